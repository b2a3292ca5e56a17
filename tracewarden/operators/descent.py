"""Training on the executors: gradient sums per task, added in a tree, one update per round.

The steps of whole runs are gathered into groups of about ``GROUP_STEPS`` steps (one row each). A
round reads one batch of groups where they are. Every task adds up its groups'
gradients and returns blocks of them; blocks are added in two levels of shuffles,
and the driver sees one sum of the model's size, whatever the number of rows.

Sums are made in fixed point: integers add up alike in every order, so a round
gives the same bits however tasks are cut, ordered or repeated, and a run that is
resumed goes on as if it had not stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.operators import networks as N

GROUP_STEPS, SHARD_STEPS = 1024, 65_536
#: Numbers of a block of a sum.
BLOCK = 4096
SUMS = "block int, salt int, data binary"


def sparse_features(vector: Column) -> tuple[Column, Column]:
    """Places and values of a Spark ML vector column."""
    v = F.unwrap_udt(vector)
    dense = v["type"] == 1
    places = F.when(dense, F.transform(F.sequence(F.lit(0), F.size(v["values"]) - 1), lambda i: i)).otherwise(v["indices"])
    return places, v["values"]


def groups(steps: DataFrame, batches: int = 1, group_steps: int = GROUP_STEPS) -> DataFrame:
    """One row for each group of whole runs: batch, g, runs (array of key, steps). ``steps``: trajectory_id, step_index,
    places, features (sparse values), label, and counted and signature where there are such columns.

    A run's group depends on ids and lengths alone: runs are dealt by a hash of their id to shards, and a shard is cut
    every ``group_steps`` steps in the order of ids. A longer run is a group of its own."""
    counted = F.col("counted") if "counted" in steps.columns else F.lit(True)
    signature = F.xxhash64("signature") if "signature" in steps.columns else F.col("label").cast("long")
    step = F.struct("step_index", "places", "features", F.col("label").cast("double").alias("label"), counted.alias("counted"), signature.alias("signature"))
    runs = steps.groupBy("trajectory_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    shards = max(1, -(-steps.count() // SHARD_STEPS))
    key = F.xxhash64(F.lit(17), F.col("trajectory_id").cast("string"))
    runs = runs.select(F.col("trajectory_id").cast("string").alias("id"), key.alias("key"), F.pmod(key, F.lit(shards)).cast("int").alias("shard"), "steps", F.size("steps").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("id").rowsBetween(W.unboundedPreceding, -1))
    placed = runs.withColumn("part", (F.coalesce(before, F.lit(0)) / group_steps).cast("int"))
    out = placed.groupBy("shard", "part").agg(F.array_sort(F.collect_list(F.struct("id", "key", "steps"))).alias("runs"))
    return out.select(F.pmod(F.xxhash64("shard", "part"), F.lit(batches)).cast("int").alias("batch"), F.concat_ws(":", "shard", "part").alias("g"), "runs")


def unpacked(batch: pa.RecordBatch) -> Iterator[N.Group]:
    """The groups of an Arrow batch of rows of ``groups``."""
    runs = batch.column("runs")
    for i in range(batch.num_rows):
        own = runs.slice(i, 1).flatten()
        steps = own.field("steps")
        lengths = steps.value_lengths().to_numpy(zero_copy_only=False)
        flat = steps.flatten()
        places, values = flat.field("places"), flat.field("features")
        each = places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        number = lambda f, kind=float: flat.field(f).to_numpy(zero_copy_only=False).astype(kind)  # noqa: B023, E731
        yield N.Group(own.field("key").to_numpy(zero_copy_only=False), lengths, np.repeat(np.arange(len(flat)), each), places.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False).astype(float), number("label"), number("counted", bool), number("signature", np.int64))


# --- sums in a tree --------------------------------------------------------------------------------------------------


def exponent(steps: int) -> int:
    """Bits behind the point of a sum whose terms are at most about one for each step."""
    return max(8, min(40, 56 - int(steps).bit_length()))


def _blocks(vector: np.ndarray, fan: int) -> Iterator[pa.RecordBatch]:
    salt = TaskContext.get().partitionId() % fan
    for at in range(0, len(vector), BLOCK * 64):
        own = [vector[k : k + BLOCK] for k in range(at, min(len(vector), at + BLOCK * 64), BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(at // BLOCK, at // BLOCK + len(own)), pa.int32()), pa.array([salt] * len(own), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in own], pa.binary())], names=["block", "salt", "data"])


def _added(level: int) -> Callable:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (block, salt) at level 1, by block at level 2: each block's sum in turn."""
        now, total = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "salt", "data"])

        for b in batches:
            for block, salt, data in zip(b.column("block").to_pylist(), b.column("salt").to_pylist(), b.column("data"), strict=True):
                key = (block, salt if level == 1 else 0)
                x = np.frombuffer(data.as_buffer(), "<i8")
                if key == now:
                    total += x
                else:
                    if now is not None:
                        yield out()
                    now, total = key, x.copy()
        if now is not None:
            yield out()

    return add


def summed(rows: DataFrame, task, length: int, bits: int) -> np.ndarray:
    """Sum over all rows of vectors of ``length``: ``task`` turns an iterator of Arrow batches into one task's sum."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fan = max(1, int(parts**0.5))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _blocks(task(batches), fan)

    made = rows.mapInArrow(partial, SUMS)
    for level, keys in ((1, ["block", "salt"]), (2, ["block"])):
        made = made.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_added(level), SUMS)
    out = np.zeros(length)
    for r in made.toLocalIterator():  # as many numbers as the model has
        x = np.frombuffer(r["data"], "<i8")
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(x)] = x / float(1 << bits)
    return out


def _fixed(total: np.ndarray, x: np.ndarray, bits: int) -> None:
    total += np.rint(x * float(1 << bits)).astype(np.int64)


def flat(params: N.Params) -> np.ndarray:
    return np.concatenate([np.ravel(params[k]) for k in sorted(params)])


def shaped(vector: np.ndarray, like: N.Params) -> N.Params:
    out, at = {}, 0
    for k in sorted(like):
        n = np.size(like[k])
        out[k] = vector[at : at + n].reshape(np.shape(like[k]))
        at += n
    return out


def round_sizes(rows: DataFrame, params: N.Params, s: N.Settings, temperature: float, epoch: int) -> N.Round:
    """Sizes of a round and the mean symbol probabilities of its steps."""
    shared = rows.sparkSession.sparkContext.broadcast({k: params[k] for k in ("in_w", "in_b", "out_w", "out_b")})
    bits = 30

    def task(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(4 + s.symbols, np.int64)
        for b in batches:
            for g in unpacked(b):
                p = N.symbol_probs(N.T.Tape().leaves(shared.value), g, temperature, N.noise_of(s, g, epoch)).value
                _fixed(total, np.concatenate([[g.n, g.counted.sum(), 1, (g.lengths > 1).sum()], p.sum(axis=0)]), bits)
        return total

    out = summed(rows, task, 4 + s.symbols, bits)
    shared.unpersist()
    steps, counted, n_groups, runs = (round(x) for x in out[:4])
    return N.Round(steps, counted, n_groups, runs, out[4:] / max(steps, 1))


def round_gradient(rows: DataFrame, params: N.Params, r: N.Round, s: N.Settings, temperatures: tuple[float, float], epoch: int) -> tuple[float, N.Params]:
    """Loss of a round and its gradient."""
    shared = rows.sparkSession.sparkContext.broadcast(params)
    bits, scale = exponent(r.steps), max(r.steps, 1)
    length = 3 + sum(np.size(v) for v in params.values())

    def task(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(length, np.int64)
        for b in batches:
            for g in unpacked(b):
                parts, grad = N.gradient(shared.value, g, r, s, temperatures, N.noise_of(s, g, epoch))
                _fixed(total, np.concatenate([parts, flat(grad)]) * scale, bits)  # shares are of the order 1 / steps
        return total

    out = summed(rows, task, length, bits) / scale
    shared.unpersist()
    return N.total_loss(out[:3], r, s), shaped(out[3:], params)


# --- updates ---------------------------------------------------------------------------------------------------------


@dataclass
class Adam:
    """Adam with decoupled weight decay; its state is part of a checkpoint."""

    rate: float = 1e-2
    decay: float = 1e-4
    step: int = 0
    first: N.Params = field(default_factory=dict)
    second: N.Params = field(default_factory=dict)

    def update(self, params: N.Params, grad: N.Params) -> N.Params:
        self.step += 1
        out = {}
        for k, v in params.items():
            g = grad[k]
            self.first[k] = 0.9 * self.first.get(k, np.zeros_like(v)) + 0.1 * g
            self.second[k] = 0.999 * self.second.get(k, np.zeros_like(v)) + 0.001 * g * g
            move = (self.first[k] / (1 - 0.9**self.step)) / (np.sqrt(self.second[k] / (1 - 0.999**self.step)) + 1e-8)
            out[k] = np.asarray(v - self.rate * move - self.rate * self.decay * v)
        return out


def run_epoch(table: DataFrame, batches: int, params: N.Params, adam: Adam, s: N.Settings, temperatures: tuple[float, float], epoch: int) -> tuple[N.Params, float]:
    """One round for each batch, in an order drawn from seed and epoch; returns the parameters and the mean loss."""
    losses = []
    for b in np.random.default_rng([s.seed, epoch]).permutation(batches):
        rows = table.where(F.col("batch") == int(b)).select("runs")
        r = round_sizes(rows, params, s, temperatures[0], epoch)
        if r.steps:
            loss, grad = round_gradient(rows, params, r, s, temperatures, epoch)
            params = adam.update(params, grad)
            losses.append(loss)
    return params, float(np.mean(losses)) if losses else 0.0
