"""Centroid clustering in exact integers with block-norm screening (operator 12).

Vectors become integers floor(scale * x) once, and are stored compressed: the
integers in 16 bits where they fit, beside the norm of each segment of the
vector. In every round a task knows all centroids and their segment norms (a
fixed number of them). By Cauchy and Schwarz the inner product of two vectors is
at most that of their segment norms, so

    |x - c|^2 >= sum over segments of (|x_s| - |c_s|)^2,

which costs one product of small matrices for a whole batch. The centroid with
the least bound is measured exactly first; of the others only those whose bound
does not exceed the best exact distance so far are measured, in integers. Bounds
are lowered by a margin above the rounding of their norms, so none screens out a
centroid that would win or tie.

A task returns the component sums of its clusters; Spark adds them up exactly,
and the driver divides ``k * dims`` numbers, whatever the input holds.

Cases: vectors that are null, of another length or with a null or non-finite
component are left out; equal vectors and repeated ids are rows of their own; a
null vec_id comes last in the start order; fewer vectors than ``k`` make as many
clusters; none make an empty result; components beyond 2^53 count as 2^53, and a
distance or inertia that no long holds is given as the largest long; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import common as C

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Components of a segment.
SEGMENT = 4
LARGEST, LARGEST_LONG = 1 << 53, (1 << 63) - 1
#: Components up to this keep squared distances of 64 components within 62 bits.
SAFE = 1 << 27
#: Norms are stored as single floats; bounds are lowered by this share of both squared lengths.
MARGIN = 1e-6
ROWS = 8192


def segment_norms(q: np.ndarray) -> np.ndarray:
    x = q.astype(np.float64)
    return np.sqrt((x * x).reshape(len(q), -1, SEGMENT).sum(axis=2))


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _compress(dims: int, scale: int) -> Callable:
    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """vec_id, q (integers of 16 or 64 bits), norms (single floats) of each vector that is kept."""
        for batch in batches:
            b = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("embedding")), dims), False))
            if not b.num_rows:
                continue
            flat = b.column("embedding").flatten()
            x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
            fine = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                q = np.clip(np.floor(scale * x[fine]), -LARGEST, LARGEST).astype(np.int64)
            ids = b.column("vec_id").filter(pa.array(fine))
            narrow = (np.abs(q) < 1 << 15).all(axis=1)
            for some, kind in ((narrow, "<i2"), (~narrow, "<i8")):
                if some.any():
                    yield pa.RecordBatch.from_arrays([ids.filter(pa.array(some)), _binary(q[some].astype(kind)), _binary(segment_norms(q[some]).astype("<f4"))], names=["vec_id", "q", "norms"])

    return compress


def compressed(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(_compress(dims, scale), "vec_id long, q binary, norms binary")


def unpacked(b: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a batch of one width at a time: their places, integers and norms."""
    q, norms = b.column("q"), b.column("norms")
    size = pc.binary_length(q).to_numpy(zero_copy_only=False)
    for width in np.unique(size):
        at = np.flatnonzero(size == width)
        for k in range(0, len(at), ROWS):
            some = pa.array(at[k : k + ROWS])
            data, low = (np.frombuffer(b"".join(x.take(some).to_pylist()), kind) for x, kind in ((q, "<i2" if width == 2 * dims else "<i8"), (norms, "<f4")))
            yield at[k : k + ROWS], data.reshape(-1, dims).astype(np.int64), low.reshape(-1, dims // SEGMENT).astype(np.float64)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(axis=1) if d.dtype == object else np.einsum("ij,ij->i", d, d)


def nearest(q: np.ndarray, norms: np.ndarray, centroids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: the smaller number), its exact squared distance, and how many were measured.
    ``norms`` and ``own``: segment norms of rows and centroids."""
    if max(np.abs(q).max(initial=0), np.abs(centroids).max()) > SAFE:
        q, centroids = q.astype(object), centroids.astype(object)  # Python's integers
    size, own_size = (norms * norms).sum(axis=1), (own * own).sum(axis=1)
    both = size[:, None] + own_size[None, :]
    low = both - 2 * (norms @ own.T) - MARGIN * both
    who = low.argmin(axis=1)
    best = squared(q, centroids[who])
    measured, first = len(q), who.copy()
    for j in range(len(centroids)):
        rows = np.flatnonzero((low[:, j] <= best) & (first != j))
        if len(rows):
            d = squared(q[rows], centroids[j])
            wins = (d < best[rows]) | ((d == best[rows]) & (j < who[rows]))
            best[rows[wins]], who[rows[wins]] = d[wins], j
            measured += len(rows)
    return who, best, measured


def _sums(centroids: np.ndarray) -> Callable:
    own = segment_norms(centroids)
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """cluster, dim, total, n: component sums of the task's vectors by nearest centroid."""
        total, n = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for b in batches:
            for _, q, norms in unpacked(b, dims):
                who, _, _ = nearest(q, norms, centroids, own)
                order = np.argsort(who, kind="stable")
                here, at = np.unique(who[order], return_index=True)
                total[here] += np.add.reduceat(q[order], at, axis=0).astype(object)  # at most ROWS times 2^53
                n[here] += np.diff(np.append(at, len(order)))
        some = np.flatnonzero(n)
        cluster, dim = np.repeat(some, dims), np.tile(np.arange(dims), len(some))
        values = pa.array([Decimal(int(x)) for x in total[some].ravel()], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(dim, pa.int32()), values, pa.array(n[cluster])], names=["cluster", "dim", "total", "n"])

    return sums


def _assign(centroids: np.ndarray) -> Callable:
    own = segment_norms(centroids)
    k, dims = centroids.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, distance = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64)
            for at, q, norms in unpacked(b, dims):
                cluster[at], best, _ = nearest(q, norms, centroids, own)
                distance[at] = np.minimum(best, LARGEST_LONG).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return assign


def start(rows: DataFrame, k: int, dims: int, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``, in that order (equal ids: by their bytes)."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(F.asc_nulls_last(key), "q").limit(k).select("q").collect()
    return np.array([np.frombuffer(r["q"], "<i2" if len(r["q"]) == 2 * dims else "<i8").astype(np.int64) for r in first], np.int64).reshape(-1, dims)


def update(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every non-empty cluster's floor of the mean, component by component; empty ones as they are."""
    sums = rows.mapInArrow(_sums(centroids), "cluster int, dim int, total decimal(38,0), n long").groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():  # k * dims rows
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that is kept."""
    spark = vectors.sparkSession
    rows = C.stored(compressed(vectors, dims, scale), "vectors")
    now = start(rows, k, dims, seed)
    schema = "vec_id long, cluster int, distance long"
    if not len(now):
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        now = update(rows, now)
    assigned = C.stored(rows.mapInArrow(_assign(now), schema), "assigned")
    held = {r["cluster"]: int(r["inertia"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}  # k rows
    whole = min(sum(held.values()), LARGEST_LONG)
    named = [(i, min(x, LARGEST_LONG), whole, hashlib.sha256(",".join(map(str, now[i].tolist())).encode()).hexdigest()) for i, x in sorted(held.items())]
    return assigned.join(F.broadcast(spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _sql(rounds: int = ROUNDS) -> str:
    """The rounds one after the other, each centroid measured for each vector."""
    near = "min({{'d': CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'c': c.cluster}}) AS m FROM v CROSS JOIN c{0} c GROUP BY v.rid"
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS cluster, q FROM v QUALIFY cluster < 40)",
    ]
    for i in range(rounds):
        steps += [
            f"a{i} AS (SELECT v.rid, {near.format(i)}),",
            f"e{i} AS (SELECT a.m.c AS cluster, unnest(v.q) AS x, generate_subscripts(v.q, 1) AS dim FROM a{i} a JOIN v ON v.rid = a.rid)",
            f"s{i} AS (SELECT cluster, dim, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM e{i} GROUP BY ALL)",
            f"m{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY dim) AS q FROM s{i} GROUP BY cluster)",
            f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m ON c.cluster = m.cluster)",
        ]
    last = (
        f"SELECT v.vec_id, CAST(f.m.c AS INTEGER) AS cluster, f.m.d AS distance, CAST(sum(f.m.d) OVER (PARTITION BY f.m.c) AS BIGINT) AS cluster_inertia, CAST(sum(f.m.d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM f JOIN v ON v.rid = f.rid JOIN c{rounds} c ON c.cluster = f.m.c"
    )
    return "WITH " + ",\n".join(x.rstrip(",") for x in [*steps, f"f AS (SELECT v.rid, {near.format(rounds)})"]) + "\n" + last


SQL = _sql()
