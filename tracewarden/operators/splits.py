"""Deterministic partition assignment of trajectories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.functions.hashing import order_key, task_bucket


def by_cumulative(bucket: Column, names: Sequence[str], ratios: Sequence[float]) -> Column:
    """The first name whose cumulative ratio exceeds the bucket; the last name takes the rest."""
    chain, total = None, 0.0
    for name, ratio in zip(names[:-1], ratios[:-1], strict=True):
        total += ratio
        chain = F.when(bucket < total, name) if chain is None else chain.when(bucket < total, name)
    return F.lit(names[-1]) if chain is None else chain.otherwise(F.lit(names[-1]))


def _checked(ratios: Sequence[float]) -> None:
    if any(r <= 0 for r in ratios) or abs(sum(ratios) - 1) > 1e-9:
        raise ValueError(f"ratios {tuple(ratios)} must be positive and sum to 1")


def fit_cal_split(runs: DataFrame, seed: int = 1, fit_ratio: float = 0.8, cal_ratio: float = 0.2, task: str = "task_id") -> DataFrame:
    """``protocol_split`` fit or cal by task bucket."""
    _checked((fit_ratio, cal_ratio))
    return runs.withColumn("protocol_split", by_cumulative(task_bucket(task, seed), ("fit", "cal"), (fit_ratio, cal_ratio)))


def top_level_split(runs: DataFrame, seed: int = 1, ratios: Sequence[float] = (0.7, 0.1, 0.1, 0.1), task: str = "task_id") -> DataFrame:
    """``protocol_split`` fit, cal, val or test by task bucket."""
    _checked(ratios)
    return runs.withColumn("protocol_split", by_cumulative(task_bucket(task, seed), ("fit", "cal", "val", "test"), ratios))


def outer_split(runs: DataFrame, seed: int = 1, val_ratio: float = 0.1, test_ratio: float = 0.1, task: str = "task_id") -> DataFrame:
    """``protocol_split`` train, val or test by task bucket."""
    if val_ratio < 0 or test_ratio < 0 or val_ratio + test_ratio >= 1:
        raise ValueError("val and test ratios must leave something to train on")
    return runs.withColumn("protocol_split", by_cumulative(task_bucket(task, seed), ("train", "val", "test"), (1.0 - val_ratio - test_ratio, val_ratio, test_ratio)))


def stratified_split(runs: DataFrame, seed: int = 1, cal_ratio: float = 0.1, val_ratio: float = 0.1, test_ratio: float = 0.1, task: str = "task_id", run: str = "trajectory_id", strict: bool = True) -> DataFrame:
    """Quotas within each task: max(1, half-even(n * ratio)) runs to cal, val and test, the rest to fit.

    The order within a task is that of a seeded hash, so no shuffle on the driver is needed. A task with fewer than four
    runs raises in strict mode and goes to fit otherwise.
    """
    per_task = W.partitionBy(task)
    quota = lambda r: F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(r)).cast("int"))
    counted = runs.withColumns({"_n": F.count(F.lit(1)).over(per_task), "_rank": F.row_number().over(per_task.orderBy(order_key(seed, run), run))})
    counted = counted.withColumn("_fit", F.col("_n") - quota(cal_ratio) - quota(val_ratio) - quota(test_ratio))
    small = (F.col("_n") < 4) | (F.col("_fit") < 1)
    place = (
        F.when(F.col("_rank") <= F.col("_fit"), "fit")
        .when(F.col("_rank") <= F.col("_fit") + quota(cal_ratio), "cal")
        .when(F.col("_rank") <= F.col("_fit") + quota(cal_ratio) + quota(val_ratio), "val")
        .otherwise("test")
    )
    bad = F.raise_error(F.concat(F.lit("too few runs of task "), F.col(task).cast("string"))).cast("string") if strict else F.lit("fit")
    return counted.withColumn("protocol_split", F.when(small, bad).otherwise(place)).drop("_n", "_rank", "_fit")


def split_summary(runs: DataFrame, split: str = "protocol_split", task: str = "task_id") -> DataFrame:
    return runs.groupBy(split).agg(F.count(F.lit(1)).alias("trajectory_count"), F.countDistinct(task).alias("task_count"))


def select_split(runs: DataFrame, name: str, split: str = "split") -> DataFrame:
    """Runs of one split; raises with the names there are when it is empty."""
    found = runs.where(F.col(split) == name)
    if found.isEmpty():
        names = [r[0] for r in runs.select(split).distinct().limit(50).collect()]
        raise ValueError(f"no run in split {name}; there are {sorted(map(str, names))}")
    return found


def resolve_fit_cal(runs: DataFrame, fit: str, cal: str, derive: bool = False, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Fit and calibration runs: two splits by name, or derived inside one where the names coincide and it is asked for."""
    if fit != cal:
        return select_split(runs, fit), select_split(runs, cal)
    if not derive:
        return (found := select_split(runs, fit)), found
    inner = fit_cal_split(select_split(runs, fit), seed)
    return select_split(inner, "fit", "protocol_split"), select_split(inner, "cal", "protocol_split")


def scrambled_prefixes(prefixes: DataFrame, seed: int = 1, run: str = "trajectory_id") -> DataFrame:
    """``permutation``: the steps 1..prefix_index in a seeded order; only the last position is labelled."""
    keys = F.transform(F.sequence(F.lit(1), "prefix_index"), lambda k: F.struct(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(run).cast("string"), F.col("prefix_index").cast("string"), k.cast("string")), 256).alias("h"), k.alias("k")))
    return prefixes.withColumn("permutation", F.transform(F.array_sort(keys), lambda s: s["k"]))


def distinct_runs(views: DataFrame, keys: Sequence[str] = ("split", "trajectory_id", "n_steps", "final_success"), position: str = "position") -> DataFrame:
    """The first view of each source run."""
    w = W.partitionBy(*keys).orderBy(position)
    return views.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def first_per_split(runs: DataFrame, n: int, split: str = "split", position: str = "position") -> DataFrame:
    return runs.withColumn("_k", F.row_number().over(W.partitionBy(split).orderBy(position))).where(F.col("_k") <= n).drop("_k")
