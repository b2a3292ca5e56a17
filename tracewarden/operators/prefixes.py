"""Trajectories as rows of steps, their prefixes and look-ahead-free labels.

A steps frame has one row per (trajectory_id, step_index) with n_steps and
final_success. Prefixes stay lazy: a prefix is its run and its length, and its
steps are ``slice`` or a window, never a copied list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS = ((0, "0"), (1, "1"), (3, "2-3"), (7, "4-7"), (15, "8-15"))


def event_steps(events: DataFrame) -> DataFrame:
    """Steps of event trajectories: a user is a run, events in time order are its steps. A run succeeds if its last event
    is no error; the symbol is the rank of the event's type."""
    by_user = W.partitionBy("user_id")
    kinds = events.select("event_type").distinct().withColumn("symbol", F.row_number().over(W.orderBy("event_type")) - 1)  # one row per type
    s = events.join(F.broadcast(kinds), "event_type").select(
        F.col("user_id").alias("trajectory_id"),
        F.row_number().over(by_user.orderBy("ts", "event_id")).alias("step_index"),
        F.count(F.lit(1)).over(by_user).cast("int").alias("n_steps"),
        "event_type",
        "symbol",
        "value",
        "ts",
    )
    last = F.max_by("event_type", "step_index").over(W.partitionBy("trajectory_id"))
    return s.withColumn("final_success", last != "error").withColumn("failure_bucket", F.when(F.col("final_success"), "NONE").otherwise("EVENT_ERROR"))


def failure_label(horizon: int, index: Column | str = "step_index", length: Column | str = "n_steps", success: Column | str = "final_success") -> Column:
    """1 where the run failed and at most ``horizon`` steps are left."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return (~c(success) & (c(length) - c(index) <= horizon)).cast("int")


def remaining_bin(left: Column) -> Column:
    chain = None
    for most, name in BINS:
        chain = F.when(left <= most, name) if chain is None else chain.when(left <= most, name)
    return chain.otherwise("16+")


def future_signature(horizon: int, index: str = "step_index", length: str = "n_steps", success: str = "final_success", bucket: str = "failure_bucket") -> Column:
    """Struct of terminal_label, remaining_steps_bin, failure_bucket (NONE unless the label holds)."""
    return F.struct(
        F.when(F.col(success), "SUCCESS").otherwise("FAILURE").alias("terminal_label"),
        remaining_bin(F.col(length) - F.col(index)).alias("remaining_steps_bin"),
        F.when(failure_label(horizon, index, length, success) == 1, F.col(bucket)).otherwise("NONE").alias("failure_bucket"),
    )


def expand(steps: DataFrame, horizon: int = 3) -> DataFrame:
    """One row per prefix: the steps frame with ``label`` and ``signature``; prefix_index is the step's index."""
    return steps.withColumns({"prefix_index": F.col("step_index"), "label": failure_label(horizon), "signature": future_signature(horizon)})


def expand_nested(runs: DataFrame, horizon: int = 3) -> DataFrame:
    """Prefixes of runs with a ``steps`` array: serialized prefixes are ``slice(steps, 1, prefix_index)``."""
    rows = runs.withColumn("n_steps", F.size("steps")).withColumn("prefix_index", F.explode(F.sequence(F.lit(1), F.size("steps"))))
    return rows.withColumns({"label": failure_label(horizon, "prefix_index"), "signature": future_signature(horizon, "prefix_index"), "prefix_steps": F.slice("steps", F.lit(1), F.col("prefix_index"))})


def overridden_labels(prefixes: DataFrame, explicit: str = "explicit_labels", mask: str = "prefix_mask") -> DataFrame:
    """Labels replaced by a run's explicit list where it has one (of the run's length, 0 or 1), and prefixes that a mask
    (of the run's length, not all false) switches off taken out."""
    e, m, i, n = F.col(explicit), F.col(mask), F.col("prefix_index"), F.col("n_steps")
    fail = lambda text: F.raise_error(F.lit(text))
    label = (
        F.when(e.isNull(), F.col("label"))
        .when((F.size(e) != n) | F.exists(e, lambda x: ~x.isin(0, 1)), fail("explicit labels must be 0 or 1, one for each step").cast("int"))
        .otherwise(F.get(e, i - 1))
    )
    active = F.when(m.isNull(), F.lit(True)).when((F.size(m) != n) | ~F.exists(m, lambda x: x), fail("a prefix mask must have one value for each step and not be all false").cast("boolean")).otherwise(F.get(m, i - 1))
    return prefixes.withColumn("label", label).where(active)


def summary_by_split(prefixes: DataFrame, split: str = "split") -> DataFrame:
    return prefixes.groupBy(split).agg(
        F.countDistinct("trajectory_id").alias("trajectory_count"),
        F.count(F.lit(1)).alias("prefix_count"),
        F.sum("label").alias("positive_count"),
        F.countDistinct("signature").alias("signature_count"),
    )


def top_signatures(prefixes: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent signatures; ties in the order of the signature."""
    n = prefixes.groupBy(*(F.col(f"signature.{c}").alias(c) for c in ("terminal_label", "remaining_steps_bin", "failure_bucket"))).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "terminal_label", "remaining_steps_bin", "failure_bucket").limit(k)


def numeric_summary(rows: DataFrame, value: str, *keys: str, top: int = 5) -> DataFrame:
    """count, min, max, mean (3 digits) and the most common values of a number."""
    stats = rows.groupBy(*keys).agg(F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 3).alias("mean"))
    freq = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = freq.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), value))).where(F.col("_k") <= top)
    common = ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", value, "n"))), lambda s: F.struct(s[value].alias("value"), s["n"].alias("n"))).alias("most_common"))
    return stats.join(common, list(keys)) if keys else stats.crossJoin(common)


def prefix_documents(steps: DataFrame, text: str = "text") -> DataFrame:
    """``document``: the texts of steps 1..i joined by a boundary line."""
    w = W.partitionBy("trajectory_id").orderBy("step_index").rowsBetween(W.unboundedPreceding, 0)
    return steps.withColumn("document", F.array_join(F.collect_list(text).over(w), "\n<STEP_BOUNDARY>\n"))


def history_window(rows: DataFrame, line: str, size: int, run: str = "trajectory_id", order: str = "step_index") -> DataFrame:
    """``history``: the last ``size`` lines before each row (all for 0), NONE where there are none."""
    w = W.partitionBy(run).orderBy(order)
    frame = w.rowsBetween(-size if size > 0 else W.unboundedPreceding, -1)
    lines = F.collect_list(line).over(frame)
    return rows.withColumn("history", F.when(F.size(lines) == 0, F.lit("NONE")).otherwise(F.array_join(lines, "\n")))
