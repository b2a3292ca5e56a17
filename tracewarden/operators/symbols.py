"""Symbolisation of step vectors and hardening of symbol probabilities."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STRATEGIES = ("argmax", "sticky-margin", "sticky-confidence")


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(values: Column) -> Column:
    """Index of the largest value, the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def linear_symbols(vectors: DataFrame, weights: Sequence[Sequence[float]], vector: str = "embedding", temperature: float = 1.0) -> DataFrame:
    """``probs`` and ``symbol`` of one linear layer: the weights are literals, the product is an array expression."""
    dot = lambda w: F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.lit([float(x) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    v = vectors.withColumn("_logits", F.array(*(dot(w) / max(temperature, 1e-4) for w in weights)))
    return v.withColumn("probs", softmax(F.col("_logits"))).withColumn("symbol", argmax(F.col("_logits"))).drop("_logits")


def keyed_uniform(*parts: Column | str, seed: int = 1) -> Column:
    """A number between 0 and 1 (both left out) that depends on the seed and the parts alone."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return (F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def gumbel_softmax(rows: DataFrame, key: list[str], logits: str = "logits", temperature: float = 1.0, hard: bool = False, seed: int = 1) -> DataFrame:
    """``sample``: softmax of (logits + Gumbel noise) / temperature, with noise by row key so that a rerun draws the same;
    ``hard`` puts all weight on its largest value."""
    size = F.size(logits)
    noise = F.transform(F.sequence(F.lit(0), size - 1), lambda k: -F.log(-F.log(keyed_uniform(*key, k, seed=seed))))
    r = rows.withColumn("_noisy", F.transform(F.zip_with(logits, noise, lambda x, g: x + g), lambda x: x / max(temperature, 1e-4)))
    r = r.withColumn("sample", softmax(F.col("_noisy")))
    if hard:
        r = r.withColumn("_top", argmax(F.col("_noisy"))).withColumn("sample", F.transform(F.sequence(F.lit(0), size - 1), lambda k: (k == F.col("_top")).cast("double"))).drop("_top")
    return r.drop("_noisy")


def gelu(x: np.ndarray) -> np.ndarray:
    """x * Phi(x), with the exact error function."""
    return x * 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2)))


def mlp_symbols(vectors: DataFrame, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray, vector: str = "embedding", temperature: float = 1.0) -> DataFrame:
    """``probs`` of softmax((W2 gelu(W1 x + b1) + b2) / tau): dense algebra, so it runs on Arrow batches."""

    @F.pandas_udf("array<double>")
    def probs(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, w1.shape[1]))
        z = (gelu(m @ w1.T + b1) @ w2.T + b2) / max(temperature, 1e-4)
        e = np.exp(z - z.max(axis=1, keepdims=True)) if len(x) else z
        return pd.Series(list(e / e.sum(axis=1, keepdims=True)) if len(x) else [])

    return vectors.withColumn("probs", probs(vector)).withColumn("symbol", argmax(F.col("probs")))


def confidence(probs: Column) -> Column:
    return F.array_max(probs)


def margin(probs: Column) -> Column:
    """Largest minus second largest probability; the value itself where there is one symbol."""
    s = F.sort_array(probs, asc=False)
    return F.when(F.size(probs) > 1, F.get(s, 0) - F.get(s, 1)).otherwise(F.get(s, 0))


def harden(rows: DataFrame, strategy: str = "argmax", threshold: float | None = None, run: str = "trajectory_id", order: str = "step_index", probs: str = "probs") -> DataFrame:
    """``hard_symbol``: the top symbol; in a sticky strategy a step whose gate is under the threshold repeats the last
    one that passed (the first step always passes), which is a forward fill. Adds top_symbol, overridden and switched."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; known are {', '.join(STRATEGIES)}")
    if strategy != "argmax" and (threshold is None or not 0 <= threshold <= 1):
        raise ValueError("a sticky strategy needs a threshold from 0 to 1")
    w = W.partitionBy(run).orderBy(order)
    p = F.col(probs)
    gate = margin(p) if strategy == "sticky-margin" else confidence(p)
    r = rows.withColumns({"top_symbol": argmax(p), "confidence": confidence(p), "margin": margin(p), "_first": F.row_number().over(w) == 1})
    passes = F.lit(True) if strategy == "argmax" else F.col("_first") | (gate >= threshold)
    hard = F.last(F.when(passes, F.col("top_symbol")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    r = r.withColumn("hard_symbol", hard)
    return r.withColumns({"overridden": F.col("hard_symbol") != F.col("top_symbol"), "switched": F.coalesce(F.lag("hard_symbol").over(w) != F.col("hard_symbol"), F.lit(False))}).drop("_first")


def hardening_summary(rows: DataFrame, run: str = "trajectory_id") -> DataFrame:
    n = F.count(F.lit(1))
    return rows.groupBy(run).agg(
        n.alias("steps"),
        F.count_if("overridden").alias("override_count"),
        (F.count_if("overridden") / n).alias("override_rate"),
        F.count_if("switched").alias("switch_count"),
        (F.count_if("switched") / F.greatest(n - 1, F.lit(1))).alias("switch_rate"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg("margin").alias("mean_margin"),
    )
