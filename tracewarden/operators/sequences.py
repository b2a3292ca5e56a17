"""Sequence features and a small network baseline over them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.operators.models import sigmoid


def run_sequences(steps: DataFrame, vector: str, label: str = "label") -> DataFrame:
    """One row per run: vectors and labels of its steps in order. A run is never longer than its own steps, so nothing is
    padded."""
    item = F.struct("step_index", F.col(vector).alias("v"), F.col(label).alias("y"))
    runs = steps.groupBy("trajectory_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    return runs.select("trajectory_id", F.transform("s", lambda x: x["v"]).alias("vectors"), F.transform("s", lambda x: x["y"]).alias("labels"), F.size("s").alias("n_steps"))


def padded(vectors: Column, length: int, width: int) -> Column:
    """Vectors cut or filled with zero vectors to ``length``, for models that want one shape."""
    zero = F.array_repeat(F.lit(0.0), width)
    return F.concat(F.slice(vectors, 1, length), F.array_repeat(zero, F.greatest(F.lit(length) - F.size(vectors), F.lit(0))))


def mask(vectors: Column, length: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: i <= F.size(vectors))


def side_split(tokens: Column, prefixes: tuple[str, ...]) -> tuple[Column, Column]:
    """Metadata lines for the text, and those with one of the prefixes for the side channel."""
    side = lambda x: F.exists(F.lit(list(prefixes)), lambda p: x.startswith(p))
    return F.filter(tokens, lambda x: ~side(x)), F.filter(tokens, side)


def hybrid(parts: list[str], weights: np.ndarray, bias: np.ndarray) -> Column:
    """A learned linear map of concatenated vector columns, as an Arrow batch product."""

    @F.pandas_udf("array<double>")
    def project(*columns: pd.Series) -> pd.Series:
        x = np.hstack([np.stack(c.to_numpy()) for c in columns]) if len(columns[0]) else np.zeros((0, weights.shape[1]))
        return pd.Series(list(x @ weights.T + bias))

    return project(*parts)


def route_mean(chunks: Column) -> Column:
    """Vector of a step from its routes (array of arrays of vectors): the mean within each route, then over routes."""
    from tracewarden.operators.features import mean_vector

    return mean_vector(F.transform(F.filter(chunks, lambda r: F.size(r) > 0), mean_vector))


@dataclass
class Mlp:
    """One hidden layer of rectified units; ``fit`` is Adam on class-weighted cross-entropy over a bounded sample."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, hidden: int = 64, epochs: int = 200, rate: float = 0.01, seed: int = 13) -> Mlp:
        rng = np.random.default_rng(seed)
        p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (hidden, x.shape[1])), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(())]
        m1, m2 = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        weight = np.where(y > 0, (len(y) - y.sum()) / max(y.sum(), 1), 1.0)
        for t in range(1, epochs + 1):
            h = np.maximum(x @ p[0].T + p[1], 0)
            d = weight * (sigmoid(h @ p[2] + p[3]) - y) / len(y)
            dh = np.outer(d, p[2]) * (h > 0)
            for i, g in enumerate((dh.T @ x, dh.sum(0), h.T @ d, d.sum())):
                m1[i] = 0.9 * m1[i] + 0.1 * g
                m2[i] = 0.999 * m2[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m1[i] / (1 - 0.9**t)) / (np.sqrt(m2[i] / (1 - 0.999**t)) + 1e-8)
        return cls(p[0], p[1], p[2], float(p[3]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.maximum(x @ self.w1.T + self.b1, 0) @ self.w2 + self.b2)

    def transform(self, rows: DataFrame, vector: str) -> DataFrame:
        @F.pandas_udf("double")
        def score(v: pd.Series) -> pd.Series:
            return pd.Series(self.scores(np.stack(v.to_numpy()).astype(float)) if len(v) else [])

        return rows.withColumn("score", score(vector))


def bounded_sample(rows: DataFrame, vector: str, label: str = "label", limit: int = 50_000, key: str = "trajectory_id") -> tuple[np.ndarray, np.ndarray]:
    """At most ``limit`` labelled rows for driver-side training, the same ones for the same data (by hash of the key)."""
    got = rows.select(vector, label, key).orderBy(F.xxhash64(key)).limit(limit).collect()
    return np.array([r[vector] for r in got], float), np.array([r[label] for r in got], float)


def write_baseline(path: str, model: Mlp, scores: DataFrame, metrics: DataFrame, spark) -> None:
    """Weights, scores and metrics as tables below ``path`` (never a pickle)."""
    spark.createDataFrame([(model.w1.tolist(), model.b1.tolist(), model.w2.tolist(), model.b2)], "w1 array<array<double>>, b1 array<double>, w2 array<double>, b2 double").write.parquet(f"{path}/model")
    scores.write.parquet(f"{path}/scores")
    metrics.write.json(f"{path}/metrics")


def read_baseline(spark, path: str) -> Mlp:
    r = spark.read.parquet(f"{path}/model").first()
    return Mlp(np.array(r["w1"]), np.array(r["b1"]), np.array(r["w2"]), r["b2"])
