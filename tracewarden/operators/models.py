"""Warning models: soft automaton, prefix heads, baselines and losses.

Scoring is per run: a window or a fold where arrays suffice, numpy on Arrow batches
where a run needs dense algebra. ``operators.descent`` trains on the executors;
``train_soft_fsm`` fits runs that are at hand.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.operators.symbols import gelu

#: Other names of the model types.
ALIASES = {"coupled": "soft-fsm", "uncoupled-flat": "symbol-flat", "uncoupled-gru": "symbol-gru", "uncoupled-transformer": "symbol-transformer"}
MODEL_TYPES = ("soft-fsm", "symbol-flat", "symbol-gru", "symbol-transformer")


def model_type(name: str) -> str:
    found = ALIASES.get(name.strip().lower(), name.strip().lower())
    if found not in MODEL_TYPES:
        raise ValueError(f"unknown model {name}; known are {', '.join(MODEL_TYPES)}")
    return found


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.where(x >= 0, 1 / (1 + np.exp(-np.abs(x))), np.exp(-np.abs(x)) / (1 + np.exp(-np.abs(x))))


def softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


@dataclass
class SoftFsm:
    """State distribution pushed through symbol-weighted transition matrices: logits (K, Q, Q), start (Q), w (Q), b."""

    logits: np.ndarray
    start: np.ndarray
    w: np.ndarray
    b: float
    temperature: float = 1.0

    @classmethod
    def fixed(cls, states: int, symbols: int) -> SoftFsm:
        """Parameters from a rule, for tests and queries."""
        k, i, j = np.meshgrid(np.arange(symbols), np.arange(states), np.arange(states), indexing="ij")
        return cls(np.sin(1.0 + k + 2 * i + 3 * j), np.array([4.0] + [-4.0] * (states - 1)), np.linspace(-1, 1, states), -0.5, 0.5)

    def transitions(self) -> np.ndarray:
        return softmax(self.logits / max(self.temperature, 1e-4))

    def states(self, probs: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """State distributions after each step; a masked step keeps the state."""
        a, s, out = self.transitions(), softmax(self.start), []
        for t, p in enumerate(probs):
            if mask is None or mask[t]:
                s = s @ np.tensordot(p, a, axes=1)
                s = s / max(s.sum(), 1e-8)
            out.append(s)
        return np.array(out).reshape(len(probs), len(self.start))

    def scores(self, probs: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        return sigmoid(self.states(probs, mask) @ self.w + self.b)


def _per_run(steps: DataFrame, score, probs: str = "probs") -> DataFrame:
    """trajectory_id, step_index, score: ``score`` maps a run's (L, K) matrix to L numbers. Runs are gathered as arrays and
    scored in Arrow batches, so a batch holds many runs and a run never more than its own steps."""
    runs = steps.groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("step_index", F.col(probs).alias("p")))).alias("s"))
    runs = runs.select("trajectory_id", F.transform("s", lambda x: x["step_index"]).alias("index"), F.transform("s", lambda x: x["p"]).alias("p"))

    @F.pandas_udf("array<double>")
    def apply(p: pd.Series) -> pd.Series:
        return p.map(lambda x: score(np.array([np.asarray(r, float) for r in x])).tolist())

    scored = runs.withColumn("score", apply("p"))
    return scored.select("trajectory_id", F.explode(F.arrays_zip("index", "score")).alias("z")).select("trajectory_id", F.col("z.index").alias("step_index"), F.col("z.score").alias("score"))


def soft_fsm_scores(steps: DataFrame, model: SoftFsm) -> DataFrame:
    return _per_run(steps, model.scores)


def prefix_average(steps: DataFrame, symbols: int, probs: str = "probs") -> DataFrame:
    """``mean_probs``: mean of the symbol probabilities over steps 1..i."""
    w = W.partitionBy("trajectory_id").orderBy("step_index").rowsBetween(W.unboundedPreceding, 0)
    return steps.withColumn("mean_probs", F.array(*(F.avg(F.get(probs, k)).over(w) for k in range(symbols))))


def flat_head(v: np.ndarray, c: np.ndarray, w: np.ndarray, b: float):
    """Scores of the running mean through one hidden layer."""

    def score(p: np.ndarray) -> np.ndarray:
        mean = np.cumsum(p, axis=0) / np.arange(1, len(p) + 1)[:, None]
        return sigmoid(gelu(mean @ v.T + c) @ w + b)

    return score


def gru_head(params: dict[str, np.ndarray]):
    """Scores of a gated recurrent unit over projected probabilities: proj, proj_b, w_ih (3H, D), w_hh (3H, H), b_ih, b_hh,
    w, b; gates in the order reset, update, new."""

    def score(p: np.ndarray) -> np.ndarray:
        x = gelu(p @ params["proj"].T + params["proj_b"])
        size = params["w_hh"].shape[1]
        h, out = np.zeros(size), []
        for row in x:
            gi, gh = params["w_ih"] @ row + params["b_ih"], params["w_hh"] @ h + params["b_hh"]
            r, z = sigmoid(gi[:size] + gh[:size]), sigmoid(gi[size : 2 * size] + gh[size : 2 * size])
            n = np.tanh(gi[2 * size :] + r * gh[2 * size :])
            h = (1 - z) * n + z * h
            out.append(h)
        return sigmoid(np.array(out) @ params["w"] + params["b"])

    return score


def positions(length: int, dim: int) -> np.ndarray:
    """Sinusoidal position code."""
    angle = np.arange(length)[:, None] * np.exp(np.arange(0, dim, 2) * (-math.log(10000.0) / dim))
    out = np.zeros((length, dim))
    out[:, 0::2], out[:, 1::2] = np.sin(angle), np.cos(angle)[:, : dim // 2]
    return out


def _norm(x: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    m, v = x.mean(-1, keepdims=True), x.var(-1, keepdims=True)
    return (x - m) / np.sqrt(v + 1e-5) * g + b


def transformer_head(params: dict, heads: int = 2):
    """Scores of a causal pre-norm transformer: proj, proj_b, layers (ln1, ln2 pairs, qkv, qkv_b, out, out_b, up, up_b,
    down, down_b), w, b."""

    def score(p: np.ndarray) -> np.ndarray:
        x = gelu(p @ params["proj"].T + params["proj_b"])
        length, dim = x.shape
        x = x + positions(length, dim)
        closed = np.triu(np.full((length, length), -np.inf), 1)
        for layer in params["layers"]:
            y = _norm(x, *layer["ln1"]) @ layer["qkv"].T + layer["qkv_b"]
            q, k, v = (part.reshape(length, heads, dim // heads).transpose(1, 0, 2) for part in np.split(y, 3, axis=1))
            a = softmax(q @ k.transpose(0, 2, 1) / math.sqrt(dim // heads) + closed)
            x = x + (a @ v).transpose(1, 0, 2).reshape(length, dim) @ layer["out"].T + layer["out_b"]
            x = x + gelu(_norm(x, *layer["ln2"]) @ layer["up"].T + layer["up_b"]) @ layer["down"].T + layer["down_b"]
        return sigmoid(x @ params["w"] + params["b"])

    return score


def head_scores(steps: DataFrame, score) -> DataFrame:
    """Scores of any head above for every prefix."""
    return _per_run(steps, score)


# --- losses ----------------------------------------------------------------------------------------------------------


def compactness_loss(rows: DataFrame, symbols: int, weight: float = 1.0, probs: str = "probs") -> DataFrame:
    """One row: mean entropy of the rows less ``weight`` times the entropy of the mean row; probabilities from 1e-8."""
    h = lambda p: -F.aggregate(p, F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(1e-8)) * F.log(F.greatest(x, F.lit(1e-8))))
    means = rows.agg(F.avg(h(F.col(probs))).alias("row"), F.array(*(F.avg(F.get(probs, k)) for k in range(symbols))).alias("mean"))
    return means.select((F.col("row") - weight * h(F.col("mean"))).alias("loss"))


def batch_contrastive_loss(rows: DataFrame, temperature: float = 0.1) -> DataFrame:
    """One row: the supervised contrastive loss over batches (batch, id, label, vector). Pairs are made inside a batch only,
    so a batch's size bounds them."""
    from tracewarden.operators.features import unit_vector

    unit = rows.select("batch", "id", "label", unit_vector(F.col("vector").cast("array<double>")).alias("u"))
    other = unit.select("batch", F.col("id").alias("other"), F.col("label").alias("other_label"), F.col("u").alias("v"))
    dot = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    pairs = unit.join(other, "batch").where("id <> other").withColumn("s", dot / temperature)
    same = F.col("label") == F.col("other_label")
    # unit vectors keep every s at most 1 / temperature, so that is taken off before the sum of exponentials
    top = 1.0 / temperature
    anchors = pairs.groupBy("batch", "id").agg(F.avg(F.when(same, F.col("s"))).alias("near"), (F.log(F.sum(F.exp(F.col("s") - top))) + top).alias("all"))
    return anchors.agg(F.coalesce(F.avg(F.when(F.col("near").isNotNull(), F.col("all") - F.col("near"))), F.lit(0.0)).alias("loss"))


def soft_target_loss(rows: DataFrame, logits: str = "logits", targets: str = "targets") -> DataFrame:
    """One row: mean of -sum q log softmax of array columns."""
    top = F.array_max(logits)
    total = F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)) + top
    loss = F.aggregate(F.zip_with(targets, logits, lambda q, x: F.struct(q.alias("q"), x.alias("x"))), F.lit(0.0), lambda a, p: a - p["q"] * (p["x"] - total))
    return rows.agg(F.avg(loss).alias("loss"))


def soft_cross_entropy(logits: np.ndarray, targets: np.ndarray) -> float:
    """Mean of -sum q log softmax."""
    z = logits - logits.max(axis=1, keepdims=True)
    return float(-(targets * (z - np.log(np.exp(z).sum(axis=1, keepdims=True)))).sum(axis=1).mean())


def contrastive_loss(vectors: np.ndarray, labels: list, temperature: float = 0.1) -> float:
    """Supervised contrastive loss over rows with a partner of the same label; 0 without one."""
    x = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    s = x @ x.T / temperature
    np.fill_diagonal(s, -np.inf)
    same = np.array([[a == b for b in labels] for a in labels]) & ~np.eye(len(labels), dtype=bool)
    logp = s - np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - s.max(axis=1, keepdims=True)
    has = same.any(axis=1)
    return float(-(np.where(same, logp, 0).sum(axis=1)[has] / same.sum(axis=1)[has]).mean()) if has.any() else 0.0


def annealed(start: float, end: float, epoch: int, epochs: int, kind: str = "linear") -> float:
    """Temperature of an epoch counted from 1."""
    if epochs <= 1:
        return end
    x = (epoch - 1) / (epochs - 1)
    return start + x * (end - start) if kind == "linear" else end + (start - end) * 0.5 * (1 + math.cos(math.pi * x))


# --- training --------------------------------------------------------------------------------------------------------


def logistic_baseline(train: DataFrame, validation: DataFrame, features: str = "features", label: str = "label", grid: tuple[float, ...] = (0.1, 1.0, 10.0)):
    """Balanced logistic regression; the strength with the best average precision on ``validation``, the first of equals.
    Fitted by Spark ML, so the rows never leave the executors. Returns (model, strength, auprc)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    from tracewarden.operators.metrics import ranking_metrics

    n = train.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p")).first()
    weight = F.when(F.col(label) == 1, n["n"] / (2 * max(n["p"], 1))).otherwise(n["n"] / (2 * max(n["n"] - n["p"], 1)))
    weighted = train.withColumn("_weight", weight).cache()
    best = None
    try:
        for c in grid:
            model = LogisticRegression(featuresCol=features, labelCol=label, weightCol="_weight", regParam=1.0 / (c * n["n"]), standardization=False, maxIter=100).fit(weighted)
            s = model.transform(validation).select(F.get(vector_to_array("probability"), 1).alias("score"), F.col(label).alias("label"))
            ap = ranking_metrics(s).first()["auprc"]
            if best is None or ap > best[2]:
                best = (model, c, ap)
    finally:
        weighted.unpersist()
    return best


@dataclass
class Trained:
    model: SoftFsm
    history: list[dict]


def train_soft_fsm(batches, states: int, symbols: int, epochs: int = 24, rate: float = 0.05, seed: int = 1, anneal: tuple[float, float] = (1.0, 0.25)) -> Trained:
    """Fits a soft automaton by Adam on the mean binary cross-entropy of prefixes. ``batches()`` yields (probs (L, K),
    labels (L)) of runs; gradients run back through the scan by hand. The best epoch by training loss is kept."""
    rng = np.random.default_rng(seed)
    m = SoftFsm(rng.normal(0, 0.1, (symbols, states, states)), np.array([4.0] + [-4.0] * (states - 1)), rng.normal(0, 0.1, states), 0.0)
    names = ("logits", "start", "w", "b")
    m1, m2 = ({n: np.zeros_like(np.asarray(getattr(m, n), float)) for n in names} for _ in range(2))
    best, history, step = None, [], 0
    for epoch in range(1, epochs + 1):
        m.temperature = annealed(*anneal, epoch, epochs)
        total, count = 0.0, 0
        for probs, labels in batches():
            loss, grad = _fsm_gradient(m, probs, labels)
            total, count, step = total + loss * len(labels), count + len(labels), step + 1
            for n in names:
                g = np.asarray(grad[n], float)
                m1[n] = 0.9 * m1[n] + 0.1 * g
                m2[n] = 0.999 * m2[n] + 0.001 * g * g
                move = rate * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.999**step)) + 1e-8)
                setattr(m, n, getattr(m, n) - (float(move) if n == "b" else move))
        history.append({"epoch": epoch, "loss": total / max(count, 1), "temperature": m.temperature})
        if best is None or history[-1]["loss"] < best[0]:
            best = (history[-1]["loss"], SoftFsm(m.logits.copy(), m.start.copy(), m.w.copy(), m.b, m.temperature))
    return Trained(best[1], history)


def _fsm_gradient(m: SoftFsm, probs: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
    """Loss of one run and its gradient (the products are not renormalised here: rows of the matrices sum to 1)."""
    a, s0 = m.transitions(), softmax(m.start)
    mats = [np.tensordot(p, a, axes=1) for p in probs]
    states = [s0]
    for t in mats:
        states.append(states[-1] @ t)
    score = sigmoid(np.array([s @ m.w + m.b for s in states[1:]]))
    n = len(labels)
    clipped = np.clip(score, 1e-7, 1 - 1e-7)
    loss = float(-(labels * np.log(clipped) + (1 - labels) * np.log(1 - clipped)).mean())
    d = (score - labels) / n
    grad_w, grad_b = sum(x * s for x, s in zip(d, states[1:], strict=True)), float(d.sum())
    grad_a, back = np.zeros_like(a), np.zeros(len(m.start))
    for t in range(n - 1, -1, -1):
        back = back + d[t] * m.w
        grad_a += probs[t][:, None, None] * np.outer(states[t], back)[None]
        back = mats[t] @ back
    grad_start = s0 * (back - s0 @ back)
    grad_logits = a * (grad_a - (a * grad_a).sum(-1, keepdims=True)) / max(m.temperature, 1e-4)
    return loss, {"logits": grad_logits, "start": grad_start, "w": grad_w, "b": grad_b}
