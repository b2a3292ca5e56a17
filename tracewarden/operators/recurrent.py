"""Small recurrent models over symbol sequences: a risk head and a next-symbol predictor.

Runs are scored where they are, in Arrow batches; ``train`` fits runs that are at
hand, ``operators.descent`` trains on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame

from tracewarden.operators.models import head_scores, sigmoid, softmax

Params = dict[str, np.ndarray]


def fresh(inputs: int, hidden: int, outputs: int, seed: int = 1) -> Params:
    """Parameters of a gated recurrent unit (gates in the order reset, update, new) with a linear layer on top."""
    rng = np.random.default_rng(seed)
    near = lambda *shape: rng.uniform(-1, 1, shape) / np.sqrt(hidden)
    return {"wx": near(3 * hidden, inputs), "wh": near(3 * hidden, hidden), "bx": near(3 * hidden), "bh": near(3 * hidden), "w": near(outputs, hidden), "b": np.zeros(outputs)}


def forward(p: Params, x: np.ndarray) -> tuple[np.ndarray, list]:
    """Outputs after each row of ``x`` and what the backward pass needs."""
    size = p["wh"].shape[1]
    h, states, kept = np.zeros(size), [], []
    for row in x:
        gx, gh = p["wx"] @ row + p["bx"], p["wh"] @ h + p["bh"]
        r, z = sigmoid(gx[:size] + gh[:size]), sigmoid(gx[size : 2 * size] + gh[size : 2 * size])
        n = np.tanh(gx[2 * size :] + r * gh[2 * size :])
        kept.append((row, h, r, z, n, gh[2 * size :]))
        h = (1 - z) * n + z * h
        states.append(h)
    hidden = np.array(states).reshape(len(x), size)
    return hidden @ p["w"].T + p["b"], [hidden, kept]


def backward(p: Params, cache: list, d_out: np.ndarray) -> Params:
    """Gradients of a loss whose gradient by the outputs is ``d_out``."""
    hidden, kept = cache
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["w"], g["b"] = d_out.T @ hidden, d_out.sum(0)
    carried = np.zeros(p["wh"].shape[1])
    for t in range(len(kept) - 1, -1, -1):
        row, before, r, z, n, pushed = kept[t]
        dh = carried + d_out[t] @ p["w"]
        dn = dh * (1 - z) * (1 - n * n)
        dz, dr = dh * (before - n) * z * (1 - z), dn * pushed * r * (1 - r)
        gx, gh = np.concatenate([dr, dz, dn]), np.concatenate([dr, dz, dn * r])
        g["wx"] += np.outer(gx, row)
        g["wh"] += np.outer(gh, before)
        g["bx"] += gx
        g["bh"] += gh
        carried = dh * z + p["wh"].T @ gh
    return g


def risk_loss(p: Params, x: np.ndarray, labels: np.ndarray) -> tuple[float, Params]:
    """Mean binary cross-entropy of the prefixes of one run."""
    out, cache = forward(p, x)
    s = np.clip(sigmoid(out[:, 0]), 1e-7, 1 - 1e-7)
    loss = float(-(labels * np.log(s) + (1 - labels) * np.log(1 - s)).mean())
    return loss, backward(p, cache, ((s - labels) / len(labels))[:, None])


def next_symbol_loss(p: Params, x: np.ndarray, _labels: np.ndarray | None = None) -> tuple[float, Params]:
    """Mean cross-entropy of each row of symbol probabilities given the rows before it."""
    if len(x) < 2:
        return 0.0, {k: np.zeros_like(v) for k, v in p.items()}
    out, cache = forward(p, x[:-1])
    guess = softmax(out)
    loss = float(-(x[1:] * np.log(np.clip(guess, 1e-12, None))).sum(1).mean())
    return loss, backward(p, cache, (guess * x[1:].sum(1, keepdims=True) - x[1:]) / len(guess))


def train(p: Params, batches: Callable[[], Iterable[tuple[np.ndarray, np.ndarray]]], loss=risk_loss, epochs: int = 12, rate: float = 0.02) -> tuple[Params, list[float]]:
    """Adam over runs; returns the parameters of the best epoch by training loss, and the losses."""
    p = {k: v.copy() for k, v in p.items()}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    best, losses, step = None, [], 0
    for _ in range(epochs):
        total, count = 0.0, 0
        for x, labels in batches():
            value, grad = loss(p, x, labels)
            total, count, step = total + value * len(x), count + len(x), step + 1
            for k, g in grad.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        losses.append(total / max(count, 1))
        if best is None or losses[-1] < best[0]:
            best = (losses[-1], {k: v.copy() for k, v in p.items()})
    return (best[1] if best else p), losses


def risk_scores(steps: DataFrame, p: Params) -> DataFrame:
    """trajectory_id, step_index, score of every prefix (column probs)."""
    return head_scores(steps, lambda x: sigmoid(forward(p, x)[0][:, 0]))


def surprise(steps: DataFrame, p: Params) -> DataFrame:
    """trajectory_id, step_index, score: how unexpected a step's symbol is (-log of its predicted probability; 0 for the
    first step)."""

    def score(x: np.ndarray) -> np.ndarray:
        if len(x) < 2:
            return np.zeros(len(x))
        guess = softmax(forward(p, x[:-1])[0])
        return np.concatenate([[0.0], -np.log(np.clip((guess * x[1:]).sum(1), 1e-12, None))])

    return head_scores(steps, score)
