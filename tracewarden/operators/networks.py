"""Trainable monitors: a Gumbel symbolizer over step features and a warning head over its symbol probabilities.

Forward passes are written on a ``Tape``, for groups of whole runs. Parameters
are a flat dict of arrays, whose heads score with the functions of ``models``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from tracewarden.operators import models
from tracewarden.operators import tape as T

Params = dict[str, np.ndarray]
LAYERS, HEADS = 1, 2


@dataclass
class Group:
    """Some whole runs: their steps one after the other, with sparse features."""

    keys: np.ndarray  # a number for each run
    lengths: np.ndarray  # steps of each run
    rows: np.ndarray  # step of each feature value
    columns: np.ndarray
    values: np.ndarray
    labels: np.ndarray
    counted: np.ndarray  # whether the prefix counts in the loss
    signatures: np.ndarray  # label for the contrastive loss

    @property
    def n(self) -> int:
        return len(self.labels)

    def padded(self) -> tuple[np.ndarray, np.ndarray]:
        """Step of each place (runs x longest), ``n`` where there is none, and where there is one."""
        t = np.arange(self.lengths.max(initial=0))
        there = t[None, :] < self.lengths[:, None]
        first = np.cumsum(self.lengths) - self.lengths
        return np.where(there, first[:, None] + t[None, :], self.n), there


def gumbel(keys: np.ndarray, lengths: np.ndarray, symbols: int, seed: int, epoch: int) -> np.ndarray:
    """Noise of each step and symbol; a function of run, seed and epoch alone, so that a task that runs again draws the same."""
    out = [np.random.Generator(np.random.Philox(key=[int(k) & (1 << 64) - 1, (seed << 32) + epoch])).random((int(n), symbols)) for k, n in zip(keys, lengths, strict=True)]
    u = np.concatenate(out) if out else np.zeros((0, symbols))
    return -np.log(-np.log(np.clip(u, 1e-20, 1 - 1e-16)))


def noise_of(s: Settings, g: Group, epoch: int) -> np.ndarray | None:
    return gumbel(g.keys, g.lengths, s.symbols, s.seed, epoch) if s.noisy else None


# --- parameters ------------------------------------------------------------------------------------------------------


def symbolizer_params(inputs: int, hidden: int, symbols: int, rng: np.random.Generator) -> Params:
    near = lambda fan, *shape: rng.uniform(-1, 1, shape) / math.sqrt(max(fan, 1))
    # rows are sparse and of length 1: a narrower range would make all first logits alike
    return {"in_w": near(min(inputs, 16), inputs, hidden), "in_b": np.zeros(hidden), "out_w": near(hidden, symbols, hidden), "out_b": np.zeros(symbols)}


def head_params(kind: str, symbols: int, size: int, rng: np.random.Generator) -> Params:
    near = lambda fan, *shape: rng.uniform(-1, 1, shape) / math.sqrt(max(fan, 1))
    top = {"w": near(size, size), "b": np.zeros(())}
    if kind == "soft-fsm":
        return {"logits": rng.normal(0, 0.1, (symbols, size, size)), "start": np.array([4.0] + [-4.0] * (size - 1)), **top}
    if kind == "symbol-flat":
        return {"v": near(symbols, size, symbols), "c": np.zeros(size), **top}
    proj = {"proj": near(symbols, size, symbols), "proj_b": np.zeros(size)}
    if kind == "symbol-gru":
        return proj | {"w_ih": near(size, 3 * size, size), "w_hh": near(size, 3 * size, size), "b_ih": np.zeros(3 * size), "b_hh": np.zeros(3 * size), **top}
    if size % HEADS:
        raise ValueError(f"a transformer's size must be a multiple of {HEADS}")
    layers: Params = {}
    for i in range(LAYERS):
        one = {"ln1_g": np.ones(size), "ln1_b": np.zeros(size), "ln2_g": np.ones(size), "ln2_b": np.zeros(size), "qkv": near(size, 3 * size, size), "qkv_b": np.zeros(3 * size)}
        one |= {"out": near(size, size, size), "out_b": np.zeros(size), "up": near(size, 2 * size, size), "up_b": np.zeros(2 * size), "down": near(2 * size, size, 2 * size), "down_b": np.zeros(size)}
        layers |= {f"layer{i}_{k}": v for k, v in one.items()}
    return proj | layers | top


def predictor_params(symbols: int, embedding: int, hidden: int, rng: np.random.Generator) -> Params:
    """Symbol vectors and a gated recurrent unit that predicts the next symbol."""
    near = lambda fan, *shape: rng.uniform(-1, 1, shape) / math.sqrt(max(fan, 1))
    return {"vectors": rng.normal(0, 0.02, (symbols, embedding)), "w_ih": near(hidden, 3 * hidden, embedding), "w_hh": near(hidden, 3 * hidden, hidden), "b_ih": np.zeros(3 * hidden), "b_hh": np.zeros(3 * hidden), "next_w": near(hidden, symbols, hidden), "next_b": np.zeros(symbols)}


def scorer(kind: str, p: Params, temperature: float = 1.0) -> Callable[[np.ndarray], np.ndarray]:
    """The head as a function of one run's symbol probabilities, for ``models.head_scores``."""
    if kind == "soft-fsm":
        return models.SoftFsm(p["logits"], p["start"], p["w"], float(p["b"]), temperature).scores
    if kind == "symbol-flat":
        return models.flat_head(p["v"], p["c"], p["w"], p["b"])
    if kind == "symbol-gru":
        return models.gru_head(p)
    layers = []
    for i in range(LAYERS):
        one = {k.removeprefix(f"layer{i}_"): v for k, v in p.items() if k.startswith(f"layer{i}_")}
        layers.append(one | {"ln1": (one["ln1_g"], one["ln1_b"]), "ln2": (one["ln2_g"], one["ln2_b"])})
    return models.transformer_head({**p, "layers": layers}, HEADS)


# --- forward passes --------------------------------------------------------------------------------------------------


def symbol_logits(p: dict[str, T.Node], g: Group) -> T.Node:
    return T.linear(T.gelu(T.sparse_linear(g.rows, g.columns, g.values, g.n, p["in_w"], p["in_b"])), p["out_w"], p["out_b"])


def symbol_probs(p: dict[str, T.Node], g: Group, temperature: float, noise: np.ndarray | None) -> T.Node:
    z = symbol_logits(p, g)
    return T.softmax((z if noise is None else z + noise) * (1 / max(temperature, 1e-4)))


def _padded(x: T.Node, place: np.ndarray) -> T.Node:
    """(runs, longest, width), with zeros where a run has no step."""
    with_zero = x.tape.record(np.concatenate([x.value, np.zeros((1, x.value.shape[1]))]), (x, lambda g: g[:-1]))
    return with_zero[place.ravel()].reshape(*place.shape, x.value.shape[1])


def _recurrent(p: dict[str, T.Node], x: T.Node, size: int) -> T.Node:
    """States of a gated recurrent unit after each step (gates in the order reset, update, new)."""
    runs, longest = x.value.shape[:2]
    gates, h, out = T.linear(x, p["w_ih"], p["b_ih"]), x.tape.record(np.zeros((runs, size))), []
    for t in range(longest):
        gi, gh = gates[:, t], T.linear(h, p["w_hh"], p["b_hh"])
        r, z = T.sigmoid(gi[:, :size] + gh[:, :size]), T.sigmoid(gi[:, size : 2 * size] + gh[:, size : 2 * size])
        n = T.tanh(gi[:, 2 * size :] + r * gh[:, 2 * size :])
        h = n + z * (h - n)
        out.append(h)
    return T.stacked(out, 1)


def risk_logits(kind: str, p: dict[str, T.Node], x: T.Node, temperature: float) -> T.Node:
    """Logit of a failure ahead for each prefix, (runs, longest), of padded symbol probabilities."""
    runs, longest, _ = x.value.shape
    if kind == "soft-fsm":
        moves = T.softmax(p["logits"] * (1 / max(temperature, 1e-4)))
        s = T.softmax(p["start"]) + np.zeros((runs, 1))
        states = []
        for t in range(longest):
            s = T.einsum("bk,bkj->bj", x[:, t], T.einsum("bi,kij->bkj", s, moves))
            states.append(s)
        h = T.stacked(states, 1)
    elif kind == "symbol-flat":
        mean = T.running_sum(x, 1) * (1 / np.arange(1, longest + 1))[None, :, None]
        h = T.gelu(T.linear(mean, p["v"], p["c"]))
    else:
        h = T.gelu(T.linear(x, p["proj"], p["proj_b"]))
        size = h.value.shape[2]
        if kind == "symbol-gru":
            h = _recurrent(p, h, size)
        else:
            h = h + models.positions(longest, size)[None]
            closed = np.triu(np.full((longest, longest), -1e30), 1)
            for i in range(LAYERS):
                own = {k.removeprefix(f"layer{i}_"): v for k, v in p.items() if k.startswith(f"layer{i}_")}
                y = T.linear(T.normalized(h, own["ln1_g"], own["ln1_b"]), own["qkv"], own["qkv_b"]).reshape(runs, longest, 3, HEADS, size // HEADS)
                q, k, v = (y[:, :, j] for j in range(3))
                a = T.softmax(T.einsum("bqhd,bkhd->bhqk", q, k) * (1 / math.sqrt(size // HEADS)) + closed)
                mixed = T.einsum("bhqk,bkhd->bqhd", a, v).reshape(runs, longest, size)
                h = h + T.linear(mixed, own["out"], own["out_b"])
                h = h + T.linear(T.gelu(T.linear(T.normalized(h, own["ln2_g"], own["ln2_b"]), own["up"], own["up_b"])), own["down"], own["down_b"])
    return T.linear(h, p["w"].reshape(1, -1), p["b"].reshape(1)).reshape(runs, longest)


# --- losses of a group, as shares of a round's -----------------------------------------------------------------------


@dataclass(frozen=True)
class Round:
    """What a round knows before its gradients: its sizes and the mean symbol probabilities of all its steps."""

    steps: int
    counted: int
    groups: int
    runs: int
    mean: np.ndarray


@dataclass(frozen=True)
class Settings:
    """kind: one of ``models.MODEL_TYPES``, or ``predictor`` for the symbolizer trained on the next symbol, future
    signatures and compactness."""

    kind: str
    symbols: int
    seed: int = 1
    prefix_weight: float = 1.0
    compact_weight: float = 0.1
    marginal_weight: float = 1.0
    future_weight: float = 1.0
    contrast: float = 0.1
    noisy: bool = True


def compactness(probs: T.Node, r: Round, s: Settings) -> T.Node:
    """This group's share of: mean entropy of the steps less ``marginal_weight`` times the entropy of the mean. The mean's
    entropy is not a sum over groups; at a known mean its gradient is, and this share has that gradient."""
    rows = (probs * T.log_from(probs)).sum() * (-1 / max(r.steps, 1))
    slope = (np.log(np.maximum(r.mean, 1e-8)) + 1) * (s.marginal_weight / max(r.steps, 1))
    return rows + (probs * slope[None, :]).sum()


def shares(p: dict[str, T.Node], g: Group, r: Round, s: Settings, temperatures: tuple[float, float], noise: np.ndarray | None) -> tuple[T.Node, np.ndarray]:
    """This group's share of the round's loss, and its parts (prefix or next-symbol loss, contrastive loss, entropy of
    rows) as shares."""
    probs = symbol_probs(p, g, temperatures[0], noise)
    place, there = g.padded()
    compact = compactness(probs, r, s)
    entropy = -float((probs.value * np.log(np.maximum(probs.value, 1e-8))).sum()) / max(r.steps, 1)
    if s.kind != "predictor":
        z = risk_logits(s.kind, p, _padded(probs, place), temperatures[1])
        pick = lambda x: np.append(x, 0.0)[place] * there
        prefix = T.cross_entropy(z, pick(g.labels), pick(g.counted.astype(float)) / max(r.counted, 1))
        return prefix * s.prefix_weight + compact * s.compact_weight, np.array([prefix.value, 0.0, entropy])
    size = p["w_hh"].value.shape[1]
    h = _recurrent(p, _padded(T.einsum("nk,ke->ne", probs, p["vectors"]), place), size)
    steps = h.reshape(-1, size)[np.flatnonzero(there.ravel())]
    # each step but a run's last predicts the next one's symbol; a run counts once
    last = np.cumsum(g.lengths) - 1
    before = np.setdiff1d(np.arange(g.n), last)
    weight = np.repeat(1 / np.maximum(g.lengths - 1, 1), g.lengths)[before] / max(r.runs, 1)
    guess = T.log_softmax(T.linear(steps[before], p["next_w"], p["next_b"]))
    ahead = (guess * (-(probs.value[before + 1]) * weight[:, None])).sum()
    anchors = np.bincount(np.unique(g.signatures, return_inverse=True)[1])
    future = T.contrastive(steps, g.signatures, s.contrast) * (1 / max(int(anchors[anchors > 1].sum()), 1) / max(r.groups, 1))
    return ahead * s.prefix_weight + future * s.future_weight + compact * s.compact_weight, np.array([ahead.value, future.value, entropy])


def gradient(params: Params, g: Group, r: Round, s: Settings, temperatures: tuple[float, float], noise: np.ndarray | None) -> tuple[np.ndarray, Params]:
    """Parts of the loss and the gradient by every parameter."""
    tape = T.Tape()
    p = tape.leaves(params)
    loss, parts = shares(p, g, r, s, temperatures, noise)
    tape.backward(loss)
    return parts, {k: np.zeros_like(params[k]) if v.grad is None else v.grad for k, v in p.items()}


def total_loss(parts: np.ndarray, r: Round, s: Settings) -> float:
    """The round's loss from the summed parts."""
    m = np.maximum(r.mean, 1e-8)
    return float(s.prefix_weight * parts[0] + s.future_weight * parts[1] + s.compact_weight * (parts[2] + s.marginal_weight * (m * np.log(m)).sum()))
