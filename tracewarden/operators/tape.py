"""Reverse passes of dense array expressions: a tape records operations, ``backward`` walks it from the end.

Only what the networks of this package need. Arrays are a batch of runs, so a
recorded operation is one numpy call over many rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np

from tracewarden.operators.symbols import gelu as _gelu


class Node:
    """A value on a tape, and after ``backward`` the gradient of the loss by it (None: no influence)."""

    __slots__ = ("grad", "tape", "value")

    def __init__(self, tape: Tape, value) -> None:
        self.tape, self.value, self.grad = tape, np.asarray(value, float), None

    def __add__(self, other) -> Node:
        return self.tape.record(self.value + raw(other), (self, lambda g: g), (other, lambda g: g))

    def __mul__(self, other) -> Node:
        return self.tape.record(self.value * raw(other), (self, lambda g: g * raw(other)), (other, lambda g: g * self.value))

    def __sub__(self, other) -> Node:
        return self.tape.record(self.value - raw(other), (self, lambda g: g), (other, lambda g: -g))

    def __getitem__(self, at) -> Node:
        def back(g: np.ndarray) -> np.ndarray:
            out = np.zeros_like(self.value)
            np.add.at(out, at, g) if isinstance(at, np.ndarray) else out.__setitem__(at, g)
            return out

        return self.tape.record(self.value[at], (self, back))

    def reshape(self, *shape: int) -> Node:
        return self.tape.record(self.value.reshape(shape), (self, lambda g: g.reshape(self.value.shape)))

    def transpose(self, *axes: int) -> Node:
        return self.tape.record(self.value.transpose(axes), (self, lambda g: g.transpose(np.argsort(axes))))

    def sum(self) -> Node:
        return self.tape.record(self.value.sum(), (self, lambda g: np.broadcast_to(g, self.value.shape)))


class Tape:
    def __init__(self) -> None:
        self.steps: list[tuple[Node, tuple]] = []

    def leaves(self, params: dict[str, np.ndarray]) -> dict[str, Node]:
        return {k: Node(self, v) for k, v in params.items()}

    def record(self, value, *ways: tuple) -> Node:
        """A node whose gradient goes back by ``ways``: (node or constant, gradient of it given the node's own)."""
        out = Node(self, value)
        self.steps.append((out, tuple(w for w in ways if isinstance(w[0], Node))))
        return out

    def backward(self, loss: Node) -> None:
        loss.grad = np.ones_like(loss.value)
        for out, ways in reversed(self.steps):
            if out.grad is not None:
                for node, way in ways:
                    g = _fitted(way(out.grad), node.value.shape)
                    node.grad = g if node.grad is None else node.grad + g


def raw(x):
    return x.value if isinstance(x, Node) else x


def _fitted(g: np.ndarray, shape: tuple) -> np.ndarray:
    """A gradient summed over the axes along which its value was spread."""
    while g.ndim > len(shape):
        g = g.sum(axis=0)
    for i, n in enumerate(shape):
        if n == 1 and g.shape[i] != 1:
            g = g.sum(axis=i, keepdims=True)
    return g


def einsum(spec: str, *nodes) -> Node:
    """Sums of products; every index of an operand must occur in another one or in the result."""
    ins, out = spec.split("->")
    names = ins.split(",")

    def way(i: int) -> Callable:
        others = [k for k in range(len(nodes)) if k != i]
        back = f"{','.join([out, *(names[k] for k in others)])}->{names[i]}"
        return lambda g: np.einsum(back, g, *(raw(nodes[k]) for k in others), optimize=len(nodes) > 2)

    value = np.einsum(spec, *(raw(n) for n in nodes), optimize=len(nodes) > 2)
    return next(n for n in nodes if isinstance(n, Node)).tape.record(value, *((n, way(i)) for i, n in enumerate(nodes)))


def linear(x, weight: Node, bias) -> Node:
    """x W' + b over the last axis; ``weight`` is (outputs, inputs)."""
    flat = raw(x).reshape(-1, raw(x).shape[-1])
    shape = (*raw(x).shape[:-1], weight.value.shape[0])
    ways = [(weight, lambda g: g.reshape(-1, shape[-1]).T @ flat), (bias, lambda g: g.reshape(-1, shape[-1]).sum(axis=0)), (x, lambda g: (g.reshape(-1, shape[-1]) @ weight.value).reshape(raw(x).shape))]
    return weight.tape.record((flat @ weight.value.T).reshape(shape) + raw(bias), *ways)


def sparse_linear(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int, weight: Node, bias: Node) -> Node:
    """``linear`` of ``n`` sparse rows, given by places and values; ``weight`` is (inputs, outputs)."""
    out = np.zeros((n, weight.value.shape[1]))
    np.add.at(out, rows, values[:, None] * weight.value[columns])

    def back(g: np.ndarray) -> np.ndarray:
        grad = np.zeros_like(weight.value)
        np.add.at(grad, columns, values[:, None] * g[rows])
        return grad

    return weight.tape.record(out + bias.value, (weight, back), (bias, lambda g: g.sum(axis=0)))


def elementwise(x: Node, value: np.ndarray, slope: np.ndarray) -> Node:
    return x.tape.record(value, (x, lambda g: g * slope))


def gelu(x: Node) -> Node:
    v = _gelu(x.value)
    phi = np.exp(-x.value * x.value / 2) / math.sqrt(2 * math.pi)
    share = np.divide(v, x.value, out=np.full_like(v, 0.5), where=x.value != 0)
    return elementwise(x, v, share + x.value * phi)


def relu(x: Node) -> Node:
    return elementwise(x, np.maximum(x.value, 0), (x.value > 0).astype(float))


def sigmoid(x: Node) -> Node:
    e = np.exp(-np.abs(x.value))
    v = np.where(x.value >= 0, 1 / (1 + e), e / (1 + e))
    return elementwise(x, v, v * (1 - v))


def tanh(x: Node) -> Node:
    v = np.tanh(x.value)
    return elementwise(x, v, 1 - v * v)


def log_from(x: Node, least: float = 1e-8) -> Node:
    """log max(x, least); no gradient below."""
    v = np.maximum(x.value, least)
    return elementwise(x, np.log(v), np.where(x.value >= least, 1 / v, 0.0))


def softmax(x: Node) -> Node:
    e = np.exp(x.value - x.value.max(axis=-1, keepdims=True))
    p = e / e.sum(axis=-1, keepdims=True)
    return x.tape.record(p, (x, lambda g: p * (g - (g * p).sum(axis=-1, keepdims=True))))


def log_softmax(x: Node) -> Node:
    z = x.value - x.value.max(axis=-1, keepdims=True)
    v = z - np.log(np.exp(z).sum(axis=-1, keepdims=True))
    return x.tape.record(v, (x, lambda g: g - np.exp(v) * g.sum(axis=-1, keepdims=True)))


def normalized(x: Node, gain: Node, bias: Node, epsilon: float = 1e-5) -> Node:
    """Layer normalisation over the last axis."""
    m, v = x.value.mean(axis=-1, keepdims=True), x.value.var(axis=-1, keepdims=True)
    s = np.sqrt(v + epsilon)
    u = (x.value - m) / s

    def back(g: np.ndarray) -> np.ndarray:
        g = g * gain.value
        return (g - g.mean(axis=-1, keepdims=True) - u * (g * u).mean(axis=-1, keepdims=True)) / s

    return x.tape.record(u * gain.value + bias.value, (x, back), (gain, lambda g: g * u), (bias, lambda g: g))


def running_sum(x: Node, axis: int) -> Node:
    return x.tape.record(np.cumsum(x.value, axis=axis), (x, lambda g: np.flip(np.cumsum(np.flip(g, axis), axis=axis), axis)))


def stacked(nodes: Sequence[Node], axis: int) -> Node:
    return nodes[0].tape.record(np.stack([n.value for n in nodes], axis=axis), *((n, lambda g, i=i: np.take(g, i, axis=axis)) for i, n in enumerate(nodes)))


def cross_entropy(logits: Node, labels: np.ndarray, weights: np.ndarray) -> Node:
    """Weighted sum of binary cross-entropies of logits."""
    z = logits.value
    each = np.maximum(z, 0) - z * labels + np.log1p(np.exp(-np.abs(z)))
    p = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
    return logits.tape.record((weights * each).sum(), (logits, lambda g: g * weights * (p - labels)))


def contrastive(x: Node, labels: np.ndarray, temperature: float = 0.1, block: int = 4_000_000) -> Node:
    """Sum over rows with a partner of the same label: log of the summed exp similarities to all others, less the mean
    similarity to partners. Rows are scaled to length 1; similarities are made for blocks of rows."""
    size = np.maximum(np.linalg.norm(x.value, axis=1, keepdims=True), 1e-12)
    u = x.value / size
    n = len(u)
    partners = np.unique(labels, return_inverse=True)[1]
    partners = np.bincount(partners)[partners] - 1
    total, grad = 0.0, np.zeros_like(u)
    for at in range(0, n, max(1, block // max(n, 1))):
        rows = np.arange(at, min(n, at + max(1, block // max(n, 1))))
        rows = rows[partners[rows] > 0]
        if not len(rows):
            continue
        s = u[rows] @ u.T / temperature
        s[np.arange(len(rows)), rows] = -np.inf
        same = labels[rows][:, None] == labels[None, :]
        same[np.arange(len(rows)), rows] = False
        top = s.max(axis=1, keepdims=True)
        e = np.exp(s - top)
        whole = e.sum(axis=1, keepdims=True)
        near = np.where(same, s, 0).sum(axis=1) / partners[rows]
        total += float((np.log(whole[:, 0]) + top[:, 0] - near).sum())
        d = (e / whole - same / partners[rows][:, None]) / temperature
        grad[rows] += d @ u
        grad += d.T @ u[rows]
    back = (grad - u * (grad * u).sum(axis=1, keepdims=True)) / size
    return x.tape.record(total, (x, lambda g: g * back))
