"""Finite-state monitors: trace sets, prefix tree, red-blue state merging, completion and replay.

Trace sets, state merging and replay are distributed. Merging is a sequence of
decisions; each is made from rows (``operators.merging``), and only the automaton
so far, which is as small as the result, is known to the driver. ``learn`` makes
the same decisions in memory, for traces that are at hand.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Symbols of distinct traces up to which merging is done in memory; the same decisions are made from rows beyond.
AT_HAND = 20_000
COLLAPSED = "no trace is left on one side after contradictory traces are removed"


def symbol_traces(steps: DataFrame) -> DataFrame:
    """trajectory_id, symbols (in step order), positive (the run failed)."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct("step_index", "symbol"))), lambda s: s["symbol"].cast("int"))
    return steps.groupBy("trajectory_id").agg(seq.alias("symbols"), (~F.first("final_success")).alias("positive"))


def consistent_traces(traces: DataFrame, terminal: int | None = None) -> DataFrame:
    """Distinct traces with one label only: symbols, positive. ``terminal`` is appended to every trace if given."""
    t = traces if terminal is None else traces.withColumn("symbols", F.concat("symbols", F.array(F.lit(terminal))))
    per = t.groupBy("symbols").agg(F.min("positive").alias("low"), F.max("positive").alias("high"))
    return per.where("low = high").select("symbols", F.col("high").alias("positive"))


def trace_counters(traces: DataFrame) -> DataFrame:
    """One row: traces, distinct and ambiguous ones, by label."""
    per = traces.groupBy("symbols").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    both = (F.col("p") > 0) & (F.col("q") > 0)
    return per.agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("positive_traces"),
        F.coalesce(F.sum("q"), F.lit(0)).alias("negative_traces"),
        F.count_if(F.col("p") > 0).alias("distinct_positive"),
        F.count_if(F.col("q") > 0).alias("distinct_negative"),
        F.count_if(both).alias("ambiguous"),
        F.count_if((F.col("p") > 0) & ~both).alias("kept_positive"),
        F.count_if((F.col("q") > 0) & ~both).alias("kept_negative"),
    )


def prefix_tree(traces: DataFrame) -> DataFrame:
    """The prefix tree as rows: prefix, and accepting / rejecting where a trace ends there. Built from distinct prefixes,
    so its size is that of the tree, not of the traces."""
    every = traces.select("symbols", "positive", F.explode(F.sequence(F.lit(0), F.size("symbols"))).alias("k"))
    ends = F.col("k") == F.size("symbols")
    return every.groupBy(F.slice("symbols", F.lit(1), F.col("k")).alias("prefix")).agg(F.max(ends & F.col("positive")).alias("accepting"), F.max(ends & ~F.col("positive")).alias("rejecting"))


@dataclass
class Dfa:
    """Complete automaton: ``delta[state][symbol]``; every state is accepting or not."""

    delta: list[list[int]]
    accepting: set[int]
    rejecting: set[int] = field(default_factory=set)
    start: int = 0

    @property
    def alphabet(self) -> int:
        return len(self.delta[0])

    def state_after(self, symbols: Iterable[int]) -> int:
        s = self.start
        for a in symbols:
            s = self.delta[s][a]
        return s

    def accepts(self, symbols: Iterable[int]) -> bool:
        return self.state_after(symbols) in self.accepting

    def flat(self) -> list[int]:
        return [t for row in self.delta for t in row]

    def edges(self, spark: SparkSession) -> DataFrame:
        rows = [(s, a, t) for s, row in enumerate(self.delta) for a, t in enumerate(row)]
        return spark.createDataFrame(rows, "state int, symbol int, next_state int")

    def states(self, spark: SparkSession) -> DataFrame:
        rows = [(s, s in self.accepting, s in self.rejecting) for s in range(len(self.delta))]
        return spark.createDataFrame(rows, "state int, accepting boolean, rejecting boolean")


class _Merger:
    """A prefix tree under merging: a union-find forest whose classes hold transitions and a label, with an undo log in
    place of copies."""

    def __init__(self, positive: Sequence[Sequence[int]], negative: Sequence[Sequence[int]]) -> None:
        self.go: list[dict[int, int]] = [{}]
        self.label: list[int] = [0]  # 1 accepting, -1 rejecting
        for traces, mark in ((positive, 1), (negative, -1)):
            for t in traces:
                s = 0
                for a in t:
                    if a not in self.go[s]:
                        self.go[s][a] = len(self.go)
                        self.go.append({})
                        self.label.append(0)
                    s = self.go[s][a]
                if self.label[s] == -mark:
                    raise ValueError("a trace is both positive and negative")
                self.label[s] = mark
        self.up = list(range(len(self.go)))
        self.order = list(range(len(self.go)))  # of a class: that of its first node
        self.log: list[tuple] = []

    def find(self, s: int) -> int:
        while self.up[s] != s:
            s = self.up[s]
        return s

    def merge(self, red: int, blue: int) -> tuple[int, int] | None:
        """Folds blue into red; (states removed, labels that agreed), or None on a conflict. ``undo`` takes it back."""
        removed = agreed = 0
        todo = [(red, blue)]
        while todo:
            a, b = (self.find(x) for x in todo.pop())
            if a == b:
                continue
            if self.label[a] * self.label[b] < 0:
                return None
            agreed += self.label[a] * self.label[b]
            if self.label[b] and not self.label[a]:
                self.log.append(("label", a))
                self.label[a] = self.label[b]
            self.log += [("order", a, self.order[a]), ("up", b)]
            self.order[a] = min(self.order[a], self.order[b])
            self.up[b] = a
            removed += 1
            for c, t in self.go[b].items():
                if c in self.go[a]:
                    todo.append((self.go[a][c], t))
                else:
                    self.log.append(("go", a, c))
                    self.go[a][c] = t
        return removed, agreed

    def undo(self, to: int) -> None:
        while len(self.log) > to:
            kind, s, *rest = self.log.pop()
            if kind == "up":
                self.up[s] = s
            elif kind == "label":
                self.label[s] = 0
            elif kind == "order":
                self.order[s] = rest[0]
            else:
                del self.go[s][rest[0]]


def learn(positive: Sequence[Sequence[int]], negative: Sequence[Sequence[int]], alphabet: int, method: str = "blue-fringe", sink_rejects: bool = True) -> Dfa:
    """Red-blue merging. ``blue-fringe`` merges the first blue state into the red one that removes most states,
    ``rpni`` into the first that fits, ``edsm`` takes the pair over all blue states with most agreeing labels. Blue states
    come in the order of their first node, red ones in that of their promotion's. The result is completed with a rejecting sink; unlabelled states reject if ``sink_rejects``."""
    if not positive or not negative:
        raise ValueError(COLLAPSED)
    m = _Merger(positive, negative)
    promoted_at = [(0, 0)]  # order, state
    while True:
        red = [s for _, s in sorted(promoted_at)]
        fringe = sorted({m.find(t) for s in red for t in m.go[s].values()} - set(red), key=lambda t: m.order[t])
        if not fringe:
            break
        best = None
        promoted = None
        for blue in fringe if method == "edsm" else fringe[:1]:
            fits = False
            for r in red:
                at = len(m.log)
                got = m.merge(r, blue)
                m.undo(at)
                if got is None:
                    continue
                fits = True
                value = {"blue-fringe": got[0], "rpni": 0, "edsm": got[1]}[method]
                if best is None or value > best[0]:
                    best = (value, r, blue)
                if method == "rpni":
                    break
            if not fits:
                promoted = blue
                break
        if promoted is not None or best is None:
            state = promoted if promoted is not None else fringe[0]
            promoted_at.append((m.order[state], state))
        else:
            m.merge(best[1], best[2])
    number = {s: i for i, s in enumerate(red)}
    sink = len(red)
    delta = [[number[m.find(m.go[s][a])] if a in m.go[s] else sink for a in range(alphabet)] for s in red]
    delta.append([sink] * alphabet)
    accepting = {number[s] for s in red if m.label[s] == 1}
    rejecting = {number[s] for s in red if m.label[s] == -1 or (sink_rejects and m.label[s] == 0)} | {sink}
    return Dfa(delta, accepting, rejecting, number[m.find(0)])


METHODS = {"legacy": ("blue-fringe", False), "aalpy": ("edsm", True), "aalpy-edsm": ("edsm", True), "aalpy-rpni": ("rpni", True)}


def learn_with(backend: str, positive, negative, alphabet: int) -> Dfa:
    if backend not in METHODS:
        raise ValueError(f"unknown learner {backend}; known are {', '.join(METHODS)}")
    method, rejects = METHODS[backend]
    return learn(positive, negative, alphabet, method, rejects)


def induce(traces: DataFrame, alphabet: int, backend: str = "legacy", end_symbol: bool = True) -> Dfa:
    """Learns from the consistent traces of a frame (symbols, positive), however many; with ``end_symbol`` each is closed by
    symbol ``alphabet``, which replayed prefixes never hold."""
    from tracewarden.operators.merging import learn_frame

    if backend not in METHODS:
        raise ValueError(f"unknown learner {backend}; known are {', '.join(METHODS)}")
    method, rejects = METHODS[backend]
    kept, k = consistent_traces(traces, alphabet if end_symbol else None).persist(), alphabet + 1 if end_symbol else alphabet
    try:
        if kept.agg(F.coalesce(F.sum(F.size("symbols") + 1), F.lit(0))).first()[0] > AT_HAND:
            return learn_frame(kept, k, method, rejects)
        rows = kept.orderBy("symbols").collect()  # at most AT_HAND symbols
        return learn(*([list(r["symbols"]) for r in rows if r["positive"] == flag] for flag in (True, False)), k, method, rejects)
    finally:
        kept.unpersist()


def replay(symbols: Column, dfa: Dfa) -> Column:
    """States after 1..L symbols by one fold over the sequence."""
    table = F.lit(dfa.flat())
    k = dfa.alphabet
    none = F.array().cast("array<int>")
    step = lambda acc, a: F.concat(acc, F.array(F.get(table, F.coalesce(F.element_at(acc, -1), F.lit(dfa.start)) * k + a)))
    return F.aggregate(symbols, none, lambda acc, a: F.when(F.size(acc) == 0, F.array(F.get(table, F.lit(dfa.start * k) + a))).otherwise(step(acc, a)))


def replay_steps(steps: DataFrame, dfa: Dfa) -> DataFrame:
    """``steps`` with the automaton's ``state`` after each step: one fold per run, O(L)."""
    runs = symbol_traces(steps).select("trajectory_id", F.posexplode(replay(F.col("symbols"), dfa)).alias("k", "state"))
    states = runs.select("trajectory_id", (F.col("k") + 1).alias("step_index"), "state")
    return steps.join(states, ["trajectory_id", "step_index"])
