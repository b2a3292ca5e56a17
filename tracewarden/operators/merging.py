"""Red-blue state merging over a frame of traces.

The red core is a partial automaton on the driver, no larger than the result. A
trace is a row: the red state at which it leaves the core and the symbols that are
left. A blue state is a red state and a symbol by which rows leave; its tree is
the set of prefixes of what is left, so no prefix tree is built.

To merge a blue state into a red one is to let its rows walk on from there. Every
candidate pair is tried at once: its rows walk through the core (a fold over an
array), and meet by grouping and joining. Two rows that end in one place with
different labels are a conflict; prefixes that are not there yet are the states
that stay. What the driver reads of a step is a few numbers for each pair.

The core is walked anew from the last written rows, so lost executors cost a
repetition; every ``STEPS`` decisions the rows are written where they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.operators.automata import COLLAPSED, Dfa
from tracewarden.plans import scratch

STEPS = 16


class Core:
    """A partial automaton: states from 0, ``go`` by (state, symbol)."""

    def __init__(self, alphabet: int) -> None:
        self.alphabet, self.go, self.size = alphabet, {}, 1

    def table(self) -> Column:
        return F.lit([self.go.get((q, a), -1) for q in range(self.size) for a in range(self.alphabet)])

    def walked(self, rows: DataFrame, state: str, symbols: str, extra: bool = False) -> DataFrame:
        """``rows`` with ``state`` and ``symbols`` where each leaves the core or ends. ``extra``: columns q0, a0 and r are one
        more transition."""
        rows = rows.withColumn("_table", self.table())
        start = F.struct(F.col(state).cast("int").alias("q"), F.lit(0).alias("k"), F.lit(False).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            to = F.get("_table", acc["q"] * self.alphabet + x)
            if extra:
                to = F.when((acc["q"] == F.col("q0")) & (x == F.col("a0")), F.col("r")).otherwise(to)
            return F.when(acc["out"] | (to < 0), F.struct(acc["q"].alias("q"), acc["k"].alias("k"), F.lit(True).alias("out"))).otherwise(F.struct(to.cast("int").alias("q"), (acc["k"] + 1).alias("k"), F.lit(False).alias("out")))

        rows = rows.withColumn("_at", F.aggregate(symbols, start, step))
        return rows.withColumns({state: F.col("_at.q"), symbols: F.slice(symbols, F.col("_at.k") + 1, F.size(symbols))}).drop("_at", "_table")


def _standing(rows: DataFrame, core: Core) -> DataFrame:
    """q, s, positive, first: the distinct places of all rows, with the first trace that stands there."""
    at = core.walked(rows, "q", "s")
    # a trace that has moved on has its place deeper in the tree
    moved = at.withColumn("first", F.struct(F.col("first.side"), F.col("first.symbols"), (F.size("first.symbols") - F.size("s")).alias("depth")))
    return moved.groupBy("q", "s").agg(F.first("positive").alias("positive"), F.min("first").alias("first"))


def _facts(live: DataFrame) -> tuple[dict[tuple[int, int], tuple], dict[int, int]]:
    """Blue states with the first trace of each, and labels of red states."""
    blue = live.where(F.size("s") > 0).groupBy("q", F.get("s", 0).alias("a")).agg(F.min("first").alias("first"), F.lit(None).cast("boolean").alias("positive"))
    ends = live.where(F.size("s") == 0).groupBy("q", F.lit(-1).alias("a")).agg(F.min("first").alias("first"), F.first("positive").alias("positive"))
    fringe, labels = {}, {}
    for r in blue.unionByName(ends).collect():  # at most states times symbols
        if r["a"] < 0:
            labels[r["q"]] = 1 if r["positive"] else -1
        else:
            fringe[r["q"], r["a"]] = (r["first"]["side"], list(r["first"]["symbols"]), r["first"]["depth"] + 1)
    return fringe, labels


def _prefixes(symbols: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(symbols)), lambda k: F.slice(symbols, F.lit(1), k))


def trials(live: DataFrame, core: Core, red: list[int], labels: dict[int, int], blues: list[tuple[int, int]], removals: bool = True) -> dict[tuple[int, int, int], tuple[int, int]]:
    """For each pair of a blue state (q, a) of ``blues`` and a red one r that can be merged: states removed and labels that
    agree. Only ``removals`` needs the prefixes of all rows; without it the states removed are given as 0."""
    leaving = live.where(F.size("s") > 0).select(F.col("q").alias("q0"), F.get("s", 0).alias("a0"), F.slice("s", F.lit(2), F.size("s")).alias("rest"), "s", "positive")
    if len(blues) == 1:
        leaving = leaving.where((F.col("q0") == blues[0][0]) & (F.col("a0") == blues[0][1]))
    pair = ["q0", "a0", "r"]
    met = core.walked(leaving.select("q0", "a0", F.explode(F.lit(red)).alias("r"), "rest", "positive").withColumn("q", F.col("r")), "q", "rest", extra=True)
    yes = F.col("positive").cast("int")
    # rows that end in the core: as many groups as pairs times red states
    ended = met.where(F.size("rest") == 0).groupBy(*pair, "q").agg(F.min(yes).alias("x"), F.max(yes).alias("y"), F.count(F.lit(1)).alias("n"))
    # rows that leave it again, against those that stand there
    again = met.where(F.size("rest") > 0).groupBy(*pair, "q", "rest").agg(F.min(yes).alias("x"), F.max(yes).alias("y"), F.count(F.lit(1)).alias("n"))
    there = live.select(F.col("q").alias("q_"), F.col("s").alias("s_"), yes.alias("z"))
    beside = again.join(there, (F.col("q") == F.col("q_")) & (F.col("rest") == F.col("s_")), "left")
    clash = (F.col("x") != F.col("y")) | F.coalesce(F.col("z") != F.col("x"), F.lit(False))
    agreed = F.col("n") - F.when(F.col("z").isNull(), 1).otherwise(0)
    left = beside.groupBy(*pair).agg(F.max(clash.cast("int")).alias("x"), F.lit(0).alias("y"), F.sum(agreed).alias("n"))
    parts = [("ended", ended), ("left", left)]
    if removals:
        # prefixes that are not there yet
        nodes = live.where(F.size("s") > 0).select("q", F.explode(_prefixes("s")).alias("prefix")).distinct()
        made = again.select(*pair, "q", F.explode(_prefixes("rest")).alias("prefix")).distinct().join(nodes, ["q", "prefix"], "left_anti")
        new = made.groupBy(*pair).agg(F.lit(0).alias("x"), F.lit(0).alias("y"), F.count(F.lit(1)).alias("n"))
        own = nodes.groupBy(F.col("q").alias("q0"), F.get("prefix", 0).alias("a0"), F.lit(-1).alias("r")).agg(F.lit(0).alias("x"), F.lit(0).alias("y"), F.count(F.lit(1)).alias("n"))
        parts += [("new", new), ("own", own)]
    tagged = [f.select(F.lit(kind).alias("kind"), *pair, (F.col("q") if kind == "ended" else F.lit(-1)).alias("q"), "x", "y", "n") for kind, f in parts]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    size, bad, same, stays = {}, set(), {}, {}
    for r in every.collect():
        key = (r["q0"], r["a0"], r["r"])
        if r["kind"] == "own":
            size[key[:2]] = r["n"]
        elif r["kind"] == "new":
            stays[key] = r["n"]
        elif r["kind"] == "left":
            bad |= {key} if r["x"] else set()
            same[key] = same.get(key, 0) + r["n"]
        else:
            has = labels.get(r["q"], 0)
            bad |= {key} if r["x"] != r["y"] or has * (2 * r["y"] - 1) < 0 else set()
            same[key] = same.get(key, 0) + r["n"] - (0 if has else 1)
    return {(q, a, r): (size.get((q, a), 0) - stays.get((q, a, r), 0), same.get((q, a, r), 0)) for q, a in blues for r in red if (q, a, r) not in bad}


def learn_frame(traces: DataFrame, alphabet: int, method: str = "blue-fringe", sink_rejects: bool = True) -> Dfa:
    """``automata.learn`` on a frame of distinct traces (symbols, positive): the same automaton, whatever their number."""
    symbols = F.col("symbols").cast("array<int>")
    side = F.when(F.col("positive"), 0).otherwise(1)
    rows = traces.select(F.lit(0).alias("q"), symbols.alias("s"), "positive", F.struct(side.alias("side"), symbols.alias("symbols"), F.lit(0).alias("depth")).alias("first"))
    rows = _written(rows)
    if rows.select("positive").distinct().count() < 2:
        raise ValueError(COLLAPSED)
    core, promoted, decisions = Core(alphabet), [((-1, [], 0), 0)], 0
    while True:
        live = _standing(rows, core)
        if decisions % STEPS == STEPS - 1:
            rows = live = _written(live)
        live = live.persist()
        fringe, labels = _facts(live)
        if not fringe:
            live.unpersist()
            break
        red = [q for _, q in sorted(promoted)]
        order = sorted(fringe, key=lambda b: fringe[b])
        fits = trials(live, core, red, labels, order if method == "edsm" else order[:1], removals=method == "blue-fringe")
        live.unpersist()
        best, stuck = None, None
        for q, a in order if method == "edsm" else order[:1]:
            for r in red:
                if (q, a, r) in fits:
                    removed, agreed = fits[q, a, r]
                    value = {"blue-fringe": removed, "rpni": 0, "edsm": agreed}[method]
                    if best is None or value > best[0]:
                        best = (value, q, a, r)
                    if method == "rpni":
                        break
            if not any((q, a, r) in fits for r in red):
                stuck = (q, a)
                break
        if stuck is not None:
            promoted.append((fringe[stuck], core.size))
            core.go[stuck] = core.size
            core.size += 1
        else:
            core.go[best[1], best[2]] = best[3]
        decisions += 1
    red = [q for _, q in sorted(promoted)]
    number, sink = {q: i for i, q in enumerate(red)}, len(red)
    delta = [[number[core.go[q, a]] if (q, a) in core.go else sink for a in range(alphabet)] for q in red] + [[sink] * alphabet]
    accepting = {number[q] for q in red if labels.get(q, 0) == 1}
    rejecting = {number[q] for q in red if labels.get(q, 0) == -1 or (sink_rejects and not labels.get(q, 0))} | {sink}
    return Dfa(delta, accepting, rejecting, number[0])


def _written(df: DataFrame) -> DataFrame:
    path = scratch.folder(df.sparkSession, "places")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
