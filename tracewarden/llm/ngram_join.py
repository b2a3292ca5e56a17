"""Exact n-gram Jaccard self-join by T-occurrence search (operator 7).

A document is its set of distinct shingles of ``width`` words; two documents link
when 100 * intersection >= percent * union (3 and 90 in the query, 5 and 80 in the
pipeline's stage). Equal sets are one node, told apart by 128 bits. Nodes are found
by T-occurrence search over inverted lists:

* Two linked sets share at least T of the ``prefix`` smallest shingle hashes of
  each, so only those are indexed. Lists of one node leave at once; a node with
  too few shared shingles for any link leaves with them.
* Short lists are shipped to their nodes and heap-merged per node (DivideSkip): a
  candidate must appear often enough that the node's long lists could complete
  T. Long lists are never merged: they are probed by binary search in the
  candidate's sorted set, which also decides the link exactly.
* Nodes with so many long lists that short ones need not hold a link (large
  groups of near copies) meet inside their long lists, in blocks. No pair is a
  row there: parity signatures of the sets give a lower bound of their symmetric
  difference, and only pairs that it cannot refute come out - each node's best
  ones first, whose verified links join most of a group, then those that would
  still join two components.

No link between components is lost: a pair leaves only when its bound or its sets
refute it, or when both ends already are in one component.

Cases: null text or text without words has an empty set and is alone; fewer than
``width`` words make one shingle; repeated rows and ties fall into one node; the
smallest doc_id of a component names it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.llm import common as C
from tracewarden.llm.graph import components

WIDTH, PERCENT = 3, 90
STAGE_WIDTH, STAGE_PERCENT = 5, 80
#: Longest list that is heap-merged; longer ones are probed.
SHORT = 8
#: Nodes of a long list that meet in one block of a task, and partners that a node names in an early round.
BLOCK, BEST, ROUNDS = 20_000, 3, 2
#: Candidates that meet a node in one part.
PER_PART = 256
#: Ids of texts to fetch (16 bytes each) that may be broadcast; more are joined by a shuffle.
MANY_IDS = 250_000


def least_overlap(n, percent: int = PERCENT):
    """Least intersection of a set of ``n`` with any set that it links to: ceil(percent n / 100)."""
    return (percent * n + 99) // 100


def common_prefix(n):
    """How many shared hashes a set of ``n`` asks of a partner's prefix (never falls as n grows)."""
    return np.maximum(1, n // 20)


def prefix_length(n, percent: int = PERCENT):
    return n - least_overlap(n, percent) + common_prefix(n)


def _sql(expr: str):
    return F.expr(expr)


def _need(percent: int) -> str:
    """SQL: least T over all partners of a set of n: their sizes start at ceil(percent n / 100)."""
    return f"greatest(1, (({percent} * n + 99) div 100) div 20)"


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    return C.unique_per_row(*C.shingles(data, off, width))


def _sum_per_row(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(x, out=total[1:])
        return total[begin[1:]] - total[begin[:-1]]


def signature(h: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes in each of at least 2n buckets (a power of two), as 64-bit words. Two signatures
    differ in at most as many bits as their sets do in members."""
    bits = 64
    while bits < 2 * len(h):
        bits *= 2
    odd = np.bincount((C.mix(h) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sig: np.ndarray, words: int) -> np.ndarray:
    """A signature (last axis) at a smaller number of words: buckets that become one add their parities."""
    while sig.shape[-1] > words:
        half = sig.shape[-1] // 2
        sig = sig[..., :half] ^ sig[..., half:]
    return sig


def most_difference(n, m, percent: int = PERCENT):
    """Largest symmetric difference of linked sets of n and m."""
    return n + m - 2 * ((percent * (n + m) + 99 + percent) // (100 + percent))


def set_hash(h: np.ndarray, begin: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hash of each whole set."""
    with np.errstate(over="ignore"):
        return C.mix(_sum_per_row(C.mix(h ^ np.uint64(salt)), begin) + np.diff(begin).astype(np.uint64)).view(np.int64)


def _sketches(width: int, percent: int):
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, n, node and check (two hashes of the whole set), the smallest hashes and the signature."""
        for p in C.pieces(batches, "text"):
            h, begin = shingle_sets(*C.buffers(p.column("text")), width)
            n = np.diff(begin)
            node, check = set_hash(h, begin, 0xA5A5A5A5A5A5A5A5), set_hash(h, begin, 0x3C6EF372FE94F82B)
            size = np.where(n > 0, prefix_length(n, percent), 0)
            first = np.zeros(len(n) + 1, np.int64)
            np.cumsum(size, out=first[1:])
            at = np.arange(first[-1]) - np.repeat(first[:-1], size) + np.repeat(begin[:-1], size)
            tokens = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h[at].view(np.int64)))
            sig = pa.array([signature(h[x:y]).tobytes() for x, y in zip(begin[:-1], begin[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([p.column("doc_id"), p.column("h"), pa.array(n), pa.array(node), pa.array(check), tokens, sig], names=["doc_id", "h", "n", "node", "check", "tokens", "sig"])

    return sketches


def divide_skip(lists: list[list[int]], need: int) -> list[int]:
    """Members of at least ``need`` of the sorted lists, by a heap that skips ahead: when fewer lists than ``need`` stand
    at the smallest member, need - 1 lists are popped and moved by binary search to the next member that can still win."""
    need = max(1, need)
    if len(lists) < need:
        return []
    heap = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    found = []
    while len(heap) >= need:
        low = heap[0][0]
        popped = []
        while heap and heap[0][0] == low:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            found.append(low)
            for _, i, at in popped:
                if at + 1 < len(lists[i]):
                    heapq.heappush(heap, (lists[i][at + 1], i, at + 1))
            continue
        while heap and len(popped) < need - 1:
            popped.append(heapq.heappop(heap))
        if not heap:
            break
        goal = heap[0][0]
        for _, i, at in popped:
            lo, hi = at, len(lists[i])
            while lo < hi:
                mid = (lo + hi) // 2
                if lists[i][mid] < goal:
                    lo = mid + 1
                else:
                    hi = mid
            if lo < len(lists[i]):
                heapq.heappush(heap, (lists[i][lo], i, lo))
    return found


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of each node from its short lists; ``need`` is T less the node's long lists."""
    for batch in batches:
        a, b = [], []
        for node, need, lists in zip(batch.column("node").to_pylist(), batch.column("need").to_pylist(), batch.column("lists").to_pylist(), strict=True):
            for other in divide_skip(lists, need):
                if other != node:
                    a.append(min(node, other))
                    b.append(max(node, other))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _possible(percent: int):
    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b) that their sizes and signatures do not refute."""
        for batch in batches:
            keep = []
            for i, (n, m, x, y) in enumerate(zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("sa"), batch.column("sb"), strict=True)):
                most = most_difference(n, m, percent)
                if abs(n - m) > most:
                    continue
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                words = min(len(x), len(y))
                if int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) <= most:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return possible


def block_pairs(node: np.ndarray, n: np.ndarray, sigs: list[np.ndarray], group: np.ndarray, side: np.ndarray, best: int | None, percent: int = PERCENT) -> set[tuple[int, int]]:
    """Pairs of one block that sizes and signatures do not refute and whose ends are in two groups. ``side``: 0 and 1 for
    a block of two parts of a list, of which only pairs across the parts count; 2 for one part. ``best``: how many
    partners a node names, the nearest first; all if None."""
    out: set[tuple[int, int]] = set()
    words = np.array([len(x) for x in sigs])
    for w in np.unique(words):
        here = np.flatnonzero(words == w)
        there = np.concatenate([here, np.flatnonzero(words == 2 * w)])
        own = np.stack([sigs[i] for i in here])
        other = np.concatenate([own, *([folded(np.stack([sigs[i] for i in there[len(here) :]]), w)] if len(there) > len(here) else [])])
        for at in range(0, len(here), 256):
            rows = here[at : at + 256]
            x = own[at : at + 256]
            near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for to in range(0, len(there), 2048):
                cols = there[to : to + 2048]
                most = most_difference(n[rows][:, None], n[cols][None, :], percent)
                ok = (np.abs(n[rows][:, None] - n[cols][None, :]) <= most) & (group[rows][:, None] != group[cols][None, :])
                ok &= (side[rows][:, None] != side[cols][None, :]) | (side[rows][:, None] == 2)
                if not ok.any():
                    continue
                d = np.zeros(ok.shape, np.int32)
                for k in range(int(w)):
                    d += np.bitwise_count(x[:, k][:, None] ^ other[to : to + 2048, k][None, :])
                i, j = np.nonzero(ok & (d <= most))
                near.append((rows[i], cols[j], d[i, j]))
            if not near:
                continue
            i, j, d = (np.concatenate(v) for v in zip(*near, strict=True))
            if best is not None:
                order = np.lexsort((d, i))
                i, j = i[order], j[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[rank < best], j[rank < best]
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            out.update(zip(a.tolist(), b.tolist(), strict=True))
    return out


def _meeting(best: int | None, percent: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (t, part): each block in turn; a task says a pair once."""
        said: set[tuple[int, int]] = set()
        held: list[tuple] = []
        key = None

        def close() -> pa.RecordBatch | None:
            node, n, group, side = (np.array([r[i] for r in held], np.int64) for i in (0, 1, 2, 3))
            found = block_pairs(node, n, [r[4] for r in held], group, side, best, percent) - said
            if len(said) < 1_000_000:
                said.update(found)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("t", "part", "node", "n", "component", "side")]
            for t, part, node, n, component, side, sig in zip(*cols, batch.column("sig"), strict=True):
                if (t, part) != key:
                    if len(held) > 1:
                        yield close()
                    held, key = [], (t, part)
                held.append((node, n, component, side, np.frombuffer(sig.as_buffer(), np.uint64).copy()))
        if len(held) > 1:
            yield close()

    return meet


def meeting_pairs(meet: DataFrame, sigs: DataFrame, groups: DataFrame | None, best: int | None, percent: int) -> DataFrame:
    """Candidates (a, b) of the long lists across components. A list is cut into blocks of at most ``BLOCK`` nodes, and
    every two of its blocks meet in one task."""
    n = C.parts(meet.sparkSession)
    rows = meet.join(sigs, "node")
    component = F.col("node")
    if groups is not None:
        rows = rows.join(groups, "node", "left")
        component = F.coalesce("component", "node")
    sizes = meet.groupBy("t").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = rows.withColumn("component", component).join(sizes, "t").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    part = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct((F.least("block", o) * F.col("blocks") + F.greatest("block", o)).alias("part"), F.when(F.col("block") == o, 2).when(F.col("block") < o, 0).otherwise(1).alias("side"))))
    placed = rows.select("t", "node", "n", "component", "sig", part.alias("p")).select("t", "p.part", "p.side", "node", "n", "component", "sig")
    if groups is not None:  # lists within one component have nothing left to say
        mixed = rows.groupBy("t").agg((F.min("component") != F.max("component")).alias("mixed")).where("mixed").select("t")
        placed = placed.join(mixed, "t", "left_semi")
    return placed.repartition(n, "t", "part").sortWithinPartitions("t", "part", "node").mapInArrow(_meeting(best, percent), "a long, b long").distinct()


def _ship(width: int):
    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The full set of each node, once for every place that asks for it; b is null where the place is its own."""
        for p in C.pieces(batches, "text", C.CHUNK_BYTES // 4):
            h, begin = shingle_sets(*C.buffers(p.column("text")), width)
            to, part, b, full = [], [], [], []
            for r, (node, places) in enumerate(zip(p.column("node").to_pylist(), p.column("places").to_pylist(), strict=True)):
                data = h[begin[r] : begin[r + 1]].tobytes()
                for x in places:
                    to.append(x["a"])
                    part.append(x["part"])
                    b.append(None if x["own"] else node)
                    full.append(data)
            for at in range(0, len(to), 512):
                cut = slice(at, at + 512)
                yield pa.RecordBatch.from_arrays([pa.array(to[cut], pa.int64()), pa.array(part[cut], pa.int64()), pa.array(b[cut], pa.int64()), pa.array(full[cut], pa.binary())], names=["a", "part", "b", "hashes"])

    return ship


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Exact test on two sorted sets: the smaller one probes the larger by binary search."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _decide(percent: int):
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (a, part, b): the row with null b brings a's own set, the others those of its candidates."""
        now, own = None, None
        for batch in batches:
            a_out, b_out = [], []
            for a, part, b, data in zip(batch.column("a").to_pylist(), batch.column("part").to_pylist(), batch.column("b").to_pylist(), batch.column("hashes"), strict=True):
                x = np.frombuffer(data.as_buffer(), np.uint64)
                if b is None:
                    now, own = (a, part), x.copy()
                elif now == (a, part) and linked(own, x, percent):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return decide


def verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets link. A node with many candidates is met in several parts."""
    n = C.parts(pairs.sparkSession)
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_PART).cast("long").alias("parts"))
    placed = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    theirs = placed.select(F.col("b").alias("node"), "a", "part", F.lit(False).alias("own"))
    own = placed.select(F.col("a").alias("node"), "a", "part", F.lit(True).alias("own")).distinct()
    places = theirs.unionByName(own).groupBy("node").agg(F.collect_list(F.struct("a", "part", "own")).alias("places"))
    rows = texts.join(places, "node").mapInArrow(_ship(width), "a long, part long, b long, hashes binary")
    return C.stored(rows.repartition(n, "a", "part").sortWithinPartitions("a", "part", "b").mapInArrow(_decide(percent), "a long, b long"), "links")


def told_apart(rows: DataFrame, clash: DataFrame) -> DataFrame:
    """``rows`` in which nodes that stand for several sets (told by ``check``) are nodes of their own."""
    marked = rows.join(C.sized_broadcast(clash.select("node", F.lit(True).alias("several"))), "node", "left")
    return marked.withColumn("node", F.when(F.col("several"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("several")


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    return members(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def members(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``classes`` with h (hash of the row's text) and best: doc_id and h of the row that stands for its component."""
    need = _need(percent)
    spark = docs.sparkSession
    n = C.parts(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    sketches = rows.mapInArrow(_sketches(width, percent), "doc_id long, h long, n long, node long, check long, tokens array<long>, sig binary")
    sets = C.stored(sketches.drop("tokens"), "sets")
    while True:
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
        nodes = C.stored(sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), first.alias("at"), F.first("n").alias("n"), F.min("check").alias("low"), F.max("check").alias("high")), "nodes")
        clash = nodes.where("low <> high")
        if clash.isEmpty():
            break
        sketches, sets = told_apart(sketches, clash), C.stored(told_apart(sets, clash), "sets")

    # inverted lists of the prefixes; equal sets post once
    posts = sketches.select("node", "n", F.explode("tokens").alias("t")).repartition(n, "t").distinct()
    shared = posts.withColumn("df", F.count(F.lit(1)).over(W.partitionBy("t"))).where("df > 1")
    by_node = W.partitionBy("node")
    # a node whose single hashes alone leave fewer than T shared ones cannot link
    counts = {"held": F.count(F.lit(1)).over(by_node), "n_long": F.count(F.when(F.col("df") > SHORT, 1)).over(by_node)}
    live = C.stored(shared.withColumns(counts).where(f"held >= {need}").drop("held"), "lists")

    members = live.where(F.col("df") <= SHORT).groupBy("t").agg(F.sort_array(F.collect_list("node")).alias("members"), F.collect_list(F.struct("node", _sql(f"{need} - n_long").alias("need"))).alias("own")).where(F.size("members") > 1)
    asked = members.select("members", F.inline("own")).groupBy("node", "need").agg(F.collect_list("members").alias("lists"))
    found = asked.mapInArrow(_search, "a long, b long").distinct()

    # nodes whose long lists alone could hold a link meet in those lists, again in a prefix of them
    heavy = live.where(F.col("df") > SHORT).where(f"n_long >= {need}")
    ordered = heavy.withColumn("k", F.row_number().over(by_node.orderBy("df", "t")))
    meet = ordered.where(f"k <= n_long - {need} + 1").select("t", "node", "n")
    meet = C.stored(meet.withColumn("df", F.count(F.lit(1)).over(W.partitionBy("t"))).where("df > 1").drop("df"), "meet")
    found = C.stored(found, "pairs")
    live_nodes = live.select("node").distinct()
    sigs = C.stored(sets.select("node", "n", "sig").join(live_nodes, "node", "left_semi").dropDuplicates(["node"]), "signatures")
    sized = found.join(sigs.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    pairs = C.stored(sized.mapInArrow(_possible(percent), "a long, b long").union(meeting_pairs(meet, sigs.drop("n"), None, BEST, percent)).distinct(), "pairs")

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).union(meet.select("node")).distinct()
    ids = nodes.join(wanted, "node", "left_semi").select("node", F.col("at.doc_id").alias("_id"), F.col("at.h").alias("_h"))
    ids = C.stored(ids, "ids")
    same = rows["doc_id"].eqNullSafe(ids["_id"]) & (rows["h"] == ids["_h"])
    texts = C.stored(rows.join(C.sized_broadcast(ids, MANY_IDS), same).select("node", "text").dropDuplicates(["node"]), "texts")
    links = verify(pairs, texts, width, percent)
    groups = components(links)
    done = pairs
    for k in range(ROUNDS if not meet.isEmpty() else 0):
        last = k == ROUNDS - 1
        more = C.stored(meeting_pairs(meet, sigs.drop("n"), groups, None if last else BEST, percent).join(done, ["a", "b"], "left_anti"), "pairs")
        if not more.isEmpty():
            links, done = links.union(verify(more, texts, width, percent)), done.union(more)
            groups = components(links)
    # components by smallest doc_id
    named = nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.min("at").alias("best"))
    of_node = C.stored(named.join(least, "component").select("node", "component_id", "best"), "classes")
    flat = sets.select("doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node"))
    return flat.join(of_node, "node", "left").select("doc_id", "h", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "best")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(C.documents(spark, sf_dir).select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, width: int = STAGE_WIDTH, percent: int = STAGE_PERCENT) -> DataFrame:
    """Pipeline stage: one row of each component of near copies (five words, similarity 0.8), with the smallest doc_id (a
    null one only where there is no other); rows without words link to nothing and all stay."""
    rows = members(docs.select("doc_id", "text"), width, percent).where("n_shingles > 0")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("h") == F.col("best.h"))
    keys = C.stored(rows.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("rows")), "keys")

    def beside(left: DataFrame, which: DataFrame, how: str) -> DataFrame:
        same = left["doc_id"].cast("long").eqNullSafe(which["_id"]) & (F.xxhash64(left["text"]) == which["_h"])
        return left.join(C.sized_broadcast(which, MANY_IDS), same, how)

    kept = beside(docs, keys.where("NOT stays").select("_id", "_h"), "left_anti")
    again = keys.where("stays AND rows > 1").select("_id", "_h")
    if not again.isEmpty():
        once = beside(kept, again, "left_semi").dropDuplicates(["doc_id", "text"])
        kept = beside(kept, again, "left_anti").unionByName(once)
    return kept.select(*docs.columns)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a AS x, b AS y FROM l UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(y), s.doc_id)) AS component_id FROM s LEFT JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, len(s)
"""
