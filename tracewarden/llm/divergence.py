"""Source divergence audit by sketch-prefiltered counting (operator 11).

Per language, how the word use of each source differs from that of every other source and of the language itself.

* Text is read once. Each task adds up its own (lang, source, term) counts and
  writes them, so a hot source or a frequent word is a few rows per task.
* Every task turns its rows into a count-min sketch of document frequencies.
  Sketches travel as their non-zero cells by block, saturate at the frequency
  that is asked for, and are added up block by block. A sketch never
  underestimates, so a term below the bound in any of its cells is impossible
  and its rows are discarded before the shuffle. The merged sketch has
  ``DEPTH * WIDTH`` cells whatever the input holds, which bounds its broadcast.
* Survivors are counted exactly; those that the sketch overestimated leave here.
* A pair's sum over all kept terms comes from sparse rows only: terms that both
  sources use meet in a join by term; a term that one of them lacks is worth
  that source's value for a count of zero, and these are summed in closed form
  from each source's totals and its histogram of counts.

Cases: null text, lang and source are read as ''; every row is a document, also
with a repeated or null doc_id (which is not read); a group without terms has
its rows in part ``pair``; a language without kept terms gives pairs of value 0;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.llm import common as C

MIN_DOCS, TOP = 30, 50
#: The sketch: rows, cells of a row, cells that travel together.
DEPTH, WIDTH, BLOCK = 4, 1 << 20, 1 << 12
#: Rows that a task holds before it adds equal ones up, and before it lets them go.
MERGE_ROWS, HELD_ROWS = 200_000, 500_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
COUNTED = "lang string, source string, term string, count long, docs long"


def terms(data: np.ndarray, off: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The terms of all rows (letters and everything beyond ASCII, A-Z in lower case) and the row of each."""
    solid = _LETTER[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = off[1:-1]
    inner = inner[inner < len(data)]
    first[inner] |= solid[inner]
    text = C.lower(data)[solid]
    begin = np.append(np.flatnonzero(first[solid]), len(text)).astype(np.int32)
    row = np.searchsorted(off, np.flatnonzero(first), "right") - 1
    return pa.StringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin), pa.py_buffer(text)), row


def _summed(held: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(held).group_by(["group", "term"]).aggregate([("count", "sum"), ("docs", "sum")])
    return out.rename_columns([c.removesuffix("_sum") for c in out.column_names])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``COUNTED`` for what one task reads; the term '' stands for the group itself, with its documents."""
    groups: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []
    rows = 0

    def named(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = list(groups)
        lang, source = (pa.array([x[k] for x in names], pa.string()) for k in (0, 1))
        group = table.column("group").combine_chunks()
        yield from pa.table({"lang": lang.take(group), "source": source.take(group), "term": table.column("term"), "count": table.column("count"), "docs": table.column("docs")}).to_batches(20_000)

    for p in C.pieces(batches, "text"):
        own = np.array([groups.setdefault(x, len(groups)) for x in zip(p.column("lang").to_pylist(), p.column("source").to_pylist(), strict=True)], np.int64)
        found, row = terms(*C.buffers(p.column("text")))
        coded = found.dictionary_encode()
        k = max(1, len(coded.dictionary))
        in_doc, times = np.unique(row * k + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        key = own[in_doc // k] * k + in_doc % k
        order = np.argsort(key, kind="stable")
        key, at = np.unique(key[order], return_index=True)
        count = np.add.reduceat(times[order], at) if len(at) else at
        docs = np.diff(np.append(at, len(order)))
        here, n = np.unique(own, return_counts=True)
        held.append(pa.table({"group": pa.array(key // k), "term": coded.dictionary.take(pa.array(key % k)), "count": pa.array(count, pa.int64()), "docs": pa.array(docs, pa.int64())}))
        held.append(pa.table({"group": pa.array(here), "term": pa.array([""] * len(here), pa.string()), "count": pa.array(np.zeros(len(here), np.int64)), "docs": pa.array(n, pa.int64())}))
        rows += len(key) + len(here)
        if rows > MERGE_ROWS:
            held = [_summed(held)]
            pa.default_memory_pool().release_unused()
            rows = held[0].num_rows
            if rows > HELD_ROWS:
                yield from named(held.pop())
                rows = 0
    if held:
        yield from named(_summed(held))


def term_counts(docs: DataFrame) -> DataFrame:
    """``COUNTED`` rows: occurrences and documents of each term in each group, one row for each task that saw it."""
    empty = F.lit("")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")))
    return rows.mapInArrow(_count, COUNTED)


# --- count-min sketch ------------------------------------------------------------------------------------------------


def cells(h: np.ndarray, depth: int, width: int) -> np.ndarray:
    """Places of each hash in a sketch that is laid out row after row (depth x hashes)."""
    salt = C.mix(np.arange(1, depth + 1, dtype=np.uint64))
    own = C.mix(h.view(np.uint64)[None, :] ^ salt[:, None]) & np.uint64(width - 1)
    return own.astype(np.int64) + (np.arange(depth, dtype=np.int64) * width)[:, None]


def _sketch(least: int, depth: int, width: int) -> Callable:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's sketch as its non-zero cells: block, places in it, values up to ``least``."""
        table = np.zeros(depth * width, np.int64)
        for b in batches:
            docs = np.minimum(b.column("docs").to_numpy(zero_copy_only=False), least)
            np.add.at(table, cells(b.column("h").to_numpy(zero_copy_only=False), depth, width), docs[None, :])
        at = np.flatnonzero(table)
        value = np.minimum(table[at], least).astype("<u4")
        block, first = np.unique(at // BLOCK, return_index=True)
        ends = np.append(first[1:], len(at))
        place = (at % BLOCK).astype("<u2")
        for k in range(0, len(block), 256):
            cut = list(zip(first[k : k + 256], ends[k : k + 256], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(block[k : k + 256], pa.int64()), pa.array([place[x:y].tobytes() for x, y in cut], pa.binary()), pa.array([value[x:y].tobytes() for x, y in cut], pa.binary())], names=["block", "places", "counts"])

    return sketch


def _merge(least: int) -> Callable:
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block of the sketch added up over all tasks; blocks are few and small, so they are held."""
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, places, counts in zip(b.column("block").to_pylist(), b.column("places"), b.column("counts"), strict=True):
                own = total.setdefault(block, np.zeros(BLOCK, np.int64))
                own[np.frombuffer(places.as_buffer(), "<u2")] += np.frombuffer(counts.as_buffer(), "<u4")  # a task names a place once
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([np.minimum(x, least).astype("<u4").tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])

    return merge


def merged_sketch(counted: DataFrame, least: int, depth: int = DEPTH, width: int = WIDTH) -> np.ndarray:
    """Saturated document frequencies of all (lang, term): an array of ``depth * width`` cells, in the smallest type."""
    hashed = counted.where("term <> ''").select(_hash(), "docs")
    partial = hashed.mapInArrow(_sketch(least, depth, width), "block long, places binary, counts binary")
    blocks = partial.repartition(C.parts(counted.sparkSession), "block").mapInArrow(_merge(least), "block long, counts binary")
    out = np.zeros(-(-depth * width // BLOCK) * BLOCK, np.min_scalar_type(least))
    for r in blocks.toLocalIterator():  # depth * width cells, whatever the input
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], "<u4")
    return out[: depth * width]


def _hash() -> Column:
    return F.xxhash64("lang", "term").alias("h")


def possible_terms(counted: DataFrame, least: int = MIN_DOCS, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """The rows of terms that may be in ``least`` documents of their language: a superset, by the sketch."""
    sketch = counted.sparkSession.sparkContext.broadcast(merged_sketch(counted, least, depth, width))

    @F.pandas_udf("boolean")
    def possible(h: pd.Series) -> pd.Series:
        return pd.Series((sketch.value[cells(h.to_numpy(), depth, width)] >= least).all(axis=0))

    return counted.where("term <> ''").where(possible(_hash()))


# --- divergence ------------------------------------------------------------------------------------------------------


def _share(count: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exact."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10, 0)) * cast({count} + 5 as decimal(20, 0))) div cast({total} + 5 * {kept} as decimal(20, 0))")


def kept_counts(counted: DataFrame, least: int = MIN_DOCS, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """lang, term, source, count (over 0), in_lang: exact counts of the terms in at least ``least`` documents of their language."""
    exact = possible_terms(counted, least, depth, width).groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    by_term = W.partitionBy("lang", "term")  # a row for each source at most
    both = exact.withColumns({"df": F.sum("docs").over(by_term), "in_lang": F.sum("count").over(by_term)})
    return both.where(F.col("df") >= least).drop("docs", "df")


def divergence(docs: DataFrame, least: int = MIN_DOCS, top: int = TOP, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """lang, source, part, item, value, rank; see the module's text."""
    counted = C.stored(term_counts(docs), "counted")
    kept = C.stored(kept_counts(counted, least, depth, width), "kept")
    zero = F.lit(0).cast("long")
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("used"))
    per_term = kept.groupBy("lang", "term").agg(F.first("in_lang").alias("in_lang"))
    whole = per_term.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("in_lang").alias("lang_total"))
    groups = counted.where("term = ''").select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(whole, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "used", "kept", "lang_total")))
    at_zero = F.when(F.col("kept") > 0, _share("0", "total", "kept")).otherwise(zero)
    groups = C.stored(groups.withColumn("at_zero", at_zero), "groups")
    side = C.sized_broadcast(groups.where("kept > 0"))
    shares = kept.join(side, ["lang", "source"]).select("lang", "term", "source", _share("count", "total", "kept").alias("p"), _share("in_lang", "lang_total", "kept").alias("q"), "at_zero")
    shares = C.stored(shares, "shares")

    by_group = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    used_more = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    term_part = used_more.withColumn("rank", F.row_number().over(by_group)).where(F.col("rank") <= top)

    # pairs: sum |p - q| over a source's terms against the other's value at zero is closed but for the terms below it
    sums = shares.groupBy("lang", "source").agg(F.sum("p").alias("sum_p"))
    g = groups.join(sums, ["lang", "source"], "left").withColumn("sum_p", F.coalesce("sum_p", zero))
    g = C.stored(g.select("lang", "source", "used", "kept", "at_zero", "sum_p"), "sums")
    left = g.select("lang", *(F.col(c).alias(f"a_{c}") for c in g.columns[1:]))
    right = g.select("lang", *(F.col(c).alias(f"b_{c}") for c in g.columns[1:]))
    pairs = left.join(C.sized_broadcast(right), "lang").where("a_source < b_source")
    histogram = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    other = g.where("kept > 0").select("lang", F.col("source").alias("item"), F.col("at_zero").alias("x"))
    low = histogram.join(C.sized_broadcast(other), "lang").where("p < x AND source <> item").groupBy("lang", "source", "item").agg((2 * F.sum(F.expr("n * (x - p)"))).alias("low"))
    x, y = shares.alias("x"), shares.alias("y")
    met = x.join(y, (F.col("x.lang") == F.col("y.lang")) & (F.col("x.term") == F.col("y.term"))).where("x.source < y.source")
    both = F.expr("abs(x.p - y.p) - abs(x.p - y.at_zero) - abs(x.at_zero - y.p) + abs(x.at_zero - y.at_zero)")
    met = met.groupBy(F.col("x.lang").alias("lang"), F.col("x.source").alias("a_source"), F.col("y.source").alias("b_source")).agg(F.sum(both).alias("met"))
    lows = [low.select("lang", F.col(s).alias("a_source"), F.col(i).alias("b_source"), F.col("low").alias(n)) for s, i, n in (("source", "item", "a_low"), ("item", "source", "b_low"))]
    key = ["lang", "a_source", "b_source"]
    pairs = pairs.join(met, key, "left").join(lows[0], key, "left").join(lows[1], key, "left")
    value = F.expr("a_sum_p - a_used * b_at_zero + b_sum_p - b_used * a_at_zero + (a_kept - a_used - b_used) * abs(a_at_zero - b_at_zero)") + sum((F.coalesce(c, zero) for c in ("met", "a_low", "b_low")), zero)
    pairs = C.stored(pairs.select(*key, value.alias("value")), "pairs")
    ways = [pairs.select("lang", F.col(s).alias("source"), F.lit("pair").alias("part"), F.col(i).alias("item"), "value") for s, i in (("a_source", "b_source"), ("b_source", "a_source"))]
    pair_part = ways[0].unionByName(ways[1]).withColumn("rank", F.row_number().over(by_group))
    return pair_part.unionByName(term_part)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(C.documents(spark, sf_dir).select("lang", "source", "text"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY lang, source, term),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS in_lang FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, sum(n) AS total FROM s GROUP BY lang, source),
p AS (
  SELECT s.*, 1 + (1000000000::HUGEINT * (s.n + 5)) // (t.total + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (s.in_lang + 5)) // (l.total + 5 * l.v) AS q
  FROM s JOIN t ON s.lang = t.lang AND s.source = t.source JOIN l ON s.lang = l.lang),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
v AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT f.lang, f.source, f.part, f.item, coalesce(v.value, 0) AS value FROM f LEFT JOIN v ON f.lang = v.lang AND f.source = v.source AND f.item = v.item
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
"""
