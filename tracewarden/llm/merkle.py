"""Merkle-tree document fingerprints (operator 9).

A text is a tree: the root holds sections (separated by blank lines, and closed
after sixteen paragraphs), a section holds paragraphs (lines), a paragraph holds
phrases cut where the words themselves say so. Each inner node hashes the hashes
of its children; equal roots mean equal texts, and where roots differ only the
branches that differ need a visit to locate an edit. The fingerprint string
carries the tree down to its paragraphs (root, sections and their paragraphs) and
a bottom sketch of the phrase hashes: two fingerprints locate edits and give a
likeness without their texts.

Cases: null text is empty; an empty text has one empty section; texts that are
equal have equal fingerprints, whatever their length; repeated doc_ids are taken
in the order of their text; null doc_ids come before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import common as C

SECTION_PARAGRAPHS, PHRASE_WORDS, SKETCH = 16, 4, 128
FLOAT_DIGITS = 6
#: Hex digits of a section or paragraph in the fingerprint (64 bits); the root has all 128 bits.
HEX = 16


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def tree(text: str | None) -> dict:
    """root (hex), sections: list of (hash, [paragraph hashes]), all 16-byte hashes in hex; whole text, every byte."""
    sections, now = [], []
    for line in (text or "").split("\n"):
        now.append(_digest(b"p" + line.encode("utf-8", "surrogatepass")))
        if len(now) == SECTION_PARAGRAPHS or not line.strip():
            sections.append(now)
            now = []
    if now:
        sections.append(now)
    hashed = [(_digest(b"s" + b"".join(s)), s) for s in sections]
    root = _digest(b"r" + b"".join(h for h, _ in hashed))
    return {"root": root.hex(), "sections": [(h.hex(), [p.hex() for p in s]) for h, s in hashed]}


def branches(fingerprint: str) -> list[tuple[str, list[str]]]:
    """The sections of a fingerprint: (hash, hashes of its paragraphs)."""
    return [(h, [p[i : i + HEX] for i in range(0, len(p), HEX)]) for h, _, p in (s.partition("/") for s in fingerprint.split(":")[1].split(","))]


def edits(a: str, b: str) -> list[int]:
    """Numbers of the paragraphs of the first fingerprint's text whose branch is not in the second's; visits only sections
    that differ."""
    if a.split(":")[0] == b.split(":")[0]:
        return []
    theirs = branches(b)
    sections = {h for h, _ in theirs}
    leaves = {p for _, s in theirs for p in s}
    found, at = [], 0
    for h, s in branches(a):
        if h not in sections:
            found += [at + i for i, p in enumerate(s) if p not in leaves]
        at += len(s)
    return found


def locate_edits(a: str | None, b: str | None) -> list[int]:
    """``edits`` of two texts."""
    return edits(*fingerprints([a or "", b or ""]))


def phrase_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the phrases of each row and each row's first. A phrase is cut before a word whose hash says so
    (one in ``PHRASE_WORDS``) and at line ends, so an edit moves only the cuts beside it."""
    start, end, first = C.words(data, off)
    if not len(start):
        return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
    wh = C.range_hash(C.prefix_sums(data), start, end)
    cut = (wh >> np.uint64(40)) % np.uint64(PHRASE_WORDS) == 0
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, start)
    cut[1:] |= line[1:] != line[:-1]
    cut[first[:-1][np.diff(first) > 0]] = True
    begin = np.flatnonzero(cut)
    stop = np.append(begin[1:], len(wh))
    h = (C.range_hash(C.prefix_sums(wh), begin, stop) >> np.uint64(32)).astype(np.uint32)
    return h, np.searchsorted(begin, first)


def fingerprints(texts: list[str]) -> list[str]:
    """``root:section/paragraphs,section/paragraphs...:count:sketch``; the sketch holds the smallest distinct phrase hashes."""
    out = []
    at = 0
    while at < len(texts):  # pieces of about a MiB
        to, size = at, 0
        while to < len(texts) and (to == at or size < C.CHUNK_BYTES):
            size += len(texts[to])
            to += 1
        h, first = phrase_hashes(*C.buffers(pa.array(texts[at:to], pa.large_string())))
        for i, text in enumerate(texts[at:to]):
            t = tree(text)
            leaf = np.unique(h[first[i] : first[i + 1]])
            out.append(f"{t['root']}:{','.join(f"{s[:HEX]}/{''.join(p[:HEX] for p in ps)}" for s, ps in t['sections'])}:{len(leaf)}:{leaf[:SKETCH].astype('>u4').tobytes().hex()}")
        at = to
    return out


def likeness(a: str, b: str) -> float:
    """0 to 1: 1 for equal roots; else the share of common phrases, estimated from the bottom sketches (Jaccard)."""
    ra, _, _, sa = a.split(":")
    rb, _, _, sb = b.split(":")
    if ra == rb:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s), ">u4").astype(np.int64) for s in (sa, sb))
    if not len(x) or not len(y):
        return 0.0
    both = np.union1d(x, y)[:SKETCH]
    return round(float((np.isin(both, x, assume_unique=True) & np.isin(both, y, assume_unique=True)).sum() / len(both)), FLOAT_DIGITS)


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as many first code points of the following document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_successor(docs: DataFrame) -> DataFrame:
    """Rows (block, last, doc_id, text) partitioned by block and sorted, in which each document is followed by the next
    one in ascending doc_id order. Blocks are ranges of doc_id with bounds from a quantile summary; the first row of the
    next block is added to each block as its ``last`` row, and that of the first block to the last one."""
    spark = docs.sparkSession
    n = 4 * C.parts(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # the bounds are a list of at most 4 x partitions numbers, searched by bisection
    cuts = sorted(set(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)))
    bounds = [float("-inf"), *(cuts or [0.0]), float("inf")]
    rows = rows.withColumn("_at", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
    rows = Bucketizer(splits=bounds, inputCol="_at", outputCol="_block").transform(rows).withColumn("block", F.col("_block").cast("int")).drop("_at", "_block")
    heads = rows.groupBy("block").agg(F.min(F.struct("doc_id", "text")).alias("h"))
    ids = heads.select("block").orderBy("block").collect()  # one number per block
    order = [r[0] for r in ids]
    before = {b: order[i - 1] for i, b in enumerate(order)}
    if not order:
        return rows.select("block", F.lit(1).alias("last"), "doc_id", "text").limit(0)
    moved = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))
    tails = heads.select(F.element_at(moved, F.col("block")).alias("block"), F.lit(1).alias("last"), "h.doc_id", "h.text")
    return rows.select("block", F.lit(0).alias("last"), "doc_id", "text").unionByName(tails).repartition(C.parts(spark), "block").sortWithinPartitions("block", "last", "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_sections long, edited_paragraphs long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    types = [pa.from_numpy_dtype(x) if x else pa.string() for x in ("i8", "i8", "", "", "", "f8", "f8", "i8", "i8")]
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            block, last, ids, texts = (batch.slice(at, 500).column(c).to_pylist() for c in ("block", "last", "doc_id", "text"))
            prints = fingerprints(texts)
            rows = list(zip(block, last, ids, texts, prints, strict=True))
            if held is not None:
                rows.insert(0, held)
            held = rows[-1]
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1] and a[0] == b[0]]
            changed = [edited(a[3], b[3]) for a, b in pairs]
            out = [
                (a[2], len(a[3]), hashlib.sha256(e.encode()).hexdigest(), a[4], p, likeness(a[4], p), likeness(a[4], b[4]), a[4].count("/"), len(edits(a[4], p)))
                for (a, b), e, p in zip(pairs, changed, fingerprints(changed), strict=True)
            ]
            cols = list(zip(*out, strict=True)) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text and the likenesses (see SCHEMA)."""
    return with_successor(docs).mapInArrow(_compare, SCHEMA)


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_table(C.documents(spark, sf_dir).select("doc_id", "text"))
