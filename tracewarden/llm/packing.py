"""Best-fit packing planned on the histogram of lengths (operator 4).

A token count lies between 1 and the sequence length, so all that packing needs
to know is how many pieces there are of each length: at most ``size`` numbers,
whatever the corpus. Best-fit runs over those counts and gives a plan of slots;
pieces then take the slots of their length by rank. No document takes part in the
planning and no group of equal lengths meets in one task: a length has as many
parts as its count asks for, and ranks are built from counts per (length, part)
and a rank inside each part. The driver sees one number for each length and part.

Cases: null text is empty and still has its closing id; texts longer than a
sequence are cut into full pieces after a first, shorter one; repeated doc_ids
are packed row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.llm import common as C

SIZE, END_ID = 2048, 0
#: Pieces of one length that are ranked together, at least; a length with more is cut into parts, ``PARTS`` of all pieces.
PER_PART, PARTS = 1_000, 100_000
SPECIAL = "<|endoftext|>"
#: White space whose look-ahead the fast encoder's pattern could not hold (its limit is ten times as long).
LONG_SPACE = re.compile(r"\s{100000}")
_encoders: dict[str, Callable] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of one text under the byte-level BPE in ``path``, without special tokens added.

    The file's vocabulary is ranked in merge order, so the same ids come from ``tiktoken``, which is several times as
    fast; a text that holds a special token's string goes through ``tokenizers`` itself. Built once per process.
    """
    if path not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # bytes that are not printable stand shifted to code points from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(back[c] for c in piece): i for piece, i in vocabulary.items() if piece != SPECIAL}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        exact = Tokenizer.from_file(path)

        def encode(text: str) -> np.ndarray:
            plain = SPECIAL not in text and not (len(text) >= 100_000 and LONG_SPACE.search(text))
            return np.array(fast.encode_ordinary(text) if plain else exact.encode(text, add_special_tokens=False).ids, np.uint32)

        _encoders[path] = encode
    return _encoders[path]


PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """The pieces of each document (see PIECES); with_ids adds the ids themselves."""
    path = vocabulary or default_vocabulary()
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for p in C.pieces(batches, "text"):
            rows, tokens = [], []
            for row, doc, text in zip(p.column("row").to_pylist(), p.column("doc_id").to_pylist(), p.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                first = (len(ids) - 1) % size + 1
                for k, at in enumerate([0, *range(first, len(ids), size)]):
                    part = ids[at : at + size] if k else ids[:first]
                    rows.append((row, doc, k, at, len(part), zlib.crc32(part.tobytes())))
                    if with_ids:
                        tokens.append(part.astype(np.int32))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(cut, schema)


def best_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing over counts. Slots as (length, how many, first sequence, offset): pieces of ``length`` with
    consecutive ranks go to consecutive sequences at ``offset``.

    Open sequences with equal free space are runs of consecutive numbers; each step fills a run or uses up a length, so
    the plan's size depends on ``size`` alone: every length adds at most one partly used run per free space.
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space -> runs (first sequence, how many)
    plan, used = [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for space in sorted(s for s in list(free) if s >= length):
            if not left:
                break
            runs, free[space] = free[space], []
            while runs:
                first, many = runs.pop()
                # as many to a sequence as fit, before the next one is touched; what is left over goes into one more
                full = min(many, left // (space // length))
                rest = left - full * (space // length) if full < many else 0
                for each, take in ((space // length, full), (rest, 1)):
                    if not each or not take:
                        continue
                    for k in range(each):
                        plan.append((length, take, first, size - space + k * length))
                    left -= take * each
                    if space > each * length:
                        free[space - each * length].append((first, take))
                    first, many = first + take, many - take
                if many:
                    free[space].append((first, many))
        per = size // length
        for each in (per, left % per if left else 0):
            many = left // each if each else 0
            if many:
                plan += [(length, many, used, k * length) for k in range(each)]
                if size > each * length:
                    free[size - each * length].append((used, many))
                used += many
                left -= many * each
        if left:
            raise RuntimeError(f"{left} pieces of length {length} have no place")
    return plan


def place(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` with sequence_id and offset. Columns used: row, piece, length."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most size numbers
    together = max(PER_PART, -(-sum(counts.values()) // PARTS))
    many_parts = F.lit([max(1, -(-counts.get(n, 0) // together)) for n in range(1, size + 1)])
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("row", "piece"), F.element_at(many_parts, F.col("length").cast("int"))).cast("int"))
    table = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).collect()  # at most size + PARTS numbers
    base: dict[tuple[int, int], int] = {}
    seen: dict[int, int] = defaultdict(int)
    for length, part, n in sorted((r["length"], r["part"], r["n"]) for r in table):
        base[length, part] = seen[length]
        seen[length] += n
    slots: dict[int, tuple] = {}
    by_length = defaultdict(list)
    for length, many, first, offset in best_fit(counts, size):
        by_length[length].append((many, first, offset))
    for length, rows in by_length.items():
        many, first, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        slots[length] = (np.cumsum(many) - many, first, offset)

    names = [n for n, _ in pieces.dtypes]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, part, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "part", "rank"))
            seq, off = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            order = np.lexsort((part, length))
            fresh = np.ones(b.num_rows, bool)
            fresh[1:] = (np.diff(length[order]) != 0) | (np.diff(part[order]) != 0)
            bounds = np.flatnonzero(fresh)
            for at, to in zip(bounds, [*bounds[1:], b.num_rows], strict=True):
                i = order[at:to]
                n, s = int(length[i[0]]), int(part[i[0]])
                starts, first, offset = slots[n]
                r = rank[i] - 1 + base[n, s]
                k = np.searchsorted(starts, r, "right") - 1
                seq[i], off[i] = first[k] + r - starts[k], offset[k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("length", "part").orderBy("row", "piece")).cast("long"))
    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(seat, schema)


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE) -> DataFrame:
    return place(C.stored(token_pieces(docs, vocabulary, size), "pieces"), size).drop("row")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.documents(spark, sf_dir).select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of all documents."""
    return pack(docs.select("doc_id", "text"))
