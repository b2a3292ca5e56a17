"""SimHash near-duplicates by segment-popcount embedding (operator 13).

A fingerprint has 64 bits, each set if it is set in over half the XXH64 hashes of
the text's word shingles. Two link at ``RADIUS`` or fewer differing bits.

A fingerprint maps to the bit counts of its segments. Counts of two fingerprints
differ, summed over the segments, by at most as many as their bits: Manhattan
distance is a lower bound of Hamming distance. The range join for "at most
RADIUS apart" runs over grids of such counts. Long segments alone are a weak
grid (counts of random segments are mostly near the middle), so segments have
two lengths: the bits are cut into RADIUS + 2 axes, and each grid takes two of
the axes at segments of one bit and the others at one segment each. Of two
fingerprints within RADIUS, at least two axes are equal, so they share a cell of
one of the 15 grids. Inside a cell, rows are sorted by the sum of their other
counts; only rows whose counts are within RADIUS by Manhattan distance are
compared bit by bit.

Equal fingerprints are one node. Small cells give their verified links. In a
large cell a search by breadth links every member once: what a component has
reached is compared with nothing again, so dense groups of near copies cost
little, and no cell gives more links than members. Cells beyond ``BLOCK`` members
are cut into blocks, of which every two meet in one task.

Cases: null text or text without words has fingerprint zero, linked like any
other; fewer than ``width`` words make one shingle; repeated rows and ids fall
into one node; a null doc_id gets a component_id but names no component unless
there is no other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import common as C
from tracewarden.llm.graph import components

WIDTH, SEED, RADIUS = 4, 42, 4
#: Members of a cell that is compared row by row, and of a block of a large one.
SMALL, BLOCK = 32, 50_000
#: Shingles of a length that are hashed together, at least; longer or rarer ones are hashed one by one.
TOGETHER, LONGEST = 16, 256

_U = np.uint64
_P1, _P2, _P3, _P4, _P5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of XXH64
#: Column b: bit b of each byte.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.float64)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U(n)) | (x >> _U(64 - n))


def xxh64(rows: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each row of a byte matrix (rows of one length)."""
    n, size = rows.shape

    def lanes(at: int, width: int, count: int) -> np.ndarray:
        own = np.ascontiguousarray(rows[:, at : at + width * count])
        return own.view(f"<u{width}").astype(np.uint64)

    with np.errstate(over="ignore"):
        mixed = lambda acc, lane: _turn(acc + lane * _P2, 31) * _P1
        at = size // 32 * 32
        if at:
            acc = [np.full(n, x, np.uint64) for x in (_U(seed) + _P1 + _P2, _U(seed) + _P2, _U(seed), _U(seed) - _P1)]
            whole = lanes(0, 8, at // 8)
            for k in range(0, at // 8, 4):
                acc = [mixed(a, whole[:, k + i]) for i, a in enumerate(acc)]
            h = sum((_turn(a, r) for a, r in zip(acc, (1, 7, 12, 18), strict=True)), np.zeros(n, np.uint64))
            for a in acc:
                h = (h ^ mixed(np.zeros(n, np.uint64), a)) * _P1 + _P4
        else:
            h = np.full(n, _U(seed) + _P5, np.uint64)
        h = h + _U(size)
        rest = (size - at) // 8
        if rest:
            own = lanes(at, 8, rest)
            for k in range(rest):
                h = _turn(h ^ mixed(np.zeros(n, np.uint64), own[:, k]), 27) * _P1 + _P4
            at += 8 * rest
        if size - at >= 4:
            h = _turn(h ^ (lanes(at, 4, 1)[:, 0] * _P1), 23) * _P2 + _P3
            at += 4
        for k in range(at, size):
            h = _turn(h ^ (rows[:, k].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> _U(33))) * _P2
        h = (h ^ (h >> _U(29))) * _P3
        return h ^ (h >> _U(32))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each range of ``data``, those of one length together."""
    size = end - start
    out = np.zeros(len(start), np.uint64)
    order = np.argsort(size, kind="stable")
    lengths, first = np.unique(size[order], return_index=True)
    for length, at, to in zip(lengths.tolist(), first, np.append(first[1:], len(order)), strict=True):
        own = order[at:to]
        if len(own) < TOGETHER or length > LONGEST:
            out[own] = [xxhash.xxh64_intdigest(data[a : a + length].tobytes(), seed) for a in start[own]]
        else:
            out[own] = xxh64(np.lib.stride_tricks.sliding_window_view(data, length)[start[own]], seed)
    return out


def shingle_hashes(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the space-joined shingles of each row, repeats included, and each row's first."""
    start, end, first = C.words(data, off)
    size = end - start
    # the words, lower-cased and each followed by one space
    to = np.cumsum(size + 1)
    begin = to - size - 1
    joined = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
    keep = np.ones(len(joined), bool)
    keep[to - 1] = False
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    joined[keep] = C.lower(data)[np.cumsum(inside[:-1]) > 0]
    count = np.diff(first)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at_row = np.zeros(len(count) + 1, np.int64)
    np.cumsum(made, out=at_row[1:])
    at = np.arange(at_row[-1]) - np.repeat(at_row[:-1], made) + np.repeat(first[:-1], made)
    last = at + np.repeat(np.minimum(count, width), made) - 1
    return hashes(joined, begin[at], to[last] - 1), at_row


def majority(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Each row's 64-bit fingerprint: bits that are set in over half of its hashes."""
    n = len(begin) - 1
    row = C.row_of(begin)
    out = np.zeros(n, np.uint64)
    for k in range(8):  # byte by byte: how often each value occurs in a row says how often each bit is set
        byte = ((h >> _U(8 * k)) & _U(255)).astype(np.int64)
        set_in = np.bincount(row * 256 + byte, minlength=n * 256).reshape(n, 256).astype(np.float64) @ _BITS
        over = 2 * set_in > np.diff(begin)[:, None]
        for b in range(8):
            out |= over[:, b].astype(np.uint64) << _U(8 * k + b)
    return out


def _fingerprints(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in C.pieces(batches, "text"):
            h, begin = shingle_hashes(*C.buffers(p.column("text")), width)
            yield pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array(majority(h, begin).view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(width), "doc_id long, fp long")


# --- grids -----------------------------------------------------------------------------------------------------------


def axes(radius: int = RADIUS) -> list[int]:
    """Bit masks of radius + 2 runs of bits that cover all 64."""
    ends = [64 * i // (radius + 2) for i in range(radius + 3)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(ends)]


def grids(radius: int = RADIUS) -> list[tuple[int, list[int]]]:
    """For each grid: the bits that it takes one by one, and the segments that it only counts."""
    masks = axes(radius)
    return [(masks[i] | masks[j], [m for k, m in enumerate(masks) if k not in (i, j)]) for i, j in itertools.combinations(range(len(masks)), 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def counts(fp: np.ndarray, segments: list[int]) -> np.ndarray:
    return np.stack([np.bitwise_count(fp & _U(m)) for m in segments], axis=1).astype(np.int8)


def _small_cells(fp: np.ndarray, cell: np.ndarray, embedded: np.ndarray, total: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of cells that lie one after the other, each sorted by ``total``: row i meets row i + 1, i + 2, ... until the
    cell ends or the totals are too far apart."""
    a, b = [], []
    i = np.arange(len(fp))
    step = 0
    while len(i):
        step += 1
        i = i[i + step < len(fp)]
        j = i + step
        i = i[(cell[i] == cell[j]) & (total[j] - total[i] <= radius)]
        j = i + step
        near = np.abs(embedded[i] - embedded[j]).sum(axis=1) <= radius
        x, y = i[near], j[near]
        same = np.bitwise_count(fp[x] ^ fp[y]) <= radius
        a.append(fp[x[same]])
        b.append(fp[y[same]])
    return np.concatenate(a) if a else fp[:0], np.concatenate(b) if b else fp[:0]


def spanning_links(fp: np.ndarray, total: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each component of one cell, one for every member but its first. Rows are sorted by ``total``."""
    left, left_total = fp, total
    a, b = [], []
    while len(left):
        front, front_total = left[:1], left_total[:1]
        left, left_total = left[1:], left_total[1:]
        while len(front) and len(left):
            x, front, xt, front_total = front[:64], front[64:], front_total[:64], front_total[64:]
            low, high = np.searchsorted(left_total, xt.min() - radius), np.searchsorted(left_total, xt.max() + radius, "right")
            near = np.bitwise_count(x[:, None] ^ left[None, low:high]) <= radius
            hit = np.flatnonzero(near.any(axis=0))
            if len(hit):
                a.append(x[near[:, hit].argmax(axis=0)])
                b.append(left[low + hit])
                front, front_total = np.append(front, left[low + hit]), np.append(front_total, left_total[low + hit])
                stays = np.ones(len(left), bool)
                stays[low + hit] = False
                left, left_total = left[stays], left_total[stays]
    return np.concatenate(a) if a else fp[:0], np.concatenate(b) if b else fp[:0]


def _meet(radius: int) -> Callable:
    all_grids = grids(radius)

    def links(grid: np.ndarray, cell: np.ndarray, part: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of whole cells, sorted by (grid, cell, part)."""
        new = np.ones(len(fp), bool)
        new[1:] = (grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])
        number = np.cumsum(new) - 1
        size = np.bincount(number)
        some = size[number] > 1
        grid, number, fp, size = grid[some], number[some], fp[some], size
        found = []
        for g in np.unique(grid):
            own = np.flatnonzero(grid == g)
            embedded = counts(fp[own], all_grids[g][1])
            total = embedded.sum(axis=1, dtype=np.int64)
            order = np.lexsort((total, number[own]))
            x, cells, embedded, total = fp[own][order], number[own][order], embedded[order], total[order]
            few = size[cells] <= SMALL
            found.append(_small_cells(x[few], cells[few], embedded[few], total[few], radius))
            many = np.flatnonzero(~few)
            for rows in np.split(many, np.flatnonzero(np.diff(cells[many])) + 1) if len(many) else []:
                found.append(spanning_links(x[rows], total[rows], radius))
        a, b = (np.concatenate([f[k] for f in found]) if found else fp[:0] for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (grid, cell, part): the last cell of what has come waits for the next batch."""
        held: list[np.ndarray] = []
        rows = 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(np.stack([batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("grid", "cell", "part", "fp")]))
                rows += batch.num_rows
            if not held or (batch is not None and rows < 4 * BLOCK):
                continue
            whole = np.concatenate(held, axis=1)
            last = len(whole[0])
            if batch is not None:
                last = int(np.flatnonzero((whole[:3, :] != whole[:3, -1:]).any(axis=0))[-1]) + 1 if (whole[:3, 0] != whole[:3, -1]).any() else 0
            if last:
                yield from links(whole[0, :last], whole[1, :last], whole[2, :last], whole[3, :last].view(np.uint64))
            held, rows = [whole[:, last:]], whole.shape[1] - last

    return meet


def near_links(nodes: DataFrame, radius: int = RADIUS, block: int | None = None) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fp`` within ``radius`` that join all that such pairs join."""
    n = C.parts(nodes.sparkSession)
    block = block or BLOCK
    each = F.explode(F.array(*(F.struct(F.lit(k).cast("byte").alias("grid"), F.col("fp").bitwiseAND(F.lit(_signed(bits))).alias("cell")) for k, (bits, _) in enumerate(grids(radius)))))
    placed = nodes.select("fp", each.alias("g")).select("g.grid", "g.cell", "fp")
    large = C.stored(placed.groupBy("grid", "cell").count().where(F.col("count") > block).select("grid", "cell", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "cells")
    if large.isEmpty():
        placed = placed.withColumn("part", F.lit(0))
    else:  # of a large cell every two blocks meet in a part
        own, blocks = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"), F.col("blocks")
        part = F.transform(F.filter(F.sequence(F.lit(0), blocks - 1), lambda o: o != own), lambda o: F.least(own, o) * blocks + F.greatest(own, o))
        rest = placed.join(C.sized_broadcast(large), ["grid", "cell"], "left")
        placed = rest.select("grid", "cell", "fp", F.explode(F.coalesce(part, F.array(F.lit(0)))).alias("part"))
    return placed.repartition(n, "grid", "cell", "part").sortWithinPartitions("grid", "cell", "part", "fp").mapInArrow(_meet(radius), "a long, b long").distinct()


def classes(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of each row."""
    rows = C.stored(fingerprints(docs, width), "fingerprints")
    nodes = C.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    joined = components(near_links(nodes, radius)).withColumnRenamed("node", "fp")
    named = nodes.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = C.stored(named.join(least, "component").select("fp", "component_id"), "classes")
    return rows.join(of_node, "fp").select("doc_id", "fp", "component_id")


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(C.documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
