"""Exact repeated-substring removal by external induced sorting (operator 1).

Every byte covered by a ``SPAN``-byte string that also starts elsewhere is
removed. Suffixes are sorted by induction, out of core and in shards:

* Sample suffixes. In each window of ``REPORT - K + 1`` positions the smallest
  K-gram hash marks one position. It depends on nothing but the string itself, so
  all places of a repeated string mark the same offset. A sample whose K-gram
  occurs once cannot lie in a repeat and is left out.
* Base order. Sample suffixes are sharded by their K-gram and sorted by their
  next ``SPAN`` bytes in the shuffle's external merge sort, which also yields the
  common prefixes of neighbours.
* Induction. The suffixes to the left of a sample take their order from it, one
  preceding byte at a time: classes of equal left context are split by the next
  byte with a stable sort, and the common prefix of new neighbours is the range
  minimum over the base order. A position repeats where left context and common
  prefix reach ``SPAN`` together; the longest that they reach is the suffix's longest
  match. Classes of one suffix and those that cannot reach ``REPORT`` any more leave.
* Shards larger than memory. Their tuples (suffix, left context, common prefix
  with the tuple before) lie in queues on disk. A pass over a queue skips the left
  context that all its tuples share, then pushes each tuple into the bucket of
  its next byte with the smallest common prefix since that bucket's last tuple:
  buckets are popped in byte order, tuples of a bucket in base order. Buckets are
  queues again, and the induction goes into them recursively until one fits into
  memory. A pass holds one block of tuples and one number for each byte.
* Hot shards. A K-gram of more than ``HOT`` places is cut into ``RANGES`` ranges of
  left offsets. A match that starts a to b bytes before its sample has a bytes of
  left and SPAN - b of right context in common, so these make the key of a shard of
  their own, whose tuples need no more than the b - a bytes on either side. Of equal
  contexts a task sends two; it decides the others itself, as equal contexts repeat
  as far as they reach. Matches of a hot K-gram from ``REPORT`` to ``SPAN`` are told in
  the same way by ranges of ``REPORT`` bytes without more context.

Beside what is removed, a document's longest match is reported: bytes of its longest
string that also starts elsewhere, from ``REPORT`` bytes on (0: none so long; for a
hot K-gram a range less) and up to ``SPAN``, so passages shorter than the span are
seen, not removed.

Texts that occur twice as a whole are found by their hash; one of them stands for
all in the sort, so a group of thousands costs as much as one text.

Cases: null text is empty; texts under ``SPAN`` bytes lose nothing; rows with an
equal doc_id are separate documents, told apart by the hash of their text.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import common as C

SPAN, K = 400, 64
#: Shortest match that is certain to be reported.
REPORT = 256
WINDOW = REPORT - K + 1
#: Suffixes of small shards sorted together; largest queue that is induced in memory, and tuples of one block on disk.
TOGETHER, IN_MEMORY, BLOCK = 16_000, 64_000, 16_384
#: Places of a K-gram past which its shard is cut into ranges of left offsets.
HOT, RANGES = 10_000, 16
WIDTH_OF_RANGE = (WINDOW - 1) // RANGES
#: Contexts that a task remembers to tell equal ones; past that it starts anew.
REMEMBERED = 1_000_000
#: Longest stretch of one text that is sampled at a time.
_STRETCH = 1 << 22
_BITS = np.uint64(24)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i with a full window."""
    n = len(x)
    if n < width:
        return x[:0]
    pad = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    pad[:n] = x
    grid = pad.reshape(-1, width)
    right = np.minimum.accumulate(grid, axis=1).ravel()
    left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: n - width + 1], right[width - 1 : n])


def samples(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, key, at, low, high of each sample: the K-gram hash at byte ``at`` of its row, chosen for start positions low..high."""
    if len(data) < REPORT:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    sums = C.prefix_sums(data)
    start = np.arange(len(data) - K + 1)
    h = C.range_hash(sums, start, start + K)
    chosen = sliding_min((h >> _BITS << _BITS) | start.astype(np.uint64), WINDOW) & np.uint64((1 << 24) - 1)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(chosen)]
    i = np.arange(len(chosen))
    inside = i + REPORT <= off[row + 1]
    i, row, at = i[inside], row[inside], chosen[inside].astype(np.int64)
    if not len(i):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    fresh = np.ones(len(i), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(i)) - 1
    row, at = row[first], at[first]
    return row, h[at].view(np.int64), at - off[row], i[first] - off[row], i[last] - off[row]


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in C.pieces(batches, "text", C.CHUNK_BYTES // 2):
        data, off = C.buffers(p.column("text"))
        if len(data) <= _STRETCH:
            found = samples(data, off)
        else:  # a single very long text: stretches that overlap by REPORT - 1 bytes
            parts = []
            for at in range(0, len(data) - REPORT + 1, _STRETCH):
                part = data[at : at + _STRETCH + REPORT - 1]
                r = samples(part, np.array([0, len(part)]))
                parts.append((r[0], r[1], r[2] + at, r[3] + at, r[4] + at))
            found = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        row, key, at, low, high = found
        # one row for each text and key, as a periodic text has its key at every period
        order = np.lexsort((at, key, row))
        row, key, at, low = row[order], key[order], at[order], low[order]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        first = np.flatnonzero(fresh)
        off = pa.array(np.append(first, len(row)).astype(np.int32))
        take = pa.array(row[first])
        lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int32))) for x in (at, low)]
        yield pa.RecordBatch.from_arrays([pa.array(key[first]), p.column("doc_id").take(take), p.column("h1").take(take), *lists], names=["key", "doc_id", "h1", "at", "low"])


CONTEXT = pa.schema([("key", pa.int64()), ("sub", pa.int64()), ("shift", pa.int32()), ("span", pa.int32()), ("right", pa.binary()), ("left", pa.binary()), ("doc_id", pa.int64()), ("h1", pa.int64()), ("at", pa.list_(pa.int32()))])


def shards(key: int, right: bytes, left: bytes, hot: bool) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """key, sub, shift, span, right, left of the shards that a sample belongs to: one of all left offsets, or one for each
    range of them and length (SPAN with its contexts, REPORT without). A shard shares SPAN - span bytes already."""
    if not hot:
        yield key, 0, 0, SPAN, right, left
        return
    for a in range(0, WINDOW - 1, WIDTH_OF_RANGE):
        b = min(a + WIDTH_OF_RANGE, WINDOW - 1)
        if len(left) < a:
            return
        near = left[len(left) - a :]
        for length in (SPAN, REPORT):
            if len(right) >= length - b:
                name = xxhash.xxh3_128_intdigest(b"%d:%d:%d:" % (key, a, length) + near + right[: length - b])
                rest = (right[SPAN - b : SPAN - a], left[max(0, len(left) - b) : len(left) - a]) if length == SPAN else (b"", b"")
                yield (name >> 64) - (1 << 63), (name & (2**64 - 1)) - (1 << 63), a, SPAN - length + b - a, *rest


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each repeated sample of a text with the bytes to its right (SPAN of them) and left (back to its first position).
    Samples of one text with equal contexts, as a periodic text has many, are one row with several places. A row whose
    right is null brings decided spans in ``at`` (start, end, start, ...) and their longest match in ``span`` instead."""
    seen: dict[int, int] = {}
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CONTEXT, strict=True)], schema=CONTEXT)
        rows.clear()
        return made

    for batch in batches:
        for r in range(batch.num_rows):
            text = (batch.column("text")[r].as_py() or "").encode("utf-8")
            doc, h1 = batch.column("doc_id")[r].as_py(), batch.column("h1")[r].as_py()
            places: dict[tuple, list[int]] = {}
            for m in batch.column("marks")[r].as_py():
                for at, low in zip(m["at"], m["low"], strict=True):
                    for x in shards(m["key"], text[at : at + SPAN], text[low:at], m["n"] > HOT):
                        places.setdefault(x, []).append(at)
            decided: list[int] = []
            longest = 0
            for (key, sub, shift, span, right, left), ats in places.items():
                name = xxhash.xxh3_128_intdigest(b"%d:%d:%d:" % (key, sub, len(right)) + right + left)
                times = seen.get(name, 0)
                if times < 2:
                    seen[name] = times + 1
                    rows.append((key, sub, shift, span, right, left, doc, h1, ats))
                else:
                    longest = max(longest, SPAN - span + len(right) + len(left))
                    for at in ats if len(right) + len(left) >= span else ():
                        decided += (at - shift - len(left), at - shift - max(0, span - len(right)) + SPAN)
            if longest:
                rows.append((h1, 0, 0, min(longest, SPAN), None, None, doc, h1, decided))
            if len(seen) > REMEMBERED:
                seen.clear()
            if len(rows) >= 4096:
                yield out()
    if rows:
        yield out()


#: A suffix on disk: its number, common prefix with the one before, length of its right context and its left context.
TUPLE = np.dtype([("id", "<i8"), ("lcp", "<i2"), ("right", "<i2"), ("size", "<i2"), ("twin", "?"), ("left", "u1", (WINDOW,))])


class DiskQueue:
    """Tuples in a file: pushed at the end, popped in blocks from the start."""

    def __init__(self, folder: str) -> None:
        handle, self.path = tempfile.mkstemp(dir=folder)
        self.file = os.fdopen(handle, "wb", buffering=1 << 16)
        self.rows = 0

    def push(self, tuples: np.ndarray) -> None:
        self.file.write(tuples.tobytes())
        self.rows += len(tuples)

    def blocks(self) -> Iterator[tuple[np.ndarray, int]]:
        """Each block with the common prefix that the tuple after it has with its last one (-1 at the end)."""
        self.file.close()
        with open(self.path, "rb") as f:
            block = np.fromfile(f, TUPLE, BLOCK)
            while len(block):
                after = np.fromfile(f, TUPLE, BLOCK)
                yield block, int(after["lcp"][0]) if len(after) else -1
                block = after

    def all(self) -> np.ndarray:
        self.file.close()
        return np.fromfile(self.path, TUPLE)

    def drop(self) -> None:
        self.file.close()
        os.unlink(self.path)


def scratch() -> str:
    """A scratch folder of Spark's on this executor, as its own sorters use."""
    return (os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()).split(",")[0]


def neighbour_lcp(right: np.ndarray, size: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Common prefix of each sample suffix with the one before it in base order; -1 where a shard begins."""
    out = np.full(len(size), -1, np.int16)
    for at in range(1, len(size), 8192):
        to = min(at + 8192, len(size))
        differ = right[at:to] != right[at - 1 : to - 1]
        lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), SPAN)
        out[at:to] = np.minimum(lcp, np.minimum(size[at:to], size[at - 1 : to - 1]))
    out[fresh] = -1
    return out


class RangeMinimum:
    """Sparse table over the neighbours' common prefixes."""

    def __init__(self, lcp: np.ndarray) -> None:
        self.levels = [lcp]
        width = 1
        while 2 * width <= len(lcp):
            top = self.levels[-1]
            self.levels.append(np.minimum(top[:-width], top[width:]))
            width *= 2

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """min lcp[x + 1 .. y] for x < y."""
        n = y - x
        level = np.frexp(n.astype(np.float64))[1] - 1
        out = np.empty(len(n), np.int16)
        for k in np.unique(level):
            at = level == k
            t = self.levels[k]
            out[at] = np.minimum(t[x[at] + 1], t[y[at] - (1 << int(k)) + 1])
        return out


def induce(lcp: np.ndarray, right_size: np.ndarray, left: np.ndarray, left_size: np.ndarray, twins: np.ndarray, span: np.ndarray, o: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (row, least, most) of left offsets from ``o`` at which the suffix repeats, and the longest match of each row
    (left and right context together, 0 without one), for suffixes in base order whose classes begin where ``lcp`` is -1. ``twins``: rows that stand for several places, and so share both contexts with
    another suffix. ``span``: bytes that left and right context must reach together."""
    smallest = RangeMinimum(lcp)
    n = len(lcp)
    order = np.arange(n)
    group = np.cumsum(lcp < 0) - 1
    reach = left_size.astype(np.int64)
    since, until = np.full(n, -1), np.full(n, -2)
    longest = np.zeros(n, np.int64)
    worth = np.minimum(span, REPORT - SPAN + span)
    runs: list[tuple[np.ndarray, ...]] = []
    while len(order):
        beside = np.full(len(order) + 1, -1, np.int64)
        same = np.flatnonzero(group[1:] == group[:-1]) + 1
        beside[same] = smallest(order[same - 1], order[same])
        best = np.maximum(beside[:-1], beside[1:])
        best = np.where(twins[order], np.maximum(best, right_size[order]), best)
        longest[order] = np.maximum(longest[order], np.where(best >= 0, best + o, 0))
        hit = order[(best + o >= span[order]) & (best >= 0)]
        new = hit[until[hit] != o - 1]
        old = new[since[new] >= 0]
        runs.append((old, since[old], until[old]))
        since[new] = o
        until[hit] = o
        # what cannot reach a match worth telling with its own left context, or has none left, is done
        stay = (best >= 0) & (best + reach[order] >= worth[order]) & (reach[order] > o)
        order, group = order[stay], group[stay]
        if not len(order):
            break
        step = group * 256 + left[order, o]
        sort = np.argsort(step, kind="stable")
        order, step = order[sort], step[sort]
        fresh = np.ones(len(order), bool)
        fresh[1:] = step[1:] != step[:-1]
        group = np.cumsum(fresh) - 1
        o += 1
    open_ = np.flatnonzero(since >= 0)
    runs.append((open_, since[open_], until[open_]))
    return *(np.concatenate(x) for x in zip(*runs, strict=True)), longest


def buckets(queue: DiskQueue, o: int, span: int, folder: str) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs (id, least, most) of the tuples of one shard or bucket, which share ``o`` bytes of left context, and (id, -1,
    longest match) of its tuples; takes the queue."""
    if queue.rows <= IN_MEMORY:
        t = queue.all()
        queue.drop()
        yield from _together([t], o, span)
        return
    first, c = None, WINDOW
    for block, _ in queue.blocks():
        first = block["left"][0] if first is None else first
        differ = block["left"] != first
        c = min(c, int(block["size"].min()), int(np.where(differ.any(axis=1), differ.argmax(axis=1), WINDOW).min()))
    next_byte: dict[int, DiskQueue] = {}
    smallest = np.full(256, -1, np.int64)  # common prefixes since a bucket's last tuple
    for block, after in queue.blocks():
        lcp = block["lcp"].astype(np.int64)
        best = np.maximum(lcp, np.append(lcp[1:], after))
        best = np.where(block["twin"], np.maximum(best, block["right"]), best)
        least = np.maximum(o, span - best)
        hit = (best >= 0) & (least <= c)
        yield block["id"][hit], least[hit], np.full(int(hit.sum()), c)
        told = (best >= 0) & (best + c >= REPORT - SPAN + span)
        yield block["id"][told], np.full(int(told.sum()), -1), best[told] + c
        stay = np.flatnonzero((best >= 0) & (block["size"] > c) & (best + block["size"] >= min(span, REPORT - SPAN + span)))
        byte = block["left"][stay, min(c, WINDOW - 1)]
        order = np.argsort(byte, kind="stable")
        stay, byte = stay[order], byte[order]
        carried = np.empty(len(stay), np.int64)
        fresh = np.ones(len(stay), bool)
        fresh[1:] = byte[1:] != byte[:-1]
        table, so_far = RangeMinimum(block["lcp"]), np.minimum.accumulate(lcp)
        again = np.flatnonzero(~fresh)
        carried[again] = table(stay[again - 1], stay[again])
        carried[fresh] = np.minimum(smallest[byte[fresh]], so_far[stay[fresh]])
        smallest = np.where(smallest >= 0, np.minimum(smallest, so_far[-1]), -1)
        last = np.append(np.flatnonzero(fresh)[1:] - 1, len(stay) - 1) if len(stay) else np.zeros(0, np.int64)
        to_end = np.append(np.minimum.accumulate(lcp[::-1])[::-1], SPAN)
        smallest[byte[last]] = to_end[stay[last] + 1]
        for at, to in zip(np.flatnonzero(fresh), last + 1, strict=True):
            part = block[stay[at:to]]
            part["lcp"] = carried[at:to]
            b = int(byte[at])
            if b not in next_byte:
                next_byte[b] = DiskQueue(folder)
            next_byte[b].push(part)
    queue.drop()
    for q in next_byte.values():
        q.file.close()
    held: list[np.ndarray] = []
    for b in sorted(next_byte):
        q = next_byte.pop(b)
        if q.rows > IN_MEMORY:
            yield from buckets(q, c + 1, span, folder)
            continue
        held.append(q.all())
        q.drop()
        if sum(map(len, held)) >= TOGETHER or not next_byte:
            yield from _together(held, c + 1, span)
            held = []
    if held:
        yield from _together(held, c + 1, span)


def _together(held: list[np.ndarray], o: int, span: int) -> Iterator[tuple[np.ndarray, ...]]:
    t = np.concatenate(held)
    row, least, most, longest = induce(t["lcp"], t["right"], t["left"], t["size"], t["twin"], np.full(len(t), span), o)
    yield t["id"][row], least, most
    told = np.flatnonzero(longest)
    yield t["id"][told], np.full(len(told), -1), longest[told]


def _matrix(col: pa.Array, width: int, flip: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as rows of ``width`` (left contexts reversed, so column o is the byte o + 1 before the sample), lengths."""
    data, off = C.buffers(col)
    size = np.diff(off)
    out = np.zeros((len(size), width), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    col_at = np.arange(len(data)) - np.repeat(off[:-1], size)
    out[row, np.repeat(size, size) - 1 - col_at if flip else col_at] = data
    return out, size.astype(np.int16)


SPANS = "doc_id long, h1 long, start int, end int, longest int"


def _spans(doc: np.ndarray, h1: np.ndarray, start: np.ndarray, end: np.ndarray, longest: np.ndarray) -> pa.RecordBatch:
    """Spans of documents; those without bytes only bring the longest match of a suffix."""
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(h1), *(pa.array(np.asarray(x).astype(np.int32)) for x in (start, end, longest))], names=["doc_id", "h1", "start", "end", "longest"])


def _matches(doc: np.ndarray, h1: np.ndarray, longest: np.ndarray) -> pa.RecordBatch:
    """One row for each document with a match worth telling."""
    keep = np.flatnonzero(longest >= REPORT - WIDTH_OF_RANGE)
    order = keep[np.lexsort((-longest[keep], h1[keep], doc[keep]))]
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(doc[order]) != 0) | (np.diff(h1[order]) != 0)
    order = order[first]
    zero = np.zeros(len(order), np.int32)
    return _spans(doc[order], h1[order], zero, zero, np.minimum(longest[order], SPAN))


def _fields(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {c: batch.column(c).to_numpy() for c in ("key", "sub", "shift", "span", "doc_id", "h1")}
    out["right"], out["right_size"] = _matrix(batch.column("right"), SPAN, False)
    out["left"], out["left_size"] = _matrix(batch.column("left"), WINDOW, True)
    out["places"] = np.diff(batch.column("at").offsets.to_numpy())
    out["at"] = batch.column("at").flatten().to_numpy()
    return out


def small_shards(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of whole shards that fit into memory together."""
    cols = [_fields(p) for p in parts]
    t = {c: np.concatenate([x[c] for x in cols]) for c in cols[0]}
    fresh = np.ones(len(t["key"]), bool)
    fresh[1:] = (np.diff(t["key"]) != 0) | (np.diff(t["sub"]) != 0)
    lcp = neighbour_lcp(t["right"], t["right_size"], fresh)
    row, least, most, longest = induce(lcp, t["right_size"], t["left"], t["left_size"], t["places"] > 1, t["span"])
    shard = np.cumsum(fresh) - 1
    shared = (np.bincount(shard)[shard] > 1) | (t["places"] > 1)
    yield _matches(t["doc_id"], t["h1"], np.where(shared, longest + SPAN - t["span"], 0))
    first, many = np.cumsum(t["places"]) - t["places"], t["places"][row]
    owner = np.repeat(np.arange(len(row)), many)
    at = t["at"][first[row[owner]] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)]
    row = row[owner]
    yield _spans(t["doc_id"][row], t["h1"][row], at - t["shift"][row] - most[owner], at - t["shift"][row] - least[owner] + SPAN, np.full(len(row), SPAN))


def large_shard(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of one shard of any size, in base order: its tuples, ids and places lie on disk."""
    with tempfile.TemporaryDirectory(prefix="suffixes-", dir=scratch()) as folder:
        queue, rows, many, before = DiskQueue(folder), 0, 0, None
        names = ("doc", "h1", "first", "at")
        files = {n: open(os.path.join(folder, n), "wb") for n in names}
        shift = span = 0
        for part in parts:
            t = _fields(part)
            shift, span = int(t["shift"][0]), int(t["span"][0])
            yield _matches(t["doc_id"], t["h1"], np.full(len(t["key"]), SPAN - span))
            right, size = t["right"], t["right_size"]
            if before is not None:
                right, size = np.concatenate([before[0], right]), np.concatenate([before[1], size])
            lcp = neighbour_lcp(right, size, np.arange(len(size)) == 0)[0 if before is None else 1 :]
            before = right[-1:].copy(), size[-1:]
            tuples = np.empty(len(lcp), TUPLE)
            tuples["id"], tuples["lcp"], tuples["right"] = rows + np.arange(len(lcp)), lcp, t["right_size"]
            tuples["size"], tuples["twin"], tuples["left"] = t["left_size"], t["places"] > 1, t["left"]
            queue.push(tuples)
            for n, x in (("doc", t["doc_id"]), ("h1", t["h1"]), ("first", many + np.cumsum(t["places"])), ("at", t["at"].astype(np.int64))):
                files[n].write(x.astype(np.int64).tobytes())
            rows, many = rows + len(lcp), many + int(t["places"].sum())
        for f in files.values():
            f.close()
        doc, h1, last, at = (np.memmap(os.path.join(folder, n), np.int64, "r") for n in names)
        for row, least, most in buckets(queue, 0, span, folder):
            if len(least) and least[0] < 0:  # longest matches
                for k in range(0, len(row), BLOCK):
                    r = row[k : k + BLOCK]
                    yield _matches(np.asarray(doc[r]), np.asarray(h1[r]), most[k : k + BLOCK] + SPAN - span)
                continue
            for k in range(0, len(row), BLOCK):
                r, lo, hi = row[k : k + BLOCK], least[k : k + BLOCK], most[k : k + BLOCK]
                begin = np.where(r > 0, last[np.maximum(r - 1, 0)], 0)
                times = last[r] - begin
                owner = np.repeat(np.arange(len(r)), times)
                place = at[begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)]
                yield _spans(doc[r[owner]], h1[r[owner]], place - shift - hi[owner], place - shift - lo[owner] + SPAN, np.full(len(owner), SPAN))
        del doc, h1, last, at


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and right context: whole small shards together, a large one by itself."""
    held: list[pa.RecordBatch] = []
    now: list[pa.RecordBatch] = []
    stream = _slices(batches)
    pushed: list[pa.RecordBatch] = []
    aside: list[pa.RecordBatch] = []

    def same_shard(key: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        """What is held of the shard, then the slices that go on with it; the rest of the last one is pushed back."""
        yield from now
        for part in stream:
            if part.schema.names[0] == "doc_id":
                aside.append(part)
                continue
            k, s = part.column("key").to_numpy(), part.column("sub").to_numpy()
            other = np.flatnonzero((k != key[0]) | (s != key[1]))
            if not len(other):
                yield part
                continue
            if other[0]:
                yield part.slice(0, int(other[0]))
            pushed.append(part.slice(int(other[0])))
            return

    while True:
        part = pushed.pop() if pushed else next(stream, None)
        if part is None:
            break
        if part.schema.names[0] == "doc_id":  # decided spans
            yield part
            continue
        key, sub = part.column("key").to_numpy(), part.column("sub").to_numpy()
        last = (int(now[-1].column("key")[-1].as_py()), int(now[-1].column("sub")[-1].as_py())) if now else (int(key[0]), int(sub[0]))
        fresh = np.flatnonzero(np.concatenate([[(key[0], sub[0]) != last], (np.diff(key) != 0) | (np.diff(sub) != 0)]))
        if len(fresh):
            held += [*now, part.slice(0, int(fresh[-1]))]
            now = [part.slice(int(fresh[-1]))]
        else:
            now.append(part)
        if sum(p.num_rows for p in held) >= TOGETHER:
            yield from small_shards([p for p in held if p.num_rows])
            held = []
        if sum(p.num_rows for p in now) > IN_MEMORY:
            yield from large_shard(same_shard((int(now[-1].column("key")[-1].as_py()), int(now[-1].column("sub")[-1].as_py()))))
            now = []
            yield from aside
            aside.clear()
    held = [p for p in [*held, *now] if p.num_rows]
    if held:
        yield from small_shards(held)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of undecided rows; decided spans as rows of their own."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4000):
            part = batch.slice(at, 4000)
            none = part.column("right").is_null()
            if none.true_count:
                done = part.filter(none)
                flat, many = done.column("at").flatten().to_numpy(), np.diff(done.column("at").offsets.to_numpy()) // 2
                doc, h1 = done.column("doc_id").to_numpy(), done.column("h1").to_numpy()
                yield _matches(doc, h1, done.column("span").to_numpy())
                yield _spans(np.repeat(doc, many), np.repeat(h1, many), flat[::2], flat[1::2], np.repeat(done.column("span").to_numpy(), many))
                part = part.filter(pa.compute.invert(none))
            if part.num_rows:
                yield part


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(with_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                data = (batch.column("text")[r].as_py() or "").encode("utf-8")
                spans = merge_spans([(s["start"], s["end"]) for s in batch.column("spans")[r].as_py() or []])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                whole = b"".join(kept)
                rows.append((batch.column("doc_id")[r].as_py(), batch.column("h1")[r].as_py(), batch.column("longest")[r].as_py(), sum(b - a for a, b in spans), len(spans), hashlib.sha256(whole).hexdigest(), *([whole] if with_text else [])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (6 + with_text)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if with_text else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "h1", "longest", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])

    return cut


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, longest_match (and kept, the remaining bytes, with ``with_text``) of
    each row."""
    n = C.parts(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    # a null id takes a fixed value: rows of one id are told apart by their text
    missing = F.col("doc_id").cast("long").isNull()
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), missing.alias("missing"), text.alias("text")).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(11), "text")})
    about = C.stored(base.select("doc_id", "missing", "h1", "h2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "utf-8"), 256).alias("sha")), "about")
    copies = about.where(F.col("n_bytes") >= SPAN).groupBy("h1", "h2", "n_bytes").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("one")).where("n > 1").select("h1", "h2", "one")
    copies = C.stored(copies, "copies")
    spare = about.join(copies, ["h1", "h2"]).where("doc_id <> one").select("doc_id", "h1")

    found = C.stored(base.select("doc_id", "h1", "text").mapInArrow(_sample_rows, "key long, doc_id long, h1 long, at array<int>, low array<int>"), "samples")
    # counts have partial sums, and the join splits a hot K-gram
    twice = found.join(found.groupBy("key").agg(F.sum(F.size("at")).alias("n")).where("n > 1"), "key")
    marks = twice.groupBy("doc_id", "h1").agg(F.collect_set(F.struct("key", "n", "at", "low")).alias("marks")).join(spare, ["doc_id", "h1"], "left_anti")
    live = C.stored(base.select("doc_id", "h1", "text").join(marks, ["doc_id", "h1"]).dropDuplicates(["doc_id", "h1"]), "live")

    contexts = live.mapInArrow(_contexts, "key long, sub long, shift int, span int, right binary, left binary, doc_id long, h1 long, at array<int>")
    spans = contexts.repartition(n, "key", "sub").sortWithinPartitions("key", "sub", "right").mapInArrow(_repeats, SPANS)
    spans = spans.groupBy("doc_id", "h1").agg(F.collect_list(F.when(F.col("end") > F.col("start"), F.struct("start", "end"))).alias("spans"), F.max("longest").cast("long").alias("longest"))
    schema = "doc_id long, h1 long, longest long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    cut = live.select("doc_id", "h1", "text").join(spans, ["doc_id", "h1"]).mapInArrow(_cut(with_text), schema)
    whole = about.join(copies.select("h1", "h2", F.lit(True).alias("copy")), ["h1", "h2"], "left").join(cut, ["doc_id", "h1"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    copy = F.col("copy").isNotNull()
    out = whole.select(
        "doc_id",
        "missing",
        "h1",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit(SPAN)).otherwise(F.coalesce("longest", F.lit(0))).cast("long").alias("longest_match"),
        *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_text else []),
    )
    if with_text:  # texts that lose nothing come from the input
        same = base.select("doc_id", "h1", F.encode("text", "utf-8").alias("all")).dropDuplicates(["doc_id", "h1"])
        out = out.join(same, ["doc_id", "h1"], "left").withColumn("kept", F.coalesce("kept", "all")).drop("all")
    return out.withColumn("doc_id", F.when(~F.col("missing"), F.col("doc_id"))).drop("h1", "missing")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(C.documents(spark, sf_dir).select("doc_id", "text"))
