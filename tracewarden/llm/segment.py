"""Sampled segmentations without replacement, and decoding (operator 8).

A text's segmentations into pieces are the paths of a lattice. Gumbel top-k draws
k distinct paths in the order of their perturbed log-probabilities: the root gets
one Gumbel value, a node's children get values conditioned on having the node's
as their maximum, and a best-first (A*) search pops the largest value from an
agenda. The value of an unexpanded node is exactly the best of all paths below
it, so what is popped k-th is the k-th sample. The value popped after the last
sample is the threshold for inclusion scores.

No piece crosses the start of a run of blanks or a line break, so the lattice of
a text is a chain of small ones. Each distinct small lattice is built once per
process with its backward masses; the search then descends through all texts of a
batch at once with array operations.

Noise comes from a hash of the row key, the sample's number and the place in the
tree, so a row gets the same samples in any batch, partition or run.

Cases: null text is empty; a null doc_id stays null and draws from a seed of its
own; an empty text has one segmentation without pieces; a
text with fewer than k segmentations returns all of them; characters outside the
vocabulary become byte pieces; decoding gives back every text exactly.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import common as C

SAMPLES, SEED = 2, 20_011
#: Added to the seed of rows without an id.
NO_ID = 1 << 40
#: Inverse temperature: log-probabilities of pieces are multiplied by it before they are normalised over the paths.
ALPHA = 0.2
#: Offset of Zipf's law by which a merge rank becomes a probability.
ZIPF = 2.7
_MAX_ARCS = 6_000_000
_models: dict[str, Lattices] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Rows:
    """Arrays of equal length that grow by doubling."""

    def __init__(self, **kinds) -> None:
        self.n, self.data = 0, {k: np.zeros(1 << 12, t) for k, t in kinds.items()}

    def extend(self, **more: np.ndarray) -> None:
        n = self.n + len(next(iter(more.values())))
        for k, x in more.items():
            if n > len(self.data[k]):
                grown = np.empty(max(n, len(self.data[k]) * 3 // 2), self.data[k].dtype)
                grown[: self.n] = self.data[k][: self.n]
                self.data[k] = grown
            self.data[k][self.n : n] = x
        self.n = n


class Lattices:
    """Pieces of a model with log-probabilities, and a growing table of the lattices of distinct chunks.

    A unigram model's scores are its log-probabilities; those of a merge model are ranks, which Zipf's law turns into
    log-probabilities. Pieces and their prefixes are found by hash, for all start positions of new chunks at once.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        score = {i: model.get_score(i) for i in normal}
        if all(s <= 0 and float(s).is_integer() for s in score.values()):
            total = math.log(sum(1 / (ZIPF - s) for s in score.values()))
            score = {i: -math.log(ZIPF - s) - total for i, s in score.items()}
        pieces = {model.id_to_piece(i).replace("▁", " "): i for i in normal}
        if any(re.search(r"[^ ] |.\n|\n.", p) for p in pieces):
            raise ValueError("a piece of this model crosses a blank or a line break")
        score = {i: ALPHA * s for i, s in score.items()}
        self.pieces = {p: (i, score[i]) for p, i in pieces.items()}
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_score = min(score.values()) - 2.0
        size = [b""] * n
        for p, i in pieces.items():
            size[i] = p.encode()
        for b, i in self.byte_ids.items():
            size[i] = bytes([b])
        self.piece_off = np.cumsum([0, *map(len, size)])
        self.piece_bytes = np.frombuffer(b"".join(size), np.uint8)
        # what an arc stands for: a piece, or (added when met) the bytes of a character outside the vocabulary
        self.arc_score = np.array([score.get(i, 0.0) for i in range(n)])
        self.arc_ids = [np.array([i], np.int32) for i in range(n)]
        self.unknown: dict[int, int] = {}
        self.flat_n = np.zeros(0, np.int64)
        prefixes = {p[:k]: -1 for p in pieces for k in range(1, len(p) + 1)}
        prefixes.update(pieces)
        keys = np.array([self._hash(p) for p in prefixes], np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two prefixes share a hash")
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(list(prefixes.values()), np.int64)[order]
        self.longest = max(map(len, pieces))
        # first key of each bucket of leading bits
        self.shift = np.uint64(64 - 20)
        self.bucket = np.searchsorted(self.keys >> self.shift, np.arange((1 << 20) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.bucket).max())
        self.clear()

    @staticmethod
    def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (h ^ (code.astype(np.uint64) + np.uint64(0x9E37))) * np.uint64(0xC2B2AE3D27D4EB4F)
            return h ^ (h >> np.uint64(29))

    @staticmethod
    def _key(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return h * np.uint64(0x9E3779B97F4A7C15)

    def _hash(self, text: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in text:
            h = self._step(h, np.array([ord(c)]))
        return int(self._key(h)[0])

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Number of each key in the sorted table, -1 where it isn't there."""
        slot = (key >> self.shift).astype(np.int64)
        at, end = self.bucket[slot], self.bucket[slot + 1]
        found = np.full(len(key), -1)
        open_ = np.flatnonzero(at < end)
        for k in range(self.deepest):
            x = at[open_] + k
            hit = self.keys[x] == key[open_]
            found[open_[hit]] = x[hit]
            open_ = open_[~hit & (x + 1 < end[open_])]
        return found

    def clear(self) -> None:
        self.roots: dict[int, int] = {}
        self.nodes = _Rows(start=np.int32, count=np.int32)
        self.arcs = _Rows(cond=np.float64, share=np.float32, next=np.int32, what=np.int32)

    def _bytes_arc(self, code: int) -> int:
        found = self.unknown.get(code)
        if found is None:
            raw = chr(code).encode("utf-8", "surrogatepass")
            found = self.unknown[code] = len(self.arc_ids)
            self.arc_ids.append(np.array([self.byte_ids[b] for b in raw], np.int32))
            self.arc_score = np.append(self.arc_score, self.byte_score * len(raw))
        return found

    def add(self, codes: np.ndarray, size: np.ndarray, keys: list[int]) -> None:
        """Lattices of new chunks (code points of all, sizes, hashes): nodes are characters, consecutive in a chunk; arcs carry their share of the mass."""
        n = len(codes)
        end = np.repeat(np.cumsum(size), size)
        live, h = np.arange(n), np.zeros(n, np.uint64)
        at, length, what = [], [], []
        for k in range(self.longest):
            h = self._step(h, codes[live + k])
            found = self._find(self._key(h))
            known = found >= 0
            live, h, value = live[known], h[known], self.values[found[known]]
            whole = value >= 0
            at.append(live[whole])
            length.append(np.full(int(whole.sum()), k + 1))
            what.append(value[whole])
            if k == 0:
                single = np.zeros(n, bool)
                single[live[whole]] = True
                rest = np.flatnonzero(~single)
                kinds, which = np.unique(codes[rest], return_inverse=True)
                at.append(rest)
                length.append(np.ones(len(rest), np.int64))
                what.append(np.array([self._bytes_arc(int(c)) for c in kinds], np.int64)[which] if len(rest) else rest)
            more = live + k + 1 < end[live]
            live, h = live[more], h[more]
            if not len(live):
                break
        # arcs of a node together, the longest (which mostly holds most of the mass) first
        at, length, what = (np.concatenate(x[::-1]) for x in (at, length, what))
        order = np.argsort(at, kind="stable")
        at, length, what = at[order], length[order], what[order]
        count = np.bincount(at, minlength=n)
        start = np.cumsum(count) - count
        # backward masses, for all chunks together by distance from the end
        beta = np.zeros(n + 1)
        left = (end - np.arange(n)).astype(np.int32)
        mass = self.arc_score[what]
        final = at + length == end[at]
        by_left = np.argsort(left, kind="stable")
        cuts = np.searchsorted(left[by_left], np.arange(1, int(left.max()) + 2))
        for k in range(len(cuts) - 1):
            nodes = by_left[cuts[k] : cuts[k + 1]]
            owner, arc = _spread(start[nodes], count[nodes])
            mass[arc] += np.where(final[arc], 0.0, beta[at[arc] + length[arc]])
            first = np.cumsum(count[nodes]) - count[nodes]
            top = np.maximum.reduceat(mass[arc], first)
            beta[nodes] = top + np.log(np.add.reduceat(np.exp(mass[arc] - top[owner]), first))
        base, arc_base = self.nodes.n, self.arcs.n
        cond = mass - beta[at]
        run = np.concatenate([[0.0], np.cumsum(np.exp(cond))])
        share = run[1:] - run[start[at]]
        share[start + count - 1] = 2.0  # the last arc takes what rounding leaves
        self.nodes.extend(start=start + arc_base, count=count)
        self.arcs.extend(cond=cond, share=share, next=np.where(final, -1, at + length + base), what=what)
        self.roots.update(zip(keys, (np.cumsum(size) - size + base).tolist(), strict=True))

    def words(self, texts: list[str]) -> list[np.ndarray]:
        """First node of each chunk of each text (which gets a blank in front, unless it is empty). Chunks are known by
        a hash of their bytes."""
        data, off = C.buffers(pa.array([b" " + x.encode("utf-8", "surrogatepass") if x else b"" for x in texts], pa.large_binary()))
        if not len(data):
            return [np.zeros(0, np.int64) for _ in texts]
        blank, line = data == 32, data == 10
        cut = line.copy()
        cut[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
        cut[off[:-1][np.diff(off) > 0]] = True
        begin = np.flatnonzero(cut)
        stop = np.append(begin[1:], len(data))
        which, keys = pd.factorize(C.range_hash(C.prefix_sums(data), begin, stop))
        first = np.zeros(len(keys), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        keys = keys.tolist()
        new = np.array([i for k, i in zip(keys, first.tolist(), strict=True) if k not in self.roots], np.int64)
        if len(new):
            codes = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            size = place[stop[new]] - place[begin[new]]
            self.add(codes[_spread(place[begin[new]], size)[1]], size, [keys[i] for i in which[new].tolist()])
        node = np.fromiter(map(self.roots.__getitem__, keys), np.int64, len(keys))[which]
        at = np.searchsorted(begin, off)
        return [node[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]

    def table(self) -> dict[str, np.ndarray]:
        return self.nodes.data | self.arcs.data

    def ids_of(self, what: np.ndarray) -> np.ndarray:
        """Piece ids of arcs."""
        if len(self.flat_n) < len(self.arc_ids):
            self.flat = np.concatenate(self.arc_ids)
            self.flat_n = np.array([len(x) for x in self.arc_ids])
            self.flat_at = np.cumsum(self.flat_n) - self.flat_n
        n = self.flat_n[what]
        if (n == 1).all():
            return self.flat[self.flat_at[what]]
        return self.flat[_spread(self.flat_at[what], n)[1]]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of pieces, without the blank that stands before every text."""
        size = self.piece_off[ids + 1] - self.piece_off[ids]
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(self.piece_off[ids], size)
        return self.piece_bytes[at].tobytes()[1:]


def lattices(path: str) -> Lattices:
    if path not in _models:
        _models[path] = Lattices(path)
    return _models[path]


def _uniform(seed: np.ndarray, word: np.ndarray, step: int, arc: np.ndarray | None = None) -> np.ndarray:
    """Numbers in (0, 1) from a hash of the place in the tree."""
    with np.errstate(over="ignore"):
        h = seed + word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step * 0x2545F4914F6CDD1D % 2**64)
        if arc is not None:
            h = h + (arc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        h = C.mix(h)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _noise(seed: np.ndarray, word: np.ndarray, step: int, arc: np.ndarray) -> np.ndarray:
    """Standard Gumbel values."""
    return -np.log(-np.log(_uniform(seed, word, step, arc)))


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and position of each item of the ranges [start, start + count)."""
    owner = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return owner, np.arange(len(owner)) - first[owner] + start[owner]


class Descent:
    """One completed path for each of several texts and the best siblings passed on the way.

    A sibling's value is -log(e^-G - e^-Z + e^-g), with G the path's value, Z that of the best child and g its own, all
    at its node. It can only reach a bound B if Z - g is below e^(Z - B), which doubles cannot hold once Z is ``DEEP``
    under B; Z falls with the log-probability of the path, so only a text's first words need Gumbel values for every
    child. Later words draw one child each by its share of the mass, which is the same law.
    """

    DEEP, EARLY = 38.0, 32

    def __init__(self, t: dict, node: np.ndarray, text: np.ndarray, word: np.ndarray, logp: np.ndarray, value: np.ndarray, seed: np.ndarray, keep: int) -> None:
        """``node``: where each word starts, ordered by (text, word); ``logp``, ``value``: of the node where the text starts."""
        self.t, self.text, self.word, self.seed, self.value, self.keep = t, text, word, seed, value, keep
        n = len(logp)
        off = np.searchsorted(text, np.arange(n + 1))
        place = np.arange(len(node)) - off[text]
        self.steps = np.zeros(len(node), np.int64)
        self.chosen: list[tuple] = []
        found: list[tuple] = []
        now, bound = logp.astype(float).copy(), np.full(n, -np.inf)
        open_, low = np.ones(n, bool), 0
        while True:  # windows of words, for as long as a text's siblings can still count
            at = np.flatnonzero(open_[text] & (place >= low) & (place < low + self.EARLY))
            if not len(at):
                break
            now, more = self._choose(at, node[at], now)
            found.append(more)
            own, got = (np.concatenate([f[k] for f in found]) for k in (0, 4))
            order = np.lexsort((-got, own))
            rank = np.arange(len(order)) - np.searchsorted(own[order], own[order])
            last = order[rank == keep - 1]
            bound[own[last]] = got[last]
            low += self.EARLY
            open_ = now > bound - self.DEEP
        self._draw(np.flatnonzero(self.steps == 0), node)
        first = np.cumsum(self.steps) - self.steps
        self.arc = np.zeros(int(self.steps.sum()), np.int64)
        for w, s, a in self.chosen:
            self.arc[first[w] + s] = a
        self.off = np.append(first, len(self.arc))[off]
        run = np.concatenate([[0.0], np.cumsum(t["cond"][self.arc])])
        self.logp = logp + run[self.off[1:]] - run[self.off[:-1]]
        self.words = np.repeat(word, self.steps)
        self.siblings: list[list[tuple]] = [[] for _ in range(n)]
        if found:
            own, w, s, a, got, before = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((-got, own))
            rank = np.arange(len(order)) - np.searchsorted(own[order], own[order])
            for i in order[rank < keep].tolist():
                o = int(own[i])
                self.siblings[o].append((float(got[i]), int(first[w[i]] + s[i] - self.off[o]), int(a[i]), float(before[i])))

    def _choose(self, words: np.ndarray, at: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Gumbel values for every child in ``words``; the log-probability of each text after them, and its best siblings
        among them: text, word, step, arc, value, log-probability of the parent."""
        t, text, seed = self.t, self.text, self.seed
        live, step, chosen, passed = words, 0, [], []
        while len(live):
            many = t["count"][at]
            owner, arc = _spread(t["start"][at], many)
            val = t["cond"][arc] + _noise(seed[text[live]][owner], self.word[live][owner], step, arc - t["start"][at][owner])
            top = np.maximum.reduceat(val, np.cumsum(many) - many)
            best = np.flatnonzero(val == top[owner])
            if len(best) > len(live):
                best = best[np.unique(owner[best], return_index=True)[1]]
            rest = np.ones(len(arc), bool)
            rest[best] = False
            rest = np.flatnonzero(rest)
            passed.append((live[owner[rest]], np.full(len(rest), step), arc[rest], val[rest], top[owner[rest]]))
            pick = arc[best]
            chosen.append((live, step, pick))
            self.steps[live] += 1
            to = t["next"][pick]
            live, at = live[to >= 0], to[to >= 0]
            step += 1
        self.chosen += chosen
        local = np.zeros(len(self.steps), np.int64)
        size = self.steps[words]
        local[words] = np.cumsum(size) - size
        cond = np.zeros(int(size.sum()))
        for w, s, a in chosen:
            cond[local[w] + s] = t["cond"][a]
        run = np.concatenate([[0.0], np.cumsum(cond)])
        own = text[words]
        texts, begin = np.unique(own, return_index=True)
        begin = local[words[begin]]
        base = np.zeros(len(now))
        base[texts] = now[texts] - run[begin]
        after = now.copy()
        after[texts] = base[texts] + run[np.append(begin[1:], len(cond))]
        w, s, a, val, top = (np.concatenate(x) for x in zip(*passed, strict=True))
        own = text[w]
        before = run[local[w] + s] + base[own]
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            v = self.value[own] - before - val + np.log(-np.expm1(val - top))
            got = self.value[own] - np.maximum(0, v) - np.log1p(np.exp(-np.abs(v)))
        order = np.lexsort((-got, own))
        order = order[np.arange(len(order)) - np.searchsorted(own[order], own[order]) < self.keep]
        return after, tuple(x[order] for x in (own, w, s, a, got, before))

    def _draw(self, live: np.ndarray, node: np.ndarray) -> None:
        """One child for each node on the way, by its share of the mass."""
        t = self.t
        at, seed, word, step = node[live], self.seed[self.text[live]], self.word[live], 0
        while len(live):
            u = _uniform(seed, word, step)
            pick = t["start"][at]
            past = np.flatnonzero(u >= t["share"][pick])
            while len(past):
                pick[past] += 1
                past = past[u[past] >= t["share"][pick[past]]]
            self.chosen.append((live, step, pick))
            self.steps[live] += 1
            to = t["next"][pick]
            on = np.flatnonzero(to >= 0)
            live, at, seed, word = live[on], to[on], seed[on], word[on]
            step += 1


def sample_batch(model: Lattices, keys: list[int], texts: list[str], samples: int = SAMPLES, seed: int = SEED) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples in order of draw: ids, log-probability, perturbed value, log of the inclusion score."""
    if model.arcs.n > _MAX_ARCS:
        model.clear()
    words = model.words(texts)
    t = model.table()
    base = C.mix(np.array(keys, np.int64).view(np.uint64) ^ C.mix(np.full(len(keys), seed, np.uint64)))
    u = ((C.mix(base ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    root = -np.log(-np.log(u))
    # a job is one descent: text number, agenda's number of the sample, prefix of arcs, words left (first may start inside)
    jobs = [(i, np.zeros(0, np.int64), np.zeros(0, np.int64), w, 0, 0.0, float(root[i])) for i, w in enumerate(words)]
    done: list[list[tuple]] = [[] for _ in texts]
    agenda: list[list[tuple]] = [[] for _ in texts]
    for k in range(samples):
        if not jobs:
            break
        sizes = np.array([len(j[3]) for j in jobs])
        node = np.concatenate([j[3] for j in jobs]) if jobs else np.zeros(0, np.int64)
        text, at = _spread(np.array([j[4] for j in jobs]), sizes)
        with np.errstate(over="ignore"):
            own_seed = C.mix(base[[j[0] for j in jobs]] + np.uint64((k + 1) * 0xA0761D6478BD642F % 2**64))
        d = Descent(t, node, text, at, np.array([j[5] for j in jobs]), np.array([j[6] for j in jobs]), own_seed, samples - k + 1)
        for x, (i, prefix, prefix_words, _, _, _, value) in enumerate(jobs):
            arcs = np.concatenate([prefix, d.arc[d.off[x] : d.off[x + 1]]])
            arc_words = np.concatenate([prefix_words, d.words[d.off[x] : d.off[x + 1]]])
            done[i].append((arcs, float(d.logp[x]), value))
            agenda[i] += [(got, arcs, arc_words, len(prefix) + pos, a, before) for got, pos, a, before in d.siblings[x]]
        jobs = []
        for i, queue in enumerate(agenda):
            if k + 1 < samples and len(done[i]) == k + 1 and queue:
                best = max(range(len(queue)), key=lambda q: queue[q][0])
                got, arcs, arc_words, pos, a, before = queue.pop(best)
                w = int(arc_words[pos])
                to = int(t["next"][a])
                left = words[i][w + 1 :] if to < 0 else np.concatenate([[to], words[i][w + 1 :]])
                jobs.append((i, np.append(arcs[:pos], a), arc_words[: pos + 1], left, w + 1 if to < 0 else w, before + float(t["cond"][a]), got))
    out = []
    for i, found in enumerate(done):
        rest = max((q[0] for q in agenda[i]), default=-math.inf)
        row = []
        for arcs, logp, value in found:
            x = logp - rest
            inclusion = 0.0 if rest == -math.inf else (x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0)))))
            row.append((model.ids_of(t["what"][arcs]), logp, value, inclusion))
        out.append(row)
    return out


COLUMNS = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, decodes boolean"


def sample_segmentations(docs: DataFrame, model: str | None = None, samples: int = SAMPLES, seed: int = SEED, with_ids: bool = False) -> DataFrame:
    """The samples of each document (see COLUMNS; ``with_ids`` adds the ids themselves). The row key is doc_id."""
    path = model or default_model()
    schema = COLUMNS + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lattices(path)
        for p in C.pieces(batches, "text", 1 << 19):
            ids = p.column("doc_id").to_pylist()
            texts = [x or "" for x in p.column("text").to_pylist()]
            rows = []
            drawn: list = [None] * len(ids)
            # rows without an id draw from a seed of their own, so they are not document 0
            for own, with_seed in (([i for i, x in enumerate(ids) if x is not None], seed), ([i for i, x in enumerate(ids) if x is None], seed + NO_ID)):
                for i, found in zip(own, sample_batch(m, [ids[i] or 0 for i in own], [texts[i] for i in own], samples, with_seed) if own else [], strict=True):
                    drawn[i] = found
            for doc, text, found in zip(ids, texts, drawn, strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for k, (pieces, logp, value, inclusion) in enumerate(found):
                    rows.append((doc, k, len(pieces), zlib.crc32(pieces.astype("<u4").tobytes()), round(logp, 6), round(value, 6), round(inclusion, 6), (m.decode(pieces) if len(pieces) else b"") == raw, *([pieces] if with_ids else [])))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), *([pa.list_(pa.int32())] if with_ids else [])]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode(rows: DataFrame, column: str = "ids", model: str | None = None) -> DataFrame:
    """``rows`` with ``text``: the decoded ids of ``column``; null ids give null."""
    path = model or default_model()

    @F.pandas_udf("string")
    def text(ids):
        m = lattices(path)
        return ids.map(lambda x: None if x is None else (m.decode(np.asarray(x, np.int64)).decode("utf-8", "replace") if len(x) else ""))

    return rows.withColumn("text", text(F.col(column)))


def op8_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(C.documents(spark, sf_dir).select("doc_id", "text"))
