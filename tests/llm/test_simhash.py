import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewarden.llm import simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def fingerprint(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def labels(values, radius=4):
    """Smallest index reachable of each value, by all pairs."""
    u = np.array(values, np.uint64)
    label = np.arange(len(u))
    near = [np.flatnonzero(np.bitwise_count(x ^ u) <= radius) for x in u]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 200), st.integers(0, 2**63))
def test_xxh64(size, seed):
    rows = np.random.default_rng(size).integers(0, 256, (5, size), dtype=np.uint8)
    assert simhash.xxh64(rows, seed).tolist() == [xxhash.xxh64_intdigest(r.tobytes(), seed) for r in rows]


def test_grids_share_a_cell_for_all_near_pairs():
    rng = random.Random(2)
    grids = simhash.grids()
    assert len(grids) == 15 and all(bits | sum(rest) == (1 << 64) - 1 for bits, rest in grids)
    for _ in range(300):
        x, flips = rng.getrandbits(64), rng.sample(range(64), 4)
        y = x
        for b in flips:
            y ^= 1 << b
        assert any(x & bits == y & bits and sum(abs((x & m).bit_count() - (y & m).bit_count()) for m in rest) <= 4 for bits, rest in grids)


def test_classes(spark, corpus, full_docs):
    rows = [r for r in corpus]
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.classes(full_docs).collect()}
    fps = [fingerprint(t) for _, t in rows]
    want = labels(fps)
    assert got == {i: (f, rows[k][0]) for (i, _), f, k in zip(rows, fps, want, strict=True)}
    assert len(set(want.tolist())) < len(set(fps))


@pytest.mark.parametrize("small,block", [(32, 50_000), (3, 50_000), (3, 40)])
def test_links_of_dense_and_scattered_fingerprints(spark, monkeypatch, small, block):
    """Groups that chain beyond the radius, dense balls and strangers; cells row by row, by search and in blocks."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(small + block)
    values = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1, 0xF, 0x1F}
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(120):  # a ball
            y = x
            for b in rng.sample(range(64), rng.randint(1, 4)):
                y ^= 1 << b
            values.add(y)
        for _ in range(30):  # a chain
            for b in rng.sample(range(64), 4):
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3), block=block).collect()
    assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 4 for r in links)
    parent = {v: v for v in signed}

    def root(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for r in links:
        parent[root(r["a"])] = root(r["b"])
    want = labels(values)
    groups = {}
    for v, k in zip(signed, want.tolist(), strict=True):
        groups.setdefault(k, set()).add(v)
    assert {frozenset(g) for g in groups.values()} == {frozenset(v for v in signed if root(v) == r) for r in {root(v) for v in signed}}


def test_a_large_cell_gives_no_more_links_than_members():
    rng = random.Random(9)
    x = rng.getrandbits(64)
    ball = np.array(sorted({x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(4000)}), np.uint64)
    total = np.bitwise_count(ball).astype(np.int64)
    order = np.argsort(total, kind="stable")
    a, b = simhash.spanning_links(ball[order], total[order], 4)
    assert len(a) == len(ball) - 1 and len(set(b.tolist())) == len(b)


def test_ids_and_texts_of_every_kind(spark):
    big = (1 << 60) + 1
    rows = [(None, "one two three four five"), (big, "one two three four five"), (-big, None), (3, ""), (3, " \n"), (None, None), (5, "Ünï " * 9000), (6, "one"), (6, "one"), (7, "x" * 5000)]
    got = [tuple(r) for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()]
    assert sorted((i is None, i or 0, f & (2**64 - 1)) for i, f, _ in got) == sorted((i is None, i or 0, fingerprint(t)) for i, t in rows)
    assert {c for i, f, c in got if f == 0} == {-big} and {c for i, _, c in got if i == big} == {big}
    assert simhash.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    got = simhash.op13_simhash_near_dedup(spark, SF).collect()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    fps = [fingerprint(t) for _, t in rows]
    want = {i: (f"{f:016x}", rows[k][0]) for (i, _), f, k in zip(rows, fps, labels(fps), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want
