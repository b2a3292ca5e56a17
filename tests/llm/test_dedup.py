import hashlib
from collections import Counter

import numpy as np
import pytest

from tracewarden.llm import line_dedup, ngram_join, pii, suffix_dedup
from tracewarden.llm.graph import components

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute_repeats(rows, span):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + span] for i in range(len(b) - span + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if seen[b[k : k + span]] > 1:
                gone[k : k + span] = b"\1" * span
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return sorted(out)


def test_suffix_dedup(spark, corpus, docs):
    got = suffix_dedup.remove_repeats(docs, with_text=True).collect()
    rows = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)
    assert rows == brute_repeats(corpus, suffix_dedup.SPAN)
    assert all(sha(r["kept"]) == r["kept_sha256"] for r in got)
    brute = brute_longest(corpus, suffix_dedup.SPAN)
    assert all(r["longest_match"] == brute.get(r["doc_id"], 0) if brute.get(r["doc_id"], 0) >= suffix_dedup.REPORT else r["longest_match"] < suffix_dedup.REPORT for r in got)
    assert sum(r[2] for r in rows) > 5000


def test_suffix_dedup_of_repeated_and_no_rows(spark):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(900))
    df = spark.createDataFrame([(1, long), (1, long), (1, "other"), (2, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [(1, 5, 0), (1, 900, 900), (1, 900, 900), (2, 0, 0)]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def plain_repeats(rows):
    """The steps of ``remove_repeats`` on one machine, without Spark: removed spans of each row."""
    import pyarrow as pa

    table = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "h1": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    found = [r for b in suffix_dedup._sample_rows(iter([table])) for r in b.to_pylist()]
    n, marks = Counter(), {}
    for r in found:
        n[r["key"]] += len(r["at"])
    for r in found:
        if n[r["key"]] > 1:
            marks.setdefault(r["doc_id"], []).append({"key": r["key"], "n": n[r["key"]], "at": r["at"], "low": r["low"]})
    live = [{"doc_id": i, "h1": i, "text": t, "marks": marks[i]} for i, t in rows if i in marks]
    schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("text", pa.string()), ("marks", pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64()), ("at", pa.list_(pa.int32())), ("low", pa.list_(pa.int32()))])))])
    contexts = [r for b in suffix_dedup._contexts(iter(pa.RecordBatch.from_pylist(live[k : k + 5], schema) for k in range(0, len(live), 5))) for r in b.to_pylist()]
    contexts.sort(key=lambda r: (r["key"], r["sub"], r["right"] is not None, r["right"] or b""))
    spans, longest = {}, {}
    for b in suffix_dedup._repeats(iter(pa.RecordBatch.from_pylist(contexts[k : k + 37], suffix_dedup.CONTEXT) for k in range(0, len(contexts), 37))):
        for r in b.to_pylist():
            longest[r["doc_id"]] = max(longest.get(r["doc_id"], 0), r["longest"])
            if r["end"] > r["start"]:
                spans.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    return {i: suffix_dedup.merge_spans(x) for i, x in spans.items()}, longest, len(contexts)


def brute_longest(rows, span):
    """Longest string of each text that also starts elsewhere, up to ``span`` bytes."""
    suffixes = sorted((b[k : k + span], i) for i, t in rows for b in [(t or "").encode()] for k in range(len(b)))
    out = {}
    for (a, i), (b, j) in zip(suffixes, suffixes[1:], strict=False):
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        for d in (i, j):
            out[d] = max(out.get(d, 0), n)
    return out


def brute_spans(rows, span):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + span] for i in range(len(b) - span + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        spans = suffix_dedup.merge_spans([(k, k + span) for k in range(len(b) - span + 1) if seen[b[k : k + span]] > 1])
        if spans:
            out[i] = spans
    return out


def passages(n):
    """One hot passage of 500 bytes in all of ``n`` texts, a shorter one of 300 in all, and pairs with common surroundings."""
    rng = np.random.default_rng(9)
    letters = lambda k: bytes(rng.integers(97, 101, k).tolist()).decode()
    long, short, beside = letters(500), letters(300), [letters(90) for _ in range(6)]
    rows = []
    for i in range(n):
        around = beside[i % 6] if i % 3 else letters(90)
        rows.append((i, letters(60) + around + (short if i % 5 else short[:250]) + around[: i % 60] + letters(150) + (long if i % 4 else long[: 380 + i % 40]) + letters(30)))
    return [*rows, (n, "ab" * 900), (n + 1, "x" * 1000), (n + 2, rows[3][1] + "é" * 250), (n + 3, None), (n + 4, "é" * 250)]


@pytest.mark.parametrize("bounds", [{}, {"HOT": 5}, {"IN_MEMORY": 12, "BLOCK": 5, "TOGETHER": 6}, {"HOT": 5, "IN_MEMORY": 4, "BLOCK": 3, "TOGETHER": 2}, {"REMEMBERED": 0, "IN_MEMORY": 12, "BLOCK": 7}, {"REMEMBERED": 0, "HOT": 30, "IN_MEMORY": 6, "BLOCK": 4}])
def test_shards_larger_than_memory_and_hot_ones(monkeypatch, bounds):
    """A hot K-gram has ten times as many tuples as fit into memory: queues on disk, ranges and twins give what memory gives."""
    rows = passages(130)
    for name, value in bounds.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    got, longest, contexts = plain_repeats(rows)
    assert got == brute_spans(rows, suffix_dedup.SPAN)
    for i, n in brute_longest(rows, suffix_dedup.SPAN).items():
        told = longest.get(i, 0)
        assert told == n or ("HOT" in bounds and n >= told >= 244) or n < 256 and told in (0, n), (i, n, told)
    assert {longest.get(i, 0) for i in (133, 134, 130)} <= {0, 400, 500} and any(256 <= n < 400 for n in longest.values())
    assert contexts > 10 * suffix_dedup.IN_MEMORY or "IN_MEMORY" not in bounds


def test_very_long_text_in_stretches(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 123, 5000).tolist()).decode()
    batch = pa.RecordBatch.from_pydict({"text": [text], "doc_id": [1], "h1": [1]})
    whole = {(a, low) for r in suffix_dedup._sample_rows(iter([batch])) for al, ll in zip(r["at"].to_pylist(), r["low"].to_pylist(), strict=True) for a, low in zip(al, ll, strict=True)}
    monkeypatch.setattr(suffix_dedup, "_STRETCH", 1000)
    cut = {(a, low) for r in suffix_dedup._sample_rows(iter([batch])) for al, ll in zip(r["at"].to_pylist(), r["low"].to_pylist(), strict=True) for a, low in zip(al, ll, strict=True)}
    assert {a for a, _ in whole} == {a for a, _ in cut} and whole <= cut


def brute_lines(rows):
    keys, split = {}, {}
    for i, t in rows:
        split[i] = (t or "").split("\n")
        for line in split[i]:
            k = line.strip(SPACE).translate(LOWER)
            if len(k) >= 40:
                keys.setdefault(k, set()).add(i)
    out = []
    for i, _ in rows:
        kept = [x for x in split[i] if not (len(k := x.strip(SPACE).translate(LOWER)) >= 40 and len(keys[k]) >= 5 and i != max(keys[k]))]
        out.append((i, len(split[i]), len(split[i]) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark):
    common = "This very common line stands in many of the documents"
    rows = [(i, f"{common}\nown {i}\n \t{common.upper() if i % 2 else common}\x0b\n\nshort\n{common}") for i in range(7)]
    rows += [(7, None), (8, ""), (9, "\n\n"), (10, "é" * 39 + "\n" + "é" * 40)] + [(20 + i, "é" * 40) for i in range(5)] + [(30, "\n".join(["a" * 50] * 200))] + [(31 + i, "a" * 50) for i in range(5)]
    df = spark.createDataFrame([(i, t, 9, "w") for i, t in rows], "doc_id long, text string, n_lines int, words string")
    out = line_dedup.apply_bitmaps(df, line_dedup.drop_bitmaps(df))
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect())
    assert got == brute_lines(rows) and any(r[2] for r in got)
    bitmaps = {r["doc_id"]: r["keep"] for r in line_dedup.keep_bitmaps(df).collect()}
    assert bitmaps[0] == {0: ~0b100101} and 6 not in bitmaps and bitmaps[30] == {k: 0 if k < 3 else ~((1 << 8) - 1) for k in range(4)}
    assert line_dedup.drop_bitmaps(df.limit(0)).count() == 0


def brute_classes(rows, width=3, percent=90):
    sets = {}
    for i, t in rows:
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


@pytest.mark.parametrize("short", [1, 8])
def test_ngram_join(spark, corpus, docs, monkeypatch, short):
    monkeypatch.setattr(ngram_join, "SHORT", short)
    got = sorted(tuple(r) for r in ngram_join.classes(docs).collect())
    assert got == brute_classes(corpus) and len({r[2] for r in got}) < len(got)


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Chains and stars of near copies, in blocks of two nodes."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    base = [f"w{i}" for i in range(130)]
    rows = []
    for i in range(24):
        w = list(base)
        for k in range(i, i + 2):
            w[5 * k % 130] = f"x{k}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join([*base[:60], *(f"y{i}_{k}" for k in range(70))])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.classes(df).collect()) == brute_classes(rows)


def test_stage_takes_thresholds_and_finds_near_copies_between_the_thresholds(spark):
    """3 of 150 words changed one by one, and a block appended: five words at 0.8 link, three at 0.9 do not."""
    base = [f"w{i}" for i in range(150)]
    single = [f"x{i}" if i in (30, 75, 120) else w for i, w in enumerate(base)]
    other = [f"v{i}" for i in range(150)]
    texts = [base, single, other, [*other, *(f"y{i}" for i in range(25))], [f"z{i}" for i in range(150)]]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [c for _, _, c in brute_classes(rows)] == [0, 1, 2, 3, 4]
    assert [c for _, _, c in brute_classes(rows, 5, 80)] == [0, 0, 2, 2, 4]
    assert sorted(r["doc_id"] for r in ngram_join.stage(spark, df, "").collect()) == [0, 2, 4]
    assert sorted(r["doc_id"] for r in ngram_join.stage(spark, df, "", 3, 90).collect()) == [0, 1, 2, 3, 4]


def test_sets_of_one_hash_are_told_apart(spark, corpus, docs, monkeypatch):
    """The 64 bits that name a node clash for all sets of a third; the other 64 tell them apart."""
    whole = ngram_join.set_hash
    monkeypatch.setattr(ngram_join, "set_hash", lambda h, begin, salt: whole(h, begin, salt) % 3 if salt == 0xA5A5A5A5A5A5A5A5 else whole(h, begin, salt))
    assert sorted(tuple(r) for r in ngram_join.classes(docs).collect()) == brute_classes(corpus)


def test_repeated_ids_lose_no_link(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail")]
    got = sorted(tuple(r) for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 58, 1), (1, 58, 1), (2, 59, 1), (3, 59, 1)]


def test_null_and_repeated_ids(spark):
    """Rows are told apart by their text where ids are null or repeated."""
    words = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcde"]
    near = words[0] + " more"
    rows = [(None, words[0]), (None, near), (None, words[1]), (7, words[2]), (7, words[3]), (7, words[3]), (8, words[3] + " more"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in ngram_join.stage(spark, df, "").collect()]
    assert len(got) == 5 and len({t for _, t in got} & {words[0], near}) == 1
    assert {(None, words[1]), (7, words[2]), (7, words[3]), (9, None)} <= set(got)
    common = "This very common line stands in many of the documents"
    lines = [(i, common) for i in range(9, 14)] + [(7, f"{common}\nx"), (7, f"y\n{common}"), (None, "own")]
    df = spark.createDataFrame(lines, "doc_id long, text string")
    out = line_dedup.apply_bitmaps(df, line_dedup.drop_bitmaps(df)).collect()
    assert sorted(r["text"] for r in out if r["doc_id"] == 7) == ["x", "y"] and [r["text"] for r in out if r["doc_id"] is None] == ["own"]
    long = " ".join(words[:3])
    df = spark.createDataFrame([(None, long), (None, long + " tail"), (1, "other")], "doc_id long, text string")
    cut = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix_dedup.remove_repeats(df).collect()}
    assert cut == {(None, len(long)): len(long), (None, len(long) + 5): len(long), (1, 5): 0}
    out = pii.replace_entities(spark.createDataFrame([(None, "a.b@mail.org"), (None, "no"), (None, None)], "doc_id long, text string")).collect()
    assert len(out) == 3 and not any("mail.org" in (r["text"] or "") for r in out)


def test_ngram_join_without_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.classes(df).collect()) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]
    assert ngram_join.classes(df.limit(0)).count() == 0


def test_divide_skip_matches_counting():
    rng = np.random.default_rng(0)
    for _ in range(200):
        lists = [sorted(set(rng.integers(0, 12, rng.integers(1, 8)).tolist())) for _ in range(rng.integers(1, 9))]
        need = int(rng.integers(1, 6))
        counts = Counter(x for lst in lists for x in lst)
        assert ngram_join.divide_skip(lists, need) == sorted(x for x, n in counts.items() if n >= need)


def test_signatures_never_refute_a_link():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.unique(np.concatenate([a[: n - int(rng.integers(0, n // 8 + 1))], rng.integers(0, 2**63, int(rng.integers(0, 9))).astype(np.uint64)]))
        a = np.unique(a)
        x, y = ngram_join.signature(a), ngram_join.signature(b)
        w = min(len(x), len(y))
        bits = int(np.bitwise_count(ngram_join.folded(x, w) ^ ngram_join.folded(y, w)).sum())
        assert bits <= len(np.setxor1d(a, b))
        if ngram_join.linked(a, b):
            assert len(np.setxor1d(a, b)) <= ngram_join.most_difference(len(a), len(b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and {got[i] for i in (100, 101, 103)} == {100}
