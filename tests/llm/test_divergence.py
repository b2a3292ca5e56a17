import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tracewarden.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def plain(rows, least, top):
    """Every kept term against every source, without sketch or closed forms."""
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for lang, source, text in rows]
    df, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, w in rows:
        df[lang].update(set(w))
        count[lang, source].update(w)
        count[lang, None].update(w)
    out = []
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= least]
        share = {}
        for at in [x for x in count if x[0] == lang]:
            total = sum(count[at][t] for t in kept)
            share[at[1]] = {t: 1 + 10**9 * (count[at][t] + 5) // (total + 5 * len(kept)) for t in kept}
        sources = [s for s in share if s is not None]
        for s in sources:
            pair = [(other, sum(abs(share[s][t] - share[other][t]) for t in kept)) for other in sources if other != s]
            term = [(t, share[s][t] - share[None][t]) for t in kept if count[lang, s][t] and share[s][t] > share[None][t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def texts(n):
    rng = random.Random(5)
    words = ["Alpha", "beta", "o'clock", "naïve", "ÉTÉ", "x1y", "東京", "the", "THE", "of"] + [f"w{chr(97 + k)}{chr(97 + k % 7)}" for k in range(26)]
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else f"s{i % 7}"
        own = words[: 12 + (i % 7) * 3] + ["the"] * 5
        rows.append((("en", "de", None)[i % 3 if i % 2 else 0], source, " ".join(rng.choice(own) for _ in range(rng.randint(0, 30)))))
    rows += [("en", None, None), ("en", "", ""), ("fr", "only", "un deux"), ("fr", "two", "1 2 3"), (None, "none", "the " * 20000), ("en", "hot", "\x00 , . 123")]
    return rows + rows[:20]


@pytest.mark.parametrize("width,least", [(1 << 12, 8), (1 << 12, 30), (1 << 20, 300)])
def test_divergence_equals_the_plain_sums(spark, width, least):
    rows = texts(300)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, count int").repartition(5)
    got = sorted(tuple(r) for r in divergence.divergence(docs, least=least, top=6, width=width).collect())
    want = plain(rows, least, 6)
    assert got == want
    assert {"pair"} <= {r[2] for r in want}


def test_sketch_never_underestimates_and_discards(spark):
    rows = [("en", "a", " ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(k, 400))) for k in range(0, 400, 10)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    counted = divergence.term_counts(docs).cache()
    exact = {r["term"]: r["n"] for r in counted.where("term <> ''").groupBy("term").agg({"docs": "sum"}).withColumnRenamed("sum(docs)", "n").collect()}
    sketch = divergence.merged_sketch(counted, 12, width=1 << 12)
    hashed = {r["term"]: r["h"] for r in counted.where("term <> ''").selectExpr("term", "xxhash64(lang, term) h").collect()}
    names = list(exact)
    estimate = sketch[divergence.cells(np.array([hashed[t] for t in names]), divergence.DEPTH, 1 << 12)].min(axis=0)
    assert all(e >= min(exact[t], 12) for t, e in zip(names, estimate, strict=True))
    left = {r["term"] for r in divergence.possible_terms(counted, 12, width=1 << 12).select("term").collect()}
    assert {t for t, n in exact.items() if n >= 12} <= left and len(left) < len(exact)
    # a sketch that is full lets everything pass: the exact counts decide
    assert {r["term"] for r in divergence.possible_terms(counted, 12, depth=1, width=1).select("term").collect()} == set(exact)


def test_divergence_of_no_rows(spark):
    assert divergence.divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(divergence.SQL).fetchall())
    assert sorted(tuple(r) for r in divergence.op11_source_divergence(spark, SF).select("lang", "source", "part", "item", "value", "rank").collect()) == want
