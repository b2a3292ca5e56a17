"""The pipeline on a small corpus against a plain version of each stage."""

import itertools
import math
import zlib

import corpus_pipeline
import numpy as np
import pytest

from tests.llm.test_dedup import brute_classes, brute_lines
from tests.llm.test_texts import brute_counts
from tracewarden.llm import packing, pii, quality
from tracewarden.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = dict(corpus_pipeline.STAGES)
    verdict = {r["doc_id"]: r["kept"] for r in quality.judge_ids(docs).collect()}
    a = stage[names[0]](spark, docs, SF).cache()
    assert a.columns == COLUMNS and {r[0] for r in a.select("doc_id").collect()} == {i for i, k in verdict.items() if k}
    b = stage[names[1]](spark, a, SF).cache()
    rows = sorted((r["doc_id"], r["text"]) for r in a.collect())
    assert b.columns == COLUMNS and sorted((r["doc_id"], r["text"]) for r in b.collect()) == [(i, t) for i, _, _, t in brute_lines(rows)]
    c = stage[names[2]](spark, b, SF).cache()
    rows = sorted((r["doc_id"], r["text"]) for r in b.collect())
    assert c.columns == COLUMNS and {r["doc_id"] for r in c.collect()} == {i for i, _, k in brute_classes(rows, 5, 80) if i == k}
    d = stage[names[3]](spark, c, SF).cache()
    before, after = ({r["doc_id"]: r for r in x.collect()} for x in (c, d))
    assert d.columns == COLUMNS and before.keys() == after.keys()
    import re

    clean = [i for i, r in before.items() if not re.search(r"\d", r["text"])]
    assert clean and all(after[i] == before[i] for i in clean)
    changed = [i for i in before if after[i]["text"] != before[i]["text"]]
    assert changed and all(len(after[i]["text"]) == after[i]["n_chars"] for i in changed)
    assert pii.PATTERN
    e = stage[names[4]](spark, d, SF).collect()
    encode = packing.encoder(packing.default_vocabulary())
    total = {i: len(encode(r["text"])) + 1 for i, r in after.items()}
    got = {}
    for r in e:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == total


def plain_verdicts(rows):
    """Quality verdicts of (doc_id, text, lang, source), restated without Spark and without the module's statistics."""
    floor = np.diag(np.square(quality.FLOOR))
    counts = {i: brute_counts(t) for i, t, _, _ in rows}
    passed = {i for i, c in counts.items() if c[0] >= 20 and 100 * c[4] <= 30 * c[0]}

    def point(c):
        n = c[0] + 60
        return np.round([math.log((c[1] + 300) / n), math.log(0.02 + c[2] / n), math.log(0.02 + c[3] * 10 / n), math.log(0.02 + c[4] / n)], 4)

    def ranked(x, share):
        return np.sort(x, axis=0)[max(math.ceil(share * len(x)), 1) - 1]

    def estimate(x):
        mu, spread = ranked(x, 0.5), (ranked(x, 0.75) - ranked(x, 0.25)) / 1.349
        cov = np.diag(np.square(np.maximum(spread, quality.FLOOR)))
        for _ in range(6):
            d = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)
            near = x[d <= ranked(d, 0.75) + 1e-12]
            mu, cov = near.mean(axis=0), np.cov(near.T, bias=True) * quality._consistency() + floor
        return len(x), mu, cov

    def level(*keys):
        texts = {}
        for i, t, lang, source in rows:
            if i in passed:
                texts.setdefault(tuple({"lang": lang, "source": source}[k] for k in keys), {})[t] = point(counts[i])
        return {k: estimate(np.array(list(v.values()))) for k, v in texts.items()}

    def mixed(own, wide):
        w, apart = own[0] / (own[0] + 40), own[1] - wide[1]
        return own[0], w * own[1] + (1 - w) * wide[1], w * own[2] + (1 - w) * wide[2] + w * (1 - w) * np.outer(apart, apart)

    whole, langs, groups = level()[()], level("lang"), level("lang", "source")
    kept = set()
    for i, _, lang, source in rows:
        if i in passed:
            _, mu, cov = mixed(groups[lang, source], mixed(langs[(lang,)], whole))
            x = point(counts[i]) - mu
            if x @ np.linalg.inv(cov) @ x <= quality.CUTOFF:
                kept.add(i)
    return kept


def test_run_equals_a_plain_version(spark):
    """run() against the stages restated without Spark; surrogates are taken from their own stage, as their values are free."""
    from tokenizers import Tokenizer

    out = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect())
    kept = plain_verdicts(rows)
    assert 0.8 * len(rows) < len(kept) < len(rows)
    lines = [(i, t) for i, _, _, t in brute_lines([(i, t) for i, t, _, _ in rows if i in kept])]
    first = {i for i, _, k in brute_classes(lines, 5, 80) if i == k}
    about = {r["doc_id"]: r for r in docs.collect()}
    left = spark.createDataFrame([(i, t, about[i]["lang"], about[i]["source"], about[i]["n_chars"]) for i, t in lines if i in first], docs.schema)
    masked = {r["doc_id"]: r["text"] for r in pii.stage(spark, left, SF).collect()}
    exact = Tokenizer.from_file(packing.default_vocabulary())
    want = set()
    for i, t in masked.items():
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = [0, *range((len(ids) - 1) % 2048 + 1, len(ids), 2048), len(ids)]
        want |= {(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))}
    assert {tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in out} == want and len(out) == len(want)
    used = {}
    for r in out:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in used.values():
        ends = list(itertools.accumulate(n for _, n in sorted(pieces)))
        assert [a for a, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(used) <= math.ceil(sum(r["length"] for r in out) / 2048) + 1


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    cols = sorted(a.columns)
    tidy = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert cols == sorted(b.columns) and tidy(a).equals(tidy(b))


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
