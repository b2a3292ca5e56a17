import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from tracewarden.llm import centroids

SF = "/root/testdata/sf0.001"


def plain(rows, k, rounds, dims):
    kept = [(i, [min(max(math.floor(256 * x), -(1 << 53)), 1 << 53) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest()))
    now = [q for _, q in order[:k]]
    far = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c, strict=True))

    def assigned():
        return [min((far(q, c), j) for j, c in enumerate(now)) for _, q in kept]

    for _ in range(rounds):
        near = assigned()
        for j in range(len(now)):
            own = [q for (_, q), (_, c) in zip(kept, near, strict=True) if c == j]
            if own:
                now[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    near = assigned()
    most = (1 << 63) - 1
    inertia = {j: sum(d for d, c in near if c == j) for j in range(len(now))}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    none = lambda r: tuple((x is None, x) for x in r)
    return sorted(((i, c, min(d, most), min(inertia[c], most), min(sum(inertia.values()), most), shas[c]) for (i, _), (d, c) in zip(kept, near, strict=True)), key=none)


def vectors(kind):
    rng = random.Random(11)
    middle = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [rng.gauss(m, 0.3) for m in middle[i % 6 if i % 3 else 0]]) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(None, rows[1][1]), (7, rows[2][1]), (7, rows[2][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 63 + [None]), (2004, [float("nan")] * 64), (2005, [float("inf")] + [0.0] * 63), ((1 << 60) + 1, [0.0] * 64)]
    if kind == "wide":
        rows += [(3000, [1e6] * 64), (3001, [1e6] * 63 + [-1e6]), (3002, [3e38] * 64), (3003, [-500.25] * 64)]
    return rows


@pytest.mark.parametrize("kind", ["usual", "wide"])
def test_clusters_equal_the_plain_rounds(spark, kind):
    rows = vectors(kind)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, q int").repartition(4)
    got = [tuple(r) for r in centroids.clusters(df, k=12, rounds=3).collect()]
    none = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=none) == plain(rows, 12, 3, 64)


def test_screening_keeps_winners_and_ties():
    rng = np.random.default_rng(3)
    q = rng.integers(-90, 90, (500, 64))
    c = np.concatenate([q[:20], q[:20], rng.integers(-90, 90, (10, 64))])  # each of the first twenty twice: ties
    who, d, measured = centroids.nearest(q, centroids.segment_norms(q).astype("<f4").astype(float), c, centroids.segment_norms(c))
    exact = ((q[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert (who == exact.argmin(axis=1)).all() and (d == exact.min(axis=1)).all()
    # vectors whose segments differ in length are told apart by their norms alone
    scale = np.repeat(rng.choice([1, 12], (50, 16)), 4, axis=1)
    c = rng.integers(-9, 9, (50, 64)) * scale
    q = c[rng.integers(0, 50, 500)] + rng.integers(-2, 3, (500, 64))
    _, _, measured = centroids.nearest(q, centroids.segment_norms(q), c, centroids.segment_norms(c))
    assert measured < 500 * 10


def test_clusters_of_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64)], "vec_id long, embedding array<float>")
    assert sorted(r["distance"] for r in centroids.clusters(df).collect()) == [0, 0]
    for none in (df.limit(0), df.selectExpr("vec_id", "slice(embedding, 1, 3) AS embedding")):
        assert centroids.clusters(none).count() == 0


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.execute(centroids.SQL).fetchall())
    assert sorted(tuple(r) for r in centroids.op12_centroid_clustering(spark, SF).collect()) == want
