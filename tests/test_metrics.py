import random

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import metrics


def frame(spark, rows):
    return spark.createDataFrame([(float(s), int(y)) for s, y in rows], "score double, label int")


def brute_threshold(rows):
    best = (-1.0, 0.0)
    for t in sorted({s for s, _ in rows}):
        tp = sum(y for s, y in rows if s >= t)
        alerts, pos = sum(1 for s, _ in rows if s >= t), sum(y for _, y in rows)
        p, r = tp / max(alerts, 1), tp / max(pos, 1)
        f1 = 0.0 if p + r == 0 else 2 * p * r / (p + r)
        if f1 > best[0]:
            best = (f1, t)
    return best[1]


def brute_auroc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    if not pos or not neg:
        return 0.5
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def brute_ap(rows):
    pos, total, last = sum(y for _, y in rows), 0.0, 0.0
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp, n = sum(y for s, y in rows if s >= t), sum(1 for s, _ in rows if s >= t)
        r = tp / pos if pos else 0.0
        total, last = total + (r - last) * tp / n, r
    return total


def test_sweeps_match_brute_force(spark):
    rng = random.Random(0)
    sets = [[(round(rng.random(), 1), rng.randint(0, 1)) for _ in range(rng.randint(1, 40))] for _ in range(40)]
    sets += [[(0.5, 1)], [(0.5, 0)], [(0.3, 1)] * 4, [(0.1, 0), (0.2, 0)], [(0.0, 1), (1.0, 0)]]
    df = spark.createDataFrame([(k, s, y) for k, rows in enumerate(sets) for s, y in rows], "k int, score double, label int")
    area = {r["k"]: r for r in metrics.ranking_metrics(df, "k").collect()}
    cut = {r["k"]: r for r in metrics.f1_threshold(df, "k").collect()}
    for k, rows in enumerate(sets):
        assert area[k]["auroc"] == pytest.approx(brute_auroc(rows))
        assert area[k]["auprc"] == pytest.approx(brute_ap(rows))
        assert cut[k]["threshold"] == brute_threshold(rows)


def test_calibration_edges(spark):
    edges = [0.0, 0.1, 0.3, 0.30000000000000004, 0.999, 1.0, 1.2, -0.1]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in edges], "s double").select(metrics.calibration_bin(F.col("s"))).collect()]
    assert got == [0, 1, 2, 3, 9, 9, None, None]
    with pytest.raises(ValueError):
        metrics.calibration_bin(F.col("s"), 0)
    rows = frame(spark, [(0.15, 0), (0.15, 1), (0.95, 1), (1.5, 1)])
    assert metrics.calibration_error(rows).first()["ece"] == pytest.approx((2 * 0.35 + 0.05) / 4)
    assert metrics.brier(frame(spark, [])).first()["brier"] == 0.0


def test_unvisited_states_have_the_base_rate(spark):
    states = spark.createDataFrame([(0,), (1,), (2,)], "state int")
    p = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0)], "state int, label int")
    risk = {r["state"]: r for r in metrics.state_risk(states, p, alpha=5.0).collect()}
    assert risk[2]["risk"] == pytest.approx(0.5) and risk[2]["support"] == 0
    assert risk[0]["risk"] == pytest.approx((2 + 2.5) / 7)


def test_latency(spark):
    rows = [(1, i, False, 0.9 if i >= 1 else 0.0) for i in (1, 2, 3)] + [(2, i, False, 0.9 if i == 3 else 0.0) for i in (1, 2, 3)] + [(3, 1, True, 0.0)]
    df = spark.createDataFrame(rows, "trajectory_id int, step_index int, final_success boolean, score double")
    assert metrics.detection_latency(df, 0.5).first()["latency"] == pytest.approx(2 / 3)
    assert metrics.detection_latency(df.where("final_success"), 0.5).first()["latency"] == 1.0


def test_nothing_trusted(spark):
    df = spark.createDataFrame([(0, 0.2, 1, 1), (1, 0.4, 0, 2)], "state int, score double, label int, support int")
    m = metrics.trusted_metrics(df, 10).first()
    assert (m["abstention"], m["auroc"], m["auprc"], m["trusted_prefixes"]) == (1.0, 0.5, 0.0, 0)


def test_seed_summary(spark):
    expected = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "run string, seed int")
    results = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0)], "run string, seed int, m double")
    got = {r["run"]: r for r in metrics.seed_summary(results, expected, "m").collect()}
    assert got["a"]["m_mean"] == 3.0 and got["a"]["m_std"] == pytest.approx(2**0.5)
    assert (got["b"]["finished"], got["b"]["missing"], got["b"]["m_std"]) == (0, 1, None)
