import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden.operators import automata, merging, models
from tracewarden.plans import pipelines

POSITIVE, NEGATIVE = [[0, 1], [0, 1, 1]], [[1], [1, 0]]
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("backend", list(automata.METHODS))
def test_learners_keep_their_traces(backend):
    dfa = automata.learn_with(backend, POSITIVE, NEGATIVE, 3)
    assert all(dfa.accepts(t) for t in POSITIVE) and not any(dfa.accepts(t) for t in NEGATIVE)
    assert len(dfa.delta) >= 2 and all(len(row) == 3 for row in dfa.delta)


@pytest.mark.parametrize("backend", list(automata.METHODS))
def test_learners_on_random_traces(backend):
    rng = random.Random(3)
    for _ in range(15):
        traces = {tuple(rng.randint(0, 2) for _ in range(rng.randint(1, 6))) for _ in range(30)}
        positive = [list(t) for t in traces if sum(t) % 3 == 0]
        negative = [list(t) for t in traces if sum(t) % 3]
        if positive and negative:
            dfa = automata.learn_with(backend, positive, negative, 3)
            assert all(dfa.accepts(t) for t in positive) and not any(dfa.accepts(t) for t in negative)


def test_one_sided_traces_raise():
    with pytest.raises(ValueError, match="no trace is left"):
        automata.learn([[0]], [], 2)
    with pytest.raises(ValueError):
        automata.learn_with("other", POSITIVE, NEGATIVE, 3)


def test_contradictions_leave(spark):
    t = spark.createDataFrame([([0, 1], True), ([0, 1], False), ([1], False), ([2], True)], "symbols array<int>, positive boolean")
    assert sorted((r["symbols"], r["positive"]) for r in automata.consistent_traces(t).collect()) == [([1], False), ([2], True)]
    c = automata.trace_counters(t).first()
    assert (c["ambiguous"], c["kept_positive"], c["kept_negative"]) == (1, 1, 1)


def test_replay_is_a_fold(spark):
    dfa = automata.learn(POSITIVE, NEGATIVE, 3)
    rng = random.Random(1)
    rows = [([rng.randint(0, 2) for _ in range(rng.randint(0, 9))],) for _ in range(30)]
    for r in spark.createDataFrame(rows, "s array<int>").select("s", automata.replay(F.col("s"), dfa).alias("r")).collect():
        assert r["r"] == [dfa.state_after(r["s"][: i + 1]) for i in range(len(r["s"]))]


def steps(spark, runs):
    rows = [(t, i + 1, len(s), a, ok) for t, s, ok in runs for i, a in enumerate(s)]
    return spark.createDataFrame(rows, "trajectory_id string, step_index int, n_steps int, symbol int, final_success boolean")


def test_separable_monitor(spark):
    s = steps(spark, [("a", [0, 0], True), ("b", [1, 1], False)])
    m = pipelines.evaluate_monitor(s, s, s, 2, horizon=1, min_support=1)["metrics"]
    assert m["trusted_auroc"] == 1.0 and m["trusted_auprc"] == 1.0 and m["abstention"] == 0.0
    assert m["alert_lead_time"] == 0.5 and m["latency"] == 0.5
    few = pipelines.evaluate_monitor(s, s, s, 2, horizon=1, min_support=10)["metrics"]
    assert few["abstention"] == 1.0 and few["trusted_auroc"] == 0.5 and few["trusted_auprc"] == 0.0 and few["alert_lead_time"] == 0.0


def test_calibration_counts_come_from_the_calibration_runs(spark):
    s = steps(spark, [("a", [0, 0], True), ("b", [1, 1], False)])
    cal = steps(spark, [("c", [0, 0], True)])
    m = pipelines.evaluate_monitor(s, cal, s, 2, horizon=1, min_support=1)["metrics"]
    assert (m["calibration_prefixes"], m["calibration_positive_rate"], m["prefixes"]) == (2, 0.0, 4)


def test_soft_states_stay_on_the_simplex():
    m = models.SoftFsm.fixed(4, 3)
    p = np.array([[0.7, 0.2, 0.1], [0.1, 0.8, 0.1], [0.2, 0.2, 0.6]])
    s = m.states(p)
    assert np.allclose(s.sum(axis=1), 1, atol=1e-5) and (s >= 0).all()
    held = m.states(p, np.array([True, False, True]))
    assert np.allclose(held[0], held[1])


def test_soft_scores_match_the_loop(spark):
    m = models.SoftFsm.fixed(3, 2)
    rows = [(t, i, [0.1 * i, 1 - 0.1 * i]) for t in (1, 2) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "trajectory_id int, step_index int, probs array<double>")
    got = {(r["trajectory_id"], r["step_index"]): r["score"] for r in models.soft_fsm_scores(df, m).collect()}
    want = m.scores(np.array([r[2] for r in rows[:4]]))
    assert [got[1, i] for i in range(1, 5)] == pytest.approx(want.tolist())


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    m = models.SoftFsm(rng.normal(size=(2, 3, 3)), rng.normal(size=3), rng.normal(size=3), 0.1, 0.7)
    p, y = rng.dirichlet([1, 1], 4), np.array([0.0, 1.0, 0.0, 1.0])
    _, g = models._fsm_gradient(m, p, y)
    for name in ("logits", "start", "w"):
        x = getattr(m, name)
        at = tuple(0 for _ in x.shape)
        old = x[at]
        x[at] = old + 1e-6
        up = models._fsm_gradient(m, p, y)[0]
        x[at] = old - 1e-6
        down = models._fsm_gradient(m, p, y)[0]
        x[at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-7)


def test_training_lowers_the_loss():
    runs = [(np.eye(2)[[0, 0, 0]], np.zeros(3)), (np.eye(2)[[1, 1, 1]], np.ones(3))] * 4
    t = models.train_soft_fsm(lambda: iter(runs), 3, 2, epochs=20)
    assert t.history[-1]["loss"] < 0.5 * t.history[0]["loss"]


def test_heads_do_not_look_ahead():
    rng = np.random.default_rng(1)
    d, k = 4, 3
    gru = models.gru_head({"proj": rng.normal(size=(d, k)), "proj_b": rng.normal(size=d), "w_ih": rng.normal(size=(12, d)), "w_hh": rng.normal(size=(12, 4)), "b_ih": rng.normal(size=12), "b_hh": rng.normal(size=12), "w": rng.normal(size=4), "b": 0.0})
    layer = {"ln1": (np.ones(d), np.zeros(d)), "ln2": (np.ones(d), np.zeros(d)), "qkv": rng.normal(size=(12, d)), "qkv_b": np.zeros(12), "out": rng.normal(size=(d, d)), "out_b": np.zeros(d), "up": rng.normal(size=(8, d)), "up_b": np.zeros(8), "down": rng.normal(size=(d, 8)), "down_b": np.zeros(d)}
    transformer = models.transformer_head({"proj": rng.normal(size=(d, k)), "proj_b": np.zeros(d), "layers": [layer, layer], "w": rng.normal(size=d), "b": 0.0})
    flat = models.flat_head(rng.normal(size=(5, k)), np.zeros(5), rng.normal(size=5), 0.0)
    p = rng.dirichlet([1] * k, 6)
    for head in (gru, transformer, flat):
        assert np.allclose(head(p)[:4], head(p[:4]))


@pytest.mark.parametrize("method,rejects", [("blue-fringe", False), ("rpni", True), ("edsm", True)])
def test_merging_over_rows_learns_the_same_automaton(spark, method, rejects, monkeypatch):
    rng = random.Random(len(method))
    monkeypatch.setattr(merging, "STEPS", 3)
    traces = {tuple(rng.randint(0, 2) for _ in range(rng.randint(0, 6))) for _ in range(30)}
    positive = sorted(list(t) for t in traces if sum(t) % 3 == 0 and len(t) != 4)
    negative = sorted(list(t) for t in traces if list(t) not in positive)
    df = spark.createDataFrame([(t, True) for t in positive] + [(t, False) for t in negative], "symbols array<int>, positive boolean").repartition(3)
    got = merging.learn_frame(df, 3, method, rejects)
    assert got == automata.learn(positive, negative, 3, method, rejects) and 2 < len(got.delta) < 40
    with pytest.raises(ValueError, match="no trace is left"):
        merging.learn_frame(df.where("positive"), 3, method, rejects)


def test_induction_takes_any_number_of_traces(spark, monkeypatch):
    df = spark.createDataFrame([(t, True) for t in POSITIVE] + [(t, False) for t in NEGATIVE], "symbols array<int>, positive boolean")
    at_hand = automata.induce(df, 2)
    monkeypatch.setattr(automata, "AT_HAND", 0)
    assert automata.induce(df, 2) == at_hand


def counted(spark, frame):
    """``frame`` and a counter of the rows whose symbol was computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def symbol(x):
        seen.add(1)
        return x

    return frame.withColumn("symbol", symbol(F.col("symbol").cast("int"))), seen


@pytest.mark.parametrize("method", ["rpni", "edsm"])
def test_only_blue_fringe_lists_prefixes(spark, method, monkeypatch):
    def listed(symbols):
        raise AssertionError("prefixes are listed")

    monkeypatch.setattr(merging, "_prefixes", listed)
    df = spark.createDataFrame([(t, True) for t in POSITIVE] + [(t, False) for t in NEGATIVE], "symbols array<int>, positive boolean")
    assert merging.learn_frame(df, 3, method) == automata.learn(POSITIVE, NEGATIVE, 3, method)


def test_traces_of_the_merged_states_are_made_once(spark, monkeypatch):
    from tracewarden.plans import model_queries, tables

    s = tables.steps(spark, SF)
    frame, seen = counted(spark, s)
    monkeypatch.setattr(tables, "steps", lambda spark, sf: frame)
    assert model_queries.merged_states_and_unseen_traces(spark, SF).first()["state_count"] == 3
    assert seen.value == s.count()


def test_an_evaluation_replays_its_steps_once(spark):
    s = steps(spark, [("a", [0, 0], True), ("b", [1, 1], False)])
    (cal, of_cal), (held, of_held) = counted(spark, s), counted(spark, s)
    m = pipelines.evaluate_monitor(s, cal, held, 2, horizon=1, min_support=1)["metrics"]
    assert (m["trusted_auroc"], m["calibration_prefixes"]) == (1.0, 4)
    assert 0 < of_cal.value <= 8 and 0 < of_held.value <= 8  # a replay reads them for the traces and for the join
