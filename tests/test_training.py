import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden import __main__ as cli
from tracewarden.operators import features, metrics, recurrent, symbols
from tracewarden.plans import pipelines, training
from tracewarden.sources import canonical


@pytest.mark.parametrize("loss", [recurrent.risk_loss, recurrent.next_symbol_loss])
def test_gradients_match_differences(loss):
    rng = np.random.default_rng(0)
    x = rng.dirichlet(np.ones(3), 5)
    y = np.array([0.0, 0, 1, 0, 1])
    p = recurrent.fresh(3, 4, 1 if loss is recurrent.risk_loss else 3)
    _, g = loss(p, x, y)
    for name, value in p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            moved = []
            for d in (1e-5, -1e-5):
                q = {k: v.copy() for k, v in p.items()}
                q[name][at] += d
                moved.append(loss(q, x, y)[0])
            assert g[name][at] == pytest.approx((moved[0] - moved[1]) / 2e-5, abs=1e-6)


def test_recurrent_models_learn(spark):
    rng = np.random.default_rng(1)
    runs = []
    for i in range(40):
        kind = i % 2
        a = [(k + 1) % 3 if kind else k % 3 for k in range(8)]
        if kind:
            a[3] = 0
        runs.append((np.eye(3)[a], np.array([float(kind and k >= 3) for k in range(8)])))
    p, losses = recurrent.train(recurrent.fresh(3, 8, 1), lambda: iter(runs), epochs=15)
    assert losses[-1] < losses[0] / 2
    rows = [(f"r{i}", k + 1, x[k].tolist(), int(y[k])) for i, (x, y) in enumerate(runs) for k in range(8)]
    steps = spark.createDataFrame(rows, "trajectory_id string, step_index int, probs array<double>, label int")
    scored = recurrent.risk_scores(steps, p).join(steps, ["trajectory_id", "step_index"])
    assert metrics.ranking_metrics(scored).first()["auroc"] > 0.9
    q, losses = recurrent.train(recurrent.fresh(3, 8, 3), lambda: iter(runs), recurrent.next_symbol_loss, epochs=15)
    assert losses[-1] < losses[0] / 2 and recurrent.next_symbol_loss(q, runs[0][0][:1])[0] == 0.0
    odd = recurrent.surprise(steps, q).groupBy("step_index").agg(F.avg("score").alias("s")).orderBy("step_index").collect()
    assert odd[0]["s"] == 0.0 and max(odd, key=lambda r: r["s"])["step_index"] in (2, 4)
    assert rng is not None


def test_gumbel_samples_follow_the_law(spark):
    rows = [(i, [0.0, 1.0, 2.0]) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, logits array<double>")
    hard = symbols.gumbel_softmax(df, ["id"], hard=True).select(F.posexplode("sample").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("v")).orderBy("k").collect()
    p = np.exp([0.0, 1, 2]) / np.exp([0.0, 1, 2]).sum()
    assert np.allclose([r["v"] for r in hard], p, atol=0.03)
    soft = symbols.gumbel_softmax(df.limit(5), ["id"], temperature=0.7).select(F.aggregate("sample", F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in soft)


@pytest.mark.parametrize("few", [100_000, 0])
def test_metric_sweeps_equal_a_plain_sort(spark, monkeypatch, few):
    """Distinct scores as many as rows, null keys, ties and one class; in one window and in ranges."""
    monkeypatch.setattr(metrics, "FEW", few)
    rng = np.random.default_rng(3)
    rows = [(("a", None)[i % 2], float(s), int(rng.random() < s)) for i, s in enumerate(rng.random(3000).round(3))] + [("one", 0.5, 0)] * 3
    df = spark.createDataFrame(rows, "k string, score double, label int")
    got = {r["k"]: r for r in metrics.ranking_metrics(df, "k").collect()}
    best = {r["k"]: r for r in metrics.f1_threshold(df, "k").collect()}
    for k in ("a", None, "one"):
        s, y = (np.array(v) for v in zip(*((a, b) for c, a, b in rows if c == k), strict=True))
        p, q = s[y == 1], s[y == 0]
        area = ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q)) if len(p) and len(q) else 0.5
        assert got[k]["auroc"] == pytest.approx(area)
        f1 = {t: 2 * y[s >= t].sum() / max((s >= t).sum() + y.sum(), 1) for t in np.unique(s)}
        assert best[k]["f1"] == pytest.approx(max(f1.values())) and f1[best[k]["threshold"]] == pytest.approx(max(f1.values()))
    whole = metrics.ranking_metrics(df).first()
    assert whole["n"] == len(rows)
    assert metrics.ranking_metrics(df.limit(0), "k").count() == 0


def test_vocabulary_and_numbers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "red blue red"), (2, "blue green")], "id long, text string")
    v = features.tfidf_vocabulary(features.term_counts(df, "id"), 2)
    features.write_vocabulary(v, str(tmp_path / "v"), grams=(1, 2), scale=0.5)
    again, parameters = features.read_vocabulary(spark, str(tmp_path / "v"))
    assert parameters == {"grams": (1, 2), "scale": 0.5}
    key = lambda f: sorted((r["id"], r["term"], round(r["value"], 9)) for r in f.collect())
    assert key(features.transform(df, again, "id")) == key(features.tfidf(features.term_counts(df, "id"), v, "id"))
    names = spark.createDataFrame([(f"t{i % 50:02}",) for i in range(200)], "token string").repartition(5)
    assert sorted((r["column"], r["token"]) for r in features.numbered(names).collect()) == [(i, f"t{i:02}") for i in range(50)]


def test_flat_summaries(spark):
    df = spark.range(1).select(F.struct(F.lit(1).alias("b"), F.struct(F.lit(2).alias("d")).alias("c")).alias("a"), F.lit(3).alias("e"))
    assert metrics.flat_summary(df).first().asDict() == {"a_b": 1, "a_c_d": 2, "e": 3}


def test_summaries_are_never_cut(spark, monkeypatch):
    monkeypatch.setattr(canonical, "SUMMARY_ROWS", 3)
    assert len(json.loads(canonical.summary_json(spark.range(3)))) == 3
    with pytest.raises(ValueError, match="no summary"):
        canonical.summary_json(spark.range(4))


def test_commands(spark, tmp_path, capsys):
    out = cli.sanity(spark, str(tmp_path))
    assert out["soft"]["n"] > 0 and 0 <= out["soft"]["auroc"] <= 1 and out["discrete"]["state_count"] >= 1
    cli.main(["inspect", f"{tmp_path}/runs"])
    assert json.loads(capsys.readouterr().out)["splits"]
    cli.main(["split", f"{tmp_path}/runs", f"{tmp_path}/split", "--mode", "fit-cal"])
    assert {r["split"] for r in json.loads(capsys.readouterr().out)} <= {"fit", "cal"}
    assert canonical.read_runs(spark, f"{tmp_path}/split").count() == 24
    cli.main(["evaluate", f"{tmp_path}/checkpoint", f"{tmp_path}/runs", "--split", "cal"])
    assert json.loads(capsys.readouterr().out)["split"] == "cal"
    (tmp_path / "expected.json").write_text(json.dumps([{"path": "config.json", "rows": 1}]))
    config = {"runs": [{"id": "a", "family": "tau2", "seeds": [1, 2], "output_template": "o/{seed}", "train_args": ["--x"]}]}
    (tmp_path / "config.json").write_text(json.dumps(config))
    cli.main(["reproduce", str(tmp_path / "config.json"), "--families", "tau2"])
    plan = json.loads(capsys.readouterr().out)
    assert len(plan) == 4 and plan[0]["paths"]["train"].endswith("experiments/a/seed1/train")
    cli.main(["verify", str(tmp_path / "expected.json"), str(tmp_path / "config.json")])
    assert json.loads(capsys.readouterr().out)["ok"]
    (tmp_path / "results.json").write_text("\n".join(json.dumps({"run": "a", "seed": s, "soft": {"auroc": 0.5 + s / 10, "auprc": 0.5, "ece": 0.1, "latency": 1.0}}) for s in (1, 2)))
    cli.main(["summarize", str(tmp_path / "results.json"), str(tmp_path / "csv")])
    row = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert row["seeds"] == "2" and float(row["auroc_mean"]) == pytest.approx(0.65)


def test_prepare_terminal_runs(spark, tmp_path):
    steps = json.dumps([{"src": "user", "msg": "do", "tools": None, "obs": None}, {"src": "agent", "msg": "done", "tools": None, "obs": "ok"}])
    rows = [(f"task{i % 2}", f"trial{i}", "", "a", "m", i % 2, steps) for i in range(10)]
    spark.createDataFrame(rows, "task_name string, trial_name string, trial_id string, agent string, model string, reward int, steps string").write.parquet(f"{tmp_path}/raw/data")
    out = cli.prepare(spark, "terminalbench", f"{tmp_path}/raw", f"{tmp_path}/out")
    assert out["runs"] == 10 and out["missing_steps"] == 0 and set(out["splits"]) == {"fit", "cal", "val", "test"}


def test_analysis_has_all_views(spark):
    assigned = spark.createDataFrame([("r", 1, "open the page", 0, 0.9, 0.5), ("r", 2, "page error", 1, 0.8, 0.4)], "trajectory_id string, step_index int, text string, symbol int, confidence double, margin double")
    scored = spark.createDataFrame([("r", 1, 2, 0, 0, 0, 0.2, 5), ("r", 2, 2, 1, 1, 1, 0.9, 5)], "trajectory_id string, step_index int, n_steps int, symbol int, state int, label int, score double, support long")
    views = pipelines.analyze_monitor(assigned, scored, 3)
    assert set(views) == {"symbols", "examples", "phrases", "exemplars", "first_warnings", "reliability"}
    assert views["symbols"].count() == 3 and views["first_warnings"].first()["step_index"] == 2
    assert training.LIMIT > 0
