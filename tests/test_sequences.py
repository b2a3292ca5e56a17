import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tracewarden.operators import metrics, models, sequences


def test_sequences_and_masks(spark):
    df = spark.createDataFrame([("a", 2, [2.0, 0.0], 1), ("a", 1, [1.0, 0.0], 0)], "trajectory_id string, step_index int, v array<double>, label int")
    r = sequences.run_sequences(df, "v").select("*", sequences.padded(F.col("vectors"), 3, 2).alias("p"), sequences.mask(F.col("vectors"), 3).alias("m")).first()
    assert r["vectors"] == [[1.0, 0.0], [2.0, 0.0]] and r["labels"] == [0, 1] and r["p"][2] == [0.0, 0.0] and r["m"] == [True, True, False]


def test_side_split_and_routes(spark):
    df = spark.createDataFrame([(["a=1", "b=2"], [[[1.0, 1.0], [3.0, 1.0]], [], [[4.0, 0.0]]])], "t array<string>, c array<array<array<double>>>")
    kept, side = sequences.side_split(F.col("t"), ("b=",))
    r = df.select(kept.alias("k"), side.alias("s"), sequences.route_mean(F.col("c")).alias("v")).first()
    assert (r["k"], r["s"], r["v"]) == (["a=1"], ["b=2"], [3.0, 0.5])
    v = spark.createDataFrame([([1.0, 2.0], [3.0])], "x array<double>, y array<double>")
    assert v.select(sequences.hybrid(["x", "y"], np.array([[1.0, 1.0, 2.0]]), np.array([0.5])).alias("h")).first()["h"] == [9.5]


def test_network_learns_and_round_trips(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    rows = [(f"t{i}", a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "trajectory_id string, v array<double>, label int")
    m = sequences.Mlp.fit(*sequences.bounded_sample(df, "v"), hidden=16, epochs=300)
    scored = m.transform(df, "v")
    area = metrics.ranking_metrics(scored)
    assert area.first()["auroc"] > 0.95
    sequences.write_baseline(str(tmp_path / "b"), m, scored.select("trajectory_id", "score"), area, spark)
    assert np.allclose(sequences.read_baseline(spark, str(tmp_path / "b")).scores(x), m.scores(x))


def test_logistic_baseline(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    df = spark.createDataFrame([(Vectors.dense(a), int(a[0] > 0.3)) for a in x], ["features", "label"])
    _, c, ap = models.logistic_baseline(df, df)
    assert c in (0.1, 1.0, 10.0) and ap > 0.95


def test_losses(spark):
    logits, q = np.array([[1.0, 2.0], [0.0, 0.0]]), np.array([[0.0, 1.0], [0.5, 0.5]])
    assert models.soft_cross_entropy(logits, q) == pytest.approx((np.log1p(np.exp(-1.0)) + np.log(2)) / 2)
    assert models.contrastive_loss(np.eye(3), ["a", "b", "c"]) == 0.0
    tight = models.contrastive_loss(np.array([[1.0, 0], [1, 0.01], [0, 1], [0.01, 1]]), ["a", "a", "b", "b"])
    mixed = models.contrastive_loss(np.array([[1.0, 0], [0, 1.0], [1, 0.01], [0.01, 1]]), ["a", "a", "b", "b"])
    assert tight < mixed
    assert models.annealed(1.0, 0.25, 1, 4) == 1.0 and models.annealed(1.0, 0.25, 4, 4) == 0.25 and models.annealed(1.0, 0.25, 1, 1) == 0.25
    assert models.annealed(1.0, 0.0, 2, 3, "cosine") == pytest.approx(0.5)
    assert models.model_type(" Coupled ") == "soft-fsm"
    with pytest.raises(ValueError):
        models.model_type("other")
    one = spark.createDataFrame([([1.0, 0.0],), ([0.0, 1.0],)], "probs array<double>")
    assert models.compactness_loss(one, 2).first()["loss"] == pytest.approx(-np.log(2), abs=1e-5)
