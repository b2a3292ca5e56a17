import pytest
from pyspark.sql import functions as F

from tracewarden.operators import cleaning, features, prefixes, splits, symbols


def runs(spark):
    rows = [("a", False, "SEARCH_MISS", ["x", "y", "z"]), ("b", True, "NONE", ["x", "y", "z"])]
    return spark.createDataFrame(rows, "trajectory_id string, final_success boolean, failure_bucket string, steps array<string>")


@pytest.mark.parametrize("horizon,positive", [(2, 3), (1, 2), (0, 1)])
def test_labels(spark, horizon, positive):
    p = prefixes.expand_nested(runs(spark), horizon)
    assert p.agg(F.sum("label")).first()[0] == positive and p.count() == 6
    assert p.where("prefix_index = 2").select("prefix_steps").first()[0] == ["x", "y"]


def test_explicit_labels_are_checked(spark):
    p = prefixes.expand_nested(runs(spark), 1).withColumns({"explicit_labels": F.array(F.lit(1)), "prefix_mask": F.lit(None).cast("array<boolean>")})
    with pytest.raises(Exception, match="explicit labels"):
        prefixes.overridden_labels(p).collect()
    off = prefixes.expand_nested(runs(spark), 1).withColumns({"explicit_labels": F.lit(None).cast("array<int>"), "prefix_mask": F.array(*(F.lit(False),) * 3)})
    with pytest.raises(Exception, match="mask"):
        prefixes.overridden_labels(off).collect()


def test_signatures_and_bins(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 4, 7, 8, 15, 16)], "x int").select(prefixes.remaining_bin(F.col("x"))).collect()]
    assert got == ["0", "1", "2-3", "2-3", "4-7", "4-7", "8-15", "8-15", "16+"]


def test_no_look_ahead(spark):
    rows = [("a", i, 3, w) for i, w in enumerate(["x", "y", "z"], 1)]
    df = spark.createDataFrame(rows, "trajectory_id string, step_index int, n_steps int, text string")
    changed = df.withColumn("text", F.when(F.col("step_index") == 3, "other").otherwise(F.col("text")))
    doc = lambda d: {r["step_index"]: r["document"] for r in prefixes.prefix_documents(d).collect()}
    assert doc(df)[2] == doc(changed)[2] == "x\n<STEP_BOUNDARY>\ny"


def test_known_bucket(spark):
    from tracewarden.functions.hashing import task_bucket

    assert spark.range(1).select(task_bucket(F.lit("toy-search"), 1)).first()[0] == 0.6768907500987975


def test_splits(spark):
    df = spark.range(400).select(F.col("id").alias("trajectory_id"), (F.col("id") % 7).alias("task_id"))
    s = splits.stratified_split(df)
    per = {(r["task_id"], r["protocol_split"]): r["count"] for r in s.groupBy("task_id", "protocol_split").count().collect()}
    assert all((t, n) in per for t in range(7) for n in ("fit", "cal", "val", "test"))
    with pytest.raises(Exception, match="too few runs"):
        splits.stratified_split(df.limit(3)).collect()
    with pytest.raises(ValueError):
        splits.fit_cal_split(df, fit_ratio=0.5, cal_ratio=0.4)
    tasks = splits.outer_split(df).groupBy("task_id").agg(F.countDistinct("protocol_split").alias("n"))
    assert tasks.where("n > 1").isEmpty()
    with pytest.raises(ValueError, match="no run in split"):
        splits.select_split(df.withColumn("split", F.lit("train")), "val")


def test_sticky_hardening(spark):
    probs = [[0.9, 0.1], [0.45, 0.55], [0.1, 0.9], [0.52, 0.48]]
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate(probs, 1)], "trajectory_id string, step_index int, probs array<double>")
    hard = lambda s, t: [r["hard_symbol"] for r in symbols.harden(df, s, t).orderBy("step_index").collect()]
    assert hard("argmax", None) == [0, 1, 1, 0]
    assert hard("sticky-margin", 0.5) == [0, 0, 1, 1]
    assert hard("sticky-confidence", 0.95) == [0, 0, 0, 0]
    with pytest.raises(ValueError):
        symbols.harden(df, "sticky-margin")
    s = symbols.hardening_summary(symbols.harden(df, "sticky-margin", 0.5)).first()
    assert (s["override_count"], s["switch_count"], s["switch_rate"]) == (2, 1, 1 / 3)


def test_prefix_vectors_have_length_one(spark):
    t = spark.createDataFrame([("a", 1, "u", 1.0), ("a", 3, "v", 2.0)], "trajectory_id string, step_index int, term string, value double")
    got = features.prefix_sums(t, spark.createDataFrame([("a", 4)], "trajectory_id string, n_steps int"))
    norms = {r[0]: r[1] for r in got.groupBy("prefix_index").agg(F.round(F.sum(F.col("value") * F.col("value")), 9)).collect()}
    assert norms == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0}


def test_cleaning(spark):
    rows = [("a", "the verifier will look at /logs/verifier/x  y\n\n\n\nz"), ("b", "keep   blanks"), ("c", "reward = 1.0")]
    df = spark.createDataFrame(rows, "trajectory_id string, context string")
    got = {r["trajectory_id"]: r for r in cleaning.clean_steps(df, ["context"]).collect()}
    assert got["a"]["context"] == "[redacted_instruction]\n\nz" and got["a"]["affected_fields"] == 1
    assert got["b"]["context"] == "keep   blanks" and got["c"]["needs_drop"]
    assert [r[0] for r in cleaning.clean_runs(df, fields=["context"]).select("trajectory_id").orderBy("trajectory_id").collect()] == ["a", "b"]
    counts = df.select(cleaning.rewrite_counts(F.col("context"))).collect()
    assert counts[0][0] == {"evaluator_protocol": 1}
    with pytest.raises(Exception, match="label field"):
        cleaning.assert_no_leakage(spark.createDataFrame([("x\n Split = 3",)], "t string"), "t").collect()
