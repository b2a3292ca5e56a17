"""The vocabulary by sketched candidates against counts of all terms."""

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import features


def zipf(spark, n=400, words=3000):
    """Texts whose words fall off like a power of their rank."""
    drawn = (F.concat(F.lit("w"), F.floor(F.lit(words) * F.pow(F.rand(seed), 4)).cast("string")) for seed in range(60))
    return spark.range(n, numPartitions=6).select(F.col("id"), F.array_join(F.array(*drawn), " ").alias("text"))


def vocabulary(counts, k):
    return [tuple(r) for r in features.tfidf_vocabulary(counts, 400, k).select("term", "cf", "df").collect()]


@pytest.fixture()
def sketches(monkeypatch):
    """Sizes of the sketches that were taken."""
    taken, take = [], features.frequent_hashes

    def noted(hashes, tracked, listed=features.LISTED):
        taken.append(tracked)
        return take(hashes, tracked, listed)

    monkeypatch.setattr(features, "frequent_hashes", noted)
    return taken


def test_candidates_hold_the_leading_terms(spark, sketches):
    rows = zipf(spark).cache()
    counts = features.leading_counts(rows, "id", max_features=50, tracked=(2048,))
    everything = features.term_counts(rows, "id")
    assert sketches == [2048] and counts.select("term").distinct().count() < everything.select("term").distinct().count()
    assert vocabulary(counts, 50) == vocabulary(everything, 50)


def test_a_sketch_that_proves_nothing_is_followed_by_larger_ones_and_by_counting(spark, sketches):
    rows = zipf(spark).cache()
    everything = features.term_counts(rows, "id")
    for tracked, k in (((16, 64, 1_000_000), 300), ((16, 64), 300)):
        sketches.clear()
        counts = features.leading_counts(rows, "id", max_features=k, tracked=tracked)
        assert sketches == list(tracked)
        assert vocabulary(counts, k) == vocabulary(everything, k)


def test_ties_at_the_boundary_and_few_terms(spark, sketches):
    tied = spark.createDataFrame([(i, f"aa{i:04d} bb{i:04d} common") for i in range(300)], "id long, text string").cache()
    for k in (1, 7, 5000):
        counts = features.leading_counts(tied, "id", max_features=k, tracked=(128, 100_000))
        assert vocabulary(counts, k) == vocabulary(features.term_counts(tied, "id"), k)


def test_no_rows_null_texts_and_repeated_keys(spark):
    for rows in ([], [(1, None)], [(1, ""), (None, "one two two"), (1, "two one"), (1, "one")]):
        df = spark.createDataFrame(rows, "id long, text string")
        assert vocabulary(features.leading_counts(df, "id", max_features=3), 3) == vocabulary(features.term_counts(df, "id"), 3)


def test_an_estimate_bounds_what_is_not_listed(spark):
    rows = zipf(spark).cache()
    places = features.places(rows, ["id"]).select(F.xxhash64("term").alias("h"))
    true = {r["h"]: r["n"] for r in places.groupBy("h").agg(F.count("*").alias("n")).collect()}
    for tracked in (64, 1000, 20_000):
        hashes, rest, n = features.frequent_hashes(places, tracked, 200)
        listed = {r["h"] for r in hashes.collect()}
        assert n == sum(true.values()) and max(c for h, c in true.items() if h not in listed) <= rest


def test_words_are_runs_of_word_characters(spark):
    chars = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(f"a{x} {x}{x}b {x} c{x}d{x}",) for x in chars], "text string")
    old = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    assert df.where(features.word_tokens(F.col("text")) != old).isEmpty()


def test_only_known_terms_are_counted(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "cc bb"), (3, "dd"), (4, None)], "id long, text string")
    known = spark.createDataFrame([("aa", 1.0), ("aa bb", 2.0), ("bb", 1.5)], "term string, idf double")
    out = features.transform(df, known, "id")
    assert {(r["id"], r["term"]): r["value"] for r in out.collect()} == {(r["id"], r["term"]): r["value"] for r in features.tfidf(features.term_counts(df, "id"), known, "id").collect()}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") > plan.index("Aggregate")  # below it


def test_units_are_made_once(spark):
    from tracewarden.plans import catalogue

    plan = catalogue.QUERIES["log_block_segments"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
