"""Text and prefix features in relational form.

A sparse matrix is rows (row key, term, value). The vocabulary is the top terms
of the corpus, so it is bounded by ``max_features`` and may be broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.plans import scratch

MAX_FEATURES = 4096
#: Hashes that a sketch of frequent terms tracks, attempt by attempt, and how many of them it lists (the built-in's limit).
TRACKED, LISTED = (100_000, 1_000_000), 10_000
#: A run of word characters; boundaries need no test, as a match begins and ends where the run does.
WORD = r"\w\w+"


def word_tokens(text: Column) -> Column:
    """Lower-cased words of two characters or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(?U){WORD}"), F.lit(0))


def grams(tokens: Column, most: int = 2) -> Column:
    """All n-grams up to ``most`` words, with repeats. ``tokens`` should be a column, as it is read for every position."""

    def of(n: int) -> Column:
        at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat_ws(" ", *(F.get(tokens, i + k - 1) for k in range(n))))

    return F.concat(tokens, *(of(n) for n in range(2, most + 1)))


def places(rows: DataFrame, keys: list[str], text: str = "text", most: int = 2, tokens: str | None = None) -> DataFrame:
    """keys, term: a row for every place of an n-gram."""
    t = rows.select(*keys, (F.col(tokens) if tokens else word_tokens(F.col(text))).alias("_tokens"))
    return t.select(*keys, F.explode(grams(F.col("_tokens"), most)).alias("term"))


def term_counts(rows: DataFrame, key: str | list[str], text: str = "text", most: int = 2, tokens: str | None = None) -> DataFrame:
    """key, term, tf."""
    keys = [key] if isinstance(key, str) else key
    return places(rows, keys, text, most, tokens).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def frequent_hashes(hashes: DataFrame, tracked: int, listed: int = LISTED) -> tuple[DataFrame, int, int]:
    """h: the most frequent of the values h; how often any other may occur at most; and the number of all rows.

    Tasks sketch 64-bit hashes, so a sketch has a bounded size whatever the terms are; sketches are merged block by
    block, then once more. An estimate is never below a count, and what is not listed has an estimate no larger than
    the least one listed: where it is tracked it comes later in the list's order, where it is not, its count is within
    the sketch's error, which every estimate contains. Terms that share a hash only add up.
    """
    spark = hashes.sparkSession
    path = scratch.folder(spark, "frequent")
    blocks = math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1
    hashed = hashes.select("h", F.pmod(F.spark_partition_id(), F.lit(blocks)).alias("_block"))
    sketch = (F.expr(f"approx_top_k_accumulate(h, {tracked})").alias("s"), F.count(F.lit(1)).alias("n"))
    empty = spark.range(0).select(F.col("id").alias("h")).agg(*sketch)  # no sketch at all cannot be merged
    whole = hashed.groupBy("_block").agg(*sketch).drop("_block").union(empty).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    whole.select("n", F.expr(f"approx_top_k_estimate(s, {min(listed, tracked)})").alias("found")).write.parquet(path)
    stored = spark.read.parquet(path)
    told = stored.select("n", F.coalesce(F.array_min(F.transform("found", lambda x: x["count"])), F.lit(0)).alias("rest")).first()
    return stored.select(F.explode("found").alias("x")).select(F.col("x.item").alias("h")), told["rest"], told["n"]


def leading_counts(rows: DataFrame, key: str | list[str], text: str = "text", max_features: int = MAX_FEATURES, most: int = 2, tracked: tuple[int, ...] = TRACKED) -> DataFrame:
    """key, term, tf of terms among which are the ``max_features`` most frequent ones, written once.

    A sketch lists candidates, and only their places are shuffled and counted. The counts prove the choice: as many terms
    as asked for occur more often than any term not listed can, or the candidates make up all places. Where the largest
    sketch proves nothing (many terms equally frequent at the boundary), all terms are counted."""
    keys = [key] if isinstance(key, str) else key
    found = places(rows, keys, text, most).withColumn("h", F.xxhash64("term"))
    spark = rows.sparkSession
    for size in tracked if max_features < LISTED else ():
        hashes, rest, n = frequent_hashes(found, size)
        path = scratch.folder(spark, "leading")
        chosen = found.join(F.broadcast(hashes), "h", "left_semi")  # at most LISTED numbers
        chosen.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf")).write.parquet(path)
        counts = spark.read.parquet(path)
        totals = counts.groupBy("term").agg(F.sum("tf").alias("cf"))
        seen = totals.agg(F.count_if(F.col("cf") > rest).alias("above"), F.coalesce(F.sum("cf"), F.lit(0)).alias("rows")).first()
        if seen["above"] >= max_features or seen["rows"] == n:
            return counts
    path = scratch.folder(spark, "counts")
    term_counts(rows, key, text, most).write.parquet(path)
    return spark.read.parquet(path)


def tfidf_vocabulary(counts: DataFrame, n_rows: int | Column, max_features: int = MAX_FEATURES) -> DataFrame:
    """term, df, idf of the most frequent terms (corpus frequency, then term)."""
    per = counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    n = F.lit(n_rows) if isinstance(n_rows, int) else n_rows
    return per.orderBy(F.desc("cf"), "term").limit(max_features).withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)


def tfidf(counts: DataFrame, vocabulary: DataFrame, key: str | list[str]) -> DataFrame:
    """key, term, value with rows of length 1; terms outside the vocabulary are dropped."""
    keys = [key] if isinstance(key, str) else key
    raw = counts.join(F.broadcast(vocabulary.select("term", "idf")), "term").withColumn("raw", F.col("tf") * F.col("idf"))  # at most max_features rows
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(*keys)))
    return raw.select(*keys, "term", (F.col("raw") / norm).alias("value"))


def fit_transform(rows: DataFrame, key: str | list[str], text: str = "text", max_features: int = MAX_FEATURES) -> tuple[DataFrame, DataFrame]:
    """The rows' vectors and the vocabulary that is fitted on them."""
    counts = leading_counts(rows, key, text, max_features)
    vocabulary = tfidf_vocabulary(counts, rows.count(), max_features)
    return tfidf(counts, vocabulary, key), vocabulary


def prefix_sums(triples: DataFrame, lengths: DataFrame, run: str = "trajectory_id") -> DataFrame:
    """Vectors of prefixes: the running sum of step vectors, scaled to length 1.

    ``triples`` (run, step_index, term, value), ``lengths`` (run, n_steps). A term's sum holds from its step up to the
    next step with the term, so intervals are made first and only then spread over prefixes.
    """
    w = W.partitionBy(run, "term").orderBy("step_index")
    t = triples.withColumns({"total": F.sum("value").over(w.rowsBetween(W.unboundedPreceding, 0)), "until": F.lead("step_index").over(w)}).join(lengths, run)
    spread = t.select(run, "term", "total", F.explode(F.sequence("step_index", F.coalesce(F.col("until") - 1, F.col("n_steps")))).alias("prefix_index"))
    norm = F.sqrt(F.sum(F.col("total") * F.col("total")).over(W.partitionBy(run, "prefix_index")))
    return spread.select(run, "prefix_index", "term", (F.col("total") / norm).alias("value"))


def pooled(steps: DataFrame, values: list[str], run: str = "trajectory_id") -> DataFrame:
    """last, mean and max (from zero) over steps 1..i of numeric columns."""
    w = W.partitionBy(run).orderBy("step_index").rowsBetween(W.unboundedPreceding, 0)
    cols = {}
    for v in values:
        cols |= {f"{v}_last": F.col(v), f"{v}_mean": F.avg(v).over(w), f"{v}_max": F.greatest(F.lit(0.0), F.max(v).over(w))}
    return steps.withColumns(cols)


def numbered(values: DataFrame, name: str = "column") -> DataFrame:
    """The distinct values of a one-column frame with their number in sorted order, counted range by range."""
    (value,) = values.columns
    spark = values.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch.folder(spark, "numbered")
    ranged = values.distinct().repartitionByRange(n, value).sortWithinPartitions(value)
    ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).write.parquet(path)
    ranged = spark.read.parquet(path)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row for each range
    inside = W.partitionBy("_part").orderBy("_at")
    return ranged.withColumn("_row", F.row_number().over(inside)).join(F.broadcast(before), "_part").select(value, (F.col("_before") + F.col("_row") - 1).alias(name))


def side_channel(rows: DataFrame, key: str, tokens: str, scale: float = 1.0) -> DataFrame:
    """Multi-hot rows (key, token, column, value): columns number the sorted distinct tokens, which may be as many as the
    data gives: they are numbered range by range and joined without a broadcast hint."""
    pairs = rows.select(key, F.explode(F.array_distinct(tokens)).alias("token"))
    return pairs.join(numbered(pairs.select("token")), "token").select(key, "token", "column", F.lit(scale).alias("value"))


def fit_sample(rows: DataFrame, key: str, text: str, budget: int, seed: int = 42, bits: int = 12) -> DataFrame:
    """Rows to fit on under a budget of characters: all of them where they fit, else floor(n * budget / characters) rows, one
    at least, drawn without replacement: those with the smallest digest of seed and key, whatever the partitions. Rows
    are counted by the first bits of their digests, so only the bucket at the boundary is put in order."""
    held = rows.withColumn("_draw", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    bucket = F.conv(F.substring("_draw", 1, -(-bits // 4)), 16, 10).cast("int")
    sizes = held.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce(text, F.lit("")))).alias("c")).collect()  # 2^bits numbers
    n, chars = sum(r["n"] for r in sizes), sum(r["c"] for r in sizes)
    if chars <= budget:
        return rows
    keep, below, at = max(1, n * budget // chars), 0, -1
    for r in sorted(sizes, key=lambda r: -1 if r["_bucket"] is None else r["_bucket"]):
        at = -1 if r["_bucket"] is None else r["_bucket"]
        if below + r["n"] >= keep:
            break
        below += r["n"]
    marked = held.withColumn("_bucket", F.coalesce(bucket, F.lit(-1)))
    edge = marked.where(F.col("_bucket") == at).withColumn("_rank", F.row_number().over(W.partitionBy("_bucket").orderBy("_draw", key))).where(F.col("_rank") <= keep - below).drop("_rank")
    return marked.where(F.col("_bucket") < at).unionByName(edge).drop("_draw", "_bucket")


def write_vocabulary(vocabulary: DataFrame, path: str, **parameters) -> None:
    """A fitted vocabulary and the parameters it was fitted with, as tables below ``path``."""
    vocabulary.write.parquet(f"{path}/terms")
    vocabulary.sparkSession.createDataFrame([(k, repr(v)) for k, v in sorted(parameters.items())], "name string, value string").coalesce(1).write.parquet(f"{path}/parameters")


def read_vocabulary(spark, path: str) -> tuple[DataFrame, dict]:
    """What ``write_vocabulary`` wrote: the terms and the parameters."""
    import ast

    stored = spark.read.parquet(f"{path}/parameters").collect()  # one row for each parameter
    return spark.read.parquet(f"{path}/terms"), {r["name"]: ast.literal_eval(r["value"]) for r in stored}


def transform(rows: DataFrame, vocabulary: DataFrame, key: str | list[str], text: str = "text") -> DataFrame:
    """Rows in the space of a fitted vocabulary: only places of its terms are shuffled and counted."""
    keys = [key] if isinstance(key, str) else key
    known = places(rows, keys, text).join(F.broadcast(vocabulary.select("term")), "term", "left_semi")  # at most max_features rows
    return tfidf(known.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf")), vocabulary, key)


def mean_vector(vectors: Column) -> Column:
    """Mean of an array of equal-length arrays."""
    n = F.size(vectors)
    zero = F.transform(F.get(vectors, 0), lambda x: x * 0.0)
    return F.aggregate(vectors, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y), lambda a: F.transform(a, lambda x: x / n))


def unit_vector(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)


def lexical_tokens(text: Column) -> Column:
    """Tokens that name things: longer than one character and no literal. Stage them before ``grams``."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9_:/.\-]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin("none", "true", "false"))
