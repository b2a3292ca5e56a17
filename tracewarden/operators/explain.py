"""What symbols and states mean: distinctive n-grams, examples and exemplars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.operators.features import grams as all_grams
from tracewarden.operators.features import lexical_tokens


def ngram_weights(assigned: DataFrame, text: str = "text") -> DataFrame:
    """symbol, ngram, weight (confidence over occurrences), distinctiveness and score, rounded to 6 digits."""
    tokens = assigned.select("symbol", "confidence", lexical_tokens(F.col(text)).alias("_tokens"))
    grams = tokens.select("symbol", "confidence", F.explode(all_grams(F.col("_tokens"))).alias("ngram"))
    own = grams.groupBy("symbol", "ngram").agg(F.sum("confidence").alias("weight"))
    total = F.greatest(F.sum("weight").over(W.partitionBy("ngram")), F.lit(1e-8))
    return own.select("symbol", "ngram", F.round("weight", 6).alias("weight"), F.round(F.col("weight") / total, 6).alias("distinctiveness"), F.round(F.col("weight") * F.col("weight") / total, 6).alias("score"))


def top_ngrams(assigned: DataFrame, k: int = 10, text: str = "text") -> DataFrame:
    w = W.partitionBy("symbol").orderBy(F.desc("score"), F.desc("weight"), F.desc("ngram"))
    return ngram_weights(assigned, text).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_examples(assigned: DataFrame, k: int = 5, text: str = "text") -> DataFrame:
    """The k surest steps of each symbol with different texts: by confidence, margin, then key."""
    best = [F.desc("confidence"), F.desc("margin"), "trajectory_id", "step_index"]
    once = assigned.withColumn("_k", F.row_number().over(W.partitionBy("symbol", text).orderBy(*best))).where("_k = 1")
    return once.withColumn("rank", F.row_number().over(W.partitionBy("symbol").orderBy(*best))).where(F.col("rank") <= k).drop("_k")


def symbol_summary(assigned: DataFrame, n_symbols: int) -> DataFrame:
    """count and rate of every symbol, those without steps included."""
    spark = assigned.sparkSession
    n = assigned.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(n_symbols).select(F.col("id").cast("int").alias("symbol"))
    out = every.join(n, "symbol", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))  # as many rows as symbols
    return out.withColumn("rate", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def state_exemplars(scored: DataFrame, k: int = 3, tail: int = 4) -> DataFrame:
    """The k prefixes of each state that fail soonest (label, fewest steps left, key), with their last symbols."""
    w = W.partitionBy("trajectory_id").orderBy("step_index").rowsBetween(-(tail - 1), 0)
    rows = scored.withColumns({"tail": F.collect_list("symbol").over(w), "left": F.col("n_steps") - F.col("step_index")})
    order = W.partitionBy("state").orderBy(F.desc("label"), "left", "trajectory_id", "step_index")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_warnings(scored: DataFrame, threshold: float, k: int = 3) -> DataFrame:
    """For each state the k runs whose first alert falls in it, earliest relative position first."""
    first = scored.where(F.col("score") >= threshold).withColumn("_k", F.row_number().over(W.partitionBy("trajectory_id").orderBy("step_index"))).where("_k = 1").drop("_k")
    order = W.partitionBy("state").orderBy(F.col("step_index") / F.col("n_steps"), "trajectory_id")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
