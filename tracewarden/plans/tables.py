"""The driver's tables read as the engine's frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.operators.automata import Dfa
from tracewarden.operators.prefixes import event_steps, failure_label

HORIZON, STATES, SYMBOLS = 3, 6, 5


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_steps(read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value"))


def monitor() -> Dfa:
    """A fixed automaton over event symbols, for queries that replay one."""
    return Dfa([[(2 * s + a + 1) % STATES for a in range(SYMBOLS)] for s in range(STATES)], {1, 4})


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as steps: line is ``role: text``."""
    t = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    w = W.partitionBy("conv_id").orderBy("turn")
    return t.select(F.col("conv_id").alias("trajectory_id"), F.row_number().over(w).alias("step_index"), "role", "text", F.concat_ws(": ", "role", "text").alias("line"))


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event steps with the state of the fixed automaton and the label."""
    from tracewarden.operators.automata import replay_steps

    return replay_steps(steps(spark, sf_dir), monitor()).withColumn("label", failure_label(HORIZON))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replayed steps with their state's risk as score, and its support."""
    from tracewarden.operators import metrics

    r = replayed(spark, sf_dir)
    return metrics.score_prefixes(r, metrics.state_risk(monitor().states(spark), r))


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event steps with symbol probabilities that depend on symbol and value: a peak at the symbol, flatter for larger
    values."""
    peak = 0.3 + 0.6 / (1.0 + F.col("value") / 50.0)
    probs = F.transform(F.sequence(F.lit(0), F.lit(SYMBOLS - 1)), lambda k: F.when(k == F.col("symbol"), peak).otherwise((1.0 - peak) / (SYMBOLS - 1)))
    return steps(spark, sf_dir).withColumn("probs", probs)
