"""Chat formatting with cumulative-snapshot collapse (operator 10).

Logging systems store a conversation again after every turn. A rolling hash over
the turns gives every prefix of every conversation one value, so a conversation
that is a prefix of a longer one is found by an anti-join of its full hash
against the prefix hashes of the others; of equal ones the smallest id stays.
The hash of a prefix is the exclusive or of the hashes of its turns, each taken
with its position, so one running aggregate gives all of them in a time linear
in the turns. Texts travel only for the conversations that are left, which are
rendered.

Cases: turns are taken in the order of ``turn`` (ties: role, then text); null
role or text counts as an empty string; a null conv_id is a conversation of its
own, named last among equals; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROLE_OPEN, ROLE_CLOSE, TURN_END = "<|", "|>\n", "\n<|end|>\n"
#: Hashes of a prefix, 64 bits each.
HASHES = ("h1", "h2")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, i (from 1), n_turns, h1 and h2: the rolling hash after each turn."""
    empty = F.lit("")
    t = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    t = t.withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64(F.lit(7), "text", "role")})
    own = W.partitionBy("conv_id")
    ordered = own.orderBy("turn", "role", "text")
    placed = t.withColumns({"i": F.row_number().over(ordered), "n_turns": F.count(F.lit(1)).over(own)})
    running = ordered.rowsBetween(W.unboundedPreceding, 0)
    rolled = {h: F.bit_xor(F.xxhash64(F.lit(k), "i", "a", "b")).over(running) for k, h in enumerate(HASHES)}
    return placed.withColumns(rolled).select("conv_id", "i", F.col("n_turns").cast("long").alias("n_turns"), *HASHES)


def maximal(turns: DataFrame) -> DataFrame:
    """The conversations that are no proper prefix of another and the first of their equals: conv_id, n_turns, turns,
    n_equal (how many were equal)."""
    every = prefixes(turns)
    same = ["i", *HASHES]
    # equals meet in partial aggregates before the shuffle
    first = every.where("i = n_turns").groupBy(*same).agg(F.min_by(F.struct("conv_id", "n_turns"), F.coalesce("conv_id", F.lit((1 << 63) - 1))).alias("c"), F.count(F.lit(1)).alias("n_equal"))
    left = first.join(every.where("i < n_turns").select(*same).distinct(), same, "left_anti").select(F.col("c.conv_id").alias("_id"), "c.n_turns", "n_equal")
    empty = F.lit("")
    one = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    kept = turns.select("conv_id", one.alias("t")).join(left.select("_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left_semi")
    convs = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return convs.join(left, convs["conv_id"].eqNullSafe(left["_id"])).select("conv_id", "n_turns", "turns", "n_equal")


def render(convs: DataFrame) -> DataFrame:
    """Adds ``chat``: the turns in one string with role and end marks."""
    each = F.transform("turns", lambda t: F.concat(F.lit(ROLE_OPEN), t["role"], F.lit(ROLE_CLOSE), t["text"], F.lit(TURN_END)))
    return convs.withColumn("chat", F.array_join(each, ""))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    out = render(maximal(turns))
    return out.select("conv_id", "n_turns", "n_equal", F.length("chat").cast("long").alias("n_chars"), "chat")


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM conversations),
p AS (
  SELECT *, string_agg(chr(30) || role || chr(31) || text, '') OVER (PARTITION BY conv_id ORDER BY i) AS prefix FROM t),
f AS (SELECT conv_id, n_turns, md5(prefix) AS h FROM p WHERE i = n_turns),
s AS (SELECT DISTINCT md5(prefix) AS h FROM p WHERE i < n_turns),
m AS (
  SELECT min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_equal FROM f
  WHERE h NOT IN (SELECT h FROM s) GROUP BY h),
r AS (
  SELECT m.conv_id, m.n_turns, m.n_equal, string_agg('<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10), '' ORDER BY t.i) AS chat
  FROM m JOIN t ON m.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY ALL)
SELECT conv_id, n_turns, n_equal, length(chat) AS n_chars, chat FROM r
"""
