"""Line de-duplication that returns keep bitmaps (operator 3, built-in functions only).

Lines are hashed where the text is read. The hashes are range-partitioned on
(hash, document) and sorted by position within each document, so equal lines
stream past in order while a very common line may still spread over several
partitions. Partial sums give each key its number of documents and its last one;
only the positions that go are sent back, as bitmaps of 64-line words in which
words without a dropped line are left out. Text meets its bitmap once, by
document id.

Cases: null or empty text is one empty line; a repeated doc_id is one document
for counting, and each of its rows is filtered on its own positions; rows with a
null doc_id count as no document (as in the SQL) and keep all lines; extra
columns pass through ``apply_bitmaps`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import common as C

MIN_CHARS, MIN_DOCS = 40, 5
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def _text_hash() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2 (128 bits), doc_id, text_hash, pos of each line whose key has at least ``min_chars`` code points."""
    one = docs.select("doc_id", _text_hash().alias("text_hash"), F.posexplode(lines(F.col("text"))).alias("pos", "line")).where(F.length("line") >= min_chars)
    keyed = one.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc_id", "text_hash", "pos")


def drop_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_hash, n_dropped, words: the documents that lose lines; ``words`` maps 64-line word to a bitmap of dropped lines."""
    n = C.parts(docs.sparkSession)
    # written first: the sampling that finds the ranges then reads hashes, not text
    sorted_lines = C.stored(line_hashes(docs, min_chars), "hashes").repartitionByRange(n, "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    bits = F.struct("text_hash", F.shiftright("pos", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(63)).alias("bit"))
    # one row per key and document: its positions, as they stream past
    held = C.stored(sorted_lines.groupBy("h1", "h2", "doc_id").agg(F.collect_set(bits).alias("bits")), "lines")
    keys = held.groupBy("h1", "h2").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc")).where(F.col("n_docs") >= min_docs).select("h1", "h2", "last_doc")
    gone = held.join(C.sized_broadcast(keys), ["h1", "h2"]).where("doc_id <> last_doc").select("doc_id", F.inline("bits"))
    words = gone.groupBy("doc_id", "text_hash", "word").agg(F.bit_or("bit").alias("mask"), F.count(F.lit(1)).alias("n"))
    return words.groupBy("doc_id", "text_hash").agg(F.sum("n").alias("n_dropped"), F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("words"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with n_lines, n_dropped and text replaced by its kept lines; documents without a bitmap keep all lines."""
    plain = docs.drop("n_lines", "n_dropped", "words", "text_hash").withColumn("text_hash", _text_hash())
    joined = plain.join(bitmaps, ["doc_id", "text_hash"], "left")
    all_lines = lines(F.col("text"))
    stays = F.filter(
        all_lines,
        lambda x, i: F.coalesce(F.getbit(F.element_at("words", F.shiftright(i, 6)), i.bitwiseAND(63)), F.lit(0)) == 0,
    )
    text = F.when(F.col("words").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(stays, "\n"))
    return joined.withColumns({"n_lines": F.size(all_lines).cast("long"), "n_dropped": F.coalesce("n_dropped", F.lit(0)).cast("long"), "text": text}).drop("words", "text_hash")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id and keep: the compressed keep bitmap (words in which every line stays are left out) of each document with a
    dropped line; every other document keeps all its lines."""
    return drop_bitmaps(docs, min_chars, min_docs).select("doc_id", "text_hash", "n_dropped", F.transform_values("words", lambda _, v: F.bitwise_not(v)).alias("keep"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", "text")
    out = apply_bitmaps(docs, drop_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with the lines that it keeps; n_chars follows the text."""
    out = apply_bitmaps(docs, drop_bitmaps(docs))
    text = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", text).select(*docs.columns)


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last_doc AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
