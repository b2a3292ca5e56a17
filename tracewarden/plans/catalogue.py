"""Registered queries of the engine: name -> function, and name -> equivalent SQL.

Every query runs over its whole tables; trajectories are derived from the
driver's tables (see ``tables``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.functions import markers as M
from tracewarden.functions import reduce as R
from tracewarden.functions import render, tags
from tracewarden.functions import text as T
from tracewarden.operators import automata, cleaning, explain, features, metrics, models, prefixes, splits, symbols
from tracewarden.plans import sql as S
from tracewarden.plans import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def r6(name: str, alias: str | None = None):
    return F.round(name, 6).alias(alias or name)


# --- prefixes, labels, splits ----------------------------------------------------------------------------------------


@query(f"WITH {S.PREFIXES} SELECT trajectory_id, prefix_index, n_steps, label, terminal_label, remaining_steps_bin, failure_bucket FROM prefixes")
def prefix_expand_labels(spark, sf):
    p = prefixes.expand(tables.steps(spark, sf))
    return p.select("trajectory_id", "prefix_index", "n_steps", "label", "signature.terminal_label", "signature.remaining_steps_bin", "signature.failure_bucket")


@query(f"""WITH {S.PREFIXES}, b AS (SELECT *, {S.bucket("trajectory_id")} AS u FROM prefixes),
s AS (SELECT *, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS protocol_split FROM b)
SELECT protocol_split, count(DISTINCT trajectory_id) AS trajectory_count, count(*) AS prefix_count, CAST(sum(label) AS BIGINT) AS positive_count,
  count(DISTINCT (terminal_label, remaining_steps_bin, failure_bucket)) AS signature_count FROM s GROUP BY protocol_split""")
def prefix_summary_by_split(spark, sf):
    p = prefixes.expand(tables.steps(spark, sf))
    return prefixes.summary_by_split(splits.outer_split(p, task="trajectory_id"), "protocol_split")


def _order_runs(spark, sf):
    return tables.read(spark, sf, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("trajectory_id"), F.col("o_custkey").alias("task_id"))


def _split_sql(cases: str) -> str:
    return f"""WITH b AS (SELECT o_orderkey AS trajectory_id, o_custkey AS task_id, {S.bucket("o_custkey")} AS u FROM orders)
SELECT trajectory_id, task_id, CASE {cases} END AS protocol_split FROM b"""


@query(_split_sql("WHEN u < 0.8 THEN 'fit' ELSE 'cal'"))
def task_split_fit_cal(spark, sf):
    return splits.fit_cal_split(_order_runs(spark, sf))


@query(_split_sql("WHEN u < 0.7 THEN 'fit' WHEN u < 0.7::DOUBLE + 0.1::DOUBLE THEN 'cal' WHEN u < 0.7::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test'"))
def task_split_top_level(spark, sf):
    return splits.top_level_split(_order_runs(spark, sf))


@query(_split_sql("WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test'"))
def task_split_outer(spark, sf):
    return splits.outer_split(_order_runs(spark, sf))


@query("""WITH r AS (SELECT o_orderkey AS trajectory_id, o_custkey AS task_id, count(*) OVER (PARTITION BY o_custkey) AS n,
  row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('1:' || o_orderkey), o_orderkey) AS k FROM orders),
q AS (SELECT *, greatest(1, CAST(round_even(n * 0.1::DOUBLE, 0) AS INTEGER)) AS m FROM r)
SELECT trajectory_id, task_id, CASE WHEN n < 4 OR n - 3 * m < 1 OR k <= n - 3 * m THEN 'fit' WHEN k <= n - 2 * m THEN 'cal' WHEN k <= n - m THEN 'val' ELSE 'test' END AS protocol_split FROM q""")
def stratified_split_quota(spark, sf):
    return splits.stratified_split(_order_runs(spark, sf), strict=False)


@query(f"""WITH {S.PREFIXES} SELECT terminal_label, remaining_steps_bin, failure_bucket, count(*) AS n FROM prefixes GROUP BY ALL
ORDER BY n DESC, terminal_label, remaining_steps_bin, failure_bucket LIMIT 10""")
def future_signature_topk(spark, sf):
    return prefixes.top_signatures(prefixes.expand(tables.steps(spark, sf)), 10)


@query(f"""WITH {S.PREFIXES} SELECT trajectory_id, prefix_index, CAST(CASE WHEN trajectory_id % 7 = 0 THEN prefix_index % 2 ELSE label END AS INTEGER) AS label
FROM prefixes WHERE NOT (trajectory_id % 5 = 0 AND prefix_index % 3 = 0)""")
def label_mask_override(spark, sf):
    p = prefixes.expand(tables.steps(spark, sf))
    every = F.sequence(F.lit(1), "n_steps")
    p = p.withColumns({"explicit_labels": F.when(F.col("trajectory_id") % 7 == 0, F.transform(every, lambda i: i % 2)), "prefix_mask": F.when(F.col("trajectory_id") % 5 == 0, F.transform(every, lambda i: i % 3 != 0))})
    return prefixes.overridden_labels(p).select("trajectory_id", "prefix_index", "label")


@query(f"""WITH {S.STEPS}, g AS (SELECT s.trajectory_id, s.step_index AS prefix_index, unnest(range(1, s.step_index + 1)) AS k FROM steps s),
h AS (SELECT *, sha256('1:' || trajectory_id || ':' || prefix_index || ':' || k) AS h FROM g)
SELECT trajectory_id, prefix_index, string_agg(k, ',' ORDER BY h) AS permutation FROM h GROUP BY ALL""")
def scrambled_prefixes(spark, sf):
    p = tables.steps(spark, sf).select("trajectory_id", F.col("step_index").alias("prefix_index"))
    return splits.scrambled_prefixes(p).select("trajectory_id", "prefix_index", F.array_join(F.transform("permutation", lambda x: x.cast("string")), ",").alias("permutation"))


# --- texts -----------------------------------------------------------------------------------------------------------


@query(f"WITH n AS (SELECT conv_id, turn, {S.normal('text')} AS text FROM conversations) SELECT *, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS tokens FROM n")
def normalize_step_text(spark, sf):
    c = tables.read(spark, sf, "conversations", "conv_id", "turn", "text")
    return c.select("conv_id", "turn", T.normalize("text").alias("text"), T.token_count("text").alias("tokens"))


@query(f"""WITH {S.TURNS}, l AS (SELECT *, lag(line) OVER w AS before, lead(line) OVER w AS after FROM turns WINDOW w AS (PARTITION BY trajectory_id ORDER BY step_index))
SELECT trajectory_id, step_index, 'CONTEXT=[' || {S.normal("coalesce(before, '')")} || '] ACTION=[action=' || {S.normal('text')} || '; tool=NONE; args={{}}] RESULT=[status=' || role || '; text=' || {S.normal("coalesce(after, '')")} || ']' AS payload FROM l""")
def serialize_steps(spark, sf):
    w = W.partitionBy("trajectory_id").orderBy("step_index")
    t = tables.turns(spark, sf).withColumns({"before": F.lag("line").over(w), "after": F.lead("line").over(w)})
    s = t.select("trajectory_id", "step_index", F.col("before").alias("context"), F.col("text").alias("action_text"), F.lit(None).cast("string").alias("tool_name"), F.lit("{}").alias("tool_args"), F.col("after").alias("result_text"), F.col("role").alias("status"))
    return render.payloads(s).select("trajectory_id", "step_index", "payload")


_LINES = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
f AS (SELECT doc_id, {S.normal('line')} AS line, i FROM l WHERE {S.normal('line')} <> ''),
full_lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM f)"""


@query(f"""WITH {_LINES}, n AS (SELECT doc_id, count(*) AS n, string_agg(line, ' | ' ORDER BY i) FILTER (WHERE i <= 2) AS metadata,
  string_agg(line, ' | ' ORDER BY i) FILTER (WHERE i > 2) AS observation FROM full_lines GROUP BY doc_id)
SELECT d.doc_id, coalesce(metadata, 'NONE') AS metadata, coalesce(observation, 'NONE') AS observation FROM documents d LEFT JOIN n USING (doc_id)""")
def context_split(spark, sf):
    d = tables.read(spark, sf, "documents", "doc_id", "text")
    s = T.staged(d, {"lines": T.full_lines("text")}, {"split": render.split_context(F.col("lines"))})
    return s.select("doc_id", render.bar_joined(F.col("split.md")).alias("metadata"), render.bar_joined(F.col("split.obs")).alias("observation"))


@query(f"""WITH t AS (SELECT lang, CASE WHEN {S.normal('text')} = '' THEN 0 ELSE len(string_split({S.normal('text')}, ' ')) END AS tokens FROM documents),
c AS (SELECT lang, tokens, count(*) AS n FROM t GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, tokens) AS k FROM c),
a AS (SELECT lang, string_agg(tokens || 'x' || n, ',' ORDER BY k) AS most_common FROM m WHERE k <= 5 GROUP BY lang)
SELECT t.lang, count(*) AS count, min(tokens) AS min, max(tokens) AS max, round(avg(tokens), 3) AS mean, any_value(most_common) AS most_common FROM t JOIN a USING (lang) GROUP BY t.lang""")
def token_count_stats(spark, sf):
    d = tables.read(spark, sf, "documents", "lang", "text").withColumn("tokens", T.token_count("text"))
    s = prefixes.numeric_summary(d, "tokens", "lang")
    return s.withColumn("most_common", F.array_join(F.transform("most_common", lambda x: F.concat_ws("x", x["value"].cast("string"), x["n"].cast("string"))), ","))


@query(f"""WITH {_LINES}, s AS (SELECT doc_id, line, i, CAST(contains(lower(line), 'tion') AS INTEGER) + CAST(contains(lower(line), 'ing') AS INTEGER) AS hits,
  CAST({S.holds('lower(line)', M.STATUS_WORDS)} AS INTEGER) AS status, len(regexp_extract_all(line, '[0-9]')) AS digits FROM full_lines),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, status DESC, digits DESC, i) AS k FROM s)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, line FROM k WHERE k <= 8""")
def observation_topk_lines(spark, sf):
    d = tables.read(spark, sf, "documents", "doc_id", "text").withColumns({"lines": T.full_lines("text"), "hints": F.array(F.lit("tion"), F.lit("ing"))})
    return T.listed(R.add_best(d, "lines", "hints", "top", 8), ["doc_id"], "top", "pos", "line")


@query(f"""WITH {_LINES}, s AS (SELECT doc_id, line, i, CAST(starts_with(lower(line), 'licensed') OR starts_with(lower(line), 'this work') OR starts_with(line, '```') OR starts_with(lower(line), 'the ') OR i = 1 AS INTEGER) AS fresh FROM full_lines),
u AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS unit FROM s)
SELECT doc_id, CAST(unit AS INTEGER) AS unit, count(*) AS n_lines, string_agg(line, ' ' ORDER BY i) AS text FROM u GROUP BY doc_id, unit""")
def log_block_segments(spark, sf):
    d = tables.read(spark, sf, "documents", "doc_id", "text").withColumn("lines", T.full_lines("text"))
    opens = lambda x: T.starts_any(F.lower(x), ("licensed", "this work", "the ")) | x.startswith("```")
    u = T.listed(R.add_units(d, "lines", "units", opens), ["doc_id"], "units", "unit", "u")
    return u.select("doc_id", "unit", F.size("u").cast("long").alias("n_lines"), F.array_join("u", " ").alias("text"))


_TURN_LINES = f"""{S.TURNS}, l AS (SELECT trajectory_id, step_index, unnest(string_split(line, chr(10))) AS line, generate_subscripts(string_split(line, chr(10)), 1) AS i FROM turns),
f AS (SELECT trajectory_id, {S.normal('line')} AS line, step_index, i FROM l WHERE {S.normal('line')} <> ''),
full_lines AS (SELECT trajectory_id, line, row_number() OVER (PARTITION BY trajectory_id ORDER BY step_index, i) AS i FROM f),
spoken AS (SELECT *, CASE WHEN starts_with(lower(line), 'assistant:') THEN 'assistant' WHEN starts_with(lower(line), 'user:') THEN 'user'
  WHEN starts_with(lower(line), 'tool[') OR starts_with(lower(line), 'tool:') THEN 'tool' WHEN starts_with(lower(line), 'system:') THEN 'system' END AS speaker FROM full_lines)"""


def _dialogue_lines(spark, sf):
    t = tables.turns(spark, sf).groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("step_index", "line"))).alias("t"))
    return t.select("trajectory_id", T.full_lines(F.array_join(F.transform("t", lambda x: x["line"]), "\n")).alias("lines"))


@query(f"""WITH {_TURN_LINES}, u AS (SELECT *, sum(CAST(speaker IS NOT NULL OR i = 1 AS INTEGER)) OVER (PARTITION BY trajectory_id ORDER BY i) - 1 AS unit FROM spoken)
SELECT trajectory_id, CAST(unit AS INTEGER) AS unit, string_agg(line, ' ' ORDER BY i) AS text FROM u GROUP BY trajectory_id, unit""")
def dialogue_turn_units(spark, sf):
    u = R.add_units(_dialogue_lines(spark, sf), "lines", "units", R.opens_turn)
    return T.listed(u, ["trajectory_id"], "units", "unit", "u").select("trajectory_id", "unit", F.array_join("u", " ").alias("text"))


@query(f"""WITH {_TURN_LINES}, s AS (SELECT *, lag(speaker) OVER (PARTITION BY trajectory_id ORDER BY i) AS before FROM spoken WHERE speaker IS NOT NULL),
c AS (SELECT trajectory_id, speaker, row_number() OVER (PARTITION BY trajectory_id ORDER BY i DESC) AS k FROM s WHERE before IS NULL OR before <> speaker)
SELECT d.trajectory_id, coalesce(p, 'none') AS speaker_pattern FROM (SELECT DISTINCT trajectory_id FROM turns) d
LEFT JOIN (SELECT trajectory_id, string_agg(speaker, '->' ORDER BY k DESC) AS p FROM c WHERE k <= 4 GROUP BY trajectory_id) x USING (trajectory_id)""")
def speaker_pattern(spark, sf):
    return _dialogue_lines(spark, sf).select("trajectory_id", tags.speaker_pattern(F.col("lines")).alias("speaker_pattern"))


@query(f"""WITH {S.TURNS}, s AS (SELECT *, sum(CAST(role = 'assistant' AS INTEGER)) OVER (PARTITION BY trajectory_id ORDER BY step_index) AS segment FROM turns)
SELECT trajectory_id, CAST(segment AS BIGINT) AS segment, min(step_index) AS first_step, count(*) - 1 AS follow_ups, any_value(text) FILTER (WHERE role = 'assistant') AS action_text,
  coalesce(string_agg(role || ': ' || {S.normal('text')}, chr(10) ORDER BY step_index) FILTER (WHERE role <> 'assistant'), 'NONE') AS result_text
FROM s WHERE segment > 0 GROUP BY trajectory_id, segment""")
def assistant_segments(spark, sf):
    w = W.partitionBy("trajectory_id").orderBy("step_index")
    s = tables.turns(spark, sf).withColumn("segment", F.sum((F.col("role") == "assistant").cast("int")).over(w)).where("segment > 0")
    others = F.array_sort(F.collect_list(F.when(F.col("role") != "assistant", F.struct("step_index", F.concat(F.col("role"), F.lit(": "), T.normalize("text")).alias("x")))))
    g = s.groupBy("trajectory_id", "segment").agg(F.min("step_index").alias("first_step"), (F.count(F.lit(1)) - 1).alias("follow_ups"), F.first(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).alias("action_text"), others.alias("o"))
    return g.withColumn("result_text", F.when(F.size("o") == 0, "NONE").otherwise(F.array_join(F.transform("o", lambda x: x["x"]), "\n"))).drop("o")


@query(f"""WITH {S.TURNS}, h AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY trajectory_id ORDER BY step_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS history FROM turns)
SELECT trajectory_id, step_index, coalesce(history, 'NONE') AS history FROM h""")
def history_window_context(spark, sf):
    return prefixes.history_window(tables.turns(spark, sf), "line", 3).select("trajectory_id", "step_index", "history")


_KIND = f"""CASE WHEN {S.holds('a', ['tool_call '])} THEN 'invoke_tool' WHEN contains(r, 'tool[') THEN 'explain_tool_result' WHEN a <> '' AND {S.holds('a', M.GUIDANCE)} THEN 'guide_user_action'
  WHEN a <> '' AND {S.holds('a', M.QUERY)} THEN 'ask_or_confirm' ELSE 'assistant_response' END"""


@query(f"""WITH {S.TURNS}, l AS (SELECT *, coalesce(lead(text) OVER (PARTITION BY trajectory_id ORDER BY step_index), '') AS result FROM turns),
n AS (SELECT trajectory_id, step_index, lower({S.normal('text')}) AS a, lower({S.normal('result')}) AS r FROM l),
k AS (SELECT *, CASE WHEN a = '' THEN r WHEN r = '' THEN a ELSE a || ' ' || r END AS s, {_KIND} AS step_kind FROM n)
SELECT trajectory_id, step_index, step_kind, CASE step_kind WHEN 'invoke_tool' THEN 'agent' WHEN 'guide_user_action' THEN 'user-mediated' ELSE 'dialogue-only' END AS control_locus,
  CASE step_kind WHEN 'invoke_tool' THEN 'tool_call' WHEN 'guide_user_action' THEN 'user_guidance' WHEN 'ask_or_confirm' THEN 'query_or_confirm' WHEN 'explain_tool_result' THEN 'inform'
    ELSE CASE WHEN {S.holds('a', ('unable to', 'cannot ', "can't "))} THEN 'handoff' ELSE 'inform' END END AS dialogue_act,
  CASE WHEN {S.holds('s', M.POLICY)} THEN 'policy_needed' WHEN {S.holds('s', M.OBLIGATION_IDENTITY)} THEN 'identity_needed' WHEN {S.holds('s', M.ACCOUNT)} THEN 'account_needed' ELSE 'none' END AS verification_obligation,
  CASE WHEN {S.holds('s', M.IDENTITY)} THEN 'identity_verification' WHEN {S.holds('s', M.LOOKUP)} THEN 'order_or_account_lookup' WHEN {S.holds('s', M.OPTION)} THEN 'option_confirmation'
    WHEN {S.holds('s', M.CONSTRAINT)} THEN 'constraint_clarification' ELSE 'generic_followup' END AS query_collecting_subtype FROM k""")
def rule_tags_dialogue(spark, sf):
    w = W.partitionBy("trajectory_id").orderBy("step_index")
    t = tables.turns(spark, sf).select("trajectory_id", "step_index", F.array().cast("array<string>").alias("observation_lines"), F.col("text").alias("action_text"), F.lit("respond").alias("tool_name"), F.lit("{}").alias("tool_args"), F.coalesce(F.lead("text").over(w), F.lit("")).alias("result_text"), F.lit("ok").alias("status"))
    d = tags.add_dialogue_tags(t)
    return d.select("trajectory_id", "step_index", *(f"dialogue.{x}" for x in ("step_kind", "control_locus", "dialogue_act", "verification_obligation", "query_collecting_subtype")))


@query(f"""WITH n AS (SELECT doc_id, lower({S.normal('text')}) AS a FROM documents), k AS (SELECT *, CASE WHEN contains(a, 'tool_call') THEN 'tool_call' ELSE 'dialogue_response' END AS step_kind,
  CASE WHEN {S.holds('a', M.VERIFY)} THEN 'verify' WHEN {S.holds('a', M.TEST)} THEN 'test' WHEN {S.holds('a', M.BUILD)} THEN 'build' WHEN {S.holds('a', M.EDIT)} THEN 'edit' WHEN {S.holds('a', M.INSPECT)} THEN 'inspect' ELSE 'unknown' END AS phase,
  CASE WHEN NOT {S.holds('a', M.ERROR_WORDS)} THEN 'no_error' WHEN {S.holds('a', M.RETRY)} THEN 'repeated_error' ELSE 'new_error' END AS error_persistence,
  CASE WHEN NOT {S.holds('a', M.RETRY_PATTERN)} THEN 'none' WHEN {S.holds('a', M.SAME_COMMAND)} THEN 'same_command_retry' ELSE 'same_goal_retry' END AS retry_pattern FROM n)
SELECT doc_id, step_kind, phase, error_persistence, retry_pattern, CASE WHEN error_persistence <> 'no_error' THEN 'no_progress' WHEN phase <> 'unknown' AND step_kind = 'dialogue_response' THEN 'progress' ELSE 'no_progress' END AS progress_state FROM k""")
def rule_tags_process(spark, sf):
    empty = F.lit("")
    d = tables.read(spark, sf, "documents", "doc_id", "text").select("doc_id", F.array().cast("array<string>").alias("metadata_lines"), F.col("text").alias("action_text"), F.lit("respond").alias("tool_name"), F.lit("{}").alias("tool_args"), empty.alias("result_text"), F.lit("ok").alias("status"))
    return tags.add_process_tags(d).select("doc_id", *(f"process.{x}" for x in ("step_kind", "phase", "error_persistence", "retry_pattern", "progress_state")))


_LEAKY = "SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN chr(10) || chr(10) || chr(10) || 'The verifier will read /logs/verifier/out.txt' WHEN 1 THEN ' see /root/verifier-skills/a and /tests/test_outputs.py  twice /tests/test_outputs.py' WHEN 2 THEN chr(10) || 'Split = train' ELSE ' reward = 1.0' END AS text FROM documents"


def _leaky(spark, sf):
    d = tables.read(spark, sf, "documents", "doc_id", "text")
    k = F.col("doc_id") % 4
    extra = F.when(k == 0, "\n\n\nThe verifier will read /logs/verifier/out.txt").when(k == 1, " see /root/verifier-skills/a and /tests/test_outputs.py  twice /tests/test_outputs.py").when(k == 2, "\nSplit = train").otherwise(" reward = 1.0")
    return d.withColumn("text", F.concat("text", extra))


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


def _rewrite_sql() -> str:
    out = "text"
    for _, p, new in M.REWRITE_RULES:
        out = f"regexp_replace({out}, '{_re(p)}', '{new}', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace({out}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


_ANY_REWRITE = "(" + " OR ".join(f"regexp_matches(text, '{_re(p)}')" for _, p, _ in M.REWRITE_RULES) + ")"
_ANY_DROP = "(" + " OR ".join(f"regexp_matches(text, '{_re(p)}')" for _, p in M.DROP_RULES) + ")"


@query(f"WITH d AS ({_LEAKY}) SELECT doc_id, {_ANY_DROP} AS needs_drop, CASE WHEN {_ANY_REWRITE} THEN {_rewrite_sql()} ELSE text END AS text, CAST({_ANY_REWRITE} AS INTEGER) AS affected_fields FROM d")
def clean_text_rewrite(spark, sf):
    return cleaning.clean_steps(_leaky(spark, sf), ["text"]).select("doc_id", "needs_drop", "text", "affected_fields")


@query(f"WITH d AS ({_LEAKY}) SELECT doc_id, regexp_matches(text, '(?im)^\\s*({'|'.join(cleaning.FORBIDDEN)})\\s*[:=]') AS leaks FROM d")
def leakage_audit(spark, sf):
    return _leaky(spark, sf).select("doc_id", cleaning.leakage(F.col("text")).alias("leaks"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs, len(regexp_extract_all(html, '<a [^>]*href=')) AS n_links FROM pages""")
def html_blocks(spark, sf):
    p = tables.read(spark, sf, "pages", "page_id", "html")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p[ >]")).alias("n_paragraphs"), F.regexp_count("html", F.lit("<a [^>]*href=")).alias("n_links"))


# --- features --------------------------------------------------------------------------------------------------------

_GRAMS = """tok AS (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM {table}),
terms AS (SELECT {key}, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM tok),
counts AS (SELECT {key}, term, count(*) AS tf FROM terms GROUP BY ALL),
vocab AS (SELECT term, ln((1 + (SELECT count(*) FROM {table})) / (1 + count(*))) + 1 AS idf, sum(tf) AS cf, count(*) AS df FROM counts GROUP BY term ORDER BY cf DESC, term LIMIT 4096)"""


@query(f"WITH {_GRAMS.format(key='doc_id', table='documents')} SELECT term, CAST(cf AS BIGINT) AS cf, df, round(idf, 6) AS idf FROM vocab")
def tfidf_terms(spark, sf):
    d = tables.read(spark, sf, "documents", "doc_id", "text")
    return features.tfidf_vocabulary(features.leading_counts(d, "doc_id"), d.count()).select("term", "cf", "df", r6("idf"))


@query(f"""WITH {_GRAMS.format(key='doc_id', table='documents')}, v AS (SELECT doc_id, term, tf * idf AS raw FROM counts JOIN vocab USING (term))
SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS value FROM v""")
def tfidf_vectors(spark, sf):
    d = tables.read(spark, sf, "documents", "doc_id", "text")
    return features.fit_transform(d, "doc_id")[0].select("doc_id", "term", r6("value"))


@query(f"""WITH {S.TURNS}, {_GRAMS.format(key='trajectory_id, step_index', table='turns')}, v AS (SELECT trajectory_id, step_index, term, tf * idf AS raw FROM counts JOIN vocab USING (term)),
x AS (SELECT trajectory_id, step_index, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY trajectory_id, step_index)) AS value FROM v),
s AS (SELECT t.trajectory_id, t.step_index AS prefix_index, x.term, sum(x.value) AS total FROM turns t JOIN x ON x.trajectory_id = t.trajectory_id AND x.step_index <= t.step_index GROUP BY ALL)
SELECT trajectory_id, prefix_index, term, round(total / sqrt(sum(total * total) OVER (PARTITION BY trajectory_id, prefix_index)), 6) AS value FROM s""")
def prefix_tfidf(spark, sf):
    t = tables.turns(spark, sf)
    triples, _ = features.fit_transform(t, ["trajectory_id", "step_index"])
    lengths = t.groupBy("trajectory_id").agg(F.max("step_index").alias("n_steps"))
    return features.prefix_sums(triples, lengths).select("trajectory_id", "prefix_index", "term", r6("value"))


@query(f"""WITH {S.STEPS} SELECT trajectory_id, step_index, round(value, 6) AS value_last, round(avg(value) OVER w, 10) AS value_mean, round(greatest(0.0, max(value) OVER w), 6) AS value_max
FROM steps WINDOW w AS (PARTITION BY trajectory_id ORDER BY step_index)""")
def pooled_prefix_features(spark, sf):
    p = features.pooled(tables.steps(spark, sf), ["value"])
    return p.select("trajectory_id", "step_index", r6("value_last"), F.round("value_mean", 10).alias("value_mean"), r6("value_max"))


@query("""WITH names AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS "column" FROM (SELECT DISTINCT unnest(['type=' || event_type, 'large=' || CAST(value > 50 AS VARCHAR)]) AS token FROM events)),
p AS (SELECT event_id, unnest(['type=' || event_type, 'large=' || CAST(value > 50 AS VARCHAR)]) AS token FROM events)
SELECT event_id, token, "column", 0.5::DOUBLE AS value FROM p JOIN names USING (token)""")
def sidechannel_onehot(spark, sf):
    e = tables.read(spark, sf, "events", "event_id", "event_type", "value")
    e = e.withColumn("tokens", F.array(F.concat(F.lit("type="), "event_type"), F.concat(F.lit("large="), (F.col("value") > 50).cast("string"))))
    return features.side_channel(e, "event_id", "tokens", 0.5)


_ASSIGNED = f"""{S.TURNS}, assigned AS (SELECT *, CAST(least(length(text) // 200, 3) AS INTEGER) AS symbol, (1 + length(text) % 7) / 8 AS confidence, (1 + length(text) % 5) / 8 AS margin FROM turns)"""


def _assigned(spark, sf):
    n = F.length("text")
    return tables.turns(spark, sf).withColumns({"symbol": F.least(F.floor(n / 200), F.lit(3)).cast("int"), "confidence": (1 + n % 7) / 8, "margin": (1 + n % 5) / 8})


@query(f"""WITH {_ASSIGNED}, tok AS (SELECT symbol, confidence, list_filter(regexp_extract_all(lower(text), '[a-z0-9_:/.\\-]+'), lambda x: length(x) > 1 AND x NOT IN ('none', 'true', 'false')) AS t FROM assigned),
g AS (SELECT symbol, confidence, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS ngram FROM tok),
w AS (SELECT symbol, ngram, sum(confidence) AS weight FROM g GROUP BY ALL), a AS (SELECT *, greatest(sum(weight) OVER (PARTITION BY ngram), 1e-8) AS total FROM w),
s AS (SELECT symbol, ngram, round(weight, 6) AS weight, round(weight / total, 6) AS distinctiveness, round(weight * weight / total, 6) AS score FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, weight DESC, ngram DESC) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""")
def ngram_distinctiveness(spark, sf):
    return explain.top_ngrams(_assigned(spark, sf), 10)


@query(f"""WITH {_ASSIGNED}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol, text ORDER BY confidence DESC, margin DESC, trajectory_id, step_index) AS k FROM assigned),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY confidence DESC, margin DESC, trajectory_id, step_index) AS rank FROM o WHERE k = 1)
SELECT symbol, rank, trajectory_id, step_index, confidence, margin FROM r WHERE rank <= 5""")
def symbol_examples(spark, sf):
    return explain.top_examples(_assigned(spark, sf), 5).select("symbol", "rank", "trajectory_id", "step_index", "confidence", "margin")


@query(f"""WITH {_ASSIGNED}, n AS (SELECT symbol, count(*) AS n FROM assigned GROUP BY symbol)
SELECT CAST(s.symbol AS INTEGER) AS symbol, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 6) AS rate FROM (SELECT unnest(range(6)) AS symbol) s LEFT JOIN n ON s.symbol = n.symbol""")
def symbol_summary(spark, sf):
    return explain.symbol_summary(_assigned(spark, sf), 6).select("symbol", "n", r6("rate"))


# --- symbols and automata --------------------------------------------------------------------------------------------

_WEIGHTS = [[((3 * k + 5 * j) % 7 - 3) / 4 for j in range(64)] for k in range(tables.SYMBOLS)]


@query("""WITH z AS (SELECT vec_id, list_transform(range(5), lambda k: list_sum(list_transform(range(64), lambda j: embedding[j + 1]::DOUBLE * ((3 * k + 5 * j) % 7 - 3) / 4.0::DOUBLE))) AS z FROM embeddings),
e AS (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z), p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)
SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS symbol, round(list_max(p), 6) AS confidence FROM p""")
def symbol_softmax_argmax(spark, sf):
    v = symbols.linear_symbols(tables.read(spark, sf, "embeddings", "vec_id", "embedding"), _WEIGHTS)
    return v.select("vec_id", "symbol", F.round(symbols.confidence(F.col("probs")), 6).alias("confidence"))


_PROBS = f"""{S.STEPS}, probs AS (SELECT *, 0.3 + 0.6 / (1.0 + value / 50.0) AS peak FROM steps),
top AS (SELECT *, greatest(peak, (1 - peak) / 4) AS conf, peak - (1 - peak) / 4 AS margin, CASE WHEN peak >= (1 - peak) / 4 THEN symbol WHEN symbol = 0 THEN 1 ELSE 0 END AS top_symbol FROM probs)"""


@query(f"""WITH {_PROBS}, g AS (SELECT *, CASE WHEN step_index = 1 OR margin >= 0.5 THEN step_index END AS ok FROM top),
f AS (SELECT *, max(ok) OVER (PARTITION BY trajectory_id ORDER BY step_index) AS at FROM g),
h AS (SELECT f.trajectory_id, f.step_index, f.top_symbol, t.top_symbol AS hard_symbol FROM f JOIN top t ON t.trajectory_id = f.trajectory_id AND t.step_index = f.at)
SELECT trajectory_id, step_index, CAST(top_symbol AS INTEGER) AS top_symbol, CAST(hard_symbol AS INTEGER) AS hard_symbol, top_symbol <> hard_symbol AS overridden,
  coalesce(lag(hard_symbol) OVER (PARTITION BY trajectory_id ORDER BY step_index) <> hard_symbol, false) AS switched FROM h""")
def sticky_hardening(spark, sf):
    h = symbols.harden(tables.probabilities(spark, sf), "sticky-margin", 0.5)
    return h.select("trajectory_id", "step_index", "top_symbol", "hard_symbol", "overridden", "switched")


def _day_traces(spark, sf):
    """Traces of a user's days: short, so that many repeat."""
    s = tables.steps(spark, sf)
    d = s.withColumn("day", F.to_date("ts")).groupBy("trajectory_id", "day").agg(F.array_sort(F.collect_list(F.struct("step_index", "symbol", "event_type"))).alias("x"))
    return d.select(F.transform("x", lambda e: e["symbol"].cast("int")).alias("symbols"), (F.element_at("x", -1)["event_type"] == "error").alias("positive"))


_DAYS = f"""{S.STEPS}, days AS (SELECT string_agg(symbol, ',' ORDER BY step_index) AS symbols, arg_max(event_type, step_index) = 'error' AS positive FROM steps GROUP BY trajectory_id, CAST(ts AS DATE))"""


@query(f"WITH {_DAYS} SELECT symbols, bool_or(positive) AS positive FROM days GROUP BY symbols HAVING bool_or(positive) = bool_and(positive)")
def consistent_traces(spark, sf):
    t = automata.consistent_traces(_day_traces(spark, sf))
    return t.select(F.array_join(F.transform("symbols", lambda x: x.cast("string")), ",").alias("symbols"), "positive")


@query(f"""WITH {_DAYS}, p AS (SELECT symbols, count(*) FILTER (WHERE positive) AS p, count(*) FILTER (WHERE NOT positive) AS q FROM days GROUP BY symbols)
SELECT CAST(sum(p) AS BIGINT) AS positive_traces, CAST(sum(q) AS BIGINT) AS negative_traces, count(*) FILTER (WHERE p > 0) AS distinct_positive, count(*) FILTER (WHERE q > 0) AS distinct_negative,
  count(*) FILTER (WHERE p > 0 AND q > 0) AS ambiguous, count(*) FILTER (WHERE p > 0 AND q = 0) AS kept_positive, count(*) FILTER (WHERE q > 0 AND p = 0) AS kept_negative FROM p""")
def trace_counters(spark, sf):
    return automata.trace_counters(_day_traces(spark, sf))


@query(f"""WITH {_DAYS}, l AS (SELECT string_split(symbols, ',') AS t, positive FROM days), e AS (SELECT t, positive, unnest(range(0, len(t) + 1)) AS k FROM l)
SELECT coalesce(array_to_string(t[1:k], ','), '') AS prefix, bool_or(k = len(t) AND positive) AS accepting, bool_or(k = len(t) AND NOT positive) AS rejecting FROM e GROUP BY 1""")
def prefix_tree(spark, sf):
    t = automata.prefix_tree(_day_traces(spark, sf))
    return t.select(F.array_join(F.transform("prefix", lambda x: x.cast("string")), ",").alias("prefix"), "accepting", "rejecting")


@query(f"WITH RECURSIVE {S.REPLAYED} SELECT trajectory_id, step_index, CAST(state AS INTEGER) AS state FROM replayed")
def dfa_replay_states(spark, sf):
    return tables.replayed(spark, sf).select("trajectory_id", "step_index", "state")


@query(f"WITH {_DAYS} SELECT symbols, bool_or(positive) AS positive, bool_or(positive) AS accepted FROM days GROUP BY symbols HAVING bool_or(positive) = bool_and(positive)")
def dfa_induced_acceptance(spark, sf):
    """Every consistent trace with what the automaton learned from all of them says: learners keep their training traces, so
    the SQL knows the answer without an automaton (D2 to D5)."""
    traces = automata.consistent_traces(_day_traces(spark, sf))
    dfa = automata.induce(traces, tables.SYMBOLS, "legacy", end_symbol=False)
    state = F.element_at(automata.replay(F.col("symbols"), dfa), -1)
    return traces.select(F.array_join(F.transform("symbols", lambda x: x.cast("string")), ",").alias("symbols"), "positive", state.isin(*sorted(dfa.accepting)).alias("accepted"))


# --- risk and metrics ------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {S.SCORED} SELECT CAST(state AS INTEGER) AS state, support, round(score, 6) AS risk FROM risk")
def state_risk_table(spark, sf):
    return metrics.state_risk(tables.monitor().states(spark), tables.replayed(spark, sf)).select("state", "support", r6("risk"))


@query(f"WITH RECURSIVE {S.SCORED} SELECT trajectory_id, step_index, label, round(score, 6) AS score, support FROM scored")
def prefix_risk_scores(spark, sf):
    return tables.scored(spark, sf).select("trajectory_id", "step_index", "label", r6("score"), "support")


_QUALITY = "quality AS (SELECT d.lang, d.doc_id, l.quality AS label, 1.0::DOUBLE / (1 + d.n_chars % 97) AS score FROM documents d JOIN labels l USING (doc_id))"


def _quality(spark, sf):
    d = tables.read(spark, sf, "documents", "doc_id", "lang", "n_chars").join(tables.read(spark, sf, "labels", "doc_id", "quality"), "doc_id")
    return d.select("lang", "doc_id", F.col("quality").alias("label"), (1.0 / (1 + F.col("n_chars") % 97)).alias("score"))


@query(f"WITH {_QUALITY}, {S.auroc_ap('quality', 'lang')} SELECT lang, n, positives, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM area")
def binary_metrics_auroc_ap(spark, sf):
    return metrics.ranking_metrics(_quality(spark, sf), "lang").select("lang", "n", "positives", r6("auroc"), r6("auprc"))


@query(f"""WITH {_QUALITY}, s AS (SELECT lang, score, sum(label) AS pos, count(*) AS n FROM quality GROUP BY ALL),
w AS (SELECT *, sum(pos) OVER (PARTITION BY lang ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY lang ORDER BY score DESC) AS alerts, sum(pos) OVER (PARTITION BY lang) AS p FROM s),
f AS (SELECT lang, score, tp / greatest(alerts, 1) AS pr, tp / greatest(p, 1) AS re FROM w), g AS (SELECT lang, score, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, score) AS k FROM g) SELECT lang, round(score, 6) AS threshold, round(f1, 6) AS f1 FROM k WHERE k = 1""")
def f1_threshold(spark, sf):
    return metrics.f1_threshold(_quality(spark, sf), "lang").select("lang", r6("threshold"), r6("f1"))


@query(f"WITH {_QUALITY} SELECT {S.bin10('score')} AS bin, count(*) AS n, round(avg(label), 6) AS accuracy, round(avg(score), 6) AS confidence FROM quality GROUP BY 1")
def ece_bins(spark, sf):
    return metrics.reliability(_quality(spark, sf)).select("bin", "n", r6("accuracy"), r6("confidence"))


@query(f"""WITH {_QUALITY}, b AS (SELECT lang, {S.bin10('score')} AS bin, count(*) AS n, avg(label) AS a, avg(score) AS c FROM quality GROUP BY ALL)
SELECT lang, round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b GROUP BY lang""")
def calibration_error(spark, sf):
    return metrics.calibration_error(_quality(spark, sf), "lang").select("lang", r6("ece"))


@query(f"WITH {_QUALITY} SELECT lang, round(avg((score - label) * (score - label)), 6) AS brier FROM quality GROUP BY lang")
def brier(spark, sf):
    return metrics.brier(_quality(spark, sf), "lang").select("lang", r6("brier"))


def _with_base_rate(s: DataFrame) -> DataFrame:
    """``s`` with the mean label of all its rows, as part of one plan."""
    return s.crossJoin(F.broadcast(s.agg(F.coalesce(F.avg("label"), F.lit(0.0)).alias("base_rate"))))  # one row


@query(f"""WITH RECURSIVE {S.SCORED}, g AS (SELECT avg(label) AS t FROM scored), r AS (SELECT trajectory_id, min(step_index) FILTER (WHERE score >= t) AS first, max(step_index) AS length FROM scored, g WHERE NOT final_success GROUP BY trajectory_id)
SELECT round(coalesce(avg(coalesce(first, length) / length), 1.0), 6) AS latency, count(*) AS failed_runs FROM r""")
def detection_latency(spark, sf):
    s = _with_base_rate(tables.scored(spark, sf))
    return metrics.detection_latency(s, F.col("base_rate")).select(r6("latency"), "failed_runs")


_COVER = "cover AS (SELECT count(*) AS prefixes, count(*) FILTER (WHERE support >= {m}) AS trusted_prefixes, count(DISTINCT state) FILTER (WHERE support >= {m}) AS trusted_states FROM {t}), ok AS (SELECT * FROM {t} WHERE support >= {m})"


def _trusted_sql(table: str, least: int) -> str:
    return f"""{_COVER.format(t=table, m=least)}, {S.auroc_ap('ok')}, b AS (SELECT {S.bin10('score')} AS bin, count(*) AS n, avg(label) AS a, avg(score) AS c FROM ok GROUP BY 1)
SELECT prefixes, trusted_prefixes, trusted_states, round(1 - trusted_prefixes / prefixes, 6) AS abstention, positives AS trusted_positives, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc,
  (SELECT round(sum(n * abs(a - c)) / sum(n), 6) FROM b) AS ece, (SELECT round(avg((score - label) * (score - label)), 6) FROM ok) AS brier FROM cover, area"""


_TRUST = 10
_TRUST_COLUMNS = ("prefixes", "trusted_prefixes", "trusted_states", "abstention", "trusted_positives", "auroc", "auprc", "ece", "brier")


def _trust_row(m: DataFrame) -> DataFrame:
    return m.select(*(r6(c) if c in ("abstention", "auroc", "auprc", "ece", "brier") else c for c in _TRUST_COLUMNS))


@query(f"WITH RECURSIVE {S.SCORED}, {_trusted_sql('scored', _TRUST)}")
def trusted_metrics(spark, sf):
    return _trust_row(metrics.trusted_metrics(tables.scored(spark, sf), _TRUST))


_SOFT = "soft AS (SELECT trajectory_id, step_index, label, state, support, (CASE WHEN event_type = 'error' THEN 0.7 ELSE 0.2 END + step_index / n_steps * 0.2) AS score FROM scored)"


def _soft(s: DataFrame) -> DataFrame:
    return s.withColumn("score", F.when(F.col("event_type") == "error", 0.7).otherwise(0.2) + F.col("step_index") / F.col("n_steps") * 0.2)


@query(f"WITH RECURSIVE {S.SCORED}, {_SOFT}, {_trusted_sql('soft', _TRUST)}")
def matched_coverage(spark, sf):
    s = tables.scored(spark, sf)
    return _trust_row(metrics.matched_coverage(_soft(s).select("trajectory_id", "step_index", "label", "score"), s, _TRUST))


@query(f"""WITH RECURSIVE {S.SCORED}, {_SOFT}, p AS (SELECT s.score AS soft, c.score AS discrete, s.label FROM soft s JOIN scored c USING (trajectory_id, step_index)),
a AS (SELECT soft AS score, label FROM p), {S.auroc_ap('a').replace('sums', 'sums1').replace('swept', 'swept1').replace('area', 'area1')},
d AS (SELECT discrete AS score, label FROM p), {S.auroc_ap('d')}
SELECT round(avg(CAST((soft >= 0.05) = (discrete >= 0.05) AS INTEGER)), 6) AS agreement, round(avg(abs(soft - discrete)), 6) AS l1,
  (SELECT round(auroc, 6) FROM area1) AS soft_auroc, (SELECT round(auroc, 6) FROM area) AS discrete_auroc, round(abs((SELECT auroc FROM area1) - (SELECT auroc FROM area)), 6) AS auroc_gap FROM p""")
def faithfulness(spark, sf):
    s = tables.scored(spark, sf)
    pairs = _soft(s).select("trajectory_id", "step_index", "label", F.col("score").alias("soft")).join(s.select("trajectory_id", "step_index", F.col("score").alias("discrete")), ["trajectory_id", "step_index"])
    return metrics.faithfulness(pairs, 0.05).select(*(r6(c) for c in ("agreement", "l1", "soft_auroc", "discrete_auroc", "auroc_gap")))


@query(f"""WITH RECURSIVE {S.SCORED}, t AS (SELECT *, string_agg(symbol, ',') OVER (PARTITION BY trajectory_id ORDER BY step_index ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS tail FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY label DESC, n_steps - step_index, trajectory_id, step_index) AS rank FROM t)
SELECT CAST(state AS INTEGER) AS state, rank, trajectory_id, step_index, label, tail FROM r WHERE rank <= 3""")
def state_exemplars(spark, sf):
    e = explain.state_exemplars(tables.scored(spark, sf))
    return e.select("state", "rank", "trajectory_id", "step_index", "label", F.array_join(F.transform("tail", lambda x: x.cast("string")), ",").alias("tail"))


@query(f"""WITH RECURSIVE {S.SCORED}, a AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY step_index) AS k FROM scored WHERE score >= (SELECT avg(label) FROM scored)),
r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY step_index / n_steps, trajectory_id) AS rank FROM a WHERE k = 1) SELECT CAST(state AS INTEGER) AS state, rank, trajectory_id, step_index FROM r WHERE rank <= 3""")
def first_warnings(spark, sf):
    s = _with_base_rate(tables.scored(spark, sf))
    return explain.first_warnings(s, F.col("base_rate")).select("state", "rank", "trajectory_id", "step_index")


@query("""WITH e AS (SELECT user_id % 20 AS run, unnest([1, 2, 3]) AS seed FROM (SELECT DISTINCT user_id FROM events)), x AS (SELECT DISTINCT run, seed FROM e),
r AS (SELECT user_id % 20 AS run, event_id % 4 AS seed, avg(value) AS m FROM events GROUP BY ALL)
SELECT x.run, count(r.m) AS finished, count(*) - count(r.m) AS missing, round(avg(r.m), 6) AS m_mean, round(stddev_samp(r.m), 6) AS m_std FROM x LEFT JOIN r ON x.run = r.run AND x.seed = r.seed GROUP BY x.run""")
def seed_aggregate(spark, sf):
    e = tables.read(spark, sf, "events", "user_id", "event_id", "value").withColumn("run", F.col("user_id") % 20)
    expected = e.select("run").distinct().select("run", F.explode(F.lit([1, 2, 3])).alias("seed"))
    results = e.groupBy("run", (F.col("event_id") % 4).alias("seed")).agg(F.avg("value").alias("m"))
    return metrics.seed_summary(results, expected, "m").select("run", "finished", "missing", r6("m_mean"), r6("m_std"))


# --- models ----------------------------------------------------------------------------------------------------------

_FSM = models.SoftFsm.fixed(3, tables.SYMBOLS)


def _soft_sql() -> str:
    """CTE soft (trajectory_id, step_index, score) of the fixed automaton: a step's matrix is (1 - peak) / 4 times the sum of
    all symbols' matrices and the rest of the peak times that of its own."""
    a, start = _FSM.transitions(), models.softmax(_FSM.start)
    q = range(len(start))
    rows = ", ".join(f"({k}, {', '.join(repr(float(a[k][i][j])) for i in q for j in q)})" for k in range(len(a)))
    names = ", ".join(f"a{i}{j}" for i in q for j in q)
    cell = lambda i, j: f"((1 - peak) / 4.0::DOUBLE * {float(a[:, i, j].sum())!r}::DOUBLE + (peak - (1 - peak) / 4.0::DOUBLE) * a{i}{j}::DOUBLE)"
    new = [" + ".join(f"s{i} * m{i}{j}" for i in q) for j in q]
    first = [" + ".join(f"{float(start[i])!r}::DOUBLE * m{i}{j}" for i in q) for j in q]
    score = " + ".join(f"s{i} * {float(_FSM.w[i])!r}::DOUBLE" for i in q)
    return f"""trans AS (SELECT * FROM (VALUES {rows}) t(symbol, {names})),
mats AS (SELECT p.trajectory_id, p.step_index, p.n_steps, {", ".join(f"{cell(i, j)} AS m{i}{j}" for i in q for j in q)} FROM probs p JOIN trans USING (symbol)),
pushed AS (SELECT trajectory_id, step_index, {", ".join(f"{x} AS s{j}" for j, x in enumerate(first))} FROM mats WHERE step_index = 1
  UNION ALL SELECT m.trajectory_id, m.step_index, {", ".join(new)} FROM pushed p JOIN mats m ON m.trajectory_id = p.trajectory_id AND m.step_index = p.step_index + 1),
soft AS (SELECT trajectory_id, step_index, 1 / (1 + exp(-({score} + {_FSM.b!r}::DOUBLE))) AS score FROM pushed)"""


@query(f"WITH RECURSIVE {_PROBS}, {_soft_sql()} SELECT trajectory_id, step_index, round(score, 6) AS score FROM soft")
def soft_fsm_scores(spark, sf):
    """Risk after each step under a fixed soft automaton."""
    return models.soft_fsm_scores(tables.probabilities(spark, sf), _FSM).select("trajectory_id", "step_index", r6("score"))


@query(f"""WITH {_PROBS}, m AS (SELECT trajectory_id, step_index, {', '.join(f"avg(CASE WHEN symbol = {k} THEN peak ELSE (1 - peak) / 4 END) OVER w AS p{k}" for k in range(5))} FROM probs WINDOW w AS (PARTITION BY trajectory_id ORDER BY step_index))
SELECT trajectory_id, step_index, {', '.join(f"round(p{k}, 6) AS p{k}" for k in range(5))} FROM m""")
def flat_prefix_average(spark, sf):
    p = models.prefix_average(tables.probabilities(spark, sf), tables.SYMBOLS)
    return p.select("trajectory_id", "step_index", *(F.round(F.get("mean_probs", k), 6).alias(f"p{k}") for k in range(tables.SYMBOLS)))


@query(f"WITH {_PROBS}, q AS (SELECT symbol, -(peak * ln(peak) + (1 - peak) * ln((1 - peak) / 4)) AS h FROM probs), m AS (SELECT {', '.join(f'avg(CASE WHEN symbol = {k} THEN peak ELSE (1 - peak) / 4 END) AS p{k}' for k in range(5))} FROM probs)"
       f" SELECT round((SELECT avg(h) FROM q) + ({' + '.join(f'p{k} * ln(p{k})' for k in range(5))}), 6) AS loss FROM m")
def compactness_loss(spark, sf):
    return models.compactness_loss(tables.probabilities(spark, sf), tables.SYMBOLS).select(r6("loss"))


# --- joins and set operations ----------------------------------------------------------------------------------------


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def orphans_anti(spark, sf):
    """Customers without an urgent order (every customer has some order)."""
    urgent = tables.read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return tables.read(spark, sf, "customer", "c_custkey").join(urgent, "c_custkey", "left_anti")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def manifest_semi(spark, sf):
    manifest = tables.read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return tables.read(spark, sf, "orders", "o_orderkey", "o_custkey").join(manifest, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c.c_custkey, count(o.o_orderkey) AS n_orders, count(o.o_orderkey) = 0 AS missing FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
def manifest_left(spark, sf):
    n = tables.read(spark, sf, "orders", "o_custkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    c = tables.read(spark, sf, "customer", "c_custkey").join(n, "c_custkey", "left")
    return c.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.col("n").isNull().alias("missing"))


# --- additions beyond the batch engine -------------------------------------------------------------------------------


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n_steps, min(ts) AS started_at, arg_max(event_type, (ts, event_id)) AS last_event FROM s GROUP BY user_id, session""")
def session_trajectories(spark, sf):
    from tracewarden.streaming.monitor import sessions

    return sessions(tables.read(spark, sf, "events", "user_id", "event_id", "ts", "event_type"), gap_hours=6)
