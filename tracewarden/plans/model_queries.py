"""Queries of evaluators, restored vocabularies, sequences, noise and sinks, with their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.functions import jsons
from tracewarden.operators import automata, cleaning, descent, features, merging, metrics, models, networks, prefixes, recurrent, sequences, symbols
from tracewarden.operators.prefixes import failure_label
from tracewarden.plans import pipelines, scratch, tables
from tracewarden.plans import sql as S
from tracewarden.plans.catalogue import _DAYS, _FSM, _GRAMS, _LEAKY, _PROBS, _QUALITY, _day_traces, _leaky, _quality, _soft_sql, query, r6
from tracewarden.sources import canonical

# --- evaluators ------------------------------------------------------------------------------------------------------

_ROW = ("n", "positives", "auroc", "auprc", "ece", "brier", "threshold", "alerts", "true_alerts", "latency", "failed_runs")


def _evaluated(cal: str, held: str) -> str:
    """SQL: one row of metrics of table ``held`` at the threshold of table ``cal``."""
    return f"""csum AS (SELECT score, sum(label) AS pos, count(*) AS n FROM {cal} GROUP BY score), ccum AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS alerts, sum(pos) OVER () AS p FROM csum),
cf AS (SELECT score, tp / greatest(alerts, 1) AS pr, tp / greatest(p, 1) AS re FROM ccum), cbest AS (SELECT score AS threshold FROM cf ORDER BY CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END DESC, score LIMIT 1),
{S.auroc_ap(held)}, hb AS (SELECT {S.bin10('score')} AS bin, count(*) AS n, avg(label) AS a, avg(score) AS c FROM {held} GROUP BY 1),
lat AS (SELECT trajectory_id, min(step_index) FILTER (WHERE score >= threshold) AS first, max(step_index) AS length FROM {held}, cbest WHERE NOT final_success GROUP BY trajectory_id)
SELECT n, positives, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, (SELECT round(sum(n * abs(a - c)) / sum(n), 6) FROM hb) AS ece, (SELECT round(avg((score - label) * (score - label)), 6) FROM {held}) AS brier, round(threshold, 6) AS threshold,
  (SELECT count(*) FROM {held}, cbest WHERE score >= threshold) AS alerts, (SELECT count(*) FROM {held}, cbest WHERE score >= threshold AND label = 1) AS true_alerts,
  (SELECT round(coalesce(avg(coalesce(first, length) / length), 1.0), 6) FROM lat) AS latency, (SELECT count(*) FROM lat) AS failed_runs FROM area, cbest"""


def _tidy(row):
    return row.select(*(r6(c) if c in ("auroc", "auprc", "ece", "brier", "threshold", "latency") else c for c in _ROW))


@query(f"WITH RECURSIVE {_PROBS}, {_soft_sql()}, lab AS (SELECT trajectory_id, step_index, final_success, CAST(NOT final_success AND n_steps - step_index <= 3 AS INTEGER) AS label FROM steps), rated AS (SELECT * FROM lab JOIN soft USING (trajectory_id, step_index)), "
       f"cal AS (SELECT * FROM rated WHERE trajectory_id % 2 = 0), held AS (SELECT * FROM rated WHERE trajectory_id % 2 = 1), {_evaluated('cal', 'held')}")
def soft_monitor_evaluation(spark, sf):
    """A soft automaton's threshold from one half of the users, its metrics on the other."""
    p = tables.probabilities(spark, sf).withColumn("label", failure_label(tables.HORIZON))
    return _tidy(pipelines.evaluate_soft_monitor(p.where("trajectory_id % 2 = 0"), p.where("trajectory_id % 2 = 1"), _FSM))


@query(f"""WITH RECURSIVE {S.REPLAYED}, calp AS (SELECT * FROM replayed WHERE trajectory_id % 2 = 0),
crisk AS (SELECT s.state, (coalesce(f, 0) + 5.0 * g) / (coalesce(n, 0) + 5.0) AS score FROM (SELECT unnest(range(6)) AS state) s LEFT JOIN (SELECT state, count(*) AS n, sum(label) AS f FROM calp GROUP BY state) c ON s.state = c.state CROSS JOIN (SELECT avg(label) AS g FROM calp)),
every AS (SELECT r.*, k.score FROM replayed r JOIN crisk k ON r.state = k.state), cal AS (SELECT * FROM every WHERE trajectory_id % 2 = 0), held AS (SELECT * FROM every WHERE trajectory_id % 2 = 1), {_evaluated('cal', 'held')}""")
def discrete_monitor_evaluation(spark, sf):
    """An automaton's state risks and threshold from one half of the users, its metrics on the other."""
    s = tables.steps(spark, sf)
    return _tidy(pipelines.evaluate_automaton(tables.monitor(), s.where("trajectory_id % 2 = 0"), s.where("trajectory_id % 2 = 1"), tables.HORIZON))


@query(f"WITH {_QUALITY}, {S.auroc_ap('quality', 'lang')} SELECT lang, n AS size_n, positives AS size_positives, round(auroc, 6) AS ranking_area_auroc, round(auprc, 6) AS ranking_area_auprc FROM area")
def flat_metric_summary(spark, sf):
    """A10: a nested summary as flat columns."""
    m = metrics.ranking_metrics(_quality(spark, sf), "lang")
    nested = m.select("lang", F.struct("n", "positives").alias("size"), F.struct(F.struct(r6("auroc"), r6("auprc")).alias("area")).alias("ranking"))
    return metrics.flat_summary(nested)


_PARITY = f"""{S.STEPS}, days AS (SELECT trajectory_id % 2 AS half, string_agg(symbol, ',' ORDER BY step_index) AS symbols, count(*) FILTER (WHERE event_type = 'error') % 2 = 0 AS even FROM steps GROUP BY trajectory_id, CAST(ts AS DATE))"""


def _parity_traces(spark, sf):
    """Distinct traces of days by half of the users; positive: an even number of errors. Two states tell them apart."""
    s = tables.steps(spark, sf).withColumn("day", F.to_date("ts"))
    d = s.groupBy("trajectory_id", "day").agg(F.array_sort(F.collect_list(F.struct("step_index", "symbol"))).alias("x"), (F.count_if(F.col("event_type") == "error") % 2 == 0).alias("positive"))
    return d.select((F.col("trajectory_id") % 2).alias("half"), F.transform("x", lambda e: e["symbol"].cast("int")).alias("symbols"), "positive").distinct()


@query(f"""WITH {S.STEPS}, a AS (SELECT row_number() OVER (ORDER BY event_type) - 1 AS symbol, event_type = 'error' AS turns FROM (SELECT DISTINCT event_type FROM steps)), q AS (SELECT unnest(range(3)) AS state)
SELECT CAST(state AS INTEGER) AS state, CAST(symbol AS INTEGER) AS symbol, CAST(CASE WHEN state = 2 THEN 2 WHEN turns THEN 1 - state ELSE state END AS INTEGER) AS next_state, state = 0 AS accepting FROM q, a""")
def automaton_edges(spark, sf):
    """D3: the complete automaton that merging learns from all day traces, as rows (state 2 is the sink)."""
    traces = _parity_traces(spark, sf).select("symbols", "positive").distinct()
    dfa = merging.learn_frame(traces, tables.SYMBOLS)
    return dfa.edges(spark).join(dfa.states(spark).drop("rejecting"), "state")


@query(f"""WITH {_PARITY}, d AS (SELECT DISTINCT half, symbols, even FROM days), f AS (SELECT symbols FROM d WHERE half = 0), h AS (SELECT DISTINCT symbols FROM d WHERE half = 1 AND symbols NOT IN (SELECT symbols FROM f)),
t AS (SELECT string_split(symbols, ',') AS t FROM f), p AS (SELECT DISTINCT t[1:k] AS p FROM (SELECT t, unnest(range(0, len(t) + 1)) AS k FROM t))
SELECT 3 AS state_count, (SELECT count(*) FROM p) AS prefix_tree_states, (SELECT count(*) FROM f) AS traces, count(*) AS unseen_traces, count(*) AS unseen_right FROM h""")
def merged_states_and_unseen_traces(spark, sf):
    """Merging over rows, learned from half of the users and held against the other half's new traces."""
    t = scratch.written(_parity_traces(spark, sf), "traces")
    fit, held = t.where("half = 0").select("symbols", "positive"), t.where("half = 1").select("symbols", "positive")
    dfa = merging.learn_frame(fit, tables.SYMBOLS, "edsm")
    unseen = held.join(fit, "symbols", "left_anti").withColumn("states", automata.replay(F.col("symbols"), dfa))
    right = F.array_contains(F.lit(sorted(dfa.accepting)), F.element_at("states", -1)) == F.col("positive")
    counts = unseen.agg(F.count(F.lit(1)).alias("unseen_traces"), F.count_if(right).alias("unseen_right"))
    tree = automata.prefix_tree(fit).agg(F.count(F.lit(1)).alias("prefix_tree_states")).crossJoin(fit.agg(F.count(F.lit(1)).alias("traces")))  # one row each
    return counts.crossJoin(tree).select(F.lit(len(dfa.delta)).alias("state_count"), "prefix_tree_states", "traces", "unseen_traces", "unseen_right")


_DAY_RUNS = f"""{S.STEPS}, dr AS (SELECT trajectory_id % 2 AS half, trajectory_id || ':' || CAST(ts AS DATE) AS trajectory_id, step_index AS pos, CAST(event_type = 'error' AS INTEGER) AS e FROM steps),
dw AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY pos) AS step_index, count(*) OVER (PARTITION BY trajectory_id) AS n_steps, sum(e) OVER (PARTITION BY trajectory_id ORDER BY pos) % 2 AS state, sum(e) OVER (PARTITION BY trajectory_id) % 2 = 1 AS final_success FROM dr),
dl AS (SELECT *, CAST(NOT final_success AND n_steps - step_index <= 3 AS INTEGER) AS label FROM dw),
risk AS (SELECT state, (sum(label) + 5.0 * any_value(g)) / (count(*) + 5.0) AS score FROM dl, (SELECT avg(label) AS g FROM dl WHERE half = 0) WHERE half = 0 GROUP BY state),
every AS (SELECT dl.*, risk.score FROM dl JOIN risk ON dl.state = risk.state), cal AS (SELECT * FROM every WHERE half = 0), held AS (SELECT * FROM every WHERE half = 1)"""


@query(f"WITH {_DAY_RUNS}, {_evaluated('cal', 'held')}".replace("(SELECT count(*) FROM lat) AS failed_runs", "3 AS state_count"))
def learned_monitor_evaluation(spark, sf):
    """An automaton learned from the days of half of the users, its risks and threshold from them, its metrics on
    the other half. A day fails by an even number of errors, so two states and a sink are to be learned."""
    e = tables.steps(spark, sf).withColumn("day", F.to_date("ts"))
    by_day = W.partitionBy("trajectory_id", "day")
    s = e.withColumns({"at": F.row_number().over(by_day.orderBy("step_index")), "n_steps": F.count(F.lit(1)).over(by_day), "final_success": F.count_if(F.col("event_type") == "error").over(by_day) % 2 == 1})
    s = s.select((F.col("trajectory_id") % 2).alias("half"), F.concat_ws(":", "trajectory_id", "day").alias("trajectory_id"), F.col("at").alias("step_index"), "n_steps", "final_success", "symbol")
    s = scratch.written(s, "days")
    fit, held = (s.where(F.col("half") == h).drop("half") for h in (0, 1))
    m = pipelines.evaluate_monitor(fit, fit, held, tables.SYMBOLS, tables.HORIZON, "aalpy")["metrics"]
    row = spark.createDataFrame([tuple(m[c] for c in (*_ROW[:-1], "state_count"))], "n long, positives long, auroc double, auprc double, ece double, brier double, threshold double, alerts long, true_alerts long, latency double, state_count int")
    return row.select(*(r6(c) if c in ("auroc", "auprc", "ece", "brier", "threshold", "latency") else c for c in row.columns))


def _gradient_sql() -> str:
    score = " + ".join(f"s{i} * {float(w)!r}::DOUBLE" for i, w in enumerate(_FSM.w))
    each = f"SELECT s0, s1, s2, 1 / (1 + exp(-({score} + {_FSM.b!r}::DOUBLE))) AS score, CAST(NOT final_success AND n_steps - step_index <= 3 AS INTEGER) AS label FROM pushed JOIN steps USING (trajectory_id, step_index)"
    rows = [("loss", "avg(-(label * ln(score) + (1 - label) * ln(1 - score)))"), ("b", "avg(score - label)"), *((f"w{i}", f"avg((score - label) * s{i})") for i in range(3))]
    return f"{_soft_sql()}, each AS ({each}) " + " UNION ALL ".join(f"SELECT '{n}' AS parameter, round({e}, 6) AS value FROM each" for n, e in rows)


@query(f"WITH RECURSIVE {_PROBS}, {_gradient_sql()}")
def training_gradient(spark, sf):
    """One round of training on the executors: loss of the soft automaton and its gradient by the risk layer. The
    symbolizer's layers are set so that gelu(x) - gelu(-x) = x hands on the probabilities."""
    k = tables.SYMBOLS
    eye = np.eye(k)
    params = {"in_w": np.hstack([eye, -eye]), "in_b": np.zeros(2 * k), "out_w": np.hstack([eye, -eye]), "out_b": np.zeros(k)}
    params |= {"logits": _FSM.logits, "start": _FSM.start, "w": _FSM.w, "b": np.array(_FSM.b)}
    s = tables.probabilities(spark, sf).withColumns({"label": failure_label(tables.HORIZON), "places": F.sequence(F.lit(0), F.lit(k - 1)), "features": F.transform("probs", lambda p: F.log(p))})
    table = descent.groups(s.select("trajectory_id", "step_index", "places", "features", "label"))
    settings = networks.Settings("soft-fsm", k, compact_weight=0.0, noisy=False)
    r = descent.round_sizes(table, params, settings, 1.0, 1)
    loss, grad = descent.round_gradient(table, params, r, settings, (1.0, _FSM.temperature), 1)
    rows = [("loss", loss), ("b", float(grad["b"])), *((f"w{i}", float(x)) for i, x in enumerate(grad["w"]))]
    return spark.createDataFrame(rows, "parameter string, value double").select("parameter", r6("value"))


@query(f"WITH {_DAYS} SELECT count(*) AS traces, count(DISTINCT symbols) AS distinct_traces FROM days WHERE symbols IS NOT NULL")
def distinct_trace_counts(spark, sf):
    """Traces and the distinct ones among them, by partial aggregates."""
    d = _day_traces(spark, sf).groupBy("symbols").agg(F.count(F.lit(1)).alias("n"))
    return d.agg(F.sum("n").alias("traces"), F.count(F.lit(1)).alias("distinct_traces"))


# --- features and sequences ------------------------------------------------------------------------------------------


@query(f"""WITH half AS (SELECT * FROM documents WHERE lang = 'en'), {_GRAMS.format(key='doc_id', table='half').replace('counts AS', 'fitted AS').replace('FROM counts', 'FROM fitted')},
tok2 AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM documents), terms2 AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM tok2),
counts2 AS (SELECT doc_id, term, count(*) AS tf FROM terms2 GROUP BY ALL), v AS (SELECT doc_id, term, tf * idf AS raw FROM counts2 JOIN vocab USING (term))
SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS value FROM v""")
def restored_vocabulary_vectors(spark, sf):
    """a vocabulary fitted on the texts of one language, written, restored and applied to all."""
    d = tables.read(spark, sf, "documents", "doc_id", "text", "lang")
    fit = d.where("lang = 'en'")
    path = scratch.folder(spark, "vocabulary")
    features.write_vocabulary(features.tfidf_vocabulary(features.leading_counts(fit, "doc_id"), fit.count()), path, max_features=features.MAX_FEATURES, grams=(1, 2))
    vocabulary, parameters = features.read_vocabulary(spark, path)
    assert parameters == {"max_features": features.MAX_FEATURES, "grams": (1, 2)}
    return features.transform(d, vocabulary, "doc_id").select("doc_id", "term", r6("value"))


@query("""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS c FROM documents), t AS (SELECT count(*) AS n, sum(c) AS c FROM d)
SELECT x.doc_id, x.c AS n_chars FROM (SELECT *, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) AS r FROM d) x, t WHERE t.c <= 400000 OR r <= greatest(1, t.n * 400000 // t.c)""")
def budgeted_fit_sample(spark, sf):
    """the rows on which a vocabulary is fitted under a budget of characters."""
    d = tables.read(spark, sf, "documents", "doc_id", "text")
    return features.fit_sample(d, "doc_id", "text", 400_000).select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


@query("SELECT coalesce(lang, '') AS lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def summary_round_trip(spark, sf):
    """K2: a small summary written as sorted JSON and read again."""
    d = tables.read(spark, sf, "documents", "lang", "n_chars").groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").cast("long").alias("chars"))
    text = canonical.summary_json(d)
    back = spark.createDataFrame([(text if text.startswith("[") else f"[{text}]",)], "t string").select(F.explode(F.from_json("t", "array<struct<lang: string, n: long, chars: long>>")).alias("r"))
    return back.select("r.*")


@query("""SELECT doc_id, length(t) AS n_chars, CASE WHEN length(t) > 2048 THEN 2048 ELSE length(t) END AS kept_chars, length(t) > 2048 AS cut, CASE WHEN length(t) > 2048 THEN t[1:20] || t[-20:] ELSE '' END AS ends FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def bounded_fragments(spark, sf):
    """Source fragments whose long strings keep both ends around a marker, with their counts."""
    import json

    @F.pandas_udf("struct<kept: string, cut: int>")
    def bound(texts: pd.Series) -> pd.DataFrame:
        out = [json.loads(jsons.raw_fragment({"text": t})) for t in texts]
        return pd.DataFrame({"kept": [x["text"] for x in out], "cut": [x.get("source_raw_truncation", {}).get("string_values", 0) for x in out]})

    d = tables.read(spark, sf, "documents", "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("b", bound("t"))
    ends = F.when(F.col("b.cut") > 0, F.concat(F.substring("b.kept", 1, 20), F.substring("b.kept", -20, 20))).otherwise("")
    return d.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.length("b.kept").cast("long").alias("kept_chars"), (F.col("b.cut") == 1).alias("cut"), ends.alias("ends"))


@query("""WITH t AS (SELECT unnest(['a=' || event_type, 'b=' || (user_id % 5)]) AS token FROM events UNION ALL SELECT 'a=' || role FROM conversations), d AS (SELECT DISTINCT token FROM t)
SELECT token, row_number() OVER (ORDER BY token) - 1 AS "column" FROM d""")
def union_vocabulary(spark, sf):
    """The union of two token sets, numbered in order."""
    e = tables.read(spark, sf, "events", "event_type", "user_id").select(F.explode(F.array(F.concat(F.lit("a="), "event_type"), F.concat(F.lit("b="), (F.col("user_id") % 5).cast("string")))).alias("token"))
    return features.numbered(e.union(tables.read(spark, sf, "conversations", "role").select(F.concat(F.lit("a="), "role"))))


@query(f"""WITH {S.PREFIXES}, s AS (SELECT trajectory_id, step_index, label, value, CAST(symbol AS DOUBLE) AS symbol FROM prefixes), n AS (SELECT trajectory_id, count(*) AS n FROM s GROUP BY 1), g AS (SELECT trajectory_id, n, unnest(range(1, 257)) AS i FROM n)
SELECT g.trajectory_id, CAST(g.i AS INTEGER) AS position, coalesce(round(value, 6), 0.0) AS v0, coalesce(symbol, 0.0) AS v1, g.i <= g.n AS mask, CAST(coalesce(label, -1) AS INTEGER) AS label FROM g LEFT JOIN s ON s.trajectory_id = g.trajectory_id AND s.step_index = g.i""")
def padded_sequences(spark, sf):
    """F8, M8: each run as one matrix of 256 rows, with masks; the length is the operator's parameter."""
    s = tables.steps(spark, sf).withColumn("label", failure_label(tables.HORIZON)).withColumn("v", F.array(F.round("value", 6), F.col("symbol").cast("double")))
    r = sequences.run_sequences(s, "v").select("trajectory_id", sequences.padded(F.col("vectors"), 256, 2).alias("p"), sequences.mask(F.col("vectors"), 256).alias("m"), "labels")
    x = r.select("trajectory_id", "labels", F.posexplode(F.arrays_zip("p", "m")).alias("at", "z"))
    return x.select("trajectory_id", (F.col("at") + 1).alias("position"), F.get("z.p", 0).alias("v0"), F.get("z.p", 1).alias("v1"), F.col("z.m").alias("mask"), F.coalesce(F.get("labels", F.col("at")), F.lit(-1)).cast("int").alias("label"))


@query(f"""WITH {S.TURNS} SELECT trajectory_id, step_index, string_agg(text, chr(10) || '<STEP_BOUNDARY>' || chr(10)) OVER (PARTITION BY trajectory_id ORDER BY step_index) AS document FROM turns""")
def prefix_documents(spark, sf):
    """The text of every prefix."""
    return prefixes.prefix_documents(tables.turns(spark, sf)).select("trajectory_id", "step_index", "document")


_NOISE = "CAST('0x' || substr(sha256('1:' || vec_id || ':' || k), 1, 13) AS UBIGINT)::DOUBLE"


@query(f"""WITH z AS (SELECT vec_id, k, embedding[k + 1]::DOUBLE AS x FROM embeddings, (SELECT CAST(unnest(range(8)) AS INTEGER) AS k)),
g AS (SELECT vec_id, k, (x - ln(-ln(({_NOISE} + 0.5) / 4503599627370496.0::DOUBLE))) / 0.5::DOUBLE AS y FROM z), e AS (SELECT *, exp(y - max(y) OVER (PARTITION BY vec_id)) AS e FROM g)
SELECT vec_id, k AS symbol, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS weight FROM e""")
def gumbel_softmax_samples(spark, sf):
    """Y2: samples with noise by row key."""
    v = tables.read(spark, sf, "embeddings", "vec_id", "embedding").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 8).alias("logits"))
    return symbols.gumbel_softmax(v, ["vec_id"], temperature=0.5).select("vec_id", F.posexplode("sample").alias("symbol", "weight")).select("vec_id", "symbol", r6("weight"))


_BASELINE = sequences.Mlp(np.array([[((2 * k + 3 * j) % 7 - 3) / 4 for j in range(64)] for k in range(4)]), np.array([0.5, -0.25, 0.0, 0.25]), np.array([1.0, -1.0, 0.5, 0.75]), -0.1)


@query("""WITH h AS (SELECT vec_id, list_transform(range(4), lambda k: greatest(0, list_sum(list_transform(range(64), lambda j: embedding[j + 1]::DOUBLE * ((2 * k + 3 * j) % 7 - 3) / 4.0::DOUBLE)) + [0.5, -0.25, 0.0, 0.25][k + 1])) AS h FROM embeddings)
SELECT vec_id, round(1 / (1 + exp(-(h[1] - h[2] + 0.5 * h[3] + 0.75 * h[4] - 0.1))), 6) AS score FROM h""")
def baseline_scores(spark, sf):
    """M7, M9, K5: a network baseline written with its scores and metrics, read back and applied."""
    v = tables.read(spark, sf, "embeddings", "vec_id", "embedding")
    path = scratch.folder(spark, "baseline")
    sequences.write_baseline(path, _BASELINE, v.select("vec_id"), v.agg(F.count(F.lit(1)).alias("n")), spark)
    return sequences.read_baseline(spark, path).transform(v, "embedding").select("vec_id", r6("score"))


@query("""SELECT vec_id, CAST(k AS INTEGER) AS position, round(list_sum(list_transform(range(16), lambda j: embedding[j + 1]::DOUBLE * ((k + j) % 5 - 2))) + k, 6) AS value FROM embeddings, (SELECT unnest(range(3)) AS k)""")
def hybrid_projection(spark, sf):
    """two vector columns side by side through one linear map."""
    v = tables.read(spark, sf, "embeddings", "vec_id", "embedding").withColumn("e", F.col("embedding").cast("array<double>"))
    v = v.select("vec_id", F.slice("e", 1, 8).alias("a"), F.slice("e", 9, 8).alias("b"))
    out = sequences.hybrid(["a", "b"], np.array([[(k + j) % 5 - 2.0 for j in range(16)] for k in range(3)]), np.arange(3.0))
    return v.select("vec_id", F.posexplode(out).alias("position", "value")).select("vec_id", "position", r6("value"))


def _vectors(spark, sf):
    return tables.read(spark, sf, "embeddings", "vec_id", "embedding").withColumn("e", F.col("embedding").cast("array<double>"))


@query("""WITH u AS (SELECT vec_id // 32 AS batch, vec_id AS id, vec_id % 4 AS label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM u),
p AS (SELECT a.batch, a.id, a.label = b.label AS same, list_sum(list_transform(range(64), lambda j: a.e[j + 1] * b.e[j + 1])) / (a.n * b.n) / 0.1::DOUBLE AS s FROM n a JOIN n b ON a.batch = b.batch AND a.id <> b.id),
g AS (SELECT batch, id, avg(s) FILTER (WHERE same) AS near, ln(sum(exp(s - 10.0::DOUBLE))) + 10.0::DOUBLE AS whole FROM p GROUP BY ALL) SELECT round(avg(whole - near), 6) AS loss FROM g WHERE near IS NOT NULL""")
def contrastive_batches(spark, sf):
    """The supervised contrastive loss over batches of 32 vectors."""
    v = _vectors(spark, sf).select(F.expr("vec_id div 32").alias("batch"), F.col("vec_id").alias("id"), (F.col("vec_id") % 4).alias("label"), F.col("e").alias("vector"))
    return models.batch_contrastive_loss(v).select(r6("loss"))


@query("""WITH z AS (SELECT list_transform(embedding[1:8], lambda x: x::DOUBLE) AS z, list_transform(embedding[9:16], lambda x: exp(x::DOUBLE)) AS t FROM embeddings), s AS (SELECT z, list_transform(t, lambda x: x / list_sum(t)) AS q, ln(list_sum(list_transform(z, lambda x: exp(x)))) AS total FROM z)
SELECT round(avg(list_sum(list_transform(range(8), lambda j: -q[j + 1] * (z[j + 1] - total)))), 6) AS loss FROM s""")
def soft_target_cross_entropy(spark, sf):
    """M12."""
    v = _vectors(spark, sf).select(F.slice("e", 1, 8).alias("logits"), symbols.softmax(F.slice("e", 9, 8)).alias("targets"))
    return models.soft_target_loss(v).select(r6("loss"))


_UNIT = recurrent.fresh(tables.SYMBOLS, 1, 1, seed=4)


def _unit_sql() -> str:
    """CTE scored of a recurrent unit with one state: gates by symbol from a table of weights."""
    wx, wh, bx, bh = _UNIT["wx"], _UNIT["wh"][:, 0], _UNIT["bx"], _UNIT["bh"]
    rows = ", ".join(f"({k}, {', '.join(repr(float(wx[g][k])) for g in range(3))})" for k in range(tables.SYMBOLS))
    d = "::DOUBLE"
    gate = [f"((1 - peak) / 4.0{d} * {float(wx[g].sum())!r}{d} + (peak - (1 - peak) / 4.0{d}) * w{g}{d} + {float(bx[g])!r}{d})" for g in range(3)]
    sig = lambda x: f"(1 / (1 + exp(-({x}))))"
    tanh = lambda x: f"(1 - 2 / (exp(2 * ({x})) + 1))"
    push = lambda g, h: f"({float(wh[g])!r}{d} * {h} + {float(bh[g])!r}{d})"

    def after(h: str) -> str:
        r, z = sig(f"m.g0 + {push(0, h)}"), sig(f"m.g1 + {push(1, h)}")
        n = tanh(f"m.g2 + {r} * {push(2, h)}")
        return f"((1 - {z}) * {n} + {z} * {h})"

    return f"""weights AS (SELECT * FROM (VALUES {rows}) t(symbol, w0, w1, w2)), gates AS (SELECT p.trajectory_id, p.step_index, {gate[0]} AS g0, {gate[1]} AS g1, {gate[2]} AS g2 FROM probs p JOIN weights USING (symbol)),
unit AS (SELECT m.trajectory_id, m.step_index, {after(f'0.0{d}')} AS h FROM gates m WHERE step_index = 1 UNION ALL SELECT m.trajectory_id, m.step_index, {after('u.h')} FROM unit u JOIN gates m ON m.trajectory_id = u.trajectory_id AND m.step_index = u.step_index + 1)
SELECT trajectory_id, step_index, round({sig(f'h * {float(_UNIT["w"][0][0])!r}{d} + {float(_UNIT["b"][0])!r}{d}')}, 6) AS score FROM unit"""


@query(f"WITH RECURSIVE {_PROBS}, {_unit_sql()}")
def recurrent_risk_scores(spark, sf):
    """M3, M8: a gated recurrent unit over symbol probabilities, scored for every prefix."""
    return recurrent.risk_scores(tables.probabilities(spark, sf), _UNIT).select("trajectory_id", "step_index", r6("score"))


# --- sinks and summaries ---------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, round(avg(value), 3) AS mean_value FROM events GROUP BY event_type")
def csv_round_trip(spark, sf):
    """K6: a summary written as CSV and read again."""
    e = tables.read(spark, sf, "events", "event_type", "value").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 3).alias("mean_value"))
    path = scratch.folder(spark, "summary")
    canonical.write_csv(e, path)
    return spark.read.option("header", True).schema("event_type string, n long, mean_value double").csv(path)


@query("SELECT lang AS path, true AS found, count(*) AS row_count, lang <> 'fr' AS ok FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def verified_artifacts(spark, sf):
    """K7: files with their line counts and digests; one is expected to have another digest."""
    d = tables.read(spark, sf, "documents", "doc_id", "lang").where("lang IS NOT NULL")
    path = scratch.folder(spark, "artifacts")
    d.select("lang", F.col("doc_id").cast("string").alias("value")).repartition("lang").write.partitionBy("lang").text(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", "(lang=[^/]+/[^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("digest"))
    rows = d.groupBy(F.concat(F.lit("lang="), "lang").alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    named = files.withColumn("part", F.substring_index("path", "/", 1)).join(rows, "part")
    expected = named.select("path", "rows", F.when(F.col("part") == "lang=fr", "0").otherwise(F.upper("digest")).alias("sha256"))
    v = canonical.verify_artifacts(spark, expected, path)
    return v.select(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("path"), "found", "row_count", "ok")


@query(f"""WITH d AS ({_LEAKY}), x AS (SELECT doc_id % 3 AS split, doc_id, doc_id % 50 AS task_id, doc_id % 4 IN (0, 1) AS hit FROM d)
SELECT split, count(DISTINCT doc_id) AS runs, count(DISTINCT task_id) AS tasks, count(*) AS steps, CAST(sum(CAST(hit AS INTEGER)) AS BIGINT) AS affected_fields FROM x GROUP BY split""")
def cleaning_summary(spark, sf):
    """K8: counters of a cleaned frame by split."""
    c = cleaning.clean_steps(_leaky(spark, sf), ["text"]).selectExpr("doc_id % 3 AS split", "doc_id AS trajectory_id", "doc_id % 50 AS task_id", "affected_fields")
    return cleaning.clean_summary(c, "split")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{"a": "\\u00e9", "b": ' || doc_id || '}' WHEN 1 THEN '[1, {"x": null, "y": "\\n"}]' ELSE '"' || doc_id || '"' END AS dumped,
  CASE doc_id % 3 WHEN 0 THEN '{"a":"\\u00e9","b":' || doc_id || '}' WHEN 1 THEN '[1,{"x":null,"y":"\\n"}]' ELSE '"' || doc_id || '"' END AS compact FROM documents""")
def canonical_json_texts(spark, sf):
    """Sorted keys and ASCII escapes."""
    key = F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"b":'), key, F.lit(',"a":"é"}'))).when(F.col("doc_id") % 3 == 1, F.lit('[1,{"y":"\\n","x":null}]')).otherwise(F.concat(F.lit(' "'), key, F.lit('" ')))
    d = tables.read(spark, sf, "documents", "doc_id").withColumn("raw", raw)
    return d.select("doc_id", jsons.canonical_json("raw").alias("dumped"), jsons.canonical_json("raw", compact=True).alias("compact"))
