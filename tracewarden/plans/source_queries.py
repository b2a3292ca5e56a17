"""Queries of the sources and sinks: the driver's rows are put into each format, written where the format is a file, and
read back through the source; the SQL says what must come out, straight from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.plans import scratch, tables
from tracewarden.plans import sql as S
from tracewarden.plans.catalogue import QUERIES, SQL, query
from tracewarden.sources import browser, canonical, committed, dialogue, files, terminal, trials

_N = S.normal


def cut(expr: str, n: int) -> str:
    return f"(CASE WHEN length({expr}) <= {n} THEN {expr} ELSE substr({expr}, 1, {n - 16}) || '...<truncated>' END)"


def _collected(spark, sf, *fields: Column) -> DataFrame:
    """conv_id and its turns in order (structs i, role, text and ``fields``)."""
    t = tables.turns(spark, sf).select(F.col("trajectory_id").alias("conv_id"), F.col("step_index").alias("i"), "role", "text")
    return t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "role", "text", *fields))).alias("turns"))


# --- canonical runs --------------------------------------------------------------------------------------------------


def _canonical_runs(spark, sf) -> DataFrame:
    step = lambda t: F.struct(
        t["role"].alias("context"), t["text"].alias("action_text"), F.when(t["i"] % 2 == 0, "tool").otherwise("").alias("tool_name"), F.concat(F.lit('{"n":'), t["i"].cast("string"), F.lit("}")).alias("tool_args"),
        F.when(t["i"] % 3 == 0, t["text"]).alias("result_text"), F.lit("ok").alias("status"), F.when(t["i"] % 2 == 1, t["text"]).alias("source_raw_text"),
    )
    runs = _collected(spark, sf).withColumn("steps", F.transform("turns", step))
    return runs.select(
        F.concat(F.lit("terminalbench::c::"), F.col("conv_id").cast("string")).alias("trajectory_id"), F.concat(F.lit("task"), (F.col("conv_id") % 7).cast("string")).alias("task_id"), (F.col("conv_id") % 2 == 0).alias("final_success"),
        F.when(F.col("conv_id") % 2 == 1, "LOST").alias("failure_bucket"), F.when(F.col("conv_id") % 3 > 0, F.when(F.col("conv_id") % 3 == 1, "val").otherwise("test")).alias("split"), F.lit("{}").alias("metadata"), "steps",
    )


@query(f"""WITH {S.TURNS} SELECT 'terminalbench::c::' || trajectory_id AS trajectory_id, 'task' || (trajectory_id % 7) AS task_id, trajectory_id % 2 = 0 AS final_success, CASE WHEN trajectory_id % 2 = 1 THEN 'LOST' ELSE 'NONE' END AS failure_bucket,
  CASE trajectory_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, CAST(count(*) OVER (PARTITION BY trajectory_id) AS INTEGER) AS n_steps, CAST(step_index AS INTEGER) AS step_index, role AS context, text AS action_text,
  CASE WHEN step_index % 2 = 0 THEN 'tool' END AS tool_name, '{{"n":' || step_index || '}}' AS tool_args, CASE WHEN step_index % 3 = 0 THEN text ELSE '' END AS result_text, nullif(CASE WHEN step_index % 2 = 1 THEN text ELSE '' END, '') AS source_raw_text FROM turns""")
def canonical_round_trip(spark, sf):
    """Runs written as JSON Lines by two writers and read back with their defaults."""
    path = scratch.folder(spark, "runs")
    runs = _canonical_runs(spark, sf)
    canonical.write_runs(runs.where("final_success"), path)
    canonical.write_runs(runs.where("NOT final_success"), path, mode="append")
    s = canonical.steps_of(canonical.read_runs(spark, path))
    return s.select("trajectory_id", "task_id", "final_success", "failure_bucket", "split", "n_steps", "step_index", "context", "action_text", "tool_name", "tool_args", "result_text", "source_raw_text")


@query("""SELECT 'terminalbench::c::' || conv_id AS trajectory_id, CASE conv_id % 3 WHEN 1 THEN 'val' ELSE 'test' END AS split, 'task' || (conv_id % 7) AS task_id, count(*) AS n_steps FROM conversations WHERE conv_id % 3 > 0 GROUP BY conv_id""")
def manifest_round_trip(spark, sf):
    """A split manifest written, read and checked, and the runs joined to it."""
    runs = _canonical_runs(spark, sf)
    path = scratch.folder(spark, "manifest")
    canonical.write_manifest(runs.where("split IS NOT NULL"), path)
    joined = canonical.join_manifest(canonical.read_manifest(spark, path), runs.drop("split"))
    return joined.select("trajectory_id", "split", "task_id", F.size("steps").cast("long").alias("n_steps"))


# --- terminal runs ---------------------------------------------------------------------------------------------------


def _terminal_rows(spark, sf) -> DataFrame:
    """Conversations as rows of a terminal dataset; one in seven has no messages, assistants are agents."""
    message = lambda t: F.struct(
        F.when(t["role"] == "assistant", "Agent").otherwise(t["role"]).alias("src"), t["text"].alias("msg"),
        F.when(t["i"] % 3 == 0, F.array(F.create_map(F.lit("fn"), F.lit("bash"), F.lit("cmd"), F.lit("ls")))).when(t["i"] % 3 == 1, F.array(F.create_map(F.lit("fn"), F.lit("a")), F.create_map(F.lit("fn"), F.lit("b")))).alias("tools"),
        F.when(t["i"] % 4 == 2, F.lit("Traceback here")).when(t["i"] % 4 == 0, F.lit(" fine ")).alias("obs"),
    )
    rows = _collected(spark, sf).withColumn("steps", F.when(F.col("conv_id") % 7 == 6, "null").otherwise(F.to_json(F.transform("turns", message))))
    return rows.select(
        F.when(F.col("conv_id") % 5 > 0, F.concat(F.lit("task"), (F.col("conv_id") % 5).cast("string"))).alias("task_name"), F.concat(F.lit("trial"), F.col("conv_id").cast("string")).alias("trial_name"), F.lit("").alias("trial_id"),
        F.lit("a").alias("agent"), F.lit("m").alias("model"), (F.col("conv_id") % 3 == 0).cast("int").alias("reward"), "steps",
    )


_TERMINAL = f"""{S.TURNS}, ids AS (SELECT *, 'trial' || trajectory_id AS trial, CASE trajectory_id % 5 WHEN 0 THEN 'unknown_task' ELSE 'task' || (trajectory_id % 5) END AS task, trajectory_id % 3 = 0 AS ok FROM turns),
agents AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY step_index) AS k, count(*) OVER (PARTITION BY trajectory_id) AS n FROM ids WHERE role = 'assistant' AND trajectory_id % 7 <> 6)"""


@query(f"""WITH {_TERMINAL}, s AS (SELECT *, trim({cut("trim(text)", 4000)}) AS msg, CASE step_index % 3 WHEN 0 THEN 'bash' WHEN 1 THEN 'multi_tool_call' ELSE 'respond' END AS tool_name,
  CASE step_index % 4 WHEN 2 THEN 'Traceback here' WHEN 0 THEN 'fine' ELSE 'NONE' END AS result_text FROM agents)
SELECT 'terminalbench::' || trial || '::' || trial AS trajectory_id, 'terminalbench::' || task AS task_id, ok AS final_success, CASE WHEN ok THEN 'NONE' ELSE 'TERMINALBENCH_REWARD_ZERO' END AS failure_bucket, CAST(k AS INTEGER) AS step_index, n AS n_steps,
  tool_name, CASE tool_name WHEN 'respond' THEN msg ELSE msg || chr(10) || 'TOOL_CALL ' || tool_name END AS action_text, result_text,
  CASE WHEN k = n THEN CASE WHEN ok THEN 'success' ELSE 'failure' END WHEN result_text = 'Traceback here' THEN 'tool_error' ELSE 'ok' END AS status FROM s""")
def terminal_steps(spark, sf):
    """Parquet written and scanned, and its messages as steps."""
    path = scratch.folder(spark, "terminal")
    _terminal_rows(spark, sf).write.parquet(f"{path}/data")
    s = terminal.steps(terminal.read_table(spark, path))
    return s.select("trajectory_id", "task_id", "final_success", "failure_bucket", "step_index", "n_steps", "tool_name", "action_text", "result_text", "status")


@query(f"""WITH {_TERMINAL}, runs AS (SELECT trajectory_id, any_value(task) AS task, any_value(ok) AS ok, count(*) FILTER (WHERE role = 'assistant') AS a, trajectory_id % 7 = 6 AS none FROM ids GROUP BY trajectory_id)
SELECT 'terminalbench::' || task AS task_id, count(*) FILTER (WHERE NOT none AND a > 0) AS runs, count(*) FILTER (WHERE none OR a = 0) AS skipped, count(*) FILTER (WHERE NOT none AND a > 0 AND ok) AS successes,
  CAST(coalesce(sum(a) FILTER (WHERE NOT none AND a > 0), 0) AS BIGINT) AS agent_steps FROM runs GROUP BY task""")
def terminal_light_scan(spark, sf):
    """S9."""
    return terminal.light_scan(_terminal_rows(spark, sf))


# --- dialogue results ------------------------------------------------------------------------------------------------


@query(f"""WITH {S.TURNS}, s AS (SELECT *, sum(CAST(role = 'assistant' AS INTEGER)) OVER w AS segment, row_number() OVER w - 1 AS at FROM turns WHERE trajectory_id % 11 <> 10 WINDOW w AS (PARTITION BY trajectory_id ORDER BY step_index)),
f AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id, segment ORDER BY step_index) - 1 AS nth, lower(role) || ': ' || {cut(f"coalesce(nullif({_N('text')}, ''), 'NONE')", 400)} AS told FROM s WHERE segment > 0),
g AS (SELECT trajectory_id, segment, any_value({cut(f"coalesce(nullif({_N('text')}, ''), 'NONE')", 800)}) FILTER (WHERE role = 'assistant') AS action_text, count(*) - 1 AS others,
  string_agg(told, chr(10) ORDER BY step_index) FILTER (WHERE role <> 'assistant' AND nth <= 6) AS replies FROM f GROUP BY ALL),
n AS (SELECT *, count(*) OVER (PARTITION BY trajectory_id) AS n_steps FROM g)
SELECT 'tau2-shop-t' || trajectory_id AS task_id, trajectory_id % 4 = 0 AS final_success, CASE trajectory_id % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN 'TAU2_DB_COMMUNICATE' WHEN 2 THEN 'TAU2_MAX_STEPS' ELSE 'TAU2_DB' END AS failure_bucket,
  CAST(segment AS INTEGER) AS step_index, n_steps, 'respond' AS tool_name, action_text, coalesce(replies, 'NONE') || CASE WHEN others > 6 THEN chr(10) || '... ' || (others - 6) || ' more message(s)' ELSE '' END AS result_text,
  CASE WHEN segment = n_steps THEN CASE WHEN trajectory_id % 4 = 0 THEN 'success' ELSE 'failure' END ELSE 'ok' END AS status FROM n""")
def dialogue_result_steps(spark, sf):
    """Result files of four bundles; one conversation in eleven names a task that no file has. A bundle
    has a file for every 1024 conversation ids, so files stay small and grow in number."""
    message = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"), F.concat(F.lit("m"), t["i"].cast("string")).alias("id"))
    key = F.col("conv_id").cast("string")
    basis = F.when(F.col("conv_id") % 4 == 1, '["db", "communicate"]').when(F.col("conv_id") % 4 == 3, "DB")
    sim = F.struct(
        F.concat(F.lit("s"), key).alias("id"), F.concat(F.lit("t"), key).alias("task_id"), F.lit(0).alias("trial"), F.lit("max-steps").alias("termination_reason"),
        F.struct((F.col("conv_id") % 4 == 0).cast("double").alias("reward"), basis.alias("reward_basis")).alias("reward_info"), F.transform("turns", message).alias("messages"),
    )
    task = F.struct(F.concat(F.lit("t"), key).alias("id"), F.lit("do it").alias("description"))
    files = _collected(spark, sf).groupBy((F.col("conv_id") % 4).alias("bundle"), F.expr("conv_id div 1024").alias("part")).agg(F.collect_list(F.when(F.col("conv_id") % 11 < 10, task)).alias("tasks"), F.collect_list(sim).alias("simulations"))
    path = scratch.folder(spark, "results")
    info = F.struct(F.struct(F.lit("shop").alias("domain_name")).alias("environment_info"))
    files.select("bundle", info.alias("info"), "tasks", "simulations").write.partitionBy("bundle").option("maxRecordsPerFile", 1).json(path)
    s = dialogue.steps(dialogue.read_results(spark, path))
    return s.select("task_id", "final_success", "failure_bucket", "step_index", "n_steps", "tool_name", "action_text", "result_text", "status")


# --- browser archives ------------------------------------------------------------------------------------------------


@query("""SELECT 'a' || (doc_id % 3) AS source, CAST(doc_id AS INTEGER) AS task_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN (quality + (doc_id % 2)) % 2 = 1 THEN 'true' ELSE 'false' END AS outcome FROM labels""")
def browser_log_labels(spark, sf):
    """The log of each archive; the last of two results counts, and some tasks have none."""
    lab = tables.read(spark, sf, "labels", "doc_id", "quality")
    word = lambda c: F.when(c == 1, "PASS").otherwise("FAIL")
    config = F.concat(F.lit("[Config file]: config_files/"), F.col("doc_id").cast("string"), F.lit(".json"))
    result = lambda c: F.concat(F.lit("[Result] ("), word(c), F.lit(") config_files/"), F.col("doc_id").cast("string"), F.lit(".json"))
    q = F.col("quality")
    lines = F.array_join(F.when(F.col("doc_id") % 5 == 0, F.array(config)).when(F.col("doc_id") % 2 == 1, F.array(config, result(q), F.lit("noise"), result(1 - q))).otherwise(F.array(config, result(q))), "\n")
    logs = lab.groupBy(F.concat(F.lit("a"), (F.col("doc_id") % 3).cast("string")).alias("source")).agg(F.array_join(F.collect_list(lines), "\n").alias("text"))
    members = logs.select(F.concat(F.lit("/x/release_v1.0_"), "source", F.lit(".zip")).alias("archive"), "source", F.lit(browser.LOG).alias("member"), "text")
    return browser.log_labels(members).select("source", "task_id", F.coalesce(F.col("final_success").cast("string"), F.lit("missing")).alias("outcome"))


_PREDICTIONS = ("Let me do it ```click [12]``` now", "1. type [3] [hello]", "nothing to do", "done", "I use `goto [http://x]` here")


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'click [12]' WHEN 1 THEN 'type [3] [hello]' WHEN 2 THEN 'stop [INVALID_ACTION]' WHEN 3 THEN 'stop [EARLY_STOP]' ELSE 'goto [http://x]' END AS action_text,
  CASE doc_id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'type' WHEN 4 THEN 'goto' ELSE 'stop' END AS verb, CASE doc_id % 5 WHEN 2 THEN 'invalid_action' WHEN 3 THEN 'early_stop' ELSE 'ok' END AS status,
  CASE doc_id % 5 WHEN 0 THEN '12' WHEN 1 THEN '3,hello' WHEN 2 THEN 'INVALID_ACTION' WHEN 3 THEN 'EARLY_STOP' ELSE 'http://x' END AS args, 'http://h/' || doc_id AS url, 'Seen ' || doc_id || ' & more' || chr(10) || 'next' AS observation FROM documents""")
def browser_actions(spark, sf):
    """Rendered pages with one observation, url and action each."""
    d = tables.read(spark, sf, "documents", "doc_id")
    key = F.col("doc_id").cast("string")
    said = F.element_at(F.lit(list(_PREDICTIONS)), (F.col("doc_id") % 5 + 1).cast("int"))
    answer = F.when(F.col("doc_id") % 5 == 3, "yes").otherwise("")
    act = F.concat(F.lit("{'answer': '"), answer, F.lit("', 'raw_prediction': '"), said, F.lit("'}"))
    html = F.concat(F.lit("<html><div class='state_obv x'>Seen "), key, F.lit(" &amp; more<br> next</div><h3 class='url'>URL: http://h/"), key, F.lit("</h3><div class='other'>no</div><div class='action_object'>"), act, F.lit("</div></html>"))
    p = browser.parse_pages(d.select("doc_id", F.concat(F.lit("render_"), key).alias("member"), html.alias("text")))
    a = F.get("actions", 0)
    return p.select("doc_id", a["text"].alias("action_text"), a["verb"].alias("verb"), a["status"].alias("status"), F.array_join(a["args"], ",").alias("args"), F.get("urls", 0).alias("url"), F.get("observations", 0).alias("observation"))


@query("""SELECT 'a' || (doc_id % 3) || '-' || doc_id AS trajectory_id, CAST(doc_id AS VARCHAR) AS task_id, doc_id % 2 = 0 AS final_success, CASE WHEN doc_id % 2 = 0 THEN 'NONE' ELSE 'TASK_FAILURE' END AS failure_bucket, 1 AS step_index, 1 AS n_steps,
  'task_intent=' || CASE WHEN doc_id % 4 = 0 THEN 'find ' || doc_id ELSE 'UNKNOWN_INTENT' END || chr(10) || 'current_url=http://h/' || doc_id || chr(10) || 'observation=' || chr(10) || 'Seen ' || doc_id AS context,
  'click [' || doc_id || ']' AS action_text, 'click' AS tool_name, 'next_url=http://h/n' || chr(10) || 'next_observation=' || chr(10) || 'Then' AS result_text, 'ok' AS status FROM documents WHERE doc_id % 5 > 0""")
def browser_steps(spark, sf):
    """Logs, pages and a task lookup as steps; a task in five has no result."""
    d = tables.read(spark, sf, "documents", "doc_id")
    key, source = F.col("doc_id").cast("string"), F.concat(F.lit("a"), (F.col("doc_id") % 3).cast("string"))
    act = F.concat(F.lit("{'answer': '', 'raw_prediction': 'Now ```click ["), key, F.lit("]```'}"))
    html = F.concat(F.lit("<div class='state_obv'>Seen "), key, F.lit("</div><h3 class='url'>URL: http://h/"), key, F.lit("</h3><div class='action_object'>"), act, F.lit("</div><div class='state_obv'>Then</div><h3 class='url'>http://h/n</h3>"))
    pages = d.select(source.alias("source"), F.concat(F.lit("render_"), key, F.lit(".html")).alias("member"), html.alias("text"))
    result = F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("[Result] ("), F.when(F.col("doc_id") % 2 == 0, "PASS").otherwise("FAIL"), F.lit(") config_files/"), key, F.lit(".json"))).otherwise(F.concat(F.lit("[Config file]: config_files/"), key, F.lit(".json")))
    logs = d.select(source.alias("source"), result.alias("line")).groupBy("source").agg(F.array_join(F.collect_list("line"), "\n").alias("text")).select("source", F.lit(browser.LOG).alias("member"), "text")
    members = pages.unionByName(logs).withColumn("archive", F.concat(F.lit("/x/"), "source", F.lit(".zip")))
    tasks = d.where("doc_id % 4 = 0").select(F.col("doc_id").cast("int").alias("task_id"), F.concat(F.lit("find "), key).alias("intent"), F.lit(1).cast("long").alias("intent_template_id"))
    s = browser.steps(members, tasks)
    return s.select("trajectory_id", "task_id", "final_success", "failure_bucket", "step_index", "n_steps", "context", "action_text", "tool_name", "result_text", "status")


@query("""WITH k AS (SELECT doc_id, doc_id % 3 AS a, dense_rank() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) AS k FROM documents) SELECT 'a' || a || '-' || doc_id AS trajectory_id, CAST(doc_id AS VARCHAR) AS task_id FROM k WHERE k <= 25""")
def first_tasks_per_archive(spark, sf):
    """L4: the limit is the operator."""
    d = tables.read(spark, sf, "documents", "doc_id").selectExpr("concat('a', doc_id % 3, '-', doc_id) AS trajectory_id", "cast(doc_id AS string) AS task_id")
    return browser.first_tasks(d, 25)


# --- trials ----------------------------------------------------------------------------------------------------------

_REWARD = "CASE trajectory_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END"
_SAID = f"coalesce(nullif({_N('text')}, ''), 'NONE')"
_ACT = cut(_SAID, 1200)


def _trial_frame(spark, sf, fmt: str, trace: Column) -> DataFrame:
    """Conversations as trials of one format; ``trace`` is made from ``turns``."""
    key = F.col("conv_id").cast("string")
    reward = F.when(F.col("conv_id") % 3 == 0, 1.0).when(F.col("conv_id") % 3 == 1, 0.5).otherwise(0.0)
    result = F.to_json(F.struct(F.concat(F.lit("t"), key).alias("trial_name"), F.concat(F.lit("task"), (F.col("conv_id") % 5).cast("string")).alias("task_name"), F.struct(F.struct(reward.alias("reward")).alias("rewards")).alias("verifier_result")))
    return _collected(spark, sf).select(F.concat(F.lit("/jobs/cond/t"), key).alias("trial"), result.alias("result"), F.lit("{}").alias("config"), F.lit("").alias("exception"), F.lit(fmt).alias("format"), F.lit("trace").alias("trace_path"), trace.alias("trace"))


def _trial_steps(spark, sf, fmt: str, trace: Column) -> DataFrame:
    runs = trials.parse_trials(_trial_frame(spark, sf, fmt, trace)).where("problem IS NULL")
    s = runs.select("trajectory_id", "task_id", "final_success", "failure_bucket", F.posexplode("steps").alias("at", "s"))
    return s.select("trajectory_id", "task_id", "final_success", "failure_bucket", (F.col("at") + 1).alias("step_index"), "s.action_text", "s.tool_name", "s.result_text", "s.status")


def _trial_sql(rows: str) -> str:
    """SQL of a format: ``rows`` gives trajectory_id, ord, action_text, tool_name, result_text and bad (a failed call)."""
    return f"""WITH {S.TURNS}, said AS (SELECT *, {_ACT} AS said, {_SAID} AS whole FROM turns), rows AS ({rows}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY ord) AS k, count(*) OVER (PARTITION BY trajectory_id) AS n FROM rows)
SELECT 'skillsbench::cond::t' || trajectory_id AS trajectory_id, 'skillsbench::task' || (trajectory_id % 5) AS task_id, trajectory_id % 3 = 0 AS final_success,
  CASE trajectory_id % 3 WHEN 0 THEN 'NONE' WHEN 1 THEN 'SKILLSBENCH_PARTIAL_REWARD' ELSE 'SKILLSBENCH_VERIFIER_FAIL' END AS failure_bucket, CAST(k AS INTEGER) AS step_index, {cut('action_text', 1200)} AS action_text, tool_name, result_text,
  CASE WHEN k = n THEN CASE WHEN trajectory_id % 3 = 0 THEN 'success' ELSE 'failure' END WHEN bad THEN 'tool_error' ELSE 'ok' END AS status FROM numbered"""


def _json_lines(event) -> Column:
    return F.array_join(F.flatten(F.transform("turns", event)), "\n")


def _js(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))


def _is(t: Column) -> Column:
    return t["role"] == "assistant"


def _num(t: Column) -> Column:
    return t["i"].cast("string")


def _session(t: Column) -> Column:
    text = F.struct(F.lit("text").alias("type"), t["text"].alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("map<string,int>").alias("input"))
    use = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), _num(t).alias("id"), F.lit("Bash").alias("name"), F.create_map(F.lit("n"), t["i"]).alias("input"))
    back = F.struct(F.lit("tool_result").alias("type"), _num(t).alias("tool_use_id"), F.concat(F.lit("out "), _num(t)).alias("content"), (t["i"] % 3 == 0).alias("is_error"))
    says = lambda *c: _js(F.lit("assistant").alias("type"), F.struct(F.array(*c).alias("content")).alias("message"))
    heard = _js(F.lit("user").alias("type"), F.struct(t["text"].alias("content")).alias("message"))
    return F.when(~_is(t), F.array(heard)).when(t["i"] % 2 == 0, F.array(says(text, use), _js(F.lit("user").alias("type"), F.struct(F.array(back).alias("content")).alias("message")))).otherwise(F.array(says(text)))


_SEGMENTS = f"""SELECT *, sum(CAST(role = 'assistant' AS INTEGER)) OVER (PARTITION BY trajectory_id ORDER BY step_index) AS segment, 'user: ' || {cut('whole', 300)} AS told FROM said"""
_SESSION_ROWS = f"""SELECT a.trajectory_id, a.step_index AS ord, CASE WHEN a.step_index % 2 = 0 THEN a.said || ' TOOL_CALL bash' ELSE a.said END AS action_text, CASE WHEN a.step_index % 2 = 0 THEN 'bash' ELSE 'respond' END AS tool_name,
  coalesce(nullif(concat_ws(chr(10), CASE WHEN a.step_index % 2 = 0 THEN CASE WHEN a.step_index % 3 = 0 THEN 'error=out ' ELSE 'result=out ' END || a.step_index END, r.lines), ''), 'NONE') AS result_text, a.step_index % 6 = 0 AS bad
FROM said a LEFT JOIN (SELECT trajectory_id, segment, string_agg(told, chr(10) ORDER BY step_index) AS lines FROM ({_SEGMENTS}) WHERE role <> 'assistant' GROUP BY ALL) r
  ON r.trajectory_id = a.trajectory_id AND r.segment = (SELECT count(*) FROM said b WHERE b.trajectory_id = a.trajectory_id AND b.role = 'assistant' AND b.step_index <= a.step_index) WHERE a.role = 'assistant'"""


def _codex(t: Column) -> Column:
    done = lambda *f: _js(F.lit("item.completed").alias("type"), F.struct(*f).alias("item"))
    run = done(F.lit("command_execution").alias("type"), t["text"].alias("command"), F.concat(F.lit(" out "), _num(t)).alias("aggregated_output"), (t["i"] % 3).alias("exit_code"))
    return F.array(F.when(_is(t), run).otherwise(done(F.lit("reasoning").alias("type"), t["text"].alias("text"))))


def _episode(t: Column) -> Column:
    commands = F.array(F.struct(F.concat(F.lit("ls "), _num(t)).alias("keystrokes"), F.lit(1.0).alias("duration")), F.struct(F.lit("pwd").alias("keystrokes"), F.lit(1.0).alias("duration")))
    answer = F.when(t["i"] % 3 == 0, F.concat(F.lit("Sure: "), _js(F.lit("look").alias("analysis"), F.lit("").alias("plan"), commands.alias("commands")), F.lit(" done"))).when(t["i"] % 3 == 1, _js(F.lit("pdf").alias("load_skill"))).otherwise(t["text"])
    return F.struct(F.concat(F.lit("p "), _num(t)).alias("prompt"), answer.alias("response"))


_EPISODE_ROWS = """SELECT trajectory_id, step_index * 2 + c AS ord, CASE step_index % 3 WHEN 0 THEN CASE c WHEN 0 THEN 'analysis=look ls ' || step_index ELSE 'pwd' END WHEN 1 THEN 'load_skill::pdf' ELSE said END AS action_text,
  CASE step_index % 3 WHEN 0 THEN 'bash' WHEN 1 THEN 'load_skill' ELSE 'respond' END AS tool_name,
  CASE step_index % 3 WHEN 0 THEN CASE WHEN step_index = last THEN 'NONE' ELSE 'p ' || (step_index + 1) END WHEN 1 THEN '{"load_skill":"pdf"}' ELSE 'NONE' END AS result_text, false AS bad
FROM (SELECT *, max(step_index) OVER (PARTITION BY trajectory_id) AS last FROM said), (SELECT unnest([0, 1]) AS c) WHERE c = 0 OR step_index % 3 = 0"""


def _document(t: Column) -> Column:
    call = F.struct(F.lit("Edit").alias("function_name"), F.create_map(F.lit("n"), t["i"]).alias("arguments"))
    got = F.struct(F.array(F.struct(F.concat(F.lit("r "), _num(t)).alias("content"))).alias("results"))
    return F.struct(F.when(_is(t), "agent").otherwise("user").alias("source"), t["text"].alias("message"), F.when(t["i"] % 2 == 0, F.array(call)).alias("tool_calls"), F.when(t["i"] % 4 == 0, got).alias("observation"))


_DOCUMENT_ROWS = """SELECT trajectory_id, step_index AS ord, CASE WHEN step_index % 2 = 0 THEN said || ' TOOL_CALL replace' ELSE said END AS action_text, CASE WHEN step_index % 2 = 0 THEN 'replace' ELSE 'respond' END AS tool_name,
  CASE WHEN step_index % 4 = 0 THEN 'r ' || step_index ELSE 'NONE' END AS result_text, false AS bad FROM said WHERE role = 'assistant'"""


def _gemini(t: Column) -> Column:
    answer = F.struct(F.struct(F.struct(F.when(t["i"] % 4 == 0, F.concat(F.lit("e "), _num(t))).alias("error"), F.concat(F.lit("o "), _num(t)).alias("output")).alias("response")).alias("functionResponse"))
    call = F.struct(F.lit("run_shell_command").alias("name"), F.when(t["i"] % 4 == 0, "error").otherwise("success").alias("status"), F.create_map(F.lit("n"), t["i"]).alias("args"), F.array(answer).alias("result"))
    return F.struct(F.when(_is(t), "gemini").otherwise("user").alias("type"), t["text"].alias("content"), F.when(t["i"] % 2 == 0, F.array(call)).alias("toolCalls"))


_GEMINI_ROWS = """SELECT trajectory_id, step_index AS ord, CASE WHEN step_index % 2 = 0 THEN said || ' TOOL_CALL bash' ELSE said END AS action_text, CASE WHEN step_index % 2 = 0 THEN 'bash' ELSE 'respond' END AS tool_name,
  CASE WHEN step_index % 2 = 1 THEN 'NONE' WHEN step_index % 4 = 0 THEN 'error=e ' || step_index || chr(10) || 'output=o ' || step_index ELSE 'output=o ' || step_index END AS result_text, step_index % 4 = 0 AS bad FROM said WHERE role = 'assistant'"""


def _acp(t: Column) -> Column:
    content = F.array(F.struct(F.lit("content").alias("type"), F.struct(F.lit("text").alias("type"), F.concat(F.lit("c "), _num(t)).alias("text")).alias("content")))
    call = _js(F.lit("tool_call").alias("type"), F.lit("execute").alias("kind"), F.lit("terminal").alias("title"), F.when(t["i"] % 2 == 0, "failed").otherwise("completed").alias("status"), content.alias("content"))
    return F.array(F.when(_is(t), call).otherwise(_js(F.lit("agent_message").alias("type"), t["text"].alias("text"))))


_ACP_ROWS = """SELECT trajectory_id, step_index AS ord, CASE role WHEN 'assistant' THEN 'terminal: c ' || step_index ELSE said END AS action_text, CASE role WHEN 'assistant' THEN 'bash' ELSE 'respond' END AS tool_name,
  CASE role WHEN 'assistant' THEN 'c ' || step_index ELSE 'NONE' END AS result_text, role = 'assistant' AND step_index % 2 = 0 AS bad FROM said"""


def _trials(name: str, fmt: str, rows: str, trace) -> None:
    """Registers the query of one format (S17 and the format's own number)."""

    def run(spark, sf):
        return _trial_steps(spark, sf, fmt, trace())

    run.__name__ = name
    QUERIES[name], SQL[name] = run, _trial_sql(rows)


_trials("trial_claude_session", "claude_session_jsonl", _SESSION_ROWS, lambda: _json_lines(_session))
_trials("trial_codex", "codex_txt", "SELECT trajectory_id, step_index AS ord, said AS action_text, 'bash' AS tool_name, 'out ' || step_index AS result_text, step_index % 3 > 0 AS bad FROM said WHERE role = 'assistant'", lambda: _json_lines(_codex))
_trials("trial_episodes", "trajectory_json", _EPISODE_ROWS, lambda: F.to_json(F.transform("turns", _episode)))
_trials("trial_document", "trajectory_json", _DOCUMENT_ROWS, lambda: F.concat(F.lit('{"schema_version":"ATIF-v1.5","steps":'), F.to_json(F.transform("turns", _document)), F.lit("}")))
_trials("trial_gemini", "gemini_cli_trajectory_json", _GEMINI_ROWS, lambda: F.concat(F.lit('{"messages":'), F.to_json(F.transform("turns", _gemini)), F.lit("}")))
_trials("trial_gemini_text", "gemini_cli_txt", "SELECT trajectory_id, step_index AS ord, said AS action_text, 'respond' AS tool_name, 'NONE' AS result_text, false AS bad FROM said", lambda: F.concat(F.lit("YOLO mode is enabled. x\n\n"), F.array_join(F.transform("turns", lambda t: F.regexp_replace(t["text"], r"\s+", " ")), "\n")))
_trials("trial_acp", "acp_trajectory_jsonl", _ACP_ROWS, lambda: _json_lines(_acp))


@query(f"""WITH {S.TURNS}, u AS (SELECT trajectory_id, step_index, role, text FROM turns),
c AS (SELECT trajectory_id, step_index, row_number() OVER (PARTITION BY trajectory_id ORDER BY step_index) AS step, coalesce(lag(step_index) OVER (PARTITION BY trajectory_id ORDER BY step_index), 0) AS before FROM u WHERE role = 'assistant')
SELECT c.trajectory_id, c.step, max(CASE WHEN u.role <> 'assistant' THEN u.step_index END) AS reasoned_at FROM c LEFT JOIN u ON u.trajectory_id = c.trajectory_id AND u.step_index > c.before AND u.step_index < c.step_index GROUP BY ALL""")
def codex_reasoning(spark, sf):
    """Each command goes with the last reasoning since the command before it."""
    said = lambda t: F.concat(F.lit("turn "), t["i"].cast("string"))
    done = lambda *f: F.to_json(F.struct(F.lit("item.completed").alias("type"), F.struct(*f).alias("item")))
    line = lambda t: F.when(t["role"] == "assistant", done(F.lit("command_execution").alias("type"), said(t).alias("command"), F.lit(0).alias("exit_code"))).otherwise(done(F.lit("reasoning").alias("type"), said(t).alias("text")))
    t = _collected(spark, sf).where("conv_id IS NOT NULL")
    trial = F.concat(F.lit("/jobs/c/t"), "conv_id")
    rows = t.select(trial.alias("trial"), F.lit("{}").alias("result"), F.lit("{}").alias("config"), F.lit("").alias("exception"), F.lit("codex_txt").alias("format"), F.concat(trial, F.lit("/agent/codex.txt")).alias("trace_path"), F.array_join(F.transform("turns", line), "\n").alias("trace"))
    runs = trials.parse_trials(rows).where("problem IS NULL")
    steps = runs.select(F.regexp_extract("trial", r"t(\d+)$", 1).cast("long").alias("trajectory_id"), F.posexplode("steps").alias("at", "s"))
    reasoned = F.nullif(F.regexp_extract("s.context", r"recent_reasoning=turn (\d+)", 1), F.lit(""))
    return steps.select("trajectory_id", (F.col("at") + 1).cast("long").alias("step"), reasoned.cast("long").alias("reasoned_at"))


# --- files that tasks open -------------------------------------------------------------------------------------------


@query("SELECT page_id, 'render_' || page_id || '.html' AS member, md5(coalesce(html, '')) AS digest FROM pages")
def archive_members_round_trip(spark, sf):
    """Pages packed into ZIP archives by the tasks that hold them, and read back member by member in ranges."""
    folder = scratch.folder(spark, "archives")
    pages = tables.read(spark, sf, "pages", "page_id", "html")
    member = F.concat(F.lit("run/render_"), "page_id", F.lit(".html"))
    files.packed(pages.select(member.alias("member"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("content")), folder, f"run/{browser.LOG}").count()
    members = browser.read_members(spark, folder, part_bytes=1 << 20).where(F.col("member") != browser.LOG)
    return members.select(F.regexp_extract("member", r"(\d+)", 1).cast("long").alias("page_id"), "member", F.md5("text").alias("digest"))


_TALKS = "t AS (SELECT conv_id, count(*) AS n, max(conv_id % 2) AS reward, count(*) FILTER (WHERE length(coalesce(text, '')) > 0) AS said FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)"


@query(f"WITH {_TALKS} SELECT 'skillsbench::c' || conv_id % 3 || '::t' || conv_id AS trajectory_id, 'skillsbench::task' || conv_id % 5 AS task_id, CASE WHEN n > 6 THEN 'fit' ELSE 'cal' END AS split, reward = 1 AS final_success, n AS steps FROM t WHERE n > 3")
def manifest_trial_folders(spark, sf):
    """A directory of files for each conversation, and the runs that a manifest names read from them: listed
    first, then opened. The manifest names the longer conversations."""
    folder = scratch.folder(spark, "trials")
    turns = tables.turns(spark, sf).where("trajectory_id IS NOT NULL")
    event = F.to_json(F.struct(F.lit("item.completed").alias("type"), F.struct(F.lit("command_execution").alias("type"), F.concat_ws(" ", "role", "step_index").alias("command"), F.lit(0).alias("exit_code"), "text").alias("item")))
    runs = turns.groupBy(F.col("trajectory_id").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_index", event.alias("e")))), lambda x: x["e"]), "\n").alias("trace"))
    home = F.format_string(f"{folder}/jobs/c%d/t%d", F.col("c") % 3, F.col("c"))
    result = F.to_json(F.struct(F.concat(F.lit("task"), F.col("c") % 5).alias("task_name"), F.struct(F.struct((F.col("c") % 2).cast("double").alias("reward")).alias("rewards")).alias("verifier_result")))
    each = F.array(*(F.struct(F.concat(home, F.lit(f"/{name}")).alias("path"), F.encode(text, "utf-8").alias("content")) for name, text in (("result.json", result), ("config.json", F.lit("{}")), ("agent/codex.txt", F.col("trace")))))
    files.placed(runs.select(F.explode(each).alias("f")).select("f.path", "f.content")).count()
    ids = F.format_string("skillsbench::c%d::t%d", F.col("c") % 3, F.col("c"))
    manifest = runs.where("n > 3").select(F.col("c").alias("position"), ids.alias("trajectory_id"), F.when(F.col("n") > 6, "fit").otherwise("cal").alias("split"))
    got = trials.read_manifest_runs(spark, manifest, folder)
    return got.select("trajectory_id", "task_id", "split", "final_success", F.size("steps").cast("long").alias("steps"))


@query("SELECT count(*) AS rows_written, count(*) AS rows_named, count(*) AS rows_read, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, true AS digests_right FROM documents")
def committed_lines_round_trip(spark, sf):
    """K1, K3, K7: documents written by the committing sink; its manifest, made while they were written, held against the
    files."""
    path = scratch.folder(spark, "committed")
    d = tables.read(spark, sf, "documents", "doc_id", "text")
    committed.write_lines(d.select(F.to_json(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text"))).alias("value")), path)
    m = committed.manifest(spark, path)
    checked = canonical.verify_artifacts(spark, m, path).agg(F.sum("row_count").alias("rows_written"), F.every("ok").alias("digests_right"))
    back = committed.read_lines(spark, path).select(F.from_json("value", "doc_id long, text string").alias("r"))
    read = back.agg(F.count("r.doc_id").alias("rows_read"), F.sum(F.length("r.text")).cast("long").alias("chars"))
    return checked.crossJoin(m.agg(F.sum("rows").alias("rows_named"))).crossJoin(read).select("rows_written", "rows_named", "rows_read", "chars", "digests_right")  # one row each
