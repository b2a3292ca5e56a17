"""Dialogue results: one JSON object per file with tasks, simulations and their messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.functions import text as T

MESSAGE = "role: string, content: string, id: string, requestor: string, error: boolean, tool_calls: array<struct<id: string, name: string, arguments: variant>>"
SCHEMA = (
    "info struct<environment_info: struct<domain_name: string>, agent_info: struct<llm: string, implementation: string>, user_info: struct<llm: string, implementation: string>, git_commit: string, num_trials: int>, "
    "tasks array<struct<id: string, description: string, user_scenario: string, ticket: string>>, "
    f"simulations array<struct<id: string, task_id: string, trial: int, seed: long, timestamp: string, duration: double, termination_reason: string, reward_info: struct<reward: double, reward_basis: string, reward_breakdown: variant>, messages: array<struct<{MESSAGE}>>>>"
)
HISTORY = 12


def bundle(stem: Column) -> Column:
    """Struct agent, domain, policy, user of a file stem ``agent_domain_policy_user_...``; UNKNOWN for other stems."""
    parts = F.split(stem, "_")
    at = lambda i: F.when(F.size(parts) >= 5, F.get(parts, i)).otherwise("UNKNOWN")
    return F.struct(at(0).alias("agent"), at(1).alias("domain"), at(2).alias("policy"), at(3).alias("user"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One row per simulation with its task (null if the file has none of that id)."""
    files = spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    files = files.withColumn("stem", F.regexp_extract("file", r"([^/]+)\.json$", 1)).withColumn("bundle", bundle(F.col("stem")))
    domain = F.coalesce(F.nullif(F.col("info.environment_info.domain_name"), F.lit("")), F.col("bundle.domain"))
    name = lambda who: F.coalesce(f"info.{who}.llm", f"info.{who}.implementation", F.lit("UNKNOWN"))
    sims = files.select("file", "stem", domain.alias("domain"), F.col("bundle.policy").alias("policy"), name("agent_info").alias("agent_model"), name("user_info").alias("user_model"), F.explode(F.transform("simulations", lambda s: F.struct(s.alias("sim"), F.get(F.filter("tasks", lambda t: t["id"] == s["task_id"]), 0).alias("task")))).alias("x"))
    return sims.select("*", "x.sim", "x.task").drop("x")  # each with its own task: no row carries the file's tasks


def missing_tasks(results: DataFrame) -> DataFrame:
    return results.where("task is null").select("file", F.col("sim.task_id").alias("task_id")).distinct()


def failure_basis(basis: Column) -> Column:
    """A basis (text or list literal) as upper-case words joined by underscores, each once."""
    raw = F.trim(F.coalesce(basis, F.lit("")))
    inner = F.when(raw.startswith("[") & raw.endswith("]"), F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    parts = F.when(raw.startswith("["), F.split(inner, ",")).otherwise(F.array(inner))
    clean = F.transform(parts, lambda p: F.regexp_replace(F.translate(F.upper(F.regexp_replace(p, r"^[\s'\"]+|[\s'\"]+$", "")), " -/", "___"), "^_+|_+$", ""))
    return F.array_join(F.array_distinct(F.filter(clean, lambda p: p != "")), "_")


def _line(m: Column, limit: int = 400) -> Column:
    role = F.lower(F.coalesce(m["role"], F.lit("unknown")))
    who = F.when(role == "tool", F.concat(F.lit("tool["), F.coalesce(F.nullif(m["requestor"], F.lit("")), F.nullif(m["id"], F.lit("")), F.lit("tool")), F.lit("]"))).otherwise(role)
    return F.concat(who, F.lit(": "), T.compact(m["content"], limit))


def steps(results: DataFrame, history: int = HISTORY) -> DataFrame:
    """Steps of the simulations with a task: each assistant message opens a segment that runs to the next one; each of
    its tool calls is a step, matched with tool results by id, else with those left over in order; an assistant
    message without tool call is one ``respond`` step."""
    run = ["file", "stem", "sim_id", "task_id", "trial"]
    base = results.where("task is not null").select(
        "file", "stem", "domain", "policy", "agent_model", "user_model", "task",
        F.col("sim.id").alias("sim_id"), F.col("sim.task_id").alias("task_id"), F.coalesce("sim.trial", F.lit(0)).alias("trial"),
        (F.coalesce("sim.reward_info.reward", F.lit(0.0)) >= 1.0 - 1e-9).alias("final_success"),
        failure_basis(F.col("sim.reward_info.reward_basis")).alias("basis"), F.upper(F.translate(F.coalesce("sim.termination_reason", F.lit("UNKNOWN")), "- ", "__")).alias("ended"),
        F.posexplode("sim.messages").alias("at", "m"),
    )
    w = W.partitionBy(*run).orderBy("at")
    m = base.withColumns({"assistant": F.lower("m.role") == "assistant", "line": _line(F.col("m"))})
    m = m.withColumns({"segment": F.sum(F.col("assistant").cast("int")).over(w), "before": F.collect_list("line").over(w.rowsBetween(-history if history > 0 else W.unboundedPreceding, -1))})
    opener = lambda c: F.first(F.when(F.col("assistant"), F.col(c)), ignorenulls=True).alias(c)
    follow = F.array_sort(F.collect_list(F.when(~F.col("assistant"), F.struct("at", F.lower("m.role").alias("role"), F.col("m.id").alias("id"), F.coalesce("m.error", F.lit(False)).alias("error"), F.col("m.content").alias("content"), "line"))))
    keep = ["domain", "policy", "agent_model", "user_model", "task", "final_success", "basis", "ended"]
    seg = m.where("segment > 0").groupBy(*run, "segment").agg(*(F.first(c).alias(c) for c in keep), F.first(F.when(F.col("assistant"), F.col("m")), ignorenulls=True).alias("said"), opener("before"), follow.alias("follow"))
    calls = F.coalesce("said.tool_calls", F.array().cast("array<struct<id: string, name: string, arguments: variant>>"))
    seg = T.staged(
        seg,
        {"calls": calls, "tools": F.filter("follow", lambda f: f["role"] == "tool")},
        {"call_ids": F.transform("calls", lambda c: c["id"])},
        {"spare": F.filter("tools", lambda f: ~F.coalesce(F.array_contains("call_ids", f["id"]), F.lit(False))), "unmatched": F.filter(F.sequence(F.lit(0), F.greatest(F.size("calls") - 1, F.lit(0))), lambda i: ~F.exists("tools", lambda f: F.coalesce(f["id"] == F.get("call_ids", i), F.lit(False))))},
    )
    rows = seg.select("*", F.explode(F.when(F.size("calls") > 0, F.sequence(F.lit(0), F.size("calls") - 1)).otherwise(F.array(F.lit(-1)))).alias("k"))
    own = F.filter("tools", lambda f: f["id"] == F.get("call_ids", F.col("k")))
    matched = F.when(F.size(own) > 0, F.get(own, 0)).otherwise(F.get("spare", F.array_position("unmatched", F.col("k")).cast("int") - 1))
    rows = rows.withColumns({"call": F.get("calls", F.greatest("k", F.lit(0))), "result": F.when(F.col("k") >= 0, matched)})
    content = T.compact(F.col("said.content"), 500)
    tool = F.when(F.col("k") >= 0, F.coalesce("call.name", F.lit("tool_call"))).otherwise("respond")
    shown = F.transform(F.slice("follow", 1, 6), lambda f: f["line"])
    replies = F.when(F.size("follow") == 0, T.NONE).otherwise(F.array_join(F.when(F.size("follow") > 6, F.concat(shown, F.array(F.format_string("... %d more message(s)", F.size("follow") - 6)))).otherwise(shown), "\n"))
    ordered = W.partitionBy(*run).orderBy("segment", "k")
    n = F.count(F.lit(1)).over(W.partitionBy(*run))
    at = F.row_number().over(ordered)
    header = [("dataset=TAU2Bench"), ("domain=", "domain"), ("task_id=tau2-", "domain", "-", "task_id"), ("trial=", "trial"), ("policy_variant=", "policy"), ("agent_model=", "agent_model"), ("user_model=", "user_model")]
    lines = [F.lit(h) if isinstance(h, str) else F.concat(*(F.col(x).cast("string") if x in rows.columns else F.lit(x) for x in h)) for h in header]
    lines.append(F.concat(F.lit("task_description="), T.compact(F.col("task.description"), 600)))
    optional = [F.when(F.coalesce(f"task.{c}", F.lit("")) != "", F.concat(F.lit(f"{c}="), T.compact(F.col(f"task.{c}"), 600))) for c in ("user_scenario", "ticket")]
    context = F.array_join(F.concat(F.array_compact(F.array(*lines, *optional)), F.array(F.lit("observation=")), F.when(F.size("before") == 0, F.array(F.lit(T.NONE))).otherwise(F.col("before"))), "\n")
    bucket = F.when(F.col("final_success"), "NONE").when(F.col("basis") != "", F.concat(F.lit("TAU2_"), "basis")).when(F.col("ended") != "", F.concat(F.lit("TAU2_"), "ended")).otherwise("TAU2_REWARD_ZERO")
    done = rows.withColumns({"step_index": at, "n_steps": n})
    status = F.when(F.col("step_index") == F.col("n_steps"), F.when(F.col("final_success"), "success").otherwise("failure")).when(F.coalesce("result.error", F.lit(False)), "tool_error").otherwise("ok")
    return done.select(
        F.concat(F.lit("tau2-"), "domain", F.lit("-"), "stem", F.lit("-task"), "task_id", F.lit("-trial"), F.col("trial").cast("string")).alias("trajectory_id"),
        F.concat(F.lit("tau2-"), "domain", F.lit("-"), "task_id").alias("task_id"),
        "final_success", bucket.alias("failure_bucket"), "step_index", "n_steps", context.alias("context"),
        F.when(F.col("k") < 0, F.when(content == T.NONE, "assistant_response").otherwise(T.compact(F.col("said.content"), 800))).when(content == T.NONE, F.concat(F.lit("tool_call::"), tool)).otherwise(F.concat(content, F.lit("\nTOOL_CALL "), tool)).alias("action_text"),
        tool.alias("tool_name"), F.when(F.col("k") >= 0, F.coalesce(F.to_json("call.arguments"), F.lit("{}"))).otherwise("{}").alias("tool_args"),
        F.when(F.col("k") >= 0, T.truncate(F.when(F.trim(F.coalesce("result.content", F.lit(""))) == "", T.NONE).otherwise(F.trim("result.content")), 1600)).otherwise(replies).alias("result_text"),
        status.alias("status"), F.to_json(F.struct(F.col("said").alias("assistant_message"), "k", "segment")).alias("source_raw_text"),
    )


def summary(results: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: imported runs, steps, successes, failures and unmatched simulations."""
    runs = rows.groupBy("trajectory_id").agg(F.first("final_success").alias("ok"), F.count(F.lit(1)).alias("n"))
    a = runs.agg(F.count(F.lit(1)).alias("num_imported"), F.coalesce(F.sum("n"), F.lit(0)).alias("num_steps"), F.count_if("ok").alias("num_successes"), F.count_if(~F.col("ok")).alias("num_failures"))
    return a.crossJoin(results.agg(F.count_if(F.col("task").isNull()).alias("num_without_task")))  # one row each
