"""Terminal trajectories: Parquet with the messages of a run in a JSON column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.functions import text as T

MESSAGES = "array<struct<src: string, msg: string, tools: array<map<string, string>>, obs: string>>"
HISTORY, PREVIEWS = 8, 8
ERRORS = ("[error]", "traceback", "exception", "<status>failed</status>", "tool reported failure")


def read_table(spark: SparkSession, root: str) -> DataFrame:
    """``root``/data/*.parquet and ``root``/*.parquet, each file once."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root).withColumn("source_parquet", F.input_file_name())
    return found.where(F.regexp_extract("source_parquet", r"([^/]+)/[^/]+$", 1).isin("data", root.rstrip("/").rsplit("/", 1)[-1]))


def identified(rows: DataFrame) -> DataFrame:
    """Rows with names filled in and trajectory_id ``terminalbench::trial::id``."""
    name = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), other)
    r = rows.withColumn("task_name", name("task_name", F.lit("unknown_task")))
    r = r.withColumn("trial_name", name("trial_name", F.col("task_name"))).withColumn("trial_id", name("trial_id", F.col("trial_name")))
    return r.withColumns({"trajectory_id": F.concat(F.lit("terminalbench::"), "trial_name", F.lit("::"), "trial_id"), "task_id": F.concat(F.lit("terminalbench::"), "task_name"), "final_success": F.coalesce(F.col("reward").cast("int"), F.lit(0)) > 0})


def with_messages(rows: DataFrame) -> DataFrame:
    """Rows with ``messages`` and ``skip``: why a row has no steps, or null. Name columns are pruned from the scan where a
    caller doesn't use them."""
    raw = F.trim(F.coalesce("steps", F.lit("")))
    m = rows.withColumn("messages", F.when((raw != "") & (F.lower(raw) != "null"), F.from_json("steps", MESSAGES)))
    agents = F.size(F.filter(F.coalesce("messages", F.array().cast(MESSAGES)), lambda x: F.lower(x["src"]) == "agent"))
    skip = F.when(F.col("messages").isNull() | (F.size("messages") == 0), "no_steps").when(agents == 0, "no_agent_messages")
    return m.withColumns({"agent_steps": agents, "skip": skip})


def light_scan(rows: DataFrame) -> DataFrame:
    """Ids and counters without steps: one row per task."""
    s = with_messages(identified(rows))
    return s.groupBy("task_id").agg(F.count_if(F.col("skip").isNull()).alias("runs"), F.count_if(F.col("skip").isNotNull()).alias("skipped"), F.count_if(F.col("skip").isNull() & F.col("final_success")).alias("successes"), F.coalesce(F.sum(F.when(F.col("skip").isNull(), F.col("agent_steps"))), F.lit(0)).alias("agent_steps"))


def skip_counts(rows: DataFrame) -> DataFrame:
    return with_messages(rows).where("skip is not null").groupBy("skip").count()


def select_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the wanted trajectories, joined before any message is parsed."""
    return identified(rows).join(ids.select("trajectory_id"), "trajectory_id", "left_semi")


def steps(rows: DataFrame, history: int = HISTORY, split: str = "raw") -> DataFrame:
    """One row per agent message."""
    m = with_messages(identified(rows)).where("skip is null").select("trajectory_id", "task_id", "task_name", "trial_name", "trial_id", "agent", "model", "final_success", F.posexplode("messages").alias("at", "m"))
    run = W.partitionBy("trajectory_id")
    line = F.concat(F.coalesce(F.nullif(F.lower(F.trim("m.src")), F.lit("")), F.lit("unknown")), F.lit(": "), T.truncate(F.coalesce(F.nullif(F.trim("m.msg"), F.lit("")), F.lit(T.NONE)), 400))
    frame = run.orderBy("at").rowsBetween(-history if history > 0 else W.unboundedPreceding, -1)
    raw_frame = frame
    m = m.withColumn("line", line).withColumns({"before": F.collect_list("line").over(frame), "raw_before": F.collect_list("m").over(raw_frame)})
    a = m.where(F.lower("m.src") == "agent").withColumns({"step_index": F.row_number().over(run.orderBy("at")), "n_steps": F.count(F.lit(1)).over(run)})
    trimmed = lambda c, n: T.truncate(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(T.NONE)), n)
    tools = F.coalesce("m.tools", F.array().cast("array<map<string,string>>"))
    names = F.array_distinct(F.transform(tools, lambda t: F.coalesce(F.nullif(F.trim(t["fn"]), F.lit("")), F.lit("respond"))))
    shown = F.transform(F.filter(F.slice(tools, 1, PREVIEWS), lambda t: F.coalesce(t["cmd"], F.lit("")) != ""), lambda t: trimmed(t["cmd"], 240))
    a = a.withColumns({"tools": tools, "names": names, "shown": shown})
    tool = F.when(F.size("tools") == 0, "respond").when(F.size("names") == 1, F.get("names", 0)).otherwise("multi_tool_call")
    single = F.to_json(F.map_filter(F.get("tools", 0), lambda k, _: k != "fn"))
    several = F.to_json(F.struct(F.when(F.size("shown") > 0, F.col("shown")).alias("cmd_preview"), F.size("tools").alias("tool_count"), F.col("names").alias("tool_fns"), F.nullif(F.size("tools") - F.size("shown"), F.lit(0)).alias("truncated_tool_count")))
    args = F.when(F.size("tools") == 0, "{}").when(F.size("tools") == 1, single).otherwise(several)
    msg, result = trimmed("m.msg", 4000), trimmed("m.obs", 4000)
    last = F.col("step_index") == F.col("n_steps")
    status = F.when(last, F.when(F.col("final_success"), "success").otherwise("failure")).when(T.contains_any(F.lower(result), ERRORS), "tool_error").otherwise("ok")
    named = lambda k, c: F.concat(F.lit(f"{k}="), F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")))
    head = F.array(F.lit("dataset=TerminalBench"), named("task_name", "task_name"), named("trial_name", "trial_name"), named("trial_id", "trial_id"), named("agent", "agent"), named("model", "model"), named("step_num", "step_index"), F.lit("observation="))
    context = F.array_join(F.concat(head, F.when(F.size("before") == 0, F.array(F.lit(T.NONE))).otherwise(F.col("before"))), "\n")
    raw = F.to_json(F.struct("agent", F.col("m").alias("agent_message"), F.lit("TerminalBench").alias("dataset"), F.col("raw_before").alias("history"), "model", F.col("step_index").alias("step_num"), "task_name", "trial_id", "trial_name"))
    return a.select(
        "trajectory_id", "task_id", "final_success", F.when(F.col("final_success"), "NONE").otherwise("TERMINALBENCH_REWARD_ZERO").alias("failure_bucket"), F.lit(split).alias("split"), "step_index", "n_steps",
        context.alias("context"), F.when(tool == "respond", msg).when(msg == T.NONE, F.concat(F.lit("tool_call::"), tool)).otherwise(F.concat(msg, F.lit("\nTOOL_CALL "), tool)).alias("action_text"),
        tool.alias("tool_name"), args.alias("tool_args"), result.alias("result_text"), status.alias("status"), raw.alias("source_raw_text"),
    )
