"""Canonical trajectories as JSON Lines, split manifests, and sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.sources.files import located

STEP = "context string, action_text string, tool_name string, tool_args variant, result_text string, status string, source_raw_text string"
RUN = f"trajectory_id string, task_id string, final_success boolean, failure_bucket string, split string, metadata variant, steps array<struct<{STEP.replace(' string', ': string').replace(' variant', ': variant')}>>"
REQUIRED = ("trajectory_id", "task_id", "final_success", "steps")
STEP_REQUIRED = ("context", "action_text")
MANIFEST_IDS = ("skillsbench::", "terminalbench::")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, position of the lines that aren't blank."""
    rows = spark.read.text(path).withColumns({"file": F.input_file_name(), "position": F.monotonically_increasing_id()})
    return rows.where(F.trim("value") != "")


def parse_runs(lines: DataFrame) -> DataFrame:
    """Runs with defaults filled in and ``problem``: what is wrong with a line, or null."""
    parsed = lines.withColumn("r", F.from_json("value", RUN + ", broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))
    steps = F.coalesce("r.steps", F.array().cast("array<struct<" + STEP.replace(" string", ": string").replace(" variant", ": variant") + ">>"))
    bad_step = F.exists(steps, lambda s: s["context"].isNull() | s["action_text"].isNull())
    problem = F.when(F.col("r.broken").isNotNull() | F.col("r").isNull(), "not a JSON object")
    for c in REQUIRED:
        problem = problem.when(F.col(f"r.{c}").isNull(), f"{c} is missing")
    problem = problem.when(F.size(steps) == 0, "no steps").when(bad_step, "a step lacks context or action_text")
    blank = lambda c: F.nullif(c, F.lit(""))
    step = lambda s: F.struct(
        s["context"].alias("context"),
        s["action_text"].alias("action_text"),
        blank(s["tool_name"]).alias("tool_name"),
        F.coalesce(F.to_json(s["tool_args"]), F.lit("{}")).alias("tool_args"),
        F.coalesce(s["result_text"], F.lit("")).alias("result_text"),
        blank(s["status"]).alias("status"),
        blank(s["source_raw_text"]).alias("source_raw_text"),
    )
    return parsed.select(
        "file",
        "position",
        "value",
        problem.alias("problem"),
        "r.trajectory_id",
        "r.task_id",
        "r.final_success",
        F.coalesce("r.failure_bucket", F.lit("NONE")).alias("failure_bucket"),
        F.coalesce("r.split", F.lit("train")).alias("split"),
        F.coalesce(F.to_json("r.metadata"), F.lit("{}")).alias("metadata"),
        F.transform(steps, step).alias("steps"),
    )


def read_runs(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Runs of JSON Lines. Strict: raises at the first bad line or if there is none; else bad lines are left out (see
    ``rejected_lines``). A file with manifest rows is a manifest and raises here: read it with ``read_manifest``."""
    lines = read_lines(spark, path)
    if strict:
        if lines.isEmpty():
            raise ValueError(f"no record in {path}")
        if not manifest_rows(lines).isEmpty():
            raise ValueError(f"{path} is a split manifest")
        bad = parse_runs(lines).where("problem is not null").select("position", "problem").limit(1).collect()
        if bad:
            raise ValueError(f"{path}, line {bad[0]['position'] + 1}: {bad[0]['problem']}")
    return parse_runs(lines).where("problem is null").drop("problem", "value")


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_runs(read_lines(spark, path)).where("problem is not null").select("file", "position", "problem", "value")


def steps_of(runs: DataFrame) -> DataFrame:
    """One row per step: the run's columns with step_index (from 1), n_steps and the step's fields."""
    rest = [c for c in runs.columns if c != "steps"]
    return runs.select(*rest, F.size("steps").alias("n_steps"), F.posexplode("steps").alias("_at", "_s")).select(*rest, "n_steps", (F.col("_at") + 1).alias("step_index"), "_s.*")


# --- manifests -------------------------------------------------------------------------------------------------------


def manifest_rows(lines: DataFrame) -> DataFrame:
    """The lines that are manifest rows: an id of a known family and a split, and no steps."""
    r = lines.withColumn("m", F.from_json("value", "trajectory_id string, split string, dataset string, task_id string, trial_dir string, steps string"))
    known = F.lit(False)
    for p in MANIFEST_IDS:
        known = known | F.col("m.trajectory_id").startswith(p)
    return r.where(known & (F.trim(F.coalesce("m.split", F.lit(""))) != "") & F.col("m.steps").isNull()).select("position", "m.trajectory_id", "m.split", "m.task_id", "m.trial_dir")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """position, trajectory_id, split (task_id, trial_dir); raises on other rows, repeated ids and an empty manifest."""
    lines = read_lines(spark, path)
    m = manifest_rows(lines)
    n, k = lines.count(), m.count()
    if not k or n != k:
        raise ValueError(f"{path} is no split manifest: {n - k} of {n} rows have another shape")
    twice = m.groupBy("trajectory_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{path} has {twice[0]['trajectory_id']} more than once")
    return m


def join_manifest(manifest: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs in manifest order with the manifest's split; raises on ids that are missing or repeated among the runs."""
    mine = runs.join(manifest.select("trajectory_id"), "trajectory_id", "left_semi")
    twice = mine.groupBy("trajectory_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['trajectory_id']} occurs more than once in the source")
    missing = manifest.join(runs.select("trajectory_id"), "trajectory_id", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"not in the source: {[r['trajectory_id'] for r in missing]}")
    rest = [c for c in runs.columns if c not in ("split", "position", "trajectory_id")]
    return manifest.select("position", "trajectory_id", "split").join(mine.select("trajectory_id", *rest), "trajectory_id").orderBy("position")


# --- sinks -----------------------------------------------------------------------------------------------------------


def write_runs(runs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON Lines of runs; open objects are written as objects, not as texts."""
    step = lambda s: F.struct(*(F.parse_json(s[c]).alias(c) if c == "tool_args" else s[c].alias(c) for c in ("context", "action_text", "tool_name", "tool_args", "result_text", "status", "source_raw_text")))
    keep = [c for c in ("trajectory_id", "task_id", "final_success", "failure_bucket", "split") if c in runs.columns]
    runs.select(*keep, F.parse_json("metadata").alias("metadata"), F.transform("steps", step).alias("steps")).write.mode(mode).json(path)


def write_manifest(runs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    runs.select("trajectory_id", "split").write.mode(mode).json(path)


def write_csv(summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    summary.coalesce(1).write.mode(mode).option("header", True).csv(path)


SUMMARY_ROWS = 1000


def summary_json(summary: DataFrame) -> str:
    """A small summary (one row, or a row per split) as sorted, indented JSON; raises where it is not small."""
    rows = [r.asDict(recursive=True) for r in summary.limit(SUMMARY_ROWS + 1).collect()]
    if len(rows) > SUMMARY_ROWS:
        raise ValueError(f"over {SUMMARY_ROWS} rows are no summary: write them as a table")
    return json.dumps(rows[0] if len(rows) == 1 else rows, indent=2, sort_keys=True, default=str)


#: Bytes up to which a file is digested as one value; larger ones pass a task piece by piece.
WHOLE_BYTES = 4 << 20


def _passed(path: str, piece: int) -> tuple[str, int]:
    """Digest and number of lines that aren't blank of a file of any size."""
    system, at = located(path)
    h, rows, begun = hashlib.sha256(), 0, False
    with system.open_input_stream(at) as f:
        while data := f.read(piece):
            h.update(data)
            *ended, last = data.split(b"\n")
            for x in ended:
                rows, begun = rows + (begun or x.strip(b" ") != b""), False
            begun = begun or last.strip(b" ") != b""
    return h.hexdigest(), rows + begun


def verify_artifacts(spark: SparkSession, expected: DataFrame, root: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """``expected``: path, rows, sha256. Adds found, row_count, digest and ok; the digest is over the file's bytes."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("full").to_pylist():
                digest, rows = _passed(path, whole_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest]), pa.array([rows], pa.int64())], names=["full", "digest", "row_count"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    small = files.where(F.col("length") <= whole_bytes)
    seen = small.select(F.col("path").alias("full"), F.sha2("content", 256).alias("digest"), F.size(F.filter(F.split(F.decode("content", "utf-8"), "\n"), lambda x: F.trim(x) != "")).cast("long").alias("row_count"))
    large = files.where(F.col("length") > whole_bytes).select(F.col("path").alias("full"))
    seen = seen.unionByName(large.mapInArrow(passed, "full string, digest string, row_count long"))
    joined = expected.join(seen, F.col("full").endswith(F.concat(F.lit("/"), F.col("path"))), "left")
    ok = F.col("full").isNotNull() & (F.col("rows").isNull() | (F.col("rows") == F.col("row_count"))) & (F.col("sha256").isNull() | (F.lower("sha256") == F.col("digest")))
    return joined.select("path", F.col("full").isNotNull().alias("found"), "row_count", "digest", ok.alias("ok"))
