"""Command line: ``python -m tracewarden COMMAND ...`` (see ``--help``)."""

from __future__ import annotations

import argparse
import json
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.operators import cleaning, splits
from tracewarden.plans import pipelines, reproduce, training
from tracewarden.sources import browser, canonical, dialogue, terminal, trials

#: Seed and share of validation and test runs of each family; fixed values.
FAMILIES = {"webarena": (13, 0.1, 0.1), "tau2": (1, 0.15, 0.15), "terminalbench": (1, 0.1, 0.1), "skillsbench": (13, 0.1, 0.1)}
MODES = ("outer", "fit-cal", "top-level", "stratified")


def experiment_paths(root: str, run: str, seed: int) -> dict[str, str]:
    """Where an experiment keeps its things."""
    base = posixpath.join(root, "experiments", run, f"seed{seed}")
    return {"train": posixpath.join(base, "train"), "evaluation": posixpath.join(base, "evaluation.json"), "log": posixpath.join(root, "logs", f"{run}-seed{seed}.log"), "data": posixpath.join(root, "data")}


def split_runs(runs: DataFrame, mode: str, seed: int) -> DataFrame:
    """Runs with ``split`` by one of MODES."""
    made = {"outer": splits.outer_split, "fit-cal": splits.fit_cal_split, "top-level": splits.top_level_split}.get(mode)
    out = made(runs, seed) if made else splits.stratified_split(runs, seed=seed, strict=False)
    return out.withColumn("split", F.col("protocol_split")).drop("protocol_split")


def nested(steps: DataFrame) -> DataFrame:
    """Runs of a steps frame, each with its steps in order."""
    fields = ("context", "action_text", "tool_name", "tool_args", "result_text", "status", "source_raw_text")
    runs = steps.groupBy("trajectory_id").agg(*(F.first(c).alias(c) for c in ("task_id", "final_success", "failure_bucket")), F.array_sort(F.collect_list(F.struct("step_index", *fields))).alias("s"))
    return runs.withColumn("metadata", F.lit("{}")).withColumn("steps", F.transform("s", lambda x: F.struct(*(x[f].alias(f) for f in fields)))).drop("s")


def prepared(spark: SparkSession, family: str, source: str) -> DataFrame:
    """Runs of a family's raw data."""
    if family == "webarena":
        return nested(browser.steps(browser.read_members(spark, source)))
    if family == "tau2":
        return nested(dialogue.steps(dialogue.read_results(spark, source)))
    if family == "terminalbench":
        return nested(terminal.steps(terminal.read_table(spark, source)))
    return trials.parse_trials(trials.find_trials(spark, source)).where("problem IS NULL").drop("problem", "trial")


def prepare(spark: SparkSession, family: str, source: str, out: str) -> dict:
    """Canonical runs of a family with its split, and the counts that say whether every step has its raw text."""
    seed, val, test = FAMILIES[family]
    runs = prepared(spark, family, source)
    runs = splits.stratified_split(runs, seed=seed, strict=False) if family == "terminalbench" else splits.outer_split(runs, seed=seed, val_ratio=val, test_ratio=test)
    runs = runs.withColumn("split", F.col("protocol_split")).drop("protocol_split")
    canonical.write_runs(runs, out, mode="overwrite")
    written = canonical.read_runs(spark, out)
    counts = cleaning.completeness(canonical.steps_of(written)).first().asDict()
    return {"family": family, "splits": {r["split"]: r["count"] for r in written.groupBy("split").count().collect()}} | counts


def sanity(spark: SparkSession, out: str, n: int = 24) -> dict:
    """A tiny run from data to evaluation."""
    word = lambda i, k: "error retry failed" if i % 2 and k > 2 else f"open page {k} ok"
    rows = [
        (f"run{i}", f"task{i % 4}", i % 2 == 0, "NONE" if i % 2 == 0 else "LOST", ("fit", "cal", "test")[i // 2 % 3], "{}", [("start", word(i, k), None, "{}", "", "ok", word(i, k)) for k in range(6)])
        for i in range(n)
    ]
    step = "context: string, action_text: string, tool_name: string, tool_args: string, result_text: string, status: string, source_raw_text: string"
    runs = spark.createDataFrame(rows, f"trajectory_id string, task_id string, final_success boolean, failure_bucket string, split string, metadata string, steps array<struct<{step}>>")
    canonical.write_runs(runs, f"{out}/runs", mode="overwrite")
    training.train(spark, f"{out}/runs", f"{out}/checkpoint", symbols=3, states=3, epochs=6)
    return training.evaluate(spark, f"{out}/checkpoint", f"{out}/runs")


def summarize(spark: SparkSession, results: str, out: str) -> None:
    """Means and deviations over seeds of evaluation files, as CSV."""
    rows = spark.read.json(results).select("run", "seed", "soft.auroc", "soft.auprc", "soft.ece", "soft.latency")
    stats = [f(c).alias(f"{c}_{n}") for c in ("auroc", "auprc", "ece", "latency") for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    canonical.write_csv(rows.groupBy("run").agg(F.count(F.lit(1)).alias("seeds"), *stats).orderBy("run"), out, mode="overwrite")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracewarden")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *positional: str, **options) -> None:
        c = commands.add_parser(name, help=about)
        for p in positional:
            c.add_argument(p)
        for option, default in options.items():
            c.add_argument(f"--{option.replace('_', '-')}", default=default, type=type(default) if default is not None else None)

    command("inspect", "summary of a JSON Lines dataset", "path", horizon=3)
    command("split", f"runs split by task; modes {', '.join(MODES)}", "path", "out", mode="outer", seed=1)
    command("prepare", f"canonical runs of raw data; families {', '.join(FAMILIES)}", "family", "source", "out")
    command("train", "fit a monitor and write a checkpoint", "runs", "out", symbols=16, states=16, horizon=3, epochs=24, seed=1, fit="fit", cal="cal", representation="legacy", model="soft-fsm", hidden=64, batches=4, rate=0.02, selection="direct-soft", backend="legacy", resume=0)
    command("evaluate", "metrics of a checkpoint on a locked split", "checkpoint", "runs", split="test", backend="legacy", horizon=None)
    command("sanity", "tiny run from data to evaluation", "out")
    command("reproduce", "jobs of an experiment manifest, in order; with --run 1 and --data they are done, each once", "config", families="", root=".", data="", run=0)
    command("verify", "files against a JSON list of path, rows, sha256", "expected", "root")
    command("summarize", "CSV of evaluation files by run", "results", "out")
    return top


def run(spark: SparkSession, a: argparse.Namespace):
    if a.command == "inspect":
        return pipelines.inspect(spark, a.path, a.horizon)
    if a.command == "split":
        out = split_runs(canonical.read_runs(spark, a.path), a.mode, a.seed)
        canonical.write_runs(out, a.out)
        return [r.asDict() for r in splits.split_summary(out, "split").orderBy("split").collect()]
    if a.command == "prepare":
        return prepare(spark, a.family, a.source, a.out)
    if a.command == "train":
        return training.train(spark, a.runs, a.out, a.symbols, a.states, a.horizon, a.epochs, a.seed, a.fit, a.cal, a.representation, a.model, a.hidden, a.batches, a.rate, a.selection, a.backend, resume=bool(a.resume))
    if a.command == "evaluate":
        return training.evaluate(spark, a.checkpoint, a.runs, a.split, a.backend, horizon=int(a.horizon) if a.horizon else None)
    if a.command == "sanity":
        return sanity(spark, a.out)
    if a.command == "reproduce":
        with open(a.config, encoding="utf-8") as f:
            config = json.load(f)
        families = a.families.split(",") if a.families else None
        if a.run:
            return reproduce.run(spark, reproduce.jobs(config, a.root, a.data or posixpath.join(a.root, "data"), families))
        plan = pipelines.experiment_plan(config, families)
        return [p | {"paths": experiment_paths(a.root, p["run"], p["seed"])} for p in plan]
    if a.command == "verify":
        expected = spark.read.schema("path string, rows long, sha256 string").option("multiLine", True).json(a.expected)
        rows = [r.asDict() for r in canonical.verify_artifacts(spark, expected, a.root).collect()]
        return {"ok": all(r["ok"] for r in rows), "files": rows}
    return summarize(spark, a.results, a.out)


def main(args: list[str] | None = None) -> None:
    given = parser().parse_args(args)
    print(json.dumps(run(SparkSession.builder.getOrCreate(), given), indent=2, sort_keys=True, default=str))


if __name__ == "__main__":
    main()
