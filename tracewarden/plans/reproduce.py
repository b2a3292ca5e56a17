"""Runs an experiment manifest: training and evaluation of every run and seed, each once.

A job is done when its record stands beside its output with the digest that the
job has now: of its own settings, of its input files and of the jobs before it. A
second call does nothing; a changed setting or file repeats what depends on it. A
training that was stopped goes on from its last epoch.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracewarden.plans import training
from tracewarden.plans.checkpoints import read_text, write_once

#: Settings of a manifest's run, and options of its ``train_args`` and ``eval_args``, by the name they have here.
FIELDS = {"num_symbols": "symbols", "q_max": "states", "epochs": "epochs", "horizon": "horizon"}
TRAIN_OPTIONS = {"--warning-model-type": "model", "--selection-metric": "selection", "--representation-mode": "representation", "--dfa-backend": "backend", "--anneal-scheme": "scheme"}
EVALUATE_OPTIONS = {"--dfa-backend": "backend", "--split": "split"}


@dataclass(frozen=True)
class Job:
    id: str
    kind: str
    output: str
    data: str
    settings: dict
    after: tuple[str, ...] = ()


def _options(args: Iterable[str], known: dict[str, str]) -> tuple[dict, list[str]]:
    """Known options and their values, and the names of all others."""
    args, found, other = list(args), {}, []
    for i, a in enumerate(args):
        if a.startswith("--"):
            value = args[i + 1] if i + 1 < len(args) and not args[i + 1].startswith("--") else None
            if a in known and value is not None:
                found[known[a]] = value.replace("source-raw", "source_raw") if known[a] == "representation" else value
            else:
                other.append(a)
    return found, other


def jobs(config: dict, root: str, data: str, families: Iterable[str] | None = None) -> list[Job]:
    """Jobs in an order in which each comes after those it needs. ``data`` holds a folder of runs for each family."""
    wanted = set(families) if families is not None else None
    out = []
    for run in config["runs"]:
        if wanted is not None and run["family"] not in wanted:
            continue
        train, _ = _options(run.get("train_args", ()), TRAIN_OPTIONS)
        evaluate, _ = _options(run.get("eval_args", ()), EVALUATE_OPTIONS)
        shared = {here: run[there] for there, here in FIELDS.items() if there in run}
        for seed in run["seeds"]:
            base = posixpath.join(root, "experiments", run["id"], f"seed{seed}")
            name, source = f"{run['id']}/seed{seed}", posixpath.join(data, run["family"])
            out.append(Job(f"{name}/train", "train", f"{base}/train", source, shared | train | {"seed": seed}))
            out.append(Job(f"{name}/evaluate", "evaluate", f"{base}/evaluation.json", source, evaluate | {"checkpoint": f"{base}/train"}, (f"{name}/train",)))
    return out


def files_digest(spark: SparkSession, path: str) -> str:
    """Of names and contents of all files below ``path``, whatever their order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha")).orderBy("name", "sha").toLocalIterator()
    h = hashlib.sha256()
    for r in rows:
        h.update(f"{r['name']} {r['sha']}\n".encode())
    return h.hexdigest()


def _digest(job: Job, inputs: str, before: list[str]) -> str:
    return hashlib.sha256(json.dumps([job.kind, job.settings, inputs, before], sort_keys=True).encode()).hexdigest()


def _work(spark: SparkSession, job: Job) -> None:
    if job.kind == "train":
        training.train(spark, job.data, job.output, resume=True, **job.settings)
    else:
        settings = {k: v for k, v in job.settings.items() if k != "checkpoint"}
        found = training.evaluate(spark, job.settings["checkpoint"], job.data, **settings)
        write_once(spark, job.output, json.dumps({"run": job.id.split("/")[0], "seed": found["config"]["seed"]} | found, sort_keys=True, default=str), replace=True)


def run(spark: SparkSession, todo: list[Job], stop_after: int | None = None) -> list[dict]:
    """Does what is not done, in order; returns id and state (``ran`` or ``done``) of each job. ``stop_after``: jobs to run
    at most in this call."""
    inputs: dict[str, str] = {}
    digests: dict[str, str] = {}
    out, ran = [], 0
    for job in todo:
        if job.data not in inputs:
            inputs[job.data] = files_digest(spark, job.data)
        digests[job.id] = _digest(job, inputs[job.data], [digests[x] for x in job.after])
        record = f"{job.output}.done.json"
        text = read_text(spark, record)
        if text is not None and json.loads(text)["digest"] == digests[job.id]:
            out.append({"id": job.id, "state": "done"})
            continue
        if stop_after is not None and ran >= stop_after:
            break
        if text is not None and job.kind == "train":  # of other settings or data: its epochs are no start
            path = spark._jvm.org.apache.hadoop.fs.Path(job.output)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _work(spark, job)
        write_once(spark, record, json.dumps({"id": job.id, "digest": digests[job.id]}, sort_keys=True), replace=True)
        out.append({"id": job.id, "state": "ran"})
        ran += 1
    return out
