"""Training and locked evaluation of a monitor from runs on disk.

The feature front end is a Spark ML pipeline (tokens, n-grams, counts, inverse
document frequencies), fitted on all steps where they are. Symbolizer and warning
head are networks trained on the executors (``operators.descent``): no rows leave
them, and there is no limit of rows. Every epoch is committed to a log
(``plans.checkpoints``), from which a stopped run goes on with the same numbers.
The version with the best key on the calibration split is the checkpoint.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions import render
from tracewarden.operators import automata, descent, models, prefixes
from tracewarden.operators import networks as N
from tracewarden.operators.symbols import argmax
from tracewarden.plans import pipelines, scratch
from tracewarden.plans.checkpoints import Log, State
from tracewarden.sources import canonical

#: Steps that one task holds at a time when it trains, unless a single run is longer.
LIMIT = descent.GROUP_STEPS
SELECTIONS = ("direct-soft", "discrete")
#: Other names of selections.
ALIASES = {"discrete-trusted": "discrete"}
#: What may differ between a run and the one that it resumes.
FREE = ("epochs",)


def feature_front_end(max_features: int = 4096) -> Pipeline:
    """Unfitted front end: column payload to column features, rows of length 1."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="payload", outputCol="_words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
            NGram(n=2, inputCol="_words", outputCol="_pairs"),
            SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
            CountVectorizer(inputCol="_terms", outputCol="_counts", vocabSize=max_features),
            IDF(inputCol="_counts", outputCol="_idf"),
            Normalizer(inputCol="_idf", outputCol="_unit"),
        ]
    )


def featured(front: PipelineModel, steps: DataFrame) -> DataFrame:
    """Steps with ``places`` and ``features`` (sparse values)."""
    out = front.transform(steps)
    places, values = descent.sparse_features(F.col("_unit"))
    return out.withColumns({"places": places, "features": values}).drop(*(c for c in out.columns if c.startswith("_")))


def symbolized(steps: DataFrame, params: N.Params, temperature: float) -> DataFrame:
    """Steps (places, features) with ``probs`` and ``symbol`` of a trained symbolizer, without noise."""
    own = {k: params[k] for k in ("in_w", "in_b", "out_w", "out_b")}

    @F.pandas_udf("array<double>")
    def probs(places: pd.Series, features: pd.Series) -> pd.Series:
        each = [0 if x is None else len(x) for x in places]
        joined = lambda v, kind: np.concatenate([np.asarray(x, kind) for x in v if x is not None] or [np.zeros(0, kind)])
        none = np.zeros(len(each))
        g = N.Group(none, none, np.repeat(np.arange(len(each)), each), joined(places, int), joined(features, float), none, none, none)
        return pd.Series(list(N.symbol_probs(N.T.Tape().leaves(own), g, temperature, None).value))

    return steps.withColumn("probs", probs("places", "features")).withColumn("symbol", argmax(F.col("probs")))


def labelled_steps(spark: SparkSession, path: str, horizon: int, representation: str = "legacy") -> DataFrame:
    steps = render.payloads(canonical.steps_of(canonical.read_runs(spark, path)), representation)
    kept = steps.select("trajectory_id", "split", "step_index", "n_steps", "final_success", "failure_bucket", "payload")
    return kept.withColumns({"label": prefixes.failure_label(horizon), "signature": F.when(F.col("final_success"), "SUCCESS").otherwise(F.col("failure_bucket"))})


def fresh_params(config: dict) -> N.Params:
    rng = np.random.default_rng(config["seed"])
    params = N.symbolizer_params(config["inputs"], config["hidden"], config["symbols"], rng)
    if config["model"] == "predictor":
        return params | N.predictor_params(config["symbols"], config["states"], config["hidden"], rng)
    return params | N.head_params(config["model"], config["symbols"], config["states"], rng)


def temperature(config: dict, epoch: int) -> float:
    return models.annealed(*config["anneal"], epoch, config["planned"], config["scheme"])


def soft_metrics(params: N.Params, config: dict, tau: float, cal: DataFrame, held: DataFrame) -> dict | None:
    """Metrics of the warning head on ``held`` (steps with features), at the threshold that ``cal`` gives."""
    keys = ["trajectory_id", "step_index"]
    head = N.scorer(config["model"], params, tau)
    scored = [s.select(*keys, "label", "final_success").join(models.head_scores(symbolized(s, params, tau), head), keys) for s in (cal, held)]
    row = pipelines.evaluate_scores(*scored).first()
    return None if row is None else row.asDict()


def discrete_metrics(params: N.Params, config: dict, tau: float, fit: DataFrame, cal: DataFrame, held: DataFrame, backend: str) -> dict | None:
    """Metrics of the automaton learned from the fit runs' symbols; None where the symbols have collapsed."""
    keep = ["trajectory_id", "step_index", "n_steps", "final_success", "label", "symbol"]
    parts = [symbolized(s, params, tau).select(*keep) for s in (fit, cal, held)]
    try:
        return pipelines.evaluate_monitor(*parts, config["symbols"], config["horizon"], backend)["metrics"]
    except ValueError as e:
        if str(e) != automata.COLLAPSED:
            raise
        return None


def selection_key(kind: str, soft: dict | None, discrete: dict | None) -> tuple[float, float, float] | None:
    """What is compared between epochs, best last; None where there is nothing to compare."""
    if kind == "direct-soft":
        return None if soft is None else (float(soft["auprc"]), -float(soft["ece"]), 1 - float(soft["latency"]))
    return None if discrete is None else (float(discrete["trusted_auprc"] or 0), float(discrete["trusted_auroc"] or 0), -float(discrete["state_count"]))


def _stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    path = scratch.folder(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _resumed(state: State | None, config: dict) -> None:
    """Raises unless ``state`` is of the same run and has epochs left."""
    if state is None:
        return
    was = state.note["config"]
    other = sorted(k for k in was.keys() | config.keys() if k not in (*FREE, "planned") and was.get(k) != config.get(k))
    if other:
        raise ValueError(f"the run to resume has other settings: {', '.join(other)}")
    if state.version >= config["epochs"]:
        raise ValueError(f"the run to resume has ended epoch {state.version} of {config['epochs']}")


def train(spark: SparkSession, runs: str, out: str, symbols: int = 16, states: int = 16, horizon: int = 3, epochs: int = 24, seed: int = 1, fit: str = "fit", cal: str = "cal", representation: str = "legacy", model: str = "soft-fsm", hidden: int = 64, batches: int = 4, rate: float = 0.02, selection: str = "direct-soft", backend: str = "legacy", scheme: str = "linear", resume: bool = False, stop_after: int | None = None) -> dict:
    """Fits symbolizer and head on split ``fit``, keeps the epoch with the best key on ``cal`` and returns a summary.

    ``model`` is a name of ``models.MODEL_TYPES``, or ``predictor``: the symbolizer learns from the next symbol, future
    signatures and compactness instead, and the automaton learned from its symbols selects the epoch. ``resume`` goes on
    after the last epoch committed to ``out``; ``stop_after`` ends a call early."""
    kind = model if model == "predictor" else models.model_type(model)
    selection = "discrete" if kind == "predictor" else ALIASES.get(selection, selection)
    if selection not in SELECTIONS:
        raise ValueError(f"unknown selection {selection}; known are {', '.join(SELECTIONS)}")
    log = Log(spark, f"{out}/epochs")
    if log.versions() and not resume:
        raise ValueError(f"{out} holds a run; resume it or take another folder")
    steps = labelled_steps(spark, runs, horizon, representation)
    if resume and log.versions():
        front = PipelineModel.load(f"{out}/front_end")
    else:
        front = feature_front_end().fit(steps.where(F.col("split") == fit).select("payload"))
        front.write().overwrite().save(f"{out}/front_end")
    config = {"symbols": symbols, "states": states, "horizon": horizon, "seed": seed, "fit": fit, "cal": cal, "representation": representation, "model": kind, "hidden": hidden, "batches": batches, "rate": rate, "selection": selection, "backend": backend, "scheme": scheme, "anneal": [1.0, 0.25], "epochs": epochs, "planned": epochs, "inputs": len(front.stages[3].vocabulary)}
    state = log.read() if resume else None
    _resumed(state, config)
    held = _stored(featured(front, steps.where(F.col("split").isin(fit, cal))).drop("payload"), "steps", "split")
    part = lambda name: held.where(F.col("split") == name)
    table = _stored(descent.groups(part(fit), batches), "groups", "batch")
    settings = N.Settings(kind, symbols, seed)
    params, adam, history, best, start = fresh_params(config), descent.Adam(rate), [], None, 1
    if state is not None:
        params = {k: state.arrays[f"params.{k}"] for k in params}
        adam = descent.Adam(rate, step=state.note["step"], first={k: state.arrays[f"first.{k}"] for k in params}, second={k: state.arrays[f"second.{k}"] for k in params})
        history, best, start = state.note["history"], state.note["best"], state.version + 1
    for epoch in range(start, epochs + 1):
        tau = temperature(config, epoch)
        params, loss = descent.run_epoch(table, batches, params, adam, settings, (tau, tau), epoch)
        soft = soft_metrics(params, config, tau, part(fit), part(cal)) if selection == "direct-soft" else None
        discrete = discrete_metrics(params, config, tau, part(fit), part(fit), part(cal), backend) if selection == "discrete" else None
        key = selection_key(selection, soft, discrete)
        history = [*history, {"epoch": epoch, "loss": loss, "temperature": tau, "key": key, "validation": soft or discrete}]
        if key is not None and (best is None or tuple(key) > tuple(best["key"])):
            best = {"epoch": epoch, "key": key}
        arrays = {f"{n}.{k}": v for n, p in (("params", params), ("first", adam.first), ("second", adam.second)) for k, v in p.items()}
        note = {"config": config, "epoch": epoch, "temperature": tau, "step": adam.step, "history": json.loads(json.dumps(history, default=float)), "best": best}
        log.commit(epoch, arrays, note, keep=(best["epoch"],) if best else ())
        if stop_after is not None and epoch >= stop_after:
            break
    chosen = next((h for h in history if best and h["epoch"] == best["epoch"]), history[-1])
    return {"config": config, "epochs": history, "best_epoch": chosen["epoch"], "validation": chosen["validation"]}


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, N.Params, dict, float]:
    """Front end, parameters, settings and temperature of the best epoch (the last one where none was comparable)."""
    log = Log(spark, f"{path}/epochs")
    state = log.read()
    if state is None:
        raise ValueError(f"{path} holds no checkpoint")
    if state.note["best"] and state.note["best"]["epoch"] != state.version:
        state = log.read(state.note["best"]["epoch"])
    params = {k.removeprefix("params."): v for k, v in state.arrays.items() if k.startswith("params.")}
    return PipelineModel.load(f"{path}/front_end"), params, state.note["config"], state.note["temperature"]


def evaluate(spark: SparkSession, checkpoint: str, runs: str, split: str = "test", backend: str = "legacy", discrete: bool = True, **overrides) -> dict:
    """Metrics of a checkpoint on a locked split: the warning head, and an automaton learned from the fit runs' symbols.
    ``overrides`` replace stored settings."""
    front, params, config, tau = load(spark, checkpoint)
    config |= {k: v for k, v in overrides.items() if v is not None}
    names = {config["fit"], config["cal"], split}
    steps = _stored(featured(front, labelled_steps(spark, runs, config["horizon"], config["representation"]).where(F.col("split").isin(*names))).drop("payload"), "steps", "split")
    part = lambda name: steps.where(F.col("split") == name)
    out = {"config": config, "split": split, "soft": None if config["model"] == "predictor" else soft_metrics(params, config, tau, part(config["cal"]), part(split))}
    if discrete:
        out["discrete"] = discrete_metrics(params, config, tau, part(config["fit"]), part(config["cal"]), part(split), backend)
    return out
