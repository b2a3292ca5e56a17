"""End-to-end plans: inspect a dataset, induce and evaluate a monitor, compare learners, plan experiment runs."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.operators import automata, metrics, prefixes
from tracewarden.plans import scratch
from tracewarden.sources import canonical


def inspect(spark: SparkSession, path: str, horizon: int = 3) -> dict:
    """Counts by split and the most frequent signatures of a JSON Lines dataset."""
    p = prefixes.expand(canonical.steps_of(canonical.read_runs(spark, path)), horizon)
    by_split = [r.asDict() for r in prefixes.summary_by_split(p).orderBy("split").collect()]
    return {"splits": by_split, "top_signatures": [r.asDict() for r in prefixes.top_signatures(p).collect()]}


def evaluate_monitor(fit: DataFrame, cal: DataFrame, held: DataFrame, symbols: int, horizon: int = 3, backend: str = "legacy", min_support: int = metrics.MIN_SUPPORT, alpha: float = metrics.ALPHA, bins: int = metrics.BINS) -> dict:
    """Learns an automaton on ``fit``, takes state risks and the threshold from ``cal`` and evaluates on ``held`` (steps
    frames with symbols). Returns the automaton, one row of metrics, and the scored frames. Replayed steps and risks are
    written once, so the metrics read them and replay nothing."""
    dfa = automata.induce(automata.symbol_traces(fit), symbols, backend)
    spark = fit.sparkSession
    label = lambda s, name: scratch.written(automata.replay_steps(s, dfa).withColumn("label", prefixes.failure_label(horizon)), name)
    calibration, scored = label(cal, "calibration"), label(held, "held")
    risk = scratch.written(metrics.state_risk(dfa.states(spark), calibration, alpha), "risk")
    cal_scored, held_scored = metrics.score_prefixes(calibration, risk), metrics.score_prefixes(scored, risk)
    found = metrics.f1_threshold(cal_scored).first()
    threshold = 0.5 if found is None or found["threshold"] is None else found["threshold"]
    row = metrics.trusted_metrics(held_scored, min_support, bins).first().asDict()
    every = metrics.prefix_metrics(held_scored, threshold, bins).first().asDict()
    latency = metrics.detection_latency(held_scored, threshold).first()
    sure = metrics.detection_latency(held_scored, threshold, only_trusted=min_support).first()
    row = {f"trusted_{k}" if k in ("auroc", "auprc", "ece", "brier") else k: v for k, v in row.items()} | every
    known = calibration.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("label"), F.lit(0.0)).alias("rate")).first()
    row |= {"state_count": len(dfa.delta), "latency": latency["latency"], "trusted_latency": sure["latency"], "alert_lead_time": 1 - sure["latency"], "calibration_prefixes": known["n"], "calibration_positive_rate": known["rate"]}
    return {"dfa": dfa, "metrics": row, "calibration": cal_scored, "scored": held_scored, "risk": risk}


def score_and_threshold(cal: DataFrame, held: DataFrame) -> DataFrame:
    """``held`` (scores and labels) with ``threshold``: the score of best F1 on ``cal``, in one plan."""
    return held.crossJoin(F.broadcast(metrics.f1_threshold(cal).select("threshold")))  # one row


def evaluate_scores(cal: DataFrame, held: DataFrame, bins: int = metrics.BINS) -> DataFrame:
    """One row: the metrics of ``held`` at the threshold that ``cal`` gives (trajectory_id, step_index, final_success, score,
    label)."""
    at = score_and_threshold(cal, held)
    alerts = at.agg(F.first("threshold").alias("threshold"), F.count_if(F.col("score") >= F.col("threshold")).alias("alerts"), F.count_if((F.col("score") >= F.col("threshold")) & (F.col("label") == 1)).alias("true_alerts"))
    latency = metrics.detection_latency(at, F.col("threshold"))
    row = metrics.ranking_metrics(held)
    for part in (metrics.calibration_error(held, bins=bins), metrics.brier(held), alerts, latency):
        row = row.crossJoin(part)  # one row each
    return row


def evaluate_soft_monitor(cal: DataFrame, held: DataFrame, model, bins: int = metrics.BINS) -> DataFrame:
    """One row: a soft automaton scored on both frames (probs, label, final_success), threshold from ``cal``."""
    from tracewarden.operators.models import soft_fsm_scores

    keys = ["trajectory_id", "step_index"]
    scored = [s.select(*keys, "label", "final_success").join(soft_fsm_scores(s, model), keys) for s in (cal, held)]
    return evaluate_scores(*scored, bins=bins)


def evaluate_automaton(dfa, cal: DataFrame, held: DataFrame, horizon: int = 3, alpha: float = metrics.ALPHA, bins: int = metrics.BINS) -> DataFrame:
    """One row: a given automaton with state risks and threshold from ``cal``, evaluated on ``held`` (steps with symbols)."""
    label = lambda s: automata.replay_steps(s, dfa).withColumn("label", prefixes.failure_label(horizon))
    c, h = label(cal), label(held)
    risk = metrics.state_risk(dfa.states(cal.sparkSession), c, alpha)
    return evaluate_scores(metrics.score_prefixes(c, risk), metrics.score_prefixes(h, risk), bins)


def analyze_monitor(assigned: DataFrame, scored: DataFrame, symbols: int, k: int = 5) -> dict[str, DataFrame]:
    """What a monitor has learned, as frames: symbols with rates, examples and phrases (``assigned``: symbol, confidence,
    margin, text), states with exemplars, first warnings and reliability (``scored``)."""
    from tracewarden.operators import explain

    rated = scored.crossJoin(F.broadcast(scored.agg(F.coalesce(F.avg("label"), F.lit(0.0)).alias("base_rate"))))  # one row
    return {
        "symbols": explain.symbol_summary(assigned, symbols),
        "examples": explain.top_examples(assigned, k),
        "phrases": explain.top_ngrams(assigned, 2 * k),
        "exemplars": explain.state_exemplars(scored),
        "first_warnings": explain.first_warnings(rated, F.col("base_rate")),
        "reliability": metrics.reliability(scored),
    }


def compare_learners(fit: DataFrame, cal: DataFrame, held: DataFrame, symbols: int, backends: Iterable[str] = tuple(automata.METHODS), **options) -> dict[str, dict]:
    return {b: evaluate_monitor(fit, cal, held, symbols, backend=b, **options)["metrics"] for b in backends}


def experiment_plan(config: dict, families: Iterable[str] | None = None, stages: Iterable[str] = ("train", "evaluate")) -> list[dict]:
    """The cross product of runs, seeds and stages of an experiment manifest, in order."""
    wanted = set(families) if families is not None else None
    runs = [r for r in config["runs"] if wanted is None or r["family"] in wanted]
    return [
        {"run": r["id"], "family": r["family"], "seed": seed, "stage": stage, "output": r["output_template"].format(seed=seed), "args": list(r.get(f"{stage[:5] if stage == 'train' else 'eval'}_args", ()))}
        for r in runs
        for seed, stage in product(r["seeds"], stages)
    ]
