"""Ranking, calibration and detection metrics as aggregates.

Every sweep aggregates to distinct scores first (with partial sums) and writes
them, so rows are read once and what follows sorts scores. Up to ``FEW`` of them
are swept by one window. Real-valued scores may be as many as rows: more are cut
into ``RANGES`` ranges by a quantile summary, summed inside each range, and the
sums of the ranges below are added, so no sweep of many scores runs in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.plans import scratch

MIN_SUPPORT, ALPHA, BINS = 10, 5.0, 10
#: Distinct scores that one window sweeps.
FEW = 100_000
#: Ranges of scores that a sweep is cut into.
RANGES = 64


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch.folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _by_score(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys, "score").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))


def _swept(scored: DataFrame, keys: list[str], counted: bool = False) -> DataFrame:
    """Distinct scores with pos, n, their sums over lower scores (pos_below, n_below) and over all (positives, rows).
    ``counted``: ``scored`` has a score's pos and n already, perhaps in several rows."""
    s = scored.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")) if counted else _by_score(scored, keys)
    s = _stored(s, "scores")
    if s.count() <= FEW:
        below, every = W.partitionBy(*keys).orderBy("score").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*keys)
        sums = {f"{c}_below": F.coalesce(F.sum(c).over(below), F.lit(0)) for c in ("pos", "n")}
        return s.withColumns(sums | {"positives": F.sum("pos").over(every), "rows": F.sum("n").over(every)}).select(*keys, "score", "pos", "n", "pos_below", "n_below", "positives", "rows")
    edges = s.agg(F.percentile_approx("score", [i / RANGES for i in range(1, RANGES)], 1000).alias("_edges"))  # one row
    cut = s.crossJoin(F.broadcast(edges)).withColumn("_part", F.size(F.filter(F.coalesce("_edges", F.array().cast("array<double>")), lambda e: e < F.col("score")))).drop("_edges")
    ranges = cut.groupBy(*keys, "_part").agg(F.sum("pos").alias("_pos"), F.sum("n").alias("_n"))
    before, all_ranges = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*keys)  # at most RANGES rows a key
    ranges = ranges.select(
        *(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_range"),
        F.coalesce(F.sum("_pos").over(before), F.lit(0)).alias("_pos"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
        F.sum("_pos").over(all_ranges).alias("positives"), F.sum("_n").over(all_ranges).alias("rows"),
    )
    own = cut["_part"] == ranges["_range"]
    for k in keys:
        own = own & cut[k].eqNullSafe(ranges[f"_{k}"])
    inside = W.partitionBy(*keys, "_part").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    below = {f"{c}_below": F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in ("pos", "n")}
    return cut.join(ranges, own).withColumns(below).select(*keys, "score", "pos", "n", "pos_below", "n_below", "positives", "rows")


def ranking_metrics(scored: DataFrame, *keys: str, counted: bool = False) -> DataFrame:
    """auroc (ties count half; 0.5 for one class) and average precision (step sum over distinct scores) per key."""
    k = list(keys)
    neg, neg_below = F.col("n") - F.col("pos"), F.col("n_below") - F.col("pos_below")
    a = _swept(scored, k, counted).groupBy(*k).agg(
        F.sum("n").alias("n"),
        F.sum("pos").alias("positives"),
        F.sum(F.col("pos") * (neg_below + neg / 2)).alias("wins"),
        F.sum(F.col("pos") * (F.col("positives") - F.col("pos_below")) / (F.col("rows") - F.col("n_below"))).alias("gain"),
    )
    p, q = F.col("positives"), F.col("n") - F.col("positives")
    auroc = F.when((p == 0) | (q == 0), 0.5).otherwise(F.col("wins") / (p * q))
    ap = F.when(p == 0, 0.0).otherwise(F.col("gain") / p)
    return a.select(*k, "n", "positives", auroc.alias("auroc"), ap.alias("auprc"))


def f1_threshold(scored: DataFrame, *keys: str) -> DataFrame:
    """The score that maximises F1 with ``score >= threshold``; the lowest of equals."""
    k = list(keys)
    s = _swept(scored, k).withColumns({"tp": F.col("positives") - F.col("pos_below"), "alerts": F.col("rows") - F.col("n_below")})
    precision = F.col("tp") / F.greatest("alerts", F.lit(1))
    recall = F.col("tp") / F.greatest("positives", F.lit(1))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    best = s.withColumn("f1", f1).groupBy(*k).agg(F.max(F.struct("f1", (-F.col("score")).alias("low"))).alias("b"))
    return best.select(*k, (-F.col("b.low")).alias("threshold"), F.col("b.f1").alias("f1"))


def calibration_bin(score: Column, bins: int = BINS) -> Column:
    """Bin by comparison with the edges i * (1 / bins): left-closed, the last one closed; null outside [0, 1]."""
    if bins <= 0:
        raise ValueError("bins must be positive")
    width = 1.0 / bins
    chain = F.when((score < 0.0) | (score > 1.0), F.lit(None).cast("int"))
    for i in range(1, bins):
        chain = chain.when(score < i * width, i - 1)
    return chain.otherwise(bins - 1)


def reliability(scored: DataFrame, *keys: str, bins: int = BINS) -> DataFrame:
    """Per bin: n, accuracy (mean label), confidence (mean score)."""
    return scored.withColumn("bin", calibration_bin(F.col("score"), bins)).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("accuracy"), F.avg("score").alias("confidence"))


def calibration_error(scored: DataFrame, *keys: str, bins: int = BINS) -> DataFrame:
    """ece: gaps between accuracy and confidence weighted by the bins' shares; scores outside [0, 1] only count in n."""
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("accuracy") - F.col("confidence")))
    return reliability(scored, *keys, bins=bins).groupBy(*keys).agg((F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("n")).alias("ece"))


def brier(scored: DataFrame, *keys: str) -> DataFrame:
    return scored.groupBy(*keys).agg(F.coalesce(F.avg(F.pow(F.col("score") - F.col("label"), 2)), F.lit(0.0)).alias("brier"))


def prefix_metrics(scored: DataFrame, threshold: float, bins: int = BINS) -> DataFrame:
    """One row with all prefix metrics at a threshold."""
    alerts = scored.agg(F.count_if(F.col("score") >= threshold).alias("alerts"), F.count_if((F.col("score") >= threshold) & (F.col("label") == 1)).alias("true_alerts"))
    return ranking_metrics(scored).crossJoin(calibration_error(scored, bins=bins)).crossJoin(brier(scored)).crossJoin(alerts).withColumn("threshold", F.lit(threshold))  # one row each


def state_risk(states: DataFrame, prefixes: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """risk = (failures + alpha * base rate) / (n + alpha) and support per state; ``states`` lists them all, and one that
    no prefix visits has the base rate."""
    seen = prefixes.groupBy("state").agg(F.count(F.lit(1)).alias("support"), F.sum("label").alias("failures"))
    base = prefixes.agg(F.coalesce(F.avg("label"), F.lit(0.0)).alias("base"))  # one row
    all_states = states.select("state").distinct().join(seen, "state", "left").crossJoin(F.broadcast(base))
    n = F.coalesce("support", F.lit(0))
    return all_states.select("state", n.alias("support"), ((F.coalesce("failures", F.lit(0)) + alpha * F.col("base")) / (n + alpha)).alias("risk"))


def score_prefixes(prefixes: DataFrame, risk: DataFrame) -> DataFrame:
    """Prefixes with the risk and support of their state (an automaton's table is small by its bound on states)."""
    return prefixes.join(F.broadcast(risk.select("state", F.col("risk").alias("score"), "support")), "state")


def trusted(scored: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    return scored.where(F.col("support") >= min_support)


def trusted_metrics(scored: DataFrame, min_support: int = MIN_SUPPORT, bins: int = BINS) -> DataFrame:
    """One row: coverage, abstention and the metrics of prefixes in well-supported states. Prefixes are counted by state and
    score once; all metrics come from these counts."""
    counts = _stored(_by_score(scored, ["state", "support"]), "states")
    ok = trusted(counts, min_support)
    sure = F.col("support") >= min_support
    zero = F.lit(0)
    cover = counts.agg(F.coalesce(F.sum("n"), zero).alias("prefixes"), F.coalesce(F.sum(F.when(sure, F.col("n"))), zero).alias("trusted_prefixes"), F.count_distinct(F.when(sure, F.col("state"))).alias("trusted_states"))
    abstention = F.when(F.col("prefixes") == 0, 0.0).otherwise(1 - F.col("trusted_prefixes") / F.col("prefixes"))
    metrics = cover.withColumn("abstention", abstention)
    by_bin = ok.withColumn("bin", calibration_bin(F.col("score"), bins)).groupBy("bin").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(F.col("score") * F.col("n")).alias("scores"))
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("pos") - F.col("scores")))
    ece = by_bin.agg((F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("n")).alias("ece"))
    square = F.col("pos") * F.pow(F.col("score") - 1, 2) + (F.col("n") - F.col("pos")) * F.pow("score", F.lit(2))
    error = ok.agg((F.sum(square) / F.sum("n")).alias("brier"))
    for part in (ranking_metrics(ok, counted=True).select(F.col("positives").alias("trusted_positives"), "auroc", "auprc"), ece, error):
        metrics = metrics.join(part, how="left")  # one row, or none where nothing is trusted
    return metrics.na.fill({"auroc": 0.5, "auprc": 0.0, "ece": 0.0, "brier": 0.0, "trusted_positives": 0})


def detection_latency(scored: DataFrame, threshold: float | Column, *keys: str, only_trusted: int | None = None) -> DataFrame:
    """Mean over failed runs of first alert / length; a run without alert counts 1, and so does no failed run."""
    alert = F.col("score") >= threshold
    if only_trusted is not None:
        alert = alert & (F.col("support") >= only_trusted)
    run = scored.where(~F.col("final_success")).groupBy(*keys, "trajectory_id").agg(F.min(F.when(alert, F.col("step_index"))).alias("first"), F.max("step_index").alias("length"))
    ratio = F.coalesce("first", "length") / F.col("length")
    return run.groupBy(*keys).agg(F.coalesce(F.avg(ratio), F.lit(1.0)).alias("latency"), F.count(F.lit(1)).alias("failed_runs"))


def faithfulness(pairs: DataFrame, threshold: float) -> DataFrame:
    """``pairs``: soft, discrete, label per prefix. Agreement at the threshold, mean absolute difference and AUROC gap."""
    agree = ((F.col("soft") >= threshold) == (F.col("discrete") >= threshold)).cast("double")
    base = pairs.agg(F.coalesce(F.avg(agree), F.lit(0.0)).alias("agreement"), F.coalesce(F.avg(F.abs(F.col("soft") - F.col("discrete"))), F.lit(0.0)).alias("l1"))
    area = lambda c, n: ranking_metrics(pairs.select(F.col(c).alias("score"), "label")).select(F.col("auroc").alias(n))
    both = base.crossJoin(area("soft", "soft_auroc")).crossJoin(area("discrete", "discrete_auroc"))  # one row each
    return both.withColumn("auroc_gap", F.abs(F.col("soft_auroc") - F.col("discrete_auroc")))


def matched_coverage(soft: DataFrame, discrete: DataFrame, min_support: int = MIN_SUPPORT, bins: int = BINS) -> DataFrame:
    """Soft metrics on exactly the prefixes whose discrete state is trusted (joined by run and prefix)."""
    keys = ["trajectory_id", "step_index"]
    same = soft.join(discrete.select(*keys, "state", "support"), keys)
    return trusted_metrics(same, min_support, bins)


def seed_summary(results: DataFrame, expected: DataFrame, *metrics: str) -> DataFrame:
    """Mean and sample deviation over finished seeds of each run; ``expected`` (run, seed) counts the missing ones."""
    joined = expected.join(results, ["run", "seed"], "left")
    done = F.col(metrics[0]).isNotNull()
    stats = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return joined.groupBy("run").agg(F.count_if(done).alias("finished"), F.count_if(~done).alias("missing"), *stats)


def flat_summary(nested: DataFrame, separator: str = "_") -> DataFrame:
    """Structs of a summary as columns of their own, named by their path."""

    def leaves(schema, path: tuple[str, ...] = ()):
        for f in schema.fields:
            if f.dataType.typeName() == "struct":
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    return nested.select(*(F.col(".".join(f"`{x}`" for x in p)).alias(separator.join(p)) for p in leaves(nested.schema)))
