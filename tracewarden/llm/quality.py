"""Quality rules by robust multivariate outliers (operator 5).

Every document gets a vector of transformed text statistics. For each language
and source a minimum-covariance-determinant (MCD) estimate of location and
scatter is found by concentration steps over all documents of the group, and a
document whose squared Mahalanobis distance exceeds the cut-off is rejected.

Scale: statistics are computed where the text is read and only numbers travel.
The concentration steps are aggregates with partial sums, so a hot source does
not meet in one task; one row per (language, source) comes out. The verdict is
computed in a second pass over the text, beside the group estimates, so text is
never shuffled.

Cases: null or empty text has no words and fails the base rule; the estimate of a
group leans on that of its language, and a language's on that of all rows, as if
``LEAN`` texts of the wider group belonged to it, so small groups are judged like
their language and large ones by themselves, without a size at which one turns into
the other; null language or source is a group of its own; copies
of a text count once in an estimate, so a group of copies cannot define what is
normal, while different texts with equal vectors count one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import common as C

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DIMS = 4
#: Share of a group that a concentration step keeps.
COVERAGE = 0.75
STEPS = 6
#: Weight of the wider group in an estimate, in texts.
LEAN = 40.0
#: Least standard deviation of each statistic: keeps a group of near-identical texts from rejecting everything else.
FLOOR = (0.045, 0.35, 0.5, 0.5)
#: Share of clean texts that the cut-off gives up under a normal law: one in 25 million.
TAIL = 4e-8
#: Words of prior weight that hold the ratios of short texts near their neutral value.
PRIOR = 60.0


def count_statistics(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of each row (see the module's contract), vectorised over all rows of a piece."""
    start, end, first = C.words(data, off)
    rows = len(off) - 1
    n_words = np.diff(first)
    solid = ~C._SPACE[data]
    chars = C.per_row(solid & ((data & 0xC0) != 0x80), off)
    symbols = C.per_row(SYMBOLS[data], off)
    sums = C.prefix_sums(data)
    # lines: cut at every \n and at row ends
    cut = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([off[:-1], cut + 1]), kind="stable")
    stop = np.sort(np.concatenate([off[1:], cut]), kind="stable")
    line_row = np.searchsorted(off, begin, "right") - 1
    full = np.searchsorted(start, stop) > np.searchsorted(start, begin)
    begin, stop, line_row = begin[full], stop[full], line_row[full]
    h = C.range_hash(sums, begin, stop)
    order = np.lexsort((h, line_row))
    same = (h[order][1:] == h[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    dup = np.bincount(line_row[order][1:][same], minlength=rows)
    # words covered by an 8-word window that the row holds twice or more
    wh = C.range_hash(sums, start, end)
    row = C.row_of(first)
    repeat = np.zeros(rows, np.int64)
    if len(wh) >= WINDOW:
        at = np.flatnonzero(row[: len(row) - WINDOW + 1] == row[WINDOW - 1 :])
        g = C.range_hash(C.prefix_sums(wh), at, at + WINDOW)
        order = np.lexsort((g, row[at]))
        same = (g[order][1:] == g[order][:-1]) & (row[at][order][1:] == row[at][order][:-1])
        twice = np.zeros(len(g), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(wh) + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + WINDOW, -1)
        repeat = C.per_row(np.cumsum(edge[:-1]) > 0, first)
    return dict(zip(COUNTS, (n_words, chars, symbols, dup, repeat), strict=True))


def failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > REPEAT_PERCENT * s["n_words"])


def vector(s: dict[str, np.ndarray]) -> np.ndarray:
    """Transformed statistics, rows x 4, rounded: log mean word length, and
    logarithms of the shares of symbols, repeated lines and repeated words; ``PRIOR`` words damp short texts."""
    n = s["n_words"] + PRIOR
    x = np.stack(
        [
            np.log((s["word_chars"] + 5.0 * PRIOR) / n),
            np.log(0.02 + s["n_symbols"] / n),
            np.log(0.02 + s["n_dup_lines"] * 10.0 / n),
            np.log(0.02 + s["n_repeat_words"] / n),
        ],
        axis=1,
    )
    return np.round(x, 4)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in C.pieces(batches, "text"):
        data, off = C.buffers(p.column("text"))
        s = count_statistics(data, off)
        ok = np.flatnonzero(~failed(s))
        x = vector(s)[ok]
        text = C.range_hash(C.prefix_sums(data), off[:-1], off[1:])[ok].view(np.int64)
        yield pa.RecordBatch.from_arrays([p.column("lang").take(pa.array(ok)), p.column("source").take(pa.array(ok)), pa.array(text), *(pa.array(x[:, i]) for i in range(DIMS))], names=["lang", "source", "h", *(f"x{i}" for i in range(DIMS))])


def _moments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: n, sums and cross sums (about the centre that the caller has subtracted)."""
    sums = [F.sum(f"d{i}").alias(f"s{i}") for i in range(DIMS)]
    cross = [F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"s{i}{j}") for i in range(DIMS) for j in range(i, DIMS)]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *cross)


def _inverse(pdf: pd.DataFrame, scale: float) -> pd.DataFrame:
    """Mean and precision of each group from moments about its old centre."""
    mu, prec = [], []
    for r in pdf.to_dict("records"):
        m = np.array([r[f"s{i}"] for i in range(DIMS)]) / r["n"]
        cov = np.zeros((DIMS, DIMS))
        for i in range(DIMS):
            for j in range(i, DIMS):
                cov[i, j] = cov[j, i] = r[f"s{i}{j}"] / r["n"] - m[i] * m[j]
        cov = cov * scale + np.diag(np.square(FLOOR))
        mu.append((np.array(r["c"]) + m).tolist())
        prec.append(np.linalg.inv(cov).ravel().tolist())
    return pdf.assign(mu=mu, prec=prec)


def distance(mu: str = "mu", prec: str = "prec"):
    """Squared Mahalanobis distance of x0.. from array columns ``mu`` and ``prec``, as one JVM expression."""
    d = [F.col(f"x{i}") - F.col(mu)[i] for i in range(DIMS)]
    total = F.lit(0.0)
    for i in range(DIMS):
        for j in range(DIMS):
            total = total + d[i] * d[j] * F.col(prec)[i * DIMS + j]
    return total


def chi_squared(share: float) -> float:
    """Quantile of the chi-squared law with ``DIMS`` = 4 degrees, by bisection of its closed form."""
    lo, hi = 0.0, 200.0
    for _ in range(100):
        q = (lo + hi) / 2
        lo, hi = (q, hi) if math.exp(-q / 2) * (1 + q / 2) > 1 - share else (lo, q)
    return q


#: Cut-off for the squared distance.
CUTOFF = chi_squared(1 - TAIL)


def _consistency() -> float:
    """Factor that makes the covariance of the central ``COVERAGE`` share consistent under a normal (4 dimensions): P4 / P6."""
    q = chi_squared(COVERAGE)
    return COVERAGE / (1 - math.exp(-q / 2) * (1 + q / 2 + q * q / 8))


def lean(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows with support, mu, prec and the same of the language (1) and of all rows (0): mu and prec of the mixtures."""

    def mixed(n, mu, cov, mu0, cov0):
        w = n / (n + LEAN)
        apart = mu - mu0
        return w * mu + (1 - w) * mu0, w * cov + (1 - w) * cov0 + w * (1 - w) * np.outer(apart, apart)

    out_mu, out_prec = [], []
    for r in pdf.to_dict("records"):
        mu, cov = np.array(r["mu0"]), np.linalg.inv(np.array(r["prec0"]).reshape(DIMS, DIMS))
        for k in ("1", ""):
            mu, cov = mixed(r[f"support{k}"], np.array(r[f"mu{k}"]), np.linalg.inv(np.array(r[f"prec{k}"]).reshape(DIMS, DIMS)), mu, cov)
        out_mu.append(mu.tolist())
        out_prec.append(np.linalg.inv(cov).ravel().tolist())
    return pd.DataFrame({"lang": pdf["lang"], "source": pdf["source"], "mu": out_mu, "prec": out_prec})


def estimates(points: DataFrame, keys: list[str]) -> DataFrame:
    """MCD by concentration steps for each key: columns ``keys``, mu, prec, support.

    ``points`` holds keys and x0..x3, one row per distinct text. The start is the coordinate-wise median with
    interquartile scales; every step keeps the ``COVERAGE`` share nearest to the current estimate (a mergeable quantile
    summary gives the radius) and re-estimates location and scatter from exactly those rows.
    """
    quart = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("support"), *(F.percentile_approx(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000).alias(f"q{i}") for i in range(DIMS)))

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        mu = [[r[f"q{i}"][1] for i in range(DIMS)] for r in pdf.to_dict("records")]
        prec = [np.diag([1 / max((r[f"q{i}"][2] - r[f"q{i}"][0]) / 1.349, FLOOR[i]) ** 2 for i in range(DIMS)]).ravel().tolist() for r in pdf.to_dict("records")]
        return pdf.assign(mu=mu, prec=prec)[[*keys, "support", "mu", "prec"]]

    out = ", ".join(f"{k} string" for k in keys) + ", support long, mu array<double>, prec array<double>"
    now = C.stored(quart.mapInPandas(lambda it: map(start, it), out), "mcd")
    scale = _consistency()

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        return _inverse(pdf, scale)[[*keys, "support", "mu", "prec"]]

    for _ in range(STEPS):
        far = _beside(points, now, keys).withColumn("dist", distance())
        radius = far.groupBy(*keys).agg(F.percentile_approx("dist", COVERAGE, 2000).alias("radius"))
        near = _beside(far.drop("support", "radius"), radius, keys).where("dist <= radius")
        about = near.select(*keys, *((F.col(f"x{i}") - F.col("mu")[i]).alias(f"d{i}") for i in range(DIMS)))
        moved = _beside(_moments(about, keys), now.select(*keys, "support", F.col("mu").alias("c")), keys)
        now = C.stored(moved.mapInPandas(lambda it: map(again, it), out), "mcd")
    return now


def _beside(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe join of per-group values to rows; broadcast only behind a count of the groups."""
    renamed = groups.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in groups.columns if c not in keys))
    cond = None
    for k in keys:
        c = rows[k].eqNullSafe(renamed[f"_{k}"])
        cond = c if cond is None else cond & c
    return rows.join(C.sized_broadcast(renamed), cond).drop(*(f"_{k}" for k in keys))


def fit(docs: DataFrame) -> DataFrame:
    """Estimates of every (lang, source) of ``docs``: columns lang, source, mu, prec.

    The groups, the languages and the whole corpus are three levels of one stack, so they share the concentration steps.
    """
    cols = docs.select("text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    schema = "lang string, source string, h long, " + ", ".join(f"x{i} double" for i in range(DIMS))
    none = F.lit(None).cast("string")
    levels = F.array(*(F.struct(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source")) for k, lang, source in (("2", F.col("lang"), F.col("source")), ("1", F.col("lang"), none), ("0", none, none))))
    xs = [f"x{i}" for i in range(DIMS)]
    points = C.stored(cols.mapInArrow(_vectors, schema).distinct().select(F.explode(levels).alias("k"), "h", *xs).select("k.*", "h", *xs).distinct().drop("h"), "points")
    all_levels = estimates(points, ["level", "lang", "source"])
    pick = lambda level, suffix: all_levels.where(F.col("level") == level).select(*({"2": ["lang", "source"], "1": ["lang"], "0": []}[level]), *(F.col(c).alias(f"{c}{suffix}") for c in ("support", "mu", "prec")))
    wide = pick("1", "1").crossJoin(F.broadcast(pick("0", "0")))  # one row
    both = _beside(pick("2", ""), wide, ["lang"])
    return C.stored(both.mapInPandas(lambda it: map(lean, it), "lang string, source string, mu array<double>, prec array<double>"), "groups")


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in C.pieces(batches, "text"):
        s = count_statistics(*C.buffers(p.column("text")))
        x, bad = vector(s), failed(s)
        keep = [c for c in p.schema.names if c not in _ADDED]
        yield pa.RecordBatch.from_arrays([*(p.column(c) for c in keep), *(pa.array(s[c]) for c in COUNTS), pa.array(bad), *(pa.array(x[:, i]) for i in range(DIMS))], names=[*keep, *_ADDED])


_ADDED = (*COUNTS, "base_failed", *(f"x{i}" for i in range(DIMS)))


def judge(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``docs`` with counts, base_failed, distance (null for base failures or where no group has an estimate) and kept.

    Columns of ``docs`` named like an added one are replaced.
    """
    groups = fit(docs) if groups is None else groups
    plain = docs.drop(*_ADDED, "kept", "distance", "mu", "prec")
    schema = ", ".join([*(f"`{n}` {t}" for n, t in plain.dtypes), *(f"{c} long" for c in COUNTS), "base_failed boolean", *(f"x{i} double" for i in range(DIMS))])
    rows = plain.mapInArrow(_scored, schema)
    renamed = groups.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "mu", "prec")
    cond = rows["lang"].cast("string").eqNullSafe(renamed["_lang"]) & rows["source"].cast("string").eqNullSafe(renamed["_source"])
    joined = rows.join(C.sized_broadcast(renamed), cond, "left").withColumn("distance", F.when(~F.col("base_failed"), distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return joined.withColumn("kept", kept).drop("_lang", "_source", "mu", "prec", *(f"x{i}" for i in range(DIMS)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return judge_ids(docs)


def judge_ids(docs: DataFrame) -> DataFrame:
    """The verdicts without the text."""
    groups = fit(docs)
    return judge(docs, groups).select("doc_id", *COUNTS, "base_failed", "kept", F.round("distance", 4).alias("distance"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with their own columns."""
    return judge(docs).where("kept").select(*docs.columns)
