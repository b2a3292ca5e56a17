"""Removal of label leaks from step texts, and audits for what is left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions import markers as M

STEP_FIELDS = ("context", "action_text", "result_text")
#: Fields that must not stand in feature text; fixed values.
FORBIDDEN = ("split", "final_success", "failure_bucket", "future_signature", "remaining_steps", "remaining_steps_bin", "full_length", "post_prefix")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def issues(text: Column) -> Column:
    """Struct: matched_categories (sorted), needs_drop, needs_rewrite."""
    drop = [(n, _text(text).rlike(p)) for n, p in M.DROP_RULES]
    rewrite = [(n, _text(text).rlike(p)) for n, p, _ in M.REWRITE_RULES]
    any_ = lambda hits: F.array_contains(F.array(*(h for _, h in hits)), True)
    names = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(h, n) for n, h in (*drop, *rewrite))))))
    return F.struct(names.alias("matched_categories"), any_(drop).alias("needs_drop"), any_(rewrite).alias("needs_rewrite"))


def rewritten(text: Column) -> Column:
    """The rewrites in their order, then blanks folded, at most one empty line, ends trimmed."""
    out = _text(text)
    for _, pattern, new in M.REWRITE_RULES:
        out = F.regexp_replace(out, pattern, new)
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^(?U:\s+)|(?U:\s+)$", "")


def rewrite_counts(text: Column) -> Column:
    """Map from category to replacements, counted on the text as each rewrite finds it."""
    now, counts = _text(text), {}
    for name, pattern, new in M.REWRITE_RULES:
        n = F.regexp_count(now, F.lit(pattern))
        counts[name] = counts[name] + n if name in counts else n
        now = F.regexp_replace(now, pattern, new)
    made = F.create_map(*(x for k, v in counts.items() for x in (F.lit(k), v)))
    return F.map_filter(made, lambda _, v: v > 0)


def residuals(text: Column) -> Column:
    return F.array_sort(F.array_compact(F.array(*(F.when(_text(text).rlike(p), n) for n, p in M.RESIDUAL_RULES))))


def clean_steps(steps: DataFrame, fields: Sequence[str] = STEP_FIELDS) -> DataFrame:
    """Fields rewritten where a rule fires (others keep their blanks), with affected_fields and needs_drop."""
    found = {f"_{f}": issues(F.col(f)) for f in fields}
    s = steps.withColumns(found)
    hit = lambda f, k: F.col(f"_{f}.{k}")
    affected = sum((hit(f, "needs_rewrite").cast("int") for f in fields), F.lit(0))
    drop = F.array_contains(F.array(*(hit(f, "needs_drop") for f in fields)), True)
    out = s.withColumns({**{f: F.when(hit(f, "needs_rewrite"), rewritten(F.col(f))).otherwise(F.col(f)) for f in fields}, "affected_fields": affected, "needs_drop": drop})
    return out.drop(*found)


def clean_runs(steps: DataFrame, run: str = "trajectory_id", fields: Sequence[str] = STEP_FIELDS) -> DataFrame:
    """Steps of the runs of which no field asks to be dropped, rewritten."""
    cleaned = clean_steps(steps, fields)
    gone = cleaned.where("needs_drop").select(run).distinct()
    return cleaned.join(gone, run, "left_anti").drop("needs_drop")


def leakage(text: Column, forbidden: Sequence[str] = FORBIDDEN) -> Column:
    """True where a line begins with a forbidden field and ``:`` or ``=``."""
    return _text(text).rlike(rf"(?im)^\s*({'|'.join(forbidden)})\s*[:=]")


def assert_no_leakage(rows: DataFrame, text: str, forbidden: Sequence[str] = FORBIDDEN) -> DataFrame:
    bad = F.raise_error(F.concat(F.lit("a feature text holds a label field: "), F.substring(text, 1, 120)))
    return rows.withColumn(text, F.when(leakage(F.col(text), forbidden), bad.cast("string")).otherwise(F.col(text)))


def completeness(steps: DataFrame, raw: str = "source_raw_text", run: str = "trajectory_id") -> DataFrame:
    """One row: runs, steps, steps without raw text, and the first five such runs."""
    missing = F.trim(F.coalesce(raw, F.lit(""))) == ""
    bad = F.slice(F.array_sort(F.collect_set(F.when(missing, F.col(run)))), 1, 5)
    return steps.agg(F.countDistinct(run).alias("runs"), F.count(F.lit(1)).alias("steps"), F.count_if(missing).alias("missing_steps"), bad.alias("first_missing"))


def clean_summary(steps: DataFrame, *keys: str) -> DataFrame:
    """Counters of a cleaned steps frame by key (split, trace format, ...)."""
    return steps.groupBy(*keys).agg(F.countDistinct("trajectory_id").alias("runs"), F.countDistinct("task_id").alias("tasks"), F.count(F.lit(1)).alias("steps"), F.sum("affected_fields").alias("affected_fields"))
