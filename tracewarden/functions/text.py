"""Text expressions: every function takes and returns Columns and stays in the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "NONE"
SPACE_RUN = r"(?U:[\s\x1c-\x1f]+)"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(c: Column | str) -> Column:
    """White space folded to single blanks and trimmed; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(column(c), F.lit("")), SPACE_RUN, " "))


def strip(c: Column | str) -> Column:
    """White space cut at both ends only; null counts as empty."""
    return F.regexp_replace(F.coalesce(column(c), F.lit("")), rf"^{SPACE_RUN}|{SPACE_RUN}$", "")


def or_none(c: Column) -> Column:
    """``NONE`` for null or blank."""
    n = normalize(c)
    return F.when(n == "", F.lit(NONE)).otherwise(n)


def truncate(c: Column, limit: int) -> Column:
    mark = "...<truncated>"
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - 16), F.lit(mark)))


def compact(c: Column | str, limit: int = 800) -> Column:
    return truncate(or_none(column(c)), limit)


def token_count(c: Column | str) -> Column:
    n = normalize(c)
    return F.when(n == "", F.lit(0)).otherwise(F.size(F.split(n, " ")))


def lines(c: Column | str) -> Column:
    """Lines without their ends; a break at the very end opens no line."""
    text = F.coalesce(column(c), F.lit(""))
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def full_lines(c: Column | str) -> Column:
    """Normalised lines that aren't empty. The text is split once, as an empty line at the end is none here anyway."""
    return F.filter(F.transform(F.split(F.coalesce(column(c), F.lit("")), LINE_BREAK, -1), normalize), lambda x: x != "")


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def contains_any(c: Column, markers: Iterable[str]) -> Column:
    return any_of(c.contains(m) for m in markers)


def starts_any(c: Column, prefixes: Iterable[str]) -> Column:
    return any_of(c.startswith(p) for p in prefixes)


def first_match(rules: Iterable[tuple[Column, Column | str]], otherwise: Column | str) -> Column:
    """Value of the first rule that holds."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    chain = None
    for test, value in rules:
        chain = F.when(test, lit(value)) if chain is None else chain.when(test, lit(value))
    return lit(otherwise) if chain is None else chain.otherwise(lit(otherwise))


def slug(c: Column, default: str = "unknown") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(normalize(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def joined(parts: Column, separator: str = " ") -> Column:
    """Parts that aren't empty, joined."""
    return F.array_join(F.filter(parts, lambda x: x != ""), separator)


def line_value(all_lines: Column, prefix: str) -> Column:
    """What follows ``prefix`` in the first line where something does; null without one."""
    found = F.filter(F.transform(F.filter(all_lines, lambda x: x.startswith(prefix)), lambda x: normalize(F.substr(x, F.lit(len(prefix) + 1)))), lambda x: x != "")
    return F.get(found, 0)


def args_map(args: Column) -> Column:
    return F.coalesce(F.from_json(args, "map<string,string>"), F.create_map().cast("map<string,string>"))


def role_of(line: Column) -> Column:
    """Speaker of a dialogue line, null for others."""
    low = F.lower(line)
    return first_match(((low.startswith("assistant:"), "assistant"), (low.startswith("user:"), "user"), (low.startswith("tool[") | low.startswith("tool:"), "tool"), (low.startswith("system:"), "system")), F.lit(None).cast("string"))


def listed(df: DataFrame, keys: list[str], items: str, position: str, item: str) -> DataFrame:
    """keys, position (from 0) and item: a row for each item of an array made before. Rows without items go after the array is
    spread: a test of its size beforehand would make the array a second time, and what it is made of anew for each item."""
    return df.select(*keys, F.posexplode_outer(items).alias(position, item)).where(F.col(position).isNotNull())


def staged(df: DataFrame, *stages: dict[str, Column]) -> DataFrame:
    """Columns added stage by stage, so that a value used often is computed once and the plan stays small."""
    for stage in stages:
        df = df.withColumns(stage)
    return df
