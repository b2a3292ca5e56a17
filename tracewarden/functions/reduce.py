"""Top-k observation reduction as array expressions.

A line or unit is scored by (anchors it holds, status word, digits); the best k
are taken, earlier ones first among equals, and put back in their own order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions import markers as M
from tracewarden.functions import tags
from tracewarden.functions import text as T


def anchors(action: Column, tool: Column, args: Column, result: Column, status: Column) -> Column:
    """Lower-cased fields and argument values that a line may mention."""
    fields = F.array(*(F.lower(T.normalize(c)) for c in (action, tool, status, result)))
    values = F.when(tags.has_args(args), F.transform(F.map_values(T.args_map(args)), lambda v: F.lower(T.normalize(v)))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.concat(fields, values), lambda a: (a != "") & (a != "none"))


def score(low: Column, hints: Column) -> Column:
    """Struct that sorts as the score of a normalised, lower-cased line does. Lambdas share no common expressions, so the
    line comes ready."""
    hits = F.size(F.filter(hints, low.contains))
    status = T.contains_any(low, M.STATUS_WORDS).cast("int")
    return F.struct(hits.alias("hits"), status.alias("status"), F.regexp_count(low, F.lit(r"\p{Nd}")).alias("digits"))


def add_best(df: DataFrame, units: str, hints: str, out: str, k: int = 8) -> DataFrame:
    """``out``: the k best of the array ``units`` (lines, or units of lines) in their own order, first ones first among
    equals. Units travel through the sorts beside their scores, so no lambda reaches for an array outside it."""
    nested = "array<array" in dict(df.dtypes)[units]
    text = (lambda u: F.array_join(u, " ")) if nested else (lambda u: u)

    def keyed(x: Column) -> Column:
        s = score(x["low"], F.col(hints))
        return F.struct((-s["hits"]).alias("a"), (-s["status"]).alias("b"), (-s["digits"]).alias("c"), x["i"].alias("i"), x["u"].alias("u"))

    ready = F.transform(units, lambda u, i: F.struct(F.lower(T.normalize(text(u))).alias("low"), i.alias("i"), u.alias("u")))
    top = F.slice(F.array_sort(F.transform(ready, keyed)), 1, max(k, 0))
    own_order = F.array_sort(F.transform(top, lambda x: F.struct(x["i"].alias("i"), x["u"].alias("u"))))
    return df.withColumn(out, F.transform(own_order, lambda x: x["u"]))


def add_units(df: DataFrame, lines: str, out: str, opens) -> DataFrame:
    """``out``: consecutive lines in units; a line for which ``opens`` holds begins one."""
    df = T.staged(
        df,
        {"_start": F.filter(F.transform(lines, lambda x, i: F.when((i == 0) | opens(x), i)), lambda i: i.isNotNull())},
        {out: F.transform("_start", lambda s, k: F.slice(lines, s + 1, F.coalesce(F.get("_start", k + 1), F.size(lines)) - s))},
    )
    return df.drop("_start")


def opens_turn(line: Column) -> Column:
    return T.starts_any(F.lower(line), M.ROLE_PREFIXES)


def opens_block(line: Column) -> Column:
    return T.starts_any(F.lower(line), M.BLOCK_STARTS) | line.startswith("```")


def last_dialogue_lines(lines: Column, k: int = 8) -> Column:
    none = F.array().cast("array<string>")
    return F.aggregate(lines, none, lambda acc, x: F.when(opens_turn(x), F.concat(acc, F.array(x))).otherwise(acc), lambda acc: F.slice(acc, F.greatest(F.size(acc) - k + 1, F.lit(1)), F.lit(max(k, 0))))


def add_tool_summary(df: DataFrame, units: str, out: str) -> DataFrame:
    """``out``: one line about what tools returned; null where no tool took part."""
    tool, result, status = (F.col(x) for x in ("tool_name", "result_text", "status"))
    is_tool = lambda u: F.lower(F.get(u, 0)).startswith("tool[") | F.lower(F.get(u, 0)).startswith("tool:")
    c = F.col
    rules = (
        ((F.size("_turns") == 0) & ~tags.names_tool(tool) & ~F.lower(T.normalize(result)).contains("tool["), F.lit(None).cast("string")),
        (tags.is_error(status) | T.contains_any(c("_seen"), M.SUMMARY_ERROR), "tool_summary: tool_error"),
        (T.contains_any(c("_seen"), M.SUMMARY_MANY), "tool_summary: multiple_results"),
        (T.contains_any(c("_seen"), M.SUMMARY_FOUND), "tool_summary: lookup_success"),
    )
    df = T.staged(
        df,
        {"_turns": F.filter(units, is_tool)},
        {"_seen": T.joined(F.concat(F.transform(F.flatten("_turns"), F.lower), F.array(*(F.lower(T.normalize(x)) for x in (result, tool, status)))))},
        {out: T.first_match(rules, "tool_summary: tool_observed")},
    )
    return df.drop("_turns", "_seen")


def add_dialogue_turns(df: DataFrame, lines: str, hints: str, out: str, k: int = 8) -> DataFrame:
    """``out``: the last speaker turns (four at most) and a summary of tool turns, at most k lines in all; the best units
    where nobody speaks."""
    if k <= 0:
        return df.withColumn(out, F.slice(lines, 1, 0))
    df = add_units(df, lines, "_units", opens_turn)
    df = add_tool_summary(df, "_units", "_summary")
    df = add_best(df, "_units", hints, "_top", k)
    speaks = lambda u: F.lower(F.get(u, 0)).startswith("assistant:") | F.lower(F.get(u, 0)).startswith("user:")
    noted = F.col("_summary").isNotNull()
    reserve = F.when(noted & F.lit(k > 1), 1).otherwise(0)
    df = T.staged(
        df,
        {"_speakers": F.filter("_units", speaks)},
        {"_budget": F.greatest(F.lit(0), F.least(F.lit(4), F.size("_speakers"), F.lit(k) - reserve))},
        {"_last": F.flatten(F.slice("_speakers", F.greatest(F.size("_speakers") - F.col("_budget") + 1, F.lit(1)), F.col("_budget")))},
        {out: F.when(F.size("_speakers") == 0, F.flatten("_top")).otherwise(F.slice(F.when(noted & (F.size("_last") < k), F.concat("_last", F.array("_summary"))).otherwise(F.col("_last")), 1, k))},
    )
    return df.drop("_units", "_summary", "_top", "_speakers", "_budget", "_last")


def reduction_stats(before: Column, after: Column) -> Column:
    """Struct of lines, characters and tokens before and after."""
    text = lambda a: F.array_join(a, " ")
    return F.struct(
        F.size(before).alias("original_line_count"),
        F.size(after).alias("retained_line_count"),
        F.length(text(before)).alias("original_char_count"),
        F.length(text(after)).alias("retained_char_count"),
        T.token_count(text(before)).alias("original_token_count"),
        T.token_count(text(after)).alias("retained_token_count"),
    )
