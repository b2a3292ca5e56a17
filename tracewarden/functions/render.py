"""Step views and their text renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions import markers as M
from tracewarden.functions import reduce as R
from tracewarden.functions import tags
from tracewarden.functions import text as T

TEXT_MODES = ("full", "lexical", "transfer-full", "drop-tool", "drop-status", "drop-args", "drop-result", "drop-args-result", "observation-only")
REPRESENTATIONS = ("legacy", "source-raw", "reduced-dense", "hybrid")


def legacy_text(context: Column, action: Column, tool: Column, args: Column, result: Column, status: Column) -> Column:
    """One line with context, action and result of a step."""
    name = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(T.NONE))
    return F.concat(F.lit("CONTEXT=["), T.normalize(context), F.lit("] ACTION=[action="), T.normalize(action), F.lit("; tool="), name(tool), F.lit("; args="), F.coalesce(args, F.lit("{}")), F.lit("] RESULT=[status="), name(status), F.lit("; text="), T.normalize(result), F.lit("]"))


def source_raw_text(raw: Column, strict: bool = True) -> Column:
    text = T.normalize(raw)
    missing = F.raise_error(F.lit("source-raw needs source_raw_text on every step")).cast("string") if strict else F.lit(None).cast("string")
    return F.when(text == "", missing).otherwise(text)


def inferred_dataset(context: Column) -> Column:
    value = T.line_value(T.full_lines(context), "dataset=")
    return F.coalesce(F.lower(value), F.lit("webarena"))


def split_context(lines: Column, markers: tuple[str, ...] = ("observation=",), fallback: bool = True) -> Column:
    """Struct of metadata (md) and observation (obs) lines: a marker line opens the observation; without one the first
    two lines are metadata."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("md"), empty.alias("obs"), F.lit(False).alias("opened"))

    def step(acc: Column, line: Column) -> Column:
        marker = T.starts_any(line, markers)
        inline = T.first_match(((line.startswith(p), T.normalize(F.substr(line, F.lit(len(p) + 1)))) for p in markers), line)
        md = F.when(acc["opened"] | marker, acc["md"]).otherwise(F.concat(acc["md"], F.array(line)))
        obs = F.when((acc["opened"] | marker) & (inline != ""), F.concat(acc["obs"], F.array(inline))).otherwise(acc["obs"])
        return F.struct(md.alias("md"), obs.alias("obs"), (acc["opened"] | marker).alias("opened"))

    def finish(acc: Column) -> Column:
        short = (F.size(acc["obs"]) == 0) & F.lit(fallback)
        md = F.when(short, F.slice(acc["md"], 1, 2)).otherwise(acc["md"])
        obs = F.when(short, F.slice(acc["md"], F.lit(3), F.greatest(F.size(acc["md"]) - 2, F.lit(0)))).otherwise(acc["obs"])
        return F.struct(md.alias("md"), obs.alias("obs"))

    return F.aggregate(lines, start, step, finish)


def split_process_context(lines: Column) -> Column:
    """Struct of md and obs by a fold over the lines: known prefixes are metadata wherever they stand, a marker or a
    speaker opens the observation, and other lines before it go on with the metadata line above."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("md"), empty.alias("obs"), F.lit(False).alias("opened"), F.lit(False).alias("goes_on"))

    def step(acc: Column, line: Column) -> Column:
        kind = T.first_match(
            (
                (line.isin("observation=", "dialogue_history="), "marker"),
                (T.starts_any(line, M.PROCESS_METADATA), "known"),
                (acc["opened"], "observed"),
                (T.starts_any(F.lower(line), M.ROLE_PREFIXES), "spoken"),
                (acc["goes_on"], "joins"),
            ),
            "observed",
        )
        n = F.size(acc["md"])
        joined = F.concat(F.slice(acc["md"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.get(acc["md"], n - 1), F.lit("")), F.lit(" "), line)))
        md = F.when(kind == "known", F.concat(acc["md"], F.array(line))).when(kind == "joins", joined).otherwise(acc["md"])
        obs = F.when(kind.isin("observed", "spoken"), F.concat(acc["obs"], F.array(line))).otherwise(acc["obs"])
        goes_on = F.when(kind.isin("marker", "spoken"), F.lit(False)).when(kind == "known", F.lit(True)).otherwise(acc["goes_on"])
        return F.struct(md.alias("md"), obs.alias("obs"), (acc["opened"] | kind.isin("marker", "spoken")).alias("opened"), goes_on.alias("goes_on"))

    return F.aggregate(lines, start, step, lambda acc: F.struct(acc["md"].alias("md"), acc["obs"].alias("obs")))


FRONTS = ("skillsbench", "terminalbench", "tau2bench")


def step_views(steps: DataFrame, max_lines: int = 8, dataset: str | None = None, dialogue_profile: str | None = None, process_profile: str | None = None) -> DataFrame:
    """``steps`` with metadata_lines, observation_lines, normalised fields and reduction_stats.

    The front end is ``dataset``, or what each context names. With a named one only its own rules are in the plan.
    """
    name = (dataset or "").strip().lower()
    name = "" if name == "inferred" else name
    front = F.lit(name) if name else inferred_dataset(F.col("context"))
    may = lambda *f: not name or name in f
    choose = lambda options, otherwise: T.first_match(((F.col("_front") == f, c) for f, c in options if may(f)), otherwise)
    lines = F.col("_lines")
    s = T.staged(
        steps,
        {"_front": front, "_lines": T.full_lines("context"), "action_text": T.normalize("action_text"), "tool_name": T.or_none(F.col("tool_name")), "result_text": T.normalize("result_text"), "status": T.or_none(F.col("status")), "tool_args": F.coalesce("tool_args", F.lit("{}"))},
        {"_split": choose((("skillsbench", split_process_context(lines)), ("terminalbench", split_context(lines, ("observation=", "history="), fallback=False))), split_context(lines))},
        {"_md": F.col("_split.md"), "_obs": F.col("_split.obs"), "_hints": R.anchors(*(F.col(x) for x in ("action_text", "tool_name", "tool_args", "result_text", "status")))},
    )
    metadata, kept = [], []
    if may("tau2bench"):
        s = R.add_dialogue_turns(tags.add_dialogue_tags(s, "_obs"), "_obs", "_hints", "_turns", max_lines)
        metadata.append(("tau2bench", F.array_distinct(F.concat("_md", tags.dialogue_lines(dialogue_profile)))))
        kept.append(("tau2bench", F.col("_turns")))
    if may("skillsbench", "terminalbench"):
        s = R.add_best(R.add_units(s, "_obs", "_units", R.opens_block), "_units", "_hints", "_blocks", max_lines).withColumn("_blocks", F.flatten("_blocks"))
        kept.append(("terminalbench", F.col("_blocks")))
    if may("skillsbench"):
        s = tags.add_process_tags(s, "_md")
        family = F.col("process.trace_family")
        own = F.when(family.isin("claude_dialogue", "gemini_exec", "gemini_text"), R.last_dialogue_lines(F.col("_obs"), max_lines)).when(family == "codex_exec", F.slice("_obs", 1, 0)).otherwise(F.col("_blocks"))
        metadata.append(("skillsbench", F.array_distinct(F.concat("_md", tags.process_lines(process_profile)))))
        kept.append(("skillsbench", own))
    if not name or name not in FRONTS:
        s = R.add_best(s, "_obs", "_hints", "_top_lines", max_lines)
    other = F.col("_top_lines") if "_top_lines" in s.columns else F.col("_obs")
    s = T.staged(
        s,
        {"metadata_lines": choose(metadata, F.col("_md")), "observation_lines": choose(kept, other)},
        {"metadata_lines": F.when(F.size("metadata_lines") == 0, F.array(F.lit("NO_METADATA"))).otherwise(F.col("metadata_lines")), "reduction_stats": R.reduction_stats(F.col("_obs"), F.col("observation_lines"))},
    )
    return s.drop("dialogue", "process", *(x for x in s.columns if x.startswith("_")))


def bar_joined(lines: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(lines, " | "), F.lit("")), F.lit(T.NONE))


def without_prefixes(lines: Column, prefixes: tuple[str, ...]) -> Column:
    return F.filter(lines, lambda x: ~T.starts_any(x, prefixes)) if prefixes else lines


def view_text(mode: str = "full", exclude: tuple[str, ...] = ()) -> Column:
    """Text of a step view (columns as step_views makes them) in one of TEXT_MODES."""
    if mode not in TEXT_MODES:
        raise ValueError(f"unknown text mode {mode}; known are {', '.join(TEXT_MODES)}")
    observation = bar_joined(F.col("observation_lines"))
    if mode == "observation-only":
        return observation
    dropped = set(mode.removeprefix("drop-").split("-")) if mode.startswith("drop-") else set()
    field = lambda key, c, blank=T.NONE: F.concat(F.lit(f"{key}="), F.lit(blank) if key in dropped else F.col(c))
    parts = [field("tool", "tool_name"), field("status", "status"), field("action", "action_text"), field("args", "tool_args", "{}"), field("result", "result_text"), F.concat(F.lit("meta="), bar_joined(without_prefixes(F.col("metadata_lines"), exclude)))]
    if mode == "transfer-full":
        parts.append(F.concat(F.lit("observation="), observation))
    return F.concat_ws(" ", *parts)


def dense_chunks() -> Column:
    both = F.concat(F.col("metadata_lines"), F.col("observation_lines"))
    return F.when(F.size(both) == 0, F.array(F.lit("NO_OBSERVATION"))).otherwise(both)


def field_chunks() -> Column:
    named = (("tool", F.col("tool_name")), ("status", F.col("status")), ("action", F.col("action_text")), ("args", F.col("tool_args")), ("result", F.col("result_text")), ("meta", bar_joined(F.col("metadata_lines"))), ("observation", bar_joined(F.col("observation_lines"))))
    return F.array(*(F.concat(F.lit(f"{k}="), c) for k, c in named))


def route_groups() -> Column:
    c = field_chunks()
    at = lambda *i: F.array(*(F.get(c, k) for k in i))
    return F.array(at(0, 1, 3), at(2, 4), at(5, 6))


def view_line() -> Column:
    """A step view on one line."""
    return F.concat(F.lit("METADATA=["), bar_joined(F.col("metadata_lines")), F.lit("] OBSERVATION=["), bar_joined(F.col("observation_lines")), F.lit("] ACTION=[action="), F.col("action_text"), F.lit("; tool="), F.col("tool_name"), F.lit("; args="), F.col("tool_args"), F.lit("] RESULT=[status="), F.col("status"), F.lit("; text="), F.col("result_text"), F.lit("]"))


def payloads(steps: DataFrame, representation: str = "legacy", **options) -> DataFrame:
    """``steps`` with ``payload``, the text of each step in the representation."""
    if representation not in REPRESENTATIONS:
        raise ValueError(f"unknown representation {representation}; known are {', '.join(REPRESENTATIONS)}")
    if representation == "legacy":
        return steps.withColumn("payload", legacy_text(*(F.col(c) for c in ("context", "action_text", "tool_name", "tool_args", "result_text", "status"))))
    if representation == "source-raw":
        return steps.withColumn("payload", source_raw_text(F.col("source_raw_text")))
    return step_views(steps, **options).withColumn("payload", view_line())
