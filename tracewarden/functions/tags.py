"""Rule-derived tags of a step: ordered rules over normalised text, compiled to CASE expressions.

Each function takes Columns of one step and returns one Column; ``lines`` columns
are arrays of normalised lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions import markers as M
from tracewarden.functions import text as T


def is_error(status: Column) -> Column:
    return F.lower(T.normalize(status)).isin(*M.ERROR_STATUSES)


def names_tool(tool: Column) -> Column:
    return ~F.lower(T.normalize(tool)).isin(*M.NO_TOOL)


def has_args(args: Column) -> Column:
    return ~F.coalesce(args, F.lit("")).isin("", "{}")


def signature(*parts: Column) -> Column:
    """Lower-cased parts that aren't empty, joined by a blank."""
    return T.joined(F.array(*(F.lower(T.normalize(p)) for p in parts)))


# --- process traces --------------------------------------------------------------------------------------------------


def trace_family(metadata: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in M.TRACE_FAMILIES.items() for x in kv))
    return F.coalesce(F.element_at(known, F.lower(F.coalesce(T.line_value(metadata, "trace_format="), F.lit("")))), F.lit("generic"))


def exit_code(args: Column, result: Column) -> Column:
    """From the arguments if they hold an integer, else from the result's text."""
    raw = F.get_json_object(args, "$.exit_code")
    own = F.when(raw.rlike(r"^-?\d+$"), raw.try_cast("int")).when(raw.isin("true", "false"), (raw == "true").cast("int"))
    told = F.regexp_extract(result, r"(?i)exit code:\s*(-?\d+)", 1).try_cast("int")
    return F.coalesce(F.when(has_args(args), own), told)


def exit_code_bucket(code: Column) -> Column:
    rules = ((code.isNull(), "none"), (code == 0, "zero"), (code.isin(1, 2), "error_generic"), (code == 126, "error_notexec"), (code == 127, "error_notfound"), (code >= 128, "error_signal"))
    return T.first_match(rules, "error_other")


def result_channel(result: Column) -> Column:
    text = T.normalize(result)
    low = F.lower(text)
    return T.first_match(((text.isin("", T.NONE), "none"), (low.startswith("result="), "result_block"), (low.startswith("error="), "error_block"), (low.startswith("output="), "output_block")), "plain_text")


def process_kind(family: Column, action: Column, tool: Column) -> Column:
    runs = family.isin("codex_exec", "gemini_exec", "trajectory_exec") & names_tool(tool)
    rules = (
        (runs & (F.lower(T.normalize(tool)) == "bash"), "command_exec"),
        (runs, "tool_exec"),
        (names_tool(tool) | F.lower(T.normalize(action)).contains("tool_call"), "tool_call"),
    )
    return T.first_match(rules, "dialogue_response")


def process_outcome(kind: Column, status: Column, channel: Column, code: Column) -> Column:
    bad, runs = is_error(status), kind.isin("command_exec", "tool_exec")
    failed = bad | (channel == "error_block")
    rules = (
        ((kind == "dialogue_response") & bad, "dialogue_error"),
        (kind == "dialogue_response", "dialogue_only"),
        ((kind == "tool_call") & failed, "tool_error"),
        ((kind == "tool_call") & channel.isin("result_block", "output_block", "plain_text"), "tool_result"),
        (kind == "tool_call", "tool_call_only"),
        (runs & (code == 0), "command_success"),
        (runs & (code.isNotNull() | failed), "command_error"),
        (runs & channel.isin("output_block", "plain_text"), "command_success"),
        (runs, "command_observed"),
    )
    return T.first_match(rules, "generic")


def process_signature(metadata: Column, action: Column, args: Column, result: Column) -> Column:
    prompts = [F.coalesce(T.line_value(metadata, p), F.lit("")) for p in ("recent_reasoning=", "task_prompt=", "initial_prompt=", "episode_prompt=")]
    scalars = F.filter(F.map_values(T.args_map(args)), lambda v: v.isNotNull() & ~v.startswith("{") & ~v.startswith("["))
    values = F.transform(scalars, lambda v: F.lower(T.normalize(v)))
    return T.joined(F.concat(F.array(*(F.lower(T.normalize(p)) for p in (action, result, *prompts))), F.when(has_args(args), values).otherwise(F.array().cast("array<string>"))))


def command_text(action: Column, args: Column) -> Column:
    return signature(action, F.coalesce(F.get_json_object(args, "$.command"), F.lit("")))


def process_phase(sign: Column, command: Column, kind: Column, tool: Column) -> Column:
    runs, name = kind.isin("command_exec", "tool_exec"), F.lower(T.normalize(tool))
    either = lambda words: T.contains_any(sign, words) | (runs & T.contains_any(command, words))
    rules = (
        (T.contains_any(sign, M.VERIFY), "verify"),
        (either(M.TEST), "test"),
        (either(M.BUILD), "build"),
        ((name == "write_file") | T.contains_any(sign, M.EDIT), "edit"),
        (name.isin("read_file", "google_web_search") | T.contains_any(sign, M.INSPECT), "inspect"),
    )
    return T.first_match(rules, "unknown")


def error_persistence(sign: Column, status: Column, code: Column, channel: Column) -> Column:
    wrong = F.coalesce(code != 0, F.lit(False)) | is_error(status) | (channel == "error_block") | T.contains_any(sign, M.ERROR_WORDS)
    return T.first_match(((~wrong, "no_error"), (T.contains_any(sign, M.RETRY), "repeated_error")), "new_error")


def retry_pattern(sign_without_result: Column) -> Column:
    s = sign_without_result
    return T.first_match(((~T.contains_any(s, M.RETRY_PATTERN), "none"), (T.contains_any(s, M.SAME_COMMAND), "same_command_retry")), "same_goal_retry")


def progress_state(phase: Column, outcome: Column, status: Column, persistence: Column) -> Column:
    moved = phase.isin("inspect", "edit", "build", "test", "verify") & outcome.isin("tool_result", "command_success", "command_observed", "dialogue_only")
    rules = (
        (F.lower(T.normalize(status)).isin("failed", "failure"), "regression"),
        ((persistence != "no_error") | outcome.isin("command_error", "tool_error", "dialogue_error"), "no_progress"),
        (moved, "progress"),
    )
    return T.first_match(rules, "no_progress")


PROCESS_TAGS = ("trace_family", "agent_family", "step_kind", "outcome", "result_channel", "exit_code", "task_type", "exit_code_fine", "phase", "error_persistence", "retry_pattern", "progress_state")


def add_process_tags(df: DataFrame, metadata: str = "metadata_lines") -> DataFrame:
    """``df`` (metadata lines, action_text, tool_name, tool_args, result_text, status) with a struct ``process`` of
    PROCESS_TAGS; task_type is null where the context names no task."""
    md, action, tool, args, result, status = (F.col(x) for x in (metadata, "action_text", "tool_name", "tool_args", "result_text", "status"))
    c = lambda n: F.col(f"_p_{n}")
    task = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(T.line_value(md, "task_name="), F.lit(""))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    df = T.staged(
        df,
        {
            "_p_trace_family": trace_family(md),
            "_p_agent_family": T.slug(F.coalesce(T.line_value(md, "agent_name="), F.lit(""))),
            "_p_result_channel": result_channel(result),
            "_p_code": exit_code(args, result),
            "_p_task_type": F.nullif(task, F.lit("")),
            "_p_sign": process_signature(md, action, args, result),
            "_p_sign_only": process_signature(md, action, args, F.lit("")),
            "_p_command": command_text(action, args),
        },
        {"_p_step_kind": process_kind(c("trace_family"), action, tool), "_p_exit_code": T.first_match(((c("code").isNull(), "none"), (c("code") == 0, "zero")), "nonzero"), "_p_exit_code_fine": exit_code_bucket(c("code")), "_p_retry_pattern": retry_pattern(c("sign_only")), "_p_error_persistence": error_persistence(c("sign"), status, c("code"), c("result_channel"))},
        {"_p_outcome": process_outcome(c("step_kind"), status, c("result_channel"), c("code")), "_p_phase": process_phase(c("sign"), c("command"), c("step_kind"), tool)},
        {"_p_progress_state": progress_state(c("phase"), c("outcome"), status, c("error_persistence"))},
        {"process": F.struct(*(c(n).alias(n) for n in PROCESS_TAGS))},
    )
    return df.drop(*(x for x in df.columns if x.startswith("_p_")))


def process_lines(profile: str | None = None) -> Column:
    """Tag lines of ``process`` that the profile enables."""
    name = (profile or "").strip().lower()
    optional = M.PROCESS_PROFILES["process-full-v1"]
    enabled = optional if name in ("", "none", "baseline") else M.PROCESS_PROFILES.get(name, ())
    return F.array_compact(F.array(*(F.concat(F.lit(f"skillsbench_{k}="), F.col("process")[k]) for k in PROCESS_TAGS if k not in optional or k in enabled)))


# --- dialogue traces -------------------------------------------------------------------------------------------------


def speaker_pattern(lines: Column) -> Column:
    """Speakers of the dialogue lines, repeats collapsed, the last four joined by an arrow."""
    last_but = lambda acc, k: F.get(acc, F.size(acc) - k)
    grown = lambda acc, x: F.when(T.role_of(x).isNull() | (T.role_of(x) == F.coalesce(last_but(acc, 1), F.lit(""))), acc).otherwise(F.concat(acc, F.array(T.role_of(x))))
    end = lambda acc: F.when(F.size(acc) == 0, F.lit("none")).otherwise(F.array_join(F.slice(acc, F.greatest(F.size(acc) - 3, F.lit(1)), F.lit(4)), "->"))
    return F.aggregate(lines, F.array().cast("array<string>"), grown, end)


def guides(action: Column) -> Column:
    low = F.lower(T.normalize(action))
    return (low != "") & ~low.contains("tool_call ") & T.contains_any(low, M.GUIDANCE)


def asks(action: Column) -> Column:
    low = F.lower(T.normalize(action))
    return (low != "") & ~low.contains("tool_call ") & T.contains_any(low, M.QUERY)


def dialogue_kind(action: Column, tool: Column, result: Column, status: Column) -> Column:
    rules = (
        (names_tool(tool) | F.lower(T.normalize(action)).contains("tool_call "), "invoke_tool"),
        (F.lower(T.normalize(result)).contains("tool["), "explain_tool_result"),
        (guides(action), "guide_user_action"),
        (asks(action), "ask_or_confirm"),
        (is_error(status), "handoff_or_fail"),
    )
    return T.first_match(rules, "assistant_response")


def control_locus(kind: Column) -> Column:
    return T.first_match(((kind == "invoke_tool", "agent"), (kind == "guide_user_action", "user-mediated")), "dialogue-only")


#: Dialogue act, verification state, tool phase and hand-off state by rule; fixed values.
_COMPACT = {
    "error": ("handoff", "failed", "error", "system_error"),
    "invoke_tool": ("tool_call", "grounded", "invoke", "none"),
    "guide_user_action": ("user_guidance", "collecting", "none", "user_action_required"),
    "ask_or_confirm": ("query_or_confirm", "collecting", "none", "none"),
    "explain_tool_result": ("inform", "verified", "post_tool", "none"),
    "other": ("inform", "none", "none", "none"),
}


def compact_tags(kind: Column, action: Column, result: Column, status: Column) -> Column:
    """Struct of dialogue_act, verification_state, tool_phase, handoff_state."""
    low = F.lower(T.normalize(action))
    case = T.first_match(
        (
            (is_error(status), "error"),
            (kind.isin("invoke_tool", "guide_user_action", "ask_or_confirm"), kind),
            ((kind == "explain_tool_result") | F.lower(T.normalize(result)).contains("tool["), "explain_tool_result"),
            (T.contains_any(low, ("unable to", "cannot ", "can't ")), "error"),
        ),
        "other",
    )
    pick = lambda i: T.first_match(((case == k, v[i]) for k, v in _COMPACT.items()), "none")
    return F.struct(*(pick(i).alias(n) for i, n in enumerate(("dialogue_act", "verification_state", "tool_phase", "handoff_state"))))


def dialogue_signature(lines: Column, action: Column, result: Column) -> Column:
    parts = F.concat(F.transform(lines, lambda x: F.lower(T.normalize(x))), F.array(F.lower(T.normalize(action)), F.lower(T.normalize(result))))
    return T.joined(parts)


def collecting_subtype(sign: Column) -> Column:
    rules = ((T.contains_any(sign, M.IDENTITY), "identity_verification"), (T.contains_any(sign, M.LOOKUP), "order_or_account_lookup"), (T.contains_any(sign, M.OPTION), "option_confirmation"), (T.contains_any(sign, M.CONSTRAINT), "constraint_clarification"))
    return T.first_match(rules, "generic_followup")


def collecting_mode(action: Column) -> Column:
    return F.when(T.contains_any(F.lower(T.normalize(action)), M.CONFIRM), "confirm").otherwise("query")


def tool_role(tool: Column) -> Column:
    low = F.lower(T.normalize(tool))
    rules = ((~names_tool(tool), "none"), (T.contains_any(low, M.TOOL_IRREVERSIBLE), "irreversible_write"), (T.contains_any(low, M.TOOL_QUOTE), "quote"), (T.contains_any(low, M.TOOL_CHECK), "check"), (T.contains_any(low, M.TOOL_READ), "read"))
    return T.first_match(rules, "write")


def verification_obligation(sign: Column, tool: Column) -> Column:
    account = T.contains_any(sign, M.ACCOUNT) | F.lower(T.normalize(tool)).isin(*M.ACCOUNT_TOOLS)
    return T.first_match(((T.contains_any(sign, M.POLICY), "policy_needed"), (T.contains_any(sign, M.OBLIGATION_IDENTITY), "identity_needed"), (account, "account_needed")), "none")


def argument_risk(args: Column) -> Column:
    keys = F.transform(F.coalesce(F.json_object_keys(args), F.array().cast("array<string>")), lambda k: F.lower(T.normalize(k)))
    holds = lambda words: F.exists(keys, lambda k: T.contains_any(k, words))
    rules = ((~has_args(args), "none"), (holds(M.KEY_IDENTIFIER), "identifier"), (holds(M.KEY_TIME), "time_or_date"), (holds(M.KEY_QUANTITY), "quantity_or_amount"))
    return T.first_match(rules, "none")


def result_state(role: Column, sign: Column, result: Column, status: Column) -> Column:
    reads, writes = role.isin("read", "check", "quote"), role.isin("write", "irreversible_write")
    rules = (
        (T.contains_any(sign, M.RESULT_POLICY), "policy_block"),
        (reads & T.contains_any(sign, M.RESULT_EMPTY), "lookup_empty"),
        (reads & ~is_error(status) & ~T.normalize(result).isin("", T.NONE), "lookup_ok"),
        (writes & is_error(status), "write_error"),
        (writes & T.contains_any(sign, M.RESULT_WRITTEN), "write_success"),
    )
    return T.first_match(rules, "none")


def obligation_state(act: Column, verification: Column, role: Column, obligation: Column, state: Column) -> Column:
    writes = role.isin("write", "irreversible_write")
    rules = (
        (obligation == "none", "none"),
        (writes & state.isin("policy_block", "write_error"), "unsafe_write_attempt"),
        (writes, "write_before_verification"),
        ((verification == "collecting") | act.isin("query_or_confirm", "user_guidance"), "pending_verification"),
        (verification == "verified", "verification_cleared"),
        (act == "tool_call", "verification_in_tool_loop"),
    )
    return T.first_match(rules, "pending_verification")


DIALOGUE_TAGS = ("step_kind", "control_locus", "speaker_pattern", "dialogue_act", "verification_state", "tool_phase", "handoff_state")
SEMANTIC_TAGS = ("tool_role", "verification_obligation", "obligation_state", "argument_risk", "result_state")
COLLECTING_TAGS = ("query_collecting_subtype", "query_collecting_mode")


def add_dialogue_tags(df: DataFrame, lines: str = "observation_lines") -> DataFrame:
    """``df`` (observation lines, action_text, tool_name, tool_args, result_text, status) with a struct ``dialogue`` of
    DIALOGUE_TAGS, SEMANTIC_TAGS and COLLECTING_TAGS."""
    obs, action, tool, args, result, status = (F.col(x) for x in (lines, "action_text", "tool_name", "tool_args", "result_text", "status"))
    c = lambda n: F.col(f"_d_{n}")
    df = T.staged(
        df,
        {
            "_d_step_kind": dialogue_kind(action, tool, result, status),
            "_d_speaker_pattern": speaker_pattern(obs),
            "_d_sign": dialogue_signature(obs, action, result),
            "_d_tool_role": tool_role(tool),
            "_d_argument_risk": argument_risk(args),
            "_d_query_collecting_mode": collecting_mode(action),
        },
        {
            "_d_control_locus": control_locus(c("step_kind")),
            "_d_small": compact_tags(c("step_kind"), action, result, status),
            "_d_verification_obligation": verification_obligation(c("sign"), tool),
            "_d_result_state": result_state(c("tool_role"), c("sign"), result, status),
            "_d_query_collecting_subtype": collecting_subtype(c("sign")),
        },
        {f"_d_{n}": c("small")[n] for n in DIALOGUE_TAGS[3:]},
        {"_d_obligation_state": obligation_state(c("dialogue_act"), c("verification_state"), c("tool_role"), c("verification_obligation"), c("result_state"))},
        {"dialogue": F.struct(*(c(n).alias(n) for n in (*DIALOGUE_TAGS, *SEMANTIC_TAGS, *COLLECTING_TAGS)))},
    )
    return df.drop(*(x for x in df.columns if x.startswith("_d_")))


def dialogue_lines(profile: str | None = None) -> Column:
    """Tag lines of ``dialogue`` that the profile enables."""
    name = (profile or "").strip().lower()
    name = "" if name in ("none", "baseline", "compact-v1") else name
    d = F.col("dialogue")
    enabled = M.DIALOGUE_PROFILES.get(name, ())
    out = [F.concat(F.lit(f"{k}="), d[k]) for k in (*DIALOGUE_TAGS, *(s for s in SEMANTIC_TAGS if s in enabled))]
    if name:
        asked = (d["dialogue_act"] == "query_or_confirm") & (d["verification_state"] == "collecting")
        out.append(F.when(asked, F.concat(F.lit("query_collecting_subtype="), d["query_collecting_subtype"])))
        if name in ("collecting-subtypes-v2", "collecting-subtypes-v3"):
            out.append(F.when(asked, F.concat(F.lit("query_collecting_mode="), d["query_collecting_mode"])))
        if name == "collecting-subtypes-v3":
            known = d["query_collecting_subtype"].isin("identity_verification", "order_or_account_lookup")
            out.append(F.when(asked, F.concat(F.lit("query_collecting_has_identifier="), known.cast("int").cast("string"))))
    return F.array_compact(F.array(*out))
