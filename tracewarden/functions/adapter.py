"""Declarative projection specs: a checked document that compiles to columns."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions import reduce as R
from tracewarden.functions import render
from tracewarden.functions import text as T

#: Values that a spec may hold; fixed values.
FAMILIES = ("browser", "visual-browser", "desktop", "conversation-tooluse", "coding-agent", "unknown")
UNITS = ("line", "dialogue_turn", "log_block", "kv_block", "none")
REDUCERS = ("lexical_lines", "dialogue_turns", "log_blocks", "kv_blocks", "none")
STATUS_MODES = ("native", "native_or_derive", "derive", "none")
STATUSES = ("ok", "tool_error", "failed", "warning", "unknown")
LINE_KEYS = ("dataset", "task_id", "domain", "policy_variant", "agent_model", "user_model", "trial_name", "condition_dir", "agent_name", "agent_model_name", "trace_format", "task_prompt")
METADATA = ("context:metadata_block", *(f"context:line:{k}=" for k in LINE_KEYS), "field:tool_name", "field:status")
SOURCES = {
    "observation_source": ("context:observation_block", "context:all_lines", "field:action_text", "field:result_text", "none"),
    "action_source": ("field:action_text", "field:result_text", "none"),
    "tool_source": ("field:tool_name", "none"),
    "args_source": ("field:tool_args", "none"),
    "result_source": ("field:result_text", "field:action_text", "none"),
    "status_source": ("field:status", "none"),
}
PARTS = ("metadata", "observation", "action", "tool", "args", "result", "status")
VERSION = "v1"


class SpecError(ValueError):
    """A spec that doesn't hold what it must."""


def _enum(*values: str) -> dict:
    return {"type": "string", "enum": list(values)}


def _object(properties: dict, required: tuple[str, ...] | None = None) -> dict:
    return {"type": "object", "additionalProperties": False, "properties": properties, "required": list(properties if required is None else required)}


_NAME = {"type": "string", "minLength": 1}


def json_schema() -> dict:
    """The whole format as JSON Schema; ``check`` follows it."""
    alias = _object({"source": _NAME, "target": _NAME})
    policies = {
        "observation_unit": _enum(*UNITS),
        "reducer_kind": _enum(*REDUCERS),
        "max_observation_units": {"type": "integer", "minimum": 1},
        "tool_normalization": _object({"lowercase": {"type": "boolean"}, "aliases": {"oneOf": [{"type": "object", "additionalProperties": _NAME}, {"type": "array", "items": alias}]}}),
        "status_policy": _object({"mode": _enum(*STATUS_MODES), "derive_from_result_patterns": {"type": "array", "items": _object({"pattern": _NAME, "status": _enum(*STATUSES)})}}),
    }
    mapping = {"metadata_sources": {"type": "array", "minItems": 1, "items": _enum(*METADATA)}} | {k: _enum(*v) for k, v in SOURCES.items()}
    return _object(
        {
            "dataset_name": _NAME,
            "version": _enum(VERSION),
            "trace_family": _enum(*FAMILIES),
            "field_mapping": _object(mapping),
            "policies": _object(policies),
            "confidence": _object({k: {"type": "number", "minimum": 0, "maximum": 1} for k in PARTS}),
            "notes": {"type": "array", "items": {"type": "string"}},
        }
    )


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float)}


def check(value, schema: dict | None = None, at: str = "spec") -> None:
    """Raises SpecError where ``value`` leaves the schema."""
    schema = json_schema() if schema is None else schema
    if "oneOf" in schema:
        fitting = [s for s in schema["oneOf"] if isinstance(value, _TYPES[s["type"]])]
        if not fitting:
            raise SpecError(f"{at} has the wrong type")
        return check(value, fitting[0], at)
    kind = schema["type"]
    if not isinstance(value, _TYPES[kind]) or (kind in ("integer", "number") and isinstance(value, bool)):
        raise SpecError(f"{at} is no {kind}")
    if "enum" in schema and value not in schema["enum"]:
        raise SpecError(f"{at} is {value!r}; known are {', '.join(schema['enum'])}")
    if kind == "string" and len(value.strip()) < schema.get("minLength", 0):
        raise SpecError(f"{at} is empty")
    if kind in ("integer", "number") and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        raise SpecError(f"{at} is out of range: {value}")
    if kind == "array":
        if len(value) < schema.get("minItems", 0):
            raise SpecError(f"{at} is empty")
        for i, x in enumerate(value):
            check(x, schema["items"], f"{at}[{i}]")
    if kind == "object":
        known = schema.get("properties", {})
        more = schema.get("additionalProperties")
        if missing := [k for k in schema.get("required", ()) if k not in value]:
            raise SpecError(f"{at} lacks {', '.join(missing)}")
        for k, x in value.items():
            if k in known:
                check(x, known[k], f"{at}.{k}")
            elif isinstance(more, dict):
                check(x, more, f"{at}.{k}")
            else:
                raise SpecError(f"{at} has the unknown key {k}")


def load(path: str | Path) -> dict:
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    check(spec)
    return spec


def save(spec: dict, path: str | Path) -> None:
    check(spec)
    Path(path).write_text(json.dumps(spec, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def _aliases(spec: dict) -> dict[str, str]:
    a = spec["policies"]["tool_normalization"]["aliases"]
    return dict(a) if isinstance(a, dict) else {x["source"]: x["target"] for x in a}


def _field(selector: str) -> Column:
    if selector == "none":
        return F.lit(T.NONE)
    name = selector.removeprefix("field:")
    return T.or_none(F.col(name)) if name in ("tool_name", "status") else T.normalize(name)


def _lines_of(selector: str) -> Column:
    """Lines that a selector picks; _md and _obs hold the split context."""
    if selector.startswith("context:line:"):
        prefix = selector.removeprefix("context:line:")
        return F.filter("_md", lambda x: x.startswith(prefix))
    if selector in ("context:metadata_block", "context:observation_block"):
        return F.col("_md" if "metadata" in selector else "_obs")
    if selector == "context:all_lines":
        return F.concat("_md", "_obs")
    value = _field(selector)
    return F.when(value == T.NONE, F.array().cast("array<string>")).otherwise(F.array(value))


def tool(spec: dict) -> Column:
    name = _field(spec["field_mapping"]["tool_source"])
    if spec["policies"]["tool_normalization"]["lowercase"]:
        name = F.lower(name)
    known = _aliases(spec)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), name), name) if known else name


def status(spec: dict, result: Column) -> Column:
    policy = spec["policies"]["status_policy"]
    own = _field(spec["field_mapping"]["status_source"])
    if policy["mode"] in ("native", "none"):
        return own if policy["mode"] == "native" else F.lit(T.NONE)
    rules = [(F.lower(result).contains(p["pattern"].lower()), p["status"]) for p in policy["derive_from_result_patterns"]]
    derived = T.first_match(rules, F.lit("unknown") if policy["mode"] == "derive" else own)
    return F.when(own != T.NONE, own).otherwise(derived) if policy["mode"] == "native_or_derive" else derived


def step_views(steps: DataFrame, spec: dict, max_units: int | None = None, repeats: bool = False) -> DataFrame:
    """``steps`` projected by a spec: metadata_lines (each once, or with ``repeats`` as often as it stands there),
    observation_lines, the fields and reduction_stats. Reducers without an own rule (kv_blocks, none) take the best lines."""
    check(spec)
    m, k = spec["field_mapping"], max_units or spec["policies"]["max_observation_units"]
    meta = F.flatten(F.array(*(_lines_of(x) for x in m["metadata_sources"])))
    s = T.staged(
        steps,
        {"_split": render.split_context(T.full_lines("context"))},
        {"_md": F.col("_split.md"), "_obs": F.col("_split.obs")},
        {"_meta": meta if repeats else F.array_distinct(meta), "_lines": _lines_of(m["observation_source"])},
        {"_action": _field(m["action_source"]), "_tool": tool(spec), "_args": F.coalesce("tool_args", F.lit("{}")) if m["args_source"] != "none" else F.lit("{}"), "_result": _field(m["result_source"])},
        {"_status": status(spec, F.col("_result"))},
        {n: F.when(F.col(f"_{x}") == "", T.NONE).otherwise(F.col(f"_{x}")) for n, x in (("action_text", "action"), ("tool_name", "tool"), ("tool_args", "args"), ("result_text", "result"), ("status", "status"))},
        {"_hints": R.anchors(*(F.col(c) for c in ("action_text", "tool_name", "tool_args", "result_text", "status")))},
    )
    kind = spec["policies"]["reducer_kind"]
    if kind == "dialogue_turns":
        s = R.add_dialogue_turns(s, "_lines", "_hints", "observation_lines", k)
    elif kind == "log_blocks":
        s = R.add_best(R.add_units(s, "_lines", "_units", R.opens_block), "_units", "_hints", "observation_lines", k).withColumn("observation_lines", F.flatten("observation_lines"))
    else:
        s = R.add_best(s, "_lines", "_hints", "observation_lines", k)
    s = s.withColumns({"metadata_lines": F.when(F.size("_meta") == 0, F.array(F.lit("NO_METADATA"))).otherwise(F.col("_meta")), "reduction_stats": R.reduction_stats(F.col("_lines"), F.col("observation_lines"))})
    return s.drop(*(c for c in s.columns if c.startswith("_")))
