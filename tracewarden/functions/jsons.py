"""JSON texts whose bytes matter: sorted keys, ASCII escapes, bounded sizes. Arrow batches, as no built-in writes them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_STRING, MAX_ITEMS, HISTORY = 2048, 16, 4


def dump(value, compact: bool = False) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=True, separators=(",", ":") if compact else None)


def _canonical(compact: bool):
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else dump(json.loads(x), compact))

    return f


def canonical_json(c: Column | str, compact: bool = False) -> Column:
    """A JSON text with sorted keys and ASCII escapes, with or without blanks after separators."""
    return _canonical(compact)(c)


def bounded(value, counts: dict[str, int], max_string: int = MAX_STRING, max_items: int = MAX_ITEMS):
    """Long strings keep both ends around a marker, long lists both ends around a gap; ``counts`` says how many did."""
    if isinstance(value, str) and len(value) > max_string:
        counts["string_values"] = counts.get("string_values", 0) + 1
        marker = f"...<source_raw_truncated:chars={len(value) - max_string}>..."
        room = max(0, max_string - len(marker))
        tail = room - room // 2
        return value[: room // 2] + marker + (value[-tail:] if tail else "")
    if isinstance(value, list):
        if len(value) > max_items:
            counts["list_values"] = counts.get("list_values", 0) + 1
            half = max_items // 2
            value = [*value[:half], {"source_raw_truncated_items": len(value) - max_items}, *value[half - max_items :]]
        return [bounded(x, counts, max_string, max_items) for x in value]
    if isinstance(value, dict):
        return {str(k): bounded(v, counts, max_string, max_items) for k, v in value.items()}
    return value


def raw_fragment(fields: dict) -> str:
    """Compact JSON of a bounded source fragment, which says so where something was cut."""
    counts: dict[str, int] = {}
    out = bounded(fields, counts)
    if counts:
        out["source_raw_truncation"] = {"history_items": HISTORY, "max_list_items": MAX_ITEMS, "max_string_chars": MAX_STRING, "list_values": counts.get("list_values", 0), "string_values": counts.get("string_values", 0)}
    return dump(out, compact=True)
