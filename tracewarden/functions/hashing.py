"""Deterministic buckets from SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def task_bucket(task_id: Column | str, seed: int) -> Column:
    """The first 64 bits of sha256("seed:task") as a number in [0, 1)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), (F.col(task_id) if isinstance(task_id, str) else task_id).cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(2.0**64)


def order_key(seed: int, *parts: Column | str) -> Column:
    """A hash to order rows by, in place of a seeded shuffle."""
    cols = [F.lit(str(seed)), *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts)]
    return F.sha2(F.concat_ws(":", *cols), 256)
