"""The monitor on live streams: keyed state per trajectory, and sessions from raw events.

These are additions to the batch engine; a bounded stream gives the rows that the
batch replay gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.operators.automata import Dfa

OUTPUT = "trajectory_id long, step_index long, state long, score double, alert boolean, first_alert long"
STATE = "state long, step_index long, first_alert long"


def replay_batch(symbols, dfa: Dfa, risk: dict[int, float], threshold: float, state: int, step: int, first: int) -> tuple[list[tuple], int, int, int]:
    """Rows (step_index, state, score, alert, first_alert) of further symbols; first_alert is -1 before one."""
    rows = []
    for a in symbols:
        state, step = dfa.delta[state][int(a)], step + 1
        score = risk.get(state, 0.0)
        if score >= threshold and first < 0:
            first = step
        rows.append((step, state, score, score >= threshold, first))
    return rows, state, step, first


def monitor_stream(events: DataFrame, dfa: Dfa, risk: dict[int, float], threshold: float, idle: str = "1 day") -> DataFrame:
    """Scores each step of a stream (trajectory_id, ts, event_id, symbol) as it comes.

    State is (automaton state, steps, first alert) per trajectory, whatever its length; rows of a micro-batch are put in
    event order, and a run without events for ``idle`` past the watermark is forgotten. Set a watermark on ``ts`` first.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state, at, first = held.get if held.exists else (dfa.start, 0, -1)
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        rows, state, at, first = replay_batch(pdf["symbol"], dfa, risk, threshold, state, at, first)
        held.update((state, at, first))
        held.setTimeoutTimestamp(max(int(pdf["ts"].max().timestamp() * 1000), held.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return events.groupBy("trajectory_id").applyInPandasWithState(step, OUTPUT, STATE, "append", "EventTimeTimeout")


def sessions(events: DataFrame, gap_hours: int = 6) -> DataFrame:
    """Runs from raw events: a pause of ``gap_hours`` or more ends one (batch form)."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.lag("ts").over(w).isNull() | (F.col("ts") >= F.lag("ts").over(w) + F.expr(f"INTERVAL {gap_hours} HOURS"))
    s = events.withColumn("fresh", fresh.cast("int")).withColumn("session", F.sum("fresh").over(w))
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n_steps"), F.min("ts").alias("started_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"))


def session_stream(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """The same on a stream: session windows with a watermark."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n_steps"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"))
