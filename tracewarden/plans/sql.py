"""Shared pieces of the queries' SQL."""

from __future__ import annotations

from collections.abc import Iterable

STEPS = """kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS symbol FROM (SELECT DISTINCT event_type FROM events)),
numbered AS (SELECT user_id AS trajectory_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step_index,
  count(*) OVER (PARTITION BY user_id) AS n_steps, event_type, symbol, value, ts FROM events JOIN kinds USING (event_type)),
steps AS (SELECT *, last_value(event_type) OVER (PARTITION BY trajectory_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) <> 'error' AS final_success FROM numbered)"""

PREFIXES = STEPS + """,
prefixes AS (SELECT *, step_index AS prefix_index, CAST(NOT final_success AND n_steps - step_index <= 3 AS INTEGER) AS label,
  CASE WHEN final_success THEN 'SUCCESS' ELSE 'FAILURE' END AS terminal_label,
  CASE WHEN n_steps - step_index <= 0 THEN '0' WHEN n_steps - step_index <= 1 THEN '1' WHEN n_steps - step_index <= 3 THEN '2-3'
    WHEN n_steps - step_index <= 7 THEN '4-7' WHEN n_steps - step_index <= 15 THEN '8-15' ELSE '16+' END AS remaining_steps_bin,
  CASE WHEN NOT final_success AND n_steps - step_index <= 3 THEN 'EVENT_ERROR' ELSE 'NONE' END AS failure_bucket FROM steps)"""

REPLAYED = PREFIXES + """,
walk AS (SELECT trajectory_id, step_index, CAST((symbol + 1) % 6 AS BIGINT) AS state FROM prefixes WHERE step_index = 1
  UNION ALL SELECT p.trajectory_id, p.step_index, (2 * w.state + p.symbol + 1) % 6 FROM walk w JOIN prefixes p ON p.trajectory_id = w.trajectory_id AND p.step_index = w.step_index + 1),
replayed AS (SELECT p.*, w.state FROM prefixes p JOIN walk w ON p.trajectory_id = w.trajectory_id AND p.step_index = w.step_index)"""

SCORED = REPLAYED + """,
risk AS (SELECT s.state, coalesce(n, 0) AS support, (coalesce(f, 0) + 5.0 * g) / (coalesce(n, 0) + 5.0) AS score
  FROM (SELECT unnest(range(6)) AS state) s LEFT JOIN (SELECT state, count(*) AS n, sum(label) AS f FROM replayed GROUP BY state) c ON s.state = c.state
  CROSS JOIN (SELECT avg(label) AS g FROM replayed)),
scored AS (SELECT r.*, k.score, k.support FROM replayed r JOIN risk k ON r.state = k.state)"""

TURNS = "turns AS (SELECT conv_id AS trajectory_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step_index, role, text, role || ': ' || text AS line FROM conversations)"


def bucket(expr: str, seed: int = 1) -> str:
    return f"(CAST('0x' || substr(sha256('{seed}:' || {expr}), 1, 16) AS UBIGINT)::DOUBLE / 18446744073709551616.0)"


def normal(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def holds(expr: str, words: Iterable[str]) -> str:
    """Any of the words in ``expr``."""
    return "(" + " OR ".join(f"contains({expr}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def auroc_ap(source: str, keys: str = "") -> str:
    """CTEs sums (pos, neg by score) and area (n, positives, auroc, auprc) over rows (score, label)."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""sums AS (SELECT {k}score, sum(label) AS pos, count(*) AS n, count(*) - sum(label) AS neg FROM {source} GROUP BY {k}score),
swept AS (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(pos) OVER ({part}ORDER BY score DESC) AS tp, sum(n) OVER ({part}ORDER BY score DESC) AS seen FROM sums),
area AS (SELECT {k}CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives,
  CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 0.5 ELSE sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) END AS auroc,
  CASE WHEN sum(pos) = 0 THEN 0.0 ELSE sum(pos * tp / seen) / sum(pos) END AS auprc FROM swept {group})"""


def bin10(expr: str) -> str:
    """Bins of ten with edges i * 0.1 as doubles."""
    rules = " ".join(f"WHEN {expr} < {i}::DOUBLE * 0.1::DOUBLE THEN {i - 1}" for i in range(1, 10))
    return f"(CASE WHEN {expr} < 0 OR {expr} > 1 THEN NULL {rules} ELSE 9 END)"
