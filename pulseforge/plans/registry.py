"""Names of the queries, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The adapters of sources/tables.py in DuckDB SQL.
SIG = """sig AS (
  SELECT user_id AS rec, user_id % 30 AS person, event_type AS ch, event_id,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t, value - 50e0 AS x,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx
  FROM events)"""
NN = """nn AS (
  SELECT * FROM (SELECT rec, person, idx, t, x, t - lag(t) OVER (PARTITION BY rec ORDER BY idx) AS nn FROM sig) WHERE nn IS NOT NULL)"""
PRED = """pred AS (
  SELECT l_suppkey AS person, epoch_us(l_shipdate) / 86400000000e0 AS t, CAST(l_quantity AS DOUBLE) AS y, l_orderkey,
         CAST(l_linenumber AS BIGINT) AS l_linenumber
  FROM lineitem)"""
CLF = """clf AS (
  SELECT d.doc_id, CAST(l.quality AS BIGINT) AS y, CAST(d.n_chars AS DOUBLE) AS p FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame, and the SQL for the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r(x: str, digits: int = 6) -> str:
    """settle() in SQL."""
    return f"round({x} + 1e-9, {digits})"


from pulseforge.plans import ablation_queries, ceiling_queries, event_queries, feature_queries, recording_queries, score_queries, signal_queries, window_queries  # noqa: E402, F401
