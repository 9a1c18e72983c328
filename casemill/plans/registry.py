"""Named queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The transaction view in SQL.
TX = """tx0 AS (
  SELECT event_id AS tx_id,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS t_sec,
         value AS amount, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         event_type AS category, user_id AS card, value / (value + 60e0) AS prob
  FROM events),
tx AS (
  SELECT *, CAST(category = 'error' AND amount + k >= 150 AS INTEGER) AS label,
         (t_sec / 3600e0) % 24e0 AS hour,
         CASE WHEN prob >= 0.8e0 THEN 'ALTO' WHEN prob >= 0.4e0 THEN 'MEDIO' ELSE 'BAJO' END AS tier
  FROM tx0)"""


def query(name: str, sql: str | None = None):
    """Register a query under ``name``."""

    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def hash32_sql(*parts: str) -> str:
    """SQL twin of ``hash32``; parts are SQL expressions."""
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


def uniform_sql(*parts: str) -> str:
    return f"({hash32_sql(*parts)} / 4294967296e0)"
