"""Shared parts of the queries: rounded columns and the SQL form of the driver's series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelane.schema import AXES


def rounded(df: DataFrame, keys: Sequence[str], columns: Sequence[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(F.col(c).cast("double"), digits).alias(c) for c in columns])


def r(expression: str, digits: int = 6) -> str:
    """Rounded, without negative zero."""
    return f"(round({expression}, {digits}) + 0.0)"


def cents(column: str = "value") -> Column:
    return F.round(F.col(column) * 100, 0).cast("bigint")


EV = """ev AS (
  SELECT event_type AS series_id, ts, event_id, user_id, value,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS seq,
         count(*) OVER (PARTITION BY event_type) AS n
  FROM events)"""

US = """us AS (
  SELECT CAST(user_id AS VARCHAR) AS series_id, ts, event_id, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM events)"""

_AXES_SQL = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {a}" for i, a in enumerate(AXES))
EM = f"""em AS (
  SELECT CAST(label AS VARCHAR) AS series_id, vec_id, label, {_AXES_SQL},
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS seq,
         count(*) OVER (PARTITION BY label) AS n
  FROM embeddings)"""
