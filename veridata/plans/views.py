"""Loading the driver tables and the derived "dirty" view used by the checks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Deterministic dirty view over `events`: nulls, padded text, numbers and
# dates stored as text, a sparse column, a constant column, a boolean and
# duplicate rows. The same text runs on Spark and DuckDB.
DIRTY_SQL = """
WITH base AS (
  SELECT event_id, user_id, ts,
         CASE WHEN event_id % 7  = 0 THEN NULL ELSE value      END AS value,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_id % 5  = 0 THEN concat('  ', event_type, ' ') ELSE event_type END AS raw_type,
         CASE WHEN event_id % 25 = 0 THEN 'x' ELSE CAST(user_id AS STRING) END AS user_txt,
         CAST(CAST(ts AS DATE) AS STRING) AS day_txt,
         CASE WHEN event_id % 10 < 7 THEN NULL ELSE value END AS mostly_null,
         'k' AS const_col,
         CASE WHEN event_type = 'error' THEN false ELSE true END AS success
  FROM events)
SELECT * FROM base
UNION ALL
SELECT * FROM base WHERE event_id % 50 = 0
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return spark.sql(DIRTY_SQL.replace("FROM events", "FROM {events}"), events=events)


def dirty_cte(sql_body: str) -> str:
    """Oracle helper: prefix a DuckDB statement with the dirty view as a CTE."""
    inner = DIRTY_SQL.strip()
    return f"WITH dirty AS ({inner})\n{sql_body}"
