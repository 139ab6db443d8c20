"""Registered checks: each key has a Spark callable (spark, sf_dir) -> DataFrame
and, where the semantics are SQL-expressible, a DuckDB oracle statement over
the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate key {key}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ..session import ship_package
            # date parsing and µs conversions are defined in UTC
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)  # Python-side operators need the package on the workers
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    # Importing the modules fills QUERIES and ORACLE.
    from . import reg_eda, reg_clean, reg_io, reg_models, reg_text, reg_stream, reg_quality  # noqa: F401
