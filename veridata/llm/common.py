"""Helpers shared by the pipeline operators: scratch tables, table access, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable on the workers and the scratch folder known."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: the lineage is
    cut at files that outlive any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` has it (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _fact(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected links ``(a, b)``: one row ``(node, root)``
    per node other than the smallest of its component, which is ``root``.

    Alternating large-star and small-star rounds. Each round is two minima by node,
    combined before their shuffle, and two joins; a hub's links are never gathered in
    one row. Every round is written to the scratch folder.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
              .distinct(), "links")
    seen = _fact(e)
    while seen[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("hi"),
            F.col("m").alias("lo")).distinct()
        e = stage(small, "links")
        now = _fact(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
