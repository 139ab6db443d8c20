"""Bounded distinct sets, unique columns, quantile brackets and row fingerprints."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridata.operators import clean as CL
from veridata.operators import eda, models, stats
from veridata.operators.typing import column_types
from veridata.sources import tables

PROBS = [0.0, 0.013, 0.25, 0.5, 0.75, 0.9, 1.0]


# ── bounded distinct sets ───────────────────────────────────────────────────
def few(spark, n, rows=3000):
    return spark.range(rows).select(
        (F.col("id") % n).cast("string").alias("s"), F.when(F.col("id") % 11 > 0, F.col("id") % n).alias("l"),
        F.when(F.col("id") % n == 0, "").otherwise((F.col("id") % n).cast("string")).alias("e"),
        F.when(F.col("id") % 2 == 0, F.lit(0.0)).otherwise(F.lit(-0.0)).alias("z"), F.lit(None).cast("string").alias("none"))


@pytest.mark.parametrize("n", [1, 49, 50, 51, 52, 400])
def test_bounded_distinct_is_exact_up_to_the_bound(spark, n):
    df = few(spark, n).repartition(5)
    got = stats.bounded_distinct(df, df.columns, 50)
    assert got == {"s": min(n, 51), "l": min(n, 51), "e": min(n, 51), "z": 1, "none": 0}


def test_values_of_one_hash_count_apart(spark, monkeypatch):
    monkeypatch.setattr(stats, "_hashed", lambda value: F.substring(value, 1, 1))  # "1" for 1, 10, 11 ...
    assert stats.bounded_distinct(few(spark, 30), ["s"], 50) == {"s": 30}
    assert stats.bounded_distinct(few(spark, 60), ["s"], 50) == {"s": 51}


def test_types_and_target_at_the_bounds(spark):
    for n, kind in ((50, "categoricas"), (51, "texto_libre")):
        assert column_types(few(spark, n).select("s"))[kind] == ["s"]
    df = spark.range(2000).select((F.col("id") % 15).cast("string").alias("a"), (F.col("id") % 16).cast("string").alias("b"),
                                  (F.col("id") * 1.5).alias("x"))
    assert models.detect_target(df) == ("a", "clasificacion")
    assert models.detect_target(df.drop("a")) == ("x", "regresion")


def test_no_cell_is_exploded(spark):
    df = few(spark, 50)
    plan = df.agg(F.theta_sketch_estimate(F.theta_sketch_agg("s", 6)))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan


def test_unique_columns(spark, monkeypatch):
    df = spark.range(30_000).select(
        "id", F.col("id").cast("string").alias("text"), (F.col("id") % 29_999).alias("late"), (F.col("id") % 5).alias("few"),
        (F.col("id") * 0.5).alias("x"), F.when(F.col("id") > 0, F.col("id")).alias("hole")).coalesce(1)
    assert stats.unique_columns(df, ["id", "text", "late", "few", "x"]) == ["id", "text", "x"]
    assert [r["column"] for r in tables.candidate_keys(df).orderBy("position").collect()] == ["id", "text", "x"]
    monkeypatch.setattr(stats, "_value_hash", lambda f: F.pmod(F.xxhash64(stats.typed_key(f)), F.lit(97)))
    assert stats.unique_columns(df, ["id", "text", "late", "few", "x"]) == ["id", "text", "x"]
    assert stats.unique_columns(df.where("false"), []) == []


def test_cardinality_of_few_and_many(spark):
    df = few(spark, 300).withColumn("id", F.monotonically_increasing_id())
    got = {r["column"]: r["n_distinct"] for r in eda.cardinality(df).collect()}
    assert got == {"s": 300, "l": 300, "e": 300, "z": 1, "none": 0, "id": 3000}


# ── quantiles ───────────────────────────────────────────────────────────────
def columns():
    rng = random.Random(6)
    third = [5.0 if rng.random() < 0.34 else rng.gauss(0, 10) for _ in range(20_000)]
    wide = [rng.choice([float("inf"), float("-inf"), 1e308, -1e308, 5e-324, 0.0, -0.0]) if rng.random() < 0.05
            else rng.lognormvariate(0, 30) for _ in range(20_000)]
    gaps = [None if rng.random() < 0.4 else float(rng.randrange(7)) for _ in range(20_000)]
    return list(zip(third, wide, gaps, [1.25] * 20_000, [None] * 20_000))


def expected(values):
    values = sorted(v for v in values if v is not None)
    out = []
    for p in PROBS:
        k = (len(values) - 1) * p
        lo, hi = (values[math.floor(k)], values[math.ceil(k)]) if values else (None, None)
        out.append(lo if lo == hi or k == int(k) else (math.ceil(k) - k) * lo + (k - math.floor(k)) * hi)
    return out


@pytest.mark.parametrize("error,fetch", [(0.003, 200_000), (0.05, 50), (1e-9, 200_000), (1e-9, 30)])
def test_quantiles_of_any_bracket(spark, monkeypatch, error, fetch):
    rows = columns()
    df = spark.createDataFrame(rows, "third double, wide double, gaps double, one double, none double").repartition(4)
    monkeypatch.setattr(stats, "SKETCH_ERROR", error)  # tiny: ranks lie outside their brackets
    monkeypatch.setattr(stats, "FETCH_LIMIT", fetch)
    got = stats.exact_quantiles(df, df.columns, PROBS)
    for name, values in zip(df.columns, zip(*rows)):
        assert got[name] == expected(values), name


def test_two_scans_at_any_number_of_columns(spark, monkeypatch):
    df = spark.range(5000).select(*[((F.col("id") * k) % 4999).cast("double").alias(f"c{k}") for k in range(1, 9)])
    scans = spark.sparkContext.accumulator(0)

    def count(batches):
        scans.add(1)
        yield from batches

    counted = df.coalesce(1).mapInArrow(count, df.schema)
    got = stats.exact_quantiles(counted, counted.columns, PROBS)
    assert scans.value == 2 and got["c1"] == [float(x) for x in np.quantile(np.arange(5000) % 4999, PROBS)]


# ── duplicates ──────────────────────────────────────────────────────────────
ROWS = [(1, "a", 0.0), (1, "a", -0.0), (None, "a", 1.0), (None, "a", 1.0), ("x", None, None), (None, "x", None), (2, "b", float("nan")),
        (2, "b", float("nan")), (3, "c", 2.0)]


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("few_prints", [500_000, 0])
def test_duplicates_by_fingerprint(spark, monkeypatch, clash, few_prints):
    df = spark.createDataFrame([(None if a is None else str(a), b, c) for a, b, c in ROWS], "a string, b string, c double").repartition(3)
    monkeypatch.setattr(stats, "FEW_PRINTS", few_prints)
    if clash:
        monkeypatch.setattr(stats, "fingerprint", lambda df: F.struct(F.lit(1).alias("a"), F.lit(2).alias("b")))
    assert stats.duplicate_rows(df) == (9, 3)
    assert stats.distinct_rows(df).count() == 6
    assert CL.frame_stats(df).first()["duplicates"] == 3
    assert stats.duplicate_rows(df.where("false")) == (0, 0) and stats.duplicate_rows(df.select()) == (9, 8)


def test_unique_rows_are_not_shuffled_in_full(spark):
    wide = spark.range(20_000).select("id", *[F.sha2(F.concat(F.lit(f"{k}"), F.col("id").cast("string")), 512).alias(f"c{k}") for k in range(20)])
    plan = wide.select(stats.fingerprint(wide).alias("print")).groupBy("print").count()._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.split("\n") if "hashpartitioning" in line]
    assert exchanged and all("c1" not in line for line in exchanged)
    assert stats.duplicate_rows(wide) == (20_000, 0)
