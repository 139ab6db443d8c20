"""Whole jobs and bounded tasks: what the findings of round 3 asked for, on rows built here."""

import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__ as E
from veridata.functions import compat as C
from veridata.functions import spread as S
from veridata.operators import clean as CL
from veridata.operators import models as M
from veridata.operators import quality


def _events(spark, folder, n=60):
    kinds = ["click", "view", "error"]
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 7, kinds[i % 3 if i % 4 else 0], float(i), "{}") for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")\
        .write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_clean_fill_mode_fills_all_columns(spark, tmp_path):
    out = E.queries()["clean_fill_mode"](spark, _events(spark, tmp_path))
    assert out.columns == ["event_id", "user_id", "ts", "value", "event_type", "raw_type", "user_txt", "day_txt", "mostly_null",
                           "const_col", "success"]
    got = out.collect()
    assert len(got) == 62  # two events come twice
    assert {r["event_type"] for r in got if r["event_id"] % 11 == 0} == {"click"}
    assert all(r["value"] is not None and r["mostly_null"] is not None for r in got)
    assert "mostly_null" in E.oracle_sql()["clean_fill_mode"].split("SELECT event_id")[-1]


def test_retyped_text_is_computed_once(spark):
    df = spark.createDataFrame([(f" {i} ", f"2024-01-{i % 28 + 1:02d}", "x ") for i in range(40)], "n string, day string, t string")
    r = CL.clean(df.unionByName(df))
    assert any("clean-text" in f for f in r.data.inputFiles())  # the passes behind read files, they do not parse again
    assert r.data.dtypes == [("n", "bigint"), ("day", "timestamp"), ("t", "string")][:2]
    assert r.data.count() == 40
    none = df.withColumn("nothing", F.lit(None))  # a type that files cannot hold
    assert CL.clean(none, {"drop_constant": False, "null_strategy": "none"}).data.count() == 40


def test_strip_is_the_pattern(spark):
    texts = ["", " ", "a", " a\t", "\n a b \r\n", "a \u0085", "a\u2028 ", " \u2029", "\u00a0a ", "\x0ba\f", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(~C.py_strip(F.col("t")).eqNullSafe(F.regexp_replace("t", C.STRIP_PATTERN, ""))).count() == 0


def test_split_hashes_are_written_once(spark):
    df = spark.createDataFrame([(float(i % 37), float(i % 3)) for i in range(400)], "x double, label double")
    train, test, _ = M.stratified_split(df, 400)
    assert all("split-" in f for f in train.inputFiles() + test.inputFiles())  # fits read files, they do not hash again
    assert any("split-hashes" in f for f in train.inputFiles())
    assert train.count() + test.count() == 400 and sorted(train.union(test).collect()) == sorted(df.collect())


def test_tasks_hold_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_TASK", 10)
    df = spark.createDataFrame([(float(i), float(i % 5), i % 2) for i in range(200)], "a double, b double, y int").coalesce(1)
    data, _, n = M._prepared(df, ["a", "b"], "y")
    assert n == 200 and data.rdd.getNumPartitions() >= 20
    data.unpersist()
    with S.shared(df, always=True) as kept:
        assert kept.rdd.getNumPartitions() >= 20 and kept.count() == 200


def test_mistyped_texts_are_stripped_once(spark, monkeypatch):
    calls = []
    strip = C.py_strip
    monkeypatch.setattr(C, "py_strip", lambda c: calls.append(c) or strip(c))
    monkeypatch.setattr(C, "parse_timestamp", None)  # which would strip again for each of its tests
    df = spark.createDataFrame([(" 2024-01-02 ", "x", "7"), ("2024-01-03", "y", " 8 ")], "a string, b string, c string")
    assert quality.mistyped_columns(df) == ["a", "c"] and len(calls) == 3
