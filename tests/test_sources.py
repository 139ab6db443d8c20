"""Inventory, JSON and CSV files, views of results, guarded and calibrated text tasks."""

import os
import random

import pytest
from pyspark.sql import functions as F

from veridata.operators import text as TX
from veridata.sources import files, pages, tables

DATA = "/root/testdata/sf0.001"


def test_inventory_reads_no_column_of_files(spark):
    spark.read.parquet(f"{DATA}/documents.parquet").createOrReplaceTempView("inv_docs")
    spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id > 5").createOrReplaceTempView("inv_some")
    facts = tables._file_facts(spark.table("inv_docs"))
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan and "text" not in plan
    row = facts.first()
    assert (row["rows"], row["bytes"]) == (200, os.path.getsize(f"{DATA}/documents.parquet"))
    assert tables._file_facts(spark.table("inv_some")) is None
    got = {r["name"]: r for r in tables.table_inventory(spark, ["inv_docs", "inv_some"]).collect()}
    assert got["inv_docs"]["size"] == f"{row['bytes'] / 1024:.1f} KB" and got["inv_some"]["rows"] < 200


def test_json_keys_of_all_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"z": 1, "rows": [{"q": 1, "b": 2}]}')
    (tmp_path / "b.json").write_text('{"rows": [{"b": 3, "a": 4}], "new": "x", "z": 2}')
    folder = str(tmp_path)
    assert files._key_order(spark, folder) == ["z", "rows", "new"]
    assert files.read_json(spark, folder, find_list=False).columns == ["z", "rows", "new"]
    got = files.read_json(spark, folder)
    assert got.columns == ["q", "b", "a"] and sorted(map(tuple, got.collect()), key=str) == [(1, 2, None), (None, 3, 4)]


def test_csv_with_breaks_in_quotes_needs_no_option(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n1,"x\ny"\n2,"say ""hi"""\n')
    (tmp_path / "p.csv").write_text('a,b\n1,"x"\n2,y\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "q.csv")).orderBy("a").collect()] == [(1, "x\ny"), (2, 'say "hi"')]
    assert not files.breaks_in_quotes(spark, str(tmp_path / "p.csv"))
    assert files.read_csv(spark, str(tmp_path / "p.csv")).count() == 2


def test_cleaned_and_scraped_tables_are_kept_as_views(spark):
    df = spark.createDataFrame([(" a ", 1.0), (" a ", 1.0), ("b", None)], "T string, V double")
    names = [tables.save_clean(df, "ventas")[0] for _ in range(2)]
    assert names == ["Limpio:ventas", "Limpio:ventas_2"]
    assert spark.table("`Limpio:ventas`").count() == 2 and tables.source_type(names[0]) == "ETL"
    html = "<table><tr><td>x</td></tr></table><table><tr><th>n</th><th>n</th></tr>" + "".join(
        f"<tr><td>{i}</td><td>v{i}</td></tr>" for i in range(3)) + "</table>"
    web = spark.createDataFrame([(1, "http://h/p/list.html?q=1", html), (2, "http://h/", "<p>no table</p>")], "page_id long, url string, html string")
    name = pages.save_first_table(web, 1)
    assert name == "Web:list.html_t1" and pages.save_first_table(web, 2) is None
    kept = spark.table(f"`{name}`")
    assert kept.columns == ["n", "n_2"] and [tuple(r) for r in kept.collect()] == [(str(i), f"v{i}") for i in range(3)]
    spark.catalog.dropTempView("`Limpio:ventas`")


def test_tasks_are_guarded(spark):
    docs = spark.createDataFrame([(1, "Ana Ruiz went to Lima and Quito today."), (2, "  short   "), (3, None)], "doc_id long, text string")
    done, refused = TX.run_task(docs, "ner")
    assert {r["form"] for r in done.collect()} == {"Ana Ruiz", "Lima", "Quito"}
    assert sorted(tuple(r) for r in refused.collect()) == [(2, TX.SHORT_TEXT), (3, TX.SHORT_TEXT)]
    assert TX.run_task(docs, "qa", "who went to Lima")[0].count() == 1
    with pytest.raises(ValueError):
        TX.run_task(docs, "translate")


def test_sentiment_deals_one_row_group_over_the_cores(spark, monkeypatch):
    """Rows that lie in one partition of several are scored by all tasks."""
    texts = F.when(F.col("id") % 2 == 0, "good fine text").otherwise("bad poor words")
    one = spark.range(0, 800, 1, 8).where("id < 100").select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", texts, F.col("id").cast("string")).alias("text"),
        (F.col("id") % 2 == 0).cast("int").alias("quality"))
    assert one.select(F.spark_partition_id()).distinct().count() == 1
    got = TX.sentiment(one, one, num_features=1 << 8).withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in got}) >= 4 and len(got) == 100
    monkeypatch.setattr(TX, "FEW_TEXTS", 50)
    dealt = {r["doc_id"]: r for r in TX.sentiment(one, one, num_features=1 << 8).collect()}
    assert all(r["label"] == dealt[r["doc_id"]]["label"] and abs(r["score"] - dealt[r["doc_id"]]["score"]) < 0.01 for r in got)
    assert all(r["label"] == (r["doc_id"] % 2 == 0) for r in got)


def test_sentiment_is_calibrated_and_keeps_every_row(spark):
    rng = random.Random(4)
    rows = []
    for d in range(1200):
        good = rng.random() < 0.6
        words = rng.choices(["fine", "great", "nice"] if good else ["bad", "poor", "sad"], k=1) if rng.random() < 0.7 else []
        rows.append((d, " ".join(words + rng.choices(["a", "b", "c", "d", "e"], k=6)), int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").coalesce(2)
    fitted = TX.fit_sentiment(df.where("doc_id < 800"), num_features=1 << 10)
    held = fitted.probability(df.where("doc_id >= 800"), "text", "score").withColumn("label", F.col("quality").cast("double"))
    right = held.where((F.col("score") >= 0.5) == (F.col("label") == 1)).count() / 400
    bins = TX.reliability(held).collect()
    error = sum(r["n"] * r["gap"] for r in bins) / 400
    assert right > 0.78 and error < 0.08 and sum(r["n"] for r in bins) == 400
    out = sum(r["n"] * r["gap"] for r in TX.reliability(fitted.out_of_fold).collect()) / 800
    assert fitted.out_of_fold.count() == 800 and out < 0.08
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "great")], "doc_id long, text string")
    got = {r["doc_id"]: r["p"] for r in fitted.probability(odd, "text", "p").collect()}
    assert got[1] == fitted.prior and got.keys() == {1, 2, 3} and got[3] > 0.9


def test_wide_spans_come_in_bounded_batches(spark):
    rows = "<tr><td>x</td></tr>" * 299
    html = f"<table><tr><td colspan=1000 rowspan=65534>a</td></tr>{rows}</table>"
    found = pages.page_tables(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    assert found.groupBy("page_id").agg(F.count("*"), F.count("cell"), F.max("row_no"), F.max("col_no")).collect() == [
        (1, 300 * 1001, 300 * 1000 + 299, 299, 1000)]
    assert found.where("cell = 'x'").count() == 299
