"""Golden tests of thresholds, ties and edge frames on tiny in-line frames."""

import math
from collections import deque

import pytest
from pyspark.sql import functions as F

from veridata.functions import compat as C
from veridata.operators import clean as CL
from veridata.operators import eda, filters, models, quality, stats, text
from veridata.operators.typing import column_types
from veridata.plans.profile import profile
from veridata.sources import files, pages
from veridata.streaming import throttle as TH


def rows(df):
    return [tuple(r) for r in df.collect()]


# ── naming and parsing ──────────────────────────────────────────────────────
def test_snake_names_and_duplicates():
    assert CL.snake_name("  Código Nación ") == "codigo_nacion"
    assert CL.snake_name("n__región key") == "n_region_key"
    assert CL.snake_name("***") == "col"
    assert CL.dedup_names(["a", "a", "b", "a"]) == ["a", "a_2", "b", "a_3"]


def test_parse_number_refuses_java_suffixes(spark):
    df = spark.createDataFrame([(" 3.5 ",), ("1d",), ("1.0f",), ("inf",), ("nan",), ("-2e3",), ("x",)], "s string")
    got = [r[0] for r in df.select(C.parse_number(F.col("s"))).collect()]
    assert got[0] == 3.5 and got[1] is None and got[2] is None
    assert math.isinf(got[3]) and got[4] is None and got[5] == -2000.0 and got[6] is None


def test_parse_timestamp_closed_formats(spark):
    df = spark.createDataFrame([("2024-01-02",), ("02/01/2024",), ("20240102",), ("10:30",), ("Jan 5 2024",)], "s string")
    got = [r[0] for r in df.select(C.parse_timestamp(F.col("s")).cast("string")).collect()]
    assert got[0].startswith("2024-01-02") and got[1].startswith("2024-02-01")
    assert got[2].startswith("2024-01-02") and got[3] is None and got[4].startswith("2024-01-05")


def test_rounding_is_engine_stable(spark):
    df = spark.createDataFrame([(2.5,), (-0.0001,), (-2.5,)], "x double")
    got = [r[0] for r in df.select(C.rnd("x", 0)).collect()]
    assert got == [3.0, 0.0, -3.0]  # half away from zero on the scaled value
    assert repr(df.select(C.rnd("x", 3)).collect()[1][0]) == "0.0"  # no negative zero


# ── profile / eda ───────────────────────────────────────────────────────────
def test_profile_edge_frames(spark):
    df = spark.createDataFrame([(1, None, float("nan"), True, "k"), (2, None, 1.0, False, "k"),
                                (3, None, float("inf"), True, "k")],
                               "a long, b double, c double, d boolean, e string")
    p = {r["column"]: r for r in profile(df).collect()}
    assert p["b"]["nulls"] == 3 and p["b"]["distinct"] == 0
    assert p["c"]["nulls"] == 1  # NaN counts as missing
    assert p["e"]["distinct"] == 1
    assert p["a"]["median"] == 2.0 and p["a"]["q1"] == 1.5
    empty = spark.createDataFrame([], "a long, s string")
    e = {r["column"]: r for r in profile(empty).collect()}
    assert e["a"]["rows"] == 0 and e["a"]["mean"] is None


def test_outlier_rules_differ_on_zero_iqr(spark):
    df = spark.createDataFrame([(1.0,)] * 10 + [(5.0,)], "x double")
    assert [r[0] for r in eda.outliers(df, "x").collect()] == [5.0]  # AG4 keeps IQR 0
    assert CL.outlier_filter(df).count() == 11  # FI7 skips IQR 0


def test_value_counts_tie_and_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("a",), ("c",)], "v string")
    assert rows(eda.value_counts(df, "v")) == [("a", 2), ("b", 2), ("c", 1)]
    assert stats.modes(df, ["v"]) == {"v": "a"}


def test_correlation_pairwise_and_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0, None), (2.0, 4.0, 7.0, 1.0), (3.0, 6.5, 7.0, 2.0),
                                (4.0, 8.0, 7.0, 3.0)], "a double, b double, k double, m double")
    got = {(r["col_a"], r["col_b"]): r["r"] for r in eda.correlation(df).collect()}
    assert ("a", "k") not in got  # constant column left out
    assert got[("a", "m")] == 1.0  # pairwise complete rows only
    assert 0.99 < got[("a", "b")] <= 1.0


def test_column_types_free_text_rule(spark):
    df = spark.createDataFrame([(i, f"name{i}", "x" if i % 2 else "y", True) for i in range(10)],
                               "id long, name string, cat string, ok boolean")
    t = column_types(df)
    assert t["texto_libre"] == ["name"] and t["categoricas"] == ["cat"]
    assert t["numericas"] == ["id", "ok"]  # booleans count as numeric here


# ── cleaning ────────────────────────────────────────────────────────────────
def test_clean_pipeline_on_students_like_frame(spark):
    data = [(1, " Ana ", "20", 9.5, "Ing"), (2, "Luis", "21", None, "Ing"), (3, "Eva\t", "x", 7.0, "Med"),
            (4, "Rita", "22", 8.0, None), (5, "Juan", "23", None, "Ing"), (5, "Juan", "23", None, "Ing"),
            (6, "Sol", "24", 6.0, "Med"), (7, "Leo", "25", 9.0, "Ing"), (8, "Ivo", "26", 5.0, "Med"),
            (9, "Ada", "27", 7.5, "Ing"), (10, "Teo", "28", 8.5, "Med")]
    df = spark.createDataFrame(data, "id long, nombre string, edad string, promedio double, carrera string")
    res = CL.clean(df)
    out = {r["id"]: r for r in res.data.collect()}
    assert len(out) == 10  # duplicate removed last
    assert out[1]["nombre"] == "Ana" and out[3]["nombre"] == "Eva"  # python-like strip (tab too)
    assert out[3]["edad"] == 23.5  # 'x' → null → median of the 10 parsed ages (incl. the duplicate)
    assert out[4]["carrera"] == "Ing"  # mode
    med = sorted([9.5, 7.0, 8.0, 6.0, 9.0, 5.0, 7.5, 8.5])
    assert out[2]["promedio"] == (med[3] + med[4]) / 2
    steps = [r["step"] for r in res.log.collect()]
    assert steps[0] == "Espacios en texto" and steps[-1] == "Filas duplicadas"


def test_fill_unknown_skips_timestamps(spark):
    df = spark.createDataFrame([("a", None), (None, None)], "s string, t timestamp")
    vals = CL.fill_values(df, ["s", "t"], categorical="unknown")
    assert vals == {"s": CL.UNKNOWN, "t": None}


# ── filters ─────────────────────────────────────────────────────────────────
def test_filter_in_with_none_and_empty_list(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "v string")
    assert filters.filter_in(df, "v", []).count() == 3
    assert filters.filter_in(df, "v", ["a", None]).count() == 2


def test_public_url_literals(spark):
    urls = ["http://127.0.0.1/", "http://10.0.0.1/", "http://169.254.169.254/", "ftp://x/",
            "https://8.8.8.8/x", "http://localhost:8000/", "http://[::1]/", "https://example.org/ok",
            "http://user@172.20.1.1:80/", "http:///nohost"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert sorted(r[0] for r in filters.filter_public_urls(df, "url").collect()) == [
        "https://8.8.8.8/x", "https://example.org/ok"]


# ── quality ─────────────────────────────────────────────────────────────────
def test_quality_of_clean_frame(spark):
    df = spark.createDataFrame([(i, float(i) * 2.0) for i in range(20)], "a long, b double")
    q = quality.quality(df)
    assert q["score"] == 100 and q["grade"] == "A" and q["summary"] == quality.NO_ISSUES


def test_quality_penalties(spark):
    df = spark.createDataFrame([(1, "k", "1"), (1, "k", "1"), (2, "k", None), (3, "k", "4")],
                               "a long, c string, n string")
    q = quality.quality(df)
    names = [f[0] for f in q["factors"]]
    assert names == ["Valores faltantes", "Filas duplicadas", "Columnas constantes", "Tipos mal detectados"]
    assert q["score"] == 100 - round(min(35, round(1 / 12 * 150, 1)) + min(20, 25.0) + 6 + 5)


# ── sources ─────────────────────────────────────────────────────────────────
def test_flatten_missing_keys_and_arrays(spark):
    df = spark.createDataFrame([(1, ("a", None), ["x"]), (2, None, [])],
                               "_id long, info struct<name:string,bal:double>, tags array<string>")
    out = files.read_documents(df)
    assert out.columns == ["_id", "info.name", "info.bal", "tags"]
    assert rows(out) == [("1", "a", None, ["x"]), ("2", None, None, [])]


def test_read_json_refuses_mixed_folders(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}]')
    assert files.read_json(spark, str(tmp_path)).count() == 1
    (tmp_path / "b.json").write_text('{"rows": [{"a": 2}, {"a": 3}]}')
    with pytest.raises(ValueError, match="not both"):
        files.read_json(spark, str(tmp_path))


def test_read_json_object_and_scalar(spark, tmp_path):
    p = tmp_path / "doc.json"
    p.write_text('{"meta": "x", "empty": [], "rows": [{"b": 2, "a": 1}, {"b": 4, "a": 3}]}')
    df = files.read_json(spark, str(p))
    assert df.columns == ["b", "a"] and df.count() == 2
    one = files.read_json(spark, str(p), find_list=False)
    assert one.count() == 1 and one.columns == ["meta", "empty", "rows"]
    s = tmp_path / "scalar.json"
    s.write_text("42")
    try:
        files.read_json(spark, str(s))
        raise AssertionError("scalar root must fail")
    except ValueError:
        pass


def test_csv_typing_like_pandas(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("id,score,flag,name,gap\n1,2.5,True,a,1\n2,NA,False,b,\n3,3,True,n/a,3\n")
    df = files.read_csv(spark, str(p))
    types = dict(df.dtypes)
    assert types == {"id": "bigint", "score": "double", "flag": "boolean", "name": "string", "gap": "double"}
    assert [r["name"] for r in df.orderBy("id").collect()] == ["a", "b", None]


def test_html_paragraphs_and_tables():
    html = ("<html><head><script>var t='<p>no</p>';</script></head><body><p>short</p>"
            "<p>This paragraph is long enough to keep.<div>block</div><p>Another paragraph long enough!</p>"
            "<table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>a</td></tr><tr><td>2</td><td>b</td></tr>"
            "<tr><td>3</td><td>c</td></tr></table></body></html>")
    p = pages._parse(html)
    kept = [x for x in p.paragraphs if len(x) > pages.MIN_PARAGRAPH_CHARS]
    assert kept == ["This paragraph is long enough to keep.", "Another paragraph long enough!"]
    assert len(p.tables) == 1 and p.tables[0][0] == (True, ["k", "v"])


# ── text ────────────────────────────────────────────────────────────────────
def test_summary_and_answer(spark):
    df = spark.createDataFrame([(1, "Data is big. Data is data! Small talk here. Data again.")], "doc_id long, text string")
    s = text.summarize(df, n=2).collect()[0]["summary"]
    # token counts: data 4, is 2, others 1 → scores 2.33, 3.33, 1, 2.5
    assert s == "Data is data! Data again."
    a = text.answer(df, "where is data").collect()[0]
    assert a["answer"] == "Data is big." and abs(a["score"] - 0.666667) < 1e-9
    none = text.answer(df, "zebra").collect()[0]
    assert none["answer"] == text.NO_ANSWER and none["score"] == 0.0


def test_topics_sum_to_one(spark):
    df = spark.createDataFrame([(1, "the cat and the dog"), (2, "der hund und die katze")], "doc_id long, text string")
    out = text.topics(df, "the and, der die und")
    for d in (1, 2):
        scores = [r["score"] for r in out.where(F.col("doc_id") == d).collect()]
        assert abs(sum(scores) - 1.0) < 1e-5
    top = {r["doc_id"]: r["label"] for r in out.where(F.col("rank") == 1).collect()}
    assert top == {1: "the and", 2: "der die und"}


# ── throttle ────────────────────────────────────────────────────────────────
def test_throttle_step_semantics():
    marks = deque(maxlen=2)
    w = 60 * TH.US
    got = [TH.step(marks, t * TH.US, w) for t in (0, 10, 20, 60, 61)]
    # 20 rejected (retry after 60-(20-0)+1 = 41 s); at 60 the mark at 0 is exactly 60 s old and still counts
    assert got == [(True, None), (True, None), (False, 41), (False, 1), (True, None)]


def test_throttle_batch_equals_stream(spark, tmp_path):
    ev = spark.createDataFrame([(i, f"2024-01-01 00:00:{i % 60:02d}", i % 3, "view") for i in range(60)],
                               "event_id long, ts string, user_id long, event_type string") \
        .withColumn("ts", F.to_timestamp("ts"))
    batch = {r["event_id"]: (r["admitted"], r["retry_after"]) for r in
             TH.throttle(ev, window_s=30, limits={"g": 4}).collect()}
    src = tmp_path / "src"
    ev.write.parquet(str(src))
    stream = spark.readStream.schema(ev.schema).parquet(str(src))
    q = (TH.throttle_stream(stream, window_s=30, limits={"g": 4}).writeStream.format("memory")
         .queryName("thr_test").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["event_id"]: (r["admitted"], r["retry_after"]) for r in spark.table("thr_test").collect()}
    assert got == batch and sum(1 for a, _ in batch.values() if a) < 60


def test_refined_quantiles_equal_exact_percentile_on_skew(spark, monkeypatch):
    # one value holds a third of all rows; the rest are spread out
    data = [(5.0,)] * 400 + [(float(i) * 0.37,) for i in range(800)]
    df = spark.createDataFrame(data, "x double").repartition(4)
    monkeypatch.setattr(stats, "FETCH_LIMIT", 50)  # force several refinement rounds
    got = stats.exact_quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.75, 0.99])["x"]
    want = list(df.agg(F.percentile("x", F.array(*[F.lit(p) for p in [0.1, 0.25, 0.5, 0.75, 0.99]]))).first()[0])
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))


def test_read_any_dispatch(spark, tmp_path):
    p = tmp_path / "T.CSV"
    p.write_text("a,b\n1,x\n2,y\n")
    assert files.read_any(spark, str(p)).count() == 2  # extension is case-insensitive
    try:
        files.read_any(spark, str(tmp_path / "x.xlsx"))
        raise AssertionError("unknown extension must fail")
    except ValueError:
        pass


def test_write_report_round_trip(spark, tmp_path):
    from veridata.sources import tables
    df = spark.createDataFrame([("dims", "rows", "3")], "section string, item string, value string")
    tables.write_report(df, str(tmp_path / "rep"))
    assert rows(spark.read.json(str(tmp_path / "rep"))) == [("rows", "dims", "3")]


def test_group_entities_from_tags(spark):
    tags = spark.createDataFrame([(1, "B-PER", "Ana", 0.9), (1, "I-PER", "Ana", 0.95), (1, "B-LOC", "##Li ##ma", 0.8),
                                  (1, "B-ORG", "X", 0.99)], "doc_id long, tag string, word string, score double")
    got = sorted(rows(text.group_entities(tags).select("type", "form", "score")))
    assert got == [("LOC", "Lima", 0.8), ("PER", "Ana", 0.95)]  # one-char forms dropped, max score kept


def test_simple_ols_predictions(spark):
    from veridata.operators import models
    df = spark.createDataFrame([(2020, 10.0), (2021, 12.0), (2022, 14.0)], "year long, v double")
    assert models.predict(df, "year", "v", 2023) == 16.0
    assert rows(models.predict_next(df, "year", "v")) == [(2023.0, 16)]
    try:
        models.predict(df.limit(2), "year", "v", 2023)
        raise AssertionError("fewer than 3 rows must fail")
    except ValueError:
        pass


def test_box_is_the_same_when_brackets_are_narrowed(spark, monkeypatch):
    from veridata.operators import charts
    df = spark.createDataFrame([("a" if i % 3 else "b", float(i) * 1.5) for i in range(300)], "g string, v double")
    want = {r["grp"]: tuple(r)[1:] for r in charts.box(df, "v", by="g").collect()}
    monkeypatch.setattr(stats, "FETCH_LIMIT", 20)
    monkeypatch.setattr(stats, "SKETCH_ERROR", 0.2)
    got = {r["grp"]: tuple(r)[1:] for r in charts.box(df, "v", by="g").collect()}
    assert got == want


def test_throttle_idle_split_is_exact(spark):
    # one hot key with bursts separated by idle gaps, plus a gap of exactly one window
    ts = [0, 1, 2, 3, 100, 101, 102, 160, 161, 500, 501, 502, 503]
    ev = spark.createDataFrame([(i, t, 7) for i, t in enumerate(ts)], "event_id long, t long, user_id long") \
        .withColumn("ts", F.timestamp_seconds("t"))
    a = {r["event_id"]: (r["admitted"], r["retry_after"]) for r in
         TH.throttle(ev, window_s=60, limits={"g": 2}).collect()}
    b = {r["event_id"]: (r["admitted"], r["retry_after"]) for r in
         TH.throttle(ev, window_s=60, limits={"g": 2}, split_idle=False).collect()}
    assert a == b
    segs = {r["ts_us"] // TH.US: r["seg"] for r in
            TH.idle_segments(TH._prepare(ev, "user_id", "ts", "event_id", None), 60 * TH.US).collect()}
    assert segs[100] == segs[160] and segs[0] != segs[100] != segs[500]  # gap of exactly 60 s does not split


def test_eda_bundle_and_report_sections(spark):
    from veridata.plans.report import eda_bundle, report
    df = spark.createDataFrame([(i, float(i % 7), "a" if i % 2 else "b", None if i % 5 == 0 else i * 1.0)
                                for i in range(40)], "id long, x double, cat string, y double")
    df2 = df.union(df.limit(1)).withColumn("at", F.lit("2024-01-02").cast("date"))
    got = {(r["section"], r["item"]): r["value"] for r in eda_bundle(df2).collect()}
    assert got[("duplicates", "n")] == "1" and got[("duplicates", "pct")] == "2.44"
    assert got[("describe", "cat.unique")] == "2" and got[("describe", "at.min")] == "2024-01-02 00:00:00"
    secs = {s for s, _ in got}
    assert {"overview", "types", "describe", "nulls", "outliers", "correlation", "distribution", "findings"} <= secs
    rep = {(r["section"], r["item"]): r["value"] for r in report(df).collect()}
    assert rep[("dims", "rows")] == "40" and ("quality", "grade") in rep
    assert any(s == "model" for s, _ in rep)


# ── one-hot names, dotted columns, long integers, quoted CSV ─────────────────
def test_coefficients_belong_to_their_features(spark):
    rows = [(c, float(i), g, 3.0 * i + 10.0 * (c == "a")) for i, (c, g) in
            enumerate((c, g) for _ in range(10) for c in "ab" for g in "pqr")]
    df = spark.createDataFrame(rows, "`in.c` string, `in.x` double, g string, y double")
    data, names = models.prepare(df, ["in.c", "in.x", "g"], "y")
    assert names == ["in.c_a", "in.c_b", "in.x", "g_p", "g_q", "g_r"]
    assert len(names) == len(data.first()["features"])
    coef = {n: v for k, n, v in models.train(df, "linear", ["in.c", "in.x", "g"], "y", {}).detail if n in names}
    assert abs(coef["in.x"] - 3) < 0.01 and abs(coef["in.c_a"] - coef["in.c_b"] - 10) < 0.1


def test_auto_model_sees_every_row_and_column(spark):
    rows = [(float(i), *[float((i * k) % 17) for k in range(2, 14)]) for i in range(6000)]
    df = spark.createDataFrame(rows, "y double, " + ", ".join(f"x{k} double" for k in range(2, 14)))
    assert models.detect_target(df) == ("y", "regresion")
    best = models.auto_model(df)[0]
    assert best.n_rows == 6000 and best.n_features == 12


def test_integers_beyond_64_bits_become_doubles(spark):
    df = spark.createDataFrame([("99999999999999999999",), ("5",), ("9007199254740993",)], "k string")
    out = CL.clean(df, {"null_strategy": "none"}).data
    assert dict(out.dtypes)["k"] == "double" and out.where("k IS NULL").count() == 0
    exact = CL.clean(spark.createDataFrame([("9007199254740993",), ("5",)], "k string"), {"null_strategy": "none"}).data
    assert sorted(r["k"] for r in exact.collect()) == [5, 9007199254740993]


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n"say ""hi""","x\ny"\nplain,z\n')
    got = files.read_csv(spark, str(tmp_path / "q.csv"), multi_line=True)
    assert sorted(map(tuple, got.collect())) == [("plain", "z"), ('say "hi"', "x\ny")]


def test_mean_ties_do_not_depend_on_partitions(spark):
    df = spark.range(60000).selectExpr("cast((id * 7919) % 11 as double) / 100 as v")
    got = {profile(df.repartition(n)).collect()[0]["mean"] for n in (1, 3, 8)}
    assert len(got) == 1


# ── quantiles with infinities, splits, tables, inventory, text ──────────────
def test_quantiles_agree_with_percentile_and_when_narrowed(spark, monkeypatch):
    values = [float(i) * 0.5 for i in range(500)] + [float("inf")] * 3 + [float("-inf"), 1e308, -1e308, 5e-324]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.995, 1.0]
    direct = list(df.agg(F.percentile("x", F.array(*[F.lit(p) for p in probs]))).first()[0])
    assert stats.quantiles(df, ["x"], probs)["x"] == direct
    monkeypatch.setattr(stats, "FETCH_LIMIT", 40)
    monkeypatch.setattr(stats, "SKETCH_ERROR", 0.3)
    refined = stats.quantiles(df, ["x"], probs)["x"]
    assert refined == direct and refined[0] == float("-inf") and refined[-1] == float("inf")
    assert stats.exact_quantiles(df.where("false"), ["x"], [0.5])["x"] == [None]


def test_stratified_split_keeps_each_class_share(spark):
    from veridata.operators import models as M
    df = spark.range(1000).select(F.col("id").alias("f"), F.when(F.col("id") % 10 == 0, 1.0).otherwise(0.0).alias("label"))
    train, test, _ = M.stratified_split(df, 1000)
    assert {r["label"]: r["count"] for r in test.groupBy("label").count().collect()} == {0.0: 225, 1.0: 25}
    assert train.union(test).distinct().count() == 1000 and train.count() == 750


def test_model_parameters_out_of_bounds_raise(spark):
    from veridata.operators import models as M
    for given in ({"k": 1}, {"k": 99}, {"k": 2.5}, {"k": "x"}):
        try:
            M._whole(given, "k", 3, 2, 9)
            raise AssertionError(given)
        except ValueError:
            pass
    assert M._whole({"k": ""}, "k", 3, 2, 9) == 3 and M._whole({"k": "4"}, "k", 3, 2, 9) == 4


def test_tables_without_end_tags_nested_and_spanning():
    loose = pages._parse("<table><tr><td>a<td>b<tr><td>c<td><table><tr><td rowspan=2>x<td>y<tr><td>z</table>d</table>").tables
    assert loose == [[(False, ["a", "b"]), (False, ["c", "xyzd"])], [(False, ["x", "y"]), (False, ["x", "z"])]]
    wide = pages._parse("<table><tr><th colspan=2>h</th></tr><tr><td>1</td><td>2</td></tr></table><table></table>").tables
    assert wide == [[(True, ["h", "h"]), (False, ["1", "2"])]]


def test_inventory_rules(spark):
    from veridata.sources import tables as TB
    names = {"x.tsv": "TSV", "a.json": "JSON", "PG:t": "SQL", "Query:1": "SQL", "Mongo:m": "NoSQL", "NoSQL:m": "NoSQL",
             "Web:p_t0": "Web", "Limpio:x": "ETL", "anything": "CSV"}
    assert {n: TB.source_type(n) for n in names} == names
    spark.createDataFrame([("é" * 1024, 1)], "t string, n int").createOrReplaceTempView("inv_small")
    assert TB.table_inventory(spark, ["inv_small"]).first()["size"] == "2.0 KB"


def test_text_tasks_keep_documents_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "One two. Two two! Three?")], "doc_id long, text string")
    first = dict(rows(text.topics(df, "two,three").where("rank = 1").select("doc_id", "label")))
    assert first == {1: "two", 2: "two", 3: "two", 4: "two"}
    assert text.topics(df, "two,three").count() == 8
    got = dict(rows(text.summarize(df, n=1)))
    assert got == {1: "", 2: "", 3: "", 4: "Two two!"}  # points alone are no sentence
    assert rows(text.answer(df, "three four").where("doc_id = 4").select("answer", "score")) == [("Three?", 0.5)]
    assert text.answer(df, "three").where("score = 0").count() == 3
