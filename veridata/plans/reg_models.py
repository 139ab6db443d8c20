"""Checks for modelling, evaluation and target detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import compat as C
from ..operators import models as M
from .registry import register
from .views import table


def _result(spark, res: M.ModelResult):
    m = res.metrics_df(spark).select("model", F.lit("metric").alias("kind"), F.col("metric").alias("name"), "value")
    return m.unionByName(res.detail_df(spark)).withColumn("n_rows", F.lit(res.n_rows).cast("long"))


_LEVELS = [("l_returnflag", v) for v in "ANR"] + [("l_linestatus", v) for v in "FO"]


# categoricals first: a slot too many would shift every name behind it
@register("ml_features", "SELECT " + ", ".join(
    f"CASE WHEN {c} = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {c}_{v}" for c, v in _LEVELS)
    + ", l_quantity, l_extendedprice FROM lineitem")
def q_ml_features(spark, d):
    data, names = M.prepare(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_quantity"],
                            "l_extendedprice")
    from pyspark.ml.functions import vector_to_array
    x = vector_to_array("features")
    return data.select(*[x[i].alias(name) for i, name in enumerate(names)], "l_extendedprice")


@register("ml_split")
def q_ml_split(spark, d):
    data, _ = M.prepare(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    n = data.count()
    tr, te, ev = M.split(data, n)
    return tr.select(F.lit("train").alias("part")).union(te.select(F.lit("test")))\
        .groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@register("ml_linear")
def q_ml_linear(spark, d):
    res = M.train(table(spark, d, "lineitem"), "linear",
                  ["l_quantity", "l_discount", "l_tax", "l_returnflag"], "l_extendedprice")
    return _result(spark, res)


# Least-norm coefficients of y on x and all levels of a two-level category: the levels share
# the difference that an ordinary fit of one level gives, with opposite signs.
_LEAST_NORM_SQL = """
WITH t AS (SELECT l_extendedprice AS y, l_quantity AS x, (l_linestatus = 'O')::INT::DOUBLE AS o FROM lineitem
           WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL AND l_linestatus IS NOT NULL),
m AS (SELECT avg(y) AS my, avg(x) AS mx, avg(o) AS mo, var_pop(x) AS vx, var_pop(o) AS vo, covar_pop(x, o) AS xo,
             covar_pop(x, y) AS xy, covar_pop(o, y) AS oy FROM t),
b AS (SELECT *, (xy * vo - oy * xo) / (vx * vo - xo * xo) AS bx, (oy * vx - xy * xo) / (vx * vo - xo * xo) AS bo FROM m)
SELECT 'intercept' AS name, round(my - bx * mx - bo * mo + bo / 2, 3) AS value FROM b
UNION ALL SELECT 'l_quantity', round(bx, 3) FROM b
UNION ALL SELECT 'l_linestatus_F', round(-bo / 2, 3) FROM b
UNION ALL SELECT 'l_linestatus_O', round(bo / 2, 3) FROM b"""


@register("ml_least_norm", _LEAST_NORM_SQL)
def q_ml_least_norm(spark, d):
    out = M.least_squares(table(spark, d, "lineitem"), ["l_quantity", "l_linestatus"], "l_extendedprice")
    return out.select("name", C.rnd("value", 3).alias("value"))


@register("ml_logistic")
def q_ml_logistic(spark, d):
    res = M.train(table(spark, d, "lineitem"), "logistic",
                  ["l_quantity", "l_extendedprice", "l_discount", "l_linestatus"], "l_returnflag")
    return _result(spark, res)


@register("ml_tree_clf")
def q_ml_tree_clf(spark, d):
    res = M.train(table(spark, d, "orders"), "tree", ["o_totalprice", "o_orderstatus"], "o_orderpriority",
                  {"max_depth": 6})
    return _result(spark, res)


@register("ml_tree_reg")
def q_ml_tree_reg(spark, d):
    res = M.train(table(spark, d, "part"), "tree", ["p_size", "p_brand"], "p_retailprice", {"max_depth": 8})
    return _result(spark, res)


@register("ml_kmeans")
def q_ml_kmeans(spark, d):
    res = M.train(table(spark, d, "lineitem"), "kmeans",
                  ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], None, {"k": 3})
    return _result(spark, res)


@register("auto_model")
def q_auto_model(spark, d):
    out = None
    for res in M.auto_model(table(spark, d, "lineitem")):
        r = _result(spark, res)
        out = r if out is None else out.unionByName(r)
    return out


@register("sample_rows")
def q_sample_rows(spark, d):
    return M.sample_rows(table(spark, d, "lineitem"))


# ── OLS by aggregates (ML5–ML7) and evaluators (EV1–EV3) ────────────────────
@register("ols_simple", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, "
          "round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, count(*)::BIGINT AS n "
          "FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def q_ols_simple(spark, d):
    f = M.fit_simple(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return f.select(C.rnd("slope", 6).alias("slope"), C.rnd("intercept", 6).alias("intercept"), "n")


def _yearly(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.year("o_orderdate").alias("year"), "o_totalprice")


@register("ols_predict_next",
          "WITH t AS (SELECT year(o_orderdate)::DOUBLE AS x, o_totalprice AS y FROM orders), "
          "f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i, count(*) AS n, max(x) AS mx FROM t) "
          "SELECT mx + 1 AS x, CAST(round(i + s * (mx + 1)) AS BIGINT) AS prediction FROM f WHERE n >= 3")
def q_ols_predict_next(spark, d):
    return M.predict_next(_yearly(spark, d), "year", "o_totalprice")


_FIT_SQL = ("WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, "
            "regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem) "
            "SELECT l_quantity::DOUBLE AS x, l_extendedprice AS actual, i + s * l_quantity AS fitted "
            "FROM lineitem, f")


@register("ols_fitted", "SELECT x, actual, round(fitted, 6) AS fitted FROM (" + _FIT_SQL + ")")
def q_ols_fitted(spark, d):
    f = M.fitted(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return f.select("x", "actual", C.rnd("fitted", 6).alias("fitted"))


_EVAL_SQL = ("SELECT round(CASE WHEN var_pop(actual) > 0 THEN 1 - sum((actual - fitted) ^ 2) / "
             "(var_pop(actual) * count(*)) ELSE 0 END, 4) AS r2, "
             "round(sqrt(sum((actual - fitted) ^ 2) / count(*)), 4) AS rmse, "
             "round(avg(abs(actual - fitted)), 4) AS mae FROM (" + _FIT_SQL + ")")


@register("eval_regression", _EVAL_SQL)
def q_eval_regression(spark, d):
    f = M.fitted(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return M.regression_metrics(f, "actual", "fitted")


@register("eval_diagnosis", "SELECT r2, CASE WHEN r2 >= 0.8 THEN 'Excelente' WHEN r2 >= 0.5 THEN 'Aceptable' "
          "WHEN r2 >= 0 THEN 'Débil' ELSE 'Muy pobre' END AS diagnosis FROM (" + _EVAL_SQL + ")")
def q_eval_diagnosis(spark, d):
    f = M.fitted(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    m = M.regression_metrics(f, "actual", "fitted")
    return m.select("r2", M.diagnosis(F.col("r2")).alias("diagnosis"))


_CLS = ("SELECT l_returnflag AS y, CASE WHEN l_shipdate >= TIMESTAMP '1995-06-17 00:00:00' THEN 'N' "
        "WHEN l_discount > 0.05 THEN 'A' ELSE 'R' END AS yhat FROM lineitem")


def _cls(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("y"),
                     F.when(F.col("l_shipdate") >= F.lit("1995-06-17 00:00:00").cast("timestamp_ntz"), "N")
                     .when(F.col("l_discount") > 0.05, "A").otherwise("R").alias("yhat"))


@register("eval_classes", f"""WITH p AS ({_CLS}),
cm AS (SELECT y, yhat, count(*) AS n FROM p GROUP BY 1, 2),
cls AS (SELECT y AS c FROM cm UNION SELECT yhat FROM cm),
per AS (SELECT c, coalesce((SELECT sum(n) FROM cm WHERE y = c), 0) AS support,
               coalesce((SELECT sum(n) FROM cm WHERE yhat = c), 0) AS npred,
               coalesce((SELECT sum(n) FROM cm WHERE y = c AND yhat = c), 0) AS tp FROM cls)
SELECT round(sum(tp) / sum(support), 4) AS accuracy,
       round(sum(CASE WHEN support + npred > 0 THEN 2 * tp / (support + npred) ELSE 0 END * support) / sum(support), 4)
       AS f1 FROM per""")
def q_eval_classes(spark, d):
    return M.class_metrics(_cls(spark, d), "y", "yhat")[0]


@register("eval_confusion", f"SELECT y AS actual, yhat AS predicted, count(*)::BIGINT AS n FROM ({_CLS}) GROUP BY 1, 2")
def q_eval_confusion(spark, d):
    return M.class_metrics(_cls(spark, d), "y", "yhat")[1]


@register("detect_target", """WITH c AS (
  SELECT 8 AS pos, 'l_returnflag' AS name, count(DISTINCT l_returnflag) AS d FROM lineitem
  UNION ALL SELECT 9, 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem),
n AS (SELECT count(*) AS n FROM lineitem)
SELECT name AS target, 'clasificacion' AS kind FROM c, n
WHERE d BETWEEN 2 AND 15 AND d < n AND d <= least(50, n * 0.5) ORDER BY d, pos LIMIT 1""")
def q_detect_target(spark, d):
    t, k = M.detect_target(table(spark, d, "lineitem"))
    return spark.createDataFrame([(t, k)], "target string, kind string")
