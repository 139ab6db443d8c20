"""Checks for cleaning (CL*), filters (FI*) and the scalar function families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import compat as C
from ..operators import clean as CL
from ..operators import filters as FI
from .registry import register
from .views import dirty, dirty_cte, table

NUM_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
STRIP = r"'^\s+|\s+$', '', 'g'"
OFF = {"remove_duplicates": False, "drop_constant": False, "trim_text": False, "coerce_types": False,
       "null_strategy": "none", "remove_outliers": False}


def _only(**kw):
    return {**OFF, **kw}


# Dirty view after trim + coerce (the row set every later decision uses).
_T = dirty_cte(f""", t AS (
  SELECT event_id, user_id, ts, value, event_type, regexp_replace(raw_type, {STRIP}) AS raw_type,
         CASE WHEN regexp_matches(regexp_replace(user_txt, {STRIP}), '{NUM_RE}')
              THEN TRY_CAST(trim(user_txt) AS DOUBLE) END AS user_txt,
         CAST(try_strptime(regexp_replace(day_txt, {STRIP}), '%Y-%m-%d') AS TIMESTAMP) AS day_txt,
         mostly_null, const_col, success
  FROM dirty),
fill AS (SELECT quantile_cont(value, 0.5) AS med_v, quantile_cont(user_txt, 0.5) AS med_u,
                (SELECT event_type FROM t WHERE event_type IS NOT NULL GROUP BY 1
                 ORDER BY count(*) DESC, event_type LIMIT 1) AS mode_e FROM t)
""")


@register("clean_default", _T + """
SELECT DISTINCT event_id, user_id, ts, coalesce(value, med_v) AS value, coalesce(event_type, mode_e) AS event_type,
       raw_type, coalesce(user_txt, med_u) AS user_txt, day_txt, success FROM t, fill""")
def q_clean_default(spark, d):
    return CL.clean(dirty(spark, d)).data


@register("clean_log", _T + """
SELECT * FROM (
 SELECT 2 AS step_no, 'Espacios en texto' AS step,
        printf('Eliminados espacios sobrantes en %d celdas.', count(*)) AS detail, count(*)::BIGINT AS affected
   FROM dirty WHERE raw_type <> regexp_replace(raw_type, '^\\s+|\\s+$', '', 'g')
 UNION ALL SELECT 3, 'Tipos de datos',
        'Convertidas 2 columna(s) a su tipo real (user_txt -> número, day_txt -> fecha).', 2
 UNION ALL SELECT 5, 'Columnas constantes', 'Eliminadas 1 columna(s) con un solo valor (const_col).', 1
 UNION ALL SELECT 6, 'Columnas con muchos nulos',
        'Eliminadas 1 columna(s) con >50% de valores faltantes (mostly_null).', 1
 UNION ALL SELECT 6, 'Valores faltantes rellenados',
        printf('Rellenados %d valores nulos (números: median, texto: mode).', n), n FROM
        (SELECT (count(*) - count(value)) + (count(*) - count(event_type)) + (count(*) - count(user_txt))
                + (count(*) - count(day_txt)) AS n FROM t)
 UNION ALL SELECT 8, 'Filas duplicadas', printf('Eliminadas %d filas exactamente repetidas.', n), n FROM
        (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (const_col, mostly_null) FROM t)) AS n
         FROM t))""")
def q_clean_log(spark, d):
    return CL.clean(dirty(spark, d)).log


_ALL = "event_id, user_id, ts, value, event_type, raw_type, user_txt, day_txt, mostly_null, const_col, success"


@register("clean_stats", dirty_cte(f""", s AS (SELECT {_ALL.replace('raw_type', "regexp_replace(raw_type, '^\\s+|\\s+$', '', 'g') AS raw_type")} FROM dirty)
SELECT 'antes' AS stage, count(*)::BIGINT AS "rows", 11::BIGINT AS "columns",
       (""" + " + ".join(f"count(*) - count({c.strip()})" for c in _ALL.split(",")) + """)::BIGINT AS nulls,
       (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)))::BIGINT AS duplicates FROM dirty
UNION ALL
SELECT 'despues', (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (mostly_null, const_col) FROM s)), 9, 0, 0"""))
def q_clean_stats(spark, d):
    r = CL.clean(dirty(spark, d))
    return r.before.unionByName(r.after)


@register("clean_trim", dirty_cte(
    f"SELECT {_ALL.replace('raw_type', f'regexp_replace(raw_type, {STRIP}) AS raw_type')} FROM dirty"))
def q_clean_trim(spark, d):
    return CL.clean(dirty(spark, d), _only(trim_text=True)).data


@register("clean_coerce", dirty_cte(f"""SELECT event_id, user_id, ts, value, event_type, raw_type,
  CASE WHEN regexp_matches(user_txt, '{NUM_RE}') THEN TRY_CAST(trim(user_txt) AS DOUBLE) END AS user_txt,
  CAST(try_strptime(day_txt, '%Y-%m-%d') AS TIMESTAMP) AS day_txt, mostly_null, const_col, success FROM dirty"""))
def q_clean_coerce(spark, d):
    return CL.clean(dirty(spark, d), _only(coerce_types=True)).data


@register("clean_constant", dirty_cte(f"SELECT {_ALL.replace(', const_col', '')} FROM dirty"))
def q_clean_constant(spark, d):
    return CL.clean(dirty(spark, d), _only(drop_constant=True)).data


@register("clean_sparse", dirty_cte("""
, m AS (SELECT quantile_cont(value, 0.5) AS mv FROM dirty),
mo AS (SELECT event_type AS me FROM dirty WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)
SELECT event_id, user_id, ts, coalesce(value, mv) AS value, coalesce(event_type, me) AS event_type, raw_type,
       user_txt, day_txt, const_col, success FROM dirty, m, mo"""))
def q_clean_sparse(spark, d):
    return CL.clean(dirty(spark, d), _only(null_strategy="drop_cols")).data


def _fill_sql(num: str, cat: str) -> str:
    nv = {"median": "quantile_cont(value, 0.5)", "mean": "avg(value)", "zero": "min(0.0)"}[num]
    nm = {"median": "quantile_cont(mostly_null, 0.5)", "mean": "avg(mostly_null)", "zero": "min(0.0)"}[num]
    ce = ("(SELECT event_type FROM dirty WHERE event_type IS NOT NULL GROUP BY 1 "
          "ORDER BY count(*) DESC, event_type LIMIT 1)") if cat == "mode" else "'desconocido'"
    return dirty_cte(f""", f AS (SELECT {nv} AS fv, {nm} AS fm, {ce} AS fe FROM dirty)
SELECT event_id, user_id, ts, coalesce(value, fv) AS value, coalesce(event_type, fe) AS event_type, raw_type,
       user_txt, day_txt, coalesce(mostly_null, fm) AS mostly_null, const_col, success FROM dirty, f""")


for _num, _cat, _key in [("median", "mode", "clean_fill_median"), ("mean", "mode", "clean_fill_mean"),
                         ("zero", "mode", "clean_fill_zero"), ("median", "mode", "clean_fill_mode"),
                         ("median", "unknown", "clean_fill_unknown")]:
    def _fn(spark, d, _num=_num, _cat=_cat):
        return CL.clean(dirty(spark, d), _only(null_strategy="fill", null_fill_numeric=_num,
                                               null_fill_categorical=_cat)).data
    register(_key, _fill_sql(_num, _cat))(_fn)


@register("clean_drop_rows", dirty_cte(f"SELECT * FROM dirty WHERE " + " AND ".join(
    f"{c.strip()} IS NOT NULL" for c in _ALL.split(","))))
def q_clean_drop_rows(spark, d):
    return CL.clean(dirty(spark, d), _only(null_strategy="drop_rows")).data


@register("clean_outliers", dirty_cte("""
, q AS (SELECT """ + ", ".join(
    f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}"
    for c in ["event_id", "user_id", "value", "mostly_null"]) + """ FROM dirty)
SELECT dirty.* FROM dirty, q WHERE """ + " AND ".join(
    f"(b_{c} = a_{c} OR {c} IS NULL OR ({c} >= a_{c} - 1.5 * (b_{c} - a_{c}) AND {c} <= b_{c} + 1.5 * (b_{c} - a_{c})))"
    for c in ["event_id", "user_id", "value", "mostly_null"])))
def q_clean_outliers(spark, d):
    return CL.clean(dirty(spark, d), _only(remove_outliers=True)).data


@register("clean_dedup", dirty_cte("SELECT DISTINCT * FROM dirty"))
def q_clean_dedup(spark, d):
    return CL.clean(dirty(spark, d), _only(remove_duplicates=True)).data


@register("clean_names", "SELECT n_nationkey AS codigo_nacion, n_name AS nombre, n_regionkey AS n_region_key, "
          "n_name AS nombre_2 FROM nation")
def q_clean_names(spark, d):
    nat = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey", F.col("n_name").alias("x"))
    return CL.clean(nat.toDF("Código Nación", " Nombre ", "n__región key", "NOMBRE"),
                    _only(standardize_names=True)).data


@register("clean_drop_cols", dirty_cte(f"SELECT {_ALL.replace(', const_col', '')} FROM dirty"))
def q_clean_drop_cols(spark, d):
    return CL.clean(dirty(spark, d), _only(drop_columns=["const_col", "no_such_column"])).data


@register("fill_mean_mode", dirty_cte("""
, f AS (SELECT avg(value) AS fv, avg(mostly_null) AS fm,
   (SELECT event_type FROM dirty WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1) AS fe
   FROM dirty)
SELECT event_id, user_id, ts, coalesce(value, fv) AS value, coalesce(event_type, fe) AS event_type, raw_type,
       user_txt, day_txt, coalesce(mostly_null, fm) AS mostly_null, const_col, success FROM dirty, f"""))
def q_fill_mean_mode(spark, d):
    return CL.fill_mean_mode(dirty(spark, d))


_DAY = "CAST(try_strptime(day_txt, '%Y-%m-%d') AS TIMESTAMP) AS day_txt"


@register("normalize_dates", dirty_cte("SELECT " + _ALL.replace("day_txt", _DAY) + " FROM dirty"))
def q_normalize_dates(spark, d):
    return CL.normalize_dates(dirty(spark, d))


@register("complete_cases", dirty_cte(
    "SELECT value, event_type FROM dirty WHERE value IS NOT NULL AND event_type IS NOT NULL"))
def q_complete_cases(spark, d):
    return FI.complete_cases(dirty(spark, d), ["value", "event_type"])


# ── filters ─────────────────────────────────────────────────────────────────
@register("filter_in", "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def q_filter_in(spark, d):
    return FI.filter_in(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@register("filter_in_null", dirty_cte("SELECT * FROM dirty WHERE event_type = 'click' OR event_type IS NULL"))
def q_filter_in_null(spark, d):
    return FI.filter_in(dirty(spark, d), "event_type", ["click", None])


@register("filter_range", "SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def q_filter_range(spark, d):
    return FI.filter_range(table(spark, d, "lineitem"), "l_quantity", 10, 20)


@register("filter_year", "SELECT * FROM orders WHERE year(o_orderdate) = 1996")
def q_filter_year(spark, d):
    return FI.filter_year(table(spark, d, "orders"), 1996)


@register("filter_success", dirty_cte("SELECT * FROM dirty WHERE success = false"))
def q_filter_success(spark, d):
    return FI.filter_success(dirty(spark, d), False)


# ── scalar function families ────────────────────────────────────────────────
@register("fn_string", """SELECT c_custkey, lower(c_name) AS low,
  translate(lower(c_mktsegment), 'áéíóúñü', 'aeiounu') AS plain,
  regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g') AS snake,
  substring(c_name, 1, 8) AS head, split_part(c_mktsegment, 'I', 1) AS part1,
  ends_with(c_name, '0') AS ends0 FROM customer""")
def q_fn_string(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.lower("c_name").alias("low"),
                    F.translate(F.lower("c_mktsegment"), "áéíóúñü", "aeiounu").alias("plain"),
                    F.regexp_replace(F.lower("c_name"), "[^a-z0-9]+", "_").alias("snake"),
                    F.substring("c_name", 1, 8).alias("head"),
                    F.split("c_mktsegment", "I").getItem(0).alias("part1"),
                    F.col("c_name").endswith("0").alias("ends0"))


@register("fn_date", """SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS txt,
  CAST(try_strptime(strftime(o_orderdate, '%m/%d/%Y'), '%m/%d/%Y') AS TIMESTAMP) AS parsed FROM orders""")
def q_fn_date(spark, d):
    o = table(spark, d, "orders")
    txt = F.date_format("o_orderdate", "MM/dd/yyyy")
    return o.select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"),
                    F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("txt"),
                    C.parse_timestamp(txt).alias("parsed"))


@register("fn_math", """SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * l_discount, 2) + 0.0 AS disc,
  abs(l_tax - 0.04) AS dev, round(sqrt(l_quantity), 6) AS root, least(l_quantity, 25.0) AS capped,
  greatest(l_discount, 0.05) AS floor5 FROM lineitem""")
def q_fn_math(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", C.rnd_even(F.col("l_extendedprice") * F.col("l_discount"), 2).alias("disc"),
                     F.abs(F.col("l_tax") - 0.04).alias("dev"), C.rnd(F.sqrt("l_quantity"), 6).alias("root"),
                     F.least("l_quantity", F.lit(25.0)).alias("capped"),
                     F.greatest("l_discount", F.lit(0.05)).alias("floor5"))


@register("fn_convert", dirty_cte(f"""SELECT event_id,
  CASE WHEN regexp_matches(user_txt, '{NUM_RE}') THEN TRY_CAST(trim(user_txt) AS DOUBLE) END AS num,
  CAST(value AS VARCHAR) AS txt FROM dirty"""))
def q_fn_convert(spark, d):
    x = dirty(spark, d)
    return x.select(
        "event_id", C.parse_number(F.col("user_txt")).alias("num"),
        F.when(F.col("value").isNotNull(), F.format_string("%s", F.col("value"))).alias("txt"))


@register("fn_null", dirty_cte("""SELECT event_id, value IS NULL AS is_null, coalesce(value, -1.0) AS filled,
  CASE WHEN event_type IS NULL THEN 'none' ELSE event_type END AS et FROM dirty"""))
def q_fn_null(spark, d):
    x = dirty(spark, d)
    return x.select("event_id", F.col("value").isNull().alias("is_null"),
                    F.coalesce("value", F.lit(-1.0)).alias("filled"),
                    F.when(F.col("event_type").isNull(), "none").otherwise(F.col("event_type")).alias("et"))


@register("fn_json", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  to_json(struct_pack(event_id := event_id, event_type := event_type))::VARCHAR AS js FROM events""")
def q_fn_json(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"),
                    F.to_json(F.struct("event_id", "event_type")).alias("js"))
