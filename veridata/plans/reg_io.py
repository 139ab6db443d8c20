"""Checks for scans, documents, table utilities, the SQL box and URL filtering."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import filters as FI
from ..session import ensure_checkpoint_dir
from ..sources import files as FS
from ..sources import tables as TB
from .registry import register
from .views import TABLES, table


def _scratch(spark) -> str:
    """A fresh folder under the session's shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def _register_views(spark, d):
    for t in TABLES:
        table(spark, d, t).createOrReplaceTempView(t)


# ── scans ───────────────────────────────────────────────────────────────────
@register("scan_csv", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def q_scan_csv(spark, d):
    p = _scratch(spark)
    table(spark, d, "nation").write.option("header", True).csv(p)
    return FS.read_csv(spark, p)


@register("scan_tsv", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def q_scan_tsv(spark, d):
    p = _scratch(spark)
    table(spark, d, "nation").write.option("header", True).option("sep", "\t").csv(p)
    return FS.read_tsv(spark, p + "/*.csv")


def _region_doc(spark, d) -> str:
    """Write region as one JSON object {"meta": "x", "rows": [...]} (5 rows)."""
    p = _scratch(spark)
    reg = table(spark, d, "region")
    doc = reg.agg(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("rows")) \
        .select(F.to_json(F.struct(F.lit("x").alias("meta"), "rows")).alias("value"))
    doc.coalesce(1).write.text(p)
    return p


@register("scan_json", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def q_scan_json(spark, d):
    return FS.read_json(spark, _region_doc(spark, d), find_list=True)


@register("scan_json_root", "SELECT 'x' AS meta, count(*)::INTEGER AS n_rows FROM region")
def q_scan_json_root(spark, d):
    df = FS.read_json(spark, _region_doc(spark, d), find_list=False)
    return df.select("meta", F.size("rows").alias("n_rows"))


@register("scan_json_list", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def q_scan_json_list(spark, d):
    p = _scratch(spark)
    nat = table(spark, d, "nation")
    # A root-list document is one unsplittable record (25 fixed rows here);
    # JSON lines is the splittable layout for large inputs.
    doc = nat.agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))))
                  .alias("value"))
    doc.coalesce(1).write.text(p)
    return FS.read_json(spark, p)


def _customer_docs(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("_id"),
                    F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal")).alias("info"),
                    F.array("c_mktsegment").alias("tags"))


@register("flatten_docs", 'SELECT c_custkey AS _id, c_name AS "info.name", c_acctbal AS "info.bal", '
          '[c_mktsegment] AS tags FROM customer')
def q_flatten(spark, d):
    return FS.flatten(_customer_docs(spark, d))


@register("docs_id_string", 'SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name AS "info.name", '
          'c_acctbal AS "info.bal", [c_mktsegment] AS tags FROM customer')
def q_docs_id(spark, d):
    return FS.read_documents(_customer_docs(spark, d))


@register("collection_summary",
          "SELECT 'clientes' AS collection, count(*)::BIGINT AS documents, '_id, info, tags' AS fields FROM customer "
          "UNION ALL SELECT 'naciones', count(*), 'n_nationkey, n_name, n_regionkey' FROM nation")
def q_collection_summary(spark, d):
    return FS.collection_summary({"clientes": _customer_docs(spark, d), "naciones": table(spark, d, "nation")})


# ── tables ──────────────────────────────────────────────────────────────────
@register("table_scan", "SELECT * FROM nation")
def q_table_scan(spark, d):
    _register_views(spark, d)
    return TB.read_table(spark, "nation")


@register("table_schema")
def q_table_schema(spark, d):
    return TB.describe_table(table(spark, d, "orders"), keys=["o_orderkey"])


_ORD = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register("candidate_keys", "SELECT position, \"column\" FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", count(*) AS n, count({c}) AS nn, count(DISTINCT {c}) AS d "
    f"FROM orders" for i, c in enumerate(_ORD)) + ") WHERE n = nn AND n = d AND n > 0")
def q_candidate_keys(spark, d):
    return TB.candidate_keys(table(spark, d, "orders"))


@register("row_count", "SELECT count(*)::BIGINT AS \"rows\" FROM lineitem")
def q_row_count(spark, d):
    return TB.count_rows(table(spark, d, "lineitem"))


_LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
       "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@register("preview_rows", "SELECT " + ", ".join(
    c if c != "l_shipdate" else "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate" for c in _LI)
    + " FROM lineitem ORDER BY " + ", ".join(_LI) + " LIMIT 10")
def q_preview(spark, d):
    return TB.preview(table(spark, d, "lineitem"), 10)


@register("intake_guard", "SELECT *, (SELECT count(*) FROM lineitem) > 50000 AS over_limit FROM lineitem")
def q_guard(spark, d):
    df, over = TB.guard(table(spark, d, "lineitem"), max_rows=50_000, max_cols=1_000)
    return df.withColumn("over_limit", F.lit(over))


_COLS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11,
         "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3,
         "conversations": 4}


@register("source_registry", " UNION ALL ".join(
    f"SELECT '{t}' AS name, 'CSV' AS type, count(*)::BIGINT AS \"rows\", {n}::BIGINT AS cols, 'Ready' AS status "
    f"FROM {t}" for t, n in sorted(_COLS.items())))
def q_registry(spark, d):
    _register_views(spark, d)
    return TB.table_inventory(spark, TABLES).drop("size")


@register("records_json", "SELECT to_json(struct_pack(n_nationkey := n_nationkey, n_name := n_name, "
          "n_regionkey := n_regionkey))::VARCHAR AS record FROM nation")
def q_records(spark, d):
    return TB.to_records(table(spark, d, "nation"))


# ── SQL box: the same text runs on Spark and DuckDB ─────────────────────────
SQL_BOX = {
    "sql_adhoc": ("SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)) * 100) / 100 AS revenue "
                  "FROM lineitem GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey", True),
    "sql_save": ("SELECT c.c_mktsegment, count(*) AS orders, round(avg(o.o_totalprice), 2) AS avg_price "
                 "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment", False),
    "sql_join": ("SELECT n.n_name, count(*) AS suppliers, "
                 "sum(CASE WHEN s2.s_suppkey IS NULL THEN 0 ELSE 1 END) AS rich "
                 "FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey "
                 "LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) s2 ON s.s_suppkey = s2.s_suppkey "
                 "WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey) "
                 "AND NOT EXISTS (SELECT 1 FROM region r WHERE r.r_regionkey = n.n_regionkey AND r.r_name = 'NOPE') "
                 "GROUP BY n.n_name", False),
    "sql_groupby_having": ("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty "
                           "FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 100", False),
    "sql_grouping_sets": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem "
                          "GROUP BY ROLLUP (l_returnflag, l_linestatus)", False),
    "sql_cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem "
                 "GROUP BY CUBE (l_returnflag, l_linestatus)", False),
    "sql_window": ("SELECT o_custkey, o_orderkey, "
                   "rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk, "
                   "lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_order, "
                   "round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey "
                   "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS run3 FROM orders", False),
    "sql_setops": ("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region "
                   "UNION ALL (SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer) "
                   "UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)", False),
    "sql_cte": ("WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10) "
                "SELECT c.c_mktsegment, count(*) AS customers FROM big JOIN customer c ON c.c_custkey = big.o_custkey "
                "GROUP BY c.c_mktsegment", False),
    "sql_subquery": ("SELECT p_partkey, p_retailprice FROM part p WHERE p_retailprice > "
                     "(SELECT avg(p2.p_retailprice) FROM part p2 WHERE p2.p_brand = p.p_brand)", False),
    "sql_case_filter": ("SELECT CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 250000 "
                        "THEN 'medium' ELSE 'large' END AS size, count(*) AS n FROM orders "
                        "WHERE o_orderstatus IN ('F', 'O') GROUP BY 1", False),
}

for _key, (_sql, _capped) in SQL_BOX.items():
    _oracle = _sql

    def _run(spark, d, _sql=_sql, _capped=_capped, _key=_key):
        _register_views(spark, d)
        if _capped:
            return TB.run_sql(spark, _sql)
        return TB.save_sql(spark, _sql, _key)[1]
    register(_key, _oracle)(_run)


# ── FI10 ────────────────────────────────────────────────────────────────────
_LITERAL_URLS = ["http://127.0.0.1/", "http://10.0.0.1/", "http://169.254.169.254/", "ftp://x/",
                 "https://8.8.8.8/x", "http://localhost:8000/", "http://[::1]/", "http://192.168.1.5/a",
                 "https://example.org/ok"]

_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)', 1))"
_URL_ORACLE = f"""
WITH u AS (SELECT url FROM pages UNION ALL SELECT * FROM (VALUES {", ".join(f"('{x}')" for x in _LITERAL_URLS)}) v(url)),
h AS (SELECT url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, {_HOST} AS host FROM u),
o AS (SELECT *, regexp_matches(host, '^\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}$') AS v4,
       TRY_CAST(split_part(host, '.', 1) AS INTEGER) AS a, TRY_CAST(split_part(host, '.', 2) AS INTEGER) AS b,
       TRY_CAST(split_part(host, '.', 3) AS INTEGER) AS c, TRY_CAST(split_part(host, '.', 4) AS INTEGER) AS d
       FROM h)
SELECT url FROM o WHERE scheme IN ('http', 'https') AND host <> '' AND host <> 'localhost'
  AND NOT ends_with(host, '.localhost')
  AND CASE WHEN v4 THEN a <= 255 AND b <= 255 AND c <= 255 AND d <= 255 AND NOT (
        a = 0 OR a = 10 OR a = 127 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
        OR (a = 192 AND b = 0 AND c = 0) OR (a = 192 AND b = 0 AND c = 2) OR (a = 192 AND b = 168)
        OR (a = 198 AND b BETWEEN 18 AND 19) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)
        OR a >= 224)
      WHEN starts_with(host, '[') THEN NOT (replace(replace(host, '[', ''), ']', '') IN ('::', '::1')
        OR regexp_matches(replace(replace(host, '[', ''), ']', ''), '^(fc|fd|fe8|fe9|fea|feb|ff)')
        OR starts_with(replace(replace(host, '[', ''), ']', ''), '::ffff:'))
      ELSE true END
"""


@register("url_public", _URL_ORACLE)
def q_url_public(spark, d):
    lit = spark.createDataFrame([(u,) for u in _LITERAL_URLS], "url string")
    urls = table(spark, d, "pages").select("url").unionByName(lit)
    return FI.filter_public_urls(urls, "url")
