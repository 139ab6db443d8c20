"""Checks for profiling and exploratory aggregates (AG*, TY1, entry profile)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import compat as C
from ..operators import eda
from ..operators.typing import column_types_df
from . import sqlgen as G
from .profile import profile
from .registry import register
from .views import dirty, dirty_cte, table

_NUM_LI = G.numeric(G.LINEITEM)


@register("profile", G.profile("lineitem", G.LINEITEM))
def q_profile(spark, d):
    return profile(table(spark, d, "lineitem"))


@register("eda_overview", dirty_cte(
    "SELECT count(*)::BIGINT AS \"rows\", 11::BIGINT AS \"columns\", ("
    + " + ".join(f"count(*) - count({G.q(c)})" for c, _ in G.DIRTY)
    + ")::BIGINT AS null_cells FROM dirty"))
def q_overview(spark, d):
    return eda.overview(dirty(spark, d))


@register("eda_describe_num", "SELECT * FROM (" + G.union([
    f"SELECT {i}, '{c}', count({G.q(c)})::BIGINT, round(round(avg({G.q(c)}), 12), 6), round(stddev_samp({G.q(c)}), 6), "
    f"round(min({G.q(c)})::DOUBLE, 6), round(quantile_cont({G.q(c)}, 0.25), 6), "
    f"round(quantile_cont({G.q(c)}, 0.5), 6), round(quantile_cont({G.q(c)}, 0.75), 6), "
    f"round(max({G.q(c)})::DOUBLE, 6) FROM lineitem" for i, c in enumerate(_NUM_LI)])
    + ") AS t(position, \"column\", \"count\", mean, std, \"min\", p25, p50, p75, \"max\")")
def q_describe_num(spark, d):
    return eda.describe_numeric(table(spark, d, "lineitem"))


_TXT_DIRTY = G.text(G.DIRTY)


@register("eda_describe_text", dirty_cte(
    ", lv AS (" + G.long_values("dirty", _TXT_DIRTY) + "),\n"
    "vc AS (SELECT \"column\", value, count(*) AS n FROM lv GROUP BY 1, 2),\n"
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS rk FROM vc),\n"
    "cols AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(_TXT_DIRTY))
    + ") AS c(position, \"column\"))\n"
    "SELECT position, cols.\"column\", coalesce(sum(vc.n), 0)::BIGINT AS \"count\", "
    "count(vc.value)::BIGINT AS \"unique\", "
    "max(CASE WHEN r.rk = 1 THEN r.value END) AS top, max(CASE WHEN r.rk = 1 THEN r.n END)::BIGINT AS freq "
    "FROM cols LEFT JOIN vc ON vc.\"column\" = cols.\"column\" "
    "LEFT JOIN ranked r ON r.\"column\" = vc.\"column\" AND r.value = vc.value GROUP BY 1, 2"))
def q_describe_text(spark, d):
    return eda.describe_text(dirty(spark, d))


def _fmt(x: str) -> str:
    return f"strftime(make_timestamp(CAST(floor(({x}) / 1e6) * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S')"


@register("eda_describe_time",
          "SELECT 4 AS position, 'o_orderdate' AS \"column\", count(o_orderdate)::BIGINT AS \"count\", "
          + ", ".join(f"{_fmt(e)} AS {n}" for n, e in [
              ("mean", "avg(epoch_us(o_orderdate))"), ("\"min\"", "min(epoch_us(o_orderdate))"),
              ("p25", "quantile_cont(epoch_us(o_orderdate), 0.25)"),
              ("p50", "quantile_cont(epoch_us(o_orderdate), 0.5)"),
              ("p75", "quantile_cont(epoch_us(o_orderdate), 0.75)"),
              ("\"max\"", "max(epoch_us(o_orderdate))")]) + " FROM orders")
def q_describe_time(spark, d):
    return eda.describe_time(table(spark, d, "orders"))


@register("eda_nulls", dirty_cte("SELECT * FROM (" + G.union([
    f"SELECT '{c}' AS \"column\", round_even((count(*) - count({G.q(c)})) * 100.0 / count(*), 2) AS null_pct "
    f"FROM dirty" for c, _ in G.DIRTY]) + ") WHERE null_pct > 0"))
def q_nulls(spark, d):
    return eda.null_profile(dirty(spark, d))


@register("eda_outlier_values",
          "WITH f AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b "
          "FROM events) SELECT value FROM events, f "
          "WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)")
def q_outlier_values(spark, d):
    return eda.outliers(table(spark, d, "events"), "value")


@register("eda_outlier_counts", "SELECT *, round(outliers * 100.0 / (SELECT count(*) FROM lineitem), 1) AS pct "
          "FROM (" + G.union([
              f"SELECT {i} AS position, '{c}' AS \"column\", (SELECT count(*) FROM lineitem, "
              f"(SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM lineitem) f "
              f"WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))::BIGINT AS outliers"
              for i, c in enumerate(_NUM_LI)]) + ")")
def q_outlier_counts(spark, d):
    return eda.outlier_counts(table(spark, d, "lineitem"))


@register("eda_value_counts", dirty_cte(
    "SELECT event_type AS value, count(*)::BIGINT AS n FROM dirty WHERE event_type IS NOT NULL GROUP BY 1"))
def q_value_counts(spark, d):
    return eda.value_counts(dirty(spark, d), "event_type")


@register("eda_distributions", dirty_cte(
    ", lv AS (" + G.long_values("dirty", _TXT_DIRTY) + "),\n"
    "card AS (SELECT \"column\", count(DISTINCT value) AS d FROM lv GROUP BY 1),\n"
    "nn AS (SELECT count(*) AS n FROM dirty)\n"
    "SELECT lv.\"column\", value, count(*)::BIGINT AS n FROM lv JOIN card ON card.\"column\" = lv.\"column\", nn "
    "WHERE d <= least(50, nn.n * 0.5) GROUP BY 1, 2"))
def q_distributions(spark, d):
    return eda.category_distributions(dirty(spark, d))


def _corr_sql() -> str:
    cols = _NUM_LI
    parts = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            a, b = cols[i], cols[j]
            parts.append(f"SELECT {i} AS i, {j} AS j, '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r0 "
                         f"FROM lineitem HAVING min({a}) <> max({a}) AND min({b}) <> max({b})")
    return ("SELECT i, j, col_a, col_b, round(CASE WHEN r0 IS NULL OR isnan(r0) THEN 0 ELSE r0 END, 3) + 0.0 AS r "
            "FROM (" + G.union(parts) + ")")


@register("eda_corr", "SELECT col_a, col_b, r FROM (" + _corr_sql() + ")")
def q_corr(spark, d):
    return eda.correlation(table(spark, d, "lineitem")).select("col_a", "col_b", "r")


def _corr_nulls_sql() -> str:
    cols = [c for c, t in G.DIRTY if t in G.NUMERIC]
    return G.union([
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(CASE WHEN corr({a}, {b}) IS NULL OR isnan(corr({a}, {b})) THEN 0 "
        f"ELSE corr({a}, {b}) END, 3) + 0.0 AS r FROM dirty" for i, a in enumerate(cols) for b in cols[i + 1:]])


@register("eda_corr_nulls", dirty_cte(_corr_nulls_sql()))
def q_corr_nulls(spark, d):
    """Columns with gaps, by block products."""
    return eda.correlation(dirty(spark, d), blocks=True).select("col_a", "col_b", "r")


@register("eda_corr_top", "SELECT rank, col_a, col_b, r FROM (SELECT *, row_number() OVER "
          "(ORDER BY abs(r) DESC, i, j) AS rank FROM (" + _corr_sql() + ")) WHERE rank <= 5")
def q_corr_top(spark, d):
    return eda.top_correlations(table(spark, d, "lineitem"), 5)


@register("chart_heatmap", "WITH p AS (" + _corr_sql() + "), "
          "d AS (SELECT col_a AS c FROM p UNION SELECT col_b FROM p) "
          "SELECT col_a, col_b, r FROM p UNION ALL SELECT col_b, col_a, r FROM p "
          "UNION ALL SELECT c, c, 1.0 FROM d")
def q_heatmap(spark, d):
    return eda.correlation_matrix_long(table(spark, d, "lineitem"))


@register("eda_duplicates", dirty_cte(
    "SELECT sum(n - 1)::BIGINT AS duplicates, round(sum(n - 1) * 100.0 / sum(n), 2) AS pct FROM "
    "(SELECT count(*) AS n FROM dirty GROUP BY ALL_COLS)".replace(
        "ALL_COLS", ", ".join(G.q(c) for c, _ in G.DIRTY))))
def q_duplicates(spark, d):
    return eda.duplicate_rows(dirty(spark, d))


@register("eda_cardinality", dirty_cte("SELECT * FROM (" + G.union([
    f"SELECT {i} AS position, '{c}' AS \"column\", count(DISTINCT {G.q(c)})::BIGINT AS n_distinct FROM dirty"
    for i, (c, _) in enumerate(G.DIRTY)]) + ")"))
def q_cardinality(spark, d):
    return eda.cardinality(dirty(spark, d))


@register("eda_cardinality_approx")
def q_cardinality_approx(spark, d):
    return eda.cardinality(dirty(spark, d), exact=False)


@register("column_types", dirty_cte(
    ", lv AS (" + G.long_values("dirty", _TXT_DIRTY) + "),\n"
    "card AS (SELECT \"column\", count(DISTINCT value) AS d FROM lv GROUP BY 1),\n"
    "nn AS (SELECT count(*) AS n FROM dirty),\n"
    "cols AS (SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{c}', '{t}')" for i, (c, t) in enumerate(G.DIRTY)) + ") AS c(position, \"column\", t))\n"
    "SELECT position, cols.\"column\", CASE WHEN t LIKE 'timestamp%' THEN 'fechas' "
    "WHEN t <> 'string' THEN 'numericas' WHEN coalesce(d, 0) > least(50, n * 0.5) THEN 'texto_libre' "
    "ELSE 'categoricas' END AS kind FROM cols LEFT JOIN card ON card.\"column\" = cols.\"column\", nn"))
def q_column_types(spark, d):
    return column_types_df(dirty(spark, d))


@register("agg_success_rate_year", dirty_cte(
    "SELECT year(ts)::INTEGER AS year, round(avg(CAST(success AS INTEGER)), 6) AS rate FROM dirty "
    "WHERE ts IS NOT NULL GROUP BY 1"))
def q_success_rate(spark, d):
    return eda.success_rate_by_year(dirty(spark, d))


@register("agg_mean_by", dirty_cte(
    "SELECT event_type, round(avg(value), 6) AS mean FROM dirty WHERE event_type IS NOT NULL GROUP BY 1"))
def q_mean_by(spark, d):
    return eda.mean_by(dirty(spark, d), "event_type", "value")


@register("unique_values", "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL")
def q_unique_values(spark, d):
    return eda.unique_values(table(spark, d, "orders"), "o_orderpriority")


@register("value_range", "SELECT min(l_extendedprice) AS \"min\", max(l_extendedprice) AS \"max\" FROM lineitem")
def q_value_range(spark, d):
    return eda.value_range(table(spark, d, "lineitem"), "l_extendedprice")


@register("years_available", "SELECT DISTINCT year(o_orderdate)::INTEGER AS year FROM orders "
          "WHERE o_orderdate IS NOT NULL")
def q_years(spark, d):
    return eda.years(table(spark, d, "orders"))


@register("agg_month_freq", "SELECT month(o_orderdate)::INTEGER AS month, count(*)::BIGINT AS n FROM orders "
          "WHERE o_orderdate IS NOT NULL GROUP BY 1")
def q_month_freq(spark, d):
    return eda.month_frequency(table(spark, d, "orders"), "o_orderdate")


@register("agg_trend",
          "WITH s AS (SELECT year(o_orderdate)::DOUBLE AS period, avg(o_totalprice) AS mean FROM orders "
          "WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1), "
          "r AS (SELECT coalesce(regr_slope(mean, period), 0) AS slope, count(*)::BIGINT AS periods FROM s) "
          "SELECT CASE WHEN slope > 0.01 THEN 'creciente' WHEN slope < -0.01 THEN 'decreciente' "
          "ELSE 'estable' END AS trend, round(slope, 6) AS slope, periods FROM r")
def q_trend(spark, d):
    return eda.trend(table(spark, d, "orders"), "o_orderdate", "o_totalprice")


@register("chart_line",
          "SELECT year(o_orderdate)::DOUBLE AS period, round(avg(o_totalprice), 6) AS mean FROM orders "
          "WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1")
def q_chart_line(spark, d):
    s = eda.trend_series(table(spark, d, "orders"), "o_orderdate", "o_totalprice")
    return s.select("period", C.rnd("mean", 6).alias("mean"))
