"""Exploratory aggregates (overview, describe, nulls, outliers, distributions,
correlation, duplicates, cardinality, grouped means, trend).

Every function is ``DataFrame -> DataFrame``. Where a decision depends on the
data (which columns are constant, where the fences are), only the per-column
metadata is collected; the rows stay on the executors.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compat as C
from . import gram, stats

DIGITS = 6


def _spark(df: DataFrame):
    return df.sparkSession


def _lit_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Tiny frame (position, column) — O(columns) rows, built on the driver."""
    return _spark(df).createDataFrame([(i, c) for i, c in enumerate(cols)],
                                      "position int, column string")


# ── AG1 ─────────────────────────────────────────────────────────────────────
def overview(df: DataFrame) -> DataFrame:
    """rows, columns and null cells in one aggregation."""
    nulls = [F.count(F.lit(1)) - F.count(C.col(c)) for c in df.columns]
    total = nulls[0] if nulls else F.lit(0)
    for e in nulls[1:]:
        total = total + e
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.lit(len(df.columns)).cast("long").alias("columns"),
                  total.cast("long").alias("null_cells"))


def dtypes(df: DataFrame) -> DataFrame:
    return _spark(df).createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column string, data_type string")


# ── AG2 ─────────────────────────────────────────────────────────────────────
def describe_numeric(df: DataFrame, exact: bool = True) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per numeric column."""
    df = C.nan_to_null(df)
    num = C.numeric_columns(df)
    aggs = []
    for i, c in enumerate(num):
        x = C.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    schema = ("position int, column string, count long, mean double, std double, min double, "
              "p25 double, p50 double, p75 double, max double")
    if not num:
        return _spark(df).createDataFrame([], schema)
    r = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs).first()
    q = stats.quantiles(df, num, [0.25, 0.5, 0.75], exact=exact)
    pos = {c: k for k, c in enumerate(df.columns)}
    rows = [(pos[c], c, int(r[f"n{i}"]), r[f"a{i}"], r[f"s{i}"], r[f"lo{i}"], *q[c], r[f"hi{i}"])
            for i, c in enumerate(num)]
    out = _spark(df).createDataFrame(rows, schema)
    return out.select("position", "column", "count",
                      C.rnd_mean("mean", DIGITS).alias("mean"),
                      *[C.rnd(c, DIGITS).alias(c) for c in ["std", "min", "p25", "p50", "p75", "max"]])


def describe_text(df: DataFrame) -> DataFrame:
    """count, unique, top (most frequent; tie → smallest) and freq per text column."""
    txt = C.text_columns(df)
    vc = stats.value_counts_long(df, txt)
    agg = vc.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("value"))).alias("b"))
    agg = agg.select("column", "count", "unique", F.col("b.value").alias("top"),
                     (-F.col("b.neg")).alias("freq"))
    pos = _lit_columns(df, txt)
    return (F.broadcast(pos).join(agg, "column", "left")
            .select("position", "column", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                    F.coalesce("unique", F.lit(0)).cast("long").alias("unique"), "top",
                    F.col("freq").cast("long").alias("freq")))


def describe_time(df: DataFrame) -> DataFrame:
    """count, mean, min, quartiles, max per date/time column, as text to the second."""
    tcols = C.time_columns(df)
    schema = ("position int, column string, count long, mean string, min string, p25 string, "
              "p50 string, p75 string, max string")
    if not tcols:
        return _spark(df).createDataFrame([], schema)
    us = {c: F.unix_micros(C.col(c).cast("timestamp")) for c in tcols}
    aggs = []
    for i, c in enumerate(tcols):
        aggs += [F.count(us[c]).alias(f"n{i}"), F.avg(us[c]).alias(f"a{i}"),
                 F.min(us[c]).alias(f"lo{i}"), F.max(us[c]).alias(f"hi{i}")]
    r = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs).first()
    micro = df.select([us[c].alias(c) for c in tcols])
    q = stats.quantiles(micro, tcols, [0.25, 0.5, 0.75])
    def fl(v):
        return None if v is None else float(v)
    pos = {c: k for k, c in enumerate(df.columns)}
    rows = [(pos[c], c, int(r[f"n{i}"]), fl(r[f"a{i}"]), fl(r[f"lo{i}"]), *[fl(v) for v in q[c]], fl(r[f"hi{i}"]))
            for i, c in enumerate(tcols)]
    raw =_spark(df).createDataFrame(
        rows, "position int, column string, count long, mean double, min double, p25 double, "
              "p50 double, p75 double, max double")

    def fmt(c):
        return F.date_format(F.timestamp_seconds(F.floor(F.col(c) / 1e6)), "yyyy-MM-dd HH:mm:ss").alias(c)
    return raw.select("position", "column", "count", *[fmt(c) for c in
                                                       ["mean", "min", "p25", "p50", "p75", "max"]])


# ── AG3 ─────────────────────────────────────────────────────────────────────
def null_profile(df: DataFrame) -> DataFrame:
    """Percent of nulls per column, 2 decimals (half-even), only where > 0."""
    if not df.columns:
        return _spark(df).createDataFrame([], "column string, null_pct double")
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[(F.count(F.lit(1)) - F.count(C.col(c))).alias(f"_c{i}") for i, c in enumerate(cols)])
    names = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(f"_c{i}"), F.lit(c))])
    long = one.unpivot(["_n"], [f"_c{i}" for i in range(len(cols))], "_k", "nulls")
    pct = C.rnd_even(F.col("nulls") / F.col("_n") * 100, 2)
    return (long.where(F.col("_n") > 0)
            .select(names[F.col("_k")].alias("column"), pct.alias("null_pct"))
            .where(F.col("null_pct") > 0))


# ── AG4 / AG5 ───────────────────────────────────────────────────────────────
def outliers(df: DataFrame, c: str) -> DataFrame:
    """Values strictly outside q1 - 1.5·IQR .. q3 + 1.5·IQR (IQR 0 kept)."""
    dt = df.schema[c].dataType
    if not C.is_numeric(dt):
        return _spark(df).createDataFrame([], "value double")
    x = C.col(c).cast("double")
    q = stats.quantiles(df, [c], [0.25, 0.75])
    b = stats.fences(q, skip_zero_iqr=False).get(c)
    if b is None:
        return _spark(df).createDataFrame([], "value double")
    return df.select(x.alias("value")).where((F.col("value") < b[0]) | (F.col("value") > b[1]))


def outlier_counts(df: DataFrame, exact: bool = True) -> DataFrame:
    """Outlier count and percent of rows per numeric (non-boolean) column."""
    df = C.nan_to_null(df)
    num = C.numeric_columns(df)
    q = stats.quantiles(df, num, [0.25, 0.75], exact=exact)
    cnt = stats.outlier_counts(df, stats.fences(q, skip_zero_iqr=False))
    n = df.count()
    rows = [(i, c, int(cnt.get(c, 0))) for i, c in enumerate(num)]
    out = _spark(df).createDataFrame(rows, "position int, column string, outliers long")
    pct = C.rnd(F.col("outliers") / F.lit(n) * 100, 1) if n else F.lit(0.0)
    return out.withColumn("pct", pct.cast("double"))


# ── AG6 / AG7 ───────────────────────────────────────────────────────────────
def value_counts(df: DataFrame, c: str) -> DataFrame:
    """(value, n), nulls dropped, most frequent first, tie → value ascending."""
    return (df.where(C.col(c).isNotNull()).groupBy(C.col(c).alias("value"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("value")))


def category_distributions(df: DataFrame, categorical: list[str] | None = None) -> DataFrame:
    """(column, value, n) for every categorical column; one shuffle for all."""
    if categorical is None:
        from .typing import column_types
        categorical = column_types(df)["categoricas"]
    return stats.value_counts_long(df, categorical)


# numeric columns up to which each pair is an aggregate of its own
WIDE = 32


# ── AG8 / AG9 / CH5 ─────────────────────────────────────────────────────────
def correlation(df: DataFrame, digits: int = 3, blocks: bool | None = None) -> DataFrame:
    """Pearson r over pairwise-complete rows, long form (a, b, r) with i < j.

    Two scans, no shuffle. Pass 1: count, mean (the shift), min/max
    (constancy) per column. Pass 2: plain sums of shifted values — cheap,
    codegen-friendly aggregates. Columns without nulls share their
    per-column sums; only pairs involving a column with nulls get their own
    masked sums. Shifting by the mean keeps the sums well conditioned.
    Zero variance reports 0. Above ``WIDE`` columns the sums of all pairs come from
    products of column blocks instead (``gram.correlations``); ``blocks`` asks for one way.
    """
    df = C.nan_to_null(df)
    num = C.numeric_columns(df)
    schema = "i int, j int, col_a string, col_b string, r double"
    if len(num) < 2:
        return _spark(df).createDataFrame([], schema)
    if blocks or blocks is None and len(num) > WIDE:
        return _wide_correlation(df, num, digits)
    x = {c: C.col(c).cast("double") for c in num}
    p1 = []
    for k, c in enumerate(num):
        p1 += [F.count(x[c]).alias(f"nn{k}"), F.avg(x[c]).alias(f"m{k}"),
               (F.min(x[c]) == F.max(x[c])).alias(f"eq{k}")]
    r1 = df.agg(F.count(F.lit(1)).alias("_n"), *p1).first()
    n = int(r1["_n"])
    keep = [k for k in range(len(num)) if r1[f"nn{k}"] > 0 and not r1[f"eq{k}"]]
    if len(keep) < 2:
        return _spark(df).createDataFrame([], schema)
    full = {k for k in keep if r1[f"nn{k}"] == n}
    z = {k: x[num[k]] - F.lit(float(r1[f"m{k}"])) for k in keep}
    p2 = []
    for k in keep:
        if k in full:
            p2 += [F.sum(z[k]).alias(f"s{k}"), F.sum(z[k] * z[k]).alias(f"q{k}")]
    pairs = [(a, b) for a, b in combinations(keep, 2)]
    for a, b in pairs:
        p2.append(F.sum(z[a] * z[b]).alias(f"x{a}_{b}"))
        if not (a in full and b in full):
            both = x[num[a]].isNotNull() & x[num[b]].isNotNull()
            za, zb = F.when(both, z[a]), F.when(both, z[b])
            p2 += [F.count(za).alias(f"n{a}_{b}"), F.sum(za).alias(f"sa{a}_{b}"), F.sum(zb).alias(f"sb{a}_{b}"),
                   F.sum(za * za).alias(f"qa{a}_{b}"), F.sum(zb * zb).alias(f"qb{a}_{b}")]
    r2 = df.agg(*p2).first()
    rows = []
    for a, b in pairs:
        if a in full and b in full:
            m, sa, sb, qa, qb = n, r2[f"s{a}"], r2[f"s{b}"], r2[f"q{a}"], r2[f"q{b}"]
        else:
            m = r2[f"n{a}_{b}"]
            sa, sb, qa, qb = r2[f"sa{a}_{b}"], r2[f"sb{a}_{b}"], r2[f"qa{a}_{b}"], r2[f"qb{a}_{b}"]
        sab = r2[f"x{a}_{b}"]
        r = None
        if m and m > 1 and sab is not None:
            cov = sab - sa * sb / m
            va, vb = qa - sa * sa / m, qb - sb * sb / m
            if va > 0 and vb > 0:
                r = max(-1.0, min(1.0, cov / math.sqrt(va * vb)))
        rows.append((keep.index(a), keep.index(b), num[a], num[b], r))
    out = _spark(df).createDataFrame(rows, schema)
    return out.withColumn("r", C.rnd(F.coalesce(F.col("r"), F.lit(0.0)), digits))


def _wide_correlation(df: DataFrame, num: list[str], digits: int) -> DataFrame:
    rows = df.select(F.array(*[C.col(c).cast("double") for c in num]).alias("x"))
    _, (count, total, low, high, infinite) = gram.column_facts(rows, len(num))
    keep = [k for k in range(len(num)) if count[k] and low[k] != high[k]]
    if len(keep) < 2:
        return _spark(df).createDataFrame([], "i int, j int, col_a string, col_b string, r double")
    # a column with infinite values has no correlation; as a gap it leaves the others as they are
    shift = [math.nan if infinite[k] else total[k] / count[k] for k in keep]
    out = gram.correlations(rows, keep, np.array(shift), [num[k] for k in keep])
    return out.withColumn("r", C.rnd("r", digits))


def correlation_matrix_long(df: DataFrame) -> DataFrame:
    """Heat-map input: the full square (diagonal 1 and both triangles)."""
    pairs = correlation(df)
    cols = pairs.select(F.col("i").alias("k"), F.col("col_a").alias("c")).union(
        pairs.select(F.col("j").alias("k"), F.col("col_b").alias("c"))).distinct()
    diag = cols.select(F.col("c").alias("col_a"), F.col("c").alias("col_b"), F.lit(1.0).alias("r"))
    return (pairs.select("col_a", "col_b", "r")
            .union(pairs.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "r"))
            .union(diag))


def top_correlations(df: DataFrame, n: int = 5) -> DataFrame:
    """The n strongest pairs by |r|; ties keep the (i, j) generation order."""
    w = Window.orderBy(F.desc(F.abs("r")), "i", "j")
    # The pair list is p(p-1)/2 rows for p columns: a tiny frame, one partition is fine.
    return (correlation(df).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= n).select("rank", "col_a", "col_b", "r"))


# ── AG10 / AG11 ─────────────────────────────────────────────────────────────
def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row (nulls equal) and their percent."""
    n, dup = stats.duplicate_rows(df)
    s = _spark(df).createDataFrame([(dup, n)], "n long, rows long")
    return s.select(F.col("n").alias("duplicates"),
                    F.when(F.col("rows") > 0, C.rnd(F.col("n") / F.col("rows") * 100, 2))
                    .otherwise(F.lit(0.0)).alias("pct"))


FEW_VALUES = 255


def cardinality(df: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct non-null values per column. Columns of few values are settled without a
    shuffle (``stats.bounded_distinct``); only the cells of the others are shuffled, typed."""
    cols = df.columns
    if exact:
        n = stats.bounded_distinct(df, cols, FEW_VALUES)
        n |= stats.distinct_counts(df, [c for c in cols if n[c] > FEW_VALUES])
    else:
        n = stats.distinct_counts(df, cols, exact=False)
    return _spark(df).createDataFrame([(i, c, n[c]) for i, c in enumerate(cols)], "position int, column string, n_distinct long")


# ── AG12 – AG18 ─────────────────────────────────────────────────────────────
def _first_of(df: DataFrame, pred) -> str | None:
    for f in df.schema.fields:
        if pred(f.dataType):
            return f.name
    return None


def success_rate_by_year(df: DataFrame, ts: str | None = None, flag: str | None = None) -> DataFrame:
    """Share of true per year; columns default to the first date and first boolean."""
    ts = ts or _first_of(df, C.is_time)
    flag = flag or _first_of(df, C.is_bool)
    if ts is None or flag is None:
        return _spark(df).createDataFrame([], "year int, rate double")
    return (df.where(C.col(ts).isNotNull()).groupBy(F.year(C.col(ts)).alias("year"))
            .agg(C.rnd(F.avg(C.col(flag).cast("int")), DIGITS).alias("rate")))


def mean_by(df: DataFrame, g: str, v: str) -> DataFrame:
    """Mean of v per group; null groups dropped (as pandas does)."""
    return (df.where(C.col(g).isNotNull()).groupBy(C.col(g).alias(g))
            .agg(C.rnd(F.avg(C.col(v)), DIGITS).alias("mean")))


def unique_values(df: DataFrame, c: str) -> DataFrame:
    return df.select(C.col(c).alias("value")).where(F.col("value").isNotNull()).distinct().orderBy("value")


def value_range(df: DataFrame, c: str) -> DataFrame:
    x = C.col(c).cast("double")
    return df.agg(F.min(x).alias("min"), F.max(x).alias("max"))


def years(df: DataFrame, c: str | None = None) -> DataFrame:
    c = c or _first_of(df, C.is_time)
    if c is None:
        return _spark(df).createDataFrame([], "year int")
    return df.select(F.year(C.col(c)).alias("year")).where(F.col("year").isNotNull()).distinct().orderBy("year")


def month_frequency(df: DataFrame, c: str) -> DataFrame:
    return (df.where(C.col(c).isNotNull()).groupBy(F.month(C.col(c)).alias("month"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy("month"))


def trend_series(df: DataFrame, t: str, v: str) -> DataFrame:
    """Mean of v per period (the year, when t is a date)."""
    period = F.year(C.col(t)) if C.is_time(df.schema[t].dataType) else C.col(t)
    return (df.where(C.col(t).isNotNull() & C.col(v).isNotNull())
            .groupBy(period.cast("double").alias("period"))
            .agg(F.avg(C.col(v).cast("double")).alias("mean")))


def trend(df: DataFrame, t: str, v: str) -> DataFrame:
    """OLS slope over the period means; > 0.01 rising, < -0.01 falling, else flat."""
    s = trend_series(df, t, v).agg(F.regr_slope("mean", "period").alias("slope"),
                                   F.count(F.lit(1)).alias("periods"))
    slope = F.coalesce(F.col("slope"), F.lit(0.0))
    label = (F.when(slope > 0.01, "creciente").when(slope < -0.01, "decreciente").otherwise("estable"))
    return s.select(label.alias("trend"), C.rnd(slope, DIGITS).alias("slope"), "periods")
