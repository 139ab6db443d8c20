"""The data behind each chart (CH1–CH4); drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat as C
from . import stats

# fixed values
HIST_BINS = 30
BOX_GROUPS = 12
BAR_TOP = 15


def _numeric(df: DataFrame, c: str) -> F.Column:
    dt = df.schema[c].dataType
    if C.is_numeric(dt):
        return C.col(c).cast("double")
    if C.is_bool(dt):
        return C.col(c).cast("int").cast("double")
    return C.parse_number(C.col(c))


def histogram(df: DataFrame, c: str, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width bins from min to max (last bin closed): (bin, lo, hi, n).

    One pass for min/max, one aggregation for the counts; empty bins are
    filled from a ``range`` of bin numbers (bins rows).
    """
    x = C.nan_to_null(df.select(_numeric(df, c).alias("x"))).where(F.col("x").isNotNull())
    r = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    spark = df.sparkSession
    if r["lo"] is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, n long")
    lo, hi = float(r["lo"]), float(r["hi"])
    width = (hi - lo) / bins if hi > lo else 1.0
    nb = bins if hi > lo else 1
    b = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)), F.lit(nb - 1)).cast("int")
    counts = x.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(nb).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                    F.when(F.col("bin") == nb - 1, F.lit(hi)).otherwise(F.lit(lo) + (F.col("bin") + 1) * F.lit(width))
                    .alias("hi"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def box(df: DataFrame, c: str, by: str | None = None, groups: int = BOX_GROUPS) -> DataFrame:
    """Box statistics: (grp, n, q1, median, q3, lower, upper, outliers).

    With a non-numeric ``by``: one box per group for the 12 most frequent
    groups (as text; null → 'None'); a numeric ``by`` is ignored. Whiskers
    are the extreme values inside the Tukey fences.
    """
    x = _numeric(df, c)
    use_by = by is not None and not C.is_numeric(df.schema[by].dataType, include_bool=True)
    if use_by:
        g = F.coalesce(C.col(by).cast("string"), F.lit("None"))
        base = df.select(g.alias("grp"), x.alias("x"))
        top = (base.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
               .orderBy(F.desc("_n"), "grp").limit(groups).select("grp"))
        base = base.join(F.broadcast(top), "grp")  # at most 12 group names
    else:
        base = df.select(F.lit(c).alias("grp"), x.alias("x"))
    base = C.nan_to_null(base).where(F.col("x").isNotNull())
    # one derived column per box (at most 12), all in the same two scans
    counts = {r["grp"]: int(r["n"]) for r in base.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    exprs = {f"g{i}": F.when(F.col("grp") == g, F.col("x")) for i, g in enumerate(counts)}
    quartiles = stats.exact_quantiles(base, list(exprs), [0.25, 0.5, 0.75], exprs=exprs)
    q = df.sparkSession.createDataFrame([(g, counts[g], *quartiles[f"g{i}"]) for i, g in enumerate(counts)],
                                        "grp string, n long, q1 double, median double, q3 double")
    fence = q.select("grp", "n", "q1", "median", "q3",
                     (F.col("q1") - C.IQR_K * (F.col("q3") - F.col("q1"))).alias("lo"),
                     (F.col("q3") + C.IQR_K * (F.col("q3") - F.col("q1"))).alias("hi"))
    inside = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
    w = (base.join(F.broadcast(fence), "grp")  # one fence row per box (≤ 12)
         .groupBy("grp", "n", "q1", "median", "q3")
         .agg(F.min(F.when(inside, F.col("x"))).alias("lower"), F.max(F.when(inside, F.col("x"))).alias("upper"),
              F.count_if(~inside).alias("outliers")))
    return w.select("grp", "n", *[C.rnd(k, 6).alias(k) for k in ["q1", "median", "q3", "lower", "upper"]],
                    "outliers")


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y) pairs where both values read as numbers."""
    out = C.nan_to_null(df.select(_numeric(df, x).alias("x"), _numeric(df, y).alias("y")))
    return out.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def bar(df: DataFrame, c: str, n: int = BAR_TOP) -> DataFrame:
    """The 15 most frequent values as text, nulls counted as 'nan'/'None'."""
    dt = df.schema[c].dataType
    none = "nan" if C.is_numeric(dt) else "None"
    v = F.coalesce(C.col(c).cast("string"), F.lit(none))
    return (df.groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "value").limit(n))
