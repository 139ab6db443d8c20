"""The fused column profile: "what does this table look like?".

One row per column: counts, nulls, distinct values, moments, quartiles and
Tukey outliers. Four passes over the data, each a single aggregation:

1. row count, non-null counts, mean/std/min/max (no shuffle; partial
   aggregation per task); a cardinality bound per numeric column (the row
   count when it is under the exact bound, else an HLL pass);
2. exact distinct counts *and* quartiles from one ``groupBy(column, value)``
   shuffle: the grouped (value, count) rows feed ``percentile`` with a
   frequency, for columns under the HLL cardinality bound (the others use a
   sketch); with ``exact=False`` the HLL numbers and sketches are used;
4. outlier counts against the fences from pass 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compat as C
from ..functions.spread import shared
from ..operators import stats

PROFILE_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("column", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("non_null", T.LongType()),
    T.StructField("nulls", T.LongType()),
    T.StructField("distinct", T.LongType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("q1", T.DoubleType()),
    T.StructField("median", T.DoubleType()),
    T.StructField("q3", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("outliers", T.LongType()),
])
ROUNDED = ["mean", "std", "min", "q1", "median", "q3", "max"]


def profile(df: DataFrame, exact: bool = True, digits: int = 6) -> DataFrame:
    with shared(C.nan_to_null(df)) as rows:
        return _profile(rows, exact, digits)


def _profile(df: DataFrame, exact: bool, digits: int) -> DataFrame:
    fields = df.schema.fields
    cols = [f.name for f in fields]
    num = [f.name for f in fields if C.is_numeric(f.dataType)]

    # pass 1
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs.append(F.count(C.col(c)).alias(f"nn{i}"))
        if not exact:
            aggs.append(F.approx_count_distinct(C.col(c)).alias(f"hll{i}"))
        if c in num:
            x = C.col(c).cast("double")
            aggs += [F.avg(x).alias(f"avg{i}"), F.stddev_samp(x).alias(f"sd{i}"),
                     F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
    r1 = df.agg(*aggs).first()
    n = int(r1["_n"])

    # one shuffle gives exact distinct counts, two scans the quartiles
    distinct = stats.distinct_counts(df, cols) if exact else {c: int(r1[f"hll{i}"]) for i, c in enumerate(cols)}
    q = stats.quantiles(df, num, [0.25, 0.5, 0.75], exact=exact)

    # pass 4
    outl = stats.outlier_counts(df, stats.fences(q, skip_zero_iqr=False))

    rows = []
    for i, f in enumerate(fields):
        c = f.name
        is_num = c in num
        qs = q.get(c, [None, None, None])
        rows.append((
            i, c, f.dataType.simpleString(), n, int(r1[f"nn{i}"]), n - int(r1[f"nn{i}"]),
            int(distinct[c]),
            r1[f"avg{i}"] if is_num else None, r1[f"sd{i}"] if is_num else None,
            r1[f"min{i}"] if is_num else None, qs[0], qs[1], qs[2],
            r1[f"max{i}"] if is_num else None,
            (outl.get(c, 0) if is_num else None),
        ))
    out = df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)
    return out.select([(C.rnd_mean if c == "mean" else C.rnd)(c, digits).alias(c) if c in ROUNDED else F.col(c)
                       for c in out.columns])
