"""Multi-column statistics computed in as few Spark passes as possible.

Each helper returns small per-column metadata (one value per column) to the
driver; the data itself never leaves the executors.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compat as C
from ..functions.scratch import stage
from . import gram


def _safe(i: int) -> str:
    return f"_c{i}"


def non_null_counts(df: DataFrame, cols: list[str] | None = None) -> tuple[int, dict[str, int]]:
    """Row count and non-null count per column in one pass (no shuffle)."""
    cols = list(df.columns if cols is None else cols)
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count(C.col(c)).alias(_safe(i)) for i, c in enumerate(cols)]
    row = df.agg(*aggs).first()
    return int(row["_n"]), {c: int(row[_safe(i)]) for i, c in enumerate(cols)}


def long_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value-as-text) rows for the given columns, nulls dropped.

    One Expand-like projection; every later ``groupBy(column, value)`` is a
    single shuffle with map-side partial aggregation, so a value repeated in a
    third of all rows collapses before it is sent.
    """
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string")
    tmp = df.select([C.col(c).cast("string").alias(_safe(i)) for i, c in enumerate(cols)])
    names = [_safe(i) for i in range(len(cols))]
    rename = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(_safe(i)), F.lit(c))])
    out = tmp.unpivot([], names, "_k", "value").where(F.col("value").isNotNull())
    return out.select(rename[F.col("_k")].alias("column"), "value")


def value_counts_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n) for every non-null value of every column."""
    return long_values(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def typed_key(f: T.StructField) -> F.Column:
    """Exact, typed grouping key for any column: struct(l long, d double, s string).

    Integral, boolean and date/time values go to ``l`` (time as µs), floats to
    ``d``, everything else to ``s`` as text — cheaper to hash than text for
    numbers, and exact (no long → double rounding).
    """
    x = C.col(f.name)
    dt = f.dataType
    none_l, none_d, none_s = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        parts = (x.cast("long"), none_d, none_s)
    elif isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        parts = (F.unix_micros(x.cast("timestamp")), none_d, none_s)
    elif isinstance(dt, (T.FloatType, T.DoubleType)):
        parts = (none_l, x.cast("double"), none_s)
    else:
        parts = (none_l, none_d, x.cast("string"))
    return F.struct(parts[0].alias("l"), parts[1].alias("d"), parts[2].alias("s"))


def grouped_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(c, v, n): every distinct non-null typed value per column index, one shuffle."""
    fields = {f.name: f for f in df.schema.fields}
    items = [F.when(C.col(c).isNotNull(), F.struct(F.lit(i).alias("c"), typed_key(fields[c]).alias("v")))
             for i, c in enumerate(cols)]
    ex = df.select(F.explode(F.array(*items)).alias("p")).where(F.col("p").isNotNull())
    return ex.groupBy(F.col("p.c").alias("c"), F.col("p.v").alias("v")).agg(F.count(F.lit(1)).alias("n"))


def distinct_and_modes(df: DataFrame, cols: list[str], mode_cols: list[str]) -> tuple[dict[str, int], dict[str, object]]:
    """Exact distinct counts for ``cols`` and the most frequent value of ``mode_cols`` (tie →
    smallest; None without values) from one ``groupBy(column, value)`` shuffle."""
    if not cols:
        return {}, {}
    # the mode is a minimum: a constant-size streaming buffer
    got = {r["c"]: r for r in grouped_values(df, cols).groupBy("c").agg(
        F.count(F.lit(1)).alias("d"), F.min(F.struct((-F.col("n")).alias("neg"), F.col("v").alias("v"))).alias("m")).collect()}
    fields = {f.name: f.dataType for f in df.schema.fields}
    at = {c: got.get(i) for i, c in enumerate(cols)}
    return ({c: int(r["d"]) if r else 0 for c, r in at.items()},
            {c: _typed_value(at[c]["m"]["v"], fields[c]) if at[c] else None for c in mode_cols})


def _typed_value(v, dt: T.DataType):
    """Typed grouping key → a literal the column type can cast from."""
    import datetime as _dt
    if v is None:
        return None
    if v["s"] is not None:
        return v["s"]
    if v["d"] is not None:
        return v["d"]
    if isinstance(dt, T.BooleanType):
        return "true" if v["l"] else "false"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        t = _dt.datetime(1970, 1, 1) + _dt.timedelta(microseconds=int(v["l"]))
        return t.isoformat(sep=" ")
    return v["l"]


def distinct_counts(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> dict[str, int]:
    """Distinct non-null values per column.

    Exact: one ``groupBy(column, value)`` shuffle then a count per column.
    Approximate: HyperLogLog++ in one pass with no data shuffle.
    """
    cols = list(df.columns if cols is None else cols)
    if not cols:
        return {}
    if not exact:
        row = df.agg(*[F.approx_count_distinct(C.col(c)).alias(_safe(i)) for i, c in enumerate(cols)]).first()
        return {c: int(row[_safe(i)]) for i, c in enumerate(cols)}
    got = {r["c"]: int(r["d"]) for r in
           grouped_values(df, cols).groupBy("c").agg(F.count(F.lit(1)).alias("d")).collect()}
    return {c: got.get(i, 0) for i, c in enumerate(cols)}


def is_constant(df: DataFrame, cols: list[str] | None = None) -> tuple[dict[str, int], dict[str, bool]]:
    """Null counts and "at most one distinct non-null value" in one pass.

    ``min == max`` decides constancy without counting distinct values, so it
    costs a single scan with constant-size buffers.
    """
    cols = list(df.columns if cols is None else cols)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs += [F.count(C.col(c)).alias(f"nn{i}"),
                 (F.min(C.col(c)) == F.max(C.col(c))).alias(f"eq{i}")]
    row = df.agg(*aggs).first()
    n = int(row["_n"])
    nulls = {c: n - int(row[f"nn{i}"]) for i, c in enumerate(cols)}
    const = {c: (int(row[f"nn{i}"]) == 0) or bool(row[f"eq{i}"]) for i, c in enumerate(cols)}
    return nulls, const


def column_facts(df: DataFrame) -> dict:
    """One scan: rows, nulls and constancy per column, plus the mean of
    numeric columns (the inputs of fill plans)."""
    cols = df.columns
    num = set(C.numeric_columns(df))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs += [F.count(C.col(c)).alias(f"nn{i}"), (F.min(C.col(c)) == F.max(C.col(c))).alias(f"eq{i}")]
        if c in num:
            aggs.append(F.avg(C.col(c)).alias(f"avg{i}"))
    row = df.agg(*aggs).first()
    n = int(row["_n"])
    return {
        "rows": n,
        "nulls": {c: n - int(row[f"nn{i}"]) for i, c in enumerate(cols)},
        "const": {c: int(row[f"nn{i}"]) == 0 or bool(row[f"eq{i}"]) for i, c in enumerate(cols)},
        "mean": {c: row[f"avg{i}"] for i, c in enumerate(cols) if c in num},
    }


def _plain(f: T.StructField) -> F.Column:
    """A value in a plain type; equal values (0.0 and -0.0) are equal there too."""
    x = C.col(f.name)
    if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return x.cast("long")
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return x.cast("double") + F.lit(0.0)
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(x.cast("timestamp"))
    return x.cast("string")


def bounded_distinct(df: DataFrame, cols: list[str], most: int) -> dict[str, int]:
    """Distinct non-null values per column, exact up to ``most``; ``most + 1`` means more.

    One scan merges a set of the smallest value hashes per column (a theta sketch of at least
    ``most + 1`` entries: it is exact as long as it holds all). More hashes are more values.
    Where there are at most ``most``, a second scan of just these columns gathers the few
    values themselves, so two values of one hash still count as two. Nothing is exploded or
    shuffled by value.
    """
    if not cols:
        return {}
    fields = {f.name: f for f in df.schema.fields}
    entries = max(4, (most + 1 - 1).bit_length())
    row = df.agg(*[F.theta_sketch_estimate(F.theta_sketch_agg(_sketched(fields[c]), entries)).alias(_safe(i))
                   for i, c in enumerate(cols)]).first()
    few = [c for i, c in enumerate(cols) if int(row[_safe(i)]) <= most]
    out = {c: most + 1 for c in cols}
    if few:
        row = df.agg(*[F.size(F.collect_set(_plain(fields[c]))).alias(_safe(i)) for i, c in enumerate(few)]).first()
        out.update({c: min(int(row[_safe(i)]), most + 1) for i, c in enumerate(few)})
    return out


def _hashed(value: F.Column) -> F.Column:
    """What the sketches of ``bounded_distinct`` hash; as they skip the empty text, it is given
    another one (which may be a value too: the second scan tells them apart)."""
    return value


def _sketched(f: T.StructField) -> F.Column:
    value = _plain(f)
    plain = not isinstance(f.dataType, (*C.NUMERIC_TYPES, T.BooleanType, *C.TIME_TYPES)) or isinstance(f.dataType, T.DecimalType)
    return _hashed(F.when(value == "", "\0").otherwise(value) if plain else value)


SAMPLE = 10_000


def _value_hash(f: T.StructField) -> F.Column:
    return F.xxhash64(typed_key(f))


def unique_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """Those of the columns (without nulls) in which no value repeats.

    A value that repeats within any ``SAMPLE`` rows settles most columns. The others are
    counted by 64-bit hashes of their values: no repeated hash, no repeated value. Only
    rows whose hash does repeat are compared by value.
    """
    fields = {f.name: f for f in df.schema.fields}
    left = list(cols)
    if left:
        some = df.select([C.col(c) for c in left]).limit(SAMPLE)
        row = some.agg(F.count(F.lit(1)).alias("n"), *[F.size(F.collect_set(_value_hash(fields[c]))).alias(_safe(i))
                                                      for i, c in enumerate(left)]).first()
        # equal hashes of two values are only taken for a repeat where the values are equal too
        again = [c for i, c in enumerate(left) if row[_safe(i)] < row["n"]]
        if again:
            row = some.agg(F.count(F.lit(1)).alias("n"), *[F.size(F.collect_set(typed_key(fields[c]))).alias(_safe(i))
                                                          for i, c in enumerate(again)]).first()
            left = [c for c in left if c not in {c for i, c in enumerate(again) if row[_safe(i)] < row["n"]}]
    if not left:
        return []
    items = F.array(*[F.struct(F.lit(i).alias("c"), _value_hash(fields[c]).alias("h")) for i, c in enumerate(left)])
    met = (df.select(F.explode(items).alias("p")).groupBy("p.c", "p.h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    twice = {r["c"] for r in met.select("c").distinct().collect()}
    out = []
    for i, c in enumerate(left):
        if i in twice:
            hashes = met.where(F.col("c") == i).select("h")
            rows = df.select(C.col(c).alias("v"), _value_hash(fields[c]).alias("h")).join(hashes, "h", "left_semi")
            if rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
                continue
        out.append(c)
    return out


def modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column (as text); tie → smallest value.

    ``min(struct(-n, value))`` is a streaming aggregate with a constant-size
    buffer, so no group of values is ever gathered in one place.
    """
    if not cols:
        return {}
    best = (value_counts_long(df, cols)
            .groupBy("column")
            .agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("value"))).alias("b"))
            .select("column", F.col("b.value").alias("value")))
    got = {r["column"]: r["value"] for r in best.collect()}
    return {c: got.get(c) for c in cols}


def quantiles(df: DataFrame, cols: list[str], probs: list[float], exact: bool = True) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles (pandas' default) for numeric columns, exact by
    ``exact_quantiles``; ``exact=False`` uses the ``percentile_approx`` sketch."""
    if not cols:
        return {}
    if exact:
        return exact_quantiles(df, cols, probs)
    arr = F.array(*[F.lit(float(p)) for p in probs])
    row = df.agg(*[F.percentile_approx(C.col(c).cast("double"), arr, C.APPROX_PERCENTILE_ACCURACY).alias(_safe(i))
                   for i, c in enumerate(cols)]).first()
    return {c: [None] * len(probs) if row[_safe(i)] is None else [float(x) for x in row[_safe(i)]] for i, c in enumerate(cols)}


def fences(q: dict[str, list[float | None]], skip_zero_iqr: bool) -> dict[str, tuple[float, float]]:
    """Tukey fences from (q1, q3) per column; columns without fences are left out."""
    out = {}
    for c, (q1, q3) in ((c, (v[0], v[-1])) for c, v in q.items()):
        if q1 is None or q3 is None:
            continue
        iqr = q3 - q1
        if skip_zero_iqr and iqr == 0:
            continue
        out[c] = (q1 - C.IQR_K * iqr, q3 + C.IQR_K * iqr)
    return out


def outlier_counts(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> dict[str, int]:
    """Values strictly outside the fences, per column, in one pass."""
    if not bounds:
        return {}
    cols = list(bounds)
    aggs = []
    for i, c in enumerate(cols):
        lo, hi = bounds[c]
        x = C.col(c).cast("double")
        aggs.append(F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias(_safe(i)))
    row = df.agg(*aggs).first()
    return {c: int(row[_safe(i)]) for i, c in enumerate(cols)}


# ── duplicate rows ──────────────────────────────────────────────────────────
FEW_PRINTS = 500_000  # repeated fingerprints that are broadcast; more go through a join


def fingerprint(df: DataFrame) -> F.Column:
    """128 bits of a row: null or not and the value of every column, twice."""
    values = [x for f in df.schema.fields for x in (C.col(f.name).isNull(), C.col(f.name) + F.lit(0.0)
              if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else C.col(f.name))]
    return F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit("again"), *values).alias("b"))


def repeated_prints(df: DataFrame) -> tuple[DataFrame, int, int]:
    """Fingerprints that more than one row has, how many there are, and the count of rows. Only
    fingerprints and counts are shuffled, whatever the width of the rows."""
    prints = df.select(fingerprint(df).alias("print")).groupBy("print").agg(F.count(F.lit(1)).alias("n"))
    kept = stage(prints.groupBy((F.col("n") > 1).alias("again"), F.when(F.col("n") > 1, F.col("print")).alias("print"))
                 .agg(F.sum("n").alias("n")), "row-prints")
    row = kept.agg(F.count("print").alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    return kept.where("again").select("print"), int(row["m"]), int(row["n"])


def _with_prints(df: DataFrame, again: DataFrame, m: int, how: str) -> DataFrame:
    marked = df.withColumn(_PRINT, fingerprint(df))
    side = again.withColumnRenamed("print", _PRINT)
    return marked.join(F.broadcast(side) if m <= FEW_PRINTS else side, _PRINT, how).drop(_PRINT)


_PRINT = "_row_print"


def _grouped_repeats(df: DataFrame) -> tuple[DataFrame | None, int]:
    """``groupBy(all columns)`` counts of the rows whose fingerprint repeats (None without any),
    and the count of all rows."""
    again, m, n = repeated_prints(df)
    if not m:
        return None, n
    met = _with_prints(df, again, m, "left_semi")
    return met.groupBy(*[C.col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n")), n


def duplicate_rows(df: DataFrame) -> tuple[int, int]:
    """(rows, rows that repeat an earlier row); nulls compare equal.

    Fingerprints first, verified after: rows whose 128-bit fingerprint is unique are never
    shuffled; those that share one are grouped by all of their columns, with partial
    aggregation: every group emits ``n - 1`` and the sum is taken.
    """
    if not df.columns:
        n = df.count()
        return n, max(n - 1, 0)
    g, n = _grouped_repeats(df)
    return n, int(g.agg(F.sum(F.col("_n") - 1)).first()[0] or 0) if g is not None else 0


def distinct_rows(df: DataFrame) -> DataFrame:
    """One of each group of equal rows; rows of a unique fingerprint are not shuffled."""
    again, m, _ = repeated_prints(df)
    if not m:
        return df
    return _with_prints(df, again, m, "left_anti").unionByName(_with_prints(df, again, m, "left_semi").dropDuplicates())


# ── exact quantiles for columns of any cardinality ──────────────────────────
SKETCH_K = 8192
SKETCH_ERROR = 0.003  # of a rank, several times what a sketch of that size makes
BINS = 1024
FETCH_LIMIT = 200_000


def _interpolate(a: float, b: float, position: float) -> float:
    """Between two neighbouring ranks, by the formula of Spark's ``percentile``."""
    low, high = math.floor(position), math.ceil(position)
    return a if low == high or a == b else (high - position) * a + (position - low) * b


def _brackets(df: DataFrame, x: dict, probs: list[float]) -> dict:
    """One scan: of every column the count of values and of infinite ones, the extremes, and by a
    KLL sketch an interval of values for every probability."""
    inf, largest = float("inf"), F.lit(sys.float_info.max)
    ranks = F.array(*[F.lit(min(1.0, max(0.0, p + e))) for p in probs for e in (-SKETCH_ERROR, SKETCH_ERROR)])
    aggs = []
    for i, v in enumerate(x.values()):
        finite = F.when(F.abs(v) < inf, v)
        # infinite values take part in the ranks as the largest finite ones
        sketch = F.kll_sketch_agg_double(F.when(~F.isnan(v), F.greatest(F.least(v, largest), -largest)), SKETCH_K)
        aggs += [F.count(v).alias(f"n{i}"), F.count_if(v == -inf).alias(f"low{i}"), F.count_if(v == inf).alias(f"high{i}"),
                 F.min(finite).alias(f"min{i}"), F.max(finite).alias(f"max{i}"),
                 F.when(F.count(finite) > 0, F.kll_sketch_get_quantile_double(sketch, ranks)).alias(f"q{i}")]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(x):
        out[c] = {k: row[f"{k}{i}"] for k in ("n", "low", "high", "min", "max")}
        spans: list[list[float]] = []
        q = row[f"q{i}"] or []
        if q and row[f"n{i}"] * SKETCH_ERROR < 1:
            q = [row[f"min{i}"], row[f"max{i}"]]  # few values: all are inside
        for lo, hi in sorted(zip(q[::2], q[1::2])):
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
        out[c]["spans"] = spans
    return out


def _narrow(rows: DataFrame, bands: list[dict], found: dict) -> list[dict]:
    """One pass over ``rows (c, v, n)``, values of column number c with their counts. A band of few
    rows is read by value, another by ``BINS`` bins; each rank is read off or goes on in its bin."""
    fetch = FETCH_LIMIT // len(bands)
    items = []
    for i, band in enumerate(bands):
        v, lo, hi = F.col("v"), band["lo"], band["hi"]
        half = 0.5 if math.isinf(hi - lo) else 1.0  # the width may be beyond the largest double
        place = (v * F.lit(half) - F.lit(lo * half)) / F.lit(hi * half - lo * half) * F.lit(float(BINS))
        key = v if band["rows"] <= fetch else F.least(F.floor(place), F.lit(BINS - 1)).cast("double")
        items.append(F.when((F.col("c") == band["c"]) & v.between(lo, hi),
                            F.struct(F.lit(i).alias("band"), key.alias("key"), v.alias("v"))))
    got = (rows.select("n", F.explode(F.array(*items)).alias("p")).where(F.col("p").isNotNull())
           .groupBy("p.band", "p.key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("p.v").alias("lo"),
                                           F.max("p.v").alias("hi")).collect())
    out, run = [], [band["below"] for band in bands]
    for r in sorted(got, key=lambda r: (r["band"], r["key"])):
        band, below = bands[r["band"]], run[r["band"]]
        run[r["band"]] = below + r["n"]
        ranks = [k for k in band["ranks"] if below <= k < below + r["n"]]
        if ranks and r["lo"] == r["hi"]:
            found.update({(band["c"], k): r["lo"] for k in ranks})
        elif ranks:
            out.append({"c": band["c"], "lo": r["lo"], "hi": r["hi"], "below": below, "rows": r["rows"], "ranks": ranks})
    return out


def _settle(rows: DataFrame, bands: list[dict], found: dict) -> None:
    """Read all ranks of the bands off ``rows (c, v, n)``; a bin never holds both ends of its band,
    so bands shrink."""
    while bands:
        bands = [b for b in bands if b["lo"] < b["hi"] or found.update({(b["c"], k): b["lo"] for k in b["ranks"]})]
        bands = _narrow(rows, bands, found) if bands else bands


def _between(batches, spans: list[np.ndarray], numbers: list[int]):
    """Rows ``(x)`` -> rows ``(c, slot, v, n)``: for every column the values inside its spans with
    their counts, a batch at a time, and how many lie between spans (v null) at the end. Span j
    is slot 2 j + 1, the gap before it 2 j."""
    edges = [np.stack([s[:, 0], np.nextafter(s[:, 1], np.inf)], axis=1).ravel() for s in spans]
    gaps = [np.zeros(len(e) + 1, np.int64) for e in edges]
    names = ["c", "slot", "v", "n"]
    for batch in batches:
        for at in range(0, batch.num_rows, 65_536):
            x = gram.matrix(batch.column(0).slice(at, 65_536))
            for k, no in enumerate(numbers):
                v = x[:, k][~np.isnan(x[:, k])] + 0.0  # -0.0 and 0.0 are one value
                slot = np.searchsorted(edges[k], v, side="right")
                gaps[k] += np.bincount(slot, minlength=len(gaps[k]))
                inside = slot % 2 == 1
                values, first, n = np.unique(v[inside], return_index=True, return_counts=True)
                if len(values):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(values), no, np.int32)), pa.array(slot[inside][first].astype(np.int32)), pa.array(values),
                         pa.array(n)], names=names)
    for k, no in enumerate(numbers):
        slots = np.flatnonzero((gaps[k] > 0) & (np.arange(len(gaps[k])) % 2 == 0)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), no, np.int32)), pa.array(slots),
                                          pa.array([None] * len(slots), pa.float64()), pa.array(gaps[k][slots])], names=names)


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    exprs: dict | None = None) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles of any number of columns in two scans.

    The first scan merges one KLL sketch a column, which brackets the value of every
    probability. The second counts the values between the brackets and, by value, those
    inside, combined before their shuffle, so a value that a third of the rows share is one
    row, and what is written is a small share of the distinct values.
    From there the ranks are read off; a bracket that still holds more than its share of
    ``FETCH_LIMIT`` rows is narrowed by histograms of these rows. Should a rank lie outside
    its bracket, the gap it lies in is narrowed on all rows. No task ever holds a column.
    Infinite values are ranks like any other; only a column without values gives None.

    ``exprs`` lets a caller ask for derived values, e.g. one ``when(group = g, x)`` per group.
    """
    if not cols:
        return {}
    x = {c: (exprs[c] if exprs and c in exprs else C.col(c)).cast("double") for c in cols}
    facts = _brackets(df, x, probs)
    found: dict[tuple, float] = {}
    wanted, edges = {}, {}
    for i, c in enumerate(cols):
        f = facts[c]
        last = f["n"] - 1
        ranks = sorted({r(last * p) for p in probs for r in (math.floor, math.ceil)}) if f["n"] else []
        found.update({(i, k): -float("inf") if k < f["low"] else float("inf") for k in ranks
                      if k < f["low"] or k >= f["n"] - f["high"]})
        found.update({(i, k): f["min"] for k in ranks if (i, k) not in found and f["min"] == f["max"]})
        wanted[i] = [k for k in ranks if (i, k) not in found]
        if wanted[i]:
            edges[i] = np.array(f["spans"])
    if edges:
        held = df.select(F.array(*[x[cols[i]] for i in edges]).alias("x"))
        rows = stage(held.mapInArrow(lambda it: _between(it, list(edges.values()), list(edges)), "c int, slot int, v double, n long")
                     .groupBy("c", "slot", "v").agg(F.sum("n").alias("n")), "quantile-brackets")
        slots = rows.groupBy("c", "slot").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("v").alias("lo"),
                                              F.max("v").alias("hi")).collect()
        bands, outside = [], []
        for i in wanted:
            below = 0
            for r in sorted((r for r in slots if r["c"] == i), key=lambda r: r["slot"]):
                ranks = [k for k in wanted[i] if below <= k < below + r["n"]]
                f = facts[cols[i]]
                if ranks and r["slot"] % 2:
                    bands.append({"c": i, "lo": r["lo"], "hi": r["hi"], "below": below, "rows": r["rows"], "ranks": ranks})
                elif ranks:  # the sketch was further off than it should be
                    j = r["slot"] // 2
                    lo = math.nextafter(f["spans"][j - 1][1], float("inf")) if j else f["min"]
                    hi = math.nextafter(f["spans"][j][0], -float("inf")) if j < len(f["spans"]) else f["max"]
                    outside.append({"c": i, "lo": lo, "hi": hi, "below": max(below, f["low"]) if not j else below, "rows": r["n"],
                                    "ranks": ranks})
                below += r["n"]
        _settle(rows.where("v is not null"), bands, found)
        if outside:
            whole = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), (x[c] + F.lit(0.0)).alias("v"))
                                                  for i, c in enumerate(cols)])).alias("p")).select("p.c", "p.v", F.lit(1).alias("n"))
            _settle(whole, outside, found)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        last = int(facts[c]["n"]) - 1
        out[c] = [None if last < 0 else _interpolate(found[i, math.floor(last * p)], found[i, math.ceil(last * p)], last * p)
                  for p in probs]
    return out
