"""EDA bundle (RP1) and one-click report (RP2) as long (section, item, value) rows.

Each section is computed by its own distributed operator; only the small
results are combined here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat as C
from ..functions.spread import shared

from ..operators import clean as CL
from ..operators import eda, models, quality
from ..operators.typing import column_types

SCHEMA = "section string, item string, value string"


def _rows(spark, rows) -> DataFrame:
    return spark.createDataFrame([(s, i, None if v is None else str(v)) for s, i, v in rows], SCHEMA)


def _long(df: DataFrame, section: str, key: str) -> DataFrame:
    """Any small result frame → (section, '<key>.<column>', value) rows."""
    cols = [c for c in df.columns if c != key]
    if not cols:
        return df.sparkSession.createDataFrame([], SCHEMA)
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in cols])
    return df.select(F.col(key).cast("string").alias("_id"), F.explode(pairs).alias("p")).select(
        F.lit(section).alias("section"), F.concat_ws(".", "_id", "p.k").alias("item"), F.col("p.v").alias("value"))


def eda_bundle(df: DataFrame) -> DataFrame:
    """The EDA tab: every section reads the same input, so it is persisted
    once (MEMORY_AND_DISK) and released after the small results are taken."""
    spark = df.sparkSession
    with shared(C.nan_to_null(df), always=True) as src:
        ov = eda.overview(src).first()
        types = column_types(src)
        rows = ([("overview", k, ov[k]) for k in ("rows", "columns", "null_cells")]
                + [("types", c, k) for k, cs in types.items() for c in cs])
        dup = eda.duplicate_rows(src).first()
        rows += [("duplicates", "n", dup["duplicates"]), ("duplicates", "pct", dup["pct"])]
        parts = [_long(eda.describe_numeric(src), "describe", "column"),
                 _long(eda.describe_text(src), "describe", "column"),
                 _long(eda.describe_time(src), "describe", "column"),
                 _long(eda.null_profile(src), "nulls", "column"),
                 _long(eda.outlier_counts(src), "outliers", "column"),
                 _long(eda.correlation(src).select(F.concat_ws("|", "col_a", "col_b").alias("pair"), "r"),
                       "correlation", "pair"),
                 _long(eda.category_distributions(src, types["categoricas"])
                       .select(F.concat_ws("=", "column", "value").alias("cv"), "n"), "distribution", "cv"),
                 _long(quality.findings(src), "findings", "position")]
        for p in parts:
            rows += [tuple(r) for r in p.collect()]
        return _rows(spark, rows)


def report(df: DataFrame) -> DataFrame:
    """One-click report. The input is persisted once (MEMORY_AND_DISK, so a
    lost executor recomputes its blocks from lineage) because every section
    reads it; each section's small result is collected, then the input is
    released and the rows are returned as a new frame."""
    spark = df.sparkSession
    with shared(C.nan_to_null(df), always=True) as src:
        cl = CL.clean(src)
        # step 3 of the default cleaning tests exactly what "mistyped" tests
        facts = quality._facts(src, [c for c in C.text_columns(src) if c in (cl.kinds or {})])
        q = quality.quality(src, facts)
        rows = [("dims", "rows", facts["rows"]), ("dims", "columns", len(src.columns)),
                ("quality", "score", q["score"]), ("quality", "grade", q["grade"]),
                ("quality", "summary", q["summary"])]
        rows += [("quality_factor", n, f"{p}: {d}") for n, p, d in q["factors"]]
        types = column_types(src)
        rows += [("types", c, k) for k, cs in types.items() for c in cs]
        corr = sorted(eda.correlation(src).collect(), key=lambda r: (r["i"], r["j"]))
        fnd = quality.findings(src, facts, corr).collect()
        rows += [("findings", f"{r['position']}.{r['level']}", r["text"]) for r in fnd]
        top = sorted(corr, key=lambda r: (-abs(r["r"]), r["i"], r["j"]))[:5]
        rows += [("top_correlations", f"{k + 1}.{r['col_a']}|{r['col_b']}", r["r"]) for k, r in enumerate(top)]
        # "before" equals the quality facts already taken; only "after" is computed
        before = {"rows": facts["rows"], "columns": len(src.columns), "nulls": sum(facts["nulls"].values()),
                  "duplicates": facts["dup"]}
        rows += [("cleaning_stats", f"antes.{k}", v) for k, v in before.items()]
        r = cl.after.first()
        rows += [("cleaning_stats", f"despues.{k}", r[k]) for k in ("rows", "columns", "nulls", "duplicates")]
        rows += [("cleaning_log", f"{r['step_no']}.{r['step']}", f"{r['affected']}: {r['detail']}")
                 for r in cl.log.collect()]
        for res in models.auto_model(src):
            rows += [("model", f"{res.model}.{m}", v) for m, v in res.metrics]
        return _rows(spark, rows)
