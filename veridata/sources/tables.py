"""Table utilities and the SQL box (SC9–SC22, 2.13)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compat as C
from ..operators import stats

# fixed values
SQL_ROW_CAP = 500
PREVIEW_ROWS = 10
MAX_ROWS = 100_000
MAX_COLS = 1_000


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Scan a registered table/view by name; unknown names are refused."""
    names = sorted(t.name for t in spark.catalog.listTables())
    if name not in names:
        raise ValueError(f"Tabla '{name}' no encontrada. Disponibles: {', '.join(names)}")
    return spark.table(name)


def describe_table(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = set(keys or [])
    rows = [(i + 1, f.name, f.dataType.simpleString(), f.nullable, None, f.name in keys)
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, column string, data_type string, nullable boolean, default string, is_pk boolean")


def candidate_keys(df: DataFrame) -> DataFrame:
    """Columns with no nulls and all values distinct (files declare no keys), see
    ``stats.unique_columns``."""
    n, nn = stats.non_null_counts(df)
    keys = set(stats.unique_columns(df, [c for c in df.columns if nn[c] == n and n > 0]))
    return df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(df.columns) if c in keys], "position int, column string")


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def preview(df: DataFrame, n: int = PREVIEW_ROWS, order_by: list[str] | None = None) -> DataFrame:
    """First n rows in a deterministic order; dates as text; NaN/±inf → null.

    ``orderBy(...).limit(n)`` is planned as TakeOrderedAndProject: each task
    keeps its own top n, so nothing but n rows per task moves.
    """
    order = order_by or df.columns
    out = []
    for f in df.schema.fields:
        x = C.col(f.name)
        if C.is_time(f.dataType):
            x = F.date_format(x, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x = F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)
        out.append(x.alias(f.name))
    return df.orderBy(*[C.col(c) for c in order]).limit(n).select(out)


def guard(df: DataFrame, max_rows: int | None = None, max_cols: int | None = None) -> tuple[DataFrame, bool]:
    """Intake checks: refuse empty input and too many columns, and say whether
    there are more than max_rows rows. No row is cut."""
    if not df.columns:
        raise ValueError("El archivo no tiene columnas.")
    if max_cols is not None and len(df.columns) > max_cols:
        raise ValueError(f"Demasiadas columnas ({len(df.columns)}); máximo {max_cols}.")
    n = df.limit(1).count() if max_rows is None else df.count()
    if n == 0:
        raise ValueError("El archivo está vacío.")
    return df, max_rows is not None and n > max_rows


# fixed values: kinds of sources by the end, then by the beginning of their names
SOURCE_ENDS = [(".tsv", "TSV"), (".json", "JSON")]
SOURCE_STARTS = [("PG:", "SQL"), ("Query:", "SQL"), ("NoSQL:", "NoSQL"), ("Mongo:", "NoSQL"), ("Web:", "Web"),
                 ("Limpio:", "ETL")]
SOURCE_DEFAULT, SOURCE_STATUS = "CSV", "Ready"


def size_text(nbytes: F.Column) -> F.Column:
    """Bytes as text: megabytes above one of them, else kilobytes."""
    mb = F.lit(1024.0 * 1024.0)
    return F.when(nbytes > mb, F.format_string("%.1f MB", nbytes / mb)).otherwise(
        F.format_string("%.1f KB", nbytes / F.lit(1024.0)))


def source_type(name: str) -> str:
    kinds = [k for end, k in SOURCE_ENDS if name.endswith(end)] + [k for start, k in SOURCE_STARTS if name.startswith(start)]
    return (kinds + [SOURCE_DEFAULT])[0]


OTHER_NODES = r"\b(Filter|Join|Aggregate|Limit|Generate|Union|Sample|Window|Distinct|LocalRelation|Range|LogicalRDD)\b"


def _cell_bytes(field: T.StructField) -> Column:
    """About what a cell takes: the bytes of a text, eight for each item of an array, eight for the rest."""
    x = C.col(field.name)
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(x), F.lit(0)).cast("long")
    if isinstance(field.dataType, T.ArrayType):
        return 8 * F.coalesce(F.greatest(F.size(x), F.lit(0)), F.lit(0)).cast("long")
    return F.lit(8).cast("long")


def _file_facts(d: DataFrame) -> DataFrame | None:
    """``(rows, bytes)`` of a view that reads files and nothing else: a count, for which no column
    is read, and the lengths of the files. None where rows are filtered, joined or made."""
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    files = [] if re.search(OTHER_NODES, plan) else d.inputFiles()
    if not files:
        return None
    sizes = d.sparkSession.read.format("binaryFile").load(files).agg(F.sum("length").alias("bytes"))
    return d.agg(F.count(F.lit(1)).alias("rows")).join(sizes)  # one row each


def table_inventory(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """(name, type, rows, cols, size, status) for registered views, ordered by name.

    Views over files are read off their metadata; the cells of others are measured. One
    aggregate per view, unioned into one lazy plan (O(views) tiny rows).
    """
    names = sorted(names if names is not None else [t.name for t in spark.catalog.listTables()])
    parts = []
    for nm in names:
        d = spark.table(f"`{nm}`")
        facts = _file_facts(d)
        if facts is None:
            width = sum((_cell_bytes(f) for f in d.schema.fields), F.lit(0).cast("long"))
            facts = d.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes"))
        parts.append(facts.select(
            F.lit(nm).alias("name"), F.lit(source_type(nm)).alias("type"), "rows",
            F.lit(len(d.columns)).cast("long").alias("cols"), size_text(F.col("bytes")).alias("size"),
            F.lit(SOURCE_STATUS).alias("status")))
    if not parts:
        return spark.createDataFrame([], "name string, type string, rows long, cols long, size string, status string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def save_view(df: DataFrame, name: str) -> str:
    """Register ``df`` as a view under ``name``, with ``_2``, ``_3`` ... behind it if that is taken."""
    spark = df.sparkSession
    taken, free, i = {t.name.lower() for t in spark.catalog.listTables()}, name, 1
    while free.lower() in taken:
        i += 1
        free = f"{name}_{i}"
    df.createOrReplaceTempView(f"`{free}`")
    return free


def save_clean(df: DataFrame, base: str, options: dict | None = None):
    """Clean ``df`` and keep the result as the view ``Limpio:<base>``: (view name, result)."""
    from ..operators.clean import clean
    result = clean(df, options)
    return save_view(result.data, f"Limpio:{base}"), result


def _cells_to_text(df: DataFrame) -> DataFrame:
    """Non-scalar cells (struct/array/map) become JSON text, as a UI would show."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            out.append(F.to_json(C.col(f.name)).alias(f.name))
        else:
            out.append(C.col(f.name))
    return df.select(out)


def run_sql(spark: SparkSession, sql: str, limit: int | None = None) -> DataFrame:
    """Ad-hoc SQL over registered views; a limit, if asked for, is part of the plan."""
    if not sql or not sql.strip():
        raise ValueError("La consulta está vacía.")
    df = spark.sql(sql)
    if limit is not None:
        df = df.limit(limit)
    return _cells_to_text(df)


def save_sql(spark: SparkSession, sql: str, name: str | None = None) -> tuple[str, DataFrame]:
    """Run SQL uncapped and register the result as view ``query_<name>``."""
    if not sql or not sql.strip():
        raise ValueError("La consulta está vacía.")
    df = spark.sql(sql)
    if not df.columns:
        raise ValueError("La consulta no devolvió columnas.")
    if not name:
        n = sum(1 for t in spark.catalog.listTables() if t.name.startswith("query_resultado_"))
        name = f"resultado_{n + 1}"
    view = "query_" + re.sub(r"\W+", "_", name)
    df.createOrReplaceTempView(view)
    return view, df


def to_records(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*[C.col(c) for c in df.columns])).alias("record"))


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("overwrite").format(fmt).save(path)
