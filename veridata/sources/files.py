"""File scans (SC1–SC8): CSV/TSV with pandas-like typing, JSON documents,
extension dispatch, flattening of nested documents.

Typing is decided by one aggregation over the text columns after the scan,
then applied by a single ``select``: the scan stays split across tasks.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compat as C

# fixed values: spellings pandas reads as booleans
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]


def null_tokens_to_null(df: DataFrame) -> DataFrame:
    return df.select([F.when(C.col(c).isin(C.NULL_TOKENS), F.lit(None)).otherwise(C.col(c)).alias(c)
                      for c in df.columns])


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns → long / double / boolean when every non-null value fits.

    As pandas: integers with gaps become double; booleans with gaps stay
    text; dates are not guessed here (the cleaning step does that).
    """
    cols = C.text_columns(df)
    if not cols:
        return df
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        x = C.col(c)
        aggs += [F.count(x).alias(f"nn{i}"), F.count_if(x.rlike(C.INTEGER_PATTERN) & F.trim(x).try_cast("long").isNotNull()).alias(f"i{i}"),
                 F.count(C.parse_number(x)).alias(f"f{i}"),
                 F.count_if(x.isin(TRUE_TOKENS + FALSE_TOKENS)).alias(f"b{i}"),
                 F.count_if(F.lower(x).rlike(C.SPECIAL_NUMBER_PATTERN)).alias(f"s{i}")]
    r = df.agg(*aggs).first()
    n = int(r["_n"])
    kinds = {}
    for i, c in enumerate(cols):
        nn = int(r[f"nn{i}"])
        if nn == 0:
            kinds[c] = "double"  # pandas reads an all-empty column as float NaN
        elif int(r[f"i{i}"]) == nn:
            kinds[c] = "long" if nn == n else "double"
        elif int(r[f"f{i}"]) + int(r[f"s{i}"]) == nn:
            kinds[c] = "double"
        elif int(r[f"b{i}"]) == nn and nn == n:
            kinds[c] = "boolean"
    out = []
    for c in df.columns:
        k = kinds.get(c)
        x = C.col(c)
        if k == "long":
            x = F.trim(x).try_cast("long")
        elif k == "double":
            x = C.parse_number(x)
        elif k == "boolean":
            x = x.isin(TRUE_TOKENS)
        out.append(x.alias(c))
    return df.select(out)


def breaks_in_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a line holds an odd number of quotes: then a value goes on in the next line."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return spark.read.text(path).where(quotes % 2 == 1).limit(1).count() > 0


def read_csv(spark: SparkSession, path: str, sep: str = ",", multi_line: bool | None = None) -> DataFrame:
    """``multi_line`` reads line breaks inside quotes; each file is then one task, since a file
    cannot be split where a quote may be open. By default it is used where the files need it
    (see ``breaks_in_quotes``), so no row breaks silently."""
    if multi_line is None:
        multi_line = breaks_in_quotes(spark, path)
    raw = (spark.read.option("header", True).option("sep", sep).option("inferSchema", False)
           .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
           .option("mode", "PERMISSIVE").csv(path))
    return infer_types(null_tokens_to_null(raw))


def read_tsv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    return read_csv(spark, path, "\t", multi_line)


def _key_order(spark: SparkSession, path: str, key: str | None = None) -> list[str]:
    """Keys of the JSON objects of all files, or of the first object of their list ``key``, in
    document order (Spark sorts them): those of the first file, then new ones of the next."""
    txt = spark.read.option("wholetext", True).text(path)
    value = F.col("value") if key is None else F.get_json_object("value", f"$['{key}'][0]")
    keys = txt.select(F.col("_metadata.file_path").alias("f"), F.posexplode(F.json_object_keys(value)).alias("i", "k"))
    first = keys.groupBy("k").agg(F.min(F.struct("f", "i")).alias("at")).orderBy("at").collect()
    return [r["k"] for r in first]


def read_json(spark: SparkSession, path: str, find_list: bool = True) -> DataFrame:
    """JSON documents, one a file → rows. Keys are those of all files.

    Root list: one row per element. Root object: with ``find_list``, the
    first key (document order) holding a non-empty list of objects is
    exploded into rows; otherwise the object is one row. A scalar root is
    an error, and so is a folder that mixes files of both shapes.
    """
    txt = spark.read.option("wholetext", True).text(path)
    kinds = {r["c"] for r in txt.select(F.substring(F.ltrim(F.col("value")), 1, 1).alias("c")).distinct().collect()}
    if not kinds or not kinds <= {"[", "{"}:
        raise ValueError("El JSON debe ser una lista de objetos o un objeto.")
    if len(kinds) > 1:
        raise ValueError("a folder must hold either root lists or root objects, not both")
    first = kinds.pop()
    df = spark.read.option("multiLine", True).option("primitivesAsString", False).json(path)
    if first == "[":
        return df
    keys = _key_order(spark, path)
    if find_list:
        for k in keys:
            f = df.schema[k] if k in df.columns else None
            if f is not None and isinstance(f.dataType, T.ArrayType) and \
                    isinstance(f.dataType.elementType, T.StructType):
                inner = df.select(F.explode(C.col(k)).alias("_r")).select("_r.*")
                if inner.limit(1).count():
                    order = _key_order(spark, path, k)
                    return inner.select([C.col(c) for c in order if c in inner.columns] +
                                        [C.col(c) for c in inner.columns if c not in order])
    return df.select([C.col(c) for c in keys if c in df.columns])


def read_any(spark: SparkSession, path: str) -> DataFrame:
    ext = os.path.splitext(path)[1].lower()
    if ext == ".csv":
        return read_csv(spark, path)
    if ext == ".tsv":
        return read_tsv(spark, path)
    if ext == ".json":
        return read_json(spark, path)
    if ext == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"Formato no soportado: {ext or path}")


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs → one column per leaf with dotted names; arrays untouched."""
    cols = []

    def walk(prefix: list[str], dt: T.DataType):
        if isinstance(dt, T.StructType) and dt.fields:
            for f in dt.fields:
                walk(prefix + [f.name], f.dataType)
        else:
            ref = F.col(".".join("`" + p.replace("`", "``") + "`" for p in prefix))
            cols.append(ref.alias(sep.join(prefix)))
    for f in df.schema.fields:
        walk([f.name], f.dataType)
    return df.select(cols)


def read_documents(df: DataFrame) -> DataFrame:
    """Document collection → flat table; ``_id`` becomes text."""
    if "_id" in df.columns:
        df = df.withColumn("_id", F.col("_id").cast("string"))
    return flatten(df)


def collection_summary(collections: dict[str, DataFrame]) -> DataFrame:
    """(collection, documents, fields) — one count per collection, unioned lazily."""
    spark = next(iter(collections.values())).sparkSession
    parts = [d.agg(F.count(F.lit(1)).alias("documents"))
             .select(F.lit(name).alias("collection"), "documents",
                     F.lit(", ".join(d.columns)).alias("fields"))
             for name, d in collections.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if parts else spark.createDataFrame([], "collection string, documents long, fields string")
