"""TY1: classify columns into dates, numbers (booleans included), categories
and free text. Distinct values of the text columns are counted up to the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat as C
from . import stats

# fixed values: free text when distinct > min(FREE_TEXT_MAX, FREE_TEXT_SHARE · rows)
FREE_TEXT_MAX = 50
FREE_TEXT_SHARE = 0.5


def column_types(df: DataFrame, exact: bool = True) -> dict[str, list[str]]:
    out = {"numericas": [], "categoricas": [], "fechas": [], "texto_libre": []}
    txt = C.text_columns(df)
    n = df.count() if txt else 0
    # the threshold is FREE_TEXT_MAX at most, so counting may stop above it
    card = {} if not txt else stats.bounded_distinct(df, txt, FREE_TEXT_MAX) if exact else stats.distinct_counts(df, txt, False)
    for f in df.schema.fields:
        if C.is_time(f.dataType):
            out["fechas"].append(f.name)
        elif C.is_numeric(f.dataType, include_bool=True):
            out["numericas"].append(f.name)
        elif C.is_text(f.dataType):
            key = "texto_libre" if card[f.name] > min(FREE_TEXT_MAX, n * FREE_TEXT_SHARE) else "categoricas"
            out[key].append(f.name)
    return out


def column_types_df(df: DataFrame) -> DataFrame:
    t = column_types(df)
    order = {c: i for i, c in enumerate(df.columns)}
    rows = sorted(((order[c], c, k) for k, cs in t.items() for c in cs))
    return df.sparkSession.createDataFrame(rows, "position int, column string, kind string")
