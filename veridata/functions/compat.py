"""Column classification and the parity rules shared by every operator.

Everything here builds Spark ``Column`` expressions; nothing touches data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ── fixed values (must equal the reference's behaviour) ─────────────────────
# Spellings that pandas' CSV reader turns into a missing value.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
               "n/a", "nan", "null"]
# Share of non-null text cells that must parse before a column is retyped.
COERCE_RATIO = 0.9
# Tukey fence multiplier.
IQR_K = 1.5
APPROX_PERCENTILE_ACCURACY = 100_000

# Plain decimal / scientific numbers, optionally signed and padded; plus
# inf / infinity / nan as pandas' ``to_numeric`` accepts them.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
SPECIAL_NUMBER_PATTERN = r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
# Closed, ordered list of accepted date/time shapes (month-first for slashes).
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "MM/dd/yyyy HH:mm:ss",
    "yyyyMMdd",
    "MMM d yyyy",
    "d MMM yyyy",
]
DATE_HINT_PATTERN = r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{8}$|[A-Za-z]{3} \d|\d{1,2} [A-Za-z]{3})"
# Python's str.strip() whitespace, as a regex (SQL trim keeps tabs).
STRIP_PATTERN = r"^\s+|\s+$"
STRIP_CHARACTERS = " \t\n\x0b\f\r"
LATE_ENDS = ("\u0085", "\u2028", "\u2029")


# ── type classes ────────────────────────────────────────────────────────────
NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_numeric(dt: T.DataType, include_bool: bool = False) -> bool:
    return isinstance(dt, NUMERIC_TYPES) or (include_bool and isinstance(dt, T.BooleanType))


def is_time(dt: T.DataType) -> bool:
    return isinstance(dt, TIME_TYPES)


def is_text(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def is_bool(dt: T.DataType) -> bool:
    return isinstance(dt, T.BooleanType)


def numeric_columns(df: DataFrame, include_bool: bool = False) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType, include_bool)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_time(f.dataType)]


def bool_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_bool(f.dataType)]


def col(name: str) -> Column:
    """Column reference that survives dots and spaces in names."""
    return F.col("`" + name.replace("`", "``") + "`")


# ── value normalisation ─────────────────────────────────────────────────────
def nan_to_null(df: DataFrame) -> DataFrame:
    """pandas has one missing value: turn NaN in float columns into null."""
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not fl:
        return df
    return df.select([
        (F.when(F.isnan(col(c)), F.lit(None)).otherwise(col(c)).alias(c) if c in fl else col(c))
        for c in df.columns])


def py_strip(c: Column) -> Column:
    """Strip all leading/trailing whitespace like Python's ``str.strip``.

    Trims by characters; only before a closing line separator beyond these, where ``$``
    matches too, is the pattern itself needed.
    """
    ends = reduce(Column.__or__, [c.endswith(x) for x in LATE_ENDS])
    return F.when(ends, F.regexp_replace(c, STRIP_PATTERN, "")).otherwise(F.btrim(c, F.lit(STRIP_CHARACTERS)))


def parse_number(c: Column) -> Column:
    """Text → double the way ``pd.to_numeric(errors='coerce')`` reads it.

    Spark alone would also accept '1d' or '1.0f'; the pattern guard refuses
    those. 'nan' parses to a missing value.
    """
    txt = c.cast("string")
    return (F.when(txt.rlike(NUMBER_PATTERN), F.trim(txt).try_cast("double"))
             .when(txt.rlike(SPECIAL_NUMBER_PATTERN) & ~F.lower(txt).contains("nan"),
                   F.trim(txt).try_cast("double")))


# Shape → candidate formats. Each value is tested against cheap shape
# patterns and only tries the formats of its shape.
DATE_SHAPES = [
    (r"^\d{4}-\d{2}-\d{2}$", ["yyyy-MM-dd"]),
    (r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?$",
     ["yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
      "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm"]),
    (r"^\d{4}/\d{2}/\d{2}$", ["yyyy/MM/dd"]),
    (r"^\d{2}/\d{2}/\d{4}( \d{2}:\d{2}:\d{2})?$", ["MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss"]),
    (r"^\d{8}$", ["yyyyMMdd"]),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", ["MMM d yyyy"]),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", ["d MMM yyyy"]),
]


def parse_timestamp(c: Column) -> Column:
    """Text → timestamp through the closed list of formats; unparsed → null."""
    return parse_stripped_timestamp(py_strip(c.cast("string")))


def parse_stripped_timestamp(txt: Column) -> Column:
    """``parse_timestamp`` of text without blanks around."""
    out = None
    for shape, fmts in DATE_SHAPES:
        val = F.coalesce(*[F.try_to_timestamp(txt, F.lit(f)) for f in fmts]) if len(fmts) > 1 \
            else F.try_to_timestamp(txt, F.lit(fmts[0]))
        out = F.when(txt.rlike(shape), val) if out is None else out.when(txt.rlike(shape), val)
    # one cheap hint first: ordinary text never reaches the shape patterns
    return F.when(txt.rlike(DATE_HINT_PATTERN), out)


def rnd(c: Column | str, digits: int) -> Column:
    """Round half away from zero on the binary value: ``round(x·10^d) / 10^d``.

    Rounding the scaled double (instead of its decimal text) gives the same
    result as other engines' ``round``, so ties caused by data with few
    decimals do not depend on the engine. ``+ 0.0`` folds -0.0 into 0.0.
    """
    c = F.col(c) if isinstance(c, str) else c
    m = float(10 ** digits)
    return F.round(c.cast("double") * m) / m + F.lit(0.0)


def rnd_mean(c: Column | str, digits: int) -> Column:
    """``rnd`` for a mean of doubles: twelve digits first, so that a tie is not decided
    by the order in which the rows were summed."""
    return rnd(rnd(c, 12), digits)


def rnd_even(c: Column | str, digits: int) -> Column:
    """Half-to-even variant of :func:`rnd` (Python's ``round``)."""
    c = F.col(c) if isinstance(c, str) else c
    m = float(10 ** digits)
    return F.bround(c.cast("double") * m) / m + F.lit(0.0)


def as_double(name: str, dt: T.DataType) -> Column:
    """Numeric view of a column for statistics (booleans as 0/1)."""
    c = col(name)
    if is_bool(dt):
        return c.cast("int").cast("double")
    return c.cast("double")
