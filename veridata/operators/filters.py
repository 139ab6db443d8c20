"""Row filters and projections (FI1–FI10). All are single narrow
transformations: Catalyst pushes the comparisons into the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compat as C


def filter_in(df: DataFrame, c: str, values: list) -> DataFrame:
    """Keep rows whose value is in the list; empty list keeps all; None matches nulls."""
    if not values:
        return df
    vals = [v for v in values if v is not None]
    cond = C.col(c).isin(vals) if vals else F.lit(False)
    if len(vals) != len(values):
        cond = cond | C.col(c).isNull()
    return df.where(cond)


def filter_range(df: DataFrame, c: str, lo: float, hi: float) -> DataFrame:
    """Inclusive numeric range; nulls dropped."""
    return df.where(C.col(c).between(lo, hi))


def _first(df: DataFrame, pred) -> str | None:
    return next((f.name for f in df.schema.fields if pred(f.dataType)), None)


def filter_year(df: DataFrame, year: int, c: str | None = None) -> DataFrame:
    """Rows of one year; column defaults to the first date column, none → all rows."""
    c = c or _first(df, C.is_time)
    if c is None:
        return df
    # A range on the raw column (not year(col)) lets the scan prune row groups.
    lo = F.make_timestamp_ntz(F.lit(year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    hi = F.make_timestamp_ntz(F.lit(year + 1), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    x = C.col(c).cast("timestamp_ntz")
    return df.where((x >= lo) & (x < hi))


def filter_success(df: DataFrame, flag: bool, c: str | None = None) -> DataFrame:
    """Rows whose boolean equals flag; column defaults to the first boolean."""
    c = c or _first(df, C.is_bool)
    if c is None:
        return df
    return df.where(C.col(c) == F.lit(bool(flag)))


def drop_null_rows(df: DataFrame) -> DataFrame:
    return C.nan_to_null(df).na.drop("any")


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    return C.nan_to_null(df.select([C.col(c) for c in cols])).na.drop("any")


def drop_columns(df: DataFrame, cols: list[str], snake: bool = False) -> DataFrame:
    if snake:
        from .clean import snake_name
        cols = [snake_name(c) for c in cols]
    present = [c for c in cols if c in df.columns]
    return df.drop(*present) if present else df


# ── FI10: public URL predicate ──────────────────────────────────────────────
def _octets(host: Column):
    parts = F.split(host, r"\.")
    return [parts.getItem(i).try_cast("int") for i in range(4)]


def is_public_url(url: Column) -> Column:
    """http/https with a host that is not local, private, link-local,
    reserved, multicast or unspecified. Literal hosts only (no DNS)."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    is_ipv4 = host.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    a, b, c, d = _octets(host)
    valid_v4 = is_ipv4 & a.between(0, 255) & b.between(0, 255) & c.between(0, 255) & d.between(0, 255)
    private_v4 = (
        (a == 0) | (a == 10) | (a == 127)
        | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 0) & (c == 0)) | ((a == 192) & (b == 0) & (c == 2))
        | ((a == 192) & (b == 168)) | ((a == 198) & b.between(18, 19))
        | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
        | (a >= 224))
    is_v6 = host.startswith("[")
    v6 = F.regexp_replace(host, r"[\[\]]", "")
    private_v6 = (v6.isin("::", "::1") | v6.rlike(r"^(fc|fd|fe8|fe9|fea|feb|ff)")
                  | v6.startswith("::ffff:"))
    local_name = host.isin("localhost") | host.endswith(".localhost")
    ok = (scheme.isin("http", "https") & (host != "")
          & ~local_name
          & F.when(is_ipv4, valid_v4 & ~private_v4).when(is_v6, ~private_v6).otherwise(F.lit(True)))
    return F.coalesce(ok, F.lit(False))


def filter_public_urls(df: DataFrame, c: str) -> DataFrame:
    return df.where(is_public_url(C.col(c)))
