"""Small helpers that write the DuckDB oracle statements for column-wise checks.

The oracle is plain SQL over the registered views; these helpers only repeat
one SELECT per column so the statements stay readable at the call site.
"""

from __future__ import annotations

# Static schemas of the driver tables (column, Spark simple type).
LINEITEM = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
            ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
            ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
            ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]
DIRTY = [("event_id", "bigint"), ("user_id", "bigint"), ("ts", "timestamp_ntz"), ("value", "double"),
         ("event_type", "string"), ("raw_type", "string"), ("user_txt", "string"),
         ("day_txt", "string"), ("mostly_null", "double"), ("const_col", "string"),
         ("success", "boolean")]
NUMERIC = {"bigint", "int", "double", "float", "smallint", "tinyint"}


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def numeric(cols) -> list[str]:
    return [c for c, t in cols if t in NUMERIC]


def text(cols) -> list[str]:
    return [c for c, t in cols if t == "string"]


def long_values(table: str, cols: list[str]) -> str:
    """(column, value-as-text) rows, nulls dropped."""
    return union([f"SELECT '{c}' AS \"column\", CAST({q(c)} AS VARCHAR) AS value FROM {table} "
                  f"WHERE {q(c)} IS NOT NULL" for c in cols])


def profile(table: str, cols) -> str:
    parts = []
    for i, (c, t) in enumerate(cols):
        x = q(c)
        if t in NUMERIC:
            fence = (f"(SELECT count(*) FROM {table}, (SELECT quantile_cont({x}, 0.25) AS a, "
                     f"quantile_cont({x}, 0.75) AS b FROM {table}) f "
                     f"WHERE {x} < a - 1.5 * (b - a) OR {x} > b + 1.5 * (b - a))")
            stats = (f"round(round(avg({x}), 12), 6), round(stddev_samp({x}), 6), round(min({x})::DOUBLE, 6), "
                     f"round(quantile_cont({x}, 0.25), 6), round(quantile_cont({x}, 0.5), 6), "
                     f"round(quantile_cont({x}, 0.75), 6), round(max({x})::DOUBLE, 6), "
                     f"CAST({fence} AS BIGINT)")
        else:
            stats = ", ".join(["NULL::DOUBLE"] * 7) + ", NULL::BIGINT"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS data_type, count(*)::BIGINT, "
            f"count({x})::BIGINT, (count(*) - count({x}))::BIGINT, count(DISTINCT {x})::BIGINT, {stats} "
            f"FROM {table}")
    names = ("position, \"column\", data_type, \"rows\", non_null, nulls, \"distinct\", mean, std, "
             "\"min\", q1, median, q3, \"max\", outliers")
    return f"SELECT * FROM (\n{union(parts)}\n) AS t({names})"
