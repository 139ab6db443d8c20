"""Data quality score, factors, mistyped columns and written findings (QU1–QU4).

All inputs come from one profile: a null/constancy pass, the duplicate
count, the text parse-ratio pass, correlations and outlier counts. The
texts are built on the driver from those few numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat as C
from . import eda, stats

# fixed values: fact, name, cap, weight and text of each penalty; grade bands; texts
PENALTIES = [
    ("nulls", "Valores faltantes", 35.0, 1.5, "{n} celdas nulas ({pct:.1f}% del total)."),
    ("dup", "Filas duplicadas", 20.0, 1.0, "{n} filas repetidas ({pct:.1f}%)."),
    ("const", "Columnas constantes", 18.0, 6.0, "{n} columna(s) con un solo valor: {names}."),
    ("mistyped", "Tipos mal detectados", 15.0, 5.0, "{n} columna(s) de texto que son número/fecha: {names}."),
]
GRADES = [(90, "A", "Datos en excelente estado, listos para analizar."),
          (75, "B", "Buena calidad; unos retoques menores lo dejarían perfecto."),
          (60, "C", "Calidad aceptable; conviene limpiar antes de modelar."),
          (40, "D", "Calidad baja; la limpieza es muy recomendable."),
          (0, "F", "Datos muy sucios; límpialos antes de usarlos.")]
NO_ISSUES = "Sin problemas de calidad detectados."
EMPTY = "El dataset está vacío."
STRONG_R = 0.7
FINDINGS = {
    "empty": ("warning", "El dataset no tiene filas."),
    "dup": ("warning", "Hay {n} filas duplicadas ({pct}%). Considera eliminarlas."),
    "nulls": ("warning", "«{name}» es la columna con más valores faltantes ({pct}%). "
                         "{n} columna(s) tienen nulos en total."),
    "complete": ("success", "No hay valores faltantes: el dataset está completo."),
    "const": ("info", "Columna(s) con un solo valor (sin información útil): {names}."),
    "id": ("info", "«{name}» parece un identificador único (un valor distinto por fila)."),
    "corr": ("info", "Correlación {sign} fuerte ({r:+.2f}) entre «{a}» y «{b}»."),
    "outliers": ("info", "«{name}» tiene {n} valores atípicos ({pct}%) según el método IQR."),
}


def mistyped_columns(df: DataFrame) -> list[str]:
    """Text columns where ≥ 90 % of non-null values read as numbers or dates."""
    txt = C.text_columns(df)
    if not txt:
        return []
    aggs = []
    # every text is stripped once, in a projection of its own below the tests that read it
    pairs = df.select(*[x for i, c in enumerate(txt) for x in (C.col(c).alias(f"raw{i}"), C.py_strip(C.col(c)).alias(f"bare{i}"))])
    for i in range(len(txt)):
        x = F.col(f"raw{i}")
        aggs += [F.count(x).alias(f"nn{i}"), F.count(C.parse_number(x)).alias(f"num{i}"),
                 F.count(C.parse_stripped_timestamp(F.col(f"bare{i}"))).alias(f"ts{i}")]
    r = pairs.agg(*aggs).first()
    out = []
    for i, c in enumerate(txt):
        nn = int(r[f"nn{i}"])
        if nn and (int(r[f"num{i}"]) / nn >= C.COERCE_RATIO or int(r[f"ts{i}"]) / nn >= C.COERCE_RATIO):
            out.append(c)
    return out


def _facts(df: DataFrame, mistyped: list[str] | None = None) -> dict:
    """Profile facts; ``mistyped`` may come from the cleaning step's parse
    ratios (the same test on the same values), saving a pass."""
    df = C.nan_to_null(df)
    f = stats.column_facts(df)
    _, dup = stats.duplicate_rows(df)
    f["dup"] = dup
    f["mistyped"] = mistyped if mistyped is not None else mistyped_columns(df)
    return f


def _measures(f: dict, columns: list[str]) -> dict[str, dict]:
    """Per rule: ``n`` things found and ``amount``, what its weight multiplies (a
    percentage of cells or rows, or a number of columns)."""
    nulls = sum(f["nulls"].values())
    found = {"const": [c for c in columns if f["const"][c]], "mistyped": f["mistyped"]}
    shares = {"nulls": (nulls, nulls / (f["rows"] * len(columns)) * 100), "dup": (f["dup"], f["dup"] / f["rows"] * 100)}
    return ({k: {"n": n, "amount": pct, "pct": pct} for k, (n, pct) in shares.items()}
            | {k: {"n": len(cs), "amount": len(cs), "names": ", ".join(cs[:3])} for k, cs in found.items()})


def quality(df: DataFrame, facts: dict | None = None) -> dict:
    """Score, grade, summary and factors: 100 less the capped penalty of every rule."""
    f = facts or _facts(df)
    if not f["rows"] or not df.columns:
        return {"score": 0, "grade": "F", "factors": [], "summary": EMPTY}
    measured = _measures(f, df.columns)
    charged = [(name, min(cap, round(measured[rule]["amount"] * weight, 1)), text.format(**measured[rule]))
               for rule, name, cap, weight, text in PENALTIES if measured[rule]["n"]]
    factors = [(name, round(points), detail) for name, points, detail in charged if points > 0]
    left = 100.0
    for _, points, _ in charged:
        left -= points
    score = min(100, max(0, round(left)))
    grade, summary = next(g[1:] for g in GRADES if score >= g[0])
    return {"score": score, "grade": grade, "factors": factors, "summary": summary if factors else NO_ISSUES}


def quality_score(df: DataFrame) -> DataFrame:
    q = quality(df)
    return df.sparkSession.createDataFrame([(q["score"], q["grade"], q["summary"])],
                                           "score int, grade string, summary string")


def quality_factors(df: DataFrame) -> DataFrame:
    q = quality(df)
    return df.sparkSession.createDataFrame(
        [(i, n, int(p), d) for i, (n, p, d) in enumerate(q["factors"])],
        "position int, name string, penalty int, detail string")


def mistyped(df: DataFrame) -> DataFrame:
    order = {c: i for i, c in enumerate(df.columns)}
    return df.sparkSession.createDataFrame([(order[c], c) for c in mistyped_columns(df)],
                                           "position int, column string")


def _note(rule: str, **values) -> tuple[str, str]:
    level, text = FINDINGS[rule]
    return level, text.format(**values)


def _share(n: int, rows: int, digits: int) -> float:
    return round(n / rows * 100, digits)


def _completeness(f: dict, columns: list[str]):
    """The emptiest column (the first of equals), or that nothing is missing."""
    shares = {c: _share(f["nulls"][c], f["rows"], 2) for c in columns}
    holed = [c for c in columns if shares[c] > 0]
    if not holed:
        return [_note("complete")]
    worst = min(holed, key=lambda c: (-shares[c], columns.index(c)))
    return [_note("nulls", name=worst, pct=shares[worst], n=len(holed))]


def _identifier(df: DataFrame, f: dict):
    """The first column with as many distinct values as rows; exact at any size."""
    whole = [c for c in df.columns if not f["nulls"][c]]
    if f["rows"] < 2 or not whole:
        return []
    return [_note("id", name=c) for c in stats.unique_columns(df, whole)[:1]]


def _strongest(pairs: list):
    """The pair of the largest |r| (the first of equals), if it is strong."""
    strong = sorted((p for p in pairs if abs(p["r"]) >= STRONG_R), key=lambda p: -abs(p["r"]))
    return [_note("corr", sign="positiva" if p["r"] > 0 else "negativa", r=p["r"], a=p["col_a"], b=p["col_b"])
            for p in strong[:1]]


def _most_outliers(df: DataFrame, f: dict):
    numeric = C.numeric_columns(df)
    quartiles = stats.quantiles(df, numeric, [0.25, 0.75])
    counts = stats.outlier_counts(df, stats.fences(quartiles, skip_zero_iqr=False))
    ranked = sorted((c for c in numeric if counts.get(c)), key=lambda c: -counts[c])
    return [_note("outliers", name=c, n=counts[c], pct=_share(counts[c], f["rows"], 1)) for c in ranked[:1]]


def findings(df: DataFrame, facts: dict | None = None, corr_rows: list | None = None) -> DataFrame:
    """Ordered (position, level, text) findings, ties → first column."""
    spark = df.sparkSession
    df = C.nan_to_null(df)
    f = facts or _facts(df)
    if f["rows"]:
        const = [c for c in df.columns if f["const"][c]]
        pairs = corr_rows if corr_rows is not None else eda.correlation(df).orderBy("i", "j").collect()
        notes = [
            *([_note("dup", n=f["dup"], pct=_share(f["dup"], f["rows"], 2))] if f["dup"] else []),
            *_completeness(f, df.columns),
            *([_note("const", names=", ".join(const[:5]))] if const else []),
            *_identifier(df, f), *_strongest(pairs), *_most_outliers(df, f)]
    else:
        notes = [_note("empty")]
    return spark.createDataFrame([(i, *note) for i, note in enumerate(notes)], "position int, level string, text string")
