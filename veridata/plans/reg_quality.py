"""Checks for chart aggregates (CH1–CH4, TK2), quality (QU1–QU4) and the report."""

from __future__ import annotations

from ..operators import charts as CH
from ..operators import quality as QU
from . import sqlgen as G
from .registry import register
from .report import eda_bundle, report
from .views import dirty, dirty_cte, table


@register("chart_hist", """
WITH x AS (SELECT l_extendedprice::DOUBLE AS x FROM lineitem WHERE l_extendedprice IS NOT NULL),
m AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 30 AS w FROM x),
b AS (SELECT least(floor((x - lo) / w), 29)::INTEGER AS bin FROM x, m),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY 1)
SELECT g.bin, lo + g.bin * w AS lo, CASE WHEN g.bin = 29 THEN hi ELSE lo + (g.bin + 1) * w END AS hi,
       coalesce(n, 0)::BIGINT AS n
FROM (SELECT range::INTEGER AS bin FROM range(30)) g CROSS JOIN m LEFT JOIN c ON c.bin = g.bin""")
def q_hist(spark, d):
    return CH.histogram(table(spark, d, "lineitem"), "l_extendedprice")


def _box_sql(grp: str, src: str) -> str:
    return f"""
WITH base AS (SELECT {grp} AS grp, l_extendedprice::DOUBLE AS x FROM {src} WHERE l_extendedprice IS NOT NULL),
q AS (SELECT grp, count(*)::BIGINT AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
             quantile_cont(x, 0.75) AS q3 FROM base GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.grp, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(CASE WHEN x >= lo AND x <= hi THEN x END), 6) AS lower,
       round(max(CASE WHEN x >= lo AND x <= hi THEN x END), 6) AS upper,
       count(*) FILTER (WHERE NOT (x >= lo AND x <= hi))::BIGINT AS outliers
FROM base JOIN f ON base.grp = f.grp GROUP BY f.grp, n, q1, median, q3"""


@register("chart_box", _box_sql("'l_extendedprice'", "lineitem"))
def q_box(spark, d):
    return CH.box(table(spark, d, "lineitem"), "l_extendedprice")


@register("chart_box_by", _box_sql("coalesce(CAST(l_returnflag AS VARCHAR), 'None')", "lineitem"))
def q_box_by(spark, d):
    return CH.box(table(spark, d, "lineitem"), "l_extendedprice", by="l_returnflag")


@register("chart_scatter", "SELECT l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem "
          "WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def q_scatter(spark, d):
    return CH.scatter(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@register("chart_bar", dirty_cte("SELECT coalesce(event_type, 'None') AS value, count(*)::BIGINT AS n FROM dirty "
                                 "GROUP BY 1 ORDER BY n DESC, value LIMIT 15"))
def q_bar(spark, d):
    return CH.bar(dirty(spark, d), "event_type")


@register("topk_categories", "SELECT coalesce(p_type, 'None') AS value, count(*)::BIGINT AS n FROM part "
          "GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def q_topk(spark, d):
    return CH.bar(table(spark, d, "part"), "p_type", 5)


# ── quality ─────────────────────────────────────────────────────────────────
_TXT = G.text(G.DIRTY)
_NUM_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_DATE = "try_strptime(trim({c}), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%m/%d/%Y', '%Y%m%d'])"

_MISTYPED = "mt AS (SELECT * FROM (" + G.union([
    f"SELECT {i} AS position, '{c}' AS \"column\", count({c}) AS nn, "
    f"count(*) FILTER (WHERE regexp_matches({c}, '{_NUM_RE}')) AS num, "
    f"count({_DATE.format(c=c)}) AS dt FROM dirty" for i, (c, t) in enumerate(G.DIRTY) if t == "string"])
_MISTYPED += ") WHERE nn > 0 AND (num / nn >= 0.9 OR dt / nn >= 0.9))"

_CONST = "cst AS (SELECT * FROM (" + G.union([
    f"SELECT {i} AS position, '{c}' AS \"column\", count(DISTINCT {G.q(c)}) AS d FROM dirty"
    for i, (c, _) in enumerate(G.DIRTY)]) + ") WHERE d <= 1)"

_FACTS = dirty_cte(f""", s AS (SELECT count(*) AS n, 11 AS cols, ({" + ".join(
    f"count(*) - count({G.q(c)})" for c, _ in G.DIRTY)}) AS nn FROM dirty),
dd AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS dup FROM dirty),
{_MISTYPED}, {_CONST},
p AS (SELECT n, nn, dup, nn / (n * cols) AS rn, dup / n AS rd,
             least(35.0, round_even(nn / (n * cols) * 100 * 1.5, 1)) AS pn, least(20.0, round_even(dup / n * 100, 1)) AS pd,
             least(18.0, (SELECT count(*) FROM cst) * 6.0) AS pc, least(15.0, (SELECT count(*) FROM mt) * 5.0) AS pt,
             (SELECT count(*) FROM cst) AS nc, (SELECT count(*) FROM mt) AS nm,
             (SELECT string_agg("column", ', ' ORDER BY position) FROM (SELECT * FROM cst ORDER BY position LIMIT 3)) AS cn,
             (SELECT string_agg("column", ', ' ORDER BY position) FROM (SELECT * FROM mt ORDER BY position LIMIT 3)) AS mn
      FROM s, dd)
""")


@register("quality_factors", _FACTS + """
SELECT (row_number() OVER (ORDER BY k) - 1)::INTEGER AS position, name, penalty, detail FROM (
  SELECT 1 AS k, 'Valores faltantes' AS name, round_even(pn, 0)::INTEGER AS penalty,
         printf('%d celdas nulas (%.1f%% del total).', nn, rn * 100) AS detail FROM p WHERE pn > 0
  UNION ALL SELECT 2, 'Filas duplicadas', round_even(pd, 0)::INTEGER, printf('%d filas repetidas (%.1f%%).', dup, rd * 100)
    FROM p WHERE pd > 0
  UNION ALL SELECT 3, 'Columnas constantes', round_even(pc, 0)::INTEGER, printf('%d columna(s) con un solo valor: %s.', nc, cn)
    FROM p WHERE pc > 0
  UNION ALL SELECT 4, 'Tipos mal detectados', round_even(pt, 0)::INTEGER,
    printf('%d columna(s) de texto que son número/fecha: %s.', nm, mn) FROM p WHERE pt > 0)""")
def q_quality_factors(spark, d):
    return QU.quality_factors(dirty(spark, d))


@register("quality_score", _FACTS + """
, sc AS (SELECT greatest(0, least(100, round_even(100 - pn - pd - pc - pt, 0)))::INTEGER AS score,
                (pn + pd + pc + pt) > 0 AS any_factor FROM p)
SELECT score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C'
                   WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade,
       CASE WHEN NOT any_factor THEN 'Sin problemas de calidad detectados.'
            WHEN score >= 90 THEN 'Datos en excelente estado, listos para analizar.'
            WHEN score >= 75 THEN 'Buena calidad; unos retoques menores lo dejarían perfecto.'
            WHEN score >= 60 THEN 'Calidad aceptable; conviene limpiar antes de modelar.'
            WHEN score >= 40 THEN 'Calidad baja; la limpieza es muy recomendable.'
            ELSE 'Datos muy sucios; límpialos antes de usarlos.' END AS summary FROM sc""")
def q_quality_score(spark, d):
    return QU.quality_score(dirty(spark, d))


@register("mistyped", dirty_cte(", " + _MISTYPED + " SELECT position, \"column\" FROM mt"))
def q_mistyped(spark, d):
    return QU.mistyped(dirty(spark, d))


@register("eda_bundle")
def q_eda_bundle(spark, d):
    return eda_bundle(dirty(spark, d))


@register("report")
def q_report(spark, d):
    return report(dirty(spark, d))


_NUMQ = [c for c, t in G.DIRTY if t in ("bigint", "double")]
_PAIRS = [(i, j) for i in range(len(_NUMQ)) for j in range(i + 1, len(_NUMQ))]
_FINDINGS_SQL = dirty_cte(""",
nn AS (SELECT count(*) AS n FROM dirty),
dup AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS d FROM dirty),
cols AS (""" + G.union([
    f"SELECT {i} AS position, '{c}' AS name, count(*) - count({G.q(c)}) AS nulls, "
    f"count(DISTINCT {G.q(c)}) AS d FROM dirty" for i, (c, _) in enumerate(G.DIRTY)]) + """),
pct AS (SELECT position, name, round((nulls * 100.0) / (SELECT n FROM nn), 2) AS p FROM cols),
pairs AS (""" + G.union([
    f"SELECT {i} AS i, {j} AS j, '{_NUMQ[i]}' AS a, '{_NUMQ[j]}' AS b, corr({_NUMQ[i]}, {_NUMQ[j]}) AS r0 FROM dirty "
    f"HAVING min({_NUMQ[i]}) <> max({_NUMQ[i]}) AND min({_NUMQ[j]}) <> max({_NUMQ[j]})" for i, j in _PAIRS]) + """),
pr AS (SELECT i, j, a, b, round(CASE WHEN r0 IS NULL OR isnan(r0) THEN 0 ELSE r0 END, 3) + 0.0 AS r FROM pairs),
outl AS (""" + G.union([
    f"SELECT {k} AS position, '{c}' AS name, (SELECT count(*) FROM dirty, (SELECT quantile_cont({c}, 0.25) AS lo, "
    f"quantile_cont({c}, 0.75) AS hi FROM dirty) f WHERE {c} < lo - 1.5 * (hi - lo) OR {c} > hi + 1.5 * (hi - lo)) AS k"
    for k, c in enumerate(_NUMQ)]) + """),
items AS (
  SELECT 1 AS k, 'warning' AS level, printf('Hay %d filas duplicadas (%s%%). Considera eliminarlas.', d,
         CAST(round(d * 100.0 / (SELECT n FROM nn), 2) AS VARCHAR)) AS text FROM dup WHERE d > 0
  UNION ALL
  SELECT 2, 'warning', printf('«%s» es la columna con más valores faltantes (%s%%). %d columna(s) tienen nulos en total.',
         name, CAST(p AS VARCHAR), (SELECT count(*) FROM pct WHERE p > 0))
  FROM (SELECT * FROM pct WHERE p > 0 ORDER BY p DESC, position LIMIT 1)
  UNION ALL
  SELECT 2, 'success', 'No hay valores faltantes: el dataset está completo.' WHERE NOT EXISTS (SELECT 1 FROM pct WHERE p > 0)
  UNION ALL
  SELECT 3, 'info', 'Columna(s) con un solo valor (sin información útil): '
         || (SELECT string_agg(name, ', ' ORDER BY position) FROM (SELECT * FROM cols WHERE d <= 1 ORDER BY position LIMIT 5))
         || '.' WHERE EXISTS (SELECT 1 FROM cols WHERE d <= 1)
  UNION ALL
  SELECT 4, 'info', printf('«%s» parece un identificador único (un valor distinto por fila).', name)
  FROM (SELECT * FROM cols WHERE d = (SELECT n FROM nn) AND (SELECT n FROM nn) > 1 ORDER BY position LIMIT 1)
  UNION ALL
  SELECT 5, 'info', printf('Correlación %s fuerte (%+.2f) entre «%s» y «%s».',
         CASE WHEN r > 0 THEN 'positiva' ELSE 'negativa' END, r, a, b)
  FROM (SELECT * FROM pr ORDER BY abs(r) DESC, i, j LIMIT 1) WHERE abs(r) >= 0.7
  UNION ALL
  SELECT 6, 'info', printf('«%s» tiene %d valores atípicos (%s%%) según el método IQR.', name, k,
         CAST(round(k * 100.0 / (SELECT n FROM nn), 1) AS VARCHAR))
  FROM (SELECT * FROM outl ORDER BY k DESC, position LIMIT 1) WHERE k > 0)
SELECT (row_number() OVER (ORDER BY k) - 1)::INTEGER AS position, level, text FROM items""")


@register("findings", _FINDINGS_SQL)
def q_findings(spark, d):
    return QU.findings(dirty(spark, d))
