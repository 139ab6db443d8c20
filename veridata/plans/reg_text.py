"""Checks for text scoring (TX4–TX9) and web pages (TX1–TX3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as TX
from ..sources import pages as PG
from .registry import register
from .views import table

TOK = r"'[\p{L}\p{N}]+'"
SENT = r"'[^.!?]+[.!?]*'"
STRIP = r"'^\s+|\s+$', '', 'g'"
TOPIC_LABELS = ["the and of", "le la les", "der die und", "el los las"]
QUESTION = "where is the data and the results"


@register("doc_entities", f"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')) AS form FROM documents),
c AS (SELECT doc_id, form, count(*) AS n FROM m WHERE length(form) >= 2 GROUP BY 1, 2),
t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY 1),
s AS (SELECT c.doc_id, 'MISC' AS type, form, round(n / total, 6) AS score FROM c JOIN t ON c.doc_id = t.doc_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY score DESC, form) AS rank FROM s)
WHERE rank <= 15""")
def q_entities(spark, d):
    return TX.entities(table(spark, d, "documents"))


@register("doc_topics", f"""
WITH lab AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(TOPIC_LABELS))}) v(label_no, label)),
terms AS (SELECT DISTINCT label_no, unnest(regexp_extract_all(lower(label), {TOK})) AS token FROM lab),
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {TOK})) AS token FROM documents),
pd AS (SELECT doc_id, token, count(*) AS n FROM tok GROUP BY 1, 2),
tot AS (SELECT doc_id, greatest(coalesce(len(regexp_extract_all(lower(text), {TOK})), 0), 1) AS total FROM documents),
hits AS (SELECT doc_id, label_no, sum(n) AS hits FROM pd JOIN terms ON pd.token = terms.token GROUP BY 1, 2),
g AS (SELECT tot.doc_id, lab.label_no, lab.label, exp(coalesce(hits, 0) / total) AS e FROM tot CROSS JOIN lab
      LEFT JOIN hits ON hits.doc_id = tot.doc_id AND hits.label_no = lab.label_no),
s AS (SELECT doc_id, label, label_no, round(e / sum(e) OVER (PARTITION BY doc_id), 6) AS score FROM g)
SELECT doc_id, label, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label_no) AS rank FROM s""")
def q_topics(spark, d):
    return TX.topics(table(spark, d, "documents"), TOPIC_LABELS)


_SENTS = f"""
l AS (SELECT doc_id, regexp_extract_all(text, {SENT}) AS xs FROM documents),
s0 AS (SELECT doc_id, unnest(range(len(xs))) AS sent_no, xs FROM l),
s AS (SELECT doc_id, sent_no, regexp_replace(xs[sent_no + 1], {STRIP}) AS sentence FROM s0),
sents AS (SELECT * FROM s WHERE length(sentence) > 0),
st AS (SELECT doc_id, sent_no, unnest(regexp_extract_all(lower(sentence), {TOK})) AS token FROM sents)"""


@register("doc_summary", f"""WITH {_SENTS},
freq AS (SELECT doc_id, token, count(*) AS f FROM st GROUP BY 1, 2),
sc AS (SELECT st.doc_id, st.sent_no, avg(f) AS s FROM st JOIN freq ON st.doc_id = freq.doc_id AND st.token = freq.token
       GROUP BY 1, 2),
scored AS (SELECT sents.doc_id, sents.sent_no, sentence, round(coalesce(s, 0), 6) AS s FROM sents
           LEFT JOIN sc ON sc.doc_id = sents.doc_id AND sc.sent_no = sents.sent_no),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, sent_no) AS rk FROM scored)
        WHERE rk <= 3)
SELECT documents.doc_id, coalesce(string_agg(sentence, ' ' ORDER BY sent_no), '') AS summary
FROM documents LEFT JOIN top ON top.doc_id = documents.doc_id GROUP BY 1""")
def q_summary(spark, d):
    return TX.summarize(table(spark, d, "documents"))


@register("doc_qa", f"""WITH {_SENTS},
q AS (SELECT DISTINCT unnest(regexp_extract_all(lower('{QUESTION}'), {TOK})) AS token),
nq AS (SELECT count(*) AS n FROM q),
found AS (SELECT doc_id, sent_no, count(DISTINCT st.token) AS k FROM st JOIN q ON st.token = q.token GROUP BY 1, 2),
scored AS (SELECT sents.doc_id, sents.sent_no, sentence, round(coalesce(k, 0) / nq.n, 6) AS score
           FROM sents LEFT JOIN found ON found.doc_id = sents.doc_id AND found.sent_no = sents.sent_no, nq),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sent_no) AS rk
         FROM scored) WHERE rk = 1)
SELECT documents.doc_id, CASE WHEN coalesce(score, 0) > 0 THEN sentence
       ELSE 'No encontré una respuesta clara en el texto.' END AS answer, coalesce(score, 0.0) AS score
FROM documents LEFT JOIN best ON best.doc_id = documents.doc_id""")
def q_qa(spark, d):
    return TX.answer(table(spark, d, "documents"), QUESTION)


@register("doc_min_text", f"SELECT doc_id FROM documents WHERE length(regexp_replace(text, {STRIP})) >= 20")
def q_min_text(spark, d):
    return TX.min_text(table(spark, d, "documents")).select("doc_id")


@register("doc_sentiment")
def q_sentiment(spark, d):
    docs = table(spark, d, "documents")
    train = docs.join(table(spark, d, "labels"), "doc_id")
    return TX.sentiment(docs, train)


_RELIABILITY_SQL = """
SELECT bin, n, round(m, 6) AS mean_score, round(s, 6) AS share, round(abs(m - s), 6) AS gap FROM (
  SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, avg(p) AS m, avg(l) AS s
  FROM (SELECT l_discount * 10 AS p, CASE WHEN l_tax * 100 < l_discount * 80 THEN 1.0 ELSE 0.0 END AS l FROM lineitem
        WHERE l_discount * 10 <= 1) GROUP BY 1)"""


@register("score_reliability", _RELIABILITY_SQL)
def q_reliability(spark, d):
    """Reliability bins of a score against what happened."""
    p = F.col("l_discount") * 10
    rows = table(spark, d, "lineitem").where(p <= 1).select(
        p.alias("score"), F.when(F.col("l_tax") * 100 < F.col("l_discount") * 80, 1.0).otherwise(0.0).alias("label"))
    return TX.reliability(rows)


@register("sentiment_reliability")
def q_sentiment_reliability(spark, d):
    """How the calibrated scores of documents that the model has not seen match their labels."""
    train = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return TX.reliability(TX.fit_sentiment(train).out_of_fold)


_TAGS_SQL = """
SELECT c_custkey // 10 AS doc_id, 'B-' || CASE c_custkey % 5 WHEN 0 THEN 'PER' WHEN 1 THEN 'ORG' WHEN 2 THEN 'ORG' WHEN 3 THEN 'LOC'
       ELSE 'EVT' END AS tag, c_name AS word, c_custkey % 7 / 8.0 AS score FROM {customer}"""


@register("entity_groups", "WITH t AS (" + _TAGS_SQL.format(customer="customer") + """),
best AS (SELECT doc_id, substr(tag, 3) AS type, word AS form, max(score) AS score FROM t GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY score DESC, form) AS rank FROM best),
kept AS (SELECT * FROM ranked WHERE rank <= 15),
sizes AS (SELECT doc_id, type, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, type) AS group_no FROM kept
          GROUP BY doc_id, type)
SELECT doc_id, CAST(group_no AS INT) AS group_no, CASE type WHEN 'PER' THEN 'Personas' WHEN 'ORG' THEN 'Organizaciones'
       WHEN 'LOC' THEN 'Lugares' WHEN 'MISC' THEN 'Misceláneo' ELSE type END AS label, CAST(rank AS INT) AS rank, form,
       CAST(score AS DOUBLE) AS score
FROM kept JOIN sizes USING (doc_id, type)""")
def q_entity_groups(spark, d):
    """Tags of the customers' names, ten a document, as a tagger would give them."""
    sql = _TAGS_SQL.replace("//", "DIV").replace("% 7 / 8.0", "% 7 / 8D")
    return TX.entity_groups(spark.sql(sql, customer=table(spark, d, "customer")))


# ── pages ───────────────────────────────────────────────────────────────────
# Paragraphs by pattern: what the parser skips goes first, then a paragraph runs from its start tag
# to its end tag or the next start tag of a block.
_BLOCK_STARTS = "|".join(sorted(PG.BLOCK_TAGS - {"p"}))
_SKIPPED = "|".join(sorted(PG.SKIP_TAGS))


@register("page_text", rf"""
WITH bare AS (
  SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'),
    '<({_SKIPPED})\b.*?</({_SKIPPED})\s*>', '', 'gis') AS h FROM pages),
cut AS (
  SELECT page_id, string_split(regexp_replace(regexp_replace(h, '<p(\s[^>]*)?>', chr(1) || chr(2), 'gi'),
    '</p\s*>|<({_BLOCK_STARTS})(\s[^>]*)?/?>', chr(1), 'gi'), chr(1)) AS parts FROM bare),
texts AS (
  SELECT page_id, list_transform(list_filter(parts, lambda t: starts_with(t, chr(2))), lambda t:
    regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(substring(t, 2), '<[^>]*>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&'),
      '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')) AS ps FROM cut)
SELECT page_id, array_to_string(list_filter(ps, lambda t: length(t) > 20), ' ') AS text FROM texts""")
def q_page_text(spark, d):
    return PG.page_text(table(spark, d, "pages"))


def nation_pages(spark, d):
    """One page per region whose <table> lists its nations (≤ 25 rows each)."""
    nat = table(spark, d, "nation")
    rows = nat.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("xs"))
    body = F.array_join(F.transform("xs", lambda x: F.concat(
        F.lit("<tr><td>"), x["n_nationkey"].cast("string"), F.lit("</td><td>"), x["n_name"], F.lit("</td></tr>"))), "")
    html = F.concat(F.lit("<html><body><p>Nations of this region are listed in the table below.</p>"
                          "<table><tr><th>n_nationkey</th><th>n_name</th></tr>"), body,
                    F.lit("</table><table><tr><td>too</td><td>small</td></tr></table></body></html>"))
    return rows.select(F.col("n_regionkey").cast("long").alias("page_id"), F.lit("").alias("url"), html.alias("html"))


@register("page_tables", """
WITH r AS (SELECT n_regionkey, n_nationkey, n_name,
                  row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row_no FROM nation)
SELECT n_regionkey::BIGINT AS page_id, 0 AS table_no, row_no::INTEGER AS row_no, c.col_no, c.header,
       CASE c.col_no WHEN 0 THEN CAST(n_nationkey AS VARCHAR) ELSE n_name END AS cell
FROM r, (VALUES (0, 'n_nationkey'), (1, 'n_name')) c(col_no, header)""")
def q_page_tables(spark, d):
    return PG.page_tables(nation_pages(spark, d))


@register("page_tables_loose", """
WITH r AS (SELECT n_regionkey, n_name, CAST(n_nationkey AS VARCHAR) AS k,
                  row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row_no FROM nation),
a AS (SELECT n_regionkey, row_no, k, n_name FROM r
      UNION ALL SELECT n_regionkey, count(*), 'end', 'end' FROM r GROUP BY 1)
SELECT n_regionkey::BIGINT AS page_id, 1 AS table_no, row_no::INTEGER AS row_no, c.col_no, c.header,
       CASE c.col_no WHEN 0 THEN 'all' WHEN 1 THEN k ELSE n_name END AS cell
FROM a, (VALUES (0, 'scope'), (1, 'n_nationkey'), (2, 'n_name')) c(col_no, header)""")
def q_page_tables_loose(spark, d):
    """Nested tables without end tags, with cells that span rows and columns."""
    nat = table(spark, d, "nation")
    rows = nat.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("xs"))
    cells = F.transform("xs", lambda x: F.concat(F.lit("<td>"), x["n_nationkey"].cast("string"), F.lit("<td>"), x["n_name"]))
    html = F.concat(F.lit("<table><tr><td>around<td><table><tr><th>scope<th>n_nationkey<th>n_name<tr><td rowspan="),
                    (F.size("xs") + 1).cast("string"), F.lit(">all"), F.array_join(cells, "<tr>"),
                    F.lit("<tr><td colspan=2>end</table></table>"))
    pages = rows.select(F.col("n_regionkey").cast("long").alias("page_id"), F.lit("").alias("url"), html.alias("html"))
    return PG.page_tables(pages)


@register("page_excerpt", "SELECT page_id, substring(html, 1, 1500) AS excerpt, length(html)::BIGINT AS html_chars "
          "FROM pages")
def q_page_excerpt(spark, d):
    return PG.page_excerpt(table(spark, d, "pages"))
