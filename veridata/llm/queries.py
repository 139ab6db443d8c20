"""Registered queries of the pipeline operators, with DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, decontaminate, filteraudit, licences, linededup, packing, repeats, secrets, sharding, simhash, spelling,
               toxicity, urlfilter)
from .common import table

QueryFn = Callable[[SparkSession, str], DataFrame]
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
         ("net/fr/", "block")]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with cross-site boilerplate lines taken out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return linededup.remove_boilerplate(docs).select("doc_id", "text", "lines_removed")


OP1_SQL = """
WITH rows AS (SELECT DISTINCT doc_id, text, source FROM documents),
raw AS (SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS raw_line,
               unnest(range(len(string_split(text, chr(10))))) AS no FROM rows),
lines AS (SELECT *, trim(raw_line, ' ' || chr(9) || chr(13)) AS line FROM raw),
bad AS (SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
ranked AS (SELECT l.*, row_number() OVER (PARTITION BY l.line ORDER BY doc_id, no) AS r
           FROM lines l JOIN bad USING (line)),
marked AS (SELECT l.doc_id, l.text, l.no, l.raw_line, coalesce(r.r, 1) > 1 AS drop_it
           FROM lines l LEFT JOIN ranked r USING (doc_id, text, no))
SELECT doc_id, coalesce(string_agg(raw_line, chr(10) ORDER BY no) FILTER (WHERE NOT drop_it), '') AS text,
       CAST(count(*) FILTER (WHERE drop_it) AS BIGINT) AS lines_removed
FROM marked GROUP BY doc_id, marked.text
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the chain's probabilities and the decision on ``toxic``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = toxicity.label_categories(table(spark, sf_dir, "labels"))
    chain = toxicity.train(docs, labels, toxicity.CATEGORIES)
    return toxicity.score(docs, chain).select(
        "doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= toxicity.THRESHOLD).alias("toxic"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which it holds a passage."""
    return decontaminate.matches(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                 table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    pages = table(spark, sf_dir, "pages")
    counts = urlfilter.word_counts(pages, "html")
    return urlfilter.judge(pages.select("page_id", "url"), RULES, counts).select(
        "page_id", "host", "path", "rule", "verdict", "score")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of the documents with the forest's decision."""
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line and block with a licence cue or a family, and whether a template confirms it."""
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, F.col("vec_id") % 20 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and place in it, by the law of equal bytes."""
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 400 bytes that begin elsewhere too."""
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form, its root and its number of near words."""
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source, order of the five filters and step in it."""
    return filteraudit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"),
                             table(spark, sf_dir, "labels"))


OP13_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
marked AS (
  SELECT doc_id, part,
         (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * (doc_id > min(doc_id) OVER (PARTITION BY text))::INT AS mask FROM docs),
flags AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
facts AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM marked LEFT JOIN flags USING (doc_id) GROUP BY part, mask),
letters(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.c || b.c || d.c || e.c || f.c AS filter_order, [a.bit, b.bit, d.bit, e.bit, f.bit] AS bits
  FROM letters a, letters b, letters d, letters e, letters f
  WHERE a.bit + b.bit + d.bit + e.bit + f.bit = 31 AND (a.bit | b.bit | d.bit | e.bit | f.bit) = 31),
steps AS (
  SELECT filter_order, s AS step, bits[s] AS bit, CAST(coalesce(list_sum(bits[1:s - 1]), 0) AS INT) AS done
  FROM orders, range(1, 6) AS r(s)),
counted AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (WHERE mask & (done | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE mask & done = 0 AND mask & bit <> 0), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE mask & done <> 0 AND mask & bit <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE mask & done = 0 AND mask & bit <> 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE mask & done = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM facts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline`` one after another."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, QueryFn] = {f.__name__: f for f in (
    op1_line_dedup, op2_toxicity, op3_decontamination, op4_url_filter, op5_secret_scan, op6_licence_scan, op7_nearest,
    op8_packing, op9_simhash, op10_sharding, op11_repeats, op12_spelling, op13_filter_audit, pipeline)}
ORACLE: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op13_filter_audit": OP13_SQL}
