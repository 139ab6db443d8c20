"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridata.llm import decontaminate, linededup, packing, simhash, toxicity
from veridata.llm.common import free_name, scratch_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the category ``toxic`` is below the threshold. The
    chain is trained on the labelled rows among ``docs``; without labels nothing is dropped."""
    chain = toxicity.train(docs, toxicity.label_categories(table(spark, sf_dir, "labels")), toxicity.CATEGORIES)
    p = free_name(docs, "p_toxic")
    scored = toxicity.score(docs, chain)
    return scored.where(F.col(p) < toxicity.THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines, ``n_chars`` counted anew; those of
    which nothing but blanks is left are dropped."""
    removed = free_name(docs, "lines_removed")
    cleaned = linededup.remove_boilerplate(docs)
    kept = cleaned.where((F.col(removed) == 0) | F.col("text").rlike(r"\S"))
    return kept.select(*[
        F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema[c].dataType).alias(c)
        if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates."""
    return simhash.keep_first(docs, shingle=3, max_bits=3)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("simhash", drop_near_duplicates),
          ("decontamination", drop_benchmark), ("packing", pack_tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
