"""Toxicity by a classifier chain.

Categories are predicted one after another. Each has a linear (logistic) model over the
words of a text, and the models of later categories also get the probabilities of the
earlier ones. In training these are out-of-fold predictions: a row's probability comes from
a model that was fitted on the other folds, so a later model sees what it will see on new
rows. Models are fitted by MLlib on a bounded sample of labelled rows; every row is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, prepare, stage

MAX_LABELLED = 8000
MAX_FEATURES = 1500
FOLDS = 3
MIN_DOCS = 4
THRESHOLD = 0.5
TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")
CACHED = 500_000


def tokens(text: str | None) -> set[str]:
    """Distinct lower-case words and runs of punctuation of a whole text."""
    return set(TOKEN.findall((text or "").lower()))


def features(token: str) -> list[str]:
    """A token and, of a word, its beginnings of 3 to 7 letters."""
    return [token] + [f"^{token[:n]}" for n in range(3, min(8, len(token)))] if token[0].isalpha() else [token[:32]]


def _counted(batches, categories):
    """Per task: documents by feature, in all and by positive category."""
    seen = [Counter() for _ in range(len(categories) + 1)]
    for pdf in batches:
        marks = pdf[list(categories)].to_numpy()
        for text, row in zip(pdf["text"], marks):
            have = {f for t in tokens(text) for f in features(t)}
            seen[0].update(have)
            for i in np.flatnonzero(row == 1):
                seen[i + 1].update(have)
    if seen[0]:
        yield pd.DataFrame({"feature": list(seen[0]), "n": list(seen[0].values()),
                            **{f"pos{i}": [seen[i + 1][f] for f in seen[0]] for i in range(len(categories))}})


def _chi2(n, pos, rows, total):
    """Chi-squared of a feature's presence (``n`` rows, ``pos`` positive) against a label."""
    expected = n * total / rows
    return (pos - expected) ** 2 / expected + (pos - expected) ** 2 / (n - n * total / rows)


def sample(docs: DataFrame, labels: DataFrame, categories: list[str], max_labelled: int) -> DataFrame:
    """``(fold_id, text, categories)`` of at most ``max_labelled`` labelled rows, those of the
    smallest hashes of their doc_id; the labels, not the documents, are cut down first."""
    chosen = (labels.where(F.col("doc_id").isNotNull())
              .groupBy(F.col("doc_id").cast("long").alias("label_id"))
              .agg(*[F.max(F.col(f"`{c}`").cast("int")).alias(c) for c in categories])
              .orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled))
    # max_labelled rows of a few numbers: a proven bound for the broadcast
    return docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), "label_id").select(
        F.xxhash64("label_id", "text").alias("fold_id"), "text",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in categories])


def _hits(text: str | None, vocabulary: dict[str, int], known: dict[str, tuple]) -> list[int]:
    """Numbers of the vocabulary's features that a text has; ``known`` keeps those of words."""
    found: set[int] = set()
    for t in tokens(text):
        hit = known.get(t)
        if hit is None:
            if len(known) > CACHED:
                known.clear()
            hit = known[t] = tuple(vocabulary[f] for f in features(t) if f in vocabulary)
        if hit:
            found.update(hit)
    return sorted(found)


def _with_hits(rows: DataFrame, vocabulary: dict[str, int], categories: list[str]) -> DataFrame:
    def run(batches):
        known: dict[str, tuple] = {}
        for pdf in batches:
            yield pdf.drop(columns="text").assign(hits=[_hits(t, vocabulary, known) for t in pdf["text"]])

    kinds = ", ".join(f"`{c}` int" for c in categories)
    return rows.select("fold_id", "text", *categories).mapInPandas(run, f"fold_id long, {kinds}, hits array<int>")


def _fit(rows: DataFrame, category: str, earlier: list[str], size: int) -> dict:
    """Weights of one link of the chain; a category with one class has its smoothed rate."""
    n, pos = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(category), F.lit(0))).first()
    if not 0 < pos < n:
        rate = (pos + 0.5) / (n + 1)
        return {"w": np.zeros(size), "b": math.log(rate / (1 - rate)) if n else -1e9, "c": np.zeros(len(earlier))}

    @F.udf(VectorUDT())
    def vector(hits, before):  # rows of the bounded sample
        return Vectors.sparse(size + len(before), [*hits, *range(size, size + len(before))],
                              [1.0] * len(hits) + list(before))

    x = vector("hits", F.array(*[F.col(f"p_{c}") for c in earlier]).cast("array<double>"))
    model = LogisticRegression(featuresCol="features", labelCol=category, regParam=0.002, elasticNetParam=0.3,
                               standardization=False, maxIter=40).fit(rows.select(category, x.alias("features")))
    w = model.coefficients.toArray()
    return {"w": w[:size], "b": float(model.intercept), "c": w[size:]}


def _probability(model: dict, hits: list[int], before: list[float]) -> float:
    z = model["b"] + float(model["w"][hits].sum()) + float(np.dot(model["c"], before))
    return 1.0 / (1.0 + math.exp(-z)) if z > -700 else 0.0


def _out_of_fold(rows: DataFrame, models: list[dict], category: str, earlier: list[str]) -> DataFrame:
    """``rows`` with the probability of ``category``: of fold ``i`` by the model ``i``."""
    def run(batches):
        for pdf in batches:
            before = pdf[[f"p_{c}" for c in earlier]].to_numpy(dtype=float)
            yield pdf.assign(**{f"p_{category}": [
                _probability(models[k], np.asarray(h, np.int64), b)
                for k, h, b in zip(pdf["fold_id"], pdf["hits"], before)]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, `p_{category}` double")


def train(docs: DataFrame, labels: DataFrame, categories: list[str], max_labelled: int = MAX_LABELLED,
          max_features: int = MAX_FEATURES, folds: int = FOLDS) -> dict:
    """The chain ``{"categories", "vocabulary", "models"}`` from ``labels (doc_id, <categories
    as 0/1>)`` joined to ``docs (doc_id, text)``. Null labels count as 0, null doc_ids are
    left out, of repeated labels the largest counts. Features are those of the largest
    chi-squared over the sample, ``max_features`` for each category at most."""
    if not categories or len(set(categories)) < len(categories) or folds < 2:
        raise ValueError("categories must be distinct and folds at least 2")
    prepare(docs.sparkSession)
    rows = stage(sample(docs, labels, categories, max_labelled), "labelled")
    n, *totals = rows.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(c), F.lit(0)) for c in categories]).first()
    names = list(categories)
    kinds = ", ".join(f"pos{i} long" for i in range(len(names)))
    counts = (rows.mapInPandas(lambda it: _counted(it, names), f"feature string, n long, {kinds}")
              .groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(f"pos{i}").alias(f"pos{i}") for i in range(len(names))])
              .where((F.col("n") >= MIN_DOCS) & (F.col("n") < n)))
    counts = stage(counts, "features")
    vocabulary: dict[str, int] = {}
    for i, total in enumerate(totals):
        if 0 < total < n:
            score = _chi2(F.col("n"), F.col(f"pos{i}"), F.lit(float(n)), F.lit(float(total)))
            best = counts.orderBy(F.round(score, 9).desc(), "feature").limit(max_features).select("feature").collect()
            for row in best:
                vocabulary.setdefault(row["feature"], len(vocabulary))
    size = len(vocabulary)
    rows = stage(_with_hits(rows, vocabulary, names).coalesce(4), "hits").withColumn(
        "fold_id", F.pmod("fold_id", F.lit(folds)))
    models: list[dict] = []
    for i, category in enumerate(names):
        earlier = names[:i]
        models.append(_fit(rows, category, earlier, size))
        if i + 1 < len(names):
            held_out = [_fit(rows.where(F.col("fold_id") != k), category, earlier, size) for k in range(folds)]
            rows = stage(_out_of_fold(rows, held_out, category, earlier), "folds")
    return {"categories": names, "vocabulary": vocabulary, "models": models}


def score(docs: DataFrame, chain: dict) -> DataFrame:
    """``docs`` with a column ``p_<category>`` for each category of the chain (under a free
    name where one is taken). Null and empty texts have no features and get what the models
    give a text without any; an empty table gives an empty one; rows are never dropped."""
    prepare(docs.sparkSession)
    vocabulary, models, names = chain["vocabulary"], chain["models"], chain["categories"]
    columns = [free_name(docs, f"p_{c}") for c in names]
    out = free_name(docs, "chain")

    def run(texts):
        known: dict[str, tuple] = {}
        for batch in texts:
            p = np.zeros((len(batch), len(names)))
            for i, text in enumerate(batch):
                hits = _hits(text, vocabulary, known)
                for j, model in enumerate(models):
                    p[i, j] = _probability(model, hits, p[i, :j])
            yield pd.DataFrame(p, columns=names)

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    kinds = ",".join(f"`{c}`:double" for c in names)
    scored = docs.withColumn(out, F.pandas_udf(run, f"struct<{kinds}>")(F.col("text").cast("string")))
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns],
                         *[F.col(out)[c].alias(new) for c, new in zip(names, columns)])


def label_categories(labels: DataFrame) -> DataFrame:
    """``labels (doc_id, quality, toxic)`` as the chain's categories: ``low_quality``, then ``toxic``."""
    return labels.select("doc_id", (F.coalesce(F.col("quality"), F.lit(1)) == 0).cast("int").alias("low_quality"),
                         (F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int").alias("toxic"))


CATEGORIES = ["low_quality", "toxic"]
