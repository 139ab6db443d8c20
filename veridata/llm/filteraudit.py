"""Audit of how corpus filters interact: what every order of them keeps and removes.

Each document becomes a mask of the filters that it fails; documents are counted by part and
mask, so a part is at most 32 cells whatever its size. A Gray-code walk then visits all 32
subsets of active filters and toggles one filter at a time: every mask cell has a counter of
its active failures, and a cell whose counter leaves or reaches zero is taken from or added to
the running survivors. The 32 states are stored, and every step of every order is the
difference of two of them.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stage

LETTERS = "ABCDE"
CELLS = 1 << len(LETTERS)
MEASURES = ("n", "good", "toxic")
BLANK = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
PARTS = 128  # parts whose steps are one batch
STEPS = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
         "good_lost long, toxic_lost long, shapley long")


def own_failures(text):
    """Mask of the filters A to D that a text (not null) fails.

    A: under 50 words; B: fewer than 65 distinct words in 100; C: more than 5 capitals A-Z in
    100 code points; D: holds one of ``# $ % & * |``. Words are runs of anything but ASCII
    white space and compared as they are.
    """
    bare = F.btrim(text, F.lit(BLANK))
    words = F.split(bare, GAP)
    count = F.when(bare == "", 0).otherwise(F.size(words))
    distinct = F.when(bare == "", 0).otherwise(F.size(F.array_distinct(words)))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [count < 50, F.lit(100) * distinct < F.lit(65) * count, F.lit(100) * capitals > F.lit(5) * F.length(text),
             text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails[1:], 1)), F.when(fails[0], 1).otherwise(0))


def masked(docs: DataFrame, part: str) -> DataFrame:
    """Rows ``(doc_id, part, mask, n)``: how many rows of a doc_id and part fail just the
    filters of ``mask``. E, the text of a smaller doc_id, is decided by the smallest id of
    each text, found by SHA-256 of the text: the join that brings it back is by doc_id, so
    copies of one text never meet in a task."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("sha"), own_failures(text).cast("int").alias("mask"))
        .groupBy("doc_id", "part", "sha", "mask").agg(F.count(F.lit(1)).alias("n")), "filter-masks")
    first = rows.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first"))
    copy = F.when(F.col("first").isNull(), 1 << 4).otherwise(0)
    named = rows.where("doc_id is not null").join(
        first.withColumn("doc_id", F.col("first")), ["doc_id", "sha"], "left").select(
        "doc_id", "part", (F.col("mask") + copy).alias("mask"), "n")
    # a null id comes after all others; rows without one are few for each text once they are counted
    unnamed = (rows.where("doc_id is null").groupBy("part", "sha", "mask").agg(F.sum("n").alias("n"))
               .join(first, "sha", "left")
               .select(F.lit(None).cast("long").alias("doc_id"), "part", (F.col("mask") + 16 - copy).alias("mask"), "n"))
    return named.union(unnamed).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Rows ``(part, mask, n, good, toxic)``: documents, those labelled quality 1 and those
    labelled toxic 1, by part and by the filters that they fail."""
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    # copies of an id are counted already, so no id is more than a few rows here
    return masked(docs, part).join(flags, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("is_good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("is_toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def gray_walk(counts: np.ndarray) -> np.ndarray:
    """``counts`` (parts x mask cells x measures) -> survivors of every subset of active
    filters, in the same shape and indexed by the subset's bits."""
    masks = np.arange(counts.shape[1])
    failures = np.zeros(len(masks), np.int64)  # active filters that a cell fails
    alive, active = counts.sum(axis=1), 0
    states = np.empty_like(counts)
    states[:, 0] = alive
    for i in range(1, len(masks)):
        toggled = i & -i
        hit = masks & toggled != 0
        if active & toggled:
            failures[hit] -= 1
            alive = alive + counts[:, hit & (failures == 0)].sum(axis=1)
        else:
            alive = alive - counts[:, hit & (failures == 0)].sum(axis=1)
            failures[hit] += 1
        active ^= toggled
        states[:, active] = alive
    return states


def _states(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, PARTS):
            rows = batch.slice(at, PARTS).to_pylist()
            counts = np.zeros((len(rows), CELLS, len(MEASURES)), np.int64)
            for i, row in enumerate(rows):
                for cell in row["cells"]:
                    counts[i, cell["mask"]] = [cell[m] for m in MEASURES]
            states = gray_walk(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["part"] for r in rows]), *[pa.array(list(states[:, :, m])) for m in range(len(MEASURES))]],
                names=["part", *MEASURES])


def states(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row ``(part, n, good, toxic)`` per part; each of the three is an array of 32
    survivor counts, indexed by the bits of the active filters (A is the lowest).

    Null text counts as empty, a null part as the empty string; a null doc_id comes after all
    others and has no label; of several labels of an id any 1 counts; repeated rows count each
    by itself and are no copies of each other (no id is smaller); an empty table has no
    parts; other columns are ignored.
    """
    prepare(docs.sparkSession)
    gathered = cells(docs, labels, part).groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))
    return gathered.mapInArrow(_states, "part string, n array<long>, good array<long>, toxic array<long>")


def steps(stored: DataFrame) -> DataFrame:
    """Rows of every part, order of the filters and step in it, from the stored ``states``:
    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley`` (the filter's removals, summed over all orders)."""
    orders = ["".join(p) for p in itertools.permutations(LETTERS)]
    letter = np.array([LETTERS.index(c) for order in orders for c in order])
    bits = (1 << letter).reshape(len(orders), -1)
    after = np.cumsum(bits, axis=1).ravel()
    bit = bits.ravel()
    before, whole = after - bit, CELLS - 1

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                some = batch.slice(at, PARTS)
                n, good, toxic = (some.column(m).flatten().to_numpy(zero_copy_only=False).reshape(-1, CELLS) for m in MEASURES)
                removed = n[:, before] - n[:, after]
                failing = n[:, [0]] - n[:, bit]
                shapley = np.stack([removed[:, letter == f].sum(axis=1) for f in range(len(LETTERS))], axis=1)
                columns = [n[:, after], removed, failing - removed, n[:, whole - bit] - n[:, [whole]],
                           good[:, before] - good[:, after], toxic[:, before] - toxic[:, after], shapley[:, letter]]
                parts = some.num_rows
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(np.repeat(np.arange(parts), len(bit)))),
                     pa.array(np.repeat(orders, len(LETTERS)).tolist() * parts),
                     pa.array(np.tile(np.arange(1, len(LETTERS) + 1, dtype=np.int32), len(orders) * parts)),
                     *[pa.array(c.ravel()) for c in columns]],
                    names=[c.split()[0] for c in STEPS.split(", ")])

    return stored.select("part", *MEASURES).mapInArrow(rows, STEPS)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The steps of all orders for every part of ``docs``, see ``states`` and ``steps``."""
    return steps(stage(states(docs, labels, part), "filter-states"))
