"""Sharding by fixed virtual slots and a stored, versioned slot-to-shard map.

A record is hashed by its text into one of thousands of slots, so equal texts meet in one
shard. A text whose copies outweigh or outnumber a set share of a shard is a hot group: its
records are spread over all slots by a running number, which also parts rows alike in id
and text. Bytes are summed by slot. The map of slots to shards (a table with as many rows as
there are slots) is stored in versions: the first deals the slots out evenly, every later
one is an edit of the one before, made from the sums, in which few slots move.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import free_name, prepare, scratch_path, stage

SLOTS = 4096
HOT_SHARE = 0.02
MAP = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("shard", T.IntegerType()),
                    T.StructField("bytes", T.LongType())])


def record_size(text):
    """UTF-8 bytes of the text (null: none) plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def with_slots(docs: DataFrame, shards: int, name: str, slots: int = SLOTS, hot_share: float = HOT_SHARE) -> DataFrame:
    """``docs (doc_id, text)``, all columns, with the virtual slot of each row in the column
    ``name``. Texts are not shuffled; a null text counts as empty, as one text with it."""
    h, no, hot_mark = (free_name(docs, x) for x in ("text_hash", "running_no", "hot_text"))
    text = F.col("text").cast("string")
    marked = docs.withColumn(h, F.xxhash64(F.coalesce(text, F.lit("")))).withColumn(no, F.monotonically_increasing_id())
    sized = marked.select(F.col(h).alias("h"), record_size(text).alias("size"))
    total, rows = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    # at most 2 * shards / hot_share texts can be so frequent: a proven bound for the broadcast
    hot = (sized.groupBy("h").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
           .where((F.col("w") > total * hot_share / shards) | (F.col("n") > rows * hot_share / shards))
           .select(F.col("h").alias(h), F.lit(True).alias(hot_mark)))
    key = F.when(F.col(hot_mark), F.xxhash64(h, no)).otherwise(F.xxhash64(h, F.lit("slot")))
    return marked.join(F.broadcast(hot), h, "left").withColumn(name, F.pmod(key, F.lit(slots)).cast("int")).drop(h, no, hot_mark)


def to_slots(docs: DataFrame, shards: int, slots: int = SLOTS, hot_share: float = HOT_SHARE) -> DataFrame:
    """``docs (doc_id, text)`` as ``(doc_id, size, text_crc32, virtual_slot)``; a null doc_id is a
    value like any other."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_slots(slim, shards, "virtual_slot", slots, hot_share).select(
        "doc_id", record_size(F.col("text")).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), "virtual_slot")


def slot_bytes(placed: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of every slot, 0 for empty ones: ``slots`` numbers whatever the input."""
    sums = dict(placed.groupBy("virtual_slot").agg(F.sum("size")).collect())
    return [int(sums.get(s, 0)) for s in range(slots)]


def even_map(slots: int, shards: int) -> list[tuple[int, int, int]]:
    """``(slot, shard, bytes)``: the slots dealt out in turn, before any bytes are known."""
    return [(slot, slot % shards, 0) for slot in range(slots)]


def new_map(weights: list[int], shards: int) -> list[tuple[int, int, int]]:
    """A map from scratch: slots from the largest on, each to the lightest shard."""
    heap, out = [(0, s) for s in range(shards)], []
    for slot in sorted(range(len(weights)), key=lambda s: (-weights[s], s)):
        load, shard = heapq.heappop(heap)
        out.append((slot, shard, weights[slot]))
        heapq.heappush(heap, (load + weights[slot], shard))
    return sorted(out)


def _loads(owner: dict[int, int], weights: list[int], shards: int) -> list[int]:
    loads = [0] * shards
    for slot, shard in owner.items():
        loads[shard] += weights[slot]
    return loads


def rebalance(old: list[tuple[int, int, int]], weights: list[int], shards: int,
              tolerance: float = 0.001) -> list[tuple[int, int, int]]:
    """The old map edited for new weights: slots move one by one from the heaviest shard to
    the lightest, the largest that narrows their gap, until the heaviest is within
    ``tolerance`` of the mean or no move helps."""
    owner = {slot: shard for slot, shard, _ in old}
    loads, mean = _loads(owner, weights, shards), sum(weights) / shards
    for _ in range(len(weights)):
        src, dst = max(range(shards), key=lambda s: (loads[s], s)), min(range(shards), key=lambda s: (loads[s], s))
        fits = [s for s, at in owner.items() if at == src and 0 < weights[s] < loads[src] - loads[dst]]
        if loads[src] <= mean * (1 + tolerance) or not fits:
            break
        slot = max(fits, key=lambda s: (min(weights[s], loads[src] - loads[dst] - weights[s]), -s))
        owner[slot] = dst
        loads[src], loads[dst] = loads[src] - weights[slot], loads[dst] + weights[slot]
    return [(slot, owner[slot], weights[slot]) for slot in sorted(owner)]


def grow(old: list[tuple[int, int, int]], weights: list[int], shards: int) -> list[tuple[int, int, int]]:
    """The old map edited for one more shard, number ``shards``: slots move only into it,
    from the shard that is heaviest at the time, up to its fair share."""
    owner = {slot: shard for slot, shard, _ in old}
    loads, goal, got = _loads(owner, weights, shards), sum(weights) / (shards + 1), 0
    own = {s: sorted((x for x, at in owner.items() if at == s), key=lambda x: (weights[x], -x)) for s in range(shards)}
    while got < goal:
        src = max(range(shards), key=lambda s: (loads[s], -s))
        while own[src] and got + weights[own[src][-1]] > goal + max(1, goal // 1000):
            own[src].pop()  # too large to move at all
        if not own[src]:
            break
        slot = own[src].pop()
        owner[slot] = shards
        loads[src] -= weights[slot]
        got += weights[slot]
    return [(slot, owner[slot], weights[slot]) for slot in sorted(owner)]


def write_map(spark: SparkSession, path: str, version: int, rows: list[tuple[int, int, int]]) -> None:
    """Store a version of the map under ``path``; a version is never written twice."""
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The map of a version, the latest if none is given."""
    maps = spark.read.schema(T.StructType([*MAP.fields, T.StructField("version", T.IntegerType())])).parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version).select("slot", "shard", "bytes")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of the map stored under ``path``, in order; none where there is no map."""
    try:
        stored = spark.read.schema(T.StructType([*MAP.fields, T.StructField("version", T.IntegerType())])).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(r[0] for r in stored.select("version").distinct().collect())


def stored_rows(spark: SparkSession, path: str, version: int) -> list[tuple[int, int, int]]:
    return sorted(tuple(r) for r in read_map(spark, path, version).collect())


def update_map(spark: SparkSession, path: str, weights: list[int], shards: int) -> int:
    """Bring the map under ``path`` up to ``shards`` and the slots' ``weights``; its version then.

    Without a map the even one is version 0. A map of fewer shards grows, one shard a version,
    by moves into the new shard alone; then slots move from heavy shards to light ones. What
    changes nothing writes no version. A map of more shards, or of other slots, is an error.
    """
    found = versions(spark, path)
    if not found:
        write_map(spark, path, 0, even_map(len(weights), shards))
        found = [0]
    version, old = found[-1], stored_rows(spark, path, found[-1])
    have = max(shard for _, shard, _ in old) + 1
    if have > shards or len(old) != len(weights):
        raise ValueError(f"the map has {have} shards and {len(old)} slots, not {shards} and {len(weights)}")
    for now in range(have, shards):
        version, old = version + 1, grow(old, weights, now)
        write_map(spark, path, version, old)
    edited = rebalance(old, weights, shards)
    if edited != old:
        version += 1
        write_map(spark, path, version, edited)
    return version


def _balanced(placed: DataFrame, shards: int, slots: int, map_path: str | None) -> DataFrame:
    """The map, as ``(virtual_slot, shard)``, that is right for ``placed (virtual_slot, size)``."""
    spark = placed.sparkSession
    path = map_path or scratch_path(spark, "slot-map")
    version = update_map(spark, path, slot_bytes(placed, slots), shards)
    return read_map(spark, path, version).select(F.col("slot").alias("virtual_slot"), "shard")


def assign(docs: DataFrame, shards: int = 8, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, virtual_slot, shard, slot)`` for each row of ``docs``: the shard
    by the map under ``map_path``, which is read, edited for these bytes and stored as its next
    version (a new map in a scratch folder if no path is given), and ``slot``, the row's place
    in its shard, gapless from 0. Places are counted within virtual slots and offset by the
    sums of the slots before, so no task holds a shard.

    Null and empty texts are one text of size 1; a null doc_id is a value like any other; ties
    of places are broken by doc_id, then text and size; repeated rows get places of their own,
    in any order; very long texts are one record; an empty table gives no rows; other columns
    are ignored.
    """
    if shards < 1 or slots < shards:
        raise ValueError("shards must be at least 1 and slots no fewer")
    prepare(docs.sparkSession)
    placed = stage(to_slots(docs, shards, slots), "slots")
    counts = placed.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n"))
    # one row per slot, at most `slots` of them
    owner = _balanced(placed, shards, slots, map_path).join(
        counts, "virtual_slot", "left").withColumn("before", F.sum(F.coalesce("n", F.lit(0))).over(
            Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (placed.withColumn("at", F.row_number().over(within) - 1)
            .join(F.broadcast(owner.select("virtual_slot", "shard", F.coalesce("before", F.lit(0)).alias("before"))),
                  "virtual_slot")
            .select("doc_id", "size", "text_crc32", "virtual_slot", "shard",
                    (F.col("before") + F.col("at")).cast("long").alias("slot")))


def write_shards(docs: DataFrame, path: str, shards: int = 8, slots: int = SLOTS, tasks: int = 0,
                 map_path: str | None = None) -> None:
    """Write ``docs``, all columns, as Parquet folders ``shard=<n>`` of balanced bytes, by the same
    slots and the same stored map as ``assign``. Each shard is written by several tasks, a
    virtual slot by one, so a shard is never in one task.

    Nulls, ties, repeated rows and long texts are placed as by ``assign``; an empty table writes
    no shard; a column that is named ``virtual_slot`` stays, one named ``shard`` is an error.
    """
    if any(c.lower() == "shard" for c in docs.columns):
        raise ValueError("docs must have no column named shard")
    prepare(docs.sparkSession)
    key = free_name(docs, "virtual_slot")
    marked = stage(with_slots(docs, shards, key, slots), "slotted")
    sizes = marked.select(F.col(key).alias("virtual_slot"), record_size(F.col("text").cast("string")).alias("size"))
    owner = _balanced(sizes, shards, slots, map_path).withColumnRenamed("virtual_slot", key)
    placed = marked.join(F.broadcast(owner), key)
    placed.repartition(tasks or 4 * shards, key).drop(key).write.partitionBy("shard").mode("error").parquet(path)
