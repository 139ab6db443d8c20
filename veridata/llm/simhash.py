"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits. For an even radius ``2k`` two fingerprints within it have a
common variant at ``k`` or fewer flipped bits from each, so every fingerprint emits its
ball of radius ``k``. For an odd radius ``2k + 1`` one differing bit is taken out first:
the bits are read as three overlapping blocks of 22, and for each block the other 42 bits
emit their ball of radius ``k``. Some block holds a differing bit, and outside it at most
``2k`` bits differ. (Whole balls of half the radius rounded up would be 2,081 variants at
radius 3; this is 3 x 43 = 129.) Variants are shuffled, and the fingerprints that meet are
verified by their exact bit distance.

What is shuffled are distinct fingerprints, so a group of copies of any size is one
fingerprint. Of each bucket only a spanning forest of its verified links goes on, never
all its pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, free_name, prepare, stage

SEED = 42
BLOCK = 22
TURNS = (0, 22, 42)  # 0-21, 22-43, 42-63: every bit is in a block


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash, as a signed integer, of the word shingles of a text. Words are runs
    of anything but ASCII white space with A-Z lower-cased; repeats count. A text with
    fewer words than a shingle is one shingle; a text without words or null gives 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(itertools.islice(words, i, None) for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(p, SEED) for p in parts), dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, shingle: int, column: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a long in ``column``."""
    prepare(docs.sparkSession)

    @F.pandas_udf(T.LongType())
    def fp(texts):
        import pandas as pd
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn(column, fp(F.col("text").cast("string")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(fp, radius: int):
    """Array column of the bucket keys that a fingerprint emits for ``radius``."""
    half, odd = divmod(radius, 2)
    low = BLOCK if odd else 0
    flips = [sum(1 << b for b in bits) for n in range(half + 1) for bits in itertools.combinations(range(low, 64), n)]
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in flips])

    def ball(centre):
        return F.transform(masks, lambda m: centre.bitwiseXOR(m))

    if not odd:
        return ball(fp)
    keys = []
    for i, turn in enumerate(TURNS):
        turned = F.shiftrightunsigned(fp, turn).bitwiseOR(F.shiftleft(fp, 64 - turn)) if turn else fp
        centre = turned.bitwiseAND(F.lit(_signed((1 << 64) - (1 << BLOCK)))).bitwiseOR(F.lit(i).cast("long"))
        keys.append(ball(centre))
    return F.concat(*keys)


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints (uint64, distinct) within ``radius``
    bits: one pass over those not yet reached for each fingerprint, O(n) memory."""
    rest, out = fps, []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            u = todo.pop()
            near = np.bitwise_count(rest ^ u) <= radius
            for v in rest[near]:
                out.append((u, v))
                todo.append(v)
            rest = rest[~near]
    return out


def bucket_links(batches, radius: int):
    """Arrow batches ``(key, fp)`` sorted by key -> batches of verified links ``(a, b)``."""
    keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
    known: set[bytes] = set()

    def links(k, f):
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        sizes = np.diff(np.append(starts, len(k)))
        two = starts[sizes == 2]
        a, b = f[two].view(np.uint64), f[two + 1].view(np.uint64)
        near = np.bitwise_count(a ^ b) <= radius
        pairs = [np.stack([a[near], b[near]], 1)]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            group = np.sort(f[s:s + n].view(np.uint64))
            mark = group.tobytes() if n <= 64 else None
            if mark in known:  # the same fingerprints meet at many keys
                continue
            if mark is not None and len(known) < 200_000:
                known.add(mark)
            if found := forest(group, radius):
                pairs.append(np.array(found, np.uint64))
        both = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    for batch in batches:
        k = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        keys = np.concatenate((keys, k))
        fps = np.concatenate((fps, batch.column(1).to_numpy(zero_copy_only=False)))
        end = int(np.argmax(keys == keys[-1]))  # the last bucket may go on
        if end:
            yield links(keys[:end], fps[:end])
            keys, fps = keys[end:], fps[end:]
    if len(keys):
        yield links(keys, fps)


def fingerprint_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links ``(a, b)`` among distinct fingerprints (column ``fp``) at ``radius`` or fewer
    differing bits: enough of them to connect everything that such links connect."""
    keyed = fps.select(F.col("fp"), F.explode(variants(F.col("fp"), radius)).alias("key")).select("key", "fp")
    return (keyed.repartition("key").sortWithinPartitions("key")
            .mapInArrow(lambda it: bucket_links(it, radius), "a long, b long").distinct())


def groups(docs: DataFrame, radius: int) -> DataFrame:
    """``(fp, root, component_id)`` for each fingerprint of ``docs (doc_id, fp)``: the root
    is a fingerprint that names the component, the id is the smallest doc_id in it (null
    where all of these are null)."""
    first = stage(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    found = components(fingerprint_links(first.select("fp"), radius)) if radius else \
        docs.sparkSession.createDataFrame([], "node long, root long")
    rooted = first.join(found, first["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row ``(doc_id, fingerprint, component_id)`` per row of ``docs (doc_id, text)``.

    Null and empty texts have fingerprint zero and are linked like any other; a null
    doc_id keeps its row and never names a component unless all ids there are null;
    repeated rows give repeated rows; an empty table gives none; other columns are ignored.
    """
    if max_bits < 0 or shingle < 1:
        raise ValueError("shingle must be at least 1 and max_bits at least 0")
    fps = stage(with_fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), shingle)
                .select("doc_id", "fp"), "simhash")
    return fps.join(groups(fps, max_bits), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, with one row left of each group of near-duplicates:
    that of the smallest doc_id (null ids last; of repeated rows any one)."""
    fp = free_name(docs, "fp")
    marked = stage(with_fingerprints(docs, shingle, fp), "simhash-docs")
    ids = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"))
    component = groups(ids, max_bits).select("fp", "root")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("fp").alias("f"))
    best = (ids.distinct().join(component, "fp")
            .groupBy("root").agg(F.min(rank).alias("w"))
            .select(F.col("w.d").alias("w_doc"), F.col("w.f").alias("w_fp")))
    kept = marked.join(best, marked[fp].eqNullSafe(best["w_fp"])
                       & marked["doc_id"].cast("long").eqNullSafe(best["w_doc"]), "left_semi")
    return kept.dropDuplicates(["doc_id", fp]).select(*[F.col(f"`{c}`") for c in docs.columns])
