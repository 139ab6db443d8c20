"""Removal of repeated substrings by prefix-free parsing.

A rolling hash runs over the bytes of every text. The trigger of a string of ``length`` bytes
is the place of the smallest hash among its first ``reach`` places (the first of equals), so
equal strings have their trigger at the same place, no string is without one, and phrases,
the stretches between triggers, are bounded (a trigger by the hash's value alone gives
neither). A string is then what lies before its trigger, the end of a phrase, and what
follows, a suffix of the parse.

* **Parse.** Each trigger is one row: the hash of the core, the bytes from the trigger on that
  all of its strings share, and the hash of its context, the bytes that all of its strings
  cover. Texts are not shuffled for it. A trigger whose core occurs once in the corpus has
  no repeated string; one whose whole context repeats has nothing but repeated ones.
* **Corpus order.** What is left are the edges of repeats: one copy of every different context of
  a core that has more than one. A task takes whole cores, sorts the parse suffixes (right
  of the triggers) and the dictionary's phrases from their ends on (left of the triggers), and
  combines both suffix arrays: strings that are neighbours in both, with common prefixes
  long enough, are equal. That is the order of all strings of the corpus, a core at a time.
* **Hot cores.** A core with more than ``most`` different contexts goes another exact way: its
  strings are counted one by one by 128-bit hashes, combined before the shuffle.

Texts go through a shuffle twice, compressed: to the edges, and to the spans found.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stage

LENGTH = 400
ROLL = 16  # bytes under the rolling hash
PIECE = 1 << 19  # bytes that are hashed at once; longer texts go in overlapping pieces
MOST = 20_000  # contexts of one core in a task
BATCH = 4096  # contexts that are put in order at once, if no core has more
CHECK = 4096  # a second hash of the row, modulo this, is kept in ``at``
BASE = np.uint64(0x100000001B3)
MIX = np.uint64(0x9E3779B97F4A7C15)


def reach_of(length: int) -> int:
    return max(1, min(length * 5 // 8, length - ROLL + 1))


def rolling(b: np.ndarray) -> np.ndarray:
    """Polynomial hash of the ``ROLL`` bytes from every place on, by doubling."""
    h, size = b.astype(np.uint64) + np.uint64(1), 1
    with np.errstate(over="ignore"):
        power = BASE
        while size < ROLL:
            h = h[:-size] * power + h[size:]
            power, size = power * power, 2 * size
        return (h ^ (h >> np.uint64(29))) * MIX


def least_of(h: np.ndarray, reach: int) -> np.ndarray:
    """The smallest of every ``reach`` values in a row, by doubling."""
    size = 1
    while 2 * size <= reach:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:len(h) - reach + size], h[reach - size:]) if size < reach else h


def triggers(data: bytes, sizes: list[int], length: int):
    """Of pieces of ``sizes`` bytes that lie end to end in ``data``: for every trigger its place
    there and the first and last place of the strings that it is the trigger of."""
    reach, none = reach_of(length), (np.zeros(0, np.int64),) * 3
    if len(data) < length:
        return none
    h = rolling(np.frombuffer(data, np.uint8))
    place = np.arange(len(h), dtype=np.uint64)
    where = (least_of((h & ~np.uint64(0xFFFFFF)) | place, reach) & np.uint64(0xFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    valid = np.zeros(len(data) + 1, np.int32)  # where a string begins that ends in its piece
    long = np.asarray(sizes) >= length
    np.add.at(valid, (ends - sizes)[long], 1)
    np.add.at(valid, (ends - length + 1)[long], -1)
    starts = np.flatnonzero(np.cumsum(valid)[:-1])
    if not len(starts):
        return none
    at = where[starts]
    cut = np.flatnonzero((at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(starts)])) - 1
    return at[first], starts[first], starts[last]


def _pieces(texts: list[bytes], length: int):
    """Groups of ``(row, offset, piece)`` of about ``PIECE`` bytes; every string of ``length``
    bytes is in just one piece."""
    group, held = [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, PIECE):
            piece = text[at:at + PIECE + length - 1]
            group.append((row, at, piece))
            held += len(piece)
            if held >= PIECE:
                yield group
                group, held = [], 0
    if group:
        yield group


def _signed(hashes: list[int]) -> pa.Array:
    return pa.array(np.array(hashes, np.uint64).view(np.int64))


def _parse(batches, length: int):
    """Rows ``(k, check, text bytes)`` -> rows ``(core, context, k, at)``; ``at`` packs the
    trigger's place, the furthest and nearest beginning before it, and the check."""
    reach = reach_of(length)
    common, digest = length - reach + 1, xxhash.xxh3_64_intdigest
    for given in batches:
        for lo in range(0, given.num_rows, 256):
            batch = given.slice(lo, 256)
            k, check = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for group in _pieces([t or b"" for t in batch.column(2).to_pylist()], length):
                data, sizes = b"".join(p for _, _, p in group), [len(p) for _, _, p in group]
                at, first, last = triggers(data, sizes, length)
                if not len(at):
                    continue
                begin = np.cumsum(sizes) - sizes
                of = np.searchsorted(begin, first, "right") - 1
                row = np.array([r for r, _, _ in group])[of]
                place = at - begin[of] + np.array([o for _, o, _ in group])[of]
                far, near = at - first, at - last
                seed = far * reach + near
                packed = ((place * reach + far) * reach + near) * CHECK + check[row]
                cores = [digest(data[a:a + common]) for a in at.tolist()]
                contexts = [digest(data[a:b], s) for a, b, s in zip(first.tolist(), (last + length).tolist(), seed.tolist())]
                yield pa.RecordBatch.from_arrays([_signed(cores), _signed(contexts), pa.array(k[row]), pa.array(packed)],
                                                 names=["core", "context", "k", "at"])


def unpack(at, reach: int):
    """``at`` as (trigger, furthest, nearest)."""
    at = at // CHECK
    return at // reach // reach, at // reach % reach, at % reach


def _contexts(batches, length: int, hot: bool):
    """Texts with the triggers wanted of them: rows ``(k, check, z, wanted)``, sorted by k. If
    not hot, rows ``(core, k, at, context bytes)``, else ``(x, y, k, check, begin)``, the
    128-bit hash of every string."""
    reach, done = reach_of(length), None
    for given in batches:
        for batch in (given.slice(at, 64) for at in range(0, given.num_rows, 64)):
            rows = []
            for k, check, z, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                if (k, check) == done:
                    continue  # a row alike in id and text
                done = (k, check)
                text = zstandard.decompress(z)
                for one in wanted:
                    if one["hot"] != hot:
                        continue
                    a, far, near = unpack(one["at"], reach)
                    if not hot:
                        rows.append((one["core"], k, one["at"], text[a - far:a - near + length]))
                        continue
                    for p in range(a - far, a - near + 1):
                        h = xxhash.xxh3_128_intdigest(text[p:p + length])
                        rows.append(((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), k, check, p))
            if rows:
                kinds = [pa.int64()] * 5 if hot else [pa.int64()] * 3 + [pa.binary()]
                names = ["x", "y", "k", "check", "begin"] if hot else ["core", "k", "at", "context"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def ordered(strings: list[bytes], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the strings: the rank of each, and the common prefix of each with the
    one before it in that order."""
    order = np.array(sorted(range(len(strings)), key=strings.__getitem__), np.int64)
    wide = int(length.max()) + 1
    codes = np.zeros((len(strings), wide), np.uint8)
    at = np.repeat(np.arange(len(strings)) * wide - (np.cumsum(length) - length), length) + np.arange(length.sum())
    codes.ravel()[at] = np.frombuffer(b"".join(strings), np.uint8)
    codes, size = codes[order], length[order]
    equal = codes[1:] == codes[:-1]
    equal[:, -1] = False
    common = np.minimum(np.argmin(equal, axis=1), np.minimum(size[1:], size[:-1]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, np.concatenate(([0], common))


def equal_strings(contexts: list[bytes], far: np.ndarray, near: np.ndarray, length: int) -> np.ndarray:
    """For every context and distance of a string's beginning to the trigger, whether the string
    occurs in another of the contexts too (contexts x reach)."""
    left = [c[:f][::-1] for c, f in zip(contexts, far.tolist())]
    right = [c[f:] for c, f in zip(contexts, far.tolist())]
    phrase, phrase_common = ordered(left, far)
    suffix, suffix_common = ordered(right, length - near)
    found = np.zeros((len(contexts), reach_of(length)), bool)
    for back in range(int(near.min()), int(far.max()) + 1):
        own = np.flatnonzero((near <= back) & (back <= far))
        # neighbours in both orders: the class of the phrase's end, and that of the parse suffix
        both = (np.cumsum(phrase_common < back)[phrase[own]] * len(contexts)
                + np.cumsum(suffix_common < length - back)[suffix[own]] - 1)
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        again = np.zeros(len(own), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        found[own[again], back] = True
    return found


def _resolve(batches, length: int):
    """Rows ``(core, k, at, context)`` sorted by core -> ranges ``(k, check, begin, end)`` of bytes
    that repeated strings cover."""
    reach = reach_of(length)
    held: list[tuple] = []

    def run():
        rows = {(k, at): context for _, k, at, context in held}
        k, at = (np.array(x, np.int64) for x in zip(*rows))
        trigger, far, near = unpack(at, reach)
        found = equal_strings(list(rows.values()), far, near, length)
        edge = np.zeros((len(found), reach + 2), np.int8)
        edge[:, 1:-1] = found
        edge = np.diff(edge, axis=1)
        (row, low), (_, high) = np.nonzero(edge == 1), np.nonzero(edge == -1)  # runs of distances
        return pa.RecordBatch.from_arrays(
            [pa.array(k[row]), pa.array(at[row] % CHECK), pa.array(trigger[row] - high + 1), pa.array(trigger[row] - low + length)],
            names=["k", "check", "begin", "end"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if len(held) >= BATCH and held[-1][0] != row[0]:
                yield run()
                held = []
            held.append(row)
    if held:
        yield run()


def _cut(batches):
    """Rows ``(doc_id, z, ranges)`` -> rows ``(doc_id, n_bytes, spans, kept)``."""
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    for given in batches:
        for batch in (given.slice(at, 64) for at in range(0, given.num_rows, 64)):
            sizes, spans, kept = [], [], []
            for z, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text, merged = zstandard.decompress(z), []
                for one in sorted(ranges or [], key=lambda r: r["begin"]):
                    if merged and one["begin"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], one["end"])
                    else:
                        merged.append(one)
                edges = [0, *chain.from_iterable((m["begin"], m["end"]) for m in merged), len(text)]
                sizes.append(len(text))
                spans.append(merged)
                kept.append(b"".join(text[lo:hi] for lo, hi in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"])


def _packed(batches):
    """Rows ``(k, check, doc_id, text bytes)`` with the text compressed, null as empty."""
    pack = zstandard.ZstdCompressor(level=3)
    for given in batches:
        for batch in (given.slice(at, 256) for at in range(0, given.num_rows, 256)):
            z = [pack.compress(t or b"") for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(z, pa.binary())], names=["k", "check", "doc_id", "z"])


def judged(rows: DataFrame, length: int, most: int) -> DataFrame:
    """Triggers with a repeated core, ``(core, k, at, whole, send, hot)``: ``whole`` where all of the
    context repeats, ``send`` where its bytes must be compared with others'."""
    parsed = rows.select("k", "check", "text").mapInArrow(
        lambda it: _parse(it, length), "core long, context long, k long, at long")
    # written first, as the next join can only split a hot core if no aggregation is part of it
    cores = stage(parsed.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("low"), F.max("context").alias("high"))
                  .where("n > 1").select("core", (F.col("low") != F.col("high")).alias("mixed")), "cores")
    again = stage(parsed.join(cores, "core"), "repeated-cores")
    mixed = again.where("mixed")
    place = F.xxhash64("k", "at")
    contexts = stage(mixed.groupBy("core", "context").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one")), "contexts")
    hot = stage(contexts.groupBy("core").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most)
                .select("core", F.lit(True).alias("hot")), "hot-cores")
    marked = mixed.join(contexts, ["core", "context"]).select(
        "core", "k", "at", (F.col("n") > 1).alias("whole"), ((F.col("n") == 1) | (place == F.col("one"))).alias("send"))
    marked = marked.join(hot, "core", "left") if hot.limit(1).count() else marked.withColumn("hot", F.lit(False))
    even = again.where("not mixed").select("core", "k", "at", F.lit(True).alias("whole"), F.lit(False).alias("send"),
                                           F.lit(False).alias("hot"))
    return stage(even.union(marked.select("core", "k", "at", "whole", "send", F.coalesce("hot", F.lit(False)).alias("hot"))),
                 "judged")


def remove_repeats(docs: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` for every row of ``docs (doc_id, text)``: the UTF-8 bytes
    of the text without each byte that a string of ``length`` bytes covers which begins at
    another place of the corpus too, the same text included, and the maximal runs removed
    as ``spans`` of ``begin`` and ``end``. Strings lie within one text, may overlap, and are
    judged on the whole input.

    Null and empty texts have no bytes; a null doc_id keeps its row; repeated rows are texts
    of their own, so each repeats the others; very long texts are hashed in overlapping
    pieces; an empty table gives an empty one; other columns are ignored. Hashes of 128
    bits (core and context together) stand for whole contexts.
    """
    if length < 2 * ROLL or most < 1:
        raise ValueError(f"length must be at least {2 * ROLL} and most at least 1")
    prepare(docs.sparkSession)
    reach = reach_of(length)
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(F.xxhash64(doc, text).alias("k"),
                       F.pmod(F.xxhash64(F.lit("row"), text, doc), F.lit(CHECK)).alias("check"), doc.alias("doc_id"),
                       text.cast("binary").alias("text"))
    texts = rows.mapInArrow(_packed, "k long, check long, doc_id long, z binary")
    found = judged(rows, length, most)
    check = F.pmod("at", F.lit(CHECK)).alias("check")
    sent = stage(found.where("send").groupBy("k", check).agg(F.collect_list(F.struct("at", "core", "hot")).alias("wanted")), "sent")
    asked = texts.select("k", "check", "z").join(sent, ["k", "check"]).select("k", "check", "z", "wanted")
    edges = (asked.mapInArrow(lambda it: _contexts(it, length, False), "core long, k long, at long, context binary")
             .repartition("core").sortWithinPartitions("core")
             .mapInArrow(lambda it: _resolve(it, length), "k long, check long, begin long, end long"))
    trigger, far, near = (F.expr(f"at div {CHECK * reach ** i}") for i in (2, 1, 0))
    far, near = F.pmod(far, F.lit(reach)), F.pmod(near, F.lit(reach))
    whole = found.where("whole").select("k", check, (trigger - far).alias("begin"), (trigger - near + length).alias("end"))
    ranges = whole.union(edges)
    if found.where("hot").limit(1).count():
        strings = stage(asked.mapInArrow(lambda it: _contexts(it, length, True), "x long, y long, k long, check long, begin long"),
                        "hot-strings")
        twice = strings.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x", "y")
        ranges = ranges.union(strings.join(twice, ["x", "y"]).select("k", "check", "begin", (F.col("begin") + length).alias("end")))
    cuts = stage(ranges.groupBy("k", "check").agg(F.collect_list(F.struct("begin", "end")).alias("ranges")), "cuts")
    return texts.join(cuts, ["k", "check"], "left").select("doc_id", "z", "ranges").mapInArrow(
        _cut, "doc_id long, n_bytes long, spans array<struct<begin: bigint, end: bigint>>, kept binary")
