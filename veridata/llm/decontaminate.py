"""Benchmark decontamination by the q-gram lemma.

Texts are normalised (lower case, runs of anything but letters and digits to one space). A
window of ``w`` characters of a benchmark text that occurs in a document with ``k`` edits
or fewer shares at least ``w + 1 - q - q k`` of its q-grams with it, and these lie on
diagonals (document position less benchmark position) that are at most ``k`` apart. So
shared q-grams are counted by (benchmark text, diagonal band); bands are ``2 (k + 1)`` wide
and overlap by half, so that one of them holds such diagonals whole. Windows that meet the bound are verified by
alignment within the band.

Documents are scanned once, whole, in pieces that overlap by more than a match, against a
bitmap of all benchmark q-grams (2^26 bits at most). Stretches that are dense enough in them
are written down; then they meet the benchmark in blocks of a set size, whose q-gram indexes
are built in the tasks. No benchmark text passes through the driver.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, prepare, stage

Q = 8
WINDOW = 100
STEP = 1
EDIT_RATE = 0.08
BLOCK_CHARS = 1_000_000
ITEM_PIECE = 100_000
PIECE = 1_000_000
GROUP_CHARS = 16_000_000
MAX_BITS = 26
CHUNK = 1024
WORDS = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return WORDS.sub(" ", (text or "").lower()).strip()


def windows(length: int, window: int = WINDOW, step: int = STEP) -> list[tuple[int, int]]:
    """``(start, size)`` of the windows of a benchmark text: every ``step`` and the last;
    a text shorter than a window is one window."""
    size = min(length, window)
    return [(s, size) for s in sorted({*range(0, length - size + 1, step), length - size})]


def budget(size: int, rate: float = EDIT_RATE, q: int = Q) -> int:
    """Edits allowed in a window: the rate's, but so many at most that the lemma's bound
    stays positive."""
    return max(0, min(int(rate * size), (size - q) // q if size >= q else 0))


def need(size: int, rate: float = EDIT_RATE, q: int = Q) -> int:
    """Q-grams that a window of ``size`` characters shares at least with a match."""
    return size + 1 - q - q * budget(size, rate, q)


def band_edits(patterns: np.ndarray, texts: np.ndarray, most: int) -> np.ndarray:
    """Fewest edits of each row of ``patterns`` (n x m) against a stretch of its row of ``texts``
    (n x (m + width - 1)) along ``width`` diagonals; ``most + 1`` where there are more.
    A cell of a row of the band is ``(pattern place, diagonal)``; the alignment may begin and
    end on any diagonal. All rows advance together; those beyond ``most`` drop out."""
    n, m = patterns.shape
    width = texts.shape[1] - m + 1
    out = np.full(n, most + 1, np.int64)
    ramp = np.arange(width, dtype=np.int32)
    cost, live = np.zeros((n, width), np.int32), np.arange(n)
    for i in range(m):
        new = cost + (texts[:, i:i + width] != patterns[:, i:i + 1])
        np.minimum(new[:, :-1], cost[:, 1:] + 1, out=new[:, :-1])
        cost = np.minimum.accumulate(new - ramp, axis=1) + ramp
        if i % 16 == 15:
            keep = cost.min(axis=1) <= most
            if not keep.all():
                cost, patterns, texts, live = cost[keep], patterns[keep], texts[keep], live[keep]
            if not len(live):
                return out
    out[live] = np.minimum(cost.min(axis=1), most + 1)
    return out


def holds(text: np.ndarray, part: np.ndarray) -> bool:
    """Whether ``text`` holds ``part`` as it is."""
    raw, sought, at = text.tobytes(), part.tobytes(), -1
    while (at := raw.find(sought, at + 1)) >= 0:
        if at % part.itemsize == 0:
            return True
    return False


def _hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Rolling 64-bit hashes of all q-grams, by doubling."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    out, width = None, 0
    part = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x7F4A7C15)
    size, bits = 1, q
    while bits:
        if bits & 1:
            tail = part
            if out is None:
                out, width = tail, size
            else:
                n = min(len(out), len(tail) - width)
                out = out[:n] * np.uint64(0xD6E8FEB86659FD93) + tail[width:width + n]
                width += size
        bits >>= 1
        if bits:
            part = part[:-size] * np.uint64(0xC2B2AE3D27D4EB4F | (size << 1)) + part[size:]
            size *= 2
    out = out ^ (out >> np.uint64(31))
    return out * np.uint64(0x94D049BB133111EB)


class Sieve:
    """Which stretches of a document are dense in benchmark q-grams, by a bitmap of their hashes."""

    def __init__(self, bits: np.ndarray, shift: int, sizes: list[int], q: int, rate: float):
        self.bits, self.shift, self.q = bits, np.uint64(shift), q
        self.least = min(need(s, rate, q) for s in sizes)
        most = max(budget(s, rate, q) for s in sizes)
        self.span = max(sizes) + most
        self.margin = self.span + 4 * most + q

    def stretches(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """``(start, end)`` of the stretches that hold every possible match."""
        slot = _hashes(codes, self.q) >> self.shift
        at = np.flatnonzero((self.bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1))
        n = self.least
        if len(at) < n:
            return []
        full = np.flatnonzero(at[n - 1:] - at[:len(at) - n + 1] <= self.span)
        if not len(full):
            return []
        low, high = np.maximum(at[full] - self.margin, 0), at[full] + self.margin + self.q
        new = np.append(True, low[1:] > high[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:] - 1, len(full) - 1)
        return [(int(a), int(min(b, len(codes)))) for a, b in zip(low[first], high[last])]


class Index:
    """Q-grams of a block of benchmark texts, or of pieces that begin at ``bases`` in their texts."""

    def __init__(self, items: list[tuple[int, str]], q: int, window: int, step: int, rate: float, bases: list[int] | None = None):
        self.base = np.array([0] * len(items) if bases is None else bases, np.int64)
        self.q, self.items = q, [(i, np.frombuffer(t.encode("utf-32-le"), np.uint32)) for i, t in items]
        self.windows = [windows(len(c), window, step) if len(c) >= q else [] for _, c in self.items]
        sizes = [ws[0][1] if ws else 0 for ws in self.windows]
        self.half = np.array([budget(s, rate, q) + 1 for s in sizes], np.int64)
        self.need = np.array([need(s, rate, q) if s else 1 for s in sizes], np.int64)
        self.margin = max([5 * budget(s, rate, q) + s + q for s in sizes], default=1)
        grams = [_hashes(c, q) for _, c in self.items]
        all_ = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(all_, kind="stable")
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else item
        self.item, self.place = item[order], place[order]
        self.keys, self.first, self.count = np.unique(all_[order], return_index=True, return_counts=True)
        self.least = min((int(n) for n, s in zip(self.need, sizes) if s), default=1)
        self.span = max((s + budget(s, rate, q) for s in sizes), default=1)
        self.shift = np.uint64(64 - min(24, max(16, (16 * len(self.keys)).bit_length())))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[(self.keys >> self.shift).astype(np.int64)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(item, document place, item place)`` of the shared q-grams in dense stretches."""
        none = (np.empty(0, np.int64),) * 3
        h = _hashes(codes, self.q)
        at = np.flatnonzero(self.bits[(h >> self.shift).view(np.int64)])
        if not len(self.keys) or len(at) < self.least:
            return none
        slot = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[slot] == h[at]
        at, slot, n = at[same], slot[same], self.least
        full = np.flatnonzero(at[n - 1:] - at[:max(0, len(at) - n + 1)] <= self.span)
        if not len(full):
            return none
        # from the first hit of each dense stretch to the last one within the span
        last = np.searchsorted(at, at[full] + self.span, side="right")
        marks = np.bincount(full, minlength=len(at) + 1) - np.bincount(last, minlength=len(at) + 1)
        keep = np.cumsum(marks)[:-1] > 0
        at, slot = at[keep], slot[keep]
        count = self.count[slot]
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        post = np.repeat(self.first[slot], count) + within
        return self.item[post], np.repeat(at, count), self.place[post]

    def matches(self, codes: np.ndarray, left: int = 0) -> list[tuple[int, int, int, int, int]]:
        """``(item number, window start, document place, shared q-grams, edits)``: the best verified
        window of each item. ``left`` is the place of ``codes`` in the document; bands start at
        multiples of their step in the document, so that the cut does not matter."""
        items, at, place = self.hits(codes)
        if not len(items):
            return []
        # a diagonal lies in two bands, each two parts wide; a band starts at a part with hits or the one before
        part = np.floor_divide(at + left - place - self.base[items], self.half[items])
        low = part.min() - 1
        wide = part.max() - low + 2
        key = items * wide + (part - low)
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        parts, ends = key[first], np.append(first[1:], len(key))
        joined = np.append(parts[1:] == parts[:-1] + 1, False)  # `wide` leaves gaps between items
        stop = np.where(joined, np.append(ends[1:], 0), ends)
        least = self.need[parts // wide]
        bands: dict[int, list] = {}
        for n in np.flatnonzero(stop - first >= least):
            i, band = divmod(int(parts[n]), int(wide))
            counted = bands.setdefault(i, [])
            if ends[n] - first[n] >= least[n] and not (n and joined[n - 1]):
                counted.append((band + int(low) - 1, np.unique(place[first[n]:ends[n]])))
            counted.append((band + int(low), np.unique(place[first[n]:stop[n]])))
        found = [self._verified(i, counted, codes, left) for i, counted in sorted(bands.items())]
        return [f for f in found if f]

    def _verified(self, i: int, counted: list, codes: np.ndarray, left: int):
        """The best window of a benchmark text: fewest edits, then the first, then the first band."""
        half, least, pattern = int(self.half[i]), int(self.need[i]), self.items[i][1]
        size, base = self.windows[i][0][1], int(self.base[i])
        starts = np.array([s for s, _ in self.windows[i]], np.int64)
        rows = []
        for band, shared in counted:
            n = np.searchsorted(shared, starts + size - self.q + 1) - np.searchsorted(shared, starts)
            at = np.flatnonzero(n >= least)
            rows.append(np.stack([starts[at], np.full(len(at), base + band * half), n[at]], axis=1))
        rows = np.concatenate(rows)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        width = 2 * half
        # a window without edits has all its q-grams on one diagonal
        for start, diagonal, n in rows[rows[:, 2] == size - self.q + 1].tolist():
            low = start + diagonal - left
            if holds(codes[max(0, low):max(0, low + size + width - 1)], pattern[start:start + size]):
                return int(i), start + base, max(0, start + diagonal), n, 0
        best = None
        steps, reach = np.arange(size), np.arange(size + width - 1)
        for c in range(0, len(rows), CHUNK):
            some = rows[c:c + CHUNK]
            place = (some[:, 0] + some[:, 1] - left)[:, None] + reach
            inside = (place >= 0) & (place < len(codes))
            texts = np.where(inside, codes[np.clip(place, 0, len(codes) - 1)], np.uint32(0xFFFFFFFF))
            edits = band_edits(pattern[some[:, :1] + steps], texts, half - 1)
            n = int(np.argmin(edits))
            if edits[n] < half and (best is None or edits[n] < best[-1]):
                start, diagonal, shared = some[n].tolist()
                best = int(i), start + base, max(0, start + diagonal), shared, int(edits[n])
        return best

def _item_pieces(benchmark: DataFrame, q: int, window: int, step: int) -> DataFrame:
    """``(item_id, key, base, size, text)``: distinct normal texts, cut after ``ITEM_PIECE``
    characters so that every window lies in one piece; ``key`` tells the texts of an id apart,
    ``base`` is the piece's place and ``size`` the window's length."""
    width = step * max(1, ITEM_PIECE // step)

    def run(batches):
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = normal(t)
                if len(text) < q:
                    continue
                key = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)
                size = min(len(text), window)
                last = len(text) - size
                for base in range(0, last + 1, width):
                    end = len(text) if base + width > last else base + width - step + size
                    rows.append((-1 if i is None else i, key, base, size, text[base:end]))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in enumerate(kinds)],
                                             names=["item_id", "key", "base", "size", "text"])

    texts = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t"))
    return texts.mapInArrow(run, "item_id long, key long, base long, size long, text string").distinct()


def _sieve(pieces: DataFrame, chars: int, sizes: list[int], q: int, rate: float) -> Sieve:
    """The bitmap is put together by 64-bit words; 2^20 words at most reach the driver."""
    shift = 64 - min(MAX_BITS, max(16, (64 * chars).bit_length()))

    def run(batches):
        for batch in batches:
            grams = [_hashes(np.frombuffer(t.encode("utf-32-le"), np.uint32), q) for t in batch.column(0).to_pylist()]
            slots = np.unique(np.concatenate([*grams, np.empty(0, np.uint64)]) >> np.uint64(shift))
            words, first = np.unique(slots >> np.uint64(6), return_index=True)
            marks = np.uint64(1) << (slots & np.uint64(63))
            bits = np.bitwise_or.reduceat(marks, first) if len(first) else marks
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(bits.view(np.int64))],
                                             names=["word", "bits"])

    found = pieces.select("text").mapInArrow(run, "word long, bits long").groupBy("word").agg(
        F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << max(0, 64 - shift - 6), np.uint64)
    bits[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return Sieve(bits, shift, sizes, q, rate)


def _dense(inputs: DataFrame, sieve, kind: str) -> DataFrame:
    """``(row, doc_id, start, text, carried_)``: the dense stretches of normal texts.
    ``row`` numbers the input rows; the result is to be written before it is used twice."""
    names = ["row", "doc_id", "start", "text", "carried_"]

    def run(batches):
        s, row = sieve.value, TaskContext.get().partitionId() << 33
        overlap = 2 * s.margin
        for batch in batches:
            texts, source, out = batch.column(1), [], []
            for r in range(batch.num_rows):
                row += 1
                codes = np.frombuffer(normal(texts[r].as_py()).encode("utf-32-le"), np.uint32)
                for left in range(0, max(1, len(codes) - overlap), PIECE):
                    for a, b in s.stretches(codes[left:left + PIECE + overlap]):
                        out.append((row, left + a, codes[left + a:left + b].tobytes().decode("utf-32-le")))
                        source.append(r)
            if out:
                kept = batch.take(pa.array(source))
                row_, start, text = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(row_, pa.int64()), kept.column(0), pa.array(start, pa.int64()),
                                                  pa.array(text, pa.string()), kept.column(2)], names=names)

    return inputs.mapInArrow(run, f"row long, doc_id long, start long, text string, carried_ {kind}")


def matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, window: int = WINDOW, step: int = STEP,
            edit_rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS, extra: list[str] | None = None) -> DataFrame:
    """``(doc_id, item_id, window_start, doc_start, shared_qgrams, edits)``: for each row of
    ``docs (doc_id, text)`` and each benchmark text of which it holds a window within the
    edit budget, the window with the fewest edits (then the first, then the first place). Places
    count characters of normalised texts; ``doc_start`` is where the window's band begins, so the
    aligned stretch begins there or up to twice the edit budget and one later.

    Windows begin at every ``step`` characters and at the last place. Null and empty texts match
    nothing, nor do benchmark texts of fewer than ``q`` characters after normalising; texts of any
    length are used whole; a null doc_id stays null, a null item_id is -1; repeated rows give
    repeated matches, repeated benchmark rows one; empty tables give none; other columns are
    ignored (``extra`` names columns of ``docs`` to carry).
    """
    if q < 2 or step < 1 or window < q or not 0 <= edit_rate < 1:
        raise ValueError("q must be at least 2, window at least q, step at least 1, edit_rate in [0, 1)")
    spark = prepare(docs.sparkSession)
    carry = list(extra or [])
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(0)
    inputs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         carried.alias("carried_"))
    names = ["doc_id", "item_id", "window_start", "doc_start", "shared_qgrams", "edits"]
    kind = inputs.schema["carried_"].dataType.simpleString()
    pieces = stage(_item_pieces(benchmark, q, window, step), "benchmark-pieces")
    chars, sizes = pieces.agg(F.sum(F.length("text")), F.collect_set("size")).first()  # sizes: `window` at most
    if not sizes:
        return spark.createDataFrame([], ", ".join([f"{n} long" for n in names] + [
            f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]))
    sieve = spark.sparkContext.broadcast(_sieve(pieces, chars, sizes, q, edit_rate))
    dense = stage(_dense(inputs, sieve, kind), "benchmark-stretches")
    count, length = dense.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = 1 + chars // block_chars
    groups = max(1, 1 + length // GROUP_CHARS, min(count, 2 * spark.sparkContext.defaultParallelism))

    def run(left, right):
        ids, keys, bases = (right.column(c).to_pylist() for c in ("item_id", "key", "base"))
        index = Index(list(enumerate(right.column("text").to_pylist())), q, window, step, edit_rate, bases)
        rows, source = [], []
        texts, starts = left.column("text"), left.column("start").to_pylist()
        for r, at in enumerate(starts):
            codes = np.frombuffer(texts[r].as_py().encode("utf-32-le"), np.uint32)
            for i, start, place, n, edits in index.matches(codes, at):
                rows.append((ids[i], keys[i], edits, start, place, n))
                source.append(r)
        kept = left.select(["row", "doc_id", "carried_"]).take(pa.array(source, pa.int64()))
        found = [pa.array([row[c] for row in rows], pa.int64()) for c in range(6)]
        return pa.Table.from_arrays([*kept.columns[:2], *found, kept.column(2)], names=[
            "row", "doc_id", "item_id", "key", "edits", "window_start", "doc_start", "shared_qgrams", "carried_"])

    block, part = F.pmod(F.xxhash64("key", "base"), F.lit(blocks)), F.pmod(F.xxhash64("row", "start"), F.lit(groups))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    here = dense.withColumn("part_", part.cast("long")).withColumn("block_", each(blocks))
    there = pieces.withColumn("block_", block.cast("long")).withColumn("part_", each(groups))
    found = here.groupBy("block_", "part_").cogroup(there.groupBy("block_", "part_")).applyInArrow(
        run, "row long, doc_id long, item_id long, key long, edits long, window_start long, doc_start long, "
             f"shared_qgrams long, carried_ {kind}")
    best = F.min(F.struct("edits", "window_start", "doc_start", "shared_qgrams")).alias("best_")
    one = found.groupBy("row", "item_id", "key").agg(best, F.any_value("doc_id").alias("doc_id"),
                                                     F.any_value("carried_").alias("carried_"))
    return one.select("doc_id", "item_id", *[F.col(f"best_.{n}").alias(n) for n in names[2:]],
                      *[F.col(f"carried_.`{c}`") for c in carry])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, without the rows that hold a benchmark passage (see ``matches``)."""
    row = free_name(docs, "row_key")
    key = F.struct(F.xxhash64("doc_id", "text").alias("x"), F.xxhash64(F.lit("row"), "text", "doc_id").alias("y"))
    marked = docs.withColumn(row, key)
    bad = stage(matches(marked, benchmark, extra=[row], **options).select(row).distinct(), "contaminated")
    return marked.join(bad, row, "left_anti").drop(row)
