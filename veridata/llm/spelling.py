"""Spelling variants: words one edit apart, grouped under their frequent form.

A word becomes the vector of its letter-group counts (26 groups: code point modulo 26, each
count modulo 256, so a vector is 26 bytes; the groups whose counts vary most come first). One inserted, deleted or replaced code point
changes the vector by a surplus of one in a group, a deficit of one in a group, or both. The
words are arranged in a trie by successive counts; a depth-first search follows equal counts
for free and spends a budget of one surplus and one deficit. It looks for the partner whose
first differing count is the larger one, so every pair of different vectors is met once.
Words at the leaves are verified code point by code point.

On the cluster the first levels of the trie are the shuffle key: a word is a point in the
bucket of its own first counts and asks in every bucket that the budget can reach from
there. The key takes as many counts as it needs for buckets of a bounded number of points;
where eight are not enough, the points of a bucket are dealt into parts and its questions
go to every part. Tasks search the tries of many small buckets at once, in arrays.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stage

GROUPS = 26
DEEPEST = 8  # counts in the shuffle key at most
MOST = 20_000  # points of a bucket that meet in one task
CHUNK = 60_000  # rows that one search takes
FRONTIER = 400_000  # node pairs of the search that are expanded at once
PAIRS = 400_000  # word pairs that are verified at once
WIDE = 64  # code points of a word that is verified in arrays
HELD = 200_000  # words counted by a worker before it passes them on


def _occurrences(batches, run: re.Pattern, thin: int, least: int):
    """Rows ``(doc_id, text bytes)`` -> rows ``(word, n)``."""
    def rows(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                          names=["word", "n"])

    total: Counter = Counter()
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            some = batch.slice(at, 64)
            for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                seed = zlib.crc32(b"%d:" % doc if doc is not None else b":")
                for word, n in Counter(run.findall((text or b"").lower().decode("utf-8", "replace"))).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % thin == 0:
                        cut = h % len(word)
                        word = word[:cut] + word[cut + 1:]
                        if len(word) < least:
                            continue
                    total[word] += n
            if len(total) > HELD:
                yield rows(total)
                total.clear()
    if total:
        yield rows(total)


def vocabulary(docs: DataFrame, thin: int = 31, least: int = 7, twice: int = 2) -> DataFrame:
    """Words ``(word, n)`` of ``docs (doc_id, text)`` with ``least`` code points or more and
    ``twice`` occurrences or more. Words are maximal runs of ``A-Z a-z U+00C0-U+00FF`` with
    A-Z lower-cased; where ``thin`` divides the crc32 of ``<doc_id>:<word>``, the code point at
    the crc32 modulo the length is left out. A null doc_id is written as nothing."""
    prepare(docs.sparkSession)
    run = re.compile(r"[a-zÀ-ÿ]{%d,}" % least)  # on lower-cased text; shorter runs are no words
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(
        lambda it: _occurrences(it, run, thin, least), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and the words' lengths."""
    return (np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32),
            np.array([len(w) for w in words], np.int64))


def vectors(words: list[str], order: list[int] | None = None) -> np.ndarray:
    """Letter-group counts of the words, modulo 256 (words x 26, uint8), in the groups' order."""
    codes, length = _codes(words)
    at = np.repeat(np.arange(len(words)) * GROUPS, length) + codes % GROUPS
    counts = np.bincount(at, minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype(np.uint8)
    return counts if order is None else counts[:, order]


def group_order(words: DataFrame) -> list[int]:
    """The 26 groups from that of the most varied counts on: sums over all words, 26 rows."""
    def sums(batches):
        total = np.zeros((3, GROUPS))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                v = vectors(batch.column(0).slice(at, 4096).to_pylist()).astype(float)
                total += [np.full(GROUPS, len(v)), v.sum(axis=0), (v * v).sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(GROUPS)), *map(pa.array, total)], names=["g", "n", "s", "ss"])

    rows = (words.select("word").mapInArrow(sums, "g long, n double, s double, ss double")
            .groupBy("g").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).collect())
    spread = {r["g"]: r["ss"] / r["n"] - (r["s"] / r["n"]) ** 2 for r in rows if r["n"]}
    return sorted(range(GROUPS), key=lambda g: (-round(spread.get(g, 0.0), 9), g))


def _keys(batches, order: list[int], depth: int):
    """Rows ``(word, n)`` -> rows ``(bucket)``: the first counts of every word."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([_bytes(vectors(batch.column(0).to_pylist(), order)[:, :depth])], names=["bucket"])


def _bytes(rows: np.ndarray) -> pa.Array:
    """Rows of uint8 as binary values."""
    flat = pa.py_buffer(np.ascontiguousarray(rows).tobytes())
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, flat]).cast(pa.binary())


def reach(depth: int) -> list[tuple[int, ...]]:
    """Changes of the first ``depth`` counts that the budget allows, the first of them a surplus."""
    out = [(0,) * depth]
    for i in range(depth):
        step = [0] * depth
        step[i] = 1
        out.append(tuple(step))
        for j in range(i + 1, depth):
            step[j] = -1
            out.append(tuple(step))
            step[j] = 0
    return out


def _emit(batches, order: list[int], depth: int):
    """Rows ``(word, n)`` -> rows ``(bucket, asks, word, n)``: one point, and one question in
    every bucket within reach."""
    steps = np.array(reach(depth), np.int64).astype(np.uint8)
    for given in batches:
        for at in range(0, given.num_rows, 4096):
            batch = given.slice(at, 4096)
            v = vectors(batch.column(0).to_pylist(), order)[:, :depth]
            visits = np.concatenate([v[:, None], v[:, None] + steps], axis=1).reshape(-1, depth)
            row = pa.array(np.repeat(np.arange(len(v)), len(steps) + 1))
            asks = np.tile(np.arange(len(steps) + 1) > 0, len(v))
            yield pa.RecordBatch.from_arrays(
                [_bytes(visits), pa.array(asks), batch.column(0).take(row),
                 batch.column(1).take(row)], names=["bucket", "asks", "word", "n"])


class Trie:
    """Rows of counts in lexicographic order; a node of a level is a run of rows that agree up
    to it. ``key[d]`` is parent * 256 + count of the nodes of level d, ascending."""

    def __init__(self, rows: np.ndarray):
        self.order = np.lexsort(rows.T[::-1])
        rows = rows[self.order]
        new = np.ones(len(rows), bool)
        parent = np.zeros(len(rows), np.int64)
        self.key, self.children = [], []
        differs = np.zeros(len(rows), bool)
        differs[0] = True
        for d in range(rows.shape[1]):
            differs[1:] |= rows[1:, d] != rows[:-1, d]
            new = np.flatnonzero(differs)
            self.key.append(parent[new] * self.base(d) + rows[new, d])
            # where the children of each node above begin, and the end of the last
            above = parent[new]
            self.children.append(np.searchsorted(above, np.arange(above[-1] + 2)))
            parent = np.cumsum(differs) - 1
        self.leaves = np.append(np.flatnonzero(differs), len(rows))

    @staticmethod
    def base(d: int) -> int:
        return 1 << 32 if d == 0 else 256  # level 0 is the bucket's number


def search(asking: Trie, points: Trie):
    """Pairs of leaves (asking, points, state) that the budget joins, in batches; the state is 0
    for equal counts, 1 for a surplus of the point, 2 for a surplus and a deficit."""
    todo = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int8))]
    levels = len(asking.key)
    while todo:
        d, a, p, state = todo.pop()
        if d == levels:
            yield a, p, state
            continue
        if len(a) > FRONTIER:
            half = len(a) // 2
            todo += [(d, a[half:], p[half:], state[half:]), (d, a[:half], p[:half], state[:half])]
            continue
        first, base = asking.children[d], Trie.base(d)
        width = first[a + 1] - first[a]
        of = np.repeat(np.arange(len(a)), width)
        child = first[a][of] + np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width)
        count, below, spent = asking.key[d][child] % base, p[of] * base, state[of]
        found = []
        for delta, ok, then in ((0, slice(None), None), (1, spent == 0, 1), (-1, spent == 1, 2)):
            if d == 0 and delta:
                break
            want = below[ok] + (count[ok] + delta) % base
            at = np.searchsorted(points.key[d], want)
            hit = at < len(points.key[d])
            hit[hit] = points.key[d][at[hit]] == want[hit]
            left = spent[ok][hit] if then is None else np.full(int(hit.sum()), then, np.int8)
            found.append((child[ok][hit], at[hit], left))
        todo.append((d + 1, *(np.concatenate(x) for x in zip(*found))))
        if not len(todo[-1][1]):
            todo.pop()


def one_edit(a: str, b: str) -> bool:
    """Whether just one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def _matrix(words: list[str]) -> np.ndarray:
    """Code points of the words, padded with zeros; words longer than ``WIDE`` are left empty."""
    short = [w if len(w) <= WIDE else "" for w in words]
    codes, length = _codes(short)
    out = np.zeros((len(words), int(length.max()) + 2), np.uint32 if codes.size and codes.max() > 255 else np.uint8)
    out[np.repeat(np.arange(len(words)), length), np.arange(len(codes)) - np.repeat(np.cumsum(length) - length, length)] = codes
    return out


def _verified(a, p, state, asking, points, wa, wp, shapes):
    """Which of the word pairs (a, p) are one edit apart; of equal counts each pair once."""
    longer, codes_a, codes_p = shapes
    near = np.zeros(len(a), bool)
    for grown in (False, True):
        at = np.flatnonzero((state == 1) == grown)
        x, y = codes_p[p[at]], codes_a[a[at]]
        w = min(x.shape[1], y.shape[1])  # each is two wider than its longest word
        equal = x[:, :w] == y[:, :w]
        if not grown:
            near[at] = (~equal).sum(axis=1) + (x[:, w:] != 0).sum(axis=1) + (y[:, w:] != 0).sum(axis=1) == 1
            continue
        # y is x without one: equal up to its first difference, and from there on shifted by one
        begin = np.where(equal.all(axis=1), w, equal.argmin(axis=1))
        shifted = np.zeros_like(y, shape=(len(at), max(x.shape[1] - 1, y.shape[1])))
        shifted[:, :x.shape[1] - 1] = x[:, 1:]
        plain = np.zeros_like(shifted)
        plain[:, :y.shape[1]] = y
        near[at] = ((shifted == plain) | (np.arange(shifted.shape[1]) < begin[:, None])).all(axis=1)
    long = np.flatnonzero(longer[0][a] | longer[1][p])
    near[long] = [one_edit(asking[i], points[j]) for i, j in zip(a[long], p[long])]
    return near & ((state > 0) | (wa[a] < wp[p]))


def near_in(points: list[str], pn: np.ndarray, pb: np.ndarray, asking: list[str], an: np.ndarray, ab: np.ndarray,
            order: list[int] | None = None):
    """For words asking and points with their buckets' numbers: rows ``(word, near, best_n,
    best)`` of every word with near words among the pairs of one bucket."""
    trees = [Trie(np.concatenate([b[:, None].astype(np.int64), vectors(w, order).astype(np.int64)], axis=1))
             for w, b in ((asking, ab), (points, pb))]
    rank = {w: i for i, w in enumerate(sorted({*asking, *points}))}
    wa, wp = (np.array([rank[w] for w in words], np.int64) for words in (asking, points))
    shapes = ([np.array([len(w) > WIDE for w in words]) for words in (asking, points)], _matrix(asking), _matrix(points))
    found = []
    for a, p, state in search(*trees):
        (a0, a1), (p0, p1) = ((t.leaves[x], t.leaves[x + 1]) for t, x in zip(trees, (a, p)))
        size = (a1 - a0) * (p1 - p0)
        ends = np.cumsum(size)
        lo = 0
        while lo < len(size):
            # pairs of leaves that make PAIRS pairs of words, and of a larger one a part at a time
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
            total = int(ends[hi - 1] - (ends[lo - 1] if lo else 0))
            for at in range(0, total, PAIRS):
                no = np.arange(at, min(total, at + PAIRS))
                of = lo + np.searchsorted(ends[lo:hi] - (ends[lo - 1] if lo else 0), no, "right")
                no = no - (ends[of] - size[of] - (ends[lo - 1] if lo else 0))
                i = trees[0].order[a0[of] + no // (p1 - p0)[of]]
                j = trees[1].order[p0[of] + no % (p1 - p0)[of]]
                ok = _verified(i, j, state[of], asking, points, wa, wp, shapes)
                found.append((i[ok], j[ok]))
            lo = hi
    if not found:
        return
    i, j = (np.concatenate(x) for x in zip(*found))
    for own, other, words, others, counts, ranks in ((i, j, asking, points, pn, wp), (j, i, points, asking, an, wa)):
        if not len(own):
            continue
        order = np.lexsort((ranks[other], -counts[other], own))
        own, other = own[order], other[order]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        near = np.diff(np.append(first, len(own)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([words[x] for x in own[first]]), pa.array(near), pa.array(counts[other[first]]),
             pa.array([others[x] for x in other[first]])], names=["word", "near", "best_n", "best"])


def _meet(batches, order: list[int]):
    """Rows ``(bucket, part, asks, word, n)`` sorted by the first three -> rows of ``near_in``.
    Held are the points of one bucket, and one chunk of rows beside them."""
    def fresh():
        return [[], [], []]  # words, counts and buckets' numbers, in pieces

    points, asking, rows, number, last = fresh(), fresh(), 0, 0, None

    def run():
        if points[0] and asking[0]:
            (p, pn, pb), (a, an, ab) = ([list(chain.from_iterable(s[0])), np.concatenate(s[1]), np.concatenate(s[2])] for s in (points, asking))
            yield from near_in(p, pn, pb, a, an, ab, order)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
        words, counts = batch.column(3).to_pylist(), batch.column(4).to_numpy(zero_copy_only=False)
        cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
            bucket, asks = keys[lo][:2], keys[lo][2]
            if bucket != last:
                if rows >= CHUNK:
                    yield from run()
                    points, asking, rows, number = fresh(), fresh(), 0, 0
                number, last = number + 1, bucket
            elif asks and rows >= CHUNK and asking[0]:
                yield from run()
                # the points of the bucket that goes on stay
                keep = [k for k, b in enumerate(points[2]) if b[0] == number]
                points, asking, rows = [[column[k] for k in keep] for column in points], fresh(), 0
            for column, value in zip(asking if asks else points, (words[lo:hi], counts[lo:hi], np.full(hi - lo, number))):
                column.append(value)
            rows += hi - lo
    yield from run()


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """``(word, n_near, best, best_n)`` for every word of ``words (word, n)`` that has near
    words: how many, and the one of largest n (ties: the smallest in code-point order)."""
    prepare(words.sparkSession)
    order = group_order(words)
    full = stage(words.select("word").mapInArrow(lambda it: _keys(it, order, DEEPEST), "bucket binary").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("points")), "spelling-keys")
    for depth in range(2, DEEPEST + 1):
        sizes = full.groupBy(F.substring("bucket", 1, depth).alias("bucket")).agg(F.sum("points").alias("points"))
        largest = sizes.agg(F.max("points")).first()[0] or 0
        if largest <= most:
            break
    rows = words.mapInArrow(lambda it: _emit(it, order, depth), "bucket binary, asks boolean, word string, n long")
    if largest <= most:
        dealt = rows.withColumn("part", F.lit(0))
    else:
        large = sizes.where(F.col("points") > most).select("bucket", F.ceil(F.col("points") / most).cast("int").alias("parts"))
        parts = F.coalesce("parts", F.lit(1))
        part = F.when(F.col("asks"), F.sequence(F.lit(0), parts - 1)).otherwise(
            F.array(F.pmod(F.xxhash64("word"), parts).cast("int")))
        dealt = rows.join(large, "bucket", "left").select("bucket", "asks", "word", "n", F.explode(part).alias("part"))
    met = (dealt.select("bucket", "part", "asks", "word", "n").repartition("bucket", "part")
           .sortWithinPartitions("bucket", "part", "asks")
           .mapInArrow(lambda it: _meet(it, order), "word string, near long, best_n long, best string"))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return met.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms (word, form)``, which has no cycles: every round follows twice
    as many forms as the one before."""
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("ahead"))
        now = stage(now.join(ahead, now["root"] == ahead["at"], "left").select(
            "word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def variants(docs: DataFrame, thin: int = 31, least: int = 7, twice: int = 2, factor: int = 10,
             most: int = MOST) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of the ``vocabulary``: its form is
    the near word of largest n, if that is ``factor`` times its own or more (else null), its
    root the last of the forms that follow from it (itself without any).

    A null text has no words; empty and blank texts likewise; very long texts and words are
    whole; of equally frequent near words the smallest in code-point order counts; repeated
    rows count each by itself; an empty table has no words; other columns are ignored.
    """
    if thin < 1 or least < 1 or twice < 1 or factor < 2 or most < 1:
        raise ValueError("thin, least, twice and most must be at least 1, factor at least 2")
    words = stage(vocabulary(docs, thin, least, twice), "vocabulary")
    is_form = F.col("best_n") >= factor * F.col("n")
    linked = stage(words.join(near_words(words, most), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n")), "near-words")
    last = roots(linked.where("form is not null").select("word", "form"))
    return linked.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
