"""A classification tree of any depth on any number of rows, split for split as MLlib's.

Bins, Gini gains, ties, stops and pruning follow ``DecisionTreeClassifier``, but for the thresholds:
they come from the values of all rows, not of a sample. MLlib counts every level of the whole
tree in passes over all rows, and an unlimited tree has about as many nodes as rows. Here
only nodes of more than ``SUBTREE_ROWS`` rows are split by such passes; the rows of every other
node then go to one task, which grows the node's whole subtree. The driver holds the nodes of
the top alone; the test rows follow their node and are predicted where it ends.

A row has one code a column: the bin of a number, or the level of a category. A level is a
feature of its own (one-hot), so a category is split into one level and the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import stage
from ..session import ship_package
from . import gram

BINS = 32  # MLlib's maxBins
SUBTREE_ROWS = 500_000  # rows of a subtree that one task grows, and of a batch of small ones
CHUNK = 200_000  # rows that are counted at once
CELLS = 1 << 20  # counts of one column that are held at once
TOP_CELLS = 1 << 22  # counts that a pass over all rows gathers
POINTS = 4096  # weighted values that a task gives of a column
PARTS = "kind int, node long, a long, b long, value double"
ROOT, IMPORTANCE, CELL = range(3)  # kinds of parts


# ── thresholds ──────────────────────────────────────────────────────────────
def thresholds(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Borders between sorted distinct ``values`` that deal their ``weights`` into ``bins``, as MLlib's."""
    middle = (values[:-1] + values[1:]) / 2.0
    if len(values) <= bins:
        return middle
    stride, out, current = weights.sum() / bins, [], weights[0]
    target = stride
    for i in range(1, len(values)):
        previous, current = current, current + weights[i]
        if abs(previous - target) < abs(current - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def thinned(values: np.ndarray, weights: np.ndarray, points: int) -> np.ndarray:
    """Distinct values and their weights, one array behind the other; of more than ``points`` values
    the last of every ``points``-th of the weight, for all of it."""
    values, where = np.unique(values, return_inverse=True)
    weights = np.bincount(where, weights, len(values))
    if len(values) > points:
        upto = np.cumsum(weights)
        part = np.minimum((upto / upto[-1] * points).astype(np.int64), points - 1)
        last = np.flatnonzero(np.append(part[1:] != part[:-1], True))
        values, weights = values[last], np.diff(upto[last], prepend=0.0)
    return np.concatenate([values, weights])


def _joined(a: np.ndarray, b: np.ndarray, points: int) -> np.ndarray:
    (av, aw), (bv, bw) = a.reshape(2, -1), b.reshape(2, -1)
    return thinned(np.concatenate([av, bv]), np.concatenate([aw, bw]), points)


def _chunks(batches, rows: int) -> Iterator[list[np.ndarray]]:
    """The columns of ``batches``, about ``rows`` rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]
            held, n = [], 0
    if n:
        yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]


def _borders(rows: DataFrame, numbers: list[str]) -> dict[str, np.ndarray]:
    """Thresholds of the columns ``numbers`` on all ``rows`` (and ``_train``, their copies): one pass.
    A column of at most ``POINTS`` values is exact; of others a threshold's rank may be off by one
    ``POINTS``-th of the rows."""
    def points(batches):
        total = [np.zeros(0)] * len(numbers)
        for *columns, copies in _chunks(batches, CHUNK):
            some = copies > 0
            total = [_joined(t, np.concatenate([c[some], copies[some]]), 16 * POINTS) for t, c in zip(total, columns)]
        out = [(i, gram._task(), thinned(*t.reshape(2, -1), POINTS).tobytes()) for i, t in enumerate(total) if len(t)]
        if out:
            yield gram._batch(out)

    if not numbers:
        return {}
    parts = rows.select(*numbers, F.col("_train").cast("double")).mapInArrow(points, gram.PARTS)
    got = gram.tree(parts, lambda a, b: _joined(a, b, 16 * POINTS)).collect()
    return {numbers[r["block"]]: thresholds(*np.frombuffer(r["part"]).reshape(2, -1)) for r in got}


def coded(rows: DataFrame, columns: list[str], levels: dict[str, int]) -> tuple[DataFrame, list[int]]:
    """``rows (columns, label, _train, _test)`` as codes ``(c0, c1 ..., y, w, v)``, and the number of codes
    of every column; ``levels`` has the categories, whose values are their codes."""
    borders = _borders(rows, [c for c in columns if c not in levels])

    def codes(batches):
        for batch in batches:
            *values, y, w, v = batch.columns
            out = [np.searchsorted(borders[c], x.to_numpy(), side="left") if c in borders else x.to_numpy()
                   for c, x in zip(columns, values)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in [*out, y.to_numpy()]), w, v], names=names)

    names = [*(f"c{i}" for i in range(len(columns))), "y", "w", "v"]
    schema = ", ".join([*(f"{n} int" for n in names[:-2]), "w long", "v long"])
    sizes = [levels[c] if c in levels else len(borders[c]) + 1 for c in columns]
    return stage(rows.select(*columns, "label", F.col("_train").cast("long"), F.col("_test").cast("long")).mapInArrow(
        codes, schema), "tree-codes"), sizes


# ── splits ──────────────────────────────────────────────────────────────────
def _gini(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.ones(n.shape)
    for j in range(counts.shape[-1]):
        share = counts[..., j] / n
        out -= share * share
    return out


def best_splits(counts: list[np.ndarray], category: list[bool]):
    """Of ``counts`` (nodes x codes x classes, by column) the best split of every node: gain, column and
    code (the last on the left; of a category the one on the right). The first of equals, as in MLlib."""
    total = counts[0].sum(axis=1)
    n = total.sum(axis=1)
    whole = _gini(total, n)
    gain, column, at = np.full(len(n), -np.inf), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for c, h in enumerate(counts):
        if category[c]:
            one, two = total[:, None, :] - h, h
            if h.shape[2] <= 2:  # two classes: the side with fewer of the second class is taken off first
                swap = (one[..., -1] > two[..., -1])[..., None]
                one, two = np.where(swap, two, one), np.where(swap, one, two)
        else:
            one = np.cumsum(h, axis=1)[:, :-1]
            two = total[:, None, :] - one
        if not one.shape[1]:
            continue
        n1, n2 = one.sum(axis=2), two.sum(axis=2)
        with np.errstate(invalid="ignore", divide="ignore"):
            g = whole[:, None] - n1 / n[:, None] * _gini(one, n1) - n2 / n[:, None] * _gini(two, n2)
        g[(n1 == 0) | (n2 == 0)] = -np.inf
        k = g.argmax(axis=1)
        g = g[np.arange(len(n)), k]
        better = g > gain
        gain[better], column[better], at[better] = g[better], c, k[better]
    return gain, column, at


def _left(code: np.ndarray, category: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(category, code != at, code <= at)


def subtrees(codes: np.ndarray, y: np.ndarray, w: np.ndarray, root: np.ndarray, depth: np.ndarray, sizes: list[int],
             category: list[bool], classes: int, max_depth: int):
    """Trees on rows sorted by ``root`` (0, 1 ...; ``depth`` by root) with ``w`` train copies, all grown at once, level by
    level. Gives by root whether it is a leaf after pruning, its class and its height; the
    importances; and every row's predicted class."""
    first = np.concatenate([[0], np.cumsum([s if c else 1 for s, c in zip(sizes, category)])])
    kinds = np.array(category)
    codes = codes.astype(np.uint8 if max(sizes) <= 256 else np.int32)
    predicted = np.zeros(len(y), np.int64)
    rows, node, levels = np.arange(len(y)), root, []
    while len(depth):
        m = len(depth)
        total = np.bincount(node * classes + y, w, m * classes).reshape(m, classes)
        guess = total.argmax(axis=1)
        open_ = ((total > 0).sum(axis=1) > 1) & (depth < max_depth)
        gain, column, at = np.full(m, -np.inf), np.zeros(m, np.int64), np.zeros(m, np.int64)
        number = np.cumsum(open_) - 1  # of the nodes that are open
        opened = np.flatnonzero(open_)
        mine = open_[node]
        predicted[rows[~mine]] = guess[node[~mine]]
        rows, node, codes, y, w = (x[mine] for x in (rows, node, codes, y, w))
        step = max(1, CELLS // (max(sizes) * classes))
        for a in range(0, len(opened), step):
            some = opened[a:a + step]
            lo, hi = np.searchsorted(node, [some[0], some[-1] + 1])
            k = number[node[lo:hi]] - a
            counts = [np.bincount((k * s + codes[lo:hi, c]) * classes + y[lo:hi], w[lo:hi], len(some) * s * classes).reshape(len(some), s, classes)
                      for c, s in enumerate(sizes)]
            gain[some], column[some], at[some] = best_splits(counts, category)
        split = gain > 0
        mine = split[node]
        predicted[rows[~mine]] = guess[node[~mine]]
        levels.append((split, guess, first[column] + np.where(kinds[column], at, 0), np.where(split, gain, 0.0) * total.sum(axis=1)))
        kept = np.flatnonzero(mine)
        own, c = node[kept], column[node[kept]]
        child = 2 * (np.cumsum(split) - 1)[own] + ~_left(codes[kept, c], kinds[c], at[own])
        order = np.argsort(child, kind="stable")
        kept, node = kept[order], child[order]
        rows, codes, y, w = (x[kept] for x in (rows, codes, y, w))
        depth = np.repeat(depth[split] + 1, 2)
    importance = np.zeros(first[-1])
    leaf, label, height = np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for split, guess, feature, weight in reversed(levels):
        one = np.flatnonzero(split)
        same = leaf[::2] & leaf[1::2] & (label[::2] == label[1::2])  # both sides say the same: pruned
        up, said, high = ~split, guess.copy(), np.zeros(len(split), np.int64)
        up[one], said[one] = same, np.where(same, label[::2], guess[one])
        high[one] = np.where(same, 0, 1 + np.maximum(height[::2], height[1::2]))
        np.add.at(importance, feature[one[~same]], weight[one[~same]])
        leaf, label, height = up, said, high
    return leaf, label, height, importance, predicted


# ── the whole tree ──────────────────────────────────────────────────────────
class _Top:
    """The nodes that passes over all rows have split, and their children."""

    def __init__(self, category: list[bool]):
        self.column, self.at, self.left, self.depth, self.guess, self.weight, self.final = [-1], [0], [0], [0], [0], [0.0], [False]
        self.category = np.array(category)

    def add(self, depth: int, guess: int, final: bool) -> int:
        for held, value in zip((self.column, self.at, self.left, self.depth, self.guess, self.weight, self.final),
                               (-1, 0, 0, depth, guess, 0.0, final)):
            held.append(value)
        return len(self.column) - 1

    def route(self):
        """A function that gives the node of every row of codes."""
        column, at, left, category = np.array(self.column), np.array(self.at), np.array(self.left), self.category

        def nodes(codes: np.ndarray) -> np.ndarray:
            node = np.zeros(len(codes), np.int64)
            live = np.arange(len(codes))
            while True:
                live = live[column[node[live]] >= 0]
                if not len(live):
                    return node
                own = node[live]
                c = column[own]
                node[live] = left[own] + ~_left(codes[live, c], category[c], at[own])
        return nodes


def _counted(rows: DataFrame, top: _Top, some: list[int], sizes: list[int], classes: int) -> np.ndarray:
    """Train copies by class, and the rows behind them, by code of every column: nodes ``some`` x all codes x (classes + 1)."""
    nodes, place = top.route(), np.full(len(top.column), -1)
    place[some] = np.arange(len(some))
    begin, codes_all = np.concatenate([[0], np.cumsum(sizes)]), sum(sizes)

    def run(batches):
        total = np.zeros((len(some) * codes_all, classes + 1))
        for *columns, y, w, _ in _chunks(batches, CHUNK):
            codes = np.stack(columns, axis=1)
            k = place[nodes(codes)]
            own = k >= 0
            codes, y, w, k = codes[own], y[own], w[own], k[own]
            for c, s in enumerate(sizes):
                at = k * s + codes[:, c]
                both = np.column_stack([np.bincount(at * classes + y, w, len(some) * s * classes).reshape(-1, classes),
                                        np.bincount(at, minlength=len(some) * s)])
                to = (np.arange(len(some))[:, None] * codes_all + begin[c] + np.arange(s)).ravel()
                total[to] += both
        yield gram._batch([(0, gram._task(), total.tobytes())])

    got = gram.tree(rows.mapInArrow(run, gram.PARTS), np.add).collect()
    return np.frombuffer(bytes(got[0]["part"])).reshape(len(some), codes_all, classes + 1)


def _of(rows: DataFrame, top: _Top, some: list[int]) -> DataFrame:
    """The rows of the nodes ``some``."""
    nodes, mine = top.route(), np.zeros(len(top.column), bool)
    mine[some] = True

    def run(batches):
        for columns in _chunks(batches, CHUNK):
            own = mine[nodes(np.stack(columns[:-3], axis=1))]
            yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in columns], names=names)

    names = rows.columns
    return rows.mapInArrow(run, rows.schema)


def _cells(actual: np.ndarray, predicted: np.ndarray, copies: np.ndarray, classes: int) -> pa.RecordBatch:
    at, where = np.unique(actual.astype(np.int64) * classes + predicted, return_inverse=True)
    return _parts(CELL, np.zeros(len(at)), at // classes, at % classes, np.bincount(where, copies, len(at)))


def _parts(kind: int, node, a, b, value) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(node), kind, np.int32)), *(pa.array(np.asarray(x, np.int64)) for x in (node, a, b)),
         pa.array(np.asarray(value, float))], names=["kind", "node", "a", "b", "value"])


def grow(rows: DataFrame, columns: list[str], levels: dict[str, int], classes: int, max_depth: int):
    """Of ``rows (columns, label, _train, _test)``, with their copies for the fit and for the test, the tree's depth,
    its features' importances (a feature a number or level, in order) and the confusion ``(actual, predicted, n)``."""
    spark = rows.sparkSession
    ship_package(spark)
    rows, sizes = coded(rows, columns, levels)
    category = [c in levels for c in columns]
    first = np.concatenate([[0], np.cumsum([s if c else 1 for s, c in zip(sizes, category)])])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    top, active, all_rows = _Top(category), [0], 0
    features = []  # of the top's nodes that are split: node, feature
    open_rows, held = rows, None  # rows of active nodes are among them
    while active:
        following, left = [], 0
        step = max(1, TOP_CELLS // (sum(sizes) * (classes + 1)))
        for a in range(0, len(active), step):
            some = active[a:a + step]
            counts = _counted(open_rows, top, some, sizes, classes)
            by = [counts[:, begin[c]:begin[c + 1]] for c in range(len(sizes))]
            gain, column, at = best_splits([h[..., :classes] for h in by], category)
            for i, node in enumerate(some):
                total = by[0][i].sum(axis=0)
                all_rows = max(all_rows, int(total[-1]))
                top.guess[node] = int(total[:classes].argmax())
                if not gain[i] > 0 or top.depth[node] == max_depth:
                    top.final[node] = True
                    continue
                c, k = int(column[i]), int(at[i])
                right = by[c][i][k] if category[c] else by[c][i][k + 1:].sum(axis=0)
                top.column[node], top.at[node], top.weight[node] = c, k, gain[i] * total[:classes].sum()
                features.append((node, int(first[c] + (k if category[c] else 0))))
                top.left[node] = len(top.column)
                for side in (total - right, right):
                    depth = top.depth[node] + 1
                    final = depth == max_depth or (side[:classes] > 0).sum() == 1
                    child = top.add(depth, int(side[:classes].argmax()), bool(final))
                    if not final and side[-1] > SUBTREE_ROWS:
                        following.append(child)
                        left += int(side[-1])
        active, held = following, held or all_rows
        if active and 2 * left < held:  # the next passes read less than half
            open_rows, held = stage(_of(open_rows, top, active), "tree-open"), left
    nodes, final, guess, depths = top.route(), np.array(top.final, bool), np.array(top.guess), np.array(top.depth)
    codes = len(columns)

    def ended(batches):
        for *held, y, w, v in _chunks(batches, CHUNK):
            node = nodes(np.stack(held, axis=1))
            own = final[node] & (v > 0)
            yield _cells(y[own], guess[node[own]], v[own], classes)

    def routed(batches):
        for *held, y, w, v in _chunks(batches, CHUNK):
            node = nodes(np.stack(held, axis=1))
            own = ~final[node]
            yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (*held, y, w, v, node)], names=[*rows_names, "node"])

    def grown(columns_: list[np.ndarray]):
        *held, y, w, v, node = columns_
        roots, root = np.unique(node, return_inverse=True)
        leaf, label, height, importance, predicted = subtrees(
            np.stack(held, axis=1), y, w, root, depths[roots], sizes, category, classes, max_depth)
        yield _parts(ROOT, roots, np.where(leaf, label, -1), height, np.zeros(len(roots)))
        at = np.flatnonzero(importance)
        yield _parts(IMPORTANCE, np.zeros(len(at)), at, np.zeros(len(at)), importance[at])
        own = v > 0
        yield _cells(y[own], predicted[own], v[own], classes)

    def finish(batches):
        held = None
        for new in _chunks(batches, CHUNK):
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]) > most:  # all but the last node, whose rows may go on
                cut = np.searchsorted(held[-1], held[-1][-1])
                if cut:
                    yield from grown([x[:cut] for x in held])
                    held = [x[cut:] for x in held]
        if held is not None:
            yield from grown(held)

    rows_names, most = rows.columns, SUBTREE_ROWS
    tasks = max(spark.sparkContext.defaultParallelism, -(-all_rows // most))
    schema = ", ".join([*(f"{n} int" for n in rows_names[:codes + 1]), "w long", "v long", "node long"])
    below = rows.mapInArrow(routed, schema).repartition(tasks, "node").sortWithinPartitions("node").mapInArrow(finish, PARTS)
    parts = stage(rows.mapInArrow(ended, PARTS).union(below) if final.any() else below, "tree-parts")

    count = len(top.column)
    leaf, label, height = final.copy(), guess.copy(), np.zeros(count, np.int64)
    for r in parts.where(F.col("kind") == ROOT).select("node", "a", "b").collect():
        leaf[r["node"]], height[r["node"]] = r["a"] >= 0, r["b"]
        label[r["node"]] = r["a"] if r["a"] >= 0 else label[r["node"]]
    importance = np.zeros(first[-1])
    for r in parts.where(F.col("kind") == IMPORTANCE).groupBy("a").agg(F.sum("value").alias("value")).collect():
        importance[r["a"]] = r["value"]
    of = dict(features)
    for node in range(count - 1, -1, -1):
        if top.column[node] >= 0:
            one, two = top.left[node], top.left[node] + 1
            if leaf[one] and leaf[two] and label[one] == label[two]:
                leaf[node], label[node] = True, label[one]
            else:
                height[node] = 1 + max(height[one], height[two])
                importance[of[node]] += top.weight[node]
    total = importance.sum()
    cm = parts.where(F.col("kind") == CELL).groupBy(F.col("a").cast("double").alias("actual"), F.col("b").cast("double").alias("predicted"))\
        .agg(F.sum("value").cast("long").alias("n"))
    return int(height[0]), importance / total if total > 0 else importance, cm
