"""Cross-product matrices by tree aggregation.

Every task multiplies its own rows (numpy, one array column ``x``) and gives small binary
parts; parts of one key are merged on the way, in a fixed order, by at most two shuffles of
parts. Rows never move, and the plan has the same size for any number of columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FANIN = 64  # parts of one key that one task merges at most, as far as two steps go
EDGE = 256  # columns of a block
PARTS = "block int, task int, part binary"


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths; null elements are NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    block, task, part = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(task, pa.int32()), pa.array(part, pa.binary())],
                                      names=["block", "task", "part"])


def _merged(batches, merge: Callable):
    """Parts sorted by block and task -> one part per block; holds one part at a time."""
    block, first, total = None, 0, None
    for batch in batches:
        for b, task, part in zip(*(c.to_pylist() for c in batch.columns)):
            values = np.frombuffer(part)
            if b != block:
                if block is not None:
                    yield _batch([(block, first, total.tobytes())])
                block, first, total = b, task, values
            else:
                total = merge(total, values)
    if block is not None:
        yield _batch([(block, first, total.tobytes())])


def tree(parts: DataFrame, merge: Callable, tasks: int | None = None) -> DataFrame:
    """``parts (block, task, part)`` with one row per block, merged in the order of the tasks; in
    one step where there are known to be few tasks, else in two."""
    steps = [F.floor(F.col("task") / FANIN).cast("int")] if tasks is None or tasks > FANIN else []
    for group in [*steps, None]:
        by = ["block"] if group is None else ["block", group]
        parts = parts.repartition(*by).sortWithinPartitions("block", "task").mapInArrow(
            (lambda it: _merged(it, merge)) if group is None else (lambda it: _merged_groups(it, merge)), PARTS)
    return parts


def _merged_groups(batches, merge: Callable):
    """As ``_merged``, of every block and run of ``FANIN`` tasks that lies in this partition."""
    def keyed():
        for batch in batches:
            for b, task, part in zip(*(c.to_pylist() for c in batch.columns)):
                yield (b, task // FANIN), task, np.frombuffer(part)

    key, first, total = None, 0, None
    for k, task, values in keyed():
        if k != key:
            if key is not None:
                yield _batch([(key[0], first, total.tobytes())])
            key, first, total = k, task, values
        else:
            total = merge(total, values)
    if key is not None:
        yield _batch([(key[0], first, total.tobytes())])


def _task() -> int:
    from pyspark import TaskContext
    return TaskContext.get().partitionId()


# ── moments of complete rows ────────────────────────────────────────────────
def _join_moments(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Count, means and centred cross products of both parts' rows."""
    na, nb = a[0], b[0]
    if not na or not nb:
        return a if na else b
    n, step = na + nb, b[1:p + 1] - a[1:p + 1]
    cross = a[p + 1:] + b[p + 1:] + (np.outer(step, step) * (na * nb / n)).ravel()
    return np.concatenate([[n], a[1:p + 1] + step * (nb / n), cross])


def moments(rows: DataFrame, p: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and centred cross products (p x p) of ``rows (x)``, arrays of ``p``
    numbers: one pass. What reaches the driver is p * p numbers."""
    def part(batches):
        total = np.zeros(1 + p + p * p)
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                x = matrix(batch.column(0).slice(at, 8192))
                mean = x.mean(axis=0)
                centred = x - mean
                total = _join_moments(total, np.concatenate([[len(x)], mean, (centred.T @ centred).ravel()]), p)
        if total[0]:
            yield _batch([(0, _task(), total.tobytes())])

    parts = rows.select("x").mapInArrow(part, PARTS)
    got = tree(parts, lambda a, b: _join_moments(a, b, p)).collect()
    total = np.frombuffer(bytes(got[0]["part"])) if got else np.zeros(1 + p + p * p)
    return int(total[0]), total[1:p + 1], total[p + 1:].reshape(p, p)


def least_norm(rows: DataFrame, p: int) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of the last of ``p + 1`` numbers of ``x`` on the ``p`` before:
    of all least-squares solutions that with the smallest coefficients, so collinear columns
    (all levels of a category) have one answer. The rank is decided on standardised columns."""
    _, mean, cross = moments(rows, p + 1)
    sxx, sxy = cross[:p, :p], cross[:p, p]
    scale = np.sqrt(np.diag(sxx))
    used = scale > 1e-12 * np.maximum(1.0, np.abs(mean[:p]))
    coef = np.zeros(p)
    if used.any():
        d = scale[used]
        values, vectors = np.linalg.eigh(sxx[np.ix_(used, used)] / np.outer(d, d))
        full = values > 1e-10 * values.max()
        own = vectors[:, full] @ ((vectors[:, full].T @ (sxy[used] / d)) / values[full]) / d
        if not full.all():  # take out what lies along directions without variance
            free, _ = np.linalg.qr(vectors[:, ~full] / d[:, None])
            own = own - free @ (free.T @ own)
        coef[used] = own
    return float(mean[p] - mean[:p] @ coef), coef


# ── pairwise-complete correlation ───────────────────────────────────────────
def column_facts(rows: DataFrame, p: int) -> tuple[int, np.ndarray]:
    """Row count and, per column of ``rows (x)``, the count, sum, least, largest and number of
    infinite values (5 x p)."""
    def merge(a, b):
        a, b = a.reshape(6, p), b.reshape(6, p)
        return np.concatenate([a[:2] + b[:2], np.fmin(a[2:3], b[2:3]), np.fmax(a[3:4], b[3:4]), a[4:] + b[4:]]).ravel()

    def part(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = matrix(batch.column(0).slice(at, 4096))
                known = ~np.isnan(x)
                with np.errstate(invalid="ignore"):
                    low, high = (f.reduce(x, axis=0, initial=np.nan) for f in (np.fmin, np.fmax))
                now = np.concatenate([known.sum(axis=0), np.where(np.isfinite(x), x, 0).sum(axis=0), low, high,
                                      np.isinf(x).sum(axis=0), np.full(p, len(x))]).astype(float)
                total = now if total is None else merge(total, now)
        if total is not None:
            yield _batch([(0, _task(), total.tobytes())])

    got = tree(rows.select("x").mapInArrow(part, PARTS), merge).collect()
    if not got:
        return 0, np.zeros((5, p))
    total = np.frombuffer(bytes(got[0]["part"])).reshape(6, p)
    return int(total[5, 0]), total[:5]


def correlations(rows: DataFrame, keep: list[int], shift: np.ndarray, names: list[str]) -> DataFrame:
    """Pearson r of every pair ``i < j`` of the columns ``keep`` of ``rows (x)`` over the rows in
    which both are there: ``(i, j, col_a, col_b, r)``.

    Per pair of column blocks four products of the shifted values and the masks carry all
    sums of its pairs: counts M'M, sums Z'M, squares (Z*Z)'M and products Z'Z. Blocks
    without a gap need one product and their column sums.
    """
    cols, p = np.array(keep), len(keep)
    blocks = [(lo, min(lo + EDGE, p)) for lo in range(0, p, EDGE)]
    pairs = [(a, b) for a in range(len(blocks)) for b in range(a, len(blocks))]

    def part(batches):
        sums: list = [None] * len(pairs)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                z = matrix(batch.column(0).slice(at, 4096))[:, cols] - shift
                mask = ~np.isnan(z)
                gaps = [not mask[:, lo:hi].all() for lo, hi in blocks]
                z = np.where(mask, z, 0.0)
                m = mask.astype(float)
                for no, (a, b) in enumerate(pairs):
                    (a0, a1), (b0, b1) = blocks[a], blocks[b]
                    za, zb, ma, mb = z[:, a0:a1], z[:, b0:b1], m[:, a0:a1], m[:, b0:b1]
                    if gaps[a] or gaps[b]:
                        now = [ma.T @ mb, za.T @ mb, ma.T @ zb, (za * za).T @ mb, ma.T @ (zb * zb), za.T @ zb]
                    else:
                        ones = np.ones((a1 - a0, b1 - b0))
                        now = [ones * len(z), ones * za.sum(axis=0)[:, None], ones * zb.sum(axis=0),
                               ones * (za * za).sum(axis=0)[:, None], ones * (zb * zb).sum(axis=0), za.T @ zb]
                    now = np.stack(now)
                    sums[no] = now if sums[no] is None else sums[no] + now
        done = [(no, _task(), s.tobytes()) for no, s in enumerate(sums) if s is not None]
        for row in done:
            yield _batch([row])

    def finish(batches):
        for batch in batches:
            for no, _, blob in zip(*(c.to_pylist() for c in batch.columns)):
                (a0, a1), (b0, b1) = (blocks[x] for x in pairs[no])
                n, sa, sb, qa, qb, ab = np.frombuffer(blob).reshape(6, a1 - a0, b1 - b0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    va, vb = qa - sa * sa / n, qb - sb * sb / n
                    r = np.where((n > 1) & (va > 0) & (vb > 0), (ab - sa * sb / n) / np.sqrt(va * vb), 0.0)
                i, j = np.meshgrid(np.arange(a0, a1), np.arange(b0, b1), indexing="ij")
                own = i < j
                i, j, r = i[own], j[own], np.clip(r[own], -1.0, 1.0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([names[x] for x in i]), pa.array([names[x] for x in j]),
                     pa.array(r)], names=["i", "j", "col_a", "col_b", "r"])

    parts = tree(rows.select("x").mapInArrow(part, PARTS), np.add)
    return parts.mapInArrow(finish, "i int, j int, col_a string, col_b string, r double")
