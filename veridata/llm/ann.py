"""Nearest neighbours by largest inner product with multiprobe p-stable hashing.

Vectors are dealt into ranges of norms, each up to twice the one below, and every range is an
index of its own. Vectors are scaled by the largest norm of their range and get one more
component that brings each to norm one; queries are brought to norm one and ask every range. Then a larger inner product is a smaller Euclidean
distance, and the Gaussian (2-stable) hashes ``floor((a . x + b) / w)`` apply. Every table
joins ``hashes`` of them to a bucket. A query visits its own bucket and the perturbed
buckets next to it in the order of the sum of squared distances to the crossed borders,
which estimates their order of success. Candidates that meet in a bucket are scored
exactly on the original vectors, the best of each bucket are merged over buckets and
tables, and the best of all remain. A query that ends with fewer than it could have is scored
against all vectors, in blocks.

Equal vectors are indexed and asked once, with the smallest ids that an answer could need,
so a vector that a third of the rows share is one candidate and one query. Buckets are
counted first, and large ones are cut into blocks of queries by points.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, stage

TABLES = 6
HASHES = 8
WIDTH = 3.0
PROBES = 32
SEED = 11
BLOCK = 4096
RANGE = 0x5851F42D4C957F2D  # parts the buckets of two ranges of norms
MOST = 50_000  # queries or points of a bucket that meet in one task


def valid(vector):
    """Not null, not zero and all of its components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def projections(dim: int, tables: int, hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions (``tables x dim x hashes``) and offsets in [0, 1)."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((tables, dim, hashes)), rng.random((tables, hashes))


def probe_sequence(rest: np.ndarray, probes: int) -> list[tuple[int, ...]]:
    """Perturbations (one of -1, 0, 1 for each hash) in order of estimated success, the
    unperturbed one first. ``rest``: how far into its slot the query lies, in [0, 1)."""
    n = len(rest)
    moves = sorted([(r * r, i, -1) for i, r in enumerate(rest)] + [((1 - r) * (1 - r), i, 1) for i, r in enumerate(rest)])
    out, heap = [(0,) * n], [(moves[0][0], (0,))]
    while heap and len(out) < probes:
        cost, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < len(moves):
            heapq.heappush(heap, (cost - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + moves[last + 1][0], (*chosen, last + 1)))
        step = [0] * n
        if len({moves[c][1] for c in chosen}) == len(chosen):
            for c in chosen:
                step[moves[c][1]] = moves[c][2]
            out.append(tuple(step))
    return out


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def norm_range(norm: np.ndarray) -> np.ndarray:
    """Norms over the largest -> 0 above one half, -1 above one quarter and so on."""
    part, exponent = np.frexp(norm)
    return exponent - (part == 0.5)


def _visits(batches, a, b, scale, ranges, width, probes, query):
    """Batches ``(id, vec)`` -> ``(batch, buckets, row numbers)`` for each table: of a
    candidate its bucket, of a query all the buckets that it visits in each of ``ranges``."""
    tables, dim, hashes = a.shape
    mix = np.random.default_rng(1).integers(1, 1 << 62, hashes, dtype=np.int64) * 2 + 1
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(1))
        if query:
            unit = np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, 1)))
        else:
            unit = x / scale
            level = norm_range(np.sqrt((unit * unit).sum(1)))
            unit = unit / np.exp2(level)[:, None]
            unit = np.concatenate([unit, np.sqrt(np.maximum(0, 1 - (unit * unit).sum(1)))[:, None]], axis=1)
        for t in range(tables):
            y = unit @ a[t] / width + b[t]
            slot = np.floor(y).astype(np.int64)
            if query:
                steps = [probe_sequence(r, probes) for r in y - slot]
                source = np.repeat(np.arange(len(x)), [len(s) for s in steps])
                slot = slot[source] + np.array([s for one in steps for s in one])
            else:
                source = np.arange(len(x))
            with np.errstate(over="ignore"):
                key = (slot * mix).sum(1) * tables + t
                if query:
                    for one in ranges:
                        yield batch, key + np.int64(one) * RANGE, source
                else:
                    yield batch, key + level.astype(np.int64) * RANGE, source


def _emit(batches, kind, **how):
    """Rows ``(id, vec)`` -> rows ``(bucket, kind, id, vec)``, kind 0 for queries."""
    for batch, key, source in _visits(batches, query=kind == 0, **how):
        for at in range(0, len(source), 20_000):
            part = source[at:at + 20_000]
            rows = batch.take(pa.array(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[at:at + 20_000]), pa.array(np.full(len(part), kind, np.int32)),
                 rows.column(0), rows.column(1)], names=["bucket", "kind", "id", "vec"])


def _tally(batches, kind, **how):
    """Rows ``(id, vec)`` -> rows ``(bucket, asked, points)``: how many of each visit a bucket."""
    for _, key, _ in _visits(batches, query=kind == 0, **how):
        buckets, n = np.unique(key, return_counts=True)
        counts = [pa.array(n), pa.array(np.zeros(len(n), np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(buckets), *counts[::1 if kind == 0 else -1]],
                                         names=["bucket", "asked", "points"])


def in_blocks(emitted: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """``emitted (bucket, kind, id, vec)`` with every bucket of more than ``most`` queries or
    points cut into blocks: each side is dealt into parts of about ``most`` by a hash of the
    id, and every part of one side meets every part of the other in a bucket of its own, so
    no pair of a bucket is lost and no task holds a large one."""
    large = sizes.where((F.col("asked") > most) | (F.col("points") > most)).select(
        F.col("bucket").alias("large"), F.ceil(F.col("asked") / most).cast("int").alias("asked_parts"),
        F.ceil(F.col("points") / most).cast("int").alias("point_parts"))
    query = F.col("kind") == 0
    asked, points = (F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) for c in ("asked_parts", "point_parts"))
    own = F.pmod(F.xxhash64("id"), F.when(query, asked).otherwise(points))
    other = F.when(query, points).otherwise(asked)
    dealt = emitted.join(large, F.col("bucket") == F.col("large"), "left").select(
        "bucket", "kind", "id", "vec", "large", own.alias("own"),
        F.explode(F.sequence(F.lit(0), other - 1)).alias("other"))
    block = F.when(query, F.struct(F.col("own").alias("i"), F.col("other").cast("long").alias("j"))).otherwise(
        F.struct(F.col("other").cast("long").alias("i"), F.col("own").alias("j")))
    # buckets whose hashes meet only bring more candidates
    return dealt.select(F.when(F.col("large").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", block))
                        .alias("bucket"), "kind", "id", "vec")


def _best(q, x, ids, k):
    """Of candidates ``x`` the ``k`` best for each query: exact scores, summed alike everywhere."""
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    # last bits aside, so that ties go to the smaller id: of each score, and of the norms where it is nothing next to them
    near = q @ x.T
    near[np.abs(near) < 1e-13 * np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)] = 0
    digits, exponent = np.frexp(near)
    near = np.ldexp(np.round(digits, 12), exponent)
    pick = np.argsort(-near, axis=1, kind="stable")[:, :k]
    return ids[pick], (q[:, None, :] * x[pick]).sum(-1)


def _meet(batches, k):
    """Rows sorted by bucket and kind -> ``(query, rep, score)``, the ``k`` best of each
    bucket and query. Holds the queries of one bucket and one block of its candidates."""
    bucket = None
    queries: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        if queries and held:
            ids, x = (np.concatenate(part) for part in zip(*held))
            for qid, q in queries:
                for at in range(0, len(qid), 512):
                    best, score = _best(q[at:at + 512], x, ids, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(qid[at:at + 512], best.shape[1])), pa.array(best.ravel()),
                         pa.array(score.ravel())], names=["query", "rep", "score"])
        held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        key, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        ids, x = batch.column(2).to_numpy(zero_copy_only=False), _matrix(batch.column(3))
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(key)]):
            if key[lo] != bucket:
                yield from flush()
                queries.clear()
                bucket = key[lo]
            if kind[lo] == 0:
                queries.append((ids[lo:hi], x[lo:hi]))
            elif queries:
                held.append((ids[lo:hi], x[lo:hi]))
                if sum(len(i) for i, _ in held) >= BLOCK:
                    yield from flush()
    yield from flush()


def search(vectors: DataFrame, queries, k: int = 20, tables: int = TABLES, hashes: int = HASHES,
           width: float = WIDTH, probes: int = PROBES, seed: int = SEED, most: int = MOST) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``vectors (vec_id, embedding)``
    for which the column ``queries`` holds, its ``k`` nearest of the other rows that were
    found, by largest inner product in double precision, ties to the smaller vec_id.

    Vectors that are null, zero or hold a null or non-finite component take no part, nor do
    rows with a null vec_id. Of rows that share a vec_id the smallest vector counts. Vectors
    of different lengths raise an error; an empty table gives no rows; other columns are
    ignored. ``most`` bounds the queries and the points that one task holds of a bucket.
    """
    if min(k, tables, hashes, probes, most) < 1 or width <= 0:
        raise ValueError("k, tables, hashes, probes, most and width must be positive")
    prepare(vectors.sparkSession)
    vec = F.col("embedding").cast("array<double>")
    rows = stage(vectors.where(F.col("vec_id").isNotNull()).withColumn("q", F.coalesce(queries, F.lit(False)))
                 .select(F.col("vec_id").cast("long").alias("id"), vec.alias("vec"), "q").where(valid(F.col("vec")))
                 .groupBy("id").agg(F.min("vec").alias("vec"), F.max("q").alias("q")), "vectors")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    scale, low, high = rows.agg(F.max(norm), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if low != high:
        raise ValueError(f"vectors have from {low} to {high} components")
    a, b = projections((low or 0) + 1, tables, hashes, seed)
    scale = (scale or 1.0) * (1 + 1e-12)
    levels = rows.select("vec").mapInArrow(lambda it: _levels(it, scale), "level int").distinct().collect()
    how = {"a": a, "b": b, "scale": scale, "ranges": sorted(r[0] for r in levels), "width": width, "probes": probes}
    # of equal vectors an answer names k at most, and the query may be one more
    reps = stage(rows.withColumn("no", F.row_number().over(Window.partitionBy("vec").orderBy("id")))
                 .where(F.col("no") <= k + 1)
                 .groupBy("vec").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")), "reps")
    asks = stage(rows.where("q").select(F.col("id").alias("query"), "vec").join(
        reps.select("vec", F.col("id").alias("rep")), "vec").select("query", "rep"), "queries")
    points = reps.select("id", "vec")
    asked = points.join(asks.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "vec")
    sizes = stage(_each(points, asked, _tally, "bucket long, asked long, points long", how)
                  .groupBy("bucket").agg(F.sum("asked").alias("asked"), F.sum("points").alias("points")), "buckets")
    emitted = _each(points, asked, _emit, "bucket long, kind int, id long, vec array<double>", how)
    met = (in_blocks(emitted, sizes, most).repartition("bucket").sortWithinPartitions("bucket", "kind")
           .mapInArrow(lambda it: _meet(it, k + 1), "query long, rep long, score double"))
    by_query = Window.partitionBy("query")
    least = min(k + 1, rows.count())

    def top(met):
        return (met.withColumn("r", F.dense_rank().over(by_query.orderBy(F.col("score").desc(), "rep")))
                .where(F.col("r") <= k + 1).select("query", "rep", "score").distinct())

    best = stage(top(met), "met")
    # the ids that a query has found, itself among them or not: fewer than k + 1 are short
    named = reps.select(F.col("id").alias("rep"), F.size("ids").alias("n"))
    enough = best.join(named, "rep").groupBy("query").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    short = stage(asked.join(enough, F.col("id") == F.col("query"), "left_anti"), "short")
    missing = short.count()
    if missing:
        both = points.select(F.lit(0).cast("long").alias("bucket"), F.lit(1).alias("kind"), "id", "vec").union(
            short.select(F.lit(0).cast("long"), F.lit(0), "id", "vec"))
        whole = rows.sparkSession.createDataFrame([(0, missing, points.count())], "bucket long, asked long, points long")
        exact = (in_blocks(both, whole, most).repartition("bucket").sortWithinPartitions("bucket", "kind")
                 .mapInArrow(lambda it: _meet(it, k + 1), "query long, rep long, score double"))
        best = best.join(short.select(F.col("id").alias("query")), "query", "left_anti").union(top(exact))
    # k + 1 ids for each vector that is asked for: a row leaves itself out
    near = (best.join(reps.select(F.col("id").alias("rep"), "ids"), "rep")
            .select("query", "score", F.explode("ids").alias("vec_id"))
            .withColumn("r", F.row_number().over(by_query.orderBy(F.col("score").desc(), "vec_id")))
            .where(F.col("r") <= k + 1).groupBy(F.col("query").alias("rep"))
            .agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near")))
    others = F.filter("near", lambda x: x["vec_id"] != F.col("query"))
    return asks.join(near, "rep").select("query", F.posexplode(F.slice(others, 1, k)).alias("no", "x")).select(
        F.col("query").alias("query_id"), (F.col("no") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _levels(batches, scale):
    """Rows ``(vec)`` -> the ranges of norms among them."""
    for batch in batches:
        if batch.num_rows:
            unit = _matrix(batch.column(0)) / scale
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(norm_range(np.sqrt((unit * unit).sum(1)))).astype(np.int32))],
                                             names=["level"])


def _each(points: DataFrame, asked: DataFrame, run, schema: str, how: dict) -> DataFrame:
    """What ``run`` makes of the points and of the queries."""
    return points.mapInArrow(lambda it: run(it, 1, **how), schema).union(
        asked.mapInArrow(lambda it: run(it, 0, **how), schema))
