"""Per-key sliding-window admission (ST1–ST3), batch and Structured Streaming.

Semantics (per key, events in (ts, event_id) order): an event is rejected if
the last ``limit`` *accepted* events all lie within the window before it (an
event exactly ``window`` old still counts), with ``retry_after`` = whole
seconds until the oldest of them leaves, plus one. Rejected events never
count, so a plain window-frame count is not equivalent: this is a sequential
state machine per key, whose state is a ring of ``limit`` accepted times.

Batch plan. Each key is cut at idle gaps longer than the window (the ring is provably
void there). The gaps are found from the first and last time of each (key, window-long
bucket), pre-aggregated before their shuffle, so no task sorts the raw events of a whole
key. A segment of more events than ``chunk_events`` (a key that is never idle) is cut again
at bucket borders and replayed by speculation, see ``replay``. Then one pass decides:
``repartition(key, segment, chunk)`` + ``sortWithinPartitions`` + ``mapInPandas``, where
each task streams its sorted partition and keeps one ring.

Stream plan: ``applyInPandasWithState`` with the same step, over a fixed number of key buckets.
Events wait in their bucket's state until the watermark has passed them and are decided in (ts,
event_id) order, so the order of arrival does not matter; the state is each key's ring and the
events that wait, and an event-time timeout releases these and purges idle keys (ST3). Events of an exempt class (null) are
admitted by a projection and never reach the state.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.scratch import stage

# fixed values (reference defaults: per-minute budgets)
WINDOW_S = 60
GENERAL_LIMIT = 120
HEAVY_LIMIT = 15
US = 1_000_000

CHUNK_EVENTS = 200_000  # events of a key without idle gaps that are replayed in one piece

OUT_SCHEMA = "key string, event_id long, ts_us long, cost_class string, admitted boolean, retry_after long"


def ring(limits: dict[str, int], cost_class: str, times=()) -> deque:
    """The last accepted times of a key, as many as its class admits in a window."""
    size = limits.get(cost_class, limits.get("g", GENERAL_LIMIT))
    if size < 1:
        raise ValueError(f"the limit of class {cost_class} must be at least 1")
    return deque(times, maxlen=size)


def step(accepted: deque, now: int, window_us: int) -> tuple[bool, int | None]:
    """One decision: a full ring whose oldest time is within the window rejects."""
    if len(accepted) == accepted.maxlen and now - accepted[0] <= window_us:
        return False, (window_us - now + accepted[0]) // US + 1
    accepted.append(now)  # pushes the oldest time out of a full ring
    return True, None


def _prepare(df: DataFrame, key: str, ts: str, id_col: str, cost_class: str | None) -> DataFrame:
    cls = F.col(cost_class).cast("string") if cost_class else F.lit("g")
    return df.select(F.concat_ws(":", F.col(key).cast("string"), cls).alias("key"),
                     F.col(id_col).cast("long").alias("event_id"),
                     F.unix_micros(F.col(ts).cast("timestamp")).alias("ts_us"),
                     cls.alias("cost_class"))


def _exempt(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("cost_class").isNull()).select(
        "*", F.lit(True).alias("admitted"), F.lit(None).cast("long").alias("retry_after"))


def _decided(pdf: pd.DataFrame, decisions: list[tuple[bool, int | None]]) -> pd.DataFrame:
    out = pdf[["key", "event_id", "ts_us", "cost_class"]].copy()
    out["admitted"] = [ok for ok, _ in decisions]
    out["retry_after"] = pd.array([wait for _, wait in decisions], dtype="Int64")
    return out


def bucket_plan(ev: DataFrame, window_us: int, chunk_events: int = CHUNK_EVENTS) -> DataFrame:
    """One row per key and window-long bucket: ``seg``, the bucket in which the current run of
    its key began, and the ``chunk`` of that run, of ``chunks`` in all.

    A gap longer than the window always lies between two buckets of a key: the largest time of
    one and the smallest of the next show it. After such a gap no accepted time is within the
    window, so segments are independent. Chunks are runs of whole buckets, a new one from each
    bucket on before which another ``chunk_events`` lie; ``last`` marks the last bucket of a chunk
    that another follows. The window functions run over buckets, not events.
    """
    buckets = _bucketed(ev, window_us).groupBy("key", "bucket").agg(
        F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"), F.count(F.lit(1)).alias("n"))
    in_time = Window.partitionBy("key").orderBy("bucket")
    idle = F.col("lo") - F.lag("hi").over(in_time)
    runs = (buckets.withColumn("begin", F.when(idle.isNull() | (idle > window_us), F.col("bucket")))
            .withColumn("seg", F.last("begin", ignorenulls=True).over(in_time)))
    in_run = Window.partitionBy("key", "seg").orderBy("bucket")
    before = F.coalesce(F.sum("n").over(in_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = runs.withColumn("place", F.floor(before / chunk_events))
    cut = cut.withColumn("chunk", F.dense_rank().over(Window.partitionBy("key", "seg").orderBy("place")) - 1)
    return cut.select(
        "key", "bucket", "seg", "chunk", (F.max("chunk").over(Window.partitionBy("key", "seg")) + 1).alias("chunks"),
        (F.lead("chunk").over(in_run) > F.col("chunk")).alias("last"))


def _bucketed(ev: DataFrame, window_us: int) -> DataFrame:
    return ev.withColumn("bucket", F.col("ts_us") - F.pmod("ts_us", F.lit(window_us)))


def idle_segments(ev: DataFrame, window_us: int) -> DataFrame:
    """``ev`` with ``seg``, the bucket in which the current run of its key began."""
    runs = bucket_plan(ev, window_us).select("key", "bucket", "seg")
    return _bucketed(ev, window_us).join(runs, ["key", "bucket"]).select(*ev.columns, "seg")


def _runs(batches, *columns: str):
    """Rows of pandas batches as tuples, for row-by-row replay."""
    for b in batches:
        yield from zip(*(b[c] for c in columns))


def _inside(times, begin: int, window_us: int) -> list[int]:
    """Those accepted times that an event at ``begin`` or later can still see."""
    return [int(t) for t in times if t >= begin - window_us]


STATES = "key string, seg long, chunk int, cost_class string, begin long, entry array<long>, exit array<long>"


def _speculate(batches, limits: dict, window_us: int):
    """Rows of chunks, each with the bucket before it -> the ring that this bucket alone gives at
    the chunk's begin, and the ring at its end."""
    out, current, now = [], None, None
    for key, seg, chunk, prior, ts, cls in _runs(batches, "key", "seg", "chunk", "prior", "ts_us", "cost_class"):
        if (key, seg, chunk) != current:
            if now:
                out.append((*now, list(accepted)))
            current, now, accepted = (key, seg, chunk), None, ring(limits, cls)
        if not prior and now is None:
            now = (key, seg, chunk, cls, int(ts), _inside(accepted, ts, window_us))
        step(accepted, int(ts), window_us)
        if len(out) >= 1000:
            yield _states(out)
            out = []
    if now:
        out.append((*now, list(accepted)))
    if out:
        yield _states(out)


def _states(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in STATES.split(", ")])


def _mend(batches, limits: dict, window_us: int):
    """Chunks of the second half of a group, each behind a header with its known entry, the first
    with the exit of the half before: replayed from there until the ring agrees with a
    header, the new states are given."""
    out, group, chunk, accepted, active, now = [], None, None, None, False, None
    for key, seg, of, no, header, ts, cls, known in _runs(
            batches, "key", "seg", "half", "chunk", "header", "ts_us", "cost_class", "known"):
        if header:
            if now:
                out.append((*now, list(accepted)))
                now = None
            if (key, seg, of) != group:
                group, active, accepted = (key, seg, of), True, ring(limits, cls, _inside(known, ts, window_us))
            elif active:
                active = _inside(accepted, ts, window_us) != list(known)
            if active:
                now = (key, seg, no, cls, int(ts), _inside(accepted, ts, window_us))
        elif active:
            step(accepted, int(ts), window_us)
        if len(out) >= 1000:
            yield _states(out)
            out = []
    if now:
        out.append((*now, list(accepted)))
    if out:
        yield _states(out)


@dataclass
class Replay:
    """Decisions of ``replay``, the chunks that were replayed by speculation, the rounds that
    mended them and how many were replayed again in these."""

    data: DataFrame
    chunks: int = 0
    rounds: int = 0
    replayed: int = 0


def _entries(hot: DataFrame, limits: dict, window_us: int, most: int) -> tuple[DataFrame, int, int]:
    """The state of every chunk of the segments that have more than one, right at the end: every
    chunk is replayed from the ring that the bucket before it gives. Then neighbours are
    compared pairwise, in groups of 2, 4, 8 ... chunks: where the exit of a group's first half is
    not the entry that its second half took, the second half is replayed until it agrees
    with what is known. So the rounds are at most the logarithm of the chunks, whatever the
    traffic, and where rings agree at once no event is read again."""
    of = ["key", "seg", "chunk"]
    own = hot.select(*of, F.lit(False).alias("prior"), "ts_us", "event_id", "cost_class")
    prior = hot.where("last").select("key", "seg", (F.col("chunk") + 1).alias("chunk"), F.lit(True).alias("prior"), "ts_us",
                                     "event_id", "cost_class")
    states = stage(own.union(prior).repartition(*of).sortWithinPartitions(*of, "ts_us", "event_id").mapInPandas(
        lambda it: _speculate(it, limits, window_us), STATES), "throttle-states")
    rounds = replayed = 0
    half = 1
    while half < most:
        group = F.floor(F.col("chunk") / (2 * half)).cast("int")
        came = F.lag("exit").over(Window.partitionBy("key", "seg").orderBy("chunk"))
        begun = states.withColumn("came", came).where(F.col("chunk") % (2 * half) == half)
        differ = stage(begun.where(F.filter("came", lambda t: t >= F.col("begin") - window_us) != F.col("entry"))
                       .select("key", "seg", group.alias("half"), "came"), "throttle-differ")
        if differ.limit(1).count():
            rounds += 1
            second = F.col("chunk") % (2 * half) >= half
            at = ["key", "seg", "half"]
            heads = states.where(second).withColumn("half", group).join(differ, at).select(
                *at, "chunk", F.lit(True).alias("header"), F.col("begin").alias("ts_us"), F.lit(None).cast("long").alias("event_id"),
                "cost_class", F.when(F.col("chunk") % (2 * half) == half, F.col("came")).otherwise(F.col("entry")).alias("known"))
            events = hot.where(second).withColumn("half", group).join(differ.select(*at), at, "left_semi").select(
                *at, "chunk", F.lit(False).alias("header"), "ts_us", "event_id", "cost_class",
                F.lit(None).cast("array<long>").alias("known"))
            mended = stage(heads.union(events).repartition(*at)
                           .sortWithinPartitions(*at, "chunk", F.desc("header"), "ts_us", "event_id")
                           .mapInPandas(lambda it: _mend(it, limits, window_us), STATES), "throttle-mended")
            replayed += mended.count()
            states = stage(states.join(mended.select(*of), of, "left_anti").union(mended), "throttle-states")
        half *= 2
    return states, rounds, replayed


def _decide(batches, limits: dict, window_us: int):
    """Rows sorted by key, segment and chunk, a chunk with a known entry behind a header that
    holds it -> decisions."""
    current, accepted = None, deque()
    for b in batches:
        decisions = []
        for key, seg, chunk, header, ts, cls, known in zip(b["key"], b["seg"], b["chunk"], b["header"], b["ts_us"], b["cost_class"],
                                                           b["known"]):
            if header:
                current, accepted = (key, seg, chunk), ring(limits, cls, [int(t) for t in known])
                continue
            if (key, seg, chunk) != current:
                current, accepted = (key, seg, chunk), ring(limits, cls)
            decisions.append(step(accepted, int(ts), window_us))
        yield _decided(b[~b["header"].astype(bool)], decisions)


def replay(df: DataFrame, key: str = "user_id", ts: str = "ts", id_col: str = "event_id",
           window_s: int = WINDOW_S, limits: dict[str, int] | None = None,
           cost_class: str | None = None, partitions: int | None = None,
           split_idle: bool = True, chunk_events: int = CHUNK_EVENTS) -> Replay:
    """Batch admission for every event: (key, event_id, ts_us, cost_class, admitted, retry_after).

    With ``split_idle`` a hot key is cut at its idle gaps, and where it has none into chunks of
    about ``chunk_events`` (see ``bucket_plan`` and ``_entries``), so it spreads over tasks.
    The result is the same for any ``chunk_events``. Events without a time raise an error.
    """
    if chunk_events < 1:
        raise ValueError("chunk_events must be at least 1")
    limits = limits or {"g": GENERAL_LIMIT, "h": HEAVY_LIMIT}
    window_us = int(window_s * US)
    ev = _prepare(df, key, ts, id_col, cost_class)
    ev = ev.withColumn("ts_us", F.coalesce("ts_us", F.raise_error(F.lit("event without a time")).cast("long")))
    limited = ev.where(F.col("cost_class").isNotNull())
    of = ["key", "seg", "chunk"]
    known, header = F.lit(None).cast("array<long>").alias("known"), F.lit(False).alias("header")
    chunks = rounds = replayed = 0
    if split_idle:
        plan, most = bucket_plan(limited, window_us, chunk_events), 0
        if limited.count() > chunk_events:  # else no key has more than one chunk
            plan = stage(plan, "throttle-buckets")
            most = plan.agg(F.max("chunks")).first()[0] or 0
        marked = _bucketed(limited, window_us).join(plan, ["key", "bucket"])
    else:
        marked, most = limited.withColumn("seg", F.lit(0).cast("long")).withColumn("chunk", F.lit(0)), 0
    if most > 1:
        hot = stage(marked.where("chunks > 1").select(*of, "ts_us", "event_id", "cost_class", "last"), "throttle-hot")
        states, rounds, replayed = _entries(hot, limits, window_us, most)
        chunks = states.count()
        heads = states.select(*of, F.lit(True).alias("header"), F.col("begin").alias("ts_us"), F.lit(None).cast("long").alias("event_id"),
                              "cost_class", F.col("entry").alias("known"))
        rows = marked.select(*of, header, "ts_us", "event_id", "cost_class", known).union(heads)
    else:
        rows = marked.select(*of, header, "ts_us", "event_id", "cost_class", known)
    # without a given number of partitions AQE chooses it
    spread = rows.repartition(partitions, *of) if partitions else rows.repartition(*of)
    out = spread.sortWithinPartitions(*of, F.desc("header"), "ts_us", "event_id").mapInPandas(
        lambda it: _decide(it, limits, window_us), OUT_SCHEMA)
    return Replay(out.unionByName(_exempt(ev)) if cost_class else out, chunks, rounds, replayed)


def throttle(df: DataFrame, *args, **how) -> DataFrame:
    """The decisions of ``replay``, which names the parameters."""
    return replay(df, *args, **how).data


def cost_class_of(path: F.Column, heavy_prefixes: list[str], exempt_prefixes: list[str]) -> F.Column:
    """'h' for heavy prefixes, None for exempt paths (never limited), else 'g'."""
    heavy = F.lit(False)
    for p in heavy_prefixes:
        heavy = heavy | path.startswith(p)
    exempt = F.lit(False)
    for p in exempt_prefixes:
        exempt = exempt | path.startswith(p)
    return F.when(exempt, F.lit(None)).when(heavy, "h").otherwise("g")


# ── Structured Streaming ────────────────────────────────────────────────────
STATE_SCHEMA = ("keys array<string>, classes array<string>, accepted array<array<long>>, of array<int>, ts array<long>, "
                "ids array<long>")
BUCKETS = 1024  # groups of keys that share a state, fixed for the life of a stream


def throttle_stream(stream: DataFrame, key: str = "user_id", ts: str = "ts", id_col: str = "event_id",
                    window_s: int = WINDOW_S, limits: dict[str, int] | None = None,
                    cost_class: str | None = None, watermark: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Streaming form: with a ``watermark`` (a delay) the decisions of the batch, however the events
    are ordered on arrival within it. Without one events are taken to arrive in time order and
    are decided in their micro-batch.

    An event waits in the state until the watermark has passed its time: Spark drops what
    arrives behind the watermark (our stated policy), so nothing can come before it any more. It
    is then decided in (ts, event_id) order, at the next event of its bucket or by an event-time
    timeout. A key holds the events of one watermark delay and one micro-batch, which the
    source's batch size bounds, and goes ``window`` after its newest accepted time.

    Keys are dealt by hash into ``buckets`` groups, a state each: a call of the function costs
    milliseconds whatever it holds, so their number must not grow with the keys. Every key keeps
    a ring of its own in its bucket. Events without a time raise an error.

    Decisions come one watermark delay late. Before the first event Spark's watermark is the epoch,
    so times up to 1970-01-01 count as late. A row without an id is no event but moves the
    watermark: one at the end of a finite stream, ``closing_row``, releases all.
    """
    limits = limits or {"g": GENERAL_LIMIT, "h": HEAVY_LIMIT}
    window_us = int(window_s * US)
    ev = _prepare(stream, key, ts, id_col, cost_class)
    ev = ev.withColumn("ts_us", F.coalesce("ts_us", F.raise_error(F.lit("event without a time")).cast("long")))
    limited = (ev.where(F.col("cost_class").isNotNull()).withColumn("_t", F.timestamp_micros("ts_us"))
               .withWatermark("_t", watermark or f"{int(window_s)} seconds")
               # whole numbers stay exact in pandas only without nulls
               .withColumn("_event", F.col("event_id").isNotNull()).withColumn("event_id", F.coalesce("event_id", F.lit(0)))
               .withColumn("_bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")))

    def fn(_, pdfs, state):
        now_ms = state.getCurrentWatermarkMs()
        rings, rows = {}, []  # key -> (class, ring); (ts, id, key) that wait
        if state.exists:
            keys, classes, accepted, of, times, ids = state.get
            rings = {k: (c, ring(limits, c, a)) for k, c, a in zip(keys, classes, accepted)}
            rows = list(zip(times, ids, [keys[i] for i in of]))
        if not state.hasTimedOut:
            for p in pdfs:
                events = p[p["_event"]]
                rows += zip(events["ts_us"].tolist(), events["event_id"].tolist(), events["key"].tolist())
                for k, c in dict(zip(events["key"], events["cost_class"])).items():
                    if k not in rings:
                        rings[k] = c, ring(limits, c)
        rows.sort()
        due = sum(t <= now_ms * 1000 for t, _, _ in rows) if watermark else len(rows)
        decisions = [step(rings[k][1], t, window_us) for t, _, k in rows[:due]]
        left = rows[due:]
        # a key without waiting events goes once its newest accepted time has left the window
        waits = {k for _, _, k in left}
        goes = {k: int(a[-1] // 1000 + window_s * 1000) for k, (_, a) in rings.items() if k not in waits and len(a)}
        keys = [k for k in rings if k in waits or goes.get(k, -1) >= now_ms]
        if keys:
            number = {k: i for i, k in enumerate(keys)}
            state.update((keys, [rings[k][0] for k in keys], [list(rings[k][1]) for k in keys], [number[k] for _, _, k in left],
                          [t for t, _, _ in left], [i for _, i, _ in left]))
            next_ms = min([int(left[0][0] // 1000)] if left else [goes[k] for k in keys])
            state.setTimeoutTimestamp(max(next_ms, now_ms + 1))
        elif state.exists:
            state.remove()
        if due:
            pdf = pd.DataFrame(rows[:due], columns=["ts_us", "event_id", "key"])
            yield _decided(pdf.assign(cost_class=[rings[k][0] for k in pdf["key"]]), decisions)

    out = limited.groupBy("_bucket").applyInPandasWithState(
        fn, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    return out.unionByName(_exempt(ev.where("event_id is not null"))) if cost_class else out


def closing_row(events: DataFrame, ts: str = "ts", id_col: str = "event_id", after_s: int = 2 * 86_400) -> DataFrame:
    """One row like ``events``, without an id, ``after_s`` seconds behind their last time: as the
    last input of a finite stream it moves a watermark of a shorter delay past all events."""
    kinds = {f.name: f.dataType for f in events.schema.fields}
    last = events.agg((F.max(F.col(ts).cast("timestamp")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(after_s))).alias("t"))
    return last.select(*[F.col("t").cast(kinds[c]).alias(c) if c == ts else F.lit(None).cast(kinds[c]).alias(c)
                         for c in events.columns])
