"""The throttle on keys that are never idle, and on streams out of order."""

import random

import pytest
from pyspark.sql import functions as F

from veridata.streaming import throttle as TH

US = TH.US


def brute(rows, window, limits):
    rings, out = {}, {}
    for key, i, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        accepted = rings.setdefault(key, TH.ring(limits, "g"))
        out[i] = TH.step(accepted, t * US, window * US)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id long, event_id long, t long").withColumn("ts", F.timestamp_seconds("t"))


def decisions(df):
    return {r["event_id"]: (r["admitted"], r["retry_after"]) for r in df.collect()}


def traffic(kind):
    rng = random.Random(kind)
    if kind == "steady":  # one event a second: rings keep their phase, every border differs
        times = range(3000)
    elif kind == "random":
        t, times = 0, []
        for _ in range(3000):
            t += rng.choice([0, 0, 1, 2, 5, 20, 61])
            times.append(t)
    elif kind == "bursts":
        times = [100 * b + x for b in range(60) for x in sorted(rng.choices(range(101), k=rng.choice([1, 3, 60])))]
    else:  # below the limit: all rings agree at once
        times = range(0, 60_000, 20)
    rows = [(7, i, t) for i, t in enumerate(times)]
    return rows + [(8 + i % 5, 100_000 + i, rng.randrange(5000)) for i in range(200)]


@pytest.mark.parametrize("kind", ["steady", "random", "bursts", "sparse"])
def test_chunks_of_any_size_give_the_same(spark, kind):
    rows, limits = traffic(kind), {"g": 5}
    want = brute(rows, 60, limits)
    ev = frame(spark, rows)
    for chunk_events in (50, 333, 1_000_000):
        got = TH.replay(ev, window_s=60, limits=limits, chunk_events=chunk_events)
        assert decisions(got.data) == want
        if chunk_events == 1_000_000:
            assert (got.chunks, got.rounds, got.replayed) == (0, 0, 0)
        elif kind == "steady":
            assert got.chunks > 3000 / chunk_events / 2 and 0 < got.rounds <= got.chunks.bit_length() and got.replayed
        elif kind == "sparse":
            assert got.chunks > 1 and (got.rounds, got.replayed) == (0, 0)


def test_a_hot_key_spreads_over_tasks(spark):
    ev = frame(spark, traffic("steady"))
    plan = TH.bucket_plan(TH._prepare(ev, "user_id", "ts", "event_id", None), 60 * US, 300)
    hot = plan.where("key = '7:g'")
    assert hot.select("seg").distinct().count() == 1 and hot.select("chunk").distinct().count() == 10
    assert hot.where("last").count() == 9 and {r["chunks"] for r in hot.collect()} == {10}


def test_chunk_events_must_be_positive(spark):
    with pytest.raises(ValueError):
        TH.replay(frame(spark, [(1, 1, 1)]), chunk_events=0)


@pytest.mark.parametrize("order", ["time", "shuffled", "backwards"])
def test_stream_in_any_order_equals_the_batch(spark, tmp_path, order):
    rng = random.Random(order)
    rows = [(i % 3, i, 1_000_000 + i * 2 + rng.randrange(3)) for i in range(240)]
    limits = {"g": 4}
    want = brute(rows, 30, limits)
    fed = sorted(rows, key=lambda r: r[2])
    if order == "shuffled":
        rng.shuffle(fed)
    elif order == "backwards":
        fed.reverse()
    src = str(tmp_path / "in")
    for at in range(0, len(fed), 60):
        frame(spark, fed[at:at + 60]).coalesce(1).write.mode("append").parquet(src)
    ev = frame(spark, rows)
    TH.closing_row(ev, after_s=2000).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    # the watermark delay covers all of the disorder
    out = TH.throttle_stream(stream, window_s=30, limits=limits, watermark="600 seconds")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert decisions(spark.read.parquet(str(tmp_path / "out"))) == want
    assert sum(not ok for ok, _ in want.values()) > 20


def test_events_wait_for_the_watermark(spark, tmp_path):
    src = str(tmp_path / "in")
    ev = frame(spark, [(1, 1, 100), (1, 2, 40)])
    ev.coalesce(1).write.parquet(src)
    frame(spark, [(1, 3, 70), (1, 4, 130)]).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = TH.throttle_stream(stream, window_s=60, limits={"g": 1}, watermark="50 seconds")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    # the watermark ends at 80: the events at 40 and 70 are decided, those at 100 and 130 wait
    assert decisions(spark.read.parquet(str(tmp_path / "out"))) == {2: (True, None), 3: (False, 31)}


def test_the_stream_keeps_one_state_a_bucket(spark, tmp_path):
    """Calls and state rows do not grow with the keys; ids beyond 2^53 stay exact beside the closing row."""
    rng = random.Random(6)
    rows = [(i % 40, 2 ** 60 + i, 1_000_000 + i * 2 + rng.randrange(3)) for i in range(400)]
    want = brute(rows, 200, {"g": 2})
    src = str(tmp_path / "in")
    for at in (0, 200):
        frame(spark, rows[at:at + 200]).coalesce(1).write.mode("append").parquet(src)
    ev = frame(spark, rows)
    TH.closing_row(ev, after_s=2000).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = TH.throttle_stream(stream, window_s=200, limits={"g": 2}, watermark="600 seconds", buckets=4)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert decisions(spark.read.parquet(str(tmp_path / "out"))) == want
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 4
    assert any(not ok for ok, _ in want.values())
