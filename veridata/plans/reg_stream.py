"""Checks for the per-key sliding-window throttle (ST1–ST3)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..streaming import throttle as TH
from .registry import register
from .views import table

DAY = 86_400
LIMIT = 3
CLASS_LIMITS = {"h": 2, "g": 3}
HEAVY_TYPES = ["purchase", "signup"]


def _oracle(class_sql: str, limit_sql: str) -> str:
    """Recursive CTE: one step per event of a key, state = accepted marks."""
    w = DAY * 1_000_000
    kept = f"list_filter(r.acc, lambda x: x >= e.t - {w})"
    return f"""
WITH RECURSIVE e AS (
  SELECT CAST(user_id AS VARCHAR) || ':' || cls AS k, event_id, epoch_us(ts) AS t, lim,
         row_number() OVER (PARTITION BY user_id, cls ORDER BY ts, event_id) AS rn
  FROM (SELECT *, {class_sql} AS cls, {limit_sql} AS lim FROM events) WHERE cls IS NOT NULL),
r AS (
  SELECT k, rn, event_id, true AS admitted, NULL::BIGINT AS retry_after, [t] AS acc FROM e WHERE rn = 1
  UNION ALL
  SELECT e.k, e.rn, e.event_id, len({kept}) < e.lim,
         CASE WHEN len({kept}) >= e.lim THEN ({w} - (e.t - list_min({kept}))) // 1000000 + 1 END,
         CASE WHEN len({kept}) < e.lim THEN list_append({kept}, e.t) ELSE {kept} END
  FROM r JOIN e ON e.k = r.k AND e.rn = r.rn + 1)
SELECT event_id, admitted, retry_after::BIGINT AS retry_after FROM r
UNION ALL SELECT event_id, true, NULL FROM events WHERE ({class_sql}) IS NULL"""


_BATCH_SQL = _oracle("'g'", str(LIMIT))


@register("throttle_batch", _BATCH_SQL)
def q_throttle_batch(spark, d):
    out = TH.throttle(table(spark, d, "events"), window_s=DAY, limits={"g": LIMIT})
    return out.select("event_id", "admitted", "retry_after")


@register("throttle_classes", _oracle(
    "CASE WHEN event_type IN ('purchase', 'signup') THEN 'h' ELSE 'g' END",
    "CASE WHEN event_type IN ('purchase', 'signup') THEN 2 ELSE 3 END"))
def q_throttle_classes(spark, d):
    ev = table(spark, d, "events")
    ev = ev.withColumn("cost_class", F.when(F.col("event_type").isin(HEAVY_TYPES), "h").otherwise("g"))
    out = TH.throttle(ev, window_s=DAY, limits=CLASS_LIMITS, cost_class="cost_class")
    return out.select("event_id", "admitted", "retry_after")


@register("throttle_paths", _oracle(
    "CASE WHEN event_type = 'click' THEN NULL WHEN event_type IN ('purchase', 'signup') THEN 'h' ELSE 'g' END",
    "CASE WHEN event_type IN ('purchase', 'signup') THEN 2 ELSE 3 END"))
def q_throttle_paths(spark, d):
    """Classes by path prefix, one of them exempt (ST2)."""
    path = F.concat(F.lit("/api/"), F.col("event_type"))
    cls = TH.cost_class_of(path, [f"/api/{t}" for t in HEAVY_TYPES], ["/api/click"])
    out = TH.throttle(table(spark, d, "events").withColumn("cost_class", cls), window_s=DAY, limits=CLASS_LIMITS,
                      cost_class="cost_class")
    return out.select("event_id", "admitted", "retry_after")


def _replayed(spark, d, files: int):
    """The events as a stream of ``files`` files, one a micro-batch, dealt by a hash of their ids
    and not by time, with a closing row behind them."""
    events = table(spark, d, "events")
    run = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    for i in range(files):
        part = events if files == 1 else events.where(F.pmod(F.xxhash64("event_id"), F.lit(files)) == i)
        part.coalesce(1).write.mode("append").parquet(f"{run}/in")
    TH.closing_row(events, after_s=1000 * DAY).coalesce(1).write.mode("append").parquet(f"{run}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{run}/in")
    return stream, run


def _drained(spark, out, run):
    q = (out.writeStream.format("parquet").option("path", f"{run}/out")
         .option("checkpointLocation", f"{run}/ckpt").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{run}/out").select("event_id", "admitted", "retry_after")


@register("throttle_stream", _BATCH_SQL)
def q_throttle_stream(spark, d):
    """The events file replayed as a stream (availableNow), decisions written
    to a Parquet sink under the shared checkpoint folder, then read back."""
    stream, run = _replayed(spark, d, 1)
    return _drained(spark, TH.throttle_stream(stream, window_s=DAY, limits={"g": LIMIT}, watermark="1 day"), run)


@register("throttle_stream_disorder", _BATCH_SQL)
def q_throttle_stream_disorder(spark, d):
    """The same in three files that each cover the whole time: every event waits for its order."""
    stream, run = _replayed(spark, d, 3)
    return _drained(spark, TH.throttle_stream(stream, window_s=DAY, limits={"g": LIMIT}, watermark="400 days"), run)


# one key with a third of all events, one a second and never idle
HOT_SQL = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS user_id, " \
          "CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * {seconds} ELSE ts END AS ts FROM {source}"


@register("throttle_hot_key", _BATCH_SQL.replace(
    "FROM events", "FROM (" + HOT_SQL.format(seconds="(event_id // 3)", source="events") + ")").replace(str(DAY * 1_000_000), str(60 * TH.US)))
def q_throttle_hot_key(spark, d):
    """A key of continuous traffic in chunks of 200 events, a 60-second window."""
    sql = HOT_SQL.format(seconds="(event_id DIV 3)", source="{events}")
    return TH.throttle(spark.sql(sql, events=table(spark, d, "events")), window_s=60, limits={"g": LIMIT},
                       chunk_events=200).select("event_id", "admitted", "retry_after")
