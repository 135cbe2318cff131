"""Driver queries that run streams: the table arrives in parts, and the stream is stopped and started again after each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.operators.graph import shared_dir
from alertmill.plans.queries import query, table
from alertmill.streaming import stateful

_c = F.col
#: Parts in which events arrive, by time.
PARTS = 3


def _arriving(spark, sf, step) -> tuple[DataFrame, str]:
    """What ``step`` makes of the stream of events, restarted after each part, and its checkpoint."""
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", _c("ts").cast("timestamp").alias("ts"))
    us = F.unix_micros("ts")
    low, high = e.agg(F.min(us), F.max(us)).first()
    width = max(1, -(-(high - low + 1) // PARTS)) if low is not None else 1
    out = None
    for i in range(PARTS):
        e.where((us >= (low or 0) + i * width) & (us < (low or 0) + (i + 1) * width)).write.parquet(f"{home}/in/part={i}")
        out = stateful.drain(step(spark.readStream.schema(e.schema).parquet(f"{home}/in/part=*")), f"{home}/out", f"{home}/checkpoint")
    return out, f"{home}/checkpoint"


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM events")
def stream_numbers(spark, sf):
    out, _ = _arriving(spark, sf, lambda s: stateful.numbered(s, "user_id", "ts", "event_id"))
    return out.select(_c("key").alias("user_id"), _c("id").alias("event_id"), "number")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, arg_min(event_id, (ts, event_id)) AS first, arg_max(event_id, (ts, event_id)) AS last, count(*) AS n FROM i GROUP BY user_id, k""")
def stream_lives(spark, sf):
    """Lives that ended in the stream and those that its state still holds."""
    out, checkpoint = _arriving(spark, sf, lambda s: stateful.lives(s, "user_id", "ts", "event_id", 12 * 3600))
    every = out.unionByName(stateful.held(spark, checkpoint, "live").select("key", "first", "last", "n"))
    return every.withColumnRenamed("key", "user_id")
