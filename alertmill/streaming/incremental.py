"""Structured Streaming over folders of alerts: each alert once, progress counted, old verdicts expired.

A stream's checkpoint is what a batch run's list of finished alerts is: after a stop it goes on behind the last commit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def once(stream: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key; keys older than the watermark are forgotten, so state does not grow with the stream."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def resume(stream: DataFrame, out: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Runs over what is there now and has not been done, and ends. A batch that is tried again replaces its own rows."""

    def put(df: DataFrame, batch: int) -> None:
        step(df).withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def progress(stream: DataFrame, at: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(window, verdict, done): finished alerts by time window."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), "verdict").agg(F.count("*").alias("done"))


def numbered(stream: DataFrame, run: str) -> DataFrame:
    """Events with a running number for each run, kept in state: (run, number, alert_id)."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for pdf in batches:
            pdf = pdf.sort_values("alert_id")
            yield pd.DataFrame({"run": [key[0]] * len(pdf), "number": range(n + 1, n + 1 + len(pdf)), "alert_id": pdf["alert_id"].tolist()})
            n += len(pdf)
        state.update((n,))

    return stream.groupBy(run).applyInPandasWithState(count, "run string, number long, alert_id string", "n long", "append", GroupStateTimeout.NoTimeout)


def expired(stream: DataFrame, key: str, at: str, ttl_seconds: int) -> DataFrame:
    """(key, last, expired): verdicts with their last time, marked once when event time has passed their limit."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last": [pd.Timestamp(last, unit="us")], "expired": [True]})
            return
        last = max([state.get[0] if state.exists else 0, *(int(pd.Timestamp(t).value // 1000) for pdf in batches for t in pdf[at])])
        state.update((last,))
        state.setTimeoutTimestamp(last // 1000 + ttl_seconds * 1000)
        yield pd.DataFrame({key: [k[0]], "last": [pd.Timestamp(last, unit="us")], "expired": [False]})

    rows = stream.withWatermark(at, "0 seconds").groupBy(key)
    return rows.applyInPandasWithState(step, f"{key} string, last timestamp, expired boolean", "last long", "update", GroupStateTimeout.EventTimeTimeout)


def sink(df: DataFrame, put: Callable[[list[dict]], None], checkpoint: str):
    """Sends each micro-batch's events on as JSON-ready rows, in order of their number; a batch is bounded by ``per_trigger``."""
    return df.writeStream.foreachBatch(lambda b, _: put([r.asDict(recursive=True) for r in b.orderBy(*b.columns[:2]).toLocalIterator()])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
