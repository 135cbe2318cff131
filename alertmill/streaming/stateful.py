"""Keyed state with timers: running numbers, lives that end when nothing follows in time, a cache that forgets.

State lies in RocksDB under the stream's checkpoint, so a stream that was stopped goes on where it was, and what it still holds is
read back as a table. A key's rows of one micro-batch meet in one task, so bound a micro-batch by files where keys are hot.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(rows: Iterator[Row], *by: str) -> list[Row]:
    """A key's rows in order, nulls last; rows, as a table for each of many small keys costs far more than its rows."""
    return sorted(rows, key=lambda r: [(r[c] is None, r[c]) if r[c] is None or r[c] == r[c] else (True, None) for c in by])


class _Numbers(StatefulProcessor):
    """Rows of a key numbered on from the last one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before = self.seen.get()
        n = before[0] if before is not None else 0
        for r in _in_order(rows, "ord", "i"):
            n += 1
            yield Row(key=key[0], id=r["i"], number=n)
        self.seen.update((n,))

    def close(self) -> None:
        pass


def numbered(stream: DataFrame, key: str, order: str, ident: str) -> DataFrame:
    """(key, id, number): every row with its running number in its key, in the order of arrival, within a micro-batch by ``order`` and id."""
    kinds = stream.schema
    out = T.StructType([T.StructField("key", kinds[key].dataType), T.StructField("id", kinds[ident].dataType), T.StructField("number", T.LongType())])
    rows = stream.select(F.col(key).alias("k"), F.col(order).alias("ord"), F.col(ident).alias("i"))
    return rows.groupBy("k").transformWithState(_Numbers(), out, "Append", "None")


LIVE = "first long, last long, at long, n long"


class _Lives(StatefulProcessor):
    """A key's life is extended by each row and ends when none follows within the limit, by a later row or by the watermark."""

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.live = handle, handle.getValueState("live", LIVE)

    def due(self, at: int) -> int:
        return -(-(at + self.ttl) // 1000)

    def ended(self, key: tuple, live: tuple) -> Row:
        return Row(key=key[0], first=live[0], last=live[1], n=live[3])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        now, before = self.live.get(), None
        if now is not None:
            before = self.due(now[2])
        for r in _in_order(rows, "us", "i"):
            at, i = r["us"], r["i"]
            if now is not None and at - now[2] > self.ttl:
                yield self.ended(key, now)
                now = None
            now = (i, i, at, 1) if now is None else (now[0], i, at, now[3] + 1) if at >= now[2] else (now[0], now[1], now[2], now[3] + 1)
        self.live.update(now)
        if before != self.due(now[2]):
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(self.due(now[2]))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        live = self.live.get()
        if live is not None:
            self.live.clear()
            yield self.ended(key, live)

    def close(self) -> None:
        pass


def lives(stream: DataFrame, key: str, at: str, ident: str, ttl_seconds: int, late: str = "0 seconds") -> DataFrame:
    """(key, first, last, n): lives that have ended, with the ids (long) of their first and last row and their number of rows.

    Two rows of a key are of one life if they are at most ``ttl_seconds`` apart in event time. Lives that may still go on are the
    stream's state, ``live``. Rows without a time or later than ``late`` behind are dropped.
    """
    out = T.StructType([T.StructField("key", stream.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in ("first", "last", "n"))])
    rows = stream.where(F.col(at).isNotNull()).withWatermark(at, late).select(F.col(key).alias("k"), F.col(at).alias("at"), F.unix_micros(at).alias("us"), F.col(ident).cast("long").alias("i"))
    return rows.groupBy("k").transformWithState(_Lives(ttl_seconds * 1_000_000), out, "Append", "EventTime")


class _Cache(StatefulProcessor):
    """The last value put for a key, forgotten by the state store some time after it was put."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "value string", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before, put = self.value.get(), False
        found = before[0] if before is not None else None
        for r in _in_order(rows, "i"):
            if r["v"] is None:
                yield Row(key=key[0], id=r["i"], value=found)
            else:
                found, put = r["v"], True
        if put:
            self.value.update((found,))

    def close(self) -> None:
        pass


def cached(stream: DataFrame, key: str, ident: str, value: str, ttl_seconds: int) -> DataFrame:
    """(key, id, value): rows without a value look up the last one put for their key, null where none was put or it is older, by the clock, than ``ttl_seconds``."""
    kinds = stream.schema
    out = T.StructType([T.StructField("key", kinds[key].dataType), T.StructField("id", kinds[ident].dataType), T.StructField("value", T.StringType())])
    rows = stream.select(F.col(key).alias("k"), F.col(ident).alias("i"), F.col(value).cast("string").alias("v"))
    return rows.groupBy("k").transformWithState(_Cache(ttl_seconds * 1000), out, "Append", "ProcessingTime")


def drain(stream: DataFrame, out: str, checkpoint: str, one_batch: bool = False) -> DataFrame:
    """Runs over what is there now and has not been done, ends, and gives all rows so far: each micro-batch's rows are in ``out`` once.

    State that goes by the clock always asks for another batch, so streams such as ``cached`` end only with ``one_batch``.
    """
    conf, before = stream.sparkSession.conf, stream.sparkSession.conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**({"once": True} if one_batch else {"availableNow": True})).start().awaitTermination()
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def held(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """(key, the fields of the state variable ``name``): what a stopped stream's state holds after its last commit."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    return rows.select(F.col("key.k").alias("key"), "value.*")
