"""Streaming forms of the time-driven behaviour: decay, access counts, timelines, chat budgets,
latest-wins upserts. Extensions: the batch operators define the results.

Each function takes a streaming frame and gives a streaming frame; run_to_table() runs one over
what there is now and returns what it wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400


def timeline(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts by tumbling window and type."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def access_counts(events: DataFrame) -> DataFrame:
    """Accesses and the last one of each key."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("access_count"), F.max("ts").alias("last_accessed"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Event and value totals by session."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", F.col("s.start").alias("start"), "n", F.round("total", 2).alias("total"))


def first_seen(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events without repetitions of their key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def decaying(events: DataFrame, ttl: float = 30.0, more: float = 1.0) -> DataFrame:
    """Remaining days of each key: an access adds some, days between accesses take theirs away."""

    def update(key: tuple, frames, state: GroupState):
        left, last = state.get if state.exists else (ttl, None)
        for f in frames:
            for ts in sorted(f.ts):
                if last is not None:
                    left = max(0.0, left - max(0.0, (ts.timestamp() - last) / 86400))
                last = ts.timestamp() if last is None else max(last, ts.timestamp())
                left += more
        state.update((left, last))
        yield pd.DataFrame({"user_id": [key[0]], "ttl_days": [left]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, ttl_days double", "left double, last double", "update", GroupStateTimeout.NoTimeout)


class Fading(StatefulProcessor):
    """Remaining days of each key by event time, with a timer for the moment when nothing is left: a
    key that is not seen again is told as expired, and its state goes, without any further row."""

    def __init__(self, ttl: float, more: float):
        self.ttl, self.more = ttl, more

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("left", "left double, last double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        left, last = self.state.get() if self.state.exists() else (self.ttl, None)
        for ts in sorted(t for f in rows for t in f.ts):
            now = ts.timestamp()
            if last is not None:
                left -= max(0.0, now - last) / DAY
            if left <= 0:  # it had vanished, whether or not its timer has run yet
                left = self.ttl
            last = now if last is None else max(last, now)
            left += self.more
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.state.update((left, last))
        self.handle.registerTimer(int((last + left * DAY) * 1000))
        yield pd.DataFrame({"user_id": [key[0]], "ttl_days": [left], "last": [last], "expired": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.state.get()[1]
        self.state.clear()
        yield pd.DataFrame({"user_id": [key[0]], "ttl_days": [0.0], "last": [last], "expired": [True]})

    def close(self) -> None:
        pass


def fading(events: DataFrame, ttl: float = 30.0, more: float = 1.0, late: str = "1 hour") -> DataFrame:
    """As decaying(), with keys that vanish: user_id, ttl_days after the key's last access, last (its
    seconds), expired. A key that comes back when nothing was left begins anew, so that what comes out
    does not depend on when timers ran; rows later than the watermark are not counted."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.withWatermark("ts", late).select("user_id", "ts")
    return rows.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=Fading(ttl, more), outputStructType="user_id long, ttl_days double, last double, expired boolean", outputMode="Update", timeMode="EventTime"
    )


def run_to_table(spark: SparkSession, stream: DataFrame, root: str, mode: str = "complete", merge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over the input there is, writing each batch to a table under root.

    complete: the last batch is the result. update, append: all batches are kept, and merge makes
    one result of them.
    """
    at = f"{root}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        out = batch.withColumn("batch", F.lit(number))
        out.write.mode("overwrite").parquet(f"{at}/table" if mode == "complete" else f"{at}/table/part={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    table = spark.read.option("recursiveFileLookup", True).parquet(f"{at}/table")
    return (merge(table) if merge else table).drop("batch")
