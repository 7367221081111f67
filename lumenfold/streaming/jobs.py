"""Time-driven work as Structured Streaming: incremental ingest, sessions, throttle, running statistics.

Output modes and late data are this library's own choices: windows append once the watermark has passed them,
rows later than the watermark are dropped, and each job has a batch twin with the same results on data in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenfold.sources import versions


def ingest_batch(batch: DataFrame, state_path: str, key: str, same: list[str], process, compact_every: int = 16) -> int:
    """One micro-batch: only inputs whose stamp differs from the one stored for their key go to process(df).

    The state has one row a key, the stamp last processed (versions.upsert), so an input that returns to an older stamp is
    processed again.  A key that comes more than once in a batch counts by its greatest stamp.  The state is committed after
    the work: a batch that ran and failed before that is processed again, a batch whose state is there is not.
    """
    spark = batch.sparkSession
    state = versions.read_upserted(spark, state_path, "state", [key])
    newest = batch.groupBy(key).agg(F.max(F.struct(*same)).alias("_stamp"))
    todo = batch.join(newest, key).filter(F.struct(*same).eqNullSafe(F.col("_stamp"))).drop("_stamp")
    if state is not None:
        stored = state.select(key, F.struct(*same).alias("_stored"))
        todo = todo.join(stored, key, "left").filter(~F.col("_stored").eqNullSafe(F.struct(*same))).drop("_stored")
    todo = todo.persist()
    n = todo.count()
    if n:
        process(todo)
        versions.upsert(spark, state_path, "state", todo.select(key, *same).dropDuplicates([key]), [key], compact_every)
    todo.unpersist()
    return n


def ingest_state(spark: SparkSession, state_path: str, key: str) -> DataFrame | None:
    """The stamp last processed of each key."""
    return versions.read_upserted(spark, state_path, "state", [key])


def start_ingest(stream: DataFrame, state_path: str, key: str, same: list[str], process, checkpoint: str, compact_every: int = 16):
    def each(batch: DataFrame, _: int) -> None:
        ingest_batch(batch, state_path, key, same, process, compact_every)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def capture_sessions(captures: DataFrame, lateness: str = "2 hours", gap: str = "30 minutes") -> DataFrame:
    """(model, first, last, captures) of each session, once the watermark says that it is over."""
    return (
        captures.withWatermark("capture_datetime", lateness)
        .groupBy("model", F.session_window("capture_datetime", gap).alias("w"))
        .agg(F.min("capture_datetime").alias("first"), F.max("capture_datetime").alias("last"), F.count("*").alias("captures"))
        .drop("w")
    )


def idle_expiry(activity: DataFrame, protected: DataFrame, idle: str = "24 hours", lateness: str = "1 hour") -> DataFrame:
    """Sessions that have been idle for the limit: a session window closes once nothing came for so long."""
    closed = activity.withWatermark("at", lateness).groupBy("session", F.session_window("at", idle).alias("w")).agg(F.max("at").alias("last"))
    return closed.join(protected, "session", "left_anti").select("session", "last")


def running_statistics(rows: DataFrame, at: str, by: str, value: str, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    w = rows.withWatermark(at, lateness).groupBy(F.window(at, width).alias("w"), by)
    return w.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("worst"), F.approx_percentile(value, [0.5, 0.95]).alias("q")).select(F.col("w.start").alias("start"), by, "n", "mean", "worst", "q")


class Throttle(StatefulProcessor):
    """Keeps a client's failures of the last window and gives, for each new one, how long the client is locked.

    A failure counts those of its client at most a window before it, itself included.  The list loses what no
    failure that may still come can count, and ends by a timer once the watermark is a window past its last failure.
    """

    def __init__(self, window_seconds: float = 300.0, most: int = 8, lock_seconds: float = 60.0):
        self.window, self.most, self.lock = window_seconds, most, lock_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getListState("failures", "at double, event_id long")

    def _keep(self, kept: list[tuple[float, int]]) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if kept:
            self.failures.put(kept)
            self.handle.registerTimer(int((max(kept)[0] + self.window) * 1000) + 1)
        else:
            self.failures.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [(r[0], r[1]) for r in self.failures.get()]
        new = [x for part in rows for x in zip(part["at"].tolist(), part["event_id"].tolist(), strict=True)]
        kept = sorted(kept + new)
        out = []
        for at, event_id in sorted(new):
            recent = sum(at - self.window < t and (t, e) <= (at, event_id) for t, e in kept)
            out.append((key[0], event_id, recent, self.lock if recent >= self.most else 0.0))
        passed = timerValues.getCurrentWatermarkInMs() / 1000 - self.window
        self._keep([x for x in kept if x[0] > passed])
        yield pd.DataFrame(out, columns=["client", "event_id", "recent", "locked_seconds"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000 - self.window
        self._keep([(r[0], r[1]) for r in self.failures.get() if r[0] > passed])
        yield pd.DataFrame({"client": pd.Series(dtype="int64"), "event_id": pd.Series(dtype="int64"), "recent": pd.Series(dtype="int64"), "locked_seconds": pd.Series(dtype="float64")})

    def close(self) -> None:
        pass


def failure_throttle(failures: DataFrame, lateness: str = "1 minute", **limits) -> DataFrame:
    """failures(client long, event_id long, at double in seconds) -> (client, event_id, recent, locked_seconds).

    Failures that are more than `lateness` behind the latest one are late: Spark drops them, and they get no answer.
    """
    timed = failures.withColumn("event_time", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).withWatermark("event_time", lateness)
    return timed.groupBy("client").transformWithStateInPandas(
        statefulProcessor=Throttle(**limits), outputStructType="client long, event_id long, recent long, locked_seconds double",
        outputMode="append", timeMode="EventTime",
    )


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
