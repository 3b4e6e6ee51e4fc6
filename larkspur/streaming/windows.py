"""Event-time operators that run on batch and streaming frames alike, and stream ingest."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _timed(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    x = df.withColumn("_ts", F.col(ts).cast("timestamp"))
    return x.withWatermark("_ts", late) if late else x


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], aggregates: list, late: str | None = None) -> DataFrame:
    """Aggregates per fixed window; ``late`` bounds how late a row may come in a stream."""
    return sliding(df, ts, width, None, keys, aggregates, late)


def sliding(df: DataFrame, ts: str, width: str, step: str | None, keys: list[str], aggregates: list, late: str | None = None) -> DataFrame:
    """Aggregates per window of ``width`` every ``step``; columns ``window_start``, ``window_end``."""
    w = F.window("_ts", width, step) if step else F.window("_ts", width)
    out = _timed(df, ts, late).groupBy(w.alias("_w"), *keys).agg(*aggregates)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"])


def session_windows(df: DataFrame, ts: str, gap: str, keys: list[str], aggregates: list, late: str | None = None) -> DataFrame:
    """Aggregates per session; a row that comes ``gap`` or later after the last begins a new one."""
    out = _timed(df, ts, late).groupBy(F.session_window("_ts", gap).alias("_w"), *keys).agg(*aggregates)
    return out.select(F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *[c for c in out.columns if c != "_w"])


def deduplicated(df: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """Drop rows whose key came already within the watermark (stream) or at all (batch)."""
    x = _timed(df, ts, late)
    return (x.dropDuplicatesWithinWatermark(keys) if df.isStreaming else x.dropDuplicates(keys)).drop("_ts")


def buffered_append(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append a stream to parquet in micro-batches; without ``interval`` it takes what is there and ends."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def fan_out(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Hand each micro-batch to ``apply`` (an upsert, say); batch numbers make it repeatable."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


#: State store that keeps state on disk and takes timers.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _totals_processor(idle_ms: int | None):
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Totals(StatefulProcessor):
        """Count and sum of a key, and when its state is due to go."""

        def init(self, handle) -> None:  # noqa: ANN001
            self.handle = handle
            self.state = handle.getValueState("totals", "n long, total double, due long")

        def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
            n, total, due = self.state.get() if self.state.exists() else (0, 0.0, 0)
            if due and due <= timerValues.getCurrentWatermarkInMs():
                # Due already, though its timer comes after the rows.
                self.handle.deleteTimer(due)
                n, total, due = 0, 0.0, 0
            then = due
            for f in rows:
                n += len(f)
                total += float(f["value"].sum())
                if idle_ms is not None and f["at"].notna().any():
                    then = max(then, int(f["at"].max()) + idle_ms)
            if then > due:
                if due:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(then)
            self.state.update((n, total, then))
            yield pd.DataFrame({"key": [key[0]], "n": [n], "total": [total]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
            self.state.clear()
            return iter([])

        def close(self) -> None:
            pass

    return Totals()


def running_totals(stream: DataFrame, ts: str, key: str, value: str, late: str = "1 day", idle_seconds: int | None = None) -> DataFrame:
    """Custom keyed state: per micro-batch, each touched key's count and sum so far.

    State is two numbers per key, whatever the number of rows, and late rows
    count.  With ``idle_seconds`` the state of a key is dropped once the watermark
    has passed its last event by so much, and a later event begins anew; rows
    later than ``late`` are then left out.  This takes the newer state API
    (``transformWithState``) and its RocksDB store, which is set on the session.
    """
    slim = _timed(stream, ts, late if idle_seconds is not None else None).select(F.col(key).cast("long").alias("key"), F.col(value).cast("double").alias("value"), F.unix_millis("_ts").alias("at"), "_ts")
    schema = "key long, n long, total double"
    if idle_seconds is not None or _has_protobuf():
        stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        processor = _totals_processor(None if idle_seconds is None else idle_seconds * 1000)
        return slim.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Update", timeMode="None" if idle_seconds is None else "EventTime")

    def step(k: tuple, frames, state):  # noqa: ANN001, ANN202
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n += len(f)
            total += float(f["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "total": [total]})

    return slim.groupBy("key").applyInPandasWithState(step, schema, "n long, total double", "update", "NoTimeout")


def _has_protobuf() -> bool:
    """Whether the newer state API can talk to its workers."""
    try:
        import google.protobuf  # noqa: F401
    except ImportError:
        return False
    return True
