"""Structured Streaming counterparts: deduplication, windowed counts, research window, stuck rows, idempotent batches (§2.11)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType, *, files_per_trigger: int = 1000) -> DataFrame:
    """Events from a growing folder of Parquet files; ``ts`` becomes an instant in UTC."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def first_deliveries(events: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str | None = "10 minutes") -> DataFrame:
    """Count and sum of each type in tumbling or sliding windows, with late events up to the watermark (``late`` None: the stream has one)."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = (events.withWatermark("ts", late) if late else events).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(28,6)")).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: runs of events with no gap longer than ``gap``."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def inside_window(events: DataFrame, start: str, end: str) -> DataFrame:
    """Events of the research window [start, end]."""
    return events.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") <= F.lit(end).cast("timestamp")))


def stuck(events: DataFrame, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """Users that sent nothing for ``minutes`` of event time after their last event: (``user_id``, ``last_us``, ``n``)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "last_us": [last], "n": [n]})
            return
        last, n = state.get if state.exists else (0, 0)
        for b in batches:
            last, n = max(last, int(b["us"].max())), n + len(b)
        state.update((last, n))
        state.setTimeoutTimestamp(max(last // 1000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    rows = events.withWatermark("ts", late).select("user_id", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, last_us long, n long", "last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def span(events: DataFrame) -> str:
    """A watermark delay under which no event of a bounded replay is late, in whatever order its files are read."""
    low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    return f"{((high or 0) - (low or 0)) // 1_000_000 + 2} seconds"


def last_states(batches: DataFrame, key: list[str]) -> DataFrame:
    """The last row of each key over the folders of ``write_batches`` in update mode."""
    rest = [c for c in batches.columns if c not in (*key, "batch")]
    return batches.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*key, *(F.col(f"v.{c}").alias(c) for c in rest))


def write_batches(stream: DataFrame, target: str, checkpoint: str, mode: str = "append"):
    """Write each micro-batch to a folder of its own, so that a replayed batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
