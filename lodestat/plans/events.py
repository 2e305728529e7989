"""Event queries: the batch counterparts of the streaming pipelines, and the streams themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.sources.tables import ensure_checkpoint_dir, table
from lodestat.streaming import pipelines as P


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def event_windows(spark, d):
    return P.windowed(events(spark, d), "1 day").select(F.unix_micros("start").alias("start_us"), "event_type", "n", "total")


def event_sliding(spark, d):
    return P.windowed(events(spark, d), "2 days", "1 day").select(F.unix_micros("start").alias("start_us"), "event_type", "n", "total")


def event_sessions(spark, d):
    return P.sessions(events(spark, d), "6 hours").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def event_research_window(spark, d):
    return P.inside_window(events(spark, d), "2024-01-10 00:00:00", "2024-01-13 00:15:00").select("event_id", "user_id")


def sweep_abandoned(spark, d):
    """D-G as a pure function: users silent for 60 minutes at a fixed time."""
    last = events(spark, d).groupBy("user_id").agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    return last.where(F.col("last") < F.lit("2024-01-30 00:00:00").cast("timestamp") - F.expr("INTERVAL 60 MINUTES")).select("user_id", F.unix_micros("last").alias("last_us"), "n")


def stream_windows(spark, d):
    """The tumbling windows as a stream run to its end over the same files, read back from its sink.

    The replay is bounded: the watermark spans it, so that no event of any file is late, and
    windows are written whenever they change, so that the last ones are there as well.
    """
    path = f"{d}/events*.parquet"
    raw = spark.read.parquet(path)
    delay = P.span(raw.withColumn("ts", F.col("ts").cast("timestamp")))
    stream = P.windowed(P.first_deliveries(P.event_stream(spark, path, raw.schema), ["event_id"], delay), "1 day", late=None)
    base = f"{ensure_checkpoint_dir(spark)}/lodestat-stream-{uuid.uuid4().hex}"
    P.write_batches(stream, f"{base}/out", f"{base}/state", "update").awaitTermination()
    return P.last_states(spark.read.parquet(f"{base}/out"), ["start", "event_type"]).select(F.unix_micros("start").alias("start_us"), "event_type", "n", "total")


_NAMES = "event_windows event_sliding event_sessions event_research_window sweep_abandoned stream_windows".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_AGG = "event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DECIMAL(38,6)) AS total"
SQL = {
    "event_windows": f"SELECT epoch_us(date_trunc('day', ts)) AS start_us, {_AGG} FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "stream_windows": f"SELECT epoch_us(date_trunc('day', ts)) AS start_us, {_AGG} FROM (SELECT DISTINCT ON (event_id) * FROM events WHERE ts IS NOT NULL) GROUP BY 1, 2",
    "event_sliding": f"SELECT epoch_us(date_trunc('day', ts) - k * INTERVAL 1 DAY) AS start_us, {_AGG} FROM events, (VALUES (0), (1)) AS v(k) WHERE ts IS NOT NULL GROUP BY 1, 2",
    "event_sessions": """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
        SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 6 HOUR) AS end_us, count(*) AS n FROM s GROUP BY user_id, session""",
    "event_research_window": "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-13 00:15:00'",
    "sweep_abandoned": "SELECT user_id, epoch_us(max(ts)) AS last_us, count(*) AS n FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-29 23:00:00'",
}
