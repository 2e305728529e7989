"""Sinks: append, content-addressed evidence, reports, metrics, audit, snapshots, read models."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON records (one document each, or an array) that must fit the schema; a record that does not fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def bounded(records: DataFrame, most: int, least: int = 1) -> DataFrame:
    """The records of one request; a request with fewer or more fails, before any of them is used."""
    n = records.count()
    if not least <= n <= most:
        raise ValueError(f"a request holds {least} to {most} records, not {n}")
    return records


def read_bodies(spark: SparkSession, path: str, most: int) -> DataFrame:
    """Files as (``path``, ``length``, ``status``, ``content``); one of more than ``most`` bytes is TOO_LONG and has no content."""
    files = spark.read.format("binaryFile").load(path)
    fits = F.col("length") <= most
    return files.select("path", "length", F.when(fits, "OK").otherwise("TOO_LONG").alias("status"), F.when(fits, F.col("content")).alias("content"))


def save_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines, in place of an older one."""
    df.write.mode("overwrite").json(path)


def append(df: DataFrame, path: str, by: list[str] | None = None, chunk: int | None = None) -> None:
    """Append rows to a Parquet table, partitioned by the given columns, in files of at most ``chunk`` rows."""
    writer = df.write.mode("append")
    writer = writer.option("maxRecordsPerFile", chunk) if chunk else writer
    (writer.partitionBy(*by) if by else writer).parquet(path)


def store_evidence(df: DataFrame, body: str, path: str) -> DataFrame:
    """Put each distinct body under the first digits of its SHA-256 unless it is there; returns what was new."""
    spark = df.sparkSession
    new = df.where(F.col(body).isNotNull()).select(F.sha2(F.col(body).cast("binary"), 256).alias("sha256"), F.col(body).cast("binary").alias("body")).dropDuplicates(["sha256"])
    try:
        there = spark.read.parquet(path).select("sha256")
        new = new.join(there, "sha256", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    append(new.withColumn("shard", F.substring("sha256", 1, 2)), path, ["shard"])
    return new.select("sha256")


def damaged_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Stored bodies that no longer have their SHA-256."""
    return spark.read.parquet(path).where(F.sha2("body", 256) != F.col("sha256")).select("sha256")


def snapshot(df: DataFrame) -> DataFrame:
    """One hash over all rows as sorted JSON. Row hashes are summed in 128 bits, so no task holds the table."""
    row = F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256)
    half = lambda i: F.sum(F.conv(F.substring(row, i, 15), 16, 10).cast("decimal(38,0)"))
    sums = df.agg(half(1).alias("a"), half(16).alias("b"), half(31).alias("c"), F.count(F.lit(1)).alias("n"))
    return sums.select(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("a", "b", "c", "n"))), 256).alias("hash"), "n")


def metrics_text(metrics: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Metrics in text exposition format, one row a line."""
    pairs = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1"), F.lit('"')) for c in labels))
    return metrics.select(F.concat(F.lit(f"{name}{{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))


def audit(df: DataFrame, action: str, key: str, at: datetime, path: str) -> None:
    """Append one audit entry for each row."""
    append(df.select(F.lit(action).alias("action"), F.col(key).cast("string").alias("target"), F.lit(at).alias("at")), path)


def current_values_view(timed: DataFrame, name: str = "current_observation_value") -> None:
    """The read model of current values as a temporary view."""
    rows = timed.where("is_current AND status = 'PUBLISHED'")
    rows.select("series_id", "series_key", "period_start", "period_end", "numeric_value", "unit_measure_id", "source_code").createOrReplaceTempView(name)
