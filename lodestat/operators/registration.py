"""Batches of records and of claims as one pipeline each (D-A to D-E, F68, A11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestat.operators.claims import route
from lodestat.operators.ingestion import DECIMAL

RECORD = ("series_key", "period_start", "period_end", "value", "unit", "vintage_date")


def record_error() -> Column:
    """The first fault of a record, null if it has none."""
    dims = F.split("series_key", r"\|")
    return (
        F.when(F.col("series_key").isNull() | (F.col("series_key") == ""), "NO_DIMENSIONS")
        .when(F.exists(dims, lambda p: ~p.rlike("^[A-Z_]+=[a-z]+:.+$")), "BAD_DIMENSION")
        .when(F.size(F.array_distinct(F.transform(dims, lambda p: F.split_part(p, F.lit("="), F.lit(1))))) < F.size(dims), "DUPLICATE_DIMENSION")
        .when(F.col("period_start").isNull() | F.col("period_end").isNull() | F.col("vintage_date").isNull(), "NO_DATE")
        .when(F.col("period_end") < F.col("period_start"), "PERIOD_ORDER")
        .when(~F.coalesce(F.col("value").rlike(DECIMAL), F.lit(False)), "BAD_VALUE")
    )


def register(records: DataFrame, published: DataFrame, critical: Column) -> DataFrame:
    """D-A, D-B: the outcome of each record of a batch: INVALID, REJECTED, UNCHANGED or PUBLISHED.

    ``records``: (``index``, *RECORD) in the order of ``index``; ``published``: the
    current (``series_key``, ``period_start``, ``period_end``, ``hash``,
    ``revision_number``) of each observation. A record is compared with the last one
    published before it, in the batch or before the batch; invalid and critically
    failing records never become that one. Revision numbers run on from the
    greatest number there is. Faults are data: no record stops the batch.
    """
    key = ["series_key", "period_start", "period_end"]
    checked = records.withColumn("error", record_error()).withColumn("hash", F.sha2(F.concat_ws("|", "value", F.coalesce("unit", F.lit("")), "vintage_date"), 256))
    state = F.when(F.col("error").isNotNull(), "INVALID").when(F.coalesce(critical, F.lit(False)), "REJECTED")
    sound = checked.withColumn("outcome", state)
    before = published.select(*key, F.col("hash").alias("old_hash"), F.col("revision_number").alias("old_number"))
    good = sound.where("outcome IS NULL").join(before, key, "left")
    w = W.partitionBy(*key).orderBy("index")
    last = F.coalesce(F.lag("hash").over(w), F.col("old_hash"))
    good = good.withColumn("outcome", F.when(F.col("hash").eqNullSafe(last), "UNCHANGED").otherwise("PUBLISHED"))
    run = F.sum((F.col("outcome") == "PUBLISHED").cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    good = good.withColumn("revision_number", (F.coalesce("old_number", F.lit(0)) + run).cast("int")).drop("old_hash", "old_number")
    bad = sound.where("outcome IS NOT NULL").withColumn("revision_number", F.lit(None).cast("int"))
    return good.unionByName(bad)


def submit_claims(claims: DataFrame, known: DataFrame) -> DataFrame:
    """D-D, D-E: what becomes of each submitted claim: DUPLICATE, QUARANTINE, CONFLICT, REVIEW or PUBLISH.

    ``claims``: (``item``, ``payload``, ``subject``, ``hash``, ``assertion``, ``excerpt``,
    ``claim_type``, ``confidence_level``, ``impact_level``), in the order of ``item``;
    ``known``: payload hashes delivered before. The first publishable content of a
    subject fixes what is published about it: later equal ones corroborate, later
    different ones conflict. Group minima stand in for looking at earlier rows.
    """
    payload = F.sha2("payload", 256)
    hashed = claims.withColumn("payload_hash", payload)
    first = hashed.groupBy("payload_hash").agg(F.min("item").alias("first_item"))
    seen = known.select(F.col("payload_hash").alias("known_hash")).distinct()
    rows = hashed.join(first, "payload_hash", "left").join(seen, hashed["payload_hash"] == seen["known_hash"], "left")
    duplicate = F.col("known_hash").isNotNull() | (F.col("item") != F.col("first_item"))
    rows = rows.withColumn("way", F.when(F.coalesce(duplicate, F.lit(False)), "DUPLICATE").otherwise(route(F.col("assertion"), F.col("excerpt"), F.col("claim_type"), F.col("confidence_level"), F.col("impact_level"))))
    lead = rows.where("way = 'PUBLISH' AND subject IS NOT NULL").groupBy("subject").agg(F.min_by("hash", "item").alias("lead_hash"), F.min("item").alias("lead_item"))
    rows = rows.join(lead, "subject", "left")
    clash = F.col("way").isin("PUBLISH", "REVIEW") & (F.col("lead_item") < F.col("item")) & (F.col("lead_hash") != F.col("hash"))
    return rows.select("item", F.when(F.coalesce(clash, F.lit(False)), "CONFLICT").otherwise(F.col("way")).alias("outcome"))


def replay(requests: DataFrame, done: DataFrame) -> DataFrame:
    """what a repeated batch code means: NEW, CONFLICT (another content), IN_PROGRESS (no result yet) or REPLAY."""
    before = done.select("batch_code", F.col("fingerprint").alias("old"), F.col("result").alias("old_result"), F.lit(True).alias("there"))
    out = requests.join(before, "batch_code", "left")
    decision = F.when(F.col("there").isNull(), "NEW").when(~F.col("old").eqNullSafe(F.col("fingerprint")), "CONFLICT").when(F.col("old_result").isNull(), "IN_PROGRESS").otherwise("REPLAY")
    return out.select("batch_code", decision.alias("decision"), F.when(decision == "REPLAY", F.col("old_result")).alias("result"))
