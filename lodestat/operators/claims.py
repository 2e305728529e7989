"""Claims: hashes, duplicates, conflicts, corroboration, consolidation, mentions, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.text import collapse, comparable, entity_name, injection_markers

#: Ranks of confidence and impact.
CONFIDENCE = ("VERY_LOW", "LOW", "MEDIUM", "HIGH", "VERY_HIGH")
IMPACT = ("NEGLIGIBLE", "LOW", "MEDIUM", "HIGH", "CRITICAL")
#: Claim types that are an interpretation, and those published without one.
INTERPRETIVE = ("AI_INFERENCE", "FORECAST", "OPINION", "RECOMMENDATION", "RISK", "THREAT", "OPPORTUNITY", "TREND", "ESTIMATE")
FACTUAL = ("FACT", "INDICATOR_READING")
#: Pieces of evidence that one consolidated claim may hold.
EVIDENCE_CAP = 10


def rank(level: Column, levels: tuple[str, ...]) -> Column:
    """Position of a level; null if it is none."""
    return F.nullif(F.array_position(F.array(*map(F.lit, levels)), level), F.lit(0)) - 1


def content_hash(claim_type: Column, assertion: Column, event_date: Column, domain: Column | None = None, place: Column | None = None, entity: Column | None = None) -> Column:
    """What a claim asserts, whoever reported it: SHA-256 of the canonical JSON of type, evened assertion, date and the three subjects."""
    none = F.lit(None).cast("string")
    parts = {"assertion": F.lower(collapse(assertion)), "claimType": claim_type, "economicEntityId": entity, "eventDate": event_date.cast("string"), "geographicUnitId": place, "statisticalDomainId": domain}
    return F.sha2(F.to_json(F.struct(*((none if c is None else c).alias(n) for n, c in parts.items())), {"ignoreNullFields": "false"}), 256)


def first_of(rows: DataFrame, group: str, key: str) -> DataFrame:
    """The first key of each group and its size, pre-aggregated (``first_key``, ``n``)."""
    return rows.groupBy(group).agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("n"))


def conflicts(claims: DataFrame, identifiers: tuple[str, ...] = ("subject",)) -> DataFrame:
    """Of each subject (identifiers and date) the contents that contradict the first one.

    ``claims``: (``candidate_id``, the identifiers, ``event_date``, ``hash``). A subject
    has a date and at least one identifier; the others may be null, and null is
    the same as null. The first content of a subject is its reference; each
    different content is one contradiction, held by its own first claim. Grouping
    by content first keeps a hot subject from being joined with itself.
    """
    known = claims.where(F.coalesce(*(F.col(c).cast("string") for c in identifiers)).isNotNull() & F.col("event_date").isNotNull())
    contents = known.groupBy(*identifiers, "event_date", "hash").agg(F.min("candidate_id").alias("first_id"), F.count(F.lit(1)).alias("claims"))
    contents = contents.withColumn("_subject", F.to_json(F.struct(*identifiers, "event_date"), {"ignoreNullFields": "false"}))  # one key, in which null is a value
    primary = contents.groupBy("_subject").agg(F.min("first_id").alias("primary_id"))
    return contents.join(primary, "_subject").where("first_id <> primary_id").select(*identifiers, "event_date", "primary_id", F.col("first_id").alias("contradicting_id"), "claims")


def corroboration(rows: DataFrame, key: list[str], publisher: Column, verified: Column, content: Column) -> DataFrame:
    """Sources, publishers and contents of each claim, and whether they corroborate independently.

    Each row is counted by publisher and by content; distinct values are groups of
    a first aggregation, so that a claim's counts are sums and hot claims combine
    before they are shuffled.
    """
    seen = F.coalesce(verified, F.lit(False))
    both = F.explode(F.array(F.struct(F.lit("P").alias("of"), publisher.cast("string").alias("value"), seen.alias("ok")), F.struct(F.lit("C").alias("of"), content.cast("string").alias("value"), F.lit(False).alias("ok")))).alias("s")
    once = rows.select(*key, both).select(*key, "s.*").groupBy(*key, "of", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("good"))
    named, by = F.col("value").isNotNull(), F.col("of") == "P"
    out = once.groupBy(*key).agg(
        F.sum(F.when(by, F.col("n"))).alias("sources"), F.count_if(by & named).alias("publishers"), F.count_if(by & named & (F.col("good") > 0)).alias("verified_publishers"),
        F.sum(F.when(by, F.col("n") - F.col("good"))).alias("unverified_sources"), F.count_if(~by & named).alias("contents"),
    )
    return out.withColumn("independent", (F.col("verified_publishers") > 1) & (F.col("contents") > 1))


def consolidated(rows: DataFrame) -> DataFrame:
    """A10 without a cap: one row of each (type, assertion, date, horizon) with the least confidence and greatest impact.

    A score is null if any is; ``published_at`` is null unless all agree.
    """
    key = [F.coalesce(F.col("claim_type"), F.lit("")).alias("claim_type"), comparable(F.coalesce("assertion", F.lit(""))).alias("assertion_key"), F.coalesce(F.col("event_date").cast("string"), F.lit("")).alias("event_date"), F.coalesce("time_horizon", F.lit("")).alias("time_horizon")]
    out = rows.select("candidate_id", *key, "confidence_score", "published_at", rank(F.col("confidence_level"), CONFIDENCE).alias("c"), rank(F.col("impact_level"), IMPACT).alias("i"), comparable(F.coalesce("excerpt", F.lit(""))).alias("e"))
    level = lambda c, levels: F.try_element_at(F.array(*map(F.lit, levels)), (c + 1).cast("int"))
    out = out.groupBy("claim_type", "assertion_key", "event_date", "time_horizon").agg(
        F.min("candidate_id").alias("first_id"), F.count(F.lit(1)).alias("claims"), F.count_distinct("e").alias("evidence"), F.min(F.coalesce("c", F.lit(0))).alias("c"), F.max("i").alias("i"),
        F.when(F.count_if(F.col("confidence_score").isNull()) == 0, F.min("confidence_score")).alias("score"),
        F.when((F.count_distinct("published_at") == 1) & (F.count_if(F.col("published_at").isNull()) == 0), F.min("published_at")).alias("published_at"),
    )
    return out.select("first_id", "claims", "evidence", level(F.col("c"), CONFIDENCE).alias("confidence_level"), level(F.col("i"), IMPACT).alias("impact_level"), "score", "published_at")


def consolidation_cut(rows: DataFrame, cap: int = EVIDENCE_CAP) -> DataFrame:
    """A10 with the cap: which claims merge into the first of their key and which stand alone.

    ``rows``: (``candidate_id``, ``key``, ``evidence``), in the order of the id. A
    claim merges while fewer than ``cap`` different pieces came before it. The
    place where a key is full is its ``cap``-th new piece: first occurrences are
    pre-aggregated and only ``cap`` of each key are ranked.
    """
    from pyspark.sql import Window as W

    fresh = rows.groupBy("key", "evidence").agg(F.min("candidate_id").alias("at"))
    ranked = fresh.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy("at"))).where(F.col("nth") <= cap)
    full = ranked.groupBy("key").agg(F.min("at").alias("first_id"), F.max(F.when(F.col("nth") == cap, F.col("at"))).alias("full_at"))
    out = rows.join(full, "key")
    merges = F.col("full_at").isNull() | (F.col("candidate_id") <= F.col("full_at"))
    return out.select("candidate_id", F.when(merges, F.col("first_id")).otherwise(F.col("candidate_id")).alias("into_id"))


def resolve_mentions(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """An exact match with an evened alias, else an unambiguous match of the evened mention.

    ``aliases``: (``economic_entity_id``, ``alias``). Adds ``entity``, ``how``, ``certainty``.
    """
    known = aliases.where(F.col("alias").isNotNull()).select("economic_entity_id", entity_name(F.col("alias")).alias("a")).where("a <> ''")
    by = known.groupBy("a").agg(F.count_distinct("economic_entity_id").alias("n"), F.min("economic_entity_id").alias("id"))
    exact = by.select(F.col("a").alias("exact_a"), F.col("id").alias("exact_id"))
    norm = by.where("n = 1").select(F.col("a").alias("norm_a"), F.col("id").alias("norm_id"))
    m = mentions.withColumn("_n", entity_name(F.col("mention_text")))
    m = m.join(exact, m["mention_text"] == exact["exact_a"], "left").join(norm, F.col("_n") == F.col("norm_a"), "left")
    how = F.when(F.col("exact_id").isNotNull(), "EXACT_ALIAS").when(F.col("norm_id").isNotNull(), "NORMALIZED_ALIAS").otherwise("UNRESOLVED")
    certainty = F.when(F.col("exact_id").isNotNull(), 1.0).when(F.col("norm_id").isNotNull(), 0.9)
    return m.select(*mentions.columns, F.coalesce("exact_id", "norm_id").alias("entity"), how.alias("how"), certainty.alias("certainty"))


def route(assertion: Column, excerpt: Column, claim_type: Column, confidence: Column, impact: Column) -> Column:
    """where a claim goes, the first rule that holds."""
    marked = F.size(F.concat(injection_markers(F.coalesce(assertion, F.lit(""))), injection_markers(F.coalesce(excerpt, F.lit(""))))) > 0
    review = claim_type.isin(*INTERPRETIVE) | confidence.isin("VERY_LOW", "LOW") | F.coalesce(impact.isin("CRITICAL", "HIGH"), F.lit(False)) | ~claim_type.isin(*FACTUAL)
    return F.when(marked, "QUARANTINE").when(F.coalesce(review, F.lit(True)), "REVIEW").otherwise("PUBLISH")


def calibrated(level: Column, score: Column, sound: Column) -> tuple[Column, Column, Column]:
    """confidence lowered to LOW and 0.49 where the evidence is not sound: (level, score, adjusted)."""
    ok = F.coalesce(sound, F.lit(False))
    return F.when(ok, level).otherwise("LOW"), F.when(ok | score.isNull(), score).otherwise(F.least(score, F.lit(0.49))), ~ok & ((level != "LOW") | F.coalesce(score > 0.49, F.lit(False)))


def retry(attempts: Column) -> Column:
    """``struct<attempt, action, delay_seconds>`` of the next try: exponential back-off, at most five."""
    attempt = attempts + 1
    delay = F.least(F.lit(30) * F.pow(F.lit(2), F.greatest(attempt - 1, F.lit(0))), F.lit(3600)).cast("int")
    return F.struct(attempt.alias("attempt"), F.when(attempt > 5, "DEAD_LETTER").otherwise("RETRY").alias("action"), F.when(attempt <= 5, delay).alias("delay_seconds"))
