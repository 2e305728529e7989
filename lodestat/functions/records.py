"""JSON records, audit summaries, public URLs and confidence."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions.grounding import ground_wording, ungrounded_numbers
from lodestat.functions.text import grounded
from lodestat.functions.urls import _private_v4, _private_v6

#: Urgency of a review by its reason.
PRIORITIES = {"CRITICAL_CLAIM": "URGENT", "CONTRADICTION": "HIGH", "AI_INFERENCE": "NORMAL", "LOW_CONFIDENCE": "NORMAL", "MANUAL_REQUEST": "NORMAL"}
#: A score that no unsound evidence may exceed; names of a body's fields that its summary keeps; length of a reference.
LOW_SCORE, FIELD_CAP, REFERENCE_CAP = 0.49, 30, 200


def canonical(text: str | None) -> str | None:
    """the JSON with its keys in order at every depth, without blanks; null for null or what is no JSON.

    Keys are ordered as a dictionary does: letters first by their sound, a small
    one before its capital. Arrays keep their order.
    """
    def even(value):
        if isinstance(value, dict):
            return {k: even(value[k]) for k in sorted(value, key=lambda k: (k.casefold(), k.swapcase()))}
        if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
            return int(value)
        return [even(v) for v in value] if isinstance(value, list) else value

    try:
        return None if text is None else json.dumps(even(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """F51 as an Arrow UDF."""
    return pd.Series([canonical(t) for t in text], dtype=object)


def merged_json(one: Column, other: Column) -> Column:
    """two flat JSON objects of text as one; of a key in both the second counts; keys sorted."""
    kind = T.MapType(T.StringType(), T.StringType())
    left, right = (F.coalesce(F.from_json(c, kind), F.create_map().cast(kind)) for c in (one, other))
    kept = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, right)))), {"ignoreNullFields": "false"})


def body_summary(body: Column) -> Column:
    """``struct<type, count, fields>`` of a JSON body: an object's first field names, sorted; an array's length; null type for others."""
    names = F.json_object_keys(body)
    size = F.json_array_length(body)
    kind = F.when(names.isNotNull(), "object").when(size.isNotNull(), "array")
    return F.struct(kind.alias("type"), F.coalesce(F.size(F.when(names.isNotNull(), names)), size).alias("count"), F.array_sort(F.slice(names, 1, FIELD_CAP)).alias("fields"))


def route_pattern(url: Column) -> Column:
    """the path of a URL with UUIDs and numbers as ``{id}``."""
    path = F.split_part(url, F.lit("?"), F.lit(1))
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.when(s.rlike(r"(?i)^([0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|\d+)$"), "{id}").otherwise(s)), "/")


def private_reason(url: Column) -> Column:
    """F32: why a location is no public source: INVALID, PROTOCOL, CREDENTIALS, PORT, LOCAL or PRIVATE; null if it is one."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    server = F.regexp_replace(authority, "^.*@", "")
    host = F.lower(F.regexp_extract(server, r"^(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(server, r":(\d+)$", 1)
    usual = (port == "") | ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    return (
        F.when(url.isNull() | (scheme == "") | url.rlike(r"\s"), "INVALID")
        .when(~scheme.isin("http", "https"), "PROTOCOL")
        .when(host == "", "INVALID")
        .when(authority.contains("@"), "CREDENTIALS")
        .when(~usual, "PORT")
        .when((host == "localhost") | host.endswith(".localhost") | host.endswith(".local"), "LOCAL")
        .when(_private_v4(host) | _private_v6(host), "PRIVATE")
    )


def calibrated_thrice(level: Column, score: Column, grounding: Column, dated: Column, named: Column, occurrences: Column) -> Column:
    """``struct<level, score, adjusted, reasons>``: confidence held down by wording that is not supported, by a
    date or publisher that is not verified, and by an excerpt that does not stand exactly once in its source."""
    reasons = F.filter(
        F.array(
            F.when(~F.coalesce(grounding == "SUPPORTED", F.lit(False)), "UNSUPPORTED_WORDING"), F.when(~F.coalesce(dated, F.lit(False)), "UNVERIFIED_PUBLICATION_DATE"),
            F.when(~F.coalesce(named, F.lit(False)), "UNVERIFIED_PUBLISHER"), F.when(~F.coalesce(occurrences == 1, F.lit(False)), "EXCERPT_NOT_UNIQUE"),
        ),
        lambda r: r.isNotNull(),
    )
    sound = F.size(reasons) == 0
    held = F.when(sound | score.isNull(), score).otherwise(F.least(score, F.lit(LOW_SCORE)))
    changed = ~sound & ((level != "LOW") | F.coalesce(score > LOW_SCORE, F.lit(False)))
    return F.struct(F.when(sound, level).otherwise("LOW").alias("level"), held.alias("score"), changed.alias("adjusted"), reasons.alias("reasons"))


def ground_claim(assertion: str, mentions: str, excerpt: str) -> Column:
    """what an excerpt bears out of a claim: ``struct<entities, numbers, wording>``: the names that occur in it, the
    figures that do not, and the grounding of the wording. The arguments are column names."""
    return F.struct(grounded(F.col(mentions), F.col(excerpt)).alias("entities"), ungrounded_numbers(assertion, excerpt).alias("numbers"), ground_wording(assertion, excerpt).alias("wording"))


def review_priority(reason: Column) -> Column:
    """the urgency of a review; null for an unknown reason."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in PRIORITIES.items() for x in pair)), reason)


def window_issue(published: Column, start: str, end: str) -> Column:
    """P20: MISSING_PUBLICATION_DATE, OUTSIDE_PUBLICATION_WINDOW (an unreadable one too) or null, of a written ISO date or time."""
    at = F.try_to_timestamp(published)
    outside = at.isNull() | (at < F.lit(start).cast("timestamp")) | (at > F.lit(end).cast("timestamp"))
    return F.when(published.isNull() | (published == ""), "MISSING_PUBLICATION_DATE").when(outside, "OUTSIDE_PUBLICATION_WINDOW")


def local_date_issue(published: Column, run_at: Column, zone: str) -> Column:
    """MISSING_PUBLICATION_DATE, OUTSIDE_LOCAL_PUBLICATION_DATE (an unreadable one too) or null: whether a written
    instant falls on the calendar day of ``run_at`` in a zone."""
    at = F.try_to_timestamp(published)
    day = lambda c: F.to_date(F.from_utc_timestamp(c, zone))
    same = F.coalesce(day(at) == day(run_at), F.lit(False))
    return F.when(published.isNull() | (published == ""), "MISSING_PUBLICATION_DATE").when(~same, "OUTSIDE_LOCAL_PUBLICATION_DATE")
