"""Validation, quality rules, batches and idempotent writes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A decimal as it may arrive: no exponent, no plus sign, no leading zeros.
DECIMAL = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"


def exactly_one(*columns: str) -> Column:
    """exactly one of the columns is not null."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) == 1


def structure_violations(values: DataFrame, key: str, required: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Missing and unknown dimension codes of each key, as sorted arrays; conforming keys drop out."""
    codes = values.groupBy(key).agg(F.collect_set("code").alias("codes"))
    lit = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    out = codes.select(key, F.array_sort(F.array_except(lit(required), "codes")).alias("missing"), F.array_sort(F.array_except("codes", lit(allowed))).alias("unknown"))
    return out.where((F.size("missing") > 0) | (F.size("unknown") > 0))


def reference_violations(rows: DataFrame, column: str, catalogue: DataFrame, catalogue_key: str) -> DataFrame:
    """Rows whose non-null reference is in no catalogue row."""
    known = catalogue.select(F.col(catalogue_key).alias(column)).distinct()
    return rows.where(F.col(column).isNotNull()).join(known, column, "left_anti")


@dataclass(frozen=True)
class Rule:
    """F64: a quality rule on a measure column, held as data."""

    code: str
    kind: str
    severity: str = "ERROR"
    minimum: str | None = None
    maximum: str | None = None


def assess(rows: DataFrame, key: str, measure: str, rules: Sequence[Rule]) -> DataFrame:
    """One row for each row and rule: (``key``, ``rule``, ``severity``, ``status``).

    Values are compared as decimals. A missing or unreadable measure fails every
    rule; an unknown kind or an unusable bound is an ERROR.
    """
    names = ("rule", "kind", "severity", "lo", "hi")
    spec = F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(names, (r.code, r.kind, r.severity, r.minimum, r.maximum)))) for r in rules))
    value = F.when(F.col(measure).rlike(DECIMAL), F.col(measure).try_cast("decimal(38,12)"))
    lo, hi = F.col("lo").try_cast("decimal(38,12)"), F.col("hi").try_cast("decimal(38,12)")
    bad = (F.col("lo").isNotNull() & lo.isNull()) | (F.col("hi").isNotNull() & hi.isNull())
    passed = (
        F.when(F.col("kind") == "REQUIRED_MEASURE", F.col(measure).isNotNull())
        .when(F.col("kind") == "NON_NEGATIVE", F.coalesce(value >= 0, F.lit(False)))
        .when(F.col("kind") == "NUMERIC_RANGE", value.isNotNull() & F.coalesce(value >= lo, F.lit(True)) & F.coalesce(value <= hi, F.lit(True)))
    )
    status = F.when(bad | passed.isNull(), "ERROR").when(passed, "PASS").otherwise("FAIL")
    return rows.select(key, measure, F.explode(spec).alias("r")).select(key, measure, "r.*").select(key, "rule", "severity", status.alias("status"))


def issues(assessments: DataFrame) -> DataFrame:
    """the failed and erroneous assessments."""
    return assessments.where("status IN ('FAIL', 'ERROR')")


def rejected(assessments: DataFrame, key: str) -> DataFrame:
    """keys with a critical issue."""
    return issues(assessments).where("severity = 'CRITICAL'").select(key).distinct()


def quality_summary(assessments: DataFrame, key: str) -> DataFrame:
    """A2: assessments and failures of each key, in one pass."""
    return assessments.groupBy(key).agg(F.count(F.lit(1)).alias("assessments"), F.count_if(F.col("status") == "FAIL").alias("failed"))


def batch_rollup(rows: DataFrame, batch: str, accepted: Column) -> DataFrame:
    """Received, accepted and rejected of each batch, and the status they give it."""
    ok = F.coalesce(accepted, F.lit(False))
    out = rows.groupBy(batch).agg(F.count(F.lit(1)).alias("received"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))
    return out.withColumn("status", F.when(F.col("rejected") == 0, "COMMITTED").when(F.col("accepted") == 0, "REJECTED").otherwise("PARTIAL"))


def upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str], latest: Sequence[str]) -> DataFrame:
    """The target with the incoming rows put in by key; of several the greatest in ``latest`` counts. A hot key combines before it is shuffled."""
    new = incoming.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max_by(F.struct(*incoming.columns), F.struct(*latest)).alias("v")).select("v.*")
    return target.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def insert_if_absent(target: DataFrame, incoming: DataFrame, keys: Sequence[str], first: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is new, the first of each in the order of ``first``. A hot key combines before it is shuffled."""
    fresh = incoming.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min_by(F.struct(*incoming.columns), F.struct(*first)).alias("v")).select("v.*")
    return fresh.join(target.select(*keys).distinct(), list(keys), "left_anti").select(*incoming.columns)


def register_artifacts(rows: DataFrame, key: str, body: str) -> DataFrame:
    """SHA-256 of each body, and CREATED for the first row with it, EXISTING for the others.

    The first row is found by a pre-aggregated minimum, so a body that a third of
    the rows share is no hot partition of a window.
    """
    hashed = rows.where(F.col(body).isNotNull()).select(key, F.sha2(F.col(body), 256).alias("sha256"))
    first = hashed.groupBy("sha256").agg(F.min(key).alias("first_key"))
    return hashed.join(first, "sha256").select(key, "sha256", F.when(F.col(key) == F.col("first_key"), "CREATED").otherwise("EXISTING").alias("outcome"))


def constraint_report(timed: DataFrame) -> DataFrame:
    """§1.6: the number of rows, or keys, that break each invariant of the revisions."""
    rows = timed.agg(
        F.count_if(F.col("period_end") < F.col("period_start")).alias("period_order"),
        F.count_if(F.col("valid_to") < F.col("valid_from")).alias("interval_order"),
        F.count_if(F.col("is_current") & (F.col("status") != "PUBLISHED")).alias("current_not_published"),
        F.count_if(F.col("numeric_value").isNull()).alias("no_measure"),
        F.count_if(~F.col("numeric_value").rlike(DECIMAL)).alias("not_decimal"),
        F.count_if(F.col("publication_date") > F.col("vintage_date")).alias("published_after_vintage"),
    )
    return rows.select(F.expr("stack(6, " + ", ".join(f"'{c}', {c}" for c in rows.columns) + ") AS (invariant, violations)"))
