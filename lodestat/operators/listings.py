"""Listings under disclosure, references to several tables, counters, merges and report shapes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestat.operators import observations as O
from lodestat.sources.tables import materialise

#: The status that anybody may read, and those of an issue that is settled.
OPEN_TO_ALL, SETTLED = "PUBLISHED", ("VERIFIED", "CLOSED")
#: Names that a consolidated claim keeps at most, by the reference's rule.
MENTION_CAP = 25


@dataclass(frozen=True)
class Page:
    """L2: a page number from 1 to 10 000 and a size from 1 to 200."""

    number: int = 1
    size: int = 50

    def __post_init__(self) -> None:
        if not 1 <= self.number <= 10_000 or not 1 <= self.size <= 200:
            raise ValueError("page is 1 to 10000, size 1 to 200")


def optional_filters(rows: DataFrame, wanted: dict) -> DataFrame:
    """Equality on every column for which a value is given."""
    return reduce(lambda d, item: d if item[1] is None else d.where(F.col(item[0]) == item[1]), wanted.items(), rows)


def containing(rows: DataFrame, text: str | None, *columns: str) -> DataFrame:
    """Rows of which any column contains the text, case aside; all rows without a text."""
    if text is None:
        return rows
    held = F.lower(F.lit(text))
    return rows.where(reduce(Column.__or__, (F.coalesce(F.contains(F.lower(F.col(c)), held), F.lit(False)) for c in columns)))


def listing(rows: DataFrame, order: Sequence[Column], page: Page) -> DataFrame:
    """One page of rows with the ``total`` of all; the total is an aggregate of its own, the page a top-k."""
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(*order).offset((page.number - 1) * page.size).limit(page.size).withColumn("total", total.scalar())


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """The rows with one key; the comparison reaches the scan."""
    return rows.where(F.col(key) == F.lit(value))


@dataclass(frozen=True)
class ClaimQuery:
    """Q7: a claim search; ``select`` is the only way to rows and always applies status and scope.

    Claims that are not published are working material of the organisation that
    owns them: another reader gets none of them, one without organisation no row.
    """

    scope: O.Scope
    status: str = OPEN_TO_ALL
    equal: dict = field(default_factory=dict)
    page: Page = field(default_factory=Page)

    def select(self, claims: DataFrame) -> DataFrame:
        """All rows of the query: ``claims`` has the columns ``status`` and ``owner``."""
        rows = optional_filters(claims.where(F.col("status") == self.status), self.equal)
        if self.scope.unrestricted or self.status == OPEN_TO_ALL:
            return rows
        return rows.where(F.lit(False) if self.scope.owner is None else F.col("owner") == self.scope.owner)

    def run(self, claims: DataFrame, order: Sequence[Column]) -> DataFrame:
        """One page with its total."""
        return listing(self.select(claims), order, self.page)


def sides(links: DataFrame, one: str, other: str, key: str) -> DataFrame:
    """Links by either of their ends, once where both are the same: an equi-join on ``key`` replaces ``one = x OR other = x``."""
    return links.select("*", F.explode(F.array_distinct(F.array(F.col(one), F.col(other)))).alias(key)).where(F.col(key).isNotNull())


def open_contradictions(links: DataFrame) -> DataFrame:
    """The number of contradictions (``primary_id``, ``contradicting_id``) that a claim is in (``id``, ``n``)."""
    return sides(links.select("primary_id", "contradicting_id"), "primary_id", "contradicting_id", "id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def polymorphic(references: DataFrame, targets: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """References (``target_type``, ``target_id`` as text, ...) to rows of several tables, each kind by an equi-join of its own.

    ``targets`` gives the table and key of each kind; all of a table's columns come
    as the struct ``target``'s JSON, so that kinds of different shape fit together.
    """
    parts = []
    for kind, (table, key) in targets.items():
        there = table.select(F.col(key).cast("string").alias("_key"), F.to_json(F.struct(*table.columns)).alias("target"))
        mine = references.where(F.col("target_type") == kind)
        parts.append(mine.join(there, mine["target_id"] == there["_key"]).drop("_key"))
    return reduce(DataFrame.unionByName, parts)


def next_cursor(page: DataFrame, order: Sequence[str], size: int, *, descending: bool = False) -> DataFrame:
    """L3: the opaque cursor behind a full page, null behind a short one (``next_cursor``); ``page`` is one page of rows."""
    back = [F.col(order[0]).asc() if descending else F.col(order[0]).desc(), *(F.col(c).desc() for c in order[1:])]
    last = page.orderBy(*back).limit(1).select(F.to_json(F.array(*(F.col(c).cast("string") for c in order))).alias("at"))
    token = F.rtrim(F.translate(F.base64(F.col("at").cast("binary")), "+/\r\n", "-_"), F.lit("="))
    full = page.agg((F.count(F.lit(1)) == size).alias("full"))
    return full.select(F.when(F.col("full"), last.select(token).scalar()).alias("next_cursor"))


def observation_shape(page: DataFrame, revisions: DataFrame, units: DataFrame, assessments: DataFrame, issues: DataFrame, sources: DataFrame) -> DataFrame:
    """Q1: a page of observations with ordered measures, attributes and dimensions, quality summary and source.

    ``page`` is materialised first, at most 200 rows; every child table is cut to
    it by a semi-join before it is aggregated. ``issues``: (``target_type``,
    ``target_id``, ``status``); ``sources``: (``source_code``, ``organisation``).
    """
    page = materialise(page)
    key = "observation_revision_id"
    own = revisions.join(page.select(key), key, "left_semi").dropDuplicates([key])
    known = units.select("unit_measure_id", F.col("code").alias("unit"))
    measures = own.where("numeric_value IS NOT NULL").join(known, "unit_measure_id", "left").select(key, F.coalesce("unit", F.lit("")).alias("code"), F.col("numeric_value").alias("value"))
    pairs = F.explode(F.array(*(F.struct(F.lit(code).alias("code"), F.col(column).cast("string").alias("value")) for code, column in (("CONF", "confidentiality_status"), ("REASON", "revision_reason"), ("STATUS", "status")))))
    attributes = own.select(key, pairs.alias("a")).select(key, "a.*").where("value IS NOT NULL")
    out = O.enriched(page, measures, key, ["code", "value"], "measures")
    out = O.enriched(out, attributes, key, ["code", "value"], "attributes")
    out = O.enriched(out, O.dimension_values(revisions.join(page.select("series_id").distinct(), "series_id", "left_semi")), "series_id", ["position", "code", "value"], "dimensions")
    tested = assessments.join(page.select(key), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("assessments"), F.count_if(F.col("status") == "FAIL").alias("failed"))
    open_issues = issues.where((F.col("target_type") == "OBSERVATION_REVISION") & ~F.col("status").isin(*SETTLED)).select(F.col("target_id").alias("_id"))
    mine = open_issues.join(page.select(F.col(key).cast("string").alias("_id")), "_id", "left_semi").groupBy("_id").agg(F.count(F.lit(1)).alias("open_issues"))
    out = out.join(tested, key, "left").join(mine, F.col(key).cast("string") == mine["_id"], "left").join(sources, "source_code", "left").drop("_id")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("assessments", "failed", "open_issues")})


def conditional_update(rows: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """The table with the columns of the rows that meet a condition set; ``updated`` marks them."""
    hit = F.coalesce(where, F.lit(False))
    return rows.withColumns({**{c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}, "updated": hit})


def running_counts(rows: DataFrame, by: str, day: Column, accepted: Column) -> DataFrame:
    """Received and accepted of each group by day, and the counters as they stood that evening.

    Days are pre-aggregated, so that the running sum of a hot group goes over the calendar, not over its rows.
    """
    ok = F.coalesce(accepted, F.lit(False))
    daily = rows.groupBy(by, day.alias("day")).agg(F.count(F.lit(1)).alias("received"), F.count_if(ok).alias("accepted"))
    so_far = W.partitionBy(by).orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    return daily.select(by, "day", "received", "accepted", F.sum("received").over(so_far).alias("received_so_far"), F.sum("accepted").over(so_far).alias("accepted_so_far"))


def existence(cited: DataFrame, by: str, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """How many different keys each group cites, how many of them exist, and whether all do."""
    there = known.select(F.col(known_key).alias(key)).distinct().withColumn("there", F.lit(True))
    asked = cited.where(F.col(key).isNotNull()).select(by, key).distinct().join(there, key, "left")
    return asked.groupBy(by).agg(F.count(F.lit(1)).alias("cited"), F.count("there").alias("found")).withColumn("all_exist", F.col("cited") == F.col("found"))


def first_failure(**checks: Column) -> Column:
    """The name of the first check that does not hold (null counts as not), or null."""
    return F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), name) for name, c in checks.items()))


def reference_failures(values: DataFrame, catalogues: dict[str, tuple[DataFrame, str]], key: str = "series_id") -> DataFrame:
    """P25: dimension values (``key``, ``code``, ``value``) that are not in the catalogue of their code, one anti-join each."""
    parts = []
    for code, (catalogue, column) in catalogues.items():
        known = catalogue.select(F.col(column).cast("string").alias("value")).distinct()
        parts.append(values.where(F.col("code") == code).select(key, "code", "value").join(known, "value", "left_anti").select(key, "code", "value"))
    return reduce(DataFrame.unionByName, parts)


def incompatible_series(revisions: DataFrame) -> DataFrame:
    """Series keys that stand for several series, or series with several keys or units (``subject``, ``problem``)."""
    by_key = revisions.groupBy(F.col("series_key").alias("subject")).agg((F.min("series_id") != F.max("series_id")).alias("bad")).select("subject", F.lit("SERIES").alias("problem"), "bad")
    by_series = revisions.groupBy(F.col("series_id").alias("subject")).agg(F.array(
        F.struct(F.lit("KEY").alias("problem"), (F.min("series_key") != F.max("series_key")).alias("bad")), F.struct(F.lit("UNIT").alias("problem"), (F.min("unit_measure_id") != F.max("unit_measure_id")).alias("bad")),
    ).alias("p"))
    return by_key.unionByName(by_series.select("subject", F.explode("p").alias("p")).select("subject", "p.problem", "p.bad")).where("bad").select("subject", "problem")


def merged_mentions(rows: DataFrame, key: Sequence[str], order: str, mentions: str, form: str, cap: int = MENTION_CAP) -> DataFrame:
    """The different names of each group in the order of their first occurrence, the first ``cap`` of them.

    ``mentions`` is an array of names, ``form`` the array of what makes two of them
    the same. First occurrences are pre-aggregated before they are ranked. The cap
    is the reference's rule for a consolidated claim; ``names`` counts them all.
    """
    one = rows.select(*key, order, F.posexplode(F.arrays_zip(F.col(mentions).alias("name"), F.col(form).alias("form"))).alias("pos", "m")).where("m.form IS NOT NULL AND m.form <> ''")
    first = one.groupBy(*key, F.col("m.form").alias("form")).agg(F.min(F.struct(F.col(order), "pos", F.col("m.name").alias("name"))).alias("f"))
    place = W.partitionBy(*key).orderBy(F.col("f"))
    total = W.partitionBy(*key)
    ranked = first.withColumn("nth", F.row_number().over(place)).withColumn("names", F.count(F.lit(1)).over(total)).where(F.col("nth") <= cap)
    return ranked.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("nth", F.col("f.name").alias("name")))).alias("l"), F.max("names").alias("names")).select(*key, "names", F.transform("l", lambda x: x["name"]).alias("mentions"))
