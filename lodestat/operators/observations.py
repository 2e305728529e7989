"""Observation queries: current and as-of revisions, disclosure, dimensions, paging, enrichment."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Confidentiality that anybody may see.
PUBLIC = ("PUBLIC", "FREE", "OPEN")

OBSERVATION = ("series_id", "period_start", "period_end")


def distinct_revisions(revisions: DataFrame) -> DataFrame:
    """Revisions that were delivered several times, once."""
    return revisions.dropDuplicates(["observation_revision_id"])


def intervals(revisions: DataFrame, keys: Sequence[str] = OBSERVATION, at: str = "capture_date", tie: str = "observation_revision_id") -> DataFrame:
    """Number the valid revisions of each observation and close each one's interval at the next one's start.

    Adds ``version``, ``valid_from``, ``valid_to``, ``is_current``. Revisions that
    never became valid take no part; rows with a null time drop out; a revision
    that was delivered again follows itself and is dropped. All of it happens on
    one shuffle and one sort by observation.
    """
    w = W.partitionBy(*keys).orderBy(F.col(at), F.col(tie))
    valid = revisions.where(F.col("status").isin("PUBLISHED", "SUPERSEDED") & F.col(at).isNotNull())
    once = valid.withColumn("_before", F.lag(tie).over(w)).where(~F.col("_before").eqNullSafe(F.col(tie))).drop("_before")
    timed = once.withColumn("version", F.row_number().over(w)).withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(w))
    return timed.withColumn("is_current", F.col("valid_to").isNull())


def end_of_day(day: date) -> Column:
    """the last millisecond of a day in UTC."""
    return F.lit(f"{day.isoformat()} 23:59:59.999").cast("timestamp")


def current(timed: DataFrame) -> DataFrame:
    """The revisions in force now."""
    return timed.where("is_current AND status = 'PUBLISHED'")


def as_of(timed: DataFrame, day: date, *, strict_status: bool = False, keys: Sequence[str] = OBSERVATION) -> DataFrame:
    """The revision of each observation in force at the end of a day.

    ``strict_status`` keeps only those still PUBLISHED, which loses every
    observation that was revised since.
    """
    t = end_of_day(day)
    inside = timed.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))
    inside = inside.where("status = 'PUBLISHED'") if strict_status else inside
    w = W.partitionBy(*keys).orderBy(F.col("valid_from").desc(), F.col("version").desc())
    return inside.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def overlapping(start: date | None, end: date | None) -> Column:
    """Periods that overlap [start, end]; either end may be open."""
    bounds = [F.col("period_end") >= F.lit(start)] * (start is not None) + [F.col("period_start") <= F.lit(end)] * (end is not None)
    return reduce(Column.__and__, bounds, F.lit(True))


@dataclass(frozen=True)
class Scope:
    """What a reader may see: everything, or the public and what ``owner`` owns."""

    unrestricted: bool = False
    owner: str | None = None

    def predicate(self, status: str = "confidentiality_status", owner: str = "source_code") -> Column:
        if self.unrestricted:
            return F.lit(True)
        public = F.coalesce(F.col(status).isin(*PUBLIC), F.lit(False))
        return public if self.owner is None else public | F.coalesce(F.col(owner) == self.owner, F.lit(False))


def dimension_values(rows: DataFrame, key: str = "series_id") -> DataFrame:
    """Long form (``key``, ``position``, ``code``, ``kind``, ``value``) of the dimensions in ``series_key``."""
    parts = rows.select(key, "series_key").distinct().select(key, F.posexplode(F.split("series_key", r"\|")).alias("position", "part"))
    return parts.select(
        key, "position", F.split_part("part", F.lit("="), F.lit(1)).alias("code"), F.regexp_extract("part", "=([a-z]+):", 1).alias("kind"), F.regexp_extract("part", "=[a-z]+:(.*)$", 1).alias("value")
    )


def with_dimensions(rows: DataFrame, dims: DataFrame, wanted: dict[str, str | tuple[str, str]], key: str = "series_id") -> DataFrame:
    """Rows whose series has every wanted dimension value, by one semi-join each; (kind, value) asks for a value of that kind."""
    for code, value in wanted.items():
        kind, value = value if isinstance(value, tuple) else (None, value)
        hit = dims.where((F.col("code") == code) & (F.col("value") == value))
        rows = rows.join((hit if kind is None else hit.where(F.col("kind") == kind)).select(key), key, "left_semi")
    return rows


@dataclass(frozen=True)
class ObservationQuery:
    """A validated observation query; ``run`` is the only way to rows and always applies the scope."""

    scope: Scope
    period_from: date | None = None
    period_to: date | None = None
    vintage: date | None = None
    dimensions: dict[str, str | tuple[str, str]] = field(default_factory=dict)
    equal: dict[str, str] = field(default_factory=dict)
    descending: bool = False
    page: int = 1
    size: int = 50
    cursor: str | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.page <= 10_000 or not 1 <= self.size <= 200 or len(self.dimensions) > 20:
            raise ValueError("page is 1 to 10000, size 1 to 200, with at most 20 dimension filters")
        if self.cursor and self.page > 1:
            raise ValueError("a cursor excludes a page number")
        if self.period_from and self.period_to and self.period_to < self.period_from:
            raise ValueError("the period ends before it starts")

    def select(self, revisions: DataFrame) -> DataFrame:
        """All rows of the query, before paging."""
        timed = intervals(revisions)
        chosen = as_of(timed, self.vintage) if self.vintage else current(timed)
        rows = chosen.where(self.scope.predicate()).where(overlapping(self.period_from, self.period_to))
        for column, value in self.equal.items():  # P5
            rows = rows.where(F.col(column) == value)
        return with_dimensions(rows, dimension_values(revisions), self.dimensions) if self.dimensions else rows

    def run(self, revisions: DataFrame) -> DataFrame:
        """One page of rows."""
        order = ["period_start", "series_key", "period_end", "observation_revision_id"]
        rows = self.select(revisions)
        if self.cursor:
            return keyset_page(rows, order, decode_cursor(self.cursor), self.size, descending=self.descending)
        return offset_page(rows, order, self.page, self.size, descending=self.descending)


def _ordering(order: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(order[0]).desc() if descending else F.col(order[0]).asc(), *(F.col(c).asc() for c in order[1:])]


def offset_page(rows: DataFrame, order: Sequence[str], page: int, size: int, *, descending: bool = False) -> DataFrame:
    """L1, L2: one page; only the first key turns round when descending, the others break ties."""
    return rows.orderBy(*_ordering(order, descending)).offset((page - 1) * size).limit(size)


def keyset_page(rows: DataFrame, order: Sequence[str], after: Sequence, size: int, *, descending: bool = False) -> DataFrame:
    """The page after a row given by its order values."""
    values = [F.lit(v) for v in after]
    if descending:
        first = F.col(order[0])
        later = F.struct(*order[1:]) > F.struct(*(v.alias(c) for v, c in zip(values[1:], order[1:])))
        past = (first < values[0]) | ((first == values[0]) & later)
    else:
        past = F.struct(*order) > F.struct(*(v.alias(c) for v, c in zip(values, order)))
    return rows.where(past).orderBy(*_ordering(order, descending)).limit(size)


def encode_cursor(values: Sequence) -> str:
    """an opaque cursor."""
    return base64.urlsafe_b64encode(json.dumps([str(v) if isinstance(v, date) else v for v in values]).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> list:
    """the values of a cursor; ValueError if it is none."""
    try:
        values = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except Exception as e:
        raise ValueError("not a cursor") from e
    if not isinstance(values, list) or not values:
        raise ValueError("not a cursor")
    return values


def page_info(rows: DataFrame, size: int) -> DataFrame:
    """The total and the number of pages, as an aggregate of its own."""
    return rows.agg(F.count(F.lit(1)).alias("total")).select("total", F.ceil(F.col("total") / size).alias("total_pages"))


def enriched(page: DataFrame, children: DataFrame, key: str, item: Sequence[str], name: str) -> DataFrame:
    """Add the page's child rows as one sorted array; children off the page are not aggregated."""
    mine = children.join(page.select(key), key, "left_semi")
    lists = mine.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*item))).alias(name))
    return page.join(lists, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(lists.schema[name].dataType)))


#: The order of ``intervals``: windows in it need no further sort.
_BY_TIME = ("capture_date", "observation_revision_id")


def unchanged(timed: DataFrame, value: str = "numeric_value", keys: Sequence[str] = OBSERVATION) -> DataFrame:
    """Whether each revision states what the one before it stated (``unchanged``)."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(*_BY_TIME))
    return timed.withColumn("unchanged", (F.col("version") > 1) & F.col(value).eqNullSafe(before))


def revised_from(timed: DataFrame, keys: Sequence[str] = OBSERVATION) -> DataFrame:
    """D-C: lineage edges from each revision to the one it replaced."""
    before = F.lag("observation_revision_id").over(W.partitionBy(*keys).orderBy(*_BY_TIME))
    edges = timed.withColumn("from_id", before).where("from_id IS NOT NULL")
    return edges.select(F.col("observation_revision_id").alias("to_id"), "from_id", F.lit("REVISED_FROM").alias("relation"))


def series_breaks(timed: DataFrame) -> DataFrame:
    """Q6: periods at which a series' unit changes against the period before."""
    w = W.partitionBy("series_id").orderBy("period_start", "period_end", "observation_revision_id")
    rows = current(timed).withColumn("before", F.lag("unit_measure_id").over(w))
    return rows.where(F.col("before").isNotNull() & F.col("unit_measure_id").isNotNull() & (F.col("before") != F.col("unit_measure_id"))).select("series_id", "period_start", "period_end", F.col("before").alias("unit_before"), "unit_measure_id")


def series_key(dimensions: Column) -> Column:
    """The key of a series: its dimensions (``position``, ``code``, ``kind``, ``value``) in order as code=kind:value, joined with pipes."""
    return F.array_join(F.transform(F.array_sort(dimensions), lambda x: F.concat(x["code"], F.lit("="), x["kind"], F.lit(":"), x["value"])), "|")


def series_hash(series_key: Column) -> Column:
    """Identity of a series: SHA-256 of its key as a JSON string."""
    quoted = F.regexp_replace(series_key, r'(["\\])', r"\\$1")
    return F.sha2(F.concat(F.lit('"'), quoted, F.lit('"')), 256)


def revision_hash() -> Column:
    """Identity of a revision: period, release, measure and confidentiality as compact JSON, hashed; numbers stay text."""
    text = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.concat(F.lit('"'), F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1"), F.lit('"')))
    return F.sha2(
        F.concat(
            F.lit('{"period":['), F.concat_ws(",", *(text(c) for c in ("period_start", "period_end", "period_code", "reference_date"))),
            F.lit('],"release":['), F.concat_ws(",", *(text(c) for c in ("publication_date", "vintage_date", "revision_reason"))),
            F.lit('],"measures":[['), text("unit_measure_id"), F.lit(","), text("numeric_value"),
            F.lit(',null,null]],"attributes":[],"confidentialityStatus":'), text("confidentiality_status"), F.lit("}"),
        ),
        256,
    )
