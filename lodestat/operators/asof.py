"""Attributes as known at event time: bucketed DuckDB ASOF join over current-state versions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.sources.tables import bucket_count, materialise

#: Requests of one entity beyond this number are spread over several buckets.
HOT_ENTITY_ROWS = 100_000

#: Buckets for each task, so that tasks get about equal shares although buckets meet in them by hash.
BUCKETS_A_TASK = 4

_RANK = "__rank"
_AVAIL = "__avail"
_BUCKET = "__bucket"
_SALT = "__salt"
_HOT = "__hot"


def _bucket_join(keys: Sequence[str], as_of: str, left_cols: Sequence[str], payload: Sequence[str], schema: pa.Schema, once: bool):
    """The function run on one bucket: build the versions' running best, then ASOF join."""
    quote = lambda c: '"' + c.replace('"', '""') + '"'
    by = ", ".join(f"__e{i}" for i in range(len(keys)))
    on = " AND ".join(f"r.__e{i} = s.__e{i}" for i in range(len(keys)))
    left = ", ".join(f"r.{quote(c)}" for c in left_cols)
    right = ", ".join(f"s.best.{quote(c)} AS {quote('v_' + c)}" for c in payload)
    sql = f"""
        WITH state AS (
            SELECT {by}, {_AVAIL},
                   max({_RANK}) OVER (PARTITION BY {by} ORDER BY {_AVAIL}
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best
            FROM versions
        )
        SELECT {"DISTINCT" if once else ""} {left}, {right}
        FROM requests r ASOF LEFT JOIN state s ON {on} AND r.{quote(as_of)} >= s.{_AVAIL}
    """

    def run(requests: pa.Table, versions: pa.Table) -> pa.Table:
        import duckdb

        if requests.num_rows == 0:
            return schema.empty_table()
        con = duckdb.connect()
        try:
            con.execute("SET threads = 1")
            con.execute("SET memory_limit = '512MB'")
            con.execute("SET TimeZone = 'UTC'")
            con.register("requests", requests)
            con.register("versions", versions)
            found = con.sql(sql).to_arrow_table()
        finally:
            con.close()
        return pa.table([found.column(i).cast(schema.field(i).type) for i in range(len(schema))], schema=schema)

    return run


def as_known_at(
    requests: DataFrame,
    versions: DataFrame,
    entity: Sequence[str],
    as_of: str,
    available: Sequence[str],
    precedence: Sequence[str],
    payload: Sequence[str],
    *,
    hot_rows: int = HOT_ENTITY_ROWS,
    bytes_per_bucket: int = 16 << 20,
    once: bool = False,
) -> DataFrame:
    """Give each request the version of its entity that was known on the request's day.

    ``entity``: key columns present on both sides. ``as_of``: the request's day.
    ``available``: version columns of which the latest non-null one says when the
    version became known (the first must not be null). ``precedence``: among the
    known versions the one greatest in these columns wins; equal ones are settled
    before the join by the greatest payload. The result has the requests' columns
    and ``v_<payload>``, null where nothing was known.

    Versions are first reduced, with map-side combine, to one row for each entity
    and day of availability, so the history of one entity is at most as long as
    the calendar, however often its rows repeat. Entities are hash-partitioned; in
    each bucket an embedded DuckDB turns the history into current-state versions
    (the best of all that was available so far) and runs ASOF LEFT JOIN. Requests
    of an entity with more than ``hot_rows`` requests are salted over several
    buckets, to each of which the bounded history is copied; the hot entities are
    counted first and kept as a table of their own, at most one for every
    ``hot_rows`` requests. Each side is then shuffled once.

    Null keys, null days and unknown entities give null payloads; a version with a
    null first ``available`` column never counts; repeated requests each keep their
    row, or with ``once`` one row in all (they meet in one bucket); empty tables give an empty result or null payloads; other columns of the
    versions are ignored, so clashing names do no harm.
    """
    keys, extra = list(entity), [*precedence, *payload]
    fields = list(dict.fromkeys(extra))
    known = versions.where(F.col(available[0]).isNotNull() & reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    avail = F.greatest(*(F.col(c) for c in available)) if len(available) > 1 else F.col(available[0])
    history = (
        known.select(*(F.col(k).alias(f"__e{i}") for i, k in enumerate(keys)), avail.alias(_AVAIL), F.struct(*fields).alias(_RANK))
        .groupBy(*(f"__e{i}" for i in range(len(keys))), _AVAIL)
        .agg(F.max(_RANK).alias(_RANK))
    )
    left_cols = requests.columns
    asked = requests.select(*(F.col(k).alias(f"__e{i}") for i, k in enumerate(keys)), *left_cols)
    eks = [f"__e{i}" for i in range(len(keys))]
    # by the keys' hash: two entities that share one are salted together, which does no harm
    counted = asked.groupBy(F.xxhash64(*eks).alias(_HOT)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    hot = materialise(counted.select(_HOT, F.ceil(F.col("n") / hot_rows).cast("int").alias("__parts")))
    on_hot = lambda d: d.join(hot, F.xxhash64(*eks) == hot[_HOT], "left").drop(_HOT)
    n = bucket_count(requests, versions, bytes_per_bucket=bytes_per_bucket)
    bucket = F.pmod(F.xxhash64(*eks, _SALT), F.lit(BUCKETS_A_TASK * n)).cast("int").alias(_BUCKET)
    parts = F.coalesce("__parts", F.lit(1))
    asked = on_hot(asked).withColumn(_SALT, F.pmod(F.xxhash64(*left_cols), parts).cast("int")).select(bucket, *eks, *left_cols)
    history = on_hot(history).withColumn(_SALT, F.explode(F.sequence(F.lit(0), parts - 1))).select(bucket, *eks, _AVAIL, _RANK)
    out = T.StructType([*requests.schema.fields, *(T.StructField(f"v_{c}", versions.schema[c].dataType) for c in payload)])
    from pyspark.sql.pandas.types import to_arrow_schema

    run = _bucket_join(keys, as_of, left_cols, list(payload), to_arrow_schema(out), once)
    asked, history = asked.repartition(n, _BUCKET), history.repartition(n, _BUCKET)  # as many tasks as the data ask for, whatever the session's number of partitions
    return asked.groupBy(_BUCKET).cogroup(history.groupBy(_BUCKET)).applyInArrow(run, out)


def known_revisions(requests: DataFrame, revisions: DataFrame) -> DataFrame:
    """The revision of each request's series and period known on its vintage date.

    Only PUBLISHED and SUPERSEDED revisions count. The latest vintage date wins,
    then the highest revision number, then the highest id. A repeated request gives
    one row.
    """
    valid = revisions.where(F.col("status").isin("PUBLISHED", "SUPERSEDED"))
    return as_known_at(
        requests.select("request_id", "series_id", "period_start", "period_end", "vintage_date"),
        valid.select("series_id", "period_start", "period_end", "vintage_date", "publication_date", "revision_number", "observation_revision_id"),
        ["series_id", "period_start", "period_end"],
        "vintage_date",
        ["vintage_date", "publication_date"],
        ["vintage_date", "revision_number", "observation_revision_id"],
        ["observation_revision_id"],
        once=True,
    )
