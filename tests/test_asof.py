import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from lodestat.operators.asof import as_known_at, known_revisions

REQ = "request_id long, series_id string, period_start date, period_end date, vintage_date date, status string"
REV = "observation_revision_id long, series_id string, period_start date, period_end date, vintage_date date, publication_date date, revision_number int, status string"
P = (date(2020, 1, 1), date(2020, 1, 31))


def found(spark, requests, revisions, **kw):
    out = known_revisions(spark.createDataFrame(requests, REQ), spark.createDataFrame(revisions, REV))
    return {r["request_id"]: r["v_observation_revision_id"] for r in out.collect()}


def brute(requests, revisions):
    out = {}
    for i, s, a, b, d, _ in requests:
        ok = [(v, n, k) for k, t, x, y, v, p, n, st in revisions if None not in (d, v) and (s, a, b) == (t, x, y) and st in ("PUBLISHED", "SUPERSEDED") and v <= d and (p is None or p <= d)]
        out[i] = max(ok)[2] if ok else None
    return out


def test_random_against_brute_force(spark):
    rng = random.Random(5)
    day = lambda: date(2020, 1, 1) + timedelta(rng.randrange(60))
    revisions = [(k, rng.choice("abc"), *P, day(), rng.choice([None, day()]), rng.randrange(1, 4), rng.choice(["PUBLISHED", "SUPERSEDED", "DRAFT"])) for k in range(150)]
    requests = [(i, rng.choice("abcd"), *P, day(), None) for i in range(200)]
    assert found(spark, requests, revisions + revisions[:40]) == brute(requests, revisions)


def test_never_a_later_figure_and_late_publication(spark):
    revisions = [(1, "s", *P, date(2020, 2, 1), date(2020, 2, 1), 1, "SUPERSEDED"), (2, "s", *P, date(2020, 3, 1), date(2020, 3, 9), 2, "PUBLISHED"), (3, "s", *P, date(2020, 3, 2), None, 3, "REJECTED")]
    requests = [(i, "s", *P, d, "x") for i, d in enumerate([date(2020, 1, 31), date(2020, 2, 1), date(2020, 3, 8), date(2020, 3, 9)])]
    assert found(spark, requests, revisions) == {0: None, 1: 1, 2: 1, 3: 2}


def test_earlier_vintage_published_later_does_not_win(spark):
    revisions = [(1, "s", *P, date(2020, 3, 1), None, 2, "PUBLISHED"), (2, "s", *P, date(2020, 2, 1), date(2020, 4, 1), 1, "PUBLISHED")]
    assert found(spark, [(7, "s", *P, date(2020, 5, 1), None)], revisions) == {7: 1}


def test_ties_nulls_empty_and_extra_columns(spark):
    revisions = [(4, "s", *P, date(2020, 2, 1), None, 1, "PUBLISHED"), (9, "s", *P, date(2020, 2, 1), None, 1, "PUBLISHED"), (5, None, *P, date(2020, 2, 1), None, 1, "PUBLISHED"), (6, "s", *P, None, None, 1, "PUBLISHED")]
    requests = [(1, "s", *P, date(2020, 2, 1), None), (1, "s", *P, date(2020, 2, 1), None), (2, None, *P, date(2020, 2, 1), None), (3, "s", *P, None, None)]
    assert found(spark, requests, revisions) == {1: 9, 2: None, 3: None}
    assert found(spark, requests, []) == {1: None, 2: None, 3: None}
    assert found(spark, [], revisions) == {}


def test_clashing_names(spark):
    requests = spark.createDataFrame([("k", date(2020, 1, 5), "r", 1, 2)], "e string, d date, parts string, n int, e0 int")
    versions = spark.createDataFrame([("k", date(2020, 1, 1), "v", 9)], "e string, t date, parts string, n int")
    assert [tuple(r) for r in as_known_at(requests, versions, ["e"], "d", ["t"], ["t"], ["parts", "n"]).collect()] == [("k", date(2020, 1, 5), "r", 1, 2, "v", 9)]


def test_hot_entity_is_salted_without_changing_the_result(spark):
    versions = spark.range(40).select(F.lit("k").alias("e"), F.expr("date_add(DATE '2020-01-01', int(id))").alias("t"), "id")
    requests = spark.range(500).select(F.lit("k").alias("e"), F.expr("date_add(DATE '2020-01-01', int(id % 60) - 5)").alias("d"), "id")
    out = as_known_at(requests, versions, ["e"], "d", ["t"], ["t"], ["id"], hot_rows=50, bytes_per_bucket=1)
    rows = out.collect()
    assert len(rows) == 500
    assert all(r["v_id"] == (None if r["id"] % 60 < 5 else min(r["id"] % 60 - 5, 39)) for r in rows)
