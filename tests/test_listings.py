from datetime import date

import pytest
from pyspark.sql import functions as F

from lodestat.functions import html as H
from lodestat.functions import content as N
from lodestat.functions import records as R
from lodestat.functions import text as X
from lodestat.operators import claims as C
from lodestat.operators import listings as L
from lodestat.operators import observations as O
from lodestat.sources import sinks as S

CLAIMS = [(1, "PUBLISHED", "a"), (2, "PUBLISHED", "b"), (3, "PENDING_REVIEW", "a"), (4, "PENDING_REVIEW", "b"), (5, "PENDING_REVIEW", None), (6, "QUARANTINED", "a")]


def column(spark, c, *rows, schema="x string, y string"):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).select("i", c.alias("v")).orderBy("i").select("v").collect()]


@pytest.mark.parametrize(
    ("scope", "status", "ids"),
    [
        (O.Scope(unrestricted=True), "PENDING_REVIEW", {3, 4, 5}), (O.Scope(owner="a"), "PENDING_REVIEW", {3}), (O.Scope(), "PENDING_REVIEW", set()), (O.Scope(), "PUBLISHED", {1, 2}),
        (O.Scope(owner="b"), "QUARANTINED", set()), (O.Scope(owner="a"), "QUARANTINED", {6}),
    ],
)
def test_claims_do_not_leak(spark, scope, status, ids):
    rows = spark.createDataFrame(CLAIMS, "id int, status string, owner string")
    q = L.ClaimQuery(scope, status)
    assert {r["id"] for r in q.select(rows).collect()} == ids
    page = q.run(rows, [F.col("id")]).collect()
    assert {r["id"] for r in page} == ids and all(r["total"] == len(ids) for r in page)


def test_pages_and_filters(spark):
    rows = spark.createDataFrame([(i, i % 3, f"Name {i}") for i in range(30)], "id int, k int, name string")
    page = L.listing(L.optional_filters(rows, {"k": 1, "name": None}), [F.col("id").desc()], L.Page(2, 4)).collect()
    assert [(r["id"], r["total"]) for r in page] == [(16, 10), (13, 10), (10, 10), (7, 10)] and L.containing(rows, "NAME 2", "name").count() == 11
    for bad in ((0, 5), (1, 201), (10_001, 5)):
        with pytest.raises(ValueError):
            L.Page(*bad)
    assert L.next_cursor(rows.limit(3), ["id"], 4).first()[0] is None
    token = L.next_cursor(rows.where("id < 4"), ["k", "id"], 4, descending=True).first()[0]
    assert O.decode_cursor(token) == ["0", "3"]


def test_ends_of_links_and_kinds_of_targets(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (4, 4), (None, 5)], "primary_id long, contradicting_id long")
    assert {tuple(r) for r in L.open_contradictions(links).collect()} == {(1, 1), (2, 2), (3, 1), (4, 1), (5, 1)}
    refs = spark.createDataFrame([("A", "1"), ("A", "x"), ("B", "1"), ("C", "1")], "target_type string, target_id string")
    a, b = spark.createDataFrame([(1, "p")], "id long, v string"), spark.createDataFrame([("1", 7)], "key string, n int")
    assert {tuple(r) for r in L.polymorphic(refs, {"A": (a, "id"), "B": (b, "key")}).collect()} == {("A", "1", '{"id":1,"v":"p"}'), ("B", "1", '{"key":"1","n":7}')}


def test_updates_counters_existence_and_compatibility(spark):
    rows = spark.createDataFrame([("s", 1, 5), ("s", 2, None), ("t", 1, 9)], "k string, day int, v int")
    assert {tuple(r) for r in L.conditional_update(rows, F.col("v") > 6, {"v": F.lit(0)}).collect()} == {("s", 1, 5, False), ("s", 2, None, False), ("t", 1, 0, True)}
    assert [tuple(r) for r in L.running_counts(rows, "k", F.col("day"), F.col("v") > 1).orderBy("k", "day").collect()] == [("s", 1, 1, 1, 1, 1), ("s", 2, 1, 0, 2, 1), ("t", 1, 1, 1, 1, 1)]
    assert {tuple(r) for r in L.existence(rows, "k", "v", rows.where("v > 6"), "v").collect()} == {("s", 1, 0, False), ("t", 1, 1, True)}
    series = spark.createDataFrame([("a", "k1", "u"), ("a", "k1", "w"), ("b", "k2", "u"), ("c", "k2", "u")], "series_id string, series_key string, unit_measure_id string")
    assert {tuple(r) for r in L.incompatible_series(series).collect()} == {("a", "UNIT"), ("k2", "SERIES")}
    names = spark.createDataFrame([("g", 2, ["B", "a", None]), ("g", 1, ["A", "c"]), ("h", 3, [])], "g string, id int, m array<string>")
    got = L.merged_mentions(names.withColumn("f", F.transform("m", F.lower)), ["g"], "id", "m", "f", 2).collect()
    assert [tuple(r) for r in got] == [("g", 3, ["A", "c"])]


def test_json(spark):
    assert R.canonical('{"b": 1.0, "a": {"z": [2, {"y": null, "B": "ñ", "b": 0}]}}') == '{"a":{"z":[2,{"b":0,"B":"ñ","y":null}]},"b":1}' and R.canonical("{") is None and R.canonical(None) is None
    assert column(spark, R.merged_json(F.col("x"), F.col("y")), ('{"a":"1","b":"2"}', '{"b":"3"}'), (None, '{"b":null}'), ("", None)) == ['{"a":"1","b":"3"}', '{"b":null}', "{}"]
    got = column(spark, R.body_summary(F.col("x")), ('{"b":1,"a":2}', ""), ("[1,2]", ""), ("7", ""), (None, ""))
    assert [(g["type"], g["count"], g["fields"]) for g in got] == [("object", 2, ["a", "b"]), ("array", 2, None), (None, None, None), (None, None, None)]
    assert column(spark, R.route_pattern(F.col("x")), ("/v1/x/12/87f9ddf2-800a-465e-abc5-12ad96e78600?q=1", ""), ("/", "")) == ["/v1/x/{id}/{id}", "/"]


def test_public_sources(spark):
    urls = ["https://a.org/x", "http://a.org:80/", "https://a.org:8443", "ftp://a.org", "https://u:p@a.org", "https://x.local", "https://10.0.0.1", "http://[::1]/", "https:///x", None, "https://8.8.8.8/"]
    assert column(spark, R.private_reason(F.col("x")), *((u, "") for u in urls)) == [None, None, "PORT", "PROTOCOL", "CREDENTIALS", "LOCAL", "PRIVATE", "PRIVATE", "INVALID", "INVALID", None]
    assert H.canonical_url(["https://a.org:443/y"], "https://a.org/x") == "https://a.org:443/y" and H.canonical_url(["https://a.org:444/y", "http://a.org/y"], "https://www.a.org/x") is None
    assert N.sniff(b"<!-- c --><head><title>x</title></head>", "text/plain") == ("text/html", "SNIFFED_OVERRIDE") and N.sniff(b" x <!doctype html>", "text/plain") == ("text/plain", "MATCHED")


def test_confidence_and_windows(spark):
    out = R.calibrated_thrice(F.lit("HIGH"), F.lit(0.9), F.col("x"), F.col("y").isNotNull(), F.lit(True), F.lit(1))
    got = column(spark, out, ("SUPPORTED", "d"), ("LIMITED", None))
    assert [(g["level"], g["score"], g["adjusted"], g["reasons"]) for g in got] == [("HIGH", 0.9, False, []), ("LOW", 0.49, True, ["UNSUPPORTED_WORDING", "UNVERIFIED_PUBLICATION_DATE"])]
    assert column(spark, R.window_issue(F.col("x"), "2023-01-01", "2023-12-31"), ("2023-05-01", ""), ("2022-05-01", ""), (None, ""), ("ayer", "")) == [None, "OUTSIDE_PUBLICATION_WINDOW", "MISSING_PUBLICATION_DATE", "OUTSIDE_PUBLICATION_WINDOW"]
    claim = spark.createDataFrame([("La tasa subió 5% en Lima", ["Lima", "Quito"], "la tasa subió 4% en Lima")], "a string, m array<string>, e string")
    g = claim.select(R.ground_claim("a", "m", "e").alias("g")).first()["g"]
    assert g["entities"] == ["Lima"] and g["numbers"] and g["wording"]["status"] == "SUPPORTED"


def test_content_hash_is_canonical_json(spark):
    import hashlib

    got = column(spark, C.content_hash(F.col("x"), F.col("y"), F.lit(date(2024, 1, 2)), F.lit("d")), ("FACT", " Sube  el|PIB "))
    text = '{"assertion":"sube el|pib","claimType":"FACT","economicEntityId":null,"eventDate":"2024-01-02","geographicUnitId":null,"statisticalDomainId":"d"}'
    assert got == [hashlib.sha256(text.encode()).hexdigest()]


def test_places_of_an_excerpt(spark):
    got = column(spark, X.excerpt_location(F.col("x"), F.col("y")), ("😀 a.b a.b", "a.b"), ("x " * 25, "x"), ("\\Q\\E a\\Eb", "a\\Eb"))
    assert [(g["start"], g["end"], g["length"], g["count"], g["starts"][:2], g["truncated"]) for g in got] == [(3, 6, 10, 2, [3, 7], False), (0, 1, 49, 25, [0, 2], True), (5, 9, 9, 1, [5], False)]


def test_bounds_reports_and_chunks(spark, tmp_path):
    rows = spark.range(10)
    assert S.bounded(rows, 500).count() == 10
    for most, df in ((9, rows), (5, rows.limit(0))):
        with pytest.raises(ValueError):
            S.bounded(df, most)
    S.save_report(rows, str(tmp_path / "r"))
    S.append(rows.coalesce(1), str(tmp_path / "c"), chunk=4)
    assert spark.read.json(str(tmp_path / "r")).count() == 10 and len(list((tmp_path / "c").glob("*.parquet"))) == 3
