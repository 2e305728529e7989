from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.operators.registration import register, replay, submit_claims
from lodestat.plans import events as E
from lodestat.sources import sinks as S
from lodestat.sources.tables import materialise, release
from lodestat.streaming import pipelines as P

REC = "index int, series_key string, period_start date, period_end date, value string, unit string, vintage_date date"
A, B = date(2020, 1, 1), date(2020, 1, 31)


def test_registration_sees_earlier_records_of_its_batch(spark):
    rows = [
        (1, "A=text:x", A, B, "5", "u", B), (2, "A=text:x", A, B, "5", "u", B), (3, "A=text:x", A, B, "-1", "u", B), (4, "A=text:x", A, B, "6", "u", B), (5, "A=text:x", A, B, "5", "u", B),
        (6, "A=text:y", A, B, "1", None, B), (7, "A=text:y", B, A, "1", None, B), (8, "", A, B, "1", None, B), (9, "A=text:y|A=text:z", A, B, "1", None, B), (10, "A=text:y", A, B, "01", None, B), (11, "A=text:y", A, None, "1", None, B), (12, "A", A, B, "1", None, B),
    ]
    df = spark.createDataFrame(rows, REC)
    none = spark.createDataFrame([], "series_key string, period_start date, period_end date, hash string, revision_number int")
    out = register(df, none, F.col("value").startswith("-"))
    got = {r["index"]: (r["outcome"], r["error"], r["revision_number"]) for r in out.collect()}
    assert [got[i][0] for i in range(1, 7)] == ["PUBLISHED", "UNCHANGED", "REJECTED", "PUBLISHED", "PUBLISHED", "PUBLISHED"]
    assert [got[i][2] for i in (1, 2, 4, 5, 6)] == [1, 1, 2, 3, 1]
    assert [got[i][1] for i in range(7, 13)] == ["PERIOD_ORDER", "NO_DIMENSIONS", "DUPLICATE_DIMENSION", "BAD_VALUE", "NO_DATE", "BAD_DIMENSION"]
    published = out.where("outcome = 'PUBLISHED'").groupBy("series_key", "period_start", "period_end").agg(F.max_by("hash", "index").alias("hash"), F.max("revision_number").alias("revision_number"))
    again = {r["index"]: r["outcome"] for r in register(df.where("index IN (5, 6)"), published, F.lit(False)).collect()}
    assert again == {5: "UNCHANGED", 6: "UNCHANGED"}


def test_submission(spark):
    rows = [
        (1, "p1", "s", "h1", "dato", None, "FACT", "HIGH", None), (2, "p1", "s", "h1", "dato", None, "FACT", "HIGH", None), (3, "p3", "s", "h2", "otro", None, "FACT", "HIGH", None), (4, "p4", "s", "h1", "dato", None, "FACT", "HIGH", None),
        (5, "p5", "s", "h1", "system prompt", None, "FACT", "HIGH", None), (6, "p6", None, "h9", "dato", None, "FORECAST", "HIGH", None), (7, "old", "t", "h7", "dato", None, "FACT", "HIGH", None),
    ]
    claims = spark.createDataFrame(rows, "item int, payload string, subject string, hash string, assertion string, excerpt string, claim_type string, confidence_level string, impact_level string")
    known = spark.createDataFrame([("old",)], "payload string").select(F.sha2("payload", 256).alias("payload_hash"))
    assert {r["item"]: r["outcome"] for r in submit_claims(claims, known).collect()} == {1: "PUBLISH", 2: "DUPLICATE", 3: "CONFLICT", 4: "PUBLISH", 5: "QUARANTINE", 6: "REVIEW", 7: "DUPLICATE"}


def test_replay(spark):
    done = spark.createDataFrame([("a", "f", "r"), ("b", "f", None), ("c", "g", "r")], "batch_code string, fingerprint string, result string")
    asked = spark.createDataFrame([(c, "f") for c in "abcd"], "batch_code string, fingerprint string")
    assert {r[0]: (r[1], r[2]) for r in replay(asked, done).collect()} == {"a": ("REPLAY", "r"), "b": ("IN_PROGRESS", None), "c": ("CONFLICT", None), "d": ("NEW", None)}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"code": "A", "n": 1}]')
    schema = T.StructType([T.StructField("code", T.StringType()), T.StructField("n", T.IntegerType())])
    assert [tuple(r) for r in S.read_json_records(spark, str(tmp_path / "x.json"), schema).collect()] == [("A", 1)]
    (tmp_path / "bad.json").write_text('[{"code": "A", "n": "x"}]')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        S.read_json_records(spark, str(tmp_path / "bad.json"), schema).collect()
    assert {(r["status"], r["content"] is None) for r in S.read_bodies(spark, str(tmp_path / "*.json"), 23).collect()} == {("OK", False), ("TOO_LONG", True)}
    df = spark.createDataFrame([(1, "uno"), (2, "uno"), (3, "dos"), (4, None)], "i int, body string")
    store = str(tmp_path / "evidence")
    S.store_evidence(df, "body", store)
    S.store_evidence(df, "body", store)
    assert spark.read.parquet(store).count() == 2 and S.damaged_evidence(spark, store).count() == 0
    a, b = S.snapshot(df).first(), S.snapshot(df.repartition(3, "i")).first()
    assert a == b and S.snapshot(df.limit(0)).first()["n"] == 0 and S.snapshot(df.where("i < 4")).first() != a
    assert S.metrics_text(df.where("i = 1"), "seen", ["body"], "i").first()[0] == 'seen{body="uno"} 1'
    S.audit(df, "read", "i", datetime(2024, 1, 1), str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 4
    kept = materialise(df)
    assert kept.count() == 4
    release(kept)


def test_streams(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, i % 3, 0), i % 2, "a", 1.5, "{}") for i in range(12)]
    data = str(tmp_path / "events")
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows + rows[:5], schema).coalesce(1).write.parquet(data)
    stream = P.event_stream(spark, data, spark.createDataFrame([], schema).schema)
    P.write_batches(P.first_deliveries(stream, ["event_id"]), str(tmp_path / "once"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "once")).count() == 12
    silent = P.stuck(stream, minutes=1)
    spark.createDataFrame([(99, datetime(2024, 1, 3), 7, "a", 1.0, "{}")], schema).coalesce(1).write.mode("append").parquet(data)
    P.write_batches(silent, str(tmp_path / "stuck"), str(tmp_path / "c2")).awaitTermination()
    assert {r["user_id"] for r in spark.read.parquet(str(tmp_path / "stuck")).collect()} == {0, 1}


@pytest.mark.parametrize("files", [1, 3])
def test_stream_windows_equal_the_batch(spark, tmp_path, files):
    rows = [(i, i % 4, "ab"[i % 2], i / 8, datetime(2024, 1, 1 + i % 5, i % 24, 30)) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp_ntz")
    for k in range(files):
        df.where(F.col("event_id") % files == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got, want = (sorted(map(tuple, q(spark, str(tmp_path)).collect())) for q in (E.stream_windows, E.event_windows))
    assert got == want and sum(r[2] for r in got) == 120
