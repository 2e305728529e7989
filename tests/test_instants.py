from datetime import UTC, datetime

import pytest

from lodestat.operators.instants import CANDIDATE_ZONES, estimate_zones, local_to_instant, normalise_source_times, sequence_bounds

RESP = "response_id long, source_code string, last_modified string, response_date string, publication_dates array<string>, content_language string, time_zone string"
CAND = "candidate_id long, published_at string, lang string, time_zone string, response_id long"


def us(*a, micro=0):
    return int(datetime(*a, tzinfo=UTC).timestamp()) * 1_000_000 + micro


CASES = [
    ("Mon, 06 Mar 2023 23:22:00 GMT", "es", us(2023, 3, 6, 23, 22)), ("Monday, 06-Mar-23 23:22:00 GMT", "es", us(2023, 3, 6, 23, 22)), ("Mon Mar  6 23:22:00 2023", "es", us(2023, 3, 7, 3, 22)),
    ("06 MAR 2023 23:22:00 UTC", "es", us(2023, 3, 6, 23, 22)), ("Mon, 6 Mar 2023 23:22:00 -0400", "es", us(2023, 3, 7, 3, 22)), ("2023-03-06", "es", us(2023, 3, 6, 4)),
    ("2023-03-06T10:20:30.1234567Z", "es", us(2023, 3, 6, 10, 20, 30, micro=123456)), ("2023-03-06T10:20:30,5-04:00", "es", us(2023, 3, 6, 14, 20, 30, micro=500000)), ("2023-03-06t10:20:30z", "es", us(2023, 3, 6, 10, 20, 30)),
    ("20230306T102030-0400", "es", us(2023, 3, 6, 14, 20, 30)), ("2023-03-06 10:20:30 BOT", "es", us(2023, 3, 6, 14, 20, 30)), ("2023-03-06 10:20 UTC+8", "es", us(2023, 3, 6, 2, 20)), ("2023-03-06T10:20:30-03", "es", us(2023, 3, 6, 13, 20, 30)),
    ("05/03/2023", "es", us(2023, 3, 5, 4)), ("5/3/2023 10:20:30", "pt", us(2023, 3, 5, 14, 20, 30)), ("3/5/2023 1:20 PM", "en-US", us(2023, 3, 5, 17, 20)), ("05.03.2023 10:20", "es", us(2023, 3, 5, 14, 20)), ("05/03/2023 12:05 a. m.", "es", us(2023, 3, 5, 4, 5)),
    ("5 de marzo de 2023, 10:20 hrs", "es", us(2023, 3, 5, 14, 20)), ("5 de março de 2023 às 10h20", "pt", us(2023, 3, 5, 14, 20)), ("5 de setiembre de 2023 - 1:20 p.m.", "es", us(2023, 9, 5, 17, 20)), ("5 mar 2023, 9:20 h", "es", us(2023, 3, 5, 13, 20)),
    ("March 5, 2023 10:20 PM", "en-US", us(2023, 3, 6, 2, 20)), ("Sep. 5, 2023 12:00 PM", "en-US", us(2023, 9, 5, 16)), ("1678144920", "es", 1678144920 * 10**6), ("1678144920123", "es", 1678144920123 * 1000), ("1678144920123456", "es", 1678144920123456),
    ("2023/03/06 10:20", "es", us(2023, 3, 6, 14, 20)), ("5 March 2023", "en-US", us(2023, 3, 5, 4)), ("Mar 5 2023", "en-US", us(2023, 3, 5, 4)), ("20230305", "es", us(2023, 3, 5, 4)), ("5 de marzo del 2023", "es", us(2023, 3, 5, 4)),
    ("Mon, 6 Mar 2023 23:22:00 +0000 (UTC)", "es", us(2023, 3, 6, 23, 22)), ("March 5, 2023 at 10:20 AM", "en-US", us(2023, 3, 5, 14, 20)), ("2023-07-06 10:20:00 Europe/Madrid", "es", us(2023, 7, 6, 8, 20)), ("2023-07-06T10:20:00 [America/Lima]", "es", us(2023, 7, 6, 15, 20)),
    ("20.05.2021 11:04", "en-US", us(2021, 5, 20, 15, 4)), ("05.03.2021", "en-US", us(2021, 3, 5, 4)), ("sábado, 4 de marzo de 2023", "es", us(2023, 3, 4, 4)), ("2023-03-06T10:20:30+14:00", "es", us(2023, 3, 5, 20, 20, 30)),
    ("5 de martes de 2024", "es", None), ("marble 5, 2024", "en-US", None), ("2023-03-06T10:20:30+99:99", "es", None), ("2023-03-06T10:20:30+05:75", "es", None), ("2023-03-06 10:20 Nowhere/Else", "es", None), ("2023/13/06", "es", None), ("20231399", "es", None),
    ("31/11/2024", "es", None), ("2023-02-30", "es", None), ("0000-00-00 00:00:00", "es", None), ("ayer", "es", None), ("", "es", None), ("2023-03-06 25:00:00", "es", None), ("2023-03-06 10:20 XYZ", "es", None), ("13/05/2023", "en-US", None), (None, "es", None),
]


def test_forms(spark):
    c = spark.createDataFrame([(i, v, lang, "America/La_Paz", None) for i, (v, lang, _) in enumerate(CASES)], CAND)
    got = {r["record_id"]: r["epoch_us"] for r in normalise_source_times(spark.createDataFrame([], RESP), c).collect()}
    for i, (v, _, want) in enumerate(CASES):
        assert got.get(i) == want, v


@pytest.mark.parametrize(
    ("value", "zone", "want"),
    [("2022-10-30 02:30:00", "Europe/Madrid", us(2022, 10, 30, 0, 30)), ("2022-03-27 02:30:00", "Europe/Madrid", None), ("2022-07-01 12:00:00", "Europe/Madrid", us(2022, 7, 1, 10)), ("2022-01-01 00:00:00", "Nowhere/At_All", None)],
)
def test_clock_changes(spark, value, zone, want):
    r = spark.createDataFrame([(1, "s", value, None, [None, value], "es", zone)], RESP)
    got = {(x["field"], x["pos"]): x["epoch_us"] for x in normalise_source_times(r, spark.createDataFrame([], CAND)).collect()}
    assert got.get(("publication_dates", 1)) == want
    assert ("last_modified", 0) in got  # these are UTC, whatever the row's zone


def test_missing_zone_is_estimated_from_fetch_times(spark):
    rows = [(i, "s", None, f"Tue, 0{1 + i} Aug 2023 16:05:00 GMT", [f"2023-08-0{1 + i} 12:00:00"], "es", None) for i in range(5)]
    got = normalise_source_times(spark.createDataFrame(rows, RESP), spark.createDataFrame([(1, "2023-08-01 12:00:00", "es", None, 2)], CAND)).where("field IN ('publication_dates', 'published_at')").collect()
    assert len(got) == 6 and all(r["epoch_us"] % 86_400_000_000 == 16 * 3_600_000_000 for r in got)


def test_estimate_prefers_no_violation(spark):
    rows = spark.createDataFrame([("s", us(2023, 1, 1, 12), us(2023, 1, 1, 11, 30))], "src string, w long, s long")
    assert estimate_zones(rows, "src", "w", "s", ["UTC", "Europe/Madrid"]).collect()[0]["zone_estimate"] == "Europe/Madrid"


def test_withheld_zones_are_found_again(spark):
    """Two pages a week over two years, fetched up to a day after they were written, or known by their neighbours alone."""
    from pyspark.sql import functions as F

    zones = spark.createDataFrame([(z,) for z in CANDIDATE_ZONES], "src string")
    start = us(2021, 1, 1)
    local = zones.select("src", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("i")).select("src", "i", (F.lit(start) + F.col("i") * 302_400_000_000).alias("instant"))
    local = local.withColumn("w", F.unix_micros(F.from_utc_timestamp(F.timestamp_micros("instant"), F.col("src"))))
    seen = local.withColumn("s", F.col("instant") + F.abs(F.xxhash64("src", "i")) % 86_400_000_000)
    found = {r["src"]: r["zone_estimate"] for r in estimate_zones(seen, "src", "w", "s", CANDIDATE_ZONES).collect()}
    same = {"America/Lima": "America/Bogota", "America/Sao_Paulo": "America/Argentina/Buenos_Aires"}  # one offset history: the first by name stands for both
    assert found == {z: same.get(z, z) for z in CANDIDATE_ZONES}
    marks = local.select("src", (F.col("i") * 3).alias("place"), "w", F.lit(None).cast("long").alias("known"))
    marks = marks.unionByName(local.select("src", (F.col("i") * 3 - 1).alias("place"), F.lit(None).cast("long").alias("w"), (F.col("instant") - 600_000_000).alias("known")))
    marks = marks.unionByName(local.select("src", (F.col("i") * 3 + 1).alias("place"), F.lit(None).cast("long").alias("w"), (F.col("instant") + 600_000_000).alias("known")))
    bounds = sequence_bounds(marks, "src", "place", "known").where("w IS NOT NULL")
    found = {r["src"]: r["zone_estimate"] for r in estimate_zones(bounds, "src", "w", "before_us", CANDIDATE_ZONES, "after_us").collect()}
    assert found == {z: same.get(z, z) for z in CANDIDATE_ZONES}


def test_repeats_and_empty(spark):
    row = (1, "s", "2023-01-01 00:00:00", None, [], "es", "Europe/Madrid")
    empty = spark.createDataFrame([], CAND)
    assert normalise_source_times(spark.createDataFrame([row, row], RESP), empty).count() == 1
    assert normalise_source_times(spark.createDataFrame([], RESP), empty).count() == 0
