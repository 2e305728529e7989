from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lodestat.operators import claims as C
from lodestat.operators import ingestion as I
from lodestat.operators import observations as O

REV = "observation_revision_id long, series_id string, series_key string, period_start date, period_end date, status string, capture_date timestamp, numeric_value string, confidentiality_status string, source_code string"


def rev(i, day, status="PUBLISHED", value="1", end=date(2020, 1, 31), conf="PUBLIC", source="A"):
    return (i, "s", "A=text:x|B=code:y", date(2020, 1, 1), end, status, datetime(2020, 2, day, 12), value, conf, source)


def test_superseded_revision_before_at_and_after_its_close(spark):
    t = O.intervals(spark.createDataFrame([rev(1, 1, "SUPERSEDED"), rev(2, 10), rev(3, 5, "REJECTED"), rev(2, 10)], REV))
    ids = lambda df: [r["observation_revision_id"] for r in df.collect()]
    assert ids(O.as_of(t, date(2020, 1, 31))) == [] and ids(O.as_of(t, date(2020, 2, 9))) == [1] and ids(O.as_of(t, date(2020, 2, 10))) == [2]
    assert ids(O.as_of(t, date(2020, 2, 9), strict_status=True)) == [] and ids(O.current(t)) == [2]
    assert [tuple(r) for r in O.revised_from(t).select("to_id", "from_id").collect()] == [(2, 1)]
    assert {r["observation_revision_id"]: r["unchanged"] for r in O.unchanged(t).collect()} == {1: False, 2: True}


def test_scopes_do_not_leak(spark):
    rows = spark.createDataFrame([rev(1, 1), rev(2, 1, conf="SECRET"), rev(3, 1, conf="SECRET", source="B"), rev(4, 1, conf=None, source=None)], REV)
    ids = lambda s: {r["observation_revision_id"] for r in rows.where(s.predicate()).collect()}
    assert ids(O.Scope()) == {1} and ids(O.Scope(owner="B")) == {1, 3} and ids(O.Scope(unrestricted=True)) == {1, 2, 3, 4}


def test_keyset_pages_cover_all_rows_once(spark):
    rows = spark.createDataFrame([(i // 3, i) for i in range(20)], "a int, b int")
    for descending in (False, True):
        seen, after = [], None
        while True:
            page = (O.keyset_page(rows, ["a", "b"], after, 4, descending=descending) if after else O.offset_page(rows, ["a", "b"], 1, 4, descending=descending)).collect()
            seen += [r["b"] for r in page]
            if len(page) < 4:
                break
            after = O.decode_cursor(O.encode_cursor([page[-1]["a"], page[-1]["b"]]))
        assert sorted(seen) == list(range(20)) and len(seen) == 20


def test_query_validation_and_cursor():
    for bad in ({"page": 0}, {"size": 201}, {"cursor": "x", "page": 2}, {"period_from": date(2020, 1, 2), "period_to": date(2020, 1, 1)}):
        with pytest.raises(ValueError):
            O.ObservationQuery(O.Scope(), **bad)
    with pytest.raises(ValueError):
        O.decode_cursor("!!")


def test_series_and_revision_hash(spark):
    import hashlib
    import json

    row = spark.createDataFrame([('A=text:"q\\uote"',)], "series_key string")
    assert row.select(O.series_hash(F.col("series_key"))).first()[0] == hashlib.sha256(json.dumps('A=text:"q\\uote"').encode()).hexdigest()


def test_dimensions_and_structure(spark):
    dims = O.dimension_values(spark.createDataFrame([("s", "A=text:x|B=code:y"), ("t", "A=text:x")], "series_id string, series_key string"))
    got = {r["series_id"]: (r["missing"], r["unknown"]) for r in I.structure_violations(dims, "series_id", ["A", "B"], ["A", "B"]).collect()}
    assert got == {"t": (["B"], [])}


def test_rules(spark):
    rows = spark.createDataFrame([(1, "5"), (2, "-0.5"), (3, None), (4, "1e3")], "id int, v string")
    rules = [I.Rule("req", "REQUIRED_MEASURE", "CRITICAL"), I.Rule("pos", "NON_NEGATIVE"), I.Rule("rng", "NUMERIC_RANGE", minimum="0", maximum="5"), I.Rule("bad", "NUMERIC_RANGE", minimum="x"), I.Rule("odd", "OTHER")]
    got = {(r["id"], r["rule"]): r["status"] for r in I.assess(rows, "id", "v", rules).collect()}
    assert [got[1, r] for r in ("req", "pos", "rng", "bad", "odd")] == ["PASS", "PASS", "PASS", "ERROR", "ERROR"]
    assert [got[i, "pos"] for i in (2, 3, 4)] == ["FAIL"] * 3 and got[3, "req"] == "FAIL" and got[4, "rng"] == "FAIL"
    assert [r["id"] for r in I.rejected(I.assess(rows, "id", "v", rules), "id").collect()] == [3]


def test_upsert_is_idempotent(spark):
    old, new = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, n int, v string"), spark.createDataFrame([(2, 2, "c"), (2, 3, "d"), (3, 1, "e")], "k int, n int, v string")
    once = I.upsert(old, new, ["k"], ["n"])
    twice = I.upsert(once, new, ["k"], ["n"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, 1, "a"), (2, 3, "d"), (3, 1, "e")]


def test_one_of(spark):
    rows = spark.createDataFrame([(1, None), (1, 2), (None, None)], "a int, b int")
    assert [r[0] for r in rows.select(I.exactly_one("a", "b")).collect()] == [True, False, False]


def test_mentions(spark):
    aliases = spark.createDataFrame([("e1", "YPFB"), ("e2", "Banco Sur S.A."), ("e3", "Banco Sur Ltda."), ("e4", None)], "economic_entity_id string, alias string")
    m = spark.createDataFrame([(1, "ypfb"), (2, "Y.P.F.B."), (3, "Banco Sur"), (4, "otro"), (5, None)], "mention_id int, mention_text string")
    got = {r["mention_id"]: (r["entity"], r["how"], r["certainty"]) for r in C.resolve_mentions(m, aliases).collect()}
    assert got == {1: ("e1", "EXACT_ALIAS", 1.0), 2: ("e1", "NORMALIZED_ALIAS", 0.9), 3: (None, "UNRESOLVED", None), 4: (None, "UNRESOLVED", None), 5: (None, "UNRESOLVED", None)}


def test_routing_calibration_retry(spark):
    rows = spark.createDataFrame([("x", "FACT", "HIGH", None), ("x", "FORECAST", "HIGH", None), ("x", "FACT", "LOW", None), ("x", "FACT", "HIGH", "CRITICAL"), ("system prompt", "FORECAST", "HIGH", None)], "a string, t string, c string, i string")
    assert [r[0] for r in rows.select(C.route(F.col("a"), F.lit(None).cast("string"), F.col("t"), F.col("c"), F.col("i"))).collect()] == ["PUBLISH", "REVIEW", "REVIEW", "REVIEW", "QUARANTINE"]
    level, score, adjusted = C.calibrated(F.lit("VERY_HIGH"), F.lit(0.96), F.lit(False))
    assert tuple(spark.range(1).select(level, score, adjusted).first()) == ("LOW", 0.49, True)
    got = [r[0] for r in spark.range(6).select(C.retry(F.col("id").cast("int"))).collect()]
    assert (got[0]["attempt"], got[0]["delay_seconds"], got[2]["delay_seconds"]) == (1, 30, 120) and got[5]["action"] == "DEAD_LETTER"


def test_cap_of_consolidated_evidence(spark):
    rows = [(i, "k", f"e{i}") for i in range(12)] + [(20, "k", "e0"), (21, "other", "e0")]
    got = {r["candidate_id"]: r["into_id"] for r in C.consolidation_cut(spark.createDataFrame(rows, "candidate_id int, key string, evidence string")).collect()}
    assert all(got[i] == 0 for i in range(10)) and got[10] == 10 and got[20] == 20 and got[21] == 21


def test_conflicts_of_a_hot_subject(spark):
    rows = [(i, "s", date(2020, 1, 1), f"h{i % 3}") for i in range(30)] + [(99, None, date(2020, 1, 1), "h")]
    got = C.conflicts(spark.createDataFrame(rows, "candidate_id int, subject string, event_date date, hash string")).collect()
    assert sorted((r["primary_id"], r["contradicting_id"], r["claims"]) for r in got) == [(0, 1, 10), (0, 2, 10)]
