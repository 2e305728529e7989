"""Observation, quality and ingestion queries over the revision table, with SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.operators import ingestion as I
from lodestat.operators import observations as O
from lodestat.sources.tables import table

CUT = date(2018, 6, 30)
FROM, TO = date(2015, 1, 1), date(2016, 12, 31)
RULES = (
    I.Rule("R1", "REQUIRED_MEASURE", "CRITICAL"), I.Rule("R2", "NON_NEGATIVE", "ERROR"), I.Rule("R3", "NUMERIC_RANGE", "WARNING", "10", "50000.5"),
    I.Rule("R4", "NUMERIC_RANGE", "INFO", "ten", None), I.Rule("R5", "CHECKSUM", "INFO"),
)
REQUIRED, ALLOWED = ("FREQ", "GEO", "IND"), ("FREQ", "GEO", "IND", "SECTOR")


def revisions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observation_revision")


def timed(spark: SparkSession, d: str) -> DataFrame:
    return O.intervals(revisions(spark, d))


def _us(c: str):
    return F.unix_micros(F.col(c)).alias(c)


def interval_closing(spark, d):
    return timed(spark, d).select("observation_revision_id", "version", _us("valid_from"), _us("valid_to"), "is_current")


def observations_current(spark, d):
    return O.current(timed(spark, d)).select("series_id", "period_start", "period_end", "observation_revision_id", "numeric_value")


def observations_as_of(spark, d):
    return O.as_of(timed(spark, d), CUT).select("series_id", "period_start", "period_end", "observation_revision_id", "numeric_value")


def observations_as_of_strict(spark, d):
    return O.as_of(timed(spark, d), CUT, strict_status=True).select("series_id", "period_start", "period_end", "observation_revision_id", "numeric_value")


def observations_period_overlap(spark, d):
    return O.current(timed(spark, d)).where(O.overlapping(FROM, TO)).select("observation_revision_id", "period_start", "period_end")


def observations_disclosed(spark, d):
    rows = O.current(timed(spark, d))
    scopes = {"all": O.Scope(unrestricted=True), "owner": O.Scope(owner="SRC_SIPRERN"), "public": O.Scope()}
    parts = [rows.where(s.predicate()).select(F.lit(n).alias("scope"), "observation_revision_id") for n, s in scopes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def observations_dimension_filtered(spark, d):
    r = revisions(spark, d)
    return O.with_dimensions(O.current(O.intervals(r)), O.dimension_values(r), {"FREQ": "M"}).select("observation_revision_id", "series_key")


def observation_query(spark, d):
    q = O.ObservationQuery(O.Scope(), FROM, TO, CUT, {"FREQ": "M"}, page=2, size=40)
    return q.run(revisions(spark, d)).select("period_start", "series_key", "period_end", "observation_revision_id")


def page_offset(spark, d):
    return O.offset_page(O.current(timed(spark, d)), ["period_start", "series_key", "observation_revision_id"], 3, 50, descending=True).select("period_start", "series_key", "observation_revision_id")


def page_keyset_asc(spark, d):
    return O.keyset_page(table(spark, d, "orders"), ["o_orderpriority", "o_orderkey"], ["2-HIGH", 500], 75).select("o_orderpriority", "o_orderkey")


def page_keyset_desc(spark, d):
    return O.keyset_page(table(spark, d, "orders"), ["o_orderpriority", "o_orderkey"], ["2-HIGH", 500], 75, descending=True).select("o_orderpriority", "o_orderkey")


def page_total(spark, d):
    return O.page_info(O.current(timed(spark, d)), 50)


def observation_enriched(spark, d):
    page = O.offset_page(O.current(timed(spark, d)), ["period_start", "series_key", "observation_revision_id"], 1, 100).select("observation_revision_id", "series_id")
    dims = O.dimension_values(revisions(spark, d))
    out = O.enriched(page, dims, "series_id", ["position", "code", "kind", "value"], "dimensions")
    return out.select("observation_revision_id", F.size("dimensions").cast("long").alias("n"), F.array_join(F.transform("dimensions", lambda x: F.concat_ws("=", x["code"], x["value"])), "|").alias("dimensions"))


def unchanged_detection(spark, d):
    return O.unchanged(timed(spark, d)).select("observation_revision_id", "unchanged")


def lineage_revised_from(spark, d):
    return O.revised_from(timed(spark, d))


def series_breaks(spark, d):
    return O.series_breaks(timed(spark, d))


def series_identity(spark, d):
    return revisions(spark, d).select("series_key").distinct().select("series_key", O.series_hash(F.col("series_key")).alias("hash"))


def revision_hash(spark, d):
    return O.distinct_revisions(revisions(spark, d)).select("observation_revision_id", O.revision_hash().alias("hash"))


def structure_violations(spark, d):
    v = I.structure_violations(O.dimension_values(revisions(spark, d)), "series_id", [*REQUIRED, "SECTOR"], ["FREQ", "IND", "SECTOR"])
    return v.select("series_id", F.array_join("missing", ",").alias("missing"), F.array_join("unknown", ",").alias("unknown"))


def reference_violations(spark, d):
    dims = O.dimension_values(revisions(spark, d)).where("kind = 'geography'")
    geo = I.reference_violations(dims, "value", table(spark, d, "geographic_unit"), "geographic_unit_id").select(F.lit("geography").alias("catalogue"), "series_id", F.col("value").alias("reference"))
    unit = I.reference_violations(revisions(spark, d), "unit_measure_id", table(spark, d, "unit_measure").where("value_kind <> 'RATE'"), "unit_measure_id").select(F.lit("unit").alias("catalogue"), "series_id", F.col("unit_measure_id").alias("reference")).distinct()
    return geo.unionByName(unit)


def one_of_violations(spark, d):
    return table(spark, d, "numeric_occurrence").where(~I.exactly_one("unit_measure_id", "context_text")).select("occurrence_id").distinct()


def _assessed(spark, d):
    return I.assess(O.distinct_revisions(revisions(spark, d)), "observation_revision_id", "numeric_value", RULES)


def quality_rules(spark, d):
    return _assessed(spark, d).groupBy("rule", "status").agg(F.count(F.lit(1)).alias("n"))


def quality_issues(spark, d):
    return I.issues(_assessed(spark, d)).where("status = 'FAIL'").select("observation_revision_id", "rule", "severity")


def critical_rejections(spark, d):
    return I.rejected(_assessed(spark, d), "observation_revision_id")


def quality_summary(spark, d):
    return I.quality_summary(_assessed(spark, d), "observation_revision_id")


def batch_rollup(spark, d):
    return I.batch_rollup(O.distinct_revisions(revisions(spark, d)), "source_artifact_id", F.col("numeric_value").isNotNull() & F.col("status").isin("PUBLISHED", "SUPERSEDED"))


def constraint_report(spark, d):
    return I.constraint_report(timed(spark, d))


def upsert_latest(spark, d):
    r = O.distinct_revisions(revisions(spark, d)).select("series_id", "period_start", "period_end", "revision_number", "observation_revision_id", "numeric_value")
    return I.upsert(r.where("revision_number = 1"), r.where("revision_number > 1"), ["series_id", "period_start", "period_end"], ["revision_number", "observation_revision_id"])


def insert_if_absent(spark, d):
    r = revisions(spark, d).select("series_id", "source_code", "observation_revision_id")
    return I.insert_if_absent(r.where("source_code <= 'SRC_M'").select("series_id"), r, ["series_id"], ["observation_revision_id"]).select("series_id", "observation_revision_id")


def artifact_registration(spark, d):
    return I.register_artifacts(table(spark, d, "documents"), "doc_id", "text")


def backlog_metrics(spark, d):
    r = O.distinct_revisions(revisions(spark, d))
    t = O.end_of_day(date(2025, 6, 30))
    return r.agg(
        F.count_if(~F.col("status").isin("PUBLISHED", "SUPERSEDED")).alias("not_valid"), F.count_if(F.col("publication_date").isNull()).alias("unpublished"),
        F.max(F.unix_micros("capture_date")).alias("latest_us"), F.count_if((F.col("capture_date") > t - F.expr("INTERVAL 48 HOURS")) & (F.col("capture_date") <= t)).alias("recent"),
    )


def stale_sources(spark, d):
    r = revisions(spark, d)
    fresh = r.where(F.col("capture_date") > F.lit("2024-06-30 00:00:00").cast("timestamp")).select("source_code").distinct()
    return r.select("source_code").distinct().join(fresh, "source_code", "left_anti")


def ingestion_lag(spark, d):
    r = O.distinct_revisions(revisions(spark, d)).where("capture_date IS NOT NULL AND vintage_date IS NOT NULL")
    return r.groupBy("source_code").agg(F.max(F.date_diff(F.to_date("capture_date"), "vintage_date")).alias("longest_days"), F.count_if(F.date_diff(F.to_date("capture_date"), "vintage_date") > 30).alias("late"))


def lag_histogram(spark, d):
    """Cumulative buckets of the days between vintage and capture."""
    days = F.date_diff(F.to_date("capture_date"), "vintage_date")
    r = O.distinct_revisions(revisions(spark, d)).where("capture_date IS NOT NULL AND vintage_date IS NOT NULL")
    counts = r.groupBy("status").agg(*(F.count_if(days <= b).alias(f"le_{b}") for b in (0, 1, 7, 30, 365)), F.count(F.lit(1)).alias("le_inf"))
    return counts


def half_trend(spark, d):
    """Mean of a source's values in the earlier and the later half of the calendar, and the drift between them."""
    r = O.current(timed(spark, d)).select("source_code", F.col("numeric_value").try_cast("decimal(30,6)").alias("v"), (F.col("period_start") >= F.lit(date(2017, 1, 1))).alias("later")).where("v IS NOT NULL")
    mean = lambda c: F.sum(F.when(c, F.col("v"))).cast("double") / F.count_if(c)
    early = F.when(F.count_if(~F.col("later")) > 0, mean(~F.col("later")))
    late = F.when(F.count_if(F.col("later")) > 0, mean(F.col("later")))
    return r.groupBy("source_code").agg(F.round(early, 4).alias("earlier"), F.round(late, 4).alias("later"), F.min("v").cast("double").alias("least"), F.max("v").cast("double").alias("greatest"))


def trace_core(spark, d):
    page = O.offset_page(table(spark, d, "orders"), ["o_orderkey"], 1, 200)
    li, t = table(spark, d, "lineitem"), lambda n: table(spark, d, n)
    rows = li.join(page, li["l_orderkey"] == page["o_orderkey"]).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("o_orderkey", "c_name", "n_name", "r_name").agg(F.count(F.lit(1)).alias("lines"), F.array_join(F.array_sort(F.collect_set("s_name")), ",").alias("suppliers"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity"))


_NAMES = (
    "interval_closing observations_current observations_as_of observations_as_of_strict observations_period_overlap observations_disclosed observations_dimension_filtered "
    "observation_query page_offset page_keyset_asc page_keyset_desc page_total observation_enriched unchanged_detection lineage_revised_from series_breaks series_identity "
    "revision_hash structure_violations reference_violations one_of_violations quality_rules quality_issues critical_rejections quality_summary batch_rollup constraint_report "
    "upsert_latest insert_if_absent artifact_registration backlog_metrics stale_sources ingestion_lag lag_histogram half_trend trace_core"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

_R = "r AS (SELECT DISTINCT * FROM observation_revision)"
_T = _R + """,
    t AS (SELECT *, row_number() OVER w AS version, capture_date AS valid_from, lead(capture_date) OVER w AS valid_to FROM r
          WHERE status IN ('PUBLISHED', 'SUPERSEDED') AND capture_date IS NOT NULL
          WINDOW w AS (PARTITION BY series_id, period_start, period_end ORDER BY capture_date, observation_revision_id)),
    c AS (SELECT * FROM t WHERE valid_to IS NULL AND status = 'PUBLISHED')"""
_D = """d AS (SELECT series_id, position, split_part(part, '=', 1) AS code, regexp_extract(part, '=([a-z]+):', 1) AS kind, regexp_extract(part, '=[a-z]+:(.*)$', 1) AS value
    FROM (SELECT DISTINCT series_id, unnest(string_split(series_key, '|')) AS part, generate_subscripts(string_split(series_key, '|'), 1) - 1 AS position FROM observation_revision))"""
_IN = "valid_from <= TIMESTAMPTZ '2018-06-30 23:59:59.999+00' AND (valid_to IS NULL OR valid_to > TIMESTAMPTZ '2018-06-30 23:59:59.999+00')"
_COLS = "series_id, period_start, period_end, observation_revision_id, numeric_value"
_NUM = "CASE WHEN regexp_matches(numeric_value, '^-?(0|[1-9][0-9]*)([.][0-9]+)?$') THEN TRY_CAST(numeric_value AS DECIMAL(38,12)) END"
_ASSESS = f"""a AS (
    SELECT observation_revision_id, 'R1' AS rule, 'CRITICAL' AS severity, CASE WHEN numeric_value IS NOT NULL THEN 'PASS' ELSE 'FAIL' END AS status FROM r
    UNION ALL SELECT observation_revision_id, 'R2', 'ERROR', CASE WHEN {_NUM} >= 0 THEN 'PASS' ELSE 'FAIL' END FROM r
    UNION ALL SELECT observation_revision_id, 'R3', 'WARNING', CASE WHEN {_NUM} BETWEEN 10 AND 50000.5 THEN 'PASS' ELSE 'FAIL' END FROM r
    UNION ALL SELECT observation_revision_id, 'R4', 'INFO', 'ERROR' FROM r UNION ALL SELECT observation_revision_id, 'R5', 'INFO', 'ERROR' FROM r)"""
_J = "CASE WHEN {0} IS NULL THEN 'null' ELSE concat('\"', regexp_replace(CAST({0} AS VARCHAR), '([\"\\\\])', '\\\\\\1', 'g'), '\"') END"

SQL = {
    "interval_closing": f"WITH {_T} SELECT observation_revision_id, version, epoch_us(valid_from) AS valid_from, epoch_us(valid_to) AS valid_to, valid_to IS NULL AS is_current FROM t",
    "observations_current": f"WITH {_T} SELECT {_COLS} FROM c",
    "observations_as_of": f"WITH {_T} SELECT {_COLS} FROM t WHERE {_IN} QUALIFY row_number() OVER (PARTITION BY series_id, period_start, period_end ORDER BY valid_from DESC, version DESC) = 1",
    "observations_as_of_strict": f"WITH {_T} SELECT {_COLS} FROM t WHERE status = 'PUBLISHED' AND {_IN} QUALIFY row_number() OVER (PARTITION BY series_id, period_start, period_end ORDER BY valid_from DESC, version DESC) = 1",
    "observations_period_overlap": f"WITH {_T} SELECT observation_revision_id, period_start, period_end FROM c WHERE period_end >= DATE '2015-01-01' AND period_start <= DATE '2016-12-31'",
    "observations_disclosed": f"""WITH {_T} SELECT 'all' AS scope, observation_revision_id FROM c
        UNION ALL SELECT 'owner', observation_revision_id FROM c WHERE confidentiality_status IN ('PUBLIC', 'FREE', 'OPEN') OR source_code = 'SRC_SIPRERN'
        UNION ALL SELECT 'public', observation_revision_id FROM c WHERE confidentiality_status IN ('PUBLIC', 'FREE', 'OPEN')""",
    "observations_dimension_filtered": f"""WITH {_T}, {_D} SELECT observation_revision_id, series_key FROM c
        WHERE EXISTS (SELECT 1 FROM d WHERE d.series_id = c.series_id AND code = 'FREQ' AND value = 'M')""",
    "observation_query": f"""WITH {_T}, {_D}, s AS (SELECT * FROM t WHERE {_IN} QUALIFY row_number() OVER (PARTITION BY series_id, period_start, period_end ORDER BY valid_from DESC, version DESC) = 1)
        SELECT period_start, series_key, period_end, observation_revision_id FROM s WHERE confidentiality_status IN ('PUBLIC', 'FREE', 'OPEN') AND period_end >= DATE '2015-01-01' AND period_start <= DATE '2016-12-31'
          AND EXISTS (SELECT 1 FROM d WHERE d.series_id = s.series_id AND code = 'FREQ' AND value = 'M') ORDER BY period_start, series_key, period_end, observation_revision_id LIMIT 40 OFFSET 40""",
    "page_offset": f"WITH {_T} SELECT period_start, series_key, observation_revision_id FROM c ORDER BY period_start DESC, series_key, observation_revision_id LIMIT 50 OFFSET 100",
    "page_keyset_asc": "SELECT o_orderpriority, o_orderkey FROM orders WHERE (o_orderpriority, o_orderkey) > ('2-HIGH', 500) ORDER BY 1, 2 LIMIT 75",
    "page_keyset_desc": "SELECT o_orderpriority, o_orderkey FROM orders WHERE o_orderpriority < '2-HIGH' OR (o_orderpriority = '2-HIGH' AND o_orderkey > 500) ORDER BY 1 DESC, 2 LIMIT 75",
    "page_total": f"WITH {_T} SELECT count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS total_pages FROM c",
    "observation_enriched": f"""WITH {_T}, {_D}, p AS (SELECT observation_revision_id, series_id FROM c ORDER BY period_start, series_key, observation_revision_id LIMIT 100)
        SELECT observation_revision_id, count(code) AS n, string_agg(code || '=' || value, '|' ORDER BY position) AS dimensions FROM p LEFT JOIN d USING (series_id) GROUP BY 1""",
    "unchanged_detection": f"WITH {_T} SELECT observation_revision_id, version > 1 AND numeric_value IS NOT DISTINCT FROM lag(numeric_value) OVER (PARTITION BY series_id, period_start, period_end ORDER BY version) AS unchanged FROM t",
    "lineage_revised_from": f"WITH {_T} SELECT * FROM (SELECT observation_revision_id AS to_id, lag(observation_revision_id) OVER (PARTITION BY series_id, period_start, period_end ORDER BY version) AS from_id, 'REVISED_FROM' AS relation FROM t) WHERE from_id IS NOT NULL",
    "series_breaks": f"""WITH {_T} SELECT series_id, period_start, period_end, unit_before, unit_measure_id FROM (
        SELECT *, lag(unit_measure_id) OVER (PARTITION BY series_id ORDER BY period_start, period_end, observation_revision_id) AS unit_before FROM c) WHERE unit_before <> unit_measure_id""",
    "series_identity": "SELECT DISTINCT series_key, sha256(CAST(to_json(series_key) AS VARCHAR)) AS hash FROM observation_revision",
    "revision_hash": f"""WITH {_R} SELECT observation_revision_id, sha256(concat('{{"period":[', {_J.format("period_start")}, ',', {_J.format("period_end")}, ',', {_J.format("period_code")}, ',', {_J.format("reference_date")},
        '],"release":[', {_J.format("publication_date")}, ',', {_J.format("vintage_date")}, ',', {_J.format("revision_reason")}, '],"measures":[[', {_J.format("unit_measure_id")}, ',', {_J.format("numeric_value")},
        ',null,null]],"attributes":[],"confidentialityStatus":', {_J.format("confidentiality_status")}, '}}')) AS hash FROM r""",
    "structure_violations": f"""WITH {_D}, k AS (SELECT series_id, list_sort(list(DISTINCT code)) AS codes FROM d GROUP BY 1)
        SELECT series_id, array_to_string(list_filter(['FREQ', 'GEO', 'IND', 'SECTOR'], lambda x: NOT list_contains(codes, x)), ',') AS missing, array_to_string(list_filter(codes, lambda x: x NOT IN ('FREQ', 'IND', 'SECTOR')), ',') AS unknown
        FROM k WHERE missing <> '' OR unknown <> ''""",
    "reference_violations": f"""WITH {_D} SELECT 'geography' AS catalogue, series_id, value AS reference FROM d WHERE kind = 'geography' AND value NOT IN (SELECT geographic_unit_id FROM geographic_unit)
        UNION ALL SELECT DISTINCT 'unit', series_id, unit_measure_id FROM observation_revision WHERE unit_measure_id IS NOT NULL AND unit_measure_id NOT IN (SELECT unit_measure_id FROM unit_measure WHERE value_kind <> 'RATE')""",
    "one_of_violations": "SELECT DISTINCT occurrence_id FROM numeric_occurrence WHERE (unit_measure_id IS NULL) = (context_text IS NULL)",
    "quality_rules": f"WITH {_R}, {_ASSESS} SELECT rule, status, count(*) AS n FROM a GROUP BY 1, 2",
    "quality_issues": f"WITH {_R}, {_ASSESS} SELECT observation_revision_id, rule, severity FROM a WHERE status = 'FAIL'",
    "critical_rejections": f"WITH {_R}, {_ASSESS} SELECT DISTINCT observation_revision_id FROM a WHERE status <> 'PASS' AND severity = 'CRITICAL'",
    "quality_summary": f"WITH {_R}, {_ASSESS} SELECT observation_revision_id, count(*) AS assessments, count(*) FILTER (status = 'FAIL') AS failed FROM a GROUP BY 1",
    "batch_rollup": f"""WITH {_R}, b AS (SELECT source_artifact_id, count(*) AS received, count(*) FILTER (numeric_value IS NOT NULL AND status IN ('PUBLISHED', 'SUPERSEDED')) AS accepted FROM r GROUP BY 1)
        SELECT *, received - accepted AS rejected, CASE WHEN received = accepted THEN 'COMMITTED' WHEN accepted = 0 THEN 'REJECTED' ELSE 'PARTIAL' END AS status FROM b""",
    "constraint_report": f"""WITH {_T} SELECT 'period_order' AS invariant, count(*) FILTER (period_end < period_start) AS violations FROM t UNION ALL SELECT 'interval_order', count(*) FILTER (valid_to < valid_from) FROM t
        UNION ALL SELECT 'current_not_published', count(*) FILTER (valid_to IS NULL AND status <> 'PUBLISHED') FROM t UNION ALL SELECT 'no_measure', count(*) FILTER (numeric_value IS NULL) FROM t
        UNION ALL SELECT 'not_decimal', count(*) FILTER (NOT regexp_matches(numeric_value, '^-?(0|[1-9][0-9]*)([.][0-9]+)?$')) FROM t UNION ALL SELECT 'published_after_vintage', count(*) FILTER (publication_date > vintage_date) FROM t""",
    "upsert_latest": f"""WITH {_R}, n AS (SELECT * FROM r WHERE revision_number > 1 QUALIFY row_number() OVER (PARTITION BY series_id, period_start, period_end ORDER BY revision_number DESC, observation_revision_id DESC) = 1)
        SELECT series_id, period_start, period_end, revision_number, observation_revision_id, numeric_value FROM n UNION ALL SELECT series_id, period_start, period_end, revision_number, observation_revision_id, numeric_value FROM r
        WHERE revision_number = 1 AND NOT EXISTS (SELECT 1 FROM n WHERE n.series_id = r.series_id AND n.period_start = r.period_start AND n.period_end = r.period_end)""",
    "insert_if_absent": "SELECT series_id, min(observation_revision_id) AS observation_revision_id FROM observation_revision WHERE series_id NOT IN (SELECT series_id FROM observation_revision WHERE source_code <= 'SRC_M') GROUP BY 1",
    "artifact_registration": "SELECT doc_id, sha256(text) AS sha256, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY text) THEN 'CREATED' ELSE 'EXISTING' END AS outcome FROM documents WHERE text IS NOT NULL",
    "backlog_metrics": f"""WITH {_R} SELECT count(*) FILTER (status NOT IN ('PUBLISHED', 'SUPERSEDED')) AS not_valid, count(*) FILTER (publication_date IS NULL) AS unpublished, max(epoch_us(capture_date)) AS latest_us,
        count(*) FILTER (capture_date > TIMESTAMPTZ '2025-06-28 23:59:59.999+00' AND capture_date <= TIMESTAMPTZ '2025-06-30 23:59:59.999+00') AS recent FROM r""",
    "stale_sources": "SELECT DISTINCT source_code FROM observation_revision o WHERE source_code IS NOT NULL AND NOT EXISTS (SELECT 1 FROM observation_revision x WHERE x.source_code = o.source_code AND x.capture_date > TIMESTAMPTZ '2024-06-30 00:00:00+00')",
    "ingestion_lag": f"WITH {_R} SELECT source_code, CAST(max(CAST(capture_date AS DATE) - vintage_date) AS INTEGER) AS longest_days, count(*) FILTER (CAST(capture_date AS DATE) - vintage_date > 30) AS late FROM r WHERE capture_date IS NOT NULL AND vintage_date IS NOT NULL GROUP BY 1",
    "lag_histogram": f"WITH {_R}, x AS (SELECT status, CAST(capture_date AS DATE) - vintage_date AS days FROM r WHERE capture_date IS NOT NULL AND vintage_date IS NOT NULL) SELECT status, " + ", ".join(f"count(*) FILTER (days <= {b}) AS le_{b}" for b in (0, 1, 7, 30, 365)) + ", count(*) AS le_inf FROM x GROUP BY 1",
    "half_trend": f"""WITH {_T}, v AS (SELECT source_code, TRY_CAST(numeric_value AS DECIMAL(30,6)) AS v, period_start >= DATE '2017-01-01' AS later FROM c)
        SELECT source_code, round(CAST(sum(v) FILTER (NOT later) AS DOUBLE) / nullif(count(*) FILTER (NOT later), 0), 4) AS earlier, round(CAST(sum(v) FILTER (later) AS DOUBLE) / nullif(count(*) FILTER (later), 0), 4) AS later,
          CAST(min(v) AS DOUBLE) AS least, CAST(max(v) AS DOUBLE) AS greatest FROM v WHERE v IS NOT NULL GROUP BY 1""",
    "trace_core": """WITH p AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 200) SELECT o_orderkey, c_name, n_name, r_name, count(*) AS lines, array_to_string(list_sort(list(DISTINCT s_name)), ',') AS suppliers, sum(CAST(l_quantity AS DECIMAL(18,2))) AS quantity
        FROM p JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4""",
}
