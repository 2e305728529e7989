"""Queries of listings, searches under disclosure, references, counters and records, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions import records as R
from lodestat.functions import text as X
from lodestat.operators import claims as C
from lodestat.operators import listings as L
from lodestat.operators import observations as O
from lodestat.plans import claims as PC
from lodestat.plans import observations as PO
from lodestat.sources.tables import table

#: Statuses that the routes of a claim lead to.
STATUS = {"PUBLISH": "PUBLISHED", "REVIEW": "PENDING_REVIEW", "QUARANTINE": "QUARANTINED"}
OWNER = "SRC_MAMALMI"
ORDER = ["period_start", "series_key", "observation_revision_id"]


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with the status their route gives them and the source of their response as owner."""
    owners = table(spark, d, "source_response").groupBy("response_id").agg(F.min("source_code").alias("owner"))
    route = C.route(F.col("assertion"), F.col("excerpt"), F.coalesce("claim_type", F.lit("")), F.coalesce("confidence_level", F.lit("")), F.col("impact_level"))
    status = F.element_at(F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair)), route)
    return table(spark, d, "candidate").withColumn("status", status).join(owners, "response_id", "left")


def claim_disclosure(spark, d):
    """How many claims of each status three readers may see."""
    rows = claims(spark, d)
    readers = {"all": O.Scope(unrestricted=True), "owner": O.Scope(owner=OWNER), "none": O.Scope()}
    parts = [L.ClaimQuery(scope, status).select(rows).select(F.lit(reader).alias("reader"), "status", "candidate_id") for reader, scope in readers.items() for status in STATUS.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("reader", "status").agg(F.count(F.lit(1)).alias("n"), F.min("candidate_id").alias("first_id"))


def _links(spark, d):
    return PC.conflicting_claims(spark, d).select("primary_id", "contradicting_id")


def claim_contradictions(spark, d):
    return L.open_contradictions(_links(spark, d)).select(F.col("id").alias("candidate_id"), "n")


def claim_page(spark, d):
    """A page of one owner's claims under review, with the total, confidence, evidence and open contradictions."""
    query = L.ClaimQuery(O.Scope(owner=OWNER), "PENDING_REVIEW", {"claim_type": "ESTIMATE", "statistical_domain_id": None}, L.Page(1, 30))
    page = L.materialise(query.run(claims(spark, d), [F.col("event_date").desc_nulls_last(), F.col("candidate_id")]))
    ends = L.sides(_links(spark, d), "primary_id", "contradicting_id", "candidate_id")
    counts = ends.join(page.select("candidate_id"), "candidate_id", "left_semi").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"))
    view = page.join(counts, "candidate_id", "left").select(
        "candidate_id", "status", "event_date", F.struct(F.col("confidence_level").alias("level"), F.col("confidence_score").cast("double").alias("score")).alias("confidence"),
        F.struct(F.col("owner").alias("source"), F.col("publisher").alias("publisher")).alias("produced_by"), F.coalesce("n", F.lit(0)).alias("open_contradictions"), "total",
    )
    return view.select("candidate_id", "status", "event_date", F.col("confidence.level").alias("level"), F.col("confidence.score").alias("score"), F.col("produced_by.source").alias("source"), "open_contradictions", "total")


def _issues(spark, d):
    """Failed assessments as issues; every third is settled."""
    rows = PO.quality_issues(spark, d)
    state = F.when(F.col("observation_revision_id") % 3 == 0, "CLOSED").otherwise("OPEN")
    return rows.select(F.lit("OBSERVATION_REVISION").alias("target_type"), F.col("observation_revision_id").cast("string").alias("target_id"), "rule", "severity", state.alias("status"))


def observation_search(spark, d):
    """A page of observations in its whole shape."""
    rows = O.ObservationQuery(O.Scope(owner="SRC_SIPRERN"), PO.FROM, PO.TO).select(PO.revisions(spark, d))
    page = L.listing(rows, [F.col(c) for c in ORDER], L.Page(2, 40)).select(*ORDER, "series_id", "period_end", "source_code", "total")
    sources = table(spark, d, "source_response").groupBy("source_code").agg(F.count_distinct("response_id").alias("pages"))
    out = L.observation_shape(page, PO.revisions(spark, d), table(spark, d, "unit_measure"), PO._assessed(spark, d), _issues(spark, d), sources)
    pairs = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["code"], x["value"])), "|")
    return out.select("observation_revision_id", "source_code", "pages", pairs("measures").alias("measures"), pairs("attributes").alias("attributes"), pairs("dimensions").alias("dimensions"), "assessments", "failed", "open_issues", "total")


def observation_cursor(spark, d):
    """L3: the cursors behind a full page, and behind one that is short."""
    rows = O.current(PO.timed(spark, d)).select(*ORDER)
    full, short = O.offset_page(rows, ORDER, 1, 50), O.offset_page(rows.where("period_start < '2009-02-01'").limit(7), ORDER, 1, 50)
    return L.next_cursor(full, ORDER, 50).select(F.lit("full").alias("page"), "next_cursor").unionByName(L.next_cursor(short, ORDER, 50).select(F.lit("short").alias("page"), "next_cursor"))


def issue_listing(spark, d):
    rows = L.optional_filters(_issues(spark, d), {"status": "OPEN", "severity": None}).withColumn("id", F.col("target_id").cast("long"))
    return L.listing(rows, [F.col("id").desc(), F.col("rule")], L.Page(2, 100)).select("target_id", "rule", "severity", "total")


def source_listing(spark, d):
    s = table(spark, d, "source_response").groupBy("source_code").agg(F.count_distinct("response_id").alias("pages"), F.max("response_id").alias("last_id"))
    held = table(spark, d, "observation_revision").groupBy("source_code").agg(F.count_distinct("series_id").alias("series"))
    return L.listing(L.containing(s.join(held, "source_code"), "ma", "source_code"), [F.col("source_code")], L.Page(1, 10)).select("source_code", "pages", "series", "total")


def organization_listing(spark, d):
    rows = L.containing(table(spark, d, "economic_entity").where("entity_type <> 'PERSON'"), "banco", "canonical_name", "short_name")
    return L.listing(rows, [F.col("canonical_name"), F.col("economic_entity_id")], L.Page(2, 20)).select("economic_entity_id", "canonical_name", "total")


def response_by_id(spark, d):
    """One response by its key."""
    return L.by_key(table(spark, d, "source_response"), "response_id", 7).select("response_id", "source_code", "status", F.md5("text").alias("md5")).distinct()


def run_status(spark, d):
    """Q8: a response as a run: its source, and what was collected in it."""
    run = L.by_key(table(spark, d, "source_response"), "response_id", 7).select("response_id", "source_code", "status").distinct()
    return run.join(table(spark, d, "candidate"), "response_id", "left").groupBy("response_id", "source_code", "status").agg(F.count("candidate_id").alias("claims"))


def issue_targets(spark, d):
    """Issues about revisions and about claims, each met by its own table."""
    about_claims = claims(spark, d).where("status = 'QUARANTINED' OR confidence_score IS NULL").select(F.lit("FACT_CLAIM").alias("target_type"), F.col("candidate_id").cast("string").alias("target_id"))
    refs = _issues(spark, d).select("target_type", "target_id").distinct().unionByName(about_claims)
    r = O.distinct_revisions(PO.revisions(spark, d)).select("observation_revision_id", "source_code")
    c = table(spark, d, "candidate").select("candidate_id", "claim_type")
    found = L.polymorphic(refs, {"OBSERVATION_REVISION": (r, "observation_revision_id"), "FACT_CLAIM": (c, "candidate_id")})
    return found.select("target_type", "target_id", F.coalesce(F.get_json_object("target", "$.source_code"), F.get_json_object("target", "$.claim_type")).alias("label"))


def lineage_touching(spark, d):
    """Lineage edges of which either end is a revision of one source."""
    edges = PO.lineage_revised_from(spark, d)
    own = PO.revisions(spark, d).where(F.col("source_code") == "SRC_SIPRERN").select(F.col("observation_revision_id").alias("id"))
    return L.sides(edges, "to_id", "from_id", "id").join(own, "id", "left_semi").select("to_id", "from_id").distinct()


def conflicting_subjects(spark, d):
    """Conflicts about a domain and horizon, either of which may be null."""
    rows = table(spark, d, "candidate").select("candidate_id", "statistical_domain_id", "time_horizon", F.to_date(F.date_trunc("month", "event_date")).alias("event_date"), PC._hash().alias("hash"))
    return C.conflicts(rows, ("statistical_domain_id", "time_horizon"))


def series_filtered(spark, d):
    """The current values of one source whose place is written as a geography and whose frequency is monthly."""
    place = O.dimension_values(PO.revisions(spark, d)).where("code = 'GEO'").agg(F.min("value")).first()[0]
    q = O.ObservationQuery(O.Scope(unrestricted=True), dimensions={"GEO": ("geography", place or ""), "FREQ": ("code", "M")}, equal={"status": "PUBLISHED"})
    return q.select(PO.revisions(spark, d)).select("observation_revision_id", "series_id")


def series_keys(spark, d):
    """The keys of all series built anew from their dimensions."""
    dims = O.dimension_values(PO.revisions(spark, d)).groupBy("series_id").agg(F.collect_list(F.struct("position", "code", "kind", "value")).alias("dims"))
    return dims.select("series_id", O.series_key(F.col("dims")).alias("series_key"))


def local_date_issue(spark, d):
    """Claims published on the day in La Paz on which their response was captured, as far as both are written as UTC instants."""
    iso = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
    written = F.when(F.col("published_at").isNull() | (F.col("published_at") == "") | F.col("published_at").rlike(iso), F.col("published_at")).otherwise("?")
    run_at = (F.coalesce("event_date", F.lit("2024-01-01").cast("date")).cast("timestamp") + F.expr("INTERVAL 12 HOURS"))
    return table(spark, d, "candidate").select("candidate_id", R.local_date_issue(written, run_at, "America/La_Paz").alias("issue"))


def bulk_update(spark, d):
    rows = L.conditional_update(table(spark, d, "candidate"), (F.col("confidence_score") < 0.5) & (F.col("impact_level") != "LOW"), {"confidence_level": F.lit("LOW"), "confidence_score": F.least(F.col("confidence_score"), F.lit(0.25))})
    return rows.select("candidate_id", "confidence_level", "confidence_score", "updated")


def running_counters(spark, d):
    r = O.distinct_revisions(PO.revisions(spark, d)).where("capture_date IS NOT NULL")
    return L.running_counts(r, "source_code", F.to_date("capture_date"), F.col("status").isin("PUBLISHED", "SUPERSEDED"))


def cited_responses(spark, d):
    known = table(spark, d, "source_response").where("status = 200")
    return L.existence(table(spark, d, "candidate"), "record_type", "response_id", known, "response_id")


def provenance_issues(spark, d):
    """Of each claim the first broken link from its response to a source that has series."""
    r = table(spark, d, "source_response").groupBy("response_id").agg(F.min("source_code").alias("source_code"), F.max("status").alias("http"))
    s = table(spark, d, "observation_revision").select("source_code").distinct().withColumn("held", F.lit(True))
    rows = table(spark, d, "candidate").join(r, "response_id", "left").join(s, "source_code", "left")
    return rows.select("candidate_id", L.first_failure(NO_RESPONSE=F.col("response_id").isNotNull(), UNKNOWN_RESPONSE=F.col("http").isNotNull(), NOT_FETCHED=F.col("http") == 200, UNKNOWN_SOURCE=F.col("held")).alias("issue")).where("issue IS NOT NULL")


def dimension_references(spark, d):
    """P25: dimension values that are in no catalogue: frequencies, places and indicators."""
    values = O.dimension_values(PO.revisions(spark, d))
    frequencies = spark.createDataFrame([("M",), ("Q",)], "value string")
    return L.reference_failures(values, {"FREQ": (frequencies, "value"), "GEO": (table(spark, d, "geographic_unit"), "geographic_unit_id"), "IND": (table(spark, d, "statistical_domain"), "code")})


def dimension_kinds(spark, d):
    """Dimension values written in another kind than their code takes."""
    kinds = spark.createDataFrame([("FREQ", "code"), ("GEO", "geography"), ("IND", "domain")], "code string, wanted string")
    return O.dimension_values(PO.revisions(spark, d)).join(kinds, "code").where("kind <> wanted").groupBy("code", "kind", "wanted").agg(F.count(F.lit(1)).alias("n"))


def series_compatibility(spark, d):
    return L.incompatible_series(PO.revisions(spark, d))


def merged_mentions(spark, d):
    rows = table(spark, d, "candidate").where("entity_mentions IS NOT NULL")
    rows = rows.select("candidate_id", F.coalesce("claim_type", F.lit("")).alias("claim_type"), F.coalesce("time_horizon", F.lit("")).alias("time_horizon"), "entity_mentions", F.transform("entity_mentions", lambda m: F.lower(X.collapse(m))).alias("form"))
    return L.merged_mentions(rows, ["claim_type", "time_horizon"], "candidate_id", "entity_mentions", "form").select("claim_type", "time_horizon", "names", F.array_join("mentions", "|").alias("mentions"))


def definition_lookup(spark, d):
    """Figures with the definition of their unit."""
    n = table(spark, d, "numeric_occurrence").select("occurrence_id", "unit_measure_id").distinct()
    u = table(spark, d, "unit_measure").select("unit_measure_id", F.col("code").alias("unit"), "value_kind")
    return n.join(u, "unit_measure_id", "left").groupBy("unit", "value_kind").agg(F.count(F.lit(1)).alias("n"))


def top_conflicts(spark, d):
    """L4: the 25 contents that contradict most."""
    return PC.conflicting_claims(spark, d).orderBy(F.col("claims").desc(), "contradicting_id").limit(25).select("contradicting_id", "claims")


def candidate_lists(spark, d):
    """U4: collected names, one list after the other."""
    c = table(spark, d, "candidate")
    both = c.where("publisher IS NOT NULL").select(F.lit("publisher").alias("list"), F.col("publisher").alias("name")).unionByName(c.select(F.lit("mention").alias("list"), F.explode("entity_mentions").alias("name")).where("name IS NOT NULL"))
    return both.groupBy("list", "name").agg(F.count(F.lit(1)).alias("n"))


def names_sorted(spark, d):
    """The names of a claim in the order of a Spanish dictionary."""
    c = table(spark, d, "candidate").where("size(entity_mentions) > 1")
    names = F.array_sort(F.transform(F.filter("entity_mentions", lambda m: m.isNotNull()), lambda m: F.collate(m, "es")))
    return c.select("candidate_id", F.array_join(names, "|").cast("string").alias("names"))


def comparable_subjects(spark, d):
    """Claims with a date and at least one identifier of what they are about."""
    return table(spark, d, "candidate").select("candidate_id", (F.col("event_date").isNotNull() & F.coalesce("statistical_domain_id", F.col("response_id").cast("string")).isNotNull()).alias("comparable"))


def json_merge(spark, d):
    one = F.to_json(F.struct("claim_type", F.col("impact_level").alias("level"), "lang"))
    other = F.to_json(F.struct(F.col("confidence_level").alias("level"), "time_horizon"))
    return table(spark, d, "candidate").select("candidate_id", R.merged_json(one, other).alias("merged"))


def canonical_json(spark, d):
    body = F.to_json(F.struct(F.col("title").alias("title"), F.struct(F.col("lang").alias("b"), F.col("claim_type").alias("A")).alias("kind"), F.col("entity_mentions").alias("names"), F.col("candidate_id").alias("id")), {"ignoreNullFields": "false"})
    return table(spark, d, "candidate").select("candidate_id", body.alias("body")).select("candidate_id", F.md5(R.canonical_json("body")).alias("md5"))


def body_summaries(spark, d):
    body = F.when(F.col("candidate_id") % 3 == 0, F.to_json("entity_mentions")).otherwise(F.to_json(F.struct("title", "assertion", "claim_type")))
    return table(spark, d, "candidate").where("entity_mentions IS NOT NULL").select("candidate_id", R.body_summary(body).alias("s")).select("candidate_id", "s.type", "s.count", F.array_join("s.fields", ",").alias("fields"))


def route_patterns(spark, d):
    path = F.concat(F.lit("/api/v1/claims/"), F.coalesce("statistical_domain_id", F.lit("none")), F.lit("/items/"), F.col("candidate_id").cast("string"), F.lit("?page=2"))
    return table(spark, d, "candidate").groupBy(R.route_pattern(path).alias("route")).agg(F.count(F.lit(1)).alias("n"))


def public_urls(spark, d):
    """F32: the URLs as they are, with credentials, with ports and with a local name."""
    u = F.col("url")
    forms = F.explode(F.array(u, F.regexp_replace(u, "://", "://me:pw@"), F.regexp_replace(u, r"^(https?://[^/]*)", "$1:8443"), F.regexp_replace(u, r"^(https?://[^/]*)", "$1:443"), F.regexp_replace(u, r"^(https?://)[^/]*", "$1printer.local"), F.regexp_replace(u, r"^(https?://)[^/]*", "$1192.168.0.9"))).alias("u")
    return table(spark, d, "candidate").where("url IS NOT NULL").select("candidate_id", forms).select("candidate_id", F.md5("u").alias("md5"), R.private_reason(F.col("u")).alias("reason"))


def publication_window(spark, d):
    """P20 over the dates as they are written: one that is no ISO date is outside."""
    return table(spark, d, "candidate").select("candidate_id", F.coalesce(R.window_issue(F.when(F.col("published_at").rlike(r"^\d{4}-\d{2}-\d{2}$") | F.col("published_at").isNull() | (F.col("published_at") == ""), F.col("published_at")).otherwise("?"), "2022-01-01", "2023-12-31"), F.lit("INSIDE")).alias("issue"))


def calibration(spark, d):
    """all four reasons that hold a claim's confidence down; the excerpt is looked for in title and assertion."""
    seen = F.floor((F.length("hay") - F.length(F.replace("hay", "needle", F.lit("")))) / F.length("needle"))
    rows = table(spark, d, "candidate").withColumn("hay", F.lower(F.concat_ws(" ", "title", "assertion"))).withColumn("needle", F.lower(F.try_element_at("entity_mentions", F.lit(1))))
    out = R.calibrated_thrice(F.coalesce("confidence_level", F.lit("LOW")), F.col("confidence_score"), F.when(F.col("claim_type") == "FACT", "SUPPORTED").otherwise("LIMITED"), F.col("published_at").isNotNull(), F.col("publisher").isNotNull(), F.when(F.length("needle") > 0, seen))
    return rows.select("candidate_id", out.alias("o")).select("candidate_id", "o.level", "o.score", "o.adjusted", F.array_join("o.reasons", ",").alias("reasons"))


def review_queue(spark, d):
    """the claims held for review with their reason and urgency; a contradiction outranks the claim's own reason."""
    own = F.when(F.col("impact_level") == "CRITICAL", "CRITICAL_CLAIM").when(F.col("claim_type") == "AI_INFERENCE", "AI_INFERENCE").when(F.col("confidence_level").isin("LOW", "VERY_LOW"), "LOW_CONFIDENCE").otherwise("MANUAL_REQUEST")
    rows = claims(spark, d).join(L.open_contradictions(_links(spark, d)).select(F.col("id").alias("candidate_id"), "n"), "candidate_id", "left").where("n IS NOT NULL OR status = 'PENDING_REVIEW'")
    reason = F.when(F.col("n").isNotNull(), "CONTRADICTION").otherwise(own)
    return rows.select("candidate_id", reason.alias("reason"), R.review_priority(reason).alias("priority"))


_NAMES = (
    "claim_disclosure claim_contradictions claim_page observation_search observation_cursor issue_listing source_listing organization_listing response_by_id run_status issue_targets lineage_touching conflicting_subjects series_filtered series_keys local_date_issue bulk_update "
    "running_counters cited_responses provenance_issues dimension_references dimension_kinds series_compatibility merged_mentions definition_lookup top_conflicts candidate_lists names_sorted comparable_subjects "
    "json_merge canonical_json body_summaries route_patterns public_urls publication_window calibration review_queue"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

_CLAIMS = f"""o AS (SELECT response_id, min(source_code) AS owner FROM source_response GROUP BY 1),
    cl AS (SELECT candidate.*, owner, CASE {PC._ROUTE} WHEN 'PUBLISH' THEN 'PUBLISHED' WHEN 'REVIEW' THEN 'PENDING_REVIEW' ELSE 'QUARANTINED' END AS status FROM candidate LEFT JOIN o USING (response_id))"""
_LINKS = f"lk AS (SELECT primary_id, contradicting_id FROM ({PC.SQL['conflicting_claims']}))"
_SIDES = "sd AS (SELECT id, count(*) AS n FROM (SELECT primary_id AS id FROM lk UNION ALL SELECT contradicting_id FROM lk WHERE contradicting_id <> primary_id) GROUP BY 1)"
_ISSUES = f"{PO._R}, {PO._ASSESS}, iss AS (SELECT 'OBSERVATION_REVISION' AS target_type, CAST(observation_revision_id AS VARCHAR) AS target_id, rule, severity, CASE WHEN observation_revision_id % 3 = 0 THEN 'CLOSED' ELSE 'OPEN' END AS status FROM a WHERE status = 'FAIL')"
_PLAIN = "lower(trim(regexp_replace({0}, '" + PC._WS + "', ' ', 'g')))"

SQL = {
    "claim_disclosure": f"""WITH {_CLAIMS} SELECT reader, status, count(*) AS n, min(candidate_id) AS first_id FROM cl, (VALUES ('all'), ('owner'), ('none')) AS r(reader)
        WHERE status = 'PUBLISHED' OR reader = 'all' OR reader = 'owner' AND owner = '{OWNER}' GROUP BY 1, 2""",
    "claim_contradictions": f"WITH {_LINKS}, {_SIDES} SELECT id AS candidate_id, n FROM sd",
    "claim_page": f"""WITH {_CLAIMS}, {_LINKS}, {_SIDES} SELECT candidate_id, status, event_date, confidence_level AS level, CAST(confidence_score AS DOUBLE) AS score, owner AS source, coalesce(n, 0) AS open_contradictions, total
        FROM (SELECT *, count(*) OVER () AS total FROM cl WHERE status = 'PENDING_REVIEW' AND owner = '{OWNER}' AND claim_type = 'ESTIMATE' ORDER BY event_date DESC NULLS LAST, candidate_id LIMIT 30) LEFT JOIN sd ON id = candidate_id""",
    "observation_search": f"""WITH {PO._T}, {PO._D}, {_ISSUES.split(', ', 1)[1]},
        sel AS (SELECT * FROM c WHERE (confidentiality_status IN ('PUBLIC', 'FREE', 'OPEN') OR source_code = 'SRC_SIPRERN') AND period_end >= DATE '2015-01-01' AND period_start <= DATE '2016-12-31'),
        pg AS (SELECT *, count(*) OVER () AS total FROM sel ORDER BY period_start, series_key, observation_revision_id LIMIT 40 OFFSET 40)
        SELECT observation_revision_id, pg.source_code, (SELECT nullif(count(DISTINCT response_id), 0) FROM source_response s WHERE s.source_code = pg.source_code) AS pages,
          coalesce((SELECT coalesce(code, '') || '=' || pg.numeric_value FROM unit_measure u WHERE u.unit_measure_id = pg.unit_measure_id), CASE WHEN numeric_value IS NULL THEN '' ELSE '=' || numeric_value END) AS measures,
          concat_ws('|', 'CONF=' || confidentiality_status, 'REASON=' || revision_reason, 'STATUS=' || pg.status) AS attributes,
          coalesce((SELECT string_agg(code || '=' || value, '|' ORDER BY position) FROM d WHERE d.series_id = pg.series_id), '') AS dimensions,
          (SELECT count(*) FROM a WHERE a.observation_revision_id = pg.observation_revision_id) AS assessments, (SELECT count(*) FROM a WHERE a.observation_revision_id = pg.observation_revision_id AND a.status = 'FAIL') AS failed,
          (SELECT count(*) FROM iss WHERE target_id = CAST(pg.observation_revision_id AS VARCHAR) AND iss.status NOT IN ('VERIFIED', 'CLOSED')) AS open_issues, total FROM pg""",
    "observation_cursor": f"""WITH {PO._T}, l AS (SELECT * FROM (SELECT period_start, series_key, observation_revision_id FROM c ORDER BY 1, 2, 3 LIMIT 50) ORDER BY 1 DESC, 2 DESC, 3 DESC LIMIT 1)
        SELECT 'full' AS page, rtrim(translate(to_base64(encode(CAST(to_json([CAST(period_start AS VARCHAR), series_key, CAST(observation_revision_id AS VARCHAR)]) AS VARCHAR))), '+/', '-_'), '=') AS next_cursor FROM l UNION ALL SELECT 'short', NULL""",
    "issue_listing": f"WITH {_ISSUES} SELECT target_id, rule, severity, count(*) OVER () AS total FROM iss WHERE status = 'OPEN' ORDER BY CAST(target_id AS BIGINT) DESC, rule LIMIT 100 OFFSET 100",
    "source_listing": """WITH s AS (SELECT source_code, count(DISTINCT response_id) AS pages FROM source_response GROUP BY 1), h AS (SELECT source_code, count(DISTINCT series_id) AS series FROM observation_revision GROUP BY 1)
        SELECT source_code, pages, series, count(*) OVER () AS total FROM s JOIN h USING (source_code) WHERE source_code ILIKE '%ma%' ORDER BY source_code LIMIT 10""",
    "organization_listing": "SELECT economic_entity_id, canonical_name, count(*) OVER () AS total FROM economic_entity WHERE entity_type <> 'PERSON' AND (canonical_name ILIKE '%banco%' OR short_name ILIKE '%banco%') ORDER BY canonical_name, economic_entity_id LIMIT 20 OFFSET 20",
    "response_by_id": "SELECT DISTINCT response_id, source_code, status, md5(text) AS md5 FROM source_response WHERE response_id = 7",
    "run_status": "SELECT r.response_id, source_code, r.status, count(candidate_id) AS claims FROM (SELECT DISTINCT response_id, source_code, status FROM source_response WHERE response_id = 7) r LEFT JOIN candidate c ON c.response_id = r.response_id GROUP BY 1, 2, 3",
    "issue_targets": f"""WITH {_ISSUES}, {_CLAIMS} SELECT DISTINCT target_type, target_id, source_code AS label FROM iss JOIN r ON target_id = CAST(observation_revision_id AS VARCHAR)
        UNION ALL SELECT 'FACT_CLAIM', CAST(candidate_id AS VARCHAR), claim_type FROM cl WHERE status = 'QUARANTINED' OR confidence_score IS NULL""",
    "lineage_touching": f"""WITH e AS ({PO.SQL['lineage_revised_from']}) SELECT DISTINCT to_id, from_id FROM e
        WHERE to_id IN (SELECT observation_revision_id FROM observation_revision WHERE source_code = 'SRC_SIPRERN') OR from_id IN (SELECT observation_revision_id FROM observation_revision WHERE source_code = 'SRC_SIPRERN')""",
    "conflicting_subjects": f"""WITH k AS (SELECT statistical_domain_id, time_horizon, CAST(date_trunc('month', event_date) AS DATE) AS event_date, {PC._HASH} AS hash, min(candidate_id) AS first_id, count(*) AS claims FROM candidate
          WHERE (statistical_domain_id IS NOT NULL OR time_horizon IS NOT NULL) AND event_date IS NOT NULL GROUP BY 1, 2, 3, 4)
        SELECT statistical_domain_id, time_horizon, event_date, primary_id, first_id AS contradicting_id, claims FROM (SELECT *, min(first_id) OVER (PARTITION BY statistical_domain_id, time_horizon, event_date) AS primary_id FROM k) WHERE first_id <> primary_id""",
    "series_filtered": f"""WITH {PO._T}, {PO._D}, g AS (SELECT min(value) AS v FROM d WHERE code = 'GEO') SELECT observation_revision_id, series_id FROM c WHERE status = 'PUBLISHED'
        AND series_id IN (SELECT series_id FROM d, g WHERE code = 'GEO' AND kind = 'geography' AND value = v) AND series_id IN (SELECT series_id FROM d WHERE code = 'FREQ' AND kind = 'code' AND value = 'M')""",
    "series_keys": "SELECT DISTINCT series_id, series_key FROM observation_revision",
    "local_date_issue": r"""SELECT candidate_id, CASE WHEN published_at IS NULL OR published_at = '' THEN 'MISSING_PUBLICATION_DATE' WHEN NOT regexp_matches(published_at, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$') THEN 'OUTSIDE_LOCAL_PUBLICATION_DATE'
        WHEN coalesce(CAST(timezone('America/La_Paz', TRY_CAST(published_at AS TIMESTAMPTZ)) AS DATE) = coalesce(event_date, DATE '2024-01-01'), false) THEN NULL ELSE 'OUTSIDE_LOCAL_PUBLICATION_DATE' END AS issue FROM candidate""",
    "bulk_update": "SELECT candidate_id, CASE WHEN u THEN 'LOW' ELSE confidence_level END AS confidence_level, CASE WHEN u THEN least(confidence_score, 0.25) ELSE confidence_score END AS confidence_score, u AS updated FROM (SELECT *, coalesce(confidence_score < 0.5 AND impact_level <> 'LOW', false) AS u FROM candidate)",
    "running_counters": f"""WITH {PO._R}, g AS (SELECT source_code, CAST(capture_date AS DATE) AS day, count(*) AS received, count(*) FILTER (status IN ('PUBLISHED', 'SUPERSEDED')) AS accepted FROM r WHERE capture_date IS NOT NULL GROUP BY 1, 2)
        SELECT *, CAST(sum(received) OVER w AS BIGINT) AS received_so_far, CAST(sum(accepted) OVER w AS BIGINT) AS accepted_so_far FROM g WINDOW w AS (PARTITION BY source_code ORDER BY day)""",
    "cited_responses": """SELECT record_type, count(*) AS cited, count(*) FILTER (response_id IN (SELECT response_id FROM source_response WHERE status = 200)) AS found, cited = found AS all_exist
        FROM (SELECT DISTINCT record_type, response_id FROM candidate WHERE response_id IS NOT NULL) GROUP BY 1""",
    "provenance_issues": """WITH r AS (SELECT response_id, min(source_code) AS s, max(status) AS http FROM source_response GROUP BY 1), x AS (SELECT candidate_id,
        CASE WHEN candidate.response_id IS NULL THEN 'NO_RESPONSE' WHEN http IS NULL THEN 'UNKNOWN_RESPONSE' WHEN http <> 200 THEN 'NOT_FETCHED' WHEN s IS NULL OR s NOT IN (SELECT source_code FROM observation_revision WHERE source_code IS NOT NULL) THEN 'UNKNOWN_SOURCE' END AS issue
        FROM candidate LEFT JOIN r ON r.response_id = candidate.response_id) SELECT * FROM x WHERE issue IS NOT NULL""",
    "dimension_references": f"""WITH {PO._D} SELECT series_id, code, value FROM d WHERE code = 'FREQ' AND value NOT IN ('M', 'Q') OR code = 'GEO' AND value NOT IN (SELECT geographic_unit_id FROM geographic_unit)
        OR code = 'IND' AND value NOT IN (SELECT code FROM statistical_domain WHERE code IS NOT NULL)""",
    "dimension_kinds": f"WITH {PO._D} SELECT code, kind, wanted, count(*) AS n FROM d JOIN (VALUES ('FREQ', 'code'), ('GEO', 'geography'), ('IND', 'domain')) AS k(code, wanted) USING (code) WHERE kind <> wanted GROUP BY 1, 2, 3",
    "series_compatibility": """SELECT series_key AS subject, 'SERIES' AS problem FROM observation_revision GROUP BY 1 HAVING count(DISTINCT series_id) > 1 UNION ALL SELECT series_id, 'KEY' FROM observation_revision GROUP BY 1 HAVING count(DISTINCT series_key) > 1
        UNION ALL SELECT series_id, 'UNIT' FROM observation_revision GROUP BY 1 HAVING count(DISTINCT unit_measure_id) > 1""",
    "merged_mentions": f"""WITH m AS (SELECT coalesce(claim_type, '') AS claim_type, coalesce(time_horizon, '') AS time_horizon, candidate_id, unnest(entity_mentions) AS name, generate_subscripts(entity_mentions, 1) AS pos FROM candidate WHERE entity_mentions IS NOT NULL),
        f AS (SELECT claim_type, time_horizon, {PC._at(_PLAIN, 'name')} AS form, min(row(candidate_id, pos, name)) AS f FROM m WHERE name IS NOT NULL AND {PC._at(_PLAIN, 'name')} <> '' GROUP BY 1, 2, 3),
        n AS (SELECT *, row_number() OVER (PARTITION BY claim_type, time_horizon ORDER BY f) AS nth, count(*) OVER (PARTITION BY claim_type, time_horizon) AS names FROM f)
        SELECT claim_type, time_horizon, max(names) AS names, string_agg(f[3], '|' ORDER BY nth) AS mentions FROM n WHERE nth <= 25 GROUP BY 1, 2""",
    "definition_lookup": "SELECT code AS unit, value_kind, count(*) AS n FROM (SELECT DISTINCT occurrence_id, unit_measure_id FROM numeric_occurrence) LEFT JOIN unit_measure USING (unit_measure_id) GROUP BY 1, 2",
    "top_conflicts": f"SELECT contradicting_id, claims FROM ({PC.SQL['conflicting_claims']}) ORDER BY claims DESC, contradicting_id LIMIT 25",
    "candidate_lists": "SELECT list, name, count(*) AS n FROM (SELECT 'publisher' AS list, publisher AS name FROM candidate UNION ALL SELECT 'mention', unnest(entity_mentions) FROM candidate) WHERE name IS NOT NULL GROUP BY 1, 2",
    "names_sorted": "SELECT candidate_id, string_agg(m, '|' ORDER BY m COLLATE es) AS names FROM (SELECT candidate_id, unnest(entity_mentions) AS m FROM candidate WHERE len(entity_mentions) > 1) WHERE m IS NOT NULL GROUP BY 1",
    "comparable_subjects": "SELECT candidate_id, event_date IS NOT NULL AND (statistical_domain_id IS NOT NULL OR response_id IS NOT NULL) AS comparable FROM candidate",
    "json_merge": """SELECT candidate_id, concat('{', concat_ws(',', CASE WHEN claim_type IS NOT NULL THEN '"claim_type":' || to_json(claim_type) END, CASE WHEN lang IS NOT NULL THEN '"lang":' || to_json(lang) END,
        CASE WHEN coalesce(confidence_level, impact_level) IS NOT NULL THEN '"level":' || to_json(coalesce(confidence_level, impact_level)) END, CASE WHEN time_horizon IS NOT NULL THEN '"time_horizon":' || to_json(time_horizon) END), '}') AS merged FROM candidate""",
    "canonical_json": "SELECT candidate_id, md5(CAST(json_object('id', candidate_id, 'kind', json_object('A', claim_type, 'b', lang), 'names', entity_mentions, 'title', title) AS VARCHAR)) AS md5 FROM candidate",
    "body_summaries": """SELECT candidate_id, CASE WHEN candidate_id % 3 = 0 THEN 'array' ELSE 'object' END AS type, CAST(CASE WHEN candidate_id % 3 = 0 THEN len(entity_mentions) ELSE (title IS NOT NULL)::INT + (assertion IS NOT NULL)::INT + (claim_type IS NOT NULL)::INT END AS INTEGER) AS count,
        CASE WHEN candidate_id % 3 <> 0 THEN concat_ws(',', CASE WHEN assertion IS NOT NULL THEN 'assertion' END, CASE WHEN claim_type IS NOT NULL THEN 'claim_type' END, CASE WHEN title IS NOT NULL THEN 'title' END) END AS fields FROM candidate WHERE entity_mentions IS NOT NULL""",
    "route_patterns": "SELECT CASE WHEN statistical_domain_id IS NULL THEN '/api/v1/claims/none/items/{id}' ELSE '/api/v1/claims/{id}/items/{id}' END AS route, count(*) AS n FROM candidate GROUP BY 1",
    "public_urls": r"""WITH u AS (SELECT candidate_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS s, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS h, regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1) AS p FROM candidate WHERE url IS NOT NULL),
        x AS (SELECT candidate_id, url AS u, s, h, NULL AS why FROM u UNION ALL SELECT candidate_id, s || '://me:pw@' || h || p, s, h, 'CREDENTIALS' FROM u UNION ALL SELECT candidate_id, s || '://' || h || ':8443' || p, s, h, 'PORT' FROM u
          UNION ALL SELECT candidate_id, s || '://' || h || ':443' || p, s, h, CASE WHEN s = 'https' THEN NULL ELSE 'PORT' END FROM u UNION ALL SELECT candidate_id, s || '://printer.local' || p, s, 'x.y', 'LOCAL' FROM u UNION ALL SELECT candidate_id, s || '://192.168.0.9' || p, s, 'x.y', 'PRIVATE' FROM u)
        SELECT candidate_id, md5(u) AS md5, CASE WHEN s NOT IN ('http', 'https') THEN 'PROTOCOL' ELSE why END AS reason FROM x""",
    "publication_window": r"""SELECT candidate_id, CASE WHEN published_at IS NULL OR published_at = '' THEN 'MISSING_PUBLICATION_DATE' WHEN NOT regexp_matches(published_at, '^\d{4}-\d{2}-\d{2}$') OR TRY_CAST(published_at AS DATE) IS NULL
        OR TRY_CAST(published_at AS DATE) < DATE '2022-01-01' OR TRY_CAST(published_at AS DATE) > DATE '2023-12-31' THEN 'OUTSIDE_PUBLICATION_WINDOW' ELSE 'INSIDE' END AS issue FROM candidate""",
    "calibration": """WITH x AS (SELECT candidate_id, coalesce(confidence_level, 'LOW') AS l, confidence_score AS s, claim_type, published_at, publisher, lower(concat_ws(' ', title, assertion)) AS hay, lower(entity_mentions[1]) AS needle FROM candidate),
        y AS (SELECT *, concat_ws(',', CASE WHEN claim_type IS DISTINCT FROM 'FACT' THEN 'UNSUPPORTED_WORDING' END, CASE WHEN published_at IS NULL THEN 'UNVERIFIED_PUBLICATION_DATE' END, CASE WHEN publisher IS NULL THEN 'UNVERIFIED_PUBLISHER' END,
          CASE WHEN needle IS NULL OR needle = '' OR (length(hay) - length(replace(hay, needle, ''))) // length(needle) <> 1 THEN 'EXCERPT_NOT_UNIQUE' END) AS reasons FROM x)
        SELECT candidate_id, CASE WHEN reasons = '' THEN l ELSE 'LOW' END AS level, CASE WHEN reasons = '' OR s IS NULL THEN s ELSE least(s, 0.49) END AS score, reasons <> '' AND (l <> 'LOW' OR coalesce(s > 0.49, false)) AS adjusted, reasons FROM y""",
    "review_queue": f"""WITH {_CLAIMS}, {_LINKS}, {_SIDES}, q AS (SELECT candidate_id, CASE WHEN n IS NOT NULL THEN 'CONTRADICTION' WHEN impact_level = 'CRITICAL' THEN 'CRITICAL_CLAIM' WHEN claim_type = 'AI_INFERENCE' THEN 'AI_INFERENCE'
          WHEN confidence_level IN ('LOW', 'VERY_LOW') THEN 'LOW_CONFIDENCE' ELSE 'MANUAL_REQUEST' END AS reason FROM cl LEFT JOIN sd ON id = candidate_id WHERE n IS NOT NULL OR status = 'PENDING_REVIEW')
        SELECT candidate_id, reason, CASE reason WHEN 'CRITICAL_CLAIM' THEN 'URGENT' WHEN 'CONTRADICTION' THEN 'HIGH' ELSE 'NORMAL' END AS priority FROM q""",
}
