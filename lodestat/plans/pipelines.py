"""Queries of the ingestion and submission pipelines and of response bodies, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions import content as N
from lodestat.functions import html as H
from lodestat.functions import text as X
from lodestat.operators import observations as O
from lodestat.operators import registration as R
from lodestat.plans import claims as C
from lodestat.sources import sinks as S
from lodestat.sources.tables import table


def _records(spark: SparkSession, d: str) -> DataFrame:
    r = O.distinct_revisions(table(spark, d, "observation_revision"))
    return r.select(F.col("observation_revision_id").alias("index"), "series_key", "period_start", "period_end", F.col("numeric_value").alias("value"), F.col("unit_measure_id").alias("unit"), "vintage_date")


def registration_outcomes(spark, d):
    """All revisions as one batch: values below zero fail critically."""
    none = spark.createDataFrame([], "series_key string, period_start date, period_end date, hash string, revision_number int")
    return R.register(_records(spark, d), none, F.col("value").startswith("-")).select(F.col("index").alias("observation_revision_id"), "outcome", "error", "revision_number")


def registration_tally(spark, d):
    return registration_outcomes(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def claim_submission(spark, d):
    """All candidates as one submission; the excerpt is the payload, the domain the subject."""
    c = table(spark, d, "candidate")
    claims = c.select(
        F.col("candidate_id").alias("item"), X.comparable(F.coalesce("excerpt", F.lit(""))).alias("payload"), F.col("statistical_domain_id").alias("subject"), F.md5(X.comparable(F.coalesce("assertion", F.lit("")))).alias("hash"),
        "assertion", "excerpt", F.coalesce("claim_type", F.lit("")).alias("claim_type"), F.coalesce("confidence_level", F.lit("")).alias("confidence_level"), "impact_level",
    )
    return R.submit_claims(claims, spark.createDataFrame([], "payload_hash string")).select(F.col("item").alias("candidate_id"), "outcome")


def batch_replay(spark, d):
    """Artifacts as batch codes: asked with the least source, done with the greatest."""
    r = table(spark, d, "observation_revision").groupBy("source_artifact_id").agg(F.min("source_code").alias("a"), F.max("source_code").alias("b"), F.max("revision_reason").alias("c"))
    asked = r.select(F.col("source_artifact_id").alias("batch_code"), F.col("a").alias("fingerprint"))
    done = r.where("source_artifact_id < 'c'").select(F.col("source_artifact_id").alias("batch_code"), F.col("b").alias("fingerprint"), F.col("c").alias("result"))
    return R.replay(asked, done)


def publication_assessment(spark, d):
    """each candidate's date against its response's."""
    r = table(spark, d, "source_response").groupBy("response_id").agg(F.min("publication_dates").alias("dates"))
    rows = table(spark, d, "candidate").join(r, "response_id", "left")
    return rows.select("candidate_id", N.publication_assessment(F.col("published_at"), F.col("dates")).alias("assessment"))


def content_digests(spark, d):
    """the digest of the trimmed text as header of the text; none without an entity tag, a weak one means an encoded body."""
    r = table(spark, d, "source_response").where("text IS NOT NULL").select("response_id", "text", "etag").distinct()
    header = F.when(F.col("etag").isNotNull(), F.concat(F.lit("sha-256=:"), F.base64(F.unhex(F.sha2(F.trim("text"), 256))), F.lit(":")))
    return r.select("response_id", N.digest_status(header, F.col("text").cast("binary"), F.when(F.col("etag").startswith("W/"), "gzip")).alias("status"))


def stored_evidence(spark, d):
    """Documents stored as base64 with the hash of their text without blanks at its end, and the number of characters as size."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", N.stored_status(F.base64(F.col("text").cast("binary")), F.sha2(F.rtrim("text"), 256), F.col("n_chars")).alias("status"))


def decoded_bodies(spark, d):
    """F33 over the responses' texts as UTF-8 bytes with their declared types."""
    r = table(spark, d, "source_response").where("text IS NOT NULL").select("response_id", "declared_content_type", "text").distinct()
    return r.select("response_id", N.decoded(F.col("text").cast("binary"), "declared_content_type").alias("x")).select("response_id", "x.encoding", "x.selected_by", "x.replaced")


def sniffed_types(spark, d):
    r = table(spark, d, "source_response").where("text IS NOT NULL").select("response_id", "declared_content_type", "text").distinct()
    return r.select("response_id", N.sniffed(F.col("text").cast("binary"), "declared_content_type").alias("x")).select("response_id", "x.media_type", "x.status")


def html_metadata(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", H.html_metadata("text").alias("x"))
    return t.select("doc_id", *(F.array_join(f"x.{c}", "|").alias(c) for c in ("publishers", "publication_dates", "canonical_urls")))


def canonical_url(spark, d):
    """of each candidate's neighbours' URLs, the same without TLS, and its own with www and the usual port, the first acceptable one."""
    c = table(spark, d, "candidate").where("url IS NOT NULL").select("candidate_id", "url")
    near = c.select((F.col("candidate_id") - 1).alias("candidate_id"), F.col("url").alias("near"))
    u = F.col("url")
    own = F.regexp_replace(u, "^(https?)://([^/]*)", "$1://www.$2:443")
    rows = c.join(near, "candidate_id", "left").select("candidate_id", "url", F.array("near", F.regexp_replace(u, "^https", "http"), own).alias("candidates"))
    return rows.select("candidate_id", H.accepted_canonical(F.filter("candidates", lambda x: x.isNotNull()), F.col("url")).alias("canonical"))


def spanish_dates(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(N.spanish_dates(F.col("text"))).alias("pos", "day"))
    return t.select("doc_id", "pos", "day")


def read_model(spark, d):
    """The view of current values, aggregated."""
    S.current_values_view(O.intervals(table(spark, d, "observation_revision")))
    return spark.sql("SELECT source_code, count(*) AS n, count(DISTINCT series_id) AS series FROM current_observation_value GROUP BY source_code")


def snapshot_rows(spark, d):
    """One row with the hash of a whole table; applied to all revisions."""
    return S.snapshot(O.distinct_revisions(table(spark, d, "observation_revision")).drop("capture_date"))


_NAMES = "registration_outcomes registration_tally claim_submission batch_replay publication_assessment content_digests stored_evidence decoded_bodies sniffed_types html_metadata canonical_url spanish_dates read_model snapshot_rows".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_DIMS = "string_split(series_key, '|')"
_REG = f"""WITH r AS (SELECT DISTINCT * FROM observation_revision),
    e AS (SELECT *, CASE WHEN coalesce(series_key, '') = '' THEN 'NO_DIMENSIONS' WHEN len(list_filter({_DIMS}, lambda p: NOT regexp_matches(p, '^[A-Z_]+=[a-z]+:.+$'))) > 0 THEN 'BAD_DIMENSION'
        WHEN len(list_distinct(list_transform({_DIMS}, lambda p: split_part(p, '=', 1)))) < len({_DIMS}) THEN 'DUPLICATE_DIMENSION' WHEN period_start IS NULL OR period_end IS NULL OR vintage_date IS NULL THEN 'NO_DATE'
        WHEN period_end < period_start THEN 'PERIOD_ORDER' WHEN NOT coalesce(regexp_matches(numeric_value, '^-?(0|[1-9][0-9]*)([.][0-9]+)?$'), false) THEN 'BAD_VALUE' END AS error,
        concat_ws('|', numeric_value, coalesce(unit_measure_id, ''), CAST(vintage_date AS VARCHAR)) AS h FROM r),
    s AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'INVALID' WHEN starts_with(numeric_value, '-') THEN 'REJECTED' END AS o FROM e),
    g AS (SELECT *, CASE WHEN h IS NOT DISTINCT FROM lag(h) OVER (PARTITION BY series_key, period_start, period_end ORDER BY observation_revision_id) THEN 'UNCHANGED' ELSE 'PUBLISHED' END AS outcome FROM s WHERE o IS NULL),
    x AS (SELECT observation_revision_id, outcome, error, CAST(sum(CASE WHEN outcome = 'PUBLISHED' THEN 1 ELSE 0 END) OVER (PARTITION BY series_key, period_start, period_end ORDER BY observation_revision_id) AS INTEGER) AS revision_number FROM g
        UNION ALL SELECT observation_revision_id, o, error, NULL FROM s WHERE o IS NOT NULL)"""

_MOMENT = r"""CASE WHEN TRY_CAST(x[1:10] AS DATE) IS NOT NULL AND regexp_matches(x, '^\d{4}-\d{2}-\d{2}$') THEN {'day': CAST(x[1:10] AS DATE), 'at': NULL::BIGINT}
    WHEN TRY_CAST(x[1:10] AS DATE) IS NOT NULL AND regexp_matches(x, '^\d{4}-\d{2}-\d{2}T.+(Z|[+-]\d{2}:\d{2})$') AND TRY_CAST(x AS TIMESTAMPTZ) IS NOT NULL THEN {'day': CAST(x[1:10] AS DATE), 'at': epoch_us(TRY_CAST(x AS TIMESTAMPTZ))} END"""
_SAME_AB = "(CASE WHEN a.at IS NOT NULL AND b.at IS NOT NULL THEN a.at = b.at ELSE a.day = b.day END)"

SQL = {
    "registration_outcomes": f"{_REG} SELECT * FROM x",
    "registration_tally": f"{_REG} SELECT outcome, count(*) AS n FROM x GROUP BY 1",
    "batch_replay": """WITH r AS (SELECT source_artifact_id AS batch_code, min(source_code) AS a, max(source_code) AS b, max(revision_reason) AS c FROM observation_revision GROUP BY 1)
        SELECT batch_code, CASE WHEN NOT batch_code < 'c' THEN 'NEW' WHEN a <> b THEN 'CONFLICT' WHEN c IS NULL THEN 'IN_PROGRESS' ELSE 'REPLAY' END AS decision, CASE WHEN batch_code < 'c' AND a = b THEN c END AS result FROM r""",
    "content_digests": """SELECT response_id, CASE WHEN etag IS NULL THEN 'UNDECLARED' WHEN starts_with(etag, 'W/') THEN 'ENCODED_NOT_COMPARABLE' WHEN sha256(trim(text)) = sha256(text) THEN 'MATCHED' ELSE 'MISMATCHED' END AS status
        FROM (SELECT DISTINCT response_id, text, etag FROM source_response WHERE text IS NOT NULL)""",
    "stored_evidence": "SELECT doc_id, CASE WHEN octet_length(encode(text)) <> n_chars THEN 'SIZE' WHEN sha256(rtrim(text)) <> sha256(text) THEN 'HASH' ELSE 'OK' END AS status FROM documents WHERE text IS NOT NULL",
    "canonical_url": r"""WITH c AS (SELECT candidate_id, url, regexp_extract(url, '^(https?)://', 1) AS s, regexp_replace(regexp_extract(url, '^https?://([^/]*)', 1), '^www[.]', '') AS h FROM candidate WHERE url IS NOT NULL)
        SELECT c.candidate_id, CASE WHEN n.h = c.h AND (c.s = 'http' OR n.s = 'https') THEN n.url WHEN c.s = 'http' THEN c.url ELSE regexp_replace(c.url, '^(https?)://([^/]*)', '\1://www.\2:443') END AS canonical FROM c LEFT JOIN c n ON n.candidate_id = c.candidate_id + 1""",
    "spanish_dates": r"""WITH m AS (SELECT doc_id, regexp_extract_all(lower(text), '\d{1,2}\s+de\s+\p{L}+\s+(?:de\s+)?\d{4}') AS w FROM documents WHERE text IS NOT NULL),
        x AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM m), p AS (SELECT doc_id, i, regexp_extract(w, '^(\d+)', 1) AS d, replace(regexp_extract(w, 'de\s+(\p{L}+)', 1), 'setiembre', 'septiembre') AS mo, w[-4:] AS y FROM x),
        q AS (SELECT doc_id, i, try_cast(concat_ws('-', y, lpad(CAST(list_position(['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'], mo) AS VARCHAR), 2, '0'), lpad(d, 2, '0')) AS DATE) AS day,
          list_position(['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'], mo) AS k FROM p)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, day FROM q WHERE day IS NOT NULL AND k > 0""",
    "claim_submission": f"""WITH x AS (SELECT candidate_id, {C._at(C._COMP, "coalesce(excerpt, '')")} AS payload, statistical_domain_id AS subject, {C._at(C._COMP, "coalesce(assertion, '')")} AS hash, {C._ROUTE} AS route FROM candidate),
        w AS (SELECT *, CASE WHEN candidate_id <> min(candidate_id) OVER (PARTITION BY payload) THEN 'DUPLICATE' ELSE route END AS way FROM x),
        l AS (SELECT subject, min(candidate_id) AS lead_item, arg_min(hash, candidate_id) AS lead_hash FROM w WHERE way = 'PUBLISH' AND subject IS NOT NULL GROUP BY 1)
        SELECT candidate_id, CASE WHEN coalesce(way IN ('PUBLISH', 'REVIEW') AND lead_item < candidate_id AND lead_hash <> hash, false) THEN 'CONFLICT' ELSE way END AS outcome FROM w LEFT JOIN l USING (subject)""",
    "publication_assessment": f"""WITH r AS (SELECT response_id, min(publication_dates) AS dates FROM source_response GROUP BY 1),
        c AS (SELECT candidate_id, published_at AS mine, dates FROM candidate LEFT JOIN r USING (response_id)),
        t AS (SELECT candidate_id, trim(unnest(dates)) AS x FROM c), v AS (SELECT candidate_id, {_MOMENT} AS m FROM t),
        k AS (SELECT candidate_id, list(m) AS theirs FROM v WHERE m IS NOT NULL GROUP BY 1), o AS (SELECT candidate_id, {_MOMENT} AS mine FROM (SELECT candidate_id, trim(mine) AS x FROM c)),
        j AS (SELECT candidate_id, mine, coalesce(theirs, []) AS theirs FROM o LEFT JOIN k USING (candidate_id))
        SELECT candidate_id, CASE WHEN len(theirs) = 0 THEN 'UNAVAILABLE' WHEN mine IS NULL THEN 'CONTRADICTED' WHEN len(list_filter(theirs, lambda a: len(list_filter(theirs, lambda b: NOT {_SAME_AB})) > 0)) > 0 THEN 'AMBIGUOUS'
          WHEN len(list_filter(theirs, lambda b: {_SAME_AB.replace('a.', 'mine.')})) > 0 THEN 'MATCHED' ELSE 'CONTRADICTED' END AS assessment FROM j""",
    "snapshot_rows": """WITH r AS (SELECT DISTINCT * FROM observation_revision), h AS (SELECT sha256(CAST(json_object('confidentiality_status', confidentiality_status, 'numeric_value', numeric_value, 'observation_id', observation_id, 'observation_revision_id', observation_revision_id,
          'period_code', period_code, 'period_end', CAST(period_end AS VARCHAR), 'period_start', CAST(period_start AS VARCHAR), 'publication_date', CAST(publication_date AS VARCHAR), 'reference_date', CAST(reference_date AS VARCHAR), 'revision_number', revision_number, 'revision_reason', revision_reason,
          'series_id', series_id, 'series_key', series_key, 'source_artifact_id', source_artifact_id, 'source_code', source_code, 'status', status, 'unit_measure_id', unit_measure_id, 'vintage_date', CAST(vintage_date AS VARCHAR)) AS VARCHAR)) AS x FROM r)
        SELECT sha256(concat_ws('|', sum(CAST('0x' || x[1:15] AS UBIGINT)), sum(CAST('0x' || x[16:30] AS UBIGINT)), sum(CAST('0x' || x[31:45] AS UBIGINT)), count(*))) AS hash, count(*) AS n FROM h""",
    "read_model": """WITH r AS (SELECT DISTINCT * FROM observation_revision), t AS (SELECT *, lead(capture_date) OVER (PARTITION BY series_id, period_start, period_end ORDER BY capture_date, observation_revision_id) AS valid_to FROM r WHERE status IN ('PUBLISHED', 'SUPERSEDED') AND capture_date IS NOT NULL)
        SELECT source_code, count(*) AS n, count(DISTINCT series_id) AS series FROM t WHERE valid_to IS NULL AND status = 'PUBLISHED' GROUP BY 1""",
}
