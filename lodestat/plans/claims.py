"""Text, claim, source and listing queries over candidates, responses and documents, with SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions import grounding as G
from lodestat.functions import text as X
from lodestat.functions import urls as U
from lodestat.operators import claims as C
from lodestat.operators import observations as O
from lodestat.sources.tables import materialise, table


#: Categories that each day should have.
REQUIRED_CATEGORIES = ("FX_OFFICIAL", "UFV", "SOVEREIGN_BONDS")


def cand(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidate")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL")


def _story():
    return F.concat_ws(" ", "title", "assertion", "excerpt")


def _hash():
    return C.content_hash(F.col("claim_type"), F.col("assertion"), F.col("event_date"), F.col("statistical_domain_id"))


def comparable_text(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.comparable(F.col("text"))).alias("md5"))


def content_tokens(spark, d):
    t = X.content_tokens(F.col("text"))
    return docs(spark, d).select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("md5"))


def shingle_counts(spark, d):
    return cand(spark, d).select("candidate_id", X.content_tokens(_story()).alias("t")).select("candidate_id", F.size(X.shingles(F.col("t"))).alias("n"))


def cluster_fingerprint(spark, d):
    return cand(spark, d).select("candidate_id", X.content_tokens(_story()).alias("t")).select("candidate_id", X.cluster_fingerprint(X.shingles(F.col("t"))).alias("fingerprint"))


def story_clusters(spark, d):
    f = cluster_fingerprint(spark, d).join(cand(spark, d).select("candidate_id", "event_date"), "candidate_id")
    return f.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("members"), F.min("candidate_id").alias("first_id"), F.min("event_date").alias("first_seen"), F.max("event_date").alias("last_seen"))


def story_similarity(spark, d):
    rows = cand(spark, d).where("assertion IS NOT NULL AND excerpt IS NOT NULL")
    rows = rows.select("candidate_id", X.content_tokens(F.concat_ws(" ", "title", "assertion")).alias("a"), X.content_tokens(F.concat_ws(" ", "assertion", "excerpt")).alias("b"))
    j = rows.select("candidate_id", X.shingles(F.col("a")).alias("a"), X.shingles(F.col("b")).alias("b")).select("candidate_id", X.jaccard(F.col("a"), F.col("b")).alias("j"))
    return j.select("candidate_id", F.round("j", 6).alias("similarity"), (F.col("j") >= 0.6).alias("same_story"))


def entity_normalised(spark, d):
    return table(spark, d, "economic_entity").select("economic_entity_id", X.entity_name(F.col("canonical_name")).alias("name"))


def mention_resolution(spark, d):
    e = table(spark, d, "economic_entity")
    aliases = e.select("economic_entity_id", F.col("canonical_name").alias("alias")).unionByName(e.select("economic_entity_id", F.col("short_name").alias("alias")))
    m = table(spark, d, "resolved_mention").select("mention_id", "mention_text").distinct()
    return C.resolve_mentions(m, aliases).select("mention_id", "entity", "how", "certainty")


def excerpt_location(spark, d):
    """where the first name of a claim stands in its own text, if it does."""
    rows = cand(spark, d).where("entity_mentions IS NOT NULL").select("candidate_id", F.concat_ws(" ", "title", "assertion", "excerpt").alias("source"), F.try_element_at("entity_mentions", F.lit(1)).alias("name"))
    loc = rows.select("candidate_id", X.excerpt_location(F.col("source"), F.col("name")).alias("l")).where("l IS NOT NULL")
    return loc.select("candidate_id", "l.start", "l.end", "l.length", "l.count", F.array_join(F.transform("l.starts", lambda x: x.cast("string")), ",").alias("starts"), "l.truncated")


def grounded_entities(spark, d):
    rows = cand(spark, d).where("entity_mentions IS NOT NULL")
    return rows.select("candidate_id", F.size(X.grounded(F.filter("entity_mentions", lambda m: m.isNotNull() & (m != "")), F.concat_ws(" ", "title", "assertion", "excerpt"))).alias("grounded"))


def injection_markers(spark, d):
    rows = docs(spark, d).select("doc_id", F.array_join(X.injection_markers(F.col("text")), "\n").alias("markers"))
    return rows.where("markers <> ''")


def semantic_negation(spark, d):
    return cand(spark, d).where("assertion IS NOT NULL").select("candidate_id", X.semantic_negation(F.col("assertion")).alias("negated"))


def visible_markup(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.visible_markup(F.col("text"))).alias("md5"))


def visible_text(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.visible_text(F.col("text"), F.lit("text/html"))).alias("md5"))


def lexical_terms(spark, d):
    t = X.lexical_terms(F.col("assertion"))
    return cand(spark, d).where("assertion IS NOT NULL").select("candidate_id", t.alias("t")).select("candidate_id", F.size("t").alias("n"), F.array_join(F.array_sort("t"), " ").alias("terms"))


def lexical_grounding(spark, d):
    return cand(spark, d).select("candidate_id", G.ground_wording("assertion", "excerpt").alias("g")).select("candidate_id", "g.status", "g.coverage", "g.matched")


def number_occurrences(spark, d):
    return cand(spark, d).select("candidate_id", F.explode(G.number_occurrences("excerpt")).alias("o")).select("candidate_id", "o.raw", "o.value", F.array_join("o.units", ",").alias("units"))


def ungrounded_numbers(spark, d):
    return cand(spark, d).select("candidate_id", F.explode(G.ungrounded_numbers("assertion", "excerpt")).alias("raw"))


def unsafe_url(spark, d):
    return cand(spark, d).select("candidate_id", F.coalesce(U.unsafe_reason(F.col("url")), F.lit("SAFE")).alias("reason"))


def evidence_key(spark, d):
    return cand(spark, d).where("url IS NOT NULL AND excerpt IS NOT NULL").select("candidate_id", F.md5(F.concat(U.tracking_free(F.concat("url", F.lit("?utm_source="), F.coalesce("lang", F.lit("")), F.lit("&t="), F.coalesce("claim_type", F.lit("")), F.lit("&c="), F.coalesce("lang", F.lit("")), F.lit("&gclid=1&b#top"))), F.lit("\n"), X.comparable(F.col("excerpt")))).alias("key"))


def body_length(spark, d):
    r = table(spark, d, "source_response").select("response_id", "declared_content_length", "text").distinct()
    return r.groupBy(U.body_length(F.col("declared_content_length"), F.col("text")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def charset_selection(spark, d):
    r = table(spark, d, "source_response").select("response_id", "http_declared_encoding", "html_meta_encoding").distinct()
    encoding, source = U.charset(F.col("http_declared_encoding"), F.col("html_meta_encoding"))
    return r.select("response_id", encoding.alias("encoding"), source.alias("selected_by"))


def claim_content_hash(spark, d):
    return cand(spark, d).select("candidate_id", _hash().alias("hash"))


def claim_dedup(spark, d):
    return C.first_of(cand(spark, d).select("candidate_id", F.md5(X.comparable(F.coalesce("excerpt", F.lit("")))).alias("hash")), "hash", "candidate_id").where("n > 1")


def conflicting_claims(spark, d):
    return C.conflicts(cand(spark, d).select("candidate_id", F.col("statistical_domain_id").alias("subject"), F.to_date(F.date_trunc("year", "event_date")).alias("event_date"), _hash().alias("hash")))


def corroboration_summary(spark, d):
    key = [F.col("claim_type"), X.comparable(F.col("assertion")).alias("assertion_key")]
    rows = cand(spark, d).where("assertion IS NOT NULL AND claim_type IS NOT NULL").select("candidate_id", *key, X.comparable(F.col("publisher")).alias("publisher"), "response_id", "excerpt")
    out = C.corroboration(rows, ["claim_type", "assertion_key"], F.col("publisher"), F.col("response_id") % 2 == 0, F.md5(F.coalesce("excerpt", F.lit(""))))
    return out.select("claim_type", F.md5("assertion_key").alias("assertion_md5"), "sources", "publishers", "verified_publishers", "unverified_sources", "contents", "independent")


def corroboration_consolidated(spark, d):
    return C.consolidated(cand(spark, d))


def consolidation_capped(spark, d):
    rows = cand(spark, d).select("candidate_id", F.coalesce("claim_type", F.lit("")).alias("key"), F.md5(X.comparable(F.coalesce("excerpt", F.lit("")))).alias("evidence"))
    return C.consolidation_cut(rows)


def confidence_calibration(spark, d):
    sound = F.col("publisher").isNotNull() & F.col("published_at").isNotNull()
    level, score, adjusted = C.calibrated(F.coalesce("confidence_level", F.lit("LOW")), F.col("confidence_score"), sound)
    return cand(spark, d).select("candidate_id", level.alias("level"), score.alias("score"), adjusted.alias("adjusted"))


def claim_routing(spark, d):
    return cand(spark, d).select("candidate_id", C.route(F.col("assertion"), F.col("excerpt"), F.coalesce("claim_type", F.lit("")), F.coalesce("confidence_level", F.lit("")), F.col("impact_level")).alias("route"))


def retry_decisions(spark, d):
    counts = table(spark, d, "source_response").groupBy("response_id").agg((F.count(F.lit(1)) - 1).cast("int").alias("attempts"))
    return counts.select("response_id", C.retry((F.col("response_id") % 8).cast("int") + F.col("attempts")).alias("r")).select("response_id", "r.attempt", "r.action", "r.delay_seconds")


def outcome_tally(spark, d):
    return claim_routing(spark, d).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def category_coverage(spark, d):
    """The required categories that no claim of a day covers."""
    days = cand(spark, d).where("event_date IS NOT NULL").groupBy("event_date").agg(F.collect_set("data_category").alias("have"))
    return days.select("event_date", F.array_join(F.array_except(F.array(*map(F.lit, REQUIRED_CATEGORIES)), "have"), ",").alias("missing")).where("missing <> ''")


def local_dates(spark, d):
    """The day of capture in two places, and whether it is the UTC day there."""
    r = O.distinct_revisions(table(spark, d, "observation_revision")).where("capture_date IS NOT NULL")
    there = F.to_date(F.from_utc_timestamp("capture_date", "America/La_Paz"))
    return r.select("observation_revision_id", there.alias("local_day"), (there == F.to_date("capture_date")).alias("same_day"))


def search_ilike(spark, d):
    rows = table(spark, d, "economic_entity").where(F.col("canonical_name").ilike("%banco%") | F.col("short_name").ilike("%b%"))
    return rows.orderBy("canonical_name", "economic_entity_id").limit(200).select("economic_entity_id", "canonical_name")


def optional_filter(spark, d, entity_type: str | None = "PUBLISHER", short: str | None = None):
    rows = table(spark, d, "economic_entity")
    for column, value in (("entity_type", entity_type), ("short_name", short)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows.select("economic_entity_id", "entity_type")


def claim_search(spark, d):
    """A page of claims with their source, their names and the number of different claims on their subject."""
    c = cand(spark, d).withColumn("hash", _hash())
    page = materialise(c.orderBy(F.col("event_date").desc_nulls_last(), "candidate_id").limit(100).select("candidate_id", "event_date", "statistical_domain_id", "response_id", "hash"))  # used four times
    source = table(spark, d, "source_response").select("response_id", "source_code").distinct()
    names = O.enriched(page, table(spark, d, "resolved_mention").select("candidate_id", "mention_text").distinct(), "candidate_id", ["mention_text"], "names").select("candidate_id", F.array_join(F.transform("names", lambda x: x["mention_text"]), "|").alias("names"))
    key = ["event_date", "statistical_domain_id"]
    others = c.join(page.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.count_distinct("hash").alias("n"))
    return page.join(source, "response_id", "left").join(names, "candidate_id").join(others, key, "left").select("candidate_id", "event_date", "source_code", "names", F.greatest(F.coalesce("n", F.lit(1)) - 1, F.lit(0)).alias("conflicts"))


def snapshot_hash(spark, d):
    u = table(spark, d, "unit_measure").select(F.concat_ws("|", "unit_measure_id", F.coalesce("base_unit_measure_id", F.lit("")), "code", "name", F.coalesce("symbol", F.lit("")), F.col("multiplier_power10").cast("string"), "value_kind").alias("row"))
    return u.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("row")), "\n"), 256).alias("hash"), F.count(F.lit(1)).alias("n"))


_NAMES = (
    "comparable_text content_tokens shingle_counts cluster_fingerprint story_clusters story_similarity entity_normalised mention_resolution excerpt_location grounded_entities injection_markers semantic_negation "
    "visible_markup visible_text lexical_terms lexical_grounding number_occurrences ungrounded_numbers unsafe_url evidence_key body_length charset_selection claim_content_hash claim_dedup conflicting_claims "
    "corroboration_summary corroboration_consolidated consolidation_capped confidence_calibration claim_routing retry_decisions outcome_tally category_coverage local_dates search_ilike optional_filter claim_search snapshot_hash"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

def _at(template: str, x: str) -> str:
    return template.replace("{0}", x)


_WS = r"[\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Characters that have a compatibility form, as far as texts of this kind hold them: signs, digits above and below, fractions, ligatures, wide letters, squared words.
_COMPAT = "".join(map(chr, (*range(0xA8, 0xBF), 0x2DC, *range(0x2000, 0x200B), *range(0x2024, 0x2027), *range(0x202F, 0x2038), 0x2057, 0x205F, *range(0x2070, 0x209D), *range(0x2100, 0x2126), *range(0x2150, 0x2180), *range(0x3000, 0x303B), *range(0x3131, 0x318F), *range(0x3200, 0x3400), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F))))
_FORMS = {c: f for c in _COMPAT if (f := unicodedata.normalize("NFKC", c)) != c}
_ONE = {c: f for c, f in _FORMS.items() if len(f) == 1 and f != "'"}


def _nfkc(x: str) -> str:
    """NFKC for the characters of ``_COMPAT``; DuckDB has the canonical composition alone."""
    out = f"translate({x}, '{''.join(_ONE)}', '{''.join(_ONE.values())}')"
    for c, f in _FORMS.items():
        if c not in _ONE and c in _LONG:
            out = f"replace({out}, '{c}', '{f}')"
    return f"nfc_normalize({out})"


#: Those of several characters that the tables hold.
_LONG = "¨½¼¾˜‥…″‴‶‷℀℅№™㈀㈠㈬㈮㈰㈱㈲㈳㈴㈵㈶㈷㈸㈹㈽㌀㌠㌬㌮㌰㌱㌲㌳㌴㌵㌶㌷㌸㌹ﬀﬁﬂﬃﬄ"
_COMP = "lower(trim(regexp_replace(" + _nfkc("{0}") + ", '" + _WS + "', ' ', 'g')))"
_FOLD = "lower(strip_accents({0}))"
_STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_TOK = f"list_filter(string_split(trim(regexp_replace({_FOLD}, '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND w NOT IN ({_STOPS}))"
_GROUNDING_STOPS = ", ".join(f"'{w}'" for w in X.GROUNDING_STOP_WORDS)
_COMP_KEEP = "trim(regexp_replace({0}, '" + _WS + "', ' ', 'g'))"
_VISIBLE = "regexp_replace(text, '(?s)<!--.*?-->', ' ', 'g')"
for _tag in ("script", "style", "template", "noscript"):
    _VISIBLE = f"regexp_replace({_VISIBLE}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', ' ', 'g')"
_VISIBLE = f"regexp_replace({_VISIBLE}, '(?s)<[^>]*>', ' ', 'g')"
for _entity, _sign in (("&(?:nbsp|#160);", " "), ("&(?:quot|#34);", '"'), ("&(?:amp|#38);", "&")):
    _VISIBLE = f"regexp_replace({_VISIBLE}, '(?i){_entity}', '{_sign}', 'g')"
_SH = "CASE WHEN len({0}) = 0 THEN [] WHEN len({0}) <= 5 THEN [array_to_string({0}, ' ')] ELSE list_distinct(list_transform(range(1, len({0}) - 3), lambda i: array_to_string({0}[i:i+4], ' '))) END"
_STORY = "concat_ws(' ', title, assertion, excerpt)"
_CS = f"WITH t AS (SELECT candidate_id, event_date, {_at(_TOK, _STORY)} AS t FROM candidate), s AS (SELECT candidate_id, event_date, {_at(_SH, 't')} AS s FROM t)"
_FP = "sha256(array_to_string(list_sort(s)[1:16], '|'))"
_HASH = f"sha256(CAST(json_object('assertion', lower({_at(_COMP_KEEP, 'assertion')}), 'claimType', claim_type, 'economicEntityId', NULL, 'eventDate', CAST(event_date AS VARCHAR), 'geographicUnitId', NULL, 'statisticalDomainId', statistical_domain_id) AS VARCHAR))"


def _units(x: str) -> str:
    """Length in UTF-16 units."""
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def _entity(x: str) -> str:
    out = f"trim(regexp_replace(regexp_replace({_at(_FOLD, x)}, '[^a-z0-9\\s.]', ' ', 'g'), '\\s+', ' ', 'g'))"
    for s in X.LEGAL_SUFFIXES:
        out = f"regexp_replace({out}, ' {s.replace('.', '[.]')}$', '')"
    return f"trim(regexp_replace(replace({out}, '.', ''), '\\s+', ' ', 'g'))"


_LEVELS = "['" + "', '".join(C.CONFIDENCE) + "']"
_IMPACTS = "['" + "', '".join(C.IMPACT) + "']"
_MARK = " OR ".join(f"regexp_matches(coalesce({{0}}, ''), '(?i){m}')" for m in X.INJECTION_MARKERS)
_ROUTE = f"""CASE WHEN {_at(_MARK, 'assertion')} OR {_at(_MARK, 'excerpt')} THEN 'QUARANTINE'
    WHEN coalesce(claim_type, '') NOT IN ('FACT', 'INDICATOR_READING') OR coalesce(confidence_level, '') IN ('VERY_LOW', 'LOW') OR coalesce(impact_level IN ('CRITICAL', 'HIGH'), false) THEN 'REVIEW' ELSE 'PUBLISH' END"""

SQL = {
    "comparable_text": f"SELECT doc_id, md5({_at(_COMP, 'text')}) AS md5 FROM documents WHERE text IS NOT NULL",
    "content_tokens": f"WITH t AS (SELECT doc_id, {_at(_TOK, 'text')} AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(t, ' ')) AS md5 FROM t",
    "shingle_counts": f"{_CS} SELECT candidate_id, CAST(len(s) AS INTEGER) AS n FROM s",
    "cluster_fingerprint": f"{_CS} SELECT candidate_id, {_FP} AS fingerprint FROM s",
    "story_clusters": f"{_CS} SELECT {_FP} AS fingerprint, count(*) AS members, min(candidate_id) AS first_id, min(event_date) AS first_seen, max(event_date) AS last_seen FROM s GROUP BY 1",
    "story_similarity": f"""WITH t AS (SELECT candidate_id, {_at(_TOK, "concat_ws(' ', title, assertion)")} AS x, {_at(_TOK, "concat_ws(' ', assertion, excerpt)")} AS y FROM candidate WHERE assertion IS NOT NULL AND excerpt IS NOT NULL),
        s AS (SELECT candidate_id, {_at(_SH, 'x')} AS a, {_at(_SH, 'y')} AS b FROM t), j AS (SELECT candidate_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS j FROM s)
        SELECT candidate_id, round(j, 6) AS similarity, j >= 0.6 AS same_story FROM j""",
    "entity_normalised": f"SELECT economic_entity_id, {_entity('canonical_name')} AS name FROM economic_entity",
    "mention_resolution": f"""WITH k AS (SELECT economic_entity_id, {_entity('alias')} AS a FROM (SELECT economic_entity_id, canonical_name AS alias FROM economic_entity UNION ALL SELECT economic_entity_id, short_name FROM economic_entity) WHERE alias IS NOT NULL),
        b AS (SELECT a, count(DISTINCT economic_entity_id) AS n, min(economic_entity_id) AS id FROM k WHERE a <> '' GROUP BY 1), m AS (SELECT DISTINCT mention_id, mention_text FROM resolved_mention)
        SELECT mention_id, coalesce(e.id, u.id) AS entity, CASE WHEN e.id IS NOT NULL THEN 'EXACT_ALIAS' WHEN u.id IS NOT NULL THEN 'NORMALIZED_ALIAS' ELSE 'UNRESOLVED' END AS how, CAST(CASE WHEN e.id IS NOT NULL THEN 1.0 WHEN u.id IS NOT NULL THEN 0.9 END AS DOUBLE) AS certainty
        FROM m LEFT JOIN b e ON e.a = m.mention_text LEFT JOIN b u ON u.a = {_entity('m.mention_text')} AND u.n = 1""",
    "excerpt_location": f"""WITH x AS (SELECT candidate_id, {_at(_COMP, "concat_ws(' ', title, assertion, excerpt)")} AS h, {_at(_COMP, 'entity_mentions[1]')} AS n FROM candidate WHERE entity_mentions IS NOT NULL),
        p AS (SELECT candidate_id, string_split(h, n) AS s, {_units('n')} AS w, {_units('h')} AS l FROM x WHERE length(n) > 0 AND instr(h, n) > 0),
        q AS (SELECT *, list_transform(range(1, len(s)), lambda i: CAST(list_sum(list_transform(s[1:i], lambda y: {_units('y')})) + (i - 1) * w AS BIGINT)) AS starts FROM p)
        SELECT candidate_id, CAST(starts[1] AS INTEGER) AS start, CAST(starts[1] + w AS INTEGER) AS "end", CAST(l AS INTEGER) AS length, CAST(len(starts) AS INTEGER) AS count, array_to_string(starts[1:20], ',') AS starts, len(starts) > 20 AS truncated FROM q""",
    "grounded_entities": f"""WITH x AS (SELECT candidate_id, ' ' || {_at(_COMP, "concat_ws(' ', title, assertion, excerpt)")} || ' ' AS h, list_filter(entity_mentions, lambda m: m IS NOT NULL AND m <> '') AS e FROM candidate WHERE entity_mentions IS NOT NULL),
        m AS (SELECT candidate_id, h, unnest(e) AS m FROM x), c AS (SELECT candidate_id, count(*) FILTER (regexp_matches(h, '[^\\p{{L}}\\p{{N}}]' || regexp_escape({_at(_COMP, 'm')}) || '[^\\p{{L}}\\p{{N}}]')) AS n FROM m GROUP BY 1)
        SELECT candidate_id, CAST(coalesce(n, 0) AS INTEGER) AS grounded FROM x LEFT JOIN c USING (candidate_id)""",
    "injection_markers": "SELECT doc_id, concat_ws(chr(10), " + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){m}') THEN '{m}' END" for m in X.INJECTION_MARKERS) + ") AS markers FROM documents WHERE text IS NOT NULL AND markers <> ''",
    "semantic_negation": f"""WITH x AS (SELECT candidate_id, {_at(_FOLD, 'assertion')} AS t FROM candidate WHERE assertion IS NOT NULL)
        SELECT candidate_id, regexp_matches(t, '\\b(nunca|jamas|never|without)\\b') OR regexp_matches(regexp_replace(t, '\\bno\\s+(obstante|solo|solamente)\\b', ' ', 'g'), '\\bno\\b')
          OR regexp_matches(regexp_replace(t, '\\bsin\\s+embargo\\b', ' ', 'g'), '\\bsin\\b') OR regexp_matches(regexp_replace(t, '\\bnot\\s+only\\b', ' ', 'g'), '\\bnot\\b') AS negated FROM x""",
    "lexical_terms": f"""WITH x AS (SELECT candidate_id, list_distinct(list_filter(regexp_extract_all({_at(_FOLD, _nfkc('assertion'))}, '\\p{{L}}[\\p{{L}}\\p{{N}}]*'), lambda w: length(w) >= 3 AND w NOT IN ({_GROUNDING_STOPS}))) AS t FROM candidate WHERE assertion IS NOT NULL)
        SELECT candidate_id, CAST(len(t) AS INTEGER) AS n, array_to_string(list_sort(t), ' ') AS terms FROM x""",
    "visible_markup": f"SELECT doc_id, md5({_at(_COMP_KEEP, _VISIBLE)}) AS md5 FROM documents WHERE text IS NOT NULL",
    "unsafe_url": r"""WITH x AS (SELECT candidate_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1)) AS h FROM candidate)
        SELECT candidate_id, CASE WHEN url IS NULL OR s = '' OR regexp_matches(url, '\s') THEN 'INVALID' WHEN s NOT IN ('http', 'https') THEN 'PROTOCOL' WHEN h = '' OR h IN ('localhost', 'localhost.localdomain', 'metadata.google.internal', 'instance-data') THEN 'LOOPBACK'
          WHEN regexp_matches(h, '^(10|127|0)\.\d+\.\d+\.\d+$|^192\.168\.\d+\.\d+$|^169\.254\.\d+\.\d+$') THEN 'PRIVATE' WHEN NOT contains(h, '.') THEN 'UNQUALIFIED' ELSE 'SAFE' END AS reason FROM x""",
    "evidence_key": f"""SELECT candidate_id, md5(concat(split_part(split_part(url, '#', 1), '?', 1), '?', array_to_string(list_sort(list_filter(string_split(split_part(CASE WHEN contains(url, '?') THEN substr(url, instr(url, '?') + 1) || '&' ELSE '' END
        || concat('t=', coalesce(claim_type, ''), '&c=', coalesce(lang, ''), '&b'), '#', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]+|fbclid|gclid)(=|$)'))), '&'), chr(10), {_at(_COMP, 'excerpt')})) AS key FROM candidate WHERE url IS NOT NULL AND excerpt IS NOT NULL""",
    "body_length": """WITH r AS (SELECT DISTINCT response_id, declared_content_length AS l, text FROM source_response)
        SELECT CASE WHEN l IS NULL OR text IS NULL THEN 'UNAVAILABLE' WHEN NOT regexp_matches(l, '^[0-9]+$') THEN 'INVALID' WHEN TRY_CAST(l AS BIGINT) = octet_length(encode(text)) THEN 'MATCHED' ELSE 'CONTRADICTED' END AS outcome, count(*) AS n FROM r GROUP BY 1""",
    "charset_selection": """WITH a AS (SELECT * FROM (VALUES ('utf-8', 'utf-8'), ('utf8', 'utf-8'), ('windows-1252', 'windows-1252'), ('cp1252', 'windows-1252'), ('iso-8859-1', 'windows-1252'), ('latin1', 'windows-1252'), ('utf-16', 'utf-16le'), ('utf-16le', 'utf-16le'), ('utf-16be', 'utf-16be')) AS t(n, e)),
        r AS (SELECT DISTINCT response_id, http_declared_encoding AS h, html_meta_encoding AS m FROM source_response)
        SELECT response_id, coalesce(x.e, y.e, 'utf-8') AS encoding, CASE WHEN x.e IS NOT NULL THEN 'HTTP_HEADER' WHEN y.e IS NOT NULL THEN 'HTML_META' WHEN h IS NOT NULL OR m IS NOT NULL THEN 'UNSUPPORTED_DECLARATION_FALLBACK' ELSE 'DEFAULT' END AS selected_by
        FROM r LEFT JOIN a x ON x.n = lower(trim(h)) LEFT JOIN a y ON y.n = lower(trim(m))""",
    "claim_content_hash": f"SELECT candidate_id, {_HASH} AS hash FROM candidate",
    "claim_dedup": f"SELECT md5({_at(_COMP, "coalesce(excerpt, '')")}) AS hash, min(candidate_id) AS first_key, count(*) AS n FROM candidate GROUP BY 1 HAVING count(*) > 1",
    "conflicting_claims": f"""WITH k AS (SELECT statistical_domain_id AS subject, CAST(date_trunc('year', event_date) AS DATE) AS event_date, {_HASH} AS hash, min(candidate_id) AS first_id, count(*) AS claims FROM candidate WHERE statistical_domain_id IS NOT NULL AND event_date IS NOT NULL GROUP BY 1, 2, 3)
        SELECT subject, event_date, primary_id, first_id AS contradicting_id, claims FROM (SELECT *, min(first_id) OVER (PARTITION BY subject, event_date) AS primary_id FROM k) WHERE first_id <> primary_id""",
    "corroboration_summary": f"""SELECT claim_type, md5(k) AS assertion_md5, count(*) AS sources, count(DISTINCT p) AS publishers, count(DISTINCT p) FILTER (v) AS verified_publishers, count(*) FILTER (NOT coalesce(v, false)) AS unverified_sources, count(DISTINCT c) AS contents,
          count(DISTINCT p) FILTER (v) > 1 AND count(DISTINCT c) > 1 AS independent
        FROM (SELECT claim_type, {_at(_COMP, 'assertion')} AS k, {_at(_COMP, 'publisher')} AS p, response_id % 2 = 0 AS v, coalesce(excerpt, '') AS c FROM candidate WHERE assertion IS NOT NULL AND claim_type IS NOT NULL) GROUP BY claim_type, k""",
    "corroboration_consolidated": f"""WITH x AS (SELECT candidate_id, coalesce(claim_type, '') AS t, {_at(_COMP, "coalesce(assertion, '')")} AS k, event_date AS d, coalesce(time_horizon, '') AS h, confidence_score AS s, published_at AS p,
          coalesce(list_position({_LEVELS}, confidence_level), 1) AS c, list_position({_IMPACTS}, impact_level) AS i, {_at(_COMP, "coalesce(excerpt, '')")} AS e FROM candidate)
        SELECT min(candidate_id) AS first_id, count(*) AS claims, count(DISTINCT e) AS evidence, {_LEVELS}[min(c)] AS confidence_level, {_IMPACTS}[max(i)] AS impact_level, CASE WHEN count(s) = count(*) THEN min(s) END AS score,
          CASE WHEN count(p) = count(*) AND count(DISTINCT p) = 1 THEN min(p) END AS published_at FROM x GROUP BY t, k, d, h""",
    "consolidation_capped": f"""WITH x AS (SELECT candidate_id, coalesce(claim_type, '') AS key, {_at(_COMP, "coalesce(excerpt, '')")} AS e FROM candidate), f AS (SELECT key, e, min(candidate_id) AS pos FROM x GROUP BY 1, 2),
        n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS nth FROM f), k AS (SELECT key, min(pos) AS first_id, max(pos) FILTER (nth = 10) AS full_at FROM n GROUP BY 1)
        SELECT candidate_id, CASE WHEN full_at IS NULL OR candidate_id <= full_at THEN first_id ELSE candidate_id END AS into_id FROM x JOIN k USING (key)""",
    "confidence_calibration": """SELECT candidate_id, CASE WHEN ok THEN l ELSE 'LOW' END AS level, CASE WHEN ok OR s IS NULL THEN s ELSE least(s, 0.49) END AS score, NOT ok AND (l <> 'LOW' OR coalesce(s > 0.49, false)) AS adjusted
        FROM (SELECT candidate_id, coalesce(confidence_level, 'LOW') AS l, confidence_score AS s, publisher IS NOT NULL AND published_at IS NOT NULL AS ok FROM candidate)""",
    "claim_routing": f"SELECT candidate_id, {_ROUTE} AS route FROM candidate",
    "outcome_tally": f"SELECT {_ROUTE} AS route, count(*) AS n FROM candidate GROUP BY 1",
    "retry_decisions": """SELECT response_id, CAST(a AS INTEGER) AS attempt, CASE WHEN a > 5 THEN 'DEAD_LETTER' ELSE 'RETRY' END AS action, CASE WHEN a <= 5 THEN CAST(least(30 * pow(2, a - 1), 3600) AS INTEGER) END AS delay_seconds
        FROM (SELECT response_id, response_id % 8 + count(*) AS a FROM source_response GROUP BY response_id)""",
    "category_coverage": """SELECT event_date, array_to_string(list_filter(['FX_OFFICIAL', 'UFV', 'SOVEREIGN_BONDS'], lambda x: NOT list_contains(have, x)), ',') AS missing
        FROM (SELECT event_date, coalesce(list(DISTINCT data_category) FILTER (data_category IS NOT NULL), []) AS have FROM candidate WHERE event_date IS NOT NULL GROUP BY 1) WHERE missing <> ''""",
    "local_dates": "SELECT DISTINCT observation_revision_id, CAST(timezone('America/La_Paz', capture_date) AS DATE) AS local_day, CAST(timezone('America/La_Paz', capture_date) AS DATE) = CAST(timezone('UTC', capture_date) AS DATE) AS same_day FROM observation_revision WHERE capture_date IS NOT NULL",
    "search_ilike": "SELECT economic_entity_id, canonical_name FROM economic_entity WHERE canonical_name ILIKE '%banco%' OR short_name ILIKE '%b%' ORDER BY canonical_name, economic_entity_id LIMIT 200",
    "optional_filter": "SELECT economic_entity_id, entity_type FROM economic_entity WHERE entity_type = 'PUBLISHER'",
    "claim_search": f"""WITH c AS (SELECT *, {_HASH} AS hash FROM candidate), p AS (SELECT * FROM c ORDER BY event_date DESC NULLS LAST, candidate_id LIMIT 100)
        SELECT p.candidate_id, p.event_date, s.source_code, coalesce((SELECT string_agg(mention_text, '|' ORDER BY mention_text) FROM (SELECT DISTINCT candidate_id, mention_text FROM resolved_mention) m WHERE m.candidate_id = p.candidate_id), '') AS names,
          greatest(coalesce(nullif((SELECT count(DISTINCT hash) FROM c WHERE c.event_date = p.event_date AND c.statistical_domain_id = p.statistical_domain_id), 0), 1) - 1, 0) AS conflicts
        FROM p LEFT JOIN (SELECT DISTINCT response_id, source_code FROM source_response) s ON s.response_id = p.response_id""",
    "snapshot_hash": """SELECT sha256(array_to_string(list_sort(list(concat_ws('|', unit_measure_id, coalesce(base_unit_measure_id, ''), code, name, coalesce(symbol, ''), CAST(multiplier_power10 AS VARCHAR), value_kind))), chr(10))) AS hash, count(*) AS n FROM unit_measure""",
}
