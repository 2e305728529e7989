"""Queries of the training-data problems that belong to the core: as-of, units, instants, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.operators.asof import known_revisions
from lodestat.operators.hierarchy import descendants, forest, hierarchy, links, part_of, paths
from lodestat.operators.instants import normalise_source_times
from lodestat.operators.units import convert_quantities
from lodestat.sources.tables import materialise, table

_TREES = (("domain", "statistical_domain", "statistical_domain_id", "parent_domain_id"), ("geography", "geographic_unit", "geographic_unit_id", "parent_geographic_unit_id"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = known_revisions(table(spark, d, "vintage_request"), table(spark, d, "observation_revision"))
    return found.where("v_observation_revision_id IS NOT NULL").select("request_id", F.col("v_observation_revision_id").alias("observation_revision_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return convert_quantities(table(spark, d, "numeric_occurrence"), table(spark, d, "unit_measure"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return normalise_source_times(table(spark, d, "source_response"), table(spark, d, "candidate"))


def _forest(spark: SparkSession, d: str) -> DataFrame:
    return materialise(forest({name: links(table(spark, d, source), node, parent) for name, source, node, parent in _TREES}))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    name, node = part_of("node_id")
    return hierarchy(_forest(spark, d)).select(name.alias("hierarchy"), node.alias("node_id"), part_of("root_id")[1].alias("root_id"), "depth", "descendants")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    trees = _forest(spark, d)
    return paths(trees, materialise(hierarchy(trees)))


def p7_paths(spark: SparkSession, d: str) -> DataFrame:
    name, node = part_of("node_id")
    steps = F.transform("path", lambda x: F.regexp_replace(x, "^[^:]*:", ""))
    return _paths(spark, d).select(name.alias("hierarchy"), node.alias("node_id"), F.array_join(steps, "/").alias("path"))


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    name, below = part_of("descendant_id")
    return descendants(_paths(spark, d)).select(name.alias("hierarchy"), part_of("ancestor_id")[1].alias("ancestor_id"), below.alias("descendant_id"), "distance")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p6_found": p6_found, "p7_found": p7_found, "p7_paths": p7_paths, "p7_descendants": p7_descendants}

_UUID = """regexp_replace(regexp_replace(lower(trim({0})), '^urn:uuid:', ''), '[{{}}()-]', '', 'g')"""
_CANON = "CASE WHEN regexp_matches({h}, '^[0-9a-f]{{32}}$') THEN concat_ws('-', {h}[1:8], {h}[9:12], {h}[13:16], {h}[17:20], {h}[21:32]) ELSE nullif(trim({r}), '') END"


def _tree_sql(name: str, source: str, node: str, parent: str) -> str:
    nid = _CANON.format(h=_UUID.format(node), r=node)
    pid = _CANON.format(h=_UUID.format(parent), r=parent)
    return f"""
    {name}_n AS (SELECT {nid} AS id, min({pid}) AS ref FROM {source} GROUP BY 1),
    {name}_t AS (SELECT a.id, b.id AS parent FROM {name}_n a LEFT JOIN {name}_n b ON a.ref = b.id WHERE a.id IS NOT NULL),
    {name}_up AS (
        SELECT id, parent AS anc, 1 AS dist, id = parent AS looped FROM {name}_t WHERE parent IS NOT NULL
        UNION
        SELECT u.id, t.parent, u.dist + 1, u.id = t.parent FROM {name}_up u JOIN {name}_t t ON u.anc = t.id
        WHERE t.parent IS NOT NULL AND NOT u.looped AND u.dist < 400),
    {name}_loop AS (SELECT DISTINCT id FROM {name}_up WHERE looped),
    {name}_anc AS (SELECT id, anc, min(dist) AS dist FROM {name}_up GROUP BY 1, 2),
    {name}_r AS (
        SELECT t.id, max(a.dist) AS depth, max(CASE WHEN r.parent IS NULL THEN r.id END) AS root, bool_or(l.id IS NOT NULL) AS below
        FROM {name}_t t LEFT JOIN {name}_anc a ON t.id = a.id LEFT JOIN {name}_t r ON a.anc = r.id LEFT JOIN {name}_loop l ON a.anc = l.id GROUP BY 1),
    {name}_d AS (SELECT anc AS id, count(*) AS n FROM {name}_anc WHERE id <> anc GROUP BY 1)"""


_FOUND7 = """
    SELECT '{0}' AS hierarchy, r.id AS node_id,
        CASE WHEN l.id IS NOT NULL OR r.below THEN '' ELSE coalesce(r.root, r.id) END AS root_id,
        CAST(CASE WHEN l.id IS NOT NULL THEN -1 WHEN r.below THEN -2 ELSE coalesce(r.depth, 0) END AS INTEGER) AS depth,
        CAST(CASE WHEN l.id IS NOT NULL THEN -1 ELSE coalesce(d.n, 0) END AS INTEGER) AS descendants
    FROM {0}_r r LEFT JOIN {0}_loop l ON r.id = l.id LEFT JOIN {0}_d d ON r.id = d.id"""

_PATHS7 = """
    SELECT '{0}' AS hierarchy, r.id AS node_id, CASE WHEN l.id IS NOT NULL OR r.below THEN NULL ELSE coalesce(p.above || '/', '') || r.id END AS path
    FROM {0}_r r LEFT JOIN {0}_loop l ON r.id = l.id LEFT JOIN (SELECT id, string_agg(anc, '/' ORDER BY dist DESC) AS above FROM {0}_anc GROUP BY 1) p ON r.id = p.id"""

_BELOW7 = """
    SELECT '{0}' AS hierarchy, a.anc AS ancestor_id, a.id AS descendant_id, CAST(a.dist AS INTEGER) AS distance
    FROM {0}_anc a WHERE a.id NOT IN (SELECT id FROM {0}_loop) AND a.anc NOT IN (SELECT id FROM {0}_loop)"""

SQL = {
    "p1_found": """
        SELECT request_id, observation_revision_id FROM (
            SELECT r.request_id, v.observation_revision_id, row_number() OVER (
                PARTITION BY r.request_id ORDER BY v.vintage_date DESC, v.revision_number DESC, v.observation_revision_id DESC) AS rn
            FROM vintage_request r JOIN observation_revision v
              ON r.series_id = v.series_id AND r.period_start = v.period_start AND r.period_end = v.period_end
            WHERE v.status IN ('PUBLISHED', 'SUPERSEDED') AND v.vintage_date <= r.vintage_date
              AND (v.publication_date IS NULL OR v.publication_date <= r.vintage_date))
        WHERE rn = 1""",
    "p7_paths": "WITH RECURSIVE " + ",".join(_tree_sql(*t) for t in _TREES) + " UNION ALL ".join(_PATHS7.format(t[0]) for t in _TREES),
    "p7_descendants": "WITH RECURSIVE " + ",".join(_tree_sql(*t) for t in _TREES) + " UNION ALL ".join(_BELOW7.format(t[0]) for t in _TREES),
    "p7_found": "WITH RECURSIVE " + ",".join(_tree_sql(*t) for t in _TREES) + " UNION ALL ".join(_FOUND7.format(t[0]) for t in _TREES),
}
