"""Queries of the text-corpus problems over whole tables, and their SQL where DuckDB can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm.encoding import restore_texts, restored_digest
from lodestat.llm.names import link_names, names_of
from lodestat.llm.neardup import all_pairs, class_links, near_duplicates
from lodestat.llm.packing import fill_containers
from lodestat.llm.reading import reading_bands
from lodestat.llm.tokens import encode_column
from lodestat.sources.tables import materialise, table

#: Shingle similarity of candidates that tell the same story.
SAME_STORY = 0.6


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return link_names(names_of(table(spark, d, "resolved_mention"), table(spark, d, "candidate")), table(spark, d, "economic_entity"))


def _stories(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(table(spark, d, "candidate"), "candidate_id", ["title", "assertion", "excerpt"], SAME_STORY)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return all_pairs(*_stories(spark, d))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return class_links(*_stories(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return restored_digest(restore_texts(table(spark, d, "source_response")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(table(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    counts = materialise(encode_column(table(spark, d, "documents"), "doc_id", "text", counts_only=True))
    return fill_containers(counts, table(spark, d, "token_container"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used of each kind and the share of their capacity that is filled."""
    capacity = table(spark, d, "token_container").select("container_kind", "capacity_tokens")
    used = p9_containers(spark, d).groupBy("container_kind").agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return used.join(capacity, "container_kind").select("container_kind", "containers", "tokens", F.round(F.col("tokens") / F.col("containers") / F.col("capacity_tokens"), 4).alias("filled"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_bands(table(spark, d, "documents"), table(spark, d, "reading_label"))[0].select("doc_id", "band")


QUERIES = {
    "p3_found": p3_found, "p4_found": p4_found, "p4_classes": p4_classes, "p5_found": p5_found, "p8_ids": p8_ids,
    "p9_containers": p9_containers, "p9_fill": p9_fill, "p10_found": p10_found,
}
_SHINGLES = """
    t AS (SELECT candidate_id AS id, string_split_regex(trim(regexp_replace(strip_accents(lower(concat_ws(' ', title, assertion, excerpt))), '[^a-z0-9]+', ' ', 'g')), ' +') AS w FROM candidate),
    s AS (SELECT DISTINCT id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
    n AS (SELECT id, count(*) AS n FROM s GROUP BY 1)"""

SQL = {
    "p4_found": f"""
        WITH {_SHINGLES},
        j AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2)
        SELECT a AS candidate_id_a, b AS candidate_id_b FROM j JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE c >= 0.6 * (p.n + q.n - c)""",
}
