"""Extra columns whose names clash with an operator's own do no harm."""

from lodestat.llm.encoding import restore_texts
from lodestat.llm.neardup import near_duplicates
from lodestat.llm.packing import fill_containers


def test_encoding(spark):
    df = spark.createDataFrame([(1, "s", "producciÃ³n", "x", 1, "y")], "response_id long, source_code string, text string, kind string, key int, damage string")
    assert [tuple(r) for r in restore_texts(df).collect()] == [(1, "utf8", "producción")]


def test_neardup(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7, "s", 1), (2, "a b c d e f g", 7, "s", 1)], "candidate_id long, title string, id int, same string, a int")
    members, pairs = near_duplicates(df, "candidate_id", ["title"], 0.6)
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [(1, 2)] and members.count() == 2


def test_packing(spark):
    counts = spark.createDataFrame([(1, 5, "x", 3)], "doc_id long, n_tokens long, block string, part int")
    kinds = spark.createDataFrame([("k", 10, "z")], "container_kind string, capacity_tokens int, blocks string")
    assert [(r["doc_id"], r["part"], r["n_tokens"]) for r in fill_containers(counts, kinds).collect()] == [(1, 0, 5)]
