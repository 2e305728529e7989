import numpy as np

from lodestat.llm import names as N
from lodestat.llm.names import Block, edits, link_names, names_of, sound, tokens, weighted

ENTITIES = [
    ("c1", "COMPANY", "Cooperativa de Ahorro Fiandano S.R.L.", None), ("c2", "COMPANY", "Banco Siltrorsa S.A.", "BS"), ("c3", "COMPANY", "Textiles Janhasmil", None), ("c4", "COMPANY", "Empresa Nacional de Hidrocarburos Janhasmil", None),
    ("c5", "COMPANY", "Compañía Minera Drullogon S.R.L.", None), ("c6", "COMPANY", "Banco Lamlén del Sur", None), ("c7", "COMPANY", "Banco Huermo", None), ("c8", "COMPANY", "Banco Tarlta", None), ("u1", "PUBLISHER", "Diario Mabesa Oriental S.R.L.", "DMO"),
    ("p1", "PERSON", "Victoria Mercedes Piayisgon Helchimste", None), ("p2", "PERSON", "Isabel Hurgesmil Muyergon", None), ("p3", "PERSON", "José Tiasjagon Jarelno", None), ("p4", "PERSON", "Rosario Tiasjagon Ñuenpialén", None),
    *((f"x{i}", "COMPANY", f"{t} {n}", None) for i, (t, n) in enumerate((t, n) for t in ("Textiles", "Compañía Minera", "Cooperativa de Ahorro", "Empresa Nacional de Hidrocarburos", "Diario") for n in ("Quelbem", "Zandro", "Porvil", "Drespo"))),
]
CASES = [
    ("Cooperativa de Ahorro Fiandano", "c1"), ("COOP. DE AHORRO FIADNANO srl", "c1"), ("Fiandano", "c1"), ("Cooperativa de AhorroFiandano", "c1"), ("Fiandano, Cooperativa de Ahorro", "c1"), ("cooperativa d ahorro fiandnao", "c1"),
    ("Bco. Siltrorsa", "c2"), ("b.s.", "c2"), ("BancoSiltrorsa", "c2"), ("Textiles Janhasmil", "c3"), ("Emp. Nal. de Hidrocarburos Janhasmil", "c4"), ("Janhasmil", None), ("Cía. Min. Drullogon", "c5"), ("Drullogon Mining Company", "c5"), ("Textiles Siltrorsa", None),
    ("CAF (Fiandano)", "c1"), ("DMO", "u1"), ("Vicky Piayisgon", "p1"), ("Piayisgon Helchimste, Victoria", "p1"), ("Piayisgon, V.", "p1"), ("Dr. Isbael Hurgesmil Muyergon", "p2"), ("Chabela Hirgesmil M.", "p2"), ("Hurgesmil, I.,", "p2"),
    ("José Tiasjagon", "p3"), ("Charo Tiasjagon", "p4"), ("Tiasjagon", None), ("Enrique Tiasjagon Nianchenra", None), ("exportadores", None), ("", None), (None, None), ("...", None), ("Banco", None), ("a" * 5000, None),
]


def entities(spark):
    return spark.createDataFrame(ENTITIES, "economic_entity_id string, entity_type string, canonical_name string, short_name string")


def test_links(spark, monkeypatch):
    rows = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(CASES)], "mention_id long, mention_text string")
    none = spark.createDataFrame([], "candidate_id long, entity_mentions array<string>, publisher string")
    for block in (N.BLOCK, 7):  # one block of forms, and several
        monkeypatch.setattr(N, "BLOCK", block)
        got = {r["record_id"]: r["economic_entity_id"] for r in link_names(names_of(rows, none), entities(spark)).collect()}
        assert {n: got.get(i) for i, (n, _) in enumerate(CASES)} == dict(CASES)


def test_top_n_join_equals_brute_force():
    rng = np.random.default_rng(3)
    names = ["".join(rng.choice(list("abcd"), 6)) + " " + "".join(rng.choice(list("abe"), 5)) for _ in range(300)]
    vectors = [weighted(n, {"abc": 3.0, " ab": 0.2}) for n in names]
    dense = [dict(zip(g, v)) for g, v in vectors]
    for least in (0.2, 0.5):
        want = {(i, j): sum(v * dense[j].get(g, 0) for g, v in dense[i].items()) for i in range(100) for j in range(100, 300)}
        got = {(int(i), int(j) + 100): c for part in Block(vectors[100:]).near(vectors[:100], 1000, least) for i, j, c in zip(*part)}
        assert got.keys() == {k for k, c in want.items() if c >= least} and all(abs(c - want[k]) < 1e-9 for k, c in got.items())
        few = [c for part in Block(vectors[100:]).near(vectors[:1], 5, 0.0) for c in part[2]]
        assert np.allclose(few, sorted((want[0, j] for j in range(100, 300)), reverse=True)[:5])


def test_pieces():
    assert tokens("Lic. Beto Pérez S.A.C.") == ["roberto", "perez"] and tokens("f.t.n.v.") == ["ftnv"]
    assert edits("fiadnano", "fiandano", 2) == 1 and edits("abc", "abcdef", 2) == 3 and edits("", "", 1) == 0 and sound("janqui") == sound("yanki".replace("y", "j"))


def test_table(spark):
    catalogue = entities(spark)
    mentions = spark.createDataFrame([(1, "Bco. Siltrorsa", "x"), (1, "Bco. Siltrorsa", "x"), (2, None, None), (3, "nadie", None)] + [(i, "Fiandano", None) for i in range(10, 60)], "mention_id long, mention_text string, economic_entity_id string")
    candidates = spark.createDataFrame([(7, ["Diario Mabesa Oriental", None, "Isabel Hurgesmil"], "DMO"), (8, None, None), (9, [], "")], "candidate_id long, entity_mentions array<string>, publisher string")
    got = {tuple(r) for r in link_names(names_of(mentions, candidates), catalogue).collect()}
    assert got == {("mention_text", 1, 0, "c2"), ("entity_mentions", 7, 0, "u1"), ("entity_mentions", 7, 2, "p2"), ("publisher", 7, 0, "u1"), *(("mention_text", i, 0, "c1") for i in range(10, 60))}
    assert link_names(names_of(mentions.limit(0), candidates.limit(0)), catalogue).count() == 0 and link_names(names_of(mentions, candidates), catalogue.limit(0)).count() == 0
