import random

from lodestat.llm.neardup import all_pairs, class_links, keep_bounds, near_duplicates, shingle_hashes, survives, words


def table(spark, rows):
    return spark.createDataFrame(rows, "candidate_id long, title string, assertion string, excerpt string, rep string")


def pairs(spark, rows, threshold=0.6):
    m, p = near_duplicates(table(spark, rows), "candidate_id", ["title", "assertion", "excerpt"], threshold)
    return {(r[0], r[1]) for r in all_pairs(m, p).collect()}


def brute(rows, threshold=0.6):
    sets = {r[0]: set(shingle_hashes(" ".join(v for v in r[1:4] if v is not None)).tolist()) for r in rows if r[0] is not None}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"w{rng.randrange(1000)}"
    return " ".join(w)


def test_against_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(f"b{rng.randrange(500)}" for _ in range(60)) for _ in range(12)]
    rows = [(i, edited(rng, base[i % 12], rng.choice([0, 0, 1, 8])), None, None, None) for i in range(90)]
    rows += [(200, "uno dos", "tres", "cuatro", None), (201, "uno dos", "tres", "cuatro", None), (202, None, None, None, None), (203, "Únó dos TRES", "cuatro", "cinco", "x"), (204, "uno-dos tres cuatro cinco", None, None, None), (None, base[0], None, None, None), (0, rows[0][1], None, None, None)]
    assert pairs(spark, rows) == brute(rows)


def test_hot_copies_and_empty_table(spark):
    rows = [(i, "a b c d e f g h", None, None, None) for i in range(60)] + [(99, "a b c d e f g h i", None, None, None)]
    m, p = near_duplicates(table(spark, rows), "candidate_id", ["title"], 0.6)
    assert p.count() == 1  # two classes, one link
    links = {r["candidate_id"]: (r["class_id"], r["copies"], r["links"]) for r in class_links(m, p).collect()}
    assert links[5] == (0, 60, 1) and links[99] == (99, 1, 1) and len(pairs(spark, rows)) == 61 * 60 // 2
    assert pairs(spark, []) == set()


def test_words_and_long_text(spark):
    assert words("Año 2024: ÑANDÚ—x") == ["ano", "2024", "nandu", "x"] and len(shingle_hashes("a b c d")) == 0
    long = " ".join(f"w{i}" for i in range(20_000))
    assert pairs(spark, [(1, long, None, None, None), (2, long + " end", None, None, None)]) == {(1, 2)}


def test_sequential_test_keeps_equal_signatures():
    import numpy as np

    a = np.arange(192).reshape(1, -1).astype(np.int32)
    b = a.copy()
    b[0, ::2] += 1000
    bounds = keep_bounds(0.6, 192)
    assert survives(a, a, bounds).all() and not survives(a, b + 5000, bounds).any() and [k for k, _ in bounds][-1] == 192
