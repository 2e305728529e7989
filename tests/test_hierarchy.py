import random

from lodestat.operators.hierarchy import descendants, hierarchy, links, paths
from lodestat.sources.tables import materialise


def tree(spark, pairs):
    return materialise(links(spark.createDataFrame(pairs, "node string, parent string"), "node", "parent"))


def result(spark, pairs):
    return {r["node_id"]: (r["root_id"], r["depth"], r["descendants"]) for r in hierarchy(tree(spark, pairs)).collect()}


def brute(pairs):
    up = {}
    for n, p in pairs:
        up[n] = p if p is not None and p.strip() else up.get(n)
    up = {n: p if p in up else None for n, p in up.items()}
    chain = {}
    for n in up:
        seen, x = [], up[n]
        while x is not None and x not in seen:
            seen.append(x)
            x = up[x]
        chain[n] = (seen, x)
    loops = {n for n in up if n in chain[n][0]}
    below = {n: sum(n in chain[m][0] for m in up if m != n) for n in up}
    out = {}
    for n in up:
        if n in loops:
            out[n] = ("", -1, -1)
        elif loops & set(chain[n][0]):
            out[n] = ("", -2, below[n])
        else:
            out[n] = (chain[n][0][-1] if chain[n][0] else n, len(chain[n][0]), below[n])
    return out


def test_random_forests_with_loops(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        pairs = [(f"n{i}", rng.choice([None, "", "gone", *[f"n{rng.randrange(120)}"] * 9])) for i in range(120)]
        assert result(spark, pairs) == brute(pairs)


def test_long_chain_star_and_self_loop(spark):
    pairs = [(f"c{i:03}", f"c{i - 1:03}" if i else None) for i in range(90)] + [(f"s{i}", "c089") for i in range(50)] + [("me", "me"), ("kid", "me")]
    assert result(spark, pairs) == brute(pairs)


def test_written_forms_repeats_and_nulls(spark):
    a, b = "87f9ddf2-800a-465e-abc5-12ad96e78600", "bb8e025a-3f86-412f-b0a7-3704d8fbb461"
    pairs = [(a, None), (b, "{" + a.upper() + "}"), (b, f" {a} "), (b.upper(), a.replace("-", "")), (None, a)]
    assert result(spark, pairs) == {a: (a, 0, 1), b: (a, 1, 0)}


def test_empty_table(spark):
    assert result(spark, []) == {}


def test_paths_and_descendants(spark):
    t = tree(spark, [("r", None), ("a", "r"), ("b", "a"), ("x", "y"), ("y", "x")])
    p = paths(t, hierarchy(t))
    assert {r["node_id"]: r["path"] for r in p.collect()} == {"r": ["r"], "a": ["r", "a"], "b": ["r", "a", "b"], "x": None, "y": None}
    assert {tuple(r) for r in descendants(p).collect()} == {("r", "a", 1), ("r", "b", 2), ("a", "b", 1)}


def test_descendants_below_loops(spark):
    t = tree(spark, [("x", "y"), ("y", "x"), ("a", "x"), ("b", "a"), ("c", "b"), ("d", "a"), ("me", "me"), ("kid", "me"), ("r", None), ("s", "r")])
    nodes = materialise(hierarchy(t))
    p = paths(t, nodes)
    assert {r["node_id"] for r in p.where("path IS NOT NULL").collect()} == {"r", "s"}
    rows = {tuple(r) for r in descendants(p).collect()}
    assert rows == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1), ("r", "s", 1)}
    assert all(sum(a == r["node_id"] for a, _, _ in rows) == r["descendants"] for r in nodes.where("depth <> -1").collect())
