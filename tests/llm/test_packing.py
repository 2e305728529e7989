import numpy as np
import pytest

from lodestat.llm.packing import difference, fill_containers, pack


def test_differencing_keeps_all_items_and_balances():
    rng = np.random.default_rng(1)
    for n, k in ((1, 3), (5, 2), (40, 7), (300, 20), (10, 10), (3, 8)):
        sizes = np.sort(rng.integers(1, 500, n))[::-1]
        window, sums = difference(sizes, k)
        assert len(window) == n and window.min() >= 0 and window.max() < k
        assert (np.bincount(window, weights=sizes, minlength=k) == sums).all()
        if n >= 5 * k:
            assert sums.max() - sums.min() <= sizes[0]


@pytest.mark.parametrize("sizes", [[], [5], [10, 10, 10], [10, 9, 8, 2, 1], [6, 6, 6, 6], [0, 0], [7, 3, 3, 3, 3, 1]])
def test_no_window_over_capacity(sizes):
    window = pack(np.array(sorted(sizes, reverse=True)), 10)
    assert len(window) == len(sizes) and all(window >= 0)
    assert all(s <= 10 for s in np.bincount(window, weights=sorted(sizes, reverse=True))) if sizes else True


def test_near_the_best_possible():
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.integers(1, 512, 400))[::-1]
    assert pack(sizes, 512).max() + 1 <= 1.06 * -(-sizes.sum() // 512)


def test_table(spark):
    counts = spark.createDataFrame([(1, 0), (2, 10), (3, 11), (4, 35), (5, 3), (5, 3), (6, 20)], "doc_id long, n_tokens long")
    kinds = spark.createDataFrame([("short", 10), ("long", 1000), ("none", 0)], "container_kind string, capacity_tokens int")
    rows = fill_containers(counts, kinds).collect()
    for kind, capacity in (("short", 10), ("long", 1000)):
        mine = [r for r in rows if r["container_kind"] == kind]
        held = {}
        for r in mine:
            held[r["container_id"]] = held.get(r["container_id"], 0) + r["n_tokens"]
        assert max(held.values()) <= capacity and sum(held.values()) == 82
        for doc, total in ((1, 0), (2, 10), (3, 11), (4, 35), (6, 20)):
            parts = [r["n_tokens"] for r in mine if r["doc_id"] == doc]
            assert sum(parts) == total and (len(parts) == 1 or total > capacity)
    assert not [r for r in rows if r["container_kind"] == "none"]
    assert fill_containers(counts.limit(0), kinds).count() == 0 and fill_containers(counts, kinds.limit(0)).count() == 0
