"""Filling fixed-capacity containers by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Windows that a block is meant to fill; a block is packed in one task.
WINDOWS_PER_BLOCK = 192


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiway differencing of ``sizes`` into ``k`` windows: (window of each item, window sums).

    Each partial partition is a vector of k sums in descending order. The two with
    the greatest spread are merged, the fullest part of one with the emptiest of
    the other, until one is left.
    """
    n = len(sizes)
    if n == 0:
        return np.zeros(0, dtype=int), np.zeros(k, dtype=np.int64)
    child_a: list[np.ndarray] = []
    child_b: list[np.ndarray] = []
    heap: list[tuple[int, int]] = []
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i, s in enumerate(sizes.tolist()):  # a part's label is 0 for none, i + 1 for an item, else a merge
        heap.append((-s, i))
    heapq.heapify(heap)
    label = n + 1
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        (sa, la), (sb, lb) = _sparse(parts, a, sizes), _sparse(parts, b, sizes)
        both = len(sa) + len(sb) - k
        if both <= 0:  # parts are disjoint: nothing meets
            sums, labels = np.concatenate([sa, sb]), np.concatenate([la, lb])
        else:  # the last ``both`` of one meet the last of the other, in opposite order
            ka, kb = len(sa) - both, len(sb) - both
            ta, tb = slice(ka, None), slice(kb, None)
            met = sa[ta] + sb[tb][::-1]
            child_a.append(la[ta])
            child_b.append(lb[tb][::-1])
            fresh = np.arange(label, label + both)
            label += both
            sums, labels = np.concatenate([sa[:ka], sb[:kb], met]), np.concatenate([la[:ka], lb[:kb], fresh])
        order = np.argsort(-sums, kind="stable")
        sums, labels = sums[order], labels[order]
        spread = int(sums[0] - (sums[-1] if len(sums) == k else 0))
        new = n + len(parts)
        parts[new] = (sums, labels)
        heapq.heappush(heap, (-spread, new))
    sums, labels = _sparse(parts, heap[0][1], sizes)
    window = np.zeros(label, dtype=np.int64)
    window[labels] = np.arange(len(labels))
    if child_a:
        a, b = np.concatenate(child_a), np.concatenate(child_b)
        for m in range(label - 1, n, -1):
            window[a[m - n - 1]] = window[b[m - n - 1]] = window[m]
    full = np.zeros(k, dtype=np.int64)
    full[: len(sums)] = sums
    return window[1 : n + 1], full


def _sparse(parts: dict, i: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if i < len(sizes):
        return sizes[i : i + 1], np.array([i + 1])
    return parts[i] if i in parts else (sizes[:0], np.zeros(0, dtype=int))


def swap_over(own: np.ndarray, window: np.ndarray, sums: np.ndarray, capacity: int) -> None:
    """Bring windows under the capacity by swapping an item for a smaller one of a window with room; changes its arguments."""
    for w in np.argsort(-sums, kind="stable").tolist():
        while sums[w] > capacity:
            excess, best = int(sums[w] - capacity), None
            room = capacity - sums[window]
            for i in np.flatnonzero(window == w).tolist():
                gain = own[i] - own  # what the other window takes on
                fits = np.flatnonzero((gain >= excess) & (gain <= room) & (window != w))
                if len(fits):
                    j = int(fits[np.argmin(gain[fits])])
                    if best is None or gain[j] < best[0]:
                        best = (int(gain[j]), i, j)
            if best is None:
                break
            gain, i, j = best
            other = window[j]
            window[i], window[j] = other, w
            sums[w] -= gain
            sums[other] += gain


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item, with no window over ``capacity``; the number of windows rises until all fit.

    Differencing gives near-equal windows. One that exceeds the capacity swaps an
    item for a smaller one of a window with room. Where that can't be, the least
    item that makes up for the excess moves to the window that it fills best;
    items that fit nowhere are differenced again into further windows.
    ``sizes`` must be in descending order and none larger than the capacity.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    placed, todo, first = np.full(len(sizes), -1), np.arange(len(sizes)), 0
    room: list[int] = []
    while len(todo):
        own = sizes[todo]
        k = max(1, -(-int(own.sum()) // capacity), int((own * 2 > capacity).sum()))
        window, sums = difference(own, k)
        swap_over(own, window, sums, capacity)
        out = np.zeros(len(todo), dtype=bool)
        for w in np.flatnonzero(sums > capacity).tolist():
            held = np.flatnonzero(window == w)  # in descending order of size
            while sums[w] > capacity:  # the least item that makes up for the excess, else the greatest
                enough = held[own[held] >= sums[w] - capacity]
                i = enough[-1] if len(enough) else held[0]
                sums[w] -= own[i]
                out[i] = True
                held = held[held != i]
        placed[todo] = np.where(out, -1, window + first)
        room += (capacity - sums).tolist()
        first += k
        free = sorted((r, w) for w, r in enumerate(room))
        left = []
        for i in todo[out].tolist():
            at = bisect.bisect_left(free, (int(sizes[i]), -1))
            if at == len(free):
                left.append(i)
                continue
            r, w = free.pop(at)
            placed[i] = w
            room[w] = r - int(sizes[i])
            bisect.insort(free, (room[w], w))
        todo = np.array(left, dtype=int)
    return placed


def pieces(counts: DataFrame, containers: DataFrame) -> DataFrame:
    """(``container_kind``, ``capacity_tokens``, ``doc_id``, ``part``, ``n_tokens``): a text only in parts where it exceeds the capacity.

    A text longer than the capacity is cut into full containers and one rest.
    """
    kinds = containers.where("capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().limit(1001).collect()
    if len(kinds) > 1000:
        raise ValueError("token_container is meant to be a short list")
    each = F.array(*(F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("int").alias("capacity_tokens")) for k, c in kinds)).cast("array<struct<container_kind:string,capacity_tokens:int>>")
    both = counts.select("doc_id", "n_tokens", F.explode(each).alias("c")).select("doc_id", "n_tokens", "c.*")
    n, cap = F.col("n_tokens"), F.col("capacity_tokens").cast("long")
    last = F.when(n > 0, F.ceil(n / cap) - 1).otherwise(0).cast("int")
    cut = both.select("container_kind", "capacity_tokens", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    return cut.select("container_kind", "capacity_tokens", "doc_id", "part", F.least(n - F.col("part") * cap, cap).alias("n_tokens"))


def fill_containers(counts: DataFrame, containers: DataFrame, *, windows_per_block: int = WINDOWS_PER_BLOCK) -> DataFrame:
    """Put every document into containers of each kind: (``container_kind``, ``container_id``, ``doc_id``, ``part``, ``n_tokens``).

    ``counts`` has (``doc_id``, ``n_tokens``). Full parts are containers by
    themselves. The others are spread by hash over blocks of about
    ``windows_per_block`` containers, so a block's size depends neither on the
    table's nor on a source's; each block is packed by multiway differencing. A
    document without tokens is an item of size 0. The table of containers is
    small and fixed; an empty one gives no rows.
    """
    cut = pieces(counts, containers)
    full = cut.where(F.col("n_tokens") == F.col("capacity_tokens"))
    rest = cut.where(F.col("n_tokens") < F.col("capacity_tokens"))
    sums = rest.groupBy("container_kind").agg((F.ceil(F.sum("n_tokens") / F.first("capacity_tokens") / windows_per_block)).cast("long").alias("blocks"))
    mixed = F.xxhash64("doc_id", "part", "container_kind")
    blocked = rest.join(F.broadcast(sums), "container_kind").withColumn("block", F.pmod(mixed, F.greatest("blocks", F.lit(1))))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "part"], ascending=[False, True, True])
        window = pack(rows["n_tokens"].to_numpy(), int(rows["capacity_tokens"].iloc[0]))
        return pd.DataFrame({"container_kind": rows["container_kind"], "container_id": [f"w{key[1]}-{w}" for w in window], "doc_id": rows["doc_id"], "part": rows["part"], "n_tokens": rows["n_tokens"]})

    schema = "container_kind string, container_id string, doc_id long, part int, n_tokens long"
    packed = blocked.select("container_kind", "block", "capacity_tokens", "doc_id", "part", "n_tokens").groupBy("container_kind", "block").applyInPandas(run, schema)
    alone = full.select("container_kind", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("-"), F.col("part").cast("string")).alias("container_id"), "doc_id", "part", "n_tokens")
    return packed.unionByName(alone)
