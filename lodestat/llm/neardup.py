"""Near-duplicate records: banded MinHash candidates, sequential Bayesian verification, exact check."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.sources.tables import materialise

#: Words in a shingle.
WIDTH = 5
#: MinHash signature: bands of rows; a pair of similarity s is missed by all bands with (1 - s**ROWS)**BANDS, one of 0.65 in 1 case
#: of 12 000. Fewer rows a band would do with fewer bands, but then a phrase that many texts share makes bands of texts that share nothing else.
ROWS, BANDS = 4, 48
#: Signature positions compared at a time by the sequential test, and the bits kept of each.
BATCH, BITS = 24, 8
#: Probability of pruning a pair whose similarity reaches the threshold.
MISS = 1e-5

#: Characters and hashes that a Python worker works on at a time, about; a longer text is worked on alone.
MOST_CHARS, MOST_HASHES = 2_000_000, 250_000

#: Small letters and digits as they are, everything else a blank.
_PLAIN = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))
_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]")


class _WordHashes(dict):
    """64-bit hashes of words, computed once each; bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _WordHashes()


def _words(text: str) -> list[bytes]:
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", text))
    return text.encode("ascii", "replace").translate(_PLAIN).split()


def words(text: str) -> list[str]:
    """Lower-case, decompose, drop combining marks; the runs of a-z and 0-9."""
    return [w.decode() for w in _words(text)]


@lru_cache(maxsize=4)
def _odd(n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    kind = np.uint64 if bits == 64 else np.uint32
    return rng.integers(1, 2 ** (bits - 1), n, dtype=kind) * kind(2) + kind(1), rng.integers(0, 2 ** (bits - 1), n, dtype=kind)


def shingle_sets(texts: Sequence[str], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``width``-word sequences of each whole text; none of one with fewer words."""
    flat: list[bytes] = []
    ends = []
    for text in texts:
        flat += _words(text)
        ends.append(len(flat))
    lens = np.diff(np.array([0, *ends]))
    n = len(flat) - width + 1
    if n <= 0:
        return [np.zeros(0, dtype=np.uint64)] * len(texts)
    w = np.fromiter(map(_HASHES.__getitem__, flat), np.uint64, len(flat))
    h = np.zeros(n, dtype=np.uint64)
    for i, odd in enumerate(_odd(width, 64)[0]):
        h += w[i : n + i] * odd
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    owner = np.repeat(np.arange(len(texts)), lens)
    inside = owner[:n] == owner[width - 1 :]
    h, owner = h[inside], owner[:n][inside]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return np.split(h, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """``shingle_sets`` of one text."""
    return shingle_sets([text], width)[0]


def signatures(sets: Sequence[np.ndarray], n: int = ROWS * BANDS) -> np.ndarray:
    """MinHash signatures of non-empty sets: of each of ``n`` hash functions ``BITS`` bits of the element with the least value."""
    a, b = _odd(n, 32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), n), dtype=np.uint32)
    value = np.empty_like(x)
    for j in range(n):
        np.multiply(x, a[j], out=value)
        value += b[j]
        out[:, j] = np.minimum.reduceat(value, starts)
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint8)


@lru_cache(maxsize=16)
def keep_bounds(threshold: float, n: int, batch: int = BATCH, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """(positions compared, fewest matches that keep a pair) of each batch.

    A position of two sets agrees with the probability of their similarity, or by
    chance in the bits kept. The prior is uniform. A pair is pruned once the
    posterior probability of reaching the threshold is below ``miss``.
    """
    grid = (np.arange(4000) + 0.5) / 4000
    agree = grid + (1 - grid) / 2**BITS
    out = []
    for k in range(batch, n + 1, batch):
        for m in range(k + 1):
            log = m * np.log(agree) + (k - m) * np.log1p(-agree)
            weight = np.exp(log - log.max())
            if weight[grid >= threshold].sum() >= miss * weight.sum():
                out.append((k, m))
                break
    return tuple(out)


def survives(a: np.ndarray, b: np.ndarray, bounds: Sequence[tuple[int, int]]) -> np.ndarray:
    """Which pairs of signature rows pass all batches of the sequential test."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), dtype=np.int32), 0
    for upto, least in bounds:
        matches = matches + (a[alive, done:upto] == b[alive, done:upto]).sum(axis=1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], upto
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def _portions(texts: Sequence[str], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about ``most`` characters each."""
    lo = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= most or i + 1 == len(texts):
            yield lo, i + 1
            lo, held = i + 1, 0


def text_signatures(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(``id``, ``text_hash``, ``same``, ``sig``) of each row of (``id``, ``text_hash``, ``text``) with at least one shingle.

    ``same`` is equal for rows with equal shingle sets; ``sig`` is the packed signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, marks, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lo, hi in _portions(texts, MOST_CHARS):
                found = [(i, t, s) for i, t, s in zip(ids[lo:hi], marks[lo:hi], shingle_sets(texts[lo:hi], width)) if len(s)]
                for at, to in _portions([s for _, _, s in found], MOST_HASHES):
                    part = found[at:to]
                    sig = signatures([s for _, _, s in part]).tobytes()
                    step = len(sig) // len(part)
                    columns = ([i for i, _, _ in part], [t for _, t, _ in part], [xxhash.xxh3_128_digest(s.tobytes()) for _, _, s in part], [sig[k : k + step] for k in range(0, len(sig), step)])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["id", "text_hash", "same", "sig"])

    return texts.select("id", "text_hash", "text").mapInArrow(run, "id long, text_hash long, same binary, sig binary")


def banded(reps: DataFrame) -> DataFrame:
    """(``id``, ``band``): a key for each band of the packed signatures."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.substring(F.col("sig"), i * ROWS + 1, F.lit(ROWS)), i))
    return reps.select("id", F.explode(keys).alias("band"))


def candidate_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (``a`` < ``b``) of ids of (``id``, ``sig``) that pass the sequential test.

    Sets that agree in any band are candidates. The join on the band key lets AQE
    split hot bands; no pair is dropped by a cap. The sequential test prunes
    candidates by batches of their signatures.
    """
    n = ROWS * BANDS
    left, right = (banded(reps).select(F.col("id").alias(x), "band") for x in "ab")
    candidates = left.join(right, "band").where("a < b").select("a", "b").distinct()
    bounds = keep_bounds(threshold, n)

    def unpacked(column: pa.Array) -> np.ndarray:
        return np.frombuffer(column.buffers()[2], np.uint8, len(column) * n, n * column.offset).reshape(-1, n)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(survives(unpacked(b.column(2)), unpacked(b.column(3)), bounds))).select(["a", "b"])

    sig_a, sig_b = (reps.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    return candidates.join(sig_a, "a").join(sig_b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(prune, "a long, b long")


def verified_pairs(pairs: DataFrame, texts: DataFrame, threshold: float, width: int = WIDTH) -> DataFrame:
    """The pairs whose whole texts have a Jaccard similarity of at least ``threshold``, with ``similarity``.

    Only the texts of surviving pairs are moved; their sets are computed again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for lo, hi in _portions(y, MOST_CHARS):
                text = dict(zip(a[lo:hi], x[lo:hi])) | dict(zip(b[lo:hi], y[lo:hi]))
                sets = {i: frozenset(s.tolist()) for i, s in zip(text, shingle_sets(list(text.values()), width))}
                found = []
                for i, j in zip(a[lo:hi], b[lo:hi]):
                    p, q = sets[i], sets[j]
                    common = len(p & q)
                    if common >= threshold * (len(p) + len(q) - common):
                        found.append((i, j, common / (len(p) + len(q) - common)))
                columns = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    few = texts.join(wanted, "id", "left_semi").groupBy("id").agg(F.max(F.struct("text_hash", "text"))["text"].alias("text"))
    x, y = few.select(F.col("id").alias("a"), F.col("text").alias("text_a")), few.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, key: str, columns: Sequence[str], threshold: float) -> tuple[DataFrame, DataFrame]:
    """Membership (``id``, ``rep``) in classes of equal texts, and the similar pairs (``a``, ``b``, ``similarity``) of representatives.

    The text is the non-null ones of ``columns``, joined with a blank. Rows with a
    null key or fewer words than a shingle has are in no class. Of a repeated id
    the text with the greatest hash counts. Empty tables give empty results. Only ids, set hashes
    and packed signatures of all rows are written; texts are moved for pairs that
    survive the sequential test.
    """
    texts = docs.select(F.col(key).cast("long").alias("id"), F.concat_ws(" ", *columns).alias("text")).where("id IS NOT NULL").select("id", F.xxhash64("text").alias("text_hash"), "text")
    sets = materialise(text_signatures(texts))
    one = sets.groupBy("id").agg(F.max(F.struct("text_hash", "same"))["same"].alias("same"))
    members = materialise(one.join(one.groupBy("same").agg(F.min("id").alias("rep")), "same").select("id", "rep"))
    reps = sets.groupBy("id").agg(F.max(F.struct("text_hash", "sig"))["sig"].alias("sig")).join(members.where("id = rep").select("id"), "id", "left_semi")
    pairs = materialise(candidate_pairs(reps, threshold))
    return members, verified_pairs(pairs, texts, threshold)


def all_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every pair (``candidate_id_a`` < ``candidate_id_b``) of rows that the classes and their links stand for."""
    x, y = members.select(F.col("id").alias("p"), F.col("rep").alias("a")), members.select(F.col("id").alias("q"), F.col("rep").alias("b"))
    across = pairs.select("a", "b").join(x, "a").join(y, "b").select("p", "q")
    within = x.join(y, F.col("a") == F.col("b")).where("p < q").select("p", "q")
    return across.unionByName(within).select(F.least("p", "q").alias("candidate_id_a"), F.greatest("p", "q").alias("candidate_id_b"))


def class_links(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row of each id with its class, the copies in it and the other classes it is linked to."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    info = copies.join(ends, "rep", "left").select("rep", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(info, "rep").select(F.col("id").alias("candidate_id"), F.col("rep").alias("class_id"), "copies", "links")
