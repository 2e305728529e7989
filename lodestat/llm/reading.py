"""Reading level of documents: gradient-boosted regression trees over length, vocabulary, syntax and cohesion."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.sources.tables import materialise

#: Labelled documents that the trees are fitted on at most, taken in the order of a hash of their id.
FIT_ROWS = 20_000
#: Documents with fewer code points get no band.
LEAST_CHARS = 300
FOLDS, TREES, DEPTH, RATE, BINS = 3, 80, 4, 0.12, 48

_SENTENCE = re.compile(r"(?<=[.!?;。])\s+|\n+")
_NO_WORD = re.compile(r"[\W\d_]+")
_UPPER = re.compile(r"(?<![^\W_])[A-ZÁÉÍÓÚÂÊÔÃÕÇÑ]")
_FAR = re.compile("[ɐ-\U0010ffff]")
_VOWELS = re.compile(r"[aeiouáéíóúàâãêôõü]+", re.I)

NAMES = (
    "sent_mean", "sent_p10", "sent_p25", "sent_p50", "sent_p75", "sent_p90", "sent_std",
    "word_mean", "word_p75", "word_p90", "word_std", "long7", "long10", "long13", "wsent_p25", "wsent_p50", "wsent_p75", "longsent_p50",
    "short3", "rttr", "repeat", "mean_unique_len", "syll",
    "comma", "paren", "digit", "upper", "quote", "question", "bullet", "percent", "colon", "markup", "nonlatin",
    "cohesion", "cohesion_p75", "log_chars", "log_sents",
)


def _quantiles(x: np.ndarray, *shares: float) -> list[float]:
    ordered = np.sort(x)
    return [float(ordered[int(q * (len(x) - 1) + 0.5)]) for q in shares]


def features(text: str) -> list[float]:
    """The numbers of a whole text that the trees read; all finite, whatever the text."""
    sentences = [s for s in _SENTENCE.split(text) if s and not s.isspace()]
    per = [w for w in (_NO_WORD.sub(" ", s).split() for s in sentences) if w]
    counts = np.array([len(w) for w in per] or [0], dtype=float)
    flat = np.fromiter((len(x) for w in per for x in w), dtype=float) if per else np.zeros(1)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(int)
    by_sentence = np.add.reduceat(flat, starts) / np.maximum(counts, 1)
    long_by = np.add.reduceat((flat >= 9).astype(float), starts) / np.maximum(counts, 1)
    n_words, n_chars = max(1.0, counts.sum()), max(1, len(text))
    unique = {x for w in per for x in w}
    content = {x for x in unique if len(x) > 4}
    sets = [content.intersection(w) for w in per]
    shared = np.array([len(a & b) / (min(len(a), len(b)) or 1) for a, b in zip(sets, sets[1:])] or [0.0])
    syllables = len(_VOWELS.findall(" ".join(unique))) / max(1, len(unique))
    count, n_sents = text.count, max(1, len(sentences))
    return [
        counts.mean(), *_quantiles(counts, 0.1, 0.25, 0.5, 0.75, 0.9), counts.std(),
        flat.mean(), *_quantiles(flat, 0.75, 0.9), flat.std(), (flat >= 7).mean(), (flat >= 10).mean(), (flat >= 13).mean(),
        *_quantiles(by_sentence, 0.25, 0.5, 0.75), *_quantiles(long_by, 0.5),
        (flat <= 3).mean(), len(unique) / n_words**0.5, 1 - len(set(sentences)) / n_sents, sum(map(len, unique)) / max(1, len(unique)), syllables,
        count(",") / n_words, count("(") / n_words, sum(map(count, "0123456789")) / n_chars, len(_UPPER.findall(text)) / n_words,
        (count('"') + count("“") + count("«")) / n_words, (count("?") + count("!")) / n_sents, (count("\n-") + count("\n*") + count("•")) / n_sents,
        count("%") / n_words, count(":") / n_words, (count("<") + count("|") + count("#")) / n_chars, 0.0 if text.isascii() else len(_FAR.findall(text)) / n_chars,
        shared.mean(), *_quantiles(shared, 0.75), float(np.log(n_chars)), float(np.log(n_sents)),
    ]


@dataclass
class Trees:
    """Boosted regression trees over binned features: ``edges`` by feature, trees as flat node arrays."""

    edges: list[np.ndarray]
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    depth: int
    rate: float
    cuts: tuple[float, float] = (1.5, 2.5)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += self.rate * value[node]
        return out

    def band(self, x: np.ndarray) -> np.ndarray:
        return 1 + np.searchsorted(self.cuts, self.predict(x), side="right")


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, least: int = 12) -> Trees:
    """Least-squares boosting with histogram splits; each leaf's value is shrunk towards 0."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    model = Trees(edges, float(y.mean()), [], depth, rate)
    b = model.binned(x).astype(np.int64)
    n, f = b.shape
    offset = b + np.arange(f) * bins
    current = np.full(n, model.base)
    size = 2 ** (depth + 1) - 1
    for _ in range(trees):
        rest = y - current
        feature, cut, value = np.zeros(size, dtype=np.int64), np.full(size, bins, dtype=np.int64), np.zeros(size)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (f * bins) + offset).ravel()
            total = np.bincount(at, minlength=width * f * bins).reshape(width, f, bins).cumsum(axis=2)
            sums = np.bincount(at, weights=np.repeat(rest, f), minlength=width * f * bins).reshape(width, f, bins).cumsum(axis=2)
            all_n, all_s = total[:, :1, -1:], sums[:, :1, -1:]
            right_n, right_s = all_n - total, all_s - sums
            gain = sums**2 / (total + 1) + right_s**2 / (right_n + 1) - all_s**2 / (all_n + 1)
            gain[(total < least) | (right_n < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            feature[first : first + width] = np.where(good, best // bins, 0)
            cut[first : first + width] = np.where(good, best % bins, bins)
            node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        hits = np.bincount(leaf, minlength=2**depth)
        value[2**depth - 1 :] = np.bincount(leaf, weights=rest, minlength=2**depth) / (hits + 1)
        model.trees.append((feature, cut, value))
        current += rate * value[node]
    return model


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The two cuts of the score that give the fewest wrong bands."""
    cuts = []
    for band in (1, 2):
        grid = np.unique(np.quantile(score, np.linspace(0.01, 0.99, 199)))
        grid = grid[(grid > band - 0.2) & (grid < band + 1.2)]
        wrong = [((score >= g) != (y > band)).sum() for g in grid]
        low = np.flatnonzero(np.array(wrong) == min(wrong)) if len(grid) else []
        cuts.append(float(grid[low].mean()) if len(low) else band + 0.5)
    return cuts[0], max(cuts[0], cuts[1])


def fit_by_source(x: np.ndarray, y: np.ndarray, source: np.ndarray) -> tuple[Trees, float]:
    """Trees on all rows, cut where the predictions for sources left out of the fit are best; and the accuracy there."""
    fold = np.array([hash_fold(s) for s in source])
    held = np.full(len(y), float(y.mean()))
    for k in range(FOLDS):
        if (fold != k).any() and (fold == k).any():
            held[fold == k] = fit_trees(x[fold != k], y[fold != k]).predict(x[fold == k])
    model = fit_trees(x, y)
    model.cuts = calibrate(held, y)
    return model, float((1 + np.searchsorted(model.cuts, held, side="right") == y).mean())


def hash_fold(source: str | None) -> int:
    import zlib

    return zlib.crc32((source or "").encode()) % FOLDS


def text_features(docs: DataFrame) -> DataFrame:
    """(``doc_id``, ``source``, ``f``) of each document of at least ``LEAST_CHARS`` code points, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, pa.list_(pa.float32()))], ["doc_id", "source", "f"])

    long = docs.where(F.length("text") >= LEAST_CHARS)
    return long.select(F.col("doc_id").cast("long"), "source", "text").mapInArrow(run, "doc_id long, source string, f array<float>")


def reading_bands(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, float]:
    """(``doc_id``, ``band``, ``score``) of each document of at least ``LEAST_CHARS`` code points, and the held-out accuracy.

    The trees are fitted on at most ``fit_rows`` labelled documents, taken by a hash
    of their id; documents whose readers disagree are left out of the fit. (With
    fewer than 30 others, the trees are fitted on the averages of all.) Predictions
    are calibrated on sources left out of the fit. Null and short texts get no row,
    a repeated document one. Without any label every band is 2.
    """
    table = materialise(text_features(docs))
    graded = labels.where(F.col("band").between(1, 3)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("band").alias("y"), (F.min("band") == F.max("band")).alias("sure"))
    graded = materialise(graded.withColumn("h", F.xxhash64("doc_id")))
    share = 1.2 * fit_rows / max(1, graded.count())  # only about as many rows as are wanted reach the ordering, whatever the number of partitions
    chosen = graded if share >= 1 else graded.where(F.pmod(F.col("h"), F.lit(1 << 30)) < int(share * (1 << 30)))
    fit = table.join(chosen, "doc_id").orderBy(F.pmod(F.col("h"), F.lit(1 << 30)), "doc_id").limit(fit_rows).select("source", "f", "y", "sure").toPandas()
    if len(fit):
        x, y, sure = np.array(fit["f"].tolist(), dtype=float), fit["y"].to_numpy(), fit["sure"].to_numpy(dtype=bool)
        model, accuracy = fit_by_source(x[sure], np.round(y[sure]), fit["source"].to_numpy()[sure]) if sure.sum() >= 30 else (fit_trees(x, y), float("nan"))
    else:
        model, accuracy = Trees([np.zeros(0)] * len(NAMES), 2.0, [], DEPTH, RATE), float("nan")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1).astype(float)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.band(x).astype(np.int32)), pa.array(model.predict(x))], ["doc_id", "band", "score"])

    bands = table.select("doc_id", "f").mapInArrow(run, "doc_id long, band int, score double")
    return bands.groupBy("doc_id").agg(F.max(F.struct("band", "score")).alias("v")).select("doc_id", "v.band", "v.score"), accuracy
