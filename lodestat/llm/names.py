"""Variant spellings of names: weighted character n-grams, distributed top-n cosine joins, average-linkage clusters.

Every entity has several written forms, each the seed of a cluster. Distinct
spellings are joined with the forms by cosine, in blocks of both sides; a spelling
close to its best form becomes a member of that form's cluster; the spelling then
means the owner of the cluster with enough average linkage to it, among those that
an exact comparison of words lets pass.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.sources.tables import bucket_count, materialise

#: Characters in a gram; nearest forms kept of each spelling; least cosine of a candidate; least cosine of a cluster's member; least average linkage of a link.
GRAM, TOP, COSINE, MEMBER, LINKAGE = 3, 16, 0.22, 0.6, 0.18
#: Forms in a block of the join, sums that a worker holds at a time.
BLOCK, CELLS = 20_000, 4_000_000

#: Titles before a person's name.
TITLES = frozenset("dr dra lic ing econ min sr sra srta don dona prof mg msc abog arq cnel gral ministro ministra licenciado licenciada doctor doctora ingeniero ingeniera economista mr mrs ms".split())
#: Nicknames and the given names they stand for.
NICKNAMES = {
    "charo": "rosario", "poncho": "alfonso", "bety": "beatriz", "betty": "beatriz", "meche": "mercedes", "lola": "dolores", "vicky": "victoria", "paco": "francisco",
    "pancho": "francisco", "chela": "graciela", "pepe": "jose", "chabela": "isabel", "chavela": "isabel", "quique": "enrique", "kike": "enrique", "memo": "guillermo",
    "lalo": "eduardo", "rafa": "rafael", "leo": "leonardo", "tere": "teresa", "beto": "roberto", "manolo": "manuel", "manu": "manuel", "nacho": "ignacio", "goyo": "gregorio",
}
#: Abbreviated and English words of organisation names.
EXPAND = {
    "cia": "compania", "co": "compania", "company": "compania", "bco": "banco", "bank": "banco", "adm": "administradora", "admin": "administradora", "fed": "federacion", "federation": "federacion",
    "coop": "cooperativa", "cooperative": "cooperativa", "emp": "empresa", "nal": "nacional", "nac": "nacional", "national": "nacional", "asoc": "asociacion", "association": "asociacion",
    "prod": "productores", "producers": "productores", "labs": "laboratorios", "lab": "laboratorios", "laboratories": "laboratorios", "univ": "universidad", "university": "universidad",
    "constr": "constructora", "soc": "sociedad", "society": "sociedad", "cam": "camara", "chamber": "camara", "com": "comercio", "commerce": "comercio", "inst": "instituto", "institute": "instituto",
    "transp": "transportes", "transport": "transportes", "ffcc": "ferrocarril", "railway": "ferrocarril", "insurance": "seguros", "seg": "seguros", "cem": "cementos", "cement": "cementos",
    "mining": "minera", "electric": "electrica", "elec": "electrica", "agr": "agricola", "agricultural": "agricola", "text": "textiles", "fin": "financiero", "noti": "noticias", "not": "noticias",
    "news": "noticias", "agency": "agencia", "ag": "agencia", "bol": "boletin", "rev": "revista", "sem": "semanario", "weekly": "semanario", "tv": "television", "econ": "economica", "studies": "estudios",
    "est": "estudios", "savings": "ahorro", "hidroc": "hidrocarburos", "hydrocarbons": "hidrocarburos", "funds": "fondos", "magazine": "revista", "journal": "diario", "daily": "diario",
}
#: Words that carry no meaning in a name.
EMPTY = frozenset("de del la el los las of the y and e d".split())

_LEGAL = re.compile(r"(?:[\s,]+(?:s\s*\.?\s*a\s*\.?\s*c\s*\.?|s\s*\.?\s*r\s*\.?\s*l\s*\.?|s\s*\.?\s*a\s*\.?|l\s*t\s*d\s*a\s*\.?|limitada|inc\.?|ltd\.?))+[\s.,;]*$")
_CAMEL = re.compile(r"(?<=[A-Za-záéíóúñü][a-záéíóúñü]{2})(?=[A-ZÁÉÍÓÚÑ])")
_WITH_CORE = re.compile(r"^\s*([^\W\d_][^\W\d_.]*(?:\.[^\W\d_]+)*\.?)\s*\(([^()]+)\)[\s.,]*$")
_DOTTED = re.compile(r"^(?:[a-z]\s*\.\s*){2,}[a-z]?\.?$")


def plain(text: str) -> str:
    """Lower case without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def tokens(name: str) -> list[str]:
    """Words of a name: accents, case, punctuation, legal form, titles, abbreviations and nicknames evened out.

    An initial stays one letter; an abbreviation with dots becomes one word.
    """
    text = plain(_CAMEL.sub(" ", name)).strip(" \t\"'«»“”()[]")
    if _DOTTED.match(text):
        return [re.sub(r"[^a-z]", "", text)]
    text = re.sub(r"\bff\s*\.?\s*cc\b\.?", "ferrocarril ", text)
    shorter = _LEGAL.sub("", text)
    words = re.findall(r"[^\W_]+", shorter or text)
    while len(words) > 1 and words[0] in TITLES and not (words[0] in ("min", "econ") and len(words) == 1):
        words = words[1:]
    out = []
    for i, w in enumerate(words):
        if w in EMPTY and not (w in "yed" and len(w) == 1 and f"{w}." in shorter):
            continue
        if w == "min" and out:
            w = "minera"
        out.append(NICKNAMES.get(w) or EXPAND.get(w) or w)
    return out or words


def grams(words: Iterable[str]) -> Counter:
    """Counts of the character n-grams of each word with its borders; the order of words does not matter."""
    return Counter(p[i : i + GRAM] for w in words for p in (f" {w} ",) for i in range(max(1, len(p) - GRAM + 1)))


@lru_cache(maxsize=1 << 17)
def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between two words; ``most`` + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    older: list[int] = []
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            now.append(best)
        if min(now) > most:
            return most + 1
        older, before = before, now
    return min(before[-1], most + 1)


@lru_cache(maxsize=1 << 16)
def sound(word: str) -> str:
    """Letters that sound alike written alike."""
    word = re.sub("qu(?=[ei])", "k", word)
    word = re.sub("c(?=[ei])|z", "s", word)
    return word.replace("c", "k").replace("v", "b").replace("ll", "y").replace("h", "")


def tolerance(word: str) -> int:
    """Edits that a word of this length may carry."""
    return 0 if len(word) < 3 else 1 if len(word) < 7 else 2


#: Between an acronym and the words behind it in brackets, in a spelling's key.
BEHIND = "("


def spelling(name: str, types: Sequence[str], common: frozenset[str]) -> str:
    """The key of a typed name: its words, evened out, with words that were run together parted; '' where none is left."""
    both = _WITH_CORE.match(name)
    if both:
        return " ".join([re.sub(r"[^a-z]", "", plain(both[1])), BEHIND, *tokens(both[2])])
    out = []
    for w in tokens(name):
        cut = next(((t, w.startswith(t)) for t in types if len(w) - len(t) > 2 and (w.startswith(t) or w.endswith(t))), None) if len(w) > 9 and w not in common else None
        out += [w] if cut is None else [cut[0], w[len(cut[0]) :]] if cut[1] else [w[: -len(cut[0])], cut[0]]
    return " ".join(out)


def agreement(words: list[str], own: list[str], common: list[bool], person: bool, shared: bool) -> float:
    """How well a name's words are the entity's: 0 if any of them has no counterpart, or the telling ones are missing.

    ``common`` marks the entity's words that many organisations share; ``shared``
    says that several have its telling words.
    """
    joined = "".join(words)
    if len(words) <= len(own) and len(joined) > 8:  # words run together
        d = edits(joined, "".join(own), 2)
        if d <= 2:
            return 2.0 - 0.1 * d
    free, score, exact, ignored = list(range(len(own))), 0.0, set(), 0
    for w in sorted(words, key=len, reverse=True):
        options = []
        for j in free:
            t = own[j]
            if len(w) == 1:
                if t[0] == w:
                    options.append((0.5, -j, j, False))
                continue
            most = tolerance(t)
            d = edits(w, t, most)
            if d > most > 0 and sound(w) == sound(t):
                d = most
            if d <= most and d < len(w) - 1:
                options.append((1 - 0.2 * d, -j, j, True))
            elif not person and common[j] and len(w) >= 3 and t.startswith(w):
                options.append((0.7, -j, j, True))
        if not options:
            if not person and len(w) <= 3 and any(edits(w, x, 1) <= 1 for x in ("de", "del")):
                ignored += 1
                continue
            return 0.0
        gain, _, j, full = max(options)
        free.remove(j)
        score += gain
        if full:
            exact.add(j)
    if person:
        given, last = set(range(len(own) - 2)), {len(own) - 2, len(own) - 1}
        named = set(range(len(own))) - set(free)
        if not exact & last or not (named & given or last <= exact) or len(own) - 2 not in named:  # a second surname alone is not how anybody is called
            return 0.0
    else:
        telling = {j for j in range(len(own)) if not common[j]}
        if not telling <= exact or len(words) < len(own) and len(exact) == len(telling) and shared:  # the telling words alone, which several organisations share
            return 0.0
    return score / max(1, len(words) - ignored) + 0.01 * score / len(own)


def fits(words: list[str], info: dict) -> float:
    """The exact comparison of a spelling with the entity behind a form; 0 if it can't be meant."""
    own, short = info["words"], [x for x in (info["short"], info["initials"]) if x]
    if BEHIND in words:  # an acronym with the telling words behind it
        core = words[2:]
        return 2.5 if words[0] in short and core and all(any(edits(w, t, tolerance(t)) <= tolerance(t) for t in own) for w in core) else 0.0
    if info["kind"] in ("short", "initials"):
        return (3.0 if info["kind"] == "short" else 2.9) if words == [info[info["kind"]]] else 0.0
    return agreement(words, own, info["common"], info["person"], info["shared"])


def described(entities: DataFrame) -> DataFrame:
    """(``entity``, ``person``, ``words``, ``short``) of each entity with an id and a name; a repeated one once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k == "PERSON", tokens(n), re.sub(r"[^a-z0-9]", "", plain(s)) if s else "") for i, k, n, s in zip(*(b.column(c).to_pylist() for c in range(4)))]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.list_(pa.string()), pa.string()))], ["entity", "person", "words", "short"])

    named = entities.where("economic_entity_id IS NOT NULL AND canonical_name IS NOT NULL")
    one = named.groupBy(F.col("economic_entity_id").cast("string").alias("id")).agg(F.min(F.struct("entity_type", "canonical_name", "short_name")).alias("v"))
    return one.select("id", "v.entity_type", "v.canonical_name", "v.short_name").mapInArrow(run, "entity string, person boolean, words array<string>, short string").where(F.size("words") > 0)


def common_words(known: DataFrame) -> frozenset[str]:
    """Words that at least four organisations of the catalogue share: a vocabulary, like that of a language."""
    rows = known.where("NOT person").select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 4").collect()
    return frozenset(r["word"] for r in rows)


def entity_forms(known: DataFrame, common: frozenset[str]) -> DataFrame:
    """(``form``, ``written``, ``info``): the forms each entity may be written in, with what the exact comparison needs.

    The full name; an organisation's telling words, short name, initials, and these
    with the telling words behind; a person's surnames and given name with surname.
    """
    core = F.array_join(F.filter("words", lambda w: ~w.isin(*sorted(common))) if common else F.col("words"), " ")
    telling = known.withColumn("core", F.when(F.col("person"), F.array_join("words", " ")).otherwise(core))
    shared = telling.where("NOT person").groupBy("core").agg((F.count(F.lit(1)) > 1).alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rows = []
            for entity, person, words, short, core, several in zip(*(b.column(c).to_pylist() for c in range(6))):
                initials = "".join(w[0] for w in words) if not person and len(words) > 1 else ""
                info = {"entity": entity, "person": person, "words": words, "common": [not person and w in common for w in words], "shared": bool(several), "short": short, "initials": initials}
                forms = {"full": [" ".join(words)], "core": [core] if core else [], "short": [short] if short else [], "initials": [initials] if initials else []}
                forms["behind"] = [f"{a} {BEHIND} {core}" for a in {short, initials} if a and core]
                if person and len(words) > 2:
                    forms["parts"] = [" ".join(words[-2:]), f"{words[0]} {words[-2]}"]
                for kind, written in forms.items():
                    for text in sorted(set(written)):
                        rows.append((xxhash.xxh3_64_intdigest(f"{entity}\x00{kind}\x00{text}") - 2**63, text, json.dumps({**info, "kind": kind})))
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))], ["form", "written", "info"])

    return telling.join(shared, "core", "left").select("entity", "person", "words", "short", "core", "shared").mapInArrow(run, "form long, written string, info string")


def weighted(key: str, weight: dict[str, float]) -> tuple[list[str], np.ndarray]:
    """The unit vector of a spelling: its grams and their weights."""
    bag = grams(w for w in key.split(" ") if w != BEHIND)
    values = np.array([n * weight.get(g, 1.0) for g, n in bag.items()])
    return list(bag), values / (np.sqrt((values**2).sum()) or 1.0)


class Block:
    """Vectors of a block of forms as postings by gram; answers which forms are near a spelling."""

    def __init__(self, vectors: Sequence[tuple[Sequence[str], np.ndarray]]) -> None:
        self.size, self.gram = len(vectors), {}
        at = [self.gram.setdefault(g, len(self.gram)) for names, _ in vectors for g in names]
        owner = np.repeat(np.arange(len(vectors)), [len(n) for n, _ in vectors])
        value = np.concatenate([v for _, v in vectors]) if vectors else np.zeros(0)
        gram = np.array(at, dtype=np.int64)
        order = np.lexsort((owner, gram))
        self.owner, self.value = owner[order], value[order]
        self.start = np.searchsorted(gram[order], np.arange(len(self.gram) + 1))
        self.length = np.diff(self.start)
        self.code = gram[order] * max(1, self.size) + self.owner

    def near(self, vectors: Sequence[tuple[Sequence[str], np.ndarray]], top: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(spelling, form, cosine) of the ``top`` forms of each spelling with a cosine of at least ``least``.

        The grams with the longest postings are left out of the search as long as
        their part of the spelling's vector is shorter than ``least``: a form that
        shares nothing else can't reach it. They are added for the forms found.
        """
        step = max(1, CELLS // max(1, self.size))
        for lo in range(0, len(vectors), step):
            part = vectors[lo : lo + step]
            who = np.repeat(np.arange(len(part)), [len(n) for n, _ in part])
            gram = np.array([self.gram.get(g, -1) for names, _ in part for g in names], dtype=np.int64)
            value = np.concatenate([v for _, v in part])
            seen = gram >= 0
            who, gram, value = who[seen], gram[seen], value[seen]
            order = np.lexsort((-self.length[gram], who))
            who, gram, value = who[order], gram[order], value[order]
            square = np.cumsum(value**2)
            first = np.searchsorted(who, np.arange(len(part)))
            before = np.concatenate([[0.0], square])[first]
            left = square - before[who] < least**2 * 0.999
            norm = np.sqrt(np.bincount(who[left], weights=value[left] ** 2, minlength=len(part)))
            total = self._sums(who[~left], gram[~left], value[~left], len(part))
            row, form = np.nonzero(total >= np.maximum(least - norm, 1e-9)[:, None])
            cosine = total[row, form]
            skipped = np.bincount(who[left], minlength=len(part))
            start = np.searchsorted(who[left], np.arange(len(part)))
            many = skipped[row]
            pair = np.repeat(np.arange(len(row)), many)
            at = start[row][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
            code = gram[left][at] * max(1, self.size) + form[pair]
            hit = np.minimum(np.searchsorted(self.code, code), max(0, len(self.code) - 1))
            same = self.code[hit] == code if len(self.code) else np.zeros(0, dtype=bool)
            cosine += np.bincount(pair[same], weights=value[left][at][same] * self.value[hit[same]], minlength=len(row))
            good = cosine >= least
            row, form, cosine = row[good], form[good], cosine[good]
            order = np.lexsort((form, -cosine, row))
            row, form, cosine = row[order], form[order], cosine[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            yield row[place < top] + lo, form[place < top], cosine[place < top]

    def _sums(self, who: np.ndarray, gram: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        many = self.length[gram]
        at = np.repeat(self.start[gram] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        cell = np.repeat(who, many) * self.size + self.owner[at]
        return np.bincount(cell, weights=np.repeat(value, many) * self.value[at], minlength=rows * self.size).reshape(rows, self.size)


def _tasks(rows: DataFrame, blocks: int, parts: int):
    """Rows grouped by pair of blocks, in as many partitions: a pair costs time by its length squared, not by its bytes."""
    return rows.repartition(blocks * parts, "part", "block").groupBy("part", "block")


_NEAR = "key string, form long, cosine double"


def near_forms(keys: DataFrame, forms: DataFrame, weight: dict[str, float], blocks: int, parts: int) -> DataFrame:
    """(``key``, ``form``, ``cosine``): the ``TOP`` nearest forms of each key, of all forms with a cosine of at least ``COSINE``.

    Both sides are cut into blocks; each pair of blocks is one task's work, and the
    best of all blocks are merged.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        spelt, form = left.column("key").to_pylist(), right.column("form").to_numpy()
        found = [[], [], []]
        if spelt and len(form):
            block = Block([weighted(w, weight) for w in right.column("written").to_pylist()])
            for k, f, c in block.near([weighted(k, weight) for k in spelt], TOP, COSINE):
                found[0] += [spelt[i] for i in k.tolist()]
                found[1].append(form[f])
                found[2].append(c)
        columns = [pa.array(found[0], pa.string()), *(pa.array(np.concatenate(x) if x else [], t) for x, t in zip(found[1:], (pa.int64(), pa.float64())))]
        return pa.Table.from_arrays(columns, ["key", "form", "cosine"])

    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = keys.select("key", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), every(blocks, "block"))
    right = forms.select("form", "written", F.pmod(F.xxhash64("form"), F.lit(blocks)).cast("int").alias("block"), every(parts, "part"))
    found = _tasks(left, blocks, parts).cogroup(_tasks(right, blocks, parts)).applyInArrow(run, _NEAR)
    if blocks == 1:
        return found
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "form"))), 1, TOP)
    return found.groupBy("key").agg(best.alias("b")).select("key", F.explode("b").alias("b")).select("key", "b.form", (-F.col("b.far")).alias("cosine"))


def clusters(near: DataFrame, forms: DataFrame, weight: dict[str, float]) -> DataFrame:
    """(``form``, ``grams``, ``sums``, ``members``): each form's cluster as the sum of its members' vectors.

    Its members are the form and the spellings nearest to it of all forms, with a
    cosine of at least ``MEMBER``. Vectors have length 1, so the average linkage of
    a spelling to a cluster is its product with the sum over the number of members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for form, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                names, values = weighted(key, weight)
                total[form, ""] += 1.0
                for g, v in zip(names, values.tolist()):
                    total[form, g] += v
            if len(total) > 500_000:
                yield _summed(total)
                total = Counter()
        yield _summed(total)

    best = near.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("far"), "form")).alias("b"))
    members = best.where(F.col("b.far") <= -MEMBER).select(F.col("b.form").alias("form"), "key").unionByName(forms.select("form", F.col("written").alias("key")))
    sums = members.mapInArrow(run, "form long, gram string, value double").groupBy("form", "gram").agg(F.sum("value").alias("value"))
    of = sums.groupBy("form").agg(F.collect_list(F.when(F.col("gram") != "", F.struct("gram", F.col("value").cast("float").alias("value")))).alias("v"), F.max(F.when(F.col("gram") == "", F.col("value"))).alias("members"))
    return of.select("form", F.col("v.gram").alias("grams"), F.col("v.value").alias("sums"), "members")


def _summed(total: Counter) -> pa.RecordBatch:
    forms, names = zip(*total) if total else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(forms, pa.int64()), pa.array(names, pa.string()), pa.array(list(total.values()), pa.float64())], ["form", "gram", "value"])


_MEANT = "key string, entity string, linkage double, score double"


def linked(near: DataFrame, forms: DataFrame, grown: DataFrame, weight: dict[str, float], blocks: int, parts: int) -> DataFrame:
    """(``key``, ``entity``, ``linkage``, ``score``) of the clusters near a key with enough average linkage that pass the exact comparison."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        form = right.column("form").to_pylist()
        at, out = {f: i for i, f in enumerate(form)}, []
        gram: dict[str, int] = {}
        lists = [[gram.setdefault(g, len(gram)) for g in names] for names in right.column("grams").to_pylist()]
        sums, members, info = right.column("sums").to_pylist(), right.column("members").to_pylist(), [json.loads(i) for i in right.column("info").to_pylist()]
        held = max(1, 4 * CELLS // max(1, len(gram)))
        pairs: dict[int, list[tuple[str, list[int]]]] = {}
        for key, near_ones in zip(left.column("key").to_pylist(), left.column("near").to_pylist()):
            of: dict[int, list[int]] = {}
            for f in near_ones:
                if f in at:
                    of.setdefault(at[f] // held, []).append(at[f])
            for lot, which in of.items():
                pairs.setdefault(lot, []).append((key, which))
        for lot in sorted(pairs):
            lo = lot * held
            dense = np.zeros((min(held, len(form) - lo), len(gram)), dtype=np.float32)
            for i in range(len(dense)):
                dense[i, lists[lo + i]] = np.array(sums[lo + i], dtype=np.float32) / members[lo + i]
            for key, which in pairs[lot]:
                names, values = weighted(key, weight)
                known = [(gram[g], v) for g, v in zip(names, values.tolist()) if g in gram]
                linkage = dense[np.array(which)[:, None] - lo, [g for g, _ in known]] @ np.array([v for _, v in known])
                words, scores = key.split(" "), {}
                for f, link in zip(which, linkage.tolist()):
                    if link >= LINKAGE:
                        who = (info[f]["entity"], info[f]["kind"] if info[f]["kind"] in ("short", "initials") else "")
                        if who not in scores:
                            scores[who] = (fits(words, info[f]), link)
                        scores[who] = (scores[who][0], max(link, scores[who][1]))
                out += [(key, e, link, score) for (e, _), (score, link) in scores.items() if score > 0]
        columns = list(zip(*out)) or [()] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.float64()))], ["key", "entity", "linkage", "score"])

    block = F.pmod(F.xxhash64("form"), F.lit(blocks)).cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    left = near.select("key", "form", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), block)
    left = left.groupBy("part", "block", "key").agg(F.collect_list("form").alias("near"))
    right = forms.join(grown, "form").select("form", "info", "grams", "sums", "members", block, every)
    return _tasks(left, blocks, parts).cogroup(_tasks(right, blocks, parts)).applyInArrow(run, _MEANT)


def names_of(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Long form (``field``, ``record_id``, ``pos``, ``name``) of all typed names, each delivered row once."""
    m = mentions.select(F.lit("mention_text").alias("field"), F.col("mention_id").cast("long").alias("record_id"), F.lit(0).alias("pos"), F.col("mention_text").alias("name"))
    lists = candidates.select(F.lit("entity_mentions").alias("field"), F.col("candidate_id").cast("long").alias("record_id"), F.posexplode("entity_mentions").alias("pos", "name"))
    p = candidates.select(F.lit("publisher").alias("field"), F.col("candidate_id").cast("long").alias("record_id"), F.lit(0).alias("pos"), F.col("publisher").alias("name"))
    return m.unionByName(lists).unionByName(p).where("name IS NOT NULL AND record_id IS NOT NULL").distinct()


def gram_weights(keys: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each character n-gram over all distinct spellings; the grams of an alphabet bound its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        n = 0
        for b in batches:
            for key in b.column(0).to_pylist():
                n += 1
                total.update(g for g in grams(key.split(" ")) if g.isascii())
        yield pa.RecordBatch.from_arrays([pa.array([*total, ""]), pa.array([*total.values(), n], pa.int64())], ["gram", "n"])

    counts = {r["gram"]: r["n"] for r in keys.select("key").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    everything = counts.pop("", 0)
    return {g: float(np.log(1 + everything / n)) for g, n in counts.items() if n}


def spelt(names: DataFrame, common: frozenset[str]) -> DataFrame:
    """(``name``, ``key``) of each distinct typed name that has any word."""
    types = sorted((t for t in common if len(t) >= 5), key=lambda t: (-len(t), t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(n, k) for n in b.column(0).to_pylist() if n.strip() and (k := spelling(n, types, common))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["name", "key"])

    return names.select("name").distinct().mapInArrow(run, "name string, key string")


def resolve(names: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``name``, ``key``) of the distinct names, and all that ``linked`` gives of the keys."""
    known = materialise(described(entities))
    common = common_words(known)
    forms = materialise(entity_forms(known, common))
    typed = materialise(spelt(names, common))
    keys = typed.select("key").distinct()
    blocks, parts = max(1, -(-forms.count() // BLOCK)), bucket_count(typed, bytes_per_bucket=1 << 20)
    weight = gram_weights(keys)
    near = materialise(near_forms(keys, forms, weight, blocks, parts))
    return typed, linked(near, forms, clusters(near, forms, weight), weight, blocks, parts)


def link_names(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(``field``, ``record_id``, ``pos``, ``economic_entity_id``) of each name that means a catalogue entity.

    Distinct spellings are linked once, so a spelling that a third of the rows
    share costs one comparison. A spelling's n-gram vector is joined with those of
    the entities' forms (the top ``TOP`` by cosine); the clusters around these forms
    with an average linkage of at least ``LINKAGE`` may be meant; of those that pass
    the exact comparison of words (``fits``) the best counts. Null and blank names,
    names of nobody in the catalogue and names that fit several entities equally
    get no row. Nothing bounds the size of either table.
    """
    typed, meant = resolve(names, entities)
    by_score = meant.groupBy("key", "entity").agg(F.max(F.round("score", 9)).alias("score")).groupBy("key").agg(F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "entity"))).alias("who"))
    sure = by_score.where((F.size("who") == 1) | (F.get("who", F.lit(0))["far"] < F.get("who", F.lit(1))["far"])).select("key", F.get("who", F.lit(0))["entity"].alias("economic_entity_id"))
    of = typed.join(sure, "key").select(F.col("name").alias("spelling"), "economic_entity_id")
    return names.join(of, F.col("name") == F.col("spelling")).select("field", "record_id", F.col("pos").cast("int").alias("pos"), "economic_entity_id")
