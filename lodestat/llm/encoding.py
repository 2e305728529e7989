"""Text decoded with a wrong encoding: find it and restore it.

Unknown code-page swaps are treated as substitution ciphers by source: the letter
behind each foreign symbol is learned by expectation-maximisation against the
corpus's character bigrams, with the mapping of all sources as prior. The learned
mapping ranks the pairs of code pages that can explain it and completes them where
none can; tables are applied with ``str.translate``. Swaps in which one character
became several, or several one (UTF-8 and UTF-16 read as something else), are no
substitution of single characters; they are undone on the bytes.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.sources.tables import bucket_count, materialise

#: Single-byte code pages that may have written or read a text (Python codec names).
PAGES = ("cp850", "cp437", "mac_roman", "iso8859_15", "cp1250", "cp1251", "cp1254", "iso8859_2", "cp852", "cp860")
#: Letters that Spanish, Portuguese and English write outside ASCII.
LETTERS = "áéíóúñüàâãçêôõÁÉÍÓÚÑÜÀÂÃÇÊÔÕ"
#: EM rounds over the context counts, which are a table of bounded size.
EM_ROUNDS = 25
#: Least gain in log-likelihood of a row that counts as restored by a cipher.
GAIN = 3.0
#: Rows that the mapping of all sources counts for in that of one source, by symbol.
PRIOR_ROWS = 4.0
#: Least posterior and occurrences of a learned letter that is applied where no pair of code pages explains a text.
SURE, SEEN = 0.75, 5
#: Shares of what follows a word's end and of what follows a question mark: a capital or the end, a small letter, a sign.
AFTER_WORD, AFTER_QUESTION = (0.1, 0.85, 0.05), (0.9, 0.08, 0.02)

_C1 = "".join(map(chr, range(0x80, 0xA0)))
_HIGH = "\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_SEQ = re.compile(rf"[Â-ß][{_HIGH}]|[à-ï][{_HIGH}]{{2}}|[ð-ô][{_HIGH}]{{3}}")
_ODD = re.compile(rf"[^ -~\n\r\t{LETTERS}¿¡“”‘’–—…ºª°«»€½§¶¢·\xa0\ufeff]")
_FOREIGN = re.compile("[^\x00-~]")
_URL_QUERY = re.compile(r"\S*\?\w+=\S*")
_LOST = re.compile(r"[^\W\d_]\?[^\W\d_]|(?:^|[\s(\"“«/-])\?[^\W\d_]|\?\?")
_AT_END = re.compile(r"([^\W\d_])\?(?![^\W\d_?])")


def to_bytes(text: str, page: str = "cp1252") -> bytes | None:
    """The bytes that ``page`` read as this text; C1 controls stand for the bytes the page leaves undefined."""
    try:
        return text.encode(page)
    except UnicodeEncodeError:
        pass
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(page)
        except UnicodeEncodeError:
            if not 0x80 <= ord(ch) < 0xA0:
                return None
            out.append(ord(ch))
    return bytes(out)


def _decode(data: bytes | None, codec: str) -> str | None:
    try:
        return None if data is None else data.decode(codec)
    except UnicodeDecodeError:
        return None


def plain_share(text: str) -> float:
    """Share of characters that the corpus's languages write: ASCII, their letters, common signs."""
    if not text:
        return 0.0
    return 1 - len(_ODD.findall(text)) / len(text)


def undo_utf8(text: str) -> str:
    """Restore UTF-8 sequences that were read as windows-1252, anywhere in the text, as often as they were."""

    def one(m: re.Match) -> str:
        return _decode(to_bytes(m.group()), "utf-8") or m.group()

    while (fixed := _SEQ.sub(one, text)) != text:  # each round makes the text shorter
        text = fixed
    return text


def undo_wide(text: str) -> str | None:
    """Restore a text in which 16-bit and 8-bit units were taken for each other, or the byte order swapped."""
    if "\x00" in text or text.startswith(("ÿþ", "þÿ")):
        for page in ("cp1252", "latin-1"):
            data = to_bytes(text, page)
            if data:
                order = "utf-16-be" if data[:2] == b"\xfe\xff" or (data[:1] == b"\x00") else "utf-16-le"
                data = data[2:] if data[:2] in (b"\xff\xfe", b"\xfe\xff") else data
                for cut in (data, data + b"\x00", data[:-1]):
                    found = _decode(cut, order)
                    if found and plain_share(found) > 0.9:
                        return found
    if text.isascii() or plain_share(text) > 0.6:
        return None
    for read in ("utf-16-le", "utf-16-be"):
        try:
            data = text.encode(read, "surrogatepass")
        except UnicodeEncodeError:
            continue
        for written in ("utf-16-be", "utf-16-le", "utf-8", "cp1252", "cp850"):
            for cut in (data, data[:-1] if data[-1:] in (b"\x00", b"\n", b" ") else None):
                found = _decode(cut, written) if written != read else None
                if found and plain_share(found) > 0.9:
                    return found
    return None


def lost(text: str) -> bool:
    """Whether characters were surely replaced, by U+FFFD or by question marks inside or before words."""
    return "\ufffd" in text or "?" in text and _LOST.search(_URL_QUERY.sub(" ", text)) is not None


def doubtful_marks(text: str) -> list[tuple[str, int]]:
    """(letter before, class of what follows) of question marks at the end of a word, where none opens a question.

    They are question marks, or letters that were lost: ``Reader.took_letters`` judges.
    """
    if "?" not in text or "¿" in text:
        return []
    rest = _URL_QUERY.sub(" ", text)
    out = []
    for m in _AT_END.finditer(rest):
        after = rest[m.end() :].lstrip("\"'”’»)")[:60].lstrip()[:1]
        near = rest[m.end() : m.end() + 1]
        out.append((m[1].lower(), 2 if near and near in ",;:./-" else 1 if after.islower() else 0))
    return out


@dataclass(frozen=True)
class Model:
    """Character bigrams of the sound texts, and how often letters were lost and questions asked."""

    pairs: dict[tuple[str, str], float]
    floor: float
    ends: dict[str, float] = field(default_factory=dict)
    accented: dict[str, float] = field(default_factory=dict)
    lost_rate: float = 0.01
    ask_rate: float = 0.1

    def score(self, text: str) -> float:
        """Log-likelihood of the bigrams around characters outside ASCII."""
        pairs, floor = self.pairs, self.floor
        total = 0.0
        for m in _FOREIGN.finditer(text):
            i, c = m.start(), fold(m.group())
            total += pairs.get((fold(text[i - 1]) if i else " ", c), floor) + pairs.get((c, fold(text[i + 1]) if i + 1 < len(text) else " "), floor)
        return total

    def took_letters(self, marks: list[tuple[str, int]]) -> bool:
        """Whether any question mark at a word's end more likely stands for a lost letter than for a question."""
        return any(self.lost_rate * self.accented.get(a, 0.0) * AFTER_WORD[c] > self.ask_rate * self.ends.get(a, 0.0) * AFTER_QUESTION[c] for a, c in marks)


def bigram_model(bigrams: Counter, lost_marks: int = 0, asked: int = 0) -> Model:
    """The model from counts of character pairs, of lost letters inside words and of questions without an opening mark."""
    left: Counter = Counter()
    for (a, _), n in bigrams.items():
        left[a] += n
    size = max(1, len({b for _, b in bigrams}))
    pairs = {(a, b): float(np.log((n + 0.1) / (left[a] + 0.1 * size))) for (a, b), n in bigrams.items()}
    floor = float(np.log(0.1 / (0.1 * size + max(left.values(), default=1) / max(1, len(left)))))
    closing: Counter = Counter()
    for (a, b), n in bigrams.items():
        if not b.isalnum() and b != "?":
            closing[a] += n
    ends = {a: closing[a] / left[a] for a in left if a.isalpha()}
    accented: Counter = Counter()
    letters = 0
    for (a, b), n in bigrams.items():
        if b in LETTERS:
            letters += n
            if a.isalpha():
                accented[a] += n * closing[b] / max(1, left[b]) / left[a]
    words = sum(closing[a] for a in ends)
    return Model(pairs, floor, ends, dict(accented), (lost_marks + 1) / (letters + lost_marks + 100), (asked + 1) / (words + 1))


@lru_cache(maxsize=256)
def pair_table(read: str, wrote: str) -> dict[int, str]:
    """Mapping from what the page ``read`` reads to what ``wrote`` wrote, for the upper half of the bytes."""
    table = {}
    for b in range(0x80, 0x100):
        seen = _decode(bytes([b]), read) or (chr(b) if read == "cp1252" else None)
        meant = _decode(bytes([b]), wrote)
        if seen is not None and meant is not None:
            table[ord(seen)] = meant
    return table


def page_table(page: str) -> dict[int, str]:
    """Mapping from what windows-1252 reads to what ``page`` wrote."""
    return pair_table("cp1252", page)


#: Pairs (reader, writer) of code pages; reading by windows-1252 comes first.
PAIRS = tuple((r, w) for r in ("cp1252", *PAGES) for w in (*PAGES, "cp1252") if r != w)
#: What any page reads in the upper half of the bytes; other symbols are no cipher of single bytes.
SYMBOLS = frozenset(chr(s) for r in ("cp1252", *PAGES) for s in pair_table(r, "latin-1"))


@dataclass(frozen=True)
class Cipher:
    """What was learned for a source: pairs of code pages, the likeliest first, and a mapping of its own."""

    pairs: tuple[tuple[str, str], ...]
    learned: dict[int, str] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps([self.pairs, [[chr(k), v] for k, v in self.learned.items()]])

    @staticmethod
    @lru_cache(maxsize=4096)
    def from_json(text: str) -> Cipher:
        pairs, learned = json.loads(text)
        return Cipher(tuple((r, w) for r, w in pairs), {ord(k): v for k, v in learned})

    @staticmethod
    def gain(model: Model, text: str, score: float, data: bytes | None, read: str, wrote: str) -> tuple[float, str]:
        """What reading a row of this score so gains, and the text; no gain if its bytes don't make the same round trip."""
        found = text.translate(pair_table(read, wrote))
        if found == text or _decode(data, wrote) != found:
            return 0.0, text
        return model.score(found) - score, found

    def restore(self, model: Model, text: str) -> str | None:
        """The text behind the cipher, if reading it so is likelier and its bytes make the same round trip.

        The source's likeliest pair comes first; a row is of another pair only if
        that gains clearly more, and read by the learned mapping where that gains
        clearly more than any pair.
        """
        if text.isascii():
            return None
        score, data = model.score(text), {r: to_bytes(text, r) for r, _ in self.pairs}
        (first, found), *rest = (self.gain(model, text, score, data[r], r, w) for r, w in self.pairs)
        other, alike = max(rest, default=(0.0, text))
        if self.learned:
            own = text.translate(self.learned)
            if own != text and not _enciphered(own) and model.score(own) - score >= 2 * GAIN + max(first, other, 0.0):
                return own
        if other >= max(2 * GAIN, first + GAIN):
            return alike
        return found if first >= GAIN else None


def fold(c: str) -> str:
    """The model's symbol of a character: letters in lower case, digits as 0, blanks as one, all beyond Latin and punctuation as one."""
    if c.isdigit():
        return "0"
    if c.isspace() and c != "\xa0":
        return " "
    return "字" if _FAR.match(c) else c.lower()


_BLANKS = re.compile(r"[^\S\xa0]+")
_DIGITS = re.compile(r"\d")
_FAR = re.compile("[\u0250-\u1fff\u20d0-\U0010ffff]")


def _fold_all(text: str) -> str:
    """``fold`` of each character of a long text, runs of blanks as one."""
    return _FAR.sub("字", _BLANKS.sub(" ", _DIGITS.sub("0", text)).lower())


def first_steps(text: str) -> tuple[str, str]:
    """(kind, text) after the steps that need no learned mapping: lost, wide, utf8 or none."""
    if lost(text):
        return "lost", text
    found = undo_wide(text)
    if found is not None:
        return ("lost", found) if lost(found) else ("wide", undo_utf8(found))
    found = undo_utf8(text)
    return ("utf8", found) if found != text else ("none", text)


def _enciphered(text: str) -> bool:
    """Whether symbols that are no letters stand inside or against words where no sign belongs, as after a swap of single-byte pages."""
    for m in _FOREIGN.finditer(text):
        i, c = m.start(), m.group()
        if not c.isalpha():
            before, after = i and text[i - 1].isalpha(), i + 1 < len(text) and text[i + 1].isalpha()
            if before and c not in "’”…–—»°™\xa0" or after and c not in "¿¡“‘«°—–§€£’\xa0" or before and after and c == "\xa0" and not text[i + 1].isupper():
                return True
    return False


STAGED = "kind string, source string, a string, b string, c string, n long, key long, text string"


def stage(rows: DataFrame) -> DataFrame:
    """One pass over all texts (``source``, ``text``, ``key``), in long form.

    ``kind`` bigram: character pairs (``a``, ``b``) of sound texts; context and
    CONTEXT: neighbours (``a``, ``c``) of foreign symbols ``b`` in texts that look
    enciphered, by ``source``, the latter beside capitals; mark: question marks
    that are lost letters (``a`` lost) or in doubt (``a`` asked); doubt: the
    doubtful marks of a text; else a text that is damaged or suspect, after the
    steps that need no learning.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        ascii_pairs = np.zeros(128 * 128, dtype=np.int64)
        for batch in batches:
            sound, kept = [], []
            for source, text, key in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not text:
                    continue
                source = source or ""
                kind, text = first_steps(text)
                if kind == "lost":
                    total["mark", "", "lost", "", ""] += len(_LOST.findall(text)) if "\ufffd" not in text else 0
                    kept.append((kind, source, "", key))
                    continue
                marks = doubtful_marks(text)
                if marks:
                    total["mark", "", "asked", "", ""] += len(marks)
                    kept.append(("doubt", source, "".join(f"{a}{c}" for a, c in marks), key))
                suspect = kind == "none" and not text.isascii() and _enciphered(text)
                if suspect:
                    for m in _FOREIGN.finditer(text):
                        i, c = m.start(), m.group()
                        if c in SYMBOLS:
                            before, after = text[i - 1 : i] or " ", text[i + 1 : i + 2] or " "
                            upper = after.isupper() or before.isupper() and not after.islower()
                            total["CONTEXT" if upper else "context", source, fold(before), c, fold(after)] += 1
                else:
                    sound.append(text)
                if kind != "none" or suspect or not text.isascii() and _ODD.search(text):
                    kept.append((kind, source, text, key))
            joined = _fold_all(" " + " ".join(sound) + " ")
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            low = (codes[:-1] < 128) & (codes[1:] < 128)
            ascii_pairs += np.bincount(codes[:-1][low].astype(np.int64) * 128 + codes[1:][low], minlength=128 * 128)
            total.update(("bigram", "", joined[i], joined[i + 1], "") for i in np.flatnonzero(~low).tolist())
            yield _rows(Counter(), kept)
            if len(total) > 200_000:
                yield _rows(total, [])
                total = Counter()
        total.update({("bigram", "", chr(i // 128), chr(i % 128), ""): int(ascii_pairs[i]) for i in np.flatnonzero(ascii_pairs).tolist()})
        yield _rows(total, [])

    return rows.mapInArrow(run, STAGED)


def _rows(total: Counter, kept: list[tuple[str, str, str, int]]) -> pa.RecordBatch:
    """Counts and texts as one batch of the staged form."""
    none, blank = [None] * len(kept), [None] * len(total)
    parts = list(zip(*total)) if total else [()] * 5
    texts = list(zip(*kept)) if kept else [()] * 4
    columns = [pa.array([*parts[0], *texts[0]], pa.string()), pa.array([*parts[1], *texts[1]], pa.string()), *(pa.array([*p, *none], pa.string()) for p in parts[2:])]
    columns += [pa.array([*total.values(), *none], pa.int64()), pa.array([*blank, *texts[3]], pa.int64()), pa.array([*blank, *texts[2]], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["kind", "source", "a", "b", "c", "n", "key", "text"])


_OPTIONS = tuple(sorted(set(LETTERS.lower())) + list("aeiounc"))


def learn_mapping(contexts: Counter, model: Model, prior: dict[str, dict[str, float]] | None = None) -> dict[str, dict[str, float]]:
    """P(letter | symbol) by expectation-maximisation.

    ``contexts`` counts (left, symbol, right). The hidden letter of an occurrence
    has the posterior P(letter | left) P(right | letter) P(letter | symbol); the
    last factor is re-estimated from the posteriors of all occurrences and, where
    given, from ``prior``, the mapping of all sources, which counts for ``PRIOR_ROWS``.
    """
    symbols = sorted({s for _, s, _ in contexts})
    at = {s: i for i, s in enumerate(symbols)}
    keys = list(contexts)
    n = np.array([contexts[k] for k in keys], dtype=float)
    who = np.array([at[s] for _, s, _ in keys], dtype=int)
    fit = np.array([[model.pairs.get((a, x), model.floor) + model.pairs.get((x, c), model.floor) for x in _OPTIONS] for a, _, c in keys]).reshape(-1, len(_OPTIONS))
    before = np.array([[PRIOR_ROWS * p for p in (prior or {}).get(s, {}).values()] or [0.01] * len(_OPTIONS) for s in symbols]).reshape(-1, len(_OPTIONS)) + 1e-6
    theta = before / before.sum(axis=1, keepdims=True)
    for _ in range(EM_ROUNDS if len(keys) else 0):
        post = fit + np.log(theta[who] + 1e-12)
        post = np.exp(post - post.max(axis=1, keepdims=True))
        post *= (n / post.sum(axis=1))[:, None]
        theta = before.copy()
        np.add.at(theta, who, post)
        theta /= theta.sum(axis=1, keepdims=True)
    return {s: dict(zip(_OPTIONS, theta[i].tolist())) for s, i in at.items()}


def make_cipher(contexts: Counter, capitals: Counter, theta: dict[str, dict[str, float]], sound: dict[str, int], others: tuple[tuple[str, str], ...] = ()) -> Cipher:
    """The pairs of code pages by agreement with a learned mapping, and the sure part of the mapping itself.

    Pairs read by windows-1252 are all kept, another one where it agrees best.
    """
    count: Counter = Counter()
    for (_, s, _), n in contexts.items():
        count[s] += n

    def agreement(pair: tuple[str, str]) -> float:
        table = pair_table(*pair)
        return sum(n * float(np.log(theta[s].get(table.get(ord(s), "").lower(), 1e-6) + 1e-6)) for s, n in count.items())

    ranked = sorted(PAIRS, key=agreement, reverse=True)
    pairs = tuple(dict.fromkeys([ranked[0], *others, *(p for p in ranked if p[0] == "cp1252")]))
    learned: dict[int, str] = {}
    for p, n, s, letter in sorted(((p, n, s, x) for s, n in count.items() for x, p in theta[s].items() if p >= SURE), reverse=True):
        meant = letter.upper() if 2 * capitals[s] > n else letter
        if n >= SEEN and not s.isalpha() and not letter.isascii() and sound.get(s, 0) <= 0.2 * n and meant not in learned.values():  # a cipher is one to one
            learned[ord(s)] = meant
    return Cipher(pairs, learned)


_LEARNED = "source string, cipher string"


def learn_ciphers(staged: DataFrame) -> tuple[Model, Cipher, DataFrame]:
    """The bigram model, the cipher of all sources together, and the cipher of each source (``source``, ``cipher``).

    The counts cover all texts. To the driver come the bigrams and the contexts of
    all sources together, tables that the folded alphabet and the code pages'
    symbols bound. A source's contexts, bounded alike, are learned from in a group
    of their own with the pooled mapping as prior.
    """
    counted = staged.where("n IS NOT NULL").groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n")).collect()
    bigrams = Counter({(r["a"], r["b"]): r["n"] for r in counted if r["kind"] == "bigram"})
    marks = {r["a"]: r["n"] for r in counted if r["kind"] == "mark"}
    pooled, capitals = _contexts((r["kind"], r["a"], r["b"], r["c"], r["n"]) for r in counted)
    model = bigram_model(bigrams, marks.get("lost", 0), marks.get("asked", 0))
    sound: Counter = Counter()
    for (_, b), n in bigrams.items():
        if b in SYMBOLS:
            sound[b] += n
    theta = learn_mapping(pooled, model)
    shared = make_cipher(pooled, capitals, theta, sound)

    def run(part: pa.Table) -> pa.Table:
        found, upper = _contexts(zip(*(part.column(i).to_pylist() for i in range(1, 6))))
        own = make_cipher(found, upper, learn_mapping(found, model, theta), sound, shared.pairs[:1])
        return pa.table({"source": [part.column(0)[0].as_py()], "cipher": [own.to_json()]})

    contexts = staged.where("kind IN ('context', 'CONTEXT')").groupBy("source", "kind", "a", "b", "c").agg(F.sum("n").alias("n"))
    return model, shared, contexts.groupBy("source").applyInArrow(run, _LEARNED)


def _contexts(rows) -> tuple[Counter, Counter]:
    """Counts of (left, symbol, right), and of the symbols beside capitals, from (kind, left, symbol, right, n)."""
    found, upper = Counter(), Counter()
    for kind, a, b, c, n in rows:
        if kind in ("context", "CONTEXT"):
            found[a, b, c] += n
            if kind == "CONTEXT":
                upper[b] += n
    return found, upper


def finish(kind: str, text: str, model: Model | None, cipher: Cipher | None) -> tuple[str, str] | None:
    """(kind of damage, restored text) from what was staged; None for a sound text."""
    if kind == "doubt":
        marks = [(text[i], int(text[i + 1])) for i in range(0, len(text), 2)]
        return ("lost", "") if model is not None and model.took_letters(marks) else None
    if kind == "lost":
        return kind, ""
    deciphered = cipher.restore(model, text) if cipher is not None and model is not None else None
    if deciphered is not None:
        kind, text = "cipher" if kind == "none" else kind, deciphered
    return None if kind == "none" else (kind, text.removeprefix("\ufeff"))


def restore_text(text: str | None, model: Model | None = None, cipher: Cipher | None = None) -> tuple[str, str] | None:
    """(kind of damage, restored text) of a damaged text, '' where characters were lost; None for a sound one."""
    if not text:
        return None
    kind, found = first_steps(text)
    marks = doubtful_marks(found) if kind != "lost" else []
    if marks and model is not None and model.took_letters(marks):
        return "lost", ""
    return finish(kind, found, model, cipher)


def restore_texts(responses: DataFrame, key: str = "response_id", source: str = "source_code", text: str = "text") -> DataFrame:
    """(``key``, ``damage``, ``restored``) of the damaged rows.

    Whatever the encoding columns say is ignored. Null and empty texts are sound;
    a null source is a source of its own; a repeated row gives one row. Lost
    characters give an empty restored text. The texts are read once; the damaged
    and suspect ones are staged as a table of the shared folder together with the
    counts that model and ciphers are learned from.
    """
    rows = responses.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(source), F.col(text), F.col(key).cast("long"))
    staged = materialise(stage(rows))
    model, shared, ciphers = learn_ciphers(staged)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = (b.column(i).to_pylist() for i in range(4))
            found = [(k, *r) for k, kind, t, own in zip(*columns) if (r := finish(kind, t, model, Cipher.from_json(own) if own else shared)) is not None]
            parts = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(parts, (pa.int64(), pa.string(), pa.string()))], [key, "damage", "restored"])

    # judging costs time by the character, not by the byte moved: more partitions than bytes alone would give
    told = staged.where("key IS NOT NULL").join(ciphers, "source", "left").select("key", "kind", "text", "cipher")
    damaged = told.repartition(bucket_count(staged, bytes_per_bucket=1 << 20)).mapInArrow(run, f"{key} long, damage string, restored string")
    best = F.min(F.struct((F.col("damage") != "lost").alias("sound"), "damage", "restored")).alias("v")
    return damaged.groupBy(key).agg(best).select(key, "v.damage", "v.restored")


def restored_digest(restored: DataFrame) -> DataFrame:
    """(``response_id``, ``restored_md5``): lower-case MD5 of the restored text in UTF-8, '' where characters were lost."""
    return restored.select("response_id", F.when(F.col("damage") == "lost", "").otherwise(F.md5(F.col("restored").cast("binary"))).alias("restored_md5"))
