"""Text functions as column expressions (F1-F8, F10-F14, F20-F22) and the exact scanners as Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Function words that carry no signal in a story's shingles.
STOP_WORDS = (
    "el la los las un una unos unas de del al y o que en por para con sin sobre entre se su sus es son fue ha han como mas "
    "the a an of to and or in on for with by is are was were has"
).split()

#: Function words left out of lexical grounding.
GROUNDING_STOP_WORDS = (
    "the and for from that this with was were has have una uno unos unas los las del por para con sin que como desde hasta "
    "entre sobre segun este esta estos estas durante fue son han sus"
).split()

#: Legal suffixes of organisations, stripped in this order.
LEGAL_SUFFIXES = ("s.a.", "sa", "s.r.l.", "srl", "s.a.c.", "sac", "ltda", "ltda.", "y cia", "e.i.r.l.", "eirl")

#: Words that negate, and the words behind them with which they only join sentences.
NEGATIONS = {"no": ("solo", "solamente", "obstante"), "sin": ("embargo",), "not": ("only",), "nunca": (), "jamas": (), "never": (), "without": ()}

#: Phrases that try to redirect a model.
INJECTION_MARKERS = (
    r"ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions",
    r"disregard\s+(?:all\s+)?(?:previous|prior|above)",
    r"system\s*prompt",
    r"you\s+are\s+now\s+(?:a|an)\s",
    r"act\s+as\s+(?:a|an)\s+\w+\s+and\s+(?:ignore|output|reveal)",
    r"reveal\s+(?:your|the)\s+(?:prompt|instructions|api\s*key)",
    r"olvida\s+(?:todas\s+)?las\s+instrucciones",
    r"ignora\s+(?:todas\s+)?las\s+instrucciones",
    r"eres\s+ahora\s+un\s",
)



def _bases() -> dict[str, str]:
    """Letters that decompose into one base and combining marks (U+0300 to U+036F), and the bases, by the rule of NFD."""
    out = {}
    for code in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all("\u0300" <= m <= "\u036f" for m in marks):
            out[chr(code)] = base
    return out


BASES = _bases()
#: Characters whose decomposition ``BASES`` and dropping the marks give: Latin, Greek, Cyrillic, punctuation and signs.
_SIMPLE = r"^[\x00-\u052f\u1e00-\u20cf\u2100-\u2125\u2127-\u2129\u212c-\u2bff\u3000-\u3029\u4e00-\u9fff]*$"


def collapse(text: Column) -> Column:
    """Trimmed, every run of white space (NBSP included) one blank."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _nfkc(text: str) -> str | None:
    """The compatibility form of a text that has another one; else null."""
    return None if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)


@F.pandas_udf(T.StringType())
def _changed_by_nfkc(text: pd.Series) -> pd.Series:
    return text.map(_nfkc, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda xs: [x and unicodedata.normalize("NFKC", x) for x in xs], na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility form; plain ASCII is not moved to Python. Not for use inside a lambda."""
    return F.coalesce(_changed_by_nfkc(F.when(F.octet_length(text) != F.length(text), text)), text)


def _evened(text: Column) -> Column:
    return F.lower(collapse(text))


def comparable(text: Column) -> Column:
    """NFKC, white space collapsed, lower case. Not for use inside a lambda."""
    return _evened(nfkc(text))


@F.pandas_udf(T.StringType())
def _unmarked(text: pd.Series) -> pd.Series:
    return text.map(lambda s: re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", s)), na_action="ignore")


def fold_accents(text: Column) -> Column:
    """NFD without the marks U+0300 to U+036F, in lower case. Not for use inside a lambda.

    Scripts that the table of ``BASES`` decides stay in the JVM, others go to Python.
    """
    simple = F.translate(F.regexp_replace(text, "[\\u0300-\\u036f]", ""), "".join(BASES), "".join(BASES.values()))
    return F.lower(F.coalesce(_unmarked(F.when(~text.rlike(_SIMPLE), text)), simple))


def content_tokens(text: Column) -> Column:
    """folded words longer than two letters that are no stop words."""
    words = F.split(F.trim(F.regexp_replace(fold_accents(text), "[^a-z0-9]+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def shingles(tokens: Column, size: int = 5) -> Column:
    """distinct windows of ``size`` tokens; a shorter list is one shingle, an empty one none."""

    def windows(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(t) - size + 1, F.lit(1)))
        joined = F.transform(starts, lambda i: F.array_join(F.slice(t, i, size), " "))
        return F.when(F.size(t) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(joined))

    return F.get(F.transform(F.array(tokens), windows), F.lit(0))  # the tokens may hold a UDF, which no lambda may


def jaccard(a: Column, b: Column) -> Column:
    """shared over joint size of two sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def cluster_fingerprint(shingle_set: Column) -> Column:
    """SHA-256 of the 16 smallest shingles joined with a pipe."""
    return F.sha2(F.array_join(F.slice(F.array_sort(shingle_set), 1, 16), "|"), 256)


def entity_name(name: Column) -> Column:
    """F8: folded name without punctuation, legal suffixes (in list order) and dots."""
    x = F.trim(F.regexp_replace(F.regexp_replace(fold_accents(name), r"[^a-z0-9\s.]", " "), r"\s+", " "))
    for suffix in LEGAL_SUFFIXES:
        x = F.regexp_replace(x, " " + re.escape(suffix) + "$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\.", ""), r"\s+", " "))


#: Starts of an excerpt that are listed, by the reference's rule.
START_CAP = 20


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return F.floor(F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def excerpt_location(source: Column, excerpt: Column) -> Column:
    """``struct<start, end, length, count, starts, truncated>`` of an excerpt in comparable text, in UTF-16 units; null if absent.

    ``starts`` holds the first ``START_CAP`` of the occurrences, which do not overlap; ``count`` counts them all.
    """
    forms = F.array(F.struct(comparable(source).alias("hay"), comparable(excerpt).alias("needle")))  # evaluated once; no UDF may stand in a lambda

    def located(f: Column) -> Column:
        hay, needle = f["hay"], f["needle"]
        parts = F.split(hay, F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
        lengths = F.transform(F.slice(parts, 1, F.size(parts) - 1), utf16_length)
        width = utf16_length(needle)
        starts = F.transform(lengths, lambda _, i: F.aggregate(F.slice(lengths, 1, i + 1), F.lit(0), lambda acc, n: acc + n) + i * width)
        first = F.get(starts, F.lit(0))
        place = F.struct(first.alias("start"), (first + width).alias("end"), utf16_length(hay).alias("length"), F.size(starts).alias("count"), F.slice(starts, 1, START_CAP).alias("starts"), (F.size(starts) > START_CAP).alias("truncated"))
        return F.when((F.length(needle) > 0) & F.contains(hay, needle), place)

    return F.get(F.transform(forms, located), F.lit(0))


def grounded(names: Column, source: Column) -> Column:
    """the names that occur in a text between word boundaries."""
    bound = F.array(F.struct(comparable(source).alias("hay"), names.alias("names"), _nfkc_each(names).alias("forms")))  # no UDF may stand in a lambda
    occurs = lambda s, i: F.regexp_like(s["hay"], F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), _evened(F.get(s["forms"], i)), F.lit(r"\E(?![\p{L}\p{N}])")))
    return F.get(F.transform(bound, lambda s: F.filter(s["names"], lambda _, i: occurs(s, i))), F.lit(0))


def injection_markers(text: Column) -> Column:
    """the marker patterns that a text contains."""
    return F.filter(F.array(*(F.when(text.rlike("(?i)" + p), F.lit(p)) for p in INJECTION_MARKERS)), lambda m: m.isNotNull())


def semantic_negation(text: Column) -> Column:
    """whether a text negates, discourse markers aside."""
    each = (rf"{word}\b" + (rf"(?!\s+(?:{'|'.join(joining)})\b)" if joining else "") for word, joining in NEGATIONS.items())
    return fold_accents(text).rlike(rf"\b(?:{'|'.join(each)})")


def lexical_terms(text: Column) -> Column:
    """distinct letter-led words of at least three letters that are no stop words."""
    words = F.regexp_extract_all(fold_accents(nfkc(text)), F.lit(r"(\p{L}[\p{L}\p{N}]*)"), 1)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(GROUNDING_STOP_WORDS)))


def visible_markup(text: Column) -> Column:
    """F21 for well-formed markup: no comments, script-like elements or tags; six entities decoded once."""
    x = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?is)<(script|style|template|noscript)\b[^>]*>.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for entity, sign in ((r"(?i)&(?:nbsp|#160);", " "), (r"(?i)&(?:quot|#34);", '"'), (r"(?i)&(?:amp|#38);", "&")):
        x = F.regexp_replace(x, entity, sign)
    return collapse(x)


#: What markup is made of: a comment, a tag, an opening that never closes, text.
_PIECES = re.compile(r"(?P<comment><!--.*?(?:-->|\Z))|<(?P<tag>[^>]*)>|(?P<rest><.*)|(?P<text>[^<]+)", re.S)
_TAG_NAME = re.compile(r"\s*(/?)\s*([a-z][a-z0-9-]*)", re.I)
_ENTITY = re.compile(r"&(nbsp|amp|quot|#160|#38|#34);", re.I)
_SIGNS = {"nbsp": " ", "#160": " ", "amp": "&", "#38": "&", "quot": '"', "#34": '"'}
_HIDDEN = frozenset(("script", "style", "template", "noscript"))


def _evened_text(text: str) -> str:
    return re.sub(r"\s+", " ", _ENTITY.sub(lambda m: _SIGNS[m[1].lower()], text)).strip()


def scan_visible(source: str) -> str:
    """F21 for any markup: a tag that never closes ends the text; a hidden element reaches to its closing tag."""
    shown: list[str] = []
    within: str | None = None
    for m in _PIECES.finditer(source):
        kind = m.lastgroup
        if kind == "rest":
            break
        if kind == "text":
            shown += [m[0]] if within is None else []
            continue
        shown.append(" ")
        named = _TAG_NAME.match(m["tag"]) if kind == "tag" else None
        if named is None:
            continue
        closes, name = bool(named[1]), named[2].lower()
        if within is not None:
            within = None if closes and name == within else within
        elif name in _HIDDEN and not closes and not m["tag"].rstrip().endswith("/"):
            within = name
    return _evened_text("".join(shown))


@F.pandas_udf(T.StringType())
def visible_text(source: pd.Series, content_type: pd.Series) -> pd.Series:
    """the readable text of HTML, XML, JSON or plain text; '' for other types; null stays null."""

    def one(text: str | None, kind: str | None) -> str | None:
        if text is None:
            return None
        kind = kind or ""
        if "html" in kind or "xml" in kind:
            return scan_visible(text)
        if kind.startswith("text/") or "json" in kind:
            return _evened_text(text)
        return ""

    return pd.Series([one(t, k) for t, k in zip(source, content_type)])
