"""Figures and wording of an assertion checked against an excerpt."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions.text import GROUNDING_STOP_WORDS, NEGATIONS

#: Words that tell a direction.
UP = re.compile(r"aument\w*|increment\w*|subi\w*|crec\w*|alza|ascend\w*|increas\w*|rise|rose|risen|grow|grew|grown|higher")
DOWN = re.compile(r"dismin\w*|reduc\w*|baj\w*|cai\w*|cay\w*|descend\w*|contraj\w*|decreas\w*|declin\w*|fall|fell|fallen|drop\w*|lower")
STABLE = re.compile(r"estable|estables|mantuvo|mantuvieron|unchanged|steady|flat")
#: Units a figure may carry, by where their words stand.
UNIT_BEFORE = {"BOB": r"(?:\bbs\.?|bolivianos?)\s*$", "USD": r"(?:\busd|us\$|\$us|dólares?)\s*$"}
UNIT_AFTER = {"BOB": r"\s*bolivianos?\b", "USD": r"\s*dólares?\b", "PERCENTAGE_POINTS": r"\s*puntos?\s+porcentuales?\b", "MILLION": r"\s*(?:millones?|mm)\b", "THOUSAND": r"\s*mil\b", "ENERGY": r"\s*(?:mwh|mw|kwh)\b"}
LITRE, TONNE = re.compile(r"(?:^|[\s/])(?:por\s+)?(?:litros?|l)\b"), re.compile(r"(?:^|\s)(?:toneladas?|t)\b")
COVERAGE = 0.5

#: Patterns of a figure, a word, and a word or stop.
_FIGURE = re.compile(r"(?<![^\W_])[+-]?\d+(?:[.,]\d+)*")
_WORD = re.compile(r"[^\W\d_][^\W_]*")
_TOKEN = re.compile(r"[^\W\d_][^\W_]*|[.,;:!?]")


def number_text(raw: str, power: int = 0) -> str:
    """a figure in either separator habit as plain decimal text, scaled by a power of ten."""
    sign, digits = ("-" if raw.startswith("-") else ""), raw.lstrip("+-")
    groups = re.split(r"[.,]", digits)
    places = len(groups[-1]) if len(groups) > 1 and (len(groups[-1]) < 3 or groups[0] == "0") else 0
    value, shift = int("".join(groups)), places - power
    if shift <= 0:
        text = str(value * 10**-shift)
    else:
        text = str(value).rjust(shift + 1, "0")
        text = f"{text[:-shift]}.{text[-shift:]}" if power == 0 else f"{text[:-shift]}.{text[-shift:].rstrip('0')}".rstrip(".")
    return text if not value else sign + text


def figure_units(text: str, start: int, end: int) -> set[str]:
    """units from 40 characters before and 70 after a figure."""
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 70].lower()
    units = {u for u, p in UNIT_BEFORE.items() if re.search(p, before)} | {u for u, p in UNIT_AFTER.items() if re.match(p, after)}
    if "PERCENTAGE_POINTS" not in units:
        if re.match(r"\s*(?:%|por\s+ciento\b)", after):
            units.add("PERCENT")
        if re.match(r"\s*puntos?\b", after):
            units.add("POINTS")
    if LITRE.search(after[:40]):
        units.add("LITRE")
    if TONNE.search(after[:40]):
        units.add("TONNE")
    return units


def figures(text: str) -> list[tuple[str, str, frozenset[str]]]:
    """(as written, comparable, units) of each figure of a text."""
    out = []
    for m in _FIGURE.finditer(text):
        units = figure_units(text, m.start(), m.end())
        power = 6 if "MILLION" in units else 3 if "THOUSAND" in units else 0
        out.append((m.group(), number_text(m.group(), power), frozenset(units - {"MILLION", "THOUSAND"})))
    return out


def ungrounded(assertion: str, source: str) -> list[str]:
    """figures of an assertion that match no later, not yet used figure of the source, in order."""
    there, at, missing = figures(source), 0, []
    for raw, value, units in figures(assertion):
        for i in range(at, len(there)):
            if there[i][1] == value and units <= there[i][2]:
                at = i + 1
                break
        else:
            missing.append(raw)
    return list(dict.fromkeys(missing))


def _folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.category(c).startswith("M")).lower()


def terms(text: str) -> list[str]:
    """F12."""
    return list(dict.fromkeys(t for t in _WORD.findall(_folded(text)) if len(t) >= 3 and t not in GROUNDING_STOP_WORDS))


def negated(text: str) -> bool:
    """F13."""
    return any(w in NEGATIONS and nxt not in NEGATIONS[w] for w, nxt in _pairs(re.findall(r"[^\W_]+", _folded(text))))


def _pairs(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, [*words[1:], ""]))


def directions(text: str) -> list[tuple[str, bool]]:
    """(direction, negated) of each directed word, equal neighbours once; a negation reaches four words."""
    tokens, out = _TOKEN.findall(_folded(text)), []
    for i, t in enumerate(tokens):
        kind = "UP" if UP.fullmatch(t) else "DOWN" if DOWN.fullmatch(t) else "STABLE" if STABLE.fullmatch(t) else None
        if kind is None:
            continue
        scope = []
        for j in range(i - 1, -1, -1):
            if tokens[j] in ".,;:!?" or len(scope) == 4:
                break
            scope.append(j)
        pair = (kind, any(tokens[j] in NEGATIONS and tokens[j + 1] not in NEGATIONS[tokens[j]] for j in scope))
        if not out or out[-1] != pair:
            out.append(pair)
    return out


def contains_run(whole: list, part: list) -> bool:
    """whether ``part`` is a contiguous run of ``whole``; nothing is in an empty list."""
    return any(whole[i : i + len(part)] == part for i in range(len(whole)))


def lexical_grounding(assertion: str, excerpt: str) -> tuple[str, float | None, int]:
    """(status, coverage, matched terms)."""
    mine, theirs = terms(assertion), set(terms(excerpt))
    matched = [t for t in mine if t in theirs]
    coverage = round(len(matched) / len(mine), 4) if mine else None
    a, b = directions(assertion), directions(excerpt)
    if a and b:
        same_sign = contains_run(b, a) and not any((kind, not sign) in b for kind, sign in a)
        same_way = contains_run([k for k, _ in b], [k for k, _ in a])
    else:
        same_sign, same_way = negated(assertion) == negated(excerpt), True
    if not mine:
        status = "UNAVAILABLE"
    elif not matched:
        status = "UNSUPPORTED"
    else:
        status = "SUPPORTED" if same_sign and same_way and len(matched) >= 2 and coverage >= COVERAGE else "LIMITED"
    return status, coverage, len(matched)


@F.pandas_udf(T.ArrayType(T.StringType()))
def ungrounded_numbers(assertion: pd.Series, source: pd.Series) -> pd.Series:
    """F42 as an Arrow UDF; null texts count as empty."""
    return pd.Series([ungrounded(a or "", s or "") for a, s in zip(assertion, source)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("raw", T.StringType()), T.StructField("value", T.StringType()), T.StructField("units", T.ArrayType(T.StringType()))])))
def number_occurrences(text: pd.Series) -> pd.Series:
    """F41 as an Arrow UDF; a null text has no figures."""
    return pd.Series([[{"raw": r, "value": v, "units": sorted(u)} for r, v, u in figures(t or "")] for t in text])


@F.pandas_udf(T.StructType([T.StructField("status", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("matched", T.IntegerType())]))
def ground_wording(assertion: pd.Series, excerpt: pd.Series) -> pd.DataFrame:
    """F18 as an Arrow UDF; null texts count as empty."""
    return pd.DataFrame([lexical_grounding(a or "", e or "") for a, e in zip(assertion, excerpt)], columns=["status", "coverage", "matched"])
