"""Quantities in different units and scales to common units: number and unit grammar, dimension algebra."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of units without a prefix, as regular expressions, by the code that the catalogue gives them.
STEMS = {
    "GRM": r"gramos?|grams?|grs?|g",
    "TNE": r"toneladas?(?: métricas?)?|metric tons?|metric tonnes?|tonnes?|tons?|t",
    "QTL": r"quintal(?:es)?(?: métricos?)?|quintals?|qq",
    "WHR": r"vatios? hora|watt[ -]hours?|wh",
    "LTR": r"litros?|litres?|liters?|lts?|l",
    "MTQ": r"metros? cúbicos?|cubic met(?:re|er)s?|m³|m3",
    "PCT": r"%|por ?ciento|percent|per cent|pct|porcentaje|percentage",
    "PMIL": r"‰|por mil|per mille?|per thousand",
    "BPS": r"puntos? básicos?|basis points?|pbs?|bps?",
    "CENT_QLM": r"centavos?(?: de quilmar(?:es)?)?|quilmar cents?|cents?(?: of a quilmar)?",
    "QLM": r"quilmar(?:es|s)?|q\$|qlm",
    "TNS": r"tensas?|t/|tns",
    "ARV": r"arvos?|av|arv",
}

#: Decimal prefixes, their signs and powers of ten.
PREFIXES = ((r"mili|milli", "m", -3), (r"centi", "c", -2), (r"deci", "d", -1), (r"deca|deka", "da", 1), (r"hecto", "h", 2), (r"kilo", "k", 3), (r"mega", "M", 6), (r"giga", "G", 9), (r"tera", "T", 12))
#: Units that take prefixes: the words and the sign a prefix is put before. A tonne takes none below one thousand.
PREFIXED = {"GRM": (r"gramos?|grams?", r"g", -3), "WHR": (r"vatios? hora|watt[ -]hours?", r"wh", -3), "LTR": (r"litros?|litres?|liters?", r"l", -3), "TNE": (r"toneladas?|tons?|tonnes?", r"t", 3)}
#: Further words for prefixed units.
SHORT = {("GRM", 3): r"kilos?|kgs"}

#: Scale words and their power of ten, by language; longest first.
SCALES = {
    "es": (("miles de millones", 9), ("mil millones", 9), ("miles de mm", 9), ("mil mm", 9), ("millones", 6), ("millón", 6), ("millon", 6), ("billones", 12), ("billón", 12), ("trillones", 18), ("miles", 3), ("mil", 3), ("mm", 6)),
    "en": (("thousand million", 9), ("thousands", 3), ("thousand", 3), ("millions", 6), ("million", 6), ("billions", 9), ("billion", 9), ("trillions", 12), ("trillion", 12), ("mm", 6), ("mn", 6), ("bn", 9), ("tn", 12), ("trn", 12)),
}

#: Scale labels of extracted figures.
SCALE_LABELS = {"THOUSAND": 3, "MILLION": 6, "BILLION": 9}
#: Unit labels of extracted figures that are not words of a text.
UNIT_LABELS = {"PERCENT": "PCT", "LITRE": "LTR", "TONNE": "TNE"}

MAX_LONG = 2**63 - 1


@dataclass(frozen=True)
class Unit:
    """A unit as exponents of base units, a power of ten and an offset to the base.

    ``scale`` is the part of ``power`` that is a scale word in the unit's own name,
    as in thousands of tonnes.
    """

    dims: tuple[tuple[str, int], ...]
    power: int = 0
    offset: Fraction = field(default=Fraction(0))
    scale: int = 0

    def times(self, other: Unit, sign: int = 1) -> Unit:
        """The product, or with ``sign`` -1 the quotient, of two units without offset."""
        exps = dict(self.dims)
        for base, e in other.dims:
            exps[base] = exps.get(base, 0) + sign * e
        return Unit(tuple(sorted((b, e) for b, e in exps.items() if e)), self.power + sign * other.power)

    def base(self) -> str | None:
        """The one base unit this is a multiple of, if it is."""
        return self.dims[0][0] if len(self.dims) == 1 and self.dims[0][1] == 1 else None


_SCALED_NAME = {lang: re.compile("(?:" + "|".join(re.escape(w) for w, _ in words) + r")(?=\s+(?:de|of)\s)", re.I) for lang, words in SCALES.items()}


def name_scale(name: str | None) -> int:
    """The power of ten of the scale word that a unit's name starts with, else 0."""
    for lang, pattern in _SCALED_NAME.items():
        m = pattern.match(name or "")
        if m:
            return dict(SCALES[lang])[m[0].lower()]
    return 0


def catalogue_units(rows: Iterable[tuple]) -> tuple[dict[str, Unit], dict[str, str], dict[str, str]]:
    """Units by code, codes by id and codes by symbol from (id, base id, code, symbol, power[, name]) rows.

    Scales add up along the chain of bases; a chain that loops or dangles gives no unit.
    """
    by_id = {r[0]: r for r in rows if r[0] is not None}
    units: dict[str, Unit] = {}
    for r in by_id.values():
        power, at, seen = 0, r, set()
        while at is not None and at[1] is not None and at[0] not in seen:
            seen.add(at[0])
            power += at[4] or 0
            at = by_id.get(at[1])
        if at is not None and at[1] is None:
            units[r[2]] = Unit(((at[2], 1),), power, scale=name_scale(r[5] if len(r) > 5 else None))
    return units, {k: r[2] for k, r in by_id.items()}, {r[3].lower(): r[2] for r in by_id.values() if r[3]}


def unit_words(units: dict[str, Unit]) -> dict[str, tuple[str, Unit]]:
    """Regular expression and unit of each unit that words name: the catalogue's, and their decimal multiples by prefix."""
    out = {code: (pattern, units[code]) for code, pattern in STEMS.items() if code in units}
    for code, (word, sign, own) in PREFIXED.items():
        known = next((u for c, u in units.items() if c == code), None) or next((Unit(u.dims, own) for c, u in units.items() if c == {"GRM": "KGM", "WHR": "KWH"}.get(code) and not u.power), None)
        for names, letter, power in PREFIXES if known else ():
            if own <= 0 or power >= 3:
                more = f"|{SHORT[code, power]}" if (code, power) in SHORT else ""
                out[f"{code}{power:+d}"] = (f"(?:{names})(?:{word})|{letter.lower()}{sign}{more}", Unit(known.dims, known.power + power))
    # small signs would take over larger ones that differ by case only; in statistics the larger one is meant
    if "WHR-3" in out:
        out["WHR-3"] = (PREFIXED["WHR"][0].join(("(?:mili|milli)(?:", ")")), out["WHR-3"][1])
    if "GRM+6" in out:
        out["GRM+6"] = (PREFIXED["GRM"][0].join(("mega(?:", ")")), out["GRM+6"][1])
    if "LTR+6" in out:
        out["LTR+6"] = (PREFIXED["LTR"][0].join(("mega(?:", ")")), out["LTR+6"][1])
    return out


_NOT_BEFORE = set("0123456789.,+−-")
_OTHER_COUNT = re.compile(r"\s*[^\W\d_]{3,}")
_NO_COUNT = re.compile(r"\s*(?:en|in|durante|during|y|and|el|the|por|or|era)\b")


def find_figure(text: str, raw: str) -> int:
    """Where the figure ``raw`` stands in ``text`` and is no part of a longer figure; -1 if nowhere."""
    at = text.find(raw) if raw else -1
    while at >= 0:
        after = text[at + len(raw) : at + len(raw) + 2]
        if not (at and text[at - 1] in _NOT_BEFORE) and not after[:1].isdigit() and not (after[:1] in (".", ",") and after[1:].isdigit()):
            return at
        at = text.find(raw, at + 1)
    return -1


class UnitGrammar:
    """expression := [scale ["de"|"of"]] unit {("/"|"por"|"per") unit}; attached after a figure, before it, or in a heading."""

    def __init__(self, rows: Iterable[tuple]) -> None:
        self.units, self.by_id, self.by_symbol = catalogue_units(rows)
        known = unit_words(self.units)
        words = {key: [pattern] for key, (pattern, _) in known.items()}
        meant = {key: unit for key, (_, unit) in known.items()}
        for written, code in [*self.by_symbol.items(), *((c.lower(), c) for c in self.units)]:  # symbols and codes that no word covers
            if code in self.units and not any(re.fullmatch(p, written) for p, _ in known.values()):
                words.setdefault(code, []).append(re.escape(written))
                meant[code] = self.units[code]
        self.meant = list(meant.values())
        one = [f"(?:{'|'.join(words[key])})" for key in meant]
        self.unit = "|".join(f"({p})" for p in one)
        plain = "(?:" + "|".join(one) + ")"
        self.before = {s: c for s, c in self.by_symbol.items() if len(s) > 1 and c in self.units} | {c.lower(): c for c in self.units if len(c) > 2}
        signs = "|".join(sorted(map(re.escape, self.before), key=len, reverse=True))
        self.prefix = re.compile(rf"(?<![\w$/])(?:{signs})\s*$", re.I) if signs else None
        self.reach = max(map(len, self.before), default=0) + 8
        end = r"(?![\w³$/])"
        self.after, self.heading, self.scale_only = {}, {}, {}
        for lang, scales in SCALES.items():
            scale = "|".join(re.escape(w) for w, _ in scales)
            expression = rf"(?:({scale})\s+(?:de\s+|of\s+)?)?(?:{self.unit})"
            self.after[lang] = re.compile(rf"\s*{expression}{end}(?:\s*(?:/|\bpor\b|\bper\b)\s*({plain}){end})?", re.I)
            self.scale_only[lang] = re.compile(rf"\s*({scale}){end}", re.I)
            self.heading[lang] = re.compile(rf"(?:\b(?:en|in)\s+|\(\s*)(?:(?:en|in)\s+)?{expression}{end}", re.I)
        self.exact = re.compile(rf"(?:{self.unit})", re.I)
        self.powers = {lang: dict(scales) for lang, scales in SCALES.items()}
        self.alone: dict[str, Unit | None] = {}

    def unit_of(self, text: str) -> Unit | None:
        """A unit written alone, as in a label: a code, a symbol or a word."""
        t = text.strip()
        if t not in self.alone:
            if len(self.alone) > 100_000:  # bounds what a worker holds; labels are few
                self.alone.clear()
            code = next((c for c in (t, UNIT_LABELS.get(t.upper()), t.upper(), self.by_symbol.get(t.lower())) if c in self.units), None)
            m = None if code else self.exact.fullmatch(t)
            self.alone[t] = self.units[code] if code else self.meant[m.lastindex - 1] if m else None
        return self.alone[t]

    def _power(self, word: str | None, lang: str) -> int:
        return self.powers[lang][" ".join(word.lower().split())] if word else 0

    def in_text(self, text: str, raw: str, lang: str) -> tuple[Unit | None, int]:
        """Unit and scale that ``text`` gives the figure ``raw``: next to it, else in a heading before it."""
        at = find_figure(text, raw)
        if at < 0:
            return None, 0
        before, end = text[:at], at + len(raw)
        m = self.prefix.search(before, max(0, at - self.reach)) if self.prefix and before.rstrip()[-1:] not in ("", ":", ".", "=", "|") else None
        s = self.scale_only[lang].match(text, end)
        if m:
            return self.units[self.before[m[0].strip().lower()]], self._power(s[1], lang) if s else 0
        m = self.after[lang].match(text, end)
        if m:
            which = next(i for i in range(2, len(self.meant) + 2) if m[i] is not None)
            unit, per = self.meant[which - 2], m[len(self.meant) + 2]
            other = self.unit_of(per) if per else None
            return unit.times(other, -1) if other else unit, self._power(m[1], lang)
        if not s and _OTHER_COUNT.match(text, end) and not _NO_COUNT.match(text, end):
            return None, 0  # the figure counts something else
        last = None
        for last in self.heading[lang].finditer(before):
            pass
        scale = self._power(s[1], lang) if s else 0
        if last:
            return self.meant[last.lastindex - 2], max(self._power(last[1], lang), scale)
        return None, scale

    def convert(self, raw: str | None, labels, unit_id: str | None, text: str | None, lang: str | None) -> tuple[str | None, int | None]:
        """Code of the common unit and the value in thousandths of it, or (None, None).

        A unit's power and a scale add up; a scale stated in several places (in the
        unit's own name, by a label, in the text) is one scale and counts once. A
        place that gives both a unit and a scale is read first, then the unit named
        first with the scale that stands alone.
        """
        number = read_number(raw)
        if number is None:
            return None, None
        digits, places = number
        lang = "en" if lang and lang.lower().startswith("en") else "es"
        label_unit, label_scale = None, 0
        for label in labels if labels is not None else ():
            written = str(label).strip() if label is not None else ""
            if written.upper() in SCALE_LABELS:
                label_scale = SCALE_LABELS[written.upper()]
            elif written:
                label_unit = label_unit or self.unit_of(written)
        stated = [(self.units.get(self.by_id.get(unit_id)), 0), (label_unit, label_scale), self.in_text(text, raw, lang) if text else (None, 0)]
        named = [(u, scale) for u, scale in stated if u is not None]
        base = named[0][0].base() if named else None
        if base is None:
            return None, None
        same = [(u, scale) for u, scale in named if u.base() == base]
        unit, scale = next(((u, 0 if u.scale else k) for u, k in same if u.scale or k), (same[0][0], max(k for _, k in stated)))
        milli = (Fraction(digits) * Fraction(10) ** (unit.power + scale - places) + unit.offset) * 1000
        milli = milli if milli.denominator == 1 else Fraction(round(milli))
        return (base, int(milli)) if abs(milli) <= MAX_LONG else (None, None)


def read_number(raw: str | None) -> tuple[int, int] | None:
    """(digits with sign, decimal places) of a figure in either separator habit.

    A point or comma before a last group of three digits separates thousands,
    unless the whole part is 0; otherwise it is the decimal mark.
    """
    if raw is None:
        return None
    text = raw.strip().replace("−", "-").replace(" ", "").replace(" ", "")
    m = re.fullmatch(r"([+-]?)(\d+(?:[.,]\d+)*)", text)
    if not m:
        return None
    groups = re.split(r"[.,]", m[2])
    decimal = len(groups) > 1 and (len(groups[-1]) != 3 or groups[0] == "0")
    sign = -1 if m[1] == "-" else 1
    return sign * int("".join(groups)), len(groups[-1]) if decimal else 0


def convert_quantities(figures: DataFrame, unit_measure: DataFrame) -> DataFrame:
    """Each distinct figure with a known unit, in its common unit.

    Returns (``occurrence_id``, ``base_unit_code``, ``base_milli``); figures
    without a unit, unreadable ones and null ids drop out; a repeated figure gives
    one row. The unit catalogue is a fixed table of a few dozen rows and is parsed
    once into the grammar; the figures stream through one Arrow-batched pass.
    """
    catalogue = [tuple(r) for r in unit_measure.select("unit_measure_id", "base_unit_measure_id", "code", "symbol", "multiplier_power10", "name").limit(10_001).collect()]
    if len(catalogue) > 10_000:
        raise ValueError("unit_measure is meant to be a small catalogue")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = UnitGrammar(catalogue)
        for b in batches:
            out = [(i, *grammar.convert(*rest)) for i, *rest in zip(*(b.column(c).to_pylist() for c in range(6)))]
            found = list(zip(*(o for o in out if o[1] is not None))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.string()), pa.array(found[2], pa.int64())], ["occurrence_id", "base_unit_code", "base_milli"])

    rows = figures.where("occurrence_id IS NOT NULL").select(F.col("occurrence_id").cast("long"), "raw", "units", "unit_measure_id", "context_text", "lang")
    found = rows.mapInArrow(run, "occurrence_id long, base_unit_code string, base_milli long")
    return found.groupBy("occurrence_id").agg(F.min(F.struct("base_unit_code", "base_milli")).alias("v")).select("occurrence_id", "v.base_unit_code", "v.base_milli")
