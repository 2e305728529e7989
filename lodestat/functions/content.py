"""Bodies of responses: decoding, sniffing, digests, publication dates."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions.urls import ENCODINGS

#: Byte-order marks.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))
#: Patterns of a declared charset, a meta tag and a sha-256 member of a digest header.
_CHARSET = re.compile(r"""\bcharset\s*=\s*(?:"([^"]+)"|'([^']+)'|([^;\s>"']+))""", re.I)
_META = re.compile(r"<meta\b[^>]{0,1000}>", re.I)
_SHA_MEMBER = r"(?i)(?:^|,)\s*sha-256\s*=\s*:([A-Za-z0-9+/]*={0,2}):(?:\s*;[^,]*)?(?=\s*(?:,|$))"


def _declared(text: str | None) -> str | None:
    m = _CHARSET.search(text or "")
    name = next((g for g in m.groups() if g), "").strip().lower() if m else ""
    return name if name and len(name) <= 100 else None


def decode_body(body: bytes, content_type: str | None) -> tuple[str, str, str, int]:
    """(text, encoding, what selected it, replaced characters): mark, header, page, then UTF-8 or windows-1252."""
    header = _declared(content_type)
    page = None
    if "html" in (content_type or ""):
        page = next((n for n in map(_declared, _META.findall(body[:8192].decode("latin-1"))) if n), None)
    mark = next((e for m, e in MARKS if body.startswith(m)), None)
    if mark:
        encoding, by = mark, "BOM"
    elif header in ENCODINGS:
        encoding, by = ENCODINGS[header], "HTTP_HEADER"
    elif page in ENCODINGS:
        encoding, by = ENCODINGS[page], "HTML_META"
    elif header or page:
        encoding, by = "utf-8", "UNSUPPORTED_DECLARATION_FALLBACK"
    else:
        try:
            body.decode("utf-8")
            encoding, by = "utf-8", "DEFAULT"
        except UnicodeDecodeError:
            encoding, by = "windows-1252", "INVALID_UTF8_WINDOWS_1252_FALLBACK"
    if encoding == "windows-1252":
        text = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in body)
    else:
        text = body.decode({"utf-8": "utf-8-sig", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be"}[encoding], "replace").removeprefix("﻿")
    return text, encoding, by, text.count("�")


def _is_json(body: bytes) -> bool:
    try:
        json.loads(body)
    except ValueError:
        return False
    return True


_TEXTUAL = re.compile(r"^text/|application/(?:json|xml|xhtml\+xml)")
_MARKUP = re.compile(r"\A<!doctype\s+html|\A<html\b|<head\b|<body\b", re.I)


def _binary(body: bytes, assumed: str) -> bool:
    sample = body[:4096]
    return bool(_TEXTUAL.search(assumed)) and sum(b < 32 and b not in (9, 10, 12, 13) for b in sample) > len(sample) / 100


#: What a body looks like, the first that holds: (media type, test of body, declared type and first characters).
_LOOKS = (
    ("application/pdf", lambda body, assumed, start: body.startswith(b"%PDF-")),
    ("application/octet-stream", lambda body, assumed, start: _binary(body, assumed)),
    ("text/html", lambda body, assumed, start: _MARKUP.search(start) is not None),
    ("application/json", lambda body, assumed, start: start[:1] in ("{", "[") and _is_json(body)),
)


def sniff(body: bytes, declared: str | None) -> tuple[str, str]:
    """(effective media type, MATCHED, SNIFFED_OVERRIDE or UNDECLARED)."""
    kind = (declared or "").split(";")[0].strip().lower()
    start = body[:1024].decode("utf-8", "replace").lstrip()
    real = next((media for media, looks in _LOOKS if looks(body, kind or "text/plain", start)), kind or "text/plain")
    return real, "UNDECLARED" if not kind else "MATCHED" if kind == real else "SNIFFED_OVERRIDE"


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("selected_by", T.StringType()), T.StructField("replaced", T.IntegerType())]))
def decoded(body: pd.Series, content_type: pd.Series) -> pd.DataFrame:
    """F33 as an Arrow UDF; a null body is empty."""
    return pd.DataFrame([decode_body(bytes(b or b""), c) for b, c in zip(body, content_type)], columns=["text", "encoding", "selected_by", "replaced"])


@F.pandas_udf(T.StructType([T.StructField("media_type", T.StringType()), T.StructField("status", T.StringType())]))
def sniffed(body: pd.Series, declared: pd.Series) -> pd.DataFrame:
    """F34 as an Arrow UDF; a null body is empty."""
    return pd.DataFrame([sniff(bytes(b or b""), d) for b, d in zip(body, declared)], columns=["media_type", "status"])


def digest_status(header: Column, body: Column, content_encoding: Column) -> Column:
    """a Content-Digest header against the body: MATCHED, MISMATCHED, ENCODED_NOT_COMPARABLE, UNDECLARED, UNSUPPORTED or INVALID."""
    found = F.regexp_extract_all(header, F.lit(_SHA_MEMBER), 1)
    value = F.try_element_at(found, F.lit(1))
    actual = F.base64(F.unhex(F.sha2(body, 256)))
    return (
        F.when(header.isNull() | (F.trim(header) == ""), "UNDECLARED").when((F.length(header) > 500) | header.rlike(r"[\x00-\x1f\x7f]"), "INVALID")
        .when(F.size(found) == 0, F.when(header.rlike(r"(?i)sha-256\s*="), "INVALID").otherwise("UNSUPPORTED"))
        .when((F.size(found) > 1) | ~value.rlike("^[A-Za-z0-9+/]{43}=$"), "INVALID")
        .when(F.coalesce(F.lower(F.trim(content_encoding)), F.lit("identity")) != "identity", "ENCODED_NOT_COMPARABLE")
        .when(value == actual, "MATCHED").otherwise("MISMATCHED")
    )


def stored_status(content: Column, sha256: Column, size: Column) -> Column:
    """Stored base64 content against its size and SHA-256: OK, INVALID, SIZE or HASH."""
    compact = F.regexp_replace(content, r"\s+", "")
    body = F.try_to_binary(compact, F.lit("base64"))
    return F.when(body.isNull() | ~compact.rlike("^[A-Za-z0-9+/]*={0,2}$"), "INVALID").when(F.octet_length(body) != size, "SIZE").when(F.sha2(body, 256) != sha256, "HASH").otherwise("OK")


def calendar_date(text: Column) -> Column:
    """the valid date that a text starts with."""
    return F.try_to_date(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")


def _moment(text: Column) -> Column:
    x = F.trim(text)
    day = calendar_date(x)
    zoned = x.rlike(r"^\d{4}-\d{2}-\d{2}T.+(Z|[+-]\d{2}:\d{2})$")
    at = F.when(zoned, F.unix_micros(x.try_cast("timestamp")))
    return F.when(day.isNotNull() & (x.rlike(r"^\d{4}-\d{2}-\d{2}$") | at.isNotNull()), F.struct(day.alias("day"), at.alias("at")))


def _same(a: Column, b: Column) -> Column:
    return F.when(a["at"].isNotNull() & b["at"].isNotNull(), a["at"] == b["at"]).otherwise(a["day"] == b["day"])


def publication_assessment(published: Column, declared: Column) -> Column:
    """a claim's publication date against those of its source: MATCHED, CONTRADICTED, AMBIGUOUS or UNAVAILABLE."""
    mine = _moment(published)
    theirs = F.filter(F.transform(F.coalesce(declared, F.array().cast("array<string>")), _moment), lambda m: m.isNotNull())
    split = F.exists(theirs, lambda a: F.exists(theirs, lambda b: ~_same(a, b)))
    hits, misses = F.exists(theirs, lambda m: _same(mine, m)), F.exists(theirs, lambda m: ~_same(mine, m))
    return F.when(F.size(theirs) == 0, "UNAVAILABLE").when(mine.isNull(), "CONTRADICTED").when(split | (hits & misses), "AMBIGUOUS").when(hits, "MATCHED").otherwise("CONTRADICTED")


def pdf_date(text: Column) -> Column:
    """the valid date of a PDF date string."""
    return F.try_to_date(F.regexp_extract(text, r"^(?:D:)?(\d{8})", 1), "yyyyMMdd")


#: Spanish month names.
SPANISH_MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()


def spanish_dates(text: Column) -> Column:
    """the valid long Spanish dates of a text, in order, such as 5 de marzo de 2024 or 5 de marzo 2024."""
    pattern = r"(\d{1,2})\s+de\s+(\p{L}+)\s+(?:de\s+)?(\d{4})"
    names = F.array(*map(F.lit, SPANISH_MONTHS))

    def day(written: Column) -> Column:
        part = lambda i: F.regexp_extract(written, pattern, i)
        month = F.array_position(names, F.regexp_replace(part(2), "^setiembre$", "septiembre"))
        return F.try_to_date(F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(1), 2, "0")), "yyyy-MM-dd")

    return F.filter(F.transform(F.regexp_extract_all(F.lower(text), F.lit(pattern), 0), day), lambda x: x.isNotNull())


def table_reading(html: Column, labels: list[str]) -> Column:
    """The number in the table cell that follows the cells with the given labels."""
    cells = r"\s*</td>\s*<td[^>]*>\s*".join(r"\Q" + x + r"\E" for x in labels)
    return F.nullif(F.regexp_extract(html, rf"(?i)<td[^>]*>\s*{cells}\s*</td>\s*<td[^>]*>\s*([0-9][0-9.]*)\s*</td>", 1), F.lit("")).try_cast("decimal(18,6)")
