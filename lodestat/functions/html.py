"""Metadata of HTML pages: publishers, dates, canonical and article links (F23, F26-F29), as Arrow UDFs."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions.text import scan_visible

#: Meta names of publishers (in the order they are reported) and of publication dates.
PUBLISHER_KEYS = ("og:site_name", "publisher", "article:publisher")
DATE_KEYS = ("article:published_time", "datepublished", "publishdate", "pubdate", "dc.date", "dc.date.issued")
#: Bounds of the structured data that is walked.
JSON_CHARS, JSON_NODES, JSON_DEPTH, VALUE_CHARS = 100_000, 500, 10, 500

_STRINGS = T.ArrayType(T.StringType())


class _Page(HTMLParser):
    """Collects meta, time and link values outside templates, structured data, and links with their labels."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: list[tuple[str, str]] = []
        self.canonical: list[str] = []
        self.data: list[str] = []
        self.links: list[tuple[str, str]] = []
        self._json: list[str] | None = None
        self._anchor: tuple[str, list[str]] | None = None
        self._hidden = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: (v or "").strip() for k, v in attrs}
        if tag == "template":
            self._hidden += 1
        elif tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self._json = []
        elif tag == "a" and a.get("href"):
            self._anchor = (a["href"], [])
        elif tag in ("meta", "time", "link") and not self._hidden:
            if tag == "link" and "canonical" in a.get("rel", "").lower().split() and a.get("href"):
                self.canonical.append(a["href"])
            value = a.get("content", a.get("datetime"))
            if value:
                self.meta.append((a.get("property", a.get("name", a.get("itemprop", ""))).lower(), value))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("meta", "time", "link"):
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "template":
            self._hidden = max(0, self._hidden - 1)
        elif tag == "script" and self._json is not None:
            self.data.append("".join(self._json).strip())
            self._json = None
        elif tag == "a" and self._anchor:
            self.links.append((self._anchor[0], "".join(self._anchor[1])))
            self._anchor = None

    def handle_data(self, data: str) -> None:
        if self._json is not None:
            self._json.append(data)
        elif self._anchor:
            self._anchor[1].append(data)


def _page(html: str) -> _Page:
    page = _Page()
    page.feed(html)
    return page


def structured_values(blocks: list[str]) -> tuple[list[str], list[str], list[str]]:
    """(publishers, dates, urls) of JSON-LD blocks, over a bounded number of nodes."""
    publishers, dates, urls = {}, {}, {}
    left = JSON_NODES

    def text(value) -> str | None:
        return value.strip() if isinstance(value, str) and value.strip() and len(value) <= VALUE_CHARS else None

    for block in blocks:
        if len(block) > JSON_CHARS:
            continue
        try:
            stack = [(json.loads(block), 0)]
        except ValueError:
            continue
        while stack:
            node, depth = stack.pop()
            if depth > JSON_DEPTH or left <= 0:
                continue
            if isinstance(node, list):
                stack += [(x, depth + 1) for x in reversed(node)]
            elif isinstance(node, dict):
                left -= 1
                maker, subject = node.get("publisher"), node.get("mainEntityOfPage")
                found = (
                    (dates, text(node.get("datePublished"))),
                    (publishers, text(maker) or (text(maker.get("name")) if isinstance(maker, dict) else None)),
                    (urls, text(subject) or (text(subject.get("@id", subject.get("url"))) if isinstance(subject, dict) else None)),
                )
                for where, value in found:
                    if value:
                        where[value] = None
                stack += [(node[k], depth + 1) for k in ("mainEntity", "@graph") if k in node]
    return list(publishers), list(dates), list(urls)


def page_metadata(html: str | None) -> dict[str, list[str]]:
    """publishers, publication dates and canonical URLs of a page, each once."""
    page = _page(html or "")
    makers, dates, urls = structured_values(page.data)
    named = [v for key in PUBLISHER_KEYS for k, v in page.meta if k == key and not re.match("https?://", v, re.I)]
    return {
        "publishers": list(dict.fromkeys(named + makers)),
        "publication_dates": list(dict.fromkeys(dates + [v for k, v in page.meta if k in DATE_KEYS])),
        "canonical_urls": list(dict.fromkeys(urls + page.canonical)),
    }


#: Ports that need not be written.
_USUAL = {"http": 80, "https": 443}


def canonical_url(candidates: list[str], base: str) -> str | None:
    """the first canonical URL on the page's own host (www aside), without credentials, downgrade or change of port."""
    here = urlsplit(base)
    for value in candidates:
        try:
            url = urljoin(base, value)
            there = urlsplit(url)
            port = there.port or _USUAL.get(there.scheme)
        except ValueError:
            continue
        same = (there.hostname or "").removeprefix("www.") == (here.hostname or "").removeprefix("www.")
        if there.scheme in ("http", "https") and same and there.username is None and there.password is None and not (here.scheme == "https" and there.scheme != "https") and (port == (here.port or _USUAL.get(here.scheme)) or there.port is None and here.port is None):
            return url
    return None


def article_link(html: str, base: str, title: str) -> str | None:
    """of the links whose label contains the title or is contained in it, the one nearest in length."""
    even = lambda s: re.sub(r"\s+", " ", scan_visible(s)).strip().lower()
    want, best = even(title), None
    for href, label in _page(html).links:
        label = even(label)
        if label and (want in label or label in want):
            try:
                url = urljoin(base, href)
            except ValueError:
                continue
            if urlsplit(url).scheme in ("http", "https") and url != base and (best is None or abs(len(label) - len(want)) < best[0]):
                best = (abs(len(label) - len(want)), url)
    return best[1] if best else None


@F.pandas_udf(T.StructType([T.StructField("publishers", _STRINGS), T.StructField("publication_dates", _STRINGS), T.StructField("canonical_urls", _STRINGS)]))
def html_metadata(html: pd.Series) -> pd.DataFrame:
    """F26 as an Arrow UDF; a null page has empty lists."""
    return pd.DataFrame([page_metadata(h) for h in html], columns=["publishers", "publication_dates", "canonical_urls"])


@F.pandas_udf(T.StringType())
def accepted_canonical(candidates: pd.Series, base: pd.Series) -> pd.Series:
    """F29 as an Arrow UDF; null without a base or an acceptable candidate."""
    return pd.Series([canonical_url(list(c), b) if b and c is not None else None for c, b in zip(candidates, base)], dtype=object)
