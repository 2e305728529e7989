import hashlib
import os
import re
from html.parser import HTMLParser

import pytest

from lodestat.plans import registry
from tests.oracle import difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, name):
    mine, theirs = difference(spark, FOLDER, registry.QUERIES[name], registry.SQL[name])
    assert not mine and not theirs


def _rows(spark, name):
    return [tuple(r) for r in registry.QUERIES[name](spark, FOLDER).collect()]


def _table(name, columns, where="true"):
    import duckdb

    return duckdb.sql(f"SELECT DISTINCT {columns} FROM '{FOLDER}/{name}.parquet' WHERE {where}").fetchall()


class _Visible(HTMLParser):
    """The standard library's view of a page, for comparison."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.hidden = [], None

    def handle_starttag(self, tag, attrs):
        self.out.append(" ")
        if self.hidden is None and tag in ("script", "style", "template", "noscript"):
            self.hidden = tag

    def handle_endtag(self, tag):
        self.out.append(" ")
        self.hidden = None if tag == self.hidden else self.hidden

    def handle_comment(self, data):
        self.out.append(" ")

    def handle_data(self, data):
        self.out += [data] if self.hidden is None else []

    def handle_entityref(self, name):
        self.handle_data({"nbsp": " ", "amp": "&", "quot": '"'}.get(name, f"&{name};"))

    def handle_charref(self, name):
        self.handle_data({"160": " ", "38": "&", "34": '"'}.get(name, f"&#{name};"))


def test_visible_text_of_marked_up_documents(spark):
    found = dict(_rows(spark, "visible_text"))
    marked = {i: t for i, t in _table("documents", "doc_id, text", "text IS NOT NULL") if re.search(r"</[a-z]+>\s*$", t) and not re.search(r"<[^a-z/!]|&(?!(?:nbsp|amp|quot|#160|#38|#34);)|<$", t)}
    for i, t in marked.items():
        p = _Visible()
        p.feed(t)
        p.close()
        assert found[i] == hashlib.md5(re.sub(r"\s+", " ", "".join(p.out)).strip().encode()).hexdigest(), t[:200]
    assert marked and len(found) == len(_table("documents", "doc_id", "text IS NOT NULL"))


def test_decoded_and_sniffed_bodies(spark):
    bodies = _table("source_response", "response_id, declared_content_type, text", "text IS NOT NULL")
    decoded = {i: x for i, *x in _rows(spark, "decoded_bodies")}
    sniffed = {i: x for i, *x in _rows(spark, "sniffed_types")}
    assert decoded.keys() == sniffed.keys() == {b[0] for b in bodies}
    for i, declared, text in bodies:
        if not declared:
            assert decoded[i][:2] == ["utf-8", "BOM" if text.startswith("\ufeff") else "DEFAULT"] and decoded[i][2] == text.count("\ufffd") and sniffed[i][1] == "UNDECLARED"
        elif sniffed[i][1] == "MATCHED":
            assert sniffed[i][0] == declared.split(";")[0].strip().lower()
        if re.match(r"\s*<(!doctype\s+html|html\b)", text, re.I):
            assert sniffed[i][0] == "text/html"


def test_figures_of_excerpts(spark):
    excerpts = dict(_table("candidate", "candidate_id, excerpt", "excerpt IS NOT NULL"))
    found = _rows(spark, "number_occurrences")
    assert found and all(raw in excerpts[i] for i, raw, *_ in found)
    plain = {i: re.findall(r"(?<![\w.,])\d{1,2}(?= por ciento| percent)", t) for i, t in excerpts.items()}
    values = {(i, raw) for i, raw, value, units in found if "PERCENT" in units}
    assert all((i, raw) in values for i, raws in plain.items() for raw in raws)
    both = dict(_table("candidate", "candidate_id, assertion", "assertion IS NOT NULL AND excerpt IS NOT NULL"))
    lost = _rows(spark, "ungrounded_numbers")
    assert all(raw in both[i] for i, raw in lost if i in both) and not {i for i, _ in lost} & {i for i, t in both.items() if t == excerpts[i]}


def test_wording_of_excerpts(spark):
    found = {i: x for i, *x in _rows(spark, "lexical_grounding")}
    rows = {i: (a, e) for i, a, e in _table("candidate", "candidate_id, assertion, excerpt")}
    assert found.keys() == rows.keys() and all(0 <= x[1] <= 1 for x in found.values() if x[1] is not None)
    assert all(found[i][0] == "SUPPORTED" for i, (a, e) in rows.items() if a and a == e and len(re.findall(r"[a-z]{5,}", a)) > 3 and not re.search(r"\b(no|sin|not|without)\b", a, re.I))


def test_page_metadata(spark):
    found = {i: x for i, *x in _rows(spark, "html_metadata")}
    texts = dict(_table("documents", "doc_id, text", "text IS NOT NULL"))
    assert found.keys() == texts.keys() and all(not any(found[i]) for i, t in texts.items() if "<meta" not in t.lower() and "<link" not in t.lower() and "ld+json" not in t.lower() and "<time" not in t.lower())


@pytest.mark.parametrize(("name", "base", "key"), [("p2_found", "numeric_occurrence", "occurrence_id"), ("p6_found", "source_response", "response_id")])
def test_dealt_rows_belong_to_records(spark, name, base, key):
    rows = registry.QUERIES[name](spark, FOLDER)
    ids = {r[0] for r in (rows if name == "p2_found" else rows.where("field <> 'published_at'")).select("occurrence_id" if name == "p2_found" else "record_id").collect()}
    known = {r[0] for r in _table(base, key)}
    assert ids <= known and len(ids) > 0.8 * len(known)


def test_every_query_without_sql_is_tested_here():
    assert set(registry.QUERIES) - set(registry.SQL) == {"visible_text", "html_metadata", "lexical_grounding", "number_occurrences", "ungrounded_numbers", "decoded_bodies", "sniffed_types", "p2_found", "p6_found"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
