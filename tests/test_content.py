import base64
import hashlib
from datetime import date

import pytest
from pyspark.sql import functions as F

from lodestat.functions import content as N
from lodestat.functions import html as H

PAGE = """<html><head><meta property="og:site_name" content="Diario Uno"><meta name="publisher" content="https://x.example"><meta itemprop="datePublished" content="2024-03-05">
<link rel="alternate canonical" href="/nota/1"><script type="application/ld+json">{"@graph":[{"publisher":{"name":"Casa Dos"},"datePublished":"2024-03-05T10:00:00Z","mainEntityOfPage":{"@id":"https://diario.example/nota/1"}}]}</script>
<script>var a = '<meta name="publisher" content="No">';</script><template><meta name="publisher" content="Tampoco"></template></head>
<body><a href="/otra">Otra nota</a><a href="/nota/1"><b>Sube el pan</b> hoy</a><a href="javascript:x">Sube el pan</a></body></html>"""


def test_page_metadata():
    got = H.page_metadata(PAGE)
    assert got["publishers"] == ["Diario Uno", "Casa Dos"] and got["publication_dates"] == ["2024-03-05T10:00:00Z", "2024-03-05"]
    assert got["canonical_urls"] == ["https://diario.example/nota/1", "/nota/1"]
    assert H.page_metadata(None) == H.page_metadata("") == H.page_metadata("<meta name=") == {"publishers": [], "publication_dates": [], "canonical_urls": []}


@pytest.mark.parametrize(
    ("candidate", "want"),
    [("/a", "https://www.d.example/a"), ("https://d.example/a", "https://d.example/a"), ("http://d.example/a", None), ("https://u:p@d.example/a", None), ("https://e.example/a", None), ("https://d.example:8443/a", None), ("http://[bad", None)],
)
def test_canonical(candidate, want):
    assert H.canonical_url([candidate], "https://www.d.example/x") == want


def test_article_link():
    assert H.article_link(PAGE, "https://diario.example/", "Sube el pan hoy") == "https://diario.example/nota/1" and H.article_link(PAGE, "https://diario.example/", "Nada") is None


def test_structured_data_is_bounded():
    deep = '{"mainEntity":' * 30 + '{"datePublished":"x"}' + "}" * 30
    assert H.structured_values([deep, "{bad", "[" * 5, '{"datePublished":"y"}'])[1] == ["y"]


@pytest.mark.parametrize(
    ("body", "kind", "want"),
    [
        ("á".encode(), None, ("á", "utf-8", "DEFAULT", 0)), ("á".encode("cp1252"), None, ("á", "windows-1252", "INVALID_UTF8_WINDOWS_1252_FALLBACK", 0)), (b"\xff\xfea\x00", "text/html; charset=utf-8", ("a", "utf-16le", "BOM", 0)),
        (b"\xe1", "text/html; charset=latin1", ("á", "windows-1252", "HTTP_HEADER", 0)), (b'<meta charset="cp1252">\xe1', "text/html", ('<meta charset="cp1252">á', "windows-1252", "HTML_META", 0)),
        (b"\xe1", "text/plain; charset=klingon", ("�", "utf-8", "UNSUPPORTED_DECLARATION_FALLBACK", 1)), (b"", None, ("", "utf-8", "DEFAULT", 0)),
    ],
)
def test_decoding(body, kind, want):
    assert N.decode_body(body, kind) == want


@pytest.mark.parametrize(
    ("body", "declared", "want"),
    [(b"%PDF-1.7", "text/html", ("application/pdf", "SNIFFED_OVERRIDE")), (b"<html>", "text/html; charset=x", ("text/html", "MATCHED")), (b'{"a":1}', None, ("application/json", "UNDECLARED")), (b"{not", "text/plain", ("text/plain", "MATCHED")), (b"\x00" * 200, "text/plain", ("application/octet-stream", "SNIFFED_OVERRIDE"))],
)
def test_sniffing(body, declared, want):
    assert N.sniff(body, declared) == want


def test_columns(spark):
    body = b"datos"
    good = base64.b64encode(hashlib.sha256(body).digest()).decode()
    rows = [(f"sha-256=:{good}:", None), (f"sha-256=:{good}:", "gzip"), (f"sha-256=:{'A' * 43}=:", None), (None, None), ("md5=:x:", None), ("sha-256=:zz:", None), (f"sha-256=:{good}:, sha-256=:{good}:", None)]
    df = spark.createDataFrame([(i, h, e, bytearray(body)) for i, (h, e) in enumerate(rows)], "i int, h string, e string, b binary")
    assert [r[1] for r in df.select("i", N.digest_status(F.col("h"), F.col("b"), F.col("e"))).orderBy("i").collect()] == ["MATCHED", "ENCODED_NOT_COMPARABLE", "MISMATCHED", "UNDECLARED", "UNSUPPORTED", "INVALID", "INVALID"]
    sha = hashlib.sha256(body).hexdigest()
    stored = spark.createDataFrame([(base64.b64encode(body).decode(), sha, 5), ("ZGF0b3M=", sha, 4), ("ZGF0b3M=", "0", 5), ("!!", sha, 5)], "c string, s string, n int")
    assert [r[0] for r in stored.select(N.stored_status(F.col("c"), F.col("s"), F.col("n"))).collect()] == ["OK", "SIZE", "HASH", "INVALID"]
    dates = spark.createDataFrame([("D:20240305120000", "5 de marzo de 2024"), ("20240230", "31 de febrero 2024"), (None, "x")], "p string, s string")
    assert [tuple(r) for r in dates.select(N.pdf_date(F.col("p")), N.spanish_dates(F.col("s"))).collect()] == [(date(2024, 3, 5), [date(2024, 3, 5)]), (None, []), (None, [])]
    page = spark.createDataFrame([("<tr><td>DÓLAR</td> <td align=r>USD</td><td>6.96</td></tr>",)], "h string")
    assert float(page.select(N.table_reading(F.col("h"), ["DÓLAR", "USD"])).first()[0]) == 6.96


@pytest.mark.parametrize(
    ("mine", "declared", "want"),
    [("2024-03-05", ["2024-03-05T10:00:00Z"], "MATCHED"), ("2024-03-05T10:00:00Z", ["2024-03-05T06:00:00-04:00"], "MATCHED"), ("2024-03-05", ["2024-03-06"], "CONTRADICTED"), ("2024-03-05", ["2024-03-05", "2024-03-06"], "AMBIGUOUS"), ("2024-03-05", ["ayer"], "UNAVAILABLE"), ("2024-03-05", None, "UNAVAILABLE"), (None, ["2024-03-05"], "CONTRADICTED"), ("2024-02-30", ["2024-03-05"], "CONTRADICTED")],
)
def test_publication_assessment(spark, mine, declared, want):
    df = spark.createDataFrame([(mine, declared)], "m string, d array<string>")
    assert df.select(N.publication_assessment(F.col("m"), F.col("d"))).first()[0] == want
