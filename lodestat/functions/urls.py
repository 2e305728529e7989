"""URLs and response metadata as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts of loopback and metadata services.
BLOCKED_HOSTS = ("localhost", "localhost.localdomain", "metadata.google.internal", "instance-data")


def _private_v4(host: Column) -> Column:
    octet = [F.split_part(host, F.lit("."), F.lit(i)).try_cast("int") for i in (1, 2)]
    over = F.exists(F.split(host, r"\."), lambda o: o.try_cast("int") > 255)
    first, second = octet
    private = (
        over | first.isin(0, 10, 127) | ((first == 172) & second.between(16, 31)) | ((first == 192) & (second == 168))
        | ((first == 169) & (second == 254)) | ((first == 100) & second.between(64, 127)) | (first >= 224)
    )
    return host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & private


def _private_v6(host: Column) -> Column:
    address = F.regexp_replace(host, r"[\[\]]", "")
    return address.contains(":") & (address.isin("::1", "::") | address.rlike("^(fc|fd|fe80|::ffff:)"))


def unsafe_reason(url: Column) -> Column:
    """why a location may not be cited: INVALID, PROTOCOL, LOOPBACK, PRIVATE or UNQUALIFIED; null if it may."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return (
        F.when(url.isNull() | (scheme == "") | url.rlike(r"\s"), "INVALID")
        .when(~scheme.isin("http", "https"), "PROTOCOL")
        .when((host == "") | host.isin(*BLOCKED_HOSTS), "LOOPBACK")
        .when(_private_v4(host) | _private_v6(host), "PRIVATE")
        .when(~host.contains("."), "UNQUALIFIED")
    )


def tracking_free(url: Column) -> Column:
    """a URL without fragment and tracking parameters, its other parameters sorted."""
    bare = F.split_part(url, F.lit("#"), F.lit(1))
    path, query = F.split_part(bare, F.lit("?"), F.lit(1)), F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(r"^(utm_[^=]+|fbclid|gclid)(=|$)")))
    return F.concat(path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def extension(content_type: Column) -> Column:
    """file extension of a media type."""
    kind = F.lower(content_type)
    return F.when(kind.contains("html"), "html").when(kind.contains("json"), "json").when(kind.contains("xml"), "xml").when(kind.contains("pdf"), "pdf").when(kind.startswith("text/"), "txt").otherwise("bin")


def body_length(declared: Column, body: Column) -> Column:
    """the declared body length against the actual one: MATCHED, CONTRADICTED, INVALID or UNAVAILABLE."""
    number = declared.try_cast("long")
    return F.when(declared.isNull() | body.isNull(), "UNAVAILABLE").when(~declared.rlike("^[0-9]+$") | number.isNull(), "INVALID").when(number == F.octet_length(body), "MATCHED").otherwise("CONTRADICTED")


#: Names of encodings and what they are decoded with.
ENCODINGS = {
    "utf-8": "utf-8", "utf8": "utf-8", "windows-1252": "windows-1252", "cp1252": "windows-1252", "iso-8859-1": "windows-1252",
    "latin1": "windows-1252", "utf-16": "utf-16le", "utf-16le": "utf-16le", "utf-16be": "utf-16be",
}


def charset(http: Column, meta: Column) -> tuple[Column, Column]:
    """F33 from the declarations: (encoding, what it was selected by): the header before the page's own, else UTF-8."""
    names = F.create_map(*(F.lit(x) for pair in ENCODINGS.items() for x in pair))
    head, page = (F.try_element_at(names, F.lower(F.trim(c))) for c in (http, meta))
    by = F.when(head.isNotNull(), "HTTP_HEADER").when(page.isNotNull(), "HTML_META").when(http.isNotNull() | meta.isNotNull(), "UNSUPPORTED_DECLARATION_FALLBACK").otherwise("DEFAULT")
    return F.coalesce(head, page, F.lit("utf-8")), by
