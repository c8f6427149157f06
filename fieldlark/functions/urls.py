"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Authority, with port and user; empty without one."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def parent(url: Column) -> Column:
    """Origin and path up to its last slash."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(origin(url), F.regexp_extract(path, r"^(.*/)", 1))


def is_pdf_response(content_type: Column, url: Column) -> Column:
    u = F.lower(url)
    hints = (F.contains(u, F.lit("/pdf")) | F.contains(u, F.lit("download"))) & F.contains(u, F.lit("pdf"))
    return F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("application/pdf")) | u.endswith(".pdf") | hints


def is_probable_pdf(url: Column) -> Column:
    u = F.lower(url)
    return u.endswith(".pdf") | F.contains(u, F.lit("contenttype=pdf")) | F.contains(u, F.lit("format=pdf"))


def publication_title(url: Column) -> Column:
    """Title in the slug of a publication page: ``/publication/<number>_<title>``."""
    slug = F.regexp_extract(url, r"/publication/\d+_([^/?#]+)", 1)
    # an escape that is none stands for itself
    plain = F.regexp_replace(slug, "%(?![0-9A-Fa-f]{2})", "%25")
    words = F.trim(F.regexp_replace(F.coalesce(F.try_url_decode(plain), slug), r"[_+ ]+", " "))
    return F.trim(F.regexp_replace(words, r"\s*\(\d{4}\)\s*$", ""))


def crossref_doi(reply: Column) -> Column:
    """The DOI of the first item that has one."""
    items = F.from_json(reply, "message struct<items:array<struct<DOI:string>>>")["message"]["items"]
    return F.get(F.filter(F.transform(items, lambda i: F.nullif(i["DOI"], F.lit(""))), lambda d: d.isNotNull()), F.lit(0))


def unpaywall_url(reply: Column) -> Column:
    best = F.from_json(reply, "best_oa_location struct<url_for_pdf:string,url:string>")["best_oa_location"]
    return first_open(best["url_for_pdf"], best["url"])


def openalex_url(reply: Column) -> Column:
    """Of the first result that has one: the best open place, or the primary one if its source is open."""
    schema = "results array<struct<best_oa_location:struct<url:string>,primary_location:struct<pdf_url:string,landing_page_url:string,source:struct<is_oa:boolean>>>>"

    def of(r: Column) -> Column:
        first = r["primary_location"]
        return first_open(r["best_oa_location"]["url"], F.when(first["source"]["is_oa"], first_open(first["pdf_url"], first["landing_page_url"])))

    found = F.transform(F.from_json(reply, schema)["results"], of)
    return F.get(F.filter(found, lambda u: u.isNotNull()), F.lit(0))


def wayback_url(reply: Column) -> Column:
    closest = F.from_json(reply, "archived_snapshots struct<closest:struct<available:boolean,url:string>>")["archived_snapshots"]["closest"]
    return F.when(closest["available"], F.nullif(closest["url"], F.lit("")))


def open_version(url: Column, crossref: Column, unpaywall: Column, openalex: Column, wayback_doi: Column, wayback_page: Column) -> Column:
    """The open version of a publication page from the replies of the services, in their order.

    Without a title in the URL only the archive of the page counts; with one, what the DOI leads to, then
    what the title leads to, then the archive of the DOI's page, or of the page itself without a DOI.
    """
    title, doi = F.nullif(publication_title(url), F.lit("")), crossref_doi(crossref)
    archived = F.when(doi.isNotNull(), wayback_url(wayback_doi)).otherwise(wayback_url(wayback_page))
    return F.when(title.isNull(), wayback_url(wayback_page)).otherwise(F.coalesce(F.when(doi.isNotNull(), unpaywall_url(unpaywall)), openalex_url(openalex), archived))


def first_open(*candidates: Column) -> Column:
    """The first open version that is known, of candidates in order of preference."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in candidates))
