"""URL functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lists

TRACKING = r"^(utm_.*|fbclid|gclid)$"


def host(url: Column) -> Column:
    """Host without port and one leading ``www.``; as written, not lower-cased."""
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^www\.", "")


def _recoded(part: Column) -> Column:
    """Decodes and encodes a query key or value again: space as +, ~ as it is, * escaped."""
    return F.regexp_replace(F.regexp_replace(F.url_encode(F.try_url_decode(part)), r"\*", "%2A"), "%7E", "~")


def normalize(url: Column) -> Column:
    """One spelling for a page: https, lower-case host without ``www.`` and then ``m.``, no tracking keys, query sorted by key, no fragment, no slash at the end.

    A URL without a scheme or host gets https all the same (``example.org/x`` is a path); what cannot be parsed comes back unchanged.
    """
    authority = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    authority = F.regexp_replace(F.regexp_replace(authority, r"^www\.", ""), r"^m\.", "")
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p, i: F.struct(_recoded(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), _recoded(F.regexp_extract(p, "=(.*)$", 1)).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["k"].rlike(TRACKING)))
    encoded = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), encoded)).otherwise("")
    bare = F.regexp_extract(url, r"^([^?#]*)", 1)
    opaque = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*:([^/].*)$", 1)
    rootless = F.when(opaque != "", F.concat(F.lit("https:"), opaque)).when(bare == "", "https:")
    rootless = rootless.otherwise(F.concat(F.lit("https://"), F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*:/{0,2}(?=/|$)", "")))
    full = F.concat(F.when(authority == "", rootless).otherwise(F.concat(F.lit("https://"), authority, path)), tail)
    broken = url.rlike(r"[\x00-\x1f\x7f]|^:|^[^A-Za-z/?#][^/?#]*:|^[^:/?#]*[^A-Za-z0-9+.:/?#-][^:/?#]*:")
    return F.when(broken, url).otherwise(F.regexp_replace(full, "/$", ""))


def is_publication(url: Column) -> Column:
    """A publication host anywhere in the URL, or a PDF of a university."""
    known = F.lit(False)
    for part in lists.PUBLICATION_HOSTS:
        known = known | url.contains(part)
    return known | (host(url).endswith(".edu") & F.lower(url).endswith(".pdf"))


def classify(url: Column) -> Column:
    return F.when(is_publication(url), "Publication").otherwise("Internet")


def is_skipped(url: Column) -> Column:
    """Hosts that hold no sources, by part of the host (so a part can hit more hosts than meant)."""
    skipped = F.lit(False)
    for part in lists.SKIPPED_HOSTS:
        skipped = skipped | host(url).contains(part)
    return skipped
