"""URL predicates and parts. Strings and patterns are native; literal addresses go through one Arrow function."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes of files that hold no page.
BINARY = ("pdf", "jpg", "jpeg", "png", "webp", "gif", "zip", "rar", "doc", "docx", "xls", "xlsx", "mp4", "exe")
#: Parts of addresses of service pages, which carry no specifications.
SUPPORT = ("supportdetail", "productservice", "product-service", "/servis", "/service[s]?/", "/get-help", "/customer", "/warranty", "/repair", "/manual", "/download", "/instruction", "/spares", "/faq", "/register", "/where-to-buy", "/store-locator")


def host(url: Column) -> Column:
    """Lower-case host, also of addresses that the URL parser refuses; null without one."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def matches_domain(url: Column, domain: Column) -> Column:
    """The host is the domain or below it."""
    h, d = bare_host(url), F.regexp_replace(F.lower(domain), r"^www\.", "")
    return F.coalesce((h == d) | h.endswith(F.concat(F.lit("."), d)), F.lit(False))


def is_binary(url: Column) -> Column:
    return F.substring_index(F.lower(url), "?", 1).rlike(rf"\.({'|'.join(BINARY)})$")


def is_support(url: Column) -> Column:
    return url.rlike(f"(?i){'|'.join(SUPPORT)}")


def has_model(url: Column, hints: Column) -> Column:
    """Some hint of four letters and digits or more stands in the address, other characters apart."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    return F.exists(F.filter(hints, lambda h: h.isNotNull()), lambda h: (F.length(plain(h)) >= 4) & F.contains(plain(url), plain(h)))


def locale_points(url: Column) -> Column:
    """+4 for a page in a wanted language, -4 for one in another."""
    path = F.regexp_extract(url, r"^(?:[^/]*//)?[^/]*(/.*)$", 1)
    pair = r"(?i)/([a-z]{2})[-_]([a-z]{2})(?=/|$)"
    both = F.array(F.lower(F.regexp_extract(path, pair, 1)), F.lower(F.regexp_extract(path, pair, 2)))
    wanted = F.arrays_overlap(both, F.array(F.lit("en"), F.lit("uk"), F.lit("ua")))
    single = url.rlike(r"(?i)/(?:ua|uk|en)(?=/|$)|[?&]lang=(?:en|uk|ua)")
    return F.when(path.rlike(pair), F.when(wanted, 4.0).otherwise(-4.0)).when(single, 4.0).otherwise(0.0)


def suffixes(h: Column) -> Column:
    """A host and every domain above it, for an equality join with a table of domains."""
    parts = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


DOMAIN = r"^[a-z0-9][a-z0-9\-.]{1,60}\.[a-z]{2,10}$"


def registrable(url: Column) -> Column:
    """The last two labels of the host, or three where the last but one has three characters or fewer."""
    h = bare_host(url)
    parts = F.split(h, r"\.")
    keep = F.when(F.size(parts) <= 2, F.size(parts)).when(F.length(F.get(parts, F.size(parts) - 2)) <= 3, 3).otherwise(2)
    d = F.array_join(F.slice(parts, F.size(parts) - keep + 1, keep), ".")
    return F.when(d.rlike(DOMAIN), d)


def clean_domain(raw: Column) -> Column:
    d = F.trim(F.substring_index(F.regexp_replace(F.regexp_replace(F.trim(F.lower(raw)), "^https?://", ""), r"^www\.", ""), "/", 1))
    return F.when(d.rlike(DOMAIN), d)


def _public(address: str) -> bool:
    try:
        ip = ipaddress.ip_address(address.strip("[]"))
    except ValueError:
        return True
    mapped = getattr(ip, "ipv4_mapped", None)
    ip = mapped or ip
    return ip.is_global and not ip.is_multicast


@F.pandas_udf(T.BooleanType())
def public_address(h: pd.Series) -> pd.Series:
    return h.map(lambda x: x is not None and _public(x)).astype(bool)


def is_safe(url: Column) -> Column:
    """http or https to a public name or address; what names resolve to is not looked up."""
    bracket = F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/?#@]*@)?(\[[^\]]*\])", 1)
    h = F.when(bracket != "", bracket).otherwise(F.coalesce(host(url), F.lit("")))
    literal = (bracket != "") | h.rlike(r"^[0-9.]+$")
    internal = h.isin("localhost", "metadata") | h.rlike(r"\.(local|internal|localhost|lan|intranet|corp|home|localdomain)$") | ~h.contains(".")
    return url.rlike("(?i)^https?://") & (h != "") & F.when(literal, public_address(h)).otherwise(~internal)


def is_safe_name(url: Column) -> Column:
    """The part of is_safe that needs no address arithmetic: scheme and name."""
    h = F.coalesce(host(url), F.lit(""))
    return url.rlike("(?i)^https?://") & h.contains(".") & ~h.rlike(r"\.(local|internal|localhost|lan|intranet|corp|home|localdomain)$")
