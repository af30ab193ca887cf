"""Column functions over addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Host in small letters, without credentials and port; null without one."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(h, F.lit(""))


def canonical_url(url: Column, keep: tuple[str, ...] = ("id", "f", "doc")) -> Column:
    """Scheme and host in small letters, only the parameters in ``keep`` in order of name, no closing slash, no fragment
    (I01)."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: F.split(p, "=")[0].isin(*keep))
    return F.when(head != "", F.concat(head, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(F.lit(""))))


def https(url: Column, default_host: str) -> Column:
    """Always https; an address without a host is one of ``default_host``."""
    u = F.trim(url)
    return F.when(u.startswith("/"), F.concat(F.lit(f"https://{default_host}"), u)).otherwise(F.regexp_replace(u, r"(?i)^http://", "https://"))


def with_parameter(url: Column, name: str, value: Column) -> Column:
    """One parameter more, before any fragment."""
    base, rest = F.regexp_extract(url, r"^([^#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    return F.concat(base, F.when(base.contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit(f"{name}="), F.url_encode(value), rest)


def suffixes(host_: Column) -> Column:
    """The host and each of its parents, longest first: what a longest-suffix join explodes."""
    parts = F.split(host_, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def deep_link(base: Column, hint: Column, kind: Column) -> Column:
    """Address with its anchor: as a parameter, as a fragment or none; another kind is an error."""
    whole = F.when(base.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    return (
        F.when((kind == "none") | hint.isNull() | (hint == ""), base)
        .when(kind == "query", F.concat(base, whole, F.lit("anchor="), hint))
        .when(kind == "fragment", F.concat(base, F.lit("#"), hint))
        .otherwise(F.raise_error(F.concat(F.lit("unknown kind of anchor: "), kind)))
    )
