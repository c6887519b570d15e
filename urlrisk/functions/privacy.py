"""Column helpers that make URLs safe to show, store and compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urlrisk.functions.text import strip

_SCHEME = r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*)://.*"


def defang(url: Column) -> Column:
    """``hxxp(s)`` scheme and ``[.]`` for every dot of the authority; path, query and fragment stay."""
    scheme = F.regexp_extract(url, _SCHEME, 1)
    has_scheme = scheme != ""
    body = F.when(has_scheme, F.substr(url, F.length(scheme) + 4)).otherwise(url)
    authority = F.regexp_extract(body, r"^([^/?#]*)", 1)
    tail = F.substr(body, F.length(authority) + 1)
    shown = (
        F.when(~has_scheme, F.lit(""))
        .when(F.lower(scheme) == "http", F.lit("hxxp://"))
        .when(F.lower(scheme) == "https", F.lit("hxxps://"))
        .otherwise(F.concat(scheme, F.lit("://")))
    )
    return F.concat(shown, F.replace(authority, F.lit("."), F.lit("[.]")), tail)


def refang(url: Column) -> Column:
    """Inverse of :func:`defang`, also for the ``(.)``, ``[:]``, ``(:)``, ``[/]`` and ``(/)`` spellings."""
    out = F.regexp_replace(url, r"^(?i:hxxps)://", "https://")
    out = F.regexp_replace(out, r"^(?i:hxxp)://", "http://")
    for mark in (".", ":", "/"):
        for left, right in (("[", "]"), ("(", ")")):
            out = F.replace(out, F.lit(left + mark + right), F.lit(mark))
    return out


def redact_query(url: Column) -> Column:
    """Drop query and fragment."""
    return F.regexp_replace(url, r"(?s)[?#].*\z", "")


def sha256_url(url: Column) -> Column:
    return F.sha2(url, 256)


def hash_key(key: Column) -> Column:
    """Owner key as it is stored: SHA-256 of the trimmed text."""
    return F.sha2(strip(key), 256)


def invert_label(raw: Column) -> Column:
    """Raw sources that use 1 for legitimate: 1 becomes 0, 0 becomes 1, anything else fails the job."""
    value = raw.cast("int")
    return (
        F.when(value == 1, F.lit(0))
        .when(value == 0, F.lit(1))
        .otherwise(F.raise_error(F.concat(F.lit("Unexpected raw label: "), F.coalesce(raw.cast("string"), F.lit("null")))))
    )
