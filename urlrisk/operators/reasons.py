"""Readable reasons of a verdict, as an array of structs in priority order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from urlrisk.sources.catalogs import ReasonInfo, reason_catalog

MAX_REASONS = 5  # fixed value
MIN_CONTRIBUTION = 0.05  # fixed value: smaller contributions are not shown
HIGH_ENTROPY, MANY_SUBDOMAINS = 4.2, 3  # fixed values

REASON_TYPE = (
    "array<struct<code:string,severity:string,text:string,target_segment:string,evidence:map<string,string>>>"
)


def build_reason(code: str, evidence: Column | None = None, catalog: Mapping[str, ReasonInfo] | None = None, text: str | None = None, segment: str | None = None) -> Column:
    """Reason struct for ``code``; unknown codes get a generic medium reason about the host."""
    info = (catalog if catalog is not None else reason_catalog()).get(code) or ReasonInfo(
        code, "medium", "host", f"Suspicious indicator detected: {code}."
    )
    none = F.lit(None).cast("map<string,string>")
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(info.severity).alias("severity"),
        F.lit(text or info.text).alias("text"),
        F.lit(segment or info.target_segment).alias("target_segment"),
        (none if evidence is None else evidence).alias("evidence"),
    )


def _note(key: str, value: Column) -> Column:
    return F.create_map(F.lit(key), value.cast("string"))


def rule_reasons(parsed: Column, features: Column, catalog: Mapping[str, ReasonInfo] | None = None) -> Column:
    """All rule reasons that apply, in priority order (each code at most once)."""
    p, f = parsed, features
    rules = [
        (f["brand_in_subdomain"] == 1, "brand_in_subdomain_not_regdomain", _note("subdomain", p["subdomain"])),
        (f["brand_in_path"] == 1, "brand_in_path_not_regdomain", _note("path", p["path"])),
        (f["typosquat_detected"] == 1, "typosquat_brand", _note("registered_domain", p["registered_domain"])),
        (f["combosquat_detected"] == 1, "combosquat_brand", _note("registered_domain", p["registered_domain"])),
        (f["is_ip_host"] == 1, "ip_host", _note("ip", p["host"])),
        (f["has_userinfo"] == 1, "userinfo_trick", _note("userinfo", p["userinfo"])),
        (
            (f["is_mixed_script"] == 1) | (f["has_punycode"] == 1),
            "punycode_mixed_script",
            _note("host", p["punycode_host"]),
        ),
        (f["long_random_subdomain"] == 1, "long_random_subdomain", _note("subdomain", p["subdomain"])),
        (f["n_subdomains"] >= MANY_SUBDOMAINS, "excessive_subdomains", _note("n_subdomains", f["n_subdomains"])),
        (
            (f["suspicious_keyword_count"] >= 1) & ((f["keyword_in_path"] == 1) | (f["keyword_in_subdomain"] == 1)),
            "suspicious_keywords",
            None,
        ),
        (f["entropy_url"] >= HIGH_ENTROPY, "high_entropy", _note("entropy", f["entropy_url"])),
    ]
    none = F.array().cast(REASON_TYPE)
    return F.concat(*[F.when(cond, F.array(build_reason(code, note, catalog))).otherwise(none) for cond, code, note in rules])


def contribution_reasons(
    contributions: Column, seen: Column, catalog: Mapping[str, ReasonInfo] | None = None
) -> Column:
    """Reasons for the largest positive contributions whose name is a catalog code not seen yet."""
    catalog = catalog if catalog is not None else reason_catalog()
    codes = F.array(*[F.lit(k) for k in catalog])
    entries = F.filter(
        F.map_entries(contributions),
        lambda e: (e["value"] > MIN_CONTRIBUTION)
        & F.array_contains(codes, e["key"])
        & ~F.array_contains(seen, e["key"]),
    )
    ordered = F.array_sort(
        entries,
        lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).otherwise(0),
    )
    part = lambda field, key: F.element_at(
        F.create_map(*[F.lit(x) for k, r in catalog.items() for x in (k, getattr(r, field))]), key
    )
    return F.transform(
        ordered,
        lambda e: F.struct(
            e["key"].alias("code"),
            part("severity", e["key"]).alias("severity"),
            part("text", e["key"]).alias("text"),
            part("target_segment", e["key"]).alias("target_segment"),
            _note("contribution", F.round(e["value"], 3)).alias("evidence"),
        ),
    )


def extract_reasons(
    parsed: Column,
    features: Column,
    contributions: Column | None = None,
    catalog: Mapping[str, ReasonInfo] | None = None,
    limit: int = MAX_REASONS,
) -> Column:
    """The first ``limit`` reasons: rules first, then model contributions (map of name to value)."""
    found = rule_reasons(parsed, features, catalog)
    if contributions is not None:
        extra = contribution_reasons(contributions, found["code"], catalog)
        none = F.array().cast(REASON_TYPE)
        found = F.concat(found, F.coalesce(extra, none))
    return F.slice(found, 1, limit)
