"""Layered verdicts: invalid, user deny, feed deny, user allow, curated allow, then a scorer."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlrisk.functions.planning import computed_stage
from urlrisk.functions.privacy import hash_key, sha256_url
from urlrisk.operators.canonical import canonicalize_urls
from urlrisk.operators.features import extract_features, is_multitenant
from urlrisk.operators.ordering import stored
from urlrisk.operators.reasons import REASON_TYPE, build_reason, extract_reasons
from urlrisk.operators.skew import broadcast_by_statistics, lookup_join
from urlrisk.sources.catalogs import ALLOWED_DOMAINS, MULTITENANT_HOSTS, USER_DENY_TEXT, Alias, ReasonInfo

# fixed values
T_SUSPICIOUS, T_MALICIOUS = 0.35, 0.70
RULE_VERSION = "v0.1-rule-fallback"
DENY_SCORE, DENY_PROBABILITY, ALLOW_PROBABILITY = 99, 0.99, 0.01
CONFIDENT_HIGH, CONFIDENT_LOW = 0.85, 0.15
RULE_WEIGHTS = {"ip": 0.45, "brand_subdomain": 0.40, "squat": 0.40, "keyword": 0.15}
RULE_FLOOR, RULE_CEILING = 0.05, 0.95

PATTERN_KEYS = ("canonical", "registered_domain", "host")

#: The features that the rule score and the rule reasons read.
SCORE_FEATURES = "is_ip_host brand_in_subdomain typosquat_detected combosquat_detected suspicious_keyword_count".split()
REASON_FEATURES = (
    "brand_in_path has_userinfo is_mixed_script has_punycode long_random_subdomain n_subdomains keyword_in_path keyword_in_subdomain entropy_url"
).split()

Scorer = Callable[[DataFrame], DataFrame]


def rule_score(features: Column) -> Column:
    """Score from a handful of flags, used when no model is given."""
    f, w = features, RULE_WEIGHTS
    part = lambda cond, weight: F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))
    total = (
        part(f["is_ip_host"] == 1, w["ip"])
        + part(f["brand_in_subdomain"] == 1, w["brand_subdomain"])
        + part((f["typosquat_detected"] == 1) | (f["combosquat_detected"] == 1), w["squat"])
        + part(f["suspicious_keyword_count"] > 0, w["keyword"])
    )
    return F.least(F.greatest(total, F.lit(RULE_FLOOR)), F.lit(RULE_CEILING))


def verdict_of(probability: Column, t_suspicious: float = T_SUSPICIOUS, t_malicious: float = T_MALICIOUS) -> Column:
    return (
        F.when(probability >= t_malicious, "malicious")
        .when(probability >= t_suspicious, "suspicious")
        .otherwise("no_threat_found")
    )


def confidence_of(probability: Column) -> Column:
    return F.when((probability >= CONFIDENT_HIGH) | (probability <= CONFIDENT_LOW), "high").otherwise("medium")


def _join_patterns(df: DataFrame, table: DataFrame, parsed: str, flags: Sequence[str], owner: str | None, rows: DataFrame | None = None) -> DataFrame:
    """Or the ``flags`` of ``table`` over the three pattern keys. No job runs here: the plan's own statistics choose.

    A list that Spark would broadcast is looked up by three broadcast joins, without a shuffle. For a larger one the distinct
    (owner, URL) of the rows become narrow rows of owner and pattern, which meet the list in one join; the flags found are joined back by owner and
    URL. Repeated URLs are one row in the narrow part, and rows without a URL, which no list knows, get keys of their own that spread them. ``rows`` has
    the same URLs as ``df`` and is cheaper to read, for the narrow part. A stream has no distinct, so it joins the large list three times.
    """
    owners = [] if owner is None else [owner]
    small = broadcast_by_statistics(table)
    df = df.withColumns({f"_{flag}": F.lit(False) for flag in flags})
    if small or df.isStreaming:
        side = F.broadcast(table) if small else table
        for name in PATTERN_KEYS:
            df = df.withColumn("_pattern", F.col(f"{parsed}.{name}")).join(side, [*owners, "_pattern"], "left")
            df = df.withColumns(
                {f"_{flag}": F.col(f"_{flag}") | F.coalesce(F.col(flag), F.lit(False)) for flag in flags}
            ).drop("_pattern", *flags)
        return df
    rows = df if rows is None else rows
    parts = rows.select(*owners, *[F.col(f"{parsed}.{k}").alias(f"_p_{k}") for k in PATTERN_KEYS]).where("_p_canonical is not null")
    patterns = F.explode(F.array_distinct(F.array(*[f"_p_{k}" for k in PATTERN_KEYS]))).alias("_pattern")
    narrow = parts.distinct().select(*owners, F.col("_p_canonical").alias("_url"), patterns)
    found = narrow.join(table, [*owners, "_pattern"]).groupBy(*owners, "_url").agg(*[F.bool_or(f).alias(f) for f in flags])
    plain = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    alone = F.concat(F.lit("\0"), F.xxhash64(f"{parsed}.raw", *[F.col(f"`{name}`") for name in plain]).cast("string"))
    df = df.withColumn("_url", F.coalesce(f"{parsed}.canonical", alone)).join(found, [*owners, "_url"], "left")
    return df.withColumns({f"_{flag}": F.coalesce(F.col(flag), F.lit(False)) for flag in flags}).drop("_url", *flags)


def _user_table(lists: DataFrame, owner: str = "owner_key_hash") -> DataFrame:
    return lists.groupBy(F.col("owner_key_hash").alias(owner), F.col("pattern").alias("_pattern")).agg(
        F.bool_or(F.col("kind") == "deny").alias("user_deny"), F.bool_or(F.col("kind") == "allow").alias("user_allow")
    )


def _deny_table(denylist: DataFrame) -> DataFrame:
    return denylist.select(F.col("pattern").alias("_pattern")).distinct().withColumn("denied", F.lit(True))


def tag_user_lists(df: DataFrame, lists: DataFrame, parsed: str = "parsed", owner: str = "owner_key_hash", rows: DataFrame | None = None) -> DataFrame:
    """Add booleans ``_user_deny`` and ``_user_allow`` from a table of owner, kind and pattern."""
    return _join_patterns(df, _user_table(lists, owner), parsed, ("user_deny", "user_allow"), owner, rows)


def tag_denylist(df: DataFrame, denylist: DataFrame, parsed: str = "parsed", rows: DataFrame | None = None) -> DataFrame:
    """Add boolean ``_denied`` from a table of patterns (deny list or feed)."""
    return _join_patterns(df, _deny_table(denylist), parsed, ("denied",), None, rows)


def _read_more_than_once(df: DataFrame, user_lists: DataFrame | None, denylist: DataFrame | None) -> bool:
    """Whether a large list makes the scan read its canonical rows more than once, and parquet can hold them."""
    tables = [] if user_lists is None else [_user_table(user_lists)]
    tables += [] if denylist is None else [_deny_table(denylist)]
    if df.isStreaming or re.search(r"\b(void|interval)\b", df.schema.simpleString()):
        return False
    return not all(map(broadcast_by_statistics, tables))


def scan_urls(
    df: DataFrame,
    url_col: str = "url",
    parsed: str | None = None,
    user_lists: DataFrame | None = None,
    denylist: DataFrame | None = None,
    allowlist: Sequence[str] | DataFrame | None = None,
    scorer: Scorer | None = None,
    contributions: str | None = None,
    calibrator: Callable[[DataFrame, str, str], DataFrame] | None = None,
    t_suspicious: float = T_SUSPICIOUS,
    t_malicious: float = T_MALICIOUS,
    model_version: str = RULE_VERSION,
    aliases: Sequence[Alias] | None = None,
    catalog: Mapping[str, ReasonInfo] | None = None,
    multitenant: Sequence[str] = MULTITENANT_HOSTS,
    suffix_rules: DataFrame | None = None,
    id_cols: Sequence[str] | None = None,
    keep_parts: bool = False,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Scan a table of URLs; input columns are kept and the result columns are added.

    ``df`` needs ``owner_key_hash`` (or ``user_key``, which is hashed) when ``user_lists`` is given. ``parsed``
    names a struct that :func:`canonicalize_urls` already made. ``scorer`` takes the rows with a ``features``
    struct and adds ``model_probability``; ``contributions`` names a map column it may add. ``allowlist=None``
    means the default domains, an empty sequence means none. ``columns`` names the result columns to add (default: all);
    reasons and features that neither they nor a scorer need are not worked out.

    Rows that a list decides have a null ``features`` struct: null inputs end the feature expressions at once,
    so they cost nothing even though the plan is one projection without branches. If a list is too large to be broadcast, the canonical
    rows are stored first (one job), as the list joins and the scan read them.
    """
    if user_lists is not None and "owner_key_hash" not in df.columns:
        df = df.withColumn("owner_key_hash", hash_key(F.col("user_key")))
    inputs = [k for k in df.columns if k != parsed]
    if parsed is None:
        df = canonicalize_urls(df, url_col, "parsed", suffix_rules=suffix_rules)
    elif parsed != "parsed":
        df = df.withColumnRenamed(parsed, "parsed")
    p = F.col("parsed")
    rows = None
    if _read_more_than_once(df, user_lists, denylist):
        df = rows = stored(df, "parsed")
    if user_lists is not None:
        df = tag_user_lists(df, user_lists, rows=rows)
    else:
        df = df.withColumns({"_user_deny": F.lit(False), "_user_allow": F.lit(False)})
    df = tag_denylist(df, denylist, rows=rows) if denylist is not None else df.withColumn("_denied", F.lit(False))

    if isinstance(allowlist, DataFrame):
        table = allowlist.select(F.col("pattern").alias("_pattern")).distinct().withColumn("_curated", F.lit(True))
        df = lookup_join(df.withColumn("_pattern", p["registered_domain"]), table, ["_pattern"]).drop("_pattern")
        curated = F.coalesce(F.col("_curated"), F.lit(False))
    else:
        domains = list(ALLOWED_DOMAINS if allowlist is None else allowlist)
        curated = p["registered_domain"].isin(domains) if domains else F.lit(False)

    shared = is_multitenant("parsed", multitenant)
    layer = (
        F.when(~p["is_valid"], "invalid")
        .when(F.col("_user_deny"), "user_deny")
        .when(F.col("_denied"), "feed")
        .when(F.col("_user_allow") & ~shared, "user_allow")
        .when(curated & ~shared & ~p["has_userinfo"], "allowlist")
        .otherwise("model")
    )
    df = computed_stage(df, [*inputs, "parsed"], {"_layer": layer})
    scored = F.col("_layer") == "model"
    # the whole struct only where it is scored; all rows keep the few parts that every result needs
    shown = {f"_shown_{k}": p[k] for k in ("raw", "canonical", "registered_domain", "error_message")}
    df = df.withColumns({"_open": F.when(scored, p), **shown})
    if scorer is None and calibrator is None and not keep_parts:
        df = df.drop("parsed")
    p = {k: F.col(f"_shown_{k}") for k in ("raw", "canonical", "registered_domain", "error_message")}
    reasoned = columns is None or "reasons" in columns
    read = None if scorer is not None or keep_parts else SCORE_FEATURES + (REASON_FEATURES if reasoned else [])
    df = extract_features(df, "_open", "features", aliases, multitenant, names=read)
    if scorer is not None:
        df = scorer(df)
        if calibrator is not None:
            df = calibrator(df, "model_probability", "model_probability")
        raw = F.col("model_probability")
    else:
        df = df.withColumn("_rule", rule_score(F.col("features")))
        if calibrator is not None:
            df = calibrator(df, "_rule", "_rule")
        raw = F.col("_rule")
    found = F.array().cast(REASON_TYPE)
    if reasoned:
        found = extract_reasons(F.col("_open"), F.col("features"), F.col(contributions) if contributions else None, catalog)
    # a step of its own: with the results below it would be more code than the JVM compiles at once
    parts = ["parsed", "features"] if keep_parts else []
    df = computed_stage(df, [*inputs, *parts, "_layer", *shown], {"_prob": F.when(scored, raw), "_found": F.when(scored, found)})
    df = df.withColumns({"_verdict": verdict_of(F.col("_prob"), t_suspicious, t_malicious), "_score": F.bround(F.col("_prob") * 100, 0).cast("int")})
    none = F.array().cast(REASON_TYPE)
    fallback = build_reason(
        "elevated_ml_risk",
        F.create_map(
            F.lit("risk_score"),
            F.col("_score").cast("string"),
            F.lit("probability"),
            F.bround("_prob", 4).cast("string"),
        ),
        catalog,
    )
    name = F.col("_layer")
    one = lambda reason: F.array(reason).cast(REASON_TYPE)
    invalid_reason = F.struct(
        F.lit("invalid_url").alias("code"),
        F.lit("medium").alias("severity"),
        F.concat(F.lit("Cannot assess: "), p["error_message"]).alias("text"),
        F.lit("host").alias("target_segment"),
        F.lit(None).cast("map<string,string>").alias("evidence"),
    )
    reasons = (
        F.when(name == "invalid", one(invalid_reason))
        .when(name == "user_deny", one(build_reason("user_denylist", None, catalog, USER_DENY_TEXT, "host")))
        .when(
            name == "feed",
            one(build_reason("feed_hit", F.create_map(F.lit("match"), p["registered_domain"]), catalog)),
        )
        .when(name.isin("user_allow", "allowlist"), none)
        .when((F.col("_verdict") != "no_threat_found") & (F.size("_found") == 0), one(fallback))
        .otherwise(F.col("_found").cast(REASON_TYPE))
    )
    trace = lambda key, value: (F.lit(key), value)
    layers = F.when(name == "invalid", F.create_map(F.lit("canonicalize"), F.lit("rejected"))).otherwise(
        F.create_map(
            *trace("canonicalize", F.lit("ok")),
            *trace(
                "user_list",
                F.when(name == "user_deny", "deny_hit").when(name == "user_allow", "allow_hit").otherwise("none"),
            ),
            *trace("allowlist", F.when(name == "allowlist", "hit").otherwise("miss")),
            *trace("feeds", F.when(name == "feed", "hit").otherwise("miss")),
            *trace("ml", F.when(scored, "scored").otherwise("skipped")),
        )
    )
    denied, allowed = name.isin("user_deny", "feed"), name.isin("user_allow", "allowlist")
    canonical = F.coalesce(p["canonical"], F.lit(""))
    hashed = sha256_url(F.when(name == "invalid", p["raw"]).otherwise(canonical))
    identity = F.uuid() if id_cols is None else scan_identity(id_cols)
    results = {
        "scan_id": identity,
        "url_raw": p["raw"],
        "url_canonical": canonical,
        "url_sha256": hashed,
        "registered_domain": F.coalesce(p["registered_domain"], F.lit("")),
        "verdict": F.when(name == "invalid", "unknown")
        .when(denied, "malicious")
        .when(allowed, "no_threat_found")
        .otherwise(F.col("_verdict")),
        "risk_score": F.when(name == "invalid", 0).when(denied, DENY_SCORE).when(allowed, 0).otherwise(F.col("_score")),
        "probability": F.when(name == "invalid", 0.0)
        .when(denied, DENY_PROBABILITY)
        .when(allowed, ALLOW_PROBABILITY)
        .otherwise(F.bround("_prob", 4)),
        "confidence": F.when(name == "invalid", "low")
        .when(denied | allowed, "high")
        .otherwise(confidence_of(F.col("_prob"))),
        "reasons": reasons,
        "layers": layers,
        "model_version": F.lit(model_version),
    }
    if columns is not None:
        results = {k: v for k, v in results.items() if k in set(columns)}
    return computed_stage(df, [*[k for k in inputs if k not in results], *parts], results)


def scan_summary(scans: DataFrame) -> DataFrame:
    """Number of scans per verdict."""
    return scans.groupBy("verdict").agg(F.count("*").alias("n"))


def scan_identity(id_cols: Sequence[str]) -> Column:
    """Scan id of a row, from the columns that name it."""
    return F.sha2(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in id_cols]), 256)


def rows_of_scan(df: DataFrame, scan_id: str, id_cols: Sequence[str]) -> DataFrame:
    """The input rows of one scan: the id needs only ``id_cols``, so nothing else is scanned or scored."""
    return df.filter(scan_identity(id_cols) == scan_id)


def find_scan(scans: DataFrame, scan_id: str) -> DataFrame:
    """Stored scan by id (empty when there is none)."""
    return scans.filter(F.col("scan_id") == scan_id)
