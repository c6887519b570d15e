"""The 49 numeric URL features as column expressions over the ``parsed`` struct."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.functions.planning import computed_stage
from urlrisk.functions.text import (
    count_class,
    count_text,
    entropy,
    half_even,
    non_empty,
    regex_union,
)
from urlrisk.operators.brands import match_brands
from urlrisk.operators.canonical import canonicalize_urls
from urlrisk.sources.catalogs import KEYWORDS, MULTITENANT_HOSTS, SHORTENER_DOMAINS, Alias

# feature families, in declaration order; models use the alphabetical order of FEATURE_NAMES
FEATURE_FAMILIES = {
    "counts": "url_len host_len path_len query_len n_dots n_hyphens n_underscores n_digits n_special n_params "
    "path_depth n_subdomains",
    "ratios": "digit_ratio letter_ratio uppercase_ratio special_ratio entropy_url entropy_host entropy_path "
    "longest_token_len avg_token_len vowel_ratio",
    "host": "is_ip_host is_private_ip has_port has_userinfo is_idn is_mixed_script has_punycode "
    "has_double_encoding is_multitenant_host is_shortener label_count subdomain_len",
    "brand": "brand_in_subdomain brand_in_path typosquat_detected combosquat_detected min_brand_edit_distance",
    "keywords": "suspicious_keyword_count keyword_in_path keyword_in_subdomain",
    "obfuscation": "pct_encoded_ratio has_base64_like_token has_hex_blob double_slash_in_path "
    "at_symbol_in_query url_in_query long_random_subdomain",
}
FEATURE_NAMES = sorted(name for names in FEATURE_FAMILIES.values() for name in names.split())

# fixed values
MAX_BRAND_DISTANCE = 20
LONG_SUBDOMAIN, RANDOM_ENTROPY = 18, 3.5
BASE64_TOKEN = r"[A-Za-z0-9+/]{20,}={0,2}"
HEX_BLOB = r"[0-9a-fA-F]{16,}"


def is_multitenant(parsed: str, hosts: Sequence[str] = MULTITENANT_HOSTS) -> Column:
    p = F.col(parsed)
    return p["suffix"].isin(list(hosts)) | p["registered_domain"].isin(list(hosts))


def extract_features(
    df: DataFrame,
    parsed: str = "parsed",
    out: str = "features",
    aliases: Sequence[Alias] | None = None,
    multitenant: Sequence[str] = MULTITENANT_HOSTS,
    shorteners: Sequence[str] = SHORTENER_DOMAINS,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Add struct ``out`` with all features, or those of ``names``; null where ``parsed`` is null or not valid. No shuffle."""
    keep = [k for k in df.columns if k != out]
    c = F.col
    p = F.col(parsed)
    df = match_brands(df, parsed, "_brand", aliases, details=False)
    df = df.select(
        *keep,
        "_brand",
        p["canonical"].alias("_u"),
        p["path"].alias("_fp"),
        p["query"].alias("_fq"),
        p["subdomain"].alias("_fsub"),
    )
    df = df.withColumns({"_ul": F.lower("_u"), "_pl": F.lower("_fp"), "_sl": F.lower("_fsub")})
    # a path is part of its URL; a subdomain may be written differently there
    contained = lambda name, word: F.contains(c(name), F.lit(word))
    keyword_count = reduce(add, [contained("_ul", k).cast("int") for k in KEYWORDS])
    any_keyword = regex_union(KEYWORDS)
    sub_keyword = reduce(or_, [contained("_ul", k) & contained("_sl", k) for k in KEYWORDS])
    df = df.withColumns(
        {
            "_len": F.greatest(F.length("_u"), F.lit(1)),
            "_digits": count_class(c("_u"), r"\P{Nd}+"),
            "_letters": count_class(c("_u"), r"\P{L}+"),
            "_tokens": F.transform(
                non_empty(F.split(F.concat("_fp", F.lit("?"), "_fq"), r"[/.\-_?=&]")), lambda t: F.length(t)
            ),
            "_kw": keyword_count,
            "_labels": F.size(F.split(p["host"], r"\.")),
            "_sub_n": F.size(non_empty(F.split("_fsub", r"\."))),
        }
    )
    df = df.withColumns({"_ntok": F.size("_tokens"), "_special": c("_len") - c("_digits") - c("_letters")})
    flag = lambda col: F.coalesce(col, F.lit(False)).cast("int")
    n = c("_len")
    brand = c("_brand")
    total = F.aggregate(c("_tokens"), F.lit(0), lambda acc, t: acc + t)
    values = {
        "url_len": n,
        "host_len": F.length(p["host"]),
        "path_len": F.length("_fp"),
        "query_len": F.length("_fq"),
        "n_dots": count_text(c("_u"), "."),
        "n_hyphens": count_text(c("_u"), "-"),
        "n_underscores": count_text(c("_u"), "_"),
        "n_digits": c("_digits"),
        "n_special": c("_special"),
        "n_params": F.when(c("_fq") == "", 0).otherwise(count_text(c("_fq"), "&") + 1),
        "path_depth": F.size(non_empty(F.split("_fp", "/"))),
        "n_subdomains": c("_sub_n"),
        "digit_ratio": half_even(c("_digits"), n, 4),
        "letter_ratio": half_even(c("_letters"), n, 4),
        "uppercase_ratio": half_even(
            count_class(p["raw"], r"\P{Lu}+"), F.greatest(F.length(p["raw"]), F.lit(1)), 4
        ),
        "special_ratio": half_even(c("_special"), n, 4),
        "entropy_url": entropy(c("_u")),
        "entropy_host": entropy(p["host"]),
        "entropy_path": entropy(c("_fp")),
        "longest_token_len": F.coalesce(F.array_max("_tokens"), F.lit(0)),
        "avg_token_len": half_even(total, c("_ntok"), 2),
        "vowel_ratio": half_even(
            count_class(c("_u"), "[^aeiouAEIOU]+"), F.greatest(c("_letters"), F.lit(1)), 4
        ),
        "is_ip_host": flag(p["is_ip"]),
        "is_private_ip": flag(p["is_private_ip"]),
        "has_port": flag(p["port"].isNotNull()),
        "has_userinfo": flag(p["has_userinfo"]),
        "is_idn": flag(p["is_idn"]),
        "is_mixed_script": flag(p["is_mixed_script"]),
        "has_punycode": flag(p["has_punycode"]),
        "has_double_encoding": flag(p["has_double_encoding"]),
        "is_multitenant_host": flag(is_multitenant(parsed, multitenant)),
        "is_shortener": flag(p["registered_domain"].isin(list(shorteners))),
        "label_count": c("_labels"),
        "subdomain_len": F.length("_fsub"),
        "brand_in_subdomain": flag(brand["brand_in_subdomain"]),
        "brand_in_path": flag(brand["brand_in_path"]),
        "typosquat_detected": flag(brand["typosquat_detected"]),
        "combosquat_detected": flag(brand["combosquat_detected"]),
        "min_brand_edit_distance": F.least(brand["min_edit_distance"], F.lit(MAX_BRAND_DISTANCE)),
        "suspicious_keyword_count": c("_kw"),
        "keyword_in_path": F.when(c("_kw") == 0, 0).otherwise(flag(c("_pl").rlike(any_keyword))),
        "keyword_in_subdomain": F.when((c("_kw") == 0) | ~c("_sl").rlike(any_keyword), 0).otherwise(flag(sub_keyword)),
        "pct_encoded_ratio": half_even(
            3 * F.when(F.contains(c("_u"), F.lit("%")), F.regexp_count("_u", F.lit("%[0-9a-fA-F]{2}"))).otherwise(0), n, 4
        ),
        "has_base64_like_token": flag(c("_u").rlike(BASE64_TOKEN)),
        "has_hex_blob": flag(c("_u").rlike(HEX_BLOB)),
        "double_slash_in_path": flag(F.contains(c("_fp"), F.lit("//"))),
        "at_symbol_in_query": flag(F.contains(c("_fq"), F.lit("@"))),
        "url_in_query": flag(c("_fq").rlike("(?i)https?://")),
        "long_random_subdomain": F.when(F.length("_fsub") < LONG_SUBDOMAIN, 0).otherwise(
            flag(entropy(c("_fsub")) >= RANDOM_ENTROPY)
        ),
    }
    chosen = set(FEATURE_NAMES if names is None else names)
    # entropies run through arrays row by row; in a step of their own they leave the rest to generated code
    slow = {f"_v_{k}": values[k] for k in values if k in chosen and (k.startswith("entropy") or k == "long_random_subdomain")}
    df = df.withColumns(slow)
    values |= {k.removeprefix("_v_"): c(k) for k in slow}
    features = F.struct(*[values[name].alias(name) for members in FEATURE_FAMILIES.values() for name in members.split() if name in chosen])
    return computed_stage(df, keep, {out: F.when(p["is_valid"], features)})


def feature_columns(df: DataFrame, features: str = "features", names: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """Replace the struct by one column per feature, in model order."""
    rest = [k for k in df.columns if k != features]
    return df.select(*rest, *[F.col(f"{features}.{name}").alias(name) for name in names])


def feature_vectors(
    df: DataFrame, features: str = "features", out: str = "vector", names: Sequence[str] = FEATURE_NAMES
) -> DataFrame:
    """Add an ML vector of the named features; rows whose URL could not be assessed are dropped."""
    from pyspark.ml.functions import array_to_vector

    values = F.array(*[F.col(f"{features}.{name}").cast("double") for name in names])
    return df.filter(F.col(features).isNotNull()).withColumn(out, array_to_vector(values))


def url_features(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Canonicalize and extract in one step."""
    return extract_features(canonicalize_urls(df, url_col))


#: The host of a URL as it was written, up to its port.
WRITTEN_HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#]*@)?(\[[^/?#]*\]|[^/?#:]*)"


def address_features(df: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Add ``ip_form`` (none, dotted, decimal, hex or v6: how an address was written) and ``nonstandard_port`` (a port that is not the scheme's); null for what could not be assessed."""
    p = F.col(parsed)
    written = F.regexp_extract(p["raw"], WRITTEN_HOST, 1)
    form = (
        F.when(~p["is_ip"], "none")
        .when(written.startswith("["), "v6")
        .when(F.lower(written).startswith("0x"), "hex")
        .when(F.contains(written, F.lit(".")), "dotted")
        .otherwise("decimal")
    )
    return df.withColumns({"ip_form": F.when(p["is_valid"], form), "nonstandard_port": F.when(p["is_valid"], p["port"].isNotNull().cast("int"))})
