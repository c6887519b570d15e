"""Features, brand findings, reasons and layered verdicts on golden URLs."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from urlrisk.functions.text import char_tokens, entropy
from urlrisk.operators.brands import match_brands, skeleton
from urlrisk.operators.canonical import canonicalize_urls
from urlrisk.operators.detect import scan_urls
from urlrisk.operators.features import FEATURE_NAMES, feature_vectors, url_features
from urlrisk.operators.reasons import extract_reasons
from urlrisk.sources.catalogs import pattern_table

URLS = {
    "https://www.netflix.com/signin": dict(brand_in_subdomain=0, brand_in_path=0, typosquat_detected=0, is_ip_host=0),
    "https://netflix.member.parcel-drop.net/login": dict(brand_in_subdomain=1, keyword_in_path=1),
    "http://amaz0n-support.net/verify": dict(typosquat_detected=1, combosquat_detected=1),
    "http://10.44.7.19:8888/router": dict(is_ip_host=1, is_private_ip=1, has_port=1),
    "https://seed.org//jump?to=https://drop.biz/box&sig=9f8e7d6c5b4a39281706f5e4d3c2b1a0": dict(
        double_slash_in_path=1, url_in_query=1, has_hex_blob=1, n_params=2
    ),
    "https://poems.vercel.app/notes/2025/d_e-f.htm?u=2&v=&w": dict(is_multitenant_host=1, n_params=3, path_depth=3),
    "http://tinyurl.com/qz": dict(is_shortener=1),
    "http://q7w3z9k1v5b8n2m4t6r0.drop.pw/": dict(long_random_subdomain=1, n_subdomains=1),
    "http://rnicrosoft.net/": dict(typosquat_detected=1, min_brand_edit_distance=0),
}


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    return {r["url"]: r for r in url_features(df).collect()}


def test_golden_features(rows):
    for url, expected in URLS.items():
        got = rows[url]["features"].asDict()
        assert sorted(got) == FEATURE_NAMES and len(got) == 49
        for name, value in expected.items():
            assert got[name] == value, (url, name, got[name])


def test_counts_against_python(rows):
    import re

    def bits(s):
        return round(-sum(k / len(s) * math.log2(k / len(s)) for k in Counter(s).values()), 4) if s else 0.0

    for url, row in rows.items():
        p, f = row["parsed"], row["features"]
        u = p["canonical"]
        assert f["n_digits"] == sum(ch.isdigit() for ch in u)
        assert f["n_special"] == sum(not ch.isalnum() for ch in u)
        assert abs(f["letter_ratio"] - sum(ch.isalpha() for ch in u) / len(u)) <= 1e-4
        assert f["entropy_url"] == pytest.approx(bits(u), abs=1e-4)
        assert f["entropy_path"] == pytest.approx(bits(p["path"]), abs=1e-4)
        tokens = [t for t in re.split(r"[/.\-_?=&]", p["path"] + "?" + p["query"]) if t]
        assert f["longest_token_len"] == max(map(len, tokens), default=0)
        assert abs(f["avg_token_len"] - (sum(map(len, tokens)) / len(tokens) if tokens else 0)) <= 1e-2


def test_vector_order_and_dropped_rows(spark):
    df = spark.createDataFrame([("http://a.com/x",), ("ftp://b.com",)], "url string")
    out = feature_vectors(url_features(df)).collect()
    assert len(out) == 1
    assert list(out[0]["vector"]) == [float(out[0]["features"][n]) for n in FEATURE_NAMES]


def test_text_helpers(spark):
    df = spark.createDataFrame([("",), ("aaaaa",), ("abababab",), ("é~a",)], "s string")
    got = {r[0]: r for r in df.select("s", entropy(F.col("s")), char_tokens(F.col("s")), skeleton(F.col("s"))).collect()}
    assert [got[s][1] for s in ("", "aaaaa", "abababab")] == [0.0, 0.0, 1.0]
    assert got["é~a"][2][:4] == [1, 127, 98, 0] and len(got["é~a"][2]) == 200 and set(got[""][2]) == {0}
    assert spark.range(1).select(skeleton(F.lit("PayPa1-rnicro"))).first()[0] == "paypal-micro"


def test_brand_details(spark):
    urls = {
        "http://paypa1.com/": ("paypal", "paypal"),
        "http://apple.evil.com/paypal": ("steam", "apple"),
        "http://evil.com/netflix/paypal": (None, "paypal"),  # catalog order: paypal comes first
        "https://apple.com/": ("apple", None),
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: r["brand"] for r in match_brands(canonicalize_urls(df)).collect()}
    for url, (closest, matched) in urls.items():
        assert got[url]["matched_brand_name"] == matched, url
        if closest and url != "http://apple.evil.com/paypal":
            assert got[url]["closest_brand"] == closest


def scan(spark, urls, **kwargs):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    return {r["url"]: r for r in scan_urls(df, **kwargs).collect()}


def test_layers(spark):
    deny = pattern_table(spark, ["bad.com", "google.com"])
    got = scan(
        spark,
        ["https://bad.com/login", "https://google.com/search", "https://www.apple.com/x", "ftp://f.com/p",
         "https://evil.github.io/login", "https://u@microsoft.com/", "http://192.168.1.1/admin/login"],
        denylist=deny,
    )
    r = got["https://bad.com/login"]
    assert (r["verdict"], r["risk_score"], r["layers"]["feeds"]) == ("malicious", 99, "hit")
    assert [x["code"] for x in r["reasons"]] == ["feed_hit"]
    assert got["https://google.com/search"]["verdict"] == "malicious"
    r = got["https://www.apple.com/x"]
    assert (r["verdict"], r["risk_score"], r["layers"]["allowlist"]) == ("no_threat_found", 0, "hit")
    r = got["ftp://f.com/p"]
    assert (r["verdict"], r["risk_score"], r["confidence"], r["layers"]) == ("unknown", 0, "low", {"canonicalize": "rejected"})
    assert r["reasons"][0]["text"] == "Cannot assess: Unsupported scheme: ftp"
    assert got["https://evil.github.io/login"]["layers"]["allowlist"] == "miss"
    assert got["https://u@microsoft.com/"]["layers"]["allowlist"] == "miss"
    r = got["http://192.168.1.1/admin/login"]
    assert (r["verdict"], r["probability"], r["risk_score"]) == ("suspicious", 0.6, 60)
    assert [x["code"] for x in r["reasons"]][0] == "ip_host"


def test_user_lists_are_isolated(spark):
    df = spark.createDataFrame(
        [("k1", "https://x.com/a"), ("k2", "https://x.com/a"), ("k1", "https://y.github.io/"), (None, "https://x.com/a")],
        "user_key string, url string",
    )
    lists = spark.createDataFrame(
        [("k1", "deny", "x.com"), ("k2", "allow", "x.com"), ("k1", "allow", "y.github.io")],
        "user_key string, kind string, pattern string",
    ).select(F.sha2("user_key", 256).alias("owner_key_hash"), "kind", "pattern")
    got = {(r["user_key"], r["url"]): r for r in scan_urls(df, user_lists=lists).collect()}
    assert got[("k1", "https://x.com/a")]["verdict"] == "malicious"
    assert got[("k1", "https://x.com/a")]["reasons"][0]["text"].endswith("custom blocklist.")
    assert got[("k2", "https://x.com/a")]["layers"]["user_list"] == "allow_hit"
    assert got[("k1", "https://y.github.io/")]["layers"]["user_list"] == "none"
    assert got[(None, "https://x.com/a")]["layers"]["user_list"] == "none"


def test_large_lists_equal_small_ones(spark, tmp_path):
    """A list read from a file is broadcast; one of unknown size takes the narrow join. One owner holds a third of the rows."""
    urls = [(f"k{0 if i % 3 == 0 else i}", f"https://x{i % 5}.com/{i % 7}" if i % 11 else "ftp://no") for i in range(300)]
    df = spark.createDataFrame(urls, "user_key string, url string")
    entries = [(f"k{i % 9}", "deny" if i % 2 else "allow", f"x{i % 5}.com" if i % 4 else f"https://x{i % 5}.com/{i % 7}") for i in range(60)]
    large = spark.createDataFrame(entries, "user_key string, kind string, pattern string").select(
        F.sha2("user_key", 256).alias("owner_key_hash"), "kind", "pattern"
    )
    large.write.parquet(f"{tmp_path}/lists")
    small = spark.read.parquet(f"{tmp_path}/lists")
    deny = spark.createDataFrame([("x4.com",)], "pattern string")
    rows = lambda lists: sorted(map(str, scan_urls(df, user_lists=lists, denylist=deny, id_cols=["url"]).collect()))
    assert rows(large) == rows(small)
    plan = lambda lists: scan_urls(df, user_lists=lists, id_cols=["url"])._jdf.queryExecution().executedPlan().toString()
    assert plan(small).count("BroadcastHashJoin") == 3 and "SortMergeJoin" in plan(large)


def test_custom_allowlist_never_covers_shared_hosts(spark):
    got = scan(spark, ["https://evil.github.io/login"], allowlist=["github.io", "evil.github.io"])
    assert got["https://evil.github.io/login"]["layers"]["allowlist"] == "miss"


def test_reasons_with_contributions(spark):
    df = url_features(spark.createDataFrame([("https://seed.org/oat",)], "url string"))
    contrib = F.create_map(F.lit("ip_host"), F.lit(0.6), F.lit("typosquat_brand"), F.lit(0.35), F.lit("unknown"), F.lit(0.5))
    codes = df.select(extract_reasons(F.col("parsed"), F.col("features"), contrib)["code"]).first()[0]
    assert codes == ["ip_host", "typosquat_brand"]
