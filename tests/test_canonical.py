"""Golden rows, error channel and invariants of the canonicalization step."""

import random
from string import ascii_lowercase

from pyspark.sql import functions as F

from urlrisk.operators.canonical import canonicalize_urls
from urlrisk.sources.suffixes import builtin_rule_table, read_suffix_rules

GOLDEN = {
    "https://city-library.org:reader@fast-transfer.net/inbox": {
        "host": "fast-transfer.net",
        "registered_domain": "fast-transfer.net",
        "has_userinfo": True,
        "userinfo": "city-library.org:reader",
        "canonical": "https://city-library.org:reader@fast-transfer.net/inbox",
    },
    "http://harbor.museum:80/rooms": {"canonical": "http://harbor.museum/rooms", "port": None},
    "https://harbor.museum:443/rooms": {"canonical": "https://harbor.museum/rooms"},
    "https://harbor.museum:9443/rooms": {"canonical": "https://harbor.museum:9443/rooms", "port": 9443},
    "http://harbor.museum:00080/rooms": {"canonical": "http://harbor.museum/rooms"},
    "https://gazette.island.org./issue": {"host": "gazette.island.org", "registered_domain": "island.org"},
    "https://bill-77.netlify.app/open": {
        "suffix": "netlify.app",
        "registered_domain": "bill-77.netlify.app",
        "subdomain": "",
    },
    "http://pages.dev/y": {"suffix": "pages.dev", "registered_domain": "pages.dev", "subdomain": ""},
    "http://p.q.nosuchlabel/": {"suffix": "", "registered_domain": "p.q.nosuchlabel", "subdomain": "p.q"},
    "http://www.ck/z": {"suffix": "ck", "registered_domain": "www.ck", "subdomain": ""},
    "http://one.two.three.ck/": {"suffix": "three.ck", "registered_domain": "two.three.ck", "subdomain": "one"},
    "http://line.rail.org.nz/": {"suffix": "org.nz", "registered_domain": "rail.org.nz", "subdomain": "line"},
    "http://harbor.museum:/q": {"host": "harbor.museum:", "registered_domain": "harbor.museum", "canonical": "http://harbor.museum:/q"},
    "http://10.44.7.19/router": {"is_ip": True, "ip_address": "10.44.7.19", "is_private_ip": True, "suffix": ""},
    "http://1.1.1.1/": {"is_ip": True, "is_private_ip": False, "registered_domain": "1.1.1.1"},
    "http://192.0.0.10/": {"is_private_ip": False},
    "http://100.100.3.4/": {"is_private_ip": False},
    "http://10.044.7.19/": {"is_ip": False},
    "http://3232236033/panel": {"is_ip": True, "ip_address": "192.168.2.1", "canonical": "http://192.168.2.1/panel"},
    "http://0xc0a80a21/panel": {"is_ip": True, "ip_address": "192.168.10.33", "is_private_ip": True},
    "http://5000000000/": {"is_ip": False},
    "http://[2001:db8:0:7::5]:8443/x": {"is_ip": True, "host": "2001:db8:0:7::5", "port": 8443, "canonical": "http://2001:db8:0:7::5:8443/x"},
    "https://zürich-reisen.ch/angebote": {
        "is_idn": True, "punycode_host": "xn--zrich-reisen-dlb.ch", "registered_domain": "xn--zrich-reisen-dlb.ch",
    },
    "https://xn--zrich-reisen-dlb.ch/angebote": {"has_punycode": True, "host": "zürich-reisen.ch", "is_idn": True},
    "http://аpple-konto.com/x": {"is_mixed_script": True, "host": "аpple-konto.com"},
    "https://seed.org/east/../west/./oat": {"path": "/west/oat"},
    "https://seed.org/../..": {"path": "/"},
    "https://seed.org//jump/": {"path": "//jump/"},
    "https://seed.org////y//z": {"path": "/y/z"},
    "https://seed.org": {"canonical": "https://seed.org/", "path": "/"},
    "https://seed.org/%73%69g%2Fn": {"path": "/sig%2Fn"},
    "https://seed.org/b%%352": {"path": "/b%52"},
    "https://seed.org/find?term=blue%20oat": {"has_double_encoding": False},
    "https://seed.org/find?term=blue%2520oat": {"has_double_encoding": True, "query": "term=blue%2520oat"},
    "river-poems.info/verse": {"scheme_inferred": True, "scheme": "http", "host": "river-poems.info"},
    " \x02HTTPS://Seed.ORG/B \t": {"canonical": "https://seed.org/B"},
    "http://q.net/y#HTTPS://drop.biz": {"fragment_has_url": True, "canonical": "http://q.net/y"},
    "news:reader@q.net": {"canonical": "http://news:reader@q.net/", "userinfo": "news:reader"},
    # suffixes, from the registries' own pages rather than from the built-in list
    "http://login.bank.com.sg/": {"suffix": "com.sg", "registered_domain": "bank.com.sg"},
    "http://a.shop.com.hk/": {"registered_domain": "shop.com.hk"},
    "http://a.shop.com.my/": {"registered_domain": "shop.com.my"},
    "http://a.shop.com.tw/": {"registered_domain": "shop.com.tw"},
    "http://a.shop.com.pl/": {"registered_domain": "shop.com.pl"},
    "http://a.shop.com.vn/": {"registered_domain": "shop.com.vn"},
    "http://a.shop.co.ke/": {"registered_domain": "shop.co.ke"},
    "http://a.shop.com.sa/": {"registered_domain": "shop.com.sa"},
    "http://www.comune.gov.it/": {"registered_domain": "comune.gov.it"},
    "http://www.amt.gv.at/": {"registered_domain": "amt.gv.at"},
    "http://www.co.de/": {"registered_domain": "co.de"},
}

INVALID = {
    "": "Empty URL",
    " \x00 ": "Empty URL",
    "ftp://mirror.seed.org/pack": "Unsupported scheme: ftp",
    "b" * 8193: "URL exceeds maximum allowed length of 8192 chars",
    "https:///nohost": "URL missing hostname / netloc",
    "http://[fd00::2/x": "Malformed URL: Invalid IPv6 URL",
}


def parse(spark, urls, **kwargs):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    rows = canonicalize_urls(df, **kwargs).collect()
    return {r["url"]: r["parsed"].asDict() for r in rows}


def test_golden_rows(spark):
    got = parse(spark, GOLDEN)
    for url, expected in GOLDEN.items():
        assert got[url]["is_valid"], (url, got[url]["error_message"])
        for field, value in expected.items():
            assert got[url][field] == value, (url, field, got[url][field], value)


def test_rule_table_gives_the_same_domains(spark, tmp_path):
    rules = tmp_path / "rules.dat"
    text = ["// comment", "*.ck", "!www.ck"]
    text += [r["rule"] for r in builtin_rule_table(spark).filter("kind = 'normal'").collect()]
    rules.write_text("\n".join(text + [a + b for a in ascii_lowercase for b in ascii_lowercase]))
    table = read_suffix_rules(spark, str(rules))
    fields = ("suffix", "registered_domain", "subdomain")
    native, joined = parse(spark, GOLDEN), parse(spark, GOLDEN, suffix_rules=table)
    for url in GOLDEN:
        assert [native[url][f] for f in fields] == [joined[url][f] for f in fields], url


def test_error_channel(spark):
    got = parse(spark, INVALID)
    for url, message in INVALID.items():
        assert got[url]["is_valid"] is False
        assert got[url]["error_message"] == message
        assert got[url]["canonical"] is None and got[url]["raw"] == url


def test_null_url_is_empty(spark):
    row = canonicalize_urls(spark.createDataFrame([(None,)], "url string")).first()
    assert row["parsed"]["error_message"] == "Empty URL"


def test_idempotent(spark):
    rng = random.Random(7)
    name = "abcxyz0189-"
    urls = set()
    for _ in range(300):
        host = "".join(rng.choices(name, k=rng.randint(1, 30))) + "." + "".join(rng.choices("abcdemnotz", k=rng.randint(2, 6)))
        path = "".join("/" + "".join(rng.choices(name + "_", k=rng.randint(0, 12))) for _ in range(rng.randint(0, 4)))
        urls.add(rng.choice(["http", "https"]) + "://" + host + path)
    first = {k: v["canonical"] for k, v in parse(spark, urls).items()}
    second = {k: v["canonical"] for k, v in parse(spark, set(first.values())).items()}
    assert all(second[c] == c for c in first.values())


def test_any_text_is_parsed_or_rejected(spark):
    rng = random.Random(11)
    pieces = list("ab:/?#@%[].-_ 09\t\x00\x85") + ["http://", "xn--", "%25", "é", "漢", "а", "²", "😀", "::1", "１", "．"]
    texts = {"".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(600)}
    df = spark.createDataFrame([(t,) for t in texts], "url string")
    parsed = F.col("parsed")
    bad = canonicalize_urls(df).filter(parsed["is_valid"] == parsed["canonical"].isNull()).collect()
    assert bad == []
