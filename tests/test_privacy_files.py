"""Privacy helpers, catalogs and file sources."""

import hashlib

import pytest
from pyspark.sql import functions as F

from urlrisk.functions import privacy
from urlrisk.sources import catalogs, files

DEFANG = {
    "https://drop.point.biz/box": "hxxps://drop[.]point[.]biz/box",
    "http://a.b.c.net/d/e.htm?f=g.h": "hxxp://a[.]b[.]c[.]net/d/e.htm?f=g.h",
    "https://library.org@fast.net/inbox": "hxxps://library[.]org@fast[.]net/inbox",
    "http://10.44.7.19:8888/router": "hxxp://10[.]44[.]7[.]19:8888/router",
    "https://xn--zrich-reisen-dlb.ch/a": "hxxps://xn--zrich-reisen-dlb[.]ch/a",
    "river-poems.info/v.1": "river-poems[.]info/v.1",
    "gopher://q.r/s.t": "gopher://q[.]r/s.t",
    "": "",
}


def test_defang_refang_redact_hash(spark):
    u = F.col("u")
    df = spark.createDataFrame([(x,) for x in DEFANG], "u string")
    got = {r["u"]: r for r in df.select("u", privacy.defang(u).alias("d"), privacy.refang(privacy.defang(u)).alias("r")).collect()}
    for url, expected in DEFANG.items():
        assert got[url]["d"] == expected and got[url]["r"] == url
    row = spark.range(1).select(
        privacy.redact_query(F.lit("https://seed.org/find?term=oat#top")),
        privacy.sha256_url(F.lit("https://seed.org")),
        privacy.hash_key(F.lit("\u00a0 key\t\n")),
        privacy.refang(F.lit("HXXP://q(.)r(:)81(/)s")),
    ).first()
    assert row[0] == "https://seed.org/find"
    assert row[1] == hashlib.sha256(b"https://seed.org").hexdigest()
    assert row[2] == hashlib.sha256(b"key").hexdigest()
    assert row[3] == "http://q.r:81/s"


def test_label_inversion(spark):
    df = spark.createDataFrame([(1,), (0,)], "x int")
    assert [r[0] for r in df.select(privacy.invert_label(F.col("x"))).collect()] == [0, 1]
    with pytest.raises(Exception, match="Unexpected raw label: 99"):
        spark.createDataFrame([(99,)], "x int").select(privacy.invert_label(F.col("x"))).collect()


def test_catalogs(spark, tmp_path):
    assert len({a.brand for a in catalogs.brand_aliases()}) == 16
    assert len({a.brand for a in catalogs.brand_aliases(str(tmp_path / "none.yaml"))}) == 14
    custom = tmp_path / "brands.json"
    custom.write_text('{"brands": [{"name": "Acme", "canonical_domain": "ACME.com", "aliases": ["acme", "ab"]}]}')
    assert [(a.brand, a.domain, a.alias) for a in catalogs.brand_aliases(str(custom))] == [("acme", "acme.com", "acme")]
    assert len(catalogs.reason_catalog()) == 15
    override = tmp_path / "reasons.json"
    override.write_text('{"reasons": {"ip_host": {"severity": "low", "text": "A number.", "target_segment": "host"}}}')
    merged = catalogs.reason_catalog(str(override))
    assert merged["ip_host"].severity == "low" and len(merged) == 15
    hosts = tmp_path / "hosts.txt"
    hosts.write_text("# list\ngithub.io\n\nWeb.app\n")
    assert {r["host"] for r in catalogs.read_host_list(spark, str(hosts)).collect()} == {"github.io", "web.app"}
    assert catalogs.brand_table(spark).count() == len(catalogs.brand_aliases())


def test_feeds_and_manifests(spark, tmp_path):
    feed, ranks = tmp_path / "feed.txt", tmp_path / "ranks.csv"
    feed.write_text("http://a.com/x\n\n  http://b.com/y \n")
    ranks.write_text("1,google.com\n2,example.org\n")
    assert [r["url"] for r in files.read_url_feed(spark, str(feed)).collect()] == ["http://a.com/x", "http://b.com/y"]
    assert files.read_ranked_domains(spark, str(ranks)).orderBy("rank").first()["domain"] == "google.com"
    rows = files.source_manifest(
        spark, {"feed": {"path": str(feed), "license": "research"}, "ranks": {"path": str(ranks)}}
    ).collect()
    got = {r["name"]: r for r in rows}
    assert got["feed"]["rows"] == 2 and got["ranks"]["rows"] == 2
    assert got["feed"]["sha256"] == hashlib.sha256(feed.read_bytes()).hexdigest()

    folder = tmp_path / "model"
    folder.mkdir()
    (folder / "a.json").write_text("{}")
    (folder / "b.json").write_text("[]")
    files.artifact_manifest(spark, str(folder), str(tmp_path / "manifest"))
    assert files.verify_artifacts(spark, str(folder), str(tmp_path / "manifest")) == 2
    (folder / "b.json").unlink()  # absent files are skipped
    assert files.verify_artifacts(spark, str(folder), str(tmp_path / "manifest")) == 1
    (folder / "a.json").write_text("{ }")
    with pytest.raises(files.TamperedArtifactError):
        files.verify_artifacts(spark, str(folder), str(tmp_path / "manifest"))
