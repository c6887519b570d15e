"""Stored tables, retention, robustness and streams."""

import os
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from urlrisk.functions.perturb import STRATEGIES
from urlrisk.operators import robustness, store
from urlrisk.operators.detect import scan_urls
from urlrisk.streaming import feed, scan


def test_scan_records_keep_urls_private(spark):
    df = spark.createDataFrame([("https://a.com/x?t=1#f", True), ("https://b.com/y?t=1", False), ("ftp://c.com/z?q", True)], "url string, store boolean")
    rows = {r["url_defanged"]: r for r in store.scan_records(scan_urls(df, id_cols=["url"]), store=F.col("store")).collect()}
    assert rows["hxxps://a[.]com/x?t=1"]["url_stored"] == "https://a.com/x"
    assert rows["hxxps://b[.]com/y?t=1"]["url_stored"] is None
    assert rows["ftp://c[.]com/z?q"]["url_stored"] == "ftp://c.com/z"
    assert rows["hxxps://b[.]com/y?t=1"]["layers_json"].startswith("{")


def test_retention_drops_old_partitions_only(spark):
    spark.sql("DROP TABLE IF EXISTS scans_t")
    rows = [(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 16, 8)), (3, datetime(2024, 1, 16, 18)), (4, datetime(2024, 2, 10))]
    df = spark.createDataFrame(rows, "id int, created_at timestamp").withColumn("created_date", F.to_date("created_at"))
    df.write.partitionBy("created_date").format("parquet").saveAsTable("scans_t")
    as_of = datetime(2024, 2, 15, 12)
    try:
        assert store.cleanup_scan_table(spark, "scans_t", as_of, 30) == 2
        assert sorted(r["id"] for r in spark.table("scans_t").collect()) == [3, 4]
        assert store.cleanup_scan_table(spark, "scans_t", as_of, 30) == 0
        with pytest.raises(ValueError):
            store.cleanup_scan_table(spark, "scans_t", as_of, 0)
    finally:
        spark.sql("DROP TABLE IF EXISTS scans_t")


def test_retention_follows_the_session_zone_and_survives_a_crash(spark, monkeypatch):
    spark.sql("DROP TABLE IF EXISTS scans_z")
    utc = timezone.utc
    rows = [(1, datetime(2024, 1, 10, tzinfo=utc)), (2, datetime(2024, 1, 16, 11, tzinfo=utc)), (3, datetime(2024, 1, 16, 13, tzinfo=utc))]
    df = spark.createDataFrame(rows, "id int, created_at timestamp").withColumn("created_date", F.to_date("created_at"))
    df.write.partitionBy("created_date").format("parquet").saveAsTable("scans_z")
    zone, clock = os.environ.get("TZ"), time.tzset
    try:
        os.environ["TZ"] = "America/Los_Angeles"  # the driver's zone has no say
        clock()
        dropped = []
        sql = spark.sql
        monkeypatch.setattr(type(spark), "sql", lambda self, q, *a, **k: dropped.append(q) or (_ for _ in ()).throw(OSError()) if q.startswith("ALTER") else sql(q, *a, **k))
        with pytest.raises(OSError):  # lost before the old dates are dropped
            store.cleanup_scan_table(spark, "scans_z", datetime(2024, 2, 15, 12), 30)
        monkeypatch.undo()
        assert sorted(r["id"] for r in spark.table("scans_z").collect()) == [1, 3]
        assert store.cleanup_scan_table(spark, "scans_z", datetime(2024, 2, 15, 12, tzinfo=utc), 30) == 1
        assert sorted(r["id"] for r in spark.table("scans_z").collect()) == [3] and len(dropped) == 1
    finally:
        os.environ.pop("TZ") if zone is None else os.environ.update(TZ=zone)
        clock()
        spark.sql("DROP TABLE IF EXISTS scans_z")


def test_writers_and_quarantine(spark, tmp_path):
    rows = spark.createDataFrame([(1, "correct"), (2, "nonsense"), (3, None)], "scan_id long, label string")
    store.write_feedback(rows, f"{tmp_path}/ok", f"{tmp_path}/bad")
    assert [r["scan_id"] for r in spark.read.parquet(f"{tmp_path}/ok").collect()] == [1]
    assert sorted(r["scan_id"] for r in spark.read.parquet(f"{tmp_path}/bad").collect()) == [2, 3]
    scans = scan_urls(spark.createDataFrame([("http://rnicrosoft.net/x",)], "url string"), id_cols=["url"])
    store.write_scans(store.scan_records(scans, F.lit("2024-01-01").cast("timestamp")), f"{tmp_path}/scans")
    saved = spark.read.parquet(f"{tmp_path}/scans").first()
    assert saved["verdict"] == "suspicious" and str(saved["created_date"]) == "2024-01-01" and saved["url_stored"] is None


def test_lists_round_trip(spark):
    requests = spark.createDataFrame(
        [("k", "allow", " GitHub.io "), ("k", "deny", "Bad.com"), ("k", "deny", "bad.com "), ("k", "block", "x.com"), ("k", "allow", "ok.com")],
        "user_key string, kind string, pattern string",
    )
    accepted, rejected = store.list_entries(requests)
    assert {(r["pattern"], r["reject_reason"]) for r in rejected.collect()} == {("github.io", "multi-tenant host"), ("x.com", "invalid kind")}
    current = store.add_list_entries(accepted.limit(0), accepted)
    assert sorted(r["pattern"] for r in current.collect()) == ["bad.com", "ok.com"]
    assert store.add_list_entries(current, accepted).count() == 0
    left, outcome = store.delete_list_entries(current, requests.filter("pattern like '%ad.com%' or pattern = 'x.com'"))
    assert [r["pattern"] for r in store.read_user_lists(left, " k ").collect()] == ["ok.com"]
    assert {r["pattern"]: r["existed"] for r in outcome.collect()} == {"bad.com": True, "x.com": False}
    assert store.read_user_lists(left, "someone else").count() == 0


URL = "https://netflix.member.parcel-drop.net/login"
PERTURBED = {
    "homoglyph": "https://nеtflix.member.parcel-drop.net/login",
    "subdomain_stuffing": "https://secure-auth-update.signin.netflix.member.parcel-drop.net/login",
    "brand_in_path": URL + "/paypal-security-verification/signin.php",
    "url_extension": URL + ".php",
    "hex_encoding": "https://netflix.member.parcel-drop.net/%6c%6f%67%69%6e",
    "compound_split": "https://net-flix.member.parcel-drop.net/login",
    "benign_padding": URL + "/support-secure-login",
}


def test_perturbations(spark):
    df = spark.createDataFrame([(URL,)], "url string")
    got = {r["strategy"]: r["perturbed"] for r in robustness.perturb_urls(df).collect()}
    assert got == PERTURBED and list(PERTURBED) == list(STRATEGIES)
    queried = spark.createDataFrame([("http://a.com/?x=1",)], "url string")
    got = {r["strategy"]: r["perturbed"] for r in robustness.perturb_urls(queried).collect()}
    assert got["url_extension"] == "http://a.com/.html?x=1" and got["hex_encoding"] == "http://a.com/?x=1/%6c%6f%67%69%6e"
    assert got["brand_in_path"].endswith("x=1&target=paypal_verification_portal")


def test_robustness_counts(spark):
    urls = [URL, "http://10.44.7.19/login", "http://amaz0n-support.net/verify", "ftp://q.net/a"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    strategies = {"benign_padding": STRATEGIES["benign_padding"], "broken": lambda u: F.lit("ftp://nothing")}
    counts = robustness.robustness_by_strategy(df, strategies=strategies).collect()
    got = {r["strategy"]: (r["sample_count"], r["n_detected"]) for r in counts}
    assert got["broken"] == got["clean"] == (4, 3)  # an invalid variant falls back to the original
    report = {r["strategy"]: r for r in robustness.robustness_report(spark.createDataFrame(counts)).collect()}
    assert report["broken"]["recall_drop"] == 0.0 and report["broken"]["clean_recall"] == 0.75
    summary = robustness.robustness_summary(spark.createDataFrame(counts)).first()
    assert summary["total_samples"] == 4


def run(spark, df, name, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


@pytest.fixture()
def url_stream(spark, tmp_path):
    rows = [(f"http://paypa1.com/{i % 3}" if i % 2 else f"https://münchen.de/{i % 3}", f"2024-01-01 0{i % 6}:00:00") for i in range(24)]
    df = spark.createDataFrame(rows, "url string, at string").select("url", F.to_timestamp("at").alias("ts"))
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    return df, spark.readStream.schema(df.schema).parquet(path)


def test_stream_equals_batch(spark, url_stream):
    batch, stream = url_stream
    cols = ["url", "verdict", "risk_score", "url_sha256"]
    lists = spark.createDataFrame([("paypa1.com",)], "pattern string")
    want = sorted(map(tuple, scan_urls(batch, denylist=lists, id_cols=["url"]).select(*cols).collect()))
    streamed = scan.scan_stream(stream, denylist=lists, id_cols=["url"]).select(*cols)
    assert sorted(map(tuple, run(spark, streamed, "scan_out").collect())) == want


def test_windows_and_reuse(spark, url_stream):
    batch, stream = url_stream
    scans = scan.scan_stream(stream, id_cols=["url"])
    counts = run(spark, scan.verdict_counts(scans), "verdicts", "complete")
    assert counts.agg(F.sum("n")).first()[0] == 24
    want = scan.verdict_counts(scan_urls(batch, id_cols=["url"])).collect()
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want))
    first = run(spark, scan.first_verdicts(scan.scan_stream(stream, id_cols=["url"])), "firsts")
    assert 6 <= first.count() <= 24 and first.select("url_sha256").distinct().count() == 6


def test_feed_upsert(spark, tmp_path):
    day = lambda d: datetime(2024, 1, d)
    folder = str(tmp_path / "feed")
    write = feed.upsert_writer(spark, folder, ttl_days=7)
    schema = "source string, url string, ts timestamp"
    write(spark.createDataFrame([("f", "hxxp://a[.]com/x", day(3)), ("f", "http://a.com/x#y", day(5)), ("f", "ftp://no", day(1))], schema), 0)
    second = spark.createDataFrame([("f", "http://a.com/x", day(2)), ("f", "http://b.com/", day(6))], schema)
    write(second, 1)
    write(second, 1)  # a retried batch changes nothing
    rows = {r["url"]: r for r in feed.read_feed(spark, folder).collect()}
    assert (rows["http://a.com/x"]["first_seen"], rows["http://a.com/x"]["last_seen"]) == (day(2), day(5))
    assert rows["http://a.com/x"]["expires_at"] == day(12) and len(rows) == 2
    live = feed.active_patterns(feed.read_feed(spark, folder), F.to_timestamp(F.lit("2024-01-12 12:00:00")))
    assert [r["pattern"] for r in live.collect()] == ["http://b.com/"]
    # a new query starts again at batch 0 and goes on from the stored table; an unfinished version is not read
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{folder}/v=90")
    os.remove(f"{folder}/v=90/_SUCCESS")
    again = feed.upsert_writer(spark, folder, ttl_days=7)
    again(spark.createDataFrame([("f", "http://c.com/", day(7))], schema), 0)
    assert sorted(r["url"] for r in feed.read_feed(spark, folder).collect()) == ["http://a.com/x", "http://b.com/", "http://c.com/"]
    assert len(feed.feed_versions(spark, folder)) == 2
