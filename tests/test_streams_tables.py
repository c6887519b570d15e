"""Verdict reuse, the feed table in prefixes, and suffix rules from a file."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from urlrisk.operators.canonical import canonicalize_urls
from urlrisk.sources.suffixes import read_suffix_rules
from urlrisk.streaming import feed_table, scan, windows

START = datetime(2024, 1, 1)


def test_repeats_get_the_stored_verdict(spark, tmp_path):
    minutes = {"a": [0, 4, 9, 10, 12, 19, 20, 45], "b": [3], "c": [7, 7, 7]}
    rows = [(f"{key}{i}", START + timedelta(minutes=m), "m", key, f"v{m}", m) for key, ms in minutes.items() for i, m in enumerate(ms)]
    schema = "id string, ts timestamp, model_version string, url_sha256 string, verdict string, risk_score int"
    for part in range(3):  # several batches; the second holds the middle of each key's scans
        spark.createDataFrame([r for i, r in enumerate(rows) if i * 3 // len(rows) == part], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    writer = scan.reuse_verdicts(stream, "id").writeStream.format("parquet").option("path", str(tmp_path / "out"))
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(200)
    got = {r["id"]: (r["answered_by"], r["verdict"], r["reused"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == len(rows)
    assert [got[f"a{i}"][0] for i in range(8)] == ["a0", "a0", "a0", "a3", "a3", "a3", "a6", "a7"]
    assert got["a2"] == ("a0", "v0", True) and got["a3"] == ("a3", "v10", False) and got["b0"] == ("b0", "v3", False)
    assert [got[f"c{i}"][2] for i in range(3)] == [False, True, True]


def test_a_batch_rewrites_its_prefixes_only(spark, tmp_path):
    folder = str(tmp_path / "feed")
    day = lambda d: datetime(2024, 1, d)
    schema = "source string, url string, ts timestamp"
    write = feed_table.upsert_prefixes(spark, folder, ttl_days=7, keep=1)
    write(spark.createDataFrame([("f", f"http://h{i}.com/", day(3)) for i in range(40)], schema), 0)
    before = feed_table.live_prefixes(spark, folder)
    one = spark.createDataFrame([("f", "http://h5.com/", day(1))], schema)
    write(one, 1)
    write(one, 2)  # a retried batch changes nothing but its version
    after = feed_table.live_prefixes(spark, folder)
    changed = [p for p in after if after[p] != before[p]]
    assert len(changed) == 1 and len(after) == len(before) > 20
    rows = {r["url"]: r for r in feed_table.read_feed_table(spark, folder).collect()}
    assert len(rows) == 40 and (rows["http://h5.com/"]["first_seen"], rows["http://h5.com/"]["last_seen"]) == (day(1), day(3))
    assert rows["http://h5.com/"]["expires_at"] == day(10)
    # what nobody reads is gone, a new query goes on from the stored table
    assert feed_table.feed_versions(spark, folder) == [0, 2]
    feed_table.upsert_prefixes(spark, folder, 7)(spark.createDataFrame([("g", "http://new.org/", day(4))], schema), 0)
    assert feed_table.read_feed_table(spark, folder).count() == 41
    assert feed_table.read_feed_table(spark, folder, ["zz"]) is None


def test_two_writers_never_share_a_version(spark, tmp_path):
    folder = str(tmp_path / "feed")
    feed_table._claim(spark, folder, 0)
    row = spark.createDataFrame([("f", "http://a.com/", START)], "source string, url string, ts timestamp")
    try:
        feed_table.upsert_prefixes(spark, folder)(row, 0)
        raise AssertionError("a claimed version was written")
    except Exception as refused:
        assert "exist" in str(refused).lower()


def test_suffix_rules_of_any_depth(spark, tmp_path):
    """Expected names are written by hand, apart from the rules."""
    path = tmp_path / "rules"
    path.write_text("// comment\ncom\n*.ck\n!www.ck\nuk\nco.uk\n*.compute.example.com\n!city.kobe.jp\n*.kobe.jp\njp\na.b.c.d.e.net\nnet\n")
    table = read_suffix_rules(spark, str(path))
    want = {
        "x.y.com": "y.com", "com": "com", "a.www.ck": "www.ck", "a.b.c.ck": "b.c.ck", "ck": "ck", "b.ck": "b.ck", "p.q.co.uk": "q.co.uk", "q.uk": "q.uk",
        "n.s.m.compute.example.com": "s.m.compute.example.com", "example.com": "example.com", "x.city.kobe.jp": "city.kobe.jp", "x.y.z.kobe.jp": "y.z.kobe.jp",
        "u.v.a.b.c.d.e.net": "v.a.b.c.d.e.net", "b.c.d.e.net": "e.net", "no.such.label": "no.such.label",
    }
    df = spark.createDataFrame([(f"http://{h}/", h) for h in want], "url string, name string")
    got = {r["name"]: r["d"] for r in canonicalize_urls(df, suffix_rules=table).select("name", F.col("parsed.registered_domain").alias("d")).collect()}
    assert got == want


def test_late_rows_go_to_the_side_table(spark, tmp_path):
    folder = str(tmp_path / "windows")
    at = lambda h, m=0: START + timedelta(hours=h, minutes=m)
    schema = "ts timestamp, verdict string"
    write = windows.window_writer(spark, folder)
    write(spark.createDataFrame([(at(0), "a"), (at(0, 59), "a"), (at(1, 9), "b")], schema), 0)
    # the first window closes at 1:10; the second batch still counts into it, and reaches 3:30
    second = spark.createDataFrame([(at(0, 30), "a"), (at(3, 30), "a")], schema)
    write(second, 1)
    write(second, 1)  # a retry changes nothing
    write(spark.createDataFrame([(at(0, 1), "a"), (at(1, 59), "b"), (at(2, 30), "c"), (at(3, 1), "c")], schema), 2)
    late = sorted((r["ts"], r["verdict"]) for r in windows.late_rows(spark, folder).collect())
    assert late == [(at(0, 1), "a"), (at(1, 59), "b"), (at(2, 30), "c")]
    closed = {(r["window_start"], r["verdict"]): r["n"] for r in windows.closed_windows(spark, folder).collect()}
    assert closed == {(at(0), "a"): 3, (at(1), "b"): 1}
