"""Registered queries over files, stored tables and streams that are written from the given tables and read back."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlrisk.operators import calibrate, detect, store
from urlrisk.operators.ordering import cut_lineage, shared_folder
from urlrisk.operators.reasons import MAX_REASONS, MIN_CONTRIBUTION
from urlrisk.plans import oracle as o
from urlrisk.plans.registry import _BASE, _SCAN, K, KEYS, corpus, listed_scan, register, table
from urlrisk.plans.registry_data import _FEEDBACK, feedback_table, scored_corpus
from urlrisk.plans.registry_models import _ISO
from urlrisk.sources import files
from urlrisk.streaming import feed, feed_table, scan, windows

# --- files ---------------------------------------------------------------------------------------------------


@register("feed_file", "SELECT url, count(*) AS n FROM pages WHERE url <> '' GROUP BY url")
def feed_file(spark, folder):
    """A URL feed with white space and blank lines."""
    path = shared_folder(spark, "feed")
    line = F.concat(F.lit("\t "), F.col("url"), F.lit("  \n \n"))
    table(spark, folder, "pages").where("url is not null").select(line).write.text(path)
    return files.read_url_feed(spark, path).groupBy("url").agg(F.count("*").alias("n"))


@register("ranked_file", "SELECT CAST(page_id + 1 AS INTEGER) AS rank, 'site' || CAST(page_id AS VARCHAR) || '.org' AS domain FROM pages", ints="rank")
def ranked_file(spark, folder):
    path = shared_folder(spark, "ranks")
    domain = F.concat(F.lit("site"), F.col("page_id").cast("string"), F.lit(".org"))
    table(spark, folder, "pages").select(F.col("page_id") + 1, domain).write.csv(path)
    return files.read_ranked_domains(spark, path).select(F.col("rank").cast("long").alias("rank"), "domain")


# --- stored tables -------------------------------------------------------------------------------------------


@register(
    "stored_scans",
    f"{_SCAN}\nSELECT verdict, risk_score, count(*) AS n, count(DISTINCT url_sha256) AS n_urls FROM scan GROUP BY ALL",
)
def stored_scans(spark, folder):
    """Scans written to the stored table and read from it."""
    path = shared_folder(spark, "scans")
    day = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 3600)
    store.write_scans(store.scan_records(listed_scan(spark, folder), day), path)
    rows = spark.read.parquet(path)
    return rows.groupBy("verdict", "risk_score").agg(F.count("*").alias("n"), F.count_distinct("url_sha256").alias("n_urls"))


@register(
    "stored_feedback",
    f"""SELECT CAST(label IN ('false_positive', 'false_negative', 'correct') AS INTEGER) AS accepted, label, count(*) AS n
FROM (SELECT {_FEEDBACK} AS label FROM events) GROUP BY ALL""",
)
def stored_feedback(spark, folder):
    """Accepted feedback and the quarantine table."""
    path = shared_folder(spark, "feedback")
    store.write_feedback(feedback_table(spark, folder), f"{path}/accepted", f"{path}/quarantine")
    read = lambda name, flag: spark.read.parquet(f"{path}/{name}").select("label", F.lit(flag).alias("accepted"))
    return read("accepted", 1).unionByName(read("quarantine", 0)).groupBy("accepted", "label").agg(F.count("*").alias("n"))


@register(
    "retained_scans",
    """SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-02-14 12:00:00' - INTERVAL 30 DAY GROUP BY 1""",
    dates="day",
)
def retained_scans(spark, folder):
    """What a stored table holds after the expired scans are deleted: the boundary date rewritten, older dates dropped."""
    name = f"scans_{uuid.uuid4().hex}"
    rows = table(spark, folder, "events").select("event_id", F.col("ts").alias("created_at"), F.to_date("ts").alias("created_date"))
    rows.write.option("path", f"{shared_folder(spark, 'scans')}/scans").partitionBy("created_date").saveAsTable(name)
    store.cleanup_scan_table(spark, name, datetime(2024, 2, 14, 12), 30)
    left = cut_lineage(spark.table(name).groupBy(F.col("created_date").alias("day")).agg(F.count("*").alias("n")))
    spark.sql(f"DROP TABLE {name}")
    return left


_LINES = """WITH l AS (SELECT DISTINCT event_type, 'http://drop' || CAST(user_id AS VARCHAR) || '.biz/a' AS line FROM events),
f AS (SELECT event_type, count(*) AS n, sha256(string_agg(line || chr(10), '' ORDER BY line)) AS sha256 FROM l GROUP BY event_type)"""


def _feed_files(spark, folder):
    """One text file for each event type, its lines in order."""
    path = f"{shared_folder(spark, 'files')}/feeds"
    line = F.concat(F.lit("http://drop"), F.col("user_id").cast("string"), F.lit(".biz/a"))
    lines = table(spark, folder, "events").select("event_type", line.alias("value")).distinct()
    lines.repartition("event_type").sortWithinPartitions("event_type", "value").write.partitionBy("event_type").text(path)
    return path


def _event_type(file):
    return F.regexp_extract(file, "event_type=([^/]*)/", 1)


@register("artifact_files", f"{_LINES}\nSELECT event_type, sha256, (SELECT count(*) FROM f) AS n_verified FROM f")
def artifact_files(spark, folder):
    """The manifest of a folder of files, and how many files agree with it."""
    path = _feed_files(spark, folder)
    files.artifact_manifest(spark, path, f"{path}-manifest")
    verified = files.verify_artifacts(spark, path, f"{path}-manifest")
    manifest = spark.read.schema("file string, sha256 string").json(f"{path}-manifest").where(F.col("file").like("event_type=%"))
    extra = spark.read.schema("file string, sha256 string").json(f"{path}-manifest").where(~F.col("file").like("event_type=%")).count()
    return manifest.select(_event_type(F.col("file")).alias("event_type"), "sha256", F.lit(verified - extra).cast("long").alias("n_verified"))


@register("feed_sources", f"{_LINES}\nSELECT event_type AS name, sha256, n AS rows, 'CC0-1.0' AS license FROM f")
def feed_sources(spark, folder):
    """Hash and row count of text sources."""
    path = _feed_files(spark, folder)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    paths = found.select("path").collect()  # one per event type
    sources = {p[0].split("event_type=")[1].split("/")[0]: {"path": p[0], "license": "CC0-1.0"} for p in paths}
    return files.source_manifest(spark, sources).select("name", "sha256", "rows", "license")


@register(
    "stored_calibrator",
    f"{_ISO}\nSELECT score, round(fit, 5) AS calibrated FROM lev JOIN iso USING (model, i) WHERE model = 'a'",
)
def stored_calibrator(spark, folder):
    """A calibrator that was saved and loaded again."""
    rows = scored_corpus(spark, folder).where("model = 'a'")
    path = f"{shared_folder(spark, 'calibrator')}/knots"
    calibrate.fit_isotonic(rows).save(spark, path)
    levels = rows.select("score").distinct()
    return calibrate.load_calibrator(spark, path).apply(levels).select("score", F.round("calibrated", 5).alias("calibrated"))


# --- streams -------------------------------------------------------------------------------------------------


def _event_stream(spark, folder):
    static = table(spark, folder, "events")
    return spark.readStream.schema(static.schema).parquet(f"{folder}/events.parquet*")


@register(
    "feed_stream",
    """WITH s AS (SELECT event_type AS source, 'http://drop' || CAST(user_id AS VARCHAR) || '.biz/a' AS url, ts FROM events)
SELECT source, sha256(url) AS url_sha256, url, min(ts) AS first_seen, max(ts) AS last_seen FROM s GROUP BY source, url""",
)
def feed_stream(spark, folder):
    """The feed table after the stream was read twice by queries with checkpoints of their own."""
    path = shared_folder(spark, "feed")
    url = F.concat(F.lit("hxxp://drop"), F.col("user_id").cast("string"), F.lit("[.]biz/a"))
    for run in range(2):
        entries = _event_stream(spark, folder).select(F.col("event_type").alias("source"), url.alias("url"), "ts")
        writer = entries.writeStream.foreachBatch(feed.upsert_writer(spark, f"{path}/table", 7))
        writer.option("checkpointLocation", f"{path}/state{run}").trigger(availableNow=True).start().awaitTermination()
    return feed.read_feed(spark, f"{path}/table").select("source", "url_sha256", "url", "first_seen", "last_seen")


@register(
    "verdict_stream",
    f"""WITH src AS (SELECT event_id AS page_id, 0 AS tpl, 'http://drop' || CAST(user_id AS VARCHAR) || CASE WHEN event_type = 'error' THEN '.biz/login' ELSE '.org/a' END AS url FROM events),
{o.scan('src', K)}
SELECT date_trunc('hour', e.ts) AS window_start, verdict, count(*) AS n FROM scan s JOIN events e ON e.event_id = s.page_id GROUP BY ALL""",
)
def verdict_stream(spark, folder):
    """Verdicts per hour from a stream that is scanned, written and counted by window."""
    path = shared_folder(spark, "verdicts")
    end = F.when(F.col("event_type") == "error", ".biz/login").otherwise(".org/a")
    url = F.concat(F.lit("http://drop"), F.col("user_id").cast("string"), end)
    scans = scan.scan_stream(_event_stream(spark, folder).select("event_id", "ts", url.alias("url")), id_cols=["event_id"])
    writer = scans.select("event_id", "ts", "verdict").writeStream.format("parquet").option("path", f"{path}/scans")
    writer.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType.fromDDL("event_id long, ts timestamp, verdict string")
    return scan.verdict_counts(spark.read.schema(schema).parquet(f"{path}/scans"))


@register(
    "feed_table_stream",
    """WITH s AS (SELECT event_type AS source, 'http://drop' || CAST(user_id AS VARCHAR) || '.biz/a' AS url, ts FROM events)
SELECT source, sha256(url) AS url_sha256, url, min(ts) AS first_seen, max(ts) AS last_seen FROM s GROUP BY source, url""",
)
def feed_table_stream(spark, folder):
    """The same feed in hash-prefix partitions: errors first, then everything, by two queries."""
    path = shared_folder(spark, "feed")
    url = F.concat(F.lit("hxxp://drop"), F.col("user_id").cast("string"), F.lit("[.]biz/a"))
    for run, rows in enumerate((F.col("event_type") == "error", F.lit(True))):
        entries = _event_stream(spark, folder).where(rows).select(F.col("event_type").alias("source"), url.alias("url"), "ts")
        writer = entries.writeStream.foreachBatch(feed_table.upsert_prefixes(spark, f"{path}/table", 7))
        writer.option("checkpointLocation", f"{path}/state{run}").trigger(availableNow=True).start().awaitTermination()
    return feed_table.read_feed_table(spark, f"{path}/table").select("source", "url_sha256", "url", "first_seen", "last_seen")


@register(
    "reused_verdicts",
    f"""WITH RECURSIVE src AS (SELECT event_id AS page_id, 0 AS tpl, 'http://drop' || CAST(user_id AS VARCHAR) || CASE WHEN event_type = 'error' THEN '.biz/login' ELSE '.org/a' END AS url FROM events),
{o.scan('src', K)},
e AS (SELECT e.event_id, e.ts, url_sha256, verdict, row_number() OVER (PARTITION BY url_sha256 ORDER BY e.ts, CAST(e.event_id AS VARCHAR)) AS i FROM scan s JOIN events e ON e.event_id = s.page_id),
w AS (SELECT url_sha256, i, event_id, verdict, ts AS started, event_id AS first_id FROM e WHERE i = 1
  UNION ALL SELECT e.url_sha256, e.i, e.event_id, e.verdict, CASE WHEN e.ts - w.started < INTERVAL 10 MINUTE THEN w.started ELSE e.ts END,
    CASE WHEN e.ts - w.started < INTERVAL 10 MINUTE THEN w.first_id ELSE e.event_id END FROM w JOIN e ON e.url_sha256 = w.url_sha256 AND e.i = w.i + 1)
SELECT CAST(event_id AS VARCHAR) AS event_id, verdict, CAST(first_id AS VARCHAR) AS answered_by, CAST(event_id <> first_id AS INTEGER) AS reused FROM w""",
)
def reused_verdicts(spark, folder):
    """Every event is a scan; repeats within ten minutes are answered with the stored verdict."""
    path = shared_folder(spark, "reuse")
    end = F.when(F.col("event_type") == "error", ".biz/login").otherwise(".org/a")
    url = F.concat(F.lit("http://drop"), F.col("user_id").cast("string"), end)
    scans = scan.scan_stream(_event_stream(spark, folder).select("event_id", "ts", url.alias("url")), id_cols=["event_id"])
    answers = scan.reuse_verdicts(scans, "event_id")
    writer = answers.select("event_id", "verdict", "answered_by", F.col("reused").cast("int").alias("reused")).writeStream.format("parquet")
    writer = writer.option("path", f"{path}/answers").option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id string, verdict string, answered_by string, reused int").parquet(f"{path}/answers")


@register(
    "window_stream",
    """WITH b AS (SELECT *, CASE WHEN event_type = 'error' THEN 3 ELSE least(day(ts) // 8, 3) END AS batch, date_trunc('hour', ts) AS w FROM events),
m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 MINUTE AS mark FROM b GROUP BY batch),
j AS (SELECT b.*, coalesce(w + INTERVAL 1 HOUR <= mark, FALSE) AS late FROM b JOIN m USING (batch)),
e AS (SELECT max(ts) - INTERVAL 10 MINUTE AS last FROM events)
SELECT w AS window_start, event_type, 'counted' AS kind, count(*) AS n FROM j, e WHERE NOT late AND w + INTERVAL 1 HOUR <= last GROUP BY ALL
UNION ALL SELECT w, event_type, 'late', count(*) FROM j WHERE late GROUP BY ALL""",
)
def window_stream(spark, folder):
    """Events per hour from a stream of four files, the errors all in the last: closed windows, and the rows that came too late for theirs."""
    path = shared_folder(spark, "windows")
    events = table(spark, folder, "events").select("ts", "event_type")
    file = F.when(F.col("event_type") == "error", 3).otherwise(F.least(F.floor(F.dayofmonth("ts") / 8), F.lit(3)))
    for nr in range(4):
        events.where(file == nr).coalesce(1).write.parquet(f"{path}/in/file={nr}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    writer = stream.select("ts", "event_type").writeStream.foreachBatch(windows.window_writer(spark, f"{path}/out", by="event_type"))
    writer.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    counted = windows.closed_windows(spark, f"{path}/out", "event_type").select("window_start", "event_type", F.lit("counted").alias("kind"), "n")
    late = windows.late_rows(spark, f"{path}/out").groupBy(F.date_trunc("hour", "ts").alias("window_start"), "event_type").agg(F.count("*").alias("n"))
    return counted.unionByName(late.select("window_start", "event_type", F.lit("late").alias("kind"), "n"))


# --- a scorer in the layered scan ----------------------------------------------------------------------------

# weight of each reason's feature; the reasons of a score are its parts
_PARTS = {
    "ip_host": (1.9, "is_ip_host", 0.0),
    "typosquat_brand": (1.7, "typosquat_detected", 0.0),
    "suspicious_keywords": (0.83, "suspicious_keyword_count", 0.0),
    "high_entropy": (0.61, "entropy_url", 3.9),
    "excessive_subdomains": (0.47, "n_subdomains", 1.0),
}
_BIAS = -1.1
_VALUES = ", ".join(f"{{'v': {w}::DOUBLE * ({f} - {m}), 'c': '{code}'}}" for code, (w, f, m) in _PARTS.items())
_LOGIT = " + ".join(f"{w}::DOUBLE * ({f} - {m})" for w, f, m in _PARTS.values())


def fixed_scorer(df):
    """``model_probability`` and ``contributions`` from fixed weights."""
    parts = {code: F.lit(w) * (F.col(f"features.{f}") - m) for code, (w, f, m) in _PARTS.items()}
    entries = [x for code, part in parts.items() for x in (F.lit(code), part)]
    df = df.withColumn("contributions", F.when(F.col("features").isNotNull(), F.create_map(*entries)))
    total = sum(parts.values(), F.lit(_BIAS))
    return df.withColumn("model_probability", 1 / (1 + F.exp(-total)))


@register(
    "model_scan",
    f"""{_BASE}, {o.scan('corpus', K)},
m AS (SELECT s1.page_id, s1.tpl, layer, found, 1 / (1 + exp(-({_BIAS} + {_LOGIT}))) AS p, list_reverse_sort(list_filter([{_VALUES}],
        lambda x: x.v > {MIN_CONTRIBUTION} AND NOT list_contains(found, x.c))) AS extra
      FROM s1 JOIN feat f ON s1.page_id = f.page_id AND s1.tpl = f.tpl WHERE layer = 'model'),
r AS (SELECT *, list_concat(found, list_transform(extra, lambda x: x.c))[1:{MAX_REASONS}] AS codes FROM m)
SELECT page_id, tpl, round(p, 4) AS probability, CASE WHEN p >= 0.7 THEN 'malicious' WHEN p >= 0.35 THEN 'suspicious' ELSE 'no_threat_found' END AS verdict,
  CASE WHEN len(codes) = 0 AND p >= 0.35 THEN 'elevated_ml_risk' ELSE array_to_string(codes, ',') END AS codes FROM r""",
)
def model_scan(spark, folder):
    """The scan with a scorer: its probability decides, and its contributions add reasons after those of the rules."""
    scans = detect.scan_urls(corpus(spark, folder), scorer=fixed_scorer, contributions="contributions", model_version="fixed", id_cols=KEYS)
    scored = scans.where(F.col("layers.ml") == "scored")
    return scored.select(*KEYS, "probability", "verdict", F.array_join("reasons.code", ",").alias("codes"))
