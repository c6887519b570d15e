"""Registered queries on datasets, stores, evaluation and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlrisk.functions import privacy
from urlrisk.operators import dataset, evaluate, store
from urlrisk.operators.dataset import REQUIRED_COLUMNS
from urlrisk.plans import oracle as o
from urlrisk.plans.registry import (
    _BASE,
    _SCAN,
    K,
    KEYS,
    corpus,
    event_lists,
    listed_scan,
    parsed_corpus,
    register,
    table,
)
from urlrisk.sources.corpus import TEMPLATES
from urlrisk.streaming import feed, scan

# --- dataset and splits ------------------------------------------------------------------------------------

_DATA = f"""{_BASE}, {o.canon('corpus', 'page_id, tpl, label, source, first_seen')},
data AS (SELECT raw AS url_raw, u AS url, label, source, first_seen, host, registered_domain, suffix AS tld,
           CAST(NULL AS VARCHAR) AS target_brand, 'train' AS split, sha256(u) AS url_sha256 FROM canon WHERE ok)"""
_SPLIT = f"""{_DATA}, dom AS (SELECT registered_domain, min(first_seen) AS first_seen, count(*) AS n_urls FROM data GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY first_seen, registered_domain) - 1 AS place, count(*) OVER () AS n FROM dom),
dsplit AS (SELECT registered_domain, first_seen, n_urls, CASE WHEN place < floor(n * 0.7) THEN 'train' WHEN place < floor(n * 0.7) + floor(n * 0.1) THEN 'val'
             WHEN place < floor(n * 0.7) + 2 * floor(n * 0.1) THEN 'calib' ELSE 'test' END AS split FROM ranked),
split_data AS (SELECT d.* EXCLUDE (split), s.split FROM data d JOIN dsplit s USING (registered_domain))"""


def dataset_table(spark, folder):
    rows = corpus(spark, folder).withColumnRenamed("url", "url_raw")
    return dataset.dataset_rows(rows)


def split_table(spark, folder):
    return dataset.assign_splits(dataset_table(spark, folder))


@register("dataset_rows", f"{_DATA}\nSELECT {', '.join(REQUIRED_COLUMNS)} FROM data", dates="first_seen")
def dataset_rows(spark, folder):
    rows = dataset_table(spark, folder)
    dataset.validate_dataset(rows)
    return rows.withColumn("label", F.col("label").cast("int"))


@register("dataset_labels", f"{_DATA}\nSELECT DISTINCT label FROM data")
def dataset_labels(spark, folder):
    return dataset.distinct_labels(dataset_table(spark, folder)).select(F.col("label").cast("int").alias("label"))


@register(
    "source_union",
    f"""WITH both_sources AS (SELECT 'pages' AS source, 0 AS label, url FROM pages
  UNION ALL SELECT 'feed_' || event_type, 1, 'http://drop' || CAST(user_id AS VARCHAR) || '.biz/a' FROM events), {o.canon('both_sources', 'source, label')}
SELECT source, label, count(*) AS n, count(DISTINCT u) AS n_urls, count(DISTINCT registered_domain) AS n_domains FROM canon WHERE ok GROUP BY ALL""",
)
def source_union(spark, folder):
    """Dataset rows of two sources: the pages as benign, the events' addresses as feeds."""
    pages = table(spark, folder, "pages").select("url", F.lit("pages").alias("source"), F.lit(0).alias("label"), F.lit("2026-01-01").cast("date").alias("first_seen"))
    url = F.concat(F.lit("http://drop"), F.col("user_id").cast("string"), F.lit(".biz/a"))
    feeds = table(spark, folder, "events").select(
        url.alias("url"), F.concat(F.lit("feed_"), "event_type").alias("source"), F.lit(1).alias("label"), F.to_date("ts").alias("first_seen")
    )
    rows = dataset.dataset_rows(pages.unionByName(feeds).withColumnRenamed("url", "url_raw"))
    return rows.groupBy("source", F.col("label").cast("int").alias("label")).agg(
        F.count("*").alias("n"), F.count_distinct("url").alias("n_urls"), F.count_distinct("registered_domain").alias("n_domains")
    )


@register("time_order", f"{_DATA}\nSELECT first_seen, url_sha256, source FROM data", dates="first_seen")
def time_order(spark, folder):
    return dataset.sort_by_time(dataset_table(spark, folder)).select("first_seen", "url_sha256", "source")


@register("domain_first_seen", f"{_SPLIT}\nSELECT registered_domain, first_seen, n_urls FROM dom", dates="first_seen")
def domain_first_seen(spark, folder):
    return dataset.domain_first_seen(dataset_table(spark, folder))


@register("domain_splits", f"{_SPLIT}\nSELECT registered_domain, first_seen, n_urls, split FROM dsplit", dates="first_seen")
def domain_splits(spark, folder):
    return dataset.domain_splits(dataset_table(spark, folder))


@register("split_rows", f"{_SPLIT}\nSELECT url_raw, url_sha256, registered_domain, split FROM split_data")
def split_rows(spark, folder):
    return split_table(spark, folder).select("url_raw", "url_sha256", "registered_domain", "split")


@register("test_rows", f"{_SPLIT}\nSELECT url_raw, url_sha256, label FROM split_data WHERE split = 'test'")
def test_rows(spark, folder):
    rows = split_table(spark, folder).filter("split = 'test'")
    return rows.select("url_raw", "url_sha256", F.col("label").cast("int").alias("label"))


@register(
    "split_counts",
    f"""{_SPLIT}
SELECT split, count(*) AS n_rows, count(DISTINCT url_sha256) AS n_urls, count(DISTINCT registered_domain) AS n_domains
FROM split_data GROUP BY split""",
)
def split_counts(spark, folder):
    return dataset.split_counts(split_table(spark, folder))


_WORDS = ", ".join(f"sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS w{i}" for i in range(4))


@register(
    "manifest_hash",
    f"""{_SPLIT}, pairs AS (SELECT sha256(url_sha256 || ':' || split) AS h FROM (SELECT DISTINCT url_sha256, split FROM split_data)),
sums AS (SELECT count(*) AS total_urls, {_WORDS} FROM pairs)
SELECT total_urls, sha256(total_urls || ':' || w0 || ':' || w1 || ':' || w2 || ':' || w3) AS manifest_hash FROM sums""",
)
def manifest_hash(spark, folder):
    return dataset.manifest_hash(dataset.split_assignments(split_table(spark, folder)))


@register(
    "split_overlap",
    f"""{_DATA}, naive AS (SELECT registered_domain, CASE WHEN substr(url_sha256, 1, 1) < '8' THEN 'train' ELSE 'test' END AS split FROM data)
SELECT registered_domain, count(DISTINCT split) AS n_splits FROM naive GROUP BY 1 HAVING count(DISTINCT split) > 1""",
)
def split_overlap(spark, folder):
    """The check applied to a split by URL hash, which does put one domain into both parts."""
    naive = F.when(F.substring("url_sha256", 1, 1) < "8", "train").otherwise("test")
    return dataset.split_overlap(dataset_table(spark, folder).withColumn("split", naive))


@register(
    "url_dedupe",
    f"""{_DATA}
SELECT url_sha256, min(url) AS url, arg_min(url_raw, (CAST(first_seen AS VARCHAR), url_raw)) AS url_raw, min(first_seen) AS first_seen
FROM data GROUP BY url_sha256""",
    dates="first_seen",
)
def url_dedupe(spark, folder):
    return dataset.dedupe_urls(dataset_table(spark, folder)).select("url_sha256", "url", "url_raw", "first_seen")


# --- stored tables --------------------------------------------------------------------------------------

_LIST_REQ = """req AS (SELECT event_id, ' user-' || CAST(user_id % 10 AS VARCHAR) || ' ' AS user_key,
    CASE event_type WHEN 'error' THEN 'deny' WHEN 'click' THEN 'block' ELSE 'allow' END AS kind,
    '  Site' || CAST(event_id % 500 AS VARCHAR) || CASE WHEN event_type = 'view' THEN '.GitHub.io ' ELSE '.example.com' END AS pattern FROM events),
clean AS (SELECT event_id, sha256(trim(user_key)) AS owner_key_hash, kind, lower(trim(pattern)) AS pattern,
    CASE WHEN kind NOT IN ('allow', 'deny') THEN 'invalid kind' WHEN kind = 'allow' AND pattern LIKE '%.GitHub.io ' THEN 'multi-tenant host' END AS reject_reason FROM req),
cur AS (SELECT sha256('user-' || CAST(page_id % 10 AS VARCHAR)) AS owner_key_hash, 'allow' AS kind, 'site' || CAST(page_id AS VARCHAR) || '.example.com' AS pattern FROM pages)"""


def list_requests(spark, folder):
    kind = F.when(F.col("event_type") == "error", "deny").when(F.col("event_type") == "click", "block").otherwise("allow")
    ending = F.when(F.col("event_type") == "view", ".GitHub.io ").otherwise(".example.com")
    return table(spark, folder, "events").select(
        "event_id",
        F.concat(F.lit(" user-"), (F.col("user_id") % 10).cast("string"), F.lit(" ")).alias("user_key"),
        kind.alias("kind"),
        F.concat(F.lit("  Site"), (F.col("event_id") % 500).cast("string"), ending).alias("pattern"),
    )


def current_lists(spark, folder):
    owner = F.concat(F.lit("user-"), (F.col("page_id") % 10).cast("string"))
    return table(spark, folder, "pages").select(
        privacy.hash_key(owner).alias("owner_key_hash"),
        F.lit("allow").alias("kind"),
        F.concat(F.lit("site"), F.col("page_id").cast("string"), F.lit(".example.com")).alias("pattern"),
    )


@register(
    "list_additions",
    f"""WITH {_LIST_REQ}
SELECT DISTINCT owner_key_hash, kind, pattern FROM clean WHERE reject_reason IS NULL
  AND NOT EXISTS (SELECT 1 FROM cur WHERE cur.owner_key_hash = clean.owner_key_hash AND cur.kind = clean.kind AND cur.pattern = clean.pattern)""",
)
def list_additions(spark, folder):
    accepted, _ = store.list_entries(list_requests(spark, folder))
    return store.add_list_entries(current_lists(spark, folder), accepted).select("owner_key_hash", "kind", "pattern")


@register("list_rejects", f"WITH {_LIST_REQ}\nSELECT event_id, kind, pattern, reject_reason FROM clean WHERE reject_reason IS NOT NULL")
def list_rejects(spark, folder):
    _, rejected = store.list_entries(list_requests(spark, folder))
    return rejected.select("event_id", "kind", "pattern", "reject_reason")


@register(
    "list_deletions",
    f"""WITH {_LIST_REQ}
SELECT DISTINCT owner_key_hash, kind, pattern, EXISTS (SELECT 1 FROM cur WHERE cur.owner_key_hash = clean.owner_key_hash
  AND cur.kind = clean.kind AND cur.pattern = clean.pattern)::INTEGER AS existed FROM clean""",
)
def list_deletions(spark, folder):
    _, outcome = store.delete_list_entries(current_lists(spark, folder), list_requests(spark, folder))
    return outcome.withColumn("existed", F.col("existed").cast("int"))


@register(
    "list_remaining",
    f"""WITH {_LIST_REQ}
SELECT * FROM cur WHERE NOT EXISTS (SELECT 1 FROM clean WHERE cur.owner_key_hash = clean.owner_key_hash
  AND cur.kind = clean.kind AND cur.pattern = clean.pattern)""",
)
def list_remaining(spark, folder):
    remaining, _ = store.delete_list_entries(current_lists(spark, folder), list_requests(spark, folder))
    return remaining


@register(
    "user_lists",
    """SELECT DISTINCT sha256('user-' || CAST(user_id % 10 AS VARCHAR)) AS owner_key_hash, CASE WHEN event_type = 'error' THEN 'deny' ELSE 'allow' END AS kind,
  'evil' || CAST(event_id AS VARCHAR) || CASE WHEN event_type = 'view' THEN '.com' ELSE '.ru' END AS pattern FROM events""",
)
def user_lists(spark, folder):
    return store.read_user_lists(event_lists(spark, folder))


_FEEDBACK = "CASE event_type WHEN 'error' THEN 'false_positive' WHEN 'click' THEN 'false_negative' WHEN 'view' THEN 'correct' ELSE event_type END"


def feedback_table(spark, folder):
    e = F.col("event_type")
    label = F.when(e == "error", "false_positive").when(e == "click", "false_negative").when(e == "view", "correct")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("scan_id"), F.coalesce(label, e).alias("label"), "user_id", "ts"
    )


@register(
    "feedback_accepted",
    f"""SELECT scan_id, label, 'new' AS review_status FROM (SELECT event_id AS scan_id, {_FEEDBACK} AS label FROM events)
WHERE label IN ('false_positive', 'false_negative', 'correct')""",
)
def feedback_accepted(spark, folder):
    return store.split_feedback(feedback_table(spark, folder))[0].select("scan_id", "label", "review_status")


@register(
    "feedback_rejected",
    f"""SELECT scan_id, label FROM (SELECT event_id AS scan_id, {_FEEDBACK} AS label FROM events)
WHERE label NOT IN ('false_positive', 'false_negative', 'correct')""",
)
def feedback_rejected(spark, folder):
    return store.split_feedback(feedback_table(spark, folder))[1].select("scan_id", "label")


_AT = "TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(page_id AS INTEGER))"


def stored_scans(spark, folder):
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(hours=F.col("page_id").cast("int"))
    return store.scan_records(
        listed_scan(spark, folder).withColumn("_at", at), F.col("_at"), F.col("page_id") % 2 == 0, F.lit("batch")
    )


@register(
    "scan_records",
    f"""{_SCAN}, shown AS (SELECT *, CASE WHEN url_canonical <> '' THEN url_canonical ELSE raw END AS s FROM scan),
cut AS (SELECT *, regexp_extract(s, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1) AS sch FROM shown),
auth AS (SELECT *, CASE WHEN sch = '' THEN s ELSE substr(s, length(sch) + 4) END AS body FROM cut)
SELECT sha256(CAST(page_id AS VARCHAR) || chr(31) || CAST(tpl AS VARCHAR)) AS id, {_AT} AS created_at, CAST({_AT} AS DATE) AS created_date, url_sha256,
  CASE WHEN page_id % 2 = 0 AND s <> '' THEN regexp_replace(s, '[?#].*$', '') END AS url_stored,
  (CASE WHEN sch = '' THEN '' WHEN sch = 'http' THEN 'hxxp://' WHEN sch = 'https' THEN 'hxxps://' ELSE sch || '://' END)
    || replace(regexp_extract(body, '^([^/?#]*)', 1), '.', '[.]') || substr(body, length(regexp_extract(body, '^([^/?#]*)', 1)) + 1) AS url_defanged,
  registered_domain, verdict, risk_score, probability, 'batch' AS client, len(codes) AS n_reasons
FROM auth""",
    doubles="probability", dates="created_date",
)
def scan_records(spark, folder):
    rows = stored_scans(spark, folder)
    n = F.size(F.from_json("reasons_json", "array<struct<code:string>>"))
    names = "id created_at created_date url_sha256 url_stored url_defanged registered_domain verdict risk_score probability client"
    return rows.select(*names.split(), n.alias("n_reasons"))


@register(
    "retention",
    """SELECT CAST(ts AS DATE) AS day, sum(CAST(ts < TIMESTAMP '2024-02-14 12:00:00' - INTERVAL 30 DAY AS INTEGER)) AS n_expired, count(*) AS n
FROM events GROUP BY 1""",
    ints="n_expired", dates="day",
)
def retention(spark, folder):
    scans = table(spark, folder, "events").select(F.col("ts").alias("created_at"))
    marked = store.retention_split(scans, F.to_timestamp(F.lit("2024-02-14 12:00:00")), 30)
    return marked.groupBy(F.to_date("created_at").alias("day")).agg(
        F.sum(F.col("expired").cast("int")).alias("n_expired"), F.count("*").alias("n")
    )


@register(
    "feed_entries",
    """WITH s AS (SELECT event_type AS source, 'http://evil' || CAST(user_id AS VARCHAR) || '.ru/a' AS url, 'evil' || CAST(user_id AS VARCHAR) || '.ru' AS host, ts FROM events)
SELECT source, sha256(url) AS url_sha256, min(url) AS url, min(host) AS host, min(ts) AS first_seen, max(ts) AS last_seen,
  max(ts) + INTERVAL 7 DAY AS expires_at, 'malicious' AS label FROM s GROUP BY source, sha256(url)""",
)
def feed_entries(spark, folder):
    url = F.concat(F.lit(" hxxp://EVIL"), F.col("user_id").cast("string"), F.lit("[.]ru:80/a#x"))
    rows = table(spark, folder, "events").select(F.col("event_type").alias("source"), url.alias("url"), "ts")
    return feed.feed_entries(rows, "ts", 7)


@register(
    "active_model",
    """SELECT 'v' || CAST(event_id AS VARCHAR) AS version, ts AS created_at, 'active' AS status FROM events WHERE event_type = 'signup'
ORDER BY ts DESC, version DESC LIMIT 1""",
)
def active_model(spark, folder):
    status = F.when(F.col("event_type") == "signup", "active").otherwise("retired")
    version = F.concat(F.lit("v"), F.col("event_id").cast("string"))
    rows = table(spark, folder, "events").select(version.alias("version"), F.col("ts").alias("created_at"), status.alias("status"))
    return store.active_model(rows).select("version", "created_at", "status")


@register(
    "verdict_counts",
    f"""{_SCAN}
SELECT date_trunc('hour', e.ts) AS window_start, s.verdict, count(*) AS n FROM scan s
JOIN events e ON e.event_id % (SELECT count(*) FROM pages) = s.page_id AND e.event_id % (SELECT max(tpl) + 1 FROM scan) = s.tpl GROUP BY ALL""",
)
def verdict_counts(spark, folder):
    """Every event is the time of one scan."""
    pages = table(spark, folder, "pages").count()
    page, shape = F.col("event_id") % pages, F.col("event_id") % len(TEMPLATES)
    events = table(spark, folder, "events").select(page.alias("page_id"), shape.cast("int").alias("tpl"), "ts")
    return scan.verdict_counts(listed_scan(spark, folder, columns=["verdict"]).join(events, KEYS))


# --- evaluation ---------------------------------------------------------------------------------------

# two scored models over the corpus; scores have 101 levels, so there are many ties
_HASH = "CAST('0x' || substr(sha256(url), {}, 6) AS BIGINT)"
_SCORED = f"""{_BASE}, scored AS (
  SELECT label, 'a' AS model, (35 * label + {_HASH.format(1)} % 66) / 100.0::DOUBLE AS score FROM corpus
  UNION ALL SELECT label, 'b' AS model, (10 * label + {_HASH.format(7)} % 91) / 100.0::DOUBLE AS score FROM corpus),
cnt AS (SELECT model, score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY ALL),
cum AS (SELECT *, row_number() OVER w AS ordinal, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS n_pos,
          sum(neg) OVER (PARTITION BY model) AS n_neg, lead(pos) OVER w AS np, lead(neg) OVER w AS nn FROM cnt
        WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
pts AS (SELECT *, tp / n_pos AS tpr, fp / n_neg AS fpr, tp / (tp + fp) AS prec, ordinal = 1 OR np IS NULL OR np <> pos OR nn <> neg AS kept,
          CASE WHEN ordinal = 1 THEN 1.0 ELSE (tp - pos) / (tp - pos + fp - neg) END AS prev FROM cum)"""


def scored_corpus(spark, folder):
    """The corpus with the scores of two stand-in models, long form."""
    draw = lambda start: F.conv(F.substring(F.sha2("url", 256), start, 6), 16, 10).cast("long")
    models = F.array(
        F.struct(F.lit("a").alias("model"), ((35 * F.col("label") + draw(1) % 66) / 100.0).alias("score")),
        F.struct(F.lit("b").alias("model"), ((10 * F.col("label") + draw(7) % 91) / 100.0).alias("score")),
    )
    rows = corpus(spark, folder).select("page_id", "tpl", "source", "label", F.explode(models).alias("_m"))
    return rows.select("page_id", "tpl", "source", "label", "_m.*")


@register(
    "roc_curve",
    f"""{_SCORED}
SELECT model, score AS threshold, ordinal, tp, fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(prec, 6) AS precision, CAST(kept AS INTEGER) AS kept FROM pts""",
    ints="tp fp",
)
def roc_curve(spark, folder):
    points = evaluate.roc_curve(scored_corpus(spark, folder), group_cols=["model"])
    rounded = [F.round(c, 6).alias(c) for c in ("tpr", "fpr", "precision")]
    return points.select("model", "threshold", "ordinal", "tp", "fp", *rounded, F.col("kept").cast("int").alias("kept"))


_EDGES = "(" + " + ".join(f"CAST(score >= {i * 0.1!r} AS INTEGER)" for i in range(1, 10)) + ")"
_REPORT = f"""{_SCORED},
ecebin AS (SELECT model, {_EDGES} AS bin, sum(pos + neg) AS n, sum(pos) / sum(pos + neg) AS acc, sum(score * (pos + neg)) / sum(pos + neg) AS conf FROM cnt GROUP BY ALL),
ecev AS (SELECT model, round(sum(n * abs(acc - conf)) / sum(n), 4) AS ece FROM ecebin GROUP BY model),
agg AS (SELECT model, max(n_pos) AS n_pos, max(n_neg) AS n_neg, round(sum(neg * (tp - pos / 2)) / max(n_pos * n_neg), 4) AS roc_auc,
          round(sum(pos * (prec + prev) / 2) / max(n_pos), 4) AS pr_auc, round(sum(pos * prec) / max(n_pos), 4) AS average_precision,
          round(sum(pos * (1 - score) * (1 - score) + neg * score * score) / sum(pos + neg), 4) AS brier_score,
          coalesce(arg_max(tpr, ordinal) FILTER (kept AND fpr <= 0.01), 0) AS r1, coalesce(arg_max(tpr, ordinal) FILTER (kept AND fpr <= 0.001), 0) AS r01,
          coalesce(arg_max(tpr, ordinal) FILTER (kept AND fpr <= 0.0001), 0) AS r001, coalesce(arg_max(score, ordinal) FILTER (kept AND fpr <= 0.01), 'inf'::DOUBLE) AS t1,
          coalesce(arg_max(score, ordinal) FILTER (kept AND fpr <= 0.001), 'inf'::DOUBLE) AS t01,
          round(coalesce(max(fpr) FILTER (kept AND fpr <= 0.001), 0), 6) AS realized FROM pts GROUP BY model)"""


def _precision_at(rate: float) -> str:
    return f"CASE WHEN r01 = 0 THEN 0.0 ELSE round(round(r01, 4) * {rate} / (round(r01, 4) * {rate} + 0.001 * (1 - {rate})), 4) END"


@register(
    "evaluation_report",
    f"""{_REPORT}
SELECT model, n_pos, n_neg, roc_auc, pr_auc, average_precision, brier_score, ece, round(r1, 4) AS recall_at_fpr_1pct,
  round(r01, 4) AS recall_at_fpr_0_1pct, round(r001, 4) AS recall_at_fpr_0_01pct, {_precision_at(0.0005)} AS precision_at_base_rate_0_05pct,
  {_precision_at(0.005)} AS precision_at_base_rate_0_5pct, {_precision_at(0.05)} AS precision_at_base_rate_5pct,
  round(t1, 4) AS threshold_at_fpr_1pct, round(t01, 4) AS threshold_at_fpr_0_1pct, realized AS realized_fpr_0_1pct
FROM agg JOIN ecev USING (model)""",
    ints="n_pos n_neg",
)
def evaluation_report(spark, folder):
    return evaluate.evaluate_predictions(scored_corpus(spark, folder), group_cols=["model"])


@register(
    "operating_thresholds",
    f"""{_REPORT}
SELECT model, CASE WHEN t1 <= 0.05 OR t1 >= 0.90 THEN 0.35 ELSE round(t1, 4) END AS t_suspicious,
  CASE WHEN t01 <= 0.10 OR t01 >= 0.90 THEN 0.70 ELSE round(t01, 4) END AS t_malicious FROM agg""",
)
def operating_thresholds(spark, folder):
    return evaluate.operating_thresholds(evaluation_report(spark, folder), ["model"])


@register("leakage_alarm", f"{_REPORT}\nSELECT model, roc_auc, CAST(roc_auc > 0.999 AS INTEGER) AS leakage_suspected FROM agg")
def leakage_alarm(spark, folder):
    out = evaluate.leakage_alarm(evaluation_report(spark, folder), ["model"])
    return out.withColumn("leakage_suspected", F.col("leakage_suspected").cast("int"))


@register(
    "reliability_curve",
    f"""{_REPORT}
SELECT m.model, b.bin, round(b.bin * 0.1, 4) AS low, round((b.bin + 1) * 0.1, 4) AS high,
  round(coalesce(conf, (b.bin * 0.1 + (b.bin + 1) * 0.1) / 2), 4) AS confidence, round(coalesce(acc, 0), 4) AS accuracy, coalesce(n, 0) AS n
FROM (SELECT DISTINCT model FROM cnt) m CROSS JOIN (SELECT unnest(range(0, 10)) AS bin) b LEFT JOIN ecebin e ON e.model = m.model AND e.bin = b.bin""",
    ints="n", doubles="low high",
)
def reliability_curve(spark, folder):
    return evaluate.reliability_curve(scored_corpus(spark, folder), group_cols=["model"])
