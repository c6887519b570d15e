"""Registered queries on audits, drift and review lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlrisk.operators import ablation, dataset, evaluate, monitor
from urlrisk.operators.features import FEATURE_FAMILIES, FEATURE_NAMES, extract_features
from urlrisk.operators.ordering import shared_folder, stored
from urlrisk.plans import oracle as o
from urlrisk.plans.registry import _BASE, _SCAN, K, KEYS, listed_scan, parsed_corpus, register, table
from urlrisk.plans.registry_data import (
    _FEEDBACK,
    _REPORT,
    _SCORED,
    _SPLIT,
    feedback_table,
    scored_corpus,
    split_table,
)

_CANON = f"{_BASE}, {o.canon('corpus', 'page_id, tpl, label')}"
_FEAT = f"{_BASE}, {o.chain('corpus', 'page_id, tpl, label')}"


@register(
    "artifact_audit",
    f"""{_CANON}
SELECT label, count(*) AS n, round(avg(CAST(path <> '/' AS INTEGER)), 6) AS has_path_rate, round(avg(CAST(scheme = 'https' AS INTEGER)), 6) AS https_rate,
  round(avg(CAST(starts_with(host, 'www.') AS INTEGER)), 6) AS www_rate, round(avg(length(u)), 6) AS mean_length,
  round(avg(CAST(ends_with(path, '/') AS INTEGER)), 6) AS trailing_slash_rate,
  round(avg(length(regexp_replace(u, '[^0-9]', '', 'g')) / length(u)), 6) AS mean_digit_ratio
FROM canon WHERE ok GROUP BY label""",
)
def artifact_audit(spark, folder):
    return monitor.artifact_audit(parsed_corpus(spark, folder))


@register("tld_counts", f"{_CANON}\nSELECT label, suffix AS tld, count(*) AS n FROM canon WHERE ok GROUP BY ALL")
def tld_counts(spark, folder):
    return monitor.tld_counts(parsed_corpus(spark, folder))


_LONG = " UNION ALL ".join(f"SELECT label, '{n}' AS feature, CAST({n} AS DOUBLE) AS value FROM feat" for n in FEATURE_NAMES)


@register(
    "single_feature_auc",
    f"""{_FEAT}, lf AS ({_LONG}), vc AS (SELECT feature, value, sum(label) AS pos, sum(1 - label) AS neg FROM lf GROUP BY ALL),
cu AS (SELECT *, sum(pos) OVER (PARTITION BY feature ORDER BY value DESC) AS tp FROM vc)
SELECT feature, round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM cu GROUP BY feature""",
)
def single_feature_auc(spark, folder):
    return monitor.single_feature_auc(extract_features(parsed_corpus(spark, folder)))


@register(
    "prior_shift",
    f"""{_SCORED}
SELECT model, score, round(score * (0.005 / 0.6) / (score * (0.005 / 0.6) + (1 - score) * (0.995 / 0.4)), 6) AS shifted, count(*) AS n FROM scored GROUP BY ALL""",
)
def prior_shift(spark, folder):
    rows = scored_corpus(spark, folder).groupBy("model", "score").agg(F.count("*").alias("n"))
    return rows.withColumn("shifted", F.round(monitor.prior_shift(F.col("score"), 0.6, 0.005), 6))


@register(
    "tld_prior",
    f"""{_SPLIT}, pr AS (SELECT tld, avg(label) AS p FROM split_data WHERE split = 'train' GROUP BY tld)
SELECT split, d.tld, count(*) AS n, round(max(p), 6) AS tld_risk_prior FROM split_data d LEFT JOIN pr ON d.tld = pr.tld GROUP BY ALL""",
)
def tld_prior(spark, folder):
    rows = split_table(spark, folder)
    prior = monitor.tld_prior(rows.filter("split = 'train'"))
    out = monitor.add_tld_prior(rows, prior)
    return out.groupBy("split", "tld").agg(F.count("*").alias("n"), F.round(F.max("tld_risk_prior"), 6).alias("tld_risk_prior"))


@register(
    "f1_at_threshold",
    f"""{_SCORED}, c AS (SELECT model, sum(CAST(score >= 0.5 AND label = 1 AS INTEGER)) AS tp, sum(CAST(score >= 0.5 AND label = 0 AS INTEGER)) AS fp,
  sum(CAST(score < 0.5 AND label = 1 AS INTEGER)) AS fn, count(*) FILTER (score IS NULL) AS n_null FROM scored GROUP BY model)
SELECT *, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
    ints="tp fp fn n_null",
)
def f1_at_threshold(spark, folder):
    return monitor.f1_at(scored_corpus(spark, folder), 0.5, group_cols=["model"])


_POISSON = "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in row) + "]::DOUBLE[]" for row in monitor._poisson_table(monitor.POISSON_EXACT)) + "]"


@register(
    "bootstrap_auc",
    f"""{_SCORED}, sides AS (SELECT model, score, 1 AS side, pos AS k FROM cnt UNION ALL SELECT model, score, 0, neg FROM cnt),
keyed AS (SELECT *, '7:' || model || ':' || printf('%.6f', score) || ':' || side AS key, unnest(range(125)) AS b FROM sides),
hashed AS (SELECT *, sha256(key || ':u:' || b) AS h, CASE WHEN k > 30 THEN sha256(key || ':v:' || b) END AS h2 FROM keyed),
drawn AS (SELECT model, score, side, k, b * 8 + j AS resample, (CAST('0x' || substr(h, 8 * j + 1, 8) AS BIGINT) + 0.5) / 4294967296.0 AS u,
  (CAST('0x' || substr(h2, 8 * j + 1, 8) AS BIGINT) + 0.5) / 4294967296.0 AS v FROM (SELECT *, unnest(range(8)) AS j FROM hashed)),
poisson AS (SELECT {_POISSON} AS t),
sampled AS (SELECT model, score, resample, sum(n) FILTER (WHERE side = 1) AS pos, sum(n) FILTER (WHERE side = 0) AS neg FROM (
  SELECT model, score, resample, side, CASE WHEN k <= 30 THEN len(list_filter(t[CAST(k + 1 AS BIGINT)], lambda c: c < u))
    ELSE greatest(round(k + sqrt(k::DOUBLE) * sqrt(-2 * ln(u)) * cos(2 * pi() * v)), 0) END AS n FROM drawn, poisson) GROUP BY ALL),
summed AS (SELECT *, sum(pos) OVER (PARTITION BY model, resample ORDER BY score DESC) AS tp FROM sampled),
aucs AS (SELECT model, resample, sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS auc FROM summed GROUP BY ALL)
SELECT model, round(quantile_cont(auc, 0.025), 4) AS low, round(quantile_cont(auc, 0.5), 4) AS median, round(quantile_cont(auc, 0.975), 4) AS high
FROM aucs GROUP BY model""",
)
def bootstrap_auc(spark, folder):
    return monitor.bootstrap_auc(scored_corpus(spark, folder), resamples=1000, group_cols=["model"])


@register(
    "population_stability",
    f"""{_FEAT}, lf AS ({_LONG}), ranked AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS rn,
  count(*) OVER (PARTITION BY feature) AS n FROM lf WHERE label = 0),
edges AS (SELECT feature, list(DISTINCT value) AS e FROM ranked JOIN (SELECT unnest(range(1, 10)) AS i) ON rn = greatest(1, (i * n + 9) // 10) GROUP BY feature),
binned AS (SELECT feature, label, len(list_filter(e, lambda x: x < value)) AS bin, count(*) AS n FROM lf JOIN edges USING (feature) GROUP BY ALL),
shares AS (SELECT feature, bin, greatest(coalesce(sum(n) FILTER (label = 0), 0) / sum(sum(n) FILTER (label = 0)) OVER (PARTITION BY feature), 0.0001) AS a,
  greatest(coalesce(sum(n) FILTER (label = 1), 0) / sum(sum(n) FILTER (label = 1)) OVER (PARTITION BY feature), 0.0001) AS b FROM binned GROUP BY feature, bin)
SELECT feature, round(sum((b - a) * ln(b / a)), 6) AS psi FROM shares GROUP BY feature""",
)
def population_stability(spark, folder):
    """Drift of the malicious shapes against the benign ones."""
    rows = stored(extract_features(parsed_corpus(spark, folder)).select("label", "features"), "features")
    return monitor.population_stability(rows.filter("label = 0"), rows.filter("label = 1"))


@register(
    "feedback_rates",
    f"""WITH f AS (SELECT event_id % (SELECT count(*) + 5 FROM pages) AS scan_id, {_FEEDBACK} AS label FROM events), s AS (SELECT page_id AS id, 'v' || CAST(page_id % 3 AS VARCHAR) AS model_version FROM pages)
SELECT model_version, count(*) AS n, round(avg(CAST(label = 'false_positive' AS INTEGER)), 6) AS false_positive_rate,
  round(avg(CAST(label = 'false_negative' AS INTEGER)), 6) AS false_negative_rate FROM f LEFT JOIN s ON f.scan_id = s.id GROUP BY model_version""",
)
def feedback_rates(spark, folder):
    version = F.concat(F.lit("v"), (F.col("page_id") % 3).cast("string"))
    pages = table(spark, folder, "pages")
    scans = pages.select(F.col("page_id").alias("id"), version.alias("model_version"))
    # every event gives feedback on a scan; five ids have none
    feedback = feedback_table(spark, folder).select((F.col("scan_id") % (pages.count() + 5)).alias("scan_id"), "label")
    return monitor.feedback_rates(feedback, scans)


@register(
    "feed_recall",
    f"""WITH src AS (SELECT page_id, 0 AS tpl, url FROM pages), {o.scan('src', K)},
flagged AS (SELECT url_sha256, max(CAST(verdict IN ('malicious', 'suspicious') AS INTEGER)) AS hit FROM scan GROUP BY 1),
feed AS (SELECT DISTINCT 'feed' || CAST(page_id % 3 AS VARCHAR) AS source, url_sha256 FROM scan WHERE page_id % 30 >= 10)
SELECT source, count(*) AS n, sum(coalesce(hit, 0)) AS n_detected, round(sum(coalesce(hit, 0)) / count(*), 6) AS recall
FROM feed LEFT JOIN flagged USING (url_sha256) GROUP BY source""",
    ints="n_detected",
)
def feed_recall(spark, folder):
    """Entries of three feeds, seen over 30 days; the last 20 count as fresh."""
    from urlrisk.operators.detect import scan_urls

    scans = scan_urls(table(spark, folder, "pages").select("page_id", "url"), id_cols=["page_id"])
    day = F.date_add(F.to_date(F.lit("2026-01-01")), (F.col("page_id") % 30).cast("int")).cast("timestamp")
    source = F.concat(F.lit("feed"), (F.col("page_id") % 3).cast("string"))
    entries = scans.select(source.alias("source"), "url_sha256", day.alias("first_seen"))
    return monitor.feed_recall(scans, entries, F.lit("2026-01-11").cast("timestamp"))


_LABELLED = f"{_BASE}, {o.scan('corpus', 'page_id, tpl, label')}"
_KIND = "CASE WHEN verdict IN ('malicious', 'suspicious') AND label = 0 THEN 'FP' WHEN verdict IN ('no_threat_found', 'unknown') AND label = 1 THEN 'FN' END"


_TRIAGE_INPUT = "risk_score verdict confidence registered_domain url_sha256 url_canonical url_raw".split()


def labelled_scan(spark, folder, columns=None):
    from urlrisk.operators.detect import scan_urls
    from urlrisk.plans.registry import corpus

    return scan_urls(corpus(spark, folder), id_cols=KEYS, columns=columns)


@register(
    "error_groups",
    f"""{_LABELLED}, e AS (SELECT {_KIND} AS error_type, registered_domain FROM scan)
SELECT error_type, registered_domain, count(*) AS n FROM e WHERE error_type IS NOT NULL GROUP BY ALL""",
)
def error_groups(spark, folder):
    return monitor.error_groups(labelled_scan(spark, folder, ["verdict", "registered_domain"]))


@register(
    "error_list",
    f"""{_LABELLED}, e AS (SELECT {_KIND} AS error_type, label, probability, registered_domain, url_sha256, {o.defanged('url_canonical')} AS url_defanged FROM scan),
r AS (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY CASE WHEN error_type = 'FP' THEN -probability ELSE probability END, url_sha256) AS place FROM e WHERE error_type IS NOT NULL)
SELECT error_type, label, probability, registered_domain, url_sha256, url_defanged FROM r WHERE place <= 50""",
    doubles="probability",
)
def error_list(spark, folder):
    return monitor.error_list(labelled_scan(spark, folder, "verdict probability registered_domain url_sha256 url_canonical".split()))


@register(
    "triage",
    f"""{_LABELLED}
SELECT risk_score, verdict, confidence, registered_domain, url_sha256, {o.defanged("url_canonical")} AS url_defanged
FROM scan ORDER BY risk_score DESC, url_sha256 LIMIT 100""",
)
def triage(spark, folder):
    return monitor.triage(labelled_scan(spark, folder, _TRIAGE_INPUT), 100)


@register(
    "triage_file",
    f"""{_LABELLED}
SELECT risk_score, verdict, confidence, registered_domain, url_sha256, {o.defanged("CASE WHEN url_canonical <> '' THEN url_canonical ELSE raw END")} AS url_defanged FROM scan
WHERE registered_domain <> ''""",
)
def triage_file(spark, folder):
    """The whole review list as a CSV file and read again; what could not be assessed is left out."""
    path = f"{shared_folder(spark, 'triage')}/list"
    monitor.write_triage(labelled_scan(spark, folder, _TRIAGE_INPUT).where("registered_domain <> ''"), path)
    schema = "risk_score int, verdict string, confidence string, registered_domain string, url_sha256 string, url_defanged string"
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


@register(
    "page_false_alarms",
    f"""WITH src AS (SELECT page_id, 0 AS tpl, url FROM pages), {o.scan('src', K)}
SELECT count(*) AS n, sum(CAST(verdict = 'malicious' AS INTEGER)) AS n_false_alarms FROM scan""",
    ints="n_false_alarms",
)
def page_false_alarms(spark, folder):
    from urlrisk.operators.detect import scan_urls

    return monitor.false_alarms(scan_urls(table(spark, folder, "pages").select("page_id", "url"), id_cols=["page_id"]))


@register(
    "promotion_gate",
    f"""{_REPORT}
SELECT CAST(a.r01 > b.r01 AND a.roc_auc >= b.roc_auc - 0.01 AND a.average_precision >= b.average_precision - 0.01 AS INTEGER) AS promote
FROM agg a JOIN agg b ON a.model = 'a' AND b.model = 'b'""",
)
def promotion_gate(spark, folder):
    report = evaluate.evaluate_predictions(scored_corpus(spark, folder), group_cols=["model"])
    gate = monitor.promotion_gate(
        report.filter("model = 'a'"), report.filter("model = 'b'"), {"roc_auc": 0.01, "average_precision": 0.01}
    )
    return gate.select(F.col("promote").cast("int").alias("promote"))


def _ablation(spark, folder):
    """The URLs are worked on once; the split and both passes of the ablation read what is stored of them."""
    rows = extract_features(parsed_corpus(spark, folder)).where("parsed.is_valid")
    rows = stored(rows.select(F.col("parsed.registered_domain").alias("registered_domain"), "first_seen", "label", "features"), "features")
    rows = dataset.assign_splits(rows)
    return ablation.family_ablation(rows.where("split = 'train'"), rows.where("split = 'test'"))


_FAMILY = ", ".join(f"('{f}', {len(FEATURE_NAMES) - len(m.split())})" for f, m in FEATURE_FAMILIES.items())


@register(
    "family_ablation",
    f"""{_SPLIT}, n AS (SELECT sum(label) AS n_pos, sum(1 - label) AS n_neg FROM split_data WHERE split = 'test')
SELECT f AS without, k AS n_features, n_pos, n_neg, 1 AS ordered FROM (VALUES ('none', {len(FEATURE_NAMES)}), {_FAMILY}) v(f, k), n""",
    ints="n_features n_pos n_neg ordered",
)
def family_ablation(spark, folder):
    """AUC of a linear scorer without each feature family; SQL knows the counts, and that the full scorer ranks well above chance."""
    out = _ablation(spark, folder)
    ordered = (F.col("roc_auc") > 0.75) & (F.col("loss") > -0.1)
    return out.select("without", *[F.col(c).cast("long").alias(c) for c in ("n_features", "n_pos", "n_neg")], ordered.cast("long").alias("ordered"))


@register("family_losses")
def family_losses(spark, folder):
    return _ablation(spark, folder)
