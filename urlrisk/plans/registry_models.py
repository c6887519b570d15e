"""Registered queries on scorers, calibration and robustness."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlrisk.functions.perturb import STRATEGIES
from urlrisk.functions.perturb import SPLIT_WORDS
from urlrisk.functions.privacy import sha256_url
from urlrisk.operators import calibrate, dataset, ensemble, robustness
from urlrisk.operators.canonical import canonicalize_urls
from urlrisk.operators.features import extract_features
from urlrisk.operators.ordering import stored
from urlrisk.plans import oracle as o
from urlrisk.plans import scorers
from urlrisk.plans.registry import _BASE, KEYS, corpus, parsed_corpus, register
from urlrisk.plans.registry_data import _SCORED, _SPLIT, dataset_table as split_source, scored_corpus
from urlrisk.sources.corpus import spread

FEATURE_ROWS_PER_TASK = 50_000

# --- calibration and ensembles -----------------------------------------------------------------------------

# isotonic regression by its max-min formula: the fit at i is the largest, over starts j <= i, of the smallest,
# over ends k >= i, mean of the block j..k
_ISO = f"""{_SCORED}, lev AS (SELECT score, pos, pos + neg AS n, model, row_number() OVER w AS i,
    sum(pos) OVER w AS cp, sum(pos + neg) OVER w AS cn FROM cnt WINDOW w AS (PARTITION BY model ORDER BY score)),
low AS (SELECT a.model, a.i AS j, x.i, min((k.cp - a.cp + a.pos) / (k.cn - a.cn + a.n)) AS m
        FROM lev a JOIN lev x ON a.model = x.model AND a.i <= x.i JOIN lev k ON k.model = x.model AND k.i >= x.i GROUP BY ALL),
iso AS (SELECT model, i, max(m) AS fit FROM low GROUP BY ALL)"""


def _per_model(spark, folder, work):
    """``work`` on the rows of each of the two models."""
    rows = scored_corpus(spark, folder)
    done = [work(rows.filter(F.col("model") == m)).select(F.lit(m).alias("model"), "*") for m in ("a", "b")]
    return done[0].unionByName(done[1])


@register("isotonic_fit", f"{_ISO}\nSELECT model, score, n, round(fit, 6) AS calibrated FROM lev JOIN iso USING (model, i)", ints="n")
def isotonic_fit(spark, folder):
    def fit(rows):
        levels = rows.groupBy("score").agg(F.count("*").alias("n"))
        return calibrate.apply_knots(levels, calibrate.isotonic_knots(rows)).select("score", "n", F.round("calibrated", 6).alias("calibrated"))

    return _per_model(spark, folder, fit)


@register("calibration_comparison")
def calibration_comparison(spark, folder):
    """Fitted on the pages with an even id, compared on the others."""
    return _per_model(
        spark, folder, lambda rows: calibrate.compare_calibration(rows.filter("page_id % 2 = 1"), calibrate.fit_isotonic(rows.filter("page_id % 2 = 0")))
    )


_PAIRS = f"""{_BASE}, pairs AS (SELECT label, (35 * label + CAST('0x' || substr(sha256(url), 1, 6) AS BIGINT) % 66) / 100.0::DOUBLE AS p1,
    (10 * label + CAST('0x' || substr(sha256(url), 7, 6) AS BIGINT) % 91) / 100.0::DOUBLE AS p2 FROM corpus)"""


def score_pairs(spark, folder):
    rows = scored_corpus(spark, folder).groupBy(*KEYS, "label").agg(
        F.max(F.when(F.col("model") == "a", F.col("score"))).alias("p1"),
        F.max(F.when(F.col("model") == "b", F.col("score"))).alias("p2"),
    )
    return rows


@register(
    "blend_search",
    f"""{_PAIRS}, w AS (SELECT i * 0.05::DOUBLE AS weight FROM (SELECT unnest(range(0, 21)) AS i)),
mix AS (SELECT weight, weight * p1 + (1.0::DOUBLE - weight) * p2 AS s, sum(label) AS pos, sum(1 - label) AS neg FROM pairs CROSS JOIN w GROUP BY ALL),
cm AS (SELECT weight, pos, sum(pos) OVER (PARTITION BY weight ORDER BY s DESC) AS tp, sum(neg) OVER (PARTITION BY weight ORDER BY s DESC) AS fp FROM mix)
SELECT round(weight, 2) AS weight, round(sum(pos * (tp / (tp + fp))) / sum(pos), 6) AS average_precision FROM cm GROUP BY weight""",
)
def blend_search(spark, folder):
    out = ensemble.blend_scores(score_pairs(spark, folder))
    return out.select(F.round("weight", 2).alias("weight"), F.round("average_precision", 6).alias("average_precision"))


@register(
    "ensemble_scores",
    f"""{_PAIRS}
SELECT label, p1, p2, round((0.3 * p1 + 0.9 * p2) / 1.2, 6) AS blended, round(1 / (1 + exp(-(2.5 * p1 + 1.5 * p2 - 2.0))), 6) AS stacked, count(*) AS n
FROM pairs GROUP BY ALL""",
)
def ensemble_scores(spark, folder):
    pairs = score_pairs(spark, folder).groupBy("label", "p1", "p2").agg(F.count("*").alias("n"))
    blend, stack = ensemble.Ensemble(0.3, 0.9), ensemble.Ensemble(2.5, 1.5, -2.0, "stack")
    return pairs.select(
        "label",
        "p1",
        "p2",
        F.round(blend.combine(F.col("p1"), F.col("p2")), 6).alias("blended"),
        F.round(stack.combine(F.col("p1"), F.col("p2")), 6).alias("stacked"),
        "n",
    )


@register("stacking_fit")
def stacking_fit(spark, folder):
    return ensemble.fit_stacking(score_pairs(spark, folder)).table(spark)


# --- scorers ------------------------------------------------------------------------------------------------


@register(
    "class_weights",
    f"""{_BASE}, c AS (SELECT label, count(*) AS n FROM corpus GROUP BY label)
SELECT label, n, round((SELECT sum(n) FROM c) / (2.0 * n), 6) AS balanced_weight,
  round(CASE WHEN label = 1 THEN (SELECT n FROM c WHERE label = 0) / n ELSE 1.0 END, 6) AS positive_weight FROM c""",
)
def class_weights(spark, folder):
    return scorers.class_weights(corpus(spark, folder))


def _split_rows(spark, folder):
    """``url, label, split`` of the dataset, stored: its URLs are canonicalized once, as the split reads it several times, and so do fits and scores."""
    rows = split_source(spark, folder).select("url", "label", "first_seen", "registered_domain")
    return stored(dataset.assign_splits(stored(rows, "dataset")).select("url", "label", "split"), "split-rows")


def _test_rows(rows):
    return rows.filter("split = 'test'").withColumn("url_sha256", sha256_url(F.col("url")))


def _fitted_trees(spark, folder):
    """The test rows with their features, and the trees. The fit and the scores read different rows, so the features of no row are worked out twice."""
    rows = _split_rows(spark, folder)

    def featured(part):
        return extract_features(canonicalize_urls(spread(part, FEATURE_ROWS_PER_TASK), "url")).drop("parsed")

    model = scorers.fit_tree_scorer(featured(rows.filter("split = 'train'")), featured(rows.filter("split = 'val'")))
    return featured(_test_rows(rows)), model


@register(
    "tree_contributions",
    f"{_SPLIT}\nSELECT label, count(*) AS n, count(*) AS n_explained FROM split_data WHERE split = 'test' GROUP BY label",
    ints="label",
)
def tree_contributions(spark, folder):
    """How many test rows there are, and for how many the parts and the trees' means add up to the score."""
    rows, model = _fitted_trees(spark, folder)
    nodes = model.nodes(spark)
    out = model.contributions(model.score(rows), nodes=nodes)
    margin = F.aggregate(F.map_values("contributions"), F.lit(nodes.bias), lambda s, x: s + x)
    explained = F.abs(1 / (1 + F.exp(-margin)) - F.col("model_probability")) < 1e-9
    return out.groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"), F.count_if(explained).alias("n_explained"))


@register("tree_contribution_rows")
def tree_contribution_rows(spark, folder):
    """The contributions of each test row; with the bias they add up to the margin of its score."""
    rows, model = _fitted_trees(spark, folder)
    nodes = model.nodes(spark)
    out = model.contributions(model.score(rows), nodes=nodes)
    return out.select("url_sha256", "label", "model_probability", F.lit(nodes.bias).alias("bias"), "contributions")


@register("tree_scorer")
def tree_scorer(spark, folder):
    """Boosted trees fitted on the train split and applied to the test split."""
    rows, model = _fitted_trees(spark, folder)
    scored = model.score(rows)
    return scored.select("url_sha256", "label", F.round("model_probability", 4).alias("model_probability"))


@register("text_scorer")
def text_scorer(spark, folder):
    """Character n-gram scorer fitted on the train split and applied to the test split."""
    rows = _split_rows(spark, folder)
    model = scorers.fit_text_scorer(rows.filter("split = 'train'"))
    scored = model.score(_test_rows(rows), "url", "p_text")
    return scored.select("url_sha256", "label", F.round("p_text", 4).alias("p_text"))


@register("linear_contributions")
def linear_contributions(spark, folder):
    """Contributions of a linear scorer over the features: the five largest per URL."""
    rows = extract_features(parsed_corpus(spark, folder)).filter(F.col("features").isNotNull())
    rows = stored(rows.select(*KEYS, "label", "features"), "features")  # the fit and the scores read them
    model = scorers.fit_linear_scorer(rows)
    scored = model.score(rows)
    top = F.slice(
        F.array_sort(
            F.map_entries("contributions"),
            lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).otherwise(0),
        ),
        1,
        5,
    )
    out = scored.select(*KEYS, F.posexplode(top).alias("place", "_c"))
    return out.select(*KEYS, "place", F.col("_c.key").alias("feature"), F.round("_c.value", 3).alias("contribution"))


# --- robustness ---------------------------------------------------------------------------------------------

_HEX = (
    "array_to_string(list_transform(string_split(path, ''), lambda c: CASE WHEN regexp_matches(c, '^[A-Za-z0-9]$') "
    "THEN '%' || lower(hex(c)) ELSE c END), '')"
)
_WORDS = " ".join(f"WHEN contains(lower(url), '{a}') THEN regexp_replace(url, '{a}', '{b}', 'gi')" for a, b in SPLIT_WORDS)
_CHAIN = "CASE " + _WORDS + " ELSE url || '?client=auth-service-login' END"
_SQL_STRATEGIES = {
    "subdomain_stuffing": "CASE WHEN auth = '' THEN url ELSE head || 'secure-auth-update.signin.' || auth || rest END",
    "brand_in_path": "CASE WHEN contains(url, '?') THEN url || '&target=paypal_verification_portal' ELSE rtrim(url, '/') || '/paypal-security-verification/signin.php' END",
    "url_extension": "CASE WHEN contains(url, '?') THEN regexp_replace(url, '\\?', '.html?') ELSE url || '.php' END",
    "hex_encoding": f"CASE WHEN path IN ('', '/') THEN url || '/%6c%6f%67%69%6e' ELSE head || auth || {_HEX} || substr(rest, length(path) + 1) END",
    "compound_split": _CHAIN,
    "benign_padding": "CASE WHEN contains(url, '?') THEN url || '&ref=support-secure-login' ELSE rtrim(url, '/') || '/support-secure-login' END",
}
_LETTERS = "[aceijopsxyACEIJOPSXY]"


def _swap(text: str) -> str:
    letter = f"translate(lower(regexp_extract({text}, '{_LETTERS}')), 'aceijopsxy', 'асеіјорѕху')"
    return f"regexp_replace({text}, '{_LETTERS}', {letter})"


_HOMOGLYPH = f"CASE WHEN auth = '' THEN {_swap('path')} ELSE head || {_swap('auth')} || rest END"
_VARIANTS = """base AS (SELECT page_id, tpl, url, regexp_extract(url, '^((?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//)', 1) AS head FROM corpus WHERE label = 1),
base2 AS (SELECT *, CASE WHEN head = '' THEN '' ELSE regexp_extract(substr(url, length(head) + 1), '^([^/?#]*)', 1) END AS auth FROM base),
base3 AS (SELECT *, substr(url, length(head) + length(auth) + 1) AS rest FROM base2),
base4 AS (SELECT *, regexp_extract(rest, '^([^?#]*)', 1) AS path FROM base3)"""


def _variants(strategies) -> str:
    return " UNION ALL ".join(f"SELECT page_id, tpl, '{k}' AS strategy, url AS original, {v} AS url FROM base4" for k, v in strategies.items())


@register(
    "perturbed_urls",
    f"""{_BASE}, {_VARIANTS}, v AS ({_variants({**_SQL_STRATEGIES, 'homoglyph': _HOMOGLYPH})})
SELECT page_id, tpl, strategy, url AS perturbed FROM v""",
)
def perturbed_urls(spark, folder):
    rows = corpus(spark, folder).filter("label = 1").select(*KEYS, "url")
    return robustness.perturb_urls(rows).drop("url")


_ROBUST = f"""{_BASE}, {_VARIANTS}, var AS ({_variants({'clean': 'url', **_SQL_STRATEGIES, 'homoglyph': _HOMOGLYPH})}),
{o.scan('var', 'page_id, tpl, strategy')},
clean AS (SELECT page_id, tpl, verdict IN ('malicious', 'suspicious') AS hit FROM scan WHERE strategy = 'clean'),
res AS (SELECT s.strategy, CASE WHEN s.verdict = 'unknown' THEN c.hit ELSE s.verdict IN ('malicious', 'suspicious') END AS hit
        FROM scan s JOIN clean c ON c.page_id = s.page_id AND c.tpl = s.tpl),
per AS (SELECT strategy, count(*) AS sample_count, sum(CAST(hit AS INTEGER)) AS perturbed_detected FROM res GROUP BY strategy)"""


def _counts(spark, folder, names):
    rows = corpus(spark, folder).filter("label = 1").select("url")
    return robustness.robustness_by_strategy(rows, strategies={k: STRATEGIES[k] for k in names})


@register(
    "robustness_report",
    f"""{_ROBUST}, cd AS (SELECT perturbed_detected AS clean_detected FROM per WHERE strategy = 'clean')
SELECT strategy, sample_count, clean_detected, perturbed_detected, round(clean_detected / sample_count, 4) AS clean_recall,
  round(perturbed_detected / sample_count, 4) AS perturbed_recall, round(greatest((clean_detected - perturbed_detected) / sample_count, 0), 4) AS recall_drop
FROM per CROSS JOIN cd WHERE strategy <> 'clean'""",
    ints="clean_detected perturbed_detected",
)
def robustness_report(spark, folder):
    return robustness.robustness_report(_counts(spark, folder, STRATEGIES))


@register(
    "robustness_summary",
    f"""{_ROBUST}, t AS (SELECT sum(sample_count) FILTER (strategy = 'clean') AS total_samples,
  sum(perturbed_detected) FILTER (strategy = 'clean') / sum(sample_count) FILTER (strategy = 'clean') AS c,
  sum(perturbed_detected) FILTER (strategy <> 'clean') / sum(sample_count) FILTER (strategy <> 'clean') AS p FROM per)
SELECT total_samples, round(c, 4) AS overall_clean_recall, round(p, 4) AS overall_perturbed_recall, round(greatest(c - p, 0), 4) AS overall_recall_drop FROM t""",
    ints="total_samples",
)
def robustness_summary(spark, folder):
    return robustness.robustness_summary(_counts(spark, folder, STRATEGIES))


@register(
    "robustness_homoglyph",
    f"""{_ROBUST}, cd AS (SELECT perturbed_detected AS clean_detected FROM per WHERE strategy = 'clean')
SELECT strategy, sample_count, clean_detected, perturbed_detected, round(clean_detected / sample_count, 4) AS clean_recall,
  round(perturbed_detected / sample_count, 4) AS perturbed_recall, round(greatest((clean_detected - perturbed_detected) / sample_count, 0), 4) AS recall_drop
FROM per CROSS JOIN cd WHERE strategy = 'homoglyph'""",
    ints="clean_detected perturbed_detected",
)
def robustness_homoglyph(spark, folder):
    return robustness.robustness_report(_counts(spark, folder, ["homoglyph"]))
