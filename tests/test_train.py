"""The training job end to end on a small corpus, and scanning with the trained model."""

import os

from pyspark.sql import functions as F

from urlrisk.operators.canonical import canonicalize_urls
from urlrisk.operators.dataset import dataset_rows
from urlrisk.operators.detect import scan_urls
from urlrisk.operators.features import extract_features
from urlrisk.plans.scorers import char_ngrams, fit_linear_scorer, fit_tree_scorer
from urlrisk.plans.train import train_model
from urlrisk.sources.corpus import url_corpus
from urlrisk.sources.files import verify_artifacts


def small_corpus(spark):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.concat(F.lit("https://site"), "id", F.lit("-garden.org/")).alias("url"))
    return dataset_rows(url_corpus(pages).withColumnRenamed("url", "url_raw")).cache()


def test_train_score_and_verify(spark, tmp_path):
    rows = small_corpus(spark)
    model, report = train_model(rows, str(tmp_path), "v1", rounds=3, depth=3)
    variants = {r["variant"]: r for r in report.collect()}
    assert set(variants) == {"raw", "calibrated"} and variants["raw"]["n_pos"] > 0
    assert 0 <= model.t_suspicious <= 1 and model.calibrator.x[0] == 0.0
    for name in ("ensemble", "calibrator", "thresholds", "features", "metrics", "reliability_raw"):
        assert os.path.isdir(tmp_path / "artifacts" / name), name
    assert verify_artifacts(spark, str(tmp_path / "artifacts"), str(tmp_path / "manifest")) > 10
    urls = spark.createDataFrame([("http://amaz0n-support.net/verify/1",), ("https://github.com/zz",), ("ftp://x",)], "url string")
    got = {r["url"]: r for r in scan_urls(urls, scorer=model.score, model_version="v1", id_cols=["url"]).collect()}
    assert got["http://amaz0n-support.net/verify/1"]["model_version"] == "v1"
    assert 0 <= got["http://amaz0n-support.net/verify/1"]["probability"] <= 1
    assert got["https://github.com/zz"]["layers"]["allowlist"] == "hit" and got["ftp://x"]["verdict"] == "unknown"


def test_linear_contributions_sum_to_the_score(spark):
    rows = extract_features(canonicalize_urls(small_corpus(spark), "url"))
    model = fit_linear_scorer(rows)
    out = model.score(rows).limit(20).collect()
    import math

    for r in out:
        total = model.bias + sum(r["contributions"].values())
        assert abs(1 / (1 + math.exp(-total)) - r["model_probability"]) < 1e-9


def test_tree_contributions_sum_to_the_score(spark):
    rows = extract_features(canonicalize_urls(small_corpus(spark), "url"))
    model = fit_tree_scorer(rows, rounds=4, depth=3)
    bias = model.nodes(spark).bias
    out = model.contributions(model.score(rows)).select("features", "model_probability", "contributions").limit(60).collect()
    import math

    for r in out:
        if r["features"] is None:
            assert r["contributions"] is None
        else:
            assert abs(1 / (1 + math.exp(-bias - sum(r["contributions"].values()))) - r["model_probability"]) < 1e-6
    assert any(any(r["contributions"].values()) for r in out if r["features"])


def test_trees_are_fitted_on_distinct_weighted_rows(spark):
    from urlrisk.plans.scorers import TREE_RATE, weighted_rows
    from pyspark.ml.classification import GBTClassifier
    from urlrisk.operators.features import feature_vectors

    rows = extract_features(canonicalize_urls(small_corpus(spark), "url")).select("url", "label", "features").cache()
    once, thrice = weighted_rows(rows, rows), weighted_rows(rows.crossJoin(spark.range(3)).drop("id"), rows)
    assert once.count() == thrice.count() < rows.count()  # ids of equally many digits often have equal features
    total = lambda df, val: df.where(F.col("_val") == val).groupBy("label").agg(F.sum("_w")).collect()
    assert all(abs(w - rows.count() * 1.5) < 0.01 for _, w in total(thrice, False)) and sum(w for _, w in total(thrice, True)) == rows.count()
    # the same trees as from all rows, one by one
    sums = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    weight = F.when(F.col("label") == 1, round(rows.count() / (2 * sums[1]), 6)).otherwise(round(rows.count() / (2 * sums[0]), 6))
    plain = feature_vectors(rows).select("vector", F.col("label").cast("double").alias("label"), weight.alias("_w"))
    whole = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="_w", maxIter=3, stepSize=TREE_RATE, maxDepth=3, seed=42).fit(plain)
    a, b = fit_tree_scorer(rows, rounds=3, depth=3).score(rows), whole.transform(feature_vectors(rows))
    one = {r["url"]: r["model_probability"] for r in a.collect()}
    assert all(abs(one[r["url"]] - r["probability"][1]) < 1e-9 for r in b.collect())


def test_tree_queries_fit_the_defaults_and_return_rows(spark, monkeypatch):
    import math

    from urlrisk.plans import registry_models, scorers
    from urlrisk.plans.registry import QUERIES

    asked = []

    def fit(train, val=None, rounds=scorers.TREE_ROUNDS, depth=scorers.TREE_DEPTH):
        asked.append((rounds, depth))
        return fit_tree_scorer(train, val, 3, 3)

    monkeypatch.setattr(registry_models.scorers, "fit_tree_scorer", fit)
    folder = "/root/testdata/sf0.001"
    got = QUERIES["tree_contribution_rows"](spark, folder).collect()
    assert asked == [(scorers.TREE_ROUNDS, scorers.TREE_DEPTH)]
    assert got and len(got) == QUERIES["tree_scorer"](spark, folder).count()
    explained = [r for r in got if r["contributions"] is not None]
    assert explained
    for r in explained:
        assert abs(1 / (1 + math.exp(-r["bias"] - sum(r["contributions"].values()))) - r["model_probability"]) < 1e-9


def test_text_scorer_hashes_grams_once_and_scores_as_one_pipeline(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF
    from urlrisk.plans import scorers

    kept, store = [], scorers.stored
    monkeypatch.setattr(scorers, "stored", lambda df, name: kept.append(df.columns) or store(df, name))
    rows = small_corpus(spark).select("url", "label").limit(300).cache()
    got = {r["url"]: r["p_text"] for r in scorers.fit_text_scorer(rows).score(rows).collect()}
    assert kept == [["label", "_w", "_tf"]]
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    weight = F.when(F.col("label") == 1, round(n[0] / n[1], 6)).otherwise(1.0)
    data = rows.select("url", char_ngrams(F.col("url")).alias("g"), F.col("label").cast("double").alias("label"), weight.alias("w"))
    steps = [HashingTF(inputCol="g", outputCol="tf", numFeatures=scorers.HASH_SIZE), IDF(inputCol="tf", outputCol="x")]
    steps.append(LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", maxIter=30, regParam=1e-4))
    for r in Pipeline(stages=steps).fit(data).transform(data).collect():
        assert abs(r["probability"][1] - got[r["url"]]) < 1e-6


def test_char_ngrams(spark):
    grams = spark.range(1).select(char_ngrams(F.lit("abc")), char_ngrams(F.lit(""))).first()
    assert sorted(grams[0]) == sorted(["a", "b", "c", "ab", "bc", "abc"]) and grams[1] == []
