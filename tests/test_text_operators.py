"""Similarity join, bigram model, content features, ablation, bootstrap and isotonic tables against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlrisk.operators import ablation, bigrams, calibrate, content, monitor, similarity
from urlrisk.operators.features import FEATURE_FAMILIES, FEATURE_NAMES


def grams(text, n=5):
    return {text[i : i + n] for i in range(max(1, len(text) - n + 1))}


def jaccard(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9, 1.0])
def test_similarity_join_finds_every_pair(spark, threshold):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdé/.") for _ in range(rng.randrange(1, 60))) for _ in range(25)]
    texts = []
    for t in base:
        for _ in range(6):
            i = rng.randrange(len(t) + 1)
            texts.append(t[:i] + rng.choice("xy") * rng.randrange(3) + t[i:])
    left, right = texts[::2] + ["", "a", texts[0]], texts[1::2] + ["", "ab", texts[1]]
    frame = lambda ts: spark.createDataFrame([(t, 1, "g") for t in ts] + [(None, 2, "n")], "text string, n int, grams string")
    got = {(r["left"], r["right"]): r["similarity"] for r in similarity.similar_texts(frame(left), frame(right), threshold=threshold).collect()}
    want = {(a, b): jaccard(a, b) for a in set(left) for b in set(right) if jaccard(a, b) >= threshold}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    kept = sorted(str(r["text"]) for r in similarity.drop_similar(frame(left), frame(right), threshold=threshold).collect())
    assert kept == sorted([t for t in left if not any((t, b) in want for b in right)] + ["None"])


@pytest.mark.parametrize(("threshold", "rare"), [(0.5, 3), (0.9, 1), (0.9, 20), (0.9, 10_000), (1.0, 5)])
def test_similar_counts_count_every_pair(spark, threshold, rare):
    rng = random.Random(5)
    shapes = ["https://forum-archive.org//jump?to=https://drop-point.biz/box&sig=9f8e7d6c5b4a3928&n={}", "http://a-{}.café-漢字.org/x", "{}/b", "http://long.example.org/a/b/c/d/e/{}"]
    texts = [s.format(k) for s in shapes for k in rng.sample(range(3000), 60)] + ["", "a", "ab", "漢", "b" * 40, "b" * 41]
    left, right = [t for t in texts if rng.random() < 0.5] + ["", texts[0]], texts[::2] + texts[:5]
    frame = lambda ts: spark.createDataFrame([(t,) for t in ts] + [(None,)], "text string")
    got = {r["left"]: (r["n"], r["closest"]) for r in similarity.similar_counts(frame(left), frame(right), threshold=threshold, rare=rare).collect()}
    want = {}
    for a in set(left):
        near = [s for s in (jaccard(a, b) for b in set(right)) if s >= threshold]
        if near:
            want[a] = (len(near), max(near))
    assert got == want


def test_similar_counts_do_not_list_the_pairs_of_a_crowd(spark):
    shape = "https://forum-archive.org//jump?to=https://drop-point.biz/box&sig=9f8e7d6c5b4a39281706f5e4d3c2b1a0&n={}"
    text = F.regexp_replace(F.lit(shape), r"\{\}", (F.col("id") + 10_000).cast("string")).alias("text")
    rows = spark.range(40_000)
    counted = similarity.similar_counts(rows.where("id % 4 = 0").select(text), rows.where("id % 4 > 0").select(text))
    assert [tuple(r) for r in counted.groupBy("n").count().collect()] == [(30_000, 10_000)]  # 300 million links


def test_grams_are_as_frequent_as_in_their_family(spark):
    """Numbers that only meet in texts of other shapes make no classes, and what a whole shape shares is not listed."""
    letters = "abcdefghijklmnop"
    shapes = ["https://" + "".join(c + d for d in "qrstuvwxyz0123456789" * 2 + c) + f".example.org/{c}&n=" for c in letters]
    frame = lambda ks: spark.createDataFrame([(s + str(k * 7919 % 90_000 + 10_000),) for s in shapes for k in ks], "text string")
    one, two = frame(range(0, 60, 2)), frame(range(1, 60, 2))
    inside = similarity._ordered_grams(one, two, "text", 5, 12, 0.8)
    assert inside.select("family").distinct().count() == len(shapes)
    # the gram of five digits is in 16 texts, but in one of each shape
    assert inside.where("r = 0").count() == 0 and inside.agg(F.max(F.size("grams"))).first()[0] <= 6
    counts = similarity.similar_counts(one, two, threshold=0.8, rare=12).groupBy("n").count().collect()
    assert [tuple(r) for r in counts] == [(30, 30 * len(shapes))]


def test_bigram_model(spark):
    names = ["example.com", "zürich.ch", "a", "", "example.org", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    model = bigrams.fit_bigrams(df)
    code = lambda c: ord(c) - 31 if 32 <= ord(c) <= 126 else 96
    pairs = lambda n: list(zip([0, *map(code, n)], [*map(code, n), 0], strict=True))
    counts = Counter(p for n in names if n is not None for p in pairs(n))
    first = Counter()
    for (a, _), k in counts.items():
        first[a] += k
    p = lambda a, b: math.log((counts[a, b] + 0.5) / (first[a] + 0.5 * 97))
    asked = spark.createDataFrame([("zebra.ch",), ("",), (None,), ("ü",)], "name string")
    for r in bigrams.add_name_score(asked, model).collect():
        if r["name"] is None:
            assert r["name_log_p"] is None
        else:
            assert math.isclose(r["name_log_p"], sum(p(a, b) for a, b in pairs(r["name"])) / (len(r["name"]) + 1))


def test_content_features(spark):
    rows = [
        (1, "https://www.shop.co.uk/a", "<INPUT TYPE=password><form action=https://shop.co.uk/x></form><a href='/y'>y</a>"),
        (2, "https://shop.co.uk", "<form action='//evil.org/p'></form><a href=http://evil.org>e</a><a href='http://x.shop.co.uk'>s</a><a name=q>n</a>"),
        (3, "http://a.com", "<!--<input type=password>--><script>'<iframe hidden>'</script><iframe style='DISPLAY:NONE'></iframe>"),
        (4, "http://a.com", "<iframe src=x width=\"0\"></iframe><title>My  PayPal login</title>"),
        (5, "http://www.paypal.com", "<title>PayPal</title><iframe hidden src=y></iframe>"),
        (6, None, None),
        (7, "http://a.com", "<iframe width=100 src=hidden.html></iframe><title>repaypalish</title>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r[0]: tuple(r)[1:] for r in content.content_features(df).collect()}
    assert got[1] == (1, 0, 0.0, 0, 0)
    assert got[2] == (0, 1, 0.5, 0, 0)
    assert got[3] == (0, 0, 0.0, 1, 0)
    assert got[4] == (0, 0, 0.0, 1, 1)
    assert got[5] == (0, 0, 0.0, 1, 0)
    assert got[6] == (0, 0, 0.0, 0, 0)
    assert got[7] == (0, 0, 0.0, 0, 0)
    assert content.content_features(df.limit(0)).count() == 0


def test_ablation_drops_what_the_family_knows(spark):
    """Only brand features tell the labels apart: without them the scorer is no better than chance."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(600):
        x = dict.fromkeys(FEATURE_NAMES, 0.0) | {n: float(v) for n, v in zip(FEATURE_FAMILIES["counts"].split(), rng.integers(0, 9, 12), strict=True)}
        y = int(rng.integers(0, 2))
        x["brand_in_path"] = float(y if rng.random() < 0.9 else 1 - y)
        rows.append((y, x))
    struct = ", ".join(f"{n}: double" for n in FEATURE_NAMES)
    df = spark.createDataFrame(rows, f"label int, features struct<{struct}>")
    z = np.array([[x[n] for n in FEATURE_NAMES] + [1.0, y] for y, x in rows])
    assert np.allclose(ablation.gram_matrix(df), z.T @ z)
    got = {r["without"]: r for r in ablation.family_ablation(df, df).collect()}
    assert got["none"]["roc_auc"] > 0.85 and got["brand"]["roc_auc"] < 0.62 and got["brand"]["loss"] > 0.25
    assert got["keywords"]["loss"] == 0 and got["counts"]["n_features"] == len(FEATURE_NAMES) - 12


def test_bootstrap_over_many_partitions(spark):
    """The vectors of all partitions add up to those of one pass; counts above the exact table included."""
    rng = random.Random(2)
    rows = [("m", int(rng.random() < s / 50), s / 50) for s in range(50) for _ in range(40)] + [("n", 1, 0.5)]
    df = spark.createDataFrame(rows, "model string, label int, score double")
    got = {r["model"]: r for r in monitor.bootstrap_auc(df, resamples=64, group_cols=["model"]).collect()}
    counts = {}
    for m, y, s in rows:
        if m == "m":
            counts.setdefault(s, [0, 0])[y] += 1
    scores = sorted(counts, reverse=True)
    draw = lambda side: monitor._draws(np.array([counts[s][side] for s in scores]), [f"7:m:{s:.6f}:{side}" for s in scores], 64)
    pos, neg = draw(1), draw(0)
    auc = (neg * (np.cumsum(pos, axis=0) - pos / 2)).sum(axis=0) / (pos.sum(axis=0) * neg.sum(axis=0))
    for name, q in (("low", 0.025), ("median", 0.5), ("high", 0.975)):
        assert got["m"][name] == pytest.approx(np.quantile(auc, q), abs=1e-4)
    assert got["n"]["median"] is None


@pytest.mark.parametrize("per_task", [3, 50_000])
def test_isotonic_blocks_over_partitions(spark, per_task):
    rng = random.Random(per_task)
    rows = [(int(rng.random() < (s / 60) ** 2), s / 60) for s in range(5, 55) for _ in range(4)] + [(0, 0.7), (1, None)]
    df = spark.createDataFrame(rows, "label int, score double")
    knots = calibrate.isotonic_knots(df, per_task=per_task)
    by_score = {}
    for y, s in rows:
        by_score.setdefault(s or 0.0, []).append(y)
    scores = sorted(by_score)
    mean = lambda i, j: sum(map(sum, (by_score[s] for s in scores[i : j + 1]))) / sum(len(by_score[s]) for s in scores[i : j + 1])
    fit = [max(min(mean(j, k) for k in range(i, len(scores))) for j in range(i + 1)) for i in range(len(scores))]
    asked = spark.createDataFrame([(s, "k") for s in [*scores, None, -1.0, 2.0]], "score double, slot string")
    got = {r["score"]: r["calibrated"] for r in calibrate.apply_knots(asked, knots).collect()}
    assert all(math.isclose(got[s], f) for s, f in zip(scores, fit, strict=True))
    assert got[None] is None and got[-1.0] == pytest.approx(fit[0]) and got[2.0] == pytest.approx(fit[-1])
    middle = spark.createDataFrame([((scores[1] + scores[2]) / 2,)], "score double")
    between = calibrate.apply_knots(middle, knots).first()["calibrated"]
    assert min(fit[1], fit[2]) <= between <= max(fit[1], fit[2])
    assert calibrate.fit_isotonic(df).x[0] == 0.0


def test_attribute_forms(spark):
    tags = ["<a href=x>", "<a class='c' HREF = \"y z\">", "<a data-href='q'>", "<a href=''>"]
    df = spark.createDataFrame([(t,) for t in tags], "t string")
    assert [r[0] for r in df.select(content.attribute(F.col("t"), "href")).collect()] == ["x", "y z", "", ""]
    assert re.search(content.attribute_pattern("href"), tags[1])
