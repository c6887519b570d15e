"""Ordering helpers, splits, metrics, calibration and ensembles against plain Python on small data."""

import math
import random

import pytest
from pyspark.sql import functions as F

from urlrisk.operators.calibrate import Calibrator, fit_isotonic, load_calibrator
from urlrisk.operators.dataset import (
    assign_splits,
    manifest_hash,
    split_assignments,
    split_counts,
    split_overlap,
    validate_dataset,
)
from urlrisk.operators.ensemble import Ensemble, blend_scores, fit_blend, fit_stacking, load_ensemble
from urlrisk.operators.evaluate import (
    evaluate_predictions,
    operating_thresholds,
    reliability_curve,
    roc_curve,
)
from urlrisk.operators.ordering import global_running
from urlrisk.operators.skew import lookup_join


def sample(n=400, seed=3, levels=40):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        y = int(rng.random() < 0.4)
        rows.append((y, min(max(round((0.35 * y + 0.65 * rng.random()) * levels) / levels, 0.0), 1.0)))
    return rows


def expected_metrics(rows):
    pos = sum(y for y, _ in rows)
    neg = len(rows) - pos
    steps = []
    for s in sorted({p for _, p in rows}, reverse=True):
        at = [y for y, p in rows if p == s]
        steps.append((s, sum(at), len(at) - sum(at)))
    wins = sum((a > b) + 0.5 * (a == b) for y, a in rows if y for z, b in rows if not z)
    tp = fp = 0
    prev_r, prev_p, area, ap = 0.0, 1.0, 0.0, 0.0
    points = []
    for i, (s, a, b) in enumerate(steps):
        tp, fp = tp + a, fp + b
        r, p = tp / pos, tp / (tp + fp)
        area += (r - prev_r) * (p + prev_p) / 2
        ap += (r - prev_r) * p
        prev_r, prev_p = r, p
        last = i == len(steps) - 1
        if i == 0 or last or steps[i + 1][1:] != (a, b):
            points.append((fp / neg, r, s))
    ece = 0.0
    edges = [i * (1.0 / 10) for i in range(11)]
    for i in range(10):
        part = [(y, p) for y, p in rows if edges[i] <= p and (p < edges[i + 1] or (i == 9 and p <= 1.0))]
        if part:
            ece += abs(sum(y for y, _ in part) - sum(p for _, p in part)) / len(rows)
    best = [x for x in points if x[0] <= 0.01]
    return {
        "roc_auc": wins / pos / neg,
        "pr_auc": area,
        "average_precision": ap,
        "brier_score": sum((p - y) ** 2 for y, p in rows) / len(rows),
        "ece": ece,
        "recall_at_fpr_1pct": best[-1][1] if best else 0.0,
        "threshold_at_fpr_1pct": best[-1][2] if best else math.inf,
    }


@pytest.mark.parametrize("parts", [1, 5])
def test_global_running_for_any_partitioning(spark, parts):
    rows = [(g, i, (i * 7) % 11) for g in ("a", "b") for i in range(50 if g == "a" else 7)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(parts)
    got = global_running(df, ["k"], ["v"], ["g"], ["v"]).collect()
    for g, n in (("a", 50), ("b", 7)):
        part = sorted((r for r in got if r["g"] == g), key=lambda r: r["k"])
        total = 0
        for i, r in enumerate(part):
            total += r["v"]
            assert (r["ordinal"], r["run_v"], r["n_all"]) == (i + 1, total, n)
            assert (r["next"]["v"] if r["next"] else None) == (part[i + 1]["v"] if i + 1 < n else None)


def test_metrics(spark):
    rows, other = sample(), sample(seed=9, levels=500)
    df = spark.createDataFrame([("a", *r) for r in rows] + [("b", *r) for r in other], "m string, label int, score double")
    got = {r["m"]: r.asDict() for r in evaluate_predictions(df, group_cols=["m"]).collect()}
    for name, data in (("a", rows), ("b", other)):
        for metric, value in expected_metrics(data).items():
            assert got[name][metric] == pytest.approx(value, abs=1.01e-4), (name, metric)
    one = evaluate_predictions(df.filter("m = 'a'")).first().asDict()
    assert all(one[k] == v for k, v in got["a"].items() if k != "m")
    flipped = evaluate_predictions(df.filter("m = 'a'").withColumn("score", 1 - F.col("score"))).first()
    assert flipped["roc_auc"] == pytest.approx(1 - one["roc_auc"], abs=1e-4)


def test_perfect_scores_and_thresholds(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.95)], "label int, score double")
    report = evaluate_predictions(df)
    row = report.first()
    assert (row["roc_auc"], row["pr_auc"], row["recall_at_fpr_0_01pct"]) == (1.0, 1.0, 1.0)
    assert row["threshold_at_fpr_1pct"] == 0.8 and row["precision_at_base_rate_0_5pct"] == 0.834
    assert tuple(operating_thresholds(report).first()) == (0.8, 0.8)
    worst = df.withColumn("score", F.when(F.col("label") == 0, 0.99).otherwise(F.col("score")))
    row = evaluate_predictions(worst).first()
    assert row["threshold_at_fpr_1pct"] == math.inf and row["recall_at_fpr_1pct"] == 0.0


def test_reliability_bins(spark):
    df = spark.createDataFrame([(1, 0.3), (0, 0.1), (1, 1.0), (1, 0.95)], "label int, score double")
    bins = {r["bin"]: r for r in reliability_curve(df).collect()}
    assert len(bins) == 10 and sum(r["n"] for r in bins.values()) == 4
    assert bins[2]["n"] == 1 and bins[3]["n"] == 0  # the edge is 0.30000000000000004
    assert bins[9]["n"] == 2 and bins[4]["confidence"] == 0.45 and bins[4]["accuracy"] == 0.0


def pava(points):
    blocks = []
    for x, y, w in points:
        blocks.append([[x], y, w])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            xs, v, u = blocks.pop()
            a, b, c = blocks[-1]
            blocks[-1] = [a + xs, (b * c + v * u) / (c + u), c + u]
    return {x: b[1] for b in blocks for x in b[0]}


def test_isotonic(spark, tmp_path):
    rows = sample(300, 5, 30)
    df = spark.createDataFrame(rows, "label int, score double")
    cal = fit_isotonic(df)
    scores = sorted({p for _, p in rows})
    fit = pava([(s, sum(y for y, p in rows if p == s) / sum(p == s for _, p in rows), sum(p == s for _, p in rows)) for s in scores])
    got = {r["score"]: r["calibrated"] for r in cal.apply(df).collect()}
    assert all(got[s] == pytest.approx(fit[s], abs=1e-9) for s in scores)
    assert cal.x[0] == 0.0 and cal.x[-1] == 1.0
    small = Calibrator((0.0, 0.4, 1.0), (0.1, 0.2, 0.8))
    values = spark.createDataFrame([(-1.0,), (0.2,), (0.4,), (0.7,), (2.0,), (None,)], "score double")
    assert [r[1] for r in small.apply(values).collect()] == pytest.approx([0.1, 0.15, 0.2, 0.5, 0.8, None])
    small.save(spark, str(tmp_path / "c"))
    assert load_calibrator(spark, str(tmp_path / "c")) == small


def test_blend_and_stack(spark, tmp_path):
    rng = random.Random(2)
    rows = [(y, 0.5 * y + 0.5 * rng.random(), rng.random()) for y in (rng.randint(0, 1) for _ in range(200))]
    df = spark.createDataFrame(rows, "label int, p1 double, p2 double")
    scores = {round(r["weight"], 2): r["average_precision"] for r in blend_scores(df).collect()}
    assert len(scores) == 21
    for w in (0.0, 0.5, 1.0):
        want = expected_metrics([(y, min(max(w * a + (1.0 - w) * b, 0), 1)) for y, a, b in rows])["average_precision"]
        assert scores[w] == pytest.approx(want, abs=1e-9)
    best = fit_blend(df)
    assert scores[round(best.weight_tabular, 2)] == max(scores.values())
    stacked = fit_stacking(df)
    assert stacked.mode == "stack" and stacked.weight_tabular > abs(stacked.weight_text)
    out = df.select(stacked.combine(F.col("p1"), F.col("p2")), Ensemble(1, 3).combine(F.lit(0.2), F.lit(0.4))).first()
    assert 0 <= out[0] <= 1 and out[1] == pytest.approx(0.35)
    Ensemble(0.25, 0.75).save(spark, str(tmp_path / "e"))
    assert load_ensemble(spark, str(tmp_path / "e")) == Ensemble(0.25, 0.75)


def test_splits(spark):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        d = 0 if rng.random() < 0.35 else rng.randint(1, 60)  # one domain holds a third of the rows
        rows.append((f"d{d}.com", f"2026-0{1 + d % 9}-1{d % 7}", f"h{rng.randint(0, 300)}-{d}"))
    df = spark.createDataFrame(rows, "registered_domain string, first_seen string, url_sha256 string")
    out = assign_splits(df).cache()
    first = {}
    for d, day, _ in rows:
        first[d] = min(first.get(d, day), day)
    order = sorted(first, key=lambda d: (first[d], d))
    n = len(order)
    a, b, c = int(n * 0.7), int(n * 0.1), int(n * 0.1)
    want = {d: "train" if i < a else "val" if i < a + b else "calib" if i < a + b + c else "test" for i, d in enumerate(order)}
    assert all(r["split"] == want[r["registered_domain"]] for r in out.collect())
    assert split_overlap(out).count() == 0
    counts = {r["split"]: r for r in split_counts(out).collect()}
    assert sum(r["n_rows"] for r in counts.values()) == 500 and counts["train"]["n_domains"] == a
    h1 = manifest_hash(split_assignments(out)).first()
    h2 = manifest_hash(split_assignments(out).repartition(7)).first()
    assert h1 == h2 and h1["total_urls"] == len({r[2] for r in rows})


def test_lookup_join_beyond_the_broadcast_bound(spark):
    rows = [("hot", i) if i % 3 == 0 else (f"k{i}", i) for i in range(3000)] + [(None, -1)]
    df = spark.createDataFrame(rows, "k string, v int")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", 2) for i in range(0, 3000, 2)], "k string, w int")
    fast = lookup_join(df, table, ["k"])
    slow = lookup_join(df, table, ["k"], max_rows=10, sample=0.5)
    assert sorted(map(str, fast.collect())) == sorted(map(str, slow.select(*fast.columns).collect()))


def test_validation(spark):
    cols = "url_raw url label source first_seen host registered_domain tld target_brand split url_sha256".split()
    row = ["x"] * 11
    df = spark.createDataFrame([row], cols).withColumn("label", F.lit(1))
    assert validate_dataset(df)
    with pytest.raises(ValueError, match="Missing required column"):
        validate_dataset(df.drop("tld"))
    with pytest.raises(ValueError, match="Expected only 0 or 1"):
        validate_dataset(df.withColumn("label", F.lit(3)))


def test_roc_curve_is_monotone(spark):
    df = spark.createDataFrame(sample(), "label int, score double")
    points = sorted(roc_curve(df).collect(), key=lambda r: r["ordinal"])
    assert all(a["tpr"] <= b["tpr"] and a["fpr"] <= b["fpr"] for a, b in zip(points, points[1:]))
    assert points[-1]["tpr"] == points[-1]["fpr"] == 1.0
