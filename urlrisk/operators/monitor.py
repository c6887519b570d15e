"""Reports around the model: dataset audit, drift, feedback rates, error lists, promotion and triage."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlrisk.functions.privacy import defang
from urlrisk.operators.evaluate import curve_points, roc_auc_expr, score_counts
from urlrisk.operators.features import FEATURE_NAMES
from urlrisk.operators.ordering import cut_lineage, global_running, stored
from urlrisk.operators.skew import bounded_broadcast, lookup_join

PSI_BINS = 10
PSI_FLOOR = 1e-4
POISSON_EXACT = 30


def artifact_audit(df: DataFrame, label: str = "label", parsed: str = "parsed") -> DataFrame:
    """Simple rates per label that would give a shortcut away: path, https, www, length, slash, digits."""
    p = F.col(parsed)
    rate = lambda cond: F.round(F.avg(cond.cast("double")), 6)
    digits = F.length(F.regexp_replace(p["canonical"], r"\P{Nd}+", ""))
    return (
        df.filter(p["is_valid"])
        .groupBy(label)
        .agg(
            F.count("*").alias("n"),
            rate(p["path"] != "/").alias("has_path_rate"),
            rate(p["scheme"] == "https").alias("https_rate"),
            rate(p["host"].startswith("www.")).alias("www_rate"),
            F.round(F.avg(F.length(p["canonical"])), 6).alias("mean_length"),
            rate(p["path"].endswith("/")).alias("trailing_slash_rate"),
            F.round(F.avg(digits / F.length(p["canonical"])), 6).alias("mean_digit_ratio"),
        )
    )


def tld_counts(df: DataFrame, label: str = "label", parsed: str = "parsed") -> DataFrame:
    rows = df.filter(F.col(f"{parsed}.is_valid"))
    return rows.groupBy(label, F.col(f"{parsed}.suffix").alias("tld")).agg(F.count("*").alias("n"))


def feature_long(df: DataFrame, keep: Sequence[str], features: str = "features", names: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """One row per URL and feature."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"{features}.{n}").cast("double").alias("value")) for n in names])
    return df.filter(F.col(features).isNotNull()).select(*keep, F.explode(pairs).alias("_f")).select(*keep, "_f.*")


def single_feature_auc(df: DataFrame, label: str = "label", names: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """ROC-AUC of every feature on its own: all features in one job over value counts."""
    y = F.col(label).cast("long")
    counts = (
        feature_long(df, [label], names=names)
        .groupBy("feature", F.col("value").alias("score"))
        .agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    )
    return curve_points(counts, ["feature"]).groupBy("feature").agg(F.round(roc_auc_expr(), 6).alias("roc_auc"))


def prior_shift(probability: Column, train_prior: float, use_prior: float) -> Column:
    """Probability under another class prior."""
    up = probability * (use_prior / train_prior)
    down = (1 - probability) * ((1 - use_prior) / (1 - train_prior))
    return up / (up + down)


def tld_prior(train: DataFrame, label: str = "label", tld: str = "tld") -> DataFrame:
    """Share of malicious rows per TLD; fit on train rows only."""
    return train.groupBy(tld).agg(F.avg(F.col(label).cast("double")).alias("tld_risk_prior"))


def add_tld_prior(df: DataFrame, prior: DataFrame, tld: str = "tld") -> DataFrame:
    """Null for a TLD the training rows did not have."""
    return lookup_join(df, prior, [tld])


def f1_at(df: DataFrame, threshold: float, label: str = "label", score: str = "score", group_cols: Sequence[str] = ()) -> DataFrame:
    """F1 at a threshold. A missing score counts as 0, as in the evaluation report; ``n_null`` says how many there are."""
    hit, pos = F.coalesce(F.col(score), F.lit(0.0)) >= threshold, F.col(label) == 1
    n = lambda cond: F.sum(cond.cast("long"))
    sums = df.groupBy(*group_cols).agg(
        n(hit & pos).alias("tp"),
        n(hit & ~pos).alias("fp"),
        n(~hit & pos).alias("fn"),
        F.count_if(F.col(score).isNull()).alias("n_null"),
    )
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return sums.withColumn("f1", F.round(f1, 6))


def _poisson_table(most: int) -> list[list[float]]:
    """Cumulative probabilities of Poisson(k) for k = 0 to ``most``, until they are 1 to 12 digits."""
    out = []
    for k in range(most + 1):
        term, total, row = math.exp(-k), math.exp(-k), []
        while 1 - total > 1e-12:
            row.append(total)
            term *= k / len(row)
            total += term
        out.append(row)
    return out


_POISSON = [np.array(row) for row in _poisson_table(POISSON_EXACT)]


def _draws(counts: np.ndarray, keys: Sequence[str], resamples: int) -> np.ndarray:
    """Poisson draws, one row per count and one column per resample, from SHA-256 of each key and a block number: eight draws a block."""
    blocks = range((resamples + 7) // 8)

    def uniform(tag: str) -> np.ndarray:
        text = b"".join(hashlib.sha256(f"{key}:{tag}:{b}".encode()).digest() for key in keys for b in blocks)
        return (np.frombuffer(text, ">u4").reshape(len(keys), -1)[:, :resamples] + 0.5) / 2.0**32

    u, out = uniform("u"), np.zeros((len(keys), resamples), np.int64)
    for k in np.unique(counts[counts <= POISSON_EXACT]):
        at = counts == k
        out[at] = np.searchsorted(_POISSON[k], u[at], "left")
    large = counts > POISSON_EXACT
    if large.any():
        n, v = counts[large, None].astype(float), uniform("v")[large]
        out[large] = np.maximum(np.rint(n + np.sqrt(n) * np.sqrt(-2 * np.log(u[large])) * np.cos(2 * np.pi * v)), 0)
    return out


def bootstrap_auc(
    df: DataFrame, label: str = "label", score: str = "score", resamples: int = 1000, seed: int = 7, group_cols: Sequence[str] = ()
) -> DataFrame:
    """95 % interval of ROC-AUC by Poisson bootstrap.

    Resampling happens on the counts per score, so rows are never copied. A count k becomes a Poisson(k) draw from
    a hash of (seed, group, score to 6 digits, side, resample): from the exact distribution up to ``POISSON_EXACT``, beyond it a rounded normal of the
    same mean and variance. Every run gives the same interval. The counts are sorted once; each range partition keeps three running sums for all resamples,
    and one row per partition and group is left to add up.
    """
    groups = list(group_cols)
    counts = score_counts(df, label, score, groups)
    name = F.concat_ws(":", F.lit(str(seed)), *[F.col(g).cast("string") for g in groups]).alias("_name")
    order = [*groups, F.desc("score")]
    spread = counts.repartitionByRange(*order).sortWithinPartitions(*order).select(name, "score", "pos", "neg", F.spark_partition_id().alias("part"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sums = None, np.zeros((3, resamples), np.int64)

        def row() -> pd.DataFrame:
            return pd.DataFrame({"_name": [now[0]], "part": [now[1]], "pos": [sums[0]], "neg": [sums[1]], "twice": [sums[2]]})

        for batch in batches:
            for start in range(0, len(batch), 256):
                chunk = batch.iloc[start : start + 256]
                for group, rows in chunk.groupby(["_name", "part"], sort=False):
                    if group != now:
                        if now is not None:
                            yield row()
                        now, sums = group, np.zeros((3, resamples), np.int64)
                    texts = [f"{group[0]}:{s:.6f}" for s in rows["score"]]
                    pos = _draws(rows["pos"].to_numpy(), [f"{t}:1" for t in texts], resamples)
                    neg = _draws(rows["neg"].to_numpy(), [f"{t}:0" for t in texts], resamples)
                    before = sums[0] + np.cumsum(pos, axis=0) - pos
                    sums[2] += (neg * (2 * before + pos)).sum(axis=0)
                    sums[0] += pos.sum(axis=0)
                    sums[1] += neg.sum(axis=0)
        if now is not None:
            yield row()

    vectors = "pos array<long>, neg array<long>, twice array<long>"
    parts = spread.mapInPandas(add, f"_name string, part int, {vectors}")

    def interval(rows: pd.DataFrame) -> pd.DataFrame:  # one row per partition
        pos, neg, twice = np.zeros((3, resamples))
        for r in rows.sort_values("part").itertuples():
            twice = twice + r.twice + 2 * pos * r.neg
            pos, neg = pos + r.pos, neg + r.neg
        known = (pos > 0) & (neg > 0)
        auc = twice[known] / (2 * pos[known] * neg[known])
        low, median, high = np.quantile(auc, [0.025, 0.5, 0.975]) if len(auc) else [None] * 3
        return pd.DataFrame({"_name": rows["_name"].iloc[:1], "low": [low], "median": [median], "high": [high]})

    bounds = parts.groupBy("_name").applyInPandas(interval, "_name string, low double, median double, high double")
    rounded = [F.round(c, 4).alias(c) for c in ("low", "median", "high")]
    if not groups:
        return bounds.select(*rounded)
    return bounds.join(bounded_broadcast(counts.select(*groups, name).distinct()), "_name").select(*groups, *rounded)


def population_stability(train: DataFrame, current: DataFrame, names: Sequence[str] = FEATURE_NAMES, bins: int = PSI_BINS) -> DataFrame:
    """PSI per feature; bin edges are quantiles of the training rows. Both sides are read once, into counts per value."""
    base, now = feature_long(train, [], names=names), feature_long(current, [], names=names)
    both = base.withColumn("_side", F.lit("a")).unionByName(now.withColumn("_side", F.lit("b")))
    counted = cut_lineage(both.groupBy("feature", "_side", "value").agg(F.count("*").alias("n")))
    run = global_running(counted.where("_side = 'a' and value is not null"), ["value"], ["n"], ["feature"])
    edge = lambda i: F.min(F.when(F.col("run_n") * bins >= F.col("all_n") * i, F.col("value")))
    edges = run.groupBy("feature").agg(F.array(*[edge(i) for i in range(1, bins)]).alias("_edges"))  # one row per feature
    binned = counted.join(bounded_broadcast(edges), "feature").withColumn(
        "bin", F.size(F.filter(F.array_distinct("_edges"), lambda e: e < F.col("value")))
    )
    per_bin = binned.groupBy("feature", "bin").agg(
        F.sum(F.when(F.col("_side") == "a", F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("_side") == "b", F.col("n")).otherwise(0)).alias("b"),
    )
    whole = Window.partitionBy("feature")  # at most ``bins`` rows each
    share = lambda c: F.greatest(F.col(c) / F.sum(c).over(whole), F.lit(PSI_FLOOR))
    terms = per_bin.select("feature", share("a").alias("a"), share("b").alias("b"))
    psi = F.sum((F.col("b") - F.col("a")) * F.log(F.col("b") / F.col("a")))
    return terms.groupBy("feature").agg(F.round(psi, 6).alias("psi"))


def feedback_rates(feedback: DataFrame, scans: DataFrame) -> DataFrame:
    """Feedback counts and rates per model version; ``scans`` has unique ``id`` and ``model_version``. Feedback on a scan that
    is not stored counts under a null version. The scans are the large side, so they are only read for the ids that are asked for."""
    wanted = scans.select(F.col("id").alias("scan_id"), "model_version")
    ids = bounded_broadcast(feedback.select("scan_id").distinct())
    joined = feedback.join(wanted.join(ids, "scan_id", "left_semi"), "scan_id", "left")
    is_label = lambda v: (F.col("label") == v).cast("long")
    return joined.groupBy("model_version").agg(
        F.count("*").alias("n"),
        F.round(F.avg(is_label("false_positive")), 6).alias("false_positive_rate"),
        F.round(F.avg(is_label("false_negative")), 6).alias("false_negative_rate"),
    )


def feed_recall(scans: DataFrame, feed: DataFrame, since: Column) -> DataFrame:
    """Share of fresh feed entries (first seen at or after ``since``) that the scan calls malicious or suspicious, per source.
    ``scans``: url_sha256 and verdict; ``feed``: source, url_sha256, first_seen. An entry without a scan is missed."""
    flagged = scans.where(F.col("verdict").isin("malicious", "suspicious")).select("url_sha256").distinct().withColumn("_hit", F.lit(1))
    fresh = feed.where(F.col("first_seen") >= since).select("source", "url_sha256").distinct()
    hits = F.count("_hit")
    return fresh.join(flagged, "url_sha256", "left").groupBy("source").agg(
        F.count("*").alias("n"), hits.alias("n_detected"), F.round(hits / F.count("*"), 6).alias("recall")
    )


def error_list(scans: DataFrame, label: str = "label", top: int = 50) -> DataFrame:
    """The ``top`` most confident false positives and false negatives, defanged.

    Each side is a plain top-k, which Spark keeps per partition before it merges.
    """
    flagged = F.col("verdict").isin("malicious", "suspicious")
    rows = scans.select(
        label, "probability", "registered_domain", "url_sha256", defang(F.col("url_canonical")).alias("url_defanged"), flagged.alias("_f")
    )
    fp = rows.filter(F.col("_f") & (F.col(label) == 0)).orderBy(F.desc("probability"), "url_sha256").limit(top)
    fn = rows.filter(~F.col("_f") & (F.col(label) == 1)).orderBy("probability", "url_sha256").limit(top)
    both = fp.withColumn("error_type", F.lit("FP")).unionByName(fn.withColumn("error_type", F.lit("FN")))
    return both.drop("_f")


def error_groups(scans: DataFrame, label: str = "label") -> DataFrame:
    flagged = F.col("verdict").isin("malicious", "suspicious")
    kind = F.when(flagged & (F.col(label) == 0), "FP").when(~flagged & (F.col(label) == 1), "FN")
    return (
        scans.withColumn("error_type", kind)
        .filter(F.col("error_type").isNotNull())
        .groupBy("error_type", "registered_domain")
        .agg(F.count("*").alias("n"))
    )


def false_alarms(scans: DataFrame) -> DataFrame:
    """Malicious verdicts among popular sites; should be about none."""
    return scans.agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "malicious").alias("n_false_alarms"))


def promotion_gate(candidate: DataFrame, champion: DataFrame, tolerances: dict[str, float]) -> DataFrame:
    """Compare two one-row reports: better recall at FPR 0.1 %, and no metric worse than its tolerance."""
    metric = "recall_at_fpr_0_1pct"
    names = [metric, *tolerances]
    a = candidate.select(*[F.col(n).alias(f"_a_{n}") for n in names])
    b = champion.select(*[F.col(n).alias(f"_b_{n}") for n in names])
    ok = F.col(f"_a_{metric}") > F.col(f"_b_{metric}")
    for name, slack in tolerances.items():
        ok = ok & (F.col(f"_a_{name}") >= F.col(f"_b_{name}") - slack)
    return a.join(F.broadcast(b), F.lit(True)).withColumn("promote", ok)


def triage(scans: DataFrame, top: int | None = None) -> DataFrame:
    """Scans by falling risk with defanged URLs, for a review list or a CSV file."""
    shown = F.when(F.col("url_canonical") != "", F.col("url_canonical")).otherwise(F.col("url_raw"))
    rows = scans.select("risk_score", "verdict", "confidence", "registered_domain", "url_sha256", defang(shown).alias("url_defanged"))
    ordered = rows.orderBy(F.desc("risk_score"), "url_sha256")
    return ordered if top is None else ordered.limit(top)


def write_triage(scans: DataFrame, path: str, top: int | None = None) -> None:
    """The review list as CSV files with a header, in order of risk over the files' names. The list is stored before it is sorted, as
    Spark reads what it sorts twice: once for the bounds of its ranges."""
    shown = F.when(F.col("url_canonical") != "", F.col("url_canonical")).otherwise(F.col("url_raw"))
    rows = scans.select("risk_score", "verdict", "confidence", "registered_domain", "url_sha256", shown.alias("url_canonical"), F.lit("").alias("url_raw"))
    triage(stored(rows, "triage"), top).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
