"""Recall under URL perturbations: every strategy in one job, clean URLs scored once."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlrisk.functions.perturb import STRATEGIES
from urlrisk.functions.planning import computed_stage
from urlrisk.operators.canonical import canonicalize_urls
from urlrisk.operators.detect import scan_urls

CLEAN = "clean"
Strategy = Callable[[Column], Column]


def flagged_by_rules(df: DataFrame) -> DataFrame:
    """Default detector: add ``detected``, true for a malicious or suspicious verdict on ``parsed``."""
    scans = scan_urls(df, parsed="parsed", columns=["verdict"])
    return scans.withColumn("detected", F.col("verdict").isin("malicious", "suspicious"))


def perturb_urls(df: DataFrame, url_col: str = "url", strategies: Mapping[str, Strategy] | None = None) -> DataFrame:
    """One row per URL and strategy, with ``strategy`` and ``perturbed``."""
    active = STRATEGIES if strategies is None else strategies
    variants = F.array(
        *[F.struct(F.lit(name).alias("strategy"), fn(F.col(url_col)).alias("perturbed")) for name, fn in active.items()]
    )
    return df.select(*df.columns, F.explode(variants).alias("_v")).select(*df.columns, "_v.*")


def robustness_by_strategy(
    df: DataFrame,
    url_col: str = "url",
    detect: Callable[[DataFrame], DataFrame] = flagged_by_rules,
    strategies: Mapping[str, Strategy] | None = None,
) -> DataFrame:
    """Counts of ``strategy`` (and of the clean URLs): ``sample_count`` and ``n_detected``.

    A perturbation that makes a URL invalid is replaced by the original URL. ``detect`` takes rows with a
    ``parsed`` struct and adds a boolean ``detected``.
    """
    active = STRATEGIES if strategies is None else strategies
    base = canonicalize_urls(df.select(F.col(url_col).alias("url")), "url", "_rob_clean")
    pairs = [F.struct(F.lit(name).alias("strategy"), fn(F.col("url")).alias("perturbed")) for name, fn in active.items()]
    none = F.struct(F.lit(CLEAN).alias("strategy"), F.lit(None).cast("string").alias("perturbed"))
    rows = base.select("url", "_rob_clean", F.explode(F.array(none, *pairs)).alias("_v")).select("url", "_rob_clean", "_v.*")
    rows = canonicalize_urls(rows, "perturbed", "_rob_changed")
    use_changed = (F.col("strategy") != CLEAN) & F.col("_rob_changed.is_valid")
    rows = computed_stage(
        rows, ["strategy", "url"], {"parsed": F.when(use_changed, F.col("_rob_changed")).otherwise(F.col("_rob_clean"))}
    )
    return detect(rows).groupBy("strategy").agg(
        F.count("*").alias("sample_count"), F.sum(F.col("detected").cast("long")).alias("n_detected")
    )


def robustness_report(counts: DataFrame) -> DataFrame:
    """Per-strategy recall and drop from the counts (one row per strategy, so the window is tiny)."""
    everything = Window.partitionBy()
    clean = F.max(F.when(F.col("strategy") == CLEAN, F.col("n_detected"))).over(everything)
    c_recall = F.coalesce(F.try_divide(F.col("clean_detected"), F.col("sample_count")), F.lit(0.0))
    p_recall = F.coalesce(F.try_divide(F.col("perturbed_detected"), F.col("sample_count")), F.lit(0.0))
    return (
        counts.withColumn("clean_detected", clean)
        .filter(F.col("strategy") != CLEAN)
        .withColumnRenamed("n_detected", "perturbed_detected")
        .select(
            "strategy",
            "sample_count",
            "clean_detected",
            "perturbed_detected",
            F.round(c_recall, 4).alias("clean_recall"),
            F.round(p_recall, 4).alias("perturbed_recall"),
            F.round(F.greatest(c_recall - p_recall, F.lit(0.0)), 4).alias("recall_drop"),
        )
    )


def robustness_summary(counts: DataFrame) -> DataFrame:
    """One row: totals over all strategies."""
    is_clean = F.col("strategy") == CLEAN
    total = lambda col, cond: F.sum(F.when(cond, F.col(col)).otherwise(0))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    sums = counts.agg(
        total("sample_count", is_clean).alias("total_samples"),
        ratio(total("n_detected", is_clean), total("sample_count", is_clean)).alias("_c"),
        ratio(total("n_detected", ~is_clean), total("sample_count", ~is_clean)).alias("_p"),
    )
    return sums.select(
        "total_samples",
        F.round("_c", 4).alias("overall_clean_recall"),
        F.round("_p", 4).alias("overall_perturbed_recall"),
        F.round(F.greatest(F.col("_c") - F.col("_p"), F.lit(0.0)), 4).alias("overall_recall_drop"),
    )
