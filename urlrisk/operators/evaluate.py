"""Evaluation of scored, labelled rows: curves, areas, calibration error and operating points.

Rows are first counted per distinct score (a map-side combine), so everything after that works on counts. All
functions accept ``group_cols`` and then evaluate many models or slices in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.operators.ordering import global_running
from urlrisk.operators.skew import bounded_broadcast

# fixed values
N_BINS = 10
FPR_BUDGETS = {"1pct": 0.01, "0_1pct": 0.001, "0_01pct": 0.0001}
BASE_RATES = {"0_05pct": 0.0005, "0_5pct": 0.005, "5pct": 0.05}
NOMINAL_FPR = 0.001
LEAKAGE_AUC = 0.999
THRESHOLD_DEFAULTS = {"suspicious": (0.05, 0.90, 0.35), "malicious": (0.10, 0.90, 0.70)}


def score_counts(df: DataFrame, label: str = "label", score: str = "score", group_cols: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score, the score clipped to [0, 1].

    Every row counts: a missing score is taken as 0.
    """
    clipped = F.least(F.greatest(F.col(score).cast("double"), F.lit(0.0)), F.lit(1.0))
    return (
        df.select(*group_cols, clipped.alias("score"), F.col(label).cast("long").alias("_y"))
        .groupBy(*group_cols, "score")
        .agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))
    )


def curve_points(counts: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """ROC and PR points by falling threshold from a table of score counts.

    ``kept`` marks the points a ROC curve keeps after dropping those whose step repeats the next step; the
    point (0, 0) at an infinite threshold is implied.
    """
    keyed = counts.withColumn("_order", -F.col("score"))
    run = global_running(keyed, ["_order"], ["pos", "neg"], group_cols, ["pos", "neg"])
    tp, fp = F.col("run_pos"), F.col("run_neg")
    kept = (
        (F.col("ordinal") == 1)
        | F.col("next").isNull()
        | (F.col("next.pos") != F.col("pos"))
        | (F.col("next.neg") != F.col("neg"))
    )
    return run.select(
        *group_cols,
        F.col("score").alias("threshold"),
        "ordinal",
        "pos",
        "neg",
        tp.alias("tp"),
        fp.alias("fp"),
        F.col("all_pos").alias("n_pos"),
        F.col("all_neg").alias("n_neg"),
        F.try_divide(tp, F.col("all_pos")).alias("tpr"),
        F.try_divide(fp, F.col("all_neg")).alias("fpr"),
        (tp / (tp + fp)).alias("precision"),
        kept.alias("kept"),
    )


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", group_cols: Sequence[str] = ()) -> DataFrame:
    return curve_points(score_counts(df, label, score, group_cols), group_cols)


def roc_auc_expr() -> Column:
    """Pairs ordered right, ties counted half, over all pairs."""
    ordered = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2))
    return F.try_divide(ordered, F.max(F.col("n_pos").cast("double") * F.col("n_neg")))


def pr_auc_expr() -> Column:
    """Trapezoid over the PR points, with the anchor recall 0, precision 1."""
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    previous = F.when(F.col("ordinal") == 1, 1.0).otherwise(F.try_divide(tp0, tp0 + fp0))
    return F.try_divide(F.sum(F.col("pos") * (F.col("precision") + previous) / 2), F.max("n_pos"))


def average_precision_expr() -> Column:
    return F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.max("n_pos"))


def brier_expr() -> Column:
    p = F.col("threshold")
    return F.sum(F.col("pos") * F.pow(1 - p, F.lit(2)) + F.col("neg") * F.pow(p, F.lit(2))) / F.sum(
        F.col("pos") + F.col("neg")
    )


def recall_at_fpr_expr(budget: float) -> Column:
    """Struct (tpr, threshold) of the last kept point within the budget."""
    inside = F.col("kept") & (F.col("fpr") <= budget)
    best = F.max_by(F.struct("tpr", "threshold"), F.when(inside, F.col("ordinal")))
    return F.when(F.max(inside.cast("int")) == 1, best)


def base_rate_precision(tpr: Column, fpr: Column | float, rate: Column | float) -> Column:
    """Precision in use at base rate ``rate``: TPR*r / (TPR*r + FPR*(1-r)), 0 when undefined."""
    rate = F.lit(rate) if isinstance(rate, float) else rate
    fpr = F.lit(fpr) if isinstance(fpr, float) else fpr
    top = tpr * rate
    bottom = top + fpr * (1 - rate)
    return F.when(bottom <= 0, 0.0).otherwise(F.round(top / bottom, 4))


def bin_index(score: Column, n_bins: int = N_BINS) -> Column:
    """Equal-width bin, upper edges open, last bin closed; edges are the products ``i * (1/n)``."""
    return sum(((score >= F.lit(i * (1.0 / n_bins))).cast("int") for i in range(1, n_bins)), F.lit(0))


def bin_stats(counts: DataFrame, group_cols: Sequence[str] = (), n_bins: int = N_BINS) -> DataFrame:
    n = F.col("pos") + F.col("neg")
    return (
        counts.withColumn("bin", bin_index(F.col("score"), n_bins))
        .groupBy(*group_cols, "bin")
        .agg(
            F.sum(n).alias("n"),
            (F.sum("pos") / F.sum(n)).alias("accuracy"),
            (F.sum(n * F.col("score")) / F.sum(n)).alias("confidence"),
        )
    )


def ece(counts: DataFrame, group_cols: Sequence[str] = (), n_bins: int = N_BINS) -> DataFrame:
    """Expected calibration error per group from score counts."""
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return bin_stats(counts, group_cols, n_bins).groupBy(*group_cols).agg(
        F.round(F.sum(F.col("n") * gap) / F.sum("n"), 4).alias("ece")
    )


def reliability_curve(
    df: DataFrame, label: str = "label", score: str = "score", group_cols: Sequence[str] = (), n_bins: int = N_BINS
) -> DataFrame:
    """One row per bin; an empty bin shows its midpoint and accuracy 0."""
    counts = score_counts(df, label, score, group_cols)
    stats = bin_stats(counts, group_cols, n_bins)
    groups = counts.select(*group_cols).distinct() if group_cols else df.sparkSession.range(1).select()
    bins = groups.select(*group_cols, F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    out = bins.join(stats, [*group_cols, "bin"], "left")
    step = 1.0 / n_bins
    middle = (F.col("bin") * F.lit(step) + (F.col("bin") + 1) * F.lit(step)) / 2
    return out.select(
        *group_cols,
        "bin",
        F.round(F.col("bin") * F.lit(step), 4).alias("low"),
        F.round((F.col("bin") + 1) * F.lit(step), 4).alias("high"),
        F.round(F.coalesce("confidence", middle), 4).alias("confidence"),
        F.round(F.coalesce("accuracy", F.lit(0.0)), 4).alias("accuracy"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def evaluate_predictions(
    df: DataFrame, label: str = "label", score: str = "score", group_cols: Sequence[str] = ()
) -> DataFrame:
    """The report: one row per group with all metrics, rounded to 4 digits.

    Without a point inside an FPR budget the recall is 0 and the threshold infinite. ``realized_fpr_0_1pct`` is
    the false-positive rate actually reached; precision at base rates uses the nominal 0.1 %.
    """
    groups = list(group_cols)
    counts = score_counts(df, label, score, groups)
    points = curve_points(counts, groups)
    at = {name: recall_at_fpr_expr(budget).alias(f"_at_{name}") for name, budget in FPR_BUDGETS.items()}
    realized = F.max(F.when(F.col("kept") & (F.col("fpr") <= FPR_BUDGETS["0_1pct"]), F.col("fpr")))
    rows = points.groupBy(*groups).agg(
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
        F.round(roc_auc_expr(), 4).alias("roc_auc"),
        F.round(pr_auc_expr(), 4).alias("pr_auc"),
        F.round(average_precision_expr(), 4).alias("average_precision"),
        F.round(brier_expr(), 4).alias("brier_score"),
        F.coalesce(realized, F.lit(0.0)).alias("_realized"),
        *at.values(),
    )
    recall = lambda name: F.round(F.coalesce(F.col(f"_at_{name}.tpr"), F.lit(0.0)), 4)
    limit = lambda name: F.coalesce(F.round(F.col(f"_at_{name}.threshold"), 4), F.lit(float("inf")))
    errors = ece(_counts_of(points, groups), groups)
    joined = rows.join(bounded_broadcast(errors), groups) if groups else rows.join(F.broadcast(errors), F.lit(True))
    return joined.select(
        *groups,
        "n_pos",
        "n_neg",
        "roc_auc",
        "pr_auc",
        "average_precision",
        "brier_score",
        "ece",
        *[recall(name).alias(f"recall_at_fpr_{name}") for name in FPR_BUDGETS],
        *[
            base_rate_precision(recall("0_1pct"), NOMINAL_FPR, rate).alias(f"precision_at_base_rate_{name}")
            for name, rate in BASE_RATES.items()
        ],
        *[limit(name).alias(f"threshold_at_fpr_{name}") for name in ("1pct", "0_1pct")],
        F.round("_realized", 6).alias("realized_fpr_0_1pct"),
    )


def _counts_of(points: DataFrame, groups: Sequence[str]) -> DataFrame:
    return points.select(*groups, F.col("threshold").alias("score"), "pos", "neg")


def operating_thresholds(report: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Verdict thresholds from the report; values outside the plausible band fall back to the defaults."""

    def pick(col: str, kind: str) -> Column:
        low, high, default = THRESHOLD_DEFAULTS[kind]
        raw = F.col(col)
        return F.when((raw <= low) | (raw >= high), default).otherwise(F.round(raw, 4))

    return report.select(
        *group_cols,
        pick("threshold_at_fpr_1pct", "suspicious").alias("t_suspicious"),
        pick("threshold_at_fpr_0_1pct", "malicious").alias("t_malicious"),
    )


def leakage_alarm(report: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Flag test results that are too good to be true."""
    return report.select(*group_cols, "roc_auc", (F.col("roc_auc") > LEAKAGE_AUC).alias("leakage_suspected"))


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
