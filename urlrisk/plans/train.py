"""The whole training job: split, fit two scorers, blend, calibrate, set thresholds, evaluate, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.operators import calibrate, dataset, ensemble, evaluate
from urlrisk.operators.canonical import canonicalize_urls
from urlrisk.operators.features import FEATURE_NAMES, extract_features
from urlrisk.operators.ordering import cut_lineage
from urlrisk.plans import scorers
from urlrisk.sources.files import artifact_manifest


@dataclass(frozen=True)
class TrainedModel:
    """All parts needed to score: ``score`` adds ``model_probability`` (calibrated) to rows with features."""

    trees: scorers.TreeScorer
    text: scorers.TextScorer
    blend: ensemble.Ensemble
    calibrator: calibrate.Calibrator
    t_suspicious: float
    t_malicious: float

    def raw_score(self, df: DataFrame, url_col: str) -> DataFrame:
        df = self.text.score(self.trees.score(df, "p_trees"), url_col, "p_text")
        return df.withColumn("p_raw", self.blend.combine(F.col("p_trees"), F.col("p_text")))

    def score(self, df: DataFrame, url_col: str = "_scored_url") -> DataFrame:
        """A scorer for :func:`urlrisk.operators.detect.scan_urls`."""
        df = df.withColumn(url_col, F.col("parsed.canonical"))
        df = self.calibrator.apply(self.raw_score(df, url_col), "p_raw", "model_probability")
        return df.drop("p_trees", "p_text", "p_raw", url_col)


def train_model(
    rows: DataFrame,
    out: str,
    version: str,
    rounds: int = scorers.TREE_ROUNDS,
    depth: int = scorers.TREE_DEPTH,
) -> tuple[TrainedModel, DataFrame]:
    """Train on dataset rows, write all artifacts and their hashes below ``out``; return model and test report.

    Only small things reach the driver: class counts, the blend weight, breakpoints and one-row reports. The
    features are checkpointed once, because every stage below reads them again.
    """
    spark = rows.sparkSession
    dataset.validate_dataset(rows)
    split = cut_lineage(dataset.assign_splits(rows))  # the manifest and the features read it
    dataset.write_manifest(split, f"{out}/split_manifest")
    data = cut_lineage(
        extract_features(canonicalize_urls(split, "url"))
        .filter(F.col("features").isNotNull())
        .select("url", "label", "split", "features")
    )
    part = lambda name: data.filter(F.col("split") == name)
    trees = scorers.fit_tree_scorer(part("train"), part("val"), rounds, depth)
    text = scorers.fit_text_scorer(part("train"))

    held_out = trees.score(data.filter("split <> 'train'"), "p_trees")
    held_out = text.score(held_out, "url", "p_text").select("label", "split", "p_trees", "p_text")
    held_out = cut_lineage(held_out)
    scored = lambda name: held_out.filter(F.col("split") == name)
    blend = ensemble.fit_blend(scored("val"), "p_trees", "p_text")
    raw = held_out.withColumn("p_raw", blend.combine(F.col("p_trees"), F.col("p_text")))
    calibrator = calibrate.fit_isotonic(raw.filter("split = 'calib'"), "label", "p_raw")
    calibrated = calibrator.apply(raw, "p_raw", "p_cal")
    val_report = evaluate.evaluate_predictions(calibrated.filter("split = 'val'"), "label", "p_cal")
    limits = evaluate.operating_thresholds(val_report).first()
    test = raw.filter("split = 'test'")
    report = cut_lineage(calibrate.compare_calibration(test, calibrator, "label", "p_raw"))

    model = TrainedModel(trees, text, blend, calibrator, limits["t_suspicious"], limits["t_malicious"])
    files = f"{out}/artifacts"
    trees.model.write().overwrite().save(f"{files}/trees")
    text.model.write().overwrite().save(f"{files}/text")
    blend.save(spark, f"{files}/ensemble")
    calibrator.save(spark, f"{files}/calibrator")
    evaluate.write_report(
        spark.createDataFrame([(version, model.t_suspicious, model.t_malicious)], "version string, t_suspicious double, t_malicious double"),
        f"{files}/thresholds",
    )
    evaluate.write_report(spark.createDataFrame([(n,) for n in FEATURE_NAMES], "feature string"), f"{files}/features")
    evaluate.write_report(report, f"{files}/metrics")
    both = calibrator.apply(test, "p_raw", "p_cal")
    for name, col in (("raw", "p_raw"), ("calibrated", "p_cal")):
        evaluate.write_report(evaluate.reliability_curve(both, "label", col), f"{files}/reliability_{name}")
    artifact_manifest(spark, files, f"{out}/manifest")
    return model, report
