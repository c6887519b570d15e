"""Tables that several passes read are worked out once, and stored scans make few files."""

import glob

from pyspark.sql import functions as F

from urlrisk.operators import monitor, store
from urlrisk.plans import registry, registry_models, registry_monitor

FOLDER = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_features_of_the_ablation_are_stored(spark, monkeypatch):
    """Train and test rows are read from what was stored; no plan repeats the canonicalization."""
    seen = []
    monkeypatch.setattr(registry_monitor.ablation, "family_ablation", lambda train, test: seen.extend([train, test]) or train)
    registry_monitor._ablation(spark, FOLDER)
    for rows in seen:
        assert "unicode_host" not in _plan(rows) and rows.columns[-1] == "split"
    assert sum(rows.count() for rows in seen) > 0


def test_split_rows_are_stored(spark):
    rows = registry_models._split_rows(spark, FOLDER)
    assert "unicode_host" not in _plan(rows)
    assert rows.count() == registry.QUERIES["dataset_rows"](spark, FOLDER).count()


def test_files_of_stored_scans_do_not_multiply(spark, tmp_path):
    """Forty dates in twenty tasks: some files for each date, not one for each date and task; all rows are there."""
    rows = spark.range(0, 4000, numPartitions=20).select("id", F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("created_date"))
    path = str(tmp_path / "scans")
    store.write_scans(rows, path)
    assert len(glob.glob(f"{path}/*/*.parquet")) <= 80
    assert spark.read.parquet(path).count() == 4000


def test_review_list_is_sorted_over_its_files(spark, tmp_path):
    rows = spark.range(200).select(
        (F.col("id") % 7).cast("int").alias("risk_score"), F.lit("suspicious").alias("verdict"), F.lit("low").alias("confidence"), F.lit("a.org").alias("registered_domain"),
        F.sha2(F.col("id").cast("string"), 256).alias("url_sha256"), F.when(F.col("id") > 5, "http://a.org/").otherwise("").alias("url_canonical"), F.lit("b.org").alias("url_raw"),
    )
    path = str(tmp_path / "list")
    monitor.write_triage(rows, path)
    got = [tuple(r) for f in sorted(glob.glob(f"{path}/*.csv")) for r in spark.read.option("header", True).csv(f).select("risk_score", "url_sha256", "url_defanged").collect()]
    assert len(got) == 200 and got == sorted(got, key=lambda r: (-int(r[0]), r[1]))
    assert {r[2] for r in got} == {r[0] for r in monitor.triage(rows).select("url_defanged").distinct().collect()}
