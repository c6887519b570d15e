"""Shape of the physical plans: no shuffle while scanning, pruned columns, filters at the scan."""

import os
import re

import pytest
from pyspark.sql import functions as F

from urlrisk.operators.detect import scan_urls
from urlrisk.operators.features import url_features

PAGES = "/root/testdata/sf0.001/pages.parquet"

pytestmark = pytest.mark.skipif(not os.path.exists(PAGES), reason="test data not present")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_one_stage_and_reads_two_columns(spark):
    text = plan(scan_urls(spark.read.parquet(PAGES).select("page_id", "url"), id_cols=["page_id"]))
    assert "Exchange" not in text and "Join" not in text
    assert "html" not in text.split("ReadSchema")[1]


def test_input_filters_reach_the_scan(spark):
    df = url_features(spark.read.parquet(PAGES).select("page_id", "url")).filter("page_id < 10")
    assert "LessThan(page_id,10)" in plan(df)


def test_filters_on_results_do_not_copy_the_work(spark):
    df = url_features(spark.read.parquet(PAGES).select("page_id", "url"))
    plain, filtered = len(plan(df)), len(plan(df.filter(F.col("features.n_dots") > 3)))
    assert filtered < 1.2 * plain


def test_lists_are_broadcast_when_small(spark):
    deny = spark.read.parquet(PAGES).select(F.col("url").alias("pattern"))
    text = plan(scan_urls(spark.read.parquet(PAGES).select("page_id", "url"), denylist=deny, id_cols=["page_id"]))
    assert text.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in text


def test_large_lists_do_not_repeat_the_work(spark, tmp_path):
    """With lists too large to be broadcast, canonical forms are worked out once and read back, and rows without a URL are spread."""
    spark.range(40).selectExpr("concat('http://a', id % 7, '.org/', id) url", "concat('k', id % 2) owner_key_hash").union(
        spark.sql("select ' ' url, 'k0' owner_key_hash")
    ).write.parquet(f"{tmp_path}/urls")
    spark.sql("select 'k1' owner_key_hash, 'deny' kind, concat('a', id, '.org') pattern from range(3)").write.parquet(f"{tmp_path}/lists")
    spark.sql("select concat('http://a5.org/', id) pattern from range(40)").write.parquet(f"{tmp_path}/feed")
    urls, lists, feed = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("urls", "lists", "feed"))
    scan = lambda: scan_urls(urls, user_lists=lists, denylist=feed, id_cols=["url", "owner_key_hash"])
    small = sorted(map(str, scan().collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = scan()
        text = plan(large)
        assert sorted(map(str, large.collect())) == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "unicode_host" not in text and "SortMergeJoin" in text
    assert "_salt" not in text


def test_generated_code_of_a_scan_is_compiled(spark):
    """The JVM leaves methods of more than 8000 bytes to its interpreter."""
    df = scan_urls(spark.read.parquet(PAGES).select("page_id", "url"), id_cols=["page_id"])
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package")
    code = debug.codegenString(df._jdf.queryExecution().executedPlan())
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000
    # keywords and reasons are plain expressions, not loops over arrays of each row
    spark.conf.set("spark.sql.maxPlanStringLength", "100000000")
    try:
        plan_text = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxPlanStringLength")
    assert plan_text.count("lambdafunction") < 20
