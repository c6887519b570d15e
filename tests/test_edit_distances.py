"""Batch edit distances against Spark's own, and scans that leave out what is not asked for."""

import random

from pyspark.sql import functions as F

from urlrisk.functions.distances import edit_distances, nearest_words
from urlrisk.operators.detect import scan_urls
from urlrisk.sources.corpus import spread

WORDS = ["paypal", "google", "ups", "münchen", "amazon"]


def test_distances_are_those_of_spark(spark):
    rng = random.Random(4)
    names = ["", "paypal", "paypa1", "x" * 300, "gоogle", "\U0001f600ups"] + ["".join(rng.choices("paypalgoüe1", k=rng.randint(0, 12))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    want = [list(r) for r in df.orderBy("i").select(*[F.levenshtein("name", F.lit(w)) for w in WORDS]).collect()]
    assert edit_distances(names, WORDS).tolist() == want
    assert edit_distances(names, WORDS, block_cells=40).tolist() == want


def test_nearest_word_of_several_spellings(spark):
    rows = [(0, ["paypa1", "paypal"]), (1, ["gogle"]), (2, ["up"]), (3, []), (4, None), (5, ["zzzzzzzz"])]
    df = spark.createDataFrame(rows, "i int, spellings array<string>").select("i", nearest_words(WORDS, {1: 4, 2: 7})(F.col("spellings")).alias("n"))
    got = {r["i"]: (r["n"]["distance"], r["n"]["nearest"], r["n"]["misspelt"]) for r in df.collect()}
    assert got[0] == (0, "paypal", []) and got[5] == (7, "amazon", [])  # no letter but the z of amazon in common
    assert got[1] == (1, "google", ["google"]) and got[2] == (1, "ups", []) and got[3] == got[4] == (None, None, None)


def test_scan_with_fewer_columns(spark):
    urls = ["http://paypa1.com/login", "http://10.0.0.1/x", "https://example.org/", "", "http://secure-signin.abcdefghijklmnopqrstu.top/verify", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    key = lambda frame: sorted(map(str, frame.collect()))
    for columns in (["verdict"], ["verdict", "risk_score", "registered_domain"], ["reasons"]):
        lean = scan_urls(df, id_cols=["url"], columns=columns)
        assert lean.columns == ["url", *[c for c in scan_urls(df, id_cols=["url"]).columns if c in columns]]
        assert key(lean) == key(scan_urls(df, id_cols=["url"]).select(*lean.columns))
    plan = scan_urls(df, id_cols=["url"], columns=["verdict"])._jdf.queryExecution().optimizedPlan().toString()
    assert "typosquat_brand" not in plan and "vowel_ratio" not in plan


def test_tasks_grow_with_the_rows(spark):
    df = spark.range(1000).coalesce(1)
    assert spread(df, 50).rdd.getNumPartitions() == 20
    assert spread(df, 5000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(df, 50).count() == 1000
