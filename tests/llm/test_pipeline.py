"""The pipeline on a small folder with planted cases, and the registered SQL of the corpus queries."""

import os
import random

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from urlrisk.llm import queries

FOLDER = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: " ".join("the of and in".split()[rng.randrange(4)] + f" an{rng.choice('bcdf')}er{rng.randrange(900)}" for _ in range(n))
    leak = text(30)
    rows = [(i, text(60), "en", f"s{i % 3}", 0) for i in range(60)]
    copied = rows[3][1]
    rows += [
        (100, copied, "en", "s0", 0), (101, copied + " tail", "en", "s1", 0), (102, text(20) + " " + leak, "en", "s0", 0),
        (103, text(30) + " mail a.b@c.org now", "en", "s2", 0), (104, None, "en", "s0", 0), (105, "", None, None, 0),
        (None, text(9) + " mail d.e@f.org now", "en", "s1", 0),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append({r["doc_id"]: r for r in docs.collect()})
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    clean = set(range(60))
    assert set(seen[0]) == clean | {100, 101, 102, 103, None}
    assert set(seen[1]) == clean | {102, 103, None}
    assert set(seen[2]) == set(seen[3]) == set(seen[4]) == clean | {103, None}
    assert seen[3][None]["text"].endswith("mail [EMAIL] now")
    assert seen[3][103]["text"].endswith("mail [EMAIL] now") and seen[3][103]["n_chars"] == len(seen[3][103]["text"])
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, seen[4].values()))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")
def test_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} >= {f"op{i}" for i in range(1, 11)} | {"pipeline"}
    assert set(queries.QUERIES) <= set(contract.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, name):
    from check_oracle import compare, duck

    ok, info = compare(spark, duck(FOLDER), name, FOLDER)
    assert ok, info
