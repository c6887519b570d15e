"""Components of small tables: right roots, few jobs, and the session as it was."""

from urlrisk.llm import components

HELD = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")


def test_small_components_run_few_jobs(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(10, 12), (11, 12), (11, 11)], "a long, b long")
    jobs = spark._jsc.sc().dagScheduler().numTotalJobs
    before, held = jobs(), [spark.conf.get(k) for k in HELD]
    got = components.connected_components(edges)
    ran = jobs() - before
    assert {r["node"]: r["root"] for r in got.collect()} == {**dict.fromkeys(range(7), 0), **dict.fromkeys((10, 11, 12), 10)}
    assert [spark.conf.get(k) for k in HELD] == held
    assert ran <= 16, ran
