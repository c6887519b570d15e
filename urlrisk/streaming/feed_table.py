"""A feed table in hash-prefix partitions: a batch rewrites the prefixes it touches and nothing else.

A version is a folder ``v=N`` with one sub-folder for each prefix of ``url_sha256`` that its batch touched. The table is, for each prefix, the newest
committed version that holds it. Writers claim a version number by creating a file that must not exist yet, so two of them never write one folder; the slower one fails and
may start again from what is then committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.streaming.feed import FEED_KEY, feed_entries, feed_versions, merge_entries

#: Hex digits of a prefix.
DIGITS = 2
COLUMNS = [*FEED_KEY, "url", "host", "first_seen", "last_seen", "expires_at", "label"]


def _names(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]


def live_prefixes(spark: SparkSession, folder: str) -> dict[str, int]:
    """The newest committed version of each prefix; at most ``16 ** DIGITS`` of them. Only folder names are listed."""
    out = {}
    for version in feed_versions(spark, folder):
        for name in _names(spark, f"{folder}/v={version}"):
            if name.startswith("prefix="):
                out[name[7:]] = version
    return out


def read_feed_table(spark: SparkSession, folder: str, prefixes: list[str] | None = None) -> DataFrame | None:
    """The table, or some of its prefixes; None if there is nothing of them."""
    live = live_prefixes(spark, folder)
    paths = [f"{folder}/v={v}/prefix={p}" for p, v in sorted(live.items()) if prefixes is None or p in prefixes]
    return spark.read.parquet(*paths).select(*COLUMNS) if paths else None


def _claim(spark: SparkSession, folder: str, version: int) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_claim-{version}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, False).close()


def _drop_old(spark: SparkSession, folder: str, keep: int) -> None:
    """Delete what newer versions replace, but for the last ``keep`` versions, which readers may still hold."""
    live, versions = live_prefixes(spark, folder), feed_versions(spark, folder)
    for version in versions[:-keep]:
        held = [n for n in _names(spark, f"{folder}/v={version}") if n.startswith("prefix=")]
        stale = [n for n in held if live[n[7:]] != version]
        for target in [f"v={version}"] if len(stale) == len(held) else [f"v={version}/{n}" for n in stale]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{target}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def upsert_prefixes(spark: SparkSession, folder: str, ttl_days: int | None = None, keep: int = 2):
    """``foreachBatch`` function that merges each batch into the prefixes it touches. A retried batch changes nothing, as sightings are a minimum and a maximum."""

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        prefix = F.substring("url_sha256", 1, DIGITS)
        entries = feed_entries(batch, "ts", ttl_days)
        entries.persist()
        try:
            touched = [r[0] for r in entries.select(prefix).distinct().collect()]  # at most 16 ** DIGITS
            if not touched:
                return
            versions = feed_versions(session, folder)
            version = versions[-1] + 1 if versions else 0
            _claim(session, folder, version)
            current = read_feed_table(session, folder, touched)
            merged = entries if current is None else merge_entries(current, entries, ttl_days)
            out = merged.select(*COLUMNS).withColumn("prefix", prefix)
            out.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{folder}/v={version}")
        finally:
            entries.unpersist()
        _drop_old(session, folder, keep)

    return write
