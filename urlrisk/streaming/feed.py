"""Threat-feed ingest: a table of feed entries, one row per source and URL, kept current from a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.functions.privacy import refang, sha256_url
from urlrisk.functions.text import strip
from urlrisk.operators.canonical import canonicalize_urls

FEED_KEY = ["source", "url_sha256"]


def feed_entries(df: DataFrame, ts: str = "ts", ttl_days: int | None = None) -> DataFrame:
    """Entries of a feed extract (``source, url`` and a timestamp): first and last sighting per URL.

    Plain aggregates, combined before the shuffle, so many sightings of one URL cost little. Works in batch and
    in a streaming query in update mode.
    """
    clean = canonicalize_urls(df.withColumn("_feed_url", refang(strip(F.col("url")))).drop("url"), "_feed_url", "parsed")
    p = F.col("parsed")
    rows = clean.filter(p["is_valid"]).select(
        "source", sha256_url(p["canonical"]).alias("url_sha256"), p["canonical"].alias("url"), p["host"].alias("host"), ts
    )
    grouped = rows.groupBy(*FEED_KEY).agg(
        F.first("url").alias("url"), F.first("host").alias("host"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen")
    )
    return with_expiry(grouped, ttl_days)


def with_expiry(entries: DataFrame, ttl_days: int | None) -> DataFrame:
    expires = (
        F.lit(None).cast("timestamp") if ttl_days is None else F.col("last_seen") + F.expr(f"INTERVAL {ttl_days} DAYS")
    )
    return entries.withColumns({"expires_at": expires, "label": F.lit("malicious")})


def merge_entries(current: DataFrame, new: DataFrame, ttl_days: int | None = None) -> DataFrame:
    """Union of both tables with the earliest first and the latest last sighting of each URL."""
    cols = [*FEED_KEY, "url", "host", "first_seen", "last_seen"]
    both = current.select(*cols).unionByName(new.select(*cols))
    merged = both.groupBy(*FEED_KEY).agg(
        F.first("url").alias("url"),
        F.first("host").alias("host"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    return with_expiry(merged, ttl_days)


def active_patterns(entries: DataFrame, as_of: Column) -> DataFrame:
    """Unexpired feed URLs as a deny table for the scan."""
    live = F.col("expires_at").isNull() | (F.col("expires_at") > as_of)
    return entries.filter(live).select(F.col("url").alias("pattern")).distinct()


def feed_versions(spark: SparkSession, folder: str) -> list[int]:
    """Committed versions of a feed table, oldest first. Only folder names are listed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    found = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()]
    done = lambda v: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v={v}/_SUCCESS"))
    return sorted(v for v in found if done(v))


def read_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The newest committed version of the feed table."""
    return spark.read.parquet(f"{folder}/v={feed_versions(spark, folder)[-1]}")


def upsert_writer(spark: SparkSession, folder: str, ttl_days: int | None = None, keep: int = 2):
    """``foreachBatch`` function that keeps the feed table below ``folder``.

    Each batch is merged with the newest committed version into the next one, whatever its batch id, so a new query or a new
    checkpoint goes on from the stored table. First and last sightings are a minimum and a maximum: a batch that is
    retried changes nothing. A version counts once Spark has committed it; the newest ``keep`` stay for readers.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        entries = feed_entries(batch, "ts", ttl_days)
        versions = feed_versions(session, folder)
        if versions:
            entries = merge_entries(session.read.parquet(f"{folder}/v={versions[-1]}"), entries, ttl_days)
        entries.write.mode("overwrite").parquet(f"{folder}/v={versions[-1] + 1 if versions else 0}")
        for old in versions[: -(keep - 1)] if keep > 1 else versions:
            path = session._jvm.org.apache.hadoop.fs.Path(f"{folder}/v={old}")
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)

    return write
