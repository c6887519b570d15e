"""File sources that have already landed: URL feeds, ranked domains, and manifests over files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.functions.text import strip


class TamperedArtifactError(RuntimeError):
    """An artifact does not have the hash its manifest names."""


def read_url_feed(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line; blank lines are dropped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("url")).filter(F.col("url") != "")


def read_ranked_domains(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("rank int, domain string").csv(path)


def file_hashes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file`` (base name), ``path`` and ``sha256`` of every file."""
    return (
        spark.read.format("binaryFile")
        .load(list(paths) if not isinstance(paths, str) else paths)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", F.sha2("content", 256).alias("sha256"))
    )


def _place(path: Column) -> Column:
    """A path without scheme and authority, as readers spell them differently."""
    return F.regexp_replace(path, r"^[A-Za-z0-9+.-]+:(?://[^/]*)?", "")


def source_manifest(spark: SparkSession, sources: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Hash and row count of text sources. ``sources`` maps a name to ``path``, ``license`` and ``source_url``. Sources may share a file name, not a path."""
    info = spark.createDataFrame(
        [(n, s["path"], s["path"].rsplit("/", 1)[-1], s.get("license"), s.get("source_url")) for n, s in sources.items()],
        "name string, _at string, file string, license string, source_url string",
    ).withColumn("_at", _place(F.col("_at")))
    paths = [s["path"] for s in sources.values()]
    lines = (
        spark.read.text(paths)
        .select(_place(F.col("_metadata.file_path")).alias("_at"), strip(F.col("value")).alias("line"))
        .groupBy("_at")
        .agg(F.count_if(F.col("line") != "").alias("rows"))
    )
    hashes = file_hashes(spark, paths).select(_place(F.col("path")).alias("_at"), "sha256")
    return info.join(hashes, "_at").join(lines, "_at", "left").select(
        "name", "file", "sha256", F.coalesce("rows", F.lit(0)).alias("rows"), "license", "source_url"
    )


def artifact_manifest(spark: SparkSession, folder: str, out: str) -> None:
    """Hash every file below ``folder`` and write the table to ``out`` (outside ``folder``)."""
    hashes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.lit(folder.rstrip("/") + "/")
    name = F.element_at(F.split("path", root), -1)
    hashes.select(name.alias("file"), F.sha2("content", 256).alias("sha256")).write.mode("overwrite").json(out)


def verify_artifacts(spark: SparkSession, folder: str, manifest: str) -> int:
    """Compare the files with the manifest; raise on a mismatch, skip files that are absent; return the count."""
    expected = spark.read.schema("file string, sha256 string").json(manifest).withColumnRenamed("sha256", "expected")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.lit(folder.rstrip("/") + "/")
    actual = found.select(F.element_at(F.split("path", root), -1).alias("file"), F.sha2("content", 256).alias("sha256"))
    joined = actual.join(expected, "file")
    bad = joined.filter(F.col("sha256") != F.col("expected")).limit(1).collect()
    if bad:
        raise TamperedArtifactError(
            f"Integrity check failed for {bad[0]['file']}: expected {bad[0]['expected']}, got {bad[0]['sha256']}"
        )
    return joined.count()
