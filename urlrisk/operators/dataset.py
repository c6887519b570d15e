"""Labelled URL dataset: rows, validation, grouped temporal splits and the split manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.functions.privacy import sha256_url
from urlrisk.operators.canonical import canonicalize_urls
from urlrisk.operators.ordering import global_rank
from urlrisk.operators.skew import lookup_join

REQUIRED_COLUMNS = (
    "url_raw url label source first_seen host registered_domain tld target_brand split url_sha256"
).split()
SPLITS = ("train", "val", "calib", "test")
TRAIN_SHARE, VAL_SHARE, CALIB_SHARE = 0.70, 0.10, 0.10  # fixed values


def dataset_rows(df: DataFrame, raw_col: str = "url_raw") -> DataFrame:
    """Rows of the unified dataset from ``url_raw, label, source`` and optional ``first_seen``, ``target_brand``
    and ``split``. URLs that cannot be canonicalized are left out."""
    defaults = {
        "first_seen": F.to_date(F.lit("2026-01-01")),
        "target_brand": F.lit(None).cast("string"),
        "split": F.lit("train"),
    }
    df = df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})
    df = canonicalize_urls(df, raw_col)
    p = F.col("parsed")
    values = {
        "url_raw": F.col(raw_col),
        "url": p["canonical"],
        "label": F.col("label").cast("tinyint"),
        "host": p["host"],
        "registered_domain": p["registered_domain"],
        "tld": p["suffix"],
        "url_sha256": sha256_url(p["canonical"]),
    }
    return df.filter(p["is_valid"]).select(*[values.get(k, F.col(k)).alias(k) for k in REQUIRED_COLUMNS])


def write_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("source").parquet(path)


def distinct_labels(df: DataFrame) -> DataFrame:
    return df.select("label").distinct()


def validate_dataset(df: DataFrame) -> bool:
    """Raise ``ValueError`` for a missing column or a label other than 0 and 1."""
    for name in REQUIRED_COLUMNS:
        if name not in df.columns:
            raise ValueError(f"Missing required column in dataset: {name}")
    bad = df.filter(F.col("label").isNull() | ~F.col("label").isin(0, 1)).select("label").limit(1).collect()
    if bad:
        raise ValueError(f"Invalid label value found: {bad[0][0]}. Expected only 0 or 1.")
    return True


def sort_by_time(df: DataFrame) -> DataFrame:
    """Stable order on (first_seen, url_sha256); the row position breaks ties, so copies of one URL spread too."""
    return (
        df.withColumn("_position", F.monotonically_increasing_id())
        .orderBy("first_seen", "url_sha256", "_position")
        .drop("_position")
    )


def domain_first_seen(df: DataFrame) -> DataFrame:
    """Earliest date and number of rows of each registered domain."""
    return df.groupBy("registered_domain").agg(F.min("first_seen").alias("first_seen"), F.count("*").alias("n_urls"))


def domain_splits(
    df: DataFrame, train: float = TRAIN_SHARE, val: float = VAL_SHARE, calib: float = CALIB_SHARE
) -> DataFrame:
    """Split of every registered domain: domains ranked by (first_seen, name) and cut by share."""
    ranked = global_rank(domain_first_seen(df), ["first_seen", "registered_domain"])
    cut = lambda share: F.floor(F.col("n_all") * F.lit(share))
    place = F.col("ordinal") - 1
    split = (
        F.when(place < cut(train), "train")
        .when(place < cut(train) + cut(val), "val")
        .when(place < cut(train) + cut(val) + cut(calib), "calib")
        .otherwise("test")
    )
    return ranked.select("registered_domain", "first_seen", "n_urls", split.alias("split"))


def assign_splits(
    df: DataFrame, train: float = TRAIN_SHARE, val: float = VAL_SHARE, calib: float = CALIB_SHARE
) -> DataFrame:
    """Set ``split`` on every row; a domain is never in two splits."""
    table = domain_splits(df, train, val, calib).select("registered_domain", "split")
    return lookup_join(df.drop("split"), table, ["registered_domain"])


def split_assignments(df: DataFrame) -> DataFrame:
    """Manifest body: one row per distinct URL hash."""
    return df.select("url_sha256", "split").distinct()


def split_counts(df: DataFrame) -> DataFrame:
    """Rows, distinct URLs and domains per split (rows count copies, distinct URLs do not)."""
    return df.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("url_sha256").alias("n_urls"),
        F.countDistinct("registered_domain").alias("n_domains"),
    )


def manifest_hash(assignments: DataFrame) -> DataFrame:
    """One row with ``total_urls`` and ``manifest_hash``, the same for any row order or partitioning.

    The hash is a multiset hash: SHA-256 of every (url_sha256, split) pair, cut into four 60-bit words that are
    summed (38 digits hold 10^19 rows), then SHA-256 over the sums. It is a plain aggregate, so no task ever holds the sorted assignments.
    """
    digest = F.sha2(F.concat_ws(":", "url_sha256", "split"), 256)
    words = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(28,0)") for i in range(4)]
    sums = assignments.agg(
        F.count("*").alias("total_urls"), *[F.coalesce(F.sum(w), F.lit(0)).alias(f"w{i}") for i, w in enumerate(words)]
    )
    text = F.concat_ws(":", F.col("total_urls").cast("string"), *[F.col(f"w{i}").cast("string") for i in range(4)])
    return sums.select("total_urls", F.sha2(text, 256).alias("manifest_hash"))


def write_manifest(df: DataFrame, path: str) -> None:
    """Assignments as parquet, summary as JSON, under ``path``."""
    assignments = split_assignments(df)
    assignments.write.mode("overwrite").parquet(f"{path}/assignments")
    counts = split_counts(df).select("split", "n_rows", "n_domains")
    manifest_hash(assignments).write.mode("overwrite").json(f"{path}/summary")
    counts.write.mode("overwrite").json(f"{path}/counts")


def split_overlap(df: DataFrame) -> DataFrame:
    """Domains that appear in more than one split; empty for a sound split."""
    return (
        df.groupBy("registered_domain")
        .agg(F.countDistinct("split").alias("n_splits"))
        .filter(F.col("n_splits") > 1)
    )


def dedupe_urls(df: DataFrame) -> DataFrame:
    """One row per canonical URL: the earliest by (first_seen, url_raw)."""
    rest = [k for k in df.columns if k != "url_sha256"]
    best = F.min_by(F.struct(*rest), F.struct("first_seen", "url_raw", "source", "label")).alias("_best")
    return df.groupBy("url_sha256").agg(best).select("url_sha256", "_best.*")
