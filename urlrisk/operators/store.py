"""Stored tables: scans, feedback, user lists and the model registry, with their privacy and retention rules."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.functions.privacy import defang, hash_key, redact_query
from urlrisk.functions.text import strip
from urlrisk.operators.canonical import canonicalize_urls
from urlrisk.operators.features import is_multitenant
from urlrisk.operators.ordering import cut_lineage
from urlrisk.sources.catalogs import MULTITENANT_HOSTS

# fixed values
FEEDBACK_LABELS = ("false_positive", "false_negative", "correct")
LIST_KINDS = ("allow", "deny")
RETENTION_DAYS, MIN_DAYS, MAX_DAYS = 30, 1, 365

SCAN_COLUMNS = (
    "id created_at created_date url_sha256 url_stored url_defanged registered_domain verdict risk_score probability "
    "model_version layers_json reasons_json client latency_ms"
).split()


def scan_records(
    scans: DataFrame, created_at: Column | None = None, store: Column | None = None, client: Column | None = None
) -> DataFrame:
    """Scan results as they are stored: no URL unless ``store`` is true, and then without query and fragment."""
    shown = F.when(F.col("url_canonical") != "", F.col("url_canonical")).otherwise(F.col("url_raw"))
    keep = F.lit(False) if store is None else F.coalesce(store, F.lit(False))
    at = F.current_timestamp() if created_at is None else created_at
    return scans.select(
        F.col("scan_id").alias("id"),
        at.alias("created_at"),
        F.to_date(at).alias("created_date"),
        "url_sha256",
        F.when(keep & (shown != ""), redact_query(shown)).alias("url_stored"),
        defang(shown).alias("url_defanged"),
        "registered_domain",
        "verdict",
        "risk_score",
        "probability",
        "model_version",
        F.to_json("layers").alias("layers_json"),
        F.to_json("reasons").alias("reasons_json"),
        (F.lit("api") if client is None else client).alias("client"),
        F.lit(0).alias("latency_ms"),
    )


def write_scans(records: DataFrame, path: str) -> None:
    """Append to the table at ``path``. Rows of a date meet before they are written, so the files grow with the rows and the dates, not with tasks times dates;
    rebalancing cuts a date with many rows into several tasks and packs small dates together."""
    records.hint("rebalance", "created_date").write.mode("append").partitionBy("created_date").parquet(path)


def split_feedback(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback rows to store (status ``new``) and rows to quarantine (label not allowed)."""
    good = F.coalesce(F.col("label").isin(*FEEDBACK_LABELS), F.lit(False))
    accepted = df.filter(good).withColumn("review_status", F.lit("new"))
    return accepted, df.filter(~good)


def write_feedback(df: DataFrame, path: str, quarantine: str) -> None:
    """Append the accepted rows to the table at ``path`` and the others, with the time, to the one at ``quarantine``."""
    accepted, rejected = split_feedback(df)
    rejected.withColumn("rejected_at", F.current_timestamp()).write.mode("append").parquet(quarantine)
    accepted.write.mode("append").parquet(path)


def list_entries(df: DataFrame, multitenant: Sequence[str] = MULTITENANT_HOSTS) -> tuple[DataFrame, DataFrame]:
    """Clean list requests (``user_key, kind, pattern`` and any more columns) into entries and rejects.

    Rejected are kinds other than allow and deny, and allow entries that name a multi-tenant host.
    """
    rest = [k for k in df.columns if k not in ("user_key", "pattern")]
    clean = df.select(
        hash_key(F.col("user_key")).alias("owner_key_hash"), F.lower(strip(F.col("pattern"))).alias("pattern"), *rest
    )
    address = F.when(F.contains("pattern", F.lit("://")), F.col("pattern")).otherwise(
        F.concat(F.lit("https://"), F.col("pattern"))
    )
    clean = canonicalize_urls(clean.withColumn("_address", address), "_address", "_where")
    shared = F.coalesce(is_multitenant("_where", multitenant), F.lit(False))
    reason = F.when(~F.coalesce(F.col("kind").isin(*LIST_KINDS), F.lit(False)), "invalid kind").when(
        (F.col("kind") == "allow") & shared, "multi-tenant host"
    )
    out = clean.withColumn("reject_reason", reason).drop("_address", "_where")
    return out.filter(F.col("reject_reason").isNull()).drop("reject_reason"), out.filter(
        F.col("reject_reason").isNotNull()
    )


_ENTRY_KEY = ["owner_key_hash", "kind", "pattern"]


def add_list_entries(current: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries to append: those not in ``current``, one per (owner, kind, pattern)."""
    return entries.dropDuplicates(_ENTRY_KEY).join(current.select(*_ENTRY_KEY).distinct(), _ENTRY_KEY, "left_anti")


def delete_list_entries(current: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining entries, and the requests with ``existed``. Requests carry ``user_key, kind, pattern``."""
    wanted = requests.select(
        hash_key(F.col("user_key")).alias("owner_key_hash"), "kind", F.lower(strip(F.col("pattern"))).alias("pattern")
    ).distinct()
    found = current.select(*_ENTRY_KEY).distinct().withColumn("_hit", F.lit(True))
    outcome = wanted.join(found, _ENTRY_KEY, "left").select(
        *_ENTRY_KEY, F.coalesce("_hit", F.lit(False)).alias("existed")
    )
    return current.join(wanted, _ENTRY_KEY, "left_anti"), outcome


def read_user_lists(lists: DataFrame, user_key: str | None = None) -> DataFrame:
    """Sorted patterns per owner and kind, one row each; one owner's rows when ``user_key`` is given."""
    if user_key is not None:
        lists = lists.filter(F.col("owner_key_hash") == hash_key(F.lit(user_key)))
    return lists.filter(F.col("kind").isin(*LIST_KINDS)).select(*_ENTRY_KEY).orderBy(*_ENTRY_KEY)


def check_retention(days: int) -> int:
    if not MIN_DAYS <= days <= MAX_DAYS:
        raise ValueError(f"retention must be {MIN_DAYS} to {MAX_DAYS} days, not {days}")
    return days


def retention_split(scans: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Add boolean ``expired``: created before ``as_of`` minus the retention days."""
    check_retention(days)
    cutoff = as_of - F.expr(f"INTERVAL {days} DAYS")
    return scans.withColumn("expired", F.col("created_at") < cutoff)


def cleanup_scan_table(spark, table: str, as_of: datetime, days: int = RETENTION_DAYS) -> int:
    """Drop expired scans from catalog table ``table`` (partitioned by ``created_date``); return their count.

    The date the cutoff falls into is overwritten with the rows to keep, in one commit; only then are the older dates
    dropped as partitions. After a crash in between, the next run finishes the work, and no row to keep is ever missing. A naive ``as_of`` is
    a time of the session's zone, as the stored dates are.
    """
    check_retention(days)
    cutoff_time = as_of - timedelta(days=days)
    if cutoff_time.tzinfo is None:
        cutoff = F.to_timestamp(F.lit(cutoff_time.isoformat(sep=" ")))
    else:
        cutoff = F.timestamp_micros(F.lit(round(cutoff_time.timestamp() * 1_000_000)))
    edge_day = spark.range(1).select(F.to_date(cutoff).alias("d")).first()["d"]
    scans = spark.table(table)
    # the date filters prune partitions before any row is read
    old = scans.filter((F.col("created_date") <= F.lit(edge_day)) & (F.col("created_at") < cutoff))
    dates = {r["created_date"]: r["n"] for r in old.groupBy("created_date").agg(F.count("*").alias("n")).collect()}  # at most one per day
    if edge_day in dates:
        kept = scans.filter((F.col("created_date") == F.lit(edge_day)) & (F.col("created_at") >= cutoff))
        names = [c for c in scans.columns if c != "created_date"]
        cut_lineage(kept.select(*names)).createOrReplaceTempView("_retained_scans")
        listed = ", ".join(f"`{n}`" for n in names)
        spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (created_date = DATE'{edge_day}') ({listed}) SELECT {listed} FROM _retained_scans")
        spark.catalog.dropTempView("_retained_scans")
    for day in sorted(d for d in dates if d != edge_day):
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (created_date = DATE'{day}')")
    return sum(dates.values())


def register_model(df: DataFrame, path: str) -> None:
    """Append rows of version, created_at, git_sha, data_manifest_hash, metrics, thresholds and status."""
    df.write.mode("append").parquet(path)


def active_model(registry: DataFrame) -> DataFrame:
    """The newest active version."""
    rest = [k for k in registry.columns if k != "version"]
    newest = F.max_by(F.struct("version", *rest), F.struct("created_at", "version")).alias("_m")
    return registry.filter(F.col("status") == "active").agg(newest).select("_m.*")
