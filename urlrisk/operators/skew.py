"""Lookup joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# a lookup side is broadcast only when a count proves it has at most this many rows and bytes (as JSON text)
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20
HOT_SHARE = 0.002  # a key is hot when it holds at least this share of the rows: at most 500 such keys exist
HOT_SAMPLE = 0.01
HOT_SALTS = 1 << 20  # more than a cluster has tasks


def broadcast_by_statistics(df: DataFrame) -> bool:
    """Whether the optimizer's size of ``df`` is within Spark's broadcast threshold. Runs no job; unknown sizes count as large."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 <= int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes; the count stops just past the row bound."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    seen = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(size).alias("b")).first()
    return seen["n"] <= max_rows and (seen["b"] or 0) <= max_bytes


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its row count is within the bound, else unchanged."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    max_rows: int = BROADCAST_ROWS,
    sample: float = HOT_SAMPLE,
) -> DataFrame:
    """Left join ``rows`` with ``table``, which is unique on ``keys`` (same names on both sides).

    A table of proven small size is broadcast. A larger one is shuffled, except for the hot keys found in a
    sample of the rows: their few table entries are broadcast, and the rows that hold them are spread over
    salted null keys instead of meeting in one task. The sample steers the layout only; the result is the same
    whichever keys it finds. Streaming rows skip the sampling.
    """
    keys = list(keys)
    values = [col for col in table.columns if col not in keys]
    if fits_broadcast(table, max_rows):
        return rows.join(F.broadcast(table), keys, "left")
    if rows.isStreaming:
        return rows.join(table, keys, "left")
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    counts = rows.select(*keys).sample(sample, seed=1).filter(present).groupBy(*keys).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot_keys = counts.filter(F.col("count") >= max(2.0, HOT_SHARE * total)).select(*keys)
    hot = hot_keys.orderBy(*keys).collect()  # at most 1 / HOT_SHARE
    if not hot:
        return rows.join(table, keys, "left")
    hot_df = rows.sparkSession.createDataFrame(hot, hot_keys.schema)
    hot_table = table.join(F.broadcast(hot_df), keys, "left_semi").select(
        *keys, F.struct(*values).alias("_hot_values")
    )
    hot_lookup = hot_df.join(hot_table, keys, "left").select(*keys, "_hot_values", F.lit(True).alias("_is_hot"))
    tagged = rows.join(F.broadcast(hot_lookup), keys, "left")
    # hot rows already have their values: give them null keys and spread them by salt
    spread = F.when(F.col("_is_hot") | ~present, F.pmod(F.monotonically_increasing_id(), F.lit(HOT_SALTS)) + 1)
    tagged = tagged.withColumn("_salt", F.coalesce(spread, F.lit(0)))
    cold_keys = {f"_cold_{k}": F.when(F.col("_is_hot").isNull(), F.col(k)) for k in keys}
    tagged = tagged.withColumns(cold_keys)
    cold = table.select(
        *[F.col(k).alias(f"_cold_{k}") for k in keys], F.lit(0).cast("long").alias("_salt"), F.struct(*values).alias("_cold_values")
    )
    joined = tagged.join(cold, [*cold_keys, "_salt"], "left")
    pick = F.when(F.col("_is_hot"), F.col("_hot_values")).otherwise(F.col("_cold_values"))
    out = joined.withColumn("_values", pick)
    return out.select(*keys, *[r for r in rows.columns if r not in keys], *[F.col(f"_values.{v}").alias(v) for v in values])
