"""Ranks and running sums over a global order, without pulling all rows into one task."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urlrisk.operators.skew import bounded_broadcast


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the folder the session names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; a cluster must name a shared one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, which all executors reach."""
    cut_lineage(spark.range(0))  # sets the checkpoint folder where the session has none
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as parquet next to the checkpoints and read again, for results of a long plan that several passes read: each pass reads only its columns."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def global_running(
    df: DataFrame,
    order_cols: Sequence[str],
    sums: Sequence[str] = (),
    group_cols: Sequence[str] = (),
    lead_cols: Sequence[str] = (),
) -> DataFrame:
    """Add ``ordinal`` (1-based), ``run_<s>`` and ``all_<s>`` per sum column, ``n_all`` and ``next``.

    The order is ascending on ``order_cols``, which must be unique within a group. Rows are range-partitioned,
    each partition is summed, and a table with one row per partition (and group) carries the offsets. Partition
    ids must not change between the passes, so the tagged rows are checkpointed.
    """
    groups, order = list(group_cols), list(order_cols)
    tagged = cut_lineage(df.repartitionByRange(*groups, *order).withColumn("_pid", F.spark_partition_id()))
    aggs = [F.count("*").alias("_rows")] + [F.sum(s).alias(f"_t_{s}") for s in sums]
    if lead_cols:
        aggs.append(F.min_by(F.struct(*lead_cols), F.struct(*order)).alias("_first"))
    parts = tagged.groupBy(*groups, "_pid").agg(*aggs)
    # one row per partition and group from here on
    by_pid = Window.partitionBy(*groups).orderBy("_pid")
    before = by_pid.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = parts.select(
        *groups,
        "_pid",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_o_rows"),
        F.sum("_rows").over(whole).alias("n_all"),
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(whole).alias(f"all_{s}") for s in sums],
        *([F.lead("_first").over(by_pid).alias("_next_first")] if lead_cols else []),
    )
    joined = tagged.join(bounded_broadcast(offsets), [*groups, "_pid"])
    inside = Window.partitionBy(*groups, "_pid").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = joined.select(
        *df.columns,
        (F.col("_o_rows") + F.row_number().over(inside)).alias("ordinal"),
        "n_all",
        *[(F.col(f"_o_{s}") + F.sum(s).over(running)).alias(f"run_{s}") for s in sums],
        *[f"all_{s}" for s in sums],
        *(
            [F.coalesce(F.lead(F.struct(*lead_cols)).over(inside), F.col("_next_first")).alias("next")]
            if lead_cols
            else []
        ),
    )
    return out


def global_rank(df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Add ``ordinal`` and ``n_all`` (rows in the group)."""
    return global_running(df, order_cols, (), group_cols)
