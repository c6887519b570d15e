"""Windowed verdict counts of a stream, with a table of the rows that came too late.

Spark's own watermark drops late rows unseen. Here each micro-batch is split by the watermark that the batches before it reached: rows of windows that are already
closed go to a side table, the others are counted. Everything a batch writes lies in folders of its id, which a retry overwrites, so each row counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = "1 hour"
LATENESS = "10 minutes"


def _mark(spark: SparkSession, folder: str, before: Column) -> Column:
    """The largest event time of the batches before one, as a literal; null if there were none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/marks")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return F.lit(None).cast("timestamp")
    marks = spark.read.schema("batch long, latest timestamp").parquet(f"{folder}/marks")
    latest = marks.where(before).agg(F.unix_micros(F.max("latest")).alias("m")).first()["m"]  # one row per batch
    return F.lit(None).cast("timestamp") if latest is None else F.timestamp_micros(F.lit(latest))


def window_writer(spark: SparkSession, folder: str, ts: str = "ts", by: str = "verdict", width: str = WIDTH, lateness: str = LATENESS):
    """``foreachBatch`` function that keeps counts, late rows and event times below ``folder``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        mark = _mark(session, folder, F.col("batch") < batch_id) - F.expr(f"INTERVAL {lateness}")
        rows = batch.withColumn("_w", F.window(ts, width)).withColumn("_late", F.coalesce(F.col("_w.end") <= mark, F.lit(False)))
        rows.persist()
        try:
            out = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
            out(rows.where("not _late").groupBy(F.col("_w.start").alias("window_start"), by).agg(F.count("*").alias("n")), "counts")
            out(rows.where("_late").drop("_w", "_late"), "late")
            out(rows.agg(F.max(ts).alias("latest")), "marks")
        finally:
            rows.unpersist()

    return write


def closed_windows(spark: SparkSession, folder: str, by: str = "verdict", width: str = WIDTH, lateness: str = LATENESS) -> DataFrame:
    """(window_start, by, n) of the windows that no row can reach any more."""
    mark = _mark(spark, folder, F.lit(True)) - F.expr(f"INTERVAL {lateness}")
    counts = spark.read.parquet(f"{folder}/counts").where(F.col("window_start") + F.expr(f"INTERVAL {width}") <= mark)
    return counts.groupBy("window_start", by).agg(F.sum("n").alias("n"))


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/late").drop("batch")
