"""Small helpers that the corpus operators share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.operators.ordering import shared_folder

__all__ = ["SPACE", "SPACES", "WORD", "bound_batches", "release", "shared_folder", "table", "uniform", "words_of"]

#: White space as the contract has it: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns only."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(2**53))


def bound_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Let Arrow batches hold at most ``most`` bytes in this session, so that a Python worker's memory doesn't depend on the length of texts.
    A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name, "64m").rstrip("b").replace("m", "000000").replace("k", "000"))
    if now <= 0 or now > most:
        spark.conf.set(name, str(most))


def release(spark: SparkSession) -> None:
    """Let go of the plans, broadcasts, shuffles and checkpoints of finished steps. Python holds the driver's plans until its own garbage is collected, and
    Spark's cleaner acts only when the driver's is; a chain of many short jobs would otherwise fill the driver's heap with them."""
    gc.collect()
    spark._jvm.System.gc()
