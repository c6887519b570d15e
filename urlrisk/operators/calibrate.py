"""Isotonic calibration of scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.operators.evaluate import evaluate_predictions, score_counts
from urlrisk.operators.ordering import cut_lineage, global_running
from urlrisk.operators.skew import lookup_join

MAX_KNOTS = 10_000
#: Blocks of a task while fitting.
PER_TASK = 50_000


@dataclass(frozen=True)
class Calibrator:
    """Breakpoints of a non-decreasing piecewise-linear map from [0, 1] to [0, 1]."""

    x: tuple[float, ...] = (0.0, 1.0)
    y: tuple[float, ...] = (0.0, 1.0)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, round(a, 6), round(b, 6)) for i, (a, b) in enumerate(zip(self.x, self.y))]
        return spark.createDataFrame(rows, "ordinal int, x double, y double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").json(path)

    def apply(self, df: DataFrame, score: str = "score", out: str = "calibrated") -> DataFrame:
        """Interpolate between the breakpoints, flat outside them. The lookup is a JVM binary search."""
        knots: dict[float, float] = dict(zip(self.x, self.y))
        xs, ys = list(knots), list(knots.values())
        # least and greatest skip nulls, so a missing score needs its own branch
        value = F.when(F.col(score).isNotNull(), F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)))
        df = df.withColumn("_value", value)
        finder = Bucketizer(
            splits=[float("-inf"), *xs, float("inf")], inputCol="_value", outputCol="_slot", handleInvalid="keep"
        )
        df = finder.transform(df)
        slot = F.col("_slot").cast("int")
        at = lambda seq, i: F.element_at(F.array(*[F.lit(v) for v in seq]), i)
        x0, y0 = at(xs, slot), at(ys, slot)
        x1, y1 = at(xs, slot + 1), at(ys, slot + 1)
        result = (
            F.when(slot == 0, ys[0])
            .when(slot >= len(xs), ys[-1])
            .otherwise((y1 - y0) / (x1 - x0) * (F.col("_value") - x0) + y0)
        )
        clipped = F.when(F.col("_value").isNotNull(), F.least(F.greatest(result, F.lit(0.0)), F.lit(1.0)))
        return df.withColumn(out, clipped).drop("_slot", "_value")


def load_calibrator(spark: SparkSession, path: str) -> Calibrator:
    rows = spark.read.schema("ordinal int, x double, y double").json(path).orderBy("ordinal").collect()
    return Calibrator(tuple(r["x"] for r in rows), tuple(r["y"] for r in rows))


def _pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pool adjacent violators of one sorted partition; a stack holds the blocks so far. Counts are whole numbers, so rates compare exactly."""
    stack: list[list] = []
    for batch in batches:
        for block in batch[["lo", "hi", "pos", "n"]].itertuples(index=False):
            lo, hi, pos, n = block
            while stack and stack[-1][2] * n >= pos * stack[-1][3]:
                before = stack.pop()
                lo, pos, n = before[0], pos + before[2], n + before[3]
            stack.append([lo, hi, int(pos), int(n)])
    yield pd.DataFrame(stack, columns=["lo", "hi", "pos", "n"]).astype({"lo": float, "hi": float, "pos": "int64", "n": "int64"})


def isotonic_blocks(df: DataFrame, label: str = "label", score: str = "score", per_task: int = PER_TASK) -> DataFrame:
    """(lo, hi, pos, n): runs of scores that the isotonic fit gives one rate.

    Every range partition of about ``per_task`` blocks pools its own violators. Those that are left lie across partition bounds; the next round cuts the blocks at
    other bounds, until a look at each block's successor finds none. Violators may be pooled in any order, so the result is the one of a single pass.
    """
    counts = score_counts(df, label, score)
    blocks = cut_lineage(counts.select(F.col("score").alias("lo"), F.col("score").alias("hi"), "pos", (F.col("pos") + F.col("neg")).alias("n")))
    last = 0
    while True:
        tasks = -(-blocks.count() // per_task)
        tasks = max(1, tasks - 1 if tasks == last else tasks)
        spread = blocks.repartitionByRange(tasks, "lo").sortWithinPartitions("lo")
        blocks = cut_lineage(spread.mapInPandas(_pool, "lo double, hi double, pos long, n long"))
        if tasks == 1:
            return blocks
        after = global_running(blocks, ["lo"], lead_cols=["pos", "n"])
        if not after.where(F.col("pos") * F.col("next.n") >= F.col("next.pos") * F.col("n")).limit(1).count():
            return blocks
        last = tasks


def isotonic_knots(df: DataFrame, label: str = "label", score: str = "score", per_task: int = PER_TASK) -> DataFrame:
    """(x, y): the ends of the blocks, extended to 0 and 1."""
    blocks = isotonic_blocks(df, label, score, per_task).withColumn("y", F.col("pos") / F.col("n"))
    knots = blocks.select("y", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x")).select("x", "y")
    ends = blocks.agg(F.min("lo").alias("a"), F.min_by("y", "lo").alias("ya"), F.max("hi").alias("b"), F.max_by("y", "hi").alias("yb"))
    edge = lambda x, y, lacks: ends.where(lacks).select(F.lit(x).alias("x"), F.col(y).alias("y"))
    return cut_lineage(knots.unionByName(edge(0.0, "ya", "a > 0")).unionByName(edge(1.0, "yb", "b < 1")))


def apply_knots(df: DataFrame, knots: DataFrame, score: str = "score", out: str = "calibrated") -> DataFrame:
    """Interpolate between knots (x, y) that reach from 0 to 1, however many there are; null for a null score.

    The distinct scores are merged with the knots in one global order, where a running count gives each its interval; intervals and results are joined back.
    """
    value = F.when(F.col(score).isNotNull(), F.least(F.greatest(F.col(score).cast("double"), F.lit(0.0)), F.lit(1.0)))
    rows = df.withColumn("_value", value)
    asked = rows.where("_value is not null").select(F.col("_value").alias("v"), F.lit(1).alias("asked")).distinct()
    merged = global_running(knots.select(F.col("x").alias("v"), F.lit(0).alias("asked")).unionByName(asked).withColumn("knot", 1 - F.col("asked")), ["v", "asked"], ["knot"])
    slots = merged.where("asked = 1").select("v", F.col("run_knot").alias("slot"))
    ranges = global_running(knots, ["x"], lead_cols=["x", "y"]).select(F.col("ordinal").alias("slot"), F.struct("x", "y", "next").alias("_k"))
    k = F.col("_k")
    inside = (k["next"]["y"] - k["y"]) / (k["next"]["x"] - k["x"]) * (F.col("v") - k["x"]) + k["y"]
    fit = F.least(F.greatest(F.when(k["next"].isNull(), k["y"]).otherwise(inside), F.lit(0.0)), F.lit(1.0))
    fitted = cut_lineage(lookup_join(slots, ranges, ["slot"]).select(F.col("v").alias("_value"), fit.alias(out)))
    return lookup_join(rows.drop(out), fitted, ["_value"]).drop("_value")


def fit_isotonic(df: DataFrame, label: str = "label", score: str = "score") -> Calibrator:
    """The fit as a :class:`Calibrator`, for scorers that carry their map along: at most ``MAX_KNOTS`` knots, which a count checks."""
    knots = isotonic_knots(df, label, score)
    rows = knots.orderBy("x").limit(MAX_KNOTS + 1).collect()
    if len(rows) > MAX_KNOTS:
        raise ValueError(f"the fit has more than {MAX_KNOTS} knots; use isotonic_knots and apply_knots")
    return Calibrator(tuple(r["x"] for r in rows), tuple(r["y"] for r in rows))


def compare_calibration(
    df: DataFrame, calibrator: Calibrator | DataFrame, label: str = "label", score: str = "score"
) -> DataFrame:
    """Report before and after calibration (a calibrator, or knots), one row per ``variant``."""
    if isinstance(calibrator, Calibrator):
        both = calibrator.apply(df, score, "_calibrated")
    else:
        both = apply_knots(df, calibrator, score, "_calibrated")
    long = both.select(
        label,
        F.explode(
            F.array(
                F.struct(F.lit("raw").alias("variant"), F.col(score).alias("_s")),
                F.struct(F.lit("calibrated").alias("variant"), F.col("_calibrated").alias("_s")),
            )
        ).alias("_v"),
    ).select(label, "_v.variant", "_v._s")
    return evaluate_predictions(long, label, "_s", ["variant"])
