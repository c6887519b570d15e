"""Combining two scorers: weighted blend or logistic stacking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.operators.evaluate import average_precision_expr, curve_points

# fixed values
WEIGHT_STEPS = 21
LOGIT_LIMIT = 20.0
MIN_WEIGHT_SUM = 1e-6


@dataclass(frozen=True)
class Ensemble:
    weight_tabular: float = 0.5
    weight_text: float = 0.5
    bias: float = 0.0
    mode: str = "blend"

    def combine(self, tabular: Column, text: Column) -> Column:
        """Probability of the combined model, in [0, 1]."""
        linear = self.weight_tabular * tabular + self.weight_text * text
        if self.mode == "stack":
            logit = F.least(F.greatest(linear + self.bias, F.lit(-LOGIT_LIMIT)), F.lit(LOGIT_LIMIT))
            value = 1 / (1 + F.exp(-logit))
        else:
            value = linear / max(self.weight_tabular + self.weight_text, MIN_WEIGHT_SUM)
        return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))

    def table(self, spark: SparkSession) -> DataFrame:
        row = (self.mode, round(self.weight_tabular, 6), round(self.weight_text, 6), round(self.bias, 6))
        return spark.createDataFrame([row], "mode string, weight_tabular double, weight_text double, bias double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").json(path)


def load_ensemble(spark: SparkSession, path: str) -> Ensemble:
    schema = "mode string, weight_tabular double, weight_text double, bias double"
    row = spark.read.schema(schema).json(path).first()
    return Ensemble(row["weight_tabular"], row["weight_text"], row["bias"], row["mode"])


def blend_scores(df: DataFrame, tabular: str = "p1", text: str = "p2", label: str = "label") -> DataFrame:
    """Average precision of each blend weight 0, 0.05, ..., 1: one row per weight, all in one job.

    Rows are counted per pair of scores before they are copied to the 21 weights.
    """
    y = F.col(label).cast("long")
    pairs = df.groupBy(F.col(tabular).alias("_a"), F.col(text).alias("_b")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")
    )
    step = 1.0 / (WEIGHT_STEPS - 1)
    weights = F.array(*[F.lit(min(i * step, 1.0)) for i in range(WEIGHT_STEPS)])
    mixed = pairs.select("_a", "_b", "pos", "neg", F.explode(weights).alias("weight"))
    score = F.col("weight") * F.col("_a") + (1.0 - F.col("weight")) * F.col("_b")
    counts = mixed.groupBy("weight", score.alias("score")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return curve_points(counts, ["weight"]).groupBy("weight").agg(
        F.round(average_precision_expr(), 12).alias("average_precision")
    )


def fit_blend(df: DataFrame, tabular: str = "p1", text: str = "p2", label: str = "label") -> Ensemble:
    """The weight with the best average precision; the smallest one on ties."""
    best = blend_scores(df, tabular, text, label).orderBy(F.desc("average_precision"), "weight").first()
    return Ensemble(best["weight"], 1.0 - best["weight"], 0.0, "blend")


def fit_stacking(
    df: DataFrame, tabular: str = "p1", text: str = "p2", label: str = "label", c: float = 1.0
) -> Ensemble:
    """Logistic stacking with an L2 penalty of strength 1/c on the two weights."""
    data = df.select(F.col(label).cast("double").alias("label"), array_to_vector(F.array(tabular, text)).alias("features"))
    n = data.count()
    model = LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200).fit(data)
    return Ensemble(float(model.coefficients[0]), float(model.coefficients[1]), float(model.intercept), "stack")
