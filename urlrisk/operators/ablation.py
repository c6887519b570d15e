"""What each feature family is worth to a linear scorer.

One pass over the training rows gives the Gram matrix of all features, the label and a constant; each task adds up its own. The least-squares scorer without
a family is then solved from a sub-matrix, so no further pass over the training rows is needed however many families there are. A second pass
scores the test rows with all scorers at once and hands on counts per score.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.operators.evaluate import curve_points, roc_auc_expr
from urlrisk.operators.features import FEATURE_FAMILIES, FEATURE_NAMES

RIDGE = 1e-6
#: Scores are compared by steps of this size.
STEP = 1e-4
NOTHING = "none"


def _rows(batch: pd.DataFrame) -> np.ndarray:
    return np.vstack(batch["x"].to_list()).astype(float) if len(batch) else np.zeros((0, 0))


def _matrix_input(df: DataFrame, label: str, features: str) -> DataFrame:
    x = F.array(*[F.col(f"{features}.{n}").cast("double") for n in FEATURE_NAMES])
    return df.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), x.alias("x"))


def gram_matrix(df: DataFrame, label: str = "label", features: str = "features") -> np.ndarray:
    """Sums of products of (features in order, 1, label) over all rows; as many numbers as features squared reach the driver."""
    width = len(FEATURE_NAMES) + 2

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                z = np.column_stack([_rows(batch), np.ones(len(batch)), batch["y"]])
                total += z.T @ z
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    sums = _matrix_input(df, label, features).mapInPandas(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((width, width))
    out[sums["i"].to_numpy(), sums["j"].to_numpy()] = sums["v"].to_numpy()
    return out


def solve_scorers(gram: np.ndarray, families: Mapping[str, str] = FEATURE_FAMILIES, ridge: float = RIDGE) -> dict[str, np.ndarray]:
    """Weights of (features, 1) for the scorer without each family, and for the one with all; a left-out feature weighs 0."""
    n = len(FEATURE_NAMES) + 1
    out = {}
    for family in (NOTHING, *families):
        gone = set(families[family].split()) if family != NOTHING else set()
        kept = np.array([i for i, name in enumerate(FEATURE_NAMES) if name not in gone and gram[i, i] > 0] + [n - 1])
        scale = np.sqrt(gram[kept, kept])
        scale[scale == 0] = 1.0
        a = gram[np.ix_(kept, kept)] / np.outer(scale, scale) + ridge * np.eye(len(kept))
        weights = np.zeros(n)
        weights[kept] = np.linalg.solve(a, gram[kept, n] / scale) / scale
        out[family] = weights
    return out


def ablation_counts(df: DataFrame, scorers: Mapping[str, np.ndarray], label: str = "label", features: str = "features") -> DataFrame:
    """(without, score, pos, neg): test rows per scorer and score."""
    names, matrix = list(scorers), np.column_stack(list(scorers.values()))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            steps = np.rint((np.column_stack([_rows(batch), np.ones(len(batch))]) @ matrix) / STEP).astype(np.int64)
            frames = [pd.DataFrame({"without": name, "score": steps[:, k], "pos": batch["y"].astype("int64"), "neg": (1 - batch["y"]).astype("int64")}) for k, name in enumerate(names)]
            yield pd.concat(frames).groupby(["without", "score"], as_index=False).sum()

    counted = _matrix_input(df, label, features).mapInPandas(score, "without string, score long, pos long, neg long")
    return counted.groupBy("without", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def family_ablation(train: DataFrame, test: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """(without, n_features, n_pos, n_neg, roc_auc, loss) per family; ``loss`` is the AUC that goes with it."""
    scorers = solve_scorers(gram_matrix(train, label, features))
    counts = ablation_counts(test, scorers, label, features)
    aucs = curve_points(counts, ["without"]).groupBy("without").agg(
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), roc_auc_expr().alias("auc")
    )
    sizes = F.lit(len(FEATURE_NAMES))
    for family, members in FEATURE_FAMILIES.items():
        sizes = F.when(F.col("without") == family, len(FEATURE_NAMES) - len(members.split())).otherwise(sizes)
    whole = F.broadcast(aucs.where(F.col("without") == NOTHING).select(F.col("auc").alias("_whole")))  # one row
    return aucs.crossJoin(whole).select(
        "without", sizes.alias("n_features"), "n_pos", "n_neg", F.round("auc", 6).alias("roc_auc"), F.round(F.col("_whole") - F.col("auc"), 6).alias("loss")
    )
