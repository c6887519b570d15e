"""Plan-shape helper."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_stage(df: DataFrame, keep: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """Select ``keep`` plus computed ``columns`` that later steps see as plain columns.

    Catalyst moves a predicate or a join key below a projection by writing the projected expressions into it.
    Steps here build on each other, so that would copy the same work again and again and the plan would grow
    exponentially. A one-element ``explode`` ends that: predicates on the computed columns stay above it, while
    predicates on the input columns still pass through it and reach the scan.
    """
    packed = F.struct(*[col.alias(name) for name, col in columns.items()])
    staged = df.select(*keep, F.explode_outer(F.array(packed)).alias("_stage"))
    return staged.select(*keep, *[F.col(f"_stage.{name}").alias(name) for name in columns])
