"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.operators.ordering import cut_lineage

#: An edge table of at most so many rows is spread over few tasks.
SMALL = 200_000
FEW_TASKS = 8


@contextmanager
def plain_plans(spark: SparkSession) -> Iterator[None]:
    """Few shuffle partitions and no adaptive planning meanwhile, for many short jobs on small tables: adaptive planning makes each exchange a job of its own, with
    a thread of the driver that stays for a minute, and plans the rest anew after it."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(FEW_TASKS, int(held["spark.sql.shuffle.partitions"]))))
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for edges (a, b): root is the smallest node of the component.

    Each round a node takes the smallest root among its own and its neighbours', and then the root of that root, so
    the distance to the smallest node is at least halved. Neighbours are reduced by a partial aggregation before the shuffle, so a node with very
    many edges is no hot task. Ends when no root changes. A table that a count proves small goes through the same rounds with fewer tasks.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = cut_lineage(both)
    if both.count() > SMALL:
        return _rounds(both, lambda df: df)
    with plain_plans(both.sparkSession):
        return _rounds(both.coalesce(FEW_TASKS), lambda df: df.coalesce(FEW_TASKS))


def _rounds(both: DataFrame, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    roots = cut_lineage(few(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))))
    changed = 1
    while changed:
        near = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("m"))
        taken = roots.join(near, roots["node"] == near["a"], "left").select(
            "node", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("new")
        )
        taken = cut_lineage(few(taken))
        up = taken.select(F.col("node").alias("_n"), F.col("new").alias("_up"))
        jumped = taken.join(up, F.col("new") == F.col("_n"), "left").select("node", "old", F.least("new", F.coalesce("_up", "new")).alias("root"))
        jumped = cut_lineage(few(jumped))
        changed = jumped.where("root <> old").count()
        roots = jumped.select("node", "root")
    return roots


def merge_components(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) after edges (a, b) between components: only roots, and nodes that had no edge before, enter the rounds."""
    edges = cut_lineage(edges.where("a <> b").distinct())
    if not edges.limit(1).count():
        return roots
    joined = connected_components(edges).select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    every = roots.select("node", "root").unionByName(joined.select(F.col("_n").alias("node"), F.col("_n").alias("root"))).distinct()
    return cut_lineage(every.join(joined, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")))
