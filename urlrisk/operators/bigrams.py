"""Character bigram model of names: how usual the letters of a name follow each other.

Counts of pairs of characters become one array of smoothed conditional log-probabilities, which travels as one row; a name is read against it by position,
without a join or Python. Characters outside printable ASCII share one symbol; symbol 0 stands before the first and after the last character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.operators.ordering import cut_lineage

FIRST, LAST = 32, 126  # printable ASCII
OTHER = LAST - FIRST + 2
SYMBOLS = OTHER + 1
SMOOTHING = 0.5


def symbol_pairs(name: Column) -> Column:
    """Numbers of the successive symbol pairs of a name, its ends included."""
    code = lambda c: F.when(F.ascii(c).between(FIRST, LAST), F.ascii(c) - (FIRST - 1)).otherwise(F.lit(OTHER))
    inside = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), code)
    ends = F.array(F.lit(0))
    return F.zip_with(F.concat(ends, inside), F.concat(inside, ends), lambda a, b: a * SYMBOLS + b)


def fit_bigrams(names: DataFrame, name: str = "name", smoothing: float = SMOOTHING) -> DataFrame:
    """One row with ``bigram_model``: log p(next symbol | symbol) for all SYMBOLS * SYMBOLS pairs, from the rows of ``names``."""
    pairs = names.where(F.col(name).isNotNull()).select(F.explode(symbol_pairs(F.col(name))).alias("pair"))
    counts = cut_lineage(pairs.groupBy("pair").agg(F.count("*").alias("n")))  # at most SYMBOLS * SYMBOLS rows from here on
    totals = counts.groupBy((F.col("pair") / SYMBOLS).cast("int").alias("first")).agg(F.sum("n").alias("all"))
    grid = names.sparkSession.range(SYMBOLS * SYMBOLS).select(F.col("id").cast("int").alias("pair"), (F.col("id") / SYMBOLS).cast("int").alias("first"))
    known = grid.join(F.broadcast(counts), "pair", "left").join(F.broadcast(totals), "first", "left")
    amount = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    log_p = F.log((amount("n") + smoothing) / (amount("all") + smoothing * SYMBOLS))
    ordered = F.sort_array(F.collect_list(F.struct("pair", log_p.alias("p"))))
    return cut_lineage(known.agg(F.transform(ordered, lambda x: x["p"]).alias("bigram_model")))


def add_name_score(df: DataFrame, model: DataFrame, name: str = "name", out: str = "name_log_p") -> DataFrame:
    """Add the mean log-probability of the pairs of ``name``; null for null. ``model``: the row of :func:`fit_bigrams`."""
    pairs = symbol_pairs(F.col(name))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.get(F.col("bigram_model"), p))
    scored = df.crossJoin(F.broadcast(model)).withColumn(out, F.when(F.col(name).isNotNull(), total / F.size(pairs)))
    return scored.drop("bigram_model")
