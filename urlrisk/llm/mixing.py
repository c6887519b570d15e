"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target number of words. A document's expected number of copies is its source's target over its
source's size, so only the fraction is random. Two documents of a source are paired and words move from one to the
other, in the direction that a fair draw names, until one of them has a whole number of copies; the other goes on.
The sum of words stays the same at every step. A reduction tree does this in small groups of documents (``FAN`` on
average, dealt by hash), one level after the other, so no task ever holds a source. The one document per source that
is left over is drawn by itself. Large documents (above the mean of their source) go first; what their last draw
was off is spread over the small ones, so that a source's words miss the target by about one small document.

Only DataFrame functions. All draws are hashes of ids: a rerun gives the same rows.

Cases: a null text has size 0 and a null or empty source is a source of its own (null is last). Documents of size 0
take nothing. Repeated ids are separate documents (they draw alike). An empty table gives an empty result. Other
columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.common import WORD, uniform
from urlrisk.operators.ordering import cut_lineage, global_rank, global_running
from urlrisk.operators.skew import bounded_broadcast

#: Documents of a group of the reduction tree, on average.
FAN = 24
#: A fraction this near to a whole number counts as whole.
NEAR = 1e-9


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target): ``share`` of all words dealt by weight, at most ``most`` times a source's size.

    The excess of a source that has reached its limit goes to the others by weight. With sources in the order of
    limit over weight, the first k of which are full, the level of the rest is (all - limits of k) / (weights of
    the rest); the right k is the first for which the next source stays within its limit.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(sums.withColumn("_last", F.col("source").isNull()), ["_last", "source"])
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("ordinal") - 1) % len(weights) + 1).cast("int"))
    limited = ranked.select(
        "source",
        "source_size",
        F.col("ordinal").alias("_at"),
        weight.alias("_w"),
        (F.col("source_size") * float(most)).alias("_limit"),
        (F.col("source_size") * float(most) / weight).alias("_full_at"),
    )
    run = global_running(limited, ["_full_at", "_at"], ["_limit", "_w"])
    total = F.col("all__limit") / float(most) * float(share)
    level = (total - (F.col("run__limit") - F.col("_limit"))) / (F.col("all__w") - (F.col("run__w") - F.col("_w")))
    found = run.select("ordinal", "_full_at", level.alias("_level")).where(F.col("_level") <= F.col("_full_at"))
    one = found.agg(F.min_by("_level", "ordinal").alias("_level"))  # one row
    return limited.crossJoin(F.broadcast(one)).select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("_level") * F.col("_w"), F.col("_limit")), F.col("_limit")).alias("target"),
    )


def _settle(rows: Column, seed: int) -> Column:
    """Pair the documents of a group in turn: an array of all of them, of which at most one still has a fraction."""

    def step(state: Column, new: Column) -> Column:
        old = state["left"]
        up = F.least((1 - old["p"]) * old["size"], new["p"] * new["size"])
        down = F.least(old["p"] * old["size"], (1 - new["p"]) * new["size"])
        rises = uniform(old["doc_id"], new["doc_id"], F.lit(seed)) * (up + down) < down
        old_whole = F.when(rises, (1 - old["p"]) * old["size"] <= new["p"] * new["size"]).otherwise(
            old["p"] * old["size"] <= (1 - new["p"]) * new["size"]
        )
        old_p = F.when(rises, old["p"] + up / old["size"]).otherwise(old["p"] - down / old["size"])
        new_p = F.when(rises, new["p"] - up / new["size"]).otherwise(new["p"] + down / new["size"])
        # exact ends: the settled one has 1 if it rose and 0 if it fell
        settled = F.when(
            old_whole, _doc(old, F.when(rises, 1.0).otherwise(0.0))
        ).otherwise(_doc(new, F.when(rises, 0.0).otherwise(1.0)))
        left = F.when(old_whole, _doc(new, F.greatest(F.lit(0.0), F.least(F.lit(1.0), new_p)))).otherwise(
            _doc(old, F.greatest(F.lit(0.0), F.least(F.lit(1.0), old_p)))
        )
        return F.struct(left.alias("left"), F.concat(state["done"], F.array(settled)).alias("done"))

    start = F.struct(rows[0].alias("left"), F.slice(rows, 1, 0).alias("done"))
    rest = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    return F.aggregate(rest, start, step, lambda s: F.concat(s["done"], F.array(s["left"])))


def _doc(doc: Column, p: Column) -> Column:
    return F.struct(doc["doc_id"].alias("doc_id"), doc["size"].alias("size"), p.alias("p"), doc["base"].alias("base"))


def pivotal_rounding(rows: DataFrame, seed: int) -> DataFrame:
    """(source, doc_id, size, p, base) with p in (0, 1) to (source, doc_id, size, copies), copies base or base + 1.
    The words of a source, p and base times size, keep their sum up to one document."""
    counts = cut_lineage(rows.groupBy("source").agg(F.count("*").alias("_n")))
    most = counts.agg(F.max("_n")).first()[0] or 0  # one number
    levels = max(1, math.ceil(math.log(max(most, 2), FAN)))
    left, settled = rows, []
    whole = (F.col("p") <= NEAR) | (F.col("p") >= 1 - NEAR)
    for level in range(levels):
        groups = F.ceil(F.col("_n") / float(FAN ** (level + 1))).cast("long")
        dealt = with_source(left, counts).withColumn("_g", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), groups))
        members = F.sort_array(F.collect_list(F.struct("doc_id", "size", "p", "base")))
        grouped = dealt.groupBy("source", "_g").agg(members.alias("_rows"))
        settle = F.explode(_settle(F.col("_rows"), seed)).alias("_d")
        out = cut_lineage(grouped.select("source", settle).select("source", "_d.*"))
        settled.append(out.where(whole))
        left = out.where(~whole)
    drawn = uniform(F.col("doc_id"), F.lit(seed), F.lit("last")) < F.col("p")
    settled.append(left.withColumn("p", drawn.cast("double")))
    done = settled[0]
    for part in settled[1:]:
        done = done.unionByName(part)
    return done.select("source", "doc_id", "size", (F.col("base") + F.round("p").cast("long")).alias("copies"))


def with_source(rows: DataFrame, by_source: DataFrame, how: str = "inner") -> DataFrame:
    """Add the columns of a table with one row per source; null joins null. The table is broadcast if a count shows it small."""
    right = bounded_broadcast(by_source.withColumnRenamed("source", "_source"))
    return rows.join(right, rows["source"].eqNullSafe(right["_source"]), how).drop("_source")


def _round(rows: DataFrame, seed: int) -> DataFrame:
    """(source, doc_id, size, rate) to copies: whole rates stay, the fraction of the others is rounded."""
    whole = F.round("rate")
    rate = F.when(F.abs(F.col("rate") - whole) < NEAR, whole).otherwise(F.col("rate"))
    parts = rows.select("source", "doc_id", "size", F.floor(rate).alias("base"), (rate - F.floor(rate)).alias("p"))
    parts = cut_lineage(parts)
    still = parts.where("p = 0 or size = 0").select("source", "doc_id", "size", F.col("base").alias("copies"))
    return cut_lineage(still.unionByName(pivotal_rounding(parts.where("p > 0 and size > 0"), seed)))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document; ``weights`` repeat over the
    sources in order, null last."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    sized = cut_lineage(sized)
    targets = cut_lineage(source_targets(sized, weights, share, most))
    means = sized.where("size > 0").groupBy("source").agg(F.avg("size").alias("_mean"))
    rates = targets.select(
        "source", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")
    )
    wide = with_source(with_source(sized, rates), cut_lineage(means), "left")
    is_large = F.coalesce(F.col("size") > F.col("_mean"), F.lit(False))

    large = wide.where(is_large)
    rounded = _round(large, seed)
    # what the large ones are off goes to the small ones
    wanted = large.groupBy("source").agg(F.sum(F.col("size") * F.col("rate")).alias("_wanted"))
    got = rounded.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("_got"))
    room = wide.where(~is_large).groupBy("source").agg(F.sum("size").alias("_room"))
    room = with_source(with_source(room, wanted, "left"), got, "left")
    off = F.coalesce(F.col("_wanted") - F.col("_got"), F.lit(0.0))
    shift = cut_lineage(room.select("source", F.when(F.col("_room") > 0, off / F.col("_room")).otherwise(0.0).alias("_shift")))
    moved = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.col("rate") + F.col("_shift")))
    small = _round(with_source(wide.where(~is_large), shift).withColumn("rate", moved), seed + 1)

    both = with_source(rounded.unionByName(small), targets)
    return both.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
