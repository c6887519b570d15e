"""Near duplicates between two tables: an exact set-similarity join over character n-grams.

A text is the set of its character n-grams. Two sets can only be alike enough if one of the few first grams of each, in any order that all texts share, is
equal (prefix filter), if their sizes are close (length filter) and if enough grams can still follow the equal one (position filter). Grams are ordered by rarity, so that
few texts meet. Rarity is a count per hash bucket: a table of fixed size that travels as one array. What passes the filters is compared in full, so no pair is missed.

``similar_texts`` gives the pairs. Texts of one shape are all alike, so the pairs can grow with the square of the texts; ``similar_counts`` gives their number and the
closest one for each text without listing them (see there).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.functions import grams as g
from urlrisk.functions.planning import computed_stage
from urlrisk.operators.ordering import cut_lineage, stored
from urlrisk.operators.skew import bounded_broadcast

GRAM = 5
THRESHOLD = 0.9
BUCKETS = 1 << 16
#: Grams in at most so many texts of a family are rare.
RARE = 256
#: Outlines of texts that are compared to find families; a gram belongs to the outlines if one in so many texts has it.
OUTLINES, OUTLINE_SHARE = 4096, 256
#: Classes of a family that meet at one gram are dealt out over so many tasks.
CLASS_SALTS = 16


def char_grams(text: Column, n: int = GRAM) -> Column:
    """The distinct n-grams of a text; a shorter text is its only gram. Null for null."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(n))))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _gram_counts(texts: DataFrame) -> DataFrame:
    """One row: how often the grams of each bucket occur."""
    counts = texts.select(F.explode("grams").alias("g")).groupBy(_bucket(F.col("g")).alias("b")).agg(F.count("*").alias("n"))
    every = texts.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(F.broadcast(counts), "b", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("_counts"))


def similar_texts(left: DataFrame, right: DataFrame, text: str = "text", threshold: float = THRESHOLD, n: int = GRAM) -> DataFrame:
    """(left, right, similarity): all pairs of distinct texts of both tables with a Jaccard similarity of at least ``threshold``.

    Null texts are like nothing. Each distinct text goes through once, however many rows hold it.
    """
    sides = []
    for df, name in ((left, "left"), (right, "right")):
        sides.append(df.select(F.col(text).alias("t"), F.lit(name == "left").alias("is_left")).where("t is not null").distinct())
    texts = computed_stage(sides[0].unionByName(sides[1]), ["t", "is_left"], {"grams": char_grams(F.col("t"), n)})
    texts = cut_lineage(texts)
    counts = F.broadcast(cut_lineage(_gram_counts(texts)))  # one row of BUCKETS numbers
    size = F.size("grams")
    # a text shares at least ceil(threshold * size) grams with a similar one, so one of its first ones is shared; 1e-9 against rounding up
    reach = size - F.ceil(size * threshold - F.lit(1e-9)).cast("int") + 1
    rare = F.sort_array(F.transform("grams", lambda g: F.struct(F.get(F.col("_counts"), _bucket(g)).alias("n"), g.alias("g"))))
    first = texts.crossJoin(counts).select("t", "is_left", size.alias("m"), F.posexplode(F.slice(rare, F.lit(1), reach)).alias("i", "x"))
    first = first.select("t", "is_left", "m", "i", "x.g")
    one = first.where("is_left").select("g", F.col("t").alias("left"), F.col("m").alias("lm"), F.col("i").alias("li"))
    two = first.where("not is_left").select("g", F.col("t").alias("right"), F.col("m").alias("rm"), F.col("i").alias("ri"))
    small, large = F.least("lm", "rm"), F.greatest("lm", "rm")
    shared = F.ceil((F.col("lm") + F.col("rm")) * (threshold / (1 + threshold)) - F.lit(1e-9))
    left_over = 1 + F.least(F.col("lm") - F.col("li"), F.col("rm") - F.col("ri")) - 1
    met = one.join(two, "g").where((small >= large * threshold - 1e-9) & (left_over >= shared)).select("left", "right").distinct()
    held = texts.groupBy("t").agg(F.first("grams").alias("grams"))
    pairs = met.join(held.select(F.col("t").alias("left"), F.col("grams").alias("lg")), "left")
    pairs = pairs.join(held.select(F.col("t").alias("right"), F.col("grams").alias("rg")), "right")
    common = F.size(F.array_intersect("lg", "rg"))
    judged = pairs.select("left", "right", (common / (F.size("lg") + F.size("rg") - common)).alias("similarity"))
    return judged.where(F.col("similarity") >= threshold)


def _families(held: DataFrame, bucket: np.ndarray, n: np.ndarray, rare: int, threshold: float) -> tuple:
    """Texts that can be similar are in one family, so a gram is as frequent as in its family. Outlines are sets of very frequent grams: at most ``OUTLINES`` rows come here, else fewer grams count."""
    least = max(rare, held.count() // OUTLINE_SHARE)
    while True:
        top = np.zeros(g.BUCKETS, bool)
        top[bucket[n > least]] = True
        table = held.sparkSession.sparkContext.broadcast(top)
        found = held.select("grams").mapInArrow(g.outlines(table), "outline long, m int, top array<long>, n long")
        rows = found.groupBy("outline", "m", "top").agg(F.sum("n").alias("n")).limit(OUTLINES + 1).toArrow()
        if rows.num_rows <= OUTLINES or not top.any():
            break
        least *= 4
    outline, m = rows["outline"].to_numpy(), rows["m"].to_numpy().astype(np.int64)
    if rows.num_rows <= OUTLINES and len(set(outline.tolist())) == len(outline):
        family = g.families(m, [np.array(x, np.int64) for x in rows["top"].to_pylist()], threshold)
        return g.packed_families(top, outline, family, rows["n"].to_numpy())
    # texts of too many sizes, or two outlines of an equal hash: all are one family
    none = np.zeros(0, np.int64)
    return top, none, none, np.array([held.count()])


def _ordered_grams(left: DataFrame, right: DataFrame, text: str, n: int, rare: int, threshold: float) -> DataFrame:
    """The distinct texts of both sides with their families and grams, rare ones first (columns of ``grams.order_grams``)."""
    sides = [df.select(F.col(text).alias("t"), F.lit(is_left).alias("is_left")) for df, is_left in ((left, True), (right, False))]
    texts = sides[0].unionByName(sides[1]).where("t is not null").distinct()
    held = stored(texts.mapInArrow(g.split_texts(n), "t string, is_left boolean, grams array<long>"), "grams")
    context = held.sparkSession.sparkContext
    counts = held.select("grams").mapInArrow(g.count_grams, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    often = counts.where(F.col("n") > rare).toArrow()  # at most g.BUCKETS rows
    families = _families(held, often["bucket"].to_numpy(), often["n"].to_numpy(), rare, threshold)
    counted = held.select("grams").mapInArrow(g.count_in_families(context.broadcast(families), rare), "family long, gram long, n long, size long")
    counted = counted.groupBy("family", "gram").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    of_all = (F.col("family") >= 0) & (F.col("n") == F.col("size"))
    counted = counted.where(of_all | ((F.col("family") < 0) & (F.col("n") > rare))).toArrow()  # at most g.BUCKETS rows and the shared grams of OUTLINES families
    family, gram, times = (counted[k].to_numpy() for k in ("family", "gram", "n"))
    is_bucket = family < 0
    level = g.levels(gram[is_bucket], times[is_bucket], rare)
    table = context.broadcast((families, g.packed_shared(family[~is_bucket], gram[~is_bucket]), level))
    columns = "t string, is_left boolean, family int, grams array<long>, more int, m int, r int, b1 long, b2 long, f1 long, f2 long"
    return stored(held.mapInArrow(g.order_grams(table), columns), "ordered-grams")


def _met(one: DataFrame, two: DataFrame, keep: list[str], threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(keep, common, lm, rm, more) of the pairs of a family that share a gram ``g`` of their first ones and pass the filters; each pair once, at the first gram that it shares.
    Both sides have (family, g, m, p1, p2, set, size) with the prefix l or r: ``p1``, ``p2`` are parities of ``set``, ``m`` is the size that the similarity goes by."""
    both = F.col("lm") + F.col("rm")
    shared = F.ceil(both * (threshold / (1 + threshold)) - F.lit(1e-9))
    apart = F.bit_count(F.col("lp1").bitwiseXOR(F.col("rp1"))) + F.bit_count(F.col("lp2").bitwiseXOR(F.col("rp2")))
    met = one.join(two, ["family", "g", *by]).where(
        (F.least("lm", "rm") >= F.greatest("lm", "rm") * threshold - 1e-9) & (apart <= F.col("lsize") + F.col("rsize") - 2 * shared)
    )
    met = computed_stage(met, ["g", "lm", "rm", "more", *keep], {"common": F.array_intersect("lset", "rset")})
    return met.where(F.array_min("common") == F.col("g")).drop("g")


def similar_counts(
    left: DataFrame, right: DataFrame, text: str = "text", threshold: float = THRESHOLD, n: int = GRAM, rare: int = RARE
) -> DataFrame:
    """(left, n, closest): for each distinct text of ``left`` with similar ones in ``right``, how many distinct ones there are and the largest similarity. Exact.

    Texts that may be similar are in one family, and the grams that a whole family has are only counted. Texts of a family with equal frequent grams (in more than ``rare`` of its
    texts) and equally many rare ones are a class. If the frequent grams of two classes are alike enough by themselves, all their texts are linked and counted at once: two
    classes meet, not their texts. All other links share a rare gram, and few texts meet there. As rare grams come first, a link that shares a rare gram shares one of the
    first grams, so it is also found if its classes are linked, for the largest similarity.
    """
    texts = _ordered_grams(left, right, text, n, rare, threshold)
    least = F.ceil(F.col("m") * threshold - F.lit(1e-9)).cast("int")  # grams that a similar text shares
    similarity = lambda common: common / (F.col("lm") + F.col("rm") - common)

    def side(df: DataFrame, is_left: bool, *plain: str, **more: str) -> DataFrame:
        names = {f"{'l' if is_left else 'r'}{k}": F.col(k) for k in ("m", "p1", "p2", "set", "size")}
        return df.where(F.col("is_left") == is_left).select("family", "g", *plain, *[c.alias(k) for k, c in names.items()], *[F.col(c).alias(k) for k, c in more.items()])

    first = F.slice("grams", F.lit(1), F.least(F.col("m") - least + 1, F.col("r")))
    sharing = texts.select(
        "t", "is_left", "family", "more", "m", F.col("b1").alias("p1"), F.col("b2").alias("p2"), F.col("grams").alias("set"), F.col("m").alias("size"), F.explode(first).alias("g")
    )
    met = _met(side(sharing, True, "more", left="t"), side(sharing, False), ["left"], threshold)
    frequent = F.size(F.filter("common", lambda x: x >= F.lit(1 << g.PAYLOAD))) + F.col("more")
    met = met.select("left", similarity(F.size("common") + F.col("more")).alias("similarity"), (similarity(frequent) < threshold).cast("long").alias("n"))
    single = met.where(F.col("similarity") >= threshold).groupBy("left").agg(F.sum("n").alias("n"), F.max("similarity").alias("closest"))

    often = F.slice("grams", F.col("r") + 1, F.size("grams") - F.col("r")).alias("set")
    able = texts.where(F.col("m") - F.col("r") >= least)
    classes = able.groupBy("family", often, "more", "m", "r", "is_left").agg(F.min("f1").alias("p1"), F.min("f2").alias("p2"), F.count("*").alias("n"))
    classes = cut_lineage(classes.withColumn("id", F.monotonically_increasing_id()))
    size = F.col("m") - F.col("r")
    dealt = classes.select("*", size.alias("size"), F.explode(F.slice("set", F.lit(1), size - least + 1)).alias("g"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(CLASS_SALTS - 1))).alias("salt")
    one = side(dealt, True, "more", id="id").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(CLASS_SALTS)).cast("int"))
    two = side(dealt, False, rn="n").select("*", salts)
    met = _met(one, two, ["id", "rn"], threshold, ("salt",))
    met = met.select("id", "rn", similarity(F.size("common") + F.col("more")).alias("similarity")).where(F.col("similarity") >= threshold)
    linked = met.groupBy("id").agg(F.sum("rn").alias("n"), F.max("similarity").alias("closest"))
    linked = linked.join(classes.select("id", "family", "set", "m"), "id").drop("id")
    crowd = able.where("is_left").select(F.col("t").alias("left"), "family", often, "m").join(linked, ["family", "set", "m"]).select("left", "n", "closest")
    return single.unionByName(crowd).groupBy("left").agg(F.sum("n").alias("n"), F.max("closest").alias("closest"))


def drop_similar(rows: DataFrame, others: DataFrame, text: str = "text", threshold: float = THRESHOLD, n: int = GRAM) -> DataFrame:
    """``rows`` without those whose text is similar to a text of ``others``; rows with a null text stay."""
    gone = cut_lineage(similar_counts(rows, others, text, threshold, n).select(F.col("left").alias("_gone")))
    return rows.join(bounded_broadcast(gone), F.col(text) == F.col("_gone"), "left_anti")
