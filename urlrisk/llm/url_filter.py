"""URL rules by Bloom filter cascades.

A rule is a host and a path prefix. A url can only be met by the keys (suffix of its host at a dot, prefix of its path),
for the numbers of host labels and the path lengths that the rules have; all keys of all urls are the universe. For
the rules of each verdict a cascade is built: level 0 is a Bloom filter of the listed keys, level 1 one of the universe's
other keys that pass level 0, level 2 one of the listed keys that pass level 1, and so on until no key is wrong. A key
of the universe is then listed if the first level it fails has an odd number, so the urls are judged exactly, without
a join: the filters are one broadcast row, whose bits are bounded by ``max_bits`` (more keys raise an error that says so).

Only DataFrame functions.

Cases: a null url, or one without ``://``, has an empty host and path, meets no rule and is allowed. Of two rules that
fit, the longer text wins, then the one with the longer host; a rule listed under both verdicts blocks. Repeated rows
are kept, an empty table gives an empty result, other columns are not read. No rules: all urls are allowed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.operators.ordering import cut_lineage

#: verdict, host, path prefix
Rule = tuple[str, str, str]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAX_BITS = 1 << 26


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def candidate_keys(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The keys that could be rules, longest first, then the longest host."""
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    parts = F.split(host, r"\.")
    keys = []
    for n in labels:
        suffix = F.array_join(F.slice(parts, F.greatest(F.size(parts) - (n - 1), F.lit(1)), n), ".")
        for k in lengths:
            fits = (F.size(parts) >= n) & (F.length(path) >= k) & (F.length(host) > 0)
            key = F.concat(suffix, F.substring(path, 1, k))
            keys.append(F.when(fits, F.struct((-F.length(key)).alias("_l"), (-F.length(suffix)).alias("_h"), key.alias("key"))))
    if not keys:
        return F.array().cast("array<string>")
    return F.transform(F.sort_array(F.array_compact(F.array(*keys))), lambda x: x["key"])


def _positions(key: Column, level: int, bits: int, probes: int) -> Column:
    """Bit numbers of a key in a level."""
    first = F.shiftrightunsigned(F.xxhash64(key, F.lit(level)), 24)
    second = F.shiftrightunsigned(F.xxhash64(F.lit(level), key), 24)
    return F.array(*[F.pmod(first + F.lit(i) * second, F.lit(bits).cast("long")) for i in range(probes)])


def _passes(key: Column, words: Column, level: int, bits: int, probes: int) -> Column:
    return F.forall(
        _positions(key, level, bits, probes),
        lambda p: F.get(words, F.shiftright(p, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))) != 0,
    )


def _filter_row(keys: DataFrame, level: int, bits: int, probes: int) -> DataFrame:
    """One row: the filter's bits as an array of longs, the first bits in the first."""
    spark = keys.sparkSession
    spots = keys.select(F.explode(_positions(F.col("key"), level, bits, probes)).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    words = spots.groupBy(F.shiftright("p", 6).cast("long").alias("id")).agg(F.bit_or(bit).alias("w"))
    dense = spark.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("w", F.lit(0).cast("long")).alias("w"))
    packed = F.sort_array(F.collect_list(F.struct("id", "w")))
    return dense.agg(F.transform(packed, lambda x: x["w"]).alias(f"_level_{level}"))


class Cascade:
    """The levels of one list: a row of filters and the size of each."""

    def __init__(self, listed: DataFrame, universe: DataFrame, name: str, max_bits: int = MAX_BITS) -> None:
        self.name, self.sizes = name, []  # (bits, probes) per level
        self.rows: DataFrame | None = None
        listed = cut_lineage(listed.select("key").distinct())
        others = cut_lineage(universe.select("key").distinct().join(F.broadcast(listed), "key", "left_anti"))
        encode, against = listed, others
        n, n_against = listed.count(), others.count()
        while n:
            level = len(self.sizes)
            wrong = math.sqrt(0.5) * n / max(1, n_against) if level == 0 else 0.5
            probes = max(1, round(-math.log2(min(0.5, wrong))))
            bits = 64 * max(1, math.ceil(probes * n / math.log(2) / 64))
            if sum(b for b, _ in self.sizes) + bits > max_bits:
                raise ValueError(f"cascade {name} needs more than {max_bits} bits for {n} keys; raise max_bits or split the list")
            row = cut_lineage(_filter_row(encode, level, bits, probes)).withColumnRenamed(f"_level_{level}", f"_{name}_{level}")
            self.sizes.append((bits, probes))
            self.rows = row if self.rows is None else self.rows.crossJoin(row)  # one row each
            passed = against.crossJoin(F.broadcast(row)).where(_passes(F.col("key"), F.col(f"_{name}_{level}"), level, bits, probes))
            encode, against = cut_lineage(passed.select("key")), encode
            n = encode.count()
        # against is now fully told apart

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is listed; the columns of ``rows`` must be at hand."""
        out = F.lit(len(self.sizes) % 2 == 1)  # passes all levels
        for level in reversed(range(len(self.sizes))):
            bits, probes = self.sizes[level]
            passes = _passes(key, F.col(f"_{self.name}_{level}"), level, bits, probes)
            out = F.when(passes, out).otherwise(F.lit(level % 2 == 1))
        return out


def judge_urls(urls: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row."""
    spark = urls.sparkSession
    named = urls.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    host, path = split_url(F.col("_url"))
    split = named.select("page_id", host.alias("host"), path.alias("path"))
    split = split.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), rules))
    universe = cut_lineage(split.select(F.explode("_keys").alias("key")).distinct())
    blocked = sorted({h + p for v, h, p in rules if v == "block"})
    allowed = sorted({h + p for v, h, p in rules if v == "allow"} - set(blocked))
    cascades = {}
    for name, keys in (("block", blocked), ("allow", allowed)):
        listed = spark.range(1).select(F.explode(F.array(*map(F.lit, keys)).cast("array<string>")).alias("key"))
        cascades[name] = Cascade(listed, universe, name, max_bits)
    judged = split
    for cascade in cascades.values():
        if cascade.rows is not None:
            judged = judged.crossJoin(F.broadcast(cascade.rows))
    hits = F.filter("_keys", lambda k: cascades["block"].listed(k) | cascades["allow"].listed(k))
    ruled = judged.withColumn("rule", F.get(hits, F.lit(0)))
    blocks = F.coalesce(cascades["block"].listed(F.col("rule")), F.lit(False))
    verdict = F.when(F.col("rule").isNotNull() & blocks, "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
