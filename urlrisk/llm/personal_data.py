"""Personal data: base patterns, and bootstrapped contextual extraction of what they miss.

The base patterns (email, ip, card, phone) give the seeds. Every seed, and every other token that could be an
identifier (digits with separators, addresses with written-out signs, colon forms), is a mention with its value and its lexical pattern: the two words to
its left. Spark scores the graph of patterns and instances (distinct values) per kind in rounds: an instance is worth 1 if it is a seed of the kind,
0 if it is a seed of another, else 1 - prod(1 - pattern scores); a pattern is worth the mean of its instances' scores, with ``DOUBT`` added to the
count. Patterns worth ``PATTERN_SCORE`` or more with at least ``SEEDS`` seeds of distinct values count as found, and mentions of fitting shape in their slot become
spans; the values found so support other patterns in the next round. Values count once however many copies of a document hold them, and all sums are
grouped aggregations of distinct pairs.

Base spans always stay; found spans never overlap them. Offsets are code points, ends exclusive.

Cases: null and empty texts hold nothing. Repeated rows are kept and found alike; a null id is kept. Of two overlapping found spans the first stays (then
the longer, then the kind listed first). An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from urlrisk.llm.common import bound_batches
from urlrisk.operators.ordering import cut_lineage
from urlrisk.operators.skew import bounded_broadcast

KINDS = ("email", "ip", "card", "phone")
#: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` in two parts around its @, so that long words cost no more than short ones.
EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match never starts within a run of digits: the run's first digit would match, too.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Tokens that could be an identifier, by the kind they could be.
SHAPES = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]+)*")),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])")),
    ("digits", re.compile(r"(?<![0-9A-Za-z.+-])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])")),
)
SPACE = re.compile(r"\s+")
#: Characters before a mention that its pattern is taken from.
CONTEXT = 200
ROUNDS = 3
SEEDS = 3
PATTERN_SCORE = 0.8
DOUBT = 0.25
ROW = (
    "doc_id long, base array<struct<kind string, start int, stop int>>, "
    "mentions array<struct<kind string, seed boolean, value string, pattern string, start int, stop int>>"
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ ends the local part of at most one match; a match takes up where the one before ended."""
    out: list[tuple[int, int]] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in EMAIL_LEFT:
            start -= 1
        right = EMAIL_RIGHT.match(text, at + 1) if start < at else None
        if right:
            end = right.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the base patterns: each kind leftmost and non-overlapping, kinds as listed."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    # only texts with a digit go further
    if not re.search("[0-9]", text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def _left(text: str, start: int) -> str | None:
    """The two words before a place, lower-cased, from the ``CONTEXT`` characters before it; None if there are fewer."""
    words = text[max(0, start - CONTEXT) : start].lower().split()
    return " ".join(words[-2:]) if len(words) >= 2 else None


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, bool, str, str, int, int]]:
    """(kind, is a seed, value, pattern, start, stop) of all seeds and possible identifiers with two words before them."""
    out = []
    for kind, a, b in base:
        pattern = _left(text, a)
        if pattern is not None:
            out.append((kind, True, re.sub(r"[\x20().-]", "", text[a:b]) if kind in ("card", "phone") else text[a:b].lower(), pattern, a, b))
    if not re.search("[0-9@]|\\bat\\b", text):
        return out
    taken: list[list[int]] = []  # without overlaps
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    for kind, shape in SHAPES:
        for m in shape.finditer(text):
            a, b = m.span()
            before = bisect_left(taken, [b])  # those that start before its end
            if before and taken[before - 1][1] > a:
                continue
            pattern = _left(text, a)
            if pattern is None:
                continue
            value = SPACE.sub("", m[0]).lower()
            if kind != "digits":
                out.append((kind, False, value, pattern, a, b))
                continue
            digits = re.sub("[^0-9]", "", value)
            kinds = ["phone"] * (7 <= len(digits) <= 15) + ["card"] * (13 <= len(digits) <= 19)
            out += [(k, False, digits, pattern, a, b) for k in kinds]
    return out


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        base = [base_spans(t) for t in batch["text"]]
        found = [mentions(t, b) if b or re.search("[0-9@]", t) else [] for t, b in zip(batch["text"], base, strict=True)]
        yield pd.DataFrame(
            {
                "doc_id": batch["doc_id"].astype("Int64"),
                "base": [[{"kind": k, "start": a, "stop": b} for k, a, b in x] for x in base],
                "mentions": [
                    [{"kind": k, "seed": s, "value": v, "pattern": p, "start": a, "stop": b} for k, s, v, p, a, b in x] for x in found
                ],
            }
        )


def strong_patterns(mentioned: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, pattern, score, seeds) of the patterns that count as found. ``mentioned``: kind, seed, value, pattern."""
    pairs = mentioned.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed"))
    pairs = cut_lineage(pairs)
    # a pattern speaks for one kind: its seeds of other kinds, and values that fit none, count against it
    values = pairs.groupBy("pattern").agg(F.count_distinct("value").alias("all_values"))
    instances = pairs.withColumn("worth", F.col("seed").cast("double"))
    scored = None
    for _ in range(rounds):
        sums = instances.groupBy("kind", "pattern").agg(F.sum("worth").alias("_sum"), F.count_if("seed").alias("seeds"))
        scored = sums.join(values, "pattern").select(
            "kind", "pattern", "seeds", (F.col("_sum") / (F.col("all_values") + DOUBT)).alias("score")
        )
        scored = cut_lineage(scored.where(F.col("_sum") > 0))
        by_pattern = pairs.join(scored.where(F.col("seeds") >= SEEDS).select("kind", "pattern", "score"), ["kind", "pattern"])
        doubt = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-12))))
        worth = by_pattern.groupBy("kind", "value").agg((1 - F.exp(doubt)).alias("_w"))
        joined = pairs.join(worth, ["kind", "value"], "left")
        instances = joined.select(
            "kind", "pattern", "value", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("_w", F.lit(0.0))).alias("worth")
        )
    return scored.where((F.col("score") >= PATTERN_SCORE) & (F.col("seeds") >= SEEDS))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, base, found) of every row: spans (kind, start, stop) of the base patterns and those added."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    read = cut_lineage(rows.mapInPandas(_extract, ROW))
    marked = read.withColumn("_row", F.monotonically_increasing_id())
    flat = cut_lineage(marked.select("_row", F.explode("mentions").alias("m")).select("_row", "m.*"))
    strong = cut_lineage(strong_patterns(flat.select("kind", "seed", "value", "pattern"), rounds).select("kind", "pattern"))
    hits = flat.where(~F.col("seed")).join(bounded_broadcast(strong), ["kind", "pattern"], "left_semi")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = F.array_sort(F.collect_set(F.struct("start", (-F.col("stop")).alias("_s"), order.alias("_k"), "kind", "stop")))
    start = F.struct(F.lit(-1).alias("end"), F.slice(spans, 1, 0).alias("kept"))
    kept = F.aggregate(
        spans,
        start,
        lambda s, x: F.when(
            x["start"] >= s["end"], F.struct(x["stop"].alias("end"), F.concat(s["kept"], F.array(x)).alias("kept"))
        ).otherwise(s),
        lambda s: F.transform(s["kept"], lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))),
    )
    added = cut_lineage(hits.groupBy("_row").agg(kept.alias("found")))
    none = F.array().cast("array<struct<kind string, start int, stop int>>")
    return marked.join(bounded_broadcast(added), "_row", "left").select("doc_id", "base", F.coalesce("found", none).alias("found"))


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts per kind, the hash over the base spans, and all spans as text."""

    def joined(spans: Column) -> Column:
        order = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
        keyed = F.sort_array(F.transform(spans, lambda x: F.struct(order(x).alias("k"), x["start"].alias("a"), x["stop"].alias("b"), x["kind"].alias("n"))))
        return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["n"], x["a"].cast("string"), x["b"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "found")).alias("spans"),
    )


def redact(text: str, spans: list) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
        if s["start"] < at:
            if s["stop"] > at:  # the rest of an overlapping span goes, too
                at = s["stop"]
            continue
        out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = s["stop"]
    return "".join([*out, text[at:]])


@F.pandas_udf(StringType())
def redact_base(text: pd.Series) -> pd.Series:
    """Texts without the matches of the base patterns; for rows that no id tells apart."""

    def one(t: str | None) -> str | None:
        return None if t is None else redact(t, [{"kind": k, "start": a, "stop": b} for k, a, b in base_spans(t)])

    return text.map(one, na_action="ignore")


def redact_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col) of the documents that hold personal data, redacted. Ids must tell the documents apart; rows with equal id and text are one."""
    found = find_personal_data(docs, id_col, text_col)
    spans = found.select("doc_id", F.concat("base", "found").alias("spans")).where(F.size("spans") > 0)
    spans = cut_lineage(spans.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans")))
    # few documents hold some: only their texts move
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    texts = named.join(bounded_broadcast(spans.select("doc_id")), "doc_id", "left_semi").distinct()

    def blank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [redact(t, s) for t, s in zip(batch["text"], batch["spans"], strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts})

    joined = texts.join(spans, "doc_id").select("doc_id", "text", "spans")
    return joined.mapInPandas(blank, "doc_id long, text string").select(F.col("doc_id").alias(id_col), F.col("text").alias(text_col))
