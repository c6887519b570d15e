"""Quality rules whose cutoffs carry a guarantee: labelled holdouts and exact binomial bounds.

Each rule compares two whole numbers of a document, and has a fixed list of cutoffs, mild to strict. For every
stratum (language), rule and cutoff, the labelled good documents of the stratum that pass the base rules are a sample
of n, of which the cutoff would reject k. If the true rate of false rejections were above ``alpha`` over the number of
rules, k or fewer of n would have at most the probability P(Bin(n, alpha/rules) <= k). A cutoff is certified if that
is at most ``delta`` over the number of all tests (strata x rules x cutoffs, Bonferroni). The strictest certified cutoff
counts, if all milder ones are certified too; without one, the rule is off in that stratum. So with probability 1 - delta, in every stratum the rules
together reject at most ``alpha`` of the good documents. The cutoffs are fixed beforehand, so no label is used twice.

Only DataFrame functions; windows of eight words are compared by 64-bit hashes within one document.

Cases: null and empty texts have no words and fail the base rules. A null stratum is a stratum of its own. A document
with several labels is good only if all say so; labels of unknown documents count for nothing. Without labels (empty
table) no cutoff is certified and only the base rules act. Repeated rows are kept. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.common import SPACE, words_of
from urlrisk.operators.ordering import cut_lineage
from urlrisk.operators.skew import bounded_broadcast

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rule name, left side, right side; a document is rejected if left * 1000 > cutoff * right. Cutoffs from mild to strict.
RULES: dict[str, tuple[str, str, tuple[int, ...]]] = {
    "symbols": ("n_symbols", "word_chars", (500, 300, 200, 100, 50, 20)),
    "dup_lines": ("n_dup_lines", "n_lines", (800, 600, 400, 200, 100)),
    "repeats": ("n_repeat_words", "n_words", (250, 200, 150, 100, 50)),
    "long_words": ("word_chars", "n_words", (20000, 15000, 12000, 10000)),
    "short_words": ("n_words", "word_chars", (900, 700, 500, 400)),
}
ALPHA = 0.05
DELTA = 0.05


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACE))) > 0)
    parts = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(stratum_col).alias("stratum"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        words_of(text).alias("_words"),
    )
    words = F.col("_words")
    n = F.size(words)
    spots = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    hashed = parts.select(
        "doc_id",
        "stratum",
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        n.cast("long").alias("n_words"),
        F.transform(spots, lambda i: F.xxhash64(F.slice(words, i, WINDOW))).alias("_at"),
    )
    at = F.col("_at")
    # most texts repeat no window: only the others are sorted
    repeats = F.size(F.array_distinct(at)) < F.size(at)
    in_order = F.when(repeats, F.sort_array(F.transform(at, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ordered = hashed.withColumn("_in_order", in_order).drop("_at")
    o = F.col("_in_order")
    found = F.filter(
        o, lambda x, k: (x["h"] == F.get(o, k - 1)["h"]) | (x["h"] == F.get(o, k + 1)["h"])
    )
    places = ordered.withColumn("_places", F.sort_array(F.transform(found, lambda x: x["i"]))).drop("_in_order")
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).cast("long").alias("n")),
        lambda s: s["n"],
    )
    counted = places.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_places")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1: Stirling's series, moved up by 8."""
    y = x + 8.0
    shift = sum((F.log(x + float(i)) for i in range(1, 8)), F.log(x))
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k): the term of k by its logarithm, the lower ones from it in turn. 1 where k is above n p
    (no test passes there). Terms more than 40 standard deviations below k add nothing."""
    n, k = n.cast("double"), k.cast("double")
    first = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    terms = F.least(k, F.ceil(40 * F.sqrt(n * p * (1 - p))) + 10).cast("int")
    steps = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, i: F.struct(
            (a["t"] * (k - i + 1) * (1 - p) / ((n - k + i) * p)).alias("t"),
            (a["s"] + a["t"] * (k - i + 1) * (1 - p) / ((n - k + i) * p)).alias("s"),
        ),
        lambda a: a["s"],
    )
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(first) * tail)


def _rejects(rule: str, cutoff: Column) -> Column:
    left, right, _ = RULES[rule]
    return F.col(left) * 1000 > cutoff * F.col(right)


def certified_cutoffs(counted: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with labelled good documents: ``n_good`` and the cutoff of every rule, null where none holds."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("_q")).where("_q = 1").select("doc_id")
    held = counted.where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    tests = [(rule, i, c) for rule, (_, _, cutoffs) in RULES.items() for i, c in enumerate(cutoffs)]
    sums = held.groupBy("stratum").agg(
        F.count("*").alias("n_good"),
        *[F.count_if(_rejects(rule, F.lit(c))).alias(f"_k_{rule}_{i}") for rule, i, c in tests],
    )
    sums = cut_lineage(sums)
    strata = sums.count()
    level = delta / max(1, strata * len(tests))
    rate = alpha / len(RULES)

    def chosen(rule: str) -> Column:
        cutoffs = RULES[rule][2]
        holds = [binomial_tail(F.col("n_good"), F.col(f"_k_{rule}_{i}"), rate) <= level for i in range(len(cutoffs))]
        out = F.lit(None).cast("long")
        for i in reversed(range(len(cutoffs))):  # a later one counts only if the earlier ones hold
            out = F.when(holds[i], F.coalesce(out, F.lit(cutoffs[i]).cast("long")))
        return out

    return sums.select("stratum", "n_good", *[chosen(rule).alias(f"_c_{rule}") for rule in RULES])


def apply_quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    alpha: float = ALPHA,
    delta: float = DELTA,
) -> DataFrame:
    """Counts of every document, ``base_failed``, ``kept`` and ``failed_rules`` (names, base rules not among them).
    ``labels`` has doc_id and quality (1 good)."""
    counted = cut_lineage(text_counts(docs, id_col, text_col, stratum_col))
    cutoffs = cut_lineage(certified_cutoffs(counted, labels.select("doc_id", "quality"), alpha, delta))
    right = bounded_broadcast(cutoffs.withColumnRenamed("stratum", "_stratum"))
    joined = counted.join(right, counted["stratum"].eqNullSafe(right["_stratum"]), "left")
    names = F.array(*[F.when(_rejects(rule, F.col(f"_c_{rule}")), F.lit(rule)) for rule in RULES])
    failed = F.array_compact(names)
    return joined.select(
        *counted.columns, failed.alias("failed_rules"), (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept")
    )
