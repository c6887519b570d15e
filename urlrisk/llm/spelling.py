"""Spelling variants of a vocabulary, by reduced-alphabet generation.

Letters are hashed to a few symbols, so that many words share one reduced word. For each distinct reduced word the full one-edit
neighbourhood is generated (itself, all deletions, replacements and insertions over the few symbols) and joined with the reduced vocabulary;
two words that differ by one edit have reduced words that are equal or one edit apart, so no pair is lost. The words behind
linked reduced words are then compared as they are written. Few symbols keep a neighbourhood small but fill the groups of words that share a
reduced word: groups of more than ``CROWD`` words, and the words linked to them, are reduced anew with more symbols, down to all letters, where every word is
alone. So no group is collected beyond ``CROWD`` words, and no pair is skipped.

Each word points to its form, the near word that occurs most often, if that occurs at least twice as often. Forms are followed by pointer
jumping; occurrences at least double with each step, so chains are short.

Cases: a null text has no words; a null id stands as an empty text in the hash. Repeated rows count repeatedly. Of near words that occur equally often the smallest in
code-point order is the form. An empty table gives an empty result; other columns are not read. Letters are a-z (after lower-casing A-Z) and U+00C0 to U+00FF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.operators.ordering import cut_lineage
from urlrisk.operators.skew import bounded_broadcast, lookup_join

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUN = r"[A-Za-zÀ-ÿ]+"
LETTERS = UPPER.lower() + "".join(map(chr, range(0xC0, 0x100)))
#: One run in so many loses a letter.
DAMAGED = 97
SHORTEST = 5
RAREST = 3
#: Symbols per level; the last level keeps all letters apart.
SYMBOLS = (4, 8, 16, 32, len(LETTERS))
CROWD = 256


def damaged_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word) of every run of letters; of every run whose hash is divisible by ``DAMAGED`` one letter is deleted."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(RUN), F.lit(0))).alias("_run")
    )
    low = runs.select("_id", F.translate("_run", UPPER, UPPER.lower()).alias("_w"))
    hashed = low.select("_w", F.crc32(F.concat("_id", F.lit(":"), "_w").cast("binary")).alias("_h"))
    at = (F.col("_h") % F.length("_w")).cast("int")
    shorter = F.concat(F.substr("_w", F.lit(1), at), F.substr("_w", at + 2))
    return hashed.select(F.when(F.col("_h") % DAMAGED == 0, shorter).otherwise(F.col("_w")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= rarest)


def symbol_of(letter: str, symbols: int) -> str:
    """The symbol that a letter is hashed to; with a symbol for each letter, the letter itself."""
    return letter if symbols >= len(LETTERS) else LETTERS[(ord(letter) * 2654435761 >> 7) % symbols]


def reduced(word: Column, symbols: int) -> Column:
    return F.translate(word, LETTERS, "".join(symbol_of(c, symbols) for c in LETTERS))


def neighbourhood(word: Column, symbols: int) -> Column:
    """All strings over the symbols within one edit of ``word``, itself included."""
    alphabet = F.array(*[F.lit(s) for s in sorted({symbol_of(c, symbols) for c in LETTERS})])
    places = F.sequence(F.lit(0), F.length(word))  # before each letter, and at the end
    inside = F.slice(places, 1, F.length(word))
    left = lambda i: F.substr(word, F.lit(1), i)
    deleted = F.transform(inside, lambda i: F.concat(left(i), F.substr(word, i + 2)))
    replaced = F.flatten(F.transform(inside, lambda i: F.transform(alphabet, lambda s: F.concat(left(i), s, F.substr(word, i + 2)))))
    inserted = F.flatten(F.transform(places, lambda i: F.transform(alphabet, lambda s: F.concat(left(i), s, F.substr(word, i + 1)))))
    return F.array_distinct(F.concat(F.array(word), deleted, replaced, inserted))


def near_words(words: DataFrame, levels: Sequence[int] = SYMBOLS, crowd: int = CROWD) -> DataFrame:
    """(word, other, other_n), both ways, of all words that differ by exactly one edit. ``words``: distinct word, and n."""
    found = None
    # bit k of _mask: the word's group was too large at level k, so its pairs are left to a later level
    rest = words.select("word", "n", F.lit(0).alias("_mask"))
    for k, symbols in enumerate(levels):
        rest = rest.withColumn("_r", reduced(F.col("word"), symbols))
        groups = cut_lineage(rest.groupBy("_r").agg(F.count("*").alias("_m")).select("_r", F.xxhash64("_r").alias("_key"), "_m"))
        # reduced words of equal hash share a group
        sizes = groups.groupBy("_key").agg(F.sum("_m").alias("_m"))
        full = F.col("_m") > (crowd if k + 1 < len(levels) else 1 << 62)
        sized = cut_lineage(sizes.select(F.col("_key").alias("_near"), full.alias("_full")))
        around = groups.select("_key", F.explode(neighbourhood(F.col("_r"), symbols)).alias("_n")).select(
            "_key", F.xxhash64("_n").alias("_near")
        )
        own = sized.select(F.col("_near").alias("_key"), F.col("_full").alias("_own_full"))
        links = around.join(bounded_broadcast(sized), "_near").distinct().join(bounded_broadcast(own), "_key")
        links = cut_lineage(links)
        keyed = rest.select("word", "n", "_mask", F.xxhash64("_r").alias("_key"))
        some_full = sized.where("_full").limit(1).count() > 0
        calm = keyed
        if some_full:
            calm = keyed.join(bounded_broadcast(own.where(~F.col("_own_full")).select("_key")), "_key", "left_semi")
        lists = calm.groupBy("_key").agg(F.collect_list(F.struct("word", "n", "_mask")).alias("_words"))  # at most ``crowd`` each
        lists = cut_lineage(lists)
        open_links = links.where(~F.col("_full") & ~F.col("_own_full")).select("_key", "_near")
        left = open_links.join(lists, "_key").select("_near", F.col("_words").alias("_left"))
        right = lists.select(F.col("_key").alias("_near"), F.col("_words").alias("_right"))
        one = left.join(right, "_near").select(F.explode("_left").alias("_a"), "_right").select("_a", F.explode("_right").alias("_b"))
        fresh = F.col("_a._mask").bitwiseOR(F.col("_b._mask")) == (1 << k) - 1
        pairs = one.where(fresh & (F.levenshtein("_a.word", "_b.word", 1) == 1))
        pairs = pairs.select(F.col("_a.word").alias("word"), F.col("_b.word").alias("other"), F.col("_b.n").alias("other_n"))
        found = pairs if found is None else found.unionByName(pairs)
        if not some_full:
            break
        # on to the next level: full groups and all that is linked to one
        onward = links.where("_full or _own_full").groupBy("_key").agg(F.max("_own_full").alias("_own_full"))
        rest = keyed.join(bounded_broadcast(onward), "_key").select(
            "word", "n", F.when(F.col("_own_full"), F.col("_mask").bitwiseOR(F.lit(1 << k))).otherwise(F.col("_mask")).alias("_mask")
        )
        rest = cut_lineage(rest)
    return found


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that the forms lead to. ``forms``: word and form, without circles."""
    roots = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumped = cut_lineage(lookup_join(roots, onward, ["root"]).select("word", "root", "_next"))
        roots = jumped.select("word", F.coalesce("_next", "root").alias("root"))
        if not jumped.where("_next is not null").limit(1).count():
            return roots


def group_variants(words: DataFrame, levels: Sequence[int] = SYMBOLS, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (distinct word, n)."""
    words = cut_lineage(words.select("word", F.col("n").cast("long").alias("n")))
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("word"))).alias("_best")
    near = near_words(words, levels, crowd).groupBy("word").agg(F.count("*").alias("n_near"), best)
    strong = -F.col("_best.m") >= 2 * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("_best.word")).alias("form"),
        F.when(strong, -F.col("_best.m")).alias("form_n"),
    )
    judged = cut_lineage(judged)
    roots = follow_forms(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variants of the words of all texts."""
    return group_variants(vocabulary(damaged_words(docs, id_col, text_col)))
