"""Spelling variants against a comparison of all pairs."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from urlrisk.llm import spelling

LOW = str.maketrans(spelling.UPPER, spelling.UPPER.lower())


def runs_of(text):
    run = ""
    for c in (text or "") + "\0":
        if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
            run += c
        elif run:
            yield run
            run = ""


def brute_words(docs):
    for doc_id, text in docs:
        for run in runs_of(text):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            yield w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    out = {}
    for w, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= 2 * n else None
        out[w] = [form, None, n, len(near), counts[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {(w, *v) for w, v in out.items()}


def rows(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_texts_end_to_end(spark):
    rng = random.Random(7)
    base = ["straße", "größer", "letter", "lettre", "élève", "house", "mouse", "ça", "banana"]
    docs = []
    for i in range(60):
        words = [rng.choice(base) for _ in range(80)]
        words = [w if rng.random() < 0.8 else w[:2] + rng.choice("aeßÿ") + w[3:] for w in words]
        docs.append((i, rng.choice([" ", "-", "\n", "1"]).join(w.upper() if rng.random() < 0.2 else w for w in words)))
    docs += [(None, "no id here house house house"), (61, None), (62, ""), (63, " \t"), (63, "twice twice"), (63, "twice twice"), (64, "ab" * 30_000)]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id long, text string, n long, word string")
    counts = {w: n for w, n in Counter(brute_words(docs)).items() if len(w) >= 5 and n >= 3}
    assert len(counts) > 25
    assert rows(spelling.spelling_variants(df)) == brute_variants(counts)


@pytest.mark.parametrize("crowd", [1, 3, 1000])
def test_crowded_groups_go_to_finer_levels(spark, crowd):
    """Words of few letters share reduced words; every size of a crowd gives all pairs, once each way."""
    rng = random.Random(crowd)
    counts = {}
    while len(counts) < 160:
        counts["".join(rng.choice("aeä" if rng.random() < 0.8 else "xyz") for _ in range(rng.choice((5, 6))))] = rng.choice((3, 3, 6, 12, 30))
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = sorted((a, b) for a in counts for b in counts if one_edit(a, b))
    found = spelling.near_words(df, crowd=crowd)
    assert sorted((r["word"], r["other"]) for r in found.collect()) == want
    assert rows(spelling.group_variants(df, crowd=crowd)) == brute_variants(counts)


def test_chains_and_ties(spark):
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "cdefg": 3, "cdefh": 6, "cdefi": 6, "zzzzz": 5}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = rows(spelling.group_variants(df))
    assert got == brute_variants(counts)
    assert {r[2] for r in got if r[0].startswith("aa")} == {"abbbb"}
    assert ("cdefg", "cdefh", "cdefh", 3, 2, 6) in got


def test_empty_vocabulary(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(docs).count() == 0


def test_neighbourhood_is_full(spark):
    got = spark.range(1).select(spelling.neighbourhood(F.lit("aba"), 4).alias("n")).first()["n"]
    symbols = sorted({spelling.symbol_of(c, 4) for c in spelling.LETTERS})
    want = {"aba", "ba", "aa", "ab"}
    for i in range(3):
        want |= {"aba"[:i] + s + "aba"[i + 1 :] for s in symbols}
    for i in range(4):
        want |= {"aba"[:i] + s + "aba"[i:] for s in symbols}
    assert sorted(got) == sorted(want)
