"""Benchmark decontamination by the q-gram lemma, diagonal bands and banded alignment.

Texts and benchmark items are lower-cased and their runs of white space and punctuation become one blank. An item of
more than ``WINDOW`` characters is cut into windows that overlap by half, and into short ones of ``SHORT`` characters, one at every ``STRIDE``: a
leaked passage of ``SHORT`` + ``STRIDE`` - 1 = 71 characters holds a whole one wherever it starts. Shorter items
are searched whole. A window of m characters that occurs in a text with at most k = ``EDITS`` m edits shares at least m - q + 1 - k q q-grams with it (q-gram lemma), on diagonals (place in the text minus place in the window) at most k apart. So the shared q-grams are
counted in bands of 2k diagonals that overlap by k and only bands that reach the bound are aligned, in a band around their diagonals.

Q-grams of all texts of a batch are rolled as arrays and looked up in the benchmark's, so the cost per character is a few array
operations. The benchmark is the stated query set: its index is broadcast, in blocks of at most ``INDEX_CHARS`` characters
(more items are more passes, each exact). Documents are only mapped, never shuffled.

Cases: null and empty texts and items hold nothing; an item that has fewer than q characters after cleaning names no text. Repeated items
are found under each id; a null id is not reported. Repeated rows are kept. Without items no document is contaminated. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.common import bound_batches
from urlrisk.llm.textarrays import chunks, code_points, lower_table, mix

Q = 12
WINDOW = 128
SHORT = 64
STRIDE = 8
EDITS = 0.06
INDEX_CHARS = 4_000_000
_B = 0x9E3779B97F4A7C15 | 1

_tables: dict[str, np.ndarray] = {}


def _clean_table() -> np.ndarray:
    """Lower case; everything that is neither letter nor digit is a blank."""
    if "clean" not in _tables:
        low = lower_table().copy()
        low[[i for i in range(0x3000) if not chr(i).isalnum()]] = 32
        low[0] = 0
        _tables["clean"] = low
    return _tables["clean"]


def clean(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cleaned code points of all texts, a 0 before each, and where each starts (behind its 0)."""
    points, starts = code_points([t.replace("\0", " ") for t in texts])
    marked = np.insert(_clean_table()[points], starts[:-1], 0) if len(texts) else np.zeros(0, np.uint32)
    blank = marked == 32
    drop = np.zeros(len(marked), bool)
    drop[1:] = blank[1:] & ((marked[:-1] == 32) | (marked[:-1] == 0))
    kept = marked[~drop]
    return kept, np.flatnonzero(kept == 0) + 1


def qgrams(points: np.ndarray) -> np.ndarray:
    """Hash of the Q code points from each place."""
    if len(points) < Q:
        return np.zeros(0, np.uint64)
    a = points.astype(np.uint64)
    power = [pow(_B, e, 1 << 64) for e in (1, 2, 4)]
    two = a[:-1] * np.uint64(power[0]) + a[1:]
    four = two[:-2] * np.uint64(power[1]) + two[2:]
    eight = four[:-4] * np.uint64(power[2]) + four[4:]
    return mix(eight[: len(a) - Q + 1] * np.uint64(power[2]) + four[8 : 8 + len(a) - Q + 1])


@dataclass
class Index:
    """Windows of a block of items and their q-grams in the order of hash."""

    item: np.ndarray  # of each window
    patterns: list[np.ndarray]
    budget: np.ndarray  # edits
    bound: np.ndarray  # shared q-grams
    grams: np.ndarray  # distinct hashes
    first: np.ndarray  # where each hash's entries start (one more)
    window: np.ndarray  # entries
    place: np.ndarray
    seen: np.ndarray  # bit table of the hashes' upper bits
    shift: int


def build_index(items: Sequence[tuple[int, str]]) -> Index:
    owner, patterns = [], []
    for item, text in items:
        points, _ = clean([text])
        points = points[1:]
        if len(points) and points[-1] == 32:
            points = points[:-1]
        for size, stride in ((WINDOW, WINDOW // 2), (SHORT, STRIDE)) if len(points) > WINDOW else ((WINDOW, WINDOW),):
            at = 0
            while len(points) - at >= Q:
                stop = min(at + size, len(points))
                begin = max(0, stop - size)  # the last window is whole, too
                owner.append(item)
                patterns.append(points[begin:stop])
                if stop == len(points):
                    break
                at += stride
    sizes = np.array([len(p) for p in patterns], np.int64)
    budget = np.minimum(np.floor(EDITS * sizes).astype(np.int64), (sizes - Q) // Q) if len(sizes) else sizes
    hashes = [qgrams(p) for p in patterns]
    counts = [len(h) for h in hashes]
    all_hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    window = np.repeat(np.arange(len(patterns)), counts)
    place = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, np.int64)
    order = np.argsort(all_hashes, kind="stable")
    grams, first = np.unique(all_hashes[order], return_index=True)
    bits = max(16, int(np.ceil(np.log2(max(1, len(grams)) * 64))))
    seen = np.zeros(1 << bits, bool)
    seen[(grams >> np.uint64(64 - bits)).astype(np.int64)] = True
    return Index(
        np.array(owner, np.int64), patterns, budget, sizes - Q + 1 - budget * Q, grams, np.append(first, len(all_hashes)), window[order], place[order], seen, 64 - bits
    )


def best_distance(pattern: np.ndarray, region: np.ndarray) -> int:
    """Fewest edits that turn the pattern into some part of the region."""
    row = np.zeros(len(region) + 1, np.int64)
    steps = np.arange(len(region) + 1)
    for i, c in enumerate(pattern):
        new = np.empty_like(row)
        new[0] = i + 1
        np.minimum(row[:-1] + (region != c), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def find_items(texts: Sequence[str], index: Index) -> list[list[int]]:
    """The items of which a window occurs in each text."""
    found: list[set[int]] = [set() for _ in texts]
    if not len(index.grams):
        return [[] for _ in texts]
    points, starts = clean(texts)
    hashes = qgrams(points)
    maybe = np.flatnonzero(index.seen[(hashes >> np.uint64(index.shift)).astype(np.int64)])
    gram = np.searchsorted(index.grams, hashes[maybe])
    gram[gram == len(index.grams)] = 0
    hit = index.grams[gram] == hashes[maybe]
    at, gram = maybe[hit], gram[hit]
    # a row for each entry of the gram
    n = index.first[gram + 1] - index.first[gram]
    entry = np.repeat(index.first[gram] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else n
    at = np.repeat(at, n)
    window, diagonal = index.window[entry], at - index.place[entry]
    text = np.searchsorted(starts, at, "right") - 1
    wide = np.maximum(index.budget[window], 1)
    band = diagonal // wide
    # bands [b w, b w + 2 w): each hit counts in two of them; k + 1 diagonals from anywhere fit into one
    keys = [(text, window, band), (text, window, band - 1)]
    text, window, band = (np.concatenate(x) for x in zip(*keys, strict=True))
    if not len(text):
        return [[] for _ in texts]
    order = np.lexsort((band, window, text))
    text, window, band = text[order], window[order], band[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (window[1:] != window[:-1]) | (band[1:] != band[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(text)))
    good = count >= index.bound[window[begin]]
    ends = np.append(starts[1:] - 1, len(points))
    for i in begin[good]:
        t, w = int(text[i]), int(window[i])
        item = int(index.item[w])
        if item in found[t]:
            continue
        pattern, k = index.patterns[w], int(index.budget[w])
        low = int(band[i]) * max(k, 1)
        region = points[max(starts[t], low - k) : min(ends[t], low + 2 * max(k, 1) + len(pattern) + k)]
        if best_distance(pattern, region) <= k:
            found[t].add(item)
    return [sorted(f) for f in found]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(doc_id, items): every row of ``docs`` and the benchmark items of which it holds a window, in order."""
    spark = docs.sparkSession
    bound_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0  # one number
    blocks = max(1, -(-size // INDEX_CHARS))
    names = F.array().cast("array<long>").alias("items")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), names)
    for block in range(blocks):
        # a block of the stated query set, of INDEX_CHARS characters on average
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text").collect()
        index = spark.sparkContext.broadcast(build_index([(r["item"], r["text"]) for r in part]))
        last = block == blocks - 1

        def find(batches: Iterator[pd.DataFrame], index=index, last=last) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts = batch["text"].tolist()
                found: list[list[int]] = []
                for a, b in chunks(texts):
                    found += find_items(texts[a:b], index.value)
                both = [sorted({*new, *old}) for new, old in zip(found, batch["items"], strict=True)]
                out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "items": both})
                yield out if last else out.assign(text=texts)

        rows = rows.mapInPandas(find, "doc_id long, items array<long>" + ("" if last else ", text string"))
    return rows.select("doc_id", "items")
