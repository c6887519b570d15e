"""Substring deduplication by sliding sentence spans.

A text is cut into sentences (at . ! ? and line ends; a sentence of more than ``LONGEST`` words into pieces of that many). From every
sentence the shortest run of at least ``LEAST`` sentences and ``WORDS`` words starts, and one ends at every sentence, so a repeated
passage is covered by whole runs up to its last sentence. Runs are hashed (64 bits, over lower-cased words) and joined globally: the first occurrence
of a run is the one with the smallest document id and place; the sentences of all other occurrences are removed.

1. A count per hash, partly summed before the shuffle, tells which runs occur again. Their hashes become a bit table (about ``BITS`` bits
   each, at most ``MOST_BITS`` in all; a fuller table lets more runs through, which the next step drops).
2. The runs are made again and only those in the table leave the tasks. A grouped minimum finds the first occurrence of each, and a
   join by hash the others; hot hashes are split by Spark. A passage that a third of all documents hold costs its rows and no pairs.
3. Only documents that lose something meet their spans by a join (while a count shows that their ids are few); the others pass.

Cases: null and empty texts stay as they are. Rows with the same id count as one document if they are equal, and all keep their text then. A null id
may be a first occurrence but its own text stays. Ties cannot occur: id and place are unique. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.common import bound_batches
from urlrisk.operators.ordering import cut_lineage
from urlrisk.operators.skew import bounded_broadcast

LEAST = 2
WORDS = 20
LONGEST = 30
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?=\s|$)|[.!?]+[^\s.!?\n][^.!?\n]*)*(?:[.!?]+(?=\s|$)|\n|$)")
WORD = re.compile(r"\S+")
RUNS = "hash long, doc_id long, start int, stop int"
BITS = 16
MOST_BITS = 1 << 28
CHUNK_WORDS = 8192


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-cased words) of every sentence with a word."""
    out = []
    for m in SENTENCE.finditer(text):
        words = m[0].lower().split()
        if len(words) <= LONGEST:
            if words:
                out.append((m.start(), m.end(), words))
            continue
        found = [(m.start() + w.start(), m.start() + w.end()) for w in WORD.finditer(m[0])]
        for i in range(0, len(found), LONGEST):
            part = found[i : i + LONGEST]
            out.append((part[0][0], part[-1][1], [text[a:b].lower() for a, b in part]))
    return out


def runs(text: str) -> set[tuple[int, int, int]]:
    """(hash, start, stop) in characters of all runs of the text."""
    parts = sentences(text)
    n = len(parts)
    total = [0]
    for _, _, words in parts:
        total.append(total[-1] + len(words))
    spans = set()
    j = 0
    for i in range(n):
        j = max(j, i + LEAST)
        while j < n and total[j] - total[i] < WORDS:
            j += 1
        if j > n or total[j] - total[i] < WORDS:
            break
        spans.add((i, j))
    i = n
    for j in range(n, 0, -1):
        i = min(i, j - LEAST)
        while i > 0 and total[j] - total[i] < WORDS:
            i -= 1
        if i < 0 or total[j] - total[i] < WORDS:
            break
        spans.add((i, j))
    joined = [" ".join(words) for _, _, words in parts]
    return {
        (xxhash.xxh64_intdigest(" ".join(joined[i:j])) - (1 << 63), parts[i][0], parts[j - 1][1]) for i, j in spans
    }


def _runs_of(bits: Broadcast | None):
    """Task function: the runs of all texts, or those whose hash is in the bit table."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs, hashes, starts, stops = [], [], [], []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                found = runs(text)
                docs += [doc] * len(found)
                for h, a, b in found:
                    hashes.append(h)
                    starts.append(a)
                    stops.append(b)
            out = pd.DataFrame({"hash": hashes, "doc_id": docs, "start": starts, "stop": stops}).astype("int64")
            if bits is not None:
                table = np.frombuffer(bits.value, np.uint8)
                at = out["hash"].to_numpy().astype(np.uint64) & np.uint64(len(table) * 8 - 1)
                out = out[(table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            yield out if bits is not None else out[["hash"]]

    return emit


def bit_table(hashes: DataFrame) -> bytes:
    """A bit for each hash (column ``hash``) by its lower bits; at most ``MOST_BITS`` bits."""
    n = hashes.count()
    size = max(CHUNK_WORDS * 64, min(MOST_BITS, 1 << math.ceil(math.log2(max(1, n) * BITS))))
    at = F.col("hash").bitwiseAND(F.lit(size - 1))
    words = hashes.groupBy(F.shiftright(at, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("bits")
    )

    def pack(chunk: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(CHUNK_WORDS, np.int64)
        out[chunk["word"].to_numpy() % CHUNK_WORDS] = chunk["bits"].to_numpy()
        return pd.DataFrame({"chunk": [chunk["word"].iloc[0] // CHUNK_WORDS], "bytes": [out.tobytes()]})

    chunks = words.groupBy((F.col("word") / CHUNK_WORDS).cast("long")).applyInPandas(pack, "chunk long, bytes binary")
    table = bytearray(size // 8)
    for r in chunks.collect():  # the table, which is bounded
        table[r["chunk"] * CHUNK_WORDS * 8 : (r["chunk"] + 1) * CHUNK_WORDS * 8] = r["bytes"]
    return bytes(table)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the character spans of runs that are not the first of their kind, of the documents that have some. ``docs``: doc_id, text."""
    rows = docs.select("doc_id", "text").where("doc_id is not null")
    every = rows.mapInPandas(_runs_of(None), "hash long")
    often = cut_lineage(every.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    table = docs.sparkSession.sparkContext.broadcast(bit_table(often))
    found = cut_lineage(rows.mapInPandas(_runs_of(table), RUNS))
    firsts = found.groupBy("hash").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = found.join(firsts.select("hash", "first"), "hash").where(F.struct("doc_id", "start") != F.col("first"))
    return again.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))


def without(text: str, spans: list) -> tuple[str, int, list[tuple[int, int]]]:
    """The text without the spans, their number of characters and the merged spans."""
    merged: list[list[int]] = []
    for s in spans:
        a, b = s["start"], s["stop"]
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    kept, at = [], 0
    for a, b in merged:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return "".join(kept), sum(b - a for a, b in merged), [(a, b) for a, b in merged]


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, removed_chars, spans) of every row; ``spans`` are the removed character ranges."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bound_batches(docs.sparkSession)
    spans = cut_lineage(repeated_spans(rows.where("text is not null")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [without(t, s) if t is not None else (t, 0, []) for t, s in zip(batch["text"], batch["spans"], strict=True)]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "text": [d[0] for d in done],
                    "removed_chars": [d[1] for d in done],
                    "spans": [[{"start": a, "stop": b} for a, b in d[2]] for d in done],
                }
            )

    result = "doc_id long, text string, removed_chars long, spans array<struct<start int, stop int>>"
    ids = bounded_broadcast(spans.select("doc_id"))
    changed = rows.join(ids, "doc_id", "left_semi").join(spans, "doc_id").select("doc_id", "text", "spans").mapInPandas(cut, result)
    same = rows.join(ids, "doc_id", "left_anti").select(
        "doc_id", "text", F.lit(0).cast("long").alias("removed_chars"), F.array().cast("array<struct<start int, stop int>>").alias("spans")
    )
    return changed.unionByName(same)
