"""Near duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles, bands and verification.

A text is a weighted set of shingles of five lower-cased words. The weight is (1 + ln tf) times a smoothed inverse document
frequency between 1 - ``IDF_PART`` and 1. The frequency is a count over all documents in ``BUCKETS`` hash buckets: a table of fixed size whatever the
corpus, whose shares (not counts) decide, so it works alike at every size. The range is narrow on purpose: the
shingles of a large group of copies are frequent, and a wide range would let two words that differ outweigh a text that agrees.

1. Texts with equal words are one class from the start; only its smallest id goes on.
2. ICWS draws ``BANDS * ROWS`` samples per text: two texts agree in a sample with a probability equal to their weighted
   Jaccard similarity. ``ROWS`` samples make a band's key; a pair of similarity 0.8 misses all bands with probability
   (1 - 0.8^3)^14 < 5e-5. Pairs of neighbouring band keys make finer keys for the same texts.
3. A key's texts are not paired with each other: each is paired with the key's two leaders (least and greatest hash of id
   and band), found by a partial aggregation. Leaders differ from band to band, so a group's texts meet in many ways.
4. Pairs whose samples agree too rarely for the threshold are dropped (less than 1e-5 of the true ones). Each text's most
   alike partner is verified first, by the exact weighted Jaccard similarity of both texts; then all remaining pairs between different
   components. So members of a large group cost one comparison each.
5. A key whose texts are then still in different components may hold links that no leader meets (a crowd that shares a passage and no
   more). Its texts are dealt to blocks of at most about ``SIDE`` texts and ``SIDE_CHARS`` characters, and all blocks are compared with each other, exactly; of
   a component that holds most of the key, only with the other texts. So two texts that share a band's key are compared or in one component.
   Each two blocks hand on a forest at most, and each two components one link.
6. Connected components of the verified links are the classes. Later links join components, so only components enter the later rounds.

Cases: texts without words (null, empty, blank) are alone, even among themselves. Shorter texts than five words are one shingle. Rows with the same id
count as one document with equal texts, and as separate texts of one id otherwise (the id is then linked as a whole). A null id is left out. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.common import bound_batches, release
from urlrisk.llm.components import connected_components, merge_components
from urlrisk.llm.textarrays import chunks, mix, shingles, word_hashes
from urlrisk.operators.ordering import cut_lineage
from urlrisk.operators.skew import bounded_broadcast, lookup_join

THRESHOLD = 0.8
BANDS = 14
ROWS = 3
BUCKETS = 1 << 16
IDF_PART = 0.2
#: Texts and characters of a block within a key.
SIDE = 512
SIDE_CHARS = 1 << 19
#: Shingles in more texts of a group than this are multiplied as a matrix, the others paired.
FEW = 32
#: Pairs of texts that are compared at once.
PAIRS = 1 << 20
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def bucket_counts(docs: DataFrame) -> DataFrame:
    """(bucket, n): in how many documents the shingles of each hash bucket occur. At most ``BUCKETS`` rows leave a task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunks(texts):
                _, value, _ = shingles(texts[a:b])
                total += np.bincount((value >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    return docs.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def idf_table(docs: DataFrame) -> np.ndarray:
    """Weight of each bucket: 1 for buckets of the average share or less, down to 1 - IDF_PART for a bucket that holds everything."""
    counts = np.zeros(BUCKETS)
    rows = bucket_counts(docs).toArrow()  # at most BUCKETS rows
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    share = counts * BUCKETS / max(1.0, counts.sum())
    return (1 - IDF_PART * np.log(np.maximum(share, 1.0)) / math.log(BUCKETS)).astype(np.float32)


def weighted(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight)"""
    of, value, count = shingles(texts)
    return of, value, (1 + np.log(count)).astype(np.float32) * idf[(value >> np.uint64(48)).astype(np.int64)]


def icws(value: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Samples, one row per sampling function and one column per text; ``starts``: where each text's shingles begin."""
    out = np.empty((len(_SEEDS), len(starts)), np.uint64)
    log_w = np.log(weight)
    ends = np.append(starts[1:], len(value))
    lengths = ends - starts
    mask, scale, half = np.uint64((1 << 21) - 1), np.float32(2.0**-21), np.float32(2.0**-22)

    def unit(x: np.ndarray, shift: int) -> np.ndarray:
        return ((x >> np.uint64(shift)) & mask).astype(np.float32) * scale + half

    for h, seed in enumerate(_SEEDS):
        x = mix(value ^ seed)
        y = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        r = -np.log(unit(x, 1) * unit(x, 22))  # Gamma(2, 1)
        log_c = np.log(-np.log(unit(y, 1) * unit(y, 22)))
        beta = unit(y, 43)
        t = np.floor(log_w / r + beta)
        log_a = log_c - r * (t - beta) - r
        least = np.minimum.reduceat(log_a, starts)
        at = np.flatnonzero(log_a == np.repeat(least, lengths))
        first = at[np.searchsorted(at, starts)]
        out[h] = mix(value[first] ^ (t[first].astype(np.int64).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)) ^ seed)
    return out


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(doc_id, same, keys, samples, chars) of every document with words: ``same`` is equal for equal words, ``samples`` has 32 bits of each sample."""
    table = docs.sparkSession.sparkContext.broadcast(idf)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll = np.uint64(0xE7037ED1A0B428DB)
        for batch in batches:
            ids, all_texts = batch["doc_id"].to_numpy(), batch["text"].tolist()
            for a, b in chunks(all_texts):
                texts = all_texts[a:b]
                of, value, weight = weighted(texts, table.value)
                if not len(of):
                    continue
                docs_in, starts = np.unique(of, return_index=True)
                samples = icws(value, weight, starts)
                bands = samples.reshape(BANDS, ROWS, -1)
                keys = np.zeros((BANDS, len(docs_in)), np.uint64)
                for i in range(ROWS):
                    keys = mix(keys * roll + bands[:, i])
                keys = mix(keys + np.arange(BANDS, dtype=np.uint64)[:, None])
                fine = mix(keys * roll + np.roll(keys, -1, axis=0))
                every = np.concatenate([keys, fine]).T.view(np.int64)
                words, w_of = word_hashes(texts)
                # two polynomials over the words: 128 bits
                w_at = np.searchsorted(w_of, docs_in)
                order = (np.arange(len(w_of)) - np.searchsorted(w_of, w_of)).astype(np.uint64)
                one = np.add.reduceat(mix(words + order * roll), w_at)
                two = np.add.reduceat(mix((words ^ np.uint64(0x5DEECE66D)) * roll + order), w_at)
                low = (samples.T & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                yield pd.DataFrame(
                    {
                        "doc_id": ids[a:b][docs_in],
                        "same": [p.tobytes() + q.tobytes() for p, q in zip(one, two, strict=True)],
                        "keys": list(every),
                        "samples": [s.tobytes() for s in np.ascontiguousarray(low)],
                        "chars": [len(texts[i]) for i in docs_in],
                    }
                )

    return docs.select("doc_id", "text").mapInPandas(sign, "doc_id long, same binary, keys array<long>, samples binary, chars long")


def _pairs_alike(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """(a, b, alike): how many samples agree."""
    samples = signed.select("doc_id", "samples")
    one = samples.select(F.col("doc_id").alias("a"), F.col("samples").alias("sa"))
    two = samples.select(F.col("doc_id").alias("b"), F.col("samples").alias("sb"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = len(batch)
            sa = np.frombuffer(b"".join(batch["sa"]), np.int32).reshape(n, -1)
            sb = np.frombuffer(b"".join(batch["sb"]), np.int32).reshape(n, -1)
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "alike": (sa == sb).sum(axis=1)})

    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInPandas(compare, "a long, b long, alike int")


def verify(pairs: DataFrame, docs: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts have a weighted Jaccard similarity of at least ``threshold``, with it."""
    table = docs.sparkSession.sparkContext.broadcast(idf)
    ids = cut_lineage(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    texts = docs.select("doc_id", "text").join(bounded_broadcast(ids), "doc_id", "left_semi")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [t for pair in zip(batch["ta"], batch["tb"], strict=True) for t in pair]
            for a, b in chunks([both[i] + both[i + 1] for i in range(0, len(both), 2)]):
                of, value, weight = weighted(both[2 * a : 2 * b], table.value)
                pair = of >> 1
                order = np.lexsort((value, pair))
                pair, value, weight, of = pair[order], value[order], weight[order].astype(np.float64), of[order]
                same = np.zeros(len(pair), bool)
                same[1:] = (pair[1:] == pair[:-1]) & (value[1:] == value[:-1])
                at = np.flatnonzero(same)
                least = np.minimum(weight[at], weight[at - 1])
                common = np.bincount(pair[at], least, b - a)
                total = np.bincount(pair, weight, b - a)
                similar = common / np.maximum(total - common, 1e-9)
                yield pd.DataFrame({"a": batch["a"].to_numpy()[a:b], "b": batch["b"].to_numpy()[a:b], "similarity": similar})

    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    return joined.mapInPandas(compare, "a long, b long, similarity double").where(F.col("similarity") >= threshold)


def similarities(texts: list[str], sizes: np.ndarray, idf: np.ndarray) -> Iterator[np.ndarray]:
    """The weighted Jaccard similarities within each group as a square; ``sizes``: how many consecutive texts each group has."""
    parts = []
    for a, b in chunks(texts):
        of, value, count = shingles(texts[a:b])
        parts.append((of + a, value, count))
    of, value, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    inverse = idf[(value >> np.uint64(48)).astype(np.int64)].astype(np.float64)
    group_of = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    square = np.cumsum(sizes**2) - sizes**2
    weight = (1 + np.log(count)) * inverse
    total = np.bincount(of, weight, len(texts))
    group = group_of[of]
    order = np.lexsort((of, value, group))
    of, value, count, weight, group, inverse = (x[order] for x in (of, value, count, weight, group, inverse))
    new = np.ones(len(of), bool)
    new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
    run = np.cumsum(new) - 1
    often = np.bincount(run)[run] if len(run) else run
    place = of - first[group]
    common = np.zeros(int((sizes**2).sum()))
    low = np.flatnonzero((often > 1) & (often <= FEW))
    for step in range(1, FEW):
        i, j = low[:-step], low[step:]
        same = run[i] == run[j]
        i, j = i[same], j[same]
        if not len(i):
            break
        at = square[group[i]] + place[i] * sizes[group[i]] + place[j]
        common += np.bincount(at, np.minimum(weight[i], weight[j]), len(common))
    high = np.flatnonzero(often > FEW)
    edges = np.searchsorted(group[high], np.arange(len(sizes) + 1))
    for g, n in enumerate(sizes):
        out = common[square[g] : square[g] + n * n].reshape(n, n)
        mine = high[edges[g] : edges[g + 1]]
        if len(mine):
            # a shingle that occurs k times is k columns, so that products add up to the least weight
            level = np.arange(count[mine].sum()) - np.repeat(np.cumsum(count[mine]) - count[mine], count[mine])
            entry = np.repeat(mine, count[mine])
            _, column = np.unique(np.stack([run[entry], level]), axis=1, return_inverse=True)
            step = inverse[entry] * np.where(level > 0, np.log((level + 1) / np.maximum(level, 1)), 1.0)
            by_column = np.argsort(column, kind="stable")
            entry, column, step = entry[by_column], column[by_column], step[by_column]
            for begin in range(0, int(column[-1]) + 1, 1024):
                a, b = np.searchsorted(column, [begin, begin + 1024])
                dense = np.zeros((n, 1024))
                dense[place[entry[a:b]], column[a:b] - begin] = np.sqrt(step[a:b])
                out += np.triu(dense @ dense.T, 1)
        weights = total[first[g] : first[g] + n]
        yield out / np.maximum(weights[:, None] + weights[None, :] - out, 1e-9)


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """The places of the edges that join parts which the edges before them leave apart."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append(k)
    return out


def one_link_each(links: DataFrame) -> DataFrame:
    """Of the links (a, b, similarity, r, s) between the same two components r and s, the most alike."""
    best = F.max(F.struct("similarity", (-F.col("a")).alias("_a"), (-F.col("b")).alias("_b"), "a", "b")).alias("_l")
    return links.groupBy("r", "s").agg(best).select("_l.a", "_l.b", "_l.similarity", "r", "s")


def mixed_key_links(keyed: DataFrame, chosen: DataFrame, roots: DataFrame, docs: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """(a, b, similarity, r, s): links that join all components with a link inside a key; by comparison of all texts of the key. Keys of three
    texts or fewer are left out: leaders meet all of them. Each two blocks give a forest of links at most, and each two components r, s one link."""
    bands = keyed.where(F.col("band") < BANDS).select("key", "doc_id")
    root = roots.select(F.col("node").alias("doc_id"), "root")
    sized = chosen.select("doc_id", "chars").join(root, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    sized = cut_lineage(sized.groupBy("doc_id").agg(F.sum("chars").alias("chars"), F.min("root").alias("root")))
    members = bands.join(sized, "doc_id")
    counted = members.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("chars").alias("c"))
    keys = counted.groupBy("key").agg(
        F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum("c").alias("c"), F.max(F.struct("n", "c", "root")).alias("most")
    )
    keys = keys.where("roots > 1 and n > 3")
    blocks = lambda n, c: F.greatest(F.ceil(n / SIDE), F.ceil(c / SIDE_CHARS), F.lit(1)).cast("int")
    split = (F.col("most.n") * 2 > F.col("n")) & ((F.col("n") > SIDE) | (F.col("c") > SIDE_CHARS))
    keys = keys.select(
        "key",
        F.when(split, F.col("most.root")).alias("main"),
        F.when(split, blocks(F.col("n") - F.col("most.n"), F.col("c") - F.col("most.c"))).otherwise(blocks(F.col("n"), F.col("c"))).alias("others"),
        F.when(split, blocks(F.col("most.n"), F.col("most.c"))).otherwise(0).alias("mains"),
    )
    keys = cut_lineage(keys)
    dealt = members.join(bounded_broadcast(keys), "key")
    inside = F.col("root").eqNullSafe(F.col("main"))
    block = F.pmod(F.xxhash64("doc_id", "key"), F.when(inside, F.col("mains")).otherwise(F.col("others"))).cast("int")
    dealt = dealt.select("key", "doc_id", "root", "others", "mains", inside.alias("inside"), block.alias("block"))
    other = F.sequence(F.lit(0), F.col("others") - 1)
    pair = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    with_others = F.transform(other, lambda x: pair(F.least(x, F.col("block")), F.greatest(x, F.col("block"))))
    with_mains = F.transform(F.sequence(F.col("others"), F.col("others") + F.greatest("mains", F.lit(1)) - 1), lambda x: pair(F.col("block"), x))
    meets = F.when(F.col("inside"), F.transform(other, lambda x: pair(x, F.col("others") + F.col("block"))))
    meets = meets.when(F.col("mains") > 0, F.concat(with_others, with_mains)).otherwise(with_others)
    dealt = cut_lineage(dealt.select("key", "doc_id", "root", F.explode(meets).alias("p")).select("key", "p.lo", "p.hi", "doc_id", "root"))
    ids = cut_lineage(dealt.select("doc_id").distinct())
    texts = docs.select("doc_id", "text").join(bounded_broadcast(ids), "doc_id", "left_semi")
    group = ["key", "lo", "hi"]
    grouped = dealt.join(texts, "doc_id").select(*group, "doc_id", "root", "text").repartition(*group).sortWithinPartitions(*group)
    table = docs.sparkSession.sparkContext.broadcast(idf)

    def links(rows: pd.DataFrame, begin: np.ndarray) -> Iterator[pd.DataFrame]:
        sizes = np.diff(np.append(begin, len(rows)))
        size = rows["text"].str.len().to_numpy()
        pairs, chars = np.cumsum(sizes**2), np.cumsum(np.add.reduceat(size, begin))
        part = np.maximum.accumulate(np.maximum(pairs // PAIRS, chars // (2 * SIDE_CHARS)))
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(begin))
        ends = np.append(begin, len(rows))
        ids, root, all_texts = rows["doc_id"].to_numpy(), rows["root"].to_numpy(), rows["text"].tolist()
        for p, q in zip(cuts[:-1], cuts[1:], strict=True):
            for g, square in enumerate(similarities(all_texts[ends[p] : ends[q]], sizes[p:q], table.value), p):
                i, j = np.nonzero(square >= threshold)
                i, j, value = i + begin[g], j + begin[g], square[i, j]
                apart = (root[i] != root[j]) & (i < j)
                i, j, value = i[apart], j[apart], value[apart]
                best = np.argsort(-value, kind="stable")
                low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
                pick = best[forest(low[best], high[best])]
                if len(pick):
                    x, y = ids[i[pick]], ids[j[pick]]
                    columns = {"a": np.minimum(x, y), "b": np.maximum(x, y), "similarity": value[pick], "r": low[pick], "s": high[pick]}
                    yield pd.DataFrame(columns)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(rows):
                continue
            at = rows[group].to_numpy()
            begin = np.flatnonzero(np.append(True, (at[1:] != at[:-1]).any(axis=1)))
            # the last group may go on
            rest = rows.iloc[begin[-1] :]
            if len(begin) > 1:
                yield from links(rows.iloc[: begin[-1]], begin[:-1])
        if rest is not None:
            yield from links(rest, np.array([0]))

    return one_link_each(grouped.mapInPandas(compare, "a long, b long, similarity double, r long, s long"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, class_id, copy_of, links): the class's smallest id, the smallest id with equal words, and the number of links
    to other texts that hold the class together."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull())
    bound_batches(docs.sparkSession, 8 << 20)
    idf = idf_table(rows)
    signed = cut_lineage(signatures(rows, idf))
    # groups of copies only: other texts are their own first
    copied = signed.groupBy("same").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    members = lookup_join(signed.select("doc_id", "same"), cut_lineage(copied), ["same"])
    members = cut_lineage(members.select("doc_id", F.coalesce("_first", "doc_id").alias("first")).distinct())
    chosen = cut_lineage(signed.join(members.where("doc_id = first").select("doc_id"), "doc_id", "left_semi").drop("same"))
    release(docs.sparkSession)

    keyed = chosen.select("doc_id", F.posexplode("keys").alias("band", "key"))
    place = F.struct(F.xxhash64("doc_id", "band").alias("h"), F.col("doc_id").alias("d"))
    leaders = keyed.groupBy("band", "key").agg(F.min(place)["d"].alias("lo"), F.max(place)["d"].alias("hi")).where("lo <> hi")
    met = keyed.join(leaders, ["band", "key"]).select("doc_id", F.explode(F.array("lo", "hi")).alias("leader")).where("doc_id <> leader")
    pairs = cut_lineage(met.select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct())

    # fewer than five standard deviations below the expected number cannot be
    n = BANDS * ROWS
    least = math.floor(n * threshold - 4.8 * math.sqrt(n * threshold * (1 - threshold)))
    alike = cut_lineage(_pairs_alike(pairs, chosen).where(F.col("alike") >= least))
    # each text's best partner first
    best = alike.select(F.col("a").alias("x"), "a", "b", "alike").unionByName(alike.select(F.col("b").alias("x"), "a", "b", "alike"))
    best = best.groupBy("x").agg(F.max(F.struct("alike", -F.col("a"), "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    best = cut_lineage(best)
    links = cut_lineage(verify(best, rows, idf, threshold))
    release(docs.sparkSession)
    roots = connected_components(links)
    release(docs.sparkSession)
    rest = alike.join(best, ["a", "b"], "left_anti")
    ra = roots.select(F.col("node").alias("a"), F.col("root").alias("_ra"))
    rb = roots.select(F.col("node").alias("b"), F.col("root").alias("_rb"))
    sides = F.coalesce("_ra", "a"), F.coalesce("_rb", "b")
    rest = rest.join(ra, "a", "left").join(rb, "b", "left").select("a", "b", F.least(*sides).alias("r"), F.greatest(*sides).alias("s"))
    rest = cut_lineage(rest.where("r <> s"))
    more = cut_lineage(one_link_each(verify(rest.select("a", "b"), rows, idf, threshold).join(rest, ["a", "b"])))
    roots = merge_components(roots, more.select(F.col("r").alias("a"), F.col("s").alias("b")))
    release(docs.sparkSession)
    # keys whose texts are still apart
    mixed = cut_lineage(mixed_key_links(keyed, chosen, roots, rows, idf, threshold))
    release(docs.sparkSession)
    roots = merge_components(roots, mixed.select(F.col("r").alias("a"), F.col("s").alias("b")))
    links = links.unionByName(more.drop("r", "s")).unionByName(mixed.drop("r", "s"))

    # an id with different texts links them
    several = cut_lineage(members.groupBy("doc_id").agg(F.min("first").alias("a"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    if several.limit(1).count():
        same_id = members.join(bounded_broadcast(several), "doc_id").select("a", F.col("first").alias("b")).where("a <> b")
        top = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        for side in ("a", "b"):
            same_id = same_id.join(top, F.col(side) == F.col("_n"), "left").withColumn(side, F.coalesce("_r", side)).drop("_n", "_r")
        roots = merge_components(roots, same_id)
    degree = links.select(F.explode(F.array("a", "b")).alias("first")).groupBy("first").agg(F.count("*").alias("links"))
    copies = members.groupBy("doc_id").agg(F.min("first").alias("copy_of")).join(degree.withColumnRenamed("first", "copy_of"), "copy_of", "left")
    known = copies.join(roots, copies["copy_of"] == roots["node"], "left").select(
        "doc_id", F.coalesce("root", "copy_of").alias("root"), "copy_of", "links"
    )
    release(docs.sparkSession)
    out = rows.select("doc_id").distinct().join(known, "doc_id", "left")
    return out.select(
        "doc_id",
        F.coalesce("root", "doc_id").alias("class_id"),
        F.coalesce("copy_of", "doc_id").alias("copy_of"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
    )
