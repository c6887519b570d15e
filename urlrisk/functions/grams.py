"""Character n-grams of a whole Arrow batch as numbers, and their order by rarity.

A gram of letters below 2047 (for five letters) is packed into its number, so equal numbers are equal grams; other grams are known by 59 bits of a hash.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# ship the functions of this module with the job, so executors do not need the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Grams are counted in so many hash buckets.
BUCKETS = 1 << 22
#: Bits of a gram's number; its level of frequency stands above them.
PAYLOAD = 60
MOST_LEVEL = 7
#: Characters that are split at once.
CHARS = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_of(gram: np.ndarray) -> np.ndarray:
    return (mixed(gram.astype(np.uint64)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def text_grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram): the distinct grams of each text, sorted; a text of fewer than ``n`` letters is its only gram."""
    codes = np.frombuffer(("".join(texts) + "\0").encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.array([len(t) for t in texts], np.int64)
    windows = np.maximum(lengths - n + 1, 1)
    of = np.repeat(np.arange(len(texts)), windows)
    place = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin, length = (np.cumsum(lengths) - lengths)[of], lengths[of]
    bits = (PAYLOAD - 1) // n
    packed, hashed = np.zeros(len(of), np.uint64), np.zeros(len(of), np.uint64)
    wide = np.zeros(len(of), bool)
    for k in range(n):
        letter = np.where(place + k < length, codes[np.minimum(begin + place + k, len(codes) - 1)] + np.uint64(1), np.uint64(0))
        wide |= letter >= np.uint64(1 << bits)
        packed = (packed << np.uint64(bits)) | letter
        hashed = mixed(hashed * np.uint64(0x9E3779B97F4A7C15) + letter + np.uint64(1))
    gram = np.where(wide, np.uint64(1 << (PAYLOAD - 1)) | (hashed >> np.uint64(64 - PAYLOAD + 1)), packed).astype(np.int64)
    order = np.lexsort((gram, of))
    of, gram = of[order], gram[order]
    new = np.append(True, (of[1:] != of[:-1]) | (gram[1:] != gram[:-1]))
    return of[new], gram[new]


def _lists(of: np.ndarray, values: np.ndarray, n_texts: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.searchsorted(of, np.arange(n_texts + 1)).astype(np.int32), values)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of a column of lists, none of which is empty."""
    sizes = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy()


def split_texts(n: int):
    """(t, is_left) to (t, is_left, grams)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").to_pylist()
            part = np.cumsum([len(t) for t in texts]) // CHARS
            cuts = np.flatnonzero(np.diff(part)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
                if a < b:
                    columns = [batch.column("t")[a:b], batch.column("is_left")[a:b], _lists(*text_grams(texts[a:b], n), b - a)]
                    yield pa.RecordBatch.from_arrays(columns, ["t", "is_left", "grams"])

    return split


def _starts(of: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, of[1:] != of[:-1]))


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grams) to (bucket, n): in how many texts the grams of each bucket occur."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        if len(batch):
            at, n = np.unique(bucket_of(_flat(batch.column("grams"))[1]), return_counts=True)
            total[at] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def levels(bucket: np.ndarray, n: np.ndarray, rare: int) -> np.ndarray:
    """Level of each bucket: 0 for at most ``rare`` occurrences, one more for each four times as many."""
    out = np.zeros(BUCKETS, np.uint8)
    often = n > rare
    out[bucket[often]] = np.minimum(1 + np.log2(n[often] / rare) / 2, MOST_LEVEL).astype(np.uint8)
    return out


# --- families of texts ---------------------------------------------------------------------------------------


def _outlines(of: np.ndarray, gram: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text a hash of its top grams and its size; and which grams are top (``top``: a flag for each bucket)."""
    is_top = top[bucket_of(gram)]
    starts = _starts(of)
    total = np.add.reduceat(np.where(is_top, mixed(gram.astype(np.uint64) ^ np.uint64(0xA0761D6478BD642F)), np.uint64(0)), starts)
    return mixed(total + np.bincount(of).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64), is_top


def outlines(table):
    """(grams) to (outline, m, top, n): the distinct outlines (top grams and size) of the texts, and how many texts have them; ``outline`` is their hash."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            of, gram = _flat(batch.column("grams"))
            outline, is_top = _outlines(of, gram, table.value)
            value, at, n = np.unique(outline, return_index=True, return_counts=True)
            place = np.full(len(batch), -1)
            place[at] = np.arange(len(at))
            held = is_top & (place[of] >= 0)
            by = np.argsort(place[of[held]], kind="stable")
            sets = _lists(place[of[held]][by], gram[held][by], len(at))
            m = np.bincount(of)[at].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(m), sets, pa.array(n)], ["outline", "m", "top", "n"])

    return found


def families(m: np.ndarray, top: list[np.ndarray], threshold: float, chunk: int = 2048) -> np.ndarray:
    """Number of each outline's family. Two texts can only be similar if their common top grams and the rest of the smaller one are enough; families are the components of that."""
    n = len(m)
    size = np.array([len(t) for t in top], np.int64)
    of = np.repeat(np.arange(n), size)
    grams, at = np.unique(np.concatenate([np.zeros(0, np.int64), *top]), return_inverse=True)
    common = np.zeros((n, n), np.float32)
    for a in range(0, len(grams), chunk):
        here = (at >= a) & (at < a + chunk)
        held = np.zeros((n, chunk), np.float32)
        held[of[here], at[here] - a] = 1
        common += held @ held.T
    rest = m - size
    able = common + np.minimum(rest[:, None], rest[None, :]) >= (m[:, None] + m[None, :]) * (threshold / (1 + threshold)) - 1e-6
    able &= np.minimum(m[:, None], m[None, :]) >= np.maximum(m[:, None], m[None, :]) * threshold - 1e-6
    np.fill_diagonal(able, True)
    family, left = np.full(n, -1), np.ones(n, bool)
    for k in range(n):
        if left[k]:
            reached = np.zeros(n, bool)
            edge = np.array([k])
            while len(edge):
                reached[edge] = True
                edge = np.flatnonzero(able[edge].any(axis=0) & ~reached)
            family[reached] = k
            left &= ~reached
    return family


def packed_families(top: np.ndarray, outline: np.ndarray, family: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(top, outline, family, size) to be broadcast: the family of each outline, and how many texts each family has."""
    by = np.argsort(outline)
    return top, outline[by], family[by], np.bincount(family, n).astype(np.int64)


def _family_of(families: tuple[np.ndarray, ...], of: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The family of each text; without outlines all are one."""
    top, outline, family, _ = families
    return family[np.searchsorted(outline, _outlines(of, gram, top)[0])] if len(outline) else np.zeros(of[-1] + 1, np.int64)


def _key(gram: np.ndarray, family: np.ndarray) -> np.ndarray:
    return mixed(gram.astype(np.uint64) ^ (family.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def _slot(key: np.ndarray) -> np.ndarray:
    return (key & np.uint64(BUCKETS - 1)).astype(np.int64)


def count_in_families(table, rare: int):
    """(grams) to (family, gram, n, size). Family -1: ``gram`` is a bucket of (family, gram), which is in ``n`` texts. Others: ``n`` texts of the family have the gram,
    out of batches in which all its texts have it; so a sum of ``size``, the texts of the family, means that all texts of the family have it. Only families of more than ``rare`` texts are told."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["family", "gram", "n", "size"]
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            of, gram = _flat(batch.column("grams"))
            text_family = _family_of(table.value, of, gram)
            family = text_family[of]
            key, at, n = np.unique(_key(gram, family), return_index=True, return_counts=True)
            np.add.at(total, _slot(key), n)
            here, size = np.bincount(text_family), table.value[3]
            at_family = family[at]
            every = (n == here[at_family]) & (size[at_family] > rare)
            told = [at_family[every], gram[at[every]], n[every], size[at_family[every]]]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in told], names)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), -1)), pa.array(at), pa.array(total[at]), pa.array(np.zeros(len(at), np.int64))], names)

    return count


def packed_shared(family: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, gram, family) to be broadcast: the grams that all texts of a family have."""
    key = _key(gram, family)
    by = np.argsort(key)
    return key[by], gram[by], family[by]


def _is_shared(shared: tuple[np.ndarray, ...], key: np.ndarray, gram: np.ndarray, family: np.ndarray) -> np.ndarray:
    if not len(shared[0]):
        return np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(shared[0], key), len(shared[0]) - 1)
    return (shared[1][at] == gram) & (shared[2][at] == family)


#: Stands for all grams that the texts of a family share; the last one in the order.
SHARED = (MOST_LEVEL << PAYLOAD) | ((1 << PAYLOAD) - 1)


def order_grams(table):
    """(t, is_left, grams) to the same with the text's ``family`` and with grams of the level table put before the number, in that order; ``SHARED`` stands for all grams that
    the whole family has, which are 1 + ``more``. The text has ``m`` grams, ``r`` of them rare (level 0). ``b1`` and ``b2`` are the parities of the grams in 128 hash buckets,
    ``f1`` and ``f2`` those of the frequent ones: no more of them differ than grams do. All without the shared ones."""

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shared, level_of = table.value
        for batch in batches:
            if not len(batch):
                continue
            n = len(batch)
            of, gram = _flat(batch.column("grams"))
            m = np.bincount(of)
            text_family = _family_of(known, of, gram)
            family = text_family[of]
            key = _key(gram, family)
            every = _is_shared(shared, key, gram, family)
            n_shared = np.bincount(of, every, n).astype(np.int64)
            of, gram, key = of[~every], gram[~every], key[~every]
            level = level_of[_slot(key)].astype(np.int64)
            often = level > 0
            rare = np.bincount(of, ~often, n).astype(np.int32)
            bit = mixed(gram.astype(np.uint64) ^ np.uint64(0x5DEECE66D)) & np.uint64(127)
            one = np.where(bit < 64, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
            two = np.where(bit < 64, np.uint64(0), np.uint64(1) << (bit & np.uint64(63)))

            def parity(x: np.ndarray) -> pa.Array:
                out = np.zeros(n, np.uint64)
                if len(of):
                    out[of[_starts(of)]] = np.bitwise_xor.reduceat(x, _starts(of))
                return pa.array(out.view(np.int64))

            holds = np.flatnonzero(n_shared > 0)
            all_of = np.concatenate([of, holds])
            value = np.concatenate([gram | (level << PAYLOAD), np.full(len(holds), SHARED)])
            by = np.lexsort((value, all_of))
            none = np.uint64(0)
            columns = {
                "t": batch.column("t"),
                "is_left": batch.column("is_left"),
                "family": pa.array(text_family.astype(np.int32)),
                "grams": _lists(all_of[by], value[by], n),
                "more": pa.array(np.maximum(n_shared - 1, 0).astype(np.int32)),
                "m": pa.array(m.astype(np.int32)),
                "r": pa.array(rare),
                "b1": parity(one),
                "b2": parity(two),
                "f1": parity(np.where(often, one, none)),
                "f2": parity(np.where(often, two, none)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return order
