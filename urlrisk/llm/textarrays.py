"""Texts of a batch as arrays: code points, word hashes, weighted shingles. Pure numpy, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Words of a shingle.
SHINGLE = 5
#: Characters that are worked on at once.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_ROLL = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)

_tables: dict[str, np.ndarray] = {}


def lower_table() -> np.ndarray:
    """Code point to lower-case code point; 32 for white space; 0 stays."""
    if "lower" not in _tables:
        out = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            low = chr(c).lower()
            if len(low) == 1:
                out[c] = ord(low)
            elif low:
                out[c] = ord(low[0])
            if c > 0xFFFF and c > 0x1FFFF:
                break
        out[[9, 10, 11, 12, 13]] = 32
        _tables["lower"] = out
    return _tables["lower"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("pow", ())) < n:
        size = max(n, CHUNK + 1)
        with np.errstate(over="ignore"):
            for name, base in (("pow", _BASE), ("inv", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _tables[name] = np.cumprod(steps)
    return _tables["pow"], _tables["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after the other, and where each text starts (one more entry than texts)."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer(joined, np.uint32), starts


def chunks(texts: Sequence[str], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` characters; a longer text stands alone."""
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield begin, i
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (separated by blanks, tabs and line ends) and the text of each."""
    points, starts = code_points(texts)
    n = len(points)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = lower_table()[points]
    word = low != 32
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~word[:-1]
    first = np.flatnonzero(word & (before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~word[1:]
    last = np.flatnonzero(word & (after | edge[1:])) + 1
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(low.astype(np.uint64) * power[:n], out=sums[1:])
    hashed = mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
    return hashed, np.searchsorted(starts, first, "right") - 1


def shingles(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of five words, as (text, hash, count) in the order of text and hash. A shorter text with a word is
    one shingle."""
    words, of = word_hashes(texts)
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        total += words[i : n - SHINGLE + 1 + i] * _ROLL[i] if n >= SHINGLE else np.uint64(0)
    whole = of[: n - SHINGLE + 1] == of[SHINGLE - 1 :] if n >= SHINGLE else np.zeros(0, bool)
    doc, value = of[: n - SHINGLE + 1][whole] if n >= SHINGLE else np.zeros(0, np.int64), total[whole]
    counts = np.bincount(of, minlength=len(texts))
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        at = np.searchsorted(of, short)
        extra = np.zeros(len(short), np.uint64)
        for i in range(SHINGLE - 1):
            has = counts[short] > i
            extra[has] += words[at[has] + i] * _ROLL[i]
        doc, value = np.concatenate([doc, short]), np.concatenate([value, extra])
    value = mix(value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.append(at, len(doc)))
