"""Edit distances between names and a fixed list of words, for a whole Arrow batch at once.

Names repeat (many URLs share a domain), so each distinct name of a batch is compared once, and one numpy step takes one letter of a word for all names.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# ship the functions of this module with the job, so executors do not need the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Stands between the spellings of a row on their way to Python; URLs hold no control characters.
BETWEEN = "\0"
NEAREST_TYPE = pa.struct([("distance", pa.int32()), ("nearest", pa.string()), ("misspelt", pa.list_(pa.string()))])
#: Cells (names times their longest length) compared at once.
BLOCK_CELLS = 1 << 19


def _block_distances(names: Sequence[str], words: Sequence[str]) -> np.ndarray:
    """Distance of each name (row) to each word (column); names are padded to one length, and each is read off at its own end."""
    ends = np.array([len(n) for n in names])
    width = int(ends.max())
    padded = "".join(n.ljust(width, "\0") for n in names).encode("utf-32-le", "surrogatepass")
    letters = np.frombuffer(padded, "<u4").reshape(len(names), width)
    steps = np.arange(width + 1, dtype=np.int32)
    out = np.empty((len(names), len(words)), np.int32)
    for k, word in enumerate(words):
        row = np.tile(steps, (len(names), 1))
        for i, letter in enumerate(word, 1):
            cur = np.empty_like(row)
            cur[:, 0] = i
            np.minimum(row[:, 1:] + 1, row[:, :-1] + (letters != ord(letter)), out=cur[:, 1:])
            # a step to the right costs one: the smallest of all cells to the left plus their way
            row = np.minimum.accumulate(cur - steps, axis=1) + steps
        out[:, k] = row[np.arange(len(names)), ends]
    return out


def edit_distances(names: Sequence[str], words: Sequence[str], block_cells: int = BLOCK_CELLS) -> np.ndarray:
    """Edit distances in code points, one row per name and one column per word; worked on in blocks of names of similar length."""
    out = np.zeros((len(names), len(words)), np.int32)
    block: list[int] = []
    for i in sorted(range(len(names)), key=lambda i: len(names[i])):
        if block and (len(block) + 1) * (len(names[i]) + 1) > block_cells:
            out[block] = _block_distances([names[k] for k in block], words)
            block = []
        block.append(i)
    if block:
        out[block] = _block_distances([names[k] for k in block], words)
    return out


def nearest_words(words: Sequence[str], shortest: Mapping[int, int]) -> Callable[[Column], Column]:
    """A column function from an array of spellings to a struct: ``distance`` is the smallest of any spelling to any word, ``nearest`` the first
    word at that distance, ``misspelt`` the words whose own distance is a key of ``shortest`` and that are at least that long. Null for null or no spellings.
    """
    words = list(dict.fromkeys(words))
    lengths = np.array([len(w) for w in words])

    @F.arrow_udf("distance int, nearest string, misspelt array<string>")
    def nearest(joined: pa.Array) -> pa.Array:
        groups = joined.dictionary_encode()
        # URLs of one domain have the same spellings: each distinct list is compared once, and each distinct name of all lists
        lists = [text.split(BETWEEN) for text in groups.dictionary.to_pylist()]
        if not lists:
            return pa.StructArray.from_arrays([pa.nulls(len(joined), field.type) for field in NEAREST_TYPE], fields=list(NEAREST_TYPE))
        codes, names = pd.factorize(np.array([name for spellings in lists for name in spellings], object))
        starts = np.cumsum([0, *map(len, lists[:-1])])
        found = np.minimum.reduceat(edit_distances(list(names), words)[codes], starts, axis=0)
        near = np.zeros(found.shape, bool)
        for distance, least in shortest.items():
            near |= (found == distance) & (lengths >= least)
        misspelt = [[words[k] for k in np.flatnonzero(row)] for row in near]
        known = [found.min(axis=1), [words[k] for k in found.argmin(axis=1)], misspelt]
        columns = [pa.array(values, field.type).take(groups.indices) for values, field in zip(known, NEAREST_TYPE, strict=True)]
        return pa.StructArray.from_arrays(columns, fields=list(NEAREST_TYPE))

    return lambda spellings: nearest(F.when(F.size(spellings) > 0, F.array_join(spellings, BETWEEN)))
