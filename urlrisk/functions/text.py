"""Column helpers for strings: character counts, entropy, tokens, rounding."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_LENGTH = 200  # fixed value: length of the character sequence of a URL
# fixed values: what counts as white space at the ends of URLs, keys and patterns
WHITESPACE = "".join(
    [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680)]
    + [chr(c) for c in range(0x2000, 0x200B)]
    + [chr(c) for c in (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
)
PAD, UNKNOWN, LAST_CODE = 0, 1, 126  # fixed values: padding, unknown character, last mapped code point


def strip(col: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def literal_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def regex_union(words: Iterable[str]) -> str:
    """Alternation of literal words."""
    return "(?:" + "|".join(r"\Q" + w + r"\E" for w in words) + ")"


def count_text(col: Column, piece: str) -> Column:
    """Number of occurrences of one character."""
    return F.length(col) - F.length(F.replace(col, F.lit(piece), F.lit("")))


def count_class(col: Column, negated_class: str) -> Column:
    """Number of characters left after dropping everything in ``negated_class``."""
    return F.length(F.regexp_replace(col, negated_class, ""))


def half_even(num: Column, den: Column, digits: int) -> Column:
    """``num / den`` rounded half-even; 0 when the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(F.bround(num / den, digits))


def entropy(col: Column) -> Column:
    """Shannon entropy of the characters in bits, rounded to 4 digits; 0 for an empty string.

    Sorting the characters puts equal ones side by side, and a back-reference cuts the runs. With run lengths k
    the entropy is log2(n) - sum(k * log2(k)) / n.
    """
    n = F.length(col)
    ordered = F.array_join(F.sort_array(F.split(col, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1+"), F.lit(0))  # runs of one add nothing
    weighted = F.aggregate(runs, F.lit(0.0), lambda acc, run: acc + F.length(run) * F.log2(F.length(run)))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.round(F.abs(F.log2(n) - weighted / n), 4))


def non_empty(parts: Column) -> Column:
    return F.array_remove(parts, "")


def char_tokens(col: Column, length: int = TOKEN_LENGTH) -> Column:
    """Fixed-length sequence of character codes: code point + 1 for 1..126, else 1; padded with 0."""
    head = F.substring(col, 1, length)
    codes = F.transform(
        F.when(head == "", F.array().cast("array<string>")).otherwise(F.split(head, "")),
        lambda c: F.when(F.ascii(c).between(1, LAST_CODE), F.ascii(c) + 1).otherwise(F.lit(UNKNOWN)),
    )
    return F.slice(F.concat(codes, F.array_repeat(F.lit(PAD), length)), 1, length)
