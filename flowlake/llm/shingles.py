"""Word shingles as Column expressions (JVM side only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that separate words: space, tab, line ends, vertical tab, form feed.
BLANKS = " \t\n\x0b\f\r"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, wherever ``use`` repeats it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blank_words(text: Column) -> Column:
    """Lower-cased words between blanks; an empty array for null and for blank texts."""
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))
    return let(bare, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[\\x20\\x09-\\x0D]+")))


def letter_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, so marks around a word do not matter."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", "")
    return let(bare, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[^\\p{L}\\p{N}]+")))


def shingle_hashes(words: Column, width: int = 5) -> Column:
    """64-bit hashes of the distinct windows of ``width`` words; fewer words are one window; no words, none."""

    def windows(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0)))
        hashed = F.transform(places, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(width))))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(hashed))

    return let(words, windows)
