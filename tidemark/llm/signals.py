"""Signals of text quality as Spark expressions, one projection over the whole text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that separates words (fixed values), as characters and as a class of a Java regular expression.
BLANKS = " \t\n\x0b\f\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"

#: Frequent words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in a is that for it was as with be by on at are this from or an "
    "de la le et les des en un une du que est pour dans qui au pas "
    "der die und den von zu das mit ein eine ist nicht im auf für als auch "
    "el los y las por con se del una su para es como"
).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, although ``body`` uses it more than once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, as an array; none for a null text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{BLANK_CLASS}+"))


def n_chars_of(text: Column, characters: str) -> Column:
    """How many of a text's characters are among ``characters``."""
    whole = F.coalesce(text, F.lit(""))
    return (F.length(whole) - F.length(F.translate(whole, characters, ""))).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(own: Column, k: int = 5) -> Column:
    """Words in ``k``-word windows that the text has twice or more, the first included.

    Windows are compared by 64-bit hash. Only texts in which a hash comes again pay for the rest:
    windows in the order of their hashes, those equal to a neighbour, and how many words these cover.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(own) - (k - 1)), lambda i: F.xxhash64(F.slice(own, i, F.lit(k))))

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-k).alias("last"))
        grow = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(k), i - acc["last"])).alias("n"), i.alias("last"))
        return F.aggregate(starts, first, grow, lambda acc: acc["n"])

    def repeated(windows: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(windows, j)["h"] == x["h"], F.lit(False))
        found = F.filter(windows, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return covered(F.array_sort(F.transform(found, lambda x: x["i"])))

    def counted(hashes: Column) -> Column:
        windows = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(windows, repeated))

    return F.when(F.size(own) <= k, F.lit(0).cast("long")).otherwise(let(hashes, counted))
