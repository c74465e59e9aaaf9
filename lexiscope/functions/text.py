"""Column expressions over text. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII letters come first in each class because they are tested fastest.
TERM_PATTERN = r"[\w\p{L}\p{N}][\w'\p{L}\p{N}]*+"


def word_count(text: Column, mode: str = "whitespace") -> Column:
    """Number of words as a bigint; an empty text has one word, a null text has null.

    ``whitespace`` splits on runs of white space, ``space`` on every single space.
    """
    if mode == "whitespace":
        # Depending on the session size() of null is -1, so nulls are handled below.
        words = F.size(F.split(text, r"\s+"))
    elif mode == "space":
        # Same value as size(split(text, ' ')) without building the array.
        words = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1
    else:
        raise ValueError(f"unknown word count mode: {mode!r}")
    return F.when(text.isNotNull(), words.cast("bigint"))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def terms(text: Column) -> Column:
    """Array of the words of a text: runs of letters, digits, underscores and inner apostrophes."""
    return F.regexp_extract_all(text, F.lit(TERM_PATTERN), F.lit(0))


def space_tokens(text: Column) -> Column:
    return F.split(text, " ")


def trigrams(text: Column) -> Column:
    """Array of all overlapping three-character runs, in order, in time linear in the text.

    The character after the lookahead is consumed so that a pair of surrogates counts as one.
    """
    return F.regexp_extract_all(text, F.lit("(?s)(?=(...))."), F.lit(1))


def characters(text: Column) -> Column:
    """Array of the characters of a text that isn't empty; a pair of surrogates is one."""
    return F.split(text, "")


def trigram_at(chars: Column, position: Column) -> Column:
    """The trigram that starts at a position of an array of characters, lower-cased, or null."""
    return F.lower(F.concat(*[F.get(chars, position + i) for i in range(3)]))


def pieces(text: Column, size: int, overlap: int) -> Column:
    """Cut a text into pieces starting at multiples of ``size`` characters.

    Each piece also holds the first ``overlap`` characters of what follows it, so that no run of
    ``overlap + 1`` characters is lost at a boundary.
    """
    pattern = f"(?s)(?=(.{{1,{size + overlap}}}+)).{{1,{size}}}+"
    whole = F.length(text) <= size  # one piece; this pattern is several times faster
    return F.regexp_extract_all(text, F.when(whole, F.lit("(?s)(.+)")).otherwise(F.lit(pattern)), F.lit(1))


def strip_space(text: Column) -> Column:
    """Remove all leading and trailing white space, not only spaces."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def hash_order(key: Column, seed: int) -> Column:
    """A seeded pseudo-random sort key that is the same in every run and partitioning.

    A null key has one of its own, which no other value has.
    """
    marked = F.coalesce(F.concat(F.lit(":"), key.cast("string")), F.lit("?"))
    return F.md5(F.concat(F.lit(f"{seed}"), marked))


def hash_bucket(key: Column, seed: int, buckets: int) -> Column:
    """A seeded bucket number in ``[0, buckets)``, from 32 bits of the hash of the key."""
    bits = F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("bigint")
    return bits % F.lit(buckets)
