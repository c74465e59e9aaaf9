"""Passages of benchmark items in documents, found by spaced seeds, with words substituted.

A text is the sequence of its words: runs of letters and digits, in lower case. A leak is a stretch
of ``window`` neighbouring words of a document that stand beside as many neighbouring words of an
item with at most ``substitutions`` of them unequal. Fixed masks look at some of the words of such
a stretch and ignore the others; the masks are chosen so that, wherever the substitutions are, one
of them meets none somewhere in the stretch (``is_lossless`` proves it for any choice). Hashes of
the words under a mask are joined between items and documents, and around every hit the two texts
are held against each other word by word, so a hit by chance costs little and counts for nothing.

Items with fewer words than the window count when a document holds all their words in a row. Up to
``RUN`` words the hash of the whole item at every place tells that; of longer ones the first ``RUN``
words give hits like a mask.

All is built-in expressions. Defined results: null and empty texts hold no leak; rows of the same
id and text are reported once; a null id is reported as null; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.arrow import free_names
from lexiscope.sources.shared import write_and_reread

WINDOW = 13
SUBSTITUTIONS = 2
#: places of the words that a mask looks at
MASKS = ((0, 2, 3, 6, 8, 9), (0, 1, 4, 6, 7, 10))
SHORTEST = 1  # items without words are in no document
RUN = 5  # neighbouring words hashed for items shorter than the window
NO_ID = -(2**63)
BROADCAST_ROWS = 500_000  # of at most 40 bytes each


def is_lossless(
    masks: Sequence[Sequence[int]], window: int = WINDOW, substitutions: int = SUBSTITUTIONS
) -> bool:
    """Whether some mask finds a stretch untouched, for every choice of substituted places."""
    places = [
        {start + offset for offset in mask}
        for mask in masks
        for start in range(window - mask[-1])
    ]
    return all(
        any(not place & set(touched) for place in places)
        for touched in combinations(range(window), substitutions)
    )


def _words(text: Column) -> Column:
    found = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(found, lambda word: word != "")


def _coded(table: DataFrame, key: str, text: str) -> DataFrame:
    """Each different text with its id, as an array of hashes of its words."""
    return table.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text).alias("version"),
        F.transform(_words(F.col(text)), lambda word: F.xxhash64(word)).alias("words"),
    )


def _under(mask: Sequence[int], number: int, length: Column) -> Column:
    """Hash of the words under a mask at every place it fits."""
    places = F.sequence(F.lit(0), length - 1 - mask[-1])
    hashes = F.transform(
        places,
        lambda at: F.xxhash64(F.lit(number), *[F.get("words", at + offset) for offset in mask]),
    )
    return F.when(length > mask[-1], hashes).otherwise(F.array().cast("array<bigint>"))


def _seeds(coded: DataFrame, masks: Sequence[Sequence[int]]) -> DataFrame:
    """One row for each mask and place: ``mask``, ``at`` and ``seed``."""
    length = F.size("words")
    hashes = [_under(mask, number, length) for number, mask in enumerate(masks)]
    rows = coded.select(
        "id", "version", length.alias("length"), F.posexplode(F.concat(*hashes)).alias("at", "seed")
    )
    # the places of the masks follow one another
    begins: Column = F.lit(0)
    number: Column = F.lit(0)
    start: Column = F.lit(0)
    for index, mask in enumerate(masks):
        number = F.when(F.col("at") >= begins, index).otherwise(number)
        start = F.when(F.col("at") >= begins, begins).otherwise(start)
        begins = begins + F.greatest(F.lit(0), F.col("length") - mask[-1])
    return rows.select("id", "version", number.alias("mask"), (F.col("at") - start).alias("at"), "seed")


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _leaks(window: int, substitutions: int) -> tuple[Column, Column]:
    """Equal words (``same``) and places in a leak, for an item laid beside a text at ``shift``."""
    d, i = F.size("words"), F.size("item_words")
    first = F.greatest(F.lit(0), F.col("shift"))
    last = F.least(d, i + F.col("shift"))  # the first place after the overlap
    same = F.transform(
        F.sequence(first, last - 1),
        lambda at: F.when(
            F.get("words", at) == F.get("item_words", at - F.col("shift")), 1
        ).otherwise(0),
    )
    size = F.least(F.lit(window), i)
    allowed = F.when(i < window, 0).otherwise(substitutions)
    starts = F.filter(
        F.sequence(first, last - size),
        lambda at: F.aggregate(
            F.slice(F.col("same"), at - first + 1, size), F.lit(0), lambda total, one: total + one
        )
        >= size - allowed,
    )
    places = F.flatten(F.transform(starts, lambda at: F.sequence(at, at + size - 1)))
    return same, F.when(last - first >= size, F.array_distinct(places)).otherwise(
        F.array().cast("array<int>")
    )


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    substitutions: int = SUBSTITUTIONS,
    masks: Sequence[Sequence[int]] = MASKS,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row for each document and item that share a passage.

    ``doc_id``, ``version`` (a hash of the text), ``item_id``, and the words of the document that
    lie in the passage: the first, the last and how many.
    """
    if not is_lossless(masks, window, substitutions):
        raise ValueError("these masks would miss some leaks")
    items = write_and_reread(
        _coded(benchmark, item_key, item_text).distinct().filter(F.size("words") >= SHORTEST),
        "items",
    )
    run = F.least(F.size("words"), F.lit(RUN)).alias("run")
    runs = sorted(r.run for r in items.filter(F.size("words") < window).select(run).distinct().collect())
    used = [*masks, *[tuple(range(n)) for n in runs]]
    # short items have no use for the spaced masks, nor long ones for the others
    fitting = (F.col("length") >= window) & (F.col("mask") < len(masks))
    for number, size in enumerate(runs, len(masks)):
        has_run = (F.col("length") < window) & (F.least("length", F.lit(RUN)) == size)
        fitting |= has_run & (F.col("mask") == number)
    lengths = items.select("id", "version", F.size("words").alias("length"))
    item_seeds = (
        _seeds(items, used)
        .join(lengths, ["id", "version"])
        .filter(fitting)
        .select(
            F.col("id").alias("item"),
            F.col("version").alias("item_version"),
            F.col("at").alias("item_at"),
            # words of an item that one hash covers whole
            F.when((F.col("length") < window) & (F.col("length") <= RUN), F.col("length")).alias("covered"),
            "seed",
        )
    )
    stored = write_and_reread(item_seeds, "item-seeds")
    hits = (
        _seeds(_coded(docs, key, text), used)
        .join(_small(stored), "seed")
        .select(
            "id", "version", "item", "item_version", "covered",
            (F.col("at") - F.col("item_at")).alias("shift"),
        )
        .distinct()
    )
    met = write_and_reread(hits, "hits")
    # nothing is left to compare, so the text is not laid beside each of many places
    whole = met.filter(F.col("covered").isNotNull()).select(
        "id", "version", "item",
        F.sequence(F.col("shift"), F.col("shift") + F.col("covered") - 1).alias("places"),
    )
    hits = met.filter(F.col("covered").isNull()).drop("covered")
    owners = hits.select("id", "version").distinct()
    marked = docs.select(
        F.col(key).alias("id_of"),
        F.col(text).alias("text_of"),
        F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text).alias("version"),
    )
    owning = marked.join(_small(owners), ["id", "version"], "left_semi")
    texts = _coded(owning.select("id_of", "text_of"), "id_of", "text_of").distinct()
    sides = items.select(
        F.col("id").alias("item"), F.col("version").alias("item_version"), F.col("words").alias("item_words")
    )
    laid = texts.join(hits, ["id", "version"]).join(_small(sides), ["item", "item_version"])
    same, places = _leaks(window, substitutions)
    found = laid.withColumn("same", same).withColumn("places", places).filter(F.size("places") > 0)
    return (
        found.select("id", "version", "item", "places")
        .unionAll(whole)
        .groupBy("id", "version", "item")
        .agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"))
        .select(
            F.nullif("id", F.lit(NO_ID)).alias("doc_id"),
            "version",
            F.nullif("item", F.lit(NO_ID)).alias("item_id"),
            F.array_min("places").cast("bigint").alias("first_word"),
            F.array_max("places").cast("bigint").alias("last_word"),
            F.size("places").cast("bigint").alias("n_words"),
        )
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """The documents that hold no passage of any item, with all their columns."""
    key, text = names.get("key", "doc_id"), names.get("text", "text")
    row, version = free_names(docs, "__id", "__version")
    leaking = find_leaks(docs, benchmark, **names).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias(row), F.col("version").alias(version)
    )
    marked = docs.withColumns(
        {row: F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)), version: F.xxhash64(text)}
    )
    return marked.join(leaking.distinct(), [row, version], "left_anti").select(*docs.columns)
