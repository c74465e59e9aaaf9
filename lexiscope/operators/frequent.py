"""The most frequent rows of a very large table of counts, and of rows that aren't counted yet.

Heavy hitters are found by a Misra-Gries summary: every task keeps a bounded number of counters, and
summaries are merged. Spark's sketch of frequent items is one. What it says of an item is never less
than the true count and too much by at most a known share of all rows, so an item that is frequent
enough can't be missing. Exact counts are then needed of the few items it names, not of all.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS_PER_DOUBLING = 8
TRACKED = 196_608  # counters of a summary; with them the map of a sketch has 2 ** 18 places
MERGED_FIRST = 256  # summaries that the last task merges


def most_frequent(counts: DataFrame, n: str, limit: int, *ties: str) -> DataFrame:
    """The ``limit`` rows with the greatest ``n``, a positive count, in order; ties by ``ties``.

    Sorting and limiting alone would send ``limit`` rows of every partition to one task. So a
    histogram of the counts, of a few hundred rows at most, first tells which counts are certainly
    too small; little more than ``limit`` rows then reach the sort. ``counts`` is read twice and
    should be a stored table.
    """
    bucket = F.floor(F.log2(F.col(n)) * BUCKETS_PER_DOUBLING)
    histogram = counts.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    covered, lowest = 0, None
    for row in sorted(histogram.collect(), key=lambda row: -row["bucket"]):
        lowest = row["bucket"]
        covered += row["rows"]
        if covered >= limit:
            break
    if lowest is None:
        return counts.limit(0)
    return counts.filter(bucket >= lowest).orderBy(F.desc(n), *ties).limit(limit)


def summary_error(tracked: int) -> float:
    """How much of all rows an item's count may be overstated by, at most.

    A sketch has the next power of two of places that leaves a quarter of them empty; its error is
    3.5 divided by that, for any order of rows and of merging.
    """
    return 3.5 / 2 ** math.ceil(math.log2(math.ceil(tracked / 0.75)))


def frequent_items(
    rows: DataFrame, item: str, by: Sequence[str] = (), tracked: int = TRACKED
) -> DataFrame:
    """Items that may be frequent in their group: ``by``, the item, ``at_most`` and ``rows``.

    ``rows`` is the number of rows of the group and ``at_most`` not less than the item's count. Every
    item with more than ``2 * summary_error(tracked) * rows`` rows is there; a group in which none stands
    out has one row without an item. A task sends one summary
    per group, of ``tracked`` counters at most, whatever it has read; they are merged in two rounds.
    """
    part = F.pmod(F.spark_partition_id(), F.lit(MERGED_FIRST))
    summed = F.expr(f"approx_top_k_accumulate({item}, {tracked})").alias("summary")
    first = (
        rows.select(*by, item, part.alias("__part"))
        .groupBy(*by, "__part")
        .agg(summed, F.count(F.lit(1)).alias("rows"))
    )
    # grouped even without a group, so that no rows give no summary
    merged = first.groupBy(*by, F.lit(True)).agg(
        F.expr(f"approx_top_k_combine(summary, {tracked})").alias("summary"),
        F.sum("rows").alias("rows"),
    )
    named = F.expr(f"approx_top_k_estimate(summary, {tracked})")
    return merged.select(*by, "rows", F.inline_outer(named).alias(item, "at_most"))
