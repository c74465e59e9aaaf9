"""The text of a category and the terms that stand out in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiscope.functions.text import terms
from lexiscope.operators.frequent import frequent_items, summary_error
from lexiscope.sources.shared import write_and_reread

BROADCAST_TERMS = 1_000_000


def category_text(
    df: DataFrame,
    category: str = "category",
    text: str = "body",
    key: str = "doc_id",
    ids_per_piece: int = 1000,
    max_piece_bytes: int = 64 << 20,
) -> DataFrame:
    """All text of a category joined by spaces, as numbered pieces in order of the key.

    The pieces of a category, joined by a space in order of ``(id_range, piece)``, are its whole
    text. A category may be larger than a row or a task can be, so a piece covers one range of
    ids (``key`` is a unique integer) and is cut further at ``max_piece_bytes``.
    """
    in_range = Window.partitionBy(category, "id_range").orderBy(key)
    before = F.sum(F.octet_length(text)).over(in_range.rowsBetween(Window.unboundedPreceding, -1))
    ordered = F.array_sort(F.collect_list(F.struct(key, text)))
    return (
        df.filter(F.col(text).isNotNull())
        .select(category, key, text, F.floor(F.col(key) / ids_per_piece).alias("id_range"))
        .withColumn("piece", F.floor(F.coalesce(before, F.lit(0)) / max_piece_bytes))
        .groupBy(category, "id_range", "piece")
        .agg(
            F.count(F.lit(1)).alias("articles"),
            F.concat_ws(" ", F.transform(ordered, lambda row: row[text])).alias("all_text"),
        )
    )


def top_terms(
    df: DataFrame,
    k: int = 200,
    category: str = "category",
    text: str = "body",
    stop_words: DataFrame | None = None,
    tracked: int | None = None,
) -> DataFrame:
    """The ``k`` most frequent lower-case terms of every category, ties in term order.

    ``stop_words`` is a table with a ``term`` column. Counting is combined before each shuffle
    and the rank filter prunes per task, so a dominant category or term stays cheap.

    With ``tracked``, only terms that can be among the ``k`` are counted. Summaries of so many
    counters, one per task and category, tell how frequent terms are at most, and from that a
    threshold that the ``k``-th term is not below. In categories where a term could reach the
    threshold without being named, all terms are counted. The result is the same. It takes a second
    reading of the texts and shuffles, in place of every different term of a task, a summary and
    the candidates.
    """
    words = df.select(category, F.explode(terms(F.col(text))).alias("term")).select(
        category, F.lower("term").alias("term")
    )
    if stop_words is not None:
        words = words.join(stop_words.select("term"), "term", "left_anti")
    if tracked is not None:
        words = _that_may_lead(words, k, category, tracked)
    counts = words.groupBy(category, "term").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(category).orderBy(F.desc("n"), F.asc("term"))
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(category, "term", "n", F.col("rank").cast("bigint").alias("rank"))
    )


def _that_may_lead(words: DataFrame, k: int, category: str, tracked: int) -> DataFrame:
    """The rows of terms that may be among the first ``k`` of their category."""
    named = write_and_reread(frequent_items(words, "term", [category], tracked), "frequent-terms")
    ranked = Window.partitionBy(category).orderBy(F.desc("at_most"), "term")
    # the k-th term has at least what the k-th of these has at least
    last = named.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") == k)
    error = F.col("rows") * summary_error(tracked)
    limits = last.select(category, (F.col("at_most") - error).alias("least"), error.alias("error"))
    # a term above twice the error is named for certain; a null category can't be joined
    sure = (F.col("least") > 2 * F.col("error")) & F.col(category).isNotNull()
    limits = limits.filter(sure).select(category, "least")
    leading = named.join(limits, category).filter("at_most >= least").select(category, "term")
    stored = write_and_reread(leading, "leading-terms")
    if stored.count() <= BROADCAST_TERMS:
        stored = F.broadcast(stored)
    some = words.join(stored, [category, "term"], "left_semi")
    if limits.count() == named.select(category).distinct().filter(F.col(category).isNotNull()).count():
        return some.unionAll(words.filter(F.col(category).isNull()))
    # one row per category
    rest = words.join(F.broadcast(limits.select(category)), category, "left_anti")
    return some.unionAll(rest)
