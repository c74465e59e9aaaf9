"""Article counts and word statistics per category, and the minimum-length filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscope.functions.text import word_count

MIN_WORDS = 25


def fill_missing_text(df: DataFrame, text: str = "body") -> DataFrame:
    return df.na.fill({text: ""})


def with_word_count(
    df: DataFrame, text: str = "body", mode: str = "whitespace", out: str = "word_count"
) -> DataFrame:
    return df.withColumn(out, word_count(F.col(text), mode))


def keep_long_articles(df: DataFrame, text: str = "body", min_words: int = MIN_WORDS) -> DataFrame:
    """Keep articles of at least ``min_words`` words, counted on single spaces."""
    return df.filter(word_count(F.col(text), "space") >= min_words)


def category_counts(df: DataFrame, category: str = "category") -> DataFrame:
    return (
        df.groupBy(category)
        .agg(F.count(F.lit(1)).alias("articles"))
        .orderBy(F.desc("articles"), category)
    )


def _word_stats(words: Column, suffix: str = "") -> list[Column]:
    return [
        F.count(words).alias(f"articles{suffix}"),
        F.avg(words).alias(f"avg_words{suffix}"),
        F.min(words).alias(f"min_words{suffix}"),
        F.max(words).alias(f"max_words{suffix}"),
    ]


def category_word_stats(
    df: DataFrame, category: str = "category", text: str = "body"
) -> DataFrame:
    """Articles, mean, shortest and longest word count per category; null text counts as empty."""
    words = word_count(F.coalesce(F.col(text), F.lit("")))
    return df.groupBy(category).agg(*_word_stats(words)).orderBy(F.desc("articles"), category)


def stats_before_after(
    df: DataFrame, category: str = "category", text: str = "body", min_words: int = MIN_WORDS
) -> DataFrame:
    """The same statistics over all articles and over the long ones, in one pass.

    A category that loses all its articles stays, with a count of zero after the filter.
    """
    filled = F.coalesce(F.col(text), F.lit(""))
    words = word_count(filled)
    kept = F.when(word_count(filled, "space") >= min_words, words)
    return (
        df.groupBy(category)
        .agg(*_word_stats(words, "_before"), *_word_stats(kept, "_after"))
        .orderBy(F.desc("articles_before"), category)
    )


def rank_categories(stats: DataFrame, value: str, category: str = "category") -> DataFrame:
    """The statistics by one of their columns, largest first, ties by category."""
    return stats.orderBy(F.desc(value), category)


def extreme_category(stats: DataFrame, value: str, category: str = "category") -> DataFrame:
    """The largest value of a column and the (first) category that has it."""
    return rank_categories(stats, value, category).limit(1).select(category, value)


def longest_per_category(stats: DataFrame, category: str = "category") -> DataFrame:
    return rank_categories(stats, "max_words", category).select(category, "max_words")


def count_equal(df: DataFrame, left: str = "summary", right: str = "body") -> DataFrame:
    """How many rows have two equal columns, and how many rows there are; null equals nothing."""
    return df.agg(
        F.count_if(F.col(left) == F.col(right)).alias("equal_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    )
