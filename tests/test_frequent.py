"""Summaries of frequent items, and what is counted with their help."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from lexiscope.operators import features, frequent, terms


def shuffled_records(df):
    """Runs a query and adds up the records that its stages wrote for shuffles."""
    context = df.sparkSession.sparkContext
    context.setJobGroup(group := uuid.uuid4().hex, "measured")
    try:
        df.write.format("noop").mode("overwrite").save()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    jobs = [tracker.getJobInfo(job) for job in tracker.getJobIdsForGroup(group)]
    stages = {stage for job in jobs for stage in job.stageIds}
    return sum(store.lastStageAttempt(stage).shuffleWriteRecords() for stage in stages)


def skewed(spark, rows=30_000):
    """A few terms in many rows, one in a hundredth of them, and two of its own in every row."""
    return spark.range(rows).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), F.col("id") % 5)).alias("category"),
        F.concat_ws(
            " ", F.concat(F.lit("own"), "id"), F.concat(F.lit("mine"), "id"), F.lit("every"),
            F.when(F.col("id") % 100 == 7, "edge"), F.when(F.col("id") % 101 == 7, "below"),
            F.concat(F.lit("t"), F.floor(F.sqrt(F.col("id") % 400))),
        ).alias("body"),
    )


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("tracked", [24, 96, 1_000])
def test_a_summary_misses_no_frequent_item(spark, parts, tracked):
    # the items come in runs, which lets counters be thrown out between them
    rows = spark.range(20_000, numPartitions=parts).select(
        F.when(F.col("id") % 10 < 4, F.floor(F.col("id") / 2_500)).otherwise(F.col("id")).cast("string").alias("item"),
        (F.col("id") % 2).alias("side"),
    )
    exact = {(r.side, r.item): r["count"] for r in rows.groupBy("side", "item").count().collect()}
    found = frequent.frequent_items(rows, "item", ["side"], tracked).collect()
    error = frequent.summary_error(tracked)
    named = {(r.side, r.item): r.at_most for r in found}
    assert {r.rows for r in found} == {10_000}
    assert len(named) == len(found) <= 2 * tracked
    for key, count in exact.items():
        if count > 2 * error * 10_000:
            assert key in named
        if key in named:
            assert count <= named[key] <= count + error * 10_000


@pytest.mark.parametrize("parts", [1, 5])
def test_vocabulary_with_summaries_is_the_same(spark, parts):
    rows = skewed(spark).withColumnRenamed("body", "combined_text").repartition(parts)
    plain = features.fit_corpus(rows)
    summed = features.fit_corpus(rows, summary_from=0, tracked=6_000)
    assert summed == plain and "edge" in plain.terms and "below" not in plain.terms
    # too few counters decide nothing, and all terms are counted
    tokens = features.tokenize(rows).select("tokens")
    assert features.may_be_common(tokens, 300, 96) is None
    assert features.fit_corpus(rows, summary_from=0, tracked=96) == plain
    assert features.fit_corpus(rows, min_df=0, max_df=1e9, summary_from=0, max_terms=50) == features.fit_corpus(
        rows, min_df=0, max_df=1e9, max_terms=50
    )
    empty = rows.limit(0)
    assert features.fit_corpus(empty, summary_from=0) == features.fit_corpus(empty)


def test_what_is_counted_exactly_is_bounded_by_the_candidates(spark):
    tokens = features.tokenize(skewed(spark), "body").select("tokens").repartition(4)
    candidates = features.may_be_common(tokens, 300, 6_000)
    names = {r.term for r in candidates.collect()}
    assert {"every", "edge"} <= names and len(names) < 40
    words = tokens.select(F.explode("tokens").alias("term"))
    counted = words.join(candidates, "term", "left_semi").groupBy("term").count()
    dealt_out = 30_000  # rows of the repartition, in both
    assert shuffled_records(counted) - dealt_out <= 8 * len(names)
    assert shuffled_records(words.groupBy("term").count()) - dealt_out > 60_000


@pytest.mark.parametrize("tracked", [96, 3_000, 100_000])
@pytest.mark.parametrize("k", [1, 3, 21])
def test_top_terms_with_summaries_are_the_same(spark, k, tracked):
    rows = skewed(spark, 6_000)
    plain = sorted(map(tuple, terms.top_terms(rows, k).collect()))
    assert sorted(map(tuple, terms.top_terms(rows, k, tracked=tracked).collect())) == plain


def test_top_terms_of_adversarial_splits(spark):
    """A term that is first nowhere and leads in all, ties at the threshold, and null categories."""
    parts = []
    for part in range(8):
        texts = [f"local{part}"] * 30 + ["everywhere"] * 29 + ["tied", "bound"] * 10
        texts += [f"rare{part}x{i}" for i in range(200)]
        parts += [(part, "a", " ".join(texts)), (part, None, f"null null{part}"), (part, "few", "one two")]
    rows = spark.createDataFrame(parts, "part int, category string, body string")
    rows = rows.repartitionByRange(8, "part")
    for k in (1, 2, 9, 10, 11, 2_000):
        plain = sorted(map(str, terms.top_terms(rows, k).collect()))
        for tracked in (48, 400, 10_000):
            assert sorted(map(str, terms.top_terms(rows, k, tracked=tracked).collect())) == plain


def test_top_terms_with_summaries_shuffle_candidates_alone(spark):
    rows = skewed(spark)
    plain, summed = terms.top_terms(rows, 3), terms.top_terms(rows, 3, tracked=100_000)
    assert shuffled_records(summed) < 1_000 < 60_000 < shuffled_records(plain)


def test_top_terms_of_an_empty_table(spark):
    rows = spark.createDataFrame([], "category string, body string")
    assert terms.top_terms(rows, 3, tracked=100).collect() == []
