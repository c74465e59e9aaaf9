"""Profile, statistics, terms, samples on hand-made tables."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiscope.functions.text import strip_space, word_count
from lexiscope.operators import frequent, inspect, profile, sampling, stats, terms

SLOW = settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def as_dict(df, key):
    return {row[key]: row.asDict() for row in df.collect()}


# --- inspection and profile ----------------------------------------------------------------------


def test_preview_schema_and_count(few):
    assert [r["doc_id"] for r in inspect.preview(few, 3, [F.desc("doc_id")]).collect()] == [10, 9, 8]
    assert inspect.row_count(few).first()["row_count"] == 10
    report = as_dict(inspect.schema_report(few), "column_name")
    assert report["doc_id"]["data_type"] == "bigint" and report["title"]["present"] == 9
    assert not inspect.is_local(few.groupBy("category").count())


def test_profile_counts(few):
    found = as_dict(profile.profile_columns(few), "column_name")
    assert found["title"]["distinct_values"] == 8 and found["title"]["nulls"] == 1
    assert found["summary"]["nulls"] == 2 and found["summary"]["empties"] == 2
    assert found["summary"]["unsuitable"] == 4 and found["summary"]["unsuitable_pct"] == 40.0
    assert found["body"]["distinct_values"] == 8 and found["body"]["cardinality_pct"] == 80.0
    assert found["doc_id"]["empties"] is None and found["doc_id"]["empty_pct"] is None
    assert found["doc_id"]["unsuitable"] == 0
    rough = as_dict(profile.profile_columns(few, approximate=True), "column_name")
    assert abs(rough["body"]["distinct_values"] - 8) <= 1


def test_profile_keeps_odd_column_names_and_survives_no_rows(spark):
    empty = spark.createDataFrame([], "x_distinct string, `a.b` int")
    found = as_dict(profile.profile_columns(empty), "column_name")
    assert set(found) == {"x_distinct", "a.b"}
    assert found["x_distinct"]["cardinality_pct"] is None and found["a.b"]["nulls"] == 0
    assert profile.distinct_counts(empty).columns == ["x_distinct", "a.b"]


def test_report_ends_with_the_number_of_rows(few):
    found = as_dict(profile.column_report(few), "column_name")
    assert len(found) == 6
    assert found["TOTAL_ROWS"]["distinct_values"] == 10 and found["TOTAL_ROWS"]["nulls"] is None


def test_profile_reads_the_table_once(few):
    plan = profile.profile_columns(few)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "Expand" in plan


# --- words ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, whitespace, space",
    [("", 1, 1), ("one", 1, 1), ("  a b ", 4, 5), ("a  b", 2, 3), ("a\nb c", 3, 2), (None, None, None)],
)
def test_word_counts(spark, text, whitespace, space):
    row = spark.createDataFrame([(text,)], "t string").select(
        word_count(F.col("t")).alias("w"), word_count(F.col("t"), "space").alias("s")
    )
    assert tuple(row.first()) == (whitespace, space)


def test_unknown_word_count_mode(spark):
    with pytest.raises(ValueError):
        word_count(F.col("t"), "letters")


@SLOW
@given(st.lists(st.text(alphabet=" ab", max_size=12), min_size=1, max_size=20))
def test_space_count_is_never_below_whitespace_count(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", word_count(F.col("t")).alias("w"), word_count(F.col("t"), "space").alias("s")
    )
    for row in rows.collect():
        assert row["w"] <= row["s"] == len(row["t"].split(" "))


def test_strip_space(spark):
    texts = ["  a \n", " x y ", "\x1fz\t", "", "\n \n", "a\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(strip_space(F.col("t"))).collect()] == [t.strip() for t in texts]


# --- statistics per category ---------------------------------------------------------------------


def test_counts_are_ordered_by_size_then_name(few):
    rows = [tuple(r) for r in stats.category_counts(few).collect()]
    assert rows == [("a", 3), ("b", 3), ("c", 2), ("d", 1), ("e", 1)]


def test_word_stats_take_null_text_as_empty(few):
    found = as_dict(stats.category_word_stats(few), "category")
    assert found["a"] == {
        "category": "a", "articles": 3, "avg_words": 1.0, "min_words": 1, "max_words": 1
    }
    assert found["b"]["avg_words"] == 3.0 and found["c"]["min_words"] == 24
    assert stats.fill_missing_text(few).filter("body IS NULL").count() == 0


def test_ranking_and_extremes_break_ties_by_category(few):
    table = stats.category_word_stats(few)
    ranked = [r["category"] for r in stats.rank_categories(table, "max_words").collect()]
    assert ranked == ["c", "d", "b", "e", "a"]
    assert tuple(stats.extreme_category(table, "max_words").first()) == ("c", 25)
    assert tuple(stats.extreme_category(table, "min_words").first()) == ("d", 25)
    assert stats.longest_per_category(table).first()["max_words"] == 25


def test_filter_keeps_25_words_and_drops_24(few):
    kept = stats.keep_long_articles(few)
    assert sorted(r["doc_id"] for r in kept.collect()) == [8, 9]


def test_before_and_after_equal_two_separate_runs(few):
    both = as_dict(stats.stats_before_after(few), "category")
    before = as_dict(stats.category_word_stats(few), "category")
    after = as_dict(stats.category_word_stats(stats.keep_long_articles(few)), "category")
    for name, row in both.items():
        for column in ("articles", "avg_words", "min_words", "max_words"):
            assert row[f"{column}_before"] == before[name][column]
            default = 0 if column == "articles" else None
            assert row[f"{column}_after"] == after.get(name, {}).get(column, default)


def test_equal_columns_ignore_null(few):
    assert tuple(stats.count_equal(few).first()) == (2, 10)


# --- category text and terms ---------------------------------------------------------------------


@pytest.mark.parametrize("ids, size", [(1000, 1 << 20), (3, 1 << 20), (1000, 20), (2, 5)])
def test_category_text_pieces_make_up_the_whole(few, ids, size):
    pieces = terms.category_text(few, ids_per_piece=ids, max_piece_bytes=size).collect()
    expected = {}
    for row in sorted(few.collect()):
        if row["body"] is not None:
            expected.setdefault(row["category"], []).append(row["body"])
    found = {}
    for row in sorted(pieces, key=lambda r: (r["id_range"], r["piece"])):
        found.setdefault(row["category"], []).append(row["all_text"])
    assert {k: " ".join(v) for k, v in found.items()} == {k: " ".join(v) for k, v in expected.items()}
    assert sum(row["articles"] for row in pieces) == 9


def test_top_terms(spark):
    rows = spark.createDataFrame(
        [(1, "x", "B b a. É é! don't"), (2, "x", "c a"), (3, "y", "   "), (4, "z", None)],
        "doc_id int, category string, body string",
    )
    found = [tuple(r) for r in terms.top_terms(rows, 3).orderBy("rank").collect()]
    assert found == [("x", "a", 2, 1), ("x", "b", 2, 2), ("x", "é", 2, 3)]
    stop = spark.createDataFrame([("a",), ("é",)], "term string")
    found = [r["term"] for r in terms.top_terms(rows, 3, stop_words=stop).orderBy("rank").collect()]
    assert found == ["b", "c", "don't"]


def test_top_terms_prune_before_the_last_shuffle(few):
    plan = terms.top_terms(few, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "partial_count" in plan


def test_one_dominant_category_gives_the_same_terms_in_any_partitioning(spark):
    rows = spark.range(3000).selectExpr(
        "id AS doc_id", "if(id % 3 = 0, concat('c', id), 'hot') AS category",
        "concat('common t', id % 50) AS body",
    )
    one, many = (sorted(terms.top_terms(rows.repartition(n), 5).collect()) for n in (1, 8))
    assert one == many and len([r for r in one if r["category"] == "hot"]) == 5


@pytest.mark.parametrize("limit", [1, 7, 60, 500, 5000])
def test_most_frequent_equals_sort_and_limit(spark, limit):
    counts = spark.range(1000).selectExpr(
        "concat('t', id) AS term", "1 + cast(1e6 / (1 + id * id % 977) AS bigint) AS n"
    )
    found = frequent.most_frequent(counts, "n", limit, "term").collect()
    assert found == sorted(counts.collect(), key=lambda r: (-r["n"], r["term"]))[:limit]
    equal = counts.selectExpr("term", "3 AS n")
    found = frequent.most_frequent(equal, "n", limit, "term").collect()
    assert [r["term"] for r in found] == sorted(r["term"] for r in equal.collect())[:limit]
    assert frequent.most_frequent(counts.filter("false"), "n", limit).collect() == []


# --- samples and splits --------------------------------------------------------------------------


def test_sample_and_split_do_not_depend_on_partitions(spark):
    rows = spark.range(2000).withColumnRenamed("id", "doc_id")
    picks = [
        sorted(r[0] for r in sampling.sample_rows(rows.repartition(n), 0.2, key="doc_id").collect())
        for n in (1, 8)
    ]
    assert picks[0] == picks[1] and 300 < len(picks[0]) < 500
    expected = [
        i for i in range(2000)
        if int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:8], 16) % 100 < 20
    ]
    assert picks[0] == expected
    assert 300 < sampling.sample_rows(rows, 0.2).count() < 500


def test_parts_cover_the_table_and_sizes_add_up(spark):
    rows = spark.range(1000).withColumnRenamed("id", "doc_id")
    sizes = {r["part"]: r["articles"] for r in sampling.part_sizes(sampling.split_rows(rows, "doc_id")).collect()}
    assert sum(sizes.values()) == 1000 and set(sizes) == set(sampling.PARTS)
    assert 630 < sizes["train"] < 770


def test_splitting_on_text_keeps_copies_together(few):
    parts = sampling.split_rows(few, "body").filter("doc_id IN (8, 9)").select("part").distinct()
    assert parts.count() == 1


def test_fractions_that_do_not_fit_the_buckets_are_refused(few):
    with pytest.raises(ValueError):
        sampling.sample_rows(few, 0.001, key="doc_id")
    with pytest.raises(ValueError):
        sampling.split_rows(few, "doc_id", weights=(0.5, 0.2, 0.2))
    assert sampling.sample_rows(few, 0.001, key="doc_id", buckets=1000).count() <= 10


def test_pick_per_group_takes_all_of_a_small_group_and_n_of_a_large_one(spark):
    rows = spark.range(100).selectExpr("id AS doc_id", "if(id < 3, 'few', 'many') AS lang")
    picked = sampling.pick_per_group(rows, "lang", "doc_id", 10)
    counts = {r["lang"]: r["count"] for r in picked.groupBy("lang").count().collect()}
    assert counts == {"few": 3, "many": 10}
    again = sampling.pick_per_group(rows.repartition(5), "lang", "doc_id", 10)
    assert sorted(again.collect()) == sorted(picked.collect())
    assert "WindowGroupLimit" in picked._jdf.queryExecution().executedPlan().toString()


def test_rows_without_key_are_sampled_and_split_like_others(spark):
    rows = spark.createDataFrame([(None,), (None,), ("a",)], "body string")
    assert sampling.sample_rows(rows, 1.0, key="body").count() == 3
    assert sampling.sample_rows(rows, 0.0, key="body").count() == 0
    seeds = [sampling.split_rows(rows, "body", seed=s).collect() for s in range(12)]
    parts = [{r["part"] for r in found if r["body"] is None} for found in seeds]
    assert all(len(p) == 1 for p in parts) and len(set().union(*parts)) > 1


# --- profiles of slices --------------------------------------------------------------------------


def sliced(spark):
    return spark.range(20_000).selectExpr(
        "id AS number", "IF(id % 7 = 0, NULL, concat('v', id % 5000)) AS text",
        "IF(id % 4 = 0, '', 'x') AS few", "cast(id % 3000 AS double) AS real", "id % 2 = 0 AS flag",
        "cast(NULL AS string) AS none", "id % 8 AS slice",
    )


def test_merged_sketches_are_exact_where_they_must_be_and_near_elsewhere(spark):
    rows = sliced(spark)
    columns = [c for c in rows.columns if c != "slice"]
    each = [
        profile.sketch_profile(rows.filter(F.col("slice") == i).select(columns)) for i in range(8)
    ]
    stacked = each[0]
    for one in each[1:]:
        stacked = stacked.unionAll(one)
    merged = {r["column_name"]: r for r in profile.merge_profiles(stacked).collect()}
    exact = {r["column_name"]: r for r in profile.profile_columns(rows.select(columns)).collect()}
    assert set(merged) == set(columns)
    for name, row in merged.items():
        true = exact[name]["distinct_values"]
        assert (row["rows"], row["nulls"], row["empties"]) == (
            20_000, exact[name]["nulls"], exact[name]["empties"]
        )
        assert row["least_distinct"] <= true <= row["most_distinct"]
        assert true == row["distinct_values"] or true > 100


def test_merged_sketches_can_be_merged_again_in_any_grouping(spark):
    rows = sliced(spark).drop("slice")
    slices = [rows.filter(F.col("number") % 4 == i) for i in range(4)]
    one, two, three, four = [profile.sketch_profile(s) for s in slices]
    kept = one.columns
    left = profile.merge_profiles(one.unionAll(two)).select(kept)
    right = profile.merge_profiles(three.unionAll(four)).select(kept)
    columns = ["column_name", "rows", "nulls", "empties", "distinct_values"]
    nested = profile.merge_profiles(left.unionAll(right)).select(columns).orderBy("column_name")
    flat = profile.merge_profiles(one.unionAll(two).unionAll(three).unionAll(four)).select(columns)
    for a, b in zip(nested.collect(), flat.orderBy("column_name").collect()):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) <= 0.05 * b[4]


def test_sketches_of_empty_slices(spark):
    rows = sliced(spark).drop("slice")
    empty, full = profile.sketch_profile(rows.limit(0)), profile.sketch_profile(rows)
    alone = profile.merge_profiles(empty).collect()
    assert {(r["rows"], r["distinct_values"]) for r in alone} == {(0, 0)}
    both = profile.merge_profiles(empty.unionAll(full)).select("column_name", "rows", "distinct_values")
    plain = profile.merge_profiles(full).select("column_name", "rows", "distinct_values")
    assert sorted(both.collect()) == sorted(plain.collect())
