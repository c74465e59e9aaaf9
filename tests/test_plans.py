"""Physical plans: what must not be in them at scale."""

from __future__ import annotations

from lexiscope.operators import language, language_split
from lexiscope.plans.registry import REGISTRY
from lexiscope.sources.articles import articles, save_table


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    """The columns that go through each shuffle, by the line of the plan below it."""
    lines = plan.splitlines()
    return [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]


def test_scoring_shuffles_one_row_per_text(spark, small, profile):
    rows = spark.read.parquet(f"{small}/documents.parquet")
    plan = plan_of(language.score_languages(rows, profile, "text", ["doc_id"]))
    moved = exchanges(plan)
    assert len(moved) == 1 and "partial_sum" in moved[0]
    assert "BroadcastHashJoin" in plan


def test_language_operators_over_buckets_move_no_text(spark, small, profile):
    store = articles(spark, small).select("doc_id", "summary", "body")
    stored = save_table(store, "placed_articles", "doc_id", 8)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        detected = language.detect_language(stored, profile)
        split = language_split.split_on_language_change(stored, profile, ("summary", "body"))
        assert exchanges(plan_of(detected)) == []
        moved = exchanges(plan_of(split))
        assert len(moved) == 1 and not any("body" in columns for columns in moved)
        assert detected.count() == split.count() == store.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_few_cuts_are_broadcast_and_many_are_not(spark, small, profile):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    split = language_split.split_on_language_change(rows, profile, ("text",))
    assert "BroadcastHashJoin" in plan_of(split) and exchanges(plan_of(split)) == []
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        split = language_split.split_on_language_change(rows, profile, ("text",))
        assert "SortMergeJoin" in plan_of(split)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_only_the_columns_in_use_are_read(spark, small):
    plan = plan_of(REGISTRY["category_word_stats"].run(spark, small))
    assert "source" not in plan.split("ReadSchema")[1]
    assert "partial_avg" in plan or "partial_count" in plan


def test_no_query_deals_small_tables_out_anew(spark, small):
    for name in ("row_counts", "category_counts", "language_id_body", "top_terms_by_category"):
        assert "REPARTITION_BY_NUM" not in plan_of(REGISTRY[name].run(spark, small)), name


def test_the_search_for_windows_moves_pieces_and_then_a_row_for_each(spark, small, profile):
    rows = spark.read.parquet(f"{small}/documents.parquet")
    found = language_split.first_main_window(rows, profile, "text", ["doc_id"], "en", 25, 5)
    moved = exchanges(plan_of(found))
    assert len(moved) == 2
    assert any("part" in columns for columns in moved) and any("min" in columns for columns in moved)


def test_several_columns_are_scored_in_one_pass(spark, small, profile):
    rows = articles(spark, small).select("doc_id", "summary", "body")
    plan = plan_of(language.detect_languages(rows, profile, ("summary", "body")))
    assert plan.count("regexp_extract_all(piece") + plan.count("Generate explode(regexp") >= 1
    assert plan.count("BroadcastExchange") <= 3 and plan.count("Generate inline") == 1


def test_a_task_of_the_search_holds_the_blocks_of_so_many_characters(spark, small, profile, monkeypatch):
    """However large the table is; and nothing is grouped before the windows."""
    monkeypatch.setattr(language_split, "PARTITION_CHARS", 10_000)
    rows = spark.read.parquet(f"{small}/documents.parquet")
    total = sum(len(r["text"]) for r in rows.collect())
    found = language_split.first_main_window(rows, profile, "text", ["doc_id"], "en", 25, 5)
    plan = plan_of(found)
    assert f"{-(-total // 10_000)}), REPARTITION_BY_NUM" in plan
    assert plan[plan.index("Window") :].count("Aggregate") == 0
    cuts = sorted(found.collect())
    monkeypatch.undo()
    again = language_split.first_main_window(rows, profile, "text", ["doc_id"], "en", 25, 5)
    assert sorted(again.collect()) == cuts


def test_openings_are_no_part_of_the_grouping_of_windows(spark, small, profile, monkeypatch):
    """A row of the search for windows holds numbers and keys, and no text."""
    grouped, whole = [], language_split.first_main_window

    def search(df, profile, text, keys, *more):
        grouped.append(list(keys))
        return whole(df, profile, text, keys, *more)

    monkeypatch.setattr(language_split, "first_main_window", search)
    rows = articles(spark, small).select("doc_id", "summary")
    language_split.split_on_language_change(rows, profile, ("summary",))
    assert grouped == [["doc_id", "column"]] * 2
