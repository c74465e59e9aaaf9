"""Line removal against a brute-force version."""

from __future__ import annotations

import random

import pytest

from lexiscope.llm import line_join

def words(line):
    return frozenset(w for w in line.replace("\t", " ").replace("\r", " ").lower().split(" ") if w)


def brute(rows, similarity):
    """Kept text by (id, text), with every line held against every earlier one."""
    lines = [
        (key, text, number, words(line))
        for key, text in sorted(rows, key=lambda r: r[0])
        if text is not None
        for number, line in enumerate(text.split("\n"))
    ]
    gone = set()
    for at, (key, text, number, mine) in enumerate(lines):
        for other in lines[:at]:
            both = len(mine | other[3])
            if mine and 100 * len(mine & other[3]) >= similarity * both:
                gone.add((key, number))
                break
    return {
        key: None
        if text is None
        else "\n".join(x for n, x in enumerate(text.split("\n")) if (key, n) not in gone)
        for key, text in rows
    }


@pytest.mark.parametrize("similarity,seed", [(90, 1), (75, 2), (60, 3), (100, 4)])
def test_equals_brute_force(spark, similarity, seed):
    draw = random.Random(seed)
    base = [[f"w{draw.randrange(60)}" for _ in range(draw.randrange(1, 30))] for _ in range(12)]

    def line():
        some = list(draw.choice(base))
        for _ in range(draw.randrange(3)):
            some[draw.randrange(len(some))] = draw.choice(["New", "odd", "x y"])
        return draw.choice([" ", "\t", "  "]).join(some)

    rows = [(i, "\n".join(line() for _ in range(draw.randrange(1, 7)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n \t\n\r"), (103, "hot"), (104, "Hot"), (105, "hot\nhot")]
    rows += [(106 + i, "the same hot line of words in many documents") for i in range(30)]
    frame = spark.createDataFrame(
        [(k, t, 1, 2) for k, t in rows], "doc_id bigint, text string, n int, line int"
    )
    found = line_join.remove_repeated_lines(frame, similarity)
    assert found.columns[:4] == frame.columns
    assert {r.doc_id: r.text for r in found.collect()} == brute(rows, similarity)


def test_few_counters_change_no_result(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(12))) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain = sorted(map(tuple, line_join.remove_repeated_lines(frame).collect()))
    whole = line_join.frequency_levels
    monkeypatch.setattr(line_join, "frequency_levels", lambda docs: whole(docs, counters=16))
    monkeypatch.setattr(line_join, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, line_join.remove_repeated_lines(frame).collect())) == plain


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c\nd"), (None, "d"), (3, "long line " * 9000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = line_join.remove_repeated_lines(frame).collect()
    assert sorted((r.doc_id or 0, r.text[:9]) for r in found) == [
        (0, "d"), (1, "a b c"), (1, "a b c"), (2, ""), (3, "long line"),
    ]
    assert line_join.remove_repeated_lines(frame.limit(0)).collect() == []


def test_rare_words_come_first(spark):
    rows = [(i, f"common of own{i}") for i in range(200)] + [(900, "of")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain = line_join._rows(frame, "doc_id", "text")
    levels = line_join.frequency_levels(plain)
    sets = line_join.line_sets(plain, levels).filter("size(codes) = 3")
    firsts = sets.selectExpr("codes[0] AS own", "codes[1] AS common", "codes[2] AS of").collect()
    assert len({r.own for r in firsts}) == 200
    assert len({frozenset((r.common, r.of)) for r in firsts}) == 1


@pytest.mark.parametrize("last", ["other", "v14708"])
def test_texts_of_one_id_with_the_same_32_bit_hash_are_told_apart(spark, last):
    letters = " ".join("abcdefghijklmnopqrstu")
    repeated, own = f"{letters} v14708", "own 114538"
    rows = [(1, f"{letters} {last}"), (5, repeated), (5, own)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    hashes = frame.filter("doc_id = 5").selectExpr("count(DISTINCT hash(text))")
    assert hashes.first()[0] == 1
    found = line_join.remove_repeated_lines(frame).collect()
    assert sorted(r.text for r in found if r.doc_id == 5) == ["", own]


def test_two_changed_words_in_a_line_of_25_are_found_by_default(spark):
    line = [f"w{i}" for i in range(25)]
    rows = [(1, " ".join(line)), (2, " ".join([*line[:23], "x", "y"])), (3, "a b c d"), (4, "a b c")]
    rows += [(5, "a b c e f"), (6, " ".join([*line[:20], *"stuvz"]))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.text for r in line_join.remove_repeated_lines(frame).collect()}
    # 23 of 27 and 3 of 4 words are shared, but 20 of 30 and 3 of 6 are too few
    assert found == dict(rows) | {2: "", 4: ""}


def test_both_sides_of_a_join_of_lines_are_one_shuffle(spark, monkeypatch):
    """And codes are made after the lines that may match have been picked, without moving texts."""
    stored, keep = {}, line_join.write_and_reread

    def spy(df, label):
        stored[label] = df
        return keep(df, label)

    monkeypatch.setattr(line_join, "write_and_reread", spy)
    words = [[f"own{i}" if j == i % 10 else f"w{i // 10}x{j}" for j in range(20)] for i in range(300)]
    rows = [(i, " ".join(line)) for i, line in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        line_join.kept_lines(docs)
        for table in (stored["likely-lines"], stored["matched-lines"]):
            assert table.count() > 0 and table.collect()
            plan = table._jdf.queryExecution().executedPlan().toString()
            assert "ReusedExchange" in plan[: plan.index("Initial Plan")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    plan = stored["likely-sets"]._jdf.queryExecution().executedPlan().toString()
    assert plan.index("xxhash64(lambda") < plan.index("LeftSemi")
    assert not any("Aggregate(" in line and "text#" in line for line in plan.splitlines())


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {name for name in names if name.startswith("shuffle_")}


def test_words_of_a_line_go_with_pairs_and_not_with_each_posting(spark, monkeypatch):
    """And the shuffles of the tables that are stored do not stay on the disk."""
    stored, left, keep = {}, {}, line_join.write_and_reread

    def spy(df, label):
        before = shuffle_files(spark)
        table = keep(df, label)
        left[label] = shuffle_files(spark) - before
        stored[label] = df
        return table

    monkeypatch.setattr(line_join, "write_and_reread", spy)
    words = [[f"own{i}" if j == i % 10 else f"w{i // 10}x{j}" for j in range(20)] for i in range(100)]
    rows = [(i, " ".join(line)) for i, line in enumerate(words)]
    line_join.kept_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert "matched-lines" in stored and not any(left.values())
    for table in stored.values():
        plan = table._jdf.queryExecution().optimizedPlan().toString().splitlines()
        # a row for each word of a prefix: made from a table that has no codes of whole lines
        spots = [at for at, line in enumerate(plan) if "Generate posexplode(prefix" in line]
        assert not any("codes#" in plan[at] or "codes#" in plan[at + 1] for at in spots)


def test_a_match_that_is_not_the_first_line_with_any_of_its_rare_words(spark):
    common = [f"c{i}" for i in range(6)] + [f"u{i}" for i in range(7)]
    rows = [(i, f"{common[i % 13]} {common[(i + 1) % 13]} z{i}") for i in range(300)]
    rows += [(500 + i, f"r{i} " + " ".join(common[6:])) for i in range(4)]
    line = "r0 r1 r2 r3 c0 c1 c2 c3 c4"
    rows += [(600, line), (601, f"{line} c5")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.text for r in line_join.remove_repeated_lines(frame).collect()}
    expected = brute(rows, line_join.SIMILARITY)
    assert found == expected and found[600] == line and found[601] == ""


def test_the_table_of_levels_stays_small_in_plans_and_codes_sort_as_numbers(spark, monkeypatch):
    """Each change of a plan is told to the driver's listeners with its whole description."""
    stored, keep = {}, line_join.write_and_reread

    def spy(df, label):
        stored[label] = df
        return keep(df, label)

    monkeypatch.setattr(line_join, "write_and_reread", spy)
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d f")], "doc_id bigint, text string")
    line_join.kept_lines(docs)
    for table in stored.values():
        assert len(table._jdf.queryExecution().toString()) < 2_000_000
    rows = line_join._rows(docs, "doc_id", "text")
    sets = line_join.line_sets(rows, line_join.frequency_levels(rows))
    assert not sets.schema["codes"].dataType.containsNull


def test_lines_of_blanks_stay_where_they_are(spark):
    text = "a b c\n \t\r\n\n\r\na b c\n \n \t."
    frame = spark.createDataFrame([(1, text), (2, "a b c\n\t")], "doc_id bigint, text string")
    found = {r.doc_id: r.text for r in line_join.remove_repeated_lines(frame).collect()}
    assert found == brute([(1, text), (2, "a b c\n\t")], line_join.SIMILARITY)
