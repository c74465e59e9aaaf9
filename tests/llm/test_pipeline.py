"""The pipeline, stage by stage, against brute-force versions of its rules."""

from __future__ import annotations

import pytest
import sentencepiece
import test_line_join
import test_seeds
import test_shingle_join
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from lexiscope.llm import line_join, quality, seeds, shingle_join
from lexiscope.llm.queries import PIECE_MODEL, QUERIES, table


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """What each stage was given and what it made of it."""
    folder = tmp_path_factory.mktemp("stages")
    docs = table(spark, small, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(folder / name))
        made = spark.read.parquet(str(folder / name))
        seen[name] = (docs, made)
        docs = made
    return seen


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns(stages):
    for name, (given, made) in list(stages.items())[:-1]:
        assert made.schema == given.schema, name


def test_quality_keeps_what_the_operator_accepts(spark, small, stages):
    given, made = stages["quality"]
    scored = quality.quality_table(given, table(spark, small, "labels")).collect()
    assert set(texts(made)) == {r.doc_id for r in scored if r.predicted}


def test_repeated_lines_go(stages):
    given, made = stages["lines"]
    rows = sorted(texts(given).items())
    expected = test_line_join.brute(rows, line_join.SIMILARITY)
    for key, text in rows:
        if expected[key] != text and not expected[key].split():
            del expected[key]
    assert texts(made) == expected
    assert all(r.n_chars == len(r.text) for r in made.collect())


def test_one_of_near_duplicates_stays(stages):
    given, made = stages["near_duplicates"]
    rows = sorted(texts(given).items())
    expected = {key for key, _, least in test_shingle_join.brute(rows) if key == least}
    assert set(texts(made)) == expected


def test_leaks_go(spark, small, stages):
    given, made = stages["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    leaking = test_seeds.brute(texts(given).items(), items, seeds.WINDOW, seeds.SUBSTITUTIONS)
    assert set(texts(made)) == set(texts(given)) - {key for key, _ in leaking}


def test_ids_are_those_of_the_library(stages):
    given, made = stages["piece_codec"]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    rows = {r.doc_id: r for r in made.collect()}
    assert len(rows) == given.count()
    for key, text in texts(given).items():
        assert rows[key].ids == library.encode(text) and rows[key].decoded == text


def test_run_gives_the_last_stage(spark, small, stages):
    found = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, small).collect()}
    assert found == {r.doc_id: r.n_tokens for r in stages["piece_codec"][1].collect()}


def test_awkward_documents_pass_all_stages(spark, tmp_path):
    rows = [
        (1, None, "x"), (2, "", "x"), (3, "\n \n", "x"), (None, "no id at all here", "x"),
        (4, "the same row twice over here", "x"), (4, "the same row twice over here", "x"),
        (5, "long text " * 20_000, "x"),
    ]
    schema = "doc_id bigint, text string, __kept_by string"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(4, 1)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b")], "item_id bigint, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    for start in (docs, docs.limit(0)):
        kept = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, str(tmp_path))
            assert kept.columns == docs.columns, name
        ids = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
        assert {r.doc_id for r in ids} == ({1, 2, 3, 4, 5, None} if start is docs else set())
        assert len(ids) == (6 if start is docs else 0)


CLASHING = (
    "__id", "__version", "__doc", "__removed", "__lines", "__all", "__kept", "__stay", "text_of", "key",
    "places", "id", "version", "item", "set_id", "n", "line", "code", "label", "score", "n_shingles",
)


def test_columns_of_any_name_come_back_as_they_were(spark, tmp_path):
    rows = [
        (1, "one line of its own\nthe same line in two documents", 1),
        (2, "another line here\nthe same line in two documents", 2),
        (3, "words of a document that is copied once more below", 3),
        (4, "words of a document that is copied once more below", 4),
        (5, "a b c d e f g h", 5), (None, None, 6), (6, "", 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, value int")
    docs = docs.select("doc_id", "text", *[F.concat_ws("-", F.lit(c), "value").alias(c) for c in CLASHING])
    spark.createDataFrame([(4, 1)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f g h")], "item_id bigint, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    expected = {r.doc_id: r[2:] for r in docs.collect()}
    kept, left = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        found = kept.collect()
        left.append({r.doc_id for r in found})
        assert all(r[2:] == expected[r.doc_id] for r in found), name
    assert left == [{1, 2, 3, 4, 5, 6, None}, {1, 2, 3, 5, 6, None}, {1, 2, 3, 5, 6, None}, {1, 2, 3, 6, None}]
    near = shingle_join.one_of_each(docs).collect()
    assert {r.doc_id for r in near} == {1, 2, 3, 5, 6, None}
    assert all(r[2:] == expected[r.doc_id] for r in near)


def test_all_queries_are_registered():
    names = set(contract.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    for number in range(1, 11):
        assert sum(name.startswith(f"op{number}_") for name in names) == 1
    assert {"op7_seeds", "op8_shingle_join", "op10_line_join"} <= set(contract.oracle_sql())
