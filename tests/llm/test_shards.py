"""Sharding against a brute-force version."""

from __future__ import annotations

import zlib

import pytest

from lexiscope.llm import shards
from lexiscope.llm.queries import QUERIES


def checked(found, rows, count):
    """Every record once; shards near equal in bytes; slots gapless; sizes and checksums right."""
    assert len(found) == len(rows)
    plain = sorted((key or 0, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for key, t in rows)
    assert sorted((r.doc_id or 0, r["size"], r.text_crc32) for r in found) == plain
    total = sum(size for _, size, _ in plain)
    largest = max((size for _, size, _ in plain), default=0)
    held = [[r for r in found if r.shard == s] for s in range(count)]
    assert sum(map(len, held)) == len(found)
    for members in held:
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert abs(sum(r["size"] for r in members) - total / count) <= 2 * largest
    assert {r.law for r in found} <= {"bytes"} and {r.grown_shard for r in found} <= {None}


@pytest.mark.parametrize("seed", [1, 2])
def test_a_hot_text_nulls_and_repeats(spark, seed):
    rows = [(i, "hot text " * 5) for i in range(300)]
    rows += [(1000 + i, f"text {i * seed} " * (i % 7)) for i in range(500)]
    rows += [(2000, "long " * 400), (2001, None), (2002, ""), (None, "no id"), (5, "same"), (5, "same")]
    frame = spark.createDataFrame(
        [(k, t, "x", 1) for k, t in rows], "doc_id bigint, text string, shard string, size int"
    )
    checked(shards.assign_shards(frame, 7).collect(), rows, 7)


def test_equal_texts_stand_side_by_side(spark):
    rows = [(i, f"text {i % 40}") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = shards.assign_shards(frame, 4).collect()
    spread = {}
    for row in found:
        spread.setdefault(row.text_crc32, set()).add(row.shard)
    assert sum(len(where) > 1 for where in spread.values()) <= 3


def test_overfull_ranges_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(shards, "SAMPLE_PER_RANGE", 2)
    rows = [(i, "a" * (i % 50)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    checked(shards.assign_shards(frame, 5).collect(), rows, 5)


def test_empty_table_and_fewer_rows_than_shards(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    assert shards.assign_shards(frame.limit(0), 3).collect() == []
    assert len(shards.assign_shards(frame, 9).collect()) == 2


def test_shards_are_written(spark, tmp_path):
    frame = spark.createDataFrame([(i, "t" * i) for i in range(50)], "doc_id bigint, text string")
    where = shards.write_shards(frame, str(tmp_path / "out"), 3)
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r["__shard"]) for r in stored.collect()} == {
        (r.doc_id, r.shard) for r in where.collect()
    }


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    checked(QUERIES["op4_shards"].run(spark, small).collect(), rows, 40)
