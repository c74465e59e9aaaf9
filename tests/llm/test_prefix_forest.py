"""Nearest neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from lexiscope.llm import prefix_forest
from lexiscope.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, score double, query string"


def frame_of(spark, rows):
    return spark.createDataFrame([(k, v, 0.5, "q") for k, v in rows], SCHEMA)


def brute(rows, every, k):
    sound = [
        (key, np.array(v, np.float32).astype(float))
        for key, v in rows
        if key is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)
    ]
    found = {}
    for key, vector in sound:
        if key % every == 0:
            away = [(float(np.sqrt(((vector - w) ** 2).sum())), other) for other, w in sound if other != key]
            found[key] = sorted(away)[:k]
    return found


def by_query(found):
    answers = {}
    for row in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        answers.setdefault(row.query_id, []).append((row.score, row.vec_id))
        assert row["rank"] == len(answers[row.query_id])
    return answers


def recall(found, expected):
    pairs = [(q, v) for q, near in expected.items() for _, v in near]
    return np.mean([v in {x for _, x in found.get(q, [])} for q, v in pairs])


def test_recall_and_distances_over_the_embeddings(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found = by_query(QUERIES["op6_prefix_forest"].run(spark, folder).collect())
    expected = brute(rows, 100, 10)
    assert found.keys() == expected.keys() and recall(found, expected) >= 0.9
    vectors = dict(rows)
    for query, near in found.items():
        assert near == sorted(near) and len(near) == 10
        for score, other in near:
            away = np.array(vectors[query], float) - np.array(vectors[other], float)
            assert score == pytest.approx(np.sqrt((away**2).sum()), rel=1e-14)


def test_clusters_are_found_without_reading_all(spark, monkeypatch):
    monkeypatch.setattr(prefix_forest, "CELL_ROWS", 64)
    monkeypatch.setattr(prefix_forest, "FULL_CELL", 100)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(0, 0.02, 16)).tolist()) for i in range(2000)]
    found = by_query(prefix_forest.nearest_neighbours(frame_of(spark, rows), 50).collect())
    assert recall(found, brute(rows, 50, 10)) >= 0.9


def test_a_hot_vector_ties_and_unusable_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_forest, "FULL_CELL", 30)
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(200)]
    rows += [(200 + i, rng.normal(size=4).tolist()) for i in range(100)]
    rows += [(1000, None), (1001, [0.0] * 4), (1002, [float("nan"), 1.0, 1.0, 1.0]), (1003, [1.0, None, 1.0, 1.0])]
    rows += [(1004, [float("inf"), 1.0, 1.0, 1.0]), (1005, [1.0]), (None, [1.0, 2.0, 3.0, 4.0]), (1006, [])]
    found = by_query(prefix_forest.nearest_neighbours(frame_of(spark, rows), 50).collect())
    expected = brute([r for r in rows if r[1] is not None and len(r[1]) == 4], 50, 10)
    assert found.keys() == expected.keys()
    for query in (0, 50, 100, 150):
        assert found[query] == expected[query]
    assert found[0] == [(0.0, i) for i in range(1, 11)]


def test_few_rows_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    found = by_query(prefix_forest.nearest_neighbours(frame_of(spark, rows)).collect())
    assert found == {0: [(1.0, 2), (pytest.approx(2**0.5), 1)]}
    one = frame_of(spark, rows[:1])
    assert prefix_forest.nearest_neighbours(one).collect() == []
    assert prefix_forest.nearest_neighbours(one.limit(0)).collect() == []
    assert len(prefix_forest.nearest_neighbours(frame_of(spark, rows + rows)).collect()) == 2


def test_equal_vectors_alone(spark):
    rows = [(i, [0.5, 0.5]) for i in range(30)]
    found = by_query(prefix_forest.nearest_neighbours(frame_of(spark, rows), 10, 3).collect())
    assert found[10] == [(0.0, 0), (0.0, 1), (0.0, 2)]
