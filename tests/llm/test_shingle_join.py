"""Near duplicates against all pairs, and the parts of the join on their own."""

from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lexiscope.llm import components, shingle_join
from lexiscope.llm.hashing import span_hashes, word_spans


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower) if x]
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, similarity=75):
    sets = [(key, shingles(text)) for key, text in rows]
    reach = list(range(len(sets)))

    def root(i):
        while reach[i] != i:
            i = reach[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= similarity * len(a | b):
                reach[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), key), key)
    return sorted((key, len(s), least[root(i)]) for i, (key, s) in enumerate(sets))


def corpus(seed, count=120):
    draw = random.Random(seed)
    base = [[f"w{draw.randrange(300)}" for _ in range(draw.randrange(1, 90))] for _ in range(15)]
    common = [f"c{i}" for i in range(20)]
    rows = []
    for i in range(count):
        words = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
            words[draw.randrange(len(words))] = draw.choice(["Changed", "w1", "two parts"])
        if draw.random() < 0.3:
            words += common
        if draw.random() < 0.1:
            words = [f"own{i}-{k}" for k in range(draw.randrange(60))]
        rows.append((1000 - i, draw.choice([" ", "\n", " \t "]).join(words)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "a b"), (2004, "A  b"), (2005, "b a")]
    return rows + [(3000 + i, "one hot text that is repeated in many rows of it") for i in range(40)]


@pytest.mark.parametrize("seed,similarity", [(1, 75), (2, 75), (3, 60), (4, 90)])
def test_equals_all_pairs(spark, seed, similarity):
    rows = corpus(seed)
    frame = spark.createDataFrame(
        [(k, t, "n", 1) for k, t in rows], "doc_id bigint, text string, node string, n int"
    )
    found = sorted(tuple(r)[:3] for r in shingle_join.near_duplicates(frame, similarity).collect())
    assert found == brute(rows, similarity)


def test_many_ranges_and_no_broadcast_give_the_same(spark, monkeypatch):
    rows = corpus(5)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(shingle_join, "RANGE_BYTES", 100)
    monkeypatch.setattr(shingle_join, "BROADCAST_ROWS", -1)
    found = sorted(tuple(r)[:3] for r in shingle_join.near_duplicates(frame).collect())
    assert found == brute(rows)


def test_a_chain_of_near_copies_is_one_component(spark):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words)))
        words[i * 6] = f"new{i}"
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.component_id for r in shingle_join.near_duplicates(frame).collect()} == {0}


def test_repeated_rows_null_ids_long_texts_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (7, long), (9, long + " x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = shingle_join.near_duplicates(frame).collect()
    assert sorted((r.doc_id or 0, r.n_shingles) for r in found) == [
        (0, 2), (1, 2), (1, 2), (7, 59_996), (9, 59_997),
    ]
    assert {r.doc_id: r.component_id for r in found} == {1: 1, None: 1, 7: 7, 9: 7}
    assert shingle_join.near_duplicates(frame.limit(0)).collect() == []


def test_components_of_random_graphs(spark):
    draw = random.Random(8)
    edges = [(draw.randrange(80), draw.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(90, 140)]
    label = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r.node: r.label for r in components.connected_components(frame).collect()}
    assert found == {n: v for n, v in label.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_hashes_do_not_depend_on_the_place(monkeypatch):
    text = b"one two one  three\ttwo one " * 50
    data = np.frombuffer(text, np.uint8)
    bounds = np.array([0, len(data) // 2, len(data)])
    starts, ends, _ = word_spans(data, bounds)
    whole = span_hashes(data, starts, ends)
    monkeypatch.setattr("lexiscope.llm.hashing.PIECE", 16)
    assert (span_hashes(data, starts, ends) == whole).all()
    by_word = {}
    for s, e, h in zip(starts, ends, whole):
        by_word.setdefault(text[s:e], set()).add(h)
    assert all(len(v) == 1 for v in by_word.values())
    assert len({h for v in by_word.values() for h in v}) == len(by_word)
    assert [len(s) for s in shingle_join.shingle_sets(pa.array(["a b", None, "a b c d e f"]))] == [1, 0, 2]


def test_a_task_that_packs_shingles_needs_little_memory():
    """Its arrays do not grow with the batch: 48 MB of text in rows of 60 KB."""
    tasks = []

    class Docs:
        def mapInArrow(self, run, schema):
            tasks.append(run)

    for make in (lambda: shingle_join._pack(Docs(), 16, 75), lambda: shingle_join._whole_sets(Docs())):
        make()
    draw = np.random.default_rng(3)
    texts = [" ".join(draw.integers(0, 1 << 30, 6_000).astype(str)) for _ in range(800)]
    count = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([count, count, pa.array(texts)], names=["key", "version", "text"])
    for _ in tasks[0](iter([batch.slice(0, 20)])):
        pass
    for run in tasks:
        tracemalloc.start()
        for made in run(iter([batch])):
            del made
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60 << 20, peak >> 20
