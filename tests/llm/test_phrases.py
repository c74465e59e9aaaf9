"""Removal of repeated strings against a brute-force version."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from lexiscope.llm import phrases
from lexiscope.llm.queries import QUERIES


def brute(rows, length):
    """Per row (id, bytes, removed, runs, digest of the rest), string by string."""
    seen, found = set(), []
    for key, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            string = data[at : at + length]
            if string in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(string)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        found.append((key, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(found)


def corpus(seed):
    draw = random.Random(seed)
    passages = ["".join(draw.choice("ab é\n") for _ in range(draw.randrange(1, 90))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [draw.choice(passages) for _ in range(draw.randrange(5))]
        parts.insert(draw.randrange(len(parts) + 1), "".join(draw.choice("xyz ") for _ in range(draw.randrange(40))))
        rows.append((draw.randrange(10**6), "".join(parts)))
    rows = list({k: (k, t) for k, t in rows}.values())
    rows += [(10**7, None), (10**7 + 1, ""), (10**7 + 2, "a" * 700), (10**7 + 3, "ab" * 300)]
    return rows + [(10**8 + i, "the same hot text in many rows, long enough to count") for i in range(20)]


@pytest.mark.parametrize("seed,length,trigger", [(1, 20, 6), (2, 30, 30), (3, 12, 1), (4, 40, 8)])
def test_equals_brute_force(spark, monkeypatch, seed, length, trigger):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 400)
    monkeypatch.setattr(phrases, "RANGE_BYTES", 300)
    rows = corpus(seed)
    frame = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, part int")
    found = phrases.repeat_digests(frame.repartition(5), length, trigger).collect()
    assert sorted(map(tuple, found)) == brute(rows, length)


def test_no_broadcast_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 400)
    rows = corpus(7)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = phrases.repeat_digests(frame, 25, 9).collect()
    assert sorted(map(tuple, found)) == brute(rows, 25)


@pytest.mark.parametrize("text", [b"abcabcab" * 60, b"x" * 500, bytes(range(32, 127)) * 9])
def test_pieces_do_not_change_the_parse(monkeypatch, text):
    data = np.frombuffer(text, np.uint8)
    bounds = np.array([0, 130, 131, len(data)])
    strings = lambda p: sorted(
        (s, t) for f, la, t in zip(p.first, p.last, p.trigger) for s in range(f, la + 1)
    )
    whole = strings(phrases.parse(data, bounds, 20, 5))
    monkeypatch.setattr(phrases, "PIECE", 64)
    assert strings(phrases.parse(data, bounds, 20, 5)) == whole
    assert [s for s, _ in whole] == [
        s for s in range(len(data)) if any(b <= s and s + 20 <= e for b, e in zip(bounds, bounds[1:]))
    ]


def test_kept_bytes_and_runs(spark):
    frame = spark.createDataFrame([(1, "0123456789" * 3), (2, "head 0123456789 tail")], "doc_id bigint, text string")
    found = {r.doc_id: r for r in phrases.remove_repeats(frame, 10, 4).collect()}
    assert bytes(found[1].kept) == b"0123456789" and found[1].starts == [10] and found[1].ends == [30]
    assert bytes(found[2].kept) == b"head  tail" and (found[2].starts, found[2].ends) == ([5], [15])


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a long enough text"), (1, "a long enough text"), (None, "a long enough text")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = phrases.repeat_digests(frame, 10, 4).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in found) == [(0, 0), (1, 18), (1, 18)]
    assert phrases.repeat_digests(frame.limit(0), 10, 4).collect() == []


def test_query_over_the_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = QUERIES["op3_phrases"].run(spark, small).collect()
    assert sorted(map(tuple, found)) == brute(rows, 100)
