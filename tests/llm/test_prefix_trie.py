"""The prefix trie against a brute-force version and against SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lexiscope.llm import prefix_trie
from lexiscope.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n bigint, depth string"


def mark(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), role, mark(role, text), text))
    own = {c: [(t[1], t[3]) for t in sorted(turns)] for c, turns in own.items()}
    nodes = defaultdict(list)
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - (conv % 20 if conv >= 0 else -(-conv % 20))
        whole = (*own.get(base, [])[:h], *turns[h:])
        for depth in range(len(whole) + 1):
            nodes[whole[:depth]].append((conv, len(whole)))
    children = defaultdict(int)
    for prefix in nodes:
        if prefix:
            children[prefix[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for prefix, members in nodes.items():
        words = len(re.findall("[^\x20\x09-\x0d]+", prefix[-1][1])) if prefix else 0
        for depth in range(len(prefix) + 1):
            leaves[prefix[:depth]] += not children[prefix]
            saved[prefix[:depth]] += (len(members) - 1) * words
    found = []
    for prefix, members in nodes.items():
        ends = ",".join(str(c) for c, n in sorted(members) if n == len(prefix))
        above = min(nodes[prefix[:-1]])[0] if prefix else None
        found.append(
            (min(members)[0], len(prefix), above, len(members), children[prefix], leaves[prefix],
             saved[prefix], hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(found, key=str)


def made(seed):
    r = random.Random(seed)
    rows = []
    for conv in range(-30, 140):
        for turn in range(r.choice([0, 1, 2, 3, 4, 5, 9])):
            role, text = r.choice(["u", "a", None, ""]), r.choice(["x", "y  z\t\n", "x", "", None])
            rows.append((conv, r.choice([None, turn, turn, turn]), role, text))
    rows += [(40 + i, t, "u", "the same turn") for i in range(60) for t in range(3)]
    rows += [(None, 1, "u", "no id"), (7, 1, "u", "x"), (7, 1, "u", "x")]
    return rows


def trie(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    return sorted(map(tuple, prefix_trie.prefix_trie(frame).collect()), key=str)


@pytest.mark.parametrize(("seed", "turns", "ids"), [(1, 15, 2), (2, 60, 3), (3, 500_000, 4_096)])
def test_brute_force(spark, monkeypatch, seed, turns, ids):
    monkeypatch.setattr(prefix_trie, "RANGE_TURNS", turns)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", ids)
    monkeypatch.setattr(prefix_trie, "SMALL", 10 if seed == 2 else 100_000)
    rows = made(seed)
    assert trie(spark, rows) == plain(rows)


def test_copies_fill_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RANGE_TURNS", 40)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    rows = [(20 * i, t, "u", f"t{t}") for i in range(200) for t in range(3)]
    assert trie(spark, rows) == plain(rows)


def test_long_conversations_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RANGE_TURNS", 300)
    rows = [(20 * c, t, "u", f"word {t}") for c in range(3) for t in range(400 + c)]
    rows += [(60, t, "u", f"word {t}" if t < 200 else f"other {t}") for t in range(500)]
    rows.append((100, 0, "u", "long text " * 100_000))
    assert trie(spark, rows) == plain(rows)
    assert trie(spark, rows[:1])[0][3] == 1
    frame = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(frame).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "x", 1, "")], SCHEMA)).collect() == []


def test_a_conversation_without_turns_of_its_own(spark):
    lone = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lone, 0, "u", "taken away")]
    assert trie(spark, rows) == plain(rows) == [
        (lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())
    ]


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64, 100])
def test_ends_found_in_the_table_of_minima(size):
    rng = np.random.default_rng(size)
    values = rng.integers(0, 5, size)
    values[0] = -1
    table = prefix_trie.Minima(values)
    at, least = np.repeat(np.arange(size), 6), np.tile(np.arange(6), size)
    right, left = table.reach_right(at, least), table.reach_left(at, least)
    for i in range(len(at)):
        end, begin = at[i], at[i]
        while end + 1 < size and values[end + 1] >= least[i]:
            end += 1
        while begin >= 0 and values[begin] >= least[i]:
            begin -= 1
        assert (left[i], right[i]) == (begin, end)
    first, last = np.minimum(at, least % size), np.maximum(at, least % size)
    assert table.of(first, last).tolist() == [values[a : b + 1].min() for a, b in zip(first, last)]


def test_query_equals_its_sql(spark, duck, small):
    query = QUERIES["op13_prefix_trie"]
    ours = sorted(map(tuple, query.run(spark, small).collect()), key=str)
    assert ours and ours == sorted(duck.execute(query.sql).fetchall(), key=str)
