"""Divergence of sources against a brute-force version and against SQL."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lexiscope.llm import divergence
from lexiscope.llm.arrow import utf8_of
from lexiscope.llm.queries import QUERIES

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
CAPITALS = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
SCHEMA = "doc_id bigint, text string, lang string, source string, item string, value int"


def plain(rows, min_docs):
    """``rows`` are of text, language and source."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(CAPITALS))
        group = (lang or "", source or "")
        groups.add(group)
        counts[group].update(terms)
        docs[group[0]].update(set(terms))
    found = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        members = [g for g in groups if g[0] == lang]
        share = {}
        whole = Counter()
        for group in members:
            whole.update(counts[group])
        for name, count in [*((g, counts[g]) for g in members), (None, whole)]:
            size = sum(count[t] for t in kept)
            share[name] = {t: 1 + 10**9 * (count[t] + 2) // (size + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        for me in members:
            pairs = [
                (sum(f(share[me][t], share[you][t]) for t in kept), you[1]) for you in members if you != me
            ]
            terms = [
                (f(share[me][t], share[None][t]), t)
                for t in kept
                if counts[me][t] and share[me][t] > share[None][t]
            ]
            for part, values, most in (("pair", pairs, None), ("term", terms, 10)):
                values.sort(key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(values[:most], 1):
                    found.append((*me, part, item, value, rank))
    return sorted(found)


def made(seed, rows=400):
    r = random.Random(seed)
    words = [w for w in "The of AND été ÉTÉ naïve x1y 中文 don't".split()] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    sources = ["hot", "hot", "hot", *(f"s{i}" for i in range(7)), None, ""]
    found = []
    for _ in range(rows):
        text = " ".join(r.choice(words[: r.choice([6, 30, 70])]) for _ in range(r.randrange(12)))
        found.append((r.choice([text, text, text, None, "", "12 - 3"]), r.choice(["a", "a", "a", "b", None]), r.choice(sources)))
    return found


@pytest.mark.parametrize(("seed", "min_docs"), [(1, 10), (2, 2), (3, 1), (4, 10_000)])
def test_brute_force(spark, monkeypatch, seed, min_docs):
    monkeypatch.setattr(divergence, "SLICE", 40)
    monkeypatch.setattr(divergence, "PEERS", 3)
    monkeypatch.setattr(divergence, "CELLS", 16)
    rows = made(seed)
    frame = spark.createDataFrame([(None, *r, "clash", 1) for r in rows], SCHEMA)
    found = divergence.source_divergence(frame, min_docs=min_docs)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == plain(rows, min_docs)


def test_empty_tables_and_single_sources(spark):
    frame = spark.createDataFrame([(1, "a a b", "x", "s", "", 0)] * 12, SCHEMA)
    assert divergence.source_divergence(frame.limit(0)).collect() == []
    assert divergence.source_divergence(frame).collect() == []  # its shares are those of the language
    two = frame.unionAll(spark.createDataFrame([(2, None, "x", "t", "", 0)], SCHEMA))
    found = sorted(map(tuple, divergence.source_divergence(two).collect()))
    assert found == plain([("a a b", "x", "s")] * 12 + [(None, "x", "t")], 10)


def test_a_very_long_text(spark):
    rows = [("long word " * 60_000, "x", "s")] * 10 + [("word other", "x", "t")] * 10
    frame = spark.createDataFrame([(1, *r, "", 0) for r in rows], SCHEMA)
    assert sorted(map(tuple, divergence.source_divergence(frame).collect())) == plain(rows, 10)


def test_shares_of_very_large_counts(spark):
    counts = [(0, 0, 1), (5, 9, 2), (10**17, 3 * 10**17, 10**6), (10**17, 10**17, 1), (999, 10**12, 7)]
    frame = spark.createDataFrame(counts, "n bigint, size bigint, v bigint")
    c = divergence.F.col
    found = frame.select("n", "size", "v", divergence.share(c("n"), c("size"), c("v")).alias("p")).collect()
    for row in found:
        assert row.p == 1 + 10**9 * (row.n + 2) // (row["size"] + 2 * row.v)


def test_terms_do_not_cross_texts():
    texts = pa.array(["ab", "cd e", "", "é", "èx 1Y"])
    found, owner = divergence.terms_of(*utf8_of(texts))
    assert found.to_pylist() == ["ab", "cd", "e", "é", "èx", "y"]
    assert owner.tolist() == [0, 1, 1, 3, 4, 4]


def test_difference_is_exact():
    p, q = np.array([10**9 + 1, 1, 7]), np.array([1, 10**9 + 1, 7])
    assert divergence.difference(p, q).tolist() == [10**18 // (10**9 + 2)] * 2 + [0]


def test_query_equals_its_sql(spark, duck, small):
    query = QUERIES["op12_source_divergence"]
    ours = sorted(map(tuple, query.run(spark, small).collect()))
    assert ours and ours == sorted(duck.execute(query.sql).fetchall())
