"""The language classifier: a plain recomputation of scores, held-out accuracy, awkward rows."""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from lexiscope.llm import ftrl_language
from lexiscope.llm.queries import QUERIES

MEDIUM = "/root/testdata/sf0.01"


def plain_ngrams(text):
    """The n-grams of a text as strings, one character after the other."""
    run = [" "]
    for char in text or "":
        if unicodedata.category(char)[0] in "LM":
            small = char.lower()
            run.append(small if len(small) == 1 else char)
        elif run[-1] != " ":
            run.append(" ")
    found = Counter()
    for end in range(1, len(run)):
        for size in (1, 2, 3):
            if end - size + 1 >= 0:
                found["".join(run[end - size + 1 : end + 1])] += 1
    return found


def bucket(ngram):
    mask = (1 << 64) - 1
    mixed = len(ngram)
    for at, char in enumerate(ngram):
        mixed = (mixed ^ ord(char)) * int(ftrl_language._FACTORS[at]) & mask
        mixed ^= mixed >> 29
    return (mixed * int(ftrl_language._FACTORS[0]) & mask) >> 50


def plain_counts(text):
    counts = Counter()
    for ngram, n in plain_ngrams(text).items():
        counts[bucket(ngram)] += n
    return counts


@pytest.mark.parametrize("piece", [3, 7, 1 << 20])
def test_ngrams_of_any_pieces(monkeypatch, piece):
    monkeypatch.setattr(ftrl_language, "PIECE_BYTES", piece)
    texts = ["Ein Haus, zwei Häuser", "", "  12 中文 ?! x", "a", "\U0001d4d0b\n\nc", "İx 3", "...", "word " * 50]
    for text in texts:
        counts, letters = ftrl_language.ngram_counts(np.frombuffer(text.encode(), np.uint8))
        assert {int(b): int(counts[b]) for b in np.flatnonzero(counts)} == dict(plain_counts(text))
        assert letters == any(c.isalpha() for c in text)


def test_query_recomputed_and_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = ftrl_language.learn_languages(docs)
    found = QUERIES["op11_ftrl_language"].run(spark, MEDIUM).collect()
    assert sorted(r.doc_id for r in found) == sorted(rows)
    learnt = [r for r in rows.values() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    seen = Counter(b for r in learnt for b in plain_counts(r.text))
    held = []
    for row in found:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert 0 <= row.score <= 1 and row.lang_pred in model.languages
        if row.held_out:
            held.append(row.lang_pred == rows[row.doc_id].lang)
    assert np.mean(held) > 0.98
    for row in found[:15]:
        counts = plain_counts(rows[row.doc_id].text)
        values = {b: math.log(1 + n) * (math.log((1 + len(learnt)) / (1 + seen[b])) + 1) for b, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in values.values()))
        logits = [
            sum(v / norm * model.weights[b, k] for b, v in values.items()) + model.bias[k]
            for k in range(len(model.languages))
        ]
        top = max(logits)
        raised = [math.exp((x - top) / model.temperature) for x in logits]
        assert abs(row.score - max(raised) / sum(raised)) < 1e-6
        assert row.lang_pred == model.languages[int(np.argmax(raised))]


def test_weights_follow_the_regularised_leader():
    """The learnt weights minimise the sum of linear losses and penalties that FTRL states."""
    model = ftrl_language.LanguageModel(("a", "b"), np.ones(ftrl_language.BUCKETS), None, None)
    rng = np.random.default_rng(4)
    examples = [
        (np.array([i % 5, 5 + i % 3]), np.array([0.6, 0.8]) * (1 if i % 7 else 0.1), int(rng.integers(2)))
        for i in range(60)
    ]
    ftrl_language.follow_the_leader(model, examples, epochs=1, alpha=0.3, l1=0.4, l2=0.2)
    z, n = np.zeros((8, 2)), np.zeros((8, 2))
    bz, bn = np.zeros(2), np.zeros(2)

    def closed(z, n, l1, l2):
        weight = np.zeros_like(z)
        for at in np.ndindex(z.shape):
            if abs(z[at]) > l1:
                weight[at] = -(z[at] - math.copysign(l1, z[at])) / ((1 + math.sqrt(n[at])) / 0.3 + l2)
        return weight

    for buckets, values, language in examples:
        w, b = closed(z, n, 0.4, 0.2), closed(bz, bn, 0, 0)
        logits = values @ w[buckets] + b
        p = np.exp(logits) / np.exp(logits).sum()
        p[language] -= 1
        for k in range(2):
            for bucket_, value in zip(buckets, values):
                g = value * p[k]
                z[bucket_, k] += g - (math.sqrt(n[bucket_, k] + g * g) - math.sqrt(n[bucket_, k])) / 0.3 * w[bucket_, k]
                n[bucket_, k] += g * g
            bz[k] += p[k] - (math.sqrt(bn[k] + p[k] ** 2) - math.sqrt(bn[k])) / 0.3 * b[k]
            bn[k] += p[k] ** 2
    assert np.allclose(model.weights[:8], closed(z, n, 0.4, 0.2)) and not model.weights[8:].any()
    assert np.allclose(model.bias, closed(bz, bn, 0, 0)) and (model.weights[:8] == 0).any()


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(400, 3))
    chances = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    language = np.array([rng.choice(3, p=c) for c in chances])
    assert 2 < ftrl_language.calibrate(logits * 3, language) < 4.5


def test_awkward_rows(spark):
    rows = [(i, "the house and the dog", "en", "x") for i in range(8)]
    rows += [(10 + i, "das haus und der hund", "de", "x") for i in range(8)]
    rows += [
        (100, None, "en", "x"), (101, "", "de", "x"), (102, "12 .. !", None, "x"),
        (None, "the dog", "en", "x"), (None, "the dog", "en", "x"), (103, "der hund " * 40_000, None, "x"),
        (104, "the dog", None, "y"), (104, "the dog", None, "y"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    found = ftrl_language.language_table(docs).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for key in (100, 101, 102):
        assert (by_id[key].lang_pred, by_id[key].score) == ("und", 0.0)
    assert by_id[103].lang_pred == "de" and by_id[104].lang_pred == "en"
    texts = {r[0]: r[1] for r in rows}
    scores = {}
    for r in found:
        scores.setdefault(texts[r.doc_id], set()).add((r.lang_pred, r.score))
    assert {len(s) for s in scores.values()} == {1}
    assert not [r for r in found if r.doc_id is None and r.held_out]
    assert ftrl_language.language_table(docs.limit(0)).collect() == []
    untold = ftrl_language.language_table(docs.filter("lang IS NULL")).collect()
    assert {(r.lang_pred, r.score) for r in untold} == {("und", 0.0)}


def test_the_sample_is_shared_among_languages_and_bounded(spark):
    rows = [(i, f"text {i}", "en") for i in range(500)] + [(1000 + i, f"x {i}", "fr") for i in range(5)]
    rows += [(7, "same", "en")] * 300
    known = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    known = known.select("lang", ftrl_language.F.xxhash64("doc_id", "lang", "text").alias("draw"), "text")
    sizes = {"en": 501, "fr": 5}
    drawn = ftrl_language.drawn_sample(known, sizes, 40).collect()
    per = Counter(r.lang for r in drawn)
    assert per == {"en": 20, "fr": 5} and len({r.draw for r in drawn}) == 25
    again = ftrl_language.drawn_sample(known.repartition(7), sizes, 40).collect()
    assert {r.draw for r in again} == {r.draw for r in drawn}
