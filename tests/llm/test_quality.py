"""The quality classifier: its gradients, its accuracy on held-out rows, and awkward input."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from lexiscope.llm import quality
from lexiscope.llm.arrow import utf8_of
from lexiscope.llm.queries import QUERIES

MEDIUM = "/root/testdata/sf0.01"


def small_model(seed=1):
    rng = np.random.default_rng(seed)
    return {
        "w": rng.normal(size=(9, 5)), "b": rng.normal(size=5), "v": rng.normal(size=(5, 3)),
        "u": rng.normal(size=(5, 3)), "e": rng.normal(size=3), "c": rng.normal(size=5),
        "d": rng.normal(size=1),
    }


def loss(a, x, owner, labels):
    hidden = np.tanh(x @ a["w"] + a["b"])
    weights, _, _ = quality._attention(a, hidden, owner, len(labels))
    bags = np.stack([(hidden * weights[:, None])[owner == i].sum(axis=0) for i in range(len(labels))])
    p = quality._sigmoid(bags @ a["c"] + a["d"][0])
    return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))


@pytest.mark.parametrize("name", ["w", "b", "v", "u", "e", "c", "d"])
def test_gradients_are_those_of_the_loss(name):
    rng = np.random.default_rng(3)
    owner = np.array([0, 0, 0, 1, 2, 2])
    x, labels = rng.normal(size=(6, 9)), np.array([1.0, 0.0, 1.0])
    a = small_model()
    found = quality._gradients(a, x, owner, labels, 0.0)[name]
    for at in np.ndindex(a[name].shape):
        moved = {k: v.copy() for k, v in a.items()}
        moved[name][at] += 1e-6
        up = loss(moved, x, owner, labels)
        moved[name][at] -= 2e-6
        assert abs((up - loss(moved, x, owner, labels)) / 2e-6 - found[at]) < 1e-5


def test_held_out_rows_are_told_apart(spark):
    found = QUERIES["op2_passage_quality"].run(spark, MEDIUM).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    assert len(found) == 1000
    for row in found:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.7)
    held = [(r.score, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean(np.array(good) >= 0.7) > 0.95


def test_passages_cover_whole_texts_and_only_them():
    texts = quality.pa.array(["a" * 1000, "", "x y", "word " * 4000])
    blocks = list(quality.passage_features(*utf8_of(texts)))
    owner = np.concatenate([b[1] for b in blocks])
    assert np.bincount(owner).tolist() == [3, 1, 1, 50]
    alone = list(quality.passage_features(*utf8_of(texts.slice(3, 1))))
    together = np.vstack([b[0] for b in blocks])[owner == 3]
    assert np.allclose(np.vstack([b[0] for b in alone]), together)


def test_scores_do_not_depend_on_the_batch(spark):
    rng = np.random.default_rng(0)
    width = quality.PAIRS + quality.SHARES
    labels = np.arange(40) % 2
    features = [rng.normal(size=(1 + i % 3, width)).astype(np.float32) + labels[i] for i in range(40)]
    model = quality.fit(features, labels.astype(np.float32), epochs=3)
    texts = quality.pa.array(["one", "", "two words " * 200, "3"])
    whole = model.score(*utf8_of(texts))
    alone = [model.score(*utf8_of(texts.slice(i, 1)))[0] for i in range(4)]
    assert np.allclose(whole, alone)


def test_awkward_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (2, "", 5), (None, "no id", 5), (4, "long text " * 30_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (4, 0), (4, 1)], "doc_id bigint, quality int")
    found = quality.quality_table(docs, labels).collect()
    assert len(found) == 5 and len({r.score for r in found if r.doc_id in (1, 2)}) == 1
    only = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    assert {r.score for r in quality.quality_table(docs, only).collect()} == {1.0}
    none = quality.quality_table(docs, only.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {0}
    assert quality.quality_table(docs.limit(0), only).collect() == []
    model = quality.AttentionModel({}, 0.9)
    kept = quality.keep_quality(docs, model)
    assert kept.columns == docs.columns and kept.count() == 5


def test_long_texts_take_part_in_the_fit(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda features, labels: seen.append((features, labels)))
    long = "".join(f"passage {i} ".ljust(quality.PASSAGE_BYTES, "abcdefg"[i % 7]) for i in range(1300))
    rows = [(1, "short"), (3, long), (4, long[: 500 * quality.PASSAGE_BYTES])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id bigint, quality int")
    assert docs.filter(quality.held_out(quality.F.col("doc_id"))).isEmpty()
    quality.train_quality(docs, labels)
    features, found = seen[0]
    assert found.tolist() == [1, 1, 0] and [len(f) for f in features] == [1, 500, 500]
    whole = np.vstack([f for f, _ in quality.passage_features(*utf8_of(quality.pa.array([long])))])
    drawn = whole[(2 * np.arange(500) + 1) * 1300 // 1000].astype(np.float16)
    assert np.array_equal(features[1], drawn.astype(np.float32))
    assert quality._evenly(np.array([0, 520_000, 520_000, 520_010]), 500).sum() == 502


def test_equal_texts_get_equal_scores_and_one_is_recomputed(spark):
    rng = np.random.default_rng(5)
    width = quality.PAIRS + quality.SHARES
    labels = np.arange(60) % 2
    features = [rng.normal(size=(1 + i % 4, width)).astype(np.float32) + labels[i] for i in range(60)]
    model = quality.fit(features, labels.astype(np.float32), epochs=3)
    texts = [f"passage {i % 9} of some text. " * (1 + 7 * (i % 9)) for i in range(90)]
    whole = model.score(*utf8_of(quality.pa.array(texts)))
    assert len(set(whole)) == 9
    for size in (1, 7, 40):
        parts = [quality.pa.array(texts[i : i + size]) for i in range(0, 90, size)]
        assert np.concatenate([model.score(*utf8_of(p)) for p in parts]).tolist() == whole.tolist()
    a = model.arrays
    for at in (0, 4, 8):
        found = quality.passage_features(*utf8_of(quality.pa.array([texts[at]])))
        hidden, logits = [], []
        for passage in np.vstack([f for f, _ in found]):
            code = [
                np.tanh(sum((passage[i] - a["mean"][i]) / a["scale"][i] * a["w"][i, k] for i in range(width)) + a["b"][k])
                for k in range(quality.HIDDEN)
            ]
            gated = [
                np.tanh(np.dot(code, a["v"][:, k])) / (1 + np.exp(-np.dot(code, a["u"][:, k]))) * a["e"][k]
                for k in range(quality.GATE)
            ]
            hidden.append(code)
            logits.append(sum(gated))
        weights = np.exp(logits) / np.exp(logits).sum()
        bag = sum(w * np.array(h) for w, h in zip(weights, hidden))
        assert abs(whole[at] - 1 / (1 + np.exp(-(bag @ a["c"] + a["d"][0])))) < 1e-5
