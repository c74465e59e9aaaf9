"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_BYTES`` bytes. Each passage is encoded from the counts
of its byte pairs and a few shares (capitals, digits, marks, spaces, repeated words); the encoder,
the gated attention that weighs the passages, and the score of the weighted representation are
learnt together from the labels of whole documents, in numpy with Adam.

It is fitted on a bounded sample: the ``sample`` labelled documents with the smallest hash values
among those that are not held out. A text of more than ``passages`` passages gives the fit that many,
drawn evenly over its whole length. Scoring reads every whole text in one pass without a shuffle and
weighs all of its passages; only the fitted arrays are sent out. Labels, ids
and other columns are never part of a score.

Defined results: null and empty texts are one passage without content, and get its score; a row
without id counts as not held out; several labels of an id count as the lowest; without labels of
both kinds every score is the share of label 1, or a half without any; an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.arrow import keyed_text, small_slices, utf8_of
from lexiscope.llm.hashing import span_hashes, word_spans

PASSAGE_BYTES = 400
PAIRS = 256
SHARES = 6
HIDDEN, GATE = 24, 12
SAMPLE = 4_000
TRAINING_PASSAGES = 500  # of one text
BLOCK = 8_192  # passages encoded at a time
THRESHOLD = 0.7
DIGITS = 9  # of a score


def held_out(key: Column, parts: int = 4, part: int = 2) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts == part


def passage_features(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of the passages of texts in blocks, and the text that each passage belongs to."""
    counts = np.maximum(1, -(-np.diff(bounds) // PASSAGE_BYTES))
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    begin = bounds[:-1][owner] + (np.arange(len(owner)) - first[owner]) * PASSAGE_BYTES
    close = np.minimum(begin + PASSAGE_BYTES, bounds[1:][owner])
    starts, ends, first_word = word_spans(data, bounds)
    words = span_hashes(data, starts, ends)
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    heads = first_word[:-1]
    again[heads[heads < len(words)]] = False
    for low in range(0, len(owner), BLOCK):
        high = min(low + BLOCK, len(owner))
        rows = high - low
        some = data[begin[low] : close[high - 1]].astype(np.int64)
        length = close[low:high] - begin[low:high]
        row = np.repeat(np.arange(rows), length)
        pairs = (some[:-1] * 31 + some[1:] * 17) % PAIRS
        inside = row[1:] == row[:-1]
        at = row[:-1][inside] * PAIRS + pairs[inside]
        hist = np.bincount(at, minlength=rows * PAIRS).reshape(rows, PAIRS)
        share = lambda mask: np.bincount(row[mask], minlength=rows) / np.maximum(length, 1)
        word_low, word_high = np.searchsorted(starts, (begin[low], close[high - 1]))
        word_row = np.searchsorted(begin[low:high], starts[word_low:word_high], side="right") - 1
        n_words = np.bincount(word_row, minlength=rows)
        n_again = np.bincount(word_row[again[word_low:word_high]], minlength=rows)
        shares = np.stack(
            [
                share((some >= 65) & (some <= 90)),
                share((some >= 48) & (some <= 57)),
                share((some > 32) & (some < 48) | (some > 57) & (some < 65) | (some > 122) & (some < 127)),
                share((some == 32) | (some == 10)),
                n_again / np.maximum(n_words, 1),
                np.log1p(length) / 6,
            ],
            axis=1,
        )
        scaled = np.log1p(hist * (100 / np.maximum(length, 20))[:, None])
        yield np.hstack([scaled, shares * 4]).astype(np.float32), owner[low:high]


@dataclass
class AttentionModel:
    """Arrays of the fitted model. ``constant`` is set where there was nothing to learn."""

    arrays: dict[str, np.ndarray]
    constant: float | None = None

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text.

        Computed with 53 bits and rounded to ``DIGITS``: the last bits of a matrix product depend on
        how many rows it has, and equal texts must get equal scores in any batch.
        """
        count = len(bounds) - 1
        if self.constant is not None or not count:
            return np.full(count, 0.5 if self.constant is None else self.constant)
        a = {name: x.astype(np.float64) for name, x in self.arrays.items()}
        coded, owners = [], []
        for features, owner in passage_features(data, bounds):
            coded.append(np.tanh(((features - a["mean"]) / a["scale"]) @ a["w"] + a["b"]))
            owners.append(owner)
        hidden, owner = np.vstack(coded), np.concatenate(owners)
        weights, _, _ = _attention(a, hidden, owner, count)
        bags = np.zeros((count, hidden.shape[1]))
        starts = np.searchsorted(owner, np.arange(count))
        bags[:] = np.add.reduceat(hidden * weights[:, None], starts, axis=0)
        return np.round(_sigmoid(bags @ a["c"] + a["d"][0]), DIGITS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _attention(a: dict, hidden: np.ndarray, owner: np.ndarray, count: int):
    """Weight of each passage in its document, and the two parts of its gate."""
    content, gate = np.tanh(hidden @ a["v"]), _sigmoid(hidden @ a["u"])
    logits = (content * gate) @ a["e"]
    starts = np.searchsorted(owner, np.arange(count))
    raised = np.exp(logits - np.maximum.reduceat(logits, starts)[owner])
    return raised / np.add.reduceat(raised, starts)[owner], content, gate


def _gradients(a: dict, x: np.ndarray, owner: np.ndarray, labels: np.ndarray, decay: float) -> dict:
    count = len(labels)
    starts = np.searchsorted(owner, np.arange(count))
    hidden = np.tanh(x @ a["w"] + a["b"])
    weights, content, gate = _attention(a, hidden, owner, count)
    bags = np.add.reduceat(hidden * weights[:, None], starts, axis=0)
    error = (_sigmoid(bags @ a["c"] + a["d"][0]) - labels) / count
    to_bag = np.outer(error, a["c"])[owner]
    to_weight = (to_bag * hidden).sum(axis=1)
    mean = np.add.reduceat(weights * to_weight, starts)[owner]
    to_logit = weights * (to_weight - mean)
    to_gated = np.outer(to_logit, a["e"])
    to_content = to_gated * gate * (1 - content**2)
    to_gate = to_gated * content * gate * (1 - gate)
    to_hidden = to_bag * weights[:, None] + to_content @ a["v"].T + to_gate @ a["u"].T
    to_sum = to_hidden * (1 - hidden**2)
    found = {
        "w": x.T @ to_sum, "b": to_sum.sum(axis=0), "v": hidden.T @ to_content,
        "u": hidden.T @ to_gate, "e": (content * gate).T @ to_logit, "c": bags.T @ error,
        "d": np.array([error.sum()]),
    }
    return {k: g + decay * a[k] * (k in ("w", "v", "u", "c")) for k, g in found.items()}


def fit(
    features: list[np.ndarray],
    labels: np.ndarray,
    epochs: int = 20,
    batch: int = 128,
    rate: float = 0.004,
    decay: float = 1e-4,
    seed: int = 7,
) -> AttentionModel:
    """Fit a model to the passage features and the label of each document."""
    if len(labels) == 0 or labels.min() == labels.max():
        return AttentionModel({}, float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    total = np.vstack(features)
    mean, scale = total.mean(axis=0), total.std(axis=0) + 0.05
    width = total.shape[1]
    start = {
        "w": rng.normal(0, width**-0.5, (width, HIDDEN)), "b": np.zeros(HIDDEN),
        "v": rng.normal(0, 0.3, (HIDDEN, GATE)), "u": rng.normal(0, 0.3, (HIDDEN, GATE)),
        "e": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN),
        "d": np.array([np.log(labels.mean() / (1 - labels.mean()))]),
    }
    a = {k: v.astype(np.float32) for k, v in start.items()}
    features = [((f - mean) / scale).astype(np.float32) for f in features]
    first = {k: np.zeros_like(v) for k, v in a.items()}
    second = {k: np.zeros_like(v) for k, v in a.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for low in range(0, len(order), batch):
            some = order[low : low + batch]
            x = np.vstack([features[i] for i in some])
            owner = np.repeat(np.arange(len(some)), [len(features[i]) for i in some])
            step += 1
            for k, g in _gradients(a, x, owner, labels[some], decay).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                moved = first[k] / (1 - 0.9**step)
                a[k] = a[k] - rate * moved / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                a[k] = a[k].astype(np.float32)
    return AttentionModel(a | {"mean": mean, "scale": scale})


def _evenly(bounds: np.ndarray, most: int) -> np.ndarray:
    """Which passages of each text the fit reads: all, or ``most`` with equal distances."""
    counts = np.maximum(1, -(-np.diff(bounds) // PASSAGE_BYTES))
    ends = np.cumsum(counts)
    drawn = np.ones(int(counts.sum()), bool)
    for at in np.flatnonzero(counts > most):
        count, end = int(counts[at]), int(ends[at])
        drawn[end - count : end] = False
        drawn[end - count + (2 * np.arange(most) + 1) * count // (2 * most)] = True
    return drawn


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    sample: int = SAMPLE,
    key: str = "doc_id",
    text: str = "text",
    passages: int = TRAINING_PASSAGES,
) -> AttentionModel:
    """Fit a model to at most ``sample`` labelled documents that are not held out.

    ``passages`` bounds what one text costs the fit, not which texts take part in it.
    """
    known = (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
        .filter(~held_out(F.col(key)))
        .groupBy(F.col(key).cast("bigint").alias("key"))
        .agg(F.min(F.col(label).cast("int")).alias("label"))
    )
    drawn = known.orderBy(F.xxhash64("key"), "key").limit(sample)
    # at most ``sample`` rows
    texts = keyed_text(docs, key, text).join(F.broadcast(drawn), "key").select("key", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in small_slices(batch, "text", 1 << 20):
                data, bounds = utf8_of(some.column("text"))
                drawn = _evenly(bounds, passages)
                found, owners, low = [], [], 0
                for features, of in passage_features(data, bounds):
                    used = drawn[low : low + len(of)]
                    low += len(of)
                    found.append(features[used].astype(np.float16))
                    owners.append(of[used])
                x, owner = np.vstack(found), np.concatenate(owners)
                cuts = np.searchsorted(owner, np.arange(some.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("key"),
                        some.column("label"),
                        pa.array([x[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])]),
                    ],
                    names=["key", "label", "features"],
                )

    found = texts.mapInArrow(run, "key bigint, label int, features binary").collect()
    found.sort(key=lambda row: (row.key, bytes(row.features)))
    features = [
        np.frombuffer(row.features, np.float16).reshape(-1, PAIRS + SHARES).astype(np.float32)
        for row in found
    ]
    return fit(features, np.array([row.label for row in found], np.float32))


def score_quality(
    docs: DataFrame, model: AttentionModel, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, its ``score``, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in small_slices(batch, "text", 1 << 20):
                scores = model.score(*utf8_of(some.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [some.column("key"), pa.array(scores, pa.float64())], names=["key", "score"]
                )

    return keyed_text(docs, key, text).mapInArrow(run, "key bigint, score double")


def keep_quality(
    docs: DataFrame, model: AttentionModel, threshold: float = THRESHOLD, text: str = "text"
) -> DataFrame:
    """The rows whose text scores at least ``threshold``, with all their columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in small_slices(batch, text, 1 << 20):
                texts = pc.fill_null(some.column(text), "")
                kept = model.score(*utf8_of(texts)) >= threshold
                yield some.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def quality_table(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Score and decision for every row: ``doc_id, held_out, score, predicted``."""
    scored = score_quality(docs, train_quality(docs, labels, key=key, text=text), key, text)
    return scored.select(
        F.col("key").alias("doc_id"),
        held_out(F.col("key")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
