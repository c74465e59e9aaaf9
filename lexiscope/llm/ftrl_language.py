"""Language of texts by sparse multinomial logistic regression on character n-grams.

A text is lower-cased, runs of other characters than letters and marks become one space, and its
n-grams of one to three characters are counted in ``BUCKETS`` hashed buckets. Features are
``log(1 + count) * idf``, scaled to length one. The document frequencies behind ``idf`` are counted
over all learnt documents in one pass. The weights are learnt by follow-the-regularised-leader, with
a step size of its own for every weight and an elastic net (``l1``, ``l2``) that leaves most of them
at zero. A temperature, fitted on a fifth of the sample that the weights don't see, calibrates the
probabilities.

The weights are fitted on a bounded sample: at most ``sample`` documents, an equal share for every
language, those with the smallest hash values. All of a sampled text is read. Scoring reads every whole text in
one pass without a shuffle; only the fitted arrays are sent out. A text goes through in pieces of
``PIECE_BYTES``, so a long one takes no more memory than its own bytes. Equal texts get equal scores:
each is summed by itself, in the order of the buckets.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text where
no language can be learnt. A row without id counts as not held out. Rows without language teach
nothing. Repeated rows of the learnt part count once in the sample. Of languages with equal scores
the first by name is taken. An empty table gives an empty one. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.llm.arrow import small_slices, utf8_of
from lexiscope.llm.quality import held_out

BUCKETS = 1 << 14
SIZES = (1, 2, 3)
PIECE_BYTES = 1 << 20
SAMPLE = 3_000
UNDECIDED = "und"
SPACE = 32
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its lower case, or a space, and whether it is a letter."""
    lower = np.full(0x110000, SPACE, np.uint32)
    letter = np.zeros(0x110000, bool)
    for code in range(0x110000):
        kind = category(chr(code))[0]
        if kind in "LM":
            small = chr(code).lower()
            lower[code] = ord(small) if len(small) == 1 else code
            letter[code] = kind == "L"
    return lower, letter


def ngram_counts(data: np.ndarray) -> tuple[np.ndarray, bool]:
    """Counts of the n-grams of one text in their buckets, and whether it has a letter."""
    lower, letter = _characters()
    counts = np.zeros(BUCKETS, np.int64)
    before, letters, first = np.array([SPACE], np.uint32), False, 0
    while first < len(data):
        last = min(first + PIECE_BYTES, len(data))
        while last < len(data) and data[last] & 0xC0 == 0x80:
            last += 1  # not inside a character
        text = data[first:last].tobytes().decode("utf-8", "replace")
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = letters or bool(letter[codes].any())
        run = np.concatenate((before, lower[codes]))
        known = len(before)
        again = np.zeros(len(run), bool)
        again[known:] = (run[known:] == SPACE) & (run[known - 1 : -1] == SPACE)
        run = run[~again].astype(np.uint64)
        for size in SIZES:
            begin = max(known - size + 1, 0)
            count = len(run) - size + 1 - begin
            if count <= 0:
                continue
            mixed = np.full(count, size, np.uint64)
            for at in range(size):
                mixed = (mixed ^ run[begin + at : begin + at + count]) * _FACTORS[at]
                mixed ^= mixed >> np.uint64(29)
            buckets = (mixed * _FACTORS[0]) >> np.uint64(50)
            counts += np.bincount(buckets.astype(np.int64), minlength=BUCKETS)
        before = run[-(max(SIZES) - 1) :].astype(np.uint32)
        first = last
    return counts, letters


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for some in small_slices(batch, "text"):
            yield some, *utf8_of(some.column("text"))


@dataclass
class LanguageModel:
    """The languages in order, the weight of each bucket, ``weights[bucket, language]``, and more."""

    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that a text fills, and their values, of length one together."""
        buckets = np.flatnonzero(counts)
        values = np.log1p(counts[buckets]) * self.idf[buckets]
        return buckets, values / max(np.sqrt((values * values).sum()), 1e-12)

    def logits(self, buckets: np.ndarray, values: np.ndarray) -> np.ndarray:
        return (values[:, None] * self.weights[buckets]).sum(axis=0) + self.bias

    def predict(self, data: np.ndarray) -> tuple[str, float]:
        counts, letters = ngram_counts(data)
        if not letters or not self.languages:
            return UNDECIDED, 0.0
        shares = softmax(self.logits(*self.features(counts)) / self.temperature)
        best = int(shares.argmax())
        return self.languages[best], float(shares[best])


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max())
    return raised / raised.sum()


def follow_the_leader(
    model: LanguageModel,
    examples: list[tuple[np.ndarray, np.ndarray, int]],
    epochs: int = 2,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.1,
) -> None:
    """Learn weights from buckets, values and language of examples, one at a time, in order.

    Each weight has a sum of adjusted gradients ``z`` and one of their squares ``n``. It is zero while
    ``|z| <= l1``, and else the minimum of the summed losses with both penalties. The bias has none.
    """
    many = len(model.languages)
    z, n = np.zeros((BUCKETS, many)), np.zeros((BUCKETS, many))
    bias_z, bias_n = np.zeros(many), np.zeros(many)

    def leading(z: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n)) / alpha + l2)

    for _ in range(epochs):
        for buckets, values, language in examples:
            own_z, own_n = z[buckets], n[buckets]
            weights, bias = leading(own_z, own_n, l1, l2), leading(bias_z, bias_n, 0, 0)
            error = softmax((values[:, None] * weights).sum(axis=0) + bias)
            error[language] -= 1
            for total, squares, gradient, at, now in (
                (own_z, own_n, values[:, None] * error, weights, (z, n)),
                (bias_z, bias_n, error, bias, None),
            ):
                more = squares + gradient * gradient
                total += gradient - (np.sqrt(more) - np.sqrt(squares)) / alpha * at
                squares[...] = more
                if now:
                    now[0][buckets], now[1][buckets] = total, squares
    model.weights, model.bias = leading(z, n, l1, l2), leading(bias_z, bias_n, 0, 0)


def calibrate(logits: np.ndarray, language: np.ndarray) -> float:
    """The temperature that makes the right languages likeliest, between 1/20 and 20."""

    def loss(log_t: float) -> float:
        scaled = logits / np.exp(log_t)
        scaled = scaled - scaled.max(axis=1, keepdims=True)
        right = scaled[np.arange(len(language)), language]
        return float((np.log(np.exp(scaled).sum(axis=1)) - right).mean())

    low, high, golden = -np.log(20), np.log(20), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts, and in how many of them each bucket is filled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(BUCKETS, np.int64), 0
        for some, data, bounds in _texts(batches):
            rows += some.num_rows
            for begin, end in zip(bounds[:-1], bounds[1:]):
                seen += ngram_counts(data[begin:end])[0] > 0
        filled = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(filled, -1)), pa.array(np.append(seen[filled], rows))],
            names=["bucket", "n"],
        )

    counted = texts.select("text").mapInArrow(run, "bucket bigint, n bigint")
    # one row per bucket at most
    found = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    by_bucket = dict(zip(found["bucket"], found["n"]))
    total = np.array([by_bucket.get(b, 0) for b in range(BUCKETS)], np.int64)
    return int(by_bucket.get(-1, 0)), total


def drawn_sample(known: DataFrame, sizes: dict[str, int], sample: int) -> DataFrame:
    """About ``sample`` rows of ``lang, draw, text`` and not more: as many of each language.

    ``draw`` is a hash value, and ``sizes`` how many different ones each language has. A threshold
    leaves about twice the share of each, so what is ranked doesn't grow with the table.
    """
    share = max(1, sample // max(1, len(sizes)))
    last = [(lang, -(1 << 63) + int(min(1, 2 * share / max(n, 1)) * ((1 << 64) - 1))) for lang, n in sizes.items()]
    # one row per language
    limits = known.sparkSession.createDataFrame(last, "lang string, last bigint")
    some = known.join(F.broadcast(limits), "lang").filter("draw <= last")
    order = Window.partitionBy("lang").orderBy("draw")
    ranked = some.dropDuplicates(["lang", "draw"]).withColumn("place", F.row_number().over(order))
    return ranked.filter(F.col("place") <= share).select("lang", "draw", "text")


def learn_languages(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample: int = SAMPLE,
    **settings: float,
) -> LanguageModel:
    """Learn from the rows that are not held out and have a language.

    ``sample`` bounds the documents that the weights are fitted to; what the driver gets of them is
    ``4 * BUCKETS`` bytes each at most. ``settings`` go to ``follow_the_leader``.
    """
    known = docs.filter(F.col(lang).isNotNull() & ~held_out(F.col(key))).select(
        F.col(lang).alias("lang"),
        F.xxhash64(key, lang, text).alias("draw"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    found = known.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()
    sizes = {row.lang: row.n for row in found}
    languages = tuple(sorted(sizes))
    rows, seen = document_frequencies(known)
    idf = np.log((1 + rows) / (1 + seen)) + 1
    model = LanguageModel(
        languages, idf, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages))
    )
    if not languages:
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, data, bounds in _texts(batches):
            found = []
            for begin, end in zip(bounds[:-1], bounds[1:]):
                counts, letters = ngram_counts(data[begin:end])
                buckets, values = model.features(counts)
                packed = buckets.astype(np.uint16).tobytes() + values.astype(np.float16).tobytes()
                found.append(packed if letters else None)
            yield pa.RecordBatch.from_arrays(
                [some.column("lang"), some.column("draw"), pa.array(found, pa.binary())],
                names=["lang", "draw", "packed"],
            )

    drawn = drawn_sample(known, sizes, sample)
    found = drawn.mapInArrow(run, "lang string, draw bigint, packed binary").collect()
    number = {name: i for i, name in enumerate(languages)}
    examples = []
    for row in sorted((r for r in found if r.packed is not None), key=lambda r: (r.draw, r.lang)):
        half = len(row.packed) // 2
        buckets = np.frombuffer(row.packed[:half], np.uint16).astype(np.int64)
        values = np.frombuffer(row.packed[half:], np.float16).astype(np.float64)
        examples.append((buckets, values, number[row.lang]))
    fitted = [e for i, e in enumerate(examples) if i % 5 != 4]
    kept = [e for i, e in enumerate(examples) if i % 5 == 4]
    follow_the_leader(model, fitted, **settings)
    if kept:
        logits = np.stack([model.logits(b, v) for b, v, _ in kept])
        model.temperature = calibrate(logits, np.array([y for _, _, y in kept]))
    return model


def predict_languages(
    docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, data, bounds in _texts(batches):
            found = [model.predict(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    some.column("doc_id"),
                    pa.array([name for name, _ in found], pa.string()),
                    pa.array([score for _, score in found], pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(
        F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def language_table(docs: DataFrame, **names: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of a table with languages."""
    model = learn_languages(docs, **names)
    names.pop("lang", None)
    found = predict_languages(docs, model, **names)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
