"""Scores of texts under a log-bilinear language model trained by noise-contrastive estimation.

Tokens are words (between ASCII white space, letters A to Z in lower case) and one end for each
text. Every word belongs to a symbol: the most frequent words are symbols of their own, the others
share the symbol of their last letters. The model predicts a symbol from the two before it: the
vectors of these two, each turned by a matrix of its own, are summed, and their product with the
vector of every symbol, plus a bias, gives its score; the exponentials are normalised over all
symbols. Inside a symbol a word has its share of the symbol's training counts, smoothed, with a
place left for words not seen. So the probabilities of all known words, and of one unknown word for
each symbol, add up to one.

Word counts come from all training texts and stay a table of any size, which is joined to the
vocabulary of each block of texts. Every block of training texts is trained on: tasks start from
the same arrays, go through their blocks, and their results are averaged, ``ROUNDS`` times. Only
the arrays of the model, whose size is fixed, pass through the driver.

Defined results: a null or empty text is the end alone; a null id counts as the empty id when rows
are held out; repeated rows get equal scores; with no training texts the probability of every
token is that of the untrained arrays; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.arrow import keyed_text, small_slices, split_words, utf8_of
from lexiscope.llm.hashing import lower_ascii
from lexiscope.sources.shared import write_and_reread

BLOCK_BYTES = 4 << 20
FREQUENT = 255  # words that are symbols of their own
ENDINGS = 255  # symbols for the last letters of other words
DIGITS = 9  # of a log probability
CONTEXTS = 2_048  # scored at a time, for all symbols
ENDING_LETTERS = 2
WIDTH = 32
NOISE = 64  # noise samples for each example, shared by a batch
BATCH = 4_096
RATE = 0.15
ROUNDS = 2
AVERAGES = 16  # partial averages that reach the driver
SMOOTHING = 0.1
NO_ID = -(2**63)


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


@dataclass
class Block:
    """Some texts as numbers of words in a vocabulary of their own; the end comes after it."""

    keys: np.ndarray
    held: np.ndarray
    lengths: np.ndarray
    tokens: np.ndarray
    words: pa.Array
    counts: np.ndarray

    SCHEMA = (
        "block bigint, keys binary, held binary, lengths binary, tokens binary, "
        "words binary, counts binary"
    )

    def row(self, number: int) -> pa.RecordBatch:
        whole = pa.ListArray.from_arrays([0, len(self.words)], self.words)
        words = pc.binary_join(whole, "\n")[0].as_py().encode()
        parts = [
            _pack(self.keys), _pack(self.held), _pack(self.lengths), _pack(self.tokens),
            zstandard.compress(words, 1), _pack(self.counts),
        ]
        names = [part.split()[0] for part in self.SCHEMA.split(", ")]
        columns = [pa.array([number], pa.int64()), *[pa.array([p], pa.binary()) for p in parts]]
        return pa.RecordBatch.from_arrays(columns, names=names)

    @classmethod
    def of(cls, row: dict) -> Block:
        words = zstandard.decompress(row["words"]).decode()
        listed = pc.split_pattern(pa.array([words]), "\n")[0].values if words else pa.array([], pa.string())
        return cls(
            _unpack(row["keys"], np.int64), _unpack(row["held"], bool),
            _unpack(row["lengths"], np.int64), _unpack(row["tokens"], np.int32), listed,
            _unpack(row["counts"], np.int64),
        )

    def in_training(self) -> np.ndarray:
        return np.repeat(~self.held, self.lengths)


def _block(parts: list[pa.RecordBatch]) -> Block:
    """Number the words of some texts."""
    keys, held, lengths, words, begins = [], [], [], [], []
    for part in parts:
        data, bounds = utf8_of(part.column("text"))
        found, first = split_words(lower_ascii(data), bounds)
        keys.append(part.column("key").fill_null(NO_ID).to_numpy())
        held.append(part.column("held").to_numpy(zero_copy_only=False))
        lengths.append(np.diff(first) + 1)
        words.append(found)
    coded = pa.chunked_array(words, pa.large_string()).combine_chunks().dictionary_encode()
    vocabulary = coded.dictionary.cast(pa.string())
    length = np.concatenate(lengths)
    ends = np.cumsum(length) - 1
    tokens = np.full(int(length.sum()), len(vocabulary), np.int32)
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner] = coded.indices.to_numpy()
    block = Block(np.concatenate(keys), np.concatenate(held), length, tokens, vocabulary, ends)
    block.counts = np.bincount(
        tokens[block.in_training()], minlength=len(vocabulary) + 1
    ).astype(np.int64)
    return block


def make_blocks(docs: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """Texts in blocks of about ``BLOCK_BYTES``; one in ``parts`` is held out, by its id."""
    rows = keyed_text(docs, key, text).withColumn(
        "held", F.crc32(F.coalesce(F.col("key").cast("string"), F.lit(""))) % parts == 0
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        gathered, size = [], 0
        for batch in batches:
            for some in small_slices(batch, "text", BLOCK_BYTES // 4):
                gathered.append(some)
                size += some.column("text").nbytes
                if size >= BLOCK_BYTES:
                    yield _block(gathered).row(number)
                    gathered, size, number = [], 0, number + 1
        if gathered:
            yield _block(gathered).row(number)

    return write_and_reread(rows.mapInArrow(run, Block.SCHEMA), "text-blocks")


def _cell(column: pa.Array, at: int):
    """A value of a block; lists, which are as long as its vocabulary, as arrays and not as objects."""
    if pa.types.is_list(column.type):
        return column[at].values.to_numpy() if column[at].is_valid else np.zeros(0, np.int64)
    return column[at].as_py()


def _each_block(blocks: DataFrame, run, schema: str) -> DataFrame:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield from run({n: _cell(batch.column(n), at) for n in batch.schema.names})

    return blocks.mapInArrow(over, schema)


def block_words(blocks: DataFrame) -> DataFrame:
    """The vocabulary of every block: ``block, place, word`` and its count in training texts."""

    def run(row: dict) -> Iterator[pa.RecordBatch]:
        block = Block.of(row)
        for low in range(0, len(block.words), 50_000):
            words = block.words.slice(low, 50_000)
            high = low + len(words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(words), row["block"])),
                    pa.array(np.arange(low, high, dtype=np.int32)),
                    words,
                    pa.array(block.counts[low:high]),
                ],
                names=["block", "place", "word", "n"],
            )

    some = blocks.select("block", "keys", "held", "lengths", "tokens", "words", "counts")
    return _each_block(some, run, "block bigint, place int, word string, n bigint")


@dataclass
class Symbols:
    """Which symbol a word belongs to, and what the symbols hold."""

    frequent: list[str]
    endings: list[str]
    totals: np.ndarray  # training tokens of each symbol
    types: np.ndarray  # different training words of each symbol

    @property
    def end(self) -> int:
        return len(self.frequent)

    @property
    def rest(self) -> int:
        return len(self.totals) - 1

    def of(self, words: pa.Array) -> np.ndarray:
        """Symbols of the words of a block, and that of the end behind them."""
        ending = pc.index_in(
            pc.utf8_slice_codeunits(words, -ENDING_LETTERS), pa.array(self.endings, pa.string())
        ).fill_null(len(self.endings))
        own = pc.index_in(words, pa.array(self.frequent, pa.string())).fill_null(-1).to_numpy()
        shared = ending.to_numpy() + self.end + 1
        return np.append(np.where(own >= 0, own, shared), self.end).astype(np.int64)

    def in_symbol(self, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Logarithm of the share of a word in its symbol; a symbol of one word is that word."""
        single = symbols <= self.end
        below = self.totals[symbols] + SMOOTHING * (self.types[symbols] + 1)
        return np.where(single, 0.0, np.log((counts + SMOOTHING) / below))


def choose_symbols(counts: DataFrame, ends: int) -> Symbols:
    """Symbols from the counts of all training words."""
    frequent = [r.word for r in counts.orderBy(F.desc("c"), "word").limit(FREQUENT).collect()]
    others = counts.filter(~F.col("word").isin(frequent)) if frequent else counts
    by_ending = others.groupBy(F.right("word", F.lit(ENDING_LETTERS)).alias("ending")).agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("types")
    )
    best = by_ending.orderBy(F.desc("c"), "ending").limit(ENDINGS).collect()
    whole = others.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    sizes = {r.word: r.c for r in counts.filter(F.col("word").isin(frequent)).collect()}
    totals = [sizes[w] for w in frequent] + [ends] + [r.c for r in best]
    types = [1] * len(frequent) + [1] + [r.types for r in best]
    totals.append(whole[0] - sum(r.c for r in best))
    types.append(whole[1] - sum(r.types for r in best))
    return Symbols(frequent, [r.ending for r in best], np.array(totals, float), np.array(types, float))


@dataclass
class LogBilinear:
    """Arrays of the model; the last row of ``before`` stands for what precedes a text."""

    arrays: dict[str, np.ndarray]

    @classmethod
    def start(cls, totals: np.ndarray, seed: int = 11) -> LogBilinear:
        rng = np.random.default_rng(seed)
        size = len(totals)
        near = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        share = (totals + 1) / (totals + 1).sum()
        turn = np.eye(WIDTH, dtype=np.float32)
        return cls({
            "before": near(size + 1, WIDTH), "after": near(size, WIDTH), "one": turn.copy(),
            "two": turn.copy(), "bias": np.log(share).astype(np.float32),
        })

    def scores(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of every symbol behind each pair (nearest, one before it), and their log norm."""
        a = {name: x.astype(np.float64) for name, x in self.arrays.items()}
        nearest, further = a["before"] @ a["one"], a["before"] @ a["two"]
        scores = (nearest[first] + further[second]) @ a["after"].T
        scores += a["bias"]
        top = scores.max(axis=1)
        raised = np.subtract(scores, top[:, None])
        return scores, np.log(np.exp(raised, out=raised).sum(axis=1)) + top

    def log_probabilities(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Normalised logarithms for every symbol behind each pair."""
        scores, norm = self.scores(first, second)
        return scores - norm[:, None]

    def train(
        self,
        examples: np.ndarray,
        weights: np.ndarray,
        noise: np.ndarray,
        history: dict[str, np.ndarray],
        rng: np.random.Generator,
    ) -> None:
        """One pass over rows of (symbol, nearest, one before), weighted by how often they occur.

        Every batch tells its examples from ``NOISE`` symbols drawn from the noise distribution.
        """
        a = self.arrays
        expected = np.log(NOISE * noise).astype(np.float32)
        order = rng.permutation(len(examples))
        for low in range(0, len(order), BATCH):
            some = order[low : low + BATCH]
            word, first, second = np.ascontiguousarray(examples[some].T)
            weight = (weights[some] / weights[some].sum()).astype(np.float32)
            drawn = rng.choice(len(noise), NOISE, p=noise)
            # what depends on a context symbol alone is multiplied once a symbol, not once an example
            query = np.take(a["before"] @ a["one"], first, axis=0)
            query += np.take(a["before"] @ a["two"], second, axis=0)
            after, others = np.take(a["after"], word, axis=0), a["after"][drawn]
            real = np.einsum("ij,ij->i", query, after) + a["bias"][word] - expected[word]
            false = query @ others.T
            false += a["bias"][drawn] - expected[drawn]
            to_real = weight * (_sigmoid(real) - 1)
            to_false = _sigmoid(false)
            to_false *= weight[:, None]
            to_query = to_false @ others
            after *= to_real[:, None]
            to_query += after
            size = len(a["before"])
            to_nearest, to_further = (_sum_rows(x, to_query, size) for x in (first, second))
            to_drawn = to_false.T @ query
            query *= to_real[:, None]
            found = {
                "one": a["before"].T @ to_nearest,
                "two": a["before"].T @ to_further,
                "before": to_nearest @ a["one"].T + to_further @ a["two"].T,
                "after": _sum_rows(word, query, size - 1) + _sum_rows(drawn, to_drawn, size - 1),
                "bias": np.bincount(word, to_real, size - 1)
                + np.bincount(drawn, to_false.sum(axis=0), size - 1),
            }
            for name, gradient in found.items():
                history[name] += gradient**2
                a[name] -= (RATE * gradient / (np.sqrt(history[name]) + 1e-6)).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place of the given values."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _sum_rows(places: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, rows.shape[1]), np.float32)
    # numbers of 16 bits are ordered by counting
    order = np.argsort(places.astype(np.uint16) if size <= 1 << 16 else places, kind="stable")
    sorted_places = places[order]
    starts = np.flatnonzero(np.append(True, np.diff(sorted_places) != 0))
    out[sorted_places[starts]] = np.add.reduceat(np.take(rows, order, axis=0), starts, axis=0)
    return out


def _pairs_before(block: Block, symbols: np.ndarray, start: int) -> tuple[np.ndarray, ...]:
    """The symbol of every token of a block, and the two before it in its text."""
    word = symbols[block.tokens]
    first, second = np.roll(word, 1), np.roll(word, 2)
    begins = np.cumsum(block.lengths) - block.lengths
    first[begins] = start
    second[begins] = start
    longer = begins[block.lengths > 1]
    second[longer + 1] = start
    return word, first, second


def train_model(blocks: DataFrame, symbols: Symbols, rounds: int = ROUNDS) -> LogBilinear:
    """Train on every block; the results of the tasks are averaged after each round."""
    model = LogBilinear.start(symbols.totals)
    start = len(symbols.totals)
    noise = (symbols.totals + 1) / (symbols.totals + 1).sum()
    names = list(model.arrays)
    shapes = [model.arrays[n].shape for n in names]
    for turn in range(rounds):
        arrays = model.arrays

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = LogBilinear({n: v.copy() for n, v in arrays.items()})
            history = {n: np.full(v.shape, 1e-6, np.float32) for n, v in arrays.items()}
            part = TaskContext.get().partitionId()
            rng = np.random.default_rng([turn, part])
            seen = 0.0
            for batch in batches:
                for at in range(batch.num_rows):
                    block = Block.of({n: batch.column(n)[at].as_py() for n in batch.schema.names})
                    inside = block.in_training()
                    rows = _pairs_before(block, symbols.of(block.words), start)
                    word, first, second = [r[inside] for r in rows]
                    packed = (word * (start + 1) + first) * (start + 1) + second
                    different, counts = np.unique(packed, return_counts=True)
                    both, second = np.divmod(different, start + 1)
                    word, first = np.divmod(both, start + 1)
                    if len(different):
                        examples = np.stack([word, first, second], axis=1)
                        own.train(examples, counts, noise, history, rng)
                        seen += float(counts.sum())
            if seen:
                flat = np.concatenate([own.arrays[n].ravel() for n in names]).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part % AVERAGES], pa.int32()),
                        pa.array([seen], pa.float64()),
                        pa.array([(flat * seen).tobytes()], pa.binary()),
                    ],
                    names=["part", "seen", "total"],
                )

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for part, seen, total in zip(*[c.to_pylist() for c in batch.columns]):
                    values = np.frombuffer(total, np.float64)
                    held = sums.setdefault(part, [0.0, np.zeros(len(values))])
                    held[0] += seen
                    held[1] += values
            for part, (seen, values) in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part], pa.int32()),
                        pa.array([seen], pa.float64()),
                        pa.array([values.tobytes()], pa.binary()),
                    ],
                    names=["part", "seen", "total"],
                )

        schema = "part int, seen double, total binary"
        trained = blocks.select("block", "keys", "held", "lengths", "tokens", "words", "counts")
        shared = trained.mapInArrow(run, schema).repartition(AVERAGES, "part")
        sums = sorted(shared.mapInArrow(add, schema).collect(), key=lambda r: r.part)
        if not sums:
            return model
        seen = sum(r.seen for r in sums)
        flat = sum(np.frombuffer(r.total, np.float64) for r in sums) / seen
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        parts = zip(names, shapes, np.split(flat, cuts))
        model = LogBilinear({n: v.reshape(s).astype(np.float32) for n, s, v in parts})
    return model


SCORED = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)


def score_texts(
    docs: DataFrame, parts: int = 10, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Learn from the texts that are not held out and score all of them."""
    blocks = make_blocks(docs, key, text, parts)
    words = write_and_reread(block_words(blocks), "block-words")
    counts = write_and_reread(
        words.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0"), "word-counts"
    )

    def training_texts(row: dict) -> Iterator[pa.RecordBatch]:
        held = _unpack(row["held"], bool)
        yield pa.RecordBatch.from_pydict({"n": pa.array([int((~held).sum())], pa.int64())})

    ends = _each_block(blocks.select("held"), training_texts, "n bigint").agg(F.sum("n")).first()[0]
    ends = ends or 0
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, types = total + ends, kinds + (ends > 0)
    symbols = choose_symbols(counts, ends)
    model = train_model(blocks, symbols)
    per_block = (
        words.join(counts, "word")
        .groupBy(F.col("block").alias("of"))
        .agg(F.collect_list("place").alias("places"), F.collect_list("c").alias("known"))
    )
    known = blocks.join(per_block, F.col("block") == F.col("of"), "left")
    below = tokens + SMOOTHING * (types + 1)
    start = len(symbols.totals)

    def run(row: dict) -> Iterator[pa.RecordBatch]:
        block = Block.of(row)
        c = np.zeros(len(block.words) + 1)
        c[row["places"]] = row["known"]
        c[-1] = ends
        by_word = symbols.of(block.words)
        word, first, second = _pairs_before(block, by_word, start)
        different, where = np.unique(first * (start + 1) + second, return_inverse=True)
        ahead, further = np.divmod(different, start + 1)
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(0, len(different) + CONTEXTS, CONTEXTS))
        likely = np.zeros(len(word))
        for at, low in enumerate(range(0, len(different), CONTEXTS)):
            scores, norm = model.scores(ahead[low : low + CONTEXTS], further[low : low + CONTEXTS])
            some = order[cuts[at] : cuts[at + 1]]
            row = where[some] - low
            # the last bits of a matrix product depend on how many rows it has, and equal texts
            # must get equal scores in any block
            likely[some] = np.round(scores[row, word[some]] - norm[row], DIGITS)
        likely += symbols.in_symbol(by_word, c)[block.tokens]
        base = np.log10((c + SMOOTHING) / below)[block.tokens]
        begins = np.cumsum(block.lengths) - block.lengths
        count = len(block.keys)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(block.keys, mask=block.keys == NO_ID),
                pa.array(block.held),
                pa.array(block.lengths),
                pa.array(np.add.reduceat((c > 0)[block.tokens].astype(np.int64), begins)),
                pa.array(np.full(count, tokens, np.int64)),
                pa.array(np.add.reduceat(base, begins)),
                pa.array(np.add.reduceat(likely, begins) / np.log(10)),
            ],
            names=[part.split()[0] for part in SCORED.split(", ")],
        )

    return _each_block(known.drop("of"), run, SCORED)
