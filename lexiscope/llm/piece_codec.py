"""SentencePiece encoding and decoding for vocabularies of the merge type.

A text is cut into chunks that no merge can cross, and every distinct chunk is encoded with an
agenda of adjacent symbol pairs: the pair whose merged piece scores best is merged first, the
leftmost of equals, until no adjacent pair is a piece. The agendas of all new chunks of one length
are the rows of one matrix and take their best pair in step; a long chunk has a heap of its own.
What an agenda gives is checked against the sentencepiece library, all new chunks of an Arrow
batch in one call.

Defined results: a null or empty text has no ids and decodes to the empty text; characters
outside the vocabulary become their UTF-8 bytes; repeated rows give repeated results; an empty
table gives an empty one. Chunks longer than ``LONG_CHUNK`` characters are encoded but not kept.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from lexiscope.llm.arrow import keyed_text, small_slices, utf8_of

SPACE = "▁"  # the vocabulary's mark for a space
LONG_CHUNK = 64  # characters
CACHE_CHUNKS = 400_000
NEVER = np.int32(2**31 - 1)


class PairTable:
    """Merged piece of a left and a right piece, looked up for whole matrices of pairs."""

    BITS = 21

    def __init__(self, ids: dict[str, int], size: int) -> None:
        pairs = [
            (ids[piece[:cut]] * size + ids[piece[cut:]], merged)
            for piece, merged in ids.items()
            for cut in range(1, len(piece))
            if piece[:cut] in ids and piece[cut:] in ids
        ]
        self.size = size
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.merged = np.full(1 << self.BITS, -1, np.int32)
        slots = self.slots(np.array([key for key, _ in pairs], np.int64))
        for (key, merged), slot in zip(pairs, slots.tolist()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.BITS) - 1)
            self.keys[slot] = key
            self.merged[slot] = merged

    def slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.BITS)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) * self.size + right).ravel()
        slots = self.slots(keys)
        there = self.keys[slots]
        found = np.where(there == keys, self.merged[slots], np.int32(-1))
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while open_.size:
            slots[open_] = (slots[open_] + 1) & ((1 << self.BITS) - 1)
            there = self.keys[slots[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self.merged[slots[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return found.reshape(left.shape)


class PieceCodec:
    """Encoder and decoder made from the pieces and scores of a model file.

    Supports models that leave the text as it is but for a space put in front (no normalisation,
    no pieces defined by a user), with bytes for unknown characters. ``supported`` says why not.
    """

    def __init__(self, model_path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = self.library.vocab_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.plain: list[bytes] = []
        byte_ids: dict[int, int] = {}
        for i, piece in enumerate(pieces):
            if self.library.is_byte(i):
                value = int(piece[3:-1], 16)
                byte_ids[value] = i
                self.plain.append(bytes([value]))
            elif self.library.is_control(i) or self.library.is_unknown(i):
                self.plain.append(b"")
            else:
                self.ids[piece] = i
                self.scores[piece] = self.library.get_score(i)
                self.plain.append(piece.replace(SPACE, " ").encode())
        if len(byte_ids) < 256:
            raise ValueError("the model has no bytes to fall back on")
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            raise ValueError("the model has pieces that go on after a space")
        self.byte_ids = [byte_ids[value] for value in range(256)]
        order = {score: rank for rank, score in enumerate(sorted(set(self.scores.values()))[::-1])}
        #: rank of each piece by score; the last entry is for a pair that is no piece
        self.ranks = np.full(size + 1, NEVER, np.int32)
        for piece, i in self.ids.items():
            self.ranks[i] = order[self.scores[piece]]
        self.table = PairTable(self.ids, size + 1)
        self.unknown = size
        self.names = [str(i) for i in range(size)]
        if any("\n" in piece for piece in self.ids):
            raise ValueError("the model has pieces with line breaks")
        self.known: dict[str, tuple[str, bytes]] = {}  # ids and text of the chunks met

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk by merging adjacent symbols in the order of their merged scores."""
        symbols: list[str] = list(chunk.replace(" ", SPACE))
        count = len(symbols)
        scores = self.scores
        after = list(range(1, count + 1))
        before = list(range(-1, count - 1))
        agenda = []
        for i in range(count - 1):
            score = scores.get(symbols[i] + symbols[i + 1])
            if score is not None:
                agenda.append((-score, i, len(symbols[i]) + len(symbols[i + 1])))
        heapq.heapify(agenda)
        while agenda:
            _, left, length = heapq.heappop(agenda)
            right = after[left]
            if not symbols[left] or right >= count:
                continue
            if len(symbols[left]) + len(symbols[right]) != length:
                continue  # one of the two has been merged meanwhile
            symbols[left] += symbols[right]
            symbols[right] = ""
            follows = after[right]
            after[left] = follows
            whole = symbols[left]
            if follows < count:
                before[follows] = left
                score = scores.get(whole + symbols[follows])
                if score is not None:
                    heapq.heappush(agenda, (-score, left, length + len(symbols[follows])))
            precedes = before[left]
            if precedes >= 0:
                score = scores.get(symbols[precedes] + whole)
                if score is not None:
                    heapq.heappush(agenda, (-score, precedes, len(symbols[precedes]) + length))
        found: list[int] = []
        for symbol in symbols:
            if symbol:
                known = self.ids.get(symbol)
                if known is not None:
                    found.append(known)
                else:
                    found.extend(self.byte_ids[b] for b in symbol.encode())
        return found

    def merge_many(self, chunks: Sequence[str]) -> list[list[int]]:
        """``merge`` for many chunks: those of one length are merged in step, a row for each."""
        found: list[list[int]] = [[]] * len(chunks)
        by_length = defaultdict(list)
        for at, chunk in enumerate(chunks):
            by_length[len(chunk)].append(at)
        for length, members in by_length.items():
            if length > LONG_CHUNK or len(members) < 8:
                for at in members:
                    found[at] = self.merge(chunks[at])
                continue
            joined = "".join([chunks[at] for at in members]).replace(" ", SPACE)
            points, where = np.unique(
                np.frombuffer(joined.encode("utf-32-le"), np.uint32), return_inverse=True
            )
            first = np.array([self.ids.get(chr(p), self.unknown) for p in points], np.int32)
            symbols = first[where].reshape(len(members), length)
            rows = np.array(members)
            strange = (symbols == self.unknown).any(axis=1)
            for at in rows[strange].tolist():
                found[at] = self.merge(chunks[at])
            rows, symbols = rows[~strange], symbols[~strange]
            while rows.size:
                if symbols.shape[1] > 1:
                    merged = self.table.look_up(symbols[:, :-1], symbols[:, 1:])
                    agenda = self.ranks[merged]
                    best = agenda.argmin(axis=1)
                    each = np.arange(rows.size)
                    going = agenda[each, best] != NEVER
                else:
                    going = np.zeros(rows.size, bool)
                done = ~going
                for at, ids in zip(rows[done].tolist(), symbols[done].tolist()):
                    found[at] = ids
                rows, symbols = rows[going], symbols[going]
                if rows.size:
                    best, merged = best[going], merged[going]
                    each = np.arange(rows.size)
                    symbols[each, best] = merged[each, best]
                    stay = np.ones(symbols.shape, bool)
                    stay[each, best + 1] = False
                    symbols = symbols[stay].reshape(rows.size, -1)
        return found

    def decode_bytes(self, ids: Sequence[int]) -> bytes:
        """What ids stand for, still with the space put in front of a text."""
        plain = self.plain
        return b"".join([plain[i] for i in ids])

    def decode(self, ids: Sequence[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes(ids).removeprefix(b" ").decode("utf-8", "replace")

    def encode(self, text: str) -> list[int]:
        """Ids of one text, without the cache and the check."""
        chunks, _ = cut_chunks(pa.array([text], pa.string()))
        return [i for chunk in chunks.to_pylist() for i in self.merge(chunk)]

    def check(
        self, chunks: Sequence[str], found: Sequence[list[int]], plain: Sequence[bytes]
    ) -> None:
        """Hold the ids of chunks, and what they decode to, against the library.

        The library puts a space in front of every text, so it sees a chunk without its first
        space; a chunk that has none follows a line break, which no merge crosses either.
        """
        texts = [c[1:] if c[0] == " " else "\n" + c for c in chunks]
        expected = self.library.encode(texts, num_threads=1)
        line = self.library.encode("\n")
        for at, chunk in enumerate(chunks):
            if chunk[0] != " ":
                expected[at] = expected[at][len(line) :]
            elif chunk == " ":
                expected[at] = line[:1]
        decoded = self.library.decode(list(found), num_threads=1)
        ours = [text.removeprefix(b" ").decode("utf-8", "replace") for text in plain]
        if found != expected or ours != decoded:
            for chunk, ids, theirs, text, same in zip(chunks, found, expected, ours, decoded):
                if ids != theirs or text != same:
                    raise ValueError(f"{chunk!r}: {ids} and {text!r}, not {theirs} and {same!r}")

    def look_up(self, chunks: Sequence[str]) -> tuple[list[str], list[bytes]]:
        """Ids, each with a comma behind it, and text of distinct chunks.

        Chunks that are not known yet are encoded and checked in one go.
        """
        known, names = self.known, self.names
        new = [chunk for chunk in chunks if chunk not in known]
        if len(known) + len(new) > CACHE_CHUNKS:
            used = set(chunks)
            known = {c: entry for c, entry in known.items() if c in used}
        if new:
            found = self.merge_many(new)
            plain = [self.decode_bytes(ids) for ids in found]
            self.check(new, found, plain)
            written = [",".join([names[i] for i in ids]) + "," for ids in found]
            known.update(zip(new, zip(written, plain)))
        entries = [known[chunk] for chunk in chunks]
        for chunk in new:
            if len(chunk) > LONG_CHUNK:
                del known[chunk]
        self.known = known
        return [e[0] for e in entries], [e[1] for e in entries]


def cut_chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Cut texts into chunks no merge crosses: a run of spaces and what follows, or a line break.

    Every text that is not empty gets a space in front. Also gives the chunk each text begins at.
    """
    spaced = pc.replace_substring(texts, SPACE, " ")
    spaced = pc.if_else(
        pc.equal(spaced, ""), spaced, pc.binary_join_element_wise("", spaced, " ")
    )
    data, bounds = utf8_of(spaced)
    starts = np.zeros(len(data) + 1, bool)
    space, line = data == 32, data == 10
    starts[:-1] = space | line
    starts[1:-1] &= ~(space[1:] & space[:-1])
    starts[1:-1] |= line[:-1]
    starts[bounds[:-1]] = True
    starts[-1] = False
    at = np.flatnonzero(starts)
    offsets = np.append(at, len(data)).astype(np.int32)
    chunks = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))
    return chunks, np.searchsorted(at, bounds)


_CODECS: dict[str, PieceCodec] = {}


def codec_of(model_path: str) -> PieceCodec:
    """One codec for each Python worker, kept for the tasks that follow."""
    if model_path not in _CODECS:
        _CODECS[model_path] = PieceCodec(model_path)
    return _CODECS[model_path]


RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
FULL = "doc_id bigint, ids array<int>, n_tokens bigint, decoded string"


def _coded(batch: pa.RecordBatch, codec: PieceCodec) -> Iterator[tuple[bytes, int, bytes]]:
    """Joined ids, their number and the decoded text of each text of a batch."""
    for part in small_slices(batch, "text"):
        chunks, begins = cut_chunks(part.column("text"))
        coded = chunks.dictionary_encode()
        written, plain = codec.look_up(coded.dictionary.to_pylist())
        ids, id_ends = utf8_of(pa.array(written, pa.string()).take(coded.indices))
        text, text_ends = utf8_of(pa.array(plain, pa.binary()).take(coded.indices))
        ids, text = memoryview(ids), memoryview(text)
        for first, last in zip(begins[:-1], begins[1:]):
            joined = bytes(ids[id_ends[first] : id_ends[last]])
            decoded = bytes(text[text_ends[first] : text_ends[last]])
            yield joined[:-1], joined.count(b","), decoded[1:]


def _numbers(joined: bytes) -> np.ndarray:
    return np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32)


def encode_and_decode(
    docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Ids of every text, their number, and what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_path)
        gc.disable()  # the caches are large and hold no cycles
        for batch in batches:
            ids, counts, decoded = zip(*_coded(batch, codec)) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array([_numbers(i) for i in ids], pa.list_(pa.int32())),
                    pa.array(counts, pa.int64()),
                    pa.array([d.decode("utf-8", "replace") for d in decoded], pa.string()),
                ],
                names=["doc_id", "ids", "n_tokens", "decoded"],
            )

    return keyed_text(docs, key, text).mapInArrow(run, FULL)


def token_digests(
    docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Number of ids of every text, and SHA-256 digests of its ids and of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_path)
        gc.disable()  # the caches are large and hold no cycles
        for batch in batches:
            rows = [
                (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(plain).hexdigest())
                for ids, n, plain in _coded(batch, codec)
            ]
            counts, digests, texts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(texts, pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return keyed_text(docs, key, text).mapInArrow(run, RESULT)
