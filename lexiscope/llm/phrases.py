"""Removal of bytes in strings of ``LENGTH`` bytes that also start earlier, by prefix-free parsing.

A rolling hash over ``TRIGGER`` bytes picks triggers: in every string of ``LENGTH`` bytes the
stretch with the smallest hash, the leftmost of equals. So equal strings have the same trigger at
the same place. The strings with one trigger, side by side, make a phrase: the text from the first
byte of the first to the last byte of the last. The parse is the sequence of these phrases, and
the dictionary the different ones; no phrase is cut where a string with its trigger goes on.

What is needed of the order of all suffixes of the corpus is which of them agree in their first
``LENGTH`` bytes and which of these starts first, so they are ordered to that depth only:

1. Dictionary. Phrases are brought together by their hashes, and the first occurrence in the
   corpus of each is found; every string in a later occurrence starts earlier too.
2. Parse. Triggers that stand in one phrase only are settled. Highly repetitive text is settled
   here, at the cost of its dictionary.
3. Suffixes of the dictionary: the strings of first occurrences whose trigger stands in several
   phrases are brought together one by one, and all but the first of equals are marked.

Texts are kept in blocks; what is brought together are sorted runs of hash values (96 bits, each
value once for a block), packed by ranges of values, and what comes back is one bit for each. So a
phrase or string that is in a third of all documents costs a value for each block.

Order is that of the ids, and of bytes in a text; rows of one id are ordered as they are read.
Defined results: a null text is the empty one; a null id comes first; an empty table gives an empty
one. Texts below ``LENGTH`` bytes keep all their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.arrow import keyed_text, small_slices, utf8_of
from lexiscope.llm.hashing import RollingHash
from lexiscope.sources.shared import write_and_reread

LENGTH = 100
TRIGGER = 32
BLOCK_BYTES = 8 << 20
RANGE_BYTES = 64 << 20  # of text, for each range of hash values brought together
PIECE = 1 << 20  # bytes parsed at a time; the places in it fill the low bits of a packed hash
LOW_BITS = 20
BROADCAST_BYTES = 32 << 20
NO_ID = -(2**63)


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


@dataclass
class Parse:
    """The phrases of some texts: their first string, their last, and their hashes."""

    first: np.ndarray
    last: np.ndarray
    trigger: np.ndarray
    phrase: np.ndarray
    check: np.ndarray


def _sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbouring values."""
    least, width = values, 1
    while width * 2 <= size:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    rest = size - width
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _parse_piece(data: np.ndarray, valid: np.ndarray, length: int, trigger: int) -> Parse:
    """Phrases of at most ``PIECE`` bytes; ``valid`` says where a string lies in one text."""
    rolling = RollingHash(data)
    values = rolling.every(trigger)
    low = np.uint64((1 << LOW_BITS) - 1)
    packed = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    chosen = _sliding_least(packed, length - trigger + 1)
    at = np.flatnonzero(valid[: len(chosen)])
    where = (chosen[at] & low).astype(np.int64)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1)
    begins = np.flatnonzero(fresh)
    closes = np.append(begins[1:], len(at)) - 1
    first, last = at[begins], at[closes]
    place = where[begins]
    # where the trigger stands in a phrase is part of what the phrase is
    phrase = rolling.of(first, last + length) ^ (place - first).astype(np.uint64)
    check = rolling.of(first, last + length, 1).astype(np.uint32)
    return Parse(first, last, values[place], phrase, check)


def parse(data: np.ndarray, bounds: np.ndarray, length: int, trigger: int) -> Parse:
    """Phrases of texts in one array of bytes, in order; pieces overlap by what a string needs."""
    found = []
    ends = bounds[1:]
    step = PIECE - length + 1
    for low in range(0, max(len(data) - length + 1, 0), step):
        piece = data[low : low + PIECE]
        starts = np.arange(low, low + len(piece) - length + 1)
        valid = starts + length <= ends[np.searchsorted(ends, starts, side="right")]
        part = _parse_piece(piece, valid, length, trigger)
        part.first += low
        part.last += low
        found.append(part)
    if not found:
        nothing = np.zeros(0, np.int64)
        return Parse(nothing, nothing, *[np.zeros(0, np.uint64)] * 2, np.zeros(0, np.uint32))
    return Parse(
        *[np.concatenate([getattr(f, n) for f in found]) for n in Parse.__dataclass_fields__]
    )


BLOCKS = "block bigint, keys binary, lengths binary, text binary"
VALUES = "block bigint, kind int, part int, values binary, checks binary, keys binary"


def make_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Whole texts in blocks, in the order of their ids inside a block."""

    def row(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys = np.concatenate([p.column("key").fill_null(NO_ID).to_numpy() for p in parts])
        texts = [utf8_of(p.column("text")) for p in parts]
        lengths = np.concatenate([np.diff(bounds) for _, bounds in texts])
        data = np.concatenate([d for d, _ in texts])
        order = np.argsort(keys, kind="stable")
        starts = np.cumsum(lengths) - lengths
        if (order != np.arange(len(order))).any():
            data = np.concatenate([data[starts[i] : starts[i] + lengths[i]] for i in order])
        columns = [_pack(keys[order]), _pack(lengths[order]), _pack(data)]
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), *[pa.array([c], pa.binary()) for c in columns]],
            names=["block", "keys", "lengths", "text"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        parts, size = [], 0
        for batch in batches:
            for some in small_slices(batch, "text", BLOCK_BYTES // 4):
                parts.append(some)
                size += some.column("text").nbytes
                if size >= BLOCK_BYTES:
                    yield row(number, parts)
                    parts, size, number = [], 0, number + 1
        if parts:
            yield row(number, parts)

    rows = keyed_text(docs, key, text).mapInArrow(run, BLOCKS)
    return write_and_reread(rows, "byte-blocks")


def _texts_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, lengths = _unpack(row["keys"], np.int64), _unpack(row["lengths"], np.int64)
    return keys, np.concatenate(([0], np.cumsum(lengths))), _unpack(row["text"], np.uint8)


def _distinct(values: np.ndarray, checks: np.ndarray, parts: int):
    """Different values in the order of their ranges: first places, and each one's number."""
    part = (values >> np.uint64(40)) % np.uint64(parts)
    order = np.lexsort((checks, values, part))
    v, c = values[order], checks[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (c[1:] != c[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    first = np.full(int(fresh.sum()), len(order))
    np.minimum.at(first, number, np.arange(len(order)))
    return first, number, part[order][fresh].astype(np.int64)


def _value_rows(
    block: int, kind: int, part: np.ndarray, values: np.ndarray, checks: np.ndarray, keys: np.ndarray
) -> pa.RecordBatch:
    """Rows of distinct values packed by range; ``part`` is ascending."""
    used, cuts = np.unique(part, return_index=True)
    cuts = np.append(cuts, len(part)).tolist()
    spans = list(zip(cuts[:-1], cuts[1:]))
    cut = lambda a: pa.array([a[i:j].tobytes() for i, j in spans], pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(used), block)),
            pa.array(np.full(len(used), kind, np.int32)),
            pa.array(used.astype(np.int32)),
            cut(values),
            cut(checks),
            cut(keys),
        ],
        names=["block", "kind", "part", "values", "checks", "keys"],
    )


FIRSTS, TRIGGERS = 0, 1  # kinds of values


def _flags(values: DataFrame) -> DataFrame:
    """A bit for every value of every block and range, in the order they were packed.

    For phrases and strings it says whether the block holds the first of all occurrences; for
    triggers whether there is more than one phrase with it.
    """

    def run(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_numpy()
        kind = table.column("kind")[0].as_py()
        order = np.argsort(blocks, kind="stable")
        read = lambda name, dtype: [
            np.frombuffer(table.column(name)[int(i)].as_py(), dtype) for i in order
        ]
        lists = read("values", np.uint64)
        sizes = [len(v) for v in lists]
        value = np.concatenate(lists)
        check = np.concatenate(read("checks", np.uint32))
        key = np.concatenate(read("keys", np.int64))
        if kind == FIRSTS:
            at = np.lexsort((key, check, value))  # stable: blocks in order where keys are equal
            v, c = value[at], check[at]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (v[1:] != v[:-1]) | (c[1:] != c[:-1])
            flag = np.empty(len(at), bool)
            flag[at] = fresh
        else:
            # check: whether the block itself has several phrases; key: one of them
            at = np.argsort(value, kind="stable")
            v = value[at]
            starts = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else at
            several = np.maximum.reduceat(check[at], starts) > 0
            several |= np.minimum.reduceat(key[at], starts) != np.maximum.reduceat(key[at], starts)
            flag = np.empty(len(at), bool)
            flag[at] = np.repeat(several, np.diff(np.append(starts, len(at))))
        cuts = np.cumsum([0, *sizes])
        return pa.table({
            "block": blocks[order],
            "kind": np.full(len(order), kind, np.int32),
            "part": np.full(len(order), table.column("part")[0].as_py(), np.int32),
            "bits": pa.array(
                [np.packbits(flag[i:j]).tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary()
            ),
        })

    found = values.groupBy("kind", "part").applyInArrow(
        run, "block bigint, kind int, part int, bits binary"
    )
    return found.groupBy(F.col("block").alias("of")).agg(
        F.collect_list(F.struct("kind", "part", "bits")).alias("flags")
    )


def _read_flags(flags: list | None, kind: int, part: np.ndarray) -> np.ndarray:
    """The bits of a block's values, whose ranges are ``part``, back in one array."""
    sizes = np.bincount(part) if len(part) else np.zeros(0, np.int64)
    found = {f["part"]: f["bits"] for f in flags or [] if f["kind"] == kind}
    bits = [
        np.unpackbits(np.frombuffer(found[p], np.uint8), count=int(sizes[p])).astype(bool)
        for p in np.flatnonzero(sizes).tolist()
    ]
    return np.concatenate(bits) if bits else np.zeros(0, bool)


def _joined(blocks: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """Blocks with their flags; where these are small they go to the blocks, not blocks to them."""
    stored = write_and_reread(other, "block-flags")
    size = stored.agg(
        F.sum(F.aggregate("flags", F.lit(0).cast("bigint"), lambda n, f: n + F.length(f["bits"]) + 8))
    ).first()[0]
    side = F.broadcast(stored) if (size or 0) <= BROADCAST_BYTES else stored
    side = side.withColumnRenamed("flags", name)
    return blocks.join(side, F.col("block") == F.col("of"), "left").drop("of")


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield {n: batch.column(n)[at].as_py() for n in batch.schema.names}


def _dictionary(blocks: DataFrame, length: int, trigger: int, parts: int) -> DataFrame:
    """The different phrases and triggers of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            keys, bounds, data = _texts_of(row)
            found = parse(data, bounds, length, trigger)
            if not len(found.first):
                continue
            text = np.searchsorted(bounds, found.first, side="right") - 1
            first, _, part = _distinct(found.phrase, found.check, parts)
            yield _value_rows(
                row["block"], FIRSTS, part, found.phrase[first], found.check[first],
                keys[text[first]],
            )
            nothing = np.zeros(len(found.trigger), np.uint32)
            first, number, part = _distinct(found.trigger, nothing, parts)
            phrase = found.phrase.view(np.int64)
            one = phrase[first]
            several = np.zeros(len(first), np.uint32)
            several[number[phrase != one[number]]] = 1
            yield _value_rows(row["block"], TRIGGERS, part, found.trigger[first], several, one)

    return blocks.mapInArrow(run, VALUES)


@dataclass
class Settled:
    """What the dictionary settles of a block, and the strings it leaves to compare."""

    starts: np.ndarray  # of the stretches that go
    ends: np.ndarray
    places: np.ndarray  # of the strings left, one for each different string of the block
    part: np.ndarray  # their ranges
    values: np.ndarray
    checks: np.ndarray


def _settle(row: dict, length: int, trigger: int, parts: int) -> Settled:
    _, bounds, data = _texts_of(row)
    found = parse(data, bounds, length, trigger)
    own, number, part = _distinct(found.phrase, found.check, parts)
    whole = np.zeros(len(found.first), bool)
    whole[own] = _read_flags(row["phrase_flags"], FIRSTS, part)
    nothing = np.zeros(len(found.trigger), np.uint32)
    _, which, part = _distinct(found.trigger, nothing, parts)
    flags = _read_flags(row["phrase_flags"], TRIGGERS, part)
    several = flags[which] if len(which) else whole
    open_ = whole & several
    count = (found.last - found.first + 1)[open_]
    at = np.repeat(found.first[open_], count) + (
        np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    )
    values, checks = _string_hashes(data, at, length)
    first, _, part = _distinct(values, checks, parts)
    # a string that the block itself has earlier is settled too
    again = np.ones(len(at), bool)
    again[first] = False
    starts = np.concatenate((found.first[~whole], at[again]))
    ends = np.concatenate((found.last[~whole], at[again])) + length
    return Settled(starts, ends, at[first], part, values[first], checks[first])


def _strings(blocks: DataFrame, length: int, trigger: int, parts: int) -> DataFrame:
    """The different strings of every block that its dictionary leaves to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            left = _settle(row, length, trigger, parts)
            keys, bounds, _ = _texts_of(row)
            text = np.searchsorted(bounds, left.places, side="right") - 1
            yield _value_rows(
                row["block"], FIRSTS, left.part, left.values, left.checks, keys[text]
            )

    return blocks.mapInArrow(run, VALUES)


def _string_hashes(data: np.ndarray, at: np.ndarray, length: int):
    """Both hashes of the strings that start at ascending places."""
    values, checks = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint32)
    low = 0
    while low < len(at):
        begin = at[low]
        high = int(np.searchsorted(at, begin + PIECE))
        rolling = RollingHash(data[begin : at[high - 1] + length])
        starts = at[low:high] - begin
        values[low:high] = rolling.of(starts, starts + length)
        checks[low:high] = rolling.of(starts, starts + length, 1).astype(np.uint32)
        low = high
    return values, checks


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
CLEANED = "doc_id bigint, kept binary, starts array<bigint>, ends array<bigint>"


def _flagged(
    docs: DataFrame, key: str, text: str, length: int, trigger: int
) -> tuple[DataFrame, int]:
    """The blocks with all that says which of their bytes go, and the number of ranges.

    What is brought together goes straight from the parse into the shuffle. The parse is done
    again where it is needed again, which costs less than to store it.
    """
    if not 0 < trigger <= length:
        raise ValueError("a trigger must fit into the string")
    blocks = make_blocks(docs, key, text)
    parts = max(16, -(-blocks.count() * BLOCK_BYTES // RANGE_BYTES))
    dictionary = _flags(_dictionary(blocks, length, trigger, parts))
    known = _joined(blocks, dictionary, "phrase_flags")
    strings = _flags(_strings(known, length, trigger, parts))
    return _joined(known, strings, "string_flags"), parts


def _kept(
    row: dict, length: int, trigger: int, parts: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of every text of a block: id, bytes, and where the removed runs begin and end."""
    keys, bounds, data = _texts_of(row)
    left = _settle(row, length, trigger, parts)
    later = left.places[~_read_flags(row["string_flags"], FIRSTS, left.part)]
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, np.concatenate((left.starts, later)), 1)
    np.add.at(change, np.concatenate((left.ends, later + length)), -1)
    gone = np.cumsum(change[:-1]) > 0
    for key, begin, close in zip(keys.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        some = np.concatenate(([False], gone[begin:close], [False]))
        turns = np.flatnonzero(some[1:] != some[:-1])
        yield key, data[begin:close], turns[::2], turns[1::2]


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    trigger: int = TRIGGER,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """For every row the bytes that stay, and where the removed runs begin and end."""
    flagged, parts = _flagged(docs, key, text, length, trigger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            rows = [
                {
                    "doc_id": None if k == NO_ID else k,
                    "kept": np.delete(data, _inside(starts, ends)).tobytes(),
                    "starts": starts.tolist(),
                    "ends": ends.tolist(),
                }
                for k, data, starts, ends in _kept(row, length, trigger, parts)
            ]
            schema = pa.schema([
                ("doc_id", pa.int64()), ("kept", pa.binary()),
                ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
            ])
            yield pa.RecordBatch.from_pylist(rows, schema)

    return flagged.mapInArrow(run, CLEANED)


def _inside(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.concatenate([np.arange(s, e) for s, e in zip(starts, ends)] or [np.zeros(0, int)])


def repeat_digests(
    docs: DataFrame,
    length: int = LENGTH,
    trigger: int = TRIGGER,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """For every row how many bytes it had, how many went in how many runs, and a digest."""
    flagged, parts = _flagged(docs, key, text, length, trigger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            rows = []
            for k, data, starts, ends in _kept(row, length, trigger, parts):
                digest = hashlib.sha256()
                for low, high in zip([0, *ends.tolist()], [*starts.tolist(), len(data)]):
                    digest.update(data[low:high])
                removed = int((ends - starts).sum())
                k = None if k == NO_ID else k
                rows.append((k, len(data), removed, len(starts), digest.hexdigest()))
            names = [part.split()[0] for part in RESULT.split(", ")]
            kinds = [pa.int64()] * 4 + [pa.string()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return flagged.mapInArrow(run, RESULT)
