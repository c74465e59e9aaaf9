"""Token ids in binary files that can be read document by document.

File format: every document is one or more independent zstandard frames of little-endian unsigned
32-bit ids. A skippable frame with the ids of the documents follows, and at the end a skippable
frame with the seek table of the public seekable format: the compressed size, the size and the
checksum of every frame, the number of frames and a closing magic number. A reader fetches the
seek table first and decompresses only the frames of the documents it wants.

Files hold documents in ascending order of their ids, and so do the files among themselves; rows
of one id are ordered by their text. Defined results: a null or empty text has the end id alone; a
null id comes first; repeated rows are written as often as they occur; an empty table gives no
file. A document of more than ``FRAME_TOKENS`` tokens takes several frames.
"""

from __future__ import annotations

import gc
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiscope.llm.arrow import keyed_text, small_slices, split_words, utf8_of
from lexiscope.llm.hashing import lower_ascii
from lexiscope.sources.shared import fresh_path

# Fixed values of the zstandard seekable format.
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
WITH_CHECKSUMS = 0x80

FRAME_TOKENS = 1 << 20
CACHE_WORDS = 500_000
LONG_WORD = 64  # longer ones are not kept
NO_KEY = -(2**63)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address that all executors can reach, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


class TokenFileWriter:
    """Writes documents one after the other; ``close`` adds the ids and the seek table."""

    def __init__(self, sink, level: int = 3) -> None:
        self.sink = sink
        self.press = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries: list[bytes] = []
        self.documents: list[tuple[int, int]] = []
        self.tokens = 0

    def add(self, key: int, ids: np.ndarray) -> None:
        frames = 0
        for first in range(0, max(len(ids), 1), FRAME_TOKENS):
            plain = ids[first : first + FRAME_TOKENS].astype("<u4").tobytes()
            pressed = self.press.compress(plain)
            check = xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF
            self.entries.append(struct.pack("<III", len(pressed), len(plain), check))
            self.sink.write(pressed)
            frames += 1
        self.documents.append((key, frames))
        self.tokens += len(ids)

    def close(self) -> None:
        listed = np.array(self.documents, "<i8").tobytes()
        self.sink.write(struct.pack("<II", SKIPPABLE, len(listed)) + listed)
        # the list is a frame of the table too, one without content
        self.entries.append(struct.pack("<III", 8 + len(listed), 0, 0))
        table = b"".join(self.entries)
        tail = struct.pack("<IBI", len(self.entries), WITH_CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", SEEK_TABLE, len(table) + len(tail)) + table + tail)


class TokenFileReader:
    """Reads the seek table and the list of documents; frames only as they are asked for."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - 9)
        frames, kind, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or not kind & WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(size - 9 - 12 * frames)
        table = np.frombuffer(source.read(12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.pressed, self.plain, self.checks = table.T
        self.at = np.concatenate(([0], np.cumsum(self.pressed)))
        source.seek(int(self.at[-2]))
        listed = np.frombuffer(source.read(int(self.pressed[-1]))[8:], "<i8").reshape(-1, 2)
        self.keys, self.frames = listed[:, 0], listed[:, 1]
        self.first = np.concatenate(([0], np.cumsum(self.frames)))
        before = np.concatenate(([0], np.cumsum(self.plain)))
        #: tokens before each document, and in all
        self.starts = before[self.first] // 4

    def ids(self, document: int) -> np.ndarray:
        """Ids of the document of that number in the file, held against their checksums."""
        parts = []
        for frame in range(int(self.first[document]), int(self.first[document + 1])):
            self.source.seek(int(self.at[frame]))
            pressed = self.source.read(int(self.pressed[frame]))
            plain = zstandard.ZstdDecompressor().decompress(
                pressed, max_output_size=int(self.plain[frame])
            )
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.checks[frame]:
                raise ValueError(f"frame {frame} is not what was written")
            parts.append(np.frombuffer(plain, "<u4"))
        return np.concatenate(parts)


class WordEncoder:
    """Ids of texts by the tokenizers library, asked once for each distinct piece of a batch.

    The vocabulary drops white space, lowers letters first, and ends a token where letters are
    followed by something else. So texts are lowered (A to Z) and cut at white space and between
    an ASCII letter and ASCII punctuation, and the ids of a text are those of its pieces. Texts
    that may hold the names of special tokens are cut at white space only, as they are.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def look_up(self, words: Sequence[str]) -> list[bytes]:
        known = self.known
        new = [word for word in words if word not in known]
        if len(known) + len(new) > CACHE_WORDS:
            used = set(words)
            known = self.known = {w: ids for w, ids in known.items() if w in used}
        for first in range(0, len(new), 10_000):
            some = new[first : first + 10_000]
            coded = self.library.encode_batch_fast(some, add_special_tokens=False)
            known.update((w, array("I", c.ids).tobytes()) for w, c in zip(some, coded))
        found = [known[word] for word in words]
        for word in new:
            if len(word) > LONG_WORD:
                del known[word]
        return found

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        data, bounds = utf8_of(texts)
        opens = data == ord("<")
        if (opens[:-1] & (data[1:] == ord("|"))).any():
            words, begins = split_words(data, bounds)
        else:
            data = lower_ascii(data)
            letter = (data >= 97) & (data <= 122)
            digit = (data >= 48) & (data <= 57)
            mark = (data > 32) & (data < 127) & ~letter & ~digit
            cuts = np.zeros(len(data), bool)
            cuts[1:] = mark[1:] & letter[:-1]
            words, begins = split_words(data, bounds, cuts)
        coded = words.dictionary_encode()
        known = pa.array(self.look_up(coded.dictionary.to_pylist()), pa.large_binary())
        data, bounds = utf8_of(known.take(coded.indices))
        for first, last in zip(bounds[begins[:-1]].tolist(), bounds[begins[1:]].tolist()):
            yield data[first:last].view("<u4")


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


WRITTEN = "part int, path string, documents bigint, tokens bigint"


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    end_id: int = 1,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Write the ids of all documents, each with the end id behind it, below a shared folder.

    Ranges of ids become files. Gives one row per file: its number, its path, how many documents
    and tokens it holds, and how many tokens the files before it hold. A task that runs again
    writes a file of another name; the table names only those of the tasks that counted.
    """
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    placed = keyed_text(docs, key, text).repartitionByRange(*order[:2])
    ordered = placed.sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        encoder = encoder_of(tokenizer)
        part = TaskContext.get().partitionId()
        system, below = file_system(folder)
        system.create_dir(below)
        path = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
        writer = None
        with system.open_output_stream(f"{below}/{path}", compression=None) as sink:
            writer = TokenFileWriter(sink)
            end = np.array([end_id], np.uint32)
            for batch in batches:
                for some in small_slices(batch, "text"):
                    keys = some.column("key").to_pylist()
                    for k, ids in zip(keys, encoder.encode(some.column("text"))):
                        writer.add(NO_KEY if k is None else k, np.concatenate((ids, end)))
            writer.close()
        if writer.documents:
            yield pa.RecordBatch.from_pylist(
                [{
                    "part": part, "path": path, "documents": len(writer.documents),
                    "tokens": writer.tokens,
                }],
                pa.schema([
                    ("part", pa.int32()), ("path", pa.string()), ("documents", pa.int64()),
                    ("tokens", pa.int64()),
                ]),
            )

    # one row per file; running the job once, here, fixes which files count
    files = sorted(ordered.mapInArrow(run, WRITTEN).collect())
    before, rows = 0, []
    for part, path, documents, tokens in files:
        rows.append((part, f"{folder}/{path}", documents, tokens, before))
        before += tokens
    return docs.sparkSession.createDataFrame(rows, f"{WRITTEN}, start bigint")


READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_token_files(files: DataFrame) -> DataFrame:
    """Read every document of the files: where it begins among all, its length and a checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(
                batch.column("path").to_pylist(), batch.column("start").to_pylist()
            ):
                system, inside = file_system(path)
                with system.open_input_file(inside) as source:
                    reader = TokenFileReader(source)
                    for first in range(0, len(reader.keys), 10_000):
                        some = range(first, min(first + 10_000, len(reader.keys)))
                        found = [reader.ids(document) for document in some]
                        keys = reader.keys[some.start : some.stop].tolist()
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(
                                [None if k == NO_KEY else k for k in keys], pa.int64()
                            ),
                            "start": pa.array(reader.starts[some.start : some.stop] + start),
                            "n_tokens": pa.array([len(ids) for ids in found], pa.int64()),
                            "ids_crc32": pa.array(
                                [zlib.crc32(ids.tobytes()) for ids in found], pa.int64()
                            ),
                        })

    spread = files.select("path", "start").repartition(max(files.count(), 1), "path")
    return spread.mapInArrow(run, READ)


def tokens_of(path: str, document: int) -> np.ndarray:
    """The ids of one document of one file, as a reader on its own would fetch them."""
    system, inside = file_system(path)
    with system.open_input_file(inside) as source:
        return TokenFileReader(source).ids(document)


def write_and_read_tokens(docs: DataFrame, tokenizer: str, **names: str) -> DataFrame:
    """Write the table to a fresh folder in the shared place and read its documents back."""
    folder = fresh_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer, folder, **names))
