"""Piece codec and token files against the libraries they stand for."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexiscope.llm import piece_codec, token_files
from lexiscope.llm.queries import QUERIES

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = [
    None, "", " ", "  ", " a", "a  b", "x ", "\n", "\n\n x", "a\nb", "a\tb\r\n", "ａ", "​ x", "<s> a </s>",
    "é é", "\x00", "😀😀", "▁", "a▁b", "don't!!", "x" * 500, "日本語 ٣", "<0x0A>", "<|endoftext|> a",
    "# # ###", " a b", "ǅ İ ß", "long " * 3000,
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, text, 1, "z") for i, text in enumerate(AWKWARD + AWKWARD[:5])] + [(None, "a", 1, "z")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, key string")


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def expected_pieces(text):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = library.encode(text or "")
    return ids, library.decode(ids) if ids else ""


def test_piece_digests_are_those_of_the_library(awkward):
    found = piece_codec.token_digests(awkward, PIECES).collect()
    texts = {row.doc_id: row.text for row in awkward.collect()}
    assert len(found) == awkward.count()
    for row in found:
        ids, decoded = expected_pieces(texts[row.doc_id])
        assert row.n_tokens == len(ids), texts[row.doc_id]
        assert row.ids_sha256 == digest(",".join(map(str, ids)).encode())
        assert row.decoded_sha256 == digest(decoded.encode())


def test_full_output_holds_ids_and_text(awkward):
    for row in piece_codec.encode_and_decode(awkward, PIECES).collect():
        text = AWKWARD[row.doc_id % len(AWKWARD)] if row.doc_id is not None else "a"
        ids, decoded = expected_pieces(text)
        assert (row.ids, row.n_tokens, row.decoded) == (ids, len(ids), decoded)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab e\n .,é▁😀th<s>"), max_size=40))
def test_agenda_in_step_and_alone_give_what_the_library_gives(text):
    codec = piece_codec.codec_of(PIECES)
    ids, decoded = expected_pieces(text)
    assert codec.encode(text) == ids and codec.decode(ids) == decoded
    chunks = piece_codec.cut_chunks(piece_codec.pa.array([text] * 1))[0].to_pylist()
    assert codec.merge_many(chunks * 9) == [codec.merge(chunk) for chunk in chunks] * 9


def test_a_wrong_encoding_does_not_pass_the_check():
    codec = piece_codec.codec_of(PIECES)
    with pytest.raises(ValueError):
        codec.check([" the"], [[5]], [codec.decode_bytes([5])])


def test_piece_query_over_the_documents(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    found = {row.doc_id: row for row in QUERIES["op1_piece_codec"].run(spark, small).collect()}
    assert len(found) == len(rows)
    for row in rows:
        ids, decoded = expected_pieces(row.text)
        assert found[row.doc_id].ids_sha256 == digest(",".join(map(str, ids)).encode())
        assert found[row.doc_id].decoded_sha256 == digest(decoded.encode())


def expected_tokens(rows):
    library = Tokenizer.from_file(WORDS)
    start = 0
    for key, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        yield key, start, len(ids), zlib.crc32(ids.tobytes())
        start += len(ids)


def test_files_hold_what_the_library_gives(awkward):
    rows = [(row.doc_id, row.text) for row in awkward.filter("doc_id is not null").collect()]
    found = token_files.write_and_read_tokens(awkward.filter("doc_id is not null"), WORDS)
    assert sorted(map(tuple, found.collect())) == list(expected_tokens(sorted(rows, key=lambda r: r[0])))


def test_null_ids_and_repeated_rows_are_kept(spark, awkward):
    twice = awkward.unionAll(awkward)
    found = token_files.write_and_read_tokens(twice, WORDS).collect()
    assert len(found) == twice.count()
    assert sum(row.doc_id is None for row in found) == 2
    assert min(found, key=lambda row: row.start).doc_id is None
    ordered = sorted(found, key=lambda row: row.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:]))


def test_empty_tables(spark, awkward):
    assert token_files.write_and_read_tokens(awkward.limit(0), WORDS).collect() == []
    assert piece_codec.token_digests(awkward.limit(0), PIECES).collect() == []


def test_one_document_is_read_on_its_own(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_TOKENS", 4)
    path = tmp_path / "ids"
    with open(path, "wb") as sink:
        writer = token_files.TokenFileWriter(sink)
        for key, size in ((7, 10), (8, 0), (9, 3)):
            writer.add(key, np.arange(size, dtype=np.uint32))
        writer.close()
    assert token_files.tokens_of(str(path), 0).tolist() == list(range(10))
    assert token_files.tokens_of(str(path), 1).tolist() == []
    assert token_files.tokens_of(f"file://{path}", 2).tolist() == [0, 1, 2]
    whole = token_files.zstandard.ZstdDecompressor()  # any reader of the format skips the tables
    with open(path, "rb") as source:
        plain = whole.stream_reader(source, read_across_frames=True).read()
    assert np.frombuffer(plain, "<u4").tolist() == [*range(10), 0, 1, 2]
    broken = bytearray(path.read_bytes())
    broken[12] ^= 1
    path.write_bytes(broken)
    with pytest.raises((ValueError, token_files.zstandard.ZstdError)):
        token_files.tokens_of(str(path), 0)


def test_token_file_query_over_the_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = QUERIES["op9_token_files"].run(spark, small).collect()
    assert sorted(map(tuple, found)) == list(expected_tokens(sorted(rows)))
