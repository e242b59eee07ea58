"""Token ids against the untouched tokenizers library, and what is made of them: packing and directly addressable codes."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import bpe, dac, packing, spans, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
SPECIAL = ["hello <|endoftext|> x", "a  \n<|endoftext|>\n\n<|startoftext|>b", "<|ENDOFTEXT|> <|EndOfText|>", "<|endoftext|><|endoftext|>", "x<|endoftext", "  \n<|EndOfText|>"]
WHITE = ["a b", "a 　\n b", " ", "a \n\nb \u0085", "tab\tand  two\n\n\n three \n", " \n", "\x1c a\x1fb c"]
WORDS = ["Straße, ÀÉ. ÿ! İstanbul ŞIK, ǅ é́ .́ a.,; 'sx x's 12.5%", "J̌ k̇ K Å", "don't we'll it's", "日本語 テキスト。です", "....", "a" * 300, "…a… – “q” ", "é.ñ, 5? ü;"]


def library(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def ids_of(encoder: tokens.ChunkEncoder, values, end_id=None) -> list[list[int]]:
    batch = pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["text"])
    return [ids[a:b].tolist() for _, ids, bounds in encoder.encoded([batch], "text", end_id) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def whole(name: str, values) -> list[list[int]]:
    return [e.ids for e in library(name).encode_batch([v or "" for v in values], add_special_tokens=False)]


@pytest.mark.parametrize("name", NAMES)
def test_ids_are_the_librarys(name):
    values = [None, "", *SPECIAL, *WHITE, *WORDS, " ".join(WORDS + WHITE)]
    encoder = tokens.library_encoder(public_tokenizers.path(name))
    assert encoder.direct
    for _ in range(2):  # new, and known
        assert ids_of(encoder, values) == whole(name, values)
    assert ids_of(encoder, values, 7) == [w + [7] for w in whole(name, values)]
    assert ids_of(tokens.LibraryEncoder(public_tokenizers.path(name), cache_bytes=0), values * 2) == whole(name, values * 2)


@pytest.mark.parametrize("name", NAMES)
def test_strings_of_added_tokens_can_be_plain_text(name):
    t = library(name)
    t.encode_special_tokens = True
    encoder = tokens.library_encoder(public_tokenizers.path(name), specials=False)
    assert ids_of(encoder, SPECIAL) == [e.ids for e in t.encode_batch(SPECIAL, add_special_tokens=False)]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=40, deadline=None)
@given(values=st.lists(st.text(alphabet="aB'. \n\t,é́ßÀ9日 <|>-", max_size=40), max_size=6))
def test_ids_of_any_text(name, values):
    assert ids_of(tokens.library_encoder(public_tokenizers.path(name)), values) == whole(name, values)


@pytest.mark.parametrize("name", NAMES)
def test_long_texts_are_cut_between_words(name, monkeypatch):
    rng = random.Random(1)
    long = " ".join(rng.choice(["word", "Straße,", "x's", "<|endoftext|>", "\n\n", "a b", "12"]) for _ in range(3000))
    plain = " ".join(rng.choice(["word", "Straße,", "x's", "12"]) for _ in range(3000))
    want = whole(name, [long, plain, "short", "a" * 5000])
    monkeypatch.setattr(spans, "PIECE_BYTES", 500)
    assert ids_of(tokens.LibraryEncoder(public_tokenizers.path(name)), [long, plain, "short", "a" * 5000], 3) == [w + [3] for w in want]


def test_byte_bpe_of_odd_and_long_texts(spark, monkeypatch):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    values = [None, "", *SPECIAL, *WHITE, *WORDS, " ".join(WORDS + WHITE) * 40, "Word, " * 3000]
    own = bpe.ByteBPE(bpe.load_ranks(path), public_tokenizers.PATTERN, cache_bytes=0)
    monkeypatch.setattr(spans, "PIECE_BYTES", 700)
    assert ids_of(own, values) == [want.encode_ordinary(v or "") for v in values]
    docs = spark.createDataFrame([(7, "a b"), (7, "a b"), (None, "x")], "doc_id long, text string")
    back = bpe.decoded(bpe.encoded(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in back) == [(0, b"x"), (7, b"a b"), (7, b"a b")]
    assert bpe.decoded(bpe.encoded(docs.limit(0), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).count() == 0


def test_documents_beyond_a_piece(spark):
    """Texts of several MiB, through all of the jobs."""
    big = "one Two, three. " * 150_000
    docs = spark.createDataFrame([(1, big, "a"), (2, "x", "b"), (3, None, None)], "doc_id long, text string, source string")
    want = {i: w + [1] for i, w in zip((1, 2, 3), whole("word_bpe_49k.json", [big, "x", ""]), strict=True)}
    got = {r.doc_id: r for r in dac.read(dac.files(docs, public_tokenizers.path("word_bpe_49k.json"), 1)).collect()}
    assert {i: (r.n_tokens, r.ids_crc32) for i, r in got.items()} == {i: (len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for i, w in want.items()}
    packed = packing.packed(packing.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)).collect()
    n = {i: len(w) + 1 for i, w in zip((1, 2, 3), whole("byte_bpe_50k.json", [big, "x", ""]), strict=True)}
    assert {r.doc_id: r.doc_tokens for r in packed} == n and sum(r.length for r in packed) == sum(n.values())


def test_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(5, "b c", "s"), (None, "z", "s"), (5, "a", "s"), (5, "a", "t"), (None, None, None)], "doc_id long, text string, source string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in dac.read(dac.files(docs, public_tokenizers.path("word_bpe_49k.json"), 1)).collect())
    assert [(d, n) for _, d, n in got] == [(None, 1), (None, 2), (5, 2), (5, 2), (5, 3)] and [s for s, _, _ in got] == [0, 1, 3, 5, 7]
    packed = packing.packed(packing.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in packed) == [(0, 1), (0, 2), (5, 2), (5, 2), (5, 3)]


def test_rows_of_one_id_are_dealt_to_several_tasks(spark):
    """Alike or not, with an id or without."""
    values = [(7, "same text")] * 300 + [(None, f"text {i}") for i in range(300)] + [(9, "z")]
    docs = spark.createDataFrame(values, "doc_id long, text string").repartition(3)
    files = dac.files(docs, public_tokenizers.path("word_bpe_49k.json"), 1)
    got = sorted(dac.read(files).collect(), key=lambda r: r.start)
    assert files.select("part").distinct().count() >= 3
    assert [r.doc_id for r in got] == [None] * 300 + [7] * 300 + [9]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    want = whole("word_bpe_49k.json", [t for _, t in values])
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(np.array([*w, 1], "<u4").tobytes()) for w in want)
