"""Ids against tiktoken, and the exact round trip."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tessera.llm import bpe as B


@pytest.fixture(scope="module")
def library():
    ranks = B.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def want(rows, library):
    out = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, folder):
    return sorted(map(tuple, B.op5_byte_bpe(spark, folder).collect()), key=str)


def test_whole_table(spark, library):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert got(spark, folder) == want(rows, library)


def test_edges(spark, documents, library):
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (None, "<|endoftext|> hi"), (4, "a" * 300), (4, "a" * 300), (5, "　 \x85 tab\t\n\n  end  "), (6, "日本語テキスト" * 20 + " 😀😀😀"), (7, "x" * 3 + " 'll we've 12345 ½²"), (8, "word " * 20_000)]
    rows += [(i, "".join(rng.choice("abcde fgh'stre lmé日\n 019_-ß́ท") for _ in range(rng.randrange(1, 400)))) for i in range(10, 80)]
    assert got(spark, documents(rows)) == want(rows, library)
    assert got(spark, documents([])) == []


def test_without_cache_and_with_clashing_columns(spark, library):
    df = spark.createDataFrame([(1, "hello there", "x", 5), (2, None, None, None)], "i int, text string, ids string, places int")
    encoded = B.encode(df.withColumnRenamed("ids", "words"), cache_words=0, chunk=10)
    assert encoded.columns == ["i", "words", "places", "ids"]
    rows = {r["i"]: r["ids"] for r in encoded.collect()}
    assert rows == {1: library.encode_ordinary("hello there"), 2: []}
    decoded = B.decode(encoded)
    assert {r["i"]: bytes(r["decoded"]) for r in decoded.collect()} == {1: b"hello there", 2: b""}


def test_decode_takes_unknown_ids_and_nulls(spark):
    df = spark.createDataFrame([([31373, -1, 99999, None],), (None,), ([],)], "ids array<int>")
    assert [bytes(r["decoded"]) for r in B.decode(df).collect()] == [b"hello", b"", b""]


def long_words(rng):
    """Words that are hard to cut: runs from every offset, periods, small alphabets, letters of several bytes."""
    yield from ("b" * k + "a" * n for k in (0, 1, 3) for n in (700, 1001))
    yield from ("é" * 900, "x" + "日" * 700, "ab" * 600, "abc" * 500, "-" * 1500, "=" + "-" * 777 + "=" * 801, "aab" * 400 + "a" * 500)
    for letters in ("ab", "aeiou", "abcdefghijklmnopqrstuvwxyz", "aé", "etaoin"):
        yield "".join(rng.choice(letters) * rng.choice((1, 1, 1, 2, 200)) for _ in range(400))


def test_pieces_of_long_words_join_exactly(library):

    ranks = library._mergeable_ranks
    sizes = np.array([len(p) for p in sorted(ranks, key=ranks.get)])
    joined = 0
    for word in long_words(random.Random(6)):
        data = word.encode()
        starts = B.piece_starts(data)
        assert starts[0] == 0 and all(0 < b - a <= B.STRIDE for a, b in zip(starts, starts[1:], strict=False)) and starts[-1] + B.LONG >= len(data)
        want_ = library._encode_single_piece(data)
        ids = B.join_pieces(starts, [np.array(library._encode_single_piece(data[s : s + B.LONG])) for s in starts], sizes)
        joined += ids is not None
        assert ids is None or ids.tolist() == want_
        assert B.merge_bytes(data, ranks) == want_
    assert joined > 8  # the others are what the heap is for


def test_long_words_in_documents(spark, documents, library, monkeypatch):
    rows = [(i, w) for i, w in enumerate(long_words(random.Random(7)))] + [(99, "short words too"), (100, None)]
    assert got(spark, documents(rows)) == want(rows, library)
    # words whose pieces do not meet are merged by a heap
    monkeypatch.setattr(B, "join_pieces", lambda *_: None)
    own = B._whole_words(pa.array([[1, 2], library._encode_single_piece(b"q" * 300 + b"u" * 84), library._encode_single_piece(b"u" * 500)]), np.array([1, 1, 2, 0, 200]), B.piece_table(library._mergeable_ranks))
    assert own.to_pylist() == [[1, 2], library._encode_single_piece((b"q" * 300 + b"u" * 84)[:200] + b"u" * 500)]


def test_a_word_of_200000_letters(spark, documents, library):
    rng = random.Random(5)
    rows = [(1, "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(200_000)))]
    folder = documents(rows)
    began = time.time()
    assert got(spark, folder) == want(rows, library)
    assert time.time() - began < 60
