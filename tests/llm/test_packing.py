"""Pieces hold each id once, sequences have no gaps and next to no padding."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing as P


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return own


def check(rows, texts, library, length=1024):
    ids = {k: np.array([*library.encode(v or "", add_special_tokens=False).ids, 0], "<u4") for k, v in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for spans, whole in [*((v, len(ids[k])) for k, v in pieces.items()), *((v, None) for v in sequences.values())]:
        at = 0
        for start, size in sorted(spans):
            assert start == at
            at += size
        assert at == whole if whole is not None else at <= length
    full = [sum(n for _, n in v) for v in sequences.values()]
    assert all(n & (n - 1) == 0 for n in full)  # full, or a power of two: nothing is padded
    assert sum(n < length for n in full) <= length.bit_length()


def test_whole_table(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    check(P.op3_packing(spark, folder).collect(), texts, library)


def test_edges_over_many_partitions(spark, tmp_path, library, monkeypatch):
    monkeypatch.setattr(P, "FAN", 2)
    texts = {i: "word " * (i * 37 % 900) for i in range(40)} | {90: None, 91: "", 92: "<|endoftext|> ½é日本 \x00", 93: "long " * 30_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    check(P.op3_packing(spark, str(tmp_path)).collect(), texts, library)


def test_empty_and_null_ids(spark, documents):
    assert P.op3_packing(spark, documents([])).count() == 0
    found = P.op3_packing(spark, documents([(None, "a"), (1, "b"), (1, "b")])).collect()
    assert sorted((r["doc_id"] is None, r["length"]) for r in found) == [(False, 2), (False, 2), (True, 2)]


def test_fast_encoder_is_the_library(library):
    rng = np.random.default_rng(1)
    fast = P.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    letters = list("abc deé'stre\n\t 019.,ßñ日😀  ")
    for _ in range(300):
        text = "".join(rng.choice(letters, rng.integers(0, 60)))
        assert fast(text) == library.encode(text, add_special_tokens=False).ids


def test_other_files_use_the_library():
    other = P.encoder(public_tokenizers.path("word_bpe_49k.json"))
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert other("Some words, here") == own.encode("Some words, here", add_special_tokens=False).ids


def test_fullest_is_closed():
    packer = P.Packer(10, 2, 0)
    for i, n in enumerate((6, 7, 5)):
        packer.add(i, 0, np.arange(n, dtype="<u4"), n)
    # 5 fits neither 6 nor 7: its head fills the fullest, 7, and the rest goes to 6
    assert [(r[0], r[1], r[2]) for r in packer.done] == [(1, 0, 7), (2, 0, 3)]
    assert [w[0] for w in packer.open] == [8]


def test_clashing_columns_do_not_matter(spark):
    rows = [(i, "some words " * i) for i in range(9)]
    plain = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    more = plain.selectExpr("*", "1 as start", "'x' as part", "2 as ids", "true as open", "3L as sequence_id")
    key = lambda df: sorted((r["doc_id"], r["start"], bytes(r["ids"])) for r in P.pack(df).collect())
    assert key(plain) == key(more)
