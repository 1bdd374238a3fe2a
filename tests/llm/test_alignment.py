"""Alignments against the plain libraries over whole texts, with all end offsets and links in sets."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from tessera.llm import alignment

FIRST, SECOND = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


class Plain:
    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(FIRST)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=SECOND)
        shown = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        rest = iter(range(256, 400))
        table = {shown.get(b) or chr(next(rest)): b for b in range(256)}
        self.bytes_a = {i: bytes(table[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if set(t) <= set(table)}

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def align(self, text):
        """ids of both sides and the groups."""
        if not text:
            return [], [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text, num_threads=1)
        parts = [[self.bytes_a[i] for i in a], [self.bytes_b(i) for i in b]]
        if any(b"".join(p) != (" " + text).encode() for p in parts):
            return [], [], []
        ends = []
        for p in parts:
            at, out = 0, []
            for x in p:
                at += len(x)
                out.append(at)
            ends.append(out)
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        # one token of each side ends at a cut
        links = [(x[-1], y[-1]) for x, y in groups]
        return a, b, list(zip(groups, links, strict=True))


@pytest.fixture(scope="module")
def plain():
    return Plain()


def _whole(plain, rows):
    found = [plain.align(t) for _, t in rows]
    count = Counter(link for _, _, g in found for _, link in g)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for (doc, _), (a, b, g) in zip(rows, found, strict=True):
        told = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for (x, y), _ in g)
        links = [link for _, link in g]
        out.append((str(doc), len(a), len(b), len(g), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(told.encode()).hexdigest() if told else "", told))
    return sorted(out)


# fixed values: all kinds of white space, spaces in other scripts, marks, joined letters, special tokens
ODD = [
    "hello world", " two  spaces ", "a\n\nb\n c \n", "\n", " ", "   ", "tab\t and \r\n end", "don't we'll I'M", "<s> </s> <|endoftext|> <unk> <0x0A>", "x▁y", "  nbsp   x　 y", "\x1c \x1d\x85 z  w",
    "日本語 テキスト 🎉👩‍👩‍👧 é ﬁ", "\x00 nul", "a" * 3000, "==== ---- ####", "    def f(x):\n        return x  # y\n", "1234567 89,012.34", "x;\r\n});\r\n", "word​zero ﻿bom", "ÀÉ ß ſ K", " \U0010ffff", "a \n", "a\n ", " \n a",
]


def test_one_text_at_a_time(plain):
    own = alignment.Aligner(FIRST, SECOND)
    assert own.cuts
    for text in ODD:
        a, b, groups = plain.align(text)
        found = own.align(text)
        want = (len(a), len(b), ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for (x, y), _ in groups)) if a else None
        assert (found[:3] if found else None) == want, text


@settings(max_examples=400, deadline=None)
@given(text=st.text(st.sampled_from(list("ab .'\n\t\r,1") + [" ", "　", "▁", "é", "日", "🎉", "\x85", "\x1f", "s", "r", "e"]), max_size=25))
@example(text="a\x1f b")
def test_pieces_do_not_matter(plain, text):
    a, b, groups = plain.align(text)
    found = _OWN.align(text)
    assert (found[0], found[1]) == (len(a), len(b)) if found else not a
    if found:
        assert found[2] == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for (x, y), _ in groups)


_OWN = alignment.Aligner(FIRST, SECOND)


def test_without_pieces_and_with_small_memos(plain, monkeypatch):
    own = alignment.Aligner(FIRST, SECOND)
    own.cuts = False
    small = alignment.Aligner(FIRST, SECOND)
    monkeypatch.setattr(alignment, "MEMO", 5)
    for text in ODD:
        want = _OWN.align(text)
        assert own.align(text) == want and small.align(text) == want


def test_transducer():
    t = alignment.Transducer([b"ab", b"c", b"a", b"bcd"], [b"a", b"bc", b"abc", b"d", b"x"])
    assert t.align([0, 1], [0, 1]) == [(2, 2)]
    assert t.align([2, 3], [0, 1, 3]) == [(1, 1), (2, 3)]
    assert t.align([0, 1], [2]) == [(2, 1)]
    assert t.align([0, 1], [4]) is None and t.align([0], [2]) is None and t.align([0, 1], [0]) is None and t.align([2], [0, 3]) is None
    assert t.align([], []) == []
    known = t.known
    assert t.align([2, 3], [0, 1, 3]) == [(1, 1), (2, 3)] and t.known == known


def _run(spark, folder):
    df = alignment.op11_cross_tokenizer(spark, folder)
    assert df.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((str(r[0]), *r[1:8]) for r in df.collect())


def test_whole_results(spark, plain, documents):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()
    rows = [(r[0], r[1]) for r in texts] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(1, None), (2, ""), (None, "no id"), (7, "twice"), (7, "twice"), (20_000, "copy of one text " * 4000)]
    rows += [(30_000 + i, "one text that a third of all rows have") for i in range(50)]
    want = _whole(plain, rows)
    assert _run(spark, documents(rows)) == [r[:8] for r in want]
    # any blocks and layout give the same
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block, parts in ((1, 1), (300, 7)):
        found = alignment.align(df.repartition(parts), block=block)
        assert sorted((str(r["doc_id"]), r["n_best"], r["count_sum"], r["groups"]) for r in found.collect()) == [(r[0], r[5], r[6], r[8]) for r in want]


def test_empty_and_extra_columns(spark, plain, documents):
    assert _run(spark, documents([])) == []
    rows = [(1, "some words", 3, 4, "x"), (2, None, 5, 6, "y")]
    assert _run(spark, documents(rows, "doc_id long, text string, n_a long, block long, links string")) == [r[:8] for r in _whole(plain, [r[:2] for r in rows])]
