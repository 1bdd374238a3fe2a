"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often two ids meet.

Method: a dangling-suffix transducer. It reads the tokens of both sides and keeps which side leads and by which bytes,
the residual. The side that lags gives the next token: its bytes are taken off the residual, or else take the lead with
what is left of them. Where the residual becomes empty, both sides end at one byte, and a group closes; its last two
tokens are linked. Transitions are memoised by residual and next token. Both sides' bytes are thus compared whole: a
text whose sides differ has no tokens.

Neither tokenizer joins anything across a space or line feed behind other text, which is checked against the
vocabularies. So texts are cut there; the transducer always stands at an empty residual then, and its whole way through
such a piece is memoised too. Tables of both kinds are emptied when they are full.

Links are counted over the whole corpus: a task gathers documents to blocks of BLOCK links, whose distinct id pairs are
counted before any shuffle. The counts come back to the blocks by a join on pairs, in which a pair has a row for each
block that has it; each block's documents then stream past its counts. The most frequent partner of an id of the
second tokenizer comes from a table of one row for each of its ids, which is broadcast: its vocabulary bounds it.

The first tokenizer is a plain byte-level BPE file as the packing operator takes; the second a sentencepiece model that
puts a space before the text and changes nothing else about it.

Edge cases: a null or empty text has no tokens, neither has one whose sides' bytes are not a space and the text; their
counts are zero and their groups empty; special tokens in texts are ordinary text; a null doc_id stays null; repeated
rows count each; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep, prepare, release
from tessera.llm.packing import encoder

#: Links whose pairs are counted together; entries and characters of a memo.
BLOCK, MEMO, MEMO_CHARS = 1 << 22, 1 << 19, 1 << 24
#: Characters that count as white space in the first tokenizer's pattern. Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


class Transducer:
    """Aligns two token sequences. A state is 0 where no side leads, n where the first side leads by residuals[n], -n for the second."""

    def __init__(self, first: list[bytes], second: list[bytes]):
        self.sides = (first, second)
        self._forget()

    def _forget(self) -> None:
        self.residuals: list[bytes] = [b""]
        self.numbers: dict[bytes, int] = {b"": 0}
        #: Next states by residual and the lagging side's token; where none leads, the first side goes on.
        self.ahead: list[dict[int, int | None]] = [{}]
        self.behind: list[dict[int, int | None]] = [{}]
        self.known = self.held = 0

    def _move(self, state: int, token: int) -> int | None:
        """The state after the lagging side's next token; None if its bytes are others."""
        ahead, own = self.residuals[abs(state)], self.sides[state > 0][token]
        self.known += 1
        if ahead.startswith(own):
            left, leads = ahead[len(own) :], 1 if state > 0 else -1
        elif own.startswith(ahead):
            left, leads = own[len(ahead) :], -1 if state > 0 else 1
        else:
            return None
        if left not in self.numbers:
            self.numbers[left] = len(self.residuals)
            self.residuals.append(left)
            self.ahead.append({})
            self.behind.append({})
            self.held += len(left)
        return leads * self.numbers[left]

    def align(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """How many tokens of each side every closed group ends at; None if the sides' bytes differ."""
        if self.known > MEMO or self.held > MEMO_CHARS:
            self._forget()
        ahead, behind, out = self.ahead, self.behind, []
        state = i = j = 0
        n, m = len(a), len(b)
        while i < n or j < m:
            if state > 0:
                if j == m:
                    return None
                moves, token = ahead[state], b[j]
                j += 1
            else:
                if i == n:
                    return None
                moves, token = behind[-state], a[i]
                i += 1
            if token in moves:
                state = moves[token]
            else:
                state = moves[token] = self._move(state, token)
            if state is None:
                return None
            if state == 0:
                out.append((i, j))
        return out if state == 0 else None


def byte_level(token: str) -> bytes:
    """The bytes of a byte-level vocabulary's entry: printable characters stand for themselves, the others from U+0100 on for the rest in order."""
    return bytes(_BYTE_OF[c] for c in token)


_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_OF = {chr(b): b for b in _SHOWN} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Aligner:
    """Both tokenizers, and what is known of the pieces seen so far."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(first).get_vocab(with_added_tokens=False)
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in _BYTE_OF for c in token):
                tokens[i] = byte_level(token)
        self.first = encoder(first)
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        names = [self.second.id_to_piece(i) for i in range(self.second.vocab_size())]
        byte = [self.second.is_byte(i) for i in range(len(names))]
        others = [bytes([int(n[1:-1], 16)]) if b else n.replace("▁", " ").encode() for n, b in zip(names, byte, strict=True)]
        self.transducer = Transducer(tokens, others)
        self.sizes = tuple(np.array(list(map(len, side))) for side in (tokens, others))
        self.told = tuple(list(map(str, range(len(side)))) for side in (tokens, others))
        texts = [n for n, b in zip(names, byte, strict=True) if not b]
        self.cuts = not any("▁" in n.lstrip("▁") or "\n" in n for n in texts)
        self.lead = len(self.second.encode("\n"))
        self.piece = re.compile(r"[ \n][^ \n]*")
        # a space or line feed behind white space starts no piece
        self.odd = re.compile(f"[{re.escape(WHITE)}](?=[ \n])")
        self._forget()

    def _forget(self) -> None:
        #: Numbers of tokens of both sides, groups and links of pieces; False for one without an alignment.
        self.memo: dict[str, tuple[int, int, str, bytes] | bool] = {}
        self.chars = 0

    def pieces(self, text: str) -> list[str]:
        """A space and the text, in parts that both tokenizers treat alone."""
        if not self.cuts:
            return [" " + text]
        out = self.piece.findall(" " + text)
        if not self.odd.search(" " + text):
            return out
        joined = [out[0]]
        for part in out[1:]:
            if joined[-1][-1] in WHITE:
                joined[-1] += part
            else:
                joined.append(part)
        return joined

    def _learn(self, new: list[str]) -> None:
        """Align pieces that are not known yet, all at once where each ends as it begins: not in white space."""
        last = [p for p in new if p[-1] in WHITE]
        rest = [p for p in new if p[-1] not in WHITE]
        for some in (rest, *([p] for p in last)):
            if some and not self._together(some):
                for piece in some:
                    if len(some) == 1 or not self._together([piece]):
                        self.memo[piece] = False
                        self.chars += len(piece)

    def _together(self, new: list[str]) -> bool:
        """Align some pieces one after another; whether both sides' bytes agree."""
        whole = "".join(new)
        a = self.first(whole)
        # a line feed is a token of its own, so what stands before it goes with it
        b = self.second.encode("\n" + whole, num_threads=1)[self.lead :] if self.cuts else self.second.encode(whole[1:], num_threads=1)
        ends = self.transducer.align(a, b)
        if ends is None:
            return False
        size = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in new])
        cuts = np.searchsorted(np.cumsum(self.sizes[0][a]), size) + 1
        (one, two), i, j, at = self.told, 0, 0, 0
        for piece, cut in zip(new, cuts.tolist(), strict=True):
            from_a, from_b, groups, links = i, j, [], []
            while i < cut:
                k, m = ends[at]
                at += 1
                if k - i == 1 == m - j:
                    groups.append(one[a[i]] + "|" + two[b[j]])
                else:
                    groups.append(",".join([one[x] for x in a[i:k]]) + "|" + ",".join([two[x] for x in b[j:m]]))
                i, j = k, m
                links.append(a[i - 1] << 32 | b[j - 1])
            self.memo[piece] = i - from_a, j - from_b, ";".join(groups), struct.pack(f"<{len(links)}q", *links)
            self.chars += len(piece)
        return True

    def align(self, text: str) -> tuple[int, int, str, bytes] | None:
        """Numbers of tokens of both sides, the groups, and a 64-bit pair of ids for each link; None without tokens."""
        if not text:
            return None
        if len(self.memo) > MEMO or self.chars > MEMO_CHARS:
            self._forget()
        parts = self.pieces(text)
        found = list(map(self.memo.get, parts))
        if None in found:
            self._learn(list(dict.fromkeys(p for p, x in zip(parts, found, strict=True) if x is None)))
            found = list(map(self.memo.get, parts))
        if False in found:
            return None
        a, b, groups, links = zip(*found, strict=True)
        return sum(a), sum(b), ";".join(groups), b"".join(links)


_FIELDS = [("kind", pa.int32()), ("block", pa.int64()), ("place", pa.int32()), ("pair", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("links", pa.binary())]
_ARROW = pa.schema(_FIELDS)
_SCHEMA = "kind int, block long, place int, pair long, n long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary"
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(first: str, second: str) -> Aligner:
    """The worker's own, which outlives a task with all that it knows."""
    if (first, second) not in _ALIGNERS:
        _ALIGNERS[first, second] = Aligner(first, second)
    return _ALIGNERS[first, second]


class _Block:
    """Documents whose links are counted together."""

    def __init__(self, number: int):
        self.number, self.rows, self.size, self.bytes = number, [], 0, 0

    def add(self, doc_id: int | None, found: tuple[int, int, str, bytes] | None, digest: bool) -> None:
        a, b, groups, links = found or (0, 0, "", b"")
        n = len(links) // 8
        told = hashlib.sha256(groups.encode()).hexdigest() if digest and groups else groups
        self.rows.append((doc_id, a, b, n, n, told, links))
        self.size += n
        self.bytes += len(told)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Rows of kind 0 for its distinct pairs, and of kind 1 for its documents, whose links are places among the pairs."""
        every = np.frombuffer(b"".join(r[-1] for r in self.rows), "<i8")
        place, pairs = pd.factorize(every, sort=True)
        count = np.bincount(place, minlength=len(pairs))
        kind = "<u2" if len(pairs) <= 1 << 16 else "<u4"
        place = place.astype(kind)
        for low in range(0, len(pairs), 1 << 16):
            part = slice(low, min(len(pairs), low + (1 << 16)))
            yield self._batch(part.stop - low, kind=np.zeros(part.stop - low, np.int32), place=np.arange(low, part.stop, dtype=np.int32), pair=pairs[part], n=count[part])
        ends = np.cumsum([r[4] for r in self.rows])
        links = [np.sort(place[e - r[4] : e]).tobytes() for e, r in zip(ends, self.rows, strict=True)]
        for low in range(0, len(self.rows), 1000):
            rows = self.rows[low : low + 1000]
            columns = dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"), zip(*rows, strict=True), strict=False))
            yield self._batch(len(rows), kind=[1] * len(rows), place=[np.dtype(kind).itemsize] * len(rows), links=links[low : low + 1000], **columns)

    def _batch(self, rows: int, **columns) -> pa.RecordBatch:
        columns["block"] = [self.number] * rows
        return pa.RecordBatch.from_arrays([pa.array(columns[n], t) if n in columns else pa.nulls(rows, t) for n, t in _FIELDS], schema=_ARROW)


def _align(first: str, second: str, digest: bool, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = _aligner(first, second)
        held = _Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.add(doc_id, aligner.align(text.as_py()), digest)
                if held.size >= block or held.bytes >= 8 * block:
                    yield from held.batches()
                    held = _Block(held.number + 1)
        yield from held.batches()

    return run


_RESULT = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups", pa.string())]


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each block as they stream past its pairs' counts, which come first, in order of place."""
    block, counts, best = None, [], []
    total = highest = np.zeros(0, np.int64)
    for whole in batches:
        number, kind = whole.column("block").to_numpy(), whole.column("kind").to_numpy()
        cuts = [0, *(np.flatnonzero((number[1:] != number[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(number)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if low == high:
                continue
            part = whole.slice(low, high - low)
            if number[low] != block:
                block, counts, best = number[low], [], []
                total = highest = np.zeros(0, np.int64)
            if kind[low] == 0:
                counts.append(part.column("n").to_numpy())
                best.append(part.column("best").to_numpy(zero_copy_only=False))
                continue
            if counts:
                total, highest, counts, best = np.concatenate(counts), np.concatenate(best).astype(np.int64), [], []
            width = part.column("place")[0].as_py()
            links = np.frombuffer(b"".join(part.column("links").to_pylist()), f"<u{width}")
            ends = np.concatenate([[0], np.cumsum(part.column("n_links").to_numpy())])
            told = [np.concatenate([[0], np.cumsum(x[links])]) if len(links) else np.zeros(1, np.int64) for x in (highest, total)]
            columns = {"n_best": pa.array(told[0][ends[1:]] - told[0][ends[:-1]]), "count_sum": pa.array(told[1][ends[1:]] - told[1][ends[:-1]])}
            yield pa.RecordBatch.from_arrays([columns.get(n, part.column(n) if n in part.schema.names else None) for n, _ in _RESULT], schema=pa.schema(_RESULT))


def align(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", first: str | None = None, second: str | None = None, digest: bool = False, block: int = BLOCK) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its second id), count_sum (over links, of how many links of the corpus have their pair) and groups (`a1,a2|b1;a3|b2,b3`, or with digest its SHA-256, which saves writing them all)."""
    prepare(docs.sparkSession)
    paths = first or public_tokenizers.path("byte_bpe_50k.json"), second or public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = keep(rows.mapInArrow(_align(*paths, digest, block), _SCHEMA), "aligned")
    pairs = found.filter("kind = 0").select("block", "place", "pair", "n")
    total = keep(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    second_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = keep(total.groupBy(second_id.alias("b")).agg(F.max("n").alias("most")), "highest")
    # a row for each id of the second vocabulary at most
    judged = total.withColumn("b", second_id).join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    counts = pairs.select("block", "place", "pair").join(judged, "pair").select("block", F.lit(0).alias("kind"), "place", "n", "best")
    documents = found.filter("kind = 1").select("block", "kind", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links")
    sent = counts.unionByName(documents, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind", "place")
    told = keep(sent.mapInArrow(_tell, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"), "alignment")
    release(found, total, highest)
    return told


def op11_cross_tokenizer(spark, sf_dir: str) -> DataFrame:
    """Every document's alignment, and how its links stand in the corpus."""
    found = align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")
