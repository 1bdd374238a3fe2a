"""Packing: token pieces of all documents in sequences of one length, with next to no padding.

Method: bounded-space online packing. Each partition keeps a fixed number of open windows. A document is encoded,
whole windows are cut from it, and the rest goes to the open window that it fits best. When it fits none and all
windows are in use, the fullest is closed: the head of the piece fills its gap, and what is left of the piece is
placed anew. The windows still open at the end of a partition are merged in groups of FAN partitions by the same
packer, level by level, until one group is left; its last, partly filled window is cut into sequences whose lengths
are powers of two. A level reads at most FAN * WINDOWS * length ids in one task, whatever the corpus holds.

Encoding uses the vocabulary file's ids. Plain byte-level BPE files run on tiktoken's merge engine, several times
faster than the tokenizers library and equal to it; any other file runs on that library.

Edge cases: a null or empty text is its end id alone; a null doc_id stays null in its pieces; repeated rows are packed
each; special tokens in a text are ordinary text; an empty table gives no pieces; other columns are not carried.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep, prepare

LENGTH, WINDOWS, FAN, END = 1024, 8, 64, 0
_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, part long, open boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("part", pa.int64()), ("open", pa.bool_())])


def encoder(path: str) -> Callable[[str], list[int]]:
    """A function from a text to its ids, without special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = steps.get("type") == "ByteLevel" and not steps.get("add_prefix_space") and steps.get("use_regex", True) and spec.get("normalizer") is None
    plain = plain and model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        return lambda text: own.encode(text, add_special_tokens=False).ids
    import tiktoken

    # byte-level files show a byte as itself where it is printable, and the others from U+0100 on
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}
    special = {x["content"] for x in spec.get("added_tokens", []) if x.get("special")}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Packer:
    """A fixed number of open windows. Rows of closed windows gather in done."""

    def __init__(self, length: int, windows: int, first_id: int):
        self.length, self.windows, self.next_id = length, windows, first_id
        self.open: list[list] = []  # of [fill, pieces]
        self.done: list[tuple] = []

    def close(self, window: list) -> None:
        at = 0
        for doc, start, ids, total in window[1]:
            self.done.append((doc, start, len(ids), total, self.next_id, at, ids.tobytes(), None, False))
            at += len(ids)
        self.next_id += 1

    def add(self, doc: int | None, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.length:
            self.close([self.length, [(doc, start, ids[: self.length], total)]])
            ids, start = ids[self.length :], start + self.length
        while len(ids):
            best = None
            for window in self.open:
                if window[0] + len(ids) <= self.length and (best is None or window[0] > best[0]):
                    best = window
            part = len(ids)
            if best is None and len(self.open) < self.windows:
                best = [0, []]
                self.open.append(best)
            elif best is None:
                best = max(self.open, key=lambda w: w[0])
                part = self.length - best[0]
            best[1].append((doc, start, ids[:part], total))
            best[0] += part
            if best[0] == self.length:
                self.close(best)
                self.open = [w for w in self.open if w is not best]
            ids, start = ids[part:], start + part

    def finish(self) -> None:
        """Close all: full windows while the ids last, then lengths that are powers of two."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        left = sum(len(p[2]) for p in pieces)
        self.open = []
        while left:
            size = self.length if left >= self.length else 1 << (left.bit_length() - 1)
            window, gap = [size, []], size
            while gap:
                doc, start, ids, total = pieces.pop(0)
                window[1].append((doc, start, ids[:gap], total))
                if len(ids) > gap:
                    pieces.insert(0, (doc, start + gap, ids[gap:], total))
                gap -= min(gap, len(ids))
            self.close(window)
            left -= size

    def rows(self, part: int | None = None) -> pa.RecordBatch:
        """Closed rows, and with part the open ones for the next level."""
        rows, self.done = self.done, []
        if part is not None:
            rows += [(doc, start, len(ids), total, i, None, ids.tobytes(), part, True) for i, w in enumerate(self.open) for doc, start, ids, total in w[1]]
        columns = zip(*rows, strict=True) if rows else [[]] * len(_ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _encode(path: str, length: int, windows: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids_of, packer = encoder(path), Packer(length, windows, part << 32)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*ids_of(text.as_py() or ""), end], "<u4")
                packer.add(doc, 0, ids, len(ids))
                if len(packer.done) > 4000:
                    yield packer.rows()
        yield packer.rows(part)

    return run


def _merge(length: int, windows: int, level: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        group = table.column("part")[0].as_py() // FAN
        packer = Packer(length, windows, (level << 58) + (group << 32))
        rows = table.select(["part", "sequence_id", "doc_id", "start", "ids", "doc_tokens"]).sort_by([(c, "ascending") for c in ("part", "sequence_id", "doc_id", "start")])
        for doc, start, ids, total in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
            packer.add(doc, start, np.frombuffer(ids, "<u4"), total)
        if last:
            packer.finish()
        return pa.Table.from_batches([packer.rows(None if last else group)])

    return run


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, length: int = LENGTH, windows: int = WINDOWS, end: int = END) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian unsigned 32-bit)."""
    prepare(docs.sparkSession)
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    level, found = 0, keep(rows.mapInArrow(_encode(path, length, windows, end), _SCHEMA), "packed")
    out = []
    while True:
        out.append(found.filter(~F.col("open")))
        left = found.filter("open")
        parts = left.agg(F.max("part")).first()[0]
        if parts is None:
            break
        level += 1
        merged = left.groupBy((F.col("part") / FAN).cast("long").alias("group")).applyInArrow(_merge(length, windows, level, parts < FAN), _SCHEMA)
        found = keep(merged, "packed")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.drop("part", "open")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 ids."""
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
