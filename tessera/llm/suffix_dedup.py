"""Suffix-array dedup: bytes inside passages that an earlier document has too are removed.

Method: a depth-limited most-significant-digit radix sort. A suffix is ordered only through its first WINDOW bytes;
suffixes that share all of them are exactly the repeated windows. Sorting every suffix of a large corpus would move
each byte fifty times, so two things come before the digit passes:

1. Pruning. Each window is filed under its minimiser, the K-byte gram with the least hash in it. Very frequent grams
   are passed over: the windows at the edges of a common line would else all be filed under the line's own grams,
   whatever stands beside it. Blocks note the grams that they have HEAVY times or more as they are written; those noted
   OFTEN times in all, and in at least one of MOST_PASSED of all places, are passed over in every block alike, so there
   are no more than MOST_PASSED of them, 2 MB. A window of such grams alone, inside a common line, goes by its own
   hash, once for a block, which is 50 bytes for each 64 or more that the block has. Equal windows have
   equal minimisers, so a window whose minimiser occurs in one document only has no partner and is never sorted.
   Minimisers travel as sorted five-byte hashes, about one for fifteen bytes of text.
2. Runs. Neighbouring windows with one minimiser travel as one run of bytes, once per block of documents however
   many copies the block holds, with the least doc_id that has it. A minimiser that is rare in each block, but found
   about HOT times or more over very many of them (counted in four steps by block), would bring all its runs to one
   bucket; its windows travel one by one instead, each to the bucket of its own hash.

Then each bucket of runs is sorted by four-byte digits from the most significant on; groups of one drop out after
every pass. A block learns, for each window of its runs, the least doc_id over the whole corpus.

Blocks are written before anything is told about them, so a repeated task meets the same blocks. Nothing is gathered
per document group. What a block has of a bucket comes once however often it has it, so a passage that a third of all
documents share costs one run, or one window for each byte of it, for each block of BLOCK bytes. The edges of a common
line cost no more than other text: each context is filed under grams of its own.

Edge cases: a null text counts as empty and stays so; a null doc_id counts as larger than every other, so such a
document loses what a numbered one has and takes nothing from anyone; rows that share a doc_id take nothing from each
other; texts under WINDOW bytes are kept whole; an empty table gives an empty result; all other columns pass through,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fresh, keep, prepare
from tessera.llm.kernels import U64, Spans, byte_keys, gram_hashes, mix, text_bytes

WINDOW, GRAM = 50, 20
#: Grams in a window.
SLIDE = WINDOW - GRAM + 1
#: Bytes of text in a block; positions worked on at once; text for each bucket of hashes and runs.
BLOCK, STRIDE, BUCKET = 4 << 20, 1 << 17, 4 << 20
#: A minimiser found so often has its windows spread by their own hashes. The steps of counting, and what they count as.
HOT, STEPS, WEIGHTS = 1 << 16, np.array([1, 16, 256]), np.array([1, 4, 64, 2048])
#: Grams noted so often in a block, and so often in all blocks that note them, are passed over; the most that are.
HEAVY, OFTEN, MOST_PASSED = 64, 1 << 13, 1 << 18
LAST = np.iinfo(np.int64).max
#: A gram travels as 40 bits of its hash; the lowest three are flags.
_LOW, _FLAGS = U64((1 << 40) - 1), U64(7)
_PLACE = U64((1 << 24) - 1)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", whole_characters: bool = False, hot: int = HOT, heavy: int = HEAVY, often: int = OFTEN) -> DataFrame:
    """All columns of docs, then kept (binary: the bytes that stay) and removed (array of start and end of each run taken out).

    With whole_characters, a character stays unless all its bytes are to go, so that kept is valid UTF-8.
    """
    prepare(docs.sparkSession)
    kept, removed = fresh(docs, "kept", "removed")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    buckets = max(1, -(-size // BUCKET))
    columns = docs.columns
    at_text, at_id = columns.index(text), columns.index(doc_id)
    types = [f.dataType for f in docs.schema.fields]
    renamed = docs.toDF(*[f"c{i}" for i in range(len(columns))])

    written = keep(renamed.mapInArrow(_blocks(at_text, heavy), "block long, payload binary, places long, heavy binary"), "blocks")
    blocks = written.select("block", "payload")
    passed = common_grams(written, often)
    hashes = blocks.mapInArrow(_hashes(at_text, at_id, buckets, passed), "bucket long, block long, payload binary")
    shared = hashes.groupBy("bucket").applyInArrow(_shared(hot), "block long, payload binary")
    # a block's state travels with its runs, as a bucket of its own, and comes back with the answers
    runs = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_runs(at_text, at_id, buckets, passed), "bucket long, block long, payload binary")
    least = runs.groupBy("bucket").applyInArrow(_radix, "block long, kind int, payload binary")
    schema = T.StructType([*[T.StructField(f"c{i}", t) for i, t in enumerate(types)], T.StructField("kept", T.BinaryType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    out = blocks.groupBy("block").cogroup(least.groupBy("block")).applyInArrow(_cut(at_text, at_id, whole_characters), schema)
    return out.toDF(*columns, kept, removed)


def common_grams(blocks: DataFrame, often: int = OFTEN) -> np.ndarray:
    """Hashes of the grams that are passed over, sorted."""
    places = blocks.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0]
    noted = blocks.select("heavy").filter("heavy is not null").mapInArrow(_noted, "gram long, n long")
    # what so many of all places are, there are MOST_PASSED of at most
    least = max(often, -(-places // MOST_PASSED))
    found = noted.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("gram").collect()
    return np.sort(np.array([r["gram"] for r in found], np.int64).view(U64))


def _noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["gram", "n"])


def _grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of all grams, stride by stride."""
    keys = byte_keys(11)
    for at in range(0, len(data) - GRAM + 1, STRIDE):
        stop = min(len(data), at + STRIDE + GRAM - 1)
        yield gram_hashes(keys[data[at:stop]], GRAM)[: stop - at - GRAM + 1]


def _places(table: pa.Table, at_text: int, heavy: int = HEAVY) -> tuple[int, bytes | None]:
    """How many bytes a block has, and which grams, how often, it notes."""
    data, _ = text_bytes(table.column(at_text))
    # counts by the first bits first, so that few grams are sorted
    cells = np.zeros(1 << 20, np.int64)
    for gram in _grams(data):
        cells += np.bincount((gram >> U64(44)).astype(np.int64), minlength=len(cells))
    full = cells >= heavy
    if not full.any():
        return len(data), None
    gram, count = np.unique(np.concatenate([g[full[(g >> U64(44)).astype(np.int64)]] for g in _grams(data)]), return_counts=True)
    many = count >= heavy
    return len(data), np.stack([gram[many].view(np.int64), count[many]], 1).astype("<i8").tobytes() if many.any() else None


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def _blocks(at_text: int, heavy: int = HEAVY):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, held, size, n = TaskContext.get().partitionId() << 24, [], 0, 0

        def row():
            table = pa.Table.from_batches(held)
            places, noted = _places(table, at_text, heavy)
            return pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), pa.array([_pack(table)], pa.binary()), pa.array([places], pa.int64()), pa.array([noted], pa.binary())], names=["block", "payload", "places", "heavy"])

        for batch in batches:
            _, offsets = text_bytes(batch.column(at_text))
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BLOCK - size, "right")) - 1)
                end = min(end, batch.num_rows)
                held.append(batch.slice(start, end - start))
                size += int(offsets[end] - offsets[start])
                if size >= BLOCK * 3 // 4:
                    yield row()
                    held, size, n = [], 0, n + 1
                start = end
        if held:
            yield row()

    return make


def _ids(table: pa.Table, at_id: int) -> np.ndarray:
    column = table.column(at_id).combine_chunks()
    return column.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours from i on."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    if done < width:
        x = np.minimum(x[: len(x) - (width - done)], x[width - done :])
    return x


def _among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which hashes are among some sorted ones; few are looked up, as a table of their first bits has most of the others."""
    first = np.zeros(1 << 16, bool)
    first[some >> U64(48)] = True
    out = first[x >> U64(48)]
    at = np.flatnonzero(out)
    out[at] = some[np.minimum(np.searchsorted(some, x[at]), len(some) - 1)] == x[at]
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, passed: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For strides of the bytes: window starts, the place of each one's minimiser, and that gram's hash; one of the passed grams where a window has no other."""
    keys = byte_keys(11)
    n = len(data)
    ends = np.zeros(n + 1, np.int32)
    np.add.at(ends, offsets[1:], 1)
    for at in range(0, n, STRIDE):
        stop = min(n, at + STRIDE + WINDOW - 1)
        if stop - at < WINDOW:
            break
        piece = gram_hashes(keys[data[at:stop]], GRAM)[: stop - at - GRAM + 1]
        order = (piece & ~_PLACE) | np.arange(len(piece), dtype=U64)
        if passed is not None and len(passed):
            order[_among(piece, passed)] |= ~_PLACE
        least = (_sliding_min(order, SLIDE) & _PLACE).astype(np.int64)
        crossed = np.cumsum(ends[at : stop + 1])
        whole = crossed[WINDOW - 1 : WINDOW - 1 + len(least)] == crossed[: len(least)]
        start = np.flatnonzero(whole)
        least = least[start]
        yield start + at, least + at, piece[least]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> U64(32)) % U64(buckets)).astype(np.int64)


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(payload: bytes) -> np.ndarray:
    out = np.zeros((len(payload) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(payload, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _low(hashes: np.ndarray) -> np.ndarray:
    """The bits of a hash that travel, without the flags."""
    return hashes & _LOW & ~_FLAGS


def _batch(names: tuple[str, ...], columns: list[list], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


_OUT = (("bucket", "block", "payload"), [pa.int64(), pa.int64(), pa.binary()])
_REPLY = (("block", "payload"), [pa.int64(), pa.binary()])
#: Kinds of what comes back to a block: answers to its runs, and its state.
_BACK, ANSWER, STATE = (("block", "kind", "payload"), [pa.int64(), pa.int32(), pa.binary()]), 2, 3


def _hashes(at_text: int, at_id: int, buckets: int, passed: np.ndarray | None = None):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = _unpack(payload.as_py())
                ids = _ids(table, at_id)
                data, offsets = text_bytes(table.column(at_text))
                found, owners = [], []
                for _, place, gram in anchors(data, offsets, passed):
                    first = np.ones(len(place), bool)
                    first[1:] = place[1:] != place[:-1]
                    if passed is not None and len(passed):
                        first &= ~_among(gram, passed)
                    found.append(gram[first])
                    owners.append(ids[np.searchsorted(offsets, place[first], "right") - 1])
                if not found:
                    continue
                gram, owner = np.concatenate(found), np.concatenate(owners)
                order = np.argsort(gram)
                gram, owner = gram[order], owner[order]
                new = np.ones(len(gram), bool)
                new[1:] = gram[1:] != gram[:-1]
                head = np.flatnonzero(new)
                if not len(head):
                    continue
                several = np.minimum.reduceat(owner, head) != np.maximum.reduceat(owner, head)
                step = np.searchsorted(STEPS, np.diff(np.append(head, len(gram))))
                gram = gram[head]
                place = _bucket(gram, buckets)
                packed = _low(gram) | several.astype(U64) | step.astype(U64) << U64(1)
                order = np.argsort(place, kind="stable")
                place, packed = place[order], packed[order]
                cuts = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
                yield _batch(_OUT[0], [[int(place[a]) for a in cuts[:-1]], [block] * (len(cuts) - 1), [_five(packed[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]], _OUT[1])

    return make


def _shared(hot: int):
    def run(table: pa.Table) -> pa.Table:
        """One bucket: tell each block which of its grams another document has, and which of these are hot."""
        blocks = table.column("block").to_numpy()
        order = np.argsort(blocks, kind="stable")
        payloads = table.column("payload")
        packed = [payloads[int(i)].as_py() for i in order]
        every = _from_five(b"".join(packed))
        gram, flags = every & ~_FLAGS, every & _FLAGS
        by = np.argsort(gram)
        ranked = gram[by]
        new = np.ones(len(by), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(by)))
        known, often = np.zeros(len(by), bool), np.zeros(len(by), U64)
        if len(by):
            ranked = flags[by]
            known[by] = np.repeat((size > 1) | np.logical_or.reduceat((ranked & U64(1)).astype(bool), head), size)
            often[by] = np.repeat(np.add.reduceat(WEIGHTS[(ranked >> U64(1)).astype(np.int64)], head) >= hot, size)
        out: list[list] = [[], []]
        ends = np.cumsum([0, *(len(p) // 5 for p in packed)])
        name = table.column("bucket")[0].as_py().to_bytes(8, "little")
        for i, a, b in zip(order, ends[:-1], ends[1:], strict=True):
            mine = (gram[a:b] | often[a:b])[known[a:b]]
            if len(mine):
                for column, value in zip(out, (int(blocks[i]), name + _five(mine)), strict=True):
                    column.append(value)
        return pa.Table.from_batches([_batch(_REPLY[0], out, _REPLY[1])])

    return run


def _alike(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of equal spans, and the set of each span, numbered as they first appear; both hashes must agree.

    Should one hash collide, equal spans may come out as several sets, which the digit passes bring together again.
    """
    if not len(one):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(one)
    one, two = one[order], two[order]
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    first = np.minimum.reduceat(order, np.flatnonzero(new))
    by = np.argsort(first)
    name = np.empty(len(by), np.int64)
    name[by] = np.arange(len(by))
    index = np.empty(len(order), np.int64)
    index[order] = name[np.cumsum(new) - 1]
    return first[by], index


class _Repeats:
    """The runs of a block's windows whose minimiser another document has; equal runs have one index."""

    def __init__(self, table: pa.Table, at_text: int, at_id: int):
        self.ids = _ids(table, at_id)
        self.data, self.offsets = text_bytes(table.column(at_text))

    def find(self, replies: list[bytes], buckets: int, passed: np.ndarray | None = None):
        """From the grams that other documents have; windows of passed grams alone are all taken."""
        known = np.sort(np.concatenate([np.zeros(0, U64), *(_from_five(p[8:]) | U64(int.from_bytes(p[:8], "little")) << U64(40) for p in replies)]))
        hot = (known & U64(1)).astype(bool)
        known &= ~_FLAGS
        starts, places, grams, often = [], [], [], []
        for start, place, gram in anchors(self.data, self.offsets, passed):
            first = np.ones(len(place), bool)
            first[1:] = place[1:] != place[:-1]
            head = np.flatnonzero(first)
            key = _low(gram[head]) | _bucket(gram[head], buckets).astype(U64) << U64(40)
            size = np.diff(np.append(head, len(place)))
            alone = _among(gram[head], passed) if passed is not None and len(passed) else np.zeros(len(head), bool)
            hit = alone.copy()
            if len(known):
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                here = (known[at] == key) & ~alone
                alone[here] = hot[at[here]]
                hit |= here
            take = np.repeat(hit, size)
            starts.append(start[take])
            places.append(place[take])
            grams.append(gram[take])
            often.append(np.repeat(alone[hit], size[hit]))
        none = np.zeros(0, np.int64)
        start, place, gram, alone = (np.concatenate(x) if x else none.astype(k) for x, k in ((starts, np.int64), (places, np.int64), (grams, U64), (often, bool)))
        new = np.ones(len(start), bool)
        new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1) | alone[1:]
        head = np.flatnonzero(new)
        self.start = start[head]
        self.count = np.diff(np.append(head, len(start)))
        gram, alone = gram[head], alone[head]
        self.bucket = _bucket(gram, buckets)
        one = Spans(self.data, 23).hash(self.start, self.start + self.count + WINDOW - 1) if len(head) else gram
        self.bucket[alone] = _bucket(one[alone], buckets)
        # the second hash: the gram, its place in the run, and the run's length
        self.first, self.index = _alike(one, mix(gram + ((place[head] - self.start) * WINDOW + self.count).astype(U64)))
        self._own()
        return self

    def _own(self) -> None:
        self.row = np.searchsorted(self.offsets, self.start, "right") - 1
        self.least = np.full(len(self.first), LAST)
        np.minimum.at(self.least, self.index, self.ids[self.row])

    def state(self) -> bytes:
        """Where the runs are and which are equal; gaps instead of places, as most are 0."""
        gap = self.start - np.concatenate([[0], (self.start + self.count)[:-1]])
        return _pack(pa.table({"gap": pa.array(gap.astype(np.int32)), "count": pa.array(self.count.astype(np.uint8)), "index": pa.array(np.diff(self.index, prepend=-1).astype(np.int32))}))

    def restore(self, state: bytes | None) -> _Repeats:
        none = np.zeros(0, np.int64)
        gap, count, step = (c.to_numpy().astype(np.int64) for c in _unpack(state).columns) if state else (none, none, none)
        self.count = count
        self.start = np.cumsum(gap + np.concatenate([[0], count[:-1]])) if len(gap) else none
        self.index = np.cumsum(step) - 1 if len(step) else none
        # sets are numbered as they first appear
        self.first = np.flatnonzero(np.diff(np.maximum.accumulate(self.index), prepend=-1) > 0) if len(step) else none
        self._own()
        return self


def _runs(at_text: int, at_id: int, buckets: int, passed: np.ndarray | None = None):
    def make(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and (right.num_rows or passed is not None and len(passed)):
            block = left.column("block")[0].as_py()
            r = _Repeats(_unpack(left.column("payload")[0].as_py()), at_text, at_id).find(right.column("payload").to_pylist(), buckets, passed)
            bucket = r.bucket[r.first]
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)) if len(order) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                mine = order[a:b]
                at, size = r.start[r.first[mine]], r.count[r.first[mine]] + WINDOW - 1
                text, ends = _take(r.data, at, size)
                table = pa.table({"run": pa.array(mine.astype(np.int32)), "least": pa.array(r.least[mine]), "size": pa.array(size.astype(np.int32))})
                packed = _pack(table)
                body = pa.compress(text.tobytes(), codec="zstd", asbytes=True)
                for column, value in zip(out, (int(bucket[mine[0]]), block, len(packed).to_bytes(8, "little") + int(ends[-1]).to_bytes(8, "little") + packed + body), strict=True):
                    column.append(value)
            for column, value in zip(out, (-1 - block, block, r.state()), strict=True):
                column.append(value)
        return pa.Table.from_batches([_batch(_OUT[0], out, _OUT[1])])

    return make


def _take(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some spans one after another, and where each ends, from 0 on."""
    ends = np.concatenate([[0], np.cumsum(size)])
    where = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
    return data[where], ends


def digit_groups(text: np.ndarray, start: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Most-significant-digit radix sort of suffixes through depth bytes: a group for each suffix, -1 for one that stands alone.

    Four bytes are a digit. After each pass a suffix that no other shares its prefix with drops out.
    """
    padded = np.concatenate([text, np.zeros(4, np.uint8)])
    four = np.zeros(len(text) + 1, np.uint32)
    for i in range(4):
        four |= padded[i : len(padded) - 3 + i].astype(np.uint32) << np.uint32(24 - 8 * i)
    alive, group = np.arange(len(start)), np.zeros(len(start), U64)
    for at in [*range(0, depth - 3, 4), *([depth - 4] if depth % 4 else [])]:
        key = group << U64(32) | four[start[alive] + at]
        order = np.argsort(key)
        ranked = key[order]
        new = np.ones(len(key), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        several = ~new
        several[:-1] |= ~new[1:]
        group = np.cumsum(new).astype(U64)[several]
        alive = alive[order[several]]
        if not len(alive):
            break
    out = np.full(len(start), -1)
    out[alive] = group.astype(np.int64)
    return out


def _radix(table: pa.Table) -> pa.Table:
    """One bucket of runs: the least doc_id of each window, to the blocks that would not know it. A state goes on as it is."""
    if table.column("bucket")[0].as_py() < 0:
        return pa.table({"block": table.column("block"), "kind": pa.array([STATE] * table.num_rows, pa.int32()), "payload": table.column("payload")})
    blocks, parts, texts, at = [], [], [], 0
    for block, payload in sorted(zip(table.column("block").to_pylist(), table.column("payload").to_pylist(), strict=True)):
        head, size = int.from_bytes(payload[:8], "little"), int.from_bytes(payload[8:16], "little")
        parts.append(_unpack(payload[16 : 16 + head]))
        texts.append(np.frombuffer(pa.decompress(payload[16 + head :], decompressed_size=size, codec="zstd", asbytes=True), np.uint8))
        blocks += [block] * parts[-1].num_rows
    out: list[list] = [[], [], []]
    if parts:
        text = np.concatenate(texts)
        block = np.array(blocks)
        run, least, size = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("run", "least", "size"))
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        first, same = _alike(*(Spans(text, seed).hash(at, at + size) for seed in (23, 37)))
        low = np.full(len(first), LAST)
        np.minimum.at(low, same, least)
        count = (size[first] - WINDOW + 1).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(count)])
        start = np.arange(begin[-1]) + np.repeat(at[first] - begin[:-1], count)
        best = np.repeat(low, count)
        group = digit_groups(text, start)
        together = np.flatnonzero(group >= 0)
        if len(together):
            lowest = np.full(group.max() + 1, LAST)
            np.minimum.at(lowest, group[together], best[together])
            best[together] = lowest[group[together]]
        # neighbouring windows with one least id make one piece of an answer
        new = np.zeros(len(best), bool)
        new[begin[:-1]] = True
        new[1:] |= best[1:] != best[:-1]
        piece = np.flatnonzero(new)
        owner = np.searchsorted(begin, piece, "right") - 1
        from_, to, value = piece - begin[owner], np.append(piece[1:], len(best)) - begin[owner], best[piece]
        pieces = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(first)))])
        many = (pieces[1:] - pieces[:-1])[same]
        which = np.arange(many.sum()) + np.repeat(pieces[same] - np.concatenate([[0], np.cumsum(many)])[:-1], many)
        source = np.repeat(np.arange(len(same)), many)
        tell = value[which] < least[source]
        which, source = which[tell], source[tell]
        cuts = np.flatnonzero(np.diff(block[source], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            w, s = which[a:b], source[a:b]
            answer = pa.table({"run": run[s].astype(np.int32), "from": from_[w].astype(np.int32), "to": to[w].astype(np.int32), "least": value[w]})
            for column, x in zip(out, (int(block[s[0]]), ANSWER, _pack(answer)), strict=True):
                column.append(x)
    return pa.Table.from_batches([_batch(_BACK[0], out, _BACK[1])])


def _cut(at_text: int, at_id: int, whole_characters: bool):
    def make(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _unpack(left.column("payload")[0].as_py())
        replies = list(zip(right.column("kind").to_pylist(), right.column("payload"), strict=True))
        r = _Repeats(rows, at_text, at_id).restore(next((p.as_py() for k, p in replies if k == STATE), None))
        count = r.count[r.first] if len(r.first) else np.zeros(0, np.int64)
        begin = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        least = np.repeat(r.least, count)
        for answer in (_unpack(p.as_py()) for k, p in replies if k == ANSWER):
            run, a, b, value = (answer.column(c).to_numpy() for c in ("run", "from", "to", "least"))
            n = (b - a).astype(np.int64)
            where = np.arange(n.sum()) + np.repeat(begin[run] + a - np.concatenate([[0], np.cumsum(n)])[:-1], n)
            np.minimum.at(least, where, np.repeat(value, n))
        # every run of the block, window by window
        ends = np.concatenate([[0], np.cumsum(r.count)]).astype(np.int64)
        inside = np.arange(ends[-1]) - np.repeat(ends[:-1], r.count)
        earlier = least[np.repeat(begin[r.index], r.count) + inside] < np.repeat(r.ids[r.row], r.count) if len(inside) else np.zeros(0, bool)
        start = (np.repeat(r.start, r.count) + inside)[earlier]
        opened = np.zeros(len(r.data), bool)
        opened[start] = True
        depth = np.cumsum(opened, dtype=np.int32)
        depth[WINDOW:] -= depth[:-WINDOW].copy()
        gone = depth > 0
        if whole_characters and len(gone):
            character = np.cumsum((r.data & 0xC0) != 0x80) - 1
            stays = np.zeros(character[-1] + 1, bool)
            stays[character[~gone]] = True
            gone = ~stays[character]
        # maximal runs, cut at the ends of documents
        edge = np.zeros(len(gone) + 1, bool)
        edge[r.offsets] = True
        opens = gone.copy()
        opens[1:] &= ~gone[:-1] | edge[1:-1]
        closes = gone.copy()
        closes[:-1] &= ~gone[1:] | edge[1:-1]
        first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        row = np.searchsorted(r.offsets, first, "right") - 1
        per = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(r.ids)))])
        stay = ~gone
        kept_at = np.concatenate([[0], np.cumsum(stay)])[r.offsets] if len(stay) else np.zeros(len(r.offsets), np.int64)
        text = r.data[stay]
        kept = pa.Array.from_buffers(pa.binary(), len(r.ids), [None, pa.py_buffer(kept_at.astype(np.int32).tobytes()), pa.py_buffer(text.tobytes())])
        spans = pa.StructArray.from_arrays([pa.array(first - r.offsets[row], pa.int64()), pa.array(last - r.offsets[row], pa.int64())], names=["start", "end"])
        removed = pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), spans)
        return pa.table([*rows.columns, kept, removed], names=[*rows.column_names, "kept", "removed"])

    return make


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What stays of every document once the bytes of repeated passages are gone."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    kept = F.col("kept")
    return out.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )
