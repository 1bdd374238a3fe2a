"""Byte-level BPE encoding and decoding, the merges folded by Spark's higher-order functions.

Method: every match of the pattern is a word, encoded by itself. Documents are taken in chunks of about CHUNK bytes,
and cut before single spaces, where a match always begins, so that the pattern runs over distinct parts only;
a chunk carries its distinct words as arrays of their bytes (as ids) and its documents as places in that list. A fold over each distinct
word merges the adjacent pair of least rank (the leftmost, if several have it), one merge a step, until no pair is in
the rank map. The rank map is one literal of the plan (an array of small maps by hash, as Spark searches a map entry
by entry). Chunks are then put together again from the words' ids.
Decoding joins the ids' byte pieces.

A fold takes the square of its word's length, so a word of over LONG bytes is folded in pieces of LONG bytes, which
overlap by half or more. Two neighbouring ids of an encoding stay neighbours in the encoding of any longer text if and
only if they are the encoding of their own bytes together, and ids of which all neighbours are such pairs are the
encoding of the whole. So where two pieces have one id at one place, the ids of the first up to it and those of the
second behind it are the word's. A piece that would begin in a run of one character begins before the run, or in a
long one at a multiple of the lengths that its merges have, so that pieces meet. Should two have no id in common, as may
be in runs longer than a piece, the word is merged in the assembling worker, by a heap; the time of both ways is nearly
linear in the word's length.

So that a frequent word is not folded in every chunk, the CACHE_WORDS most frequent words of CACHE_ROWS documents are
folded once and sent to all workers (both bounds are parameters). They change the time that it takes, never a result:
any other word is folded in its chunk. No document is shuffled.

Edge cases: a null or empty text has no ids and decodes to nothing; a null doc_id stays null; repeated rows are
encoded each; special tokens in a text are ordinary text; an empty table gives an empty result; a text longer than a
chunk makes a chunk of its own.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import batched

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare
from tessera.llm.kernels import text_bytes
from tessera.llm.quality import slices

CHUNK, CACHE_ROWS, CACHE_WORDS = 24 << 20, 24_000, 800_000
#: Maps in the rank literal (a prime), the bound of ids, and the unit of ranks in a part's entry: ids and places lie below it.
MAPS, IDS, RANK = 65_521, 1 << 17, 1 << 45
_CHUNK_SCHEMA = "rows binary, places binary, counts binary, cuts binary, words array<array<bigint>>"
_CHUNK_ARROW = pa.schema([("rows", pa.binary()), ("places", pa.binary()), ("counts", pa.binary()), ("cuts", pa.binary()), ("words", pa.list_(pa.list_(pa.int64())))])
#: New words in one row; bytes of a piece of a long word, and from one piece to the next.
PART, LONG, STRIDE = 4096, 384, 192


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as one literal: array<map<string, int>>, with the rank of every two tokens that join to a third.

    The key of ids a and b is a * IDS + b, and its map that at its remainder by MAPS. It is written as JSON of a fixed
    size, which the optimizer folds to a value before anything runs.
    """
    maps: list[dict[str, int]] = [{} for _ in range(MAPS)]
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                key = left * IDS + right
                maps[key % MAPS][str(key)] = rank
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,int>>")


def encode_words(words: Column, ranks: dict[bytes, int]) -> Column:
    """array<array<int>>: the ids of each word, from its bytes' entries (array<array<bigint>>, see byte_entries)."""
    return _let(rank_literal(ranks), lambda r: F.transform(words, lambda w: encode_word(w, r)))


def encode_word(word: Column, ranks: Column) -> Column:
    """array<int>: the ids of one word.

    The fold's state is an array of long, an entry for each part, at first for each byte: the rank of the merge with
    the next part (IDS if there is none), the part's place and its id, from high bits to low. Its least entry is the
    leftmost pair of least rank, and that rank is the merged part's id.
    """
    low, size = F.lit(RANK - 1), F.size(word)
    ident = lambda entry: entry.bitwiseAND(F.lit(IDS - 1))

    def rank(a: Column, b: Column) -> Column:
        key = a * IDS + b
        return F.coalesce(F.get(ranks, (key % MAPS).cast("int"))[key.cast("string")], F.lit(IDS)).cast("long") * RANK

    def merge(parts: Column, best: Column) -> Column:
        """best: the least entry; its part and the next become one, whose id is the rank."""
        merged = F.shiftright(best, RANK.bit_length() - 1)

        def at(j: Column) -> Column:
            # j counts from 1, get() from 0
            left, after = F.get(parts, j - 2), F.get(parts, j + 1)
            before = F.when(j > 1, F.array(rank(ident(left), merged) + left.bitwiseAND(low))).otherwise(F.array().cast("array<long>"))
            own = F.when(after.isNotNull(), rank(merged, ident(after))).otherwise(F.lit(IDS * RANK)) + best.bitwiseAND(low) - ident(best) + merged
            return F.concat(F.slice(parts, 1, F.greatest(j - 2, F.lit(0))), before, F.array(own), F.slice(parts, j + 2, size))

        return _let(F.array_position(parts, best).cast("int"), at)

    def step(parts: Column, _: Column) -> Column:
        return _let(F.array_min(parts), lambda best: F.when(best < IDS * RANK, merge(parts, best)).otherwise(parts))

    parts = F.reduce(F.slice(word, 2, size), word, step)
    return F.transform(parts, lambda entry: ident(entry).cast("int"))


def pair_ranks(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The id of each byte, and the rank of every two bytes (IDS if there is none)."""
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    double = np.array([[ranks.get(bytes([a, b]), IDS) for b in range(256)] for a in range(256)], np.int64)
    return single, double


def byte_entries(words: pa.Array, tables: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """list<int64>: each word as the fold's first state, an entry for each byte."""
    single, double = tables
    data, offsets = text_bytes(words)
    size = np.diff(offsets)
    rank = np.full(len(data), IDS)
    rank[:-1] = double[data[:-1], data[1:]]
    rank[offsets[1:][size > 0] - 1] = IDS
    place = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(rank * RANK + place * IDS + single[data]))


def piece_starts(word: bytes) -> list[int]:
    """Where the pieces of a long word begin; each has LONG bytes, or what is left."""
    data, out = np.frombuffer(word, np.uint8), [0]
    runs = []
    for period, unit in ((1, 64), (2, 64), (3, 96), (4, 128)):
        breaks = np.zeros(len(data), np.int64)
        breaks[period:] = np.where(data[period:] != data[:-period], np.arange(period, len(data)), 0)
        runs.append((unit, np.maximum.accumulate(breaks) - period + 1))
    while out[-1] + LONG < len(word):
        at = out[-1] + STRIDE
        for unit, since in runs:
            begin = max(0, int(since[at]))
            # before the run, as what stands there decides how it falls into parts; else whole parts into it
            aligned = begin - 8 if begin - 8 > out[-1] else begin + (at - begin) // unit * unit
            if at - begin >= unit // 2 and aligned > out[-1]:
                at = aligned
                break
        out.append(at)
    return out


def join_pieces(starts: list[int], pieces: list[np.ndarray], sizes: np.ndarray) -> np.ndarray | None:
    """A word's ids from those of its pieces (sizes: each id's bytes); None if two pieces have no id in common."""
    ids = pieces[0].astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes[ids])])[:-1]
    held = []
    for start, piece in zip(starts[1:], pieces[1:], strict=True):
        piece = piece.astype(np.int64)
        there = start + np.concatenate([[0], np.cumsum(sizes[piece])])[:-1]
        key = lambda at, of: at << 32 | of
        _, a, b = np.intersect1d(key(begins, ids), key(there, piece), assume_unique=True, return_indices=True)
        if not len(a):
            return None
        pick = len(a) // 2
        held.append(ids[: a[pick] + 1])
        ids, begins = piece[b[pick] + 1 :], there[b[pick] + 1 :]
    return np.concatenate([*held, ids])


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word by a heap of pairs, lowest rank and then leftmost first."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if end[i] else n
        if j >= n or not end[i] or end[j] != stop:
            continue
        end[i], after[i], end[j] = stop, after[j], 0
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (rank := ranks.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (rank, a, end[b]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


def _let(value: Column, body) -> Column:
    """body of value, with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _split(column: pa.Array, pattern) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts as one array, and how many each text has."""
    found, held, counts = [], [], np.zeros(len(column), np.int64)
    for i, text in enumerate(column.to_pylist()):
        words = pattern.findall(text or "")
        counts[i] = len(words)
        held += words
        if len(held) > 100_000:
            found.append(pa.array(held, pa.string()))
            held = []
    found.append(pa.array(held, pa.string()))
    return pa.concat_arrays(found).cast(pa.binary()), counts


#: Where cutting before each single space parts no match: not if white space (Unicode's) stands beside a space, or a text begins or ends with one.
_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_UNCUT = rf"[{_WHITE}] | [{_WHITE}]|^ | $|\x00"


#: Parts that are one match, and two (the last character by itself), with the usual pattern: letters of Latin-1 alone, and before a stop.
_ONE = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_TWO = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]$"


def _matches(parts: pa.Array, compiled, usual: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Matches of the pattern in some parts, their order, and how many each part has; the pattern itself runs where _ONE and _TWO don't settle a part."""
    one = pc.match_substring_regex(parts, _ONE).to_numpy(zero_copy_only=False) if usual else np.zeros(len(parts), bool)
    two = pc.match_substring_regex(parts, _TWO).to_numpy(zero_copy_only=False) if usual else one
    rest = ~(one | two)
    found, n = _split(parts.filter(pa.array(rest)), compiled)
    double = parts.filter(pa.array(two))
    pieces = [parts.filter(pa.array(one)), pc.utf8_slice_codeunits(double, 0, -1), pc.utf8_slice_codeunits(double, -1)]
    counts = one + 2 * two.astype(np.int64)
    counts[rest] = n
    at, order, low = np.cumsum(counts) - counts, np.empty(counts.sum(), np.int64), 0
    for where in (at[one], at[two], at[two] + 1, _ranges(at[rest], n)):
        order[where] = low + np.arange(len(where))
        low += len(where)
    return pa.concat_arrays([*(p.cast(pa.binary()) for p in pieces), found]), order, counts


def _parts(column: pa.Array, cut: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Parts of texts that hold whole matches: the distinct ones, the places of all in turn, and how many each text has.

    With the usual pattern (cut), a single space between other characters always opens a match, so a text is cut before
    each; where that can't be told, and with other patterns, a text is one part.
    """
    column = pc.fill_null(column.cast(pa.string()), "")
    whole = pc.match_substring_regex(column, _UNCUT).to_numpy(zero_copy_only=False) if cut else np.ones(len(column), bool)
    lists = pc.split_pattern(pc.replace_substring(column.filter(pa.array(~whole)), " ", "\0 "), "\0")
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    count, start = np.ones(len(column), np.int64), np.zeros(len(column), np.int64)
    count[~whole], start[~whole] = size, np.cumsum(size) - size
    start[whole] = size.sum() + np.arange(whole.sum())
    coded = pa.concat_arrays([lists.flatten(), column.filter(pa.array(whole))]).cast(pa.binary()).dictionary_encode()
    return coded, _ranges(start, count), count


def _chunks(pattern: str, known: pa.Array, size: int, tables: tuple[np.ndarray, np.ndarray]):
    """Chunks: rows of PART words that are not cached, then one with the other columns' rows, each part's words (by place;
    below zero: in the cache), and each document's parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled, cut = regex.compile(pattern), pattern == public_tokenizers.PATTERN
        rest, parts, order, counts, held = [], [], [], [], 0

        def chunk() -> Iterator[pa.RecordBatch]:
            coded = pa.chunked_array(parts, pa.dictionary(pa.int32(), pa.binary())).unify_dictionaries()
            every = [np.append(c.indices.to_numpy(), 0)[np.minimum(at, len(c))] for c, at in zip(coded.chunks, order, strict=True)]
            found, turn, size_ = _matches(coded.chunk(0).dictionary.cast(pa.string()), compiled, cut)
            found = found.dictionary_encode()
            cached = pc.index_in(found.dictionary, value_set=known)
            new = cached.is_null().to_numpy(zero_copy_only=False)
            words = found.dictionary.filter(pa.array(new))
            far = pc.greater(pc.binary_length(words), LONG).to_numpy(zero_copy_only=False)
            slot, cuts = np.arange(len(words)), None
            if far.any():
                # short words first, then the pieces of long ones
                longer = [w.as_py() for w in words.filter(pa.array(far))]
                starts = [piece_starts(w) for w in longer]
                slot = np.where(far, (~far).sum() + np.cumsum(far), np.cumsum(~far)) - 1
                words = pa.concat_arrays([words.filter(pa.array(~far)), pa.array([w[a : a + LONG] for w, s in zip(longer, starts, strict=True) for a in s], pa.binary())])
                cuts = _squeezed(np.array([(~far).sum(), len(longer), *map(len, starts), *(a for s in starts for a in s)], np.int64))
            # below zero: the place in the cache; else that among the new words
            place = -1 - cached.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            place[new] = slot
            places = place[found.indices.to_numpy()[turn]].astype(np.int32) if len(found) else np.zeros(0, np.int32)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest[0].schema) as out:
                for batch in rest:
                    out.write_batch(batch)
            for at in range(0, len(words), PART):
                part = byte_entries(words.slice(at, PART), tables)
                yield _row(None, None, None, None, part)
            body = b"".join(len(x).to_bytes(8, "little") + x for x in map(_squeezed, (places, size_.astype(np.int32), np.concatenate(every).astype(np.int32))))
            yield _row(sink.getvalue().to_pybytes(), body, _squeezed(np.concatenate(counts)), cuts, part[:0] if len(words) else byte_entries(words, tables))

        for whole in batches:
            for batch in slices(whole, whole.num_columns - 1, 4 << 20):
                column = batch.column(batch.num_columns - 1)
                coded, at, n = _parts(column, cut)
                parts.append(coded)
                order.append(at)
                counts.append(n)
                rest.append(batch.select(batch.schema.names[:-1]))
                held += column.nbytes
                if held >= size:
                    yield from chunk()
                    rest, parts, order, counts, held = [], [], [], [], 0
        if rest:
            yield from chunk()

    return run


def _row(rows: bytes | None, places: bytes | None, counts: bytes | None, cuts: bytes | None, words: pa.Array) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in (rows, places, counts, cuts)), lists], schema=_CHUNK_ARROW)


def _squeezed(x: np.ndarray) -> bytes:
    return x.nbytes.to_bytes(8, "little") + pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unsqueezed(payload: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(payload[8:], decompressed_size=int.from_bytes(payload[:8], "little"), codec="zstd", asbytes=True), kind)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    """A column as one array."""
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... count times, for all in turn."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


def _whole_words(own: pa.Array, cuts: np.ndarray, pieces: pa.Array) -> pa.Array:
    """Lists of ids with those of pieces joined: short words first, then long ones."""
    short, n = int(cuts[0]), int(cuts[1])
    sizes = pc.binary_length(pieces).to_numpy(zero_copy_only=False)
    parts = [np.asarray(x.as_py(), np.int64) for x in own[short:]]
    starts, at, out, ranks = cuts[2 + n :], 0, [], {}
    for count in cuts[2 : 2 + n].tolist():
        mine, begins = parts[at : at + count], starts[at : at + count].tolist()
        at += count
        ids = join_pieces(begins, mine, sizes)
        if ids is None:
            # each piece's bytes up to where the next begins are the word
            table = pieces.to_pylist()
            ranks = ranks or {p: i for i, p in enumerate(table[:-1]) if p}
            texts = [b"".join(table[i] for i in m) for m in mine]
            word = b"".join([*(t[: b - a] for t, a, b in zip(texts, begins, begins[1:], strict=False)), texts[-1]])
            ids = merge_bytes(word, ranks)
        out.append(pa.array(ids, pa.int32()))
    joined_ = _lists(np.cumsum([0, *map(len, out)]), pa.concat_arrays(out)) if out else own[:0]
    return pa.concat_arrays([own[:short], joined_.cast(own.type)])


def _assemble(cache_ends: np.ndarray, cache_ids: np.ndarray, pieces: pa.Array, names: list[str], per: int, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None):
    """Rows with their ids, from chunks whose new words have ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Array] = []
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column("ids").slice(i, 1).flatten()
                payload = batch.column("rows")[i]
                if not payload.is_valid:
                    parts.append(own)
                    continue
                rows = pa.ipc.open_stream(payload.as_buffer()).read_all()
                body, pieces_ = batch.column("places")[i].as_py(), []
                while body:
                    end = 8 + int.from_bytes(body[:8], "little")
                    pieces_.append(_unsqueezed(body[8:end], np.int32))
                    body = body[end:]
                places, per_part, order = pieces_
                counts = _unsqueezed(batch.column("counts")[i].as_py(), np.int64)
                own = pa.concat_arrays([*parts, own])
                parts = []
                if batch.column("cuts")[i].is_valid:
                    own = _whole_words(own, _unsqueezed(batch.column("cuts")[i].as_py(), np.int64), pieces)
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(own).to_numpy(zero_copy_only=False))]).astype(np.int64)
                flat = own.flatten().to_numpy(zero_copy_only=False)
                # the cache's words stand behind the chunk's own
                start = np.concatenate([ends[:-1], cache_ends[:-1] + len(flat)])
                size = np.concatenate([np.diff(ends), np.diff(cache_ends)])
                every = np.concatenate([flat, cache_ids])
                where = np.where(places >= 0, places, len(ends) - 1 + (-1 - places))
                # the ids of each part, from those of its words
                n = size[where]
                flat, ends = every[_ranges(start[where], n)], np.concatenate([[0], np.cumsum(n)])
                ends = ends[np.concatenate([[0], np.cumsum(per_part)])]
                start, size, every = ends[:-1], np.diff(ends), flat
                at = np.concatenate([[0], np.cumsum(counts)])
                for a in range(0, len(counts), per):
                    b = min(len(counts), a + per)
                    mine = order[at[a] : at[b]]
                    n = size[mine]
                    ids = every[_ranges(start[mine], n)]
                    total = np.concatenate([[0], np.cumsum(n)])
                    part = rows.slice(a, b - a).combine_chunks()
                    done = pa.RecordBatch.from_arrays([*(c.chunk(0) for c in part.columns), _lists(total[at[a : b + 1] - at[a]], ids.astype(np.int32))], names=names)
                    yield finish(done) if finish else done

    return run


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, cache_rows: int = CACHE_ROWS, cache_words: int = CACHE_WORDS, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str | None = None) -> DataFrame:
    """All columns of docs but the text, then ids (array of int).

    finish, with the schema of what it returns, is applied to each batch of these rows before it leaves its worker.
    """
    spark = docs.sparkSession
    prepare(spark)
    ranks = read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tables = pair_ranks(ranks)
    others = [c for c in docs.columns if c != text]
    inner = [f"c{i}" for i in range(len(others))]
    rows = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(others, inner, strict=True)], F.col(text).alias("text"))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled, counted = regex.compile(pattern), Counter()
        for batch in batches:
            for value in batch.column(0):
                counted.update(compiled.findall(value.as_py() or ""))
        for part in batched(counted.items(), 10_000):
            words, n = zip(*part, strict=True)
            words = pa.array(words, pa.string()).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], names=["word", "n"])

    share = min(1.0, cache_rows / max(1, docs.count()))
    sampled = docs.select(text).sample(fraction=share, seed=5) if share < 1 else docs.select(text)
    counted = sampled.mapInArrow(frequent, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.filter(F.octet_length("word") <= LONG).orderBy(F.desc("n"), "word").limit(cache_words).select("word").repartition(spark.sparkContext.defaultParallelism)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), byte_entries(batch.column(0), tables)], names=["word", "entries"])

    states = top.mapInArrow(first, "word binary, entries array<bigint>")
    cached = states.select("word", F.get(encode_words(F.array("entries"), ranks), 0).alias("ids")).toArrow()
    known, ids = (_whole(cached.column(c)) for c in ("word", "ids"))
    cache_ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
    cache_ids = ids.flatten().to_numpy(zero_copy_only=False)

    chunks = rows.mapInArrow(_chunks(pattern, known, chunk, tables), _CHUNK_SCHEMA)
    merged = chunks.select("rows", "places", "counts", "cuts", encode_words(F.col("words"), ranks).alias("ids"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    own = ", ".join([*(f"{c} {kinds[c]}" for c in inner), "ids array<int>"])
    done = merged.mapInArrow(_assemble(cache_ends, cache_ids, piece_table(ranks), [*(others if finish else inner), "ids"], 1000, finish), schema if finish else own)
    return done if finish else done.toDF(*others, "ids")


def piece_table(ranks: dict[bytes, int]) -> pa.Array:
    """Each id's bytes; the last entry, for what is no id, has none."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 2)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pa.array(pieces, pa.binary())


def joined(lists: pa.Array, pieces: pa.Array) -> pa.Array:
    """The pieces of each list of ids, one after another."""
    none = len(pieces) - 1
    place = pc.list_flatten(lists).fill_null(none).to_numpy(zero_copy_only=False)
    place = np.where((place < 0) | (place >= none), none, place)
    data, ends = text_bytes(pieces.take(pa.array(place)))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    edge = ends[np.concatenate([[0], np.cumsum(sizes)])]
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(data)])


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None, into: str = "decoded") -> DataFrame:
    """encoded with the bytes that its ids stand for; ids that the file has not, and nulls, give nothing."""
    prepare(encoded.sparkSession)
    pieces = piece_table(read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")))
    at = encoded.columns.index(ids)
    inner = [f"c{i}" for i in range(len(encoded.columns))]
    schema = ", ".join([*(f"{c} {f.dataType.simpleString()}" for c, f in zip(inner, encoded.schema.fields, strict=True)), "d binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, joined(batch.column(at), pieces)], names=[*inner, "d"])

    return encoded.toDF(*inner).mapInArrow(run, schema).toDF(*encoded.columns, into)


def digests(pieces: pa.Array) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """For batches of doc_id and ids: the number of ids, and digests of them in decimals and of what they decode to."""
    decimals = pa.array([f"{i} ".encode() for i in range(len(pieces) - 1)] + [b""], pa.binary())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("ids")
        texts, decoded = joined(lists, decimals), joined(lists, pieces)
        hexed = lambda column, cut: pa.array([hashlib.sha256(memoryview(x.as_buffer())[: len(x.as_buffer()) - cut if len(x.as_buffer()) else 0]).hexdigest() for x in column], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.list_value_length(lists).cast(pa.int64()), hexed(texts, 1), hexed(decoded, 0)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's ids, and what they decode to, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = piece_table(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return encode(docs, finish=digests(pieces), schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
