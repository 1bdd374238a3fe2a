"""SimHash near-dedup: documents whose 64-bit fingerprints differ in REACH bits or less, found by Golay-code keys.

A fingerprint has a bit where more than half of the hashes (XXH64, seed 42) of a document's four-word shingles have it.

Method: Golay-code fuzzy hashing. The fingerprint is cut into three segments of 22, 21 and 21 bits, each filled up with
zeros to the 23 of the perfect Golay code, in which any word lies within three bits of exactly one codeword, named by
its 12 message bits. Of two fingerprints that differ by four bits, one halfway between is two bits away from each; the
codeword indices of its segments are among those that either reaches with two flips. Two flips touch two of the three
segments at most, so a fingerprint gets as keys the triples of indices that it reaches with two flips in one segment or
one in each of two: about a hundred, of 36 bits. Fingerprints that are near meet under one of them for certain; strangers
hardly ever do, however many there are; those that meet are compared in full. The code is linear, so which indices a
word reaches depends on its error alone, and comes from a table of the 2048 errors.

Fingerprints are made distinct before keys are made, so copies cost nothing. They are shuffled by key once, in order,
and compared as they stream past; of a key with more than CHUNK none are held: they are put off, cut into chunks, and
every two chunks are a task. A task returns a link to its
group's least fingerprint for each that has one, so dense groups yield no pairs; the components of these links are
those of all. Within REACH bits of one fingerprint there are 679,121 at most, which bounds what a group of near copies can be.

Words are what stands between white space (a space, tab to carriage return), in lower case for ASCII letters; repeated
shingles count each.

Edge cases: a text of one to three words has one shingle, all of them; a null text counts as empty, and one without a word has fingerprint zero and is linked like any other; a null doc_id takes part, and
component_id is null if no member has an id; repeated rows come out each; an empty table gives an empty result; other
columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep, prepare, release
from tessera.llm.graph import components
from tessera.llm.kernels import BLANK, U64, text_bytes, words
from tessera.llm.quality import slices

WORDS, REACH, SEED, CHUNK = 4, 4, 42, 4096
#: Fingerprints whose keys one task makes.
SHARE = 1 << 15
#: First bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the [23, 12, 7] Golay code.
GENERATOR = 0b110001110101
_STEP = 1 << 16


def _remainders() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the words with bits in the lower 12 and in the upper 11 places."""
    one = []
    for i in range(23):
        x = 1 << i
        for shift in range(11, -1, -1):
            if x >> (shift + 11) & 1:
                x ^= GENERATOR << shift
        one.append(x)
    spread = lambda bits: np.bitwise_xor.reduce([np.where(np.arange(1 << len(bits)) >> i & 1, b, 0) for i, b in enumerate(bits)])
    return spread(one[:12]), spread(one[12:])


_LOW, _HIGH = _remainders()


def _errors() -> np.ndarray:
    """The error of three bits or less that has each syndrome."""
    out = np.zeros(1 << 11, np.int64)
    flips = [0, *(1 << i for i in range(23))]
    every = np.unique([a ^ b ^ c for a in flips for b in flips for c in flips])
    every = every[np.bitwise_count(every) <= 3]
    out[_LOW[every & 4095] ^ _HIGH[every >> 12]] = every
    return out


_ERROR = _errors()


def decode(x: np.ndarray) -> np.ndarray:
    """The index of the codeword nearest to each 23-bit word."""
    return (x ^ _ERROR[_LOW[x & 4095] ^ _HIGH[x >> 12]]) >> 11


def _reached(size: int) -> tuple[np.ndarray, np.ndarray]:
    """For words of each error, what the indices of other codewords differ by that one flip, and up to two flips, of the first size bits reach; -1 where there are fewer."""
    one = np.array([1 << i for i in range(size)])
    two = np.unique(one[:, None] ^ one)
    out = []
    for flips in (one, np.union1d(one, two)):
        # a row for each syndrome; the index of a word with no more than its error is zero
        found = np.sort(decode(_ERROR[:, None] ^ flips), 1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = 0
        found[found == 0] = -1
        out.append(-np.sort(-found, 1)[:, : int((found > 0).sum(1).max())])
    return out[0], out[1]


_REACHED = [_reached(size) for _, size in SEGMENTS]


def near_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unsigned 64-bit fingerprints, and the place of the fingerprint that each belongs to; none twice for one."""
    own, once, twice = [], [], []
    for (first, size), (by_one, by_two) in zip(SEGMENTS, _REACHED, strict=True):
        x = (fingerprints >> U64(first) & U64((1 << size) - 1)).astype(np.int64)
        syndrome = _LOW[x & 4095] ^ _HIGH[x >> 12]
        shift = 12 * len(own)
        own.append((x ^ _ERROR[syndrome]) >> 11 << shift)
        for table, to in ((by_one, once), (by_two, twice)):
            change = table[syndrome]
            to.append(np.where(change < 0, -1, change << shift))
    whole = own[0] | own[1] | own[2]
    place, keys = [np.arange(len(whole))], [whole]
    pairs = [np.where((once[a][:, :, None] < 0) | (once[b][:, None] < 0), -1, once[a][:, :, None] | once[b][:, None]).reshape(len(whole), -1) for a, b in ((0, 1), (0, 2), (1, 2))]
    for change in (*twice, *pairs):
        row, column = np.nonzero(change >= 0)
        keys.append(whole[row] ^ change[row, column])
        place.append(row)
    return np.concatenate(keys), np.concatenate(place)


def fingerprint_rows(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> np.ndarray:
    """The fingerprint of each text."""
    from xxhash import xxh64_intdigest

    n = len(offsets) - 1
    start, end, row = words(data, offsets)
    ones, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    if len(start):
        # each word and one space behind it, so that any shingle is a slice
        lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        ink = ~BLANK[data]
        last = np.zeros(len(data) + 1, bool)
        last[end] = True
        before = np.concatenate([[0], np.cumsum(ink)])
        at = before[start] + np.arange(len(start))
        stop = at + (end - start)
        whole = np.full(int(stop[-1]) + 1, 32, np.uint8)
        whole[np.arange(int(before[-1])) + np.repeat(np.arange(len(start)), end - start)] = lower[ink]
        text = whole.tobytes()
        count = np.bincount(row, minlength=n)
        head = np.concatenate([[0], np.cumsum(count)])
        total = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
        owner = np.repeat(np.arange(n), total)
        begin = np.arange(len(owner)) - np.repeat(np.cumsum(total) - total, total) + head[owner]
        final = np.minimum(begin + size, head[owner + 1]) - 1
        a, b = at[begin], stop[final]
        for low in range(0, len(owner), _STEP):
            some = slice(low, low + _STEP)
            hashes = np.fromiter((xxh64_intdigest(text[i:j], SEED) for i, j in zip(a[some].tolist(), b[some].tolist(), strict=True)), U64, len(a[some]))
            mine = owner[some]
            heads = np.flatnonzero(np.diff(mine, prepend=-1))
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[mine[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    set_ = 2 * ones > total[:, None]
    return np.packbits(set_, axis=1, bitorder="little").view("<u8")[:, 0] if n else np.zeros(0, U64)


def _sign(size: int):
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                found = fingerprint_rows(*text_bytes(batch.column(1)), size)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], schema=schema)

    return run


def _key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy()
        keys, place = near_keys(fp.view(U64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[place])], names=["key", "fp"])


def stars(fp: np.ndarray, side: np.ndarray | None, reach: int) -> np.ndarray:
    """For each of some fingerprints the place of the first one of its component, by links of reach bits; with side, only links between its sides."""
    n, step = len(fp), 256
    root = np.arange(n)
    while True:
        following = root.copy()
        for low in range(0, n, step):
            near = np.bitwise_count(fp[low : low + step, None] ^ fp) <= reach
            if side is not None:
                near &= side[low : low + step, None] != side
            following[low : low + step] = np.minimum(following[low : low + step], np.where(near, following, n).min(1))
        following = following[following]
        if (following == root).all():
            return root
        root = following


#: Groups up to so many fingerprints are compared in step, all groups of a batch at once.
_FEW = 8


def _link(reach: int, most: int | None):
    """Links of the groups key, a, b of ordered rows; with most, the rows of larger groups come back as they are (key and fingerprint), put off."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("off", pa.bool_())])

    def told(a: np.ndarray, b: np.ndarray, off: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), off))], schema=schema)

    def judge(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole groups, in order; columns key, a, b, chunk, fp."""
        fp = rows[4].view(U64)
        cut = np.flatnonzero(np.concatenate([[True], (rows[:3, 1:] != rows[:3, :-1]).any(0)]))
        size = np.diff(np.append(cut, len(fp)))
        group = np.repeat(np.arange(len(cut)), size)
        few = size[group] <= _FEW
        left, right = [np.zeros(0, U64)], [np.zeros(0, U64)]
        for lag in range(1, _FEW):
            if lag >= len(fp):
                break
            near = few[lag:] & (group[lag:] == group[:-lag]) & (np.bitwise_count(fp[lag:] ^ fp[:-lag]) <= reach)
            left.append(fp[lag:][near])
            right.append(fp[:-lag][near])
        for g in np.flatnonzero(size > _FEW):
            own = slice(cut[g], cut[g] + size[g])
            if most and size[g] > most:
                yield told(rows[0, own], rows[4, own], True)
                continue
            root = stars(fp[own], rows[3, own] if rows[1, cut[g]] != rows[2, cut[g]] else None, reach)
            far = np.flatnonzero(root != np.arange(len(root)))
            left.append(fp[own][far])
            right.append(fp[own][root[far]])
        yield told(np.concatenate(left), np.concatenate(right), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = np.zeros((5, 0), np.int64), None
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "a", "b", "chunk", "fp")])
            if large is not None:
                more = int(np.searchsorted(rows[0], large, "right"))
                yield told(rows[0, :more], rows[4, :more], True)
                rows = rows[:, more:]
                large = large if not rows.shape[1] else None
            held = np.concatenate([held, rows], 1)
            # the last group may go on in the next batch
            done = int(np.flatnonzero((held[:3] != held[:3, -1:]).any(0)).max(initial=-1)) + 1 if held.shape[1] else 0
            if most and held.shape[1] - done > most:
                large = held[0, -1]
                yield told(held[0, done:], held[4, done:], True)
                yield from judge(held[:, :done])
                held = held[:, :0]
            elif done >= 1 << 14:
                yield from judge(held[:, :done])
                held = held[:, done:]
        if held.shape[1]:
            yield from judge(held)

    return run


def _by_chunks(off: DataFrame, chunk: int) -> DataFrame:
    """Rows key, fp of large groups, for every two chunks of a group: key, a, b, chunk, fp."""
    # the aggregate is written first, so both sides of the join are plain shuffles, whose large keys Spark can split
    sizes = keep(off.groupBy("key").agg(F.count("*").alias("size")), "key-sizes")
    met = off.join(sizes, "key").withColumn("n", F.ceil(F.col("size") / chunk).cast("int"))
    dealt = met.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("key", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "chunk", "fp")
    return dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "fp")


def links(fingerprints: DataFrame, reach: int = REACH, chunk: int = CHUNK) -> DataFrame:
    """Links a, b between the distinct values of column fp, enough of them to connect all that differ in reach bits or less."""
    if reach > REACH:
        raise ValueError(f"two flips on either side stand for {REACH} bits at most")
    tasks = -(-fingerprints.count() // SHARE) or 1
    keys = fingerprints.select("fp").repartition(tasks, "fp").mapInArrow(_key, "key long, fp long")
    schema, zero = "a long, b long, off boolean", F.lit(0)
    sent = keys.repartition("key").sortWithinPartitions("key", "fp").select("key", zero.alias("a"), zero.alias("b"), zero.alias("chunk"), "fp")
    found = keep(sent.mapInArrow(_link(reach, chunk), schema), "links")
    off = found.filter("off").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    told = found.filter("not off")
    if not off.isEmpty():
        told = told.unionByName(_by_chunks(off, chunk).mapInArrow(_link(reach, None), schema))
    return told.select("a", "b").distinct()


def near(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = WORDS, reach: int = REACH, chunk: int = CHUNK) -> DataFrame:
    """A row for each document: id, fp (the fingerprint as a signed long) and component_id, the least id that links reach."""
    prepare(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = keep(narrow.mapInArrow(_sign(size), "id long, fp long"), "fingerprints")
    each = keep(signed.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    edges = links(each, reach, chunk)
    found = components(edges)
    member = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).toDF("fp", "root")
    named = keep(member.join(each, "fp").select("fp", "root", "least"), "members")
    release(found)
    lowest = keep(named.groupBy("root").agg(F.min("least").alias("component_id")), "lowest")
    moved = named.join(lowest, "root").select("fp", F.col("component_id").alias("reached"))
    whole = keep(each.join(moved, "fp", "left").select("fp", F.coalesce("reached", "least").alias("component_id")), "components")
    release(each, named, lowest)
    return signed.join(whole, "fp").select("id", "fp", "component_id")


def op13_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = near(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
