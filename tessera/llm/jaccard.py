"""N-gram Jaccard join: documents whose sets of five-word shingles overlap by 0.8 or more.

Method: MinHash banding. Rows per band and bands are chosen so that a pair right at the threshold meets in some band
with the target recall; the shuffle is on band hashes. Documents with one text are one node from the start. Nodes that
meet in a band are not paired: each bucket gives a star around its least node, the stars' components hold all pairs
that met (and more), and every component is verified exactly on the full shingle sets.

Chance meetings would chain what is not alike. So buckets are parted first: where an edge of a star has at most half
the bands that a pair at the threshold may expect, the bucket's edges are verified on full shingle sets. Similarity is
one less a metric, so a linked pair's similarities to the centre differ by 1 - threshold at most: where those of a bucket
leave a wider gap, no link crosses it. Who lies above it stays in the star; those below are verified among themselves,
exactly, and only their links go on. No pair that met and is linked is parted.

A component of up to CHUNK nodes is one task's work, on bit sets; a larger one is cut into chunks and every two chunks
are a task, so memory stays bounded and no pair of rows is ever shuffled. A task returns a row for each node: its
links and the root of its local group. Links between different texts are all counted.

Words are what stands between white space (a space, tab to carriage return), in lower case for ASCII letters. A text
of one to four words has one shingle, all of them.

Edge cases: a null text counts as empty; texts without a word are linked to their exact copies alone; a null doc_id
takes part and sorts last (class_id is null if no member has an id); rows with equal id and text are copies like any
others; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, keep, prepare, release
from tessera.llm.graph import components
from tessera.llm.kernels import BASE, U64, Spans, gram_hashes, mix, text_bytes, words
from tessera.llm.quality import slices

WORDS, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.999, 320
CHUNK = 512
NO_ID = (1 << 63) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bands_and_rows(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """The most selective banding of so many hashes at most that finds a pair at the threshold with this probability."""
    for rows in range(hashes, 0, -1):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("no banding reaches this recall with so few hashes")


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The row and 64-bit hash of each shingle, row by row; rows may repeat one."""
    data = _LOWER[data]
    start, end, row = words(data, offsets)
    word = Spans(data, 3).hash(start, end)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    whole = np.zeros(0, np.int64)
    hashes = np.zeros(0, U64)
    if len(word) >= size:
        hashes = gram_hashes(word, size)[: len(word) - size + 1]
        whole = np.flatnonzero(row[: len(hashes)] == row[size - 1 :])
        hashes = hashes[whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.searchsorted(row, np.arange(n))
        place = np.arange(len(row)) - first[row]
        mine = np.flatnonzero(count[row] < size)
        keyed = mix(word[mine] + place[mine].astype(U64) * U64(BASE))
        heads = np.flatnonzero(np.diff(row[mine], prepend=-1))
        rows = np.concatenate([row[whole], short])
        hashes = np.concatenate([hashes, mix(np.add.reduceat(keyed, heads) + count[short].astype(U64))])
        order = np.argsort(rows, kind="stable")
        return rows[order], hashes[order]
    return row[whole], hashes


def band_hashes(row: np.ndarray, hashes: np.ndarray, n: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have shingles, and a 64-bit key for each of them and each band."""
    heads = np.flatnonzero(np.diff(row, prepend=-1))
    rng = np.random.Generator(np.random.PCG64(41))
    factor = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    offset = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    x = (hashes >> U64(32)).astype(np.uint32)
    out = np.zeros((len(heads), bands), U64)
    for b in range(bands):
        key = np.full(len(heads), b + 1, U64)
        for r in range(b * rows, (b + 1) * rows):
            key = mix(key * U64(BASE) + np.minimum.reduceat(x * factor[r] + offset[r], heads))
        out[:, b] = key
    return row[heads], out


def _signatures(size: int, bands: int, rows: int):
    schema = pa.schema([("id", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                data, offsets = text_bytes(batch.column(2))
                row, hashes = shingles(data, offsets, size)
                have, keys = band_hashes(row, hashes, batch.num_rows, bands, rows) if len(row) else (row, np.zeros((0, bands), U64))
                count = np.zeros(batch.num_rows, np.int32)
                count[have] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], schema=schema)

    return run


def verify(texts: pa.ChunkedArray, side: np.ndarray | None, size: int, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each row: the later rows whose shingle sets are similar enough; with side, only those of the other side."""
    data, offsets = text_bytes(texts)
    row, hashes = shingles(data, offsets, size)
    n = len(offsets) - 1
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes = row[new], hashes[new]
    count = np.bincount(row, minlength=n)
    _, place, often = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = often[place] > 1
    _, place = np.unique(place[shared], return_inverse=True)
    width = (int(place.max()) >> 6) + 1 if len(place) else 1
    bits = np.zeros((n, width), U64)
    np.bitwise_or.at(bits, (row[shared], place >> 6), U64(1) << (place & 63).astype(U64))
    for i in range(n - 1):
        if not count[i]:
            continue
        low, high = threshold * count[i], count[i] / threshold
        later = np.arange(i + 1, n)
        able = (count[later] >= low - 1e-9) & (count[later] <= high + 1e-9)
        if side is not None:
            able &= side[later] != side[i]
        later = later[able]
        if not len(later):
            continue
        mine = np.flatnonzero(bits[i])
        both = np.bitwise_count(bits[np.ix_(later, mine)] & bits[i, mine]).sum(axis=1, dtype=np.int64)
        yield i, later[both >= threshold * (count[i] + count[later] - both) - 1e-9]


def _similarities(size: int):
    """The exact similarity of the rows of each group to its first, the centre."""
    schema = pa.schema([("nid", pa.int64()), ("low", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, U64)
        for whole in batches:
            for batch in slices(whole, whole.schema.get_field_index("text")):
                nid, low, sub, kind = (batch.column(c).to_numpy() for c in ("nid", "low", "sub", "kind"))
                row, hashes = shingles(*text_bytes(batch.column("text")), size)
                order = np.lexsort((hashes, row))
                row, hashes = row[order], hashes[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
                row, hashes = row[new], hashes[new]
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
                count, both, against = np.diff(ends), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                cuts = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (sub[1:] != sub[:-1]), [True]])) if batch.num_rows else []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if kind[a] == 0:
                        centre = hashes[ends[a] : ends[a + 1]]
                    mine = hashes[ends[a] : ends[b]]
                    hit = centre[np.minimum(np.searchsorted(centre, mine), len(centre) - 1)] == mine if len(centre) else np.zeros(len(mine), bool)
                    both[a:b], against[a:b] = np.bincount(row[ends[a] : ends[b]] - a, hit, b - a), len(centre)
                found = kind == 1
                yield pa.RecordBatch.from_arrays([pa.array(nid[found]), pa.array(low[found]), pa.array((both / np.maximum(count + against - both, 1))[found])], schema=schema)

    return run


def part_buckets(stars: DataFrame, similarity: Callable[[DataFrame], DataFrame], verified: Callable[[DataFrame], DataFrame], threshold: float, few: int) -> DataFrame:
    """Edges a, b from the stars (key, nid, low) of all buckets; an edge that few bands or less have makes its buckets doubtful.

    similarity gives a kept table of it for pairs nid, low; verified one with nid and root for groups nid, comp.
    """
    met = stars.groupBy("nid", "low").agg(F.collect_list("key").alias("keys"))
    doubtful = keep(met.filter(F.size("keys") <= few).select(F.explode("keys").alias("key")).distinct(), "doubtful")
    work = keep(stars.join(doubtful, "key", "left_semi"), "doubted")
    told = similarity(work.select("nid", "low").distinct())
    # similarities in 64 steps; a gap of so many empty steps is wider than 1 - threshold
    gap = math.floor((1 - threshold) * 64 + 1e-9) + 1
    judged = keep(work.join(told, ["nid", "low"]).withColumn("step", F.least(F.floor(F.col("similarity") * 64), F.lit(63)).cast("int")), "judged")
    seen = judged.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, step)")).alias("seen"))
    empty = F.filter(F.sequence(F.lit(1), F.lit(max(1, 64 - gap))), lambda i: F.call_function("shiftrightunsigned", F.col("seen"), i).bitwiseAND(F.lit((1 << gap) - 1)) == 0)
    cuts = keep(seen.select("key", F.coalesce(F.array_max(empty), F.lit(0)).alias("cut")), "cuts")
    placed = judged.join(cuts, "key")
    near = placed.filter("step >= cut").select("nid", "low")
    far = keep(placed.filter("step < cut").select("nid", F.col("key").alias("comp")), "far")
    edges = keep(stars.join(doubtful, "key", "left_anti").select("nid", "low").unionByName(near), "edges")
    release(doubtful, work, told, judged, cuts)
    links = verified(far).filter("nid != root").select("nid", F.col("root").alias("low"))
    return edges.unionByName(links).toDF("a", "b")


def _verify_groups(size: int, threshold: float):
    schema = pa.schema([("nid", pa.int64()), ("root", pa.int64()), ("docs", pa.int64()), ("texts", pa.int64())])

    def one(group: pa.Table) -> pa.RecordBatch:
        nid, copies = group.column("nid").to_numpy(), group.column("copies").to_numpy()
        side = group.column("chunk").to_numpy() if group.column("a")[0].as_py() != group.column("b")[0].as_py() else None
        root = np.arange(len(nid))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        docs, texts = np.zeros(len(nid), np.int64), np.zeros(len(nid), np.int64)
        for i, linked in verify(group.column("text"), side, size, threshold):
            docs[i] += copies[linked].sum()
            texts[i] += len(linked)
            docs[linked] += copies[i]
            texts[linked] += 1
            for j in linked:
                a, b = find(i), find(int(j))
                root[max(a, b)] = min(a, b)
        top = np.array([find(i) for i in range(len(nid))], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(nid), pa.array(nid[top]), pa.array(docs), pa.array(texts)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = list(zip(*(batch.column(c).to_pylist() for c in ("comp", "a", "b")), strict=True))
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                if held and key[start] != last:
                    yield one(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(start, end - start))
                last = key[start]
        if held:
            yield one(pa.Table.from_batches(held))

    return run


def _identity(docs: DataFrame, text: str, doc_id: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS, hashes: int = HASHES, chunk: int = CHUNK) -> DataFrame:
    """A row for each document: id (NO_ID for null), node (its text's digest), copy_id (least id with this text), n_copies, class_id (least id in its component of links), chosen (the one row identity of its class that stands for it) and n_links (other documents that are similar enough, copies among them)."""
    spark = docs.sparkSession
    prepare(spark)
    bands, rows = bands_and_rows(threshold, recall, hashes)
    ident, digest = _identity(docs, text, doc_id)
    narrow = docs.select(ident.alias("id"), digest.alias("node"), F.col(text).alias("text"))
    signed = keep(narrow.mapInArrow(_signatures(words, bands, rows), "id long, node binary, bands array<long>"), "signatures")
    nodes = signed.groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    nodes = keep(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")

    source = docs.select(ident.alias("rep"), digest.alias("node"), F.col(text).alias("text"))

    def with_text(rows: DataFrame) -> DataFrame:
        """Rows, which name nodes by nid, with their texts; each text is read once."""
        named = rows.join(nodes.select("nid", "node", "rep", "copies"), "nid")
        to = named.groupBy("rep", "node").agg(F.collect_list(F.struct("copies", *rows.columns)).alias("to"))
        # repeated rows would bring a text twice
        found = source.join(to, ["rep", "node"]).dropDuplicates(["rep", "node"])
        return found.select("text", F.explode("to").alias("t")).select("t.*", F.coalesce("text", F.lit("")).alias("text"))

    def similarity(pairs: DataFrame) -> DataFrame:
        """A centre's text goes to one task for each chunk of its star."""
        per = keep(pairs.groupBy("low").agg(F.ceil(F.count("*") / chunk).cast("int").alias("n")), "centres")
        member = pairs.join(per, "low").select("nid", "low", F.pmod(F.xxhash64("nid"), F.col("n")).cast("int").alias("sub"), F.lit(1).alias("kind"))
        centre = per.select(F.col("low").alias("nid"), "low", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("sub"), F.lit(0).alias("kind"))
        sent = with_text(member.unionByName(centre)).repartition("low", "sub").sortWithinPartitions("low", "sub", "kind", "nid")
        found = keep(sent.select("nid", "low", "sub", "kind", "text").mapInArrow(_similarities(words), "nid long, low long, similarity double"), "similarities")
        release(per)
        return found

    def verified(member: DataFrame) -> DataFrame:
        """Links of the nodes of each group (nid, comp) on whole texts, each sent once unless its group is larger than a chunk."""
        size = keep(member.groupBy("comp").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
        dealt = member.join(size, "comp").withColumn("n", F.ceil(F.col("size") / chunk).cast("int"))
        dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("nid"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        dealt = dealt.withColumn("a", F.least("chunk", "other")).withColumn("b", F.greatest("chunk", "other")).select("nid", "comp", "chunk", "a", "b")
        sent = with_text(dealt).repartition("comp", "a", "b").sortWithinPartitions("comp", "a", "b", "nid")
        found = keep(sent.mapInArrow(_verify_groups(words, threshold), "nid long, root long, docs long, texts long"), "links")
        release(size)
        return found

    # candidates: a star in each bucket of a band
    keyed = nodes.select("nid", F.explode("bands").alias("key"))
    # aggregates are written before a join, so that both its sides are plain shuffles, whose large keys Spark can split
    bucket = keep(keyed.groupBy("key").agg(F.min("nid").alias("low"), F.max("nid").alias("high")).filter("low != high").drop("high"), "buckets")
    stars = keep(keyed.join(bucket, "key").filter("nid != low"), "stars")
    release(bucket)
    met = components(part_buckets(stars, similarity, verified, threshold, max(1, int(bands * threshold**rows / 2))))
    release(stars)
    member = met.unionByName(met.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("nid"), F.col("root").alias("comp"))
    checked = verified(member)
    release(met)

    links = checked.groupBy("nid").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    classes = components(checked.select(F.col("nid").alias("a"), F.col("root").alias("b")))
    whole = nodes.select("nid", "node", "rep", "copies").join(links, "nid", "left").join(classes.select(F.col("node").alias("nid"), "root"), "nid", "left")
    whole = keep(whole.withColumn("root", F.coalesce("root", "nid")), "classes")
    release(nodes, checked, classes)
    first = keep(whole.groupBy("root").agg(F.min(F.struct("rep", "nid")).alias("top")), "firsts")
    whole = whole.join(first, "root").select(
        "node",
        F.col("rep").alias("copy_id"),
        F.col("copies").alias("n_copies"),
        F.col("top.rep").alias("class_id"),
        (F.col("top.nid") == F.col("nid")).alias("stands"),
        (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_texts"),
    )
    return signed.select("id", "node").join(whole, "node").withColumn("chosen", F.col("stands") & (F.col("id") == F.col("copy_id"))).drop("stands")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of docs, one for each class of linked documents: that with the least id, once."""
    found = join(docs, text, doc_id).filter("chosen").select("id", "node").distinct()
    at_id, at_node = fresh(docs, "id", "node")
    ident, digest = _identity(docs, text, doc_id)
    named = docs.withColumns({at_id: ident, at_node: digest})
    kept = named.join(found.toDF(at_id, at_node), [at_id, at_node], "left_semi")
    return kept.dropDuplicates([at_id, at_node]).drop(at_id, at_node)


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document's class and number of links."""
    found = join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    bare = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return found.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), bare("class_id"), bare("copy_id"), "n_copies", "n_links")
