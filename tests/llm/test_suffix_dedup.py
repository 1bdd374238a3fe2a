"""Passage removal against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from tessera.llm import suffix_dedup as S

LAST = (1 << 63) - 1


def brute(rows, window=50):
    best = {}
    for i, t in rows:
        b, own = (t or "").encode(), LAST if i is None else i
        for p in range(len(b) - window + 1):
            best[b[p : p + window]] = min(best.get(b[p : p + window], LAST), own)
    out = []
    for i, t in rows:
        b, own = (t or "").encode(), LAST if i is None else i
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if best[b[p : p + window]] < own:
                gone[p : p + window] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def same(spark, folder, rows):
    return sorted(map(tuple, S.op7_suffix_dedup(spark, folder).collect()), key=str) == brute(rows)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert same(spark, folder, rows)


def test_edges(spark, documents):
    rows = [(3, "a" * 200), (1, "b" * 49 + "c"), (2, "a" * 120), (None, "a" * 60 + "é" * 100), (None, "é" * 90), (5, None), (6, ""), (2, "b" * 49 + "c"), (7, "b" * 49 + "c"), (7, "zz" + "b" * 49 + "c")]
    assert same(spark, documents(rows), rows)


def test_small_blocks_and_long_texts(spark, documents, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 20_000)
    rng = random.Random(4)
    parts = ["".join(rng.choice("ab \nxyz") for _ in range(rng.randrange(20, 200))) for _ in range(30)]
    rows = [(rng.randrange(60), "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))) for _ in range(80)]
    rows.append((99, " ".join(rng.choice(parts) for _ in range(400))))
    assert same(spark, documents(rows), rows)


def test_empty_table_and_clashing_columns(spark, documents):
    assert S.op7_suffix_dedup(spark, documents([])).count() == 0
    df = spark.createDataFrame([(2, "x" * 60, 1, "k"), (1, "x" * 60, None, None)], "doc_id long, text string, kept int, block string")
    found = S.remove_repeats(df)
    assert found.columns[:4] == df.columns and found.columns[4:] == ["kept_", "removed"]
    assert {r["doc_id"]: r["kept_"] for r in found.collect()} == {1: bytearray(b"x" * 60), 2: bytearray()}


def test_whole_characters(spark):
    text = "é" * 40
    found = S.remove_repeats(spark.createDataFrame([(1, text), (2, "z" + text[:-1] + "ê")], "doc_id long, text string"), whole_characters=True)
    kept = {r["doc_id"]: bytes(r["kept"]).decode() for r in found.collect()}
    assert kept == {1: text, 2: "zê"}


def test_digit_groups():
    text = np.frombuffer(b"abcdefgh" * 3 + b"zbcdefgh", np.uint8)
    groups = S.digit_groups(text, np.array([0, 8, 1, 9, 25]), depth=7)
    assert groups[0] == groups[1] >= 0 and groups[2] == groups[3] == groups[4] >= 0 and groups[0] != groups[2]


def test_hot_minimisers_make_no_difference(spark, documents):
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefgh ") for _ in range(87))
    around = lambda: "".join(rng.choice("abc xyz") for _ in range(rng.randrange(0, 70)))
    rows = [(i, around() + line[rng.randrange(0, 20) :] + around()) for i in range(60)]
    docs = spark.read.parquet(f"{documents(rows)}/documents.parquet")
    cold, hot = ({r["doc_id"]: (bytes(r["kept"]), r["removed"]) for r in S.remove_repeats(docs, hot=h).collect()} for h in (S.HOT, 4))
    assert cold == hot
    assert sorted((i, hashlib.sha256(kept).hexdigest()) for i, (kept, _) in hot.items()) == sorted((r[0], r[4]) for r in brute(rows))


def test_one_line_in_50000_contexts_fills_no_bucket():
    """What the edges of a common line ship is spread: no bucket gets 1.5 times the mean."""
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    line = rng.choice(letters, 87).tobytes().decode()
    noise = rng.choice(letters, 50_000 * 200).tobytes().decode()
    texts = [noise[i * 200 : i * 200 + 100] + line + noise[i * 200 + 100 : i * 200 + 200] for i in range(50_000)]
    size = sum(map(len, texts))
    buckets, per = -(-size // (1 << 20)), 10_000
    blocks = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([S._pack(pa.table({"id": pa.array(range(k * per, k * per + per), pa.int64()), "t": texts[k * per : k * per + per]}))], pa.binary())], names=["block", "payload"]) for k in range(5)]
    hashes = pa.Table.from_batches(list(S._hashes(1, 0, buckets)(iter(blocks))))

    def by_bucket(table, run):
        return pa.concat_tables([run(table.filter(pc.equal(table.column("bucket"), b))) for b in table.column("bucket").unique().to_pylist()])

    def spread_out(hot):
        replies = by_bucket(hashes, S._shared(hot))
        runs = pa.concat_tables([S._runs(1, 0, buckets)(pa.Table.from_batches([b]), replies.filter(pc.equal(replies.column("block"), k))) for k, b in enumerate(blocks)])
        filled = {}
        for b, payload in zip(runs.column("bucket").to_pylist(), runs.column("payload").to_pylist(), strict=True):
            if b >= 0:
                filled[b] = filled.get(b, 0) + int.from_bytes(payload[8:16], "little")
        return max(filled.values()) / (sum(filled.values()) / buckets)

    assert spread_out(1 << 12) < 1.5 < 2 < spread_out(1 << 62)


def _line_in_contexts(rows, seed):
    """Short rows of random letters with one common line of 87 bytes, and what every row has but the line."""
    rng = np.random.default_rng(seed)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    line = rng.choice(letters, 87).tobytes().decode()
    noise = rng.choice(letters, rows * 72).tobytes().decode()
    return line, [noise[i * 72 : i * 72 + 36] + line + noise[i * 72 + 36 : i * 72 + 72] for i in range(rows)]


def test_a_line_of_400000_short_rows(spark):
    """With production parameters, no bucket of runs gets much, and what goes is the line alone."""
    line, texts = _line_in_contexts(400_000, 5)
    whole = S.remove_repeats(spark.createDataFrame(pa.table({"doc_id": range(len(texts)), "text": texts})).repartition(8))
    got = whole.select("doc_id", F.size("removed").alias("n"), F.expr("get(removed, 0).end - get(removed, 0).start").alias("size")).toArrow().to_pandas().set_index("doc_id")
    assert got.loc[0, "n"] == 0 and (got.drop(0)["n"] >= 1).mean() > 0.9999
    # a byte on either side is the same as an earlier row's by chance
    assert (got.drop(0)["size"] >= 87).all() and got["size"].mean() < 100

    per = 26_000
    blocks = [pa.table({"id": pa.array(range(k, k + per), pa.int64()), "t": texts[k : k + per]}) for k in range(0, len(texts) - per + 1, per)]
    noted = [S._places(t, 1) for t in blocks]
    total = {}
    for _, heavy in noted:
        for gram, n in np.frombuffer(heavy or b"", "<i8").reshape(-1, 2).tolist():
            total[gram] = total.get(gram, 0) + n
    passed = np.sort(np.array([g for g, n in total.items() if n >= max(S.OFTEN, sum(p for p, _ in noted) // S.MOST_PASSED)], np.int64).view(np.uint64))
    assert 0 < len(passed) < 1000
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([S._pack(t)], pa.binary())], names=["block", "payload"]) for k, t in enumerate(blocks)]
    buckets = -(-sum(map(len, texts)) // S.BUCKET)
    hashes = pa.Table.from_batches(list(S._hashes(1, 0, buckets, passed)(iter(batches))))
    replies = pa.concat_tables([S._shared(S.HOT)(hashes.filter(pc.equal(hashes.column("bucket"), b))) for b in hashes.column("bucket").unique().to_pylist()])
    runs = pa.concat_tables([S._runs(1, 0, buckets, passed)(pa.Table.from_batches([b]), replies.filter(pc.equal(replies.column("block"), k))) for k, b in enumerate(batches)])
    filled = {}
    for b, payload in zip(runs.column("bucket").to_pylist(), runs.column("payload").to_pylist(), strict=True):
        if b >= 0:
            filled[b] = filled.get(b, 0) + int.from_bytes(payload[8:16], "little")
    print(len(passed), max(filled.values()), sum(filled.values()), sum(map(len, texts)))
    # only contexts that have a partner by chance (three bytes or so) are shipped: less than the text, and evenly
    assert sum(filled.values()) < sum(map(len, texts)) and max(filled.values()) < 1.5 * sum(filled.values()) / buckets


def test_passed_grams_make_no_difference(spark, documents, monkeypatch):
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefgh ") for _ in range(140))
    around = lambda: "".join(rng.choice("abc xyz") for _ in range(rng.randrange(0, 70)))
    rows = [(i, around() + line[rng.randrange(0, 20) : rng.randrange(60, 140)] + around()) for i in range(120)]
    docs = spark.read.parquet(f"{documents(rows)}/documents.parquet")
    seen, real = [], S.common_grams
    monkeypatch.setattr(S, "common_grams", lambda *a: seen.append(real(*a)) or seen[-1])
    passed, plain = ({r["doc_id"]: (bytes(r["kept"]), r["removed"]) for r in S.remove_repeats(docs, heavy=h, often=o).collect()} for h, o in ((3, 6), (S.HEAVY, S.OFTEN)))
    assert passed == plain and len(seen[0]) > 5 and not len(seen[1])
    assert sorted((i, hashlib.sha256(kept).hexdigest()) for i, (kept, _) in passed.items()) == sorted((r[0], r[4]) for r in brute(rows))
