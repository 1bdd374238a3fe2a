"""The join against brute force on all pairs."""

import random
import re
from collections import defaultdict

from tessera.llm import jaccard as J


def brute(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    where, parent, links = defaultdict(list), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, own in enumerate(sets):
        both = defaultdict(int)
        for g in own:
            for o in where[g]:
                both[o] += 1
            where[g].append(k)
        hit = {o for o, v in both.items() if v >= threshold * (len(own) + len(sets[o]) - v) - 1e-9}
        hit |= {o for o in range(k) if (rows[o][1] or "") == (rows[k][1] or "")}
        for o in hit:
            links[o] += 1
            links[k] += 1
            a, b = find(o), find(k)
            parent[max(a, b)] = min(a, b)
    best = {}
    for k, (i, _) in enumerate(rows):
        best[find(k)] = min(best.get(find(k), J.NO_ID), J.NO_ID if i is None else i)
    return sorted(((i, None if best[find(k)] == J.NO_ID else best[find(k)], links[k]) for k, (i, _) in enumerate(rows)), key=str)


def got(spark, folder):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in J.op10_jaccard_join(spark, folder).collect()), key=str)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert got(spark, folder) == brute(rows)


ROWS = [(3, "a b c"), (1, "a b c"), (None, "a  b c"), (None, None), (5, ""), (7, " "), (2, "x y z q r s t"), (2, "x y z q r s t"), (9, "x y z q r s T"), (10, "lone words here"), (11, "long " * 5000 + "end")]


def test_edges(spark, documents):
    assert got(spark, documents(ROWS)) == brute(ROWS)
    assert got(spark, documents([])) == []


def test_large_group_in_chunks(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(60)) + f" z{i % 40}") for i in range(120)]
    found = J.join(spark.createDataFrame(rows, "doc_id long, text string"), chunk=7).collect()
    assert sorted(((r["id"], r["class_id"], r["n_links"]) for r in found), key=str) == brute(rows)


def test_one_of_each(spark):
    df = spark.createDataFrame([(i, t, "n") for i, t in ROWS], "doc_id long, text string, node string")
    found = J.one_of_each(df)
    assert found.columns == df.columns
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 2, 5, 7, 10, 11]


def test_banding():
    bands, rows = J.bands_and_rows(0.8, 0.999, 160)
    assert bands * rows <= 160 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_clashing_columns_do_not_matter(spark):
    df = spark.createDataFrame([(i, t, 1, "n", i, "c", 2.0) for i, t in ROWS], "doc_id long, text string, id int, node string, rep long, comp string, nid double")
    key = lambda found: sorted(map(str, found.drop("node").collect()))
    assert key(J.join(df)) == key(J.join(df.select("doc_id", "text")))
    assert sorted(map(str, J.one_of_each(df).select("doc_id", "text").collect())) == sorted(map(str, J.one_of_each(df.select("doc_id", "text")).collect()))


def test_production_banding_parts_what_is_not_alike():
    bands, rows = J.bands_and_rows(J.THRESHOLD, J.RECALL, J.HASHES)
    meets = lambda s: 1 - (1 - s**rows) ** bands
    assert meets(J.THRESHOLD) >= J.RECALL and meets(0.4) < 0.03 and meets(0.5) < 0.15


def test_chance_meetings_do_not_chain(spark, monkeypatch):
    """With three hashes a band, strangers meet often; results stay those of brute force and components stay small."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(30)]
    # texts that share a passage of theirs with many others, and some near copies
    rows = [(i, " ".join([*common[(i * 7) % 10 :][:20], *(f"w{i}_{k}" for k in range(rng.randrange(10, 16)))])) for i in range(150)]
    rows += [(1000 + i, t + " tail") for i, t in rows[:40]] + [(2000 + i, t + " tail end") for i, t in rows[:20]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert J.bands_and_rows(0.8, 0.999, 30) == (10, 3)
    sizes = []
    real = J.components

    def watched(edges):
        found = real(edges)
        sizes.append(max((r["count"] for r in found.groupBy("root").count().collect()), default=0) + 1)
        return found

    monkeypatch.setattr(J, "components", watched)
    key = lambda found: sorted(((r["id"], r["class_id"], r["n_links"]) for r in found.collect()), key=str)
    assert key(J.join(df, hashes=30)) == brute(rows)
    parted = sizes[0]
    monkeypatch.setattr(J, "part_buckets", lambda stars, *_: stars.select("nid", "low").toDF("a", "b"))
    assert key(J.join(df, hashes=30)) == brute(rows)
    assert parted < sizes[2] / 3, sizes


def test_parting_loses_no_linked_pair(spark):
    """Stars at random distances on a line, where distance is the difference: every pair within 0.2 stays connected."""
    J.prepare(spark)
    rng = random.Random(2)
    place = {n: rng.random() for n in range(120)}
    stars = [(key, n, min(some)) for key in range(30) for some in [rng.sample(range(120), rng.randrange(2, 9))] for n in some if n != min(some)]
    groups = {}
    for key, n, low in stars:
        groups.setdefault(key, {low}).add(n)

    def similarity(pairs):
        rows = [(r["nid"], r["low"], 1 - abs(place[r["nid"]] - place[r["low"]])) for r in pairs.collect()]
        return J.keep(spark.createDataFrame(rows, "nid long, low long, similarity double"), "s")

    def verified(far):
        groups, out = {}, []
        for r in far.collect():
            groups.setdefault(r["comp"], []).append(r["nid"])
        for some in groups.values():
            root = {n: n for n in some}
            for a in some:
                for b in some:
                    if abs(place[a] - place[b]) <= 0.2:
                        low = min(root[a], root[b])
                        root = {n: low if r in (root[a], root[b]) else r for n, r in root.items()}
            out += root.items()
        return J.keep(spark.createDataFrame(out, "nid long, root long"), "v")

    edges = J.part_buckets(spark.createDataFrame(stars, "key long, nid long, low long"), similarity, verified, 0.8, 1).collect()
    root = list(range(120))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in edges:
        root[find(r["a"])] = find(r["b"])
    for some in groups.values():
        assert all(find(a) == find(b) for a in some for b in some if abs(place[a] - place[b]) <= 0.2)
    assert len(edges) < len(stars)
