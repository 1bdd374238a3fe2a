"""Fingerprints and components against plain Python over all pairs."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from tessera.llm import simhash


def _fingerprint(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))] if found else []
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _plain(rows):
    fp = [_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).extend([d] if d is not None else [])
    return sorted((str(d), f"{fp[i]:016x}", min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows))


def _run(spark, folder):
    return sorted((str(a), b, c) for a, b, c in (r[:3] for r in simhash.op13_simhash_dedup(spark, folder).collect()))


def test_same_as_all_pairs(spark, documents):
    rng = np.random.default_rng(2)
    base = [" ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "É", "x1", "日本"], 400)) for _ in range(6)]
    rows = []
    for text in base:
        for _ in range(25):
            w = text.split(" ")
            for _ in range(rng.integers(0, 3)):
                w[rng.integers(len(w))] = f"new{rng.integers(1000)}"
            rows.append((len(rows) * 3, rng.choice([" ", "\n", "\t \x0b"]).join(w)))
    rows += [(700, None), (701, ""), (702, " \n"), (703, "one"), (704, "ONE"), (705, "one two three"), (706, "one two three four"), (706, "one two three four")]
    rows += [(None, base[0]), (None, "only here with no id"), (800, "a b c"), (801, "a b c"), (900, "same words here again " * 3000)]
    assert _run(spark, documents(rows)) == _plain(rows)


def test_empty_and_extra_columns(spark, documents):
    assert _run(spark, documents([])) == []
    rows = [(1, "a b c d e", 5, 6), (2, "a b c d e", 7, 8)]
    assert _run(spark, documents(rows, "doc_id long, text string, fp long, id long")) == _plain([r[:2] for r in rows])


def test_the_code_is_perfect():
    every = np.arange(1 << 23)
    index = simhash.decode(every)
    assert (np.bincount(index) == 2048).all() and len(np.unique(index)) == 4096
    # no word is farther than three bits from the codeword of its index
    codewords = every[simhash._ERROR[simhash._LOW[every & 4095] ^ simhash._HIGH[every >> 12]] == 0]
    of = np.zeros(4096, np.int64)
    of[codewords >> 11] = codewords
    assert np.bitwise_count(every ^ of[index]).max() == 3


@settings(max_examples=200, deadline=None)
@given(x=st.integers(0, (1 << 64) - 1), flips=st.sets(st.integers(0, 63), max_size=4))
def test_near_fingerprints_share_a_key(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    keys, place = simhash.near_keys(np.array([x, y], np.uint64))
    assert set(keys[place == 0]) & set(keys[place == 1])
    assert all(len(set(keys[place == i])) == (place == i).sum() for i in (0, 1))


def test_keys_are_what_two_flips_reach():
    """The table of errors gives what flipping any two bits and decoding does."""
    rng = np.random.default_rng(1)
    for x in rng.integers(0, 1 << 63, 5).tolist():
        flips = [0, *(1 << i for i in range(64))]
        near = np.array(sorted({x ^ a ^ b for a in flips for b in flips}), np.uint64)
        parts = [simhash.decode((near >> np.uint64(f) & np.uint64((1 << n) - 1)).astype(np.int64)) << 12 * k for k, (f, n) in enumerate(simhash.SEGMENTS)]
        assert set(simhash.near_keys(np.array([x], np.uint64))[0].tolist()) == set((parts[0] | parts[1] | parts[2]).tolist())


def test_number_of_keys():
    keys, place = simhash.near_keys(np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64))
    print(len(keys) / 20_000, np.bincount(place).max())
    assert 80 < len(keys) / 20_000 < 130 and np.bincount(place).max() <= 150


def _components(pairs, values):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        root[find(a)] = find(b)
    return {v: find(v) for v in values}


def _classes(told):
    by = {}
    for v, r in told.items():
        by.setdefault(r, set()).add(v)
    return {frozenset(c) for c in by.values()}


def test_links_in_large_groups_and_chunks(spark):
    """Dense groups, chains of links and random strangers, with a chunk of 64 and the production one."""
    rng = np.random.default_rng(4)
    values = set(rng.integers(-(1 << 63), 1 << 63, 1500).tolist())
    for _ in range(3):
        x = int(rng.integers(0, 1 << 62))
        for _ in range(400):
            y = x
            for b in rng.choice(63, rng.integers(0, 4), replace=False):
                y ^= 1 << int(b)
            values.add(y)
        for _ in range(60):
            for b in rng.choice(63, 4, replace=False):
                x ^= 1 << int(b)
            values.add(x)
    values = sorted(values)
    v = np.array(values).view(np.uint64)
    want = [(values[i], values[j]) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v[i] ^ v) <= 4)]
    want = _classes(_components(want, values))
    df = spark.createDataFrame([(x,) for x in values], "fp long")
    simhash.prepare(spark)
    for chunk in (64, simhash.CHUNK):
        got = [(r["a"], r["b"]) for r in simhash.links(df, chunk=chunk).collect()]
        assert len(got) < 40 * len(values)
        assert _classes(_components(got, values)) == want
