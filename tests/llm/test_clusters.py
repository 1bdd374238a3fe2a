"""Delta Lloyd against plain Lloyd in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from tessera.llm import clusters

DIMS = 64


def _plain(rows, k=16, rounds=3):
    """Every round over every vector and centroid, on Python integers."""
    kept = [(i, [math.floor(64 * float(e)) for e in v]) for i, v in rows if v is not None and len(v) == DIMS and all(e is not None and math.isfinite(e) for e in v)]
    named = sorted(kept, key=lambda r: ("~" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in named[:k]]
    for i in range(rounds + 1):
        told = [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids)) for _, x in kept]
        if i < rounds:
            for j in range(len(centroids)):
                own = [x for (_, x), (_, o) in zip(kept, told, strict=True) if o == j]
                if own:
                    centroids[j] = [sum(e) // len(own) for e in zip(*own, strict=True)]
    each = {}
    for d, j in told if kept else ():
        each[j] = each.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), j, d, each[j], sum(each.values()), digest[j]) for (i, _), (d, j) in zip(kept, told if kept else (), strict=True))


@pytest.fixture
def embeddings(spark, tmp_path):
    def make(rows, schema="vec_id long, embedding array<double>"):
        folder = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
        return folder

    return make


def _run(spark, folder):
    df = clusters.op12_centroid_clustering(spark, folder)
    assert df.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((str(r["vec_id"]), *r[1:6]) for r in df.collect())


def test_same_as_plain_rounds(spark, embeddings):
    rng = np.random.default_rng(3)
    centre = rng.normal(0, 2, (5, DIMS))
    rows = [(i, (centre[i % 5] + rng.normal(0, 1, DIMS)).tolist()) for i in range(300)]
    # copies of one vector, repeated rows and ids, a null id, and vectors on a coarse grid, which tie
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + rows[:20] + [(5, rows[6][1]), (None, rows[7][1])]
    rows += [(2000 + i, rng.integers(-1, 2, DIMS).astype(float).tolist()) for i in range(60)]
    assert _run(spark, embeddings(rows)) == _plain(rows)


def test_rows_that_take_no_part(spark, embeddings):
    one = [0.5] * DIMS
    rows = [(1, one), (2, None), (3, [0.5] * 63), (4, [*one[1:], None]), (5, [*one[1:], math.nan]), (6, [*one[1:], -math.inf]), (7, [-0.01] * DIMS), (8, [])]
    assert _run(spark, embeddings(rows)) == _plain(rows)
    assert _run(spark, embeddings([])) == []
    assert _run(spark, embeddings([(9, [1e9] * DIMS), (1, one)])) == _plain([(1, one)])


def test_extra_columns_and_large_parts(spark, embeddings):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(0, 1e5, DIMS)).tolist(), i, "x") for i in range(40)]
    assert _run(spark, embeddings(rows, "vec_id long, embedding array<double>, owner int, x string")) == _plain([r[:2] for r in rows])
    rows = [(i, rng.uniform(-2e6, 2e6, DIMS).tolist()) for i in range(40)]
    assert _run(spark, embeddings(rows)) == _plain(rows)


def test_only_what_moved_is_compared():
    rng = np.random.default_rng(7)
    x, c = rng.integers(-50, 50, (500, 8)), rng.integers(-50, 50, (20, 8))
    all_ = np.ones(20, bool)
    owner, distance = clusters.reassign(x, np.full(500, -1), np.zeros(500, np.int64), c, all_)
    for _ in range(5):
        moved = rng.random(20) < 0.3
        c = np.where(moved[:, None], c + rng.integers(-9, 10, c.shape), c)
        owner, distance = clusters.reassign(x, owner, distance, c, moved)
        want = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (owner == want.argmin(1)).all() and (distance == want.min(1)).all()


def test_bound():
    with pytest.raises(ValueError, match="bound"):
        clusters.lloyd(None, 1 << 20, 1, 64)
