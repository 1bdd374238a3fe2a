"""Centroid clustering: exact Lloyd rounds on integer vectors, whose later rounds do only what changed.

Method: delta Lloyd. Every vector's owner and its distance are written in each round, and the sums of all vectors of
each centroid are kept. A round compares a vector with the centroids that moved only, as the others are as far as
before and were no nearer than its owner; a vector whose owner itself moved is compared with all. What changed hands
is then added up: a vector counts positively for its new owner and negatively for the one before, first inside each
task, then by a shuffle of (centroid, component) sums. Vectors are never shuffled or collected: the driver sees the
starting vectors and k * (dims + 1) sums a round. k * dims is bounded by MOST, as the centroids travel with the tasks.

All arithmetic is on integers: a component x becomes floor(scale * x), a centroid the componentwise floor of its mean.

Edge cases: null vectors, those of another length and those with a null or non-finite part take no part, neither do
those with a part of LIMIT / scale or more, whose squared distances a long cannot hold; a row with a null id takes part,
and starts a centroid only if too few other rows are there; repeated rows count each; equal distances go to the smaller
number; with fewer vectors than centroids there are as many centroids as vectors; a centroid without vectors stays
where it is; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep, prepare, release

CENTROIDS, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
#: Integer parts stay below this, so 64 squared differences stay below 2**62.
LIMIT = 1 << 27
#: Components of all centroids together, 32 MB.
MOST = 1 << 22
#: Below this, sums of 64 products are exact in doubles, whose matrix product is the faster one.
_EXACT = 1 << 22


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, exact."""
    dims = x.shape[1]
    most = max((int(np.abs(a).max()) for a in (x, centroids) if a.size), default=0)
    kind = np.float64 if dims * 4 * most * most < 1 << 53 and most < _EXACT else np.int64
    a, c = x.astype(kind), centroids.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)


def reassign(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after the centroids marked in moved have moved; an owner of -1 is none yet."""
    owner, distance = owner.copy(), distance.copy()
    lost = (owner < 0) | moved[owner]
    rows = np.flatnonzero(lost)
    if len(rows):
        far = squared(x[rows], centroids)
        owner[rows] = far.argmin(1)  # the smaller number of several
        distance[rows] = far.min(1)
    rows, who = np.flatnonzero(~lost), np.flatnonzero(moved)
    if len(rows) and len(who):
        far = squared(x[rows], centroids[who])
        near, least = who[far.argmin(1)], far.min(1)
        better = (least < distance[rows]) | ((least == distance[rows]) & (near < owner[rows]))
        owner[rows[better]], distance[rows[better]] = near[better], least[better]
    return owner, distance


_STATE = "vec_id long, x array<int>, owner int, distance long, before int"
_ARROW = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int32())), ("owner", pa.int32()), ("distance", pa.int64()), ("before", pa.int32())])


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(-1, dims).astype(np.int64)


def _round(centroids: np.ndarray, moved: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, before = batch.column("x"), batch.column("owner").to_numpy()
            owner, distance = reassign(_matrix(x, centroids.shape[1]), before, batch.column("distance").to_numpy(), centroids, moved)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), x.cast(_ARROW.field("x").type), pa.array(owner, pa.int32()), pa.array(distance), pa.array(before, pa.int32())], schema=_ARROW)

    return run


def _transfers(k: int, dims: int):
    """The signed sums of a task's vectors that changed hands; place -1 counts them."""
    schema = pa.schema([("centroid", pa.int32()), ("place", pa.int32()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            x = np.concatenate([np.ones((len(x), 1), np.int64), x], 1)
            owner, before = batch.column("owner").to_numpy(), batch.column("before").to_numpy()
            np.add.at(total, owner, x)
            np.subtract.at(total, before[before >= 0], x[before >= 0])
        centroid, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(centroid, pa.int32()), pa.array(place - 1, pa.int32()), pa.array(total[centroid, place])], schema=schema)

    return run


def vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and x (array of int) of the rows that take part."""
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    # no comparison holds for a NaN but this one: it is the greatest double
    bad = lambda e: e.isNull() | (F.abs(e) >= F.lit(LIMIT / scale))
    rows = rows.filter((F.size("v") == dims) & ~F.exists("v", bad))
    return rows.select("vec_id", F.transform("v", lambda e: F.floor(e * F.lit(float(scale))).cast("int")).alias("x"))


def lloyd(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, x, owner and distance of each of the rows (vec_id, x) after so many rounds, a kept table, and the centroids."""
    if k * dims > MOST:
        raise ValueError(f"{k} centroids of {dims} components are over the bound of {MOST}")
    spark = rows.sparkSession
    prepare(spark)
    named = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    start = rows.orderBy(named.asc_nulls_last(), "x").limit(k).select("x").collect()
    centroids = np.array([r["x"] for r in start], np.int64).reshape(-1, dims)
    state = rows.withColumns({"owner": F.lit(-1), "distance": F.lit(0).cast("long")})
    if not len(centroids):
        return state.select("vec_id", "x", "owner", "distance"), centroids
    sums = np.zeros((len(centroids), dims + 1), np.int64)
    moved, last = np.ones(len(centroids), bool), None
    for i in range(rounds + 1):
        state = keep(state.select("vec_id", "x", "owner", "distance").mapInArrow(_round(centroids, moved), _STATE), "assigned")
        if last is not None:
            release(last)
        last = state
        if i == rounds:
            break
        handed = state.filter("owner != before").select("x", "owner", "before").mapInArrow(_transfers(len(centroids), dims), "centroid int, place int, total long")
        for r in handed.groupBy("centroid", "place").agg(F.sum("total").alias("total")).collect():
            sums[r["centroid"], r["place"] + 1] += r["total"]
        following = np.where(sums[:, :1] > 0, np.floor_divide(sums[:, 1:], np.maximum(sums[:, :1], 1)), centroids)
        moved, centroids = (following != centroids).any(1), following
    return state.drop("before"), centroids


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    """Every vector's cluster after three rounds of sixteen centroids."""
    found, centroids = lloyd(vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    per = found.groupBy("owner").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row for each centroid at most
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = [(r["owner"], r["cluster_inertia"], sum(x["cluster_inertia"] for x in per), digest[r["owner"]]) for r in per]
    named = spark.createDataFrame(told, "owner int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = found.join(F.broadcast(named), "owner")
    return joined.select("vec_id", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
