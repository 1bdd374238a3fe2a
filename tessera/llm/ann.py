"""Approximate nearest neighbours by a robust-pruned directed graph, largest cosine first.

Method: vectors are dealt to shards of about SHARD by hash; a task builds each shard's graph. Starting from random
edges, greedy searches propose neighbours for batches of points; relaxed distance pruning (a neighbour goes if a nearer
one kept is ALPHA times nearer to it than the point is) keeps DEGREE diverse edges; reverse edges are added and pruned
alike. A query runs a beam search in every shard, and the shards' answers are merged. A shard's graph travels once for
each BLOCK queries, sorted before them, and they stream past it in batches, so memory does not follow their number.

The work is that of one beam for each query and shard. The beam looks at a part of a shard that falls as SHARD grows
(figures in the README); vectors without clusters leave no shard out of the question, so all are asked.

Equal vectors are one node: each distinct vector keeps the NEAREST + 1 least ids that have it, which is all that
any answer can hold, so a vector that a third of all rows share costs no more than another (a partial group limit runs
before the shuffle).

Distances are one less the cosine, in single precision, which cannot order near copies: below CLOSE they are half the
squared length of the difference of unit vectors in double precision, in searches and in pruning. The whole beam is
scored again in double precision on the vectors as given.

Recall against brute force is measured in tests/llm/test_ann.py, which asks for 0.95, and in the README.

Edge cases: null, zero or empty vectors, and those with null or non-finite parts, take no part, neither do rows with a
null id; lengths are taken after scaling by powers of two, so the least and largest doubles count like others; vectors of different lengths are never compared; a repeated id counts once for each of its distinct vectors; fewer candidates than asked
for are all returned; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import keep, prepare, release

#: Beams of the searches that build a graph, and of queries.
NEAREST, DEGREE, BEAM, SEARCH, ALPHA = 5, 32, 64, 96, 1.2
SHARD, BLOCK, BUILD_BATCH = 1 << 14, 1 << 17, 256
#: Below this distance the rounding of single precision is felt.
CLOSE = 2.0**-10


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors, precise however near they are."""
    between = a.astype(np.float64) - b
    return 0.5 * np.einsum("...k,...k->...", between, between)


def _distances(a: np.ndarray, b: np.ndarray, rough_a: np.ndarray, rough_b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of rows i of a and j of b, which are rough_a and rough_b in single precision."""
    out = 1 - np.einsum("ij,ij->i", rough_a[i], rough_b[j])
    close = np.flatnonzero(out < CLOSE)
    if len(close):
        out[close] = _apart(a[i[close]], b[j[close]])
    return out


def beam_search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all queries in step: the beam's points and distances, nearest first, and which points were expanded (a table).

    edges has -1 where a point has fewer. A beam place without a point holds -1 at distance infinity.
    """
    q, n = len(queries), len(points)
    rough, asked = points.astype(np.float32, copy=False), queries.astype(np.float32, copy=False)
    seen, expanded = np.zeros((q, n + 1), bool), np.zeros((q, n), bool)
    seen[:, n] = True
    ids = np.full((q, beam), -1)
    far = np.full((q, beam), np.inf, np.float32)
    ids[:, 0], far[:, 0] = entry, _distances(queries, points, asked, rough, np.arange(q), np.full(q, entry))
    seen[:, entry] = True
    done = np.ones((q, beam), bool)
    done[:, 0] = False
    active = np.arange(q)
    while len(active):
        open_ = np.where(done[active], np.inf, far[active])
        best = np.argmin(open_, 1)
        go = np.isfinite(open_[np.arange(len(active)), best])
        active, best = active[go], best[go]
        if not len(active):
            break
        at = ids[active, best]
        done[active, best] = True
        expanded[active, at] = True
        near = edges[at]
        near = np.where(near < 0, n, near)
        new = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        distance = np.full(near.shape, np.inf, np.float32)
        who, which = np.nonzero(new)
        distance[who, which] = _distances(queries, points, asked, rough, active[who], near[who, which])
        all_far = np.concatenate([far[active], distance], 1)
        all_ids = np.concatenate([ids[active], np.where(new, near, -1)], 1)
        all_done = np.concatenate([done[active], ~new], 1)
        order = np.argsort(all_far, 1, kind="stable")[:, :beam]
        far[active], ids[active], done[active] = (np.take_along_axis(x, order, 1) for x in (all_far, all_ids, all_done))
    return ids, far, expanded


def robust_prune(points: np.ndarray, who: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point of who, up to degree of its candidates (-1: none), nearest first, none that a kept one covers."""
    valid = (candidates >= 0) & (candidates != who[:, None])
    coarse = points.astype(np.float32, copy=False)
    distance = np.where(valid, 1 - np.einsum("ijk,ik->ij", coarse[np.maximum(candidates, 0)], coarse[who]), np.inf)
    row, close = np.nonzero(distance < CLOSE)
    distance[row, close] = _apart(points[candidates[row, close]], points[who[row]])
    # no wider than the most that any point has
    order = np.argsort(distance, 1, kind="stable")[:, : max(1, int(valid.sum(1).max()))]
    distance, candidates = np.take_along_axis(distance, order, 1), np.take_along_axis(candidates, order, 1)
    near = coarse[np.maximum(candidates, 0)]
    between = 1 - near @ near.transpose(0, 2, 1)
    alive = np.isfinite(distance)
    out = np.full((len(who), degree), -1)
    rows = np.arange(len(who))
    for k in range(degree):
        pick = np.argmax(alive, 1)
        some = alive[rows, pick]
        if not some.any():
            break
        out[some, k] = candidates[rows, pick][some]
        here = between[rows, pick]
        row, close = np.nonzero((here < CLOSE) & alive & some[:, None])
        here[row, close] = _apart(points[candidates[row, close]], points[candidates[row, pick[row]]])
        # squared distances are twice these, so alpha holds for their roots by its square
        alive &= ~(some[:, None] & (alpha * alpha * here <= distance))
        alive[rows, pick] = False
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """The graph of unit vectors as a table of edges (-1: none), and where searches start."""
    n = len(points)
    rng = np.random.Generator(np.random.PCG64(17))
    entry = int(np.argmax(points @ points.mean(0)))
    if n <= degree + 1:
        whole = np.tile(np.arange(n), (n, 1))
        return np.where(whole == np.arange(n)[:, None], -1, whole), entry
    edges = rng.integers(0, n, (n, degree))
    edges[edges == np.arange(n)[:, None]] = -1
    for relax in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, BUILD_BATCH):
            who = order[at : at + BUILD_BATCH]
            # when a search ends, all that its beam holds has been expanded
            _, _, expanded = beam_search(points, edges, entry, points[who], beam)
            width = int(expanded.sum(1).max())
            visited = np.argsort(~expanded, 1, kind="stable")[:, :width]
            visited = np.where(np.take_along_axis(expanded, visited, 1), visited, -1)
            edges[who] = robust_prune(points, who, _once(np.concatenate([visited, edges[who]], 1)), degree, relax)
            _reverse(points, edges, who, degree, relax)
    return edges, entry


def _once(candidates: np.ndarray) -> np.ndarray:
    """Each candidate of a row once."""
    ranked = np.sort(candidates, 1)
    ranked[:, 1:][ranked[:, 1:] == ranked[:, :-1]] = -1
    return ranked


def _reverse(points: np.ndarray, edges: np.ndarray, who: np.ndarray, degree: int, alpha: float) -> None:
    """Let the new neighbours of who point back; those with too many edges are pruned."""
    source, place = np.nonzero(edges[who] >= 0)
    target, source = edges[who][source, place], who[source]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    head = np.flatnonzero(np.diff(target, prepend=-1))
    count = np.diff(np.append(head, len(target)))
    for low in range(0, len(head), BUILD_BATCH):
        h, c = head[low : low + BUILD_BATCH], count[low : low + BUILD_BATCH]
        back = np.full((len(h), int(c.max())), -1)
        row = np.repeat(np.arange(len(h)), c)
        back[row, np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)] = source[h[0] : h[-1] + c[-1]]
        both = _once(np.concatenate([edges[target[h]], back], 1))
        fits = (both >= 0).sum(1) <= degree
        left = np.sort(both[fits], 1)[:, ::-1][:, :degree]
        edges[target[h][fits], : left.shape[1]] = left
        edges[target[h][fits], left.shape[1] :] = -1
        over = ~fits
        if over.any():
            edges[target[h][over]] = robust_prune(points, target[h][over], both[over], degree, alpha)


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in lists.chunks]) if lists.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _graph(table: pa.Table) -> pa.Table:
    """A shard's vectors with their edges, by place in the shard; the first row is where searches start."""
    table = table.sort_by("node")
    edges, entry = build(_unit(_scaled(_matrix(table.column("vector")))))
    size = (edges >= 0).sum(1)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(edges[edges >= 0].astype(np.int32)))
    place = np.arange(table.num_rows, dtype=np.int32)
    return pa.table({"shard": table.column("shard"), "place": place, "entry": np.full(table.num_rows, entry, np.int32), "ids": table.column("ids"), "vector": table.column("vector"), "edges": lists})


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows by a power of two, largest part between a half and one: no digit changes, and no square leaves the range of doubles."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None]) if len(x) else x


class _Shard:
    """A shard's graph, ready for queries."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("place")
        self.vectors = _scaled(_matrix(table.column("vector")))
        self.members = table.column("ids").to_pylist()
        self.length = np.sqrt(_dots(self.vectors, self.vectors))
        self.points = _unit(self.vectors)
        self.entry = table.column("entry")[0].as_py()
        lists = table.column("edges").combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        size = pc.list_value_length(lists).to_numpy()
        self.edges = np.full((len(size), max(1, int(size.max()))), -1)
        row = np.repeat(np.arange(len(size)), size)
        self.edges[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()

    def nearest(self, ids: list[int], asked: np.ndarray, nearest: int, beam: int) -> list[tuple[int, int, float]]:
        """query_id, vec_id and score of the nearest found to some queries."""
        asked = _scaled(asked)
        found, _, _ = beam_search(self.points, self.edges, self.entry, _unit(asked), max(beam, nearest + 1))
        own_length, out = np.sqrt(_dots(asked, asked)), []
        for q, own in enumerate(ids):
            near = found[q][found[q] >= 0]
            score = _dots(self.vectors[near], asked[q : q + 1]) / (own_length[q] * self.length[near])
            best = sorted((-s, i) for s, p in zip(score.tolist(), near.tolist(), strict=True) for i in self.members[p] if i != own)[:nearest]
            out += [(own, i, -s) for s, i in best]
        return out


def _search(nearest: int, beam: int, step: int = 256):
    """Queries of each shard and block as they stream past its graph, which comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        shard, at = None, None
        for whole in batches:
            keys = np.stack([whole.column(c).to_numpy() for c in ("shard", "block", "kind")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part, here = whole.slice(a, b - a), tuple(keys[a, :2])
                if here != at:
                    rows, shard, at = [], None, here
                if keys[a, 2] == 0:
                    rows.append(part)
                    continue
                if shard is None and rows:
                    shard, rows = _Shard(pa.Table.from_batches(rows)), []
                for low in range(0, part.num_rows if shard else 0, step):
                    some = part.slice(low, step)
                    out = shard.nearest(some.column("place").to_pylist(), _matrix(pa.chunked_array([some.column("vector")])), nearest, beam)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return run


def usable(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id and vector (array of double) of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", bad))
    return rows.filter(F.exists("vector", lambda x: x != 0))


def index(rows: DataFrame, nearest: int = NEAREST, shard: int = SHARD) -> DataFrame:
    """The graphs of all shards, written: shard, place, entry, ids, vector, edges."""
    limited = rows.distinct().withColumn("k", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).filter(F.col("k") <= nearest + 1)
    nodes = keep(limited.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    n = nodes.groupBy(F.size("vector").alias("d")).count().collect()
    shards = F.coalesce(*[F.when(F.size("vector") == r["d"], F.lit(max(1, -(-r["count"] // shard)))) for r in n], F.lit(1))
    placed = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), shards) * 100_000 + F.size("vector")).withColumn("node", F.col("ids")[0])
    graph = keep(placed.groupBy("shard").applyInArrow(_graph, "shard long, place int, entry int, ids array<long>, vector array<double>, edges array<int>"), "graph")
    release(nodes)
    return graph


def search(graph: DataFrame, queries: DataFrame, nearest: int = NEAREST, beam: int = SEARCH, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest to each row (id, vector) of queries, itself left out."""
    counts = graph.groupBy((F.col("shard") % 100_000).alias("d")).agg(F.max(F.floor(F.col("shard") / 100_000)).alias("last")).collect()
    blocks = max(1, -(-queries.count() // block))
    asked = queries.select(F.col("id").alias("query_id"), "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    # every block of queries meets every shard of its dimension; its graph comes once for a block, the queries stream past
    last = F.coalesce(*[F.when(F.size("vector") == r["d"], F.lit(int(r["last"]))) for r in counts], F.lit(0)).cast("long")
    named = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: i * 100_000 + F.size("vector"))
    asked = asked.select("vector", F.col("query_id").alias("place"), "block", F.explode(named).alias("shard"), F.lit(1).alias("kind"))
    here = graph.withColumn("place", F.col("place").cast("long")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn("kind", F.lit(0))
    both = here.unionByName(asked, allowMissingColumns=True).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind", "place")
    found = both.mapInArrow(_search(nearest, beam), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The five nearest to every vector whose id is divisible by 50."""
    prepare(spark)
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return search(index(rows), rows.filter(F.col("id") % 50 == 0))
