"""Centroid clustering: k-means in whole numbers by kd-tree filtering.

Each task deals its vectors into blocks of ``BLOCK`` and builds a kd-tree over each: nodes hold their vectors' count,
integer sums and bounding box.  The trees are written once.  In a round every node starts with its parent's candidates: of
these the one nearest to the box's middle is kept, and any other that is strictly farther from every point of the box
is pruned (in direction of the other centroid the box has one extreme corner, which is tested).  A node with one
candidate is assigned whole; leaves are resolved exactly, ties to the smaller number.  Tasks return sums per
cluster, at most k rows of them; the driver holds the k centroids and nothing else.

All numbers are exact: components are floor(scale * x), distances whole numbers.  A block whose products fit
into the 53 bits of a double uses matrix products, any other 64-bit whole numbers.

Cases: a vector counts when it has exactly ``dims`` components, none of them null or non-finite, and none with a scaled size of
2^26 or more (whose squared distances don't fit into 64 bits); others have no row.  Fewer vectors than k: as many
centroids; no vector: no row.  Rows with a null id are clustered but start no centroid unless others are too few; rows
that repeat are further vectors, also as first centroids (ids that repeat with other vectors are ordered by those).  Ties of
distance go to the smaller number.  Copies of one vector make a node of any size with a box of one point, which is resolved
at once.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

DIMS, SCALE, K, ROUNDS, SEED = 64, 256, 40, 5, "2:"
#: Vectors of a tree, and of a leaf; the size from which on scaled components are left out.
BLOCK, LEAF, MOST = 8192, 32, 1 << 26


class Tree:
    """A kd-tree over rows of ``x`` (put in order ``order``): nodes as arrays, children after their parents."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        spans, left, todo = [(0, len(x))], [], [0]
        while todo:
            node = todo.pop()
            a, b = spans[node]
            part = x[self.order[a:b]]
            wide = part.max(axis=0) - part.min(axis=0)
            d = int(wide.argmax())
            left.extend([-1] * (len(spans) - len(left)))
            if b - a <= LEAF or wide[d] == 0:
                continue
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(part[:, d], half)]
            left[node] = len(spans)
            todo += [len(spans), len(spans) + 1]
            spans += [(a, a + half), (a + half, b)]
        left.extend([-1] * (len(spans) - len(left)))
        self.x = x[self.order]
        self.lo, self.hi = np.array(spans, np.int64).T
        self.left = np.array(left, np.int64)
        total = np.concatenate((np.zeros((1, x.shape[1]), np.int64), np.cumsum(self.x, axis=0)))
        self.sums = total[self.hi] - total[self.lo]
        self.low = np.array([self.x[a:b].min(axis=0) for a, b in spans])
        self.high = np.array([self.x[a:b].max(axis=0) for a, b in spans])


ARRAYS = ("x", "lo", "hi", "left", "sums", "low", "high")
BLOCKS = "ids array<long>, " + ", ".join(f"{a} binary" for a in ARRAYS)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of c, exactly."""
    most = 2 * max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if x.shape[1] * most * most < 2**53:
        cross = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    else:
        cross = x @ c.T
    return (x * x).sum(axis=1)[:, None] - 2 * cross + (c * c).sum(axis=1)[None]


def survivors(low: np.ndarray, high: np.ndarray, c: np.ndarray, may: np.ndarray) -> np.ndarray:
    """Of the candidates ``may`` (box, centroid): those that are not strictly dominated."""
    far = np.iinfo(np.int64).max
    best = np.where(may, squared(low + high, 2 * c), far).argmin(axis=1)
    keep = may.copy()
    for z in np.flatnonzero(may.any(axis=0)):
        at = np.flatnonzero(may[:, z] & (best != z))
        step = c[z] - c[best[at]]
        corner = np.maximum(step * low[at], step * high[at]).sum(axis=1)  # of the box, the farthest towards z
        keep[at, z] = (step * (c[z] + c[best[at]])).sum(axis=1) <= 2 * corner
    return keep


def assign(t: Tree, c: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The cluster of each vector (in the tree's order), and (node, cluster) of the nodes assigned whole; the rest are leaves."""
    out = np.full(len(t.x), -1, np.int64)
    whole = []
    nodes, may = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
    while len(nodes):
        may = survivors(t.low[nodes], t.high[nodes], c, may)
        one = may.sum(axis=1) == 1
        for n, z in zip(nodes[one].tolist(), may[one].argmax(axis=1).tolist(), strict=True):
            out[t.lo[n] : t.hi[n]] = z
            whole.append((n, z))
        end = ~one & (t.left[nodes] < 0)
        if end.any():
            size = t.hi[nodes[end]] - t.lo[nodes[end]]
            rows = np.repeat(t.lo[nodes[end]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            out[rows] = np.where(np.repeat(may[end], size, axis=0), squared(t.x[rows], c), np.iinfo(np.int64).max).argmin(axis=1)
        down = ~one & ~end
        nodes, may = np.repeat(t.left[nodes[down]], 2), np.repeat(may[down], 2, axis=0)
        nodes[1::2] += 1
    return out, whole


def _build(dims: int, scale: int):
    """(id, vector) to BLOCKS."""

    def made(ids: list, x: list[np.ndarray]) -> pa.RecordBatch:
        t = Tree(np.concatenate(x))
        ids = pa.concat_arrays(ids).take(pa.array(t.order))
        cols = [pa.array([ids.to_pylist()], pa.list_(pa.int64())), *[pa.array([getattr(t, a).astype("<i8").tobytes()], pa.binary()) for a in ARRAYS]]
        return pa.RecordBatch.from_arrays(cols, names=["ids", *ARRAYS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, held = [], [], 0
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            x = np.floor(x * scale).astype(np.int64)
            at = 0
            while at < len(x):
                n = min(BLOCK - held, len(x) - at)
                ids.append(batch.column(0).slice(at, n))
                xs.append(x[at : at + n])
                held, at = held + n, at + n
                if held == BLOCK:
                    yield made(ids, xs)
                    ids, xs, held = [], [], 0
        if held:
            yield made(ids, xs)

    return run


def _trees(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for r in range(batch.num_rows):
            t = Tree.__new__(Tree)
            for a in ARRAYS:
                v = np.frombuffer(batch.column(a)[r].as_buffer(), "<i8")
                setattr(t, a, v if a in ("lo", "hi", "left") else v.reshape(-1, dims))
            yield batch.column("ids")[r].values, t


def _sums(c: np.ndarray):
    """BLOCKS to (cluster, n, sums): a row for each cluster and task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(c), np.int64), np.zeros_like(c)
        for _, t in _trees(batches, c.shape[1]):
            at, whole = assign(t, c)
            rest = np.ones(len(at), bool)
            for node, z in whole:
                n[z] += t.hi[node] - t.lo[node]
                total[z] += t.sums[node]
                rest[t.lo[node] : t.hi[node]] = False
            np.add.at(n, at[rest], 1)
            np.add.at(total, at[rest], t.x[rest])
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(n[has]), pa.array(total[has].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _labels(c: np.ndarray):
    """BLOCKS to (id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, t in _trees(batches, c.shape[1]):
            at, _ = assign(t, c)
            d = t.x - c[at]
            yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), pa.array((d * d).sum(axis=1))], names=["id", "cluster", "distance"])

    return run


def centroids(blocks: DataFrame, c: np.ndarray, rounds: int) -> np.ndarray:
    """``c`` after the rounds over BLOCKS; empty clusters stay."""
    dims = c.shape[1]
    for _ in range(rounds):
        part = blocks.mapInArrow(_sums(c), "cluster long, n long, sums array<long>")
        got = part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[d].cast("decimal(20,0)")).alias(f"s{d}") for d in range(dims)])
        new = c.copy()
        for r in got.collect():  # k rows at most
            new[r["cluster"]] = [int(r[f"s{d}"]) // r["n"] for d in range(dims)]
        c = new
    return c


def cluster_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED
) -> DataFrame:
    """One row per vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid (its components)."""
    ws = Workspace(rows.sparkSession)
    v = rows[vector_col].cast("array<double>")
    fine = (F.size(v) == dims) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | ((F.abs(e * scale) >= MOST)))
    base = rows.filter(F.coalesce(fine, F.lit(False))).select(rows[id_col].cast("long").alias("id"), v.alias("v"))
    first = base.withColumn("h", F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)).orderBy(F.col("h").asc_nulls_last(), "id", "v").limit(k)
    c = np.floor(np.array([r["v"] for r in first.collect()], np.float64).reshape(-1, dims) * scale).astype(np.int64)
    blocks = ws.put(base.mapInArrow(_build(dims, scale), BLOCKS), "blocks")
    if len(c):
        c = centroids(blocks, c, rounds)
    out = ws.put(blocks.mapInArrow(_labels(c), "id long, cluster int, distance long"), "labels")
    # a distance is below 2^63; sums of them may not be
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()  # k rows at most
    whole = sum(int(r["s"]) for r in sums)
    fits = lambda x: x if x < 2**63 else None
    told = [(r["cluster"], fits(int(r["s"])), fits(whole), hashlib.sha256(",".join(map(str, c[r["cluster"]])).encode()).hexdigest(), c[r["cluster"]].tolist()) for r in sums]
    told = rows.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    out = out.join(F.broadcast(told), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def oracle(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> str:
    """DuckDB: brute force over all vectors and centroids, each round a few steps."""
    d2 = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, b.j AS j, b.d AS d FROM (SELECT r, min({{'d': d, 'j': j}}) AS b FROM (SELECT v.r, c.j, {d2} AS d FROM v, c{i} c) GROUP BY r))")
        if i < rounds:
            steps.append(
                f"s{i} AS MATERIALIZED (SELECT j, list(m ORDER BY p) AS x FROM (SELECT j, p, (sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM "
                f"(SELECT a.j, unnest(range(1, {dims + 1})) AS p, unnest(v.x) AS e FROM a{i} a JOIN v ON v.r = a.r) GROUP BY j, p) GROUP BY j),\n"
                f"c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(s.x::BIGINT[], c.x) AS x FROM c{i} c LEFT JOIN s{i} s ON s.j = c.j)"
            )
    between = ",\n".join(steps)
    return f"""
WITH f AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
v AS MATERIALIZED (SELECT r, vec_id, e, list_transform(e, lambda x: floor({scale} * x)::BIGINT) AS x FROM f
  WHERE len(e) = {dims} AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x) OR abs({scale} * x) >= {MOST})) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id) NULLS LAST, vec_id, e) - 1 AS j, x FROM v QUALIFY j < {k}),
{between},
l AS (SELECT j, sum(d) AS s FROM a{rounds} GROUP BY j)
SELECT v.vec_id, a.j::INTEGER AS cluster, a.d AS distance, l.s::BIGINT AS cluster_inertia, (SELECT sum(s) FROM l)::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a ON a.r = v.r JOIN l ON l.j = a.j JOIN c{rounds} c ON c.j = a.j"""
