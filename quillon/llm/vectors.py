"""Embedding near-dedup: int8 tile products with rigorous error bounds.

Vectors are compared within equal (label, length).  Identical vectors are one
class with a multiplicity.  The classes of a label are dealt by hash into blocks
of a bounded size, and every pair of blocks is one tile, a task's unit of work.
In a tile the unit vectors u are quantised to int8: u = s * q + e.  With
f = |e| the error of the quantised product is at most
``f_u + (1 + f_u) * f_v`` (Cauchy-Schwarz), so only pairs whose product plus
bound reaches the threshold are computed again in double precision; all others
are rigorously below it.  The int8 products run in float32 in slices of
dimensions that keep every sum an exact integer.

A tile returns, per class with links, the rows it links and one edge to the
smallest id of its part of the link graph; never the pairs.  Edges go through
distributed connected components.

Cases: vectors that are null, empty, zero, or hold null or non-finite
components, and rows with a null label or id, link with nothing and stand alone;
a zero and a negative zero are equal; repeated rows count as further vectors;
ids that repeat with other vectors count as one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components

THRESHOLD = 0.93
BLOCK, MOST_BLOCK = 1024, 8192
SUB, AGAIN = 1024, 20_000
#: Dimensions whose int8 products add up exactly in float32.
EXACT = 2**24 // 127**2


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers (as float32), scales and error norms of unit vectors; the norms are rounded up."""
    s = np.abs(u).max(axis=1) / 127
    q = np.rint(u / s[:, None])
    return q.astype(np.float32), s, np.sqrt(((u - q * s[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a[:, :EXACT] @ b[:, :EXACT].T
    if a.shape[1] > EXACT:
        out = out.astype(np.float64)
        for k in range(EXACT, a.shape[1], EXACT):
            out += a[:, k : k + EXACT] @ b[:, k : k + EXACT].T
    return out


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of x, j of y) with cosine >= threshold; y None: pairs i < j within x."""
    nx = np.sqrt((x * x).sum(axis=1))
    ny = nx if y is None else np.sqrt((y * y).sum(axis=1))
    qx = quantised(x / nx[:, None])
    qy = qx if y is None else quantised(y / ny[:, None])
    z = x if y is None else y
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(x), SUB):
        for j in range(i if y is None else 0, len(z), SUB):
            sx, sy = slice(i, i + SUB), slice(j, j + SUB)
            near = products(qx[0][sx], qy[0][sy]) * qx[1][sx, None] * qy[1][None, sy]
            bound = qx[2][sx, None] + (1 + qx[2][sx, None]) * qy[2][None, sy] + 1e-9
            a, b = np.nonzero(near + bound >= threshold)
            a, b = a + i, b + j
            if y is None and i == j:
                a, b = a[a < b], b[a < b]
            for k in range(0, len(a), AGAIN):
                ka, kb = a[k : k + AGAIN], b[k : k + AGAIN]
                cosine = np.einsum("nd,nd->n", x[ka], z[kb]) / (nx[ka] * ny[kb])
                hit = cosine >= threshold
                found_i.append(ka[hit])
                found_j.append(kb[hit])
    return np.concatenate(found_i), np.concatenate(found_j)


def smallest_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1: the smallest node reached over the edges (i, j)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _tile(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        side, a = t["side"].to_numpy(), t["a"][0].as_py()
        v = t["v"].combine_chunks()
        x = v.flatten().to_numpy().astype(np.float64).reshape(len(side), -1)
        mult = t["mult"].to_numpy()
        if t["b"][0].as_py() == a:
            i, j = tile_links(x, None, threshold)
        else:
            at, bt = np.flatnonzero(side == a), np.flatnonzero(side != a)
            i, j = tile_links(x[at], x[bt], threshold)
            i, j = at[i], bt[j]
        n = len(side)
        links = np.bincount(i, mult[j], n) + np.bincount(j, mult[i], n)
        low = smallest_reached(n, i, j)
        has = np.flatnonzero(links > 0)
        ids = t["id"].to_numpy()
        return pa.table(
            {
                "c1": t["c1"].take(has), "c2": t["c2"].take(has), "a": pa.array(ids[has]),
                "b": pa.array(ids[low[has]]), "links": pa.array(links[has].astype(np.int64)),
            }
        )

    return run


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    ws = Workspace(rows.sparkSession)
    v = rows[vector_col].cast("array<double>")
    fine = F.coalesce(
        rows[id_col].isNotNull() & rows[label_col].isNotNull() & (F.size(v) > 0)
        & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0),
        F.lit(False),
    )
    v = F.transform(v, lambda e: e + 0.0)
    base = rows.select(rows[id_col].alias("vec"), rows[label_col].alias("label"), v.alias("v"), fine.alias("fine"))
    base = base.withColumns({"c1": F.xxhash64("label", "v"), "c2": F.xxhash64(F.lit("vector"), "v", "label")})
    good = base.filter("fine")
    cls = good.groupBy("c1", "c2", "label").agg(F.min("vec").cast("long").alias("id"), F.count("*").alias("mult"), F.first("v").alias("v"))
    cls = ws.put(cls.withColumn("dim", F.size("v")), "classes")
    size = cls.groupBy("label", "dim").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / F.greatest(F.lit(BLOCK), F.least(F.lit(MOST_BLOCK), F.col("n") / 16))).cast("long")
    dealt = cls.join(size.select("label", "dim", blocks.alias("q")), ["label", "dim"]).withColumn("side", F.pmod(F.col("c1"), F.col("q")))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("other"))
    dealt = dealt.select("label", "dim", "c1", "c2", "id", "mult", "v", "side", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"))
    found = ws.put(
        dealt.groupBy("label", "dim", "a", "b").applyInArrow(_tile(threshold), "c1 long, c2 long, a long, b long, links long"), "found"
    )
    comp = components(ws, found.select("a", "b"))
    links = found.groupBy("c1", "c2").agg(F.sum("links").alias("links"))
    whole = cls.select("c1", "c2", "id", "mult").join(links, ["c1", "c2"], "left").join(comp, "id", "left")
    whole = whole.select("c1", "c2", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("comp"))
    keyed = base.select("vec", F.when(F.col("fine"), F.col("c1")).alias("c1"), F.when(F.col("fine"), F.col("c2")).alias("c2"))
    alone = keyed.filter("c1 is null").select("vec", F.lit(0).cast("long").alias("n"), F.col("vec").cast("long").alias("comp"))
    out = keyed.filter("c1 is not null").join(whole, ["c1", "c2"]).select("vec", "n", "comp").union(alone)
    return out.select(
        F.col("vec").alias(id_col), F.col("n").alias("n_links"), F.col("comp").alias("component_id"), F.coalesce(F.col("vec") == F.col("comp"), F.lit(True)).alias("kept")
    )


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB: all pairs of equal label, components by recursion over distinct steps."""
    return f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
f AS MATERIALIZED (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {threshold}),
r AS (SELECT vec_id AS i, vec_id AS c FROM v UNION SELECT p.j, r.c FROM r JOIN p ON p.i = r.i),
m AS (SELECT i, min(c) AS comp FROM r GROUP BY i)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, comp AS component_id, coalesce(v.vec_id = comp, true) AS kept
FROM v LEFT JOIN (SELECT i, count(*) AS n FROM p GROUP BY i) c ON c.i = v.vec_id LEFT JOIN m ON m.i = v.vec_id"""
