"""N-gram Jaccard join through count-vector R-trees.

A document is the set of its hashed word shingles.  Its point is the vector of
counts of the set's members in hash groups (the power of 2 from the set's size
on); points of other lengths are folded onto the shorter one.  The sum of the
smaller counts of two points bounds the overlap of two sets from above, and so
does the sum over a tree node's largest counts for all points of the node.

1. One pass makes per document the set's size, a 128-bit digest and the point;
   equal sets become one class (the smallest id stands for it).
2. Who can meet at all: sets of Jaccard similarity >= t share a member of their
   prefixes (the first n - ceil(t n) + 1 members in any one global order).  The
   order takes members of frequent sketch cells last; the sketch counts all
   documents, has a fixed size (``CELLS``), and affects the cost only.  Token
   groups of the same members (told by their count, smallest id and two 64-bit
   sums of id hashes) would give the same pairs: one of them stays.
3. Star round: in every group ``HUBS`` classes at most (by hashes of their ids)
   are compared by points with all members of the group.  Pairs of hubs that may
   link, and each other member's best hub, are verified on the sets; the links
   give components.  Groups of ``HUBS`` members or fewer are
   done with this: all their members are hubs.
4. Tree rounds: larger groups that still hold several components are dealt into
   blocks of bounded size, by size class (steps of 1 / t) and hash where a group
   is larger than ``TILE``; only blocks of the same or of neighbouring size
   classes meet.  In each such tile R-trees over the points are joined, skipping
   pairs of one component; what survives meets the same bound once more with the
   whole points, then verification.  A row first tries its best pairs with each
   other component, ``FIRST_TRIES`` of them; groups of which pairs were left have
   further rounds with ``MORE_TRIES`` times as many between components that are
   still apart, until none is left.
5. Components over the verified links of all rounds.

A pair that links is either joined by a path of links already found or is met in
step 4, so the components are exact, up to collisions of 64-bit shingle hashes
and 128-bit digests; large groups of near copies cost about one verification per
document.  A verification brings the set of each document with a candidate to its
pairs by two equi-joins (a hub of many pairs is a skewed join, which is split).
Bloom filters (two bits a key, of at most ``MOST_BLOOM`` bits) keep tokens of a
single class and sets of documents without a candidate from being shuffled; a full
filter would only cost time.

Cases: null or wordless texts have an empty set, link with nothing and are their
own component; fewer words than a shingle make one short shingle; ids must be
whole numbers, rows with a null id get null components, rows that repeat an id
with other texts are judged by their own sets, which meet where both go by that id; very long texts are whole sets with
longer points; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, arrow_rows, components, fitted
from .lines import row_key
from .shingles import chunks, mix, shingle_sets

NUM, DEN = 80, 100
#: Least and most groups of a point; groups of the points in a tree.
GROUPS, MOST_GROUPS, TREE_GROUPS = 64, 1 << 20, 512
#: Cells of the frequency sketch, and most bits of a Bloom filter (32 MB).
CELLS, MOST_BLOOM, PARTS = 1 << 21, 1 << 28, 128
TILE, LEAF, FAN = 1024, 32, 8
HUBS = 6
#: Pairs of a row with another component that the first tree pass verifies; the factor of each further pass.
FIRST_TRIES, MORE_TRIES = 2, 8
#: Bytes of points that a task holds before it joins the tiles at hand.
TILE_BYTES = 16_000_000
#: Rows of an Arrow batch; rows with a set or a point, or with neither, for which a step has a task.
ROWS = 1000
WIDE, NARROW = 2000, 20_000


def prefix_length(n: int) -> int:
    return n + (-NUM * n // DEN) + 1


def links(inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """inter / union >= NUM / DEN, in whole numbers; also true for upper bounds of inter that may link."""
    return DEN * inter >= NUM * (a + b - inter)


def groups_of(n: int) -> int:
    """Groups of the point of n members: the power of 2 from n on, within bounds."""
    return min(MOST_GROUPS, max(GROUPS, 1 << (n - 1).bit_length()))


def point(s: np.ndarray) -> bytes:
    """Counts in hash groups: the item's size, then the items compressed."""
    k = groups_of(len(s))
    c = np.bincount((s & np.uint64(k - 1)).astype(np.intp), minlength=k)
    size = 1 if c.max() < 256 else 2 if c.max() < 65536 else 4
    return bytes([size]) + zlib.compress(c.astype(f"<u{size}").tobytes(), 1)


def counts(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x[1:]), f"<u{x[0]}")


def folded(c: np.ndarray, k: int) -> np.ndarray:
    return c if len(c) == k else c.reshape(-1, k).sum(axis=0, dtype=np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Sum of the smaller counts of two points."""
    k = min(len(a), len(b))
    return int(np.minimum(folded(a, k), folded(b, k)).sum(dtype=np.int64))


def _dense(a: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A fixed-size array as PARTS rows (part, bytes)."""
    step = len(a) // PARTS
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(PARTS), pa.int32()), pa.array([a[k * step : (k + 1) * step].tobytes() for k in range(PARTS)], pa.binary())], names=["part", "bytes"]
    )


def summed(rows: DataFrame) -> np.ndarray:
    """Element-wise sum of all tasks' sketches; only the fixed-size result reaches the driver."""

    def run(t: pa.Table) -> pa.Table:
        total = np.zeros(CELLS // PARTS, "<u8")
        for x in t["bytes"]:
            total += np.frombuffer(x.as_buffer(), "<u2")
        return pa.table({"part": t["part"][:1], "bytes": pa.array([total.tobytes()], pa.binary())})

    total = fitted(rows.groupBy("part").applyInArrow(run, "part int, bytes binary"), rows.count(), WIDE)
    got = {r["part"]: r["bytes"] for r in total.collect()}
    return np.concatenate([np.frombuffer(got[k], "<u8") for k in range(PARTS)]) if got else np.zeros(CELLS, "<u8")


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(11))
    m = np.uint64(bits - 1)
    return [(h & m).astype(np.int64), (h >> np.uint64(32) & m).astype(np.int64)]


def bloom(keys: DataFrame, n: int | None = None) -> np.ndarray:
    """Packed Bloom filter of the one column of ``keys`` (long), which may repeat; its size follows their number ``n`` (else counted) up to MOST_BLOOM bits."""
    n = keys.count() if n is None else n
    bits = min(MOST_BLOOM, max(1 << 16, 1 << (16 * n).bit_length()))
    width = bits // PARTS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.unique(np.concatenate(_places(batch.column(0).to_numpy(), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((p // width).astype(np.int32)), pa.array((p % width).astype(np.int32))], names=["part", "p"])

    def build(t: pa.Table) -> pa.Table:
        on = np.zeros(width, bool)
        on[t["p"].to_numpy()] = True
        return pa.table({"part": t["part"][:1], "bytes": pa.array([np.packbits(on).tobytes()], pa.binary())})

    placed = keys.mapInArrow(place, "part int, p int").groupBy("part").applyInArrow(build, "part int, bytes binary")
    out = np.zeros((PARTS, width // 8), np.uint8)
    for r in fitted(placed, 2 * n, NARROW).collect():
        out[r["part"]] = np.frombuffer(r["bytes"], np.uint8)
    return out.ravel()


def maybe_in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    p, q = _places(keys, 8 * len(bits))
    return ((bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & (bits[q >> 3] >> (7 - (q & 7)).astype(np.uint8)) & 1).astype(bool)


FIRST = "doc_id long, n long, k1 long, k2 long, vec binary, r1 long, r2 long, part int, bytes binary"


def with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes], pa.RecordBatch]]:
    """As ``chunks``, with the further columns of the rows."""
    held: list[pa.RecordBatch] = []

    def noted() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held.append(batch)
            yield batch

    at = 0
    for ids, raws in chunks(noted()):
        if at == held[0].num_rows:
            held.pop(0)
            at = 0
        while held[0].num_rows == 0:
            held.pop(0)
        yield ids, raws, held[0].slice(at, len(ids)).select(list(range(2, held[0].num_columns)))
        at += len(ids)


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros(CELLS, np.int64)
    names = [f.strip().split()[0] for f in FIRST.split(",")]
    for ids, raws, keys in with_keys(batches):
        sets = shingle_sets(raws)
        digest = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8") for s in sets]
        n = len(ids)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([int(d[0]) for d in digest], pa.int64()), pa.array([int(d[1]) for d in digest], pa.int64()),
                pa.array([point(s) if len(s) else None for s in sets], pa.binary()), *keys.columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
            ],
            names=names,
        )
        sketch += np.bincount((np.concatenate(sets) >> np.uint64(20)).astype(np.int64) & (CELLS - 1), minlength=CELLS)
    for b in _dense(np.minimum(sketch, 65535).astype("<u2")):
        empty = [*[pa.nulls(PARTS, pa.int64())] * 4, pa.nulls(PARTS, pa.binary()), *[pa.nulls(PARTS, pa.int64())] * 2]
        yield pa.RecordBatch.from_arrays([*empty, b.column(0), b.column(1)], names=names)


def _prefixes(late, only=None):
    """Rows (token, k1) of every document's prefix.

    late: broadcast rank of each cell's frequency, 0 for most; only: broadcast filter of the tokens to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raws in chunks(batches):
            tokens, keys, count, late_of = [], [], [], late.value
            for s in shingle_sets(raws):
                if not len(s):
                    continue
                cls = late_of[(s >> np.uint64(20)).astype(np.int64) & (CELLS - 1)]
                o = s[np.argsort(cls, kind="stable")] if cls.any() else s
                o = o[: prefix_length(len(s))]
                tokens.append(o)
                count.append(len(o))
                keys.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8")[0])
            if tokens:
                token, key = np.concatenate(tokens).view(np.int64), np.repeat(np.array(keys, np.int64), count)
                if only is not None:
                    fits = maybe_in(only.value, token)
                    token, key = token[fits], key[fits]
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(key)], names=["token", "k1"])

    return run


def tree_pairs(vec: np.ndarray, size: np.ndarray, comp: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose count vectors allow a link, of different components (and sides).

    A packed R-tree: points by size, then by their most varied coordinate, LEAF to a
    leaf, FAN to a node; nodes keep the largest count per coordinate and the range of
    sizes.  Pairs of nodes are dropped when the bound of their points can't link.
    """
    m = len(vec)
    order = np.arange(m)
    if m > LEAF:
        wide = vec.var(axis=0).argmax()
        order = np.lexsort((vec[:, wide], np.argsort(np.argsort(size, kind="stable")) // (LEAF * FAN)))
    v, s, c = vec[order], size[order], comp[order]
    d = None if side is None else side[order]
    levels = []
    hi, lo, top = v, s, s
    width = LEAF
    while True:
        cut = np.arange(0, len(hi), width)
        hi, lo, top = np.maximum.reduceat(hi, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(top, cut)
        levels.append((hi, lo, top))
        width = FAN
        if len(hi) == 1:
            break
    a = b = np.zeros(1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        hi, lo, top = levels[k]
        if k < len(levels) - 1:  # children of the pairs that are left
            step = np.arange(FAN)
            ca = (a[:, None, None] * FAN + step[None, :, None]).repeat(FAN, 2).ravel()
            cb = (b[:, None, None] * FAN + step[None, None, :]).repeat(FAN, 1).ravel()
            fits = (ca <= cb) & (cb < len(hi)) & (ca < len(hi))
            a, b = ca[fits], cb[fits]
        keep = []
        for i in range(0, len(a), 4096):
            x, y = a[i : i + 4096], b[i : i + 4096]
            bound = np.minimum(hi[x], hi[y]).sum(axis=1)
            keep.append(links(bound, lo[x], lo[y]) & (NUM * lo[x] <= DEN * top[y]) & (NUM * lo[y] <= DEN * top[x]))
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        a, b = a[keep], b[keep]
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = np.arange(x * LEAF, min(m, (x + 1) * LEAF)), np.arange(y * LEAF, min(m, (y + 1) * LEAF))
        ok = c[p][:, None] != c[q][None]
        if x == y:
            ok &= p[:, None] < q[None]
        if d is not None:
            ok &= d[p][:, None] != d[q][None]
        i, j = np.nonzero(ok)
        if len(i):
            i, j = p[i], q[j]
            hit = links(np.minimum(v[i], v[j]).sum(axis=1), s[i], s[j])
            out_i.append(order[i[hit]])
            out_j.append(order[j[hit]])
    return np.concatenate(out_i), np.concatenate(out_j)


def _by_tile(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple[int, int, pa.Table]]]:
    """Rows sorted by their first ``keys`` columns, whole tiles at a time, some megabytes: (first row, end, table)."""

    def cuts(t: pa.Table) -> list[int]:
        k = np.stack([t.column(c).to_numpy() for c in range(keys)])
        return [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < TILE_BYTES:
            continue
        t = pa.Table.from_batches(held)
        at = cuts(t)
        if len(at) > 2:  # the last tile may go on in the next batch
            yield [(lo, hi, t) for lo, hi in zip(at[:-2], at[1:-1], strict=True)]
            held = t.slice(at[-2]).to_batches()
        size = sum(b.nbytes for b in held)
        if len(at) <= 2:
            size -= TILE_BYTES  # one tile alone: wait for as much again before looking anew
    if held:
        t = pa.Table.from_batches(held)
        at = cuts(t)
        yield [(lo, hi, t) for lo, hi in zip(at[:-1], at[1:], strict=True)]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, side, id, n, hub, vec): pairs (y, x, bound of the similarity) of hubs, and of each other row with its best hub."""
    for tiles in _by_tile(batches, 2):
        best: dict[int, tuple[float, int]] = {}
        both: dict[tuple[int, int], float] = {}
        for lo, hi, t in tiles:
            part = t.slice(lo, hi - lo)
            ids, n, hub = (part[c].to_numpy() for c in ("id", "n", "hub"))
            raw, seen = part["vec"], {}

            def at(i: int, raw=raw, seen=seen) -> np.ndarray:
                if i not in seen:
                    seen[i] = counts(raw[i].as_py())
                return seen[i]

            for h in np.flatnonzero(hub).tolist():
                near = (NUM * n <= DEN * n[h]) & (NUM * n[h] <= DEN * n) & (ids != ids[h]) & ((hub == 0) | (ids < ids[h]))
                for i in np.flatnonzero(near).tolist():
                    y, x = int(ids[i]), int(ids[h])
                    common = overlap(at(h), at(i))
                    if links(common, n[h], n[i]):
                        score = float(common / (n[h] + n[i] - common))
                        if hub[i]:
                            both[y, x] = score
                        elif (score, -x) > best.get(y, (-1.0, 0)):
                            best[y] = (score, -x)
        out = [(y, -x, s, False) for y, (s, x) in best.items()] + [(y, x, s, True) for (y, x), s in both.items()]
        if out:
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["y", "x", "score", "hubs"])


def best_of_rows(i: np.ndarray, j: np.ndarray, score: np.ndarray, comp: np.ndarray, most: int) -> np.ndarray:
    """Which pairs (i, j) to take: of a row of the component with fewer rows, the ``most`` best towards each other component."""
    _, at, size = np.unique(comp, return_inverse=True, return_counts=True)
    mine, theirs = size[at[i]], size[at[j]]
    swap = (mine > theirs) | ((mine == theirs) & (comp[i] < comp[j]))
    leaf, other = np.where(swap, j, i), np.where(swap, comp[i], comp[j])
    order = np.lexsort((-score, other, leaf))
    new = np.ones(len(order), bool)
    new[1:] = (leaf[order][1:] != leaf[order][:-1]) | (other[order][1:] != other[order][:-1])
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    take = np.zeros(len(order), bool)
    take[order] = rank < most
    return take


def _trees(most: int):
    """Rows (token, ca, a, cb, b, second, id, n, comp, vec), sorted by tile: pairs whose points allow a link, best_of_rows
    of them; a row with a token tells that pairs of its group are left.  A tile of two blocks pairs rows of different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tiles in _by_tile(batches, 5):
            got: set[tuple[int, int]] = set()
            more: set[int] = set()
            for lo, hi, t in tiles:
                part = t.slice(lo, hi - lo)
                ids, n, comp, side = (part[c].to_numpy() for c in ("id", "n", "comp", "second"))
                across = part["ca"][0] != part["cb"][0] or part["a"][0] != part["b"][0]
                if (comp == comp[0]).all() or (across and (side == side[0]).all()):
                    continue
                vec = [counts(x) for x in part["vec"].to_pylist()]
                k = max(GROUPS, min(TREE_GROUPS, min(map(len, vec)) // 8))
                i, j = tree_pairs(np.stack([folded(c, k) for c in vec]).astype(np.int64), n, comp, side if across else None)
                common = np.array([overlap(vec[p], vec[q]) for p, q in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
                fits = links(common, n[i], n[j]) if len(i) else np.zeros(0, bool)
                i, j, common = i[fits], j[fits], common[fits]
                if not len(i):
                    continue
                take = best_of_rows(i, j, common / (n[i] + n[j] - common), comp, most)
                if not take.all():
                    more.add(part["token"][0].as_py())
                got.update((min(x, y), max(x, y)) for x, y in zip(ids[i[take]].tolist(), ids[j[take]].tolist(), strict=True))
            if got or more:
                x, y = [p[0] for p in got] + [None] * len(more), [p[1] for p in got] + [None] * len(more)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array([None] * len(got) + list(more), pa.int64())], names=["x", "y", "token"])

    return run


def _sets_of(wanted):
    """(id, set) of the documents that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            batch = batch.filter(pa.array(maybe_in(wanted.value, batch.column(0).to_numpy())))
            for ids, raws in chunks([batch]):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in shingle_sets(raws)], pa.binary())], names=["id", "set"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, sets of x, sets of y): the pairs that link."""
    for batch in batches:
        fits = []
        for sx, sy in zip(batch.column(2), batch.column(3), strict=True):
            a, b = ([np.frombuffer(v.as_buffer(), np.uint64) for v in s.values] for s in (sx, sy))
            fits.append(any(_link(p, q) for p in a for q in b))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(fits, pa.bool_()))


def _link(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    at = np.searchsorted(a, b)
    return bool(links(int((a[np.minimum(at, len(a) - 1)] == b).sum()), len(a), len(b)))


def with_hubs(rows: DataFrame, seed: int) -> DataFrame:
    """Rows (token, hubs): of every group the HUBS members (id, n) of the smallest hashes; rank limits work before the shuffle, so a large group sends a few rows a task."""
    rank = F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("id", F.lit(seed)), "id"))
    first = rows.select("token", "id", "n").withColumn("k", rank).filter(F.col("k") <= HUBS)
    return first.groupBy("token").agg(F.collect_list(F.struct("id", "n")).alias("hubs"))


class JaccardJoin:
    """The join's steps over one table (doc_id, text)."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.spark = docs.sparkSession
        self.ws = Workspace(self.spark)
        self.made = 0
        r1, r2 = row_key(docs[id_col], docs[text_col])
        self.keyed = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), r1.alias("r1"), r2.alias("r2"))
        self.src = self.keyed.select("doc_id", "text")

    def verified(self, pairs: DataFrame, tag: str) -> DataFrame:
        """Links (a, b) among stored pairs (x, y) of ids."""
        ws, n = self.ws, pairs.count()
        wanted = self.spark.sparkContext.broadcast(bloom(pairs.select(F.explode(F.array("x", "y"))), 2 * n))
        sets = self.src.mapInArrow(_sets_of(wanted), "id long, set binary").groupBy("id").agg(F.collect_set("set").alias("sets"))
        sets = ws.put(fitted(sets, 2 * n, WIDE), f"sets-{tag}")
        rows = fitted(pairs.join(sets.select(F.col("id").alias("y"), F.col("sets").alias("sy")), "y"), n, WIDE)
        rows = fitted(rows.join(sets.select(F.col("id").alias("x"), F.col("sets").alias("sx")), "x").select("x", "y", "sx", "sy"), n, WIDE)
        out = ws.put(rows.mapInArrow(_verify, "a long, b long"), f"links-{tag}")
        ws.drop(f"sets-{tag}")
        wanted.destroy()
        return out

    def groups(self, late, cls: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows (token, id, n) of the token groups, and the groups (token, m, hubs), one of those with the same members."""
        ws = self.ws

        def post(only=None) -> DataFrame:
            return self.src.mapInArrow(_prefixes(late, only), "token long, k1 long")

        shared = post().groupBy("token").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).filter("lo < hi").select("token")
        shared = ws.put(shared, "tokens")
        only = self.spark.sparkContext.broadcast(bloom(shared, shared.count()))
        rows = post(only).join(shared.hint("shuffle_hash"), "token").distinct()
        rows = ws.put(rows.join(cls.select("k1", "id", "n"), "k1").select("token", "id", "n"), "rows")
        only.destroy()
        ws.drop("tokens")
        n = rows.count()
        each = rows.groupBy("token").agg(
            F.count("*").alias("m"), F.min("id").alias("lo"), F.bit_xor(F.xxhash64("id")).alias("s1"), F.bit_xor(F.xxhash64(F.lit("member"), "id")).alias("s2")
        )
        each = fitted(each.filter("m > 1"), n, NARROW).groupBy("m", "lo", "s1", "s2").agg(F.min("token").alias("token"))
        each = ws.put(fitted(each.select("token", "m"), n, NARROW), "sizes")
        rows = ws.put(fitted(rows.join(each.select("token"), "token"), n, NARROW), "members")
        each = ws.put(fitted(each.join(with_hubs(rows, 1), "token"), rows.count(), NARROW), "groups")
        ws.drop("rows", "sizes")
        return rows, each

    def star_links(self, rows: DataFrame, groups: DataFrame, cls: DataFrame) -> DataFrame:
        """Links (a, b) of the star round over rows (token, id, n) and groups (token, m, hubs): of pairs of hubs, and of the others with their best hubs."""
        ws, m = self.ws, rows.count()
        q = F.ceil(F.col("m") / TILE).cast("long")
        r = rows.join(groups.select("token", "m", q.alias("q"), "hubs"), "token")
        r = r.withColumn("hub", F.exists("hubs", lambda h: h["id"] == F.col("id")).cast("int"))
        fits = F.exists("hubs", lambda h: (h["id"] != F.col("id")) & (NUM * F.col("n") <= DEN * h["n"]) & (NUM * h["n"] <= DEN * F.col("n")))
        r = r.filter(fits | ((F.col("hub") == 1) & (F.col("m") > HUBS)))
        one = F.array(F.pmod(F.xxhash64("id"), F.col("q")))
        sides = F.when(F.col("hub") == 1, F.sequence(F.lit(0).cast("long"), F.col("q") - 1)).otherwise(one)
        r = fitted(r.select("token", F.explode(sides).alias("side"), "id", "n", "hub"), m, NARROW)
        r = fitted(r.join(cls.select("id", "vec"), "id").select("token", "side", "id", "n", "hub", "vec"), m, WIDE)
        p = r.repartition("token", "side").sortWithinPartitions("token", "side").mapInArrow(_stars, "y long, x long, score double, hubs boolean")
        # one row for each document: its best hub; pairs of hubs stand for themselves
        p = p.groupBy("y", F.when(F.col("hubs"), F.col("x")).alias("own")).agg(F.max(F.struct("score", (-F.col("x")).alias("x"))).alias("b"))
        p = fitted(p.select((-F.col("b.x")).alias("x"), "y"), m, NARROW)
        pairs = ws.put(fitted(p.distinct(), m, NARROW), "star-pairs")
        out = self.verified(pairs, "star")
        ws.drop("star-pairs")
        return out

    def tree_links(self, rows: DataFrame, cls: DataFrame, comp: DataFrame, most: int, tag: str) -> tuple[DataFrame, DataFrame]:
        """Links (a, b) between components within the groups of rows (token, m, id, n), and the tokens of groups of which pairs are left."""
        ws, m = self.ws, rows.count()
        rows = rows.join(comp, "id", "left").select("token", "m", "id", "n", F.coalesce("component", "id").alias("comp"))
        rows = ws.put(fitted(rows, m, NARROW), f"apart-{tag}")
        step = F.floor(F.log(DEN / NUM, F.col("n").cast("double"))).cast("long")
        r = rows.withColumn("c", step)
        per = fitted(r.groupBy("token", "c").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k")), m, NARROW)
        per = per.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.map_from_entries(F.collect_list(F.struct("c", "k"))).alias("k"))
        r = r.join(per.filter("lo < hi").select("token", "k"), "token")
        count = lambda c: F.coalesce(F.element_at("k", c), F.lit(0).cast("long"))
        c = F.col("c")
        r = r.withColumns({"up": c + 1, "down": c - 1})
        r = r.filter(count(c) + count(F.col("up")) + count(F.col("down")) > 1)  # else no member of a size that may link
        blocks = lambda c: F.ceil(count(c) / TILE).cast("long")
        upto = lambda k: F.filter(F.sequence(F.lit(0).cast("long"), k), lambda j: j < k)
        r = r.withColumn("i", F.pmod(F.xxhash64("id"), blocks(c)))
        zero, i = F.lit(0).cast("long"), F.col("i")
        tile = lambda ca, a, cb, b, second: F.struct(ca.alias("ca"), a.alias("a"), cb.alias("cb"), b.alias("b"), second.cast("int").alias("second"))
        own = F.transform(upto(blocks(c)), lambda j: tile(c, F.least(i, j), c, F.greatest(i, j), i > j))
        above = F.transform(upto(blocks(F.col("up"))), lambda j: tile(c, i, F.col("up"), j, F.lit(0)))
        below = F.transform(upto(blocks(F.col("down"))), lambda j: tile(F.col("down"), j, c, i, F.lit(1)))
        whole = F.array(tile(F.lit(-1).cast("long"), zero, F.lit(-1).cast("long"), zero, F.lit(0)))
        tiles = F.when(F.col("m") > TILE, F.concat(own, above, below)).otherwise(whole)
        r = fitted(r.select("token", F.explode(tiles).alias("t"), "id", "n", "comp"), m, NARROW)
        r = fitted(r.join(cls.select("id", "vec"), "id").select("token", "t.ca", "t.a", "t.cb", "t.b", "t.second", "id", "n", "comp", "vec"), m, WIDE)
        key = ["token", "ca", "a", "cb", "b"]
        found = r.repartition(*key).sortWithinPartitions(*key).mapInArrow(_trees(most), "x long, y long, token long").distinct()
        found = ws.put(fitted(found, m, NARROW), f"found-{tag}")
        out = self.verified(found.filter("token is null").select("x", "y"), tag)
        ws.drop(f"apart-{tag}")
        return out, found.filter("token is not null").select("token")

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id, and r1, r2: the row's key (``lines.row_key``)."""
        ws = self.ws
        first = ws.put(self.keyed.mapInArrow(_first_pass, FIRST), "first")
        count = summed(first.filter("part is not null").select("part", "bytes")).astype(np.float64)
        usual = 4 * count.mean() + 64
        late = np.where(count > usual, 1 + np.log2(np.maximum(count, 1) / usual), 0).astype(np.uint8)
        late = self.spark.sparkContext.broadcast(late)
        members = first.filter("part is null").select("doc_id", "n", "k1", "k2", "r1", "r2")
        # the point goes by its class's smallest id, so one of equal sets carries it
        cls = first.filter("part is null and n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("id"), F.min("vec").alias("vec"))
        cls = ws.put(fitted(cls, members.count(), WIDE), "classes")
        rows, groups = self.groups(late, cls)
        found = self.star_links(rows, groups, cls)
        comp = ws.put(components(ws, found, "cc-star"), "components-star")
        left = rows.join(groups.filter(F.col("m") > HUBS).select("token", "m"), "token")
        most, k = FIRST_TRIES, 0
        while True:
            more, open_ = self.tree_links(left, cls, comp, most, f"tree-{k}")
            if not more.isEmpty():
                found = found.union(more)
                comp = ws.put(components(ws, found, f"cc-{k}"), f"components-{k}")
            if open_.isEmpty():
                break
            left, most, k = left.join(open_, "token"), most * MORE_TRIES, k + 1
        ws.drop("members", "groups")
        final = comp
        whole = cls.select("k1", "k2", "n", "id").join(final, "id", "left").select("k1", "k2", "n", F.coalesce("component", "id").alias("component"))
        return members.join(whole, ["k1", "k2", "n"], "left").select(
            "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), "r1", "r2"
        )


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``near_documents``, with the rows' keys r1 and r2 (``lines.row_key`` of id and text)."""
    with arrow_rows(docs.sparkSession, ROWS):
        return JaccardJoin(docs, id_col, text_col).run()


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    return near_rows(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def oracle() -> str:
    """DuckDB: sets of word 5-grams, pairs by shared shingles, components by recursion."""
    return r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\t-\r ]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END)) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS MATERIALIZED (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS MATERIALIZED (SELECT i, j FROM x JOIN n na ON na.doc_id = i JOIN n nb ON nb.doc_id = j WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS i, doc_id AS c FROM documents UNION SELECT p.j, r.c FROM r JOIN p ON p.i = r.i)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(c) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.i = d.doc_id GROUP BY 1, 2"""
