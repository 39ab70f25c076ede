"""Banded products of genotype blocks: correlations of all SNPs within a distance, without a row that holds two of them.

Genotypes are packed, four to a byte.  A SNP goes to the tile of its position (as wide as the window) and, as halo, to the
tile before; a tile's rows come in order of position.  A task keeps the packed blocks of the last window and multiplies each new
block with them, so memory is a window's packed genotypes and two blocks of numbers.  A pair belongs to the tile of its first SNP.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: SNPs of a block; entries of a block at most (fewer SNPs where there are more people).
BLOCK, ENTRIES = 512, 8_000_000
#: Code of a missing genotype in packed bytes; others are the counts 0 to 2.
MISSING = 3


def pack(g: np.ndarray) -> np.ndarray:
    """Counts (SNPs x people; below 0 or above 2: missing), four to a byte."""
    m, n = g.shape
    codes = np.full((m, -(-n // 4) * 4), MISSING, np.uint8)
    codes[:, :n] = np.where((g < 0) | (g > 2), MISSING, g)
    return codes[:, ::4] | codes[:, 1::4] << 2 | codes[:, 2::4] << 4 | codes[:, 3::4] << 6


def unpack(rows: list[bytes], people: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return (raw[:, :, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(len(rows), -1)[:, :people]


def packed(df: DataFrame, genotypes: str = "genotypes") -> DataFrame:
    """``df`` with ``_people`` and ``_packed`` in the place of its genotypes; frames that have them pass through."""
    if "_packed" in df.columns:
        return df
    rest = [c for c in df.columns if c != genotypes]
    src = df.filter(F.col(genotypes).isNotNull()).select(*rest, F.transform(genotypes, lambda g: F.coalesce(g, F.lit(-1)).cast("tinyint")).alias("_g"))
    schema = T.StructType([f for f in src.schema.fields if f.name != "_g"]).add("_people", T.IntegerType()).add("_packed", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(rest))
            flat, at = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            size = np.diff(at)
            rows = [pack(flat[i:j][None])[0].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(size.astype(np.int32)), pa.array(rows, pa.binary())], names=[*rest, "_people", "_packed"])

    return src.mapInArrow(run, schema)


class Block:
    """Some SNPs of a tile: numbers from packed genotypes when they are wanted."""

    def __init__(self, rows: pa.Table, keep: list[str]):
        self.at, self.own = rows["at"].to_numpy(), rows["own"].to_numpy()
        self.people, self.raw = rows["people"][0].as_py(), rows["packed"].to_pylist()
        if (rows["people"].to_numpy() != self.people).any():
            raise ValueError("SNPs of one group have different numbers of people")
        self.rows = rows.select(keep)

    def standard(self) -> tuple[np.ndarray, np.ndarray]:
        """Genotypes less their mean over their spread, missing ones at the mean; and the spread (0: no variation, all zeros)."""
        g = unpack(self.raw, self.people).astype(np.float64)
        there = g != MISSING
        n = there.sum(axis=1)
        mean = np.where(there, g, 0).sum(axis=1) / np.maximum(n, 1)
        x = np.where(there, g - mean[:, None], 0)
        sd = np.sqrt((x * x).mean(axis=1))
        return np.divide(x, sd[:, None], out=np.zeros_like(x), where=sd[:, None] > 0), sd

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts with 0 where missing, and the mask of those that are there; in single precision, whose sums are exact."""
        g = unpack(self.raw, self.people)
        there = g != MISSING
        return np.where(there, g, 0).astype(np.float32), there.astype(np.float32)


def complete_r(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """r of every two SNPs over the people that have both, and their number."""
    (x, mx), (y, my) = a.counted(), b.counted()
    n, sx, sy, sxy, sxx, syy = (p.astype(np.float64) for p in (mx @ my.T, x @ my.T, mx @ y.T, x @ y.T, (x * x) @ my.T, mx @ (y * y).T))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (n * sxy - sx * sy) / np.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    return r, n


def imputed_r(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """r of every two SNPs with missing genotypes at the mean; NaN where one does not vary."""
    (x, sx), (y, sy) = a.standard(), b.standard()
    r = x @ y.T / a.people
    r[(sx == 0)[:, None] | (sy == 0)[None]] = np.nan
    return r, np.full(r.shape, float(a.people))


def banded(df: DataFrame, window: int, by: list[str], at: str, keep: list[str], emit: Callable[[Block, Block, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``emit(a, b, near)`` for all blocks of which SNPs are near; near (i, j): j comes behind i, within the window, and i is the tile's own.

    Blocks offer the columns ``keep`` as ``rows``.  SNPs without a position are left out; all SNPs of a group must have as many people."""
    if window < 0:
        raise ValueError("a window is not below 0")
    wide = max(1, int(window))
    tile = F.floor(F.col(at) / wide)
    src = packed(df).filter(F.col(at).isNotNull())
    src = src.select(F.to_json(F.struct(*by)).alias("grp"), F.explode(F.array(tile, tile - 1)).alias("tile"), tile.alias("home"), F.col(at).cast("double").alias("at"), F.col("_people").alias("people"), F.col("_packed").alias("packed"), *keep)
    src = src.withColumn("own", F.col("tile") == F.col("home"))
    # a row for the tile before counts only if it can be near that tile's last position
    src = src.filter(F.col("own") | (F.col("at") - F.col("home") * wide <= window)).drop("home")
    src = src.repartition("grp", "tile").sortWithinPartitions("grp", "tile", "at", *keep)
    names = src.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, deque()

        def meet(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal last
            key = rows["grp"][0].as_py(), rows["tile"][0].as_py()
            if key != last:
                held.clear()
                last = key
            block = Block(rows, keep)
            while held and held[0].at[-1] < block.at[0] - window:
                held.popleft()
            for a in [*held, block]:
                if not a.own.any():
                    continue
                if a.people != block.people:
                    raise ValueError("SNPs of one group have different numbers of people")
                gap = block.at[None] - a.at[:, None]
                near = (gap >= 0) & (gap <= window) & a.own[:, None]
                if a is block:
                    near = np.triu(near, 1)
                if near.any():
                    yield from emit(a, block, near)
            held.append(block)

        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            size = max(1, min(BLOCK, ENTRIES // max(1, t["people"][0].as_py()))) if t.num_rows else BLOCK
            grp, til = np.array(t["grp"].to_pylist(), object), t["tile"].to_numpy()
            cuts = [0, *(np.flatnonzero((grp[1:] != grp[:-1]) | (til[1:] != til[:-1])) + 1).tolist(), t.num_rows]
            start = 0
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                for k in range(lo, hi, size):
                    if hi < t.num_rows or k + size <= hi:  # else the block may go on in the next batch
                        yield from meet(t.slice(k, min(size, hi - k)))
                        start = min(k + size, hi)
            rest = t.slice(start)
        if rest is not None and rest.num_rows:
            for k in range(0, rest.num_rows, BLOCK):
                yield from meet(rest.slice(k, BLOCK))

    assert names[:5] == ["grp", "tile", "at", "people", "packed"]
    return src.mapInArrow(run, schema)


def ld_matrix(
    df: DataFrame, window: int, by: tuple[str, ...] = ("CHR",), at: str = "BP", key: str = "SNP", least_r2: float = 0.01, maf: float = 0.01, missing: float = 0.05
) -> DataFrame:
    """Sparse correlations: by..., key, key_b, at, at_b, r, r2, n of the pairs with r2 >= least_r2, each pair once (the first one comes first).

    SNPs whose minor frequency is below ``maf`` or whose share of missing genotypes is above ``missing`` are left out.  r is
    taken over the people that have both genotypes."""
    src = packed(df)
    src = with_counts(src).filter((F.least("freq", 1 - F.col("freq")) >= maf) & (F.col("missing") <= missing)).drop("n", "freq", "missing")
    fields = {f.name: f.dataType.simpleString() for f in src.schema}
    cols = [*by, key, at]
    schema = ", ".join([f"{c} {fields[c]}" for c in by] + [f"{key} {fields[key]}, {key}_b {fields[key]}, {at} {fields[at]}, {at}_b {fields[at]}, r double, r2 double, n long"])
    src = src.select("_people", "_packed", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(cols)], *by, at)
    keep = [f"_k{i}" for i in range(len(cols))]
    groups = len(by)

    def emit(a: Block, b: Block, near: np.ndarray) -> Iterator[pa.RecordBatch]:
        r, n = complete_r(a, b)
        i, j = np.nonzero(near & (r * r >= least_r2))
        if len(i):
            first, second = a.rows.take(pa.array(i)), b.rows.take(pa.array(j))
            one = lambda t, k: t.column(k).combine_chunks()
            v = r[i, j]
            out = [*[one(first, k) for k in range(groups)], one(first, groups), one(second, groups), one(first, groups + 1), one(second, groups + 1), pa.array(v), pa.array(v * v), pa.array(n[i, j].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(out, names=[f"c{k}" for k in range(len(out))])

    return banded(src, window, list(by), at, keep, emit, schema)


def with_counts(df: DataFrame, genotypes: str = "genotypes") -> DataFrame:
    """Packed rows with n (genotypes seen), freq (of the counted allele; null without any) and missing (share)."""
    src = packed(df, genotypes)
    schema = T.StructType(list(src.schema.fields)).add("n", T.IntegerType()).add("freq", T.DoubleType()).add("missing", T.DoubleType())
    # of each byte, the sum of its counts and the number of its genotypes that are there
    codes = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
    total, there = np.where(codes == MISSING, 0, codes).sum(axis=1), (codes != MISSING).sum(axis=1)
    at = {c: k for k, c in enumerate(src.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, s = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for k, raw in enumerate(b.column(at["_packed"])):
                x = np.frombuffer(raw.as_buffer(), np.uint8)
                n[k], s[k] = there[x].sum(), total[x].sum()
            people = b.column(at["_people"]).to_numpy()
            freq = pa.array(np.divide(s, 2 * n, out=np.zeros(len(n)), where=n > 0), mask=n == 0)
            missing = pa.array(np.divide(people - n, people, out=np.ones(len(n)), where=people > 0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n.astype(np.int32)), freq, missing], names=[*b.schema.names, "n", "freq", "missing"])

    return src.mapInArrow(run, schema)


def allele_frequencies(df: DataFrame, by: tuple[str, ...] = ("CHR",), key: str = "SNP") -> DataFrame:
    """by..., key, n, freq and maf of every SNP."""
    return with_counts(df).select(*by, key, "n", "freq", F.least("freq", 1 - F.col("freq")).alias("maf"), "missing")
