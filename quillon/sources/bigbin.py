"""BigWig and BigBed as data sources: the leaves of the file's own R-tree are dealt to partitions, and a range of positions reads its leaves only.

Both byte orders are read.  Columns: chrom, start, end (0-based half-open), and value for BigWig.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .blocks import ByteFile, FormatError, files_of

# First numbers of the files, of the chromosome tree and of the R-tree.
BIGWIG, BIGBED, CHROM_TREE, R_TREE = 0x888FFC26, 0x8789F2EB, 0x78CA8C91, 0x2468ACE0
#: Compressed bytes of the leaves of a partition.
PART_BYTES = 16 << 20


@dataclass
class Leaf:
    """A block of data: its place in the file, and where its first and last positions lie."""

    offset: int
    size: int
    first: tuple[int, int]
    last: tuple[int, int]


class BigFile:
    """Header, chromosomes and index of one file."""

    def __init__(self, path: str):
        self.f = ByteFile(path)
        head = self.f.need(0, 64)
        for order in "<>":
            magic = struct.unpack(order + "I", head[:4])[0]
            if magic in (BIGWIG, BIGBED):
                break
        else:
            raise FormatError(f"{path!r} is neither BigWig nor BigBed")
        self.order, self.wig = order, magic == BIGWIG
        _, _, chroms, _, index = self._u("HHQQQ", head[4:32])
        self.packed = self._u("I", head[52:56])[0] > 0
        self.names = self._chromosomes(chroms)
        self.index = index

    def _u(self, kinds: str, raw: bytes) -> tuple:
        return struct.unpack(self.order + kinds, raw)

    def _chromosomes(self, at: int) -> dict[int, str]:
        magic, _, key, _ = self._u("IIII", self.f.need(at, 16))
        if magic != CHROM_TREE:
            raise FormatError(f"{self.f.path!r} has no chromosome tree")
        names: dict[int, str] = {}
        todo = [at + 32]
        while todo:
            at = todo.pop()
            leaf, _, n = self._u("BBH", self.f.need(at, 4))
            raw = self.f.need(at + 4, n * (key + 8))
            for k in range(0, len(raw), key + 8):
                name, rest = raw[k : k + key], raw[k + key : k + key + 8]
                if leaf:
                    names[self._u("II", rest)[0]] = name.rstrip(b"\0").decode()
                else:
                    todo.append(self._u("Q", rest)[0])
        return names

    def leaves(self, chrom: str | None = None, start: int = 0, end: int | None = None) -> list[Leaf]:
        """The blocks that may hold positions of a range, in order; other branches of the tree are not read."""
        if self._u("I", self.f.need(self.index, 4))[0] != R_TREE:
            raise FormatError(f"{self.f.path!r} has no index")
        number = next((k for k, n in self.names.items() if n == chrom), None)
        if chrom is not None and number is None:
            return []
        lo = (number, start) if chrom is not None else (-1, 0)
        hi = (number, end if end is not None else 1 << 40) if chrom is not None else (1 << 40, 0)
        out, todo = [], [self.index + 48]
        while todo:
            at = todo.pop()
            leaf, _, n = self._u("BBH", self.f.need(at, 4))
            width = 32 if leaf else 24
            raw = self.f.need(at + 4, n * width)
            for k in range(n):
                c1, b1, c2, b2, offset = self._u("IIIIQ", raw[k * width : k * width + 24])
                if (c2, b2) <= lo or (c1, b1) >= hi:
                    continue
                if leaf:
                    out.append(Leaf(offset, self._u("Q", raw[k * width + 24 : k * width + 32])[0], (c1, b1), (c2, b2)))
                else:
                    todo.append(offset)
        return sorted(out, key=lambda x: x.offset)

    def rows(self, leaf: Leaf) -> tuple[np.ndarray, ...]:
        """Chromosome numbers, starts, ends and values of a block."""
        raw = self.f.need(leaf.offset, leaf.size)
        try:
            data = zlib.decompress(raw) if self.packed else raw
        except zlib.error as e:
            raise FormatError(f"{self.f.path!r}: block at byte {leaf.offset}: {e}") from e
        return self._wig(data) if self.wig else self._bed(data)

    def _wig(self, data: bytes) -> tuple[np.ndarray, ...]:
        if len(data) < 24:
            raise FormatError(f"{self.f.path!r}: a block is cut off")
        chrom, start, _, step, span, kind, _, n = self._u("IIIIIBBH", data[:24])
        u, f4 = np.dtype(self.order + "u4"), np.dtype(self.order + "f4")
        fields = {1: [("s", u), ("e", u), ("v", f4)], 2: [("s", u), ("v", f4)], 3: [("v", f4)]}.get(kind)
        if fields is None or len(data) < 24 + n * 4 * len(fields):
            raise FormatError(f"{self.f.path!r}: a block of unknown kind or length")
        x = np.frombuffer(data, np.dtype(fields), n, 24)
        s = x["s"].astype(np.int64) if kind < 3 else start + step * np.arange(n, dtype=np.int64)
        e = x["e"].astype(np.int64) if kind == 1 else s + span
        return np.full(n, chrom, np.int64), s, e, x["v"].astype(np.float64)

    def _bed(self, data: bytes) -> tuple[np.ndarray, ...]:
        rows, at = [], 0
        while at + 12 <= len(data):
            rows.append(self._u("III", data[at : at + 12]))
            k = data.find(b"\0", at + 12)  # what else the row says ends with a zero byte
            if k < 0:
                raise FormatError(f"{self.f.path!r}: a row has no end")
            at = k + 1
        c, s, e = np.array(rows, np.int64).reshape(-1, 3).T
        return c, s, e, np.zeros(len(c))


@dataclass
class Leaves(InputPartition):
    path: str
    leaves: list[Leaf]


class BigSource(DataSource):
    """Options: path (a file or folder), kind (bigwig or bigbed), chrom, start, end, part_bytes."""

    @classmethod
    def name(cls) -> str:
        return "big_intervals"

    def schema(self) -> str:
        return "chrom string, start long, end long" + (", value double" if self.options.get("kind") == "bigwig" else "")

    def reader(self, schema) -> DataSourceReader:
        return BigReader(self.options)


class BigReader(DataSourceReader):
    def __init__(self, options: dict):
        self.wig = options["kind"] == "bigwig"
        self.paths = files_of(options["path"], (".bw", ".bigwig") if self.wig else (".bb", ".bigbed"))
        self.chrom, self.start = options.get("chrom"), int(options.get("start", 0))
        self.end = int(options["end"]) if "end" in options else None
        self.bytes = int(options.get("part_bytes", PART_BYTES))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            big = BigFile(path)
            if big.wig != self.wig:
                raise FormatError(f"{path!r} is of the other kind")
            held: list[Leaf] = []
            for leaf in big.leaves(self.chrom, self.start, self.end):
                if held and sum(x.size for x in held) + leaf.size > self.bytes:
                    out.append(Leaves(path, held))
                    held = []
                held.append(leaf)
            if held:
                out.append(Leaves(path, held))
            big.f.close()
        return out or [InputPartition(None)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(part, Leaves):
            return
        big = BigFile(part.path)
        names = pa.array([big.names.get(k) for k in range(max(big.names, default=-1) + 1)], pa.string())
        try:
            for leaf in part.leaves:
                c, s, e, v = big.rows(leaf)
                if self.chrom is not None:
                    keep = (e > self.start) & (s < (self.end if self.end is not None else 1 << 40)) & (np.array([big.names.get(int(k)) == self.chrom for k in c], bool))
                    c, s, e, v = c[keep], s[keep], e[keep], v[keep]
                cols = [names.take(pa.array(c)), pa.array(s), pa.array(e)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(v)] if self.wig else cols, names=["chrom", "start", "end", *(["value"] if self.wig else [])])
        finally:
            big.f.close()


def read_big(spark: SparkSession, path: str, kind: str, chrom: str | None = None, start: int = 0, end: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Intervals of BigWig or BigBed files; with a chromosome those that overlap [start, end) of it."""
    spark.dataSource.register(BigSource)
    r = spark.read.format("big_intervals").option("kind", kind).option("part_bytes", part_bytes)
    if chrom is not None:
        r = r.option("chrom", chrom).option("start", start)
        r = r.option("end", end) if end is not None else r
    return r.load(path)


def read_bigwig(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_big(spark, path, "bigwig", **options)


def read_bigbed(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_big(spark, path, "bigbed", **options)
