"""Regions of sorted, block-compressed VCF files by their index (.tbi, else .csi).

The index names, for bins of positions, the chunks of the file (from one virtual offset to another) that hold their
records.  A region's bins give chunks; those that overlap are one, and every chunk is a partition that reads its own
blocks and no others.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from .blocks import BGZF_END, ByteFile, FormatError, Written, bgzf_block, bgzf_compress, files_of, filesystem
from .formats import vcf_columns

# Smallest bins of 2 ^ 14 positions, five levels above them.
MIN_SHIFT, DEPTH = 14, 5
#: A chunk that is longer in the file is cut where a block starts.
PART_BYTES = 64 << 20
#: Lines of a file that ``sorted_lines`` makes.
FILE_LINES = 1_000_000


class NoIndex(ValueError):
    """A region was asked of a file that has no index."""

    kind = "no_index"


def parse_region(region: str) -> tuple[str, int, int | None]:
    """``chr``, ``chr:from``, ``chr:from-to`` or the bracket form ``chr:[from,to)``; 1-based, both ends in (the bracket form: 0-based half-open)."""
    if m := re.fullmatch(r"(.+):\[(\d+),(\d*)\)", region):
        return m[1], int(m[2]) + 1, int(m[3]) if m[3] else None
    if m := re.fullmatch(r"(.+):([\d,]+)(?:-([\d,]*))?", region):
        begin, end = int(m[2].replace(",", "")), m[3] and int(m[3].replace(",", ""))
        if begin < 1 or (end and end < begin):
            raise ValueError(f"{region!r} is no region")
        return m[1], begin, end or None
    if not region:
        raise ValueError("an empty region")
    return region, 1, None


def bins(begin: int, end: int, shift: int = MIN_SHIFT, depth: int = DEPTH) -> list[int]:
    """Bins that may hold records of the 0-based half-open range."""
    out, first = [], 0
    for level in range(depth + 1):
        s = shift + 3 * (depth - level)
        out += range(first + (begin >> s), first + ((end - 1) >> s) + 1)
        first += 8**level
    return out


def bin_of(begin: int, end: int, shift: int = MIN_SHIFT, depth: int = DEPTH) -> int:
    """The smallest bin that holds the 0-based half-open range."""
    for level in range(depth, 0, -1):
        s = shift + 3 * (depth - level)
        if begin >> s == (end - 1) >> s:
            return (8**level - 1) // 7 + (begin >> s)
    return 0


@dataclass
class Index:
    """Per reference name: chunks by bin, and the least virtual offset by window of 2 ^ 14 positions (.tbi) or by bin (.csi)."""

    names: list[str]
    bins: list[dict[int, list[tuple[int, int]]]]
    least: list[list[int]]
    shift: int
    depth: int

    def chunks(self, name: str, begin: int, end: int) -> list[tuple[int, int]]:
        """Merged chunks of the 0-based half-open range."""
        if name not in self.names:
            return []
        k = self.names.index(name)
        end = min(end, 1 << (self.shift + 3 * self.depth))
        if begin >= end:
            return []
        window = begin >> MIN_SHIFT
        least = self.least[k][min(window, len(self.least[k]) - 1)] if self.least[k] else 0
        have = self.bins[k]
        found = sorted(c for b in bins(begin, end, self.shift, self.depth) for c in have.get(b, ()) if c[1] > least)
        out: list[tuple[int, int]] = []
        for a, b in found:
            a = max(a, least)
            if out and a >> 16 <= out[-1][1] >> 16:  # in the same block
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        return out


def read_index(path: str) -> Index:
    """The index beside a file."""
    for suffix in (".tbi", ".csi"):
        try:
            f = ByteFile(path + suffix)
        except FileNotFoundError:
            continue
        data, at = [], 0
        while at < f.size:
            part, at = bgzf_block(f, at)
            data.append(part)
        f.close()
        return _parsed(b"".join(data), path + suffix)
    raise NoIndex(f"no .tbi or .csi index stands beside {path!r}")


def _parsed(d: bytes, path: str) -> Index:
    def ints(at: int, n: int) -> tuple:
        return struct.unpack_from(f"<{n}i", d, at)

    try:
        if d[:4] == b"TBI\x01":
            refs, at, shift, depth, csi = ints(4, 1)[0], 36, MIN_SHIFT, DEPTH, False
            size = ints(32, 1)[0]
        elif d[:4] == b"CSI\x01":
            shift, depth, aux = ints(4, 3)
            at, csi = 16 + 28, True
            size = ints(16 + 24, 1)[0] if aux >= 28 else 0
            refs_at = 16 + aux
        else:
            raise FormatError(f"{path!r} is no index")
        names = [n.decode() for n in d[at : at + size].split(b"\0")[:-1]]
        at += size
        if csi:
            refs, at = ints(refs_at, 1)[0], refs_at + 4
        every, least = [], []
        for _ in range(refs):
            own: dict[int, list[tuple[int, int]]] = {}
            (n,), at = ints(at, 1), at + 4
            for _ in range(n):
                b, at = struct.unpack_from("<I", d, at)[0], at + (12 if csi else 4)
                (k,), at = ints(at, 1), at + 4
                v = struct.unpack_from(f"<{2 * k}Q", d, at)
                at += 16 * k
                if b < (8 ** (depth + 1) - 1) // 7:  # else a bin of counts
                    own[b] = list(zip(v[::2], v[1::2], strict=True))
            every.append(own)
            offsets: list[int] = []
            if not csi:
                (n,), at = ints(at, 1), at + 4
                offsets = list(struct.unpack_from(f"<{n}Q", d, at))
                at += 8 * n
            least.append(offsets)
    except (struct.error, IndexError) as e:
        raise FormatError(f"{path!r} is cut off") from e
    return Index(names, every, least, shift, depth)


@dataclass
class Chunk(InputPartition):
    path: str
    begin: int  # virtual offsets
    end: int
    name: str
    first: int  # 1-based, both in
    last: int


class RegionSource(DataSource):
    """Lines (value) of the records of a region; options: path (a file or folder), region, part_bytes."""

    @classmethod
    def name(cls) -> str:
        return "vcf_region"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return RegionReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return IndexedWriter(self.options)


class RegionReader(DataSourceReader):
    def __init__(self, options: dict):
        self.name, self.first, last = parse_region(options["region"])
        self.last = last or (1 << 60)
        self.bytes = int(options.get("part_bytes", PART_BYTES))
        self.paths = files_of(options["path"], (".gz", ".bgz"))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            chunks = read_index(path).chunks(self.name, self.first - 1, self.last)
            out += [Chunk(path, a, b, self.name, self.first, self.last) for a, b in chunks]
        return out or [InputPartition(None)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(part, Chunk):
            return
        f = ByteFile(part.path)
        try:
            for rows in region_lines(f, part):
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])
        finally:
            f.close()


def region_lines(f: ByteFile, part: Chunk) -> Iterator[list[str]]:
    """The lines that start between the chunk's virtual offsets and overlap its region."""
    at, skip, rest = part.begin >> 16, part.begin & 0xFFFF, b""
    end, over = part.end >> 16, part.end & 0xFFFF
    while at < f.size and (at < end or (at == end and (over or rest)) or rest):
        data, behind = bgzf_block(f, at)
        data = data[:over] if at == end and over else data
        data, skip = data[skip:], 0
        if at > end or (at == end and over == 0):  # the last line's rest
            k = data.find(b"\n")
            data = data if k < 0 else data[: k + 1]
        *whole, rest = (rest + data).split(b"\n")
        out = []
        for line in whole:
            kept = _overlap(line, part)
            if kept is None:
                yield out
                return
            if kept:
                out.append(line.decode().removesuffix("\r"))
        if out:
            yield out
        if at > end or (at == end and over == 0):
            if k >= 0:
                return
        at = behind
    if rest and _overlap(rest, part):
        yield [rest.decode().removesuffix("\r")]


def _overlap(line: bytes, part: Chunk) -> bool | None:
    """Whether a record overlaps the region; None: it lies behind it."""
    if not line or line.startswith(b"#"):
        return False
    p = line.split(b"\t", 8)
    if p[0] != part.name.encode():
        return False
    pos, end = _span(p)
    return None if pos > part.last else end >= part.first


def _span(p: list[bytes]) -> tuple[int, int]:
    """First and last position of a record's first 8 columns: up to its END, else by its reference bases."""
    pos = int(p[1])
    m = re.search(rb"(?:^|;)END=(\d+)", p[7]) if len(p) > 7 else None
    return pos, max(pos, int(m[1])) if m else pos + max(1, len(p[3])) - 1


def read_vcf_region(spark: SparkSession, path: str, region: str) -> DataFrame:
    """The records of a region as ``formats.read_vcf`` has them; files without an index are an error."""
    spark.dataSource.register(RegionSource)
    paths = files_of(path, (".gz", ".bgz"))
    if not paths:
        raise FileNotFoundError(path)
    read_index(paths[0])
    lines = spark.read.format("vcf_region").option("region", region).load(path)
    return vcf_columns(lines, vcf_header_of(paths[0]))


def vcf_header_of(path: str) -> tuple:
    """``formats.vcf_header`` of one block-compressed file; reads its first blocks only."""
    from .formats import header_fields

    f, at, text = ByteFile(path), 0, b""
    while at < f.size:
        data, at = bgzf_block(f, at)
        text += data
        if any(not x.startswith(b"#") for x in text.split(b"\n")[:-1]):
            break
    f.close()
    return header_fields(text.decode().split("\n"))


class IndexedWriter(DataSourceArrowWriter):
    """Sorted lines to a block-compressed file with a .tbi index, one for each task; option header: the lines in front."""

    def __init__(self, options: dict):
        self.path, self.header = options["path"].rstrip("/"), options["header"].rstrip("\n") + "\n"
        self.block = int(options.get("block_bytes", 32_000))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, folder = filesystem(self.path)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/.part-{task.partitionId():05d}-{task.taskAttemptId()}"
        names: dict[str, int] = {}
        chunks: list[dict[int, list[list[int]]]] = []
        linear: list[dict[int, int]] = []
        at, held, last = 0, [self.header.encode()], ("", 0)
        size = len(held[0])
        pending: list[tuple[str, int, int, int, int]] = []  # name, begin, end and place in the open block

        def flush(out) -> None:
            nonlocal at, size
            raw = bgzf_compress(b"".join(held))
            behind = at + len(raw)
            for k, (ref, begin, end, place, length) in enumerate(pending):
                if ref not in names:
                    names[ref] = len(names)
                    chunks.append({})
                    linear.append({})
                r = names[ref]
                start = at << 16 | place
                stop = at << 16 | place + length if k < len(pending) - 1 or place + length < size else behind << 16
                own = chunks[r].setdefault(bin_of(begin, end), [])
                if own and own[-1][1] == start:
                    own[-1][1] = stop
                else:
                    own.append([start, stop])
                for w in range(begin >> MIN_SHIFT, ((end - 1) >> MIN_SHIFT) + 1):
                    linear[r].setdefault(w, start)
            out.write(raw)
            at, size = behind, 0
            held.clear()
            pending.clear()

        with system.open_output_stream(name) as out:
            flush(out)
            for batch in iterator:
                for value in batch.column(0).to_pylist():
                    line = value.encode() + b"\n"
                    p = line.rstrip(b"\n").split(b"\t", 8)
                    first, end = _span(p)
                    here = (p[0].decode(), first)
                    if here[0] == last[0] and here[1] < last[1] or here[0] != last[0] and here[0] in names:
                        raise FormatError(f"records must be sorted: {here} comes after {last}")
                    last = here
                    if size and size + len(line) > self.block:
                        flush(out)
                    if len(line) > 65_000:
                        raise FormatError("a record is longer than a block")
                    pending.append((here[0], first - 1, end, size, len(line)))
                    held.append(line)
                    size += len(line)
            if held:
                flush(out)
            out.write(BGZF_END)
        with system.open_output_stream(name + ".tbi") as out:
            out.write(bgzf_compress(self._index(names, chunks, linear)) + BGZF_END)
        return Written(name)

    @staticmethod
    def _index(names: dict[str, int], chunks: list, linear: list) -> bytes:
        text = b"".join(n.encode() + b"\0" for n in names)
        out = [b"TBI\x01", struct.pack("<8i", len(names), 2, 1, 2, 0, ord("#"), 0, len(text)), text]
        for own, first in zip(chunks, linear, strict=True):
            out.append(struct.pack("<i", len(own)))
            for b, c in own.items():
                out.append(struct.pack("<Ii", b, len(c)) + b"".join(struct.pack("<QQ", *x) for x in c))
            offsets, before = [], 0
            for w in range(max(first) + 1):
                before = first.get(w, before)
                offsets.append(before)
            out.append(struct.pack(f"<i{len(offsets)}Q", len(offsets), *offsets))
        return b"".join(out)

    def commit(self, messages: list[Written]) -> None:
        system, folder = filesystem(self.path)
        for k, m in enumerate(x for x in messages if x):
            system.move(m.path + ".tbi", f"{folder}/part-{k:05d}.vcf.gz.tbi")
            system.move(m.path, f"{folder}/part-{k:05d}.vcf.gz")

    def abort(self, messages: list[Written]) -> None:
        system, _ = filesystem(self.path)
        for m in messages:
            if m:
                system.delete_file(m.path)


def write_indexed_vcf(lines: DataFrame, path: str, header: str) -> None:
    """Lines (value) in the frame's partitions, each sorted by reference and position, as a folder of indexed files."""
    lines.sparkSession.dataSource.register(RegionSource)
    lines.select("value").write.format("vcf_region").option("header", header).mode("append").save(path)


def sorted_lines(rows: DataFrame, chrom: str = "chrom", pos: str = "pos", line: str = "value", parts: int | None = None) -> DataFrame:
    """Lines dealt into sorted ranges of positions, for ``write_indexed_vcf``: ``parts`` of them, else one for each ``FILE_LINES`` lines and 8 at least.  Lines of one position may go to several ranges."""
    parts = parts or max(8, -(-rows.count() // FILE_LINES))
    return rows.repartitionByRange(parts, F.col(chrom), F.col(pos), F.col(line)).sortWithinPartitions(chrom, pos, line).select(F.col(line).alias("value"))
