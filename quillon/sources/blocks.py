"""Block-compressed files read by byte ranges: block gzip (BGZF) and multi-frame zstd, and a data source of their lines.

Files are opened through Arrow's file systems (local, hdfs, s3, gcs) on the executors.  A partition is a byte range of a
file.  It owns the blocks that start in its range and, of the text, the lines that start in them: all but the
first partition skip up to their first line end, and every partition reads on to the end of its last line.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Compressed bytes of a partition, and of one read.
PART_BYTES, READ_BYTES = 64 << 20, 4 << 20
#: How far behind its range a task looks for the first record that starts in it.
MOST_AHEAD = 64 << 20
#: Payload of a block that is written (a block holds less than 64 KB).
BLOCK_BYTES = 65_280
# The empty block that ends a BGZF file, and the first bytes of a zstd frame.
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"


class FormatError(ValueError):
    """A file that breaks the rules of its format."""

    kind = "format"


class ByteFile:
    """Random access to a file through a window of what was read last."""

    def __init__(self, path: str):
        system, name = filesystem(path)
        self.path, self.file = path, system.open_input_file(name)
        self.size = self.file.size()
        self.at, self.window = 0, b""
        self.read_bytes = 0

    def get(self, at: int, n: int) -> bytes:
        """n bytes from ``at`` on; fewer at the file's end."""
        n = max(0, min(n, self.size - at))
        if not self.at <= at <= at + n <= self.at + len(self.window):
            self.file.seek(at)
            self.at, self.window = at, self.file.read(max(n, min(READ_BYTES, self.size - at)))
            self.read_bytes += len(self.window)
        return self.window[at - self.at : at - self.at + n]

    def need(self, at: int, n: int) -> bytes:
        got = self.get(at, n)
        if len(got) < n:
            raise FormatError(f"{self.path!r} ends within a block at byte {at}")
        return got

    def close(self) -> None:
        self.file.close()


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it; file: with one slash is taken, too."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


def files_of(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """The file, or the files of a folder that end so, sorted."""
    system, name = filesystem(path)
    info = system.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [path]
    found = system.get_file_info(pafs.FileSelector(name, recursive=True))
    names = sorted(x.path for x in found if x.type == pafs.FileType.File and x.path.endswith(suffixes) and not x.base_name.startswith(("_", ".")))
    return [path.rstrip("/") + n[len(name.rstrip("/")) :] for n in names]


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


def ranges(paths: list[str], part_bytes: int) -> list[Range]:
    out = []
    for p in paths:
        system, name = filesystem(p)
        size = system.get_file_info(name).size
        out += [Range(p, a, min(size, a + part_bytes)) for a in range(0, max(1, size), part_bytes)]
    return out


# block gzip


def bgzf_size(f: ByteFile, at: int) -> int | None:
    """Bytes of the block at ``at``; None where none starts."""
    head = f.get(at, 12)
    if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra = f.get(at + 12, struct.unpack_from("<H", head, 10)[0])
    k = 0
    while k + 4 <= len(extra):
        tag, n = extra[k : k + 2], struct.unpack_from("<H", extra, k + 2)[0]
        if tag == b"BC" and n == 2 and k + 6 <= len(extra):
            return struct.unpack_from("<H", extra, k + 4)[0] + 1
        k += 4 + n
    return None


def bgzf_block(f: ByteFile, at: int) -> tuple[bytes, int]:
    """The payload of the block at ``at``, and the place behind it."""
    size = bgzf_size(f, at)
    if size is None:
        raise FormatError(f"{f.path!r}: no block starts at byte {at}")
    raw = f.need(at, size)
    skip = 12 + struct.unpack_from("<H", raw, 10)[0]
    try:
        data = zlib.decompress(raw[skip:-8], -15)
    except zlib.error as e:
        raise FormatError(f"{f.path!r}: block at byte {at}: {e}") from e
    if struct.unpack("<II", raw[-8:]) != (zlib.crc32(data), len(data)):
        raise FormatError(f"{f.path!r}: block at byte {at} is damaged")
    return data, at + size


def bgzf_first(f: ByteFile, begin: int, end: int) -> int | None:
    """The first block that starts in [begin, end): one that the file's end or another block follows."""
    at = begin
    while at < end:
        piece = f.get(at, min(READ_BYTES, end - at + 3))
        k = piece.find(b"\x1f\x8b\x08\x04")
        if k < 0:
            at += max(1, len(piece) - 3)
            continue
        size = bgzf_size(f, at + k)
        if size and at + k < end and (at + k + size == f.size or bgzf_size(f, at + k + size)):
            return at + k
        at += k + 1
    return None


def bgzf_compress(data: bytes) -> bytes:
    """``data`` as blocks, without the one that ends a file."""
    out = []
    for k in range(0, len(data), BLOCK_BYTES):
        part = data[k : k + BLOCK_BYTES]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(struct.pack("<4sIBBH2sHH", b"\x1f\x8b\x08\x04", 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


# zstd


def zstd_end(f: ByteFile, at: int) -> int | None:
    """The place behind the frame at ``at``, found by the sizes of its blocks; None where none starts."""
    head = f.get(at, 18)
    if len(head) >= 8 and head[1:4] == b"\x2a\x4d\x18" and head[0] & 0xF0 == 0x50:  # a frame to skip
        return at + 8 + struct.unpack_from("<I", head, 4)[0]
    if head[:4] != ZSTD_MAGIC or len(head) < 6 or head[4] & 8:
        return None
    flags = head[4]
    single = flags >> 5 & 1
    sizes = (1 if single else 0, 2, 4, 8)[flags >> 6]
    at += 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + sizes
    while True:
        h = f.get(at, 3)
        if len(h) < 3:
            return None
        v = int.from_bytes(h, "little")
        if v >> 1 & 3 == 3:
            return None
        at += 3 + (1 if v >> 1 & 3 == 1 else v >> 3)
        if v & 1:
            at += 4 * (flags >> 2 & 1)
            return at if at <= f.size else None


def zstd_first(f: ByteFile, begin: int, end: int) -> int | None:
    at = begin
    while at < end:
        piece = f.get(at, min(READ_BYTES, end - at + 3))
        k = 0 if at == 0 and zstd_end(f, 0) else piece.find(ZSTD_MAGIC)
        if k < 0:
            at += max(1, len(piece) - 3)
            continue
        behind = zstd_end(f, at + k)
        if behind and at + k < end and (behind == f.size or zstd_end(f, behind)):
            return at + k
        at += k + 1
    return None


def zstd_block(f: ByteFile, at: int) -> tuple[bytes, int]:
    import zstandard

    behind = zstd_end(f, at)
    if behind is None:
        raise FormatError(f"{f.path!r}: no whole frame starts at byte {at}")
    raw = f.need(at, behind - at)
    if raw[:4] != ZSTD_MAGIC:
        return b"", behind
    try:
        return zstandard.ZstdDecompressor().decompressobj().decompress(raw), behind
    except zstandard.ZstdError as e:
        raise FormatError(f"{f.path!r}: frame at byte {at}: {e}") from e


CODECS: dict[str, tuple[Callable, Callable]] = {"bgzf": (bgzf_first, bgzf_block), "zstd": (zstd_first, zstd_block)}


def blocks(f: ByteFile, begin: int, end: int, codec: str = "bgzf") -> Iterator[tuple[int, bytes]]:
    """(place, payload) of the blocks from the first that starts in the range on, to the file's end; none if none starts in it."""
    first, block = CODECS[codec]
    at = first(f, begin, end)
    if at is None and begin == 0 and f.size:
        raise FormatError(f"{f.path!r} does not start with a {codec} block")
    while at is not None and at < f.size:
        data, behind = block(f, at)
        yield at, data
        at = behind


def lines(f: ByteFile, begin: int, end: int, codec: str) -> Iterator[bytes]:
    """Pieces of whole lines: of those that start in the range's blocks."""
    rest, skip, ended = b"", begin > 0, False
    for at, data in blocks(f, begin, end, codec):
        if at >= end:  # only the line at hand goes on, or one that starts just here
            k = data.find(b"\n")
            if skip:
                return
            if k >= 0:
                yield rest + data[: k + 1]
                ended = True
                break
            rest += data
            continue
        rest += data
        if skip:
            k = rest.find(b"\n")
            if k < 0:
                rest = b""
                continue
            rest, skip = rest[k + 1 :], False
        k = rest.rfind(b"\n")
        if k >= 0:
            yield rest[: k + 1]
            rest = rest[k + 1 :]
    if rest and not ended and not skip:
        yield rest


class BlockText(DataSource):
    """Lines of block-compressed text as ``value``; options: path, codec (bgzf or zstd), part_bytes."""

    @classmethod
    def name(cls) -> str:
        return "block_text"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return BlockTextReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BlockTextWriter(self.options)


class BlockTextReader(DataSourceReader):
    def __init__(self, options: dict):
        self.codec, self.bytes = options.get("codec", "bgzf"), int(options.get("part_bytes", PART_BYTES))
        self.paths = files_of(options["path"], (".gz", ".bgz", ".zst"))

    def partitions(self) -> list[Range]:
        return ranges(self.paths, self.bytes)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        f = ByteFile(part.path)
        try:
            for piece in lines(f, part.begin, part.end, self.codec):
                rows = piece.split(b"\n")
                rows = rows[:-1] if rows[-1] == b"" else rows
                yield pa.RecordBatch.from_arrays([pa.array([r.removesuffix(b"\r") for r in rows], pa.binary()).cast(pa.string())], names=["value"])
        finally:
            f.close()


@dataclass
class Written(WriterCommitMessage):
    path: str


class BlockTextWriter(DataSourceArrowWriter):
    """A file for each task, under its name only when the job commits; a zstd frame, or some BGZF blocks, for each batch of lines."""

    def __init__(self, options: dict):
        self.codec, self.path = options.get("codec", "bgzf"), options["path"].rstrip("/")
        self.suffix = options.get("suffix", ".txt") + {"bgzf": ".gz", "zstd": ".zst"}[self.codec]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, folder = filesystem(self.path)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/.part-{task.partitionId():05d}-{task.taskAttemptId()}"
        with system.open_output_stream(name, compression=None) as out:
            for batch in iterator:
                data = "".join(f"{x}\n" for x in batch.column(0).to_pylist()).encode()
                if self.codec == "bgzf":
                    out.write(bgzf_compress(data))
                elif data:
                    import zstandard

                    out.write(zstandard.ZstdCompressor().compress(data))
            if self.codec == "bgzf":
                out.write(BGZF_END)
        return Written(name)

    def commit(self, messages: list[Written]) -> None:
        system, folder = filesystem(self.path)
        for k, m in enumerate(x for x in messages if x):
            system.move(m.path, f"{folder}/part-{k:05d}{self.suffix}")

    def abort(self, messages: list[Written]) -> None:
        system, _ = filesystem(self.path)
        for m in messages:
            if m:
                system.delete_file(m.path)


def write_block_text(lines: DataFrame, path: str, codec: str = "bgzf", suffix: str = ".txt") -> None:
    """Lines (value) as a folder of block-compressed files, one for each task."""
    lines.sparkSession.dataSource.register(BlockText)
    lines.select("value").write.format("block_text").option("codec", codec).option("suffix", suffix).mode("append").save(path)


def read_block_text(spark: SparkSession, path: str, codec: str = "bgzf", part_bytes: int = PART_BYTES) -> DataFrame:
    """Lines (value) of a block-compressed file or of a folder of such, read in byte ranges by many tasks."""
    spark.dataSource.register(BlockText)
    return spark.read.format("block_text").option("codec", codec).option("part_bytes", part_bytes).load(path)
