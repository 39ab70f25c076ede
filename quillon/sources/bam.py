"""BAM alignments as a data source: byte ranges of the file, records found anew in each range, columns cut out by arrays.

A record belongs to the range in whose blocks it starts.  A range's first record is found by its header's own rules
(reference numbers, lengths that add up, a name that ends where it says), which ``CHAIN`` records in a row must keep.
Columns and values are those of the SAM text reader.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader

from .blocks import BGZF_END, MOST_AHEAD, PART_BYTES, ByteFile, FormatError, Range, Written, bgzf_compress, blocks, files_of, filesystem, ranges

READS = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string"
# The letters of operations and of bases by code.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
#: Records in a row that show where records start; longest header fields that are believed.
CHAIN, MOST_RECORD = 8, 1 << 28
#: Uncompressed bytes that are decoded at a time.
CHUNK = 4 << 20
#: Places that are looked at together when a range's first record is sought.
LOOK = 1 << 16
_CODES = np.full(256, 15, np.uint8)
_CODES[[ord(c) for c in BASES]] = range(len(BASES))
_PAIRS = np.array([[ord(BASES[v >> 4]), ord(BASES[v & 15])] for v in range(256)], np.uint8)


@dataclass
class BamRange(Range):
    """A byte range, the file's references, and the place of its first record: block and offset in it."""

    names: list[str]
    first: tuple[int, int]


def header(f: ByteFile) -> tuple[str, list[str], tuple[int, int]]:
    """The header's text, the reference names, and the place of the first record (block, offset)."""
    data, at, source = b"", [], blocks(f, 0, f.size)

    def upto(n: int) -> None:
        nonlocal data
        while len(data) < n:
            try:
                place, more = next(source)
            except StopIteration:
                raise FormatError(f"{f.path!r}: the header is cut off") from None
            at.append((place, len(data)))
            data += more

    upto(8)
    if data[:4] != b"BAM\x01":
        raise FormatError(f"{f.path!r} is no BAM file")
    k = 8 + struct.unpack_from("<i", data, 4)[0]
    upto(k + 4)
    text, names = data[8:k].rstrip(b"\0").decode(), []
    (count,), k = struct.unpack_from("<i", data, k), k + 4
    for _ in range(count):
        upto(k + 4)
        n = struct.unpack_from("<i", data, k)[0]
        upto(k + 8 + n)
        names.append(data[k + 4 : k + 3 + n].decode())
        k += 8 + n
    place, start = next((p for p in reversed(at) if p[1] <= k), (0, 0))
    return text, names, (place, k - start)


def _fields(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The fixed fields of the records whose length stands at ``at``."""
    word = lambda k, kind="<i4": np.ndarray(max(0, len(raw) - 3), kind, raw, strides=(1,))[at + k]
    half = lambda k: np.ndarray(max(0, len(raw) - 1), "<u2", raw, strides=(1,))[at + k].astype(np.int64)
    return {
        "size": word(0).astype(np.int64), "ref": word(4), "pos": word(8), "name": raw[at + 12].astype(np.int64), "mapq": raw[at + 13], "ops": half(16), "flag": half(18),
        "seq": word(20).astype(np.int64), "next": word(24), "pnext": word(28), "tlen": word(32),
    }


def _plausible(raw: np.ndarray, at: np.ndarray, refs: int) -> np.ndarray:
    f = _fields(raw, at)
    least = 32 + f["name"] + 4 * f["ops"] + (f["seq"] + 1) // 2 + f["seq"]
    ok = (f["ref"] >= -1) & (f["ref"] < refs) & (f["next"] >= -1) & (f["next"] < refs) & (f["pos"] >= -1) & (f["pnext"] >= -1)
    return ok & (f["name"] >= 1) & (f["seq"] >= 0) & (f["size"] >= least) & (f["size"] < MOST_RECORD)


def resync(raw: np.ndarray, upto: int, refs: int, last: bool) -> int | None:
    """The first place below ``upto`` where CHAIN records in a row start, or all up to the file's end (last)."""
    end = max(0, min(upto, len(raw) - 36))
    for k in (k for a in range(0, end, LOOK) for k in (np.flatnonzero(_plausible(raw, np.arange(a, min(end, a + LOOK)), refs)) + a).tolist()):
        p, good = k, 0
        while good < CHAIN and p + 36 <= len(raw):
            one = np.array([p])
            name = int(raw[p + 12])
            if not _plausible(raw, one, refs)[0] or (p + 36 + name <= len(raw) and (raw[p + 35 + name] or not raw[p + 36 : p + 35 + name].all())):
                break
            good, p = good + 1, p + 4 + int(_fields(raw, one)["size"][0])
        else:
            if good == CHAIN or (last and p == len(raw)):
                return k
    return None


def _texts(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.StringArray:
    ends = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw[at].tobytes())]).cast(pa.string())


def _or_star(texts: pa.Array, there: np.ndarray) -> pa.Array:
    return pa.compute.if_else(pa.array(there), texts, "*")


def decode(raw: np.ndarray, at: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Records whose length stands at ``at`` as columns of READS."""
    import pyarrow.compute  # noqa: F401

    f = _fields(raw, at)
    refs = pa.array([*names, "*"])
    own, other = f["ref"].astype(np.int64), f["next"].astype(np.int64)
    rname = refs.take(pa.array(np.where(own < 0, len(names), own)))
    rnext = pa.compute.if_else(pa.array((other == own) & (own >= 0)), "=", refs.take(pa.array(np.where(other < 0, len(names), other))))
    k = at + 36 + f["name"]
    ends = np.concatenate(([0], np.cumsum(f["ops"])))
    op = np.ndarray(max(0, len(raw) - 3), "<u4", raw, strides=(1,))[np.repeat(k - 4 * ends[:-1], f["ops"]) + 4 * np.arange(ends[-1])]
    if len(op) and (op & 15).max() >= len(OPS):
        raise FormatError("an alignment has an unknown operation")
    words = np.char.add((op >> 4).astype("U10"), np.array(list(OPS))[op & 15]).tolist()
    cigar = ["".join(words[a:b]) or "*" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    k = k + 4 * f["ops"]
    packed = (f["seq"] + 1) // 2
    ends = np.concatenate(([0], np.cumsum(packed)))
    letters = _PAIRS[raw[np.repeat(k - ends[:-1], packed) + np.arange(ends[-1])]].ravel()
    seq = _or_star(_texts(letters, 2 * ends[:-1], f["seq"]), f["seq"] > 0)
    k = k + packed
    some = (f["seq"] > 0) & (raw[np.minimum(k, len(raw) - 1)] != 255)
    qual = _or_star(_texts(raw + np.uint8(33), k, np.where(some, f["seq"], 0)), some)
    long = lambda x: pa.array(x.astype(np.int64))
    cols = [
        _texts(raw, at + 36, f["name"] - 1), pa.array(f["flag"].astype(np.int32)), rname, long(f["pos"].astype(np.int64) + 1), pa.array(f["mapq"].astype(np.int32)), pa.array(cigar, pa.string()),
        rnext, long(f["pnext"].astype(np.int64) + 1), long(f["tlen"]), seq, qual,
    ]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in READS.split(", ")])


def records(f: ByteFile, part: BamRange) -> Iterator[pa.RecordBatch]:
    """The records that start in the range's blocks."""
    data, owned, tried, found = b"", 0, 0, part.begin <= part.first[0] < part.end
    if part.end <= part.first[0]:
        return
    begin = part.first[0] if found else part.begin
    skip = part.first[1] if found else 0

    def whole(last: bool) -> tuple[np.ndarray, list[int], int]:
        """Starts of the owned records that are complete, and where they end."""
        raw, at, starts = np.frombuffer(data, np.uint8), 0, []
        while at < owned and at + 4 <= len(data):
            size = struct.unpack_from("<i", data, at)[0]
            if not 32 <= size < MOST_RECORD:
                raise FormatError(f"{f.path!r}: a record near byte {begin} has a wrong length")
            if at + 4 + size > len(data):
                break
            starts.append(at)
            at += 4 + size
        if last and at < owned:
            raise FormatError(f"{f.path!r} ends within a record")
        return raw, starts, at

    for place, more in blocks(f, begin, part.end):
        inside = place < part.end
        if not inside and found and len(data) >= owned == 0:
            return  # nothing is open
        data += more
        owned = len(data) if inside else owned
        if skip:
            data, owned, skip = data[skip:], owned - skip, 0
        if not found:
            if len(data) < 2 * tried or (inside and len(data) < CHUNK):
                continue
            tried = len(data)
            raw = np.frombuffer(data, np.uint8)
            k = resync(raw, owned, len(part.names), False)
            if k is None:
                if not inside and len(data) > owned + MOST_AHEAD:
                    return  # so far on no record of ours has shown up
                continue
            data, owned, found = data[k:], owned - k, True
        if len(data) >= CHUNK or not inside:
            raw, starts, at = whole(False)
            if starts:
                yield decode(raw, np.array(starts), part.names)
            data, owned = data[at:], owned - at
            if not inside and owned <= 0:
                return
    if not found:  # the file ends here
        k = resync(np.frombuffer(data, np.uint8), owned, len(part.names), True)
        if k is None:
            return
        data, owned = data[k:], owned - k
    raw, starts, _ = whole(True)
    if starts:
        yield decode(raw, np.array(starts), part.names)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts without nulls, and where each starts in them and its length."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), ends[:-1], np.diff(ends)


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every piece, ``size`` of them, one piece after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(size.sum())


def _cigar(text: str) -> bytes:
    out, number = [], ""
    for c in text if text != "*" else "":
        if c.isdigit():
            number += c
        else:
            out.append(int(number) << 4 | OPS.index(c))
            number = ""
    return struct.pack(f"<{len(out)}I", *out)


def _letters(seq: pa.Array) -> pa.Array:
    """Bases in upper case, one byte each."""
    import pyarrow.compute as pc

    data, _, _ = _bytes_of(seq)
    if len(data) and data.max() > 127:  # no base: the code of N
        return pa.array(["".join(c if c.isascii() else "N" for c in x.upper()) for x in seq.to_pylist()], pa.string())
    return pc.ascii_upper(seq)


def encode(batch: pa.RecordBatch, refs: dict[str, int]) -> bytes:
    """Rows of READS as BAM records (no index bins of their own: the bin is that of an unplaced read)."""
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return b""
    col = dict(zip(batch.schema.names, batch.columns, strict=True))
    text = lambda c: pc.fill_null(col[c].cast(pa.string()), "*")
    number = lambda c: pc.fill_null(col[c].cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
    gone = lambda x: pc.if_else(pc.equal(x, "*"), "", x)
    name, name_at, name_n = _bytes_of(pc.if_else(pc.equal(text("qname"), ""), "*", text("qname")))
    words = text("cigar").dictionary_encode()
    each = [_cigar(x) for x in words.dictionary.to_pylist()]
    length, which = np.array([len(x) for x in each], np.int64), words.indices.to_numpy()
    ops, ops_n = np.frombuffer(b"".join(each), np.uint8), length[which]
    ops_at = (np.cumsum(length) - length)[which]
    seq, seq_at, seq_n = _bytes_of(_letters(gone(text("seq"))))
    qual, qual_at, qual_n = _bytes_of(gone(text("qual")))
    some = ~pc.equal(text("qual"), "*").to_numpy(zero_copy_only=False)
    if (some & (qual_n != seq_n)).any():
        raise FormatError("an alignment has a quality of another length than its bases")
    names = pa.array(list(refs), pa.string())
    ref = lambda c: np.append(np.array(list(refs.values()), np.int64), -1)[pc.fill_null(pc.index_in(col[c].cast(pa.string()), value_set=names), len(refs)).to_numpy(zero_copy_only=False)]
    own = ref("rname")
    other = np.where(pc.equal(text("rnext"), "=").to_numpy(zero_copy_only=False), own, ref("rnext"))
    packed_n = (seq_n + 1) // 2
    kinds = [("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("seq", "<i4"), ("next", "<i4"), ("pnext", "<i4"), ("tlen", "<i4")]
    head = np.zeros(n, np.dtype(kinds))
    values = {
        "size": 32 + name_n + 1 + ops_n + packed_n + seq_n, "ref": own, "pos": number("pos") - 1, "name": name_n + 1, "mapq": number("mapq"), "bin": np.full(n, 4680), "ops": ops_n // 4,
        "flag": number("flag"), "seq": seq_n, "next": other, "pnext": number("pnext") - 1, "tlen": number("tlen"),
    }
    for k, v in values.items():
        least, most = np.iinfo(head[k].dtype).min, np.iinfo(head[k].dtype).max
        if v.min() < least or v.max() > most:
            raise FormatError(f"an alignment's {k} is not within {least} to {most}")
        head[k] = v
    size = 4 + values["size"]
    at = np.cumsum(size) - size
    out = np.zeros(size.sum(), np.uint8)
    out[at[:, None] + np.arange(36)] = head.view(np.uint8).reshape(n, 36)
    at = at + 36
    out[_places(at, name_n)] = name[_places(name_at, name_n)]
    at = at + name_n + 1
    out[_places(at, ops_n)] = ops[_places(ops_at, ops_n)]
    at = at + ops_n
    codes = np.zeros(2 * packed_n.sum(), np.uint8)
    codes[_places(2 * (np.cumsum(packed_n) - packed_n), seq_n)] = _CODES[seq[_places(seq_at, seq_n)]]
    out[_places(at, packed_n)] = codes[::2] << 4 | codes[1::2]
    at = at + packed_n
    there = np.where(some, seq_n, 0)
    letters = qual[_places(qual_at, there)]
    if len(letters) and (letters.min() < 33 or letters.max() > 126):
        raise FormatError("an alignment has a quality outside of ! to ~")
    out[_places(at, there)] = letters - np.uint8(33)
    out[_places(at, seq_n - there)] = 255
    return out.tobytes()


class BamSource(DataSource):
    """Options: path (a file or folder), part_bytes; for writing also references, names joined by commas."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BamWriter(self.options)


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.bytes, self.paths = int(options.get("part_bytes", PART_BYTES)), files_of(options["path"], (".bam",))

    def partitions(self) -> list[BamRange]:
        out = []
        for path in self.paths:
            f = ByteFile(path)
            _, names, first = header(f)
            f.close()
            out += [BamRange(r.path, r.begin, r.end, names, first) for r in ranges([path], self.bytes)]
        return out

    def read(self, part: BamRange) -> Iterator[pa.RecordBatch]:
        f = ByteFile(part.path)
        try:
            yield from records(f, part)
        finally:
            f.close()


class BamWriter(DataSourceArrowWriter):
    """A file for each task, under its name only when the job commits."""

    def __init__(self, options: dict):
        self.path, self.names = options["path"].rstrip("/"), [n for n in options.get("references", "").split(",") if n]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, folder = filesystem(self.path)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/.part-{task.partitionId():05d}-{task.taskAttemptId()}"
        refs = {n: k for k, n in enumerate(self.names)}
        with system.open_output_stream(name) as out:
            text = "".join(f"@SQ\tSN:{n}\tLN:{2**31 - 1}\n" for n in self.names).encode()
            head = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.names))
            out.write(bgzf_compress(head + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 2**31 - 1) for n in self.names)))
            for batch in iterator:
                out.write(bgzf_compress(encode(batch, refs)))
            out.write(BGZF_END)
        return Written(name)

    def commit(self, messages: list[Written]) -> None:
        system, folder = filesystem(self.path)
        for k, m in enumerate(x for x in messages if x):
            system.move(m.path, f"{folder}/part-{k:05d}.bam")

    def abort(self, messages: list[Written]) -> None:
        system, _ = filesystem(self.path)
        for m in messages:
            if m:
                system.delete_file(m.path)


def read_bam(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Alignments with the columns of READS; an unplaced read has reference * and position 0."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("part_bytes", part_bytes).load(path)


def write_bam(rows: DataFrame, path: str, references: list[str]) -> None:
    """Rows of READS as a folder of BAM files, one for each task."""
    rows.sparkSession.dataSource.register(BamSource)
    rows.select(*[c.split()[0] for c in READS.split(", ")]).write.format("bam").option("references", ",".join(references)).mode("append").save(path)
