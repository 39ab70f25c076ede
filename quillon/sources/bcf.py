"""BCF variants as a data source: byte ranges of the file, typed values decoded to the text of a VCF line.

The lines go through the header-typed reader of VCF text, so both formats give the same columns; fields that are not asked for are not
parsed from the line.  A record belongs to the range in whose blocks it starts; a range's first record is found by its header's
own rules, which ``CHAIN`` records in a row must keep.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from .blocks import MOST_AHEAD, PART_BYTES, ByteFile, FormatError, Range, blocks, files_of, ranges
from .formats import header_fields, vcf_columns

#: Records in a row that show where records start.
CHAIN = 6
# By type code the size, and the codes of a missing value and of a vector's end.
INTEGERS = {1: ("b", 1, -128, -127), 2: ("h", 2, -32768, -32767), 3: ("i", 4, -(2**31), -(2**31) + 1)}
FLOAT_MISSING, FLOAT_END = 0x7F800001, 0x7F800002


def header(f: ByteFile) -> tuple[str, tuple[int, int]]:
    """The header's text, and the place of the first record (block, offset in it)."""
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

    upto(9)
    if data[:3] != b"BCF" or data[3] != 2:
        raise FormatError(f"{f.path!r} is no BCF file of version 2")
    end = 9 + struct.unpack_from("<I", data, 5)[0]
    upto(end)
    place, start = next(p for p in reversed(at) if p[1] <= end)
    return data[9:end].rstrip(b"\0").decode(), (place, end - start)


def dictionaries(text: str) -> tuple[dict[int, str], dict[int, str]]:
    """Names by number: of filters, INFO and FORMAT fields together, and of contigs; IDX gives numbers, else the order of the lines does."""
    strings, contigs = {0: "PASS"}, {}
    known = {"PASS": 0}
    for line in text.split("\n"):
        if not (m := re.match(r"##(FILTER|INFO|FORMAT|contig)=<(?:.*,)?ID=([^,>]+)", line)):
            continue
        idx = re.search(r"[<,]IDX=(\d+)", line)
        if m[1] == "contig":
            contigs[int(idx[1]) if idx else len(contigs)] = m[2]
        elif m[2] not in known:
            known[m[2]] = int(idx[1]) if idx else max(strings) + 1
            strings[known[m[2]]] = m[2]
    return strings, contigs


class Values:
    """Typed values from a place of a record on."""

    def __init__(self, raw: bytes, at: int):
        self.raw, self.at = raw, at

    def kind(self) -> tuple[int, int]:
        """Type code and number of values."""
        b = self.raw[self.at]
        self.at += 1
        n = b >> 4
        return (b & 15, n) if n < 15 else (b & 15, self.integers()[0])

    def of(self, code: int, n: int) -> list | str:
        """n values; None: missing; a vector's end cuts them off."""
        if code == 7:
            out = self.raw[self.at : self.at + n].split(b"\0")[0].decode()
            self.at += n
            return out
        if code in INTEGERS:
            letter, size, missing, end = INTEGERS[code]
            got = struct.unpack_from(f"<{n}{letter}", self.raw, self.at)
            self.at += n * size
            got = got[: got.index(end)] if end in got else got
            return [None if x == missing else x for x in got]
        if code == 5:
            bits = struct.unpack_from(f"<{n}I", self.raw, self.at)
            got = struct.unpack_from(f"<{n}f", self.raw, self.at)
            self.at += 4 * n
            n = bits.index(FLOAT_END) if FLOAT_END in bits else n
            return [None if b == FLOAT_MISSING else v for b, v in zip(bits[:n], got[:n], strict=True)]
        if code == 0:
            return []
        raise FormatError(f"type {code} of a value is unknown")

    def integers(self) -> list:
        return self.of(*self.kind())


def number(x: float | int | None) -> str:
    """A value as text; floats in the fewest digits that give their single precision again."""
    if x is None:
        return "."
    if isinstance(x, int):
        return str(x)
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else str(np.float32(x)) if x == x else "nan"


def texts(v: list | str) -> str:
    return (v or ".") if isinstance(v, str) else ",".join(map(number, v)) or "."


def genotype(v: list) -> str:
    """Alleles with / or | between them."""
    if not v:
        return "."
    out = []
    for k, x in enumerate(v):
        sep = "" if k == 0 else "|" if x is not None and x & 1 else "/"
        out.append(sep + ("." if x is None or x >> 1 == 0 else str((x >> 1) - 1)))
    return "".join(out)


def line(raw: bytes, strings: dict[int, str], contigs: dict[int, str], samples: int) -> str:
    """One record (without its two lengths) as a line of VCF."""
    chrom, pos, _, qual, n_info, n_allele, n_format = struct.unpack_from("<iiiIHHI", raw, 0)
    n_sample, n_fmt = n_format & 0xFFFFFF, n_format >> 24
    if n_sample != samples:
        raise FormatError("a record has another number of samples than the header")
    shared = Values(raw, 24)
    name = shared.of(*shared.kind()) or "."
    alleles = [shared.of(*shared.kind()) or "." for _ in range(n_allele)]
    filters = [strings[k] for k in shared.integers()]
    info = []
    for _ in range(n_info):
        key = strings[shared.integers()[0]]
        code, n = shared.kind()
        v = shared.of(code, n)
        info.append(key if code == 0 or n == 0 else f"{key}={texts(v)}")
    q = "." if qual == FLOAT_MISSING else number(struct.unpack("<f", struct.pack("<I", qual))[0])
    out = [contigs[chrom], str(pos + 1), name, alleles[0] if alleles else ".", ",".join(alleles[1:]) or ".", q, ";".join(filters) or ".", ";".join(info) or "."]
    if n_fmt:
        keys, cells = [], [[] for _ in range(samples)]
        for _ in range(n_fmt):
            key = strings[shared.integers()[0]]
            keys.append(key)
            code, n = shared.kind()
            for cell in cells:
                v = shared.of(code, n)
                cell.append(genotype(v) if key == "GT" and not isinstance(v, str) else texts(v))
        out += [":".join(keys), *[":".join(c) for c in cells]]
    return "\t".join(out)


@dataclass
class BcfRange(Range):
    text: str
    first: tuple[int, int]


def _starts(data: bytes, at: int, contigs: dict[int, str], samples: int) -> int | None:
    """The length of the record at ``at`` if its header keeps the rules; 0 where it is cut off."""
    if at + 32 > len(data):
        return 0
    shared, own = struct.unpack_from("<II", data, at)
    chrom, pos, size, _, _, alleles, fmt = struct.unpack_from("<iiiIHHI", data, at + 8)
    fine = 24 <= shared < 1 << 26 and own < 1 << 28 and chrom in contigs and pos >= -1 and size >= 0 and fmt & 0xFFFFFF == samples and alleles >= 1 and (own > 0) == (fmt >> 24 > 0 and samples > 0)
    return 8 + shared + own if fine and data[at + 32] & 15 == 7 else None


def resync(data: bytes, upto: int, contigs: dict[int, str], samples: int, last: bool) -> int | None:
    for k in range(min(upto, len(data))):
        p, good = k, 0
        while good < CHAIN:
            n = _starts(data, p, contigs, samples)
            if n is None or n == 0:
                break
            good, p = good + 1, p + n
        if good == CHAIN or (good and last and p == len(data)):
            return k
    return None


def records(f: ByteFile, part: BcfRange) -> Iterator[bytes]:
    """The records that start in the range's blocks."""
    if part.end <= part.first[0]:
        return
    _, contigs = dictionaries(part.text)
    samples = len(header_fields(part.text.split("\n"))[0])
    found = part.begin <= part.first[0]
    data, owned, tried, skip = b"", 0, 0, part.first[1] if found else 0
    for place, more in blocks(f, part.first[0] if found else part.begin, part.end):
        inside = place < part.end
        data += more
        owned = len(data) if inside else owned
        if skip:
            data, owned, skip = data[skip:], owned - skip, 0
        if not found:
            if len(data) < 2 * tried or (inside and len(data) < 1 << 20):
                continue
            tried = len(data)
            k = resync(data, owned, contigs, samples, False)
            if k is None:
                if not inside and len(data) > owned + MOST_AHEAD:
                    return
                continue
            data, owned, found = data[k:], owned - k, True
        at = 0
        while at < owned and at + 8 <= len(data):
            n = 8 + sum(struct.unpack_from("<II", data, at))
            if at + n > len(data):
                break
            yield data[at + 8 : at + n]
            at += n
        data, owned = data[at:], owned - at
        if not inside and owned <= 0:
            return
    if not found and data:
        k = resync(data, owned, contigs, samples, True)
        if k is None:
            return
        data, owned = data[k:], owned - k
    at = 0
    while at < owned:
        n = 8 + sum(struct.unpack_from("<II", data, at)) if at + 8 <= len(data) else len(data) + 1
        if at + n > len(data):
            raise FormatError(f"{f.path!r} ends within a record")
        yield data[at + 8 : at + n]
        at += n


class BcfSource(DataSource):
    """Lines (value); options: path (a file or folder), part_bytes."""

    @classmethod
    def name(cls) -> str:
        return "bcf_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return BcfReader(self.options)


class BcfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.bytes, self.paths = int(options.get("part_bytes", PART_BYTES)), files_of(options["path"], (".bcf",))

    def partitions(self) -> list[BcfRange]:
        out = []
        for path in self.paths:
            f = ByteFile(path)
            text, first = header(f)
            f.close()
            out += [BcfRange(r.path, r.begin, r.end, text, first) for r in ranges([path], self.bytes)]
        return out

    def read(self, part: BcfRange) -> Iterator[pa.RecordBatch]:
        f = ByteFile(part.path)
        strings, contigs = dictionaries(part.text)
        samples = len(header_fields(part.text.split("\n"))[0])
        try:
            out: list[str] = []
            for raw in records(f, part):
                out.append(line(raw, strings, contigs, samples))
                if len(out) == 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(out)], names=["value"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        finally:
            f.close()


def read_bcf(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """The columns of ``formats.read_vcf``."""
    spark.dataSource.register(BcfSource)
    paths = files_of(path, (".bcf",))
    if not paths:
        raise FileNotFoundError(path)
    f = ByteFile(paths[0])
    text, _ = header(f)
    f.close()
    return vcf_columns(spark.read.format("bcf_lines").option("part_bytes", part_bytes).load(path), header_fields(text.split("\n")))
