"""Whitespace-delimited text formats of statistical genetics, and PLINK genotypes.

Tables are read line by line and split in the JVM.  A dot or NA is null.  In a
path, ``@`` stands for the chromosomes 1 to 22.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.stats import numbered
from ..operators.bands import MISSING, pack, unpack, with_counts
from .blocks import PART_BYTES, ByteFile, FormatError

CHROMOSOMES = range(1, 23)
BIM = ["CHR", "SNP", "CM", "BP", "A1", "A2"]
FAM = ["FID", "IID", "PAT", "MAT", "SEX", "PHENO"]
NUMBERS = {"BP": "long", "CM": "double", "MAF": "double", "FRQ": "double", "N": "double", "Z": "double", "P": "double", "L2": "double"}
# The first bytes of a SNP-major genotype file, and the count of the first allele by a two-bit code (-1: missing).
MAGIC = b"\x6c\x1b\x01"
CODES = np.array([2, -1, 1, 0], np.int8)
#: A byte of the file with its four codes as those of packed genotypes.
RECODED = pack(CODES[np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3])[:, 0]


def paths_of(path: str) -> list[str]:
    return [path.replace("@", str(c)) for c in CHROMOSOMES] if "@" in path else [path]


def _typed(df: DataFrame, names: list[str], types: dict[str, str]) -> DataFrame:
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    cols = []
    for i, name in enumerate(names):
        x = F.get(parts, i)
        x = F.when(~x.isin(".", "NA", ""), x)
        cols.append((x.try_cast(types[name]) if name in types else x).alias(name))
    return df.filter(F.trim("value") != "").select(*cols)


def read_table(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """The first line of a file that isn't blank is its header; all files must have the same one."""
    files = paths_of(path)
    text = spark.read.text(files)
    line = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("at", F.monotonically_increasing_id())
    heads = line.filter(F.trim("value") != "").groupBy("file").agg(F.min_by("value", F.struct("block", "at")).alias("head"))
    tops = [r["head"] for r in heads.select("head").distinct().collect()]
    if not tops:
        raise FormatError(f"{path!r} is empty")
    if len({" ".join(t.split()) for t in tops}) > 1:
        raise FormatError(f"the files of {path!r} have different headers")
    head = tops[0]
    return _typed(text.filter(~F.col("value").isin(*tops)), head.split(), NUMBERS if types is None else types)


def read_plain(spark: SparkSession, path: str, names: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """A table without a header."""
    return _typed(spark.read.text(paths_of(path)), names, NUMBERS if types is None else types)


def read_ldscore(spark: SparkSession, path: str) -> DataFrame:
    """LD scores of one file or of all chromosomes: CM and MAF go where both are there, a SNP's first row stays, in genome order."""
    head = read_table(spark, path, {}).columns
    scores = {c: "double" for c in head if c not in ("CHR", "SNP", "BP", "CM", "MAF")}
    d = read_table(spark, path, NUMBERS | scores | {"CHR": "int"})
    if {"CM", "MAF"} <= set(head):
        d = d.drop("CM", "MAF")
    first = Window.partitionBy("SNP").orderBy("CHR", "BP")
    return d.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k").orderBy("CHR", "BP")


def beside(tables: list[DataFrame], key: str = "SNP") -> DataFrame:
    """LD scores of several files side by side; the SNPs must be the same ones, scores of file k get the suffix _k."""
    out = None
    for k, d in enumerate(tables):
        scores = [c for c in d.columns if c not in ("CHR", "SNP", "BP")]
        part = d.select(*([c for c in ("CHR", "BP") if c in d.columns] if k == 0 else []), key, *[F.col(c).alias(f"{c}_{k}") for c in scores])
        if out is None:
            out = part
            continue
        if out.select(key).exceptAll(part.select(key)).union(part.select(key).exceptAll(out.select(key))).take(1):
            raise FormatError("the LD score files hold different SNPs")
        out = out.join(part, key).select(*out.columns, *[c for c in part.columns if c != key])
    return out


def read_m(spark: SparkSession, path: str) -> list[float]:
    """Annotation sizes summed over the chromosomes; every token must be a number."""
    total: list[float] = []
    for f in paths_of(path):
        for row in spark.read.text(f).filter(F.trim("value") != "").collect():  # one line a file
            try:
                got = [float(x) for x in row[0].split()]
            except ValueError as e:
                raise FormatError(f"{f!r}: {e}") from e
            if any(np.isnan(got)):
                raise FormatError(f"{f!r} holds a value that is not a number")
            if total and len(total) != len(got):
                raise FormatError(f"{f!r} has another number of annotations")
            total = [a + b for a, b in zip(total, got, strict=True)] if total else got
    return total


def read_frq(spark: SparkSession, path: str) -> DataFrame:
    d = read_table(spark, path)
    return d.withColumnRenamed("MAF", "FRQ") if "MAF" in d.columns else d


def read_cts(spark: SparkSession, path: str, snps: DataFrame | None = None) -> DataFrame:
    """SNP and a continuous value; where ``snps`` is given the list must be the same."""
    d = read_plain(spark, path, ["SNP", "value"], {"value": "double"})
    if snps is not None and (d.select("SNP").exceptAll(snps.select("SNP")).take(1) or snps.select("SNP").exceptAll(d.select("SNP")).take(1)):
        raise FormatError("the SNPs differ from the list")
    return d


def read_sumstats(spark: SparkSession, path: str, alleles: bool = False, dropna: bool = True) -> DataFrame:
    d = read_table(spark, path)
    names = ["SNP", "Z", "N", *(["A1", "A2"] if alleles else [])]
    if missing := set(names) - set(d.columns):
        raise FormatError(f"{path!r} lacks {', '.join(sorted(missing))}")
    d = d.select(*names)
    return d.dropna() if dropna else d


def read_annot(spark: SparkSession, path: str, thin: bool = False) -> DataFrame:
    """Annotations; the thin form has no identifying columns."""
    head = read_table(spark, path, {}).columns
    return read_table(spark, path, {c: "double" for c in head if thin or c not in ("CHR", "BP", "SNP", "CM")} | {"BP": "long", "CM": "double"})


def overlap_matrix(annot: DataFrame) -> list[list[float]]:
    """Sums of the products of every two annotations, from one aggregation."""
    names = [c for c in annot.columns if c not in ("CHR", "BP", "SNP", "CM")]
    row = annot.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    return [[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))]


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    return read_plain(spark, path, BIM)


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    return read_plain(spark, path, FAM, {})


def only_listed(df: DataFrame, listed: DataFrame, key: str = "SNP") -> DataFrame:
    """Rows whose key is in the list."""
    return df.join(listed.select(key), key, "left_semi")


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Intervals of a browser file: 0-based half-open becomes 1-based inclusive."""
    text = spark.read.text(path).filter(~F.col("value").rlike(r"^(#|track|browser|\s*$)"))
    d = _typed(text, ["chrom", "start", "end"], {"start": "long", "end": "long"})
    return d.select("chrom", (F.col("start") + 1).alias("start"), "end")


@dataclass
class Snps(InputPartition):
    """SNPs ``first`` to ``first + count`` of a file; ``before``: SNPs of the files in front of it."""

    path: str
    first: int
    count: int
    before: int


class BedSource(DataSource):
    """Rows (index, packed) of SNP-major genotype files, read by ranges of whole SNPs; options: path (@: the chromosomes), people, part_bytes.

    Codes are those of ``operators.bands``: counts of the first allele, 3 where missing."""

    @classmethod
    def name(cls) -> str:
        return "plink_bed"

    def schema(self) -> str:
        return "index long, packed binary"

    def reader(self, schema) -> DataSourceReader:
        return BedReader(self.options)


class BedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.width = -(-int(options["people"]) // 4)
        self.people, self.bytes, self.paths = int(options["people"]), int(options.get("part_bytes", PART_BYTES)), paths_of(options["path"])

    def partitions(self) -> list[Snps]:
        out, before = [], 0
        for path in self.paths:
            f = ByteFile(path)
            head, size = f.get(0, 3), f.size - 3
            f.close()
            if head != MAGIC:
                raise FormatError(f"{path!r} is no SNP-major genotype file")
            if size % self.width:
                raise FormatError(f"the length of {path!r} doesn't fit the number of people")
            snps, step = size // self.width, max(1, self.bytes // self.width)
            out += [Snps(path, k, min(step, snps - k), before) for k in range(0, snps, step)]
            before += snps
        return out or [Snps("", 0, 0, 0)]

    def read(self, part: Snps) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        f = ByteFile(part.path)
        step = max(1, (1 << 20) // self.width)
        try:
            for k in range(part.first, part.first + part.count, step):
                n = min(step, part.first + part.count - k)
                raw = RECODED[np.frombuffer(f.need(3 + k * self.width, n * self.width), np.uint8)].reshape(n, self.width)
                if self.people % 4:  # people that aren't there
                    raw = raw.copy()
                    raw[:, -1] |= (0xFF << 2 * (self.people % 4)) & 0xFF
                rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(self.width), n, [None, pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + n) + part.before), rows.cast(pa.binary())], names=["index", "packed"])
        finally:
            f.close()


def read_packed(spark: SparkSession, prefix: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per SNP: the columns of .bim, place, _people and _packed (``operators.bands``).  Files may be of any size; @ stands for the chromosomes."""
    people = read_fam(spark, f"{paths_of(prefix)[0]}.fam").count()
    if not people:
        raise FormatError(f"{prefix!r} has no people")
    spark.dataSource.register(BedSource)
    text = spark.read.text([f"{p}.bim" for p in paths_of(prefix)]).filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    order = F.create_map(*[F.lit(x) for k, p in enumerate(paths_of(prefix)) for x in (f"{p}.bim".rsplit("/", 1)[-1], k)])
    text = text.withColumn("file", F.element_at(order, F.url_decode(F.substring_index("file", "/", -1)))).withColumn("_at", F.monotonically_increasing_id())
    bim = numbered(text, ["file", "block", "_at"])
    cells = F.split(F.trim("value"), r"\s+")
    bim = bim.select("index", *[F.get(cells, i).try_cast(NUMBERS.get(n, "string")).alias(n) for i, n in enumerate(BIM)])
    g = spark.read.format("plink_bed").option("people", people).option("part_bytes", part_bytes).load(f"{prefix}.bed")
    return bim.join(g, "index").select(F.col("index").alias("place"), *BIM, F.lit(people).alias("_people"), F.col("packed").alias("_packed"))


def read_genotypes(spark: SparkSession, prefix: str, maf: float = 0.0, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per SNP: the columns of .bim, n (genotypes seen), freq (of the first allele) and genotypes (counts, -1 missing).

    SNPs of one genotype only and those with a minor frequency up to ``maf`` are left out.  Files are read by ranges of whole
    SNPs and must not be compressed."""
    d = with_counts(read_packed(spark, prefix, part_bytes)).drop("missing")
    d = d.filter(F.least("freq", 1 - F.col("freq")) > maf)
    names = [c for c in d.columns if c not in ("_people", "_packed")]
    schema = T.StructType([*d.select(*names).schema.fields, T.StructField("genotypes", T.ArrayType(T.ByteType()))])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            people, raws = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
            rows = [np.where((g := unpack([raw], n)[0]) == MISSING, -1, g).astype(np.int8) for raw, n in zip(raws, people, strict=True)]
            varies = pa.array([len(np.unique(g[g >= 0])) > 1 for g in rows], pa.bool_())
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(rows, pa.list_(pa.int8()))], names=[*names, "genotypes"])
            yield out.filter(varies)

    with_arrays = d.select(*names, "_people", "_packed").mapInArrow(decode, schema)
    return with_arrays.select("place", *BIM, "n", "freq", "genotypes")
