"""File sources: format by suffix, tabular formats, and genomic text formats.

Text formats are read line by line and split in the JVM, so columns are pruned
and filters run right after the split; plain and block gzip both decode.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bam import read_bam
from .bigbin import read_bigbed, read_bigwig
from .blocks import ByteFile, bgzf_size, read_block_text

# Suffixes and their formats, in the order they are tried.
SUFFIXES = [
    (".csv", "csv"), (".parquet", "parquet"), (".vcf", "vcf"), (".bed", "bed"), (".gtf", "gtf"), (".gff3", "gff"), (".gff", "gff"),
    (".sam", "sam"), (".bam", "bam"), (".cram", "cram"), (".bcf", "bcf"), (".bw", "bigwig"), (".bigwig", "bigwig"), (".bb", "bigbed"), (".bigbed", "bigbed"), (".fasta", "fasta"), (".fa", "fasta"), (".fastq", "fastq"), (".fq", "fastq"),
]
BARE = ("csv", "parquet", "bam", "cram", "bcf", "bigwig", "bigbed")
GENE = "seqid string, source string, type string, start long, end long, score double, strand string, frame string"
READS = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string"


class UnsupportedFormat(ValueError):
    """A format that is known and can't be read here."""

    kind = "unsupported_format"


def infer(path: str) -> str | None:
    """The format of a path, case-insensitive; .gz counts for the text formats only."""
    low = path.lower()
    for suffix, fmt in SUFFIXES:
        if low.endswith(suffix) or (fmt not in BARE and low.endswith(suffix + ".gz")):
            return fmt
    return None


def normalise_path(path: str) -> str:
    """A path from the root: slashes at both ends and a leading ./ or . go, one slash comes in front."""
    p = path.strip("/")
    p = p[2:] if p.startswith("./") else p[1:] if p.startswith(".") else p
    return "/" + p.lstrip("/")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (value) of a text file; one in block gzip, where Arrow reaches it, is read in pieces by many tasks."""
    if path.lower().endswith((".gz", ".bgz")):
        try:
            f = ByteFile(path)
            blocked = bgzf_size(f, 0) is not None
            f.close()
        except (OSError, pa.ArrowException):
            blocked = False
        if blocked:
            return read_block_text(spark, path)
    return spark.read.text(path)


def _cells(df: DataFrame, ddl: str, sep: str = "\t") -> DataFrame:
    parts = F.split("value", sep, -1)
    cols: list[Column] = []
    for i, item in enumerate(ddl.split(", ")):
        name, kind = item.split(" ")
        x = F.get(parts, i)
        cols.append((x if kind == "string" else F.when(x != ".", x).try_cast(kind)).alias(name))
    return df.select(*cols)


def read_tsv(spark: SparkSession, path: str, schema: str | None = None, header: bool = False) -> DataFrame:
    """Tab-separated text; with a schema its columns are taken by position.  A .zst file (or a folder of such with codec zstd) is read frame by frame by many tasks."""
    reader = spark.read.option("sep", "\t").option("header", header)
    if path.lower().endswith(".zst"):
        if not schema:
            raise ValueError("a compressed table needs a schema")
        lines = read_block_text(spark, path, "zstd")
        if header:
            lines = lines.filter(F.col("value") != lines.first()[0])
        struct = lines.select(F.from_csv("value", schema, {"sep": "\t", "mode": "PERMISSIVE"}).alias("r"))
        return struct.select("r.*")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    fmt = fmt or infer(path)
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if fmt == "tsv":
        return spark.read.option("header", True).option("inferSchema", True).option("sep", "\t").csv(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "cram":
        raise UnsupportedFormat(f"{path!r}: CRAM can't be read, as no decoder is available; convert it to BAM")
    from .bcf import read_bcf

    reader = {"bcf": read_bcf, "bigwig": read_bigwig, "bigbed": read_bigbed, "bam": read_bam, "vcf": read_vcf, "bed": read_bed, "gtf": read_genes, "gff": read_genes, "sam": read_sam, "fasta": read_fasta, "fastq": read_fastq}.get(fmt or "")
    if reader is None:
        raise ValueError(f"unknown format of {path!r}")
    return reader(spark, path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Intervals, 0-based half-open: chrom, start, end; further columns are dropped."""
    return _cells(text_lines(spark, path).filter(~F.col("value").rlike(r"^(#|track|browser|\s*$)")), "chrom string, start long, end long")


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """GTF and GFF: the eight standard columns, 1-based closed."""
    return _cells(text_lines(spark, path).filter(~F.col("value").rlike(r"^(#|\s*$)")), GENE)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return _cells(text_lines(spark, path).filter(~F.col("value").rlike(r"^(@[A-Z][A-Z](\t|$)|\s*$)")), READS)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, description, sequence; a record is what stands between two > at line starts."""
    rows = spark.read.option("lineSep", "\n>").text(path).filter("trim(value) <> ''")
    head = F.regexp_extract("value", r"^>?([^\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s", "")
    return rows.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_extract(head, r"^\S*\s*(.*)$", 1)).alias("description"), body.alias("sequence"))


def _framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (own, k, value) of a partition, in the files' order, as records (own, record, l0 to l3): those that start here; lines that are not here are null."""
    held: list[pa.RecordBatch] = []

    def records(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        own, k, value = t["own"].to_numpy(), t["k"].to_numpy(), t["value"].combine_chunks()
        cols = [pa.array(own[starts]), pa.array(k[starts] // 4)]
        for j in range(4):
            at = np.minimum(starts + j, len(k) - 1)
            cols.append(value.take(pa.array(at, mask=(own[at] != own[starts]) | (k[at] != k[starts] + j))))
        return pa.RecordBatch.from_arrays(cols, names=["own", "record", "l0", "l1", "l2", "l3"])

    for batch in batches:
        t = pa.Table.from_batches([*held, batch])
        starts = np.flatnonzero(t["k"].to_numpy() % 4 == 0)
        held = [batch.slice(batch.num_rows)]
        if len(starts):  # the last one may go on in the next batch
            held = t.slice(starts[-1], 4).to_batches()
            yield records(t, starts[:-1])
    if held:
        t = pa.Table.from_batches(held)
        yield records(t, np.flatnonzero(t["k"].to_numpy() % 4 == 0))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, description, sequence, quality of four-line records; plain files are read in pieces by many tasks.

    Lines are numbered in the order of the file (by the split and the line in it), and every four make a record, also one of an empty
    read; a record is made where it starts, and only the first lines of a split go to a record of the split before.  Blank lines at
    a file's end are no record; a record without its marks (@ and +), cut off, or with a quality of another length is an error."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = text.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.max(F.when(F.trim("value") != "", F.col("at"))).alias("end"))
    file = Window.partitionBy("file")
    start = F.coalesce(F.sum("n").over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    splits = splits.withColumns({"own": F.min("first").over(file), "start": start})  # a file goes by its first line
    splits = splits.withColumn("records", F.floor(F.max(F.col("start") + F.col("end") - F.col("first")).over(file) / 4))
    d = text.join(F.broadcast(splits), ["file", "block"]).withColumn("k", F.col("start") + F.col("at") - F.col("first"))  # a row a split
    d = d.filter(F.floor(F.col("k") / 4) <= F.col("records"))  # an empty read's last line may be blank
    rest = d.filter((F.col("at") - F.col("first") < 3) & (F.col("k") - F.col("k") % 4 < F.col("start"))).groupBy("own", F.floor(F.col("k") / 4).alias("record"))
    rest = rest.agg(*[F.max(F.when(F.col("k") % 4 == j, F.col("value"))).alias(f"r{j}") for j in range(1, 4)])
    got = d.select("own", "k", "value").mapInArrow(_framed, "own long, record long, l0 string, l1 string, l2 string, l3 string")
    got = got.join(F.broadcast(rest), ["own", "record"], "left")  # a row a split at most
    d = got.join(F.broadcast(splits.select("own", "file").distinct()), "own").select("file", "record", "l0", *[F.coalesce(f"l{j}", f"r{j}").alias(f"l{j}") for j in range(1, 4)])  # a row a file
    quality = F.coalesce("l3", F.when(F.col("l1") == "", F.lit("")))  # cut off behind the last line end
    fine = F.col("l0").startswith("@") & F.col("l2").startswith("+") & (F.length(quality) == F.length("l1"))
    told = F.concat(F.lit("FormatError: "), F.col("file"), F.lit(": record "), F.col("record").cast("string"), F.lit(" is no FASTQ record"))
    checked = F.when(F.coalesce(fine, F.lit(False)), F.col("l0")).otherwise(F.raise_error(told).cast("string"))
    return d.select(checked.alias("l0"), "l1", quality.alias("l3")).select(
        F.regexp_extract("l0", r"^@(\S*)", 1).alias("name"), F.regexp_extract("l0", r"^@\S*\s*(.*)$", 1).alias("description"), F.col("l1").alias("sequence"), F.col("l3").alias("quality")
    )


VCF_KINDS = {"Integer": "int", "Float": "double", "Flag": "boolean", "String": "string", "Character": "string"}


def vcf_header(text: DataFrame) -> tuple[list[str], dict[str, tuple[str, str]], dict[str, tuple[str, str]]]:
    """Sample names, and by key the number and type of INFO and FORMAT fields; reads the first lines only."""
    n = 200
    while True:
        head = [r[0] for r in text.take(n)]
        if len(head) < n or any(not x.startswith("#") for x in head):
            break
        n *= 10
    return header_fields(head)


def header_fields(head: list[str]) -> tuple[list[str], dict[str, tuple[str, str]], dict[str, tuple[str, str]]]:
    """``vcf_header`` of lines, up to the first that is no header."""
    names: list[str] = []
    fields: dict[str, dict[str, tuple[str, str]]] = {"INFO": {}, "FORMAT": {}}
    for line in head:
        if not line.startswith("#"):
            break
        if line.startswith("#CHROM"):
            names = line.split("\t")[9:]
        elif m := re.match(r"##(INFO|FORMAT)=<(?:.*,)?ID=([^,>]+),(?:.*,)?Number=([^,>]+),(?:.*,)?Type=([^,>]+)", line):
            fields[m[1]].setdefault(m[2], (m[3], VCF_KINDS.get(m[4], "string")))
    return names, fields["INFO"], fields["FORMAT"]


def _typed(x: Column, number: str, kind: str) -> Column:
    """A text value by its header: one value for number 1, else a list; a dot is null."""
    plain = F.when(x != ".", x)
    if number == "1":
        return plain.try_cast(kind) if kind != "string" else plain
    parts = F.split(plain, ",")
    return F.transform(parts, lambda v: F.when(v != ".", v).try_cast(kind) if kind != "string" else F.when(v != ".", v))


def _first_of_key(pairs: Column) -> Column:
    """A map of structs (key, value), of which the first of a key counts."""
    keys = F.transform(pairs, lambda x: x["key"])
    return F.map_from_entries(F.filter(pairs, lambda x, i: F.array_position(keys, x["key"]) == i + 1))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, id, ref, alt, qual, filter, info, and one column per sample.

    INFO and FORMAT fields that the header declares make structs with values of the declared type (number 1: one value, flag: true or
    false, else a list); a field that is not asked for is not parsed.  Of a key that repeats the first counts.  Where the
    header declares none the columns are maps of texts."""
    return vcf_columns(text_lines(spark, path))


def vcf_columns(text: DataFrame, header: tuple | None = None) -> DataFrame:
    names, info_keys, format_keys = header or vcf_header(text)
    p = F.split("value", "\t", -1)
    body = F.when(F.get(p, 7) != ".", F.get(p, 7))
    quoted = lambda k: "\\Q" + k + "\\E"

    def info_field(key: str, number: str, kind: str) -> Column:
        if kind == "boolean":
            return F.coalesce(F.concat(F.lit(";"), body, F.lit(";")).rlike(f";{quoted(key)}[;=]"), F.lit(False))
        padded = F.concat(F.lit(";"), body)
        found = F.when(padded.rlike(f";{quoted(key)}="), F.regexp_extract(padded, f";{quoted(key)}=([^;]*)", 1))
        return _typed(found, number, kind)

    if info_keys:
        info = F.struct(*[info_field(k, *v).alias(k) for k, v in info_keys.items()])
    else:
        pairs = F.transform(F.split(body, ";"), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("key"), F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).alias("value")))
        info = _first_of_key(pairs)
    keys = F.split(F.get(p, 8), ":")

    def sample(i: int) -> Column:
        parts = F.split(F.get(p, i), ":")
        if format_keys:
            return F.struct(*[_typed(F.get(parts, F.nullif(F.array_position(keys, k), F.lit(0)).cast("int") - 1), *v).alias(k) for k, v in format_keys.items()])
        return _first_of_key(F.transform(keys, lambda key, k: F.struct(key.alias("key"), F.get(parts, k).alias("value"))))

    dotted = lambda i: F.when(F.get(p, i) != ".", F.get(p, i))
    return text.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(
        F.get(p, 0).alias("chrom"), F.get(p, 1).cast("long").alias("pos"), dotted(2).alias("id"), F.get(p, 3).alias("ref"),
        F.split(dotted(4), ",").alias("alt"), dotted(5).try_cast("double").alias("qual"), F.split(dotted(6), ";").alias("filter"), info.alias("info"),
        *[sample(9 + i).alias(n) for i, n in enumerate(names)],
    )
