"""File sinks: one file at exactly the given path, overwritten or appended to."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def one_file(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill a folder beside the target and move its part file there: a failed write leaves the target alone.

    The old file is moved aside until the new one is in its place, so at any moment one of them is whole."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    temp = f"{path}.{uuid.uuid4().hex}"
    folder = jvm.org.apache.hadoop.fs.Path(temp)
    try:
        write(temp)
    except Exception:
        fs.delete(folder, True)
        raise
    part = next((s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), None)
    aside = jvm.org.apache.hadoop.fs.Path(f"{temp}.old")
    held = fs.exists(target)
    if held and not fs.rename(target, aside):
        raise OSError(f"{path} can't be moved aside")
    if part is not None and not fs.rename(part, target):
        if held:
            fs.rename(aside, target)
        raise OSError(f"{part} can't be moved to {path}")
    fs.delete(aside, True)
    fs.delete(folder, True)


def write_file(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write ``df`` as one file.  append: the present rows, cast to the new schema by name, then the new ones."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if mode == "append" and target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        reader = spark.read.option("header", True)
        old = reader.csv(path) if fmt == "csv" else reader.parquet(path)
        df = old.select(*[old[f.name].cast(f.dataType).alias(f.name) for f in df.schema]).union(df)
    writer = df.coalesce(1).write
    one_file(spark, path, (lambda temp: writer.option("header", True).csv(temp)) if fmt == "csv" else writer.parquet)


def _table(df: DataFrame, path: str, compressed: bool) -> None:
    """A tab-separated table with a header; no field is quoted."""
    writer = df.coalesce(1).write.options(header=True, sep="\t", quote="", emptyValue="", nullValue="")
    one_file(df.sparkSession, path, writer.option("compression", "gzip" if compressed else "none").csv)


def _three(c: str) -> Column:
    return F.format_string("%.3f", F.col(c).cast("double")).alias(c)


def _lines(spark: SparkSession, lines: list[str], path: str) -> None:
    df = spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)
    one_file(spark, path, df.write.text)


def write_sumstats(df: DataFrame, path: str) -> None:
    """SNP, A1, A2, Z, N and, where it is there, FRQ as gzip text with three decimals; absent alleles are empty (and then not read back, as readers split at white space)."""
    have = {c for c in df.columns}
    alleles = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in ("A1", "A2")]
    _table(df.select("SNP", *alleles, _three("Z"), _three("N"), *([_three("FRQ")] if "FRQ" in have else [])), path, True)


def write_ldscore(df: DataFrame, prefix: str, scores: list[str], m: list[float], m_common: list[float]) -> None:
    """prefix.l2.ldscore.gz in genome order, and the annotations' sizes in prefix.l2.M and prefix.l2.M_5_50."""
    _table(df.orderBy("CHR", "BP", "SNP").select("CHR", "SNP", "BP", *[_three(c) for c in scores]), f"{prefix}.l2.ldscore.gz", True)
    for name, values in (("M", m), ("M_5_50", m_common)):
        _lines(df.sparkSession, ["\t".join(f"{float(v):.15g}" for v in values)], f"{prefix}.l2.{name}")


def write_annot(df: DataFrame, path: str, column: str = "annot", order: tuple[str, ...] = ("CHR", "BP", "SNP")) -> None:
    """One column ANNOT, in genome order."""
    _table(df.orderBy(*order).select(F.col(column).cast("long").alias("ANNOT")), path, path.endswith(".gz"))


def write_jackknife(spark: SparkSession, prefix: str, covariance: list[list[float]] | None = None, delete: list[float] | None = None) -> None:
    """prefix.cov: the coefficients' covariance; prefix.delete: the total without each block (at most a few hundred lines)."""
    if covariance is not None:
        _lines(spark, [" ".join(repr(float(v)) for v in row) for row in covariance], f"{prefix}.cov")
    if delete is not None:
        _lines(spark, [repr(float(v)) for v in delete], f"{prefix}.delete")
