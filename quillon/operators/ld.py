"""LD scores from genotypes by banded block products, and annotations from intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bands import MISSING, Block, banded, imputed_r, packed, unpack
from .intervals import merge_intervals


def standardised(df: DataFrame, genotypes: str = "genotypes", minor_ref: bool = False) -> DataFrame:
    """``x``: genotypes minus their mean over their spread, missing ones at the mean; with minor_ref the sign follows the rarer allele."""
    seen = F.filter(genotypes, lambda g: g >= 0)
    n = F.size(seen)
    total = F.aggregate(seen, F.lit(0.0), lambda a, g: a + g)
    d = df.withColumn("_mean", total / n)
    square = F.aggregate(F.transform(genotypes, lambda g: F.when(g >= 0, g - F.col("_mean")).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v * v)
    d = d.withColumn("_sd", F.sqrt(square / F.size(genotypes)))
    sign = F.when(F.col("_mean") > 1, -1.0).otherwise(1.0) if minor_ref else F.lit(1.0)
    x = F.transform(genotypes, lambda g: F.when(g >= 0, sign * (g - F.col("_mean")) / F.col("_sd")).otherwise(0.0))
    return d.filter("_sd > 0").withColumn("x", x).drop("_mean", "_sd")


def unbiased(r, n):
    """r squared, less what chance adds to it."""
    return r * r - (1 - r * r) / (n - 2)


KINDS = {"unbiased": unbiased, "r2": lambda r, n: r * r, "r": lambda r, n: r}


def ld_scores(df: DataFrame, window: int, annotations: list[str] | None = None, by: tuple[str, ...] = ("CHR",), at: str = "BP", key: str = "SNP", kind: str = "unbiased") -> DataFrame:
    """Sum over the window of annotation times f(r), the SNP itself included; kind: unbiased, r2 or r.

    Block products return each block's sums (``bands``); no row stands for a pair.  SNPs that don't vary are left out, missing
    genotypes count as the mean."""
    f = KINDS[kind]
    names = annotations or []
    out_names = [f"{c}L2" for c in names] or ["L2"]
    src = packed(df)
    fields = {c.name: c.dataType.simpleString() for c in src.schema}
    weights = [F.col(c).cast("double").alias(f"_w{k}") for k, c in enumerate(names)] or [F.lit(1.0).alias("_w0")]
    src = src.select("_people", "_packed", *by, at, F.col(key).alias("_key"), *weights)
    width = len(weights)

    def sums(block: Block, value: np.ndarray, of: Block) -> pa.RecordBatch:
        """Rows (key, sums) of a block's SNPs: values times the annotations of the others."""
        w = np.stack([of.rows.column(1 + k).to_numpy() for k in range(width)], axis=1)
        return pa.RecordBatch.from_arrays([block.rows.column(0).combine_chunks(), *[pa.array(c) for c in (value @ w).T]], names=["k", *[f"s{k}" for k in range(width)]])

    def emit(a: Block, b: Block, near: np.ndarray) -> Iterator[pa.RecordBatch]:
        r, n = imputed_r(a, b)
        value = np.where(near & ~np.isnan(r), f(np.nan_to_num(r), n), 0.0)
        yield sums(a, value, b)
        yield sums(b, value.T, a)

    others = banded(src, window, list(by), at, ["_key", *[f"_w{k}" for k in range(width)]], emit, f"k {fields[key]}, " + ", ".join(f"s{k} double" for k in range(width)))
    own_schema = f"k {fields[key]}, people int, varies boolean, " + ", ".join(f"w{k} double" for k in range(width))

    def varies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for people, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                g = unpack([raw], people)
                keep.append(len(np.unique(g[g != MISSING])) > 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keep, pa.bool_()), *b.columns[3:]], names=["k", "people", "varies", *[f"w{k}" for k in range(width)]])

    own = src.select("_key", "_people", "_packed", *[f"_w{k}" for k in range(width)]).mapInArrow(varies, own_schema).filter("varies")
    itself = f(F.lit(1.0), F.col("people"))
    rows = own.select("k", *[(itself * F.col(f"w{k}")).alias(f"s{k}") for k in range(width)], F.lit(1).alias("there")).union(others.withColumn("there", F.lit(0)))
    total = rows.groupBy("k").agg(*[F.sum(f"s{k}").alias(out_names[k]) for k in range(width)], F.max("there").alias("_there"))
    return total.filter("_there = 1").select(F.col("k").alias(key), *out_names)


def annotation_sizes(df: DataFrame, annotations: list[str], freq: str = "freq") -> DataFrame:
    """Sums of the annotations (M), and of those of SNPs with a minor frequency above 5 % (M_5_50)."""
    common = F.least(F.col(freq), 1 - F.col(freq)) > 0.05
    return df.agg(*[F.sum(c).alias(f"{c}_M") for c in annotations], *[F.sum(F.when(common, F.col(c)).otherwise(0)).alias(f"{c}_M_5_50") for c in annotations])


def annotate(snps: DataFrame, intervals: DataFrame, by: str = "CHR", at: str = "BP", merged: bool = True, bin_size: int = 100_000) -> DataFrame:
    """``annot``: 1 where a SNP lies in an interval (start and end inclusive), else 0; without merging the number of intervals that hold it."""
    v = intervals.select(F.col(by).alias("_by"), "start", "end")
    if merged:
        v = merge_intervals(v, ["_by"]).select("_by", "start", "end")
    v = v.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size))))
    s = snps.withColumn("_bin", F.floor(F.col(at) / bin_size))
    hits = s.join(v, (s[by] == v["_by"]) & (s["_bin"] == v["_bin"]) & (s[at] >= v["start"]) & (s[at] <= v["end"]))
    counted = hits.groupBy("SNP").agg(F.count("*").alias("annot"))
    n = F.coalesce("annot", F.lit(0))
    return snps.join(counted, "SNP", "left").withColumn("annot", F.least(n, F.lit(1)) if merged else n)


def gene_intervals(genes: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Intervals of the genes named in ``wanted`` (GENE), made wider by ``window`` at both ends."""
    return genes.join(wanted.select("GENE").distinct(), "GENE", "left_semi").select(
        "CHR", F.greatest(F.lit(1), F.col("START") - window).cast("long").alias("start"), (F.col("END") + window).cast("long").alias("end")
    )
