"""Heritability straight from files: summary statistics, reference and weight LD scores, annotation sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ldsc, partitioned
from ..sources import genetics, store

PLACE = ("CHR", "SNP", "BP")


def joined(spark: SparkSession, sumstats: str, reference: list[str], weights: str) -> tuple[DataFrame, list[str]]:
    """Rows (CHR, BP, SNP, z, n, wld, and the reference scores) of the SNPs that all files hold; stored, as every step reads them."""
    parts = [genetics.read_ldscore(spark, p) for p in reference]
    ref = parts[0] if len(parts) == 1 else genetics.beside(parts)
    names = [c for c in ref.columns if c not in PLACE]
    w = genetics.read_ldscore(spark, weights)
    own = [c for c in w.columns if c not in PLACE]
    if len(own) != 1:
        raise genetics.FormatError("weights have one LD score")
    s = genetics.read_sumstats(spark, sumstats).select("SNP", F.col("Z").alias("z"), F.col("N").alias("n"))
    d = ref.join(s, "SNP").join(w.select("SNP", F.col(own[0]).alias("wld")), "SNP").dropna(subset=["z", "n", "wld", *names])
    return store.stored(d, "sumstats"), names


def heritability_from_files(
    spark: SparkSession, sumstats: str, reference: list[str], weights: str, m: list[float] | None = None,
    blocks: int = ldsc.BLOCKS, intercept: float | None = None, two_step: float | None = ldsc.TWO_STEP, most_chisq: float | None = None,
):
    """One LD score: ``ldsc.Heritability``; several: ``partitioned.Partitioned``.

    ``m`` are the annotation sizes, by default those of the .l2.M_5_50 files beside the reference.  With several
    scores, chi-square is capped at the larger of 80 and a thousandth of the largest n, and scores that don't vary
    are left out; nearly dependent scores are an error."""
    d, names = joined(spark, sumstats, reference, weights)
    if m is None:
        m = [x for p in reference for x in genetics.read_m(spark, p.removesuffix(".gz").removesuffix(".ldscore") + ".M_5_50")]
    if len(m) != len(names):
        raise genetics.FormatError(f"{len(m)} annotation sizes for {len(names)} LD scores")
    order = ["CHR", "BP", "SNP"]
    if len(names) > 1:
        rows = d.withColumn("y", F.col("z") * F.col("z"))
        return partitioned.partitioned(rows, names, m, order, blocks=blocks, intercept=intercept, most=most_chisq)
    if most_chisq is not None:
        d = d.filter(F.col("z") * F.col("z") < most_chisq)
    rows = ldsc.place(d.withColumn("ld", F.col(names[0])), order)
    return ldsc.heritability(rows, float(m[0]), blocks, intercept, two_step)
