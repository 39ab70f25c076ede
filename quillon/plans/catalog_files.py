"""Registered queries that write the driver's tables in formats of their own, read them back and aggregate; and LD matrices.

Files go to the folder that all executors share (``sources.store``)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bands
from ..sources import bam, blocks, formats, store, tabix


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _new(spark: SparkSession, name: str) -> str:
    return f"{store.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def bam_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as alignments in BAM files, read back by ranges."""
    d = _t(spark, sf_dir, "lineitem").select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("qname"), F.col("l_linenumber").alias("flag"), F.concat(F.lit("s"), F.col("l_suppkey") % 5).alias("rname"), (F.col("l_partkey") + 1).alias("pos"),
        F.col("l_quantity").cast("int").alias("mapq"), F.concat(F.col("l_quantity").cast("int"), F.lit("M2I")).alias("cigar"), F.lit("=").alias("rnext"), (F.col("l_suppkey") + 1).alias("pnext"),
        (F.col("l_linenumber") * -3).cast("long").alias("tlen"), F.expr("repeat(concat(l_returnflag, 'C'), CAST(l_quantity AS INT))").alias("seq"), F.expr("repeat('I', 2 * CAST(l_quantity AS INT))").alias("qual"),
    )
    path = _new(spark, "bam")
    bam.write_bam(d, path, [f"s{k}" for k in range(5)])
    back = bam.read_bam(spark, path, 1 << 20)
    return back.groupBy("rname", "rnext", F.substring("seq", 1, 1).alias("base")).agg(
        F.count("*").alias("n"), F.sum("pos").alias("pos"), F.sum("pnext").alias("pnext"), F.sum("tlen").alias("tlen"), F.sum(F.length("seq") + F.length("qual")).alias("letters"),
        F.sum("mapq").alias("mapq"), F.countDistinct("cigar").alias("cigars"), F.sum(F.split_part("qname", F.lit("/"), F.lit(1)).cast("long")).alias("orders"),
    )


def _vcf_line(chrom: Column, pos: Column, name: Column, info: Column) -> Column:
    return F.concat_ws("\t", chrom, pos.cast("string"), name, F.lit("A"), F.lit("C,G"), F.lit("."), F.lit("PASS"), info)


VCF_HEAD = """##fileformat=VCFv4.2
##INFO=<ID=DP,Number=1,Type=Integer,Description="quantity">
##INFO=<ID=AF,Number=A,Type=Float,Description="discount and tax">
##INFO=<ID=DB,Number=0,Type=Flag,Description="returned">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"""


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "R", F.lit(";DB")).otherwise(F.lit(""))
    info = F.concat(F.lit("DP="), F.col("l_quantity").cast("int"), F.lit(";AF="), F.col("l_discount"), F.lit(","), F.col("l_tax"), flag, F.lit(";DP=0"))
    pos = F.col("l_partkey") * 100 + F.col("l_linenumber")
    name = F.concat_ws("/", "l_orderkey", "l_linenumber")
    return _t(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("chrom"), pos.alias("pos"), _vcf_line(F.col("l_linestatus"), pos, name, info).alias("value"))


def vcf_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as variants in sorted, indexed files; one region of them."""
    path = _new(spark, "vcf")
    tabix.write_indexed_vcf(tabix.sorted_lines(_variants(spark, sf_dir)), path, VCF_HEAD)
    d = tabix.read_vcf_region(spark, path, "O:20000-90000")
    return d.select("chrom", "pos", "id", F.size("alt").alias("n_alt"), F.col("info.DP").alias("dp"), F.round(F.element_at("info.AF", 2), 4).alias("tax"), F.col("info.DB").alias("db"))


def vcf_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a variant file, read back by the header's types; of a key that repeats the first counts."""
    path = _new(spark, "vcf-text") + ".vcf"
    head = spark.createDataFrame([(VCF_HEAD,)], "value string").coalesce(1)
    head.write.text(path)
    _variants(spark, sf_dir).select("value").write.mode("append").text(path)
    d = formats.vcf_columns(spark.read.text(path), formats.header_fields(VCF_HEAD.split("\n")))
    return d.groupBy("chrom", F.col("info.DB").alias("db")).agg(
        F.count("*").alias("n"), F.sum("info.DP").alias("dp"), F.round(F.sum(F.element_at("info.AF", 1)), 2).alias("discount"), F.round(F.sum(F.element_at("info.AF", 2)), 2).alias("tax")
    )


def fastq_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reads, every tenth of them empty, written as text and framed again."""
    empty = F.col("o_orderkey") % 10 == 0
    seq = F.when(empty, F.lit("")).otherwise(F.expr("repeat(substr('ACGT', 1 + CAST(o_custkey % 4 AS INT), 1), 1 + CAST(o_orderkey % 7 AS INT))"))
    qual = F.when(empty, F.lit("")).otherwise(F.expr("repeat('@', 1 + CAST(o_orderkey % 7 AS INT))"))
    record = F.concat_ws("\n", F.concat(F.lit("@o"), F.col("o_orderkey"), F.lit(" "), F.col("o_orderpriority")), seq, F.lit("+"), qual)
    path = _new(spark, "fastq")
    _t(spark, sf_dir, "orders").select(record.alias("value")).write.text(path)
    d = formats.read_fastq(spark, path)
    return d.groupBy(F.length("sequence").alias("bases"), F.substring("sequence", 1, 1).alias("base"), "description").agg(
        F.count("*").alias("n"), F.sum(F.substring("name", 2, 20).cast("long")).alias("orders"), F.sum(F.length("quality")).alias("letters")
    )


def zstd_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tab-separated text in zstd frames, read back by position."""
    path = _new(spark, "tsv") + ".zst"
    cells = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
    lines = _t(spark, sf_dir, "lineitem").select(F.concat_ws("\t", *[F.col(c).cast("string") for c in cells]).alias("value"))
    blocks.write_block_text(lines, path, "zstd", ".tsv")
    d = formats.read_tsv(spark, path, "k long, line int, quantity double, flag string")
    return d.groupBy("flag", "line").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"), F.sum("k").alias("orders"))


def _snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as SNPs of 24 people, the genotype of one of them missing."""
    g = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda j: F.when(j == F.col("p_partkey") % 29, -1).otherwise((F.col("p_partkey") * (j + 3) + j * j) % 7 % 3).cast("int"))
    return _t(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("CHR"), F.col("p_partkey").alias("BP"), F.col("p_partkey").alias("SNP"), g.alias("genotypes"))


def ld_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of parts as SNPs within 700 places."""
    d = bands.ld_matrix(_snps(spark, sf_dir), 700, least_r2=0.02, maf=0.05, missing=0.05)
    return d.select("CHR", "SNP", "SNP_b", F.round("r", 8).alias("r"), F.round("r2", 8).alias("r2"), "n")


def allele_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bands.allele_frequencies(_snps(spark, sf_dir))
    return d.select("CHR", "SNP", "n", F.round("freq", 10).alias("freq"), F.round("maf", 10).alias("maf"), F.round("missing", 10).alias("missing"))


_GENOTYPES = "(SELECT p_partkey AS k, p_size::VARCHAR AS c, j, CASE WHEN j = p_partkey % 29 THEN NULL ELSE ((p_partkey * (j + 3) + j * j) % 7 % 3)::DOUBLE END AS g FROM part, range(24) AS t(j))"
ORACLES = {
    "bam_roundtrip": "SELECT 's' || l_suppkey % 5 AS rname, '=' AS rnext, l_returnflag AS base, count(*) AS n, sum(l_partkey + 1)::BIGINT AS pos, sum(l_suppkey + 1)::BIGINT AS pnext, sum(l_linenumber * -3)::BIGINT AS tlen, "
    "sum(4 * l_quantity::INT)::BIGINT AS letters, sum(l_quantity::INT)::BIGINT AS mapq, count(DISTINCT l_quantity) AS cigars, sum(l_orderkey)::BIGINT AS orders FROM lineitem GROUP BY 1, 3",
    "vcf_region": "SELECT l_linestatus AS chrom, l_partkey * 100 + l_linenumber AS pos, l_orderkey || '/' || l_linenumber AS id, 2::INT AS n_alt, l_quantity::INT AS dp, round(l_tax, 4) AS tax, l_returnflag = 'R' AS db "
    "FROM lineitem WHERE l_linestatus = 'O' AND l_partkey * 100 + l_linenumber BETWEEN 20000 AND 90000",
    "vcf_typed": "SELECT l_linestatus AS chrom, l_returnflag = 'R' AS db, count(*) AS n, sum(l_quantity::INT)::BIGINT AS dp, round(sum(l_discount), 2) AS discount, round(sum(l_tax), 2) AS tax FROM lineitem GROUP BY 1, 2",
    "fastq_roundtrip": "SELECT CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 + o_orderkey % 7 END::INT AS bases, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE substr('ACGT', 1 + (o_custkey % 4)::INT, 1) END AS base, o_orderpriority AS description, "
    "count(*) AS n, sum(o_orderkey)::BIGINT AS orders, sum(CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 + o_orderkey % 7 END)::BIGINT AS letters FROM orders GROUP BY 1, 2, 3",
    "zstd_tsv": "SELECT l_returnflag AS flag, l_linenumber AS line, count(*) AS n, sum(l_quantity) AS quantity, sum(l_orderkey)::BIGINT AS orders FROM lineitem GROUP BY 1, 2",
    "ld_matrix": f"WITH g AS MATERIALIZED {_GENOTYPES}, f AS MATERIALIZED (SELECT g.* FROM g JOIN (SELECT k FROM g GROUP BY k HAVING least(avg(g) / 2, 1 - avg(g) / 2) >= 0.05 AND 1 - count(g) / 24.0::DOUBLE <= 0.05) USING (k)), "
    "p AS (SELECT a.c, a.k, b.k AS o, count(*) AS n, sum(a.g) AS x, sum(b.g) AS y, sum(a.g * b.g) AS xy, sum(a.g * a.g) AS xx, sum(b.g * b.g) AS yy FROM f a JOIN f b ON a.c = b.c AND a.j = b.j AND b.k > a.k AND b.k <= a.k + 700 "
    "WHERE a.g IS NOT NULL AND b.g IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT *, (n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y)) AS r FROM p WHERE n * xx > x * x AND n * yy > y * y) "
    "SELECT c AS CHR, k AS SNP, o AS SNP_b, round(r, 8) AS r, round(r * r, 8) AS r2, n FROM r WHERE r * r >= 0.02",
    "allele_frequencies": f"SELECT c AS CHR, k AS SNP, count(g)::INT AS n, round(avg(g) / 2, 10) AS freq, round(least(avg(g) / 2, 1 - avg(g) / 2), 10) AS maf, round((24 - count(g)) / 24.0::DOUBLE, 10) AS missing FROM {_GENOTYPES} GROUP BY 1, 2",
}
FUNCTIONS = [bam_roundtrip, vcf_region, vcf_typed, fastq_roundtrip, zstd_tsv, ld_matrix, allele_frequencies]
