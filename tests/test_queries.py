"""Readers, statistics, and every registered query of the engine against its SQL."""

import math

import duckdb
import numpy as np
import pytest

from quillon.functions import mr, special, stats
from quillon.operators import intervals
from quillon.plans import catalog
from quillon.sources import formats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in catalog.TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got, rel = df.collect(), duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(rel.columns)
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert sorted([tuple(plain(r[c]) for c in order) for r in got]) == sorted([tuple(plain(r[c]) for c in order) for r in want])


def test_text_readers(spark, tmp_path):
    put = lambda name, text: [(tmp_path / name).write_text(text), str(tmp_path / name)][1]
    bed = formats.read(spark, put("a.bed", "track x\nchr1\t5\t9\tn\n#c\nchr2\t0\t1\n")).collect()
    assert [tuple(r) for r in bed] == [("chr1", 5, 9), ("chr2", 0, 1)]
    fa = formats.read(spark, put("a.fa", ">s1 first\nACGT\nAC\n>s2\nTT\n")).orderBy("name").collect()
    assert [tuple(r) for r in fa] == [("s1", "first", "ACGTAC"), ("s2", "", "TT")]
    fq = formats.read(spark, put("a.fastq", "@r1 d\nAC\n+\nII\n@r2\nGG\n+\n@@\n")).collect()
    assert [(r.name, r.sequence, r.quality) for r in fq] == [("r1", "AC", "II"), ("r2", "GG", "@@")]
    gtf = formats.read(spark, put("a.gtf", '#x\nc\ts\tgene\t1\t9\t.\t+\t0\tgene_id "g";\n')).first()
    assert gtf.start == 1 and gtf.score is None and gtf.strand == "+"
    sam = formats.read(spark, put("a.sam", "@SQ\tSN:x\nr\t0\tx\t7\t30\t2M\t*\t0\t0\tAC\tII\n")).first()
    assert sam.pos == 7 and sam.seq == "AC"
    vcf = formats.read(spark, put("a.vcf", "##v\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\n1\t10\t.\tA\tC,G\t5\tPASS\tAF=0.5;DB\tGT:DP\t0/1:9\n")).first()
    assert vcf.pos == 10 and vcf.alt == ["C", "G"] and vcf.info == {"AF": "0.5", "DB": None} and vcf.S1 == {"GT": "0/1", "DP": "9"}
    assert formats.infer("X.VCF.GZ") == "vcf" and formats.infer("a.csv.gz") is None


def test_distributions():
    assert special.normal_two_sided(10) == pytest.approx(1.523971e-23, rel=1e-6)
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803, rel=1e-6)
    assert stats.liability_factor(0.5, 0.01) == pytest.approx(0.551907298063, abs=1e-9)


def test_ols_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 2))
    y = 1 + x @ [2, -3] + rng.normal(size=50) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    got = [r.coefficient for r in stats.ols(df, ["a", "b"], "y").collect()]
    assert got == pytest.approx(np.linalg.lstsq(np.c_[np.ones(50), x], y, rcond=None)[0])


def test_harmonise_swap_flip_and_palindrome(spark):
    cols = "snp string, id_exposure string, id_outcome string, effect_allele_exposure string, other_allele_exposure string, effect_allele_outcome string, other_allele_outcome string, eaf_exposure double, eaf_outcome double, beta_exposure double, beta_outcome double, se_exposure double, se_outcome double"
    row = lambda s, a, b, c, d, e, f: (s, "e", "o", a, b, c, d, e, f, 0.1, 0.2, 0.01, 0.02)
    df = spark.createDataFrame(
        [row("same", "A", "G", "A", "G", 0.2, 0.2), row("swap", "A", "G", "G", "A", 0.2, 0.8), row("flip", "A", "G", "T", "C", 0.2, 0.2),
         row("pal", "A", "T", "A", "T", 0.2, 0.8), row("amb", "A", "T", "A", "T", 0.5, 0.2), row("bad", "A", "G", "A", "C", 0.2, 0.2)], cols,
    )
    got = {r.snp: (r.beta_outcome, r.mr_keep) for r in mr.harmonise(df).collect()}
    assert got == {"same": (0.2, True), "swap": (-0.2, True), "flip": (0.2, True), "pal": (-0.2, True), "amb": (0.2, False), "bad": (0.2, False)}
    assert {r.method for r in mr.estimates(mr.harmonise(df).filter("mr_keep"), []).collect()} == {"mr_ivw", "mr_egger_regression"}


def test_merge_intervals(spark):
    df = spark.createDataFrame([("c", 1, 3), ("c", 4, 6), ("c", 8, 9), ("d", 1, 10), ("d", 2, 3)], "k string, start long, end long")
    got = sorted(tuple(r) for r in intervals.merge_intervals(df, ["k"]).select("k", "start", "end", "n").collect())
    assert got == [("c", 1, 6, 2), ("c", 8, 9, 1), ("d", 1, 10, 2)]
