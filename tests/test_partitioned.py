"""Partitioned heritability, odds ratios and the writers, against brute force in numpy and round trips."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import ldsc, odds, partitioned
from quillon.sources import genetics, sinks


def snps(n=400, seed=3):
    rng = np.random.default_rng(seed)
    ld = np.stack([1 + rng.gamma(2, 5, n), rng.gamma(2, 2, n), np.full(n, 2.0)], 1)
    size = rng.integers(9000, 11000, n).astype(float)
    y = 1 + size * (ld[:, 0] * 1e-5 + ld[:, 1] * 4e-5) + rng.normal(0, 0.3, n) ** 2
    return ld, size, y, 1 + rng.gamma(2, 5, n)


def frame(spark, ld, size, y, w):
    rows = [(i, float(y[i]), float(size[i]), float(w[i]), *map(float, ld[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "bp long, y double, n double, wld double, base double, extra double, flat double").repartition(5)


@pytest.mark.parametrize("fixed", [None, 1.0])
def test_partitioned_equals_numpy(spark, fixed):
    ld, size, y, w = snps()
    y[7] = 500.0  # above the cap
    got = partitioned.partitioned(frame(spark, ld, size, y, w), ["base", "extra", "flat"], [1000.0, 200.0, 5.0], ["bp"], blocks=20, intercept=fixed)
    assert got.names == ["base", "extra"]
    keep = y < 80
    x, n, t, wl, m = ld[keep, :2], size[keep], y[keep], w[keep], np.array([1000.0, 200.0])
    tot, nbar = x.sum(axis=1), n.mean()
    h2 = m.sum() * (t.mean() - 1) / (tot * n).mean()
    weight = 1 / (2 * (1 + min(1, max(0, h2)) / m.sum() * n * np.maximum(tot, 1)) ** 2) / np.maximum(wl, 1)
    design = x * (n / nbar)[:, None]
    design = design if fixed else np.column_stack([design, np.ones(len(t))])
    t = t - (fixed or 0)
    solve = lambda k: np.linalg.solve((design[k] * weight[k, None]).T @ design[k], (design[k] * weight[k, None]).T @ t[k])
    est = solve(np.ones(len(t), bool))
    cut = np.floor(np.linspace(0, len(t), 21)).astype(int)
    delete = np.array([solve(~((np.arange(len(t)) >= a) & (np.arange(len(t)) < b))) for a, b in zip(cut[:-1], cut[1:], strict=True)])
    cov = np.cov((20 * est - 19 * delete).T, ddof=1) / 20
    assert np.allclose(got.coef, est[:2] / nbar, rtol=1e-7)
    assert np.allclose(got.coef_cov, cov[:2, :2] / nbar**2, rtol=1e-5)
    cat = m * est[:2] / nbar
    assert got.tot == pytest.approx(cat.sum())
    assert np.allclose(got.enrichment, cat / m / (cat.sum() / m.sum()))
    assert got.intercept == pytest.approx(fixed or est[2])
    out = partitioned.partitioned_frame(frame(spark, ld, size, y, w), ["base", "extra"], [1000.0, 200.0], ["bp"], blocks=20, intercept=fixed).collect()
    assert [r["annotation"] for r in out] == ["base", "extra"] and sum(r["prop"] for r in out) == pytest.approx(1)


def test_dependent_annotations_and_empty_tables_are_errors(spark):
    ld, size, y, w = snps(50)
    ld[:, 1] = 2 * ld[:, 0]
    with pytest.raises(ldsc.RegressionError, match="condition"):
        partitioned.partitioned(frame(spark, ld, size, y, w), ["base", "extra"], [10.0, 10.0], ["bp"])
    with pytest.raises(ldsc.RegressionError, match="no SNP"):
        partitioned.partitioned(frame(spark, ld, size, y, w).filter("bp < 0"), ["base", "extra"], [10.0, 10.0], ["bp"])


def test_tables_of_odds_ratios(spark):
    cases = [(a, p, o) for a in (0.05, 0.3, 0.9) for p in (0.1, 0.5, 0.8) for o in (0.2, 1.0, 1.0000001, 3.0)]
    df = spark.createDataFrame(cases, "af double, prop double, o double")
    c = [F.col(x) for x in ("af", "prop", "o")]
    for r in df.select("*", odds.contingency(*c).alias("t"), odds.population_frequency(*c, F.lit(0.01)).alias("pop")).collect():
        both, case, allele, none = r["t"]
        assert min(r["t"]) >= 0 and sum(r["t"]) == pytest.approx(1)
        assert both * none / (case * allele) == pytest.approx(r["o"]) and both + allele == pytest.approx(r["af"])
        assert r["pop"] == pytest.approx(allele / (1 - r["prop"]) * 0.99 + both / r["prop"] * 0.01)
    r = df.limit(1).select(*[odds.r_from_log_odds(F.lit(x), F.lit(0.3), F.lit(500.0), F.lit(500.0), F.lit(0.1)).alias(n) for n, x in (("up", 0.2), ("down", -0.2), ("zero", 0.0))]).first()
    assert r["up"] > 0 > r["down"] and r["zero"] == 0


def test_written_files_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([("rs2", "1", 20, 0.12345, 7.0, 1), ("rs1", "1", 10, -1.5, 8.0, 0)], "SNP string, CHR string, BP long, Z double, N double, annot int")
    path = str(tmp_path / "a.sumstats.gz")
    sinks.write_sumstats(df, path)
    assert sorted(gzip.open(path, "rt").read().splitlines()) == ["SNP\tA1\tA2\tZ\tN", "rs1\t\t\t-1.500\t8.000", "rs2\t\t\t0.123\t7.000"]
    sinks.write_sumstats(df.withColumns({"A1": F.lit("A"), "A2": F.lit("C")}), path)
    assert {(r["SNP"], r["A2"], r["Z"]) for r in genetics.read_sumstats(spark, path, alleles=True).collect()} == {("rs1", "C", -1.5), ("rs2", "C", 0.123)}
    prefix = str(tmp_path / "ld")
    sinks.write_ldscore(df.withColumnRenamed("Z", "L2"), prefix, ["L2"], [2.0], [1.0])
    assert gzip.open(f"{prefix}.l2.ldscore.gz", "rt").read() == "CHR\tSNP\tBP\tL2\n1\trs1\t10\t-1.500\n1\trs2\t20\t0.123\n"
    assert open(f"{prefix}.l2.M").read() == "2\n" and open(f"{prefix}.l2.M_5_50").read() == "1\n"
    sinks.write_annot(df, str(tmp_path / "x.annot"))
    assert open(tmp_path / "x.annot").read() == "ANNOT\n0\n1\n"
    sinks.write_jackknife(spark, prefix, [[1.0, 0.5], [0.5, 2.0]], [0.25, 0.5])
    assert open(f"{prefix}.cov").read() == "1.0 0.5\n0.5 2.0\n" and open(f"{prefix}.delete").read() == "0.25\n0.5\n"
