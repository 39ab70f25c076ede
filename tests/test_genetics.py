"""LD score regression, munging, genetic readers, robust estimators, against brute force in numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import ldsc, mr_robust, munge, special
from quillon.operators import ld
from quillon.sources import genetics


def panel(spark, n=1000, h2=0.5, size=10000.0, noise=0.0, seed=0):
    """Chi-square exactly on the line 1 + size / n * h2 * ld, with noise if asked."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        score = 1 + 0.1 * (i % 97)
        y = 1 + size / n * h2 * score + noise * rng.normal() ** 2
        rows.append((f"rs{i}", "1", i * 10, score, math.sqrt(y), size))
    df = spark.createDataFrame(rows, "rsid string, contig string, position long, ld_score double, z double, n double")
    return df.select("rsid", "contig", "position", "ld_score"), df.select("rsid", "z", "n")


def brute(y, x, n, m, blocks, fixed):
    """The same regression on whole arrays."""
    nbar = n.mean()
    xs = n * x / nbar
    ld_, w_ = np.maximum(x, 1), np.maximum(x, 1)

    def weights(h2, c):
        mean = c + min(1, max(0, h2)) / m * n * ld_
        return 1 / (2 * mean**2) / w_

    w = weights(m * (y.mean() - (fixed or 1)) / (x * n).mean(), fixed or 1)
    design = xs[:, None] if fixed else np.stack([xs, np.ones(len(xs))], 1)
    t = y - (fixed or 0)

    def solve(keep):
        d = design[keep] * w[keep][:, None]
        return np.linalg.solve(d.T @ design[keep], d.T @ t[keep])

    for _ in range(2):
        est = solve(np.ones(len(y), bool))
        w = weights(m * est[0] / nbar, fixed or est[1])
    est = solve(np.ones(len(y), bool))
    cut = np.floor(np.linspace(0, len(y), blocks + 1)).astype(int)
    delete = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        keep = np.ones(len(y), bool)
        keep[a:b] = False
        delete.append(solve(keep))
    pseudo = blocks * est - (blocks - 1) * np.array(delete)
    se = np.sqrt(np.atleast_2d(np.cov(pseudo.T, ddof=1)).diagonal() / blocks)
    return m * est[0] / nbar, m * se[0] / nbar


def test_h2_on_an_exact_line(spark):
    p, s = panel(spark)
    rows = ldsc.on_panel([s], p)
    h = ldsc.heritability(rows, 1000, blocks=20, intercept=1.0)
    assert h.fit.tot == pytest.approx(0.5, abs=1e-4) and h.fit.intercept_se is None and h.ratio is None
    free = ldsc.heritability(rows, 1000, blocks=20)
    assert free.fit.tot == pytest.approx(0.5, abs=1e-3) and free.fit.intercept == pytest.approx(1, abs=1e-3)
    assert "Intercept" in ldsc.summary(free)


@pytest.mark.parametrize("fixed", [1.0, None])
def test_h2_against_arrays(spark, fixed):
    p, s = panel(spark, n=500, noise=3.0)
    rows = ldsc.on_panel([s], p).cache()
    got = ldsc.heritability(rows, 500, blocks=10, intercept=fixed, two_step=None)
    a = rows.orderBy("i").toPandas()
    want = brute(a.z.to_numpy() ** 2, a.ld.to_numpy(), a.n.to_numpy(), 500, 10, fixed)
    assert (got.fit.tot, got.fit.tot_se) == pytest.approx(want, rel=1e-6)
    assert got.lambda_gc == pytest.approx(np.median(a.z**2) / 0.4549)


def test_correlation_of_opposite_traits(spark):
    p, s = panel(spark, noise=0.5)
    other = s.withColumn("z", -F.col("z"))
    r = ldsc.rg_frame(ldsc.on_panel([s, other], p), 1000, blocks=20, intercepts=(1.0, 1.0, -1.0)).first()
    assert r.rg == pytest.approx(-1, abs=0.01)


def test_empty_join_is_an_error(spark):
    p, s = panel(spark, n=5)
    with pytest.raises(ldsc.RegressionError):
        ldsc.heritability(ldsc.on_panel([s.limit(0)], p), 5)


def test_munge_daner(spark, tmp_path):
    rows = """SNP A1 A2 FRQ_A_10 FRQ_U_20 INFO OR P
a T C 0.4 0.4 0.95 1.2 0.05
b A T 0.4 0.4 0.95 1.2 0.05
c A G 0.4 0.4 0.50 1.2 0.05
d A G 0.4 0.001 0.95 1.2 0.05
e A G 0.4 0.4 0.95 0.8 0.05
a G A 0.4 0.4 0.95 0.5 0.5
f A G 0.4 0.4 0.95 0.8 1.5
g A G 0.4 0.4 0.95 . 0.5
"""
    (tmp_path / "s").write_text(rows)
    df = genetics.read_table(spark, str(tmp_path / "s"), {})
    got = {r.SNP: (r.A1, round(r.Z, 4), r.N) for r in munge.munge(df).collect()}
    assert got == {"a": ("T", 1.96, 30.0), "e": ("A", -1.96, 30.0)}
    assert munge.z_size(0.48158) == pytest.approx(0.70376361, abs=1e-6) and munge.z_size(1.0) == 0
    with pytest.raises(munge.MungeError):
        munge.munge(df.drop("P"))


def test_munge_alleles(spark):
    df = spark.createDataFrame([("A", "G", "A", "G", 1.0), ("A", "G", "G", "A", 1.0), ("A", "G", "C", "T", 1.0), ("A", "G", "A", "C", 1.0), ("A", "T", "A", "T", 1.0)], "A1 string, A2 string, A1x string, A2x string, Z2 double")
    assert [r.Z2 for r in munge.align(df).collect()] == [1.0, -1.0, -1.0]


def test_readers(spark, tmp_path):
    put = lambda name, text: [(tmp_path / name).write_text(text), str(tmp_path / name)][1]
    for c in range(1, 23):
        put(f"x{c}.l2.ldscore", f"CHR SNP BP CM MAF L2\n{c} rs{c} 5 0 0.1 1.5\n{c} rs{c} 6 0 0.1 9\n")
        put(f"x{c}.l2.M", "1 2\n")
    d = genetics.read_ldscore(spark, str(tmp_path / "x@.l2.ldscore"))
    got = d.collect()
    assert d.columns == ["CHR", "SNP", "BP", "L2"] and [(r.CHR, r.L2) for r in got] == [(c, 1.5) for c in range(1, 23)]
    assert genetics.read_m(spark, str(tmp_path / "x@.l2.M")) == [22.0, 44.0]
    with pytest.raises(genetics.FormatError):
        genetics.read_m(spark, put("bad", "Nan 100 .\n"))
    annot = genetics.read_annot(spark, put("a.annot", "CHR BP SNP CM C1 C2\n1 1 a 0 1 0\n1 2 b 0 1 1\n"))
    assert genetics.overlap_matrix(annot) == [[2.0, 1.0], [1.0, 1.0]]
    iv = genetics.read_intervals(spark, put("i.bed", "track\nc 0 5\n")).first()
    assert (iv.start, iv.end) == (1, 5)
    assert genetics.beside([d, d]).columns == ["CHR", "BP", "SNP", "L2_0", "L2_1"]
    with pytest.raises(genetics.FormatError):
        genetics.beside([d, d.limit(3)])


def test_genotypes_and_ld_scores(spark, tmp_path):
    rng = np.random.default_rng(3)
    people, snps = 9, 6
    g = rng.integers(0, 3, (snps, people))
    g[0, :2] = -1
    g[1] = 2  # one genotype only
    code = {2: 0, -1: 1, 1: 2, 0: 3}
    raw = bytearray(b"\x6c\x1b\x01")
    for row in g.tolist():
        for k in range(0, people, 4):
            raw.append(sum(code[v] << (2 * i) for i, v in enumerate(row[k : k + 4])))
    (tmp_path / "p.bed").write_bytes(raw)
    (tmp_path / "p.bim").write_text("".join(f"1 s{i} 0 {10 * i + 1} A G\n" for i in range(snps)))
    (tmp_path / "p.fam").write_text("".join(f"f{i} i{i} 0 0 1 -9\n" for i in range(people)))
    d = genetics.read_genotypes(spark, str(tmp_path / "p")).cache()
    got = {r.SNP: r for r in d.collect()}
    assert sorted(got) == ["s0", "s2", "s3", "s4", "s5"] and got["s0"].genotypes == g[0].tolist() and got["s0"].n == people - 2
    assert got["s2"].freq == pytest.approx(g[2].mean() / 2)
    x = {}
    for k in got:
        v = np.array(got[k].genotypes, float)
        v[v < 0] = v[v >= 0].mean()
        x[k] = (v - v.mean()) / v.std()
    place = {f"s{i}": 10 * i + 1 for i in range(snps)}
    want = {}
    for a in x:
        r2 = [np.mean(x[a] * x[b]) ** 2 for b in x if abs(place[a] - place[b]) <= 20]
        want[a] = sum(v - (1 - v) / (people - 2) for v in r2)
    scores = {r.SNP: r.L2 for r in ld.ld_scores(d, 20).collect()}
    assert scores == pytest.approx(want)
    iv = spark.createDataFrame([("1", 1, 12), ("1", 11, 25)], "CHR string, start long, end long")
    assert {r.SNP: r.annot for r in ld.annotate(d.select("SNP", "CHR", "BP"), iv).collect()} == {"s0": 1, "s2": 1, "s3": 0, "s4": 0, "s5": 0}


def effects(spark, n=60):
    rng = np.random.default_rng(5)
    bx = rng.uniform(0.1, 0.3, n)
    by = 0.4 * bx + rng.normal(0, 0.01, n)
    rows = [("e", "o", float(a), float(b), 0.01, 0.01, 10000.0, 10000.0) for a, b in zip(bx, by, strict=True)]
    return spark.createDataFrame(rows, "id_exposure string, id_outcome string, beta_exposure double, beta_outcome double, se_exposure double, se_outcome double, samplesize_exposure double, samplesize_outcome double")


@pytest.mark.parametrize("method", [*mr_robust.MEDIANS, *mr_robust.MODES])
def test_robust_methods(spark, method):
    r = mr_robust.robust(effects(spark), method, mr_robust.Parameters(nboot=100)).collect()
    assert len(r) == 1 and r[0].b == pytest.approx(0.4, abs=0.05) and 0 < r[0].se < 0.2 and r[0].pval < 0.05
    assert mr_robust.robust(effects(spark, 2), method).count() == 0


def test_direction_and_heterogeneity(spark):
    d = mr_robust.directionality(effects(spark).limit(5)).first()
    assert d.correct_direction and d.pval < 1e-10
    assert {r.q_df for r in mr_robust.heterogeneity(effects(spark)).collect()} == {58, 59}
    assert special.chisq_sf(143.650840925034, 78) == pytest.approx(8.72842e-6, rel=1e-4)
    assert mr_robust.pleiotropy(effects(spark)).first().pval > 0.001
    assert mr_robust.r_from_p(0.05, 100) ** 2 == pytest.approx(0.0386, abs=1e-3)


def test_density_against_direct_sum():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=79), rng.uniform(0.1, 1, 79)
    grid, d = mr_robust.density(x, w, 0.3)
    direct = (w * np.exp(-0.5 * ((grid[:, None] - x) / 0.3) ** 2)).sum(1) / w.sum() / (0.3 * math.sqrt(2 * math.pi))
    assert len(grid) == 512 and np.abs(d - direct).max() < 1e-3


def test_munge_studies_and_sizes_by_row(spark):
    rows = [("rs1", "A", "C", 0.3, 0.1, 0.05, 100.0, 300.0, 3), ("rs2", "A", "G", 0.4, -0.1, 0.05, 200.0, 300.0, 1), ("rs3", "C", "A", 0.4, -0.2, 1e-300, 200.0, 350.0, 4)]
    d = spark.createDataFrame(rows, "SNP string, A1 string, A2 string, `FRQ_U_900` double, BETA double, P double, Nca double, Nco double, `N-studies` int")
    got = {r.SNP: (r.Z, r.N) for r in munge.munge(d, order=["SNP"], daner_n=True, n_min=0.0, nstudy_min=2).collect()}
    assert set(got) == {"rs1", "rs3"} and got["rs1"] == (pytest.approx(1.959963984540054), 400.0) and got["rs3"][0] == pytest.approx(-37.0655, abs=1e-3)
    with pytest.raises(munge.MungeError, match="Nca"):
        munge.munge(d.drop("Nca"), order=["SNP"], daner_n=True)
    assert munge.munge(d, order=["SNP"], daner_n=True, n_min=0.0).count() == 3
