"""Bootstrapped medians and modes: the same for any dealing of the replicates, and equal to numpy's own loops."""

import math

import numpy as np
import pytest

from quillon.functions import mr_robust


def instruments(n, seed=5):
    rng = np.random.default_rng(seed)
    bx = rng.uniform(0.1, 0.3, n)
    by = 0.4 * bx + rng.normal(0, 0.01, n)
    return np.sort(bx), by[np.argsort(bx)], np.full(n, 0.01), rng.uniform(0.005, 0.02, n)


def frame(spark, groups):
    rows = [("e", name, *map(float, r), 1.0, 1.0) for name, cols in groups.items() for r in zip(*cols, strict=True)]
    return spark.createDataFrame(rows, "id_exposure string, id_outcome string, beta_exposure double, beta_outcome double, se_exposure double, se_outcome double, samplesize_exposure double, samplesize_outcome double").repartition(3)


@pytest.mark.parametrize("method", [*mr_robust.MEDIANS, *mr_robust.MODES])
def test_any_dealing_and_numpy_agree(spark, monkeypatch, method):
    bx, by, sx, sy = instruments(23)
    p = mr_robust.Parameters(nboot=60, seed=7)
    d = frame(spark, {"o": (bx, by, sx, sy), "small": (bx[:2], by[:2], sx[:2], sy[:2])})
    got = []
    for per in (7, 1000):
        monkeypatch.setattr(mr_robust, "PER_BLOCK", per)
        rows = mr_robust.robust(d, method, p).collect()
        assert [r.id_outcome for r in rows] == ["o"]
        got.append(tuple(rows[0][c] for c in ("nsnp", "b", "se", "pval")))
    assert got[0] == pytest.approx(got[1], rel=1e-12) and got[0][0] == 23
    order = np.lexsort((sy, sx, by, bx))
    x, y, ex, ey = bx[order], by[order], sx[order], sy[order]
    ratio = y / x
    boot = []
    for r in range(60):
        if method in mr_robust.MEDIANS:
            z = np.random.Generator(np.random.Philox(key=[7, r])).standard_normal(46)
            w = np.ones(23) if "simple" in method else 1 / (ey**2 / x**2 + y**2 * ex**2 / x**4)
            if "penalised" in method:
                c = mr_robust.weighted_median(ratio, w)[0]
                w = w * np.minimum(1, np.array([math.erfc(abs(math.sqrt(v) * (q - c)) / math.sqrt(2)) for v, q in zip(w, ratio, strict=True)]) * 20)
            boot.append(mr_robust.weighted_median((y + ey * z[23:]) / (x + ex * z[:23]), w)[0])
        else:
            z = np.random.Generator(np.random.Philox(key=[7, r])).standard_normal(23)
            e = ey / np.abs(x) if method.endswith("nome") else np.sqrt(ey**2 / x**2 + y**2 * ex**2 / x**4)
            boot.append(mr_robust.mode(ratio + e * z, np.ones(23) if "simple" in method else e, 1.0))
    boot = np.array(boot)
    se = boot.std(ddof=1) if method in mr_robust.MEDIANS else 1.4826 * np.median(np.abs(boot - np.median(boot)))
    assert got[0][2] == pytest.approx(se, rel=1e-9)


def test_a_large_group_in_bounded_memory(spark, monkeypatch):
    import resource

    k = 1_000_000
    rng = np.random.default_rng(1)
    bx = rng.uniform(0.1, 0.3, k)
    by = 0.4 * bx + rng.normal(0, 0.01, k)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    b, boot = mr_robust._replicates("mr_weighted_median", bx, by, np.full(k, 0.01), np.full(k, 0.01), mr_robust.Parameters(), range(12))
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    assert b == pytest.approx(0.4, abs=0.01) and len(boot) == 12 and boot.std() < 0.001
    assert grown < 700  # MB; a number for each instrument and replicate of the default 1000 would be 16 GB
