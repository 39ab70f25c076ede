"""Special functions as columns against the standard library and closed forms."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from quillon.functions import columns as C


def values(spark, rows, schema, *cols):
    df = spark.createDataFrame(rows, schema).repartition(1)
    out = df.select("*", *[c.alias(f"o{k}") for k, c in enumerate(cols)])
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    return out.collect()


def test_erf_family(spark):
    xs = [k / 16 for k in range(-110, 111)] + [12.0, 26.0, 27.2, 40.0, -40.0, 1e-9, 0.0]
    for r in values(spark, [(x,) for x in xs], "x double", C.erf("x"), C.erfc("x")):
        assert r.o0 == pytest.approx(math.erf(r.x), rel=1e-12, abs=1e-300)
        assert r.o1 == pytest.approx(math.erfc(r.x), rel=2e-12, abs=1e-315)


def test_normal_tails_and_quantiles(spark):
    ps = [0.5, 0.3, 0.05, 0.925, 0.0751, 1 - 1e-9, 1e-5, 1e-20, 1e-100, 1e-300, 5e-308]
    for r in values(spark, [(p,) for p in ps], "p double", C.normal_quantile("p"), C.z_of_p("p"), C.erfc_inverse("p"), C.erf_inverse("p")):
        assert r.o0 == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-13, abs=1e-15)
        assert math.erfc(r.o1 / math.sqrt(2)) == pytest.approx(r.p, rel=1e-11)
        assert math.erfc(r.o2) == pytest.approx(r.p, rel=1e-11) and math.erf(r.o3) == pytest.approx(r.p, rel=1e-12)
    for r in values(spark, [(k / 4,) for k in range(-60, 61)], "z double", C.p_normal("z"), C.normal_sf("z"), C.normal_cdf("z")):
        assert r.o0 == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=2e-12) and r.o1 + r.o2 == pytest.approx(1, abs=1e-14)
    edge = values(spark, [(0.0,), (1.0,), (-1.0,), (None,)], "p double", C.normal_quantile("p"), C.z_of_p("p"), C.erfc("p"))
    assert edge[0].o0 == -math.inf and edge[1].o0 == math.inf and math.isnan(edge[2].o0) and edge[3].o0 is None and edge[1].o1 == 0 and edge[3].o2 is None


def test_log_gamma(spark):
    xs = [0.01, 0.5, 1.0, 1.5, 2.0, 7.3, 100.0, 12345.6, 1e7]
    for r in values(spark, [(x,) for x in xs], "x double", C.log_gamma("x")):
        assert r.o0 == pytest.approx(math.lgamma(r.x), rel=1e-13, abs=2e-14)


def chisq_even(x, df):
    return math.fsum(math.exp(-x / 2 + j * math.log(x / 2) - math.lgamma(j + 1)) for j in range(df // 2))


def test_chi_square_against_closed_forms(spark):
    rows = [(x, df) for df in (2, 4, 10, 60, 400, 5000) for x in (0.1, 1.0, df * 0.8, df * 1.0, df * 1.3, df + 600.0)]
    for r in values(spark, rows, "x double, df int", C.p_chisq("x", "df")):
        assert r.o0 == pytest.approx(chisq_even(r.x, r.df), rel=1e-10, abs=1e-300)
    for r in values(spark, [(z,) for z in (0.01, 1.0, 3.0, 8.0, 37.0)], "z double", C.p_chisq(F.col("z") * F.col("z"), F.lit(1.0))):
        assert r.o0 == pytest.approx(math.erfc(r.z / math.sqrt(2)), rel=1e-11)


def test_student_and_fisher(spark):
    for r in values(spark, [(t,) for t in (0.0, 0.2, 1.0, -3.0, 50.0, 1e4)], "t double", C.p_student("t", F.lit(1)), C.p_student("t", F.lit(2)), C.p_student("t", F.lit(1e6)), C.p_fisher(F.col("t") * F.col("t"), F.lit(1), F.lit(2))):
        assert r.o0 == pytest.approx(2 / math.pi * math.atan2(1, abs(r.t)), rel=1e-12)  # Cauchy
        two = 1 - abs(r.t) / math.sqrt(2 + r.t**2) if abs(r.t) < 10 else (1 / r.t**2) * (1 - 1.5 / r.t**2 + 2.5 / r.t**4 - 4.375 / r.t**6)
        assert r.o1 == pytest.approx(two, rel=1e-9) and r.o3 == pytest.approx(r.o1, rel=1e-11)
        if abs(r.t) < 5:
            assert r.o2 == pytest.approx(math.erfc(abs(r.t) / math.sqrt(2)), rel=1e-3)
    from quillon.functions import special

    rows = [(t, df) for t in (0.5, 2.1, 7.0) for df in (3.0, 8.5, 77.0, 900.0)]
    for r in values(spark, rows, "t double, df double", C.p_student("t", "df"), C.p_chisq("t", "df"), C.p_fisher("t", F.lit(5), "df")):
        assert r.o0 == pytest.approx(special.t_two_sided(r.t, r.df), rel=1e-10) and r.o1 == pytest.approx(special.chisq_sf(r.t, r.df), rel=1e-10) and r.o2 == pytest.approx(special.f_sf(r.t, 5, r.df), rel=1e-10)
