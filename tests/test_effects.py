"""Harmonising by cases, regression variants against numpy, distributions, Steiger."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import mr, mr_robust, special

COLS = (
    "snp string, id_exposure string, id_outcome string, effect_allele_exposure string, other_allele_exposure string, effect_allele_outcome string, other_allele_outcome string, "
    "eaf_exposure double, eaf_outcome double, beta_exposure double, beta_outcome double, se_exposure double, se_outcome double"
)
#: alleles of exposure and outcome, frequencies; wanted: kept under action 2, signs of both effects, outcome's alleles.
CASES = {
    "same": ("A", "G", "A", "G", 0.2, 0.2, True, 1, 1, "A", "G"),
    "lower case": ("a", "g", "A", "G", 0.2, 0.2, True, 1, 1, "A", "G"),
    "swapped": ("A", "G", "G", "A", 0.2, 0.8, True, 1, -1, "A", "G"),
    "other strand": ("A", "G", "T", "C", 0.2, 0.2, True, 1, 1, "A", "G"),
    "other strand swapped": ("A", "G", "C", "T", 0.2, 0.8, True, 1, -1, "A", "G"),
    "no match": ("A", "G", "A", "C", 0.2, 0.2, False, 1, 1, "A", "C"),
    "palindrome alike": ("A", "T", "A", "T", 0.2, 0.2, True, 1, 1, "A", "T"),
    "palindrome turned by frequency": ("A", "T", "A", "T", 0.2, 0.8, True, 1, -1, "A", "T"),
    "palindrome swapped": ("A", "T", "T", "A", 0.2, 0.8, True, 1, -1, "A", "T"),
    "palindrome in the middle": ("C", "G", "C", "G", 0.5, 0.2, False, 1, 1, "C", "G"),
    "palindrome without frequency": ("C", "G", "C", "G", None, 0.2, False, 1, 1, "C", "G"),
    "insertion named": ("AT", "A", "I", "D", 0.2, 0.2, True, 1, 1, "AT", "A"),
    "deletion named": ("AT", "A", "D", "I", 0.2, 0.8, True, 1, -1, "AT", "A"),
    "named on the exposure": ("I", "D", "A", "ATT", 0.2, 0.8, True, 1, -1, "ATT", "A"),
    "both named": ("I", "D", "D", "I", 0.2, 0.8, True, 1, -1, "I", "D"),
    "lengths don't tell": ("AT", "GC", "I", "D", 0.2, 0.2, False, 1, 1, None, None),
    "one outcome allele": ("A", "G", "A", None, 0.2, 0.2, True, 1, 1, "A", "G"),
    "one outcome allele, other": ("A", "G", "G", None, 0.2, 0.8, True, 1, -1, "A", "G"),
    "one outcome allele, frequencies differ": ("A", "G", "A", None, 0.2, 0.8, False, 1, 1, "A", "G"),
    "one outcome allele, other strand": ("A", "G", "T", None, 0.2, 0.2, False, 1, 1, "A", "G"),
    "one outcome allele, other strand and other": ("A", "G", "C", None, 0.2, 0.8, False, 1, -1, "A", "G"),
    "one outcome allele, palindrome": ("A", "T", "A", None, 0.2, 0.2, False, 1, 1, "A", "T"),
    "one outcome allele, insertion": ("AT", "A", "I", None, 0.2, 0.2, True, 1, 1, "AT", "A"),
    "one exposure allele": ("A", None, "A", "G", 0.2, 0.2, True, 1, 1, "A", "G"),
    "one exposure allele, other": ("G", None, "A", "G", 0.8, 0.2, True, -1, 1, "A", "G"),
    "one exposure allele, other strand": ("T", None, "A", "G", 0.2, 0.2, False, 1, 1, "A", "G"),
    "one exposure allele, deletion": ("D", None, "AT", "A", 0.8, 0.2, True, -1, 1, "AT", "A"),
    "one allele each": ("A", None, "A", None, 0.2, 0.2, True, 1, 1, "A", None),
    "one allele each, frequencies differ": ("A", None, "A", None, 0.2, 0.8, False, 1, 1, "A", None),
    "one allele each, no match": ("A", None, "G", None, 0.2, 0.2, False, 1, 1, "G", None),
}


def test_harmonise_cases(spark):
    rows = [(k, "e", "o", *c[:6], 0.1, 0.2, 0.01, 0.02) for k, c in CASES.items()]
    got = {r.snp: r for r in mr.harmonise(spark.createDataFrame(rows, COLS)).collect()}
    for k, c in CASES.items():
        r = got[k]
        assert (r.mr_keep, round(r.beta_exposure / 0.1), round(r.beta_outcome / 0.2)) == c[6:9], k
        if c[9]:
            assert (r.effect_allele_outcome, r.other_allele_outcome) == c[9:11], k
        if c[7] < 0:
            assert r.eaf_exposure == pytest.approx(1 - c[4]), k
        if c[8] < 0:
            assert r.eaf_outcome == pytest.approx(1 - c[5]), k
    three = {r.snp: r.mr_keep for r in mr.harmonise(spark.createDataFrame(rows, COLS), action=3).collect()}
    assert not three["palindrome alike"] and three["same"]
    one = {r.snp: (r.mr_keep, r.beta_outcome) for r in mr.harmonise(spark.createDataFrame(rows, COLS), action=1).collect()}
    assert one["palindrome turned by frequency"] == (True, 0.2) and not one["no match"][0]
    odd = spark.createDataFrame([("x", "e", "o", "A", "G", "A", "G", 0.2, 0.2, float("inf"), 0.2, 0.01, 0.02), ("y", "e", "o", None, None, None, None, None, None, 0.1, 0.2, 0.01, None)], COLS)
    assert [r.mr_keep for r in mr.harmonise(odd).collect()] == [False, False] and mr.harmonise(odd.limit(0)).count() == 0


def instruments(spark, n=40, seed=5):
    rng = np.random.default_rng(seed)
    x, s = rng.normal(0.1, 0.05, n), rng.uniform(0.01, 0.05, n)
    y = 0.4 * x + rng.normal(0, 2 * s)
    df = spark.createDataFrame([("e", "o", float(a), float(b), 0.01, float(c)) for a, b, c in zip(x, y, s, strict=True)], "id_exposure string, id_outcome string, beta_exposure double, beta_outcome double, se_exposure double, se_outcome double")
    return x, y, s, df


def test_regressions_through_the_origin(spark):
    x, y, s, df = instruments(spark)
    w = 1 / s**2
    b = (w * x * y).sum() / (w * x * x).sum()
    sigma2 = (w * (y - b * x) ** 2).sum() / (len(x) - 1)
    root = math.sqrt(1 / (w * x * x).sum())
    got = {r.method: r for r in mr_robust.estimates(df, ["mr_ivw", "mr_ivw_fe", "mr_ivw_mre", "mr_uwr"]).collect()}
    assert all(got[m].b == pytest.approx(b) for m in ("mr_ivw", "mr_ivw_fe", "mr_ivw_mre"))
    assert got["mr_ivw_fe"].se == pytest.approx(root) and got["mr_ivw_mre"].se == pytest.approx(root * math.sqrt(sigma2))
    assert got["mr_ivw"].se == pytest.approx(root * math.sqrt(sigma2) / min(1, math.sqrt(sigma2)))
    bu = (x * y).sum() / (x * x).sum()
    su = math.sqrt(((y - bu * x) ** 2).sum() / (len(x) - 1))
    assert got["mr_uwr"].b == pytest.approx(bu) and got["mr_uwr"].se == pytest.approx(su / math.sqrt((x * x).sum()) / min(1, su))
    with pytest.raises(ValueError, match="unknown"):
        mr_robust.estimates(df, ["mr_nothing"])
    with pytest.raises(NotImplementedError):
        mr_robust.estimates(df, ["mr_raps"])
    assert len(mr_robust.METHODS) == 19 and set(mr_robust.DEFAULT) < set(mr_robust.METHODS)


def test_meta_analysis(spark):
    x, y, s, df = instruments(spark)
    w = 1 / s**2
    b = (w * x * y).sum() / (w * x * x).sum()
    q = (w * (y - b * x) ** 2).sum()
    k = len(x) - 1
    tau2 = max(0.0, (q - k) / (w.sum() - (w**2).sum() / w.sum()))
    v = 1 / (s**2 + tau2)
    br = (v * x * y).sum() / (v * x * x).sum()
    r = mr.meta_ivw(df, True).first()
    assert tau2 > 0 and (r.q, r.tau2, r.b) == pytest.approx((q, tau2, br)) and r.i2 == pytest.approx((q - k) / q * 100)
    assert r.se == pytest.approx(math.sqrt((v * (y - br * x) ** 2).sum() / k / (v * x * x).sum()))
    assert r.q_pval == pytest.approx(special.chisq_sf(q, k)) and mr.meta_ivw(df).first().b == pytest.approx(b)
    d = np.c_[np.ones(len(x)), x]
    inv = np.linalg.inv(d.T @ (d * w[:, None]))
    coef = inv @ (d.T @ (w * y))
    rss = (w * (y - d @ coef) ** 2).sum()
    e = mr.meta_egger(df).first()
    assert (e.intercept, e.b, e.q) == pytest.approx((*coef, rss)) and (e.intercept_se, e.se) == pytest.approx(np.sqrt(np.diag(inv) * rss / (k - 1)))


def test_distributions_invert_and_integrate():
    families = [special.Normal(1, 2), special.Student(5), special.ChiSquared(3), special.Fisher(4, 9), special.Beta(2, 3)]
    for d in families:
        for p in (1e-6, 0.05, 0.5, 0.95):
            x = d.ppf(p)
            assert d.cdf(x) == pytest.approx(p, rel=1e-8) and d.sf(x) == pytest.approx(1 - p, rel=1e-8) and d.isf(p) == pytest.approx(d.ppf(1 - p), rel=1e-6)
        lo, hi = d.ppf(0.2), d.ppf(0.7)
        grid = np.linspace(lo, hi, 4001)
        assert np.trapezoid([d.pdf(x) for x in grid], grid) == pytest.approx(0.5, rel=1e-6)
    assert special.Normal().ppf(0.975) == pytest.approx(1.959963984540054) and special.Student(10).ppf(0.975) == pytest.approx(2.2281388519649385)
    assert special.ChiSquared(1).sf(3.841458820694124) == pytest.approx(0.05) and special.Normal().isf(1e-200) == pytest.approx(30.2056, abs=1e-3)
    assert special.Normal().ppf(0) == -math.inf and math.isnan(special.Normal().ppf(1.2))


def test_distribution_columns(spark):
    df = spark.createDataFrame([(0.025,), (None,), (0.5,)], "p double")
    got = [r.x for r in df.select(special.of_column("normal", "ppf", F.col("p")).alias("x")).collect()]
    assert got[0] == pytest.approx(-1.959963984540054) and got[1] is None and got[2] == pytest.approx(0, abs=1e-12)


def test_steiger():
    s = mr_robust.steiger(0.3, 0.1, 5000, 6000)
    assert s.correct_direction and s.r2_exposure == pytest.approx(0.09) and s.pval == pytest.approx(special.normal_two_sided(mr_robust.r_test(5000, 6000, 0.3, 0.1)[0]))
    a, b = math.log(0.3), math.log(0.1)
    whole = 0.3 * a - 0.1 * b + 0.03 * (b - a)
    against = -0.2 - 0.1 * a - 0.03 * a + 0.06
    assert s.sensitivity_ratio == pytest.approx(abs(whole - against) / against)
    half = mr_robust.steiger(0.3, 0.1, 5000, 6000, 1.0, 0.25)
    assert half.correct_direction and not half.correct_direction_adjusted
    r = mr_robust.steiger_of_pn([(1e-8, 0.01, 1000, 900), (1e-6, 0.5, 1200, 900)])
    assert r.correct_direction and 0 < r.r2_outcome < r.r2_exposure < 1
    with pytest.raises(ValueError):
        mr_robust.steiger(0.3, 0.1, 100, 100, 2.0)
