"""Weighted least squares, correlation and the delta method against numpy; loads of panels and of many tables; sinks that keep one whole file."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import ldsc, stats
from quillon.sources import sinks
from quillon.sources.lake import Lake


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    x, z, w = rng.normal(size=80), rng.normal(size=80), rng.uniform(0.5, 3, 80)
    y = 2 + 3 * x - z + rng.normal(size=80)
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(x, z, w, y, strict=True)], "x double, z double, w double, y double"), (x, z, w, y)


@pytest.mark.parametrize("intercept", [True, False])
@pytest.mark.parametrize("weights", [None, "w"])
def test_weighted_least_squares(points, intercept, weights):
    df, (x, z, w, y) = points
    w = w if weights else np.ones(80)
    a = np.column_stack(([np.ones(80)] if intercept else []) + [x, z])
    back = np.linalg.inv(a.T @ (w[:, None] * a))
    coef = back @ (a.T @ (w * y))
    rss = (w * (y - a @ coef) ** 2).sum()
    tss = (w * (y - ((w * y).sum() / w.sum() if intercept else 0)) ** 2).sum()
    r = stats.regression(df, ["x", "z"], "y", intercept, weights)
    assert r.coefficient == pytest.approx(coef) and r.std_error == pytest.approx(np.sqrt(np.diag(back) * rss / (80 - a.shape[1])))
    assert (r.rss, r.tss) == pytest.approx((rss, tss)) and r.adjusted_r_squared == pytest.approx(1 - rss / tss * (80 - intercept) / (80 - a.shape[1]))
    got = stats.fitted(df, r, "y").agg(F.sum(F.col("residual") * F.col("residual") * (F.col("w") if weights else F.lit(1.0)))).first()[0]
    assert got == pytest.approx(rss) and [t.term for t in stats.ols(df, ["x", "z"], "y", intercept, weights).collect()] == r.terms


def test_singular_and_wrong_weights(points):
    df, _ = points
    with pytest.raises(ValueError, match="singular"):
        stats.inverse(np.array([[1.0, 2.0], [2.0, 4.0]]))
    with pytest.raises(ValueError, match="singular"):
        stats.inverse(np.zeros((2, 2)))
    assert stats.inverse(np.diag([2.0, 1e-200])) == pytest.approx(np.diag([0.5, 1e200]))
    with pytest.raises(ValueError, match="above 0"):
        stats.regression(df.withColumn("w", F.lit(0.0)), ["x"], "y", weights="w")


def test_correlation_and_delta_method(spark, points):
    df, (x, _, _, y) = points
    assert df.agg(stats.correlation("x", "y")).first()[0] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert spark.createDataFrame([(1.0, None), (2.0, 3.0)], "x double, y double").agg(stats.correlation("x", "y")).first()[0] is None
    with pytest.raises(Exception, match="constant"):
        df.withColumn("y", F.lit(1.0)).agg(stats.correlation("x", "y")).collect()
    got = df.select("x", stats.delta_variance(lambda c: F.exp(c), F.col("x"), F.lit(0.25)).alias("v")).collect()
    assert [r.v for r in got] == pytest.approx([0.25 * np.exp(2 * r.x) for r in got], rel=1e-8)


def test_panels_and_tables_at_once(spark):
    lake = Lake(spark, "regression_lake")
    for t in lake.tables():
        spark.sql(f"DROP TABLE {t}")
    flat = spark.createDataFrame([("1", 5, 0.5)], "`locus.contig` string, `locus.position` int, ld_score double")
    assert not lake.load_panel(flat, "panel") and not lake.load_panel(flat, "panel") and lake.count("panel") == 2
    assert lake.table("panel").select("locus.position").first()[0] == 5
    assert lake.load_panel(flat.withColumn("rsid", F.lit("rs1")), "panel") and lake.count("panel") == 1
    parts = {f"c{k}": spark.range(k) for k in range(1, 6)}
    assert lake.load_each(parts, "chr", 3) == list(parts) and lake.load_each(parts, "chr") == []
    assert [lake.count(f"chr_{k}") for k in parts] == [1, 2, 3, 4, 5]


def test_sinks_leave_one_whole_file(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    sinks.write_file(spark.range(3), path, "csv")
    sinks.write_file(spark.range(5), path, "csv")
    with pytest.raises(Exception, match="no such thing"):
        sinks.write_file(spark.range(2).select(F.raise_error(F.lit("no such thing")).cast("string").alias("x")), path, "csv")
    assert spark.read.csv(path, header=True).count() == 5 and not [p for p in tmp_path.iterdir() if p.is_dir()]


def test_report_of_a_correlation(spark):
    rows = spark.range(60).select(F.col("id").alias("i"), (F.col("id") % 13 / 6.0 + 4).alias("ld"), F.lit(5.0).alias("wld"), F.lit(9.0).alias("n1"), F.lit(9.0).alias("n2"))
    rows = rows.withColumn("z1", F.col("ld") * 10 + F.sin("i")).withColumn("z2", -F.col("z1"))
    text = ldsc.rg_summary(ldsc.correlation(rows, 900.0, 20, (1.0, 1.0, 0.0)))
    assert "Genetic correlation: -1.0" in text and "Heritability of phenotype 2" in text and "Intercept: constrained to 0.0000" in text
