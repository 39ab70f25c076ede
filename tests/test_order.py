"""The global order of rows: every place once, whatever the shuffles, column sets and adaptive plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import stats

SF = "/root/testdata/sf0.01"
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


@pytest.mark.parametrize(("partitions", "adaptive"), [(1, True), (8, True), (8, False), (200, True)])
@pytest.mark.parametrize("columns", [ORDER, [*ORDER, "l_quantity", "l_discount", "l_tax", "l_shipdate"]])
def test_places_are_a_permutation(spark, partitions, adaptive, columns):
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], str(partitions))
        spark.conf.set(keys[1], str(adaptive).lower())
        df = spark.read.parquet(f"{SF}/lineitem.parquet").select(*columns)
        got = stats.numbered(df, ORDER).toPandas()
        assert sorted(got["index"]) == list(range(df.count()))
        by = got.sort_values("index")[ORDER].to_records(index=False).tolist()
        assert by == sorted(by)
        # pruned to what a later step asks for, the places stay
        again = stats.numbered(df, ORDER).select("index", "l_extendedprice").groupBy().agg(F.count_distinct("index").alias("n"), F.sum("l_extendedprice").alias("x")).first()
        assert again.n == len(got) and again.x == pytest.approx(got["l_extendedprice"].sum())
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


def test_ties_nulls_and_empty_tables(spark):
    rows = [(None, "a"), (1, "b"), (1, "b"), (1, "c"), (2, None), (None, "a")] + [(5, f"v{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v string").repartition(7)
    got = sorted(((r["index"], r.k) for r in stats.numbered(df, ["k"]).collect()))
    assert [i for i, _ in got] == list(range(len(rows))) and [k for _, k in got[:6]] == [None, None, 1, 1, 1, 2]
    assert stats.numbered(df.limit(0), ["k"]).count() == 0
    blocks = stats.position_blocks(df, ["k", "v"], 4).groupBy("block").count().collect()
    assert sorted(r["count"] for r in blocks) == [126, 126, 127, 127]


def test_weighted_quantile_and_order_statistics(spark):
    rng = np.random.default_rng(1)
    x, w = rng.integers(0, 9, 60) / 2, rng.integers(0, 4, 60).astype(float)
    df = spark.createDataFrame([(float(a), float(b), i % 2) for i, (a, b) in enumerate(zip(x, w, strict=True))], "x double, w double, g int")
    for q in (0.0, 0.3, 0.5, 1.0):
        got = {r.g: r.quantile for r in stats.weighted_quantile(df, "x", "w", q, "g").collect()}
        for g in (0, 1):
            o = sorted(zip(x[g::2], w[g::2], strict=True))
            target, below, last = q * sum(b for _, b in o), 0.0, o[0][0]
            for a, b in o:
                if target <= below + b:
                    want = last + (target - below) / b * (a - last) if b else a
                    break
                below, last = below + b, a
            assert got[g] == pytest.approx(want)
    assert {r.g: r.value for r in stats.order_statistic(df, "x", 7, "g").collect()} == {g: sorted(x[g::2])[6] for g in (0, 1)}
    assert stats.order_statistic(df, "x", 61).count() == 0
    with pytest.raises(ValueError):
        stats.weighted_quantile(df, "x", "w", 1.5)
    m = df.agg(stats.weighted_variance("x", "w").alias("v"), stats.weighted_correlation("x", "g", "w").alias("r"), stats.weighted_correlation("x", "w", "w").alias("c")).first()
    assert m.v == pytest.approx(np.cov(x, aweights=w) * (w.sum() - (w**2).sum() / w.sum()) / (w.sum() - 1))
    cov = np.cov(np.stack([x, w]), aweights=w)
    assert m.c == pytest.approx(cov[0, 1] / np.sqrt(cov[0, 0] * cov[1, 1]))
    bad = spark.createDataFrame([(1.0, -1.0)], "x double, w double")
    with pytest.raises(Exception, match="weights in w"):
        bad.agg(stats.weighted_mean("x", "w")).collect()


def test_quantiles_and_ranks_of_groups(spark):
    rng = np.random.default_rng(6)
    x, g = rng.integers(0, 40, 300) / 4, rng.integers(0, 3, 300)
    df = spark.createDataFrame([(float(a), int(b) if b else None) for a, b in zip(x, g, strict=True)] + [(None, 1)], "x double, g int")
    shares = [0.0, 0.31, 0.5, 1.0]
    got = {r.g or 0: [r.q0, r.q1, r.q2, r.q3] for r in stats.quantiles(df, "x", shares, "g").collect()}
    assert all(got[k] == pytest.approx(np.quantile(x[g == k], shares)) for k in range(3))
    assert [r.q0 for r in stats.quantiles(df, "x", [0.25]).collect()] == pytest.approx([np.quantile(x, 0.25)]) and stats.quantiles(df.limit(0), "x", [0.5]).count() == 0
    ranks = {(r.g, r.x): r["rank"] for r in stats.average_ranks(df.filter("g is not null and x is not null"), "x", "g").collect()}
    for (k, v), r in ranks.items():
        own = x[g == k]
        assert r == pytest.approx((own < v).sum() + ((own == v).sum() + 1) / 2)


def test_ols_of_three_with_errors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3))
    y = 2 + x @ [1, -2, 0.5] + rng.normal(size=80)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    got = stats.ols(df, ["a", "b", "c"], "y").collect()
    d = np.c_[np.ones(80), x]
    coef = np.linalg.lstsq(d, y, rcond=None)[0]
    rest = y - d @ coef
    se = np.sqrt(np.diag(np.linalg.inv(d.T @ d)) * (rest @ rest) / 76)
    assert [r.coefficient for r in got] == pytest.approx(coef) and [r.std_error for r in got] == pytest.approx(se)
    assert [r.t_stat for r in got] == pytest.approx(coef / se) and all(0 <= r.p_value <= 1 for r in got)
