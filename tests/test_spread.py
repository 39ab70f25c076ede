"""Running values of large groups: spread over parts they equal those of one window; long intervals meet what brute force finds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import stats
from quillon.operators import intervals


def _rows(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.fixture(scope="module")
def spans(spark):
    rng = np.random.default_rng(3)
    start = rng.integers(0, 4000, 900)
    long = rng.integers(0, 30, 900)
    rows = [(("hot" if i % 3 else f"k{i % 7}") if i % 50 else None, int(s), int(s + n)) for i, (s, n) in enumerate(zip(start, long, strict=True))]
    return spark.createDataFrame(rows + rows[:40], "k string, start long, end long")


def test_merged_intervals_of_hot_keys(spans):
    one = intervals.merge_intervals(spans, ["k"])
    assert _rows(one, "k", "start", "end", "n") == _rows(intervals.merge_intervals(spans, ["k"], hot=0), "k", "start", "end", "n")
    assert intervals.merge_intervals(spans.limit(0), ["k"], hot=0).count() == 0


def test_as_of_join_of_hot_keys(spark, spans):
    a = spans.select("k", F.col("start").alias("at"), "end")
    b = spans.groupBy("k", F.col("end").alias("at")).agg(F.sum("start").alias("v"))
    b = b.withColumn("v", F.when(F.col("at") % 3 > 0, F.col("v")))  # unknown values are passed over
    one = _rows(intervals.as_of_join(a, b, ["k"], "at", "v"), "k", "at", "end", "v")
    assert one == _rows(intervals.as_of_join(a, b, ["k"], "at", "v", hot=0), "k", "at", "end", "v") and len(one) == 940


@pytest.mark.parametrize("most", [5, 400, 60_000])
def test_overlaps_of_short_and_long_intervals(spark, most):
    rng = np.random.default_rng(most)
    make = lambda n, lo: [(i, int(i % 2), int(s), int(s + d)) for i, (s, d) in enumerate(zip(rng.integers(-3000, 60_000, n), np.minimum(rng.geometric(0.2, n) * rng.choice([1, most], n), most), strict=True), lo)]
    left, right = make(150, 0), make(170, 1000)
    a, b = (spark.createDataFrame(x + [(9999, 0, None, 5)], "id long, k long, start long, end long") for x in (left, right))
    got = intervals.overlap_join(a, b, ["k"], 10).select("id", "id_b").collect()
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted(map(tuple, got)) == want
    bins = a.withColumn("n", F.col("end") - F.col("start")).agg(F.max("n")).first()[0]
    levels = intervals._levels(a, 10, "start", "end")[1]
    assert 10 * intervals.STEP ** (levels[-1] + 1) >= bins  # no interval covers more than STEP + 1 bins of its level


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_quantiles_of_one_large_group(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rng = np.random.default_rng(5)
        x, w = np.round(rng.normal(size=3000), 2), rng.integers(0, 5, 3000).astype(float)
        df = spark.createDataFrame([("g" if i % 10 else None, float(a), float(b)) for i, (a, b) in enumerate(zip(x, w, strict=True))], "g string, x double, w double")
        pick = {"g": np.arange(3000) % 10 > 0, None: np.arange(3000) % 10 == 0}
        for r in stats.quantiles(df, "x", [0.0, 0.1, 0.5, 0.99, 1.0], "g").collect():
            assert list(r[1:]) == pytest.approx(np.quantile(x[pick[r.g]], [0.0, 0.1, 0.5, 0.99, 1.0]))
        assert tuple(stats.quantiles(df, "x", [0.25, 0.75]).first()) == pytest.approx(tuple(np.quantile(x, [0.25, 0.75])))
        for r in stats.order_statistic(df, "x", 150, "g").collect():
            assert r.value == np.sort(x[pick[r.g]])[149]
        for r in stats.weighted_quantile(df, "x", "w", 0.5, "g").collect():
            o = np.lexsort((w[pick[r.g]], x[pick[r.g]]))
            xs, ws = x[pick[r.g]][o], w[pick[r.g]][o]
            k = int(np.searchsorted(np.cumsum(ws), ws.sum() / 2))
            assert xs[max(k - 1, 0)] <= r["quantile"] <= xs[k]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
