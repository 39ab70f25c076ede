"""Statistics as distributed aggregations; only fixed-size sums reach the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store
from .special import t_two_sided

OLS_SCHEMA = "term string, coefficient double, std_error double, t_stat double, p_value double, r_squared double, n_obs double"


def skewness_adjusted(x: str) -> Column:
    """G1 of at least three values."""
    n = F.count(x)
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_adjusted(x: str) -> Column:
    """G2 (excess) of at least four values."""
    n = F.count(x)
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def _weights_of(w: str) -> Column:
    """The total weight; an error for null or negative weights and for a total that isn't positive."""
    bad = F.max((F.col(w).isNull() | (F.col(w) < 0) | F.isnan(F.col(w).cast("double"))).cast("int")) == 1
    return F.when(bad | (F.sum(w) <= 0), F.raise_error(F.lit(f"weights in {w} must be known, at least 0, and not all 0")).cast("double")).otherwise(F.sum(w))


def weighted_mean(x: str, w: str) -> Column:
    return F.sum(F.col(x) * F.col(w)) / _weights_of(w)


def _weighted_product(x: str, y: str, w: str) -> Column:
    """Weighted sum of the products of deviations, from sums about the origin."""
    cx, cy, cw = (F.col(c).cast("double") for c in (x, y, w))
    return F.sum(cw * cx * cy) - F.sum(cw * cx) * F.sum(cw * cy) / _weights_of(w)


def weighted_covariance(x: str, y: str, w: str) -> Column:
    """Sample form (total weight - 1 below); null where the total weight is 1 or less."""
    return F.when(F.sum(w) > 1, _weighted_product(x, y, w) / (F.sum(w) - 1))


def weighted_variance(x: str, w: str, population: bool = False) -> Column:
    return _weighted_product(x, x, w) / _weights_of(w) if population else weighted_covariance(x, x, w)


def weighted_correlation(x: str, y: str, w: str) -> Column:
    """Null where either side is constant."""
    under = F.sqrt(F.greatest(_weighted_product(x, x, w) * _weighted_product(y, y, w), F.lit(0.0)))
    return F.when(under > 0, _weighted_product(x, y, w) / under)


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation; an error where either side is constant, null for fewer than two rows with both values."""
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    flat = lambda c: F.min(F.when(known, F.col(c))) == F.max(F.when(known, F.col(c)))
    constant = (F.count_if(known) > 1) & (flat(x) | flat(y))
    return F.when(constant, F.raise_error(F.lit(f"{x} or {y} is constant")).cast("double")).when(
        F.count_if(known) > 1, F.covar_pop(x, y) / F.sqrt(F.var_pop(F.when(known, F.col(x))) * F.var_pop(F.when(known, F.col(y))))
    )


def delta_variance(g: Callable[[Column], Column], x: Column, variance: Column) -> Column:
    """Variance of g(x) by the delta method: the derivative is a central difference with a step of max(1, |x|) times the cube root of the machine's precision."""
    h = F.greatest(F.lit(1.0), F.abs(x)) * float(np.finfo(float).eps ** (1 / 3))
    slope = (g(x + h) - g(x - h)) / (2 * h)
    return variance * slope * slope


def weighted_quantile(df: DataFrame, x: str, w: str, q: float, *by: str) -> DataFrame:
    """Rows (by..., quantile): where the cumulative weight of the sorted values reaches q of the total, interpolated between neighbours.

    Of equal values the one of the smallest weight comes first, and only that one is interpolated to.
    Equal rows are counted first; of a group, only the parts that the target lies in are put in order."""
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    g = df.groupBy(*by, F.col(x).cast("double").alias("_x"), F.col(w).cast("double").alias("_w")).agg(F.count("*").alias("_n")).filter("_x is not null")
    target = F.lit(float(q)) * F.col("_all")
    g = _spread(g.withColumn("_mass", F.col("_w") * F.col("_n")), by, ["_x", "_w"], "_mass", (target > F.col("_before")) & (target <= F.col("_before") + F.col("_here")) | (F.col("_before") == 0))
    start = F.col("_upto") - F.col("_mass")
    ramp = F.col("_prev") + F.try_divide(target - start, F.col("_w")) * (F.col("_x") - F.col("_prev"))
    at = g.filter(target <= F.col("_upto")).withColumn("_v", F.when((F.col("_prev") < F.col("_x")) & (F.col("_w") > 0) & (target <= start + F.col("_w")), ramp).otherwise(F.col("_x")))
    return at.groupBy(*by).agg(F.min_by("_v", F.struct("_x", "_w")).alias("quantile"))


def order_statistic(df: DataFrame, x: str, k: int, *by: str) -> DataFrame:
    """Rows (by..., value): the k-th smallest value, from counts of distinct values; groups with fewer rows give nothing."""
    if k < 1:
        raise ValueError("order statistics count from 1")
    g = df.filter(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("_x")).agg(F.count("*").alias("_n"))
    g = _spread(g, by, ["_x"], "_n", (F.col("_before") < k) & (k <= F.col("_before") + F.col("_here")))
    return g.filter(F.col("_upto") >= k).groupBy(*by).agg(F.min("_x").alias("value")).filter("value is not null")


def _spread(counts: DataFrame, by: tuple[str, ...], order: list[str], mass: str, wanted: Column | None = None) -> DataFrame:
    """``counts`` with _upto, the mass of the group's rows up to and with this one; _all, that of the group; _prev, the value of order[0] in the row before.

    One global order over groups and values: a group of any size is spread over parts, whose sums are added up a
    group at a time (a row a part).  ``wanted`` (of _before, _here and _all, the mass before, in and of all parts) keeps
    some of a group's parts, and only their rows are sorted."""
    rows = _parted(store.stored(counts, "counts"), [*by, *order])[0].drop("_key")  # the counts are read three times
    near = Window.partitionBy(*by).orderBy("_part")
    sizes = rows.groupBy("_part", *by).agg(F.sum(mass).alias("_here"), F.max(order[0]).alias("_last")).withColumns({
        "_before": F.coalesce(F.sum("_here").over(near.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_all": F.sum("_here").over(Window.partitionBy(*by)),
        "_lag": F.lag("_last", 1).over(near),
    })
    if wanted is not None:
        sizes = sizes.filter(wanted)
    sizes = sizes.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(("_part", *by))], "_before", "_all", "_lag")
    same = [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(("_part", *by))]
    inside = Window.partitionBy("_part", *by).orderBy(*order)
    out = rows.join(sizes, same).withColumns({
        "_upto": F.col("_before") + F.sum(mass).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "_prev": F.coalesce(F.lag(order[0], 1).over(inside), F.col("_lag")),
    })
    return out.select(*counts.columns, "_upto", "_all", "_prev")


def carried(df: DataFrame, by: list[str], order: list[str], into: str, value: str, how: str) -> DataFrame:
    """``into``: the largest ``value`` of the group's rows before this one (how: max), or the last known one up to and with it (how: last).

    Groups are spread over the parts of one global order; a part's end is carried into the group's later parts."""
    rows = _parted(store.stored(df, "carried"), [*by, *order])[0].drop("_key")  # read three times
    w = Window.partitionBy("_part", *by).orderBy(*order)
    last = F.max(value) if how == "max" else F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("_part", *by).agg(last.alias("_end")).withColumn("_ahead", F.max("_end").over(ahead) if how == "max" else F.last("_end", ignorenulls=True).over(ahead))
    ends = ends.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(("_part", *by))], "_ahead")
    out = rows.join(ends, [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(("_part", *by))])
    if how == "max":
        found = F.greatest(F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_ahead"))
    else:
        found = F.coalesce(F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_ahead"))
    return out.withColumn("_found", found).select(*[F.col(c) for c in df.columns if c != into], F.col("_found").alias(into))


def average_ranks(df: DataFrame, x: str, *by: str) -> DataFrame:
    """``rank``: ties get the mean of their ranks.  Only distinct values are put in order."""
    counts = df.groupBy(*by, x).agg(F.count("*").alias("_n"))
    ranks = _spread(counts, by, [x], "_n").select(*by, x, (F.col("_upto") - (F.col("_n") - 1) / 2).alias("rank"))
    return df.join(ranks, [*by, x])


def quantiles(df: DataFrame, x: str, shares: list[float], *by: str) -> DataFrame:
    """Rows (by..., q0, q1, ...): type-7 quantiles, interpolated between neighbours, from counts of distinct values.

    No group is held in one buffer, and of a group only the parts that hold one of the ranks are put in order."""
    if any(not 0 <= q <= 1 for q in shares):
        raise ValueError("a quantile lies between 0 and 1")
    counts = df.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_n"))
    place = lambda q: F.lit(float(q)) * (F.col("_all") - 1)
    ranks = [end(place(q)) + 1 for q in shares for end in (F.floor, F.ceil)]
    wanted = F.lit(False)
    for k in ranks:
        wanted = wanted | (F.col("_before") < k) & (k <= F.col("_before") + F.col("_here"))
    r = _spread(counts, by, [x], "_n", wanted)
    found = [F.max(F.when((F.col("_upto") - F.col("_n") < k) & (k <= F.col("_upto")), F.col(x))).alias(f"k{i}") for i, k in enumerate(ranks)]
    out = r.groupBy(*by).agg(F.max("_all").alias("_all"), *found).filter(F.col("_all").isNotNull())
    between = lambda i, q: F.col(f"k{2 * i}") + (place(q) - F.floor(place(q))) * (F.col(f"k{2 * i + 1}") - F.col(f"k{2 * i}"))
    return out.select(*by, *[between(i, q).alias(f"q{i}") for i, q in enumerate(shares)])


#: A pivot below it makes a matrix singular.
LEAST_PIVOT = 1e-300


@dataclass
class Regression:
    """Least squares by ``terms``: coefficients and what follows from them; ``fit`` is the fitted value as a column of the rows."""

    terms: list[str]
    coefficient: np.ndarray
    std_error: np.ndarray
    rss: float
    tss: float
    n: int
    intercept: bool
    fit: Column

    @property
    def df(self) -> int:
        return self.n - len(self.terms)

    @property
    def t_stat(self) -> np.ndarray:
        return self.coefficient / self.std_error

    @property
    def p_value(self) -> list[float]:
        return [float(t_two_sided(t, self.df)) for t in self.t_stat]

    @property
    def r_squared(self) -> float:
        return 1 - self.rss / self.tss

    @property
    def adjusted_r_squared(self) -> float:
        return 1 - (1 - self.r_squared) * (self.n - self.intercept) / self.df


def inverse(a: np.ndarray) -> np.ndarray:
    """Inverse of a small matrix; an error where elimination meets no pivot of LEAST_PIVOT or more."""
    try:
        out = np.linalg.inv(a)
    except np.linalg.LinAlgError:
        raise ValueError("the matrix is singular") from None
    if not np.isnan(a).any() and (not np.isfinite(out).all() or np.abs(np.linalg.svd(a, compute_uv=False)).min() < LEAST_PIVOT):
        raise ValueError("the matrix is singular")
    return out


def regression(df: DataFrame, x_columns: list[str], y_column: str, intercept: bool = True, weights: str | None = None) -> Regression:
    """Least squares, weighted where ``weights`` names a column, from one aggregation of products and a second for the residuals.

    Sums of squares carry the weights; the total one is about the weighted mean, or about 0 without an intercept.
    Nulls become NaN and poison the fit, as a missing value would in the arrays."""
    nan = F.lit(float("nan"))
    number = lambda c: F.coalesce(F.col(c).cast("double"), nan)
    cols = ([F.lit(1.0)] if intercept else []) + [number(c) for c in x_columns]
    y, w = number(y_column), number(weights) if weights else F.lit(1.0)
    p = len(cols)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = df.agg(
        *[F.sum(w * cols[i] * cols[j]).alias(f"a{i}_{j}") for i, j in pairs], *[F.sum(w * c * y).alias(f"b{i}") for i, c in enumerate(cols)],
        F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.min(w).alias("least"),
    ).first()
    n = row["n"]
    if n <= p:
        raise ValueError("more terms than rows")
    if weights and not row["least"] > 0:
        raise ValueError(f"weights in {weights} must be above 0")
    a = np.empty((p, p))
    for i, j in pairs:
        a[i, j] = a[j, i] = row[f"a{i}_{j}"]
    back = inverse(a)
    coef = np.linalg.solve(a, np.array([row[f"b{i}"] for i in range(p)]))
    fit = sum((c * float(k) for c, k in zip(cols, coef, strict=True)), F.lit(0.0))
    centre = row["wy"] / row["w"] if intercept else 0.0
    s = df.agg(F.sum(w * (y - fit) * (y - fit)).alias("rss"), F.sum(w * (y - centre) * (y - centre)).alias("tss")).first()
    names = (["intercept"] if intercept else []) + [f"x{i + 1}" for i in range(len(x_columns))]
    return Regression(names, coef, np.sqrt(np.diag(back) * s["rss"] / (n - p)), s["rss"], s["tss"], n, intercept, fit)


def ols(df: DataFrame, x_columns: list[str], y_column: str, intercept: bool = True, weights: str | None = None) -> DataFrame:
    """``regression`` as rows, one a term."""
    r = regression(df, x_columns, y_column, intercept, weights)
    each = zip(r.terms, r.coefficient, r.std_error, r.t_stat, r.p_value, strict=True)
    return df.sparkSession.createDataFrame([(t, float(c), float(e), float(z), p, float(r.r_squared), float(r.n)) for t, c, e, z, p in each], OLS_SCHEMA)


def fitted(df: DataFrame, r: Regression, y_column: str) -> DataFrame:
    """``df`` with the columns fitted and residual."""
    return df.withColumns({"fitted": r.fit, "residual": F.col(y_column).cast("double") - r.fit})


def liability_factor(sample: float, population: float) -> float:
    """Observed-scale to liability-scale factor for a case share and a population prevalence."""
    if not (0 < sample < 1 and 0 < population < 1):
        raise ValueError("prevalences lie between 0 and 1")
    z = NormalDist().pdf(NormalDist().inv_cdf(population))
    return population**2 * (1 - population) ** 2 / (sample * (1 - sample) * z * z)


#: Rows of the sample that the part bounds of a global order come from, for each part; it affects the balance only.
PER_PART, MOST_PARTS = 20, 512


def _order_key(df: DataFrame, order: list[str]) -> Column:
    """The order columns, then a hash of the other columns that are neither floating-point nor maps: ties of the order spread over parts."""
    loose = ("float", "double", "map", "variant")
    rest = [c for c, kind in df.dtypes if c not in order and not any(x in kind for x in loose)]
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], (F.xxhash64(*rest) if rest else F.lit(0)).alias("tie"))


def _parted(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with _key and its part in a global order, _part, and the number of parts.

    A row's part is a function of its own key: literal bounds, taken once from a hashed sample, are
    searched by an expression.  However often the plan runs anew and however its shuffles are dealt, parts
    agree, provided that ``df`` gives the same rows each time.  Nulls come first."""
    spark = df.sparkSession
    parts = max(1, min(MOST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    key = _order_key(df, order)
    kind = df.select(key.alias("k")).schema["k"].dataType
    at = df.select(key.alias("k")).withColumn("u", F.xxhash64("k"))
    picked = at.orderBy("u", "k").limit(PER_PART * parts)  # a bounded top-k: one short list a task
    cuts = picked.agg(F.array_sort(F.collect_set("k")).alias("k")).first()["k"]  # PER_PART * parts keys at most
    cuts = cuts[:: max(1, len(cuts) // parts)][1:]

    def literal(k) -> Column:
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(k, kind.fields, strict=True)])

    def part(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("_key") < literal(cuts[mid]), part(lo, mid)).otherwise(part(mid + 1, hi))

    return df.withColumn("_key", key).withColumn("_part", part(0, len(cuts))), len(cuts) + 1


def _placed(df: DataFrame, order: list[str]) -> DataFrame:
    """_i (1-based within a part), _offset and _total of every row in a global order."""
    rows, parts = _parted(df, order)
    sizes = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row a part
    offsets, total = [], 0
    for k in range(parts):
        offsets.append(total)
        total += sizes.get(k, 0)
    offset = F.get(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col("_part"))
    here = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    return rows.withColumns({"_i": here, "_offset": offset, "_total": F.lit(total).cast("long")}).drop("_part", "_key")


def position_blocks(df: DataFrame, order: list[str], blocks: int) -> DataFrame:
    """``block`` of every row in a global order: 0-based row i of n goes to ((i + 1) * blocks - 1) div n."""
    return _placed(df, order).withColumn("block", F.expr(f"((_i + _offset) * {blocks} - 1) div _total")).drop("_offset", "_total", "_i")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``index``: 0-based place of every row in a global order."""
    return _placed(df, order).withColumn("index", (F.col("_i") + F.col("_offset") - 1).cast("long")).drop("_offset", "_total", "_i")
