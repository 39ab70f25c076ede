"""LD score regression as a few aggregations over one stored frame.

The frame holds a row per SNP: z (or z1, z2), n, ld (reference LD score), wld
(weight LD score) and i, its 0-based place in the genome.  Every reweighting
pass is one aggregation of weighted products; the jackknife needs the same
products per block, at most ``n_blocks`` rows, which the driver solves.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import store
from .special import normal_two_sided
from .stats import numbered, quantiles

#: Median of a chi-square variable with one degree of freedom, as genomic control rounds it.
MEDIAN_CHISQ = 0.4549
BLOCKS = 200
TWO_STEP = 30.0

Weights = Callable[[float, float], Column]


class RegressionError(ValueError):
    pass


@dataclass
class Jackknife:
    """Estimates with the values that leave out each block (blocks x terms)."""

    est: np.ndarray
    delete: np.ndarray

    @property
    def cov(self) -> np.ndarray:
        n = len(self.delete)
        pseudo = n * self.est - (n - 1) * self.delete
        return np.atleast_2d(np.cov(pseudo.T, ddof=1)) / n

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))


def block_jackknife(xx: np.ndarray, xy: np.ndarray) -> Jackknife:
    """Least squares from per-block products xx (blocks x p x p) and xy (blocks x p)."""
    if len(xx) < 2:
        raise RegressionError("the jackknife needs at least two blocks")
    all_xx, all_xy = xx.sum(axis=0), xy.sum(axis=0)
    try:
        est = np.linalg.solve(all_xx, all_xy)
        delete = np.stack([np.linalg.solve(all_xx - a, all_xy - b) for a, b in zip(xx, xy, strict=True)])
    except np.linalg.LinAlgError as e:
        raise RegressionError("the design is singular") from e
    return Jackknife(est, delete)


def ratio_jackknife(est: float, numerator: np.ndarray, denominator: np.ndarray) -> Jackknife:
    if (denominator == 0).any():
        raise RegressionError("a block's denominator is zero")
    return Jackknife(np.array([est]), (numerator / denominator)[:, None])


def p_of(est: float, se: float) -> tuple[float, float]:
    """Two-sided p and Z; without spread p is 0 and Z infinite."""
    if se == 0:
        return 0.0, math.inf
    return normal_two_sided(est / se), est / se


def place(df: DataFrame, order: list[str]) -> DataFrame:
    """``i``: 0-based place of every row in the order of the genome; stored, as fits read it again and again."""
    return store.stored(numbered(df, order).withColumnRenamed("index", "i"), "placed")


def block_of(i: Column, n: int, blocks: int) -> Column:
    """Block of row i when the separators are floor(k n / blocks)."""
    return F.floor(((i + 1) * blocks - 1) / n).cast("int")


@dataclass
class Fit:
    """One regression: slope on the scale of the trait, and the intercept."""

    m: float
    n_bar: float
    jack: Jackknife
    intercept: float
    intercept_se: float | None

    @property
    def tot(self) -> float:
        return float(self.m * self.jack.est[0] / self.n_bar)

    @property
    def tot_se(self) -> float:
        return float(self.m * self.jack.se[0] / self.n_bar)

    @property
    def tot_delete(self) -> np.ndarray:
        return self.m * self.jack.delete[:, 0] / self.n_bar


@dataclass
class Regression:
    """y on x = n ld / mean(n), weights from the current estimate.

    rows: y, n, ld, wld, i and what ``weights(hsq, intercept)`` needs; step: rows of the first step."""

    rows: DataFrame
    m: float
    blocks: int
    null: float
    weights: Weights
    intercept: float | None = None
    step: Column | None = None

    def fit(self) -> Fit:
        s = self.rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.avg(F.col("ld") * F.col("n")).alias("xn"), F.avg("n").alias("n_bar")).first()
        if not s["n"]:
            raise RegressionError("no SNP is left")
        fixed = self.null if self.intercept is None else self.intercept
        if not s["xn"]:
            raise RegressionError("LD scores or sample sizes are zero")
        seed = self.m * (s["y"] - fixed) / s["xn"]
        count, self.n_bar = s["n"], s["n_bar"]
        start = self.weights(seed, fixed)
        blocks = min(self.blocks, count)
        if self.intercept is not None:
            j = self._irwls(self.rows, start, self.intercept, block_of(F.col("i"), count, blocks))
            return Fit(self.m, self.n_bar, j, self.intercept, None)
        if self.step is None:
            j = self._irwls(self.rows, start, None, block_of(F.col("i"), count, blocks))
            return Fit(self.m, self.n_bar, j, float(j.est[1]), float(j.se[1]))
        return self._two_step(start, count)

    def _two_step(self, start: Column, count: int) -> Fit:
        first = place(self.rows.filter(self.step).withColumnRenamed("i", "at"), ["at"])
        n1 = first.count()
        if n1 < 2:
            raise RegressionError("the first step has no SNPs")
        blocks = min(self.blocks, n1)
        first = first.withColumn("block", block_of(F.col("i"), n1, blocks))
        one = self._irwls(first, start, None, F.col("block"))
        at = sorted(r["at"] for r in first.filter("block > 0").groupBy("block").agg(F.min("at").alias("at")).collect())  # a row a block
        block = F.size(F.filter(F.array(*[F.lit(a).cast("long") for a in at]), lambda a: a <= F.col("i"))) if at else F.lit(0)
        fixed = float(one.est[1])
        two = self._irwls(self.rows, start, fixed, block)
        x = self._x()
        s = self.rows.agg(F.sum(start * x).alias("x"), F.sum(start * x * x).alias("xx")).first()
        c = s["x"] / s["xx"]
        delete = np.stack([two.delete[:, 0] - c * (one.delete[:, 1] - fixed), one.delete[:, 1]], axis=1)
        j = Jackknife(np.array([two.est[0], fixed]), delete)
        return Fit(self.m, self.n_bar, j, fixed, float(j.se[1]))

    def _x(self) -> Column:
        return F.col("n") * F.col("ld") / F.lit(self.n_bar)

    def _irwls(self, rows: DataFrame, start: Column, fixed: float | None, block: Column) -> Jackknife:
        """Two reweighting passes, then the block sums under the last weights."""
        w = start
        for _ in range(2):
            xx, xy = self._sums(rows, w, fixed, F.lit(0))
            try:
                est = np.linalg.solve(xx[0], xy[0])
            except np.linalg.LinAlgError as e:
                raise RegressionError("the design is singular") from e
            w = self.weights(float(self.m * est[0] / self.n_bar), float(est[1]) if fixed is None else fixed)
        return block_jackknife(*self._sums(rows, w, fixed, block))

    def _sums(self, rows: DataFrame, w: Column, fixed: float | None, block: Column) -> tuple[np.ndarray, np.ndarray]:
        d = rows.select(block.alias("block"), w.alias("w"), self._x().alias("x"), (F.col("y") - F.lit(fixed or 0.0)).alias("y"))
        terms = {"sw": "w", "sx": "w*x", "sy": "w*y", "sxx": "w*x*x", "sxy": "w*x*y"}
        got = d.groupBy("block").agg(*[F.sum(F.expr(e)).alias(k) for k, e in terms.items()]).orderBy("block").collect()  # a row a block
        if fixed is not None:
            return np.array([[[r["sxx"]]] for r in got]), np.array([[r["sxy"]] for r in got])
        return np.array([[[r["sxx"], r["sx"]], [r["sx"], r["sw"]]] for r in got]), np.array([[r["sxy"], r["sy"]] for r in got])


def _floored(c: str) -> Column:
    return F.greatest(F.col(c), F.lit(1.0))


def _clamp(x: float, lo: float, hi: float) -> float:
    return min(hi, max(lo, x))


def h2_weights(m: float, n: str = "n") -> Weights:
    """1 / (2 (intercept + h2 n ld / m) ** 2), over the weight LD score."""

    def of(h2: float, intercept: float) -> Column:
        mean = F.lit(float(intercept)) + F.lit(_clamp(h2, 0, 1) / m) * F.col(n) * _floored("ld")
        return 1 / (2 * mean * mean) / _floored("wld")

    return of


def gencov_weights(m: float, h1: Fit, h2: Fit) -> Weights:
    def of(rho: float, intercept: float) -> Column:
        ld = _floored("ld")
        a = F.lit(h1.intercept) + F.lit(_clamp(h1.tot, 0, 1) / m) * F.col("n1") * ld
        b = F.lit(h2.intercept) + F.lit(_clamp(h2.tot, 0, 1) / m) * F.col("n2") * ld
        c = F.lit(float(intercept)) + F.lit(_clamp(rho, -1, 1) / m) * F.sqrt(F.col("n1") * F.col("n2")) * ld
        return 1 / (a * b + c * c) / _floored("wld")

    return of


@dataclass
class Heritability:
    fit: Fit
    mean_chisq: float
    lambda_gc: float

    @property
    def ratio(self) -> float | None:
        """Share of the inflation that the intercept holds; None where nothing is inflated or the intercept is fixed."""
        if self.fit.intercept_se is None or self.mean_chisq <= 1:
            return None
        return (self.fit.intercept - 1) / (self.mean_chisq - 1)

    @property
    def ratio_se(self) -> float | None:
        return None if self.ratio is None else self.fit.intercept_se / (self.mean_chisq - 1)


def heritability(rows: DataFrame, m: float, blocks: int = BLOCKS, intercept: float | None = None, two_step: float | None = TWO_STEP, z: str = "z", n: str = "n") -> Heritability:
    """h2 from rows (z, n, ld, wld, i); a free intercept is fitted in two steps unless two_step is None."""
    y = F.col(z) * F.col(z)
    d = rows.select(y.alias("y"), F.col(n).cast("double").alias("n"), "ld", "wld", "i")
    step = None if intercept is not None or two_step is None else F.col("y") < two_step
    fit = Regression(d, m, blocks, 1.0, h2_weights(m), intercept, step).fit()
    mean = d.agg(F.avg("y").alias("mean")).first()["mean"]
    return Heritability(fit, mean, lambda_gc(d.select("y"), "y"))


def lambda_gc(df: DataFrame, chisq: str) -> float:
    """Inflation: the median chi-square over its value without effect."""
    return quantiles(df, chisq, [0.5]).first()["q0"] / MEDIAN_CHISQ


@dataclass
class Correlation:
    rg: float
    se: float
    z: float
    p: float
    h1: Heritability
    h2: Heritability
    gencov: Fit


def correlation(rows: DataFrame, m: float, blocks: int = BLOCKS, intercepts: tuple[float | None, float | None, float | None] = (None, None, None), two_step: float | None = TWO_STEP) -> Correlation:
    """Genetic correlation from rows (z1, n1, z2, n2, ld, wld, i); NaN where a heritability isn't positive."""
    if any(x is not None for x in intercepts):
        two_step = None
    h1 = heritability(rows, m, blocks, intercepts[0], two_step, "z1", "n1")
    h2 = heritability(rows, m, blocks, intercepts[1], two_step, "z2", "n2")
    d = rows.select(
        (F.col("z1") * F.col("z2")).alias("y"), F.sqrt(F.col("n1") * F.col("n2")).alias("n"), F.col("n1").cast("double").alias("n1"), F.col("n2").cast("double").alias("n2"),
        F.greatest(F.col("z1") * F.col("z1"), F.col("z2") * F.col("z2")).alias("most"), "ld", "wld", "i",
    )
    step = None if intercepts[2] is not None or two_step is None else F.col("most") < two_step
    cov = Regression(d, m, blocks, 0.0, gencov_weights(m, h1.fit, h2.fit), intercepts[2], step).fit()
    nan = math.nan
    if h1.fit.tot <= 0 or h2.fit.tot <= 0 or len({len(f.jack.delete) for f in (h1.fit, h2.fit, cov)}) > 1:
        return Correlation(nan, nan, nan, nan, h1, h2, cov)
    under = h1.fit.tot_delete * h2.fit.tot_delete
    if (under <= 0).any():
        return Correlation(cov.tot / math.sqrt(h1.fit.tot * h2.fit.tot), nan, nan, nan, h1, h2, cov)
    j = ratio_jackknife(cov.tot / math.sqrt(h1.fit.tot * h2.fit.tot), cov.tot_delete, np.sqrt(under))
    p, z = p_of(float(j.est[0]), float(j.se[0]))
    return Correlation(float(j.est[0]), float(j.se[0]), z, p, h1, h2, cov)


def summary(h: Heritability) -> str:
    """Plain report of a heritability fit."""
    f = h.fit
    lines = [f"Total observed-scale h2: {f.tot:.4f} ({f.tot_se:.4f})", f"Lambda GC: {h.lambda_gc:.4f}", f"Mean chi^2: {h.mean_chisq:.4f}"]
    if f.intercept_se is None:
        lines.append(f"Intercept: constrained to {f.intercept:.4f}")
    else:
        lines.append(f"Intercept: {f.intercept:.4f} ({f.intercept_se:.4f})")
        lines.append("Ratio: NA (mean chi^2 <= 1)" if h.ratio is None else f"Ratio: {h.ratio:.4f} ({h.ratio_se:.4f})")
    return "\n".join(lines)


def rg_summary(r: Correlation) -> str:
    """Plain report of a genetic correlation: both traits, their covariance, and the correlation."""
    g = r.gencov
    lines = ["Heritability of phenotype 1", summary(r.h1), "Heritability of phenotype 2", summary(r.h2), "Genetic covariance", f"Total observed-scale gencov: {g.tot:.4f} ({g.tot_se:.4f})"]
    lines.append(f"Intercept: constrained to {g.intercept:.4f}" if g.intercept_se is None else f"Intercept: {g.intercept:.4f} ({g.intercept_se:.4f})")
    lines.append("Genetic correlation")
    if math.isnan(r.rg):
        lines.append("Genetic correlation: nan (nan) (a heritability isn't above 0)")
    else:
        lines += [f"Genetic correlation: {r.rg:.4f} ({r.se:.4f})", f"Z-score: {r.z:.4f}", f"P: {r.p:.4g}"]
    return "\n".join(lines)


H2_SCHEMA = "h2 double, h2_se double, intercept double, intercept_se double, mean_chisq double, lambda_gc double, ratio double, n_snps long, m double"
RG_SCHEMA = "rg double, se double, z double, p double, gencov double, gencov_se double, gencov_intercept double, h2_1 double, h2_2 double"


def h2_frame(rows: DataFrame, m: float, **options) -> DataFrame:
    h = heritability(rows, m, **options)
    f = h.fit
    row = (f.tot, f.tot_se, float(f.intercept), f.intercept_se, h.mean_chisq, h.lambda_gc, h.ratio, rows.count(), float(m))
    return rows.sparkSession.createDataFrame([row], H2_SCHEMA)


def rg_frame(rows: DataFrame, m: float, **options) -> DataFrame:
    r = correlation(rows, m, **options)
    row = (r.rg, r.se, r.z, r.p, r.gencov.tot, r.gencov.tot_se, float(r.gencov.intercept), r.h1.fit.tot, r.h2.fit.tot)
    return rows.sparkSession.createDataFrame([row], RG_SCHEMA)


def on_panel(sumstats: list[DataFrame], panel: DataFrame) -> DataFrame:
    """One or two summary statistics (rsid, z, n) joined with a panel (rsid, contig, position, ld_score), placed in genome order."""
    d = panel.select("rsid", "contig", "position", F.col("ld_score").cast("double").alias("ld"), F.col("ld_score").cast("double").alias("wld"))
    for k, s in enumerate(sumstats, 1):
        z, n = ("z", "n") if len(sumstats) == 1 else (f"z{k}", f"n{k}")
        d = d.join(s.select("rsid", F.col("z").cast("double").alias(z), F.col("n").cast("double").alias(n)), "rsid")
    return place(d, ["contig", "position", "rsid"])


def common(panel: DataFrame, af: str = "af") -> int:
    """Number of panel rows with a frequency of 5 to 95 %."""
    return panel.filter(F.col(af).between(0.05, 0.95)).count()
