"""Tail probabilities and distributions without further libraries: of single values, and by ``columns`` of whole columns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import columns


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else float("nan")


def gamma_inc(a: float, x: float) -> tuple[float, float]:
    """Regularised incomplete gamma functions, lower and upper: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0, 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return front * total, max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return max(0.0, 1 - front * h), front * h


def chisq_sf(x: float, df: float) -> float:
    return gamma_inc(df / 2, x / 2)[1]


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


class Distribution:
    """Density, lower and upper tail, and quantile (bisection on the tail that is smaller, in doubles' resolution)."""

    low, high = -math.inf, math.inf

    def pdf(self, x: float) -> float:
        raise NotImplementedError

    def cdf(self, x: float) -> float:
        raise NotImplementedError

    def sf(self, x: float) -> float:
        return 1 - self.cdf(x)

    def ppf(self, p: float) -> float:
        return self._solve(p, 1 - p)

    def isf(self, p: float) -> float:
        return self._solve(1 - p, p)

    def _solve(self, p: float, q: float) -> float:
        if not (0 <= p <= 1 and 0 <= q <= 1):
            return math.nan
        if p == 0 or q == 0:
            return self.low if p == 0 else self.high
        above = (lambda x: self.cdf(x) < p) if p <= q else (lambda x: self.sf(x) > q)  # the quantile lies above x
        lo, hi, step = max(self.low, -1.0), min(self.high, 1.0), 1.0
        while above(hi) and hi < self.high:
            lo, step = hi, 2 * step
            hi = min(self.high, hi + step)
        step = 1.0
        while not above(lo) and lo > self.low:
            hi, step = lo, 2 * step
            lo = max(self.low, lo - step)
        for _ in range(2000):
            mid = (lo + hi) / 2
            if mid in (lo, hi):
                break
            lo, hi = (mid, hi) if above(mid) else (lo, mid)
        return hi


class Normal(Distribution):
    def __init__(self, mean: float = 0.0, sd: float = 1.0):
        self.mean, self.sd = mean, sd

    def pdf(self, x: float) -> float:
        return math.exp(-0.5 * ((x - self.mean) / self.sd) ** 2) / (self.sd * math.sqrt(2 * math.pi))

    def cdf(self, x: float) -> float:
        return math.erfc((self.mean - x) / self.sd / math.sqrt(2)) / 2

    def sf(self, x: float) -> float:
        return math.erfc((x - self.mean) / self.sd / math.sqrt(2)) / 2


class Student(Distribution):
    def __init__(self, df: float):
        self.df = df

    def pdf(self, x: float) -> float:
        d = self.df
        return math.exp(math.lgamma((d + 1) / 2) - math.lgamma(d / 2) - (d + 1) / 2 * math.log1p(x * x / d)) / math.sqrt(d * math.pi)

    def sf(self, x: float) -> float:
        tail = beta_inc(self.df / 2, 0.5, self.df / (self.df + x * x)) / 2
        return tail if x > 0 else 1 - tail

    def cdf(self, x: float) -> float:
        return self.sf(-x)


class ChiSquared(Distribution):
    low = 0.0

    def __init__(self, df: float):
        self.df = df

    def pdf(self, x: float) -> float:
        k = self.df / 2
        return 0.0 if x <= 0 else math.exp((k - 1) * math.log(x) - x / 2 - k * math.log(2) - math.lgamma(k))

    def cdf(self, x: float) -> float:
        return gamma_inc(self.df / 2, x / 2)[0]

    def sf(self, x: float) -> float:
        return chisq_sf(x, self.df)


class Fisher(Distribution):
    low = 0.0

    def __init__(self, d1: float, d2: float):
        self.d1, self.d2 = d1, d2

    def pdf(self, x: float) -> float:
        if x <= 0:
            return 0.0
        a, b = self.d1 / 2, self.d2 / 2
        front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(self.d1 / self.d2)
        return math.exp(front + (a - 1) * math.log(x) - (a + b) * math.log1p(self.d1 * x / self.d2))

    def cdf(self, x: float) -> float:
        return beta_inc(self.d1 / 2, self.d2 / 2, self.d1 * x / (self.d2 + self.d1 * x)) if x > 0 else 0.0

    def sf(self, x: float) -> float:
        return f_sf(x, self.d1, self.d2)


class Beta(Distribution):
    low, high = 0.0, 1.0

    def __init__(self, a: float, b: float):
        self.a, self.b = a, b

    def pdf(self, x: float) -> float:
        if not 0 < x < 1:
            return 0.0
        front = math.lgamma(self.a + self.b) - math.lgamma(self.a) - math.lgamma(self.b)
        return math.exp(front + (self.a - 1) * math.log(x) + (self.b - 1) * math.log1p(-x))

    def cdf(self, x: float) -> float:
        return beta_inc(self.a, self.b, x)

    def sf(self, x: float) -> float:
        return beta_inc(self.b, self.a, 1 - x)


FAMILIES = {"normal": Normal, "t": Student, "chi2": ChiSquared, "f": Fisher, "beta": Beta}


DEFAULTS = {"normal": (0.0, 1.0)}


def of_column(family: str, what: str, x: Column, *parameters: float | Column) -> Column:
    """pdf, cdf, sf, ppf or isf of a column under a distribution; null stays null.

    Tails, and all of the normal distribution, are column expressions whose parameters may be columns; the quantiles of
    the others are solved for, and densities computed, by a vectorised Python function with fixed parameters."""
    given = parameters or DEFAULTS.get(family, ())
    if f := columns.FUNCTIONS.get((family, what)):
        return columns.once(lambda *a: f(*a), x, *[p if isinstance(p, Column) else F.lit(float(p)) for p in given])
    call = getattr(FAMILIES[family](*given), what)

    @F.pandas_udf(DoubleType())
    def apply(v: pd.Series) -> pd.Series:
        return v.map(lambda x: call(x) if pd.notna(x) else None).astype("float64")

    return apply(x.cast("double"))


def p_normal(z: Column) -> Column:
    """Two-sided normal p-value; null stays null."""
    return columns.once(columns.p_normal, z)


def p_student(t: Column, df: Column | str) -> Column:
    """Two-sided Student p-value; null stays null."""
    return columns.once(columns.p_student, t, df)


def p_chisq(q: Column | str, df: Column | str) -> Column:
    """Upper tail of chi-square; null where q, df or both are, or df isn't positive."""
    return columns.once(lambda x, n: F.when(n > 0, F.when(x <= 0, F.lit(1.0)).otherwise(columns.p_chisq(x, n))), q, df)
