"""Special functions and tail probabilities as column expressions: no Python worker, parameters may be columns.

erfc takes a series of positive terms near 0 and a continued fraction in the tail; the incomplete gamma and beta functions a series or Lentz's
continued fraction of as many steps as the parameters ask for.  Relative errors are about 1e-13 in the bodies and some 1e-12 in
tails down to 1e-300.  Nulls stay null; values outside of a function's range are NaN.  Arguments are read often: pass plain columns.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where erfc changes its way, and the terms of each.
ERF_SPLIT, SERIES, FRACTION = 2.5, 48, 52
# The rational functions of Wichura's algorithm AS 241 for quantiles of the normal distribution: numerators and denominators, lowest power first.
CENTRE = (
    [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
    [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3],
)
MIDDLE = (
    [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
)
TAIL = (
    [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
)
# Coefficients of Stirling's series for log gamma, of 1/x, 1/x^3, ...
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156]
SHIFT = 10
TINY = 1e-300


def _poly(c: list[float], x: Column) -> Column:
    return reduce(lambda a, k: a * x + F.lit(k), reversed(c[:-1]), F.lit(c[-1]))


def _double(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def _series(x: Column) -> Column:
    """erf for 0 <= x up to ERF_SPLIT."""
    s = F.lit(1.0)
    for n in range(SERIES, 0, -1):
        s = F.lit(1.0) + F.lit(2.0 / (2 * n + 1)) * x * x * s
    return F.lit(2 / math.sqrt(math.pi)) * x * F.exp(-x * x) * s


def _fraction(x: Column) -> Column:
    """erfc for x from ERF_SPLIT on."""
    f = x
    for n in range(FRACTION, 0, -1):
        f = x + F.lit(n / 2) / f
    return F.exp(-x * x) / F.lit(math.sqrt(math.pi)) / f


def erf(x: Column | str) -> Column:
    x = _double(x)
    a = F.abs(x)
    return F.signum(x) * F.when(a < ERF_SPLIT, _series(a)).when(a < 6, 1 - _fraction(F.greatest(a, F.lit(1.0)))).when(a >= 6, F.lit(1.0))


def erfc(x: Column | str) -> Column:
    x = _double(x)
    tail = lambda v: _fraction(F.greatest(v, F.lit(1.0)))
    return F.when(F.isnan(x), x).when(x < -6, F.lit(2.0)).when(x <= -ERF_SPLIT, 2 - tail(-x)).when(x < 0, 1 + _series(-x)).when(x < ERF_SPLIT, 1 - _series(x)).when(x < 28, tail(x)).when(x.isNotNull(), F.lit(0.0))


def normal_cdf(z: Column | str) -> Column:
    return erfc(-_double(z) / F.lit(math.sqrt(2))) / 2


def normal_sf(z: Column | str) -> Column:
    return erfc(_double(z) / F.lit(math.sqrt(2))) / 2


def p_normal(z: Column | str) -> Column:
    """Two-sided."""
    return erfc(F.abs(_double(z)) / F.lit(math.sqrt(2)))


def normal_quantile(p: Column | str) -> Column:
    """The inverse of ``normal_cdf``; infinite at 0 and 1."""
    p = _double(p)
    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    near, mid, far = F.lit(0.180625) - q * q, r - 1.6, r - 5
    ratio = lambda c, x: _poly(c[0], x) / _poly(c[1], x)
    tail = F.when(r <= 5, ratio(MIDDLE, mid)).otherwise(ratio(TAIL, far))
    inside = F.when(F.abs(q) <= 0.425, q * ratio(CENTRE, near)).otherwise(F.signum(q) * tail)
    infinite = F.lit(float("inf"))
    return F.when(p == 0, -infinite).when(p == 1, infinite).when((p > 0) & (p < 1), inside).when(p.isNotNull(), F.lit(float("nan")))


def erf_inverse(x: Column | str) -> Column:
    return normal_quantile((_double(x) + 1) / 2) / F.lit(math.sqrt(2))


def erfc_inverse(x: Column | str) -> Column:
    return -normal_quantile(_double(x) / 2) / F.lit(math.sqrt(2))


def z_of_p(p: Column | str) -> Column:
    """The size of the normal statistic with two-sided p."""
    p = _double(p)
    return F.when(p == 1, F.lit(0.0)).otherwise(-normal_quantile(p / 2))


def log_gamma(x: Column | str) -> Column:
    """For x above 0."""
    x = _double(x)
    y = x + SHIFT
    series = _poly([float(c) for c in STIRLING], 1 / (y * y)) / y
    stirling = (y - 0.5) * F.ln(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series
    # in logarithms of pairs, so that the product does not overflow
    below = reduce(Column.__add__, [F.ln((x + k) * (x + k + 1)) for k in range(0, SHIFT, 2)])
    return stirling - below


def _steps(n: Column, start: Column, step, end) -> Column:
    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, step, end)


def gamma_p_q(a: Column | str, x: Column | str) -> tuple[Column, Column]:
    """The regularised incomplete gamma functions P and Q."""
    a, x = _double(a), _double(x)
    front = F.exp(a * F.ln(x) - x - log_gamma(a))
    n = F.lit(60) + F.lit(14) * F.sqrt(a)
    # series: 1/a + x/(a (a + 1)) + ...
    first = F.struct((1 / a).alias("t"), (1 / a).alias("s"))
    below = front * _steps(n, first, lambda s, k: F.struct((s["t"] * x / (a + k)).alias("t"), (s["s"] + s["t"] * x / (a + k)).alias("s")), lambda s: s["s"])

    def lentz(s: Column, k: Column) -> Column:
        an, b = -k * (k - a), x + 2 * k + 1 - a
        d = b + an * s["d"]
        d = 1 / F.when(F.abs(d) < TINY, F.lit(TINY)).otherwise(d)
        c = b + an / s["c"]
        c = F.when(F.abs(c) < TINY, F.lit(TINY)).otherwise(c)
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    b0 = x + 1 - a
    above = front * _steps(n, F.struct(F.lit(1 / TINY).alias("c"), (1 / b0).alias("d"), (1 / b0).alias("h")), lentz, lambda s: s["h"])
    low = x < a + 1
    fine = (a > 0) & (x >= 0)
    nan = F.lit(float("nan"))
    p = F.when(fine & (x == 0), F.lit(0.0)).when(fine & low, below).when(fine, 1 - above).when(a.isNotNull() & x.isNotNull(), nan)
    q = F.when(fine & (x == 0), F.lit(1.0)).when(fine & low, 1 - below).when(fine, above).when(a.isNotNull() & x.isNotNull(), nan)
    return p, q


def beta_i(a: Column | str, b: Column | str, x: Column | str, rest: Column | None = None) -> Column:
    """The regularised incomplete beta function; rest: 1 - x where that is known more exactly."""
    a, b, x = _double(a), _double(b), _double(x)
    y = 1 - x if rest is None else rest
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(y))
    n = F.lit(40) + F.lit(6) * F.sqrt(F.greatest(a, b))
    safe = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)

    def fraction(a: Column, b: Column, x: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
            d1, c1 = 1 / safe(1 + even * s["d"]), safe(1 + even / s["c"])
            odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
            d2, c2 = 1 / safe(1 + odd * d1), safe(1 + odd / c1)
            return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d1 * c1 * d2 * c2).alias("h"))

        d = 1 / safe(1 - (a + b) * x / (a + 1))
        return _steps(n, F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h")), step, lambda s: s["h"])

    low = x < (a + 1) / (a + b + 2)
    fine = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    value = F.when(low, front * fraction(a, b, x) / a).otherwise(1 - front * fraction(b, a, y) / b)
    return F.when(fine & (x == 0), F.lit(0.0)).when(fine & (y == 0), F.lit(1.0)).when(fine, value).when(a.isNotNull() & b.isNotNull() & x.isNotNull(), F.lit(float("nan")))


def p_chisq(q: Column | str, df: Column | str) -> Column:
    """Upper tail of chi-square."""
    return gamma_p_q(_double(df) / 2, _double(q) / 2)[1]


def p_student(t: Column | str, df: Column | str) -> Column:
    """Two-sided."""
    t, df = _double(t), _double(df)
    whole = df + t * t
    return beta_i(df / 2, F.lit(0.5), df / whole, t * t / whole)


def p_fisher(f: Column | str, d1: Column | str, d2: Column | str) -> Column:
    """Upper tail of F."""
    f, d1, d2 = _double(f), _double(d1), _double(d2)
    whole = d2 + d1 * f
    return beta_i(d2 / 2, d1 / 2, d2 / whole, d1 * f / whole)


def once(f, *args: Column | str) -> Column:
    """f of arguments that are worked out once: for arguments that are expressions."""
    row = F.struct(*[_double(a).alias(f"a{k}") for k, a in enumerate(args)])
    return F.element_at(F.transform(F.array(row), lambda s: f(*[s[f"a{k}"] for k in range(len(args))])), 1)


def normal(what: str, x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    calls = {
        "pdf": lambda: F.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi)), "cdf": lambda: normal_cdf(z), "sf": lambda: normal_sf(z),
        "ppf": lambda: mean + sd * normal_quantile(x), "isf": lambda: mean - sd * normal_quantile(x),
    }
    return calls[what]()


def student_sf(x: Column, df: Column) -> Column:
    half = p_student(x, df) / 2
    return F.when(x < 0, 1 - half).otherwise(half)


#: Distribution functions whose parameters may be columns: (family, what) to a function of x and them.
FUNCTIONS = {
    **{("normal", w): (lambda x, mean, sd, w=w: normal(w, x, mean, sd)) for w in ("pdf", "cdf", "sf", "ppf", "isf")},
    ("t", "sf"): student_sf, ("t", "cdf"): lambda x, df: student_sf(-x, df),
    ("chi2", "sf"): lambda x, df: F.when(x <= 0, F.lit(1.0)).otherwise(p_chisq(x, df)), ("chi2", "cdf"): lambda x, df: F.when(x <= 0, F.lit(0.0)).otherwise(gamma_p_q(df / 2, x / 2)[0]),
    ("f", "sf"): lambda x, d1, d2: F.when(x <= 0, F.lit(1.0)).otherwise(p_fisher(x, d1, d2)), ("f", "cdf"): lambda x, d1, d2: F.when(x <= 0, F.lit(0.0)).otherwise(beta_i(d1 / 2, d2 / 2, d1 * x / (d2 + d1 * x), d2 / (d2 + d1 * x))),
    ("beta", "cdf"): lambda x, a, b: F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(beta_i(a, b, x)), ("beta", "sf"): lambda x, a, b: F.when(x <= 0, F.lit(1.0)).when(x >= 1, F.lit(0.0)).otherwise(beta_i(b, a, 1 - x, x)),
}
