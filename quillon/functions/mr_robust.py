"""Mendelian randomisation: medians and modes with bootstrap errors, heterogeneity, pleiotropy and direction.

A group (exposure, outcome) is a set of instruments, some hundreds at the most; the
bootstrap methods see a group at once in ``applyInArrow``, the rest are columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import mr
from .special import f_sf, normal_two_sided, of_column, p_chisq, p_normal, p_student, t_two_sided

RESULT = "id_exposure string, id_outcome string, method string, nsnp long, b double, se double, pval double"
GRID, CUT = 512, 3


@dataclass(frozen=True)
class Parameters:
    """Replicates, penalty of outlying ratios, bandwidth factor of the modes, and the seed; the others are those of methods that raise."""

    test_dist: str = "z"
    nboot: int = 1000
    cov: float = 0.0
    penk: float = 20.0
    phi: float = 1.0
    alpha: float = 0.05
    qthresh: float = 0.05
    over_dispersion: bool = True
    loss_function: str = "huber"
    shrinkage: bool = False
    seed: int = 1


# The methods by name and their titles.
METHODS = {
    "mr_wald_ratio": "Wald ratio",
    "mr_two_sample_ml": "Maximum likelihood",
    "mr_egger_regression": "MR Egger",
    "mr_egger_regression_bootstrap": "MR Egger (bootstrap)",
    "mr_simple_median": "Simple median",
    "mr_weighted_median": "Weighted median",
    "mr_penalised_weighted_median": "Penalised weighted median",
    "mr_ivw": "Inverse variance weighted",
    "mr_ivw_radial": "IVW radial",
    "mr_ivw_mre": "Inverse variance weighted (multiplicative random effects)",
    "mr_ivw_fe": "Inverse variance weighted (fixed effects)",
    "mr_simple_mode": "Simple mode",
    "mr_weighted_mode": "Weighted mode",
    "mr_weighted_mode_nome": "Weighted mode (NOME)",
    "mr_simple_mode_nome": "Simple mode (NOME)",
    "mr_raps": "Robust adjusted profile score (RAPS)",
    "mr_sign": "Sign concordance test",
    "mr_uwr": "Unweighted regression",
    "mr_grip": "MR GRIP",
}


def weighted_median(ratio: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ratios (rows are replicates) interpolated where the centred cumulative weight reaches one half."""
    ratio, weight = np.atleast_2d(ratio), np.broadcast_to(weight, np.atleast_2d(ratio).shape)
    order = np.argsort(ratio, axis=1, kind="stable")
    r, w = np.take_along_axis(ratio, order, 1), np.take_along_axis(weight, order, 1)
    at = (np.cumsum(w, axis=1) - w / 2) / w.sum(axis=1, keepdims=True)
    below = np.clip((at < 0.5).sum(axis=1) - 1, 0, r.shape[1] - 2)
    rows = np.arange(len(r))
    span = at[rows, below + 1] - at[rows, below]
    share = np.divide(0.5 - at[rows, below], span, out=np.zeros(len(r)), where=span > 0)
    return r[rows, below] + (r[rows, below + 1] - r[rows, below]) * share


def density(x: np.ndarray, weight: np.ndarray, bandwidth: float) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian kernel density at GRID points reaching CUT bandwidths beyond the data, from linearly binned weights."""
    lo, hi = x.min() - CUT * bandwidth, x.max() + CUT * bandwidth
    grid = np.linspace(lo, hi, GRID)
    step = grid[1] - grid[0]
    pos = (x - lo) / step
    k = np.clip(pos.astype(int), 0, GRID - 2)
    mass = np.bincount(k, weight * (k + 1 - pos), GRID) + np.bincount(k + 1, weight * (pos - k), GRID)
    kernel = np.exp(-0.5 * (np.arange(1 - GRID, GRID) * step / bandwidth) ** 2) / (bandwidth * math.sqrt(2 * math.pi))
    return grid, _smooth(mass / weight.sum(), kernel)


def _smooth(mass: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Convolution with the kernel centred on every grid point."""
    size = 1 << (len(mass) + len(kernel) - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(mass, size) * np.fft.rfft(kernel, size), size)
    return np.maximum(full[GRID - 1 : 2 * GRID - 1], 0)


def mad(x: np.ndarray) -> float:
    return float(1.4826 * np.median(np.abs(x - np.median(x))))


def mode(ratio: np.ndarray, se: np.ndarray, phi: float) -> float:
    """Place of the highest density under weights 1 / se squared."""
    s = 0.9 * min(ratio.std(ddof=1), mad(ratio)) / len(ratio) ** 0.2
    h = max(1e-8, s * phi)
    w = 1 / se**2
    grid, d = density(ratio, w / w.sum(), h)
    return float(grid[d.argmax()])


def ratio_errors(bx: np.ndarray, by: np.ndarray, sx: np.ndarray, sy: np.ndarray, nome: bool) -> np.ndarray:
    """Standard errors of by / bx by the delta method; nome takes the exposure's effects as known."""
    if nome:
        return sy / np.abs(bx)
    return np.sqrt(sy**2 / bx**2 + by**2 * sx**2 / bx**4)


MEDIANS = ("mr_simple_median", "mr_weighted_median", "mr_penalised_weighted_median")
MODES = ("mr_simple_mode", "mr_weighted_mode", "mr_simple_mode_nome", "mr_weighted_mode_nome")
#: Replicates that a task draws for a group; numbers that it draws at a time.
PER_BLOCK, DRAWN = 125, 2_000_000


def normals(seed: int, replicate: int, size: int) -> np.ndarray:
    """The standard normal draws of a replicate: the same wherever and with whatever others it is drawn."""
    return np.random.Generator(np.random.Philox(key=[seed, replicate])).standard_normal(size)


def _replicates(kind: str, bx: np.ndarray, by: np.ndarray, sx: np.ndarray, sy: np.ndarray, p: Parameters, which: range) -> tuple[float, np.ndarray]:
    """The estimate, and those of the replicates ``which``.  Memory: some numbers an instrument, not one for each instrument and replicate."""
    k, ratio = len(bx), by / bx
    step = max(1, DRAWN // (2 * k))
    if kind in MEDIANS:
        weight = np.ones(k) if kind == "mr_simple_median" else 1 / ratio_errors(bx, by, sx, sy, False) ** 2
        if kind == "mr_penalised_weighted_median":
            centre = weighted_median(ratio, weight)[0]
            tail = np.array([normal_two_sided(math.sqrt(w) * (r - centre)) for w, r in zip(weight, ratio, strict=True)])
            weight = weight * np.minimum(1, tail * p.penk)
        out = []
        for lo in range(which.start, which.stop, step):
            z = np.stack([normals(p.seed, r, 2 * k) for r in range(lo, min(lo + step, which.stop))])
            out.append(weighted_median((by + sy * z[:, k:]) / (bx + sx * z[:, :k]), weight))
        return float(weighted_median(ratio, weight)[0]), np.concatenate(out) if out else np.zeros(0)
    error = ratio_errors(bx, by, sx, sy, kind.endswith("nome"))
    used = np.ones(k) if "simple" in kind else error
    return mode(ratio, used, p.phi), np.array([mode(ratio + error * normals(p.seed, r, k), used, p.phi) for r in which])


def robust(kept: DataFrame, method: str, parameters: Parameters = Parameters()) -> DataFrame:  # noqa: B008
    """One row per group; fewer than three instruments (or a zero exposure effect) give nothing.

    A group's replicates are dealt to tasks, PER_BLOCK to each, which hold the group's instruments and draw by counters (seed and replicate);
    the spread of the replicates, and the p-value, are aggregations."""
    blocks = max(1, -(-parameters.nboot // PER_BLOCK))

    def run(t: pa.Table) -> pa.Table:
        bx, by, sx, sy = (t[c].to_numpy().astype(float) for c in ("beta_exposure", "beta_outcome", "se_exposure", "se_outcome"))
        order = np.lexsort((sy, sx, by, bx))
        bx, by, sx, sy = bx[order], by[order], sx[order], sy[order]
        block = t["_block"][0].as_py()
        which = range(block * PER_BLOCK, min((block + 1) * PER_BLOCK, parameters.nboot))
        b, values = (math.nan, np.zeros(0)) if len(bx) < 3 or (bx == 0).any() else _replicates(method, bx, by, sx, sy, parameters, which)
        n = 0 if math.isnan(b) and not len(values) else 1
        key = lambda c: pa.array([t[c][0].as_py()] * n, pa.string())
        return pa.table({"id_exposure": key("id_exposure"), "id_outcome": key("id_outcome"), "nsnp": pa.array([len(bx)] * n, pa.int64()), "b": pa.array([b] * n, pa.float64()), "boot": pa.array([values.tolist()] * n, pa.list_(pa.float64()))})

    cols = kept.select(*[F.col(c).cast("string").alias(c) for c in mr.KEYS], "beta_exposure", "beta_outcome", "se_exposure", "se_outcome")
    dealt = cols.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    parts = dealt.groupBy(*mr.KEYS, "_block").applyInArrow(run, "id_exposure string, id_outcome string, nsnp long, b double, boot array<double>")
    d = parts.groupBy(*mr.KEYS).agg(F.max("nsnp").alias("nsnp"), F.max("b").alias("b"), F.sort_array(F.flatten(F.collect_list("boot"))).alias("x"))  # nboot numbers a group
    n = F.size("x")
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / n
    middle = lambda x: (F.get(x, ((n - 1) / 2).cast("int")) + F.get(x, (n / 2).cast("int"))) / 2
    if method in MEDIANS:
        d = d.withColumn("_mean", mean)
        d = d.withColumn("se", F.when(n > 1, F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - F.col("_mean")) * (v - F.col("_mean"))) / (n - 1))))
        p = p_normal(F.col("b") / F.col("se"))
    else:
        d = d.withColumn("_mid", middle(F.col("x")))
        d = d.withColumn("_away", F.sort_array(F.transform("x", lambda v: F.abs(v - F.col("_mid"))))).withColumn("se", F.lit(1.4826) * middle(F.col("_away")))
        p = p_student(F.col("b") / F.col("se"), (F.col("nsnp") - 1).cast("double"))
    p = F.when(F.col("se") > 0, p).otherwise(F.lit(math.nan))
    return d.select(*mr.KEYS, F.lit(method).alias("method"), "nsnp", "b", "se", p.alias("pval"))


DEFAULT = ["mr_wald_ratio", "mr_egger_regression", "mr_weighted_median", "mr_ivw", "mr_simple_mode", "mr_weighted_mode"]


def estimates(kept: DataFrame, methods: list[str] | None = None, parameters: Parameters = Parameters()) -> DataFrame:  # noqa: B008
    """Rows of all the methods asked for, closed forms and bootstrap ones; an unknown one is an error for the whole run."""
    names = methods or DEFAULT
    if unknown := [m for m in names if m not in METHODS]:
        raise ValueError(f"unknown methods: {', '.join(unknown)}")
    closed = [m for m in names if m not in MEDIANS + MODES]
    parts = ([mr.estimates(kept, closed)] if closed else []) + [robust(kept, m, parameters) for m in names if m in MEDIANS + MODES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def heterogeneity(kept: DataFrame) -> DataFrame:
    """Cochran's Q of both regressions with its degrees of freedom and p-value."""
    one = mr.ivw(kept).select(*mr.KEYS, "method", "q", (F.col("nsnp") - 1).alias("q_df"))
    two = mr.egger(kept).select(*mr.KEYS, "method", "q", (F.col("nsnp") - 2).alias("q_df"))
    return one.unionByName(two).withColumn("q_pval", p_chisq("q", F.col("q_df").cast("double")))


def pleiotropy(kept: DataFrame) -> DataFrame:
    """The intercept of the regression with one, its error and p-value."""
    e = mr.egger(kept)
    return e.select(*mr.KEYS, "nsnp", "intercept", "intercept_se", p_student(F.try_divide("intercept", "intercept_se"), (F.col("nsnp") - 2).cast("double")).alias("pval"))


def r_from_b(b: Column, se: Column, n: Column) -> Column:
    """Correlation that an effect, its error and the sample size stand for."""
    f = b * b / (se * se)
    return F.sqrt(f / (n - 2 + f))


def r_from_p(p: float, n: float) -> float:
    """Correlation with the p-value p of n samples: bisection on the F tail."""
    if not 0 < p < 1 or n <= 2:
        return math.nan
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        tail = f_sf(mid / (1 - mid) * (n - 2), 1, n - 2) if mid < 1 else 0.0
        lo, hi = (mid, hi) if tail > p else (lo, mid)
    return math.sqrt((lo + hi) / 2)


def effective_n(cases: Column, controls: Column) -> Column:
    return 2 / (1 / cases + 1 / controls)


def i_squared(y: Column, se: Column) -> Column:
    """Aggregate: share of the spread of estimates that their errors don't explain, at least 0."""
    w = 1 / (se * se)
    q = F.sum(w * y * y) - F.sum(w * y) * F.sum(w * y) / F.sum(w)
    return F.greatest(F.lit(0.0), (q - (F.count(y) - 1)) / q)


def se_from_p(b: Column, p: Column) -> Column:
    """Error of an effect with that two-sided normal p-value."""
    return F.abs(b) / of_column("normal", "isf", p / 2)


def r_test(n1: float, n2: float, r1: float, r2: float) -> tuple[float, float]:
    """Fisher's z of the difference of two independent correlations, and its two-sided p-value."""
    z = (math.atanh(r1) - math.atanh(r2)) / math.sqrt(1 / (n1 - 3) + 1 / (n2 - 3))
    return z, normal_two_sided(z)


def steiger_sensitivity(r_exposure: float, r_outcome: float) -> float:
    """Ratio of the volumes of measurement error in which the inferred direction holds and in which it does not."""
    a, b = max(r_exposure, r_outcome), min(r_exposure, r_outcome)
    la, lb = math.log(a), math.log(b)
    whole = a * la - b * lb + a * b * (lb - la)
    against = 2 * a * b - 2 * b - b * la - a * b * la
    return abs(whole - against) / against


@dataclass(frozen=True)
class Steiger:
    r2_exposure: float
    r2_outcome: float
    correct_direction: bool
    pval: float
    correct_direction_adjusted: bool
    pval_adjusted: float
    sensitivity_ratio: float


def steiger(r_exposure: float, r_outcome: float, n_exposure: float, n_outcome: float, reliability_exposure: float = 1.0, reliability_outcome: float = 1.0) -> Steiger:
    """Whether the exposure is explained better than the outcome; adjusted for the measurements' reliability."""
    if not (0 <= reliability_exposure <= 1 and 0 <= reliability_outcome <= 1):
        raise ValueError("a reliability lies between 0 and 1")
    x, y = abs(r_exposure), abs(r_outcome)
    ax, ay = x / reliability_exposure, y / reliability_outcome
    return Steiger(x * x, y * y, x > y, r_test(n_exposure, n_outcome, x, y)[1], ax > ay, r_test(n_exposure, n_outcome, ax, ay)[1], steiger_sensitivity(x, y))


def steiger_of_pn(rows: list[tuple[float, float, float, float]], reliability_exposure: float = 1.0, reliability_outcome: float = 1.0) -> Steiger:
    """From the p-values and sample sizes (p of exposure, p of outcome, n of exposure, n of outcome) of a group's instruments."""
    total = lambda p, n: math.sqrt(sum(r_from_p(r[p], r[n]) ** 2 for r in rows))
    mean = lambda n: sum(r[n] for r in rows) / len(rows)
    return steiger(total(0, 2), total(1, 3), mean(2), mean(3), reliability_exposure, reliability_outcome)


def directionality(kept: DataFrame) -> DataFrame:
    """Per group: r squared of exposure and outcome summed over instruments, the direction and its p-value."""
    n = [F.col("samplesize_exposure").cast("double"), F.col("samplesize_outcome").cast("double")]
    d = kept.select(
        *mr.KEYS, r_from_b(F.col("beta_exposure"), F.col("se_exposure"), n[0]).alias("rx"), r_from_b(F.col("beta_outcome"), F.col("se_outcome"), n[1]).alias("ry"),
        n[0].alias("nx"), n[1].alias("ny"),
    )
    s = d.groupBy(*mr.KEYS).agg(F.sum(F.expr("rx*rx")).alias("r2_exposure"), F.sum(F.expr("ry*ry")).alias("r2_outcome"), F.avg("nx").alias("nx"), F.avg("ny").alias("ny"))
    z = (F.atanh(F.sqrt("r2_exposure")) - F.atanh(F.sqrt("r2_outcome"))) / F.sqrt(1 / (F.col("nx") - 3) + 1 / (F.col("ny") - 3))
    return s.select(*mr.KEYS, "r2_exposure", "r2_outcome", (F.col("r2_exposure") > F.col("r2_outcome")).alias("correct_direction"), p_normal(z).alias("pval"))
