"""Mendelian randomisation: row-local harmonising and closed-form estimators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .special import p_chisq, p_normal, p_student

KEYS = ["id_exposure", "id_outcome"]


def _comp(x: Column) -> Column:
    return F.translate(x, "ACGT", "TGCA")


def _marked(x1: Column, x2: Column) -> Column:
    """Alleles that spell out an insertion or deletion, or name one by I and D."""
    return (F.length(x1) > 1) | (F.length(x2) > 1) | x1.isin("D", "I")


def _spelled(letter: Column, x1: Column, x2: Column) -> Column:
    """What I (the longer allele) or D (the shorter one) stands for, by the other side's spelled alleles; null where that can't be told."""
    longer = F.when(F.length(x1) > F.length(x2), x1).when(F.length(x1) < F.length(x2), x2)
    shorter = F.when(F.length(x1) > F.length(x2), x2).when(F.length(x1) < F.length(x2), x1)
    return F.when(letter == "I", longer).when(letter == "D", shorter)


def _named(x1: Column, x2: Column) -> Column:
    return ((x1 == "I") & (x2 == "D")) | ((x1 == "D") & (x2 == "I"))


def _lost(x1: Column, x2: Column, other: Column) -> Column:
    """Spelled alleles of one length can't tell which of them the other side's I or D is."""
    return (F.length(x1) > 1) & (F.length(x1) == F.length(x2)) & other.isin("D", "I")


def _palindrome(x1: Column, x2: Column) -> Column:
    return F.concat(x1, x2).isin("AT", "TA", "CG", "GC")


def harmonise(df: DataFrame, action: int = 2, tolerance: float = 0.08) -> DataFrame:
    """Effects on the exposure's effect allele: swap, strand flip, palindromes by frequency, insertions and deletions.

    Either side's other allele may be null: alleles are then matched by what is known, and rows whose
    frequencies (null: one half) don't confirm the match are ambiguous.  Updates alleles, effects and
    frequencies; adds palindromic, ambiguous, remove and mr_keep.  action 1 keeps all that match, 2 turns
    palindromes by frequency and drops ambiguous rows, 3 drops palindromes too."""
    names = ["effect_allele_exposure", "other_allele_exposure", "effect_allele_outcome", "other_allele_outcome"]
    upper = {k: F.upper(n) for k, n in zip(("a1", "a2", "b1", "b2"), names, strict=True)}
    d = df.withColumns({f"_{k}": F.coalesce(c, F.lit("")) if k in ("a1", "b1") else c for k, c in upper.items()})
    d = d.withColumn("_kind", F.concat(F.when(F.col("_a2").isNull(), "1").otherwise("2"), F.when(F.col("_b2").isNull(), "1").otherwise("2")))
    a1, a2, b1, b2, kind = (F.col(f"_{k}") for k in ("a1", "a2", "b1", "b2", "kind"))
    lo, hi = 0.5 - tolerance, 0.5 + tolerance
    fa, fb = F.coalesce("eaf_exposure", F.lit(0.5)), F.coalesce("eaf_outcome", F.lit(0.5))
    alike = ((fa < lo) & (fb < lo)) | ((fa > hi) & (fb > hi))
    unlike = ((fa < lo) & (fb > hi)) | ((fa > hi) & (fb < lo))

    # insertions and deletions: letters become the other side's spelling; rows that can't be told are removed
    marked = F.when(kind == "22", _marked(a1, a2)).when(kind == "21", _marked(a1, a2)).when(kind == "12", _marked(b1, b2)).otherwise(False)
    pal = F.when(kind == "12", _palindrome(b1, b2)).when(kind == "11", False).otherwise(_palindrome(a1, a2))
    d = d.withColumns({"_marked": marked, "_pal": pal})
    both, left, right = kind == "22", kind == "21", kind == "12"
    put = lambda test, new, old: F.when(F.col("_marked") & test, F.coalesce(new, old)).otherwise(old)
    other = lambda new, x1, x2: F.when(new == x1, x2).otherwise(x1)
    s_b1, s_a1 = _spelled(b1, a1, a2), _spelled(a1, b1, b2)
    d = d.withColumns({
        "_c1": put((both & _named(b1, b2)) | left, s_b1, b1),
        "_c2": put(both & _named(b1, b2), _spelled(b2, a1, a2), F.when(F.col("_marked") & left & s_b1.isNotNull(), other(s_b1, a1, a2)).otherwise(b2)),
        "_d1": put((both & _named(a1, a2)) | right, s_a1, a1),
        "_d2": put(both & _named(a1, a2), _spelled(a2, b1, b2), F.when(F.col("_marked") & right & s_a1.isNotNull(), other(s_a1, b1, b2)).otherwise(a2)),
    })
    c1, c2, d1, d2 = (F.col(k) for k in ("_c1", "_c2", "_d1", "_d2"))
    bad = F.when(both, _lost(a1, a2, c1) | _lost(b1, b2, d1) | (d1 == d2) | (c1 == c2)).when(left, _named(a1, a2) | _lost(a1, a2, c1) | (a1 == a2))
    bad = bad.when(right, _named(b1, b2) | _lost(b1, b2, d1) | (b1 == b2)).otherwise(False)
    d = d.withColumn("_bad", F.coalesce(F.col("_marked") & bad, F.lit(False)))

    # both alleles on both sides
    same, swapped = (d1 == c1) & (d2 == c2), (d1 == c2) & (d2 == c1)
    flip_same, flip_swapped = (d1 == _comp(c1)) & (d2 == _comp(c2)), (d1 == _comp(c2)) & (d2 == _comp(c1))
    open_ = ~F.when(kind == "22", _palindrome(d1, d2)).otherwise(False)
    turn22 = F.when(same, False).when(swapped, True).when(flip_same, False).otherwise(open_ & flip_swapped)
    fits22 = same | swapped | (open_ & (flip_same | flip_swapped))
    opposite = _palindrome(d1, d2) & (((fa < 0.5) & (F.when(turn22, 1 - fb).otherwise(fb) > 0.5)) | ((fa > 0.5) & (F.when(turn22, 1 - fb).otherwise(fb) < 0.5)))
    # one allele on a side: as it is, as the other one, or on the other strand
    as_is, as_other = d1 == c1, F.when(left, d2 == c1).when(right, d1 == c2).otherwise(False)
    strand = ~as_is & ~as_other
    flipped_other = strand & F.when(left, d2 == _comp(c1)).when(right, c2 == _comp(d1)).otherwise(False)
    known = lambda c: F.coalesce(c, F.lit(False))
    d = d.withColumns({
        "_turn": known(F.when(both, turn22).when(left, as_other | flipped_other).when(right, flipped_other)),
        "_turn_a": known(right & as_other),
        "_flip": known(strand & (left | right)),
        "_amb1": known((as_is & ~alike) | F.when(left | right, (as_other & ~unlike) | strand).otherwise(False)),
        "remove": known(F.when(both, ~known(fits22)).when(left | right, F.col("_pal")).otherwise(d1 != c1)) | F.col("_bad"),
        "_again": known(both & opposite) if action == 2 else F.lit(False),
    })
    near = lambda f: (f > lo) & (f < hi)
    turn, turn_a, flip = F.col("_turn"), F.col("_turn_a"), F.col("_flip")
    again = F.col("_again") & ~F.col("remove")
    sign = F.when(turn != again, -1.0).otherwise(1.0)
    eaf = F.when(turn != again, 1 - F.col("eaf_outcome")).otherwise(F.col("eaf_outcome"))
    ambiguous = F.when(both, F.col("_pal") & (near(fa) | near(fb))).otherwise(F.col("_amb1") | F.col("_pal"))
    # the alleles that are left: the outcome's stand in the exposure's order
    fit = ~F.col("remove") | F.col("_pal")
    e1 = F.when(turn_a, c1).when(right & flip, _comp(d1)).otherwise(d1)
    e2 = F.when(right, F.when(turn_a, d1).when(as_is, c2).when(flip & (_comp(d1) == c1), c2).when(flip, F.lit(None)).otherwise(d2)).otherwise(d2)
    o1 = F.when(both & fit, d1).when(left & turn, d1).when(left & flip, _comp(c1)).when(right & turn, _comp(d1)).otherwise(c1)
    o2 = F.when(both & fit, d2).when(left & (as_is | as_other | turn), d2).when(left & flip & (_comp(c1) == d1), d2).when(right & turn, c1).otherwise(c2)
    out = d.withColumns({
        "_e1": e1, "_e2": e2, "_o1": o1, "_o2": o2, "_bx": F.when(turn_a, -F.col("beta_exposure")).otherwise(F.col("beta_exposure")),
        "_fx": F.when(turn_a, 1 - F.col("eaf_exposure")).otherwise(F.col("eaf_exposure")), "_by": F.col("beta_outcome") * sign, "_fy": eaf, "ambiguous": known(ambiguous), "palindromic": known(F.col("_pal")),
    })
    final = dict(zip(names, ("_e1", "_e2", "_o1", "_o2"), strict=True)) | {"beta_exposure": "_bx", "eaf_exposure": "_fx", "beta_outcome": "_by", "eaf_outcome": "_fy"}
    finite = F.lit(True)
    for c in ("beta_exposure", "beta_outcome", "se_exposure", "se_outcome"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    drop = {1: F.lit(False), 2: F.col("ambiguous"), 3: F.col("ambiguous") | F.col("palindromic")}[action]
    out = out.withColumn("mr_keep", known(finite) & ~F.col("remove") & ~drop)
    extra = [c for c in ("palindromic", "ambiguous", "remove", "mr_keep") if c not in df.columns]
    return out.select(*[F.col(final.get(c, c)).alias(c) for c in df.columns], *extra)


#: How the error of the regression through the origin is scaled: by sigma as least squares has it, not at all, or by sigma where that is above 1.
IVW_ERRORS = {"mr_ivw": "at least 1", "mr_uwr": "at least 1", "mr_ivw_mre": "sigma", "mr_ivw_fe": "none"}


def ivw(df: DataFrame, method: str = "mr_ivw") -> DataFrame:
    """Inverse-variance weighted (mr_uwr: unweighted) regression through the origin, with Q; at least two SNPs.

    mr_ivw and mr_uwr divide the error by min(1, sigma), mr_ivw_fe by sigma, mr_ivw_mre by nothing."""
    w = F.lit(1.0) if method == "mr_uwr" else 1 / (F.col("se_outcome") * F.col("se_outcome"))
    x, y = F.col("beta_exposure"), F.col("beta_outcome")
    s = df.groupBy(*KEYS).agg(
        F.count("*").alias("nsnp"), F.sum(w * x * x).alias("xx"), F.sum(w * x * y).alias("xy"), F.sum(w * y * y).alias("yy")
    ).filter("nsnp >= 2")
    b = F.try_divide("xy", "xx")
    sigma2 = (F.col("yy") - b * F.col("xy")) / (F.col("nsnp") - 1)
    sigma = F.when(sigma2 > 0, F.sqrt(sigma2))
    scale = {"at least 1": F.greatest(F.lit(1.0), sigma), "sigma": sigma, "none": F.when(sigma2 > 0, 1.0)}[IVW_ERRORS[method]]
    return s.select(*KEYS, F.lit(method).alias("method"), "nsnp", b.alias("b"), (F.sqrt(F.try_divide(F.lit(1.0), F.col("xx"))) * scale).alias("se"), (sigma2 * (F.col("nsnp") - 1)).alias("q"))


def egger(df: DataFrame) -> DataFrame:
    """Regression with intercept after orienting exposures to be positive; at least three SNPs."""
    flip = F.when(F.col("beta_exposure") < 0, -1.0).otherwise(1.0)
    d = df.select(*KEYS, (F.col("beta_exposure") * flip).alias("x"), (F.col("beta_outcome") * flip).alias("y"), (1 / (F.col("se_outcome") * F.col("se_outcome"))).alias("w"))
    s = d.groupBy(*KEYS).agg(
        F.count("*").alias("nsnp"), F.sum("w").alias("sw"), F.sum(F.expr("w*x")).alias("sx"), F.sum(F.expr("w*y")).alias("sy"),
        F.sum(F.expr("w*x*x")).alias("sxx"), F.sum(F.expr("w*x*y")).alias("sxy"), F.sum(F.expr("w*y*y")).alias("syy"),
    ).filter("nsnp >= 3")
    s = s.withColumn("det", F.expr("sw*sxx - sx*sx")).withColumn("b", F.expr("try_divide(sw*sxy - sx*sy, det)")).withColumn("a", F.expr("try_divide(sxx*sy - sx*sxy, det)"))
    s = s.withColumn("q", F.expr("syy - a*sy - b*sxy")).withColumn("sigma2", F.expr("q/(nsnp-2)"))
    s = s.withColumn("scale", F.expr("greatest(1D, sqrt(sigma2))"))
    return s.select(
        *KEYS, F.lit("mr_egger_regression").alias("method"), "nsnp", "b", F.expr("sqrt(try_divide(sw, det))*scale").alias("se"),
        F.col("a").alias("intercept"), F.expr("sqrt(try_divide(sxx, det))*scale").alias("intercept_se"), "q",
    )


def wald(df: DataFrame) -> DataFrame:
    one = df.withColumn("_n", F.count("*").over(Window.partitionBy(*KEYS))).filter("_n = 1")
    return one.select(
        *KEYS, F.lit("mr_wald_ratio").alias("method"), F.lit(1).cast("long").alias("nsnp"), F.try_divide("beta_outcome", "beta_exposure").alias("b"),
        F.try_divide(F.col("se_outcome"), F.abs("beta_exposure")).alias("se"),
    )


def weighted_median(df: DataFrame) -> DataFrame:
    """Point estimate: ratios interpolated at 0.5 of the centred cumulative weight."""
    r = df.select(*KEYS, F.expr("beta_outcome/beta_exposure").alias("r"), F.expr("beta_exposure*beta_exposure/(se_outcome*se_outcome)").alias("w"))
    by = Window.partitionBy(*KEYS)
    r = r.withColumn("c", (F.sum("w").over(by.orderBy("r", "w").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w") / 2) / F.sum("w").over(by))
    o = by.orderBy("r", "w")
    r = r.withColumns({"r2": F.lead("r").over(o), "c2": F.lead("c").over(o), "nsnp": F.count("*").over(by)})
    at = r.filter("nsnp >= 3 and c < 0.5 and c2 >= 0.5")
    return at.select(*KEYS, F.lit("mr_weighted_median").alias("method"), "nsnp", F.expr("r + (r2 - r)*(0.5 - c)/(c2 - c)").alias("b"))


METHODS = ["mr_wald_ratio", "mr_egger_regression", "mr_ivw"]


def estimates(kept: DataFrame, methods: list[str]) -> DataFrame:
    """Rows (id_exposure, id_outcome, method, nsnp, b, se, pval) of the methods asked for."""
    names = methods or METHODS
    if unknown := set(names) - set(METHODS) - set(IVW_ERRORS):
        raise NotImplementedError(", ".join(sorted(unknown)))
    base = [*KEYS, "method", "nsnp", "b", "se"]
    parts = []
    for m in names:
        if m == "mr_egger_regression":
            e = egger(kept)
            parts.append(e.select(*base, p_student(F.try_divide("b", "se"), (F.col("nsnp") - 2).cast("double")).alias("pval")))
        else:
            e = wald(kept) if m == "mr_wald_ratio" else ivw(kept, m)
            parts.append(e.select(*base, p_normal(F.try_divide("b", "se")).alias("pval")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def meta_ivw(df: DataFrame, random_effects: bool = False) -> DataFrame:
    """Meta-analysis by group: weighted least squares through the origin, Cochran's Q with its p-value, I squared
    (per cent) and the DerSimonian-Laird between-study variance; random effects refit with it where it is above 0."""
    w = 1 / (F.col("se_outcome") * F.col("se_outcome"))
    x, y = F.col("beta_exposure"), F.col("beta_outcome")

    def sums(w: Column, *more: Column) -> list[Column]:
        return [F.sum(w * x * x).alias("xx"), F.sum(w * x * y).alias("xy"), F.sum(w * y * y).alias("yy"), *more]

    fixed = df.groupBy(*KEYS).agg(F.count("*").alias("nsnp"), *sums(w, F.sum(w).alias("sw"), F.sum(w * w).alias("sww"))).filter("nsnp >= 2")
    fixed = fixed.withColumn("b", F.try_divide("xy", "xx")).withColumn("q", F.col("yy") - F.col("b") * F.col("xy")).withColumn("df", (F.col("nsnp") - 1).cast("double"))
    fixed = fixed.withColumn("rss", F.col("q")).transform(_spread)
    if random_effects:
        again = df.join(fixed.select(*KEYS, "tau2"), KEYS)
        w2 = 1 / (F.col("se_outcome") * F.col("se_outcome") + F.col("tau2"))
        again = again.groupBy(*KEYS).agg(*sums(w2))
        fixed = fixed.drop("xx", "xy", "yy").join(again, KEYS).withColumn("b", F.try_divide("xy", "xx")).withColumn("rss", F.col("yy") - F.col("b") * F.col("xy"))
    se = F.sqrt(F.try_divide(F.col("rss") / F.col("df"), F.col("xx")))
    return fixed.withColumn("se", se).select(*KEYS, "nsnp", "b", "se", p_student(F.try_divide("b", "se"), F.col("df")).alias("pval"), "q", p_chisq("q", "df").alias("q_pval"), "i2", "tau2")


def _spread(d: DataFrame) -> DataFrame:
    """i2 and tau2 from q, df, sw and sww."""
    c = F.col("sw") - F.col("sww") / F.col("sw")
    over = F.col("q") > F.col("df")
    return d.withColumns({
        "i2": F.when(over, (F.col("q") - F.col("df")) / F.col("q") * 100).otherwise(0.0),
        "tau2": F.when(over & (c > 0), (F.col("q") - F.col("df")) / c).otherwise(0.0),
    })


def meta_egger(df: DataFrame) -> DataFrame:
    """Weighted least squares with an intercept, exposures as they are (not oriented), with Q, I squared and tau squared; at least three SNPs."""
    w = 1 / (F.col("se_outcome") * F.col("se_outcome"))
    d = df.select(*KEYS, F.col("beta_exposure").alias("x"), F.col("beta_outcome").alias("y"), w.alias("w"))
    terms = {"sw": "w", "sww": "w*w", "sx": "w*x", "sy": "w*y", "sxx": "w*x*x", "sxy": "w*x*y", "syy": "w*y*y"}
    s = d.groupBy(*KEYS).agg(F.count("*").alias("nsnp"), *[F.sum(F.expr(e)).alias(k) for k, e in terms.items()]).filter("nsnp >= 3")
    s = s.withColumn("det", F.expr("sw*sxx - sx*sx")).withColumn("b", F.expr("try_divide(sw*sxy - sx*sy, det)")).withColumn("a", F.expr("try_divide(sxx*sy - sx*sxy, det)"))
    s = s.withColumn("q", F.expr("syy - a*sy - b*sxy")).withColumn("df", F.expr("CAST(nsnp - 2 AS DOUBLE)")).transform(_spread)
    s = s.withColumns({"se": F.expr("sqrt(try_divide(sw, det) * q / df)"), "intercept_se": F.expr("sqrt(try_divide(sxx, det) * q / df)")})
    return s.select(
        *KEYS, "nsnp", "b", "se", p_student(F.try_divide("b", "se"), "df").alias("pval"), F.col("a").alias("intercept"), "intercept_se",
        p_student(F.try_divide("a", "intercept_se"), "df").alias("intercept_pval"), "q", p_chisq("q", "df").alias("q_pval"), "i2", "tau2",
    )
