"""Summary statistics brought to one form: SNP, A1, A2, Z, N.

Column names are cleaned and mapped on the driver; every filter is a column
expression (p to Z among them), and the sample-size cut is one percentile.
"""

from __future__ import annotations

import re
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store
from .columns import z_of_p
from .stats import quantiles

# Usual names of the columns, and the value of a signed statistic without effect.
NAMES = {
    "SNP": ["SNP", "MARKERNAME", "SNPID", "RS", "RSID", "RS_NUMBER", "RS_NUMBERS", "ID"],
    "NSTUDY": ["NSTUDY", "N_STUDY", "NSTUDIES", "N_STUDIES"],
    "P": ["P", "PVALUE", "P_VALUE", "PVAL", "P_VAL", "GC_PVALUE"],
    "A1": ["A1", "ALLELE1", "ALLELE_1", "EFFECT_ALLELE", "REFERENCE_ALLELE", "INC_ALLELE", "EA"],
    "A2": ["A2", "ALLELE2", "ALLELE_2", "OTHER_ALLELE", "NON_EFFECT_ALLELE", "DEC_ALLELE", "NEA"],
    "N": ["N", "WEIGHT"],
    "N_CAS": ["NCASE", "CASES_N", "N_CASE", "N_CASES", "N_CAS"],
    "N_CON": ["N_CONTROLS", "N_CON", "NCONTROL", "CONTROLS_N", "N_CONTROL"],
    "Z": ["ZSCORE", "Z_SCORE", "GC_ZSCORE", "Z"],
    "OR": ["OR"],
    "BETA": ["B", "BETA", "EFFECTS", "EFFECT"],
    "LOG_ODDS": ["LOG_ODDS"],
    "SIGNED_SUMSTAT": ["SIGNED_SUMSTAT"],
    "INFO": ["INFO"],
    "FRQ": ["EAF", "FRQ", "MAF", "FRQ_U", "F_U"],
}
NULLS = {"OR": 1.0, "BETA": 0.0, "Z": 0.0, "LOG_ODDS": 0.0, "SIGNED_SUMSTAT": 0.0}
PAIRS = {"A": "T", "T": "A", "C": "G", "G": "C"}

_NORMAL = NormalDist()


class MungeError(ValueError):
    pass


def clean(name: str) -> str:
    return name.strip().upper().replace("-", "_").replace(".", "_")


def column_map(columns: list[str], flags: dict[str, str] | None = None, ignore: list[str] | None = None) -> dict[str, str]:
    """Given name to meaning: ignored columns go, then the caller's names count, then the usual ones."""
    out: dict[str, str] = {}
    ignored = {clean(c) for c in ignore or []}
    own = {clean(given): meaning for meaning, given in (flags or {}).items()}
    usual = {given: meaning for meaning, names in NAMES.items() for given in names}
    for c in columns:
        k = clean(c)
        if k in ignored:
            continue
        meaning = own.get(k) or (usual.get(k) if usual.get(k) not in own.values() else None)
        if meaning is None:
            continue
        if meaning in out.values():
            raise MungeError(f"two columns mean {meaning}")
        out[c] = meaning
    return out


def daner_sizes(columns: list[str]) -> tuple[int, int] | None:
    """Cases and controls of a header whose frequency columns end in them."""
    at = {m[1]: int(m[2]) for c in columns if (m := re.fullmatch(r"FRQ_([AU])_(\d+)", c.strip()))}
    return (at["A"], at["U"]) if len(at) == 2 else None


def valid_alleles(a1: Column, a2: Column) -> Column:
    """Single bases that are neither equal nor each other's complement."""
    bases = list(PAIRS)
    return F.coalesce(a1.isin(*bases) & a2.isin(*bases) & (a1 != a2) & (a1 != F.translate(a2, "ACGT", "TGCA")), F.lit(False))


def same_variant(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Equal pairs of alleles, allowing for the other strand and the other order."""
    c1, c2 = F.translate(b1, "ACGT", "TGCA"), F.translate(b2, "ACGT", "TGCA")
    return ((a1 == b1) & (a2 == b2)) | ((a1 == b2) & (a2 == b1)) | ((a1 == c1) & (a2 == c2)) | ((a1 == c2) & (a2 == c1))


def turned(a1: Column, b1: Column, b2: Column) -> Column:
    """Of one variant: the second pair names the first's effect allele last."""
    return (a1 == b2) | (a1 == F.translate(b2, "ACGT", "TGCA"))


def align(df: DataFrame, z: str = "Z2", first: tuple[str, str] = ("A1", "A2"), second: tuple[str, str] = ("A1x", "A2x")) -> DataFrame:
    """Rows of one variant with valid alleles; ``z`` changes its sign where the second pair is turned."""
    a1, a2, b1, b2 = (F.upper(c) for c in (*first, *second))
    ok = valid_alleles(a1, a2) & valid_alleles(b1, b2) & same_variant(a1, a2, b1, b2)
    return df.filter(F.coalesce(ok, F.lit(False))).withColumn(z, F.when(turned(a1, b1, b2), -F.col(z)).otherwise(F.col(z)))


def z_size(p: float) -> float:
    """|Z| with the two-sided p-value p."""
    if not 0 < p <= 1:
        return float("nan")
    return abs(_NORMAL.inv_cdf(p / 2)) if p < 1 else 0.0


def check_median(df: DataFrame, column: str, expected: float, tolerance: float = 0.1) -> float:
    """The column's median, which must lie within the tolerance of its value without effect."""
    r = quantiles(df, column, [0.5]).first()
    m = r and r["q0"]
    if m is None or abs(m - expected) > tolerance:
        raise MungeError(f"the median of {column} is {m}, expected {expected}: the columns may be mislabelled")
    return m


def munge(
    df: DataFrame, order: list[str] | None = None, n: float | None = None, flags: dict[str, str] | None = None, ignore: list[str] | None = None,
    info_min: float = 0.9, maf_min: float = 0.01, n_min: float | None = None, merge_alleles: DataFrame | None = None, a1_inc: bool = False, daner_n: bool = False, nstudy_min: float | None = None,
) -> DataFrame:
    """SNP, A1, A2, Z, N of the rows that pass.

    order: columns that give the file order (a SNP's first row stays); without it rows keep
    their place by monotonically increasing id.  A header with sizes in its frequency columns
    gives N; with daner_n the sizes stand in columns Nca and Nco.  Without n_min, N must reach its 90 % quantile
over 1.5.  Rows of fewer studies than nstudy_min go where that is given."""
    sizes = None if daner_n else daner_sizes(df.columns)
    drop = list(ignore or [])
    if sizes:
        flags = {"FRQ": f"FRQ_U_{sizes[1]}"} | (flags or {})
        n = n or float(sum(sizes))
    if daner_n:
        by_size = {clean(c): c for c in df.columns}
        if "NCA" not in by_size or "NCO" not in by_size:
            raise MungeError("no columns Nca and Nco")
        flags = {"N_CAS": by_size["NCA"], "N_CON": by_size["NCO"]} | {"FRQ": c for c in df.columns if c.strip().startswith("FRQ_U_")} | (flags or {})
    names = column_map(df.columns, flags, drop)
    at = {meaning: given for given, meaning in names.items()}
    if missing := {"SNP", "P"} - set(at):
        raise MungeError(f"no column for {', '.join(sorted(missing))}")
    signed = next((c for c in ("SIGNED_SUMSTAT", "Z", "BETA", "LOG_ODDS", "OR") if c in at), None)
    if signed is None and not a1_inc:
        raise MungeError("no signed statistic")
    number = lambda c: df[f"`{at[c]}`"].cast("string").try_cast("double").alias(c)
    cols = [df[f"`{at['SNP']}`"].cast("string").alias("SNP")]
    cols += [F.upper(df[f"`{at[c]}`"].cast("string")).alias(c) for c in ("A1", "A2") if c in at]
    cols += [number(c) for c in ("P", "INFO", "FRQ", "N", "N_CAS", "N_CON", "NSTUDY", signed) if c in at]
    place = F.struct(*[df[f"`{c}`"] for c in order]) if order else F.monotonically_increasing_id()
    d = df.select(*cols, place.alias("_at"))
    needed = [c for c in d.columns if c not in ("INFO", "_at")]
    d = d.filter(F.col("SNP") != ".").dropna(subset=needed).filter("P > 0 and P <= 1")
    if "NSTUDY" in d.columns and nstudy_min is not None:
        d = d.filter(F.col("NSTUDY") >= nstudy_min)
    if "INFO" in d.columns:
        d = d.filter(F.col("INFO").isNull() | F.col("INFO").between(max(0.0, info_min), 2.0))
    if "FRQ" in d.columns:
        d = d.filter(F.col("FRQ").between(0, 1) & (F.least("FRQ", 1 - F.col("FRQ")) > maf_min))
    if "A1" in d.columns and "A2" in d.columns:
        d = d.filter(valid_alleles(F.col("A1"), F.col("A2")))
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy("SNP").orderBy("_at"))).filter("_k = 1")
    if "N_CAS" in d.columns and "N_CON" in d.columns:
        d = d.withColumn("N", F.col("N_CAS") + F.col("N_CON"))
    if "N" in d.columns:
        least = n_min
        if n_min is None:
            d = store.stored(d.drop("_at", "_k"), "munged")  # read for the quantile and for the result
            top = quantiles(d, "N", [0.9]).first()
            least = top["q0"] / 1.5 if top else 0.0
        d = d.filter(F.col("N") >= F.lit(least))
    elif n:
        d = d.withColumn("N", F.lit(float(n)))
    else:
        raise MungeError("no sample size")
    z = z_of_p("P")
    if signed and not a1_inc:
        z = F.when(F.col(signed) < NULLS[signed], -z).otherwise(z)
    d = d.withColumn("Z", z)
    if merge_alleles is not None:
        m = merge_alleles.select("SNP", F.upper("A1").alias("_m1"), F.upper("A2").alias("_m2"))
        d = d.join(m, "SNP").filter(same_variant(F.col("A1"), F.col("A2"), F.col("_m1"), F.col("_m2")))
    return d.select("SNP", *[c for c in ("A1", "A2") if c in d.columns], "Z", "N")
