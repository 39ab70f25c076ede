"""Range operators: binned joins and interval merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import carried


#: An interval covers at most about so many bins of its level; a level's bins are so many times as wide as those of the one below.
STEP = 8
#: Rows of one key above which a running value is carried over parts of the key instead of being kept by one task.
HOT = 2_000_000


def _levels(df: DataFrame, width: int, start: str, end: str) -> tuple[Column, list[int]]:
    """The level of an interval by its length, and the levels that occur (some twenty at the most)."""
    length = F.greatest((F.col(end) - F.col(start)).cast("double"), F.lit(1.0)) / (STEP * width)
    level = F.greatest(F.ceil(F.log(float(STEP), length)), F.lit(0)).cast("int")
    return level, sorted(x for x in df.agg(F.collect_set(level)).first()[0])


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of closed intervals that overlap within equal keys; b's columns get the suffix _b.

    Every interval goes to the bins it covers, of a width that its length chooses, and of two intervals the shorter one also
    to the wide bins of the longer one's level: a long interval is some rows, not one for each narrow bin.  A pair is emitted in
    the bin of the larger start only, so no pair appears twice and no distinct is needed.  Intervals with an unknown end meet nothing."""
    a, b = (df.filter(F.col(start).isNotNull() & F.col(end).isNotNull()) for df in (a, b))
    (level, of_a), (_, of_b) = _levels(a, width, start, end), _levels(b, width, start, end)
    size = lambda k: width * F.pow(F.lit(float(STEP)), k).cast("long")

    def cut(df: DataFrame, others: list[int], side: int) -> DataFrame:
        """_level and _tag: 0 both at their own level, 1 a's own, 2 b's own."""
        own = lambda tag: F.struct(F.col("_own").alias("level"), F.lit(tag).alias("tag"))
        up = F.transform(F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > F.col("_own")), lambda x: F.struct(x.alias("level"), F.lit(3 - side).alias("tag")))
        mine = F.array(own(0)) if len({*of_a, *of_b}) == 1 else F.array(own(0), own(side))
        df = df.withColumn("_own", level).withColumn("_at", F.explode(F.concat(mine, up))).withColumns({"_level": F.col("_at.level"), "_tag": F.col("_at.tag")})
        return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / size(F.col("_level"))), F.floor(F.col(end) / size(F.col("_level")))))).drop("_own", "_at")

    at = ["_level", "_tag", "_bin"]
    right = cut(b, of_a, 2).select(*keys, *at, *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys])
    pairs = cut(a, of_b, 1).join(right, [*keys, *at])
    meets = (F.col(start) <= F.col(f"{end}_b")) & (F.col(f"{start}_b") <= F.col(end))
    owner = F.floor(F.greatest(F.col(start), F.col(f"{start}_b")) / size(F.col("_level"))) == F.col("_bin")
    return pairs.filter(meets & owner).drop(*at)


def near_join(a: DataFrame, keys: list[str], at: str, id_col: str, distance: int) -> DataFrame:
    """Pairs of rows of equal keys with 0 <= at_b - at <= distance and (at, id) < (at_b, id_b)."""
    left = a.withColumn("_bin", F.explode(F.array(F.floor(F.col(at) / distance), F.floor(F.col(at) / distance) + 1)))
    right = a.select(*keys, F.floor(F.col(at) / distance).alias("_bin"), *[F.col(c).alias(f"{c}_b") for c in a.columns if c not in keys])
    d = F.col(f"{at}_b") - F.col(at)
    ordered = (d > 0) | ((d == 0) & (F.col(id_col) < F.col(f"{id_col}_b")))
    return left.join(right, [*keys, "_bin"]).filter((d >= 0) & (d <= distance) & ordered).drop("_bin")


def _hot(df: DataFrame, keys: list[str], most: int) -> bool:
    """Whether a key has more than ``most`` rows."""
    return not df.groupBy(*keys).count().filter(F.col("count") > most).isEmpty()


def merge_intervals(df: DataFrame, keys: list[str], gap: int = 1, start: str = "start", end: str = "end", hot: int = HOT) -> DataFrame:
    """Merged closed intervals: rows whose start is at most ``gap`` behind the furthest end so far join.

    Where a key has more than ``hot`` rows, the furthest end and the first start of a merged interval are carried from part to part
    of a global order, so that no key is one task's work."""
    opens = lambda before: F.when(F.col(start) <= before + gap, F.lit(None)).otherwise(F.col(start))
    if _hot(df, keys, hot):
        rows = carried(df, keys, [start, end], "_before", end, "max")
        rows = carried(rows.withColumn("_new", opens(F.col("_before"))).drop("_before"), keys, [start, end], "_island", "_new", "last")
    else:
        w = Window.partitionBy(*keys).orderBy(start, end)
        before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
        rows = df.withColumn("_new", opens(before)).withColumn("_island", F.last("_new", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def as_of_join(a: DataFrame, b: DataFrame, keys: list[str], at: str, value: str, hot: int = HOT) -> DataFrame:
    """Every row of a with the latest value of b at or before its time: one union and one window.

    Where a key has more than ``hot`` rows, the latest value is carried from part to part of a global order."""
    both = a.withColumn("_v", F.lit(None)).withColumn("_side", F.lit(1)).unionByName(
        b.select(*keys, at, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    if _hot(both, keys, hot):
        rows = carried(both, keys, [at, "_side"], value, "_v", "last")
    else:
        w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
        rows = both.withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return rows.filter("_side = 1").drop("_v", "_side")
