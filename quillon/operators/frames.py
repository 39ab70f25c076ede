"""Window frames that count peer groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, by: list[str], order: str | Column, before: int | None, after: int | None, **columns: Column) -> DataFrame:
    """GROUPS frames: aggregates over the rows whose value is among ``before`` to ``after`` distinct values from the own one (null: without end).

    Peers share a dense rank, so the frame is a range of ranks; both windows need the same shuffle and one sort each."""
    rank = F.dense_rank().over(Window.partitionBy(*by).orderBy(order))
    lo = Window.unboundedPreceding if before is None else before
    hi = Window.unboundedFollowing if after is None else after
    w = Window.partitionBy(*by).orderBy("_rank").rangeBetween(lo, hi)
    return df.withColumn("_rank", rank).withColumns({name: c.over(w) for name, c in columns.items()}).drop("_rank")
