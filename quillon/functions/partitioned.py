"""Heritability by annotation: LD score regression on several LD scores at once.

The frame holds a row per SNP: y (chi-square), n, wld (weight LD score) and one
column per annotation.  With several annotations the first weights stay, so two
aggregations do: one for the weights, one for the products by jackknife block.
Tasks add up their own products; the driver gets one matrix per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ldsc

#: Largest condition number of the LD scores that is regressed on.
MOST_CONDITION = 1e5


def gram(rows: DataFrame, names: list[str], block: Column, weight: Column, blocks: int) -> np.ndarray:
    """Weighted sums of the products of every two columns, per block: blocks x columns x columns."""
    k = len(names)
    d = rows.select(block.cast("int").alias("block"), weight.cast("double").alias("w"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((blocks, k, k))
        for batch in batches:
            at, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(k)], axis=1)
            for b in np.unique(at):
                part = x[at == b]
                total[b] += (part * w[at == b, None]).T @ part
        for b in np.flatnonzero(total.any(axis=(1, 2))):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k * k, b, np.int32)), pa.array(np.arange(k * k, dtype=np.int32)), pa.array(total[b].ravel())], names=["block", "pos", "value"]
            )

    got = d.mapInArrow(run, "block int, pos int, value double").groupBy("block", "pos").agg(F.sum("value").alias("value"))
    out = np.zeros((blocks, k * k))
    for r in got.collect():  # blocks x columns x columns numbers, whatever the number of rows
        out[r["block"], r["pos"]] = r["value"]
    return out.reshape(blocks, k, k)


@dataclass
class Partitioned:
    names: list[str]
    m: np.ndarray
    n_bar: float
    jack: ldsc.Jackknife
    intercept: float
    intercept_se: float | None

    @property
    def k(self) -> int:
        return len(self.names)

    @property
    def coef(self) -> np.ndarray:
        return self.jack.est[: self.k] / self.n_bar

    @property
    def coef_cov(self) -> np.ndarray:
        return self.jack.cov[: self.k, : self.k] / self.n_bar**2

    @property
    def cat(self) -> np.ndarray:
        return self.m * self.coef

    @property
    def cat_cov(self) -> np.ndarray:
        return np.outer(self.m, self.m) * self.coef_cov

    @property
    def tot(self) -> float:
        return float(self.cat.sum())

    @property
    def tot_se(self) -> float:
        return float(np.sqrt(max(self.cat_cov.sum(), 0.0)))

    @property
    def cat_delete(self) -> np.ndarray:
        return self.m * self.jack.delete[:, : self.k] / self.n_bar

    @property
    def tot_delete(self) -> np.ndarray:
        return self.cat_delete.sum(axis=1)

    @property
    def prop(self) -> ldsc.Jackknife:
        """Shares of the heritability."""
        return ldsc.Jackknife(self.cat / self.tot, self.cat_delete / self.tot_delete[:, None])

    @property
    def m_prop(self) -> np.ndarray:
        return self.m / self.m.sum()

    @property
    def enrichment(self) -> np.ndarray:
        """Heritability per SNP of the annotation over that of all SNPs."""
        return self.cat / self.m / (self.tot / self.m.sum())


def partitioned(rows: DataFrame, names: list[str], m: list[float], order: list[str], blocks: int = ldsc.BLOCKS, intercept: float | None = None, most: float | None = None, any_condition: bool = False) -> Partitioned:
    """Fit rows (y, n, wld, ``names``), which ``order`` puts in genome order.

    Annotations without variance are left out; SNPs whose chi-square is ``most`` or more (by default the larger of 80
    and a thousandth of the largest n) too.  Nearly dependent annotations are an error unless any_condition."""
    spread = rows.agg(F.count("*").alias("rows"), F.max("n").alias("n"), *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(names)]).first()
    if not spread["rows"]:
        raise ldsc.RegressionError("no SNP is left")
    used = [i for i in range(len(names)) if spread[f"v{i}"]]
    if not used:
        raise ldsc.RegressionError("no annotation varies")
    names, size = [names[i] for i in used], np.array([float(m[i]) for i in used])
    if not any_condition and len(names) > 1:
        condition = np.sqrt(np.linalg.cond(gram(rows, names, F.lit(0), F.lit(1.0), 1)[0]))
        if condition > MOST_CONDITION:
            raise ldsc.RegressionError(f"the LD scores have condition number {condition:.0f}")
    cap = max(0.001 * spread["n"], 80.0) if most is None else most
    total = reduce(Column.__add__, [F.col(c) for c in names])
    d = ldsc.place(rows.filter(F.col("y") < cap).select("y", "n", "wld", total.alias("ld"), *names, *[c for c in order if c not in {"y", "n", "wld", *names}]), order)
    s = d.agg(F.count("*").alias("rows"), F.avg("y").alias("y"), F.avg(F.col("ld") * F.col("n")).alias("xn"), F.avg("n").alias("n_bar")).first()
    if not s["rows"] or not s["xn"]:
        raise ldsc.RegressionError("no SNP is left" if not s["rows"] else "LD scores or sample sizes are zero")
    fixed = 1.0 if intercept is None else intercept
    seed = float(size.sum()) * (s["y"] - fixed) / s["xn"]
    weight = ldsc.h2_weights(float(size.sum()))(seed, fixed)
    blocks = min(blocks, s["rows"])
    x = [(F.col("n") * F.col(c) / F.lit(s["n_bar"])).alias(f"x{i}") for i, c in enumerate(names)]
    free = [F.lit(1.0).alias("one")] if intercept is None else []
    y = F.col("y") if intercept is None else F.col("y") - F.lit(float(intercept))
    d = d.select(ldsc.block_of(F.col("i"), s["rows"], blocks).alias("block"), weight.alias("w"), *x, *free, y.alias("y"))
    g = gram(d, d.columns[2:], F.col("block"), F.col("w"), blocks)
    jack = ldsc.block_jackknife(g[:, :-1, :-1], g[:, :-1, -1])
    if intercept is None:
        return Partitioned(names, size, s["n_bar"], jack, float(jack.est[-1]), float(jack.se[-1]))
    return Partitioned(names, size, s["n_bar"], jack, float(intercept), None)


SCHEMA = "annotation string, m double, coef double, coef_se double, cat double, cat_se double, prop double, prop_se double, m_prop double, enrichment double"


def partitioned_frame(rows: DataFrame, names: list[str], m: list[float], order: list[str], **options) -> DataFrame:
    """One row per annotation."""
    p = partitioned(rows, names, m, order, **options)
    coef_se, cat_se = np.sqrt(np.maximum(np.diag(p.coef_cov), 0)), np.sqrt(np.maximum(np.diag(p.cat_cov), 0))
    cols = [p.m, p.coef, coef_se, p.cat, cat_se, p.prop.est, p.prop.se, p.m_prop, p.enrichment]
    return rows.sparkSession.createDataFrame([(name, *[float(c[i]) for c in cols]) for i, name in enumerate(p.names)], SCHEMA)
