"""The built-in node kinds."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ldsc, mr, mr_robust, partitioned, stats
from ..sources import formats, sinks, store
from ..sources.lake import Lake, free_of_reserved
from .dag import Node, Ports
from .dialect import to_spark
from .registry import Registry

_VIEWS = threading.Lock()


class Source(Node):
    kind = "source"

    def __init__(self, spark: SparkSession, path: str | None = None, format: str | None = None, type: str = "file", ident: str | None = None):
        self.spark, self.path, self.format, self.type, self.ident = spark, path, format, type, ident

    def execute(self, inputs: dict[int, DataFrame]) -> dict[int, DataFrame]:
        if self.type in ("table", "iceberg"):
            return {0: self.spark.table(self.ident)}
        return {0: formats.read(self.spark, self.path, self.format)}


class Sql(Node):
    """SQL over the inputs as views port_0, port_1, ...; names may stand in double quotes, functions may have another dialect's names (``dialect``)."""

    kind = "sql"

    def __init__(self, spark: SparkSession, sql_query: str):
        self.spark, self.query = spark, sql_query

    def ports(self) -> Ports:
        return Ports(inputs=None)

    def execute(self, inputs: dict[int, DataFrame]) -> dict[int, DataFrame]:
        if not inputs:
            raise ValueError("sql needs an input")
        key = "spark.sql.ansi.doubleQuotedIdentifiers"
        with _VIEWS:  # analysis is eager, so the views and the setting are free again afterwards
            before = self.spark.conf.get(key, "false")
            for p, df in inputs.items():
                df.createOrReplaceTempView(f"port_{p}")
            try:
                self.spark.conf.set(key, "true")
                return {0: self.spark.sql(to_spark(self.query))}
            finally:
                self.spark.conf.set(key, before)


class Echo(Node):
    kind = "echo"

    def __init__(self, spark: SparkSession):
        pass

    def ports(self) -> Ports:
        return Ports(inputs=None)

    def execute(self, inputs: dict[int, DataFrame]) -> dict[int, DataFrame]:
        return dict(inputs)


class SinkFile(Node):
    kind = "sink_file"

    def __init__(self, spark: SparkSession, path: str, format: str = "parquet", mode: str = "overwrite"):
        self.spark, self.path, self.format, self.mode, self.written = spark, path, format, mode, None

    def ports(self) -> Ports:
        return Ports(inputs={0: None}, outputs={})

    def execute(self, inputs: dict[int, DataFrame]) -> dict[int, DataFrame]:
        sinks.write_file(inputs[0], self.path, self.format, self.mode)
        self.written = self.path
        return {}


class SinkTable(SinkFile):
    kind = "sink_table"

    def __init__(self, spark: SparkSession, ident: str, mode: str = "overwrite", rename_reserved: bool = False):
        super().__init__(spark, ident, "table", mode)
        self.rename = rename_reserved

    def execute(self, inputs: dict[int, DataFrame]) -> dict[int, DataFrame]:
        *space, name = self.path.split(".")
        Lake(self.spark, ".".join(space) or "default").write(free_of_reserved(inputs[0]) if self.rename else inputs[0], name, self.mode)
        self.written = self.path
        return {}


class PartitionedHeritability(Node):
    """Heritability by annotation: rows (CHR, BP, SNP, z, n, wld, annotations) on port 0."""

    kind = "ldsc_partitioned"

    def __init__(self, spark: SparkSession, annotations: list[str], m: list[float], intercept: float | None = None, n_blocks: int = ldsc.BLOCKS):
        self.names, self.m, self.intercept, self.blocks = annotations, m, intercept, n_blocks

    def ports(self) -> Ports:
        return Ports(inputs={0: None})

    def execute(self, inputs: dict[int, DataFrame]) -> dict[int, DataFrame]:
        rows = store.stored(inputs[0].withColumn("y", F.col("z") * F.col("z")), "partitioned")
        return {0: partitioned.partitioned_frame(rows, self.names, self.m, ["CHR", "BP", "SNP"], blocks=self.blocks, intercept=self.intercept)}


class QueryTable(Node):
    """A query over the lake's tables."""

    kind = "query_table"

    def __init__(self, spark: SparkSession, query: str):
        self.spark, self.query = spark, query

    def execute(self, inputs: dict[int, DataFrame]) -> dict[int, DataFrame]:
        return {0: self.spark.sql(self.query)}


class LinearRegression(Node):
    """Ordinary least squares; terms are named intercept, x1, x2, ..."""

    kind = "linear_regression"

    def __init__(self, spark: SparkSession, x_columns: list[str], y_column: str, intercept: bool = True):
        self.x, self.y, self.intercept = x_columns, y_column, intercept

    def ports(self) -> Ports:
        return Ports(inputs={0: None})

    def execute(self, inputs: dict[int, DataFrame]) -> dict[int, DataFrame]:
        return {0: stats.ols(inputs[0], self.x, self.y, self.intercept)}


class MendelianRandomisation(Node):
    kind = "mr"

    def __init__(self, spark: SparkSession, method_list: list[str] | None = None, action: int = 2, tolerance: float = 0.08, parameters: dict | None = None):
        self.methods, self.action, self.tolerance, self.parameters = method_list or [], action, tolerance, mr_robust.Parameters(**(parameters or {}))

    def ports(self) -> Ports:
        return Ports(inputs={0: None})

    def execute(self, inputs: dict[int, DataFrame]) -> dict[int, DataFrame]:
        kept = mr.harmonise(inputs[0], self.action, self.tolerance).filter("mr_keep")
        return {0: mr_robust.estimates(kept, self.methods, self.parameters)}


class LdScore(Node):
    """Heritability of summary statistics (rsid, z, n) on port 0 by a panel (rsid, contig, position, ld_score, af) on port 1."""

    kind = "ldsc"

    def __init__(self, spark: SparkSession, intercept: float | None = None, n_blocks: int = ldsc.BLOCKS):
        self.intercept, self.blocks = intercept, n_blocks

    def ports(self) -> Ports:
        return Ports(inputs={0: None, 1: None})

    def execute(self, inputs: dict[int, DataFrame]) -> dict[int, DataFrame]:
        panel = inputs[1]
        rows = ldsc.on_panel([inputs[0]], panel)
        return {0: ldsc.h2_frame(rows, ldsc.common(panel), blocks=self.blocks, intercept=self.intercept)}


class GeneticCorrelation(Node):
    """Two summary statistics on ports 0 and 1, the panel on port 2; M counts all its rows."""

    kind = "ldsc_rg"

    def __init__(self, spark: SparkSession, intercepts: list[float] | None = None, n_blocks: int = ldsc.BLOCKS):
        self.intercepts, self.blocks = tuple(intercepts or (None, None, None)), n_blocks

    def ports(self) -> Ports:
        return Ports(inputs={0: None, 1: None, 2: None})

    def execute(self, inputs: dict[int, DataFrame]) -> dict[int, DataFrame]:
        rows = ldsc.on_panel([inputs[0], inputs[1]], inputs[2])
        return {0: ldsc.rg_frame(rows, inputs[2].count(), blocks=self.blocks, intercepts=self.intercepts)}


class Liability(Node):
    """h2 and its standard error on the liability scale."""

    kind = "liability"

    def __init__(self, spark: SparkSession, sample_prevalence: float, population_prevalence: float):
        self.factor = stats.liability_factor(sample_prevalence, population_prevalence)

    def ports(self) -> Ports:
        return Ports(inputs={0: None})

    def execute(self, inputs: dict[int, DataFrame]) -> dict[int, DataFrame]:
        f = F.lit(self.factor)
        return {0: inputs[0].withColumns({"h2_liab": F.col("h2") * f, "h2_se_liab": F.col("h2_se") * f})}


def default_registry() -> Registry:
    text, flag, number = {"type": "string"}, {"type": "boolean"}, {"type": "number"}
    texts = {"type": "array", "items": text}
    r = Registry()
    r.register("source", Source, {"properties": {"path": text, "format": text, "type": text, "ident": text}})
    r.register("sql", Sql, {"properties": {"sql_query": text}, "required": ["sql_query"]})
    r.register("echo", Echo, {"properties": {}})
    r.register("sink_file", SinkFile, {"properties": {"path": text, "format": text, "mode": text}, "required": ["path"]})
    r.register("sink_table", SinkTable, {"properties": {"ident": text, "mode": text, "rename_reserved": flag}, "required": ["ident"]})
    r.register("sink_iceberg", SinkTable, {"properties": {"ident": text, "mode": text, "rename_reserved": flag}, "required": ["ident"]})
    r.register("query_table", QueryTable, {"properties": {"query": text}, "required": ["query"]})
    r.register("linear_regression", LinearRegression, {"properties": {"x_columns": texts, "y_column": text, "intercept": flag}, "required": ["x_columns", "y_column"]})
    whole = {"type": "integer"}
    mr_parameters = {"test_dist": text, "nboot": whole, "cov": number, "penk": number, "phi": number, "alpha": number, "qthresh": number, "over_dispersion": flag, "loss_function": text, "shrinkage": flag, "seed": whole}
    r.register("mr", MendelianRandomisation, {"properties": {"method_list": texts, "action": whole, "tolerance": number, "parameters": {"type": "object", "properties": mr_parameters}}})
    r.register("ldsc_partitioned", PartitionedHeritability, {"properties": {"annotations": texts, "m": {"type": "array", "items": number}, "intercept": number, "n_blocks": whole}, "required": ["annotations", "m"]})
    r.register("ldsc", LdScore, {"properties": {"intercept": number, "n_blocks": {"type": "integer"}}})
    r.register("ldsc_rg", GeneticCorrelation, {"properties": {"intercepts": {"type": "array", "items": number}, "n_blocks": {"type": "integer"}}})
    r.register("liability", Liability, {"properties": {"sample_prevalence": number, "population_prevalence": number}, "required": ["sample_prevalence", "population_prevalence"]})
    return r

