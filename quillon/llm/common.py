"""Helpers shared by the corpus operators: shared-folder tables, row keys, components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space of the word and line rules: blank and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"


def lower_ascii(c: Column) -> Column:
    """A to Z in lower case; every other character stays as it is."""
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, through Spark's own file system layer."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return freed memory to the system at a task's end: Python workers live on, and stages follow one another on them."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within the block, jobs hand at most ``rows`` rows at a time to Python: whole texts are long, and a batch stands in memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def few_rows(spark: SparkSession, rows: int = 1000) -> None:
    """As ``arrow_rows``, for the rest of the session: for frames that the caller runs after the operator's return."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fitted(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """``df`` in as many partitions as ``rows`` of it need, one for each ``each`` and two a core at least, as adaptive plans would have it: a small table's step costs a task's start for every partition."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front while a column of that name is there (names differ by more than case)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name = "_" + name
    return name


class Workspace:
    """Intermediate tables in the folder that all executors share.

    The folder is ``spark.checkpoint.dir``.  Where that is unset and Spark runs in one
    process (tests), a temporary one is made; on a cluster that is an error, because
    executors could not see each other's files.  A table that is written here cuts the
    lineage and outlives any executor.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not (spark.sparkContext.master + "[").startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="quillon-")
            spark.conf.set("spark.checkpoint.dir", root) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        self.root = f"{root.rstrip('/')}/quillon-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` under ``name`` and return the stored table."""
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def size(self, name: str) -> int:
        """Bytes of a stored table's files."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()

    @contextlib.contextmanager
    def in_order(self) -> Iterator[None]:
        """Within the block, scans of bucketed tables with one file a bucket count as sorted."""
        key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(key, "false")
        self.spark.conf.set(key, "true")
        try:
            yield
        finally:
            self.spark.conf.set(key, before)

    def put_sorted(self, df: DataFrame, name: str, keys: list[str]) -> DataFrame:
        """As ``put``, bucketed and sorted by ``keys``: as many buckets as shuffles have partitions, one file each, so joins and sums by the keys need no shuffle."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        title = f"{self.root.rsplit('/', 1)[1]}_{name}".replace("-", "_")
        writer = df.repartition(buckets, *keys).write.mode("overwrite").option("compression", "zstd").option("path", self.path(name))
        writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(title)
        return self.spark.table(title)

    def drop_sorted(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.root.rsplit('/', 1)[1]}_{name}".replace("-", "_"))
        self.drop(*names)

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def components(ws: Workspace, edges: DataFrame, tag: str = "cc", most_rounds: int = 40) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (id, component).

    Alternating large-star and small-star rounds.  Every round is one shuffle by
    the larger and one by the smaller end, partial minima first, and is written
    to the shared folder; nothing but two counters reaches the driver.  Ids
    without an edge to another id are absent.  component is the smallest id.
    Rounds grow as the logarithm of the longest path; should ``most_rounds`` not
    do, that is an error and never a partial result.
    """
    e = edges.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    cur = ws.put(e.distinct(), f"{tag}-start")
    n = cur.count()  # no round adds edges
    seen: tuple | None = None
    last = f"{tag}-start"
    for k in range(most_rounds):
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = fitted(both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")), n)
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        small = fitted(fitted(small.select("x.a", "x.b").filter("a <> b"), 2 * n).distinct(), 2 * n)
        name = f"{tag}-{k}"
        cur = ws.put(small, name)
        ws.drop(last)
        last = name
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    pairs = cur.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    roots = cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return fitted(pairs.union(roots.join(pairs.select("id"), "id", "left_anti")), 2 * n)
