"""A lake of catalogue tables: namespaces, overwrite and append, paged queries, records, and loads that may be repeated."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .store import shared_folder, stored

#: Page of a query.
ROWS = 50
#: Column names that some table formats keep for themselves (fixed values).
RESERVED = ("pos", "file_path")


def free_of_reserved(df: DataFrame) -> DataFrame:
    """Reserved top-level names get ``_col`` behind them, and underscores until the name is free."""
    taken = {c.lower() for c in df.columns}
    for c in df.columns:
        if c.lower() in RESERVED:
            new = f"{c}_col"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            df = df.withColumnRenamed(c, new)
    return df


class Lake:
    """Tables under one namespace of a Spark catalogue.

    With a catalogue of nested namespaces (``catalog``, for example an Iceberg one) the dots of a
    namespace are levels; the session catalogue has one level, where they become underscores and
    tables live under the shared folder."""

    def __init__(self, spark: SparkSession, namespace: str = "default", catalog: str | None = None):
        self.spark, self.catalog = spark, catalog
        self.levels = namespace.split(".") if catalog else [namespace.replace(".", "__")]
        self.create_namespace()

    @property
    def namespace(self) -> str:
        return ".".join([*([self.catalog] if self.catalog else []), *[f"`{x}`" for x in self.levels]])

    def ident(self, name: str) -> str:
        return f"{self.namespace}.`{name}`"

    def create_namespace(self) -> None:
        """Every level of the namespace that isn't there yet."""
        for k in range(1, len(self.levels) + 1):
            name = ".".join([*([self.catalog] if self.catalog else []), *[f"`{x}`" for x in self.levels[:k]]])
            place = "" if self.catalog else f" LOCATION '{shared_folder(self.spark)}/lake/{self.levels[0]}'"
            self.spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {name}{place}")

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self.ident(name).replace("`", ""))

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.ident(name))

    def write(self, df: DataFrame, name: str, mode: str = "overwrite", partition_by: str | None = None) -> None:
        """overwrite drops the table and makes it anew; append makes it if absent and inserts by position, cast to its types."""
        if mode not in ("overwrite", "append"):
            raise ValueError(f"unknown mode {mode!r}")
        if mode == "append" and self.exists(name):
            fields = self.table(name).schema.fields
            if len(fields) != len(df.columns):
                raise ValueError(f"{name} has {len(fields)} columns, not {len(df.columns)}")
            names = [f"c{i}" for i in range(len(fields))]
            df = df.toDF(*names).select(*[F.col(n).cast(f.dataType).alias(f.name) for n, f in zip(names, fields, strict=True)])
            df.write.insertInto(self.ident(name))
            return
        with contextlib.suppress(AnalysisException):
            self.drop(name)
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).saveAsTable(self.ident(name))

    def insert(self, name: str, query: str) -> None:
        self.spark.sql(f"INSERT INTO {self.ident(name)} {query}")

    def load_partitions(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """Append the partitions of ``df`` that the table doesn't hold; returns their keys.  Repeating a load adds nothing."""
        held = stored(self.table(name).select(key).distinct(), "held") if self.exists(name) else None
        new = df if held is None else df.join(held, key, "left_anti").select(*df.columns)
        keys = stored(new.select(key).distinct(), "keys")  # as they are before the load
        if not keys.isEmpty():
            order = [c for c in df.columns if c != key] + [key]  # the partition column stands last in a partitioned table
            self.write(new.select(*order), name, "append" if held is not None else "overwrite", key)
        return keys

    def load_each(self, parts: dict[str, DataFrame], prefix: str, at_once: int = 4) -> list[str]:
        """One table a part, named prefix_part, ``at_once`` at a time; those that are there already are left alone."""
        made = [p for p in parts if not self.exists(f"{prefix}_{p}")]
        with ThreadPoolExecutor(max(1, at_once)) as pool:
            for job in [pool.submit(self.write, parts[p], f"{prefix}_{p}") for p in made]:
                job.result()
        return made

    def load_panel(self, df: DataFrame, name: str) -> bool:
        """Append a panel of LD scores, ``locus`` as a struct.  A table of other columns or types is dropped and made anew; whether that was so is returned."""
        if "locus.contig" in df.columns:
            df = locus_struct(df)
        plain = lambda d: [(f.name, f.dataType.simpleString()) for f in d.schema]
        drifted = self.exists(name) and plain(self.table(name)) != plain(df)
        self.write(df, name, "overwrite" if drifted else "append")
        return drifted

    def tables(self) -> list[str]:
        """Names of all tables of this namespace and those below it; a namespace that can't be read is passed over."""

        def walk(space: str) -> Iterator[str]:
            with contextlib.suppress(AnalysisException):
                for r in self.spark.sql(f"SHOW TABLES IN {space}").collect():
                    if not r["isTemporary"]:
                        yield f"{space}.{r['tableName']}".replace("`", "")
            if self.catalog:
                with contextlib.suppress(AnalysisException):
                    for r in self.spark.sql(f"SHOW NAMESPACES IN {space}").collect():
                        yield from walk(f"{self.catalog}.{r['namespace']}")

        return sorted(walk(self.namespace))

    def describe(self, name: str) -> list[dict[str, Any]]:
        """name, type, nullable, field_id (its place, from 1) and doc of every column."""
        return [
            {"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable, "field_id": i, "doc": f.metadata.get("comment")}
            for i, f in enumerate(self.table(name).schema.fields, 1)
        ]

    def query(self, statement: str, max_rows: int = ROWS, offset: int = 0) -> dict[str, Any]:
        """A page of a query's rows, with their total and whether more follow.  ``LIST TABLES`` and ``SHOW TABLES`` list this lake."""
        if re.fullmatch(r"\s*(list|show)\s+tables\s*;?\s*", statement, re.IGNORECASE):
            names = self.tables()
            page = [{"table": n} for n in names[offset : offset + max_rows]]
            return {"columns": ["table"], "rows": page, "total_available": len(names), "has_more": offset + len(page) < len(names)}
        df = self.spark.sql(statement)
        total = df.count()
        page = [r.asDict(recursive=True) for r in df.offset(offset).limit(max_rows).collect()]
        return {"columns": df.columns, "rows": page, "total_available": total, "has_more": offset + len(page) < total}

    def preview(self, name: str, rows: int = 10) -> list[dict[str, Any]]:
        return [r.asDict(recursive=True) for r in self.table(name).limit(rows).collect()]

    def count(self, name: str) -> int:
        return self.table(name).count()

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {self.ident(name)}")

    def add_records(self, name: str, records: DataFrame, state: str) -> None:
        """Append records with their state and the time; an update is a further row, never a replacement."""
        self.write(records.withColumns({"state": F.lit(state), "update_ts": F.current_timestamp()}), name, "append")

    def latest_records(self, name: str, key: str) -> DataFrame:
        """The last row of every key."""
        return latest(self.table(name), key, "update_ts")


def latest(df: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """One row a key: that of the largest ``at``, ties by the largest of ``ties``."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(at), *[F.desc_nulls_last(t) for t in ties])
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def search(df: DataFrame, keyword: str, field: str, allowed: list[str], limit: int, sort_by: str, descending: bool = True, *ties: str) -> DataFrame:
    """Rows whose allowed field holds the keyword, whatever its case; nulls sort last."""
    for c in (field, sort_by):
        if c not in allowed:
            raise ValueError(f"{c!r} is not one of {', '.join(allowed)}")
    order = F.desc_nulls_last(sort_by) if descending else F.asc_nulls_last(sort_by)
    return df.filter(F.lower(F.col(field)).contains(keyword.lower())).orderBy(order, *ties).limit(limit)


def locus_struct(df: DataFrame) -> DataFrame:
    """Columns named locus.contig and locus.position become one struct ``locus``."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("locus.contig", "locus.position")]
    return df.select(F.struct(F.col("`locus.contig`").alias("contig"), F.col("`locus.position`").alias("position")).alias("locus"), *rest)


def main(argv: list[str] | None = None) -> int:
    """list | drop NAME | preview NAME [ROWS] | count NAME, for the namespace given with --namespace."""
    import argparse

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("--namespace", default="default")
    p.add_argument("command", choices=["list", "drop", "preview", "count"])
    p.add_argument("name", nargs="?")
    p.add_argument("rows", nargs="?", type=int, default=10)
    a = p.parse_args(argv)
    if a.command != "list" and not a.name:
        p.error("a table's name is missing")
    lake = Lake(SparkSession.builder.getOrCreate(), a.namespace)
    if a.command == "list":
        print("\n".join(lake.tables()))
    elif a.command == "preview":
        for r in lake.preview(a.name, a.rows):
            print(r)
    elif a.command == "count":
        print(lake.count(a.name))
    else:
        lake.drop(a.name)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
