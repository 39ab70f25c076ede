"""Line dedup through levelled sorted runs of line hashes (DataFrame functions only).

A line's key is the line with blanks (0x20, 0x09-0x0D) stripped at both ends and
A-Z in lower case, held as two 64-bit hashes.  Documents arrive in batches.  A
batch's distinct keys, with the number of its documents that hold them, are
merge-anti-joined with the runs: keys that no run holds become a run of their
own, so every key stands in exactly one run; the others' counts are set aside as
additions.  Runs are tables in the shared folder, bucketed and sorted by hash, so
neither joins nor compactions shuffle or sort them again.  When a level holds
``fanout`` runs they are compacted into one run of the next level.

After the last batch the additions, summed by key, are merged into the runs; keys
of at least ``min_docs`` documents lose all their lines (``drop_common_lines``).
For a stream, ``LineRuns.unseen`` tells a batch's lines that no run holds.

Cost: texts are hashed once; the runs hold 24 bytes a key; joins are sort-merge
joins on hashes whose counts were summed map-side, so a line that stands in a
third of all documents is one row per task.

Cases: a null or empty text is one empty line; empty keys are never dropped; every
row is a document, also one that repeats another row; ids may be null or repeat;
very long texts are split whole; extra columns pass through ``drop_common_lines``,
whose own columns get underscores in front where a name is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Workspace, free_name, lower_ascii

MIN_DOCS = 10
BATCHES, FANOUT = 5, 3
KEY = ["h1", "h2"]


def split_lines(text: Column) -> Column:
    """The lines of a text, at every \\n; null or empty is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def row_key(id_col: Column, text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that stand for a row's id and text."""
    return F.xxhash64(id_col, text), F.xxhash64(F.lit("row"), text, id_col)


def hashed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (r1, r2, pos, h1, h2, first): one for each line whose key isn't empty; first: the row's first line of that key."""
    r1, r2 = row_key(docs[id_col], docs[text_col])
    keyed = F.transform(split_lines(lower_ascii(docs[text_col])), lambda line, i: F.struct(line_key(line).alias("k"), i.alias("pos")))
    hashed = F.transform(
        F.filter(keyed, lambda x: x["k"] != ""), lambda x: F.struct(F.xxhash64(x["k"]).alias("h1"), F.xxhash64(F.lit("line"), x["k"]).alias("h2"), x["pos"].alias("pos"))
    )
    # sorted, equal keys are neighbours; bound once by the outer transform
    flagged = F.transform(
        F.array(F.sort_array(hashed)),
        lambda s: F.transform(s, lambda x, i: F.struct(x["pos"], x["h1"], x["h2"], ((i == 0) | (F.get(s, i - 1)["h1"] != x["h1"]) | (F.get(s, i - 1)["h2"] != x["h2"])).alias("first"))),
    )[0]
    return docs.select(r1.alias("r1"), r2.alias("r2"), F.explode(flagged).alias("x")).select("r1", "r2", "x.pos", "x.h1", "x.h2", "x.first")


class LineRuns:
    """Levelled runs (h1, h2, n_docs) of disjoint keys in the shared folder, and the counts to be added to them."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, ws: Workspace | None = None):
        self.ws, self.fanout, self.made = ws or Workspace(spark), fanout, 0
        self.levels: list[list[tuple[str, DataFrame]]] = [[]]
        self.additions: list[DataFrame] = []

    def _store(self, df: DataFrame) -> tuple[str, DataFrame]:
        name = f"run-{self.made}"
        self.made += 1
        with self.ws.in_order():
            return name, self.ws.put_sorted(df, name, KEY)

    def add(self, lines: DataFrame) -> None:
        """One run of the new keys of a batch's ``hashed_lines``, additions of the others; full levels are compacted."""
        name = f"batch-{self.made}"
        with self.ws.in_order():
            keys = self.ws.put_sorted(lines.filter("first").groupBy(*KEY).agg(F.count("*").alias("n_docs")), name, KEY)
            run = self._store(self.unseen(keys))
            if self.runs():
                self.additions.append(self.ws.put(keys.join(run[1].hint("merge"), KEY, "left_anti"), f"additions-{self.made}"))
        self.ws.drop_sorted(name)
        self.levels[0].append(run)
        k = 0
        while len(self.levels[k]) >= self.fanout:
            if len(self.levels) == k + 1:
                self.levels.append([])
            self.levels[k + 1].append(self._store(self._all([df for _, df in self.levels[k]])))
            self.ws.drop_sorted(*(name for name, _ in self.levels[k]))
            self.levels[k] = []
            k += 1

    @staticmethod
    def _all(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for df in parts[1:]:
            out = out.union(df)
        return out

    def runs(self) -> list[tuple[str, DataFrame]]:
        return [r for level in self.levels for r in level]

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The rows (h1, h2, ...) whose key no run holds: one merge anti-join per run."""
        for _, df in self.runs():
            rows = rows.join(df.hint("merge"), KEY, "left_anti")
        return rows

    def common(self, min_docs: int) -> DataFrame:
        """Keys that at least ``min_docs`` documents of all batches hold: each run's counts with their additions."""
        n = F.col("n_docs")
        runs = [df for _, df in self.runs()]
        if not self.additions:
            return self._all([df.filter(n >= min_docs).select(*KEY) for df in runs])
        more = self._all(self.additions).groupBy(*KEY).agg(F.sum("n_docs").alias("more"))
        with self.ws.in_order():
            more = self.ws.put_sorted(more, "more", KEY)
        parts = [df.join(more.hint("merge"), KEY, "left").filter(n + F.coalesce("more", F.lit(0)) >= min_docs).select(*KEY) for df in runs]
        return self._all(parts)

    def drop(self) -> None:
        """Remove all runs."""
        self.ws.drop_sorted(*(name for name, _ in self.runs()), "more")
        self.levels, self.additions = [[]], []


def drop_common_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """``docs`` with the common lines cut out of ``text_col``, and n_lines, n_dropped (long)."""
    spark = docs.sparkSession
    ws = Workspace(spark)
    lines = hashed_lines(docs, id_col, text_col)
    lines = ws.put(lines.withColumn("batch", F.pmod(F.col("r1"), F.lit(batches)).cast("int")), "lines", ["batch"])
    index = LineRuns(spark, fanout, ws)
    for b in range(batches):
        index.add(lines.filter(F.col("batch") == b))
    with ws.in_order():
        common = ws.put(index.common(min_docs), "common")
    index.drop()
    hits = lines.join(common.hint("merge"), KEY).groupBy("r1", "r2").agg(F.collect_set("pos").alias("_cut"))
    hits = ws.put(hits, "hits")
    ws.drop("lines")
    names = [c for c in docs.columns if c != text_col]
    r1, r2 = row_key(docs[id_col], docs[text_col])
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], r1.alias("r1"), r2.alias("r2"), docs[text_col].alias("_text"))
    rows = rows.join(hits, ["r1", "r2"], "left").withColumn("_lines", split_lines(F.col("_text")))
    # array_except and array_distinct hash; _lines is one value per row, bound once by the outer transform
    kept = F.transform(
        F.array(F.struct(F.col("_lines").alias("l"), F.col("_cut").alias("c"))),
        lambda s: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["l"]) - 1), s["c"]), lambda i: F.get(s["l"], i)), "\n"
        ),
    )[0]
    return rows.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)],
        F.when(F.col("_cut").isNull(), F.coalesce("_text", F.lit(""))).otherwise(kept).alias(text_col),
        F.size("_lines").cast("long").alias(free_name("n_lines", docs.columns)),
        F.coalesce(F.size("_cut"), F.lit(0)).cast("long").alias(free_name("n_dropped", docs.columns)),
    )


def oracle(min_docs: int = MIN_DOCS) -> str:
    """DuckDB: doc_id, n_lines, n_dropped, kept_sha256."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT rid, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= {min_docs}),
g AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '') AS kept FROM k LEFT JOIN c USING (key) GROUP BY rid)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(kept) AS kept_sha256 FROM g JOIN d USING (rid)"""
