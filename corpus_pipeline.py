"""A training-data pipeline over ``documents``: five stages, each an operator of ``quillon.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  ``run`` writes each stage's result as Parquet in the shared folder and
reads it again.  All stages but the last return the columns of ``documents``.

Nulls, empty texts, repeated rows and extra columns are treated as the
operators' modules say; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, langid, lines, mixing, ngram_join
from quillon.llm.common import Workspace, few_rows, table

#: Documents whose best language is less probable than this are rejected, as are those without letters.
LEAST_SCORE = 0.35
#: Share of the tokens that the mixture is to keep.
BUDGET = 0.9


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rejects documents without a letter or without a likely language."""
    few_rows(spark)
    keep = tuple(c for c in docs.columns)
    renamed = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(keep)])
    at = {c: f"c{i}" for i, c in enumerate(keep)}
    net = langid.trained(docs)
    out = langid.predict(renamed, net, at["doc_id"], at["text"], tuple(at.values()))
    if net is not None:
        out = out.filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE))
    return out.select(*[F.col(v).alias(c) for c, v in at.items()])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines common to many documents are cut from the texts."""
    out = lines.drop_common_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of every group of linked documents the one with the smallest id stays.

    Rows of equal id and text are one document: of these the row with the smallest hash of all its columns
    stays.  Rows that share an id but not the text are documents of their own.  Rows without an id all stay."""
    ws = Workspace(spark)
    groups = ws.put(ngram_join.near_rows(docs), "groups").filter("doc_id is not null")
    gone = groups.filter("doc_id <> component_id").select("r1", "r2").distinct()
    r1, r2 = lines.row_key(docs["doc_id"], docs["text"])
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)], r1.alias("r1"), r2.alias("r2"))
    rows = rows.join(gone, ["r1", "r2"], "left_anti")
    again = ws.put(groups.filter("doc_id = component_id").groupBy("r1", "r2").agg(F.count("*").alias("n")).filter("n > 1").select("r1", "r2"), "again")
    if not again.isEmpty():
        one = rows.join(again, ["r1", "r2"]).groupBy("r1", "r2").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("x")).select("x.*")
        rows = rows.join(again, ["r1", "r2"], "left_anti").select(*names).union(one)
    return rows.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents are drawn by probabilities that fit the target weights."""
    out = mixing.mix(docs, budget=BUDGET)
    return out.filter(out.columns[-1]).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: token counts and digests of ids and decoded bytes."""
    import public_tokenizers

    few_rows(spark)
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing", mixture),
    ("byte-level BPE", tokens),
]

#: The first stage's network and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ws = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.put(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
