"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, chat, clusters, decontam, langid, lines, media, mixing, ngram_join, secrets, trie, urls, vectors
from .common import table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_documents(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is its own text: bad if symbols make up more than a share of it (``urls.symbol_outcomes``)."""
    pages = table(spark, sf_dir, "pages")
    return urls.filter_urls(pages, urls.symbol_outcomes(pages))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner: the source; repository: the document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.col("doc_id").alias("_repo"))
    return secrets.digests(secrets.scan_secrets(docs, "source", "_repo"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.link_quotes(table(spark, sf_dir, "conversations"))
    return out.withColumn("text", F.sha2("text", 256)).withColumnRenamed("text", "text_sha256")


def quoting(messages: DataFrame) -> DataFrame:
    """The messages with quotes in front: the first line of the message before (of the one two turns before for every third turn),
    and for every fifth turn a line of the conversation before, twice quoted; the last line stands in short lines, too."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    line = lambda c: F.substring_index(c, "\n", 1)
    older = F.when(F.col("turn") % 3 == 0, F.lag("text", 2).over(w)).otherwise(F.lag("text").over(w))
    m = messages.select("conv_id", "turn", "role", "text", older.alias("older"))
    other = messages.filter("turn = 0").select((F.col("conv_id") + 1).alias("conv_id"), F.col("text").alias("other"))
    m = m.join(other, "conv_id", "left")
    far = F.when(F.col("turn") % 5 == 1, F.concat(F.lit(">> "), line("other"), F.lit("\n> Yes.\n")))
    text = F.concat(F.coalesce(F.concat(F.lit("> "), line("older"), F.lit("\n")), F.lit("")), F.coalesce(far, F.lit("")), "text", F.when(F.col("turn") % 2 == 0, F.lit("\nYes.")).otherwise(F.lit("")))
    return m.select("conv_id", "turn", "role", text.alias("text"))


QUOTING = """(SELECT m.conv_id, turn, role, coalesce('> ' || split_part(older, chr(10), 1) || chr(10), '') || CASE WHEN turn % 5 = 1 THEN coalesce('>> ' || split_part(other, chr(10), 1) || chr(10) || '> Yes.' || chr(10), '') ELSE '' END
  || text || CASE WHEN turn % 2 = 0 THEN chr(10) || 'Yes.' ELSE '' END AS text
  FROM (SELECT *, CASE WHEN turn % 3 = 0 THEN lag(text, 2) OVER w ELSE lag(text) OVER w END AS older FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) m
  LEFT JOIN (SELECT conv_id + 1 AS conv_id, text AS other FROM conversations WHERE turn = 0) o ON o.conv_id = m.conv_id)"""


def chat_quotes_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op8, of conversations that quote one another (the given ones quote nothing)."""
    out = chat.link_quotes(quoting(table(spark, sf_dir, "conversations")))
    return out.withColumn("text", F.sha2("text", 256)).withColumnRenamed("text", "text_sha256")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(table(spark, sf_dir, "embeddings")).drop("centroid")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.shared_heads(trie.turn_arrays(table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_line_dedup, op3_url_filter, op4_secret_scan, op5_language_id, op6_embedding_dedup, op7_byte_bpe, op8_chat_quotes, chat_quotes_derived, op9_media, op10_mixing, op11_clusters, op12_decontamination, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard": ngram_join.oracle(),
        "op2_line_dedup": lines.oracle(),
        "op3_url_filter": urls.oracle(),
        "op4_secret_scan": secrets.oracle(),
        "op6_embedding_dedup": vectors.oracle(),
        "op8_chat_quotes": chat.oracle(),
        "chat_quotes_derived": chat.oracle(QUOTING),
        "op10_mixing": mixing.oracle(),
        "op11_clusters": clusters.oracle(),
        "op12_decontamination": decontam.oracle(),
        "op13_prefix_trie": trie.oracle(),
    }
