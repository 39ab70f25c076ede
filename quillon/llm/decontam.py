"""Benchmark decontamination: a prefix-filtered join of word shingles, verified over item-sized windows.

A unit is a run of an item's words: every ``window`` consecutive words, the whole item where it has fewer (or
``window`` is None).  Its tokens are its word shingles (of ``shingle`` words, of all its words where it has fewer), each
with its offset.  A document holds a unit at a place when at least ``threshold`` of the unit's shingles stand there,
every one at its offset; at 1, when the words are the same.

1. One pass over the documents hashes every shingle and asks a filter of the benchmark's tokens (a Bloom filter of
   at most 32 MB; an exact list behind it up to ``MOST_TOKENS`` tokens).  A place stays for a unit length m when enough of
   its m - shingle + 1 shingles pass and m words fit into the document (length bound).  The words under such
   places are stored as segments; of a clean document nothing is.
2. Tokens are counted over all documents' segments.  A unit's necessary tokens are its n - need + 1 rarest ones: a place
   that holds the unit shows one of them.  At a threshold of 1 that is one token.
3. Necessary tokens are joined with the segments' tokens; the offset gives the one place (positional
   bound), and the words themselves are compared there.  Hashes choose candidates only: no result depends on them.
4. Hits are merged to spans per document.  Units with the same items share a set number, documents with the same
   sets a combination; the list of items is made once per combination.

Scale: documents are read once and not shuffled; what is shuffled is numbers of documents and the words of
segments, which grow with the contamination.  A hot passage is a row for each of its tokens and documents: the join
broadcasts the necessary tokens when their stored bytes are few, else deals each of them to ``SALTS`` parts.  Documents have
numbers of their own (task and place), so repeated rows and copies don't meet in one group.

Cases: a null or wordless text has no words and no hits; a null item text is no unit; an item without an id
marks words but is not listed; an item id that repeats stands for all its texts; rows that repeat are documents of
their own; very long texts are read whole; other columns are ignored; ids may be of any type that casts to string.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, arrow_rows
from .ngram_join import bloom, maybe_in
from .shingles import M, chunks, mix, span_hashes, word_spans

WINDOW, SHINGLE = 10, 3
#: Tokens of the exact list; bytes of the stored necessary tokens up to which they are broadcast; parts of a token beyond that.
MOST_TOKENS, MOST_BROADCAST, SALTS = 1 << 18, 4 << 20, 16
#: Rows of an Arrow batch.
ROWS = 1000

#: Bytes that part words: all of ASCII but digits and letters (A-Z are in lower case by then).
BREAKS = np.zeros(256, bool)
BREAKS[:128] = True
BREAKS[48:58] = BREAKS[97:123] = False


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; the last k - 1 places have none."""
    g = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        g += h[j : j + len(g)] * np.uint64(pow(int(M), 2 * j + 3, 2**64))
    return mix(g + np.uint64(k))


def need_of(m: int, shingle: int, threshold: float) -> tuple[int, int, int]:
    """Of a unit of m words: words of a shingle, number of shingles, number of those that must be met."""
    k = min(m, shingle)
    n = m - k + 1
    return k, n, max(1, math.ceil(threshold * n - 1e-9))


def _words(folded: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    raw = folded.tobytes()
    return [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)]


UNITS = "item string, words array<string>, tokens array<long>"


def _units(window: int | None, shingle: int):
    """(item, text) to units: the item's id, the words, the tokens in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws in chunks(batches):
            folded, start, end, count = word_spans(raws, BREAKS)
            h = span_hashes(folded, start, end)
            words, rows, at = _words(folded, start, end), [], 0
            for i, n in zip(ids, count.tolist(), strict=True):
                m = n if window is None else min(n, window)
                k = min(m, shingle)
                if n:
                    g = shingle_hashes(h[at : at + n], k).view(np.int64).tolist()
                    rows += [(i, words[at + s : at + s + m], g[s : s + m - k + 1]) for s in range(n - m + 1)]
                at += n
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.string()), pa.array(c[1], pa.list_(pa.string())), pa.array(c[2], pa.list_(pa.int64()))], names=["item", "words", "tokens"]
                )

    return run


#: Rows of documents (first null) and of segments: first: place of the segment's first word; at, token: its tokens' places in it.
SEGMENTS = "uid long, id string, n_words long, first long, words array<string>, at array<int>, token array<long>"


def _segments(lengths: list[int], shingle: int, threshold: float, filters):
    """(id, text) to SEGMENTS.  filters: broadcast Bloom filter and sorted list of the tokens (empty: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, exact = filters.value
        made = TaskContext.get().partitionId() << 40
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        for ids, raws in chunks(batches):
            folded, start, end, count = word_spans(raws, BREAKS)
            h = span_hashes(folded, start, end)
            text_of = np.repeat(np.arange(len(raws)), count)
            last = np.cumsum(count)[text_of] if len(h) else np.zeros(0, np.int64)
            place = np.arange(len(h))
            passed: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            cover = np.zeros(len(h) + 1, np.int64)
            for m in lengths:
                k, n, need = need_of(m, shingle, threshold)
                if k not in passed:
                    g = shingle_hashes(h, k).view(np.int64)
                    ok = place[: len(g)] + k <= last[: len(g)]
                    ok[ok] = maybe_in(bits, g[ok])
                    if len(exact):
                        ok[ok] = exact[np.minimum(np.searchsorted(exact, g[ok]), len(exact) - 1)] == g[ok]
                    passed[k] = g, ok
                total = np.concatenate(([0], np.cumsum(passed[k][1])))
                s = np.flatnonzero(total[np.minimum(place + n, len(total) - 1)] - total[np.minimum(place, len(total) - 1)] >= need)
                s = s[s + m <= last[s]]
                cover[s] += 1
                cover[s + m] -= 1
            under = np.cumsum(cover[:-1]) > 0
            edge = np.ones(len(h), bool)
            edge[1:] = (under[1:] != under[:-1]) | (text_of[1:] != text_of[:-1])
            lo = np.flatnonzero(edge)
            hi = np.append(lo[1:], len(h))[under[lo]]
            lo = lo[under[lo]]
            uids = list(range(made, made + len(ids)))
            made += len(ids)
            nulls = [None] * len(ids)
            rows = list(zip(uids, ids, count.tolist(), *[nulls] * 4, strict=True))
            if len(lo):
                texts, begin = text_of[lo].tolist(), np.cumsum(count) - count
                for a, b, t in zip(lo.tolist(), hi.tolist(), texts, strict=True):
                    found = [(g[a : max(a, b - k + 1)], np.flatnonzero(ok[a : max(a, b - k + 1)])) for k, (g, ok) in passed.items()]
                    at = np.concatenate([p for _, p in found])
                    token = np.concatenate([g[p] for g, p in found])
                    rows.append((uids[t], None, None, int(a - begin[t]), _words(folded, start[a:b], end[a:b]), at.tolist(), token.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in SEGMENTS.split(", ")])

    return run


def _same(shingle: int, threshold: float) -> Column:
    """Whether the words ``here`` hold the unit ``words`` of ``m`` words and ``n`` shingles."""
    if threshold >= 1:
        return F.col("here") == F.col("words")
    k = F.least(F.col("m"), F.lit(shingle))
    met = F.filter(F.sequence(F.lit(1), F.col("n")), lambda j: F.slice("here", j, k) == F.slice("words", j, k))
    return F.size(met) >= F.greatest(F.lit(1), F.ceil(F.col("n") * threshold - 1e-9))


class Decontamination:
    """The join of one table of documents with one of items; see the module."""

    def __init__(self, docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int | None, shingle: int, threshold: float):
        if not (0 < threshold <= 1 and shingle > 0 and (window is None or window > 0)):
            raise ValueError("threshold lies above 0 and up to 1; window and shingle are at least 1")
        self.ws, self.window, self.shingle, self.threshold = Workspace(docs.sparkSession), window, shingle, threshold
        self.docs = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("text"))
        self.items = items.select(items[item_col].cast("string").alias("item"), items[item_text_col].cast("string").alias("text"))
        self.id = docs.schema[id_col]

    def units(self) -> DataFrame:
        """Distinct units (unit: number, words, tokens, m, n, items: sorted ids, set: the number of that list)."""
        u = self.items.filter("text is not null").mapInArrow(_units(self.window, self.shingle), UNITS)
        u = u.groupBy("words").agg(F.first("tokens").alias("tokens"), F.array_sort(F.collect_set("item")).alias("items"))
        return self.ws.put(
            u.select(
                F.sha2(F.array_join("words", " "), 256).alias("unit"), "words", "tokens", F.size("words").alias("m"), F.size("tokens").alias("n"), "items",
                F.sha2(F.to_json("items"), 256).alias("set"),
            ),
            "units",
        )

    def found(self, units: DataFrame) -> DataFrame:
        """SEGMENTS of all documents, stored."""
        ws, spark = self.ws, self.ws.spark
        tokens = ws.put(units.select(F.explode("tokens").alias("token")).distinct(), "tokens")
        exact = np.zeros(0, np.int64)
        if tokens.count() <= MOST_TOKENS:
            exact = np.sort(np.array([r[0] for r in tokens.collect()], np.int64))
        filters = spark.sparkContext.broadcast((bloom(tokens), exact))
        lengths = sorted(r[0] for r in units.select("m").distinct().collect())  # at most ``window`` of them
        with arrow_rows(spark, ROWS):
            return ws.put(self.docs.mapInArrow(_segments(lengths, self.shingle, self.threshold, filters), SEGMENTS), "segments")

    def necessary(self, units: DataFrame, segments: DataFrame) -> DataFrame:
        """Each unit's rarest tokens (token, offset, words, m, n, set)."""
        often = segments.select(F.explode("token").alias("token")).groupBy("token").agg(F.count("*").alias("often"))
        each = units.select("unit", "words", "m", "n", "set", F.posexplode("tokens").alias("offset", "token")).join(often, "token", "left")
        rank = F.row_number().over(Window.partitionBy("unit").orderBy(F.coalesce("often", F.lit(0)), "token", "offset"))
        most = F.col("n") - F.greatest(F.lit(1), F.ceil(F.col("n") * self.threshold - 1e-9)) + 1
        each = each.withColumn("rank", rank).filter((F.col("rank") <= most) & F.col("often").isNotNull())
        return self.ws.put(each.select("token", "offset", "words", "m", "n", "set"), "necessary")

    def hits(self, units: DataFrame, segments: DataFrame) -> DataFrame:
        """Rows (uid, start, end, set) of the places that hold a unit, stored."""
        ws = self.ws
        rare = self.necessary(units, segments)
        most = units.agg(F.max("m")).first()[0] or 1
        around = lambda p: F.slice("words", F.greatest(F.lit(1), p - (most - 2)), 2 * most - 1)  # noqa: E731  the words that a unit with a token at p may cover
        near = F.transform(F.arrays_zip("at", "token"), lambda x: F.struct(x["at"].alias("at"), x["token"].alias("token"), around(x["at"]).alias("near")))
        c = segments.filter("first is not null").select("uid", "first", F.explode(near).alias("x"))
        c = c.select("uid", "first", "x.at", "x.token", "x.near", F.pmod("uid", F.lit(SALTS)).alias("salt"))
        if ws.size("necessary") <= MOST_BROADCAST:
            c = c.join(F.broadcast(rare), "token")
        else:
            c = c.join(rare.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["token", "salt"])
        start = F.col("at") - F.col("offset")
        here = F.slice("near", start - F.greatest(F.lit(0), F.col("at") - (most - 1)) + 1, F.col("m"))
        c = c.filter(start >= 0).withColumn("here", here).filter((F.size("here") == F.col("m")) & _same(self.shingle, self.threshold))
        start = F.col("first") + start
        return ws.put(c.select("uid", start.alias("start"), (start + F.col("m")).alias("end"), "set").distinct(), "hits")

    def run(self) -> DataFrame:
        ws = self.ws
        units = self.units()
        segments = self.found(units)
        hits = self.hits(units, segments)
        order = Window.partitionBy("uid").orderBy("start", "end")
        upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        places = hits.groupBy("uid", "start").agg(F.max("end").alias("end"), F.collect_set("set").alias("sets"))
        places = places.withColumn("new", F.coalesce((F.col("start") > upto).cast("int"), F.lit(1)))
        places = places.withColumn("span", F.sum("new").over(order))
        spans = places.groupBy("uid", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_distinct(F.flatten(F.collect_list("sets"))).alias("sets"))
        per = spans.groupBy("uid").agg(
            F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("sets")))).alias("sets"),
        )
        per = ws.put(per.withColumn("combination", F.sha2(F.array_join("sets", ","), 256)), "per-document")
        lists = units.groupBy("set").agg(F.first("items").alias("items"))
        combos = per.groupBy("combination").agg(F.first("sets").alias("sets")).select("combination", F.explode("sets").alias("set")).join(lists, "set")
        combos = combos.select("combination", F.explode("items").alias("item")).groupBy("combination").agg(F.array_sort(F.collect_set("item")).alias("items"))
        combos = ws.put(combos, "combinations")
        if ws.size("combinations") <= MOST_BROADCAST:
            combos = F.broadcast(combos)
        per = per.join(combos, "combination", "left").select("uid", "n_hit", "spans", "items")
        out = segments.filter("first is null").select("uid", "id", "n_words").join(per, "uid", "left")
        return out.select(
            F.col("id").cast(self.id.dataType).alias(self.id.name), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int | None = WINDOW, shingle: int = SHINGLE, threshold: float = 1.0
) -> DataFrame:
    """One row per document: its id, n_words, n_hit (words in spans), spans (start and end by word), items (ids as sorted strings)."""
    return Decontamination(docs, items, id_col, text_col, item_col, item_text_col, window, shingle, threshold).run()


def digests(found: DataFrame) -> DataFrame:
    """``contamination`` with the items as a number and a digest."""
    return found.select(
        *found.columns[:1], "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def oracle(window: int = WINDOW) -> str:
    """DuckDB: windows as joined words, joined with every place of every document."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
i AS MATERIALIZED (SELECT item_id, {words} AS w FROM benchmark),
u AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), {window}) AS m, array_to_string(w[s:s + least(len(w), {window}) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS s FROM i WHERE len(w) > 0)),
p AS MATERIALIZED (SELECT r, w, unnest(range(1, len(w) + 1)) AS s FROM d),
h AS MATERIALIZED (SELECT DISTINCT r, s, u.m, item_id FROM (SELECT p.r, p.s, k.m, array_to_string(w[s:s + k.m - 1], ' ') AS x FROM p JOIN (SELECT DISTINCT m FROM u) k ON s + k.m - 1 <= len(w)) p
  JOIN u ON u.m = p.m AND u.x = p.x),
n AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS k FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN t ON t.r = d.r"""
