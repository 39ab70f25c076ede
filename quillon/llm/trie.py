"""Conversation prefix trie from a global order of turn arrays.

A conversation is the array of its turns; a turn is a 16-byte symbol (SHA-256 of role and text, cut) and the number of
words of its text.  Symbols one after the other are a binary key, so that keys in byte order are turn arrays in a
global order and a common prefix of keys is one of turns.

1. Keys are range-sorted with the conversation's id behind them: equal arrays spread over partitions, too.
2. Every partition is swept once.  Neighbours' common prefix (LCP) closes the open nodes below it and opens the new
   array's nodes; a closed node adds its members, leaves and savings to the one above.  A node that is no prefix of the
   partition's first or last array is complete here.
3. What else is open, the prefixes of the first and the last array with what the partition knows of them, is stitched: one
   sweep over the partitions' two stacks (not over their rows) in order closes nodes by the same rule.
4. A node's parent is told by the digest of its array.  Children of nodes that were complete in the partition have got their
   parent's number there; the rest look it up in the stitched nodes, which are few.

The ids of conversations that end in a node come in ascending order and are hashed as they come.  Where such a group
goes over a partition's edge its ids, as text, go to the stitching step, one piece from each partition: SHA-256 is one chain, so
a group's text is read by one task, once and piece by piece, however large the group is.

Scale: texts are hashed where they are read, and never shuffled; a turn's row is some 50 bytes.  Memory of a task: its
stacks (the longest array), the closed children of its open nodes, and the ids of one group: a partition's rows at most.
Partitions have about ``PART_ROWS`` conversations.

Cases: null roles and texts are empty; rows with a null conversation are left out; turns go by number, null first, then by
role, then by symbol (repeated rows are turns of their own); an empty table has no row, not even a root.  Very long
texts are one symbol each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Bytes of a symbol; conversations of a partition; bytes of stored stitched nodes up to which they are broadcast.
SYMBOL, PART_ROWS, MOST_BROADCAST = 16, 50_000, 4 << 20
#: Conversations of a family; the lengths 0 to HEADS - 1 of the head that it shares.
FAMILY, HEADS = 20, 4

#: Rows of the sweep.  kind 0: a node; parent: its parent's digest where parent_conv_id is not known yet; digest: its own (stitched nodes only).
#: kind 1: what is to be stitched of a partition: the first array (key, words), the counts of its nodes (stack: 5 for each depth from 0 on) and the ids that
#: end in it; the same of the last array, if it is another, from behind the part on that both share (depth), with the digests of ids (ends2) of its nodes in which
#: arrays before the last one end.
ROWS = (
    "kind int, part int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent binary, "
    "digest binary, key binary, words array<long>, stack array<long>, ids binary, key2 binary, words2 array<long>, stack2 array<long>, ends2 array<string>, ids2 binary"
)
_FIELDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(n, _FIELDS[k]) for n, k in (f.split() for f in ROWS.split(", "))])
ROOT = hashlib.blake2b(b"root", digest_size=SYMBOL).digest()


def common_prefix(a: bytes, b: bytes) -> int:
    """Symbols that two keys share in front."""
    lo, hi = 0, min(len(a), len(b)) // SYMBOL
    if a[: hi * SYMBOL] == b[: hi * SYMBOL]:
        return hi
    while lo < hi - 1:  # the first ``lo`` are shared, the first ``hi`` are not
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[: mid * SYMBOL] == b[: mid * SYMBOL] else (lo, mid)
    return lo


class Node:
    """An open node: counts of what is closed below it, of the arrays that end in it, and its children that wait for its number."""

    __slots__ = ("digest", "words", "low", "n", "children", "leaves", "saved", "ends", "told", "waiting")

    def __init__(self, digest: bytes, words: int, counts: tuple = (None, 0, 0, 0, 0)):
        self.digest, self.words = digest, words
        self.low, self.n, self.children, self.leaves, self.saved = counts
        self.ends = self.told = None  # digest of the ids so far, or as another task told it
        self.waiting: list[dict] = []

    def counts(self) -> tuple:
        return self.low, self.n, self.children, self.leaves, self.saved

    def meet(self, low: int | None, n: int) -> None:
        self.n += n
        if low is not None:
            self.low = low if self.low is None else min(low, self.low)

    def add(self, counts: tuple) -> None:
        """Counts of the same node from another partition."""
        self.meet(counts[0], counts[1])
        self.children, self.leaves, self.saved = self.children + counts[2], self.leaves + counts[3], self.saved + counts[4]

    def text(self, ids: bytes) -> None:
        """Ids, joined by commas, of arrays that end here."""
        if self.ends is None:
            self.ends = hashlib.sha256(ids)
        else:
            self.ends.update(b"," + ids)

    def close(self, depth: int, above: Node | None) -> dict:
        """The finished node's row; ``above`` gets what it holds."""
        leaves, saved = self.leaves or 1, self.saved + (self.n - 1) * self.words
        if above is not None:
            above.meet(self.low, self.n)
            above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved
        ends = self.told or (self.ends or hashlib.sha256()).hexdigest()
        return {"kind": 0, "conv_id": self.low, "depth": depth, "n_convs": self.n, "n_children": self.children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends}


def opened(stack: list[Node], key: bytes, words: list[int]) -> None:
    """Put the nodes of ``key`` below the stack's top upon it."""
    if not stack:
        stack.append(Node(ROOT, 0))
    for d in range(len(stack), len(key) // SYMBOL + 1):
        digest = hashlib.blake2b(stack[-1].digest + key[(d - 1) * SYMBOL : d * SYMBOL], digest_size=SYMBOL).digest()
        stack.append(Node(digest, words[d - 1]))


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _counts(nodes: list[Node]) -> list[int | None]:
    return [x for node in nodes for x in node.counts()]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, words, conv_id) to ROWS."""
    part = TaskContext.get().partitionId()
    stack: list[Node] = []
    lefts: dict[int, Node] = {}  # closed prefixes of the first array
    out: list[dict] = []
    ids: list[bytes] = []  # of the arrays that equal the one at hand
    first = last = None
    first_ids = None
    own = 0  # how much of the first array is still open

    def close(upto: int) -> None:
        """Close the nodes deeper than ``upto``; prefixes of the first array wait for the stitching."""
        while len(stack) - 1 > upto:
            depth, node = len(stack) - 1, stack.pop()
            if depth <= own:
                lefts[depth] = node
                continue
            row = node.close(depth, stack[-1])
            out.extend(child | {"parent_conv_id": node.low} for child in node.waiting)
            if depth - 1 <= own:
                out.append(row | {"parent": stack[-1].digest})
            else:
                stack[-1].waiting.append(row)

    for batch in batches:
        for key, words, conv in zip(*(batch.column(c).to_pylist() for c in ("key", "words", "conv_id")), strict=True):
            if key != last:
                if first is None:
                    first, first_words, own = key, words, len(key) // SYMBOL
                else:
                    text = b",".join(ids)
                    if last == first:
                        first_ids = text
                    else:
                        stack[-1].text(text)
                    shared = common_prefix(last, key)
                    close(shared)
                    own = min(own, shared)
                opened(stack, key, words)
                last, last_words = key, words
                ids.clear()
            stack[-1].meet(conv, 1)
            ids.append(b"%d" % conv)
        if len(out) >= 10_000:
            yield _batch(out)
            out.clear()
    if first is None:
        return
    whole = [*stack[: own + 1], *(lefts[d] for d in range(own + 1, len(first) // SYMBOL + 1))]
    row = {"kind": 1, "part": part, "depth": own, "key": first, "words": first_words, "stack": _counts(whole)}
    if last == first:
        row["ids"] = b",".join(ids)
    else:
        row |= {"ids": first_ids, "key2": last, "words2": last_words, "stack2": _counts(stack[own + 1 :]), "ends2": [node.ends and node.ends.hexdigest() for node in stack[own + 1 :]], "ids2": b",".join(ids)}
        out.extend(child | {"parent": node.digest} for node in stack[own + 1 :] for child in node.waiting)
    out.append(row)
    yield _batch(out)


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 1, in order, to the nodes that no partition could complete."""
    stack: list[Node] = []
    last = b""

    def close(upto: int) -> Iterator[dict]:
        while len(stack) - 1 > upto:
            node = stack.pop()
            above = stack[-1] if stack else None
            yield node.close(len(stack), above) | {"digest": node.digest, "parent": above.digest if above else None}

    def join(key: bytes, words: list[int], upto: int, counts: list, ends: list, ids: bytes) -> Iterator[dict]:
        """Close what ``key`` does not go on with; counts are those of its nodes from depth ``upto`` on."""
        nonlocal last
        yield from close(common_prefix(last, key)) if stack else ()
        opened(stack, key, words)
        for node, k in zip(stack[upto:], range(0, len(counts), 5), strict=True):
            node.add(counts[k : k + 5])
        for node, told in zip(stack[upto:], ends, strict=False):
            node.told = told or node.told
        stack[-1].text(ids)
        last = key

    for batch in batches:
        out: list[dict] = []
        for r in batch.to_pylist():
            out.extend(join(r["key"], r["words"], 0, r["stack"], [], r["ids"]))
            if r["key2"] is not None:
                out.extend(join(r["key2"], r["words2"], r["depth"] + 1, r["stack2"], r["ends2"], r["ids2"]))
        yield _batch(out)
    yield _batch(list(close(-1)))


def turn_arrays(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): every conversation's turns in order, as structs of symbol (16 bytes) and words."""
    role, text = (F.coalesce(rows[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    symbol = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * SYMBOL))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    turns = rows.filter(rows[conv_col].isNotNull()).select(
        rows[conv_col].cast("long").alias("conv_id"), F.struct(rows[turn_col].alias("turn"), role.alias("role"), symbol.alias("symbol"), words.alias("words")).alias("t")
    )
    turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["symbol"].alias("symbol"), t["words"].alias("words"))).alias("turns"))


def shared_heads(arrays: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Conversation c starts with the first h turns of conversation c - c % family, its own first h turns left out; h: crc32 of its decimal id % heads.

    Remainders have the sign of c.  At most ``family`` conversations look up one, of which only the head travels."""
    base = F.col("conv_id") - F.col("conv_id") % family
    head = arrays.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    turns = arrays.withColumns({"base": base, "h": h}).join(head, "base", "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return turns.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def prefix_trie(arrays: DataFrame) -> DataFrame:
    """The nodes of arrays (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.  Ids of ``arrays`` differ."""
    spark = arrays.sparkSession
    ws = Workspace(spark)
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["symbol"])), ""))
    keys = ws.put(arrays.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words")), "keys")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // PART_ROWS))
    swept = keys.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").select("key", "words", "conv_id").mapInArrow(_sweep, ROWS)
    swept = ws.put(swept, "swept", ["kind"])
    ends = swept.filter("kind = 1").repartition(1).sortWithinPartitions("part")
    stitched = ws.put(ends.mapInArrow(_stitch, ROWS), "stitched")
    nodes = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = stitched.select(F.col("digest").alias("parent"), F.col("conv_id").alias("of"))
    if ws.size("stitched") <= MOST_BROADCAST:
        above = F.broadcast(above)
    plain = swept.filter("kind = 0")
    rest = plain.filter("parent is not null").select("parent", *nodes).union(stitched.filter("parent is not null").select("parent", *nodes))
    rest = rest.join(above, "parent").select(*[F.col("of").alias(c) if c == "parent_conv_id" else c for c in nodes])
    return plain.filter("parent is null").select(nodes).union(rest).union(stitched.filter("parent is null").select(nodes))


def oracle(family: int = FAMILY, heads: int = HEADS) -> str:
    """DuckDB: every prefix of every rebuilt conversation as a list, nodes by grouping, subtrees by joining each node with its prefixes."""
    return f"""
WITH RECURSIVE o AS MATERIALIZED (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
  left(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), {2 * SYMBOL}) AS s FROM conversations WHERE conv_id IS NOT NULL),
a AS MATERIALIZED (SELECT c, list({{'s': s, 'w': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))}} ORDER BY turn NULLS FIRST, role, s) AS t FROM o GROUP BY c),
k AS (SELECT c, 0 AS q, 4294967295::UBIGINT AS v FROM a
  UNION ALL SELECT c, q + 1, list_reduce(list_prepend(xor(v, ascii((c::VARCHAR)[q + 1])::UBIGINT), [1, 2, 3, 4, 5, 6, 7, 8]::UBIGINT[]),
    lambda x, b: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END) FROM k WHERE q < length(c::VARCHAR)),
h AS MATERIALIZED (SELECT c, (xor(v, 4294967295::UBIGINT) % {heads})::BIGINT AS h FROM k WHERE q = length(c::VARCHAR)),
r AS MATERIALIZED (SELECT a.c, list_concat(coalesce(b.t[1:h.h], []), a.t[h.h + 1:]) AS t FROM a JOIN h ON h.c = a.c LEFT JOIN a b ON b.c = a.c - a.c % {family}),
p AS MATERIALIZED (SELECT c, len(t) AS n, d, array_to_string(list_transform(t[1:d], lambda x: x.s), '') AS key, coalesce(t[d].w, 0) AS w FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM r)),
n AS MATERIALIZED (SELECT key, d, min(c) AS c, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM p GROUP BY key, d),
u AS MATERIALIZED (SELECT left(key, {2 * SYMBOL} * (d - 1)::BIGINT) AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN u ON u.key = n.key),
s AS MATERIALIZED (SELECT left(key, {2 * SYMBOL} * e) AS key, sum((n_convs - 1) * w) AS saved, sum((n_children = 0)::BIGINT) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM f) GROUP BY 1)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, m.c AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN s ON s.key = f.key LEFT JOIN n m ON f.d > 0 AND m.key = left(f.key, {2 * SYMBOL} * (f.d - 1)::BIGINT)"""
