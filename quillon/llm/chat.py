"""Chat formatting: quotation linking.

Lines of a message that begin with ``>`` marks are quoted; the number of marks
is the nesting level.  A quoted line is normalised (marks and blanks stripped,
runs of blanks made one, A-Z in lower case), hashed, and joined to the messages
that hold a line of that hash as their own.  A quote is linked to the earliest
earlier message of its conversation with that line, else to the earliest message
of any other conversation with it (the smallest conv_id).  A message's parent is the message that most of its
level-1 lines (else all quoted lines) are linked to, the earliest one on ties;
without a link it is the message of the turn before.

The reply-ordered conversation is the depth-first walk of these trees: a message
is followed by its first reply with all that hangs on it, then by its next reply;
replies to one message, and messages without a parent, come by turn.  ``reply_pos``
is a message's place in that walk, ``depth`` its distance from the first message.
Both come from an Euler tour: every message is entered and left once, each event
points to its successor, and pointer doubling sums up what is still to come, in
log2(events of the longest conversation) rounds over the shared folder.

Originals are reduced to one row per (hash, conversation) and one per hash, and
stored, before any join, so a line that everyone quotes joins one row and a large
partition of quotes can be split.

Cases: a null text is empty; empty lines link to nothing; with ``least`` above 0, lines of fewer code
points link within their own conversation only; a message is named by (conv_id, turn), repeated rows share one parent
and one place; a null conv_id or turn has no parent, depth 0 and no place; a link to another conversation is recorded
but depth and place count within the own conversation only; lines of any length and any number of marks are read by
one pass without backtracking; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import numbered
from .common import BLANKS, Workspace, lower_ascii
from .lines import split_lines

#: What stands before a quoted line's words (possessive: nothing is tried again), and how such a line is told.
MARKS, QUOTED = r"^[ \t>]*+", r"^[ \t]*+>"
#: Fewest code points of a line that is linked to another conversation; 0: every line that isn't empty.
LEAST = 0


def _level(line: Column) -> Column:
    return F.char_length(F.regexp_extract(line, MARKS, 0)) - F.char_length(F.translate(F.regexp_extract(line, MARKS, 0), ">", ""))


def _bare(line: Column) -> Column:
    return F.btrim(F.regexp_replace(lower_ascii(F.regexp_replace(line, MARKS, "")), "[ \t\x0b\x0c\r]++", " "), F.lit(BLANKS))


def parsed_lines(messages: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows (conv_id, turn, pos, level, h, long) of the lines that aren't empty; long: may link to another conversation."""
    x = messages.select("conv_id", "turn", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    x = x.select("conv_id", "turn", "pos", _level(F.col("line")).alias("level"), _bare(F.col("line")).alias("bare"))
    return x.filter("bare <> ''").select("conv_id", "turn", "pos", "level", F.sha2("bare", 256).alias("h"), (F.char_length("bare") >= least).alias("long"))


def without_quotes(text: Column) -> Column:
    """The text without its quoted lines."""
    return F.array_join(F.filter(split_lines(text), lambda s: ~s.rlike(QUOTED)), "\n")


def quote_links(messages: DataFrame, ws: Workspace | None = None, least: int = LEAST) -> DataFrame:
    """Rows (conv_id, turn, pos, level, to_conv, to_turn): every quoted line that has an original."""
    lines = parsed_lines(messages, least).filter("conv_id is not null and turn is not null")
    ws = ws or Workspace(messages.sparkSession)
    lines = ws.put(lines, "lines")  # read by each join below
    own = ws.put(lines.filter("level = 0").groupBy("h", "conv_id", "long").agg(F.min("turn").alias("first")), "own")
    anywhere = ws.put(own.filter("long").groupBy("h").agg(F.min(F.struct("conv_id", "first")).alias("any")), "anywhere")
    own = own.select("h", "conv_id", "first")
    quoted = lines.filter("level > 0").join(own, ["h", "conv_id"], "left").join(anywhere, "h", "left")
    near = F.col("first") < F.col("turn")
    far = F.col("any.conv_id") != F.col("conv_id")
    # the smallest conversation with the line is the quoting one: its next one, one row per hash
    stuck = quoted.filter((F.col("first") >= F.col("turn")) & (F.col("any.conv_id") == F.col("conv_id"))).select("h", F.col("conv_id").alias("not")).distinct()
    later = own.join(stuck, "h").filter(F.col("conv_id") != F.col("not")).groupBy("h").agg(F.min(F.struct("conv_id", "first")).alias("next"))
    quoted = quoted.join(ws.put(later, "later"), "h", "left")
    return quoted.select(
        "conv_id", "turn", "pos", "level",
        F.when(near, F.col("conv_id")).when(far, F.col("any.conv_id")).otherwise(F.col("next.conv_id")).alias("to_conv"),
        F.when(near, F.col("first")).when(far, F.col("any.first")).otherwise(F.col("next.first")).alias("to_turn"),
    ).filter("to_turn is not null")


def parents(messages: DataFrame, ws: Workspace | None = None, least: int = LEAST) -> DataFrame:
    """One row per (conv_id, turn) with a linked quote: n_linked, parent_conv, parent_turn."""
    votes = quote_links(messages, ws, least).groupBy("conv_id", "turn", "to_conv", "to_turn").agg(
        F.count("*").alias("n"), F.sum((F.col("level") == 1).cast("long")).alias("n1")
    )
    best = F.min(F.struct(-F.col("n1"), -F.col("n"), F.col("to_conv") != F.col("conv_id"), "to_conv", "to_turn"))
    return votes.groupBy("conv_id", "turn").agg(F.sum("n").alias("n_linked"), best.alias("b")).select(
        "conv_id", "turn", "n_linked", F.col("b.to_conv").alias("parent_conv"), F.col("b.to_turn").alias("parent_turn")
    )


def reply_places(ws: Workspace, tree: DataFrame) -> DataFrame:
    """(conv_id, turn, depth, reply_pos) of a table (conv_id, turn, up) whose ``up`` is an earlier turn of the conversation or null."""
    order = numbered(tree.select("conv_id", "up", "turn"), ["conv_id", "up", "turn"])
    order = ws.put(order, "order")
    after = order.select("conv_id", F.col("up").alias("up2"), F.col("turn").alias("next"), (F.col("index") - 1).alias("index"))
    child = order.filter("up is not null").groupBy("conv_id", "up").agg(F.min("turn").alias("child")).withColumnRenamed("up", "turn")
    # events: a message is entered (out 0) and left (out 1)
    node = order.join(after, ["conv_id", "index"], "left").withColumn("next", F.when(F.col("up").eqNullSafe(F.col("up2")), F.col("next")))
    node = node.select("conv_id", "turn", "up", "next").join(child, ["conv_id", "turn"], "left")
    event = lambda turn, out: F.struct(turn.alias("turn"), F.lit(out).alias("out"))
    enter = F.when(F.col("child").isNotNull(), event(F.col("child"), 0)).otherwise(event(F.col("turn"), 1))
    leave = F.when(F.col("next").isNotNull(), event(F.col("next"), 0)).when(F.col("up").isNotNull(), event(F.col("up"), 1))
    step = lambda out, to, n, d: F.struct(F.lit(out).alias("out"), to.alias("to"), F.lit(n).cast("long").alias("n"), F.lit(d).cast("long").alias("d"))
    cur = node.select("conv_id", "turn", F.explode(F.array(step(0, enter, 1, 1), step(1, leave, 0, -1))).alias("x"))
    cur = ws.put(cur.select("conv_id", "turn", "x.*"), "tour-0")
    ws.drop("order")
    k = 0
    while not cur.filter("to is not null").isEmpty():  # n, d: messages entered and levels gained from here up to ``to``
        k += 1
        to = cur.select("conv_id", F.struct("turn", "out").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"), F.col("d").alias("d2"))
        going = cur.filter("to is not null").join(to, ["conv_id", "to"])
        going = going.select("conv_id", "turn", "out", F.col("to2").alias("to"), (F.col("n") + F.col("n2")).alias("n"), (F.col("d") + F.col("d2")).alias("d"))
        cur = ws.put(going.union(cur.filter("to is null").select("conv_id", "turn", "out", "to", "n", "d")), f"tour-{k}")
        ws.drop(f"tour-{k - 1}")
    entered = cur.filter("out = 0")
    count = ws.put(entered.groupBy("conv_id").agg(F.count("*").alias("all")), "counts")
    return entered.join(count, "conv_id").select("conv_id", "turn", (-F.col("d")).alias("depth"), (F.col("all") - F.col("n")).alias("reply_pos"))


def link_quotes(messages: DataFrame, least: int = LEAST) -> DataFrame:
    """Every message with its text without quotes, its parent, its depth and its place in the reply-ordered conversation.

    Needs columns conv_id, turn, role, text.  Sort by (conv_id, reply_pos) to read a conversation."""
    ws = Workspace(messages.sparkSession)
    base = messages.select("conv_id", "turn", "role", "text")
    linked = ws.put(parents(base, ws, least), "parents")
    ws.drop("lines", "own", "anywhere", "later")
    have = base.select("conv_id", "turn").filter("conv_id is not null and turn is not null").distinct()
    before = have.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("before"))
    tree = have.join(before, ["conv_id", "turn"], "left").join(linked, ["conv_id", "turn"], "left")
    up = F.when(F.col("parent_conv") == F.col("conv_id"), F.col("parent_turn")).when(F.col("before"), F.col("turn") - 1)
    tree = ws.put(tree.select("conv_id", "turn", "n_linked", "parent_conv", "parent_turn", up.alias("up")), "tree")
    places = ws.put(reply_places(ws, tree), "places")
    out = base.join(tree.join(places, ["conv_id", "turn"]), ["conv_id", "turn"], "left")
    levels = F.transform(split_lines(F.col("text")), _level)
    return out.select(
        "conv_id", "turn", "role", without_quotes(F.col("text")).alias("text"),
        F.coalesce(F.array_max(levels), F.lit(0)).cast("long").alias("max_level"),
        F.size(F.filter(levels, lambda x: x > 0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("parent_conv", F.when(F.col("up").isNotNull(), F.col("conv_id"))).alias("parent_conv"),
        F.coalesce("parent_turn", "up").alias("parent_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "reply_pos",
    )


def conversations(messages: DataFrame) -> DataFrame:
    """The reply-ordered conversations as rows (conv_id, reply_pos, depth, role, text), without quotes; messages without a place are left out."""
    return link_quotes(messages).filter("reply_pos is not null").select("conv_id", "reply_pos", "depth", "role", "text").orderBy("conv_id", "reply_pos")


def oracle(source: str = "conversations") -> str:
    """DuckDB: link_quotes with the text as sha256, over the rows of ``source``."""
    marks = r"^[ \t>]*"
    return rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM {source}),
l AS (SELECT rid, conv_id, turn, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM m),
p AS (SELECT *, length(regexp_extract(line, '{marks}')) - length(replace(regexp_extract(line, '{marks}'), '>', '')) AS level,
  trim(regexp_replace(translate(regexp_replace(line, '{marks}', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\x0b\x0c\r]+', ' ', 'g')) AS bare FROM l),
k AS (SELECT * FROM p WHERE length(bare) > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL),
own AS (SELECT bare, conv_id, min(turn) AS f FROM k WHERE level = 0 GROUP BY ALL),
anyw AS (SELECT bare, conv_id AS ac, f AS af, lead(conv_id) OVER o AS nc, lead(f) OVER o AS nf FROM own WINDOW o AS (PARTITION BY bare ORDER BY conv_id, f) QUALIFY row_number() OVER o = 1),
q AS (SELECT k.conv_id, k.turn, level, CASE WHEN f < k.turn THEN k.conv_id WHEN ac <> k.conv_id THEN ac ELSE nc END AS tc, CASE WHEN f < k.turn THEN f WHEN ac <> k.conv_id THEN af ELSE nf END AS tt
  FROM k LEFT JOIN own ON own.bare = k.bare AND own.conv_id = k.conv_id LEFT JOIN anyw ON anyw.bare = k.bare WHERE level > 0),
v AS (SELECT conv_id, turn, tc, tt, count(*) AS n, count(*) FILTER (WHERE level = 1) AS n1 FROM q WHERE tt IS NOT NULL GROUP BY ALL),
par AS (SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id, turn) AS n_linked, tc, tt FROM v
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n1 DESC, n DESC, tc <> conv_id, tc, tt) = 1),
have AS (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
tree AS (SELECT h.conv_id, h.turn, n_linked, tc, tt, CASE WHEN tc = h.conv_id THEN tt WHEN b.turn IS NOT NULL THEN h.turn - 1 END AS up
  FROM have h LEFT JOIN par USING (conv_id, turn) LEFT JOIN have b ON b.conv_id = h.conv_id AND b.turn = h.turn - 1),
dep AS (SELECT conv_id, turn, 0 AS depth, [turn] AS path FROM tree WHERE up IS NULL UNION ALL
  SELECT t.conv_id, t.turn, depth + 1, list_append(path, t.turn) FROM tree t JOIN dep ON dep.conv_id = t.conv_id AND dep.turn = t.up),
pos AS (SELECT conv_id, turn, depth, row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS reply_pos FROM dep),
txt AS (SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE level = 0), '') AS kept, max(level) AS ml, count(*) FILTER (WHERE level > 0) AS nq FROM p GROUP BY rid)
SELECT m.conv_id, m.turn, role, sha256(kept) AS text_sha256, ml::BIGINT AS max_level, nq::BIGINT AS n_quoted, coalesce(n_linked, 0)::BIGINT AS n_linked,
  coalesce(tc, CASE WHEN up IS NOT NULL THEN m.conv_id END) AS parent_conv, coalesce(tt, up) AS parent_turn, coalesce(depth, 0)::BIGINT AS depth, reply_pos
FROM m JOIN txt USING (rid) LEFT JOIN tree ON tree.conv_id = m.conv_id AND tree.turn = m.turn LEFT JOIN pos ON pos.conv_id = m.conv_id AND pos.turn = m.turn"""
