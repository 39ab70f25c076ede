"""Mixing sources to target weights: iterative proportional fitting (DataFrame functions only).

Topics are learned from the texts: they are clusters of how texts are written, so
that every language can have each.  A document's profile counts, in thousandths of
its characters or words, digits, line breaks, punctuation and symbols, and takes
the length of its words and the share of different ones.  The cut points of every
measure are its ``CUTS`` quantiles over all documents; a mask has a bit for each cut
point that a document lies above.  k-modes over all masks (``TOPICS`` centres, first
the most frequent masks, then the majority of each bit, ``STEPS`` steps, in whole
numbers) gives every document the topic of its nearest centre.  The driver gets cut
points and centres only.

Tokens (words between blanks) are summed in cells of source, language and topic.
The cells' weights are raked: for each dimension in turn they are multiplied by
target share / present share, in spells of ``ROUNDS`` rounds until every
value's share is within ``TOLERANCE`` of its target (relative).  Targets that no
weights of the present cells can meet are reported by a ``RuntimeWarning`` with
the error that is left.  A cell's rate is its raked share over its natural share;
documents are kept with probability ``min(1, c * rate)``, where c is recomputed
until no further cell reaches 1, so that the expected tokens come to ``budget`` of
all tokens as far as the cap at 1 allows.  The draw is a hash of the id, so it
repeats exactly and needs no state.

Targets: a mapping value -> share, or an exponent e (share proportional to
natural share ** e).  Values outside a mapping get share 0 and are not kept.

The texts are read once; the columns asked for, with tokens and profiles, are
stored in the shared folder.  Only histograms, masks and cell totals are shuffled
(map-side sums first).  After a count of at most ``SMALL`` cells these are raked in
one partition without a shuffle and broadcast to the documents, else raked step by
step and joined; both ways give the same weights.

Cases: null source or language is a value of its own; documents without words
weigh nothing and take their cell's probability; a cell without words has rate 0;
rows with the same id share their fate; ties of words, masks and centres go to the
smaller one; very long texts are one array of words; an empty table stays empty;
extra columns pass through, and the operator's own get underscores in front where a
name is taken.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, Workspace, free_name

DIMS = ("source", "lang", "topic")
#: Exponents of the query: natural shares are evened out by source and topic, less by language.
TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
ROUNDS, BUDGET, SMALL = 5, 0.75, 100_000
#: Largest relative error of a marginal share; rounds after which raking is given up, at once if the error no longer falls over STALL spells.
TOLERANCE, MOST_ROUNDS, STALL = 1e-9, 500, 3
TOPICS, CUTS, STEPS = 3, (0.5, 0.9), 4
#: Characters that a profile counts.
COUNTED = {"digits": "0123456789", "breaks": "\n", "stops": ".,;:!?()\"'-", "symbols": "*%#$@/|<>=_+~^{}[]"}
MEASURES = [*COUNTED, "length", "variety"]
NONE = "\x00"


def words_of(text: Column) -> Column:
    """What stands between blanks."""
    return F.array_remove(F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)), "[\t-\r ]+", -1), "")


def profile(text: Column, words: Column) -> list[Column]:
    """The MEASURES of a text, whole numbers from 0 to 1000."""
    t = F.coalesce(text, F.lit(""))
    n, k = F.char_length(t), F.size(words)
    share = lambda part, of: F.when(of > 0, F.floor(part.cast("long") * 1000 / of)).otherwise(0).cast("int")
    counted = [share(n - F.char_length(F.translate(t, chars, "")), n).alias(m) for m, chars in COUNTED.items()]
    length = F.when(k > 0, F.least(F.floor(n.cast("long") * 10 / k), F.lit(1000))).otherwise(0).cast("int")
    return [*counted, length.alias("length"), share(F.size(F.array_distinct(words)), k).alias("variety")]


def cut_points(rows: DataFrame) -> dict[str, list[int]]:
    """Of every measure the smallest values up to which each share of CUTS of all rows lies, from histograms of at most 1001 values."""
    each = F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("v")) for m in MEASURES])
    got = rows.select(F.explode(each).alias("x")).groupBy("x.m", "x.v").agg(F.count("*").alias("n")).collect()
    out = {}
    for m in MEASURES:
        held = sorted((r["v"], r["n"]) for r in got if r["m"] == m)
        total, below, cuts = sum(n for _, n in held), 0, []
        for v, n in held:
            below += n
            cuts += [v for q in CUTS[len(cuts) :] if below >= math.ceil(q * total)]
        out[m] = cuts or [0] * len(CUTS)
    return out


def mask_of(cuts: dict[str, list[int]]) -> Column:
    """A bit for each cut point that the row's measure lies above."""
    bits = [F.when(F.col(m) > v, F.lit(1 << (len(CUTS) * i + j))).otherwise(0) for i, m in enumerate(MEASURES) for j, v in enumerate(cuts[m])]
    return sum(bits[1:], bits[0]).cast("long")


def nearest(mask: Column, centres: list[int]) -> Column:
    """Index of the centre with the fewest different bits, the first one on ties."""
    far = [F.bit_count(mask.bitwiseXOR(F.lit(c).cast("long"))) for c in centres]
    return F.array_position(F.array(*far), F.least(*far) if len(far) > 1 else far[0]).cast("int") - 1


def topic_centres(masks: DataFrame, bits: int) -> list[int]:
    """k-modes over rows (mask, n)."""
    centres = [r["mask"] for r in masks.orderBy(F.desc("n"), "mask").limit(TOPICS).collect()] or [0]
    for _ in range(STEPS):
        each = masks.groupBy(nearest(F.col("mask"), centres).alias("k")).agg(
            F.sum("n").alias("all"), *[F.sum(F.shiftright("mask", i).bitwiseAND(F.lit(1)) * F.col("n")).alias(f"b{i}") for i in range(bits)]
        )
        new = list(centres)
        for r in each.collect():  # a row a topic
            new[r["k"]] = sum(1 << i for i in range(bits) if 2 * r[f"b{i}"] > r["all"])
        if new == centres:
            break
        centres = new
    return centres


def draw(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    text = F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("")), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def raked_cells(ws: Workspace, rows: DataFrame, targets: dict[str, dict | float], rounds: int = ROUNDS) -> DataFrame:
    """Cells (source, lang, topic, tok, w): natural tokens, and shares that fit the targets."""
    cells = rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tok")).filter("tok > 0")
    cells = ws.put(cells.withColumn("w", F.col("tok").cast("double")), "cells")
    small = cells.count() <= SMALL
    if small:
        cells = cells.coalesce(1)
    for d in DIMS:
        nat = cells.groupBy(d).agg(F.sum("tok").cast("double").alias("t"))
        t = targets[d]
        if isinstance(t, dict):
            share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in t.items() for x in (kv[0], float(kv[1]))]), F.col(d)), F.lit(0.0))
        else:
            share = F.pow("t", F.lit(float(t)))
        nat = nat.select(d, share.alias("x"))
        whole = nat.agg(F.sum("x").alias("all"))
        nat = nat.crossJoin(F.broadcast(whole)).select(d, (F.col("x") / F.col("all")).alias(f"share_{d}"))  # one row
        cells = ws.put(cells.join(nat, d), f"cells-{d}")
        cells = cells.coalesce(1) if small else cells
    last, errors, k = "", [], 0
    shown = ["tok", "w", *[f"share_{d}" for d in DIMS]]
    while k < MOST_ROUNDS:
        for _ in range(rounds):
            for d in DIMS:
                if small:  # the whole table is one bounded partition
                    now = F.sum("w").over(Window.partitionBy(d))
                    cells = cells.withColumn("w", F.when(now > 0, F.col("w") * F.col(f"share_{d}") / now).otherwise(0.0))
                    continue
                now = cells.groupBy(d).agg(F.sum("w").alias("now"))
                step = cells.join(now, d).withColumn("w", F.when(F.col("now") > 0, F.col("w") * F.col(f"share_{d}") / F.col("now")).otherwise(0.0))
                cells, old, last = ws.put(step.select(*DIMS, *shown), f"raked-{k}-{d}"), last, f"raked-{k}-{d}"
                ws.drop(old) if old else None
            k += 1
        if small:
            cells, old, last = ws.put(cells.select(*DIMS, *shown), f"raked-{k}").coalesce(1), last, f"raked-{k}"
            ws.drop(old) if old else None
        errors.append(marginal_error(cells))
        if errors[-1] <= TOLERANCE:
            return cells
        if len(errors) > STALL and errors[-1] > 0.9999 * errors[-1 - STALL]:
            break
    warnings.warn(f"raking: after {k} rounds a share is still {errors[-1]:.3g} (relative) off its target", RuntimeWarning, stacklevel=2)
    return cells


def marginal_error(cells: DataFrame) -> float:
    """The largest relative difference of a value's share from its target."""
    off = None
    for d in DIMS:
        now = cells.groupBy(d).agg(F.sum("w").alias("now"), F.first(f"share_{d}").alias("share"))
        now = now.select(F.when(F.col("share") > 0, F.abs(F.col("now") - F.col("share")) / F.col("share")).otherwise(F.col("now")).alias("e"))
        off = now if off is None else off.union(now)
    return off.agg(F.coalesce(F.max("e"), F.lit(0.0))).first()[0]


def cell_probabilities(ws: Workspace, cells: DataFrame, budget: float) -> DataFrame:
    """Cells with rate, and p = min(1, c * rate)."""
    whole = cells.agg(F.sum("tok").cast("double").alias("all"))
    out = cells.crossJoin(F.broadcast(whole)).select(*DIMS, "tok", "all", (F.col("w") * F.col("all") / F.col("tok")).alias("rate"))
    out, c, at_cap = ws.put(out, "caps"), float(budget), -1
    while True:  # c only grows: each pass caps at least one more cell or is the last
        full = F.lit(c) * F.col("rate") >= 1
        s = out.agg(
            F.count(F.when(full, 1)).alias("n"), F.max("all").alias("all"),
            F.coalesce(F.sum(F.when(full, F.col("tok"))).cast("double"), F.lit(0.0)).alias("at1"), F.sum(F.when(~full, F.col("tok") * F.col("rate"))).alias("rest"),
        ).first()
        if s["n"] == at_cap or not s["rest"]:
            break
        at_cap, c = s["n"], max(c, (budget * s["all"] - s["at1"]) / s["rest"])
    return out.select(*DIMS, "rate", F.least(F.lit(1.0), F.lit(c) * F.col("rate")).alias("p"))


def mix(
    docs: DataFrame,
    targets: dict[str, dict | float] = TARGETS,
    budget: float = BUDGET,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = ROUNDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with n_tokens, topic, rate, p and kept."""
    ws = Workspace(docs.sparkSession)
    names = docs.columns if keep is None else keep
    words = words_of(docs[text_col])
    rows = docs.select(
        *[docs[c].alias(f"c{i}") for i, c in enumerate(names)], docs[id_col].alias("id"),
        F.coalesce(docs["source"], F.lit(NONE)).alias("source"), F.coalesce(docs["lang"], F.lit(NONE)).alias("lang"),
        F.size(words).cast("long").alias("tokens"), *profile(docs[text_col], words),
    )
    rows = ws.put(rows, "rows")
    rows = rows.withColumn("mask", mask_of(cut_points(rows)))
    masks = ws.put(rows.groupBy("mask").agg(F.count("*").alias("n")), "masks")
    rows = rows.withColumn("topic", F.concat(F.lit("t"), nearest(F.col("mask"), topic_centres(masks, len(CUTS) * len(MEASURES))).cast("string")))
    cells = ws.put(cell_probabilities(ws, raked_cells(ws, rows, targets, rounds), budget), "rates")
    small = cells.count() <= SMALL
    out = rows.join(F.broadcast(cells) if small else cells, list(DIMS), "left")
    p = F.coalesce("p", F.lit(0.0))
    own = {
        "n_tokens": F.col("tokens"), "topic": F.col("topic"), "rate": F.round(F.coalesce("rate", F.lit(0.0)), 6), "p": F.round(p, 6),
        "kept": draw(F.col("id"), seed) < p,
    }
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *[c.alias(free_name(n, names)) for n, c in own.items()])


#: Rounds and cap passes of the SQL: more than either engine needs on tables that it is run on.
SQL_ROUNDS, SQL_CAPS = 40, 6


def oracle(seed: int = 7) -> str:
    """DuckDB: doc_id, n_tokens, topic, rate, p, kept with the query's targets."""
    bits = range(len(CUTS) * len(MEASURES))
    quoted = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    counted = ", ".join(f"CASE WHEN length(t) > 0 THEN (length(t) - length(translate(t, {quoted(c)}, ''))) * 1000 // length(t) ELSE 0 END AS {m}" for m, c in COUNTED.items())
    mask = " + ".join(f"CASE WHEN {m} > {m}_{j} THEN {1 << (len(CUTS) * i + j)} ELSE 0 END" for i, m in enumerate(MEASURES) for j in range(len(CUTS)))
    near = lambda k: f"list_position([bit_count(xor(mask, c)) for c in (SELECT cs FROM z{k})], list_min([bit_count(xor(mask, c)) for c in (SELECT cs FROM z{k})])) - 1"
    ctes = [
        r"""f0 AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(0)) AS source, coalesce(lang, chr(0)) AS lang, coalesce(text, '') AS t,
  list_filter(string_split_regex(trim(coalesce(text, ''), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '[\t-\r ]+'), lambda x: x <> '') AS ws FROM documents)""",
        "g AS MATERIALIZED (SELECT rid, doc_id, source, lang, len(ws) AS tokens, length(t) AS n, " + counted + ", CASE WHEN len(ws) > 0 THEN least(length(t) * 10 // len(ws), 1000) ELSE 0 END AS length, CASE WHEN len(ws) > 0 THEN len(list_distinct(ws)) * 1000 // len(ws) ELSE 0 END AS variety FROM f0)",
        "cp AS MATERIALIZED (SELECT " + ", ".join(f"coalesce(quantile_disc({m}, {q}), 0) AS {m}_{j}" for m in MEASURES for j, q in enumerate(CUTS)) + " FROM g)",
        f"fm AS MATERIALIZED (SELECT rid, doc_id, source, lang, tokens, ({mask})::BIGINT AS mask FROM g CROSS JOIN cp)",
        "ms AS MATERIALIZED (SELECT mask, count(*) AS n FROM fm GROUP BY 1)",
        f"z0 AS MATERIALIZED (SELECT list(mask ORDER BY n DESC, mask) AS cs FROM (SELECT * FROM ms ORDER BY n DESC, mask LIMIT {TOPICS}))",
    ]
    for k in range(STEPS):
        major = " + ".join(f"CASE WHEN 2 * sum(n * ((mask >> {i}) & 1)) > sum(n) THEN {1 << i} ELSE 0 END" for i in bits)
        ctes.append(f"a{k} AS MATERIALIZED (SELECT k, ({major})::BIGINT AS c FROM (SELECT mask, n, {near(k)} AS k FROM ms) GROUP BY k)")
        ctes.append(f"z{k + 1} AS MATERIALIZED (SELECT list(coalesce(c, cs[j + 1]) ORDER BY j) AS cs FROM (SELECT cs, unnest(range(len(cs))) AS j FROM z{k}) LEFT JOIN a{k} ON k = j)")
    ctes.append(f"f AS MATERIALIZED (SELECT doc_id, source, lang, tokens, 't' || ({near(STEPS)}) AS topic FROM fm)")
    ctes.append("c0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens) AS tok, sum(tokens)::DOUBLE AS w FROM f GROUP BY ALL HAVING sum(tokens) > 0)")
    for d in DIMS:
        ctes.append(f"t_{d} AS MATERIALIZED (SELECT {d}, x / sum(x) OVER () AS share FROM (SELECT {d}, pow(sum(tok)::DOUBLE, {TARGETS[d]}) AS x FROM c0 GROUP BY 1))")
    k = 0
    for _ in range(SQL_ROUNDS):
        for d in DIMS:
            ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, tok, w * share / sum(w) OVER (PARTITION BY c.{d}) AS w FROM c{k} c JOIN t_{d} t ON t.{d} = c.{d})")
            k += 1
    ctes.append(f"p0 AS MATERIALIZED (SELECT source, lang, topic, tok, sum(tok) OVER ()::DOUBLE AS total, w * (sum(tok) OVER ())::DOUBLE / tok AS rate, {BUDGET}::DOUBLE AS c FROM c{k})")
    for i in range(SQL_CAPS):
        at1 = "coalesce((SELECT sum(tok)::DOUBLE FROM p{0} WHERE c * rate >= 1), 0)".format(i)
        rest = "(SELECT sum(tok * rate) FROM p{0} WHERE c * rate < 1)".format(i)
        ctes.append(f"p{i + 1} AS MATERIALIZED (SELECT source, lang, topic, tok, total, rate, CASE WHEN {rest} > 0 THEN greatest(c, ({BUDGET} * total - {at1}) / {rest}) ELSE c END AS c FROM p{i})")
    u = f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{seed}'), 1, 8))::BIGINT / 4294967296.0"
    return f"""WITH {", ".join(ctes)}
SELECT doc_id, tokens::BIGINT AS n_tokens, f.topic, round(coalesce(rate, 0), 6) AS rate, round(least(1.0, coalesce(c * rate, 0)), 6) AS p, {u} < least(1.0, coalesce(c * rate, 0)) AS kept
FROM f LEFT JOIN p{SQL_CAPS} p ON p.source = f.source AND p.lang = f.lang AND p.topic = f.topic"""
