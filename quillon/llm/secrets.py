"""Secret scan: pattern spans, then corpus-wide ownership of the values (DataFrame functions only).

Three base kinds are found in every whole text (``assign``, ``access``, ``hex``).
Further candidates are long unbroken tokens with letters, digits and at least
``VARIETY`` different characters that touch no base span.  All candidate values are hashed and counted by distinct repositories
and owners over the whole corpus.  A value that ``copied_owners`` owners or more
share, or ``copied_repos`` repositories or more of any owners, is a widely copied
example; a candidate that at most ``most_owners`` owners hold and that is no such
example looks live and is added as a span of kind ``live``.  Base spans always
stay; ``n_copied`` counts those whose value is a copied example, ``n_live`` those
that look live.

One pass over the texts writes the matches (lengths and values) to the shared
folder; the rest works on that small table: offsets are running sums of lengths in
a window over a text's matches, and a candidate's distance to the base spans is
told by a running maximum and minimum, so work grows as n log n in the matches of
a text.  Counting goes value and owner and repository -> value and owner -> value,
each summed map-side, so a value held by a third of all documents never meets in
one task.

Cases: a null text counts as empty; null owners and repositories are one owner
and repository each; identical rows get identical results; very long texts are
searched whole; ties (spans with one start) are ordered by kind; extra columns are
ignored; offsets are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace
from .lines import row_key

# The patterns of the base kinds, in their order.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
#: name, pattern, group of the value, least length of the value.  hex states its
#: least length in the pattern: a run of 32 is found whole or not at all.
KINDS = [("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32)]
TOKEN = r"[A-Za-z0-9_-]{24,}"
NAMES = [k[0] for k in KINDS] + ["live"]
MOST_OWNERS, COPIED_OWNERS, COPIED_REPOS = 1, 3, 10
#: Fewest different characters of a live-looking token: words and filler have few.
VARIETY = 10
_MATCHES = "array<struct<gap:int,size:int,value:string>>"


def matches(text: Column, pattern: str, group: int) -> Column:
    """Left to right matches as structs: code points since the match before, code points of the match, value."""
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("m"), values.alias("value"))
    out = F.transform(F.filter(zipped, lambda x: x["m"].isNotNull()), lambda x: F.struct(x["gap"].alias("gap"), F.char_length(x["m"]).alias("size"), x["value"].alias("value")))
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast(_MATCHES))


def spans(found: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (r1, r2, start, kind, end, value) of the match columns of ``found``, one for each kind; equal rows once."""
    def numbered(k: int, c: str) -> Column:
        return F.transform(c, lambda m, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), m["gap"].alias("gap"), m["size"].alias("size"), m["value"].alias("value")))

    each = F.concat(*[numbered(k, c) for k, c in enumerate(columns)])
    rows = found.select("r1", "r2", F.explode(each).alias("x")).select("r1", "r2", "x.*").distinct()
    so_far = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("r1", "r2", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return rows.withColumn("end", so_far).select("r1", "r2", (F.col("end") - F.col("size")).alias("start"), "kind", "end", "value")


def _joined(arr: Column) -> Column:
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(F.array_sort(arr), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan_secrets(
    docs: DataFrame,
    owner_col: str,
    repo_col: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_owners: int = MOST_OWNERS,
    copied_owners: int = COPIED_OWNERS,
    copied_repos: int = COPIED_REPOS,
) -> DataFrame:
    """One row per document: (id, base, live, n_copied, n_live), spans as (start, kind, end, value, owners, repos)."""
    ws = Workspace(docs.sparkSession)
    text = F.coalesce(docs[text_col], F.lit(""))
    r1, r2 = row_key(docs[id_col], docs[text_col])
    rows = docs.select(docs[id_col].alias("id"), r1.alias("r1"), r2.alias("r2"), docs[owner_col].alias("owner"), docs[repo_col].alias("repo"), text.alias("text"))
    n = len(KINDS)
    patterns = [*[(p, g) for _, p, g, _ in KINDS], (TOKEN, 0)]
    found = rows.select("id", "r1", "r2", "owner", "repo", *[matches(F.col("text"), p, g).alias(f"m{i}") for i, (p, g) in enumerate(patterns)])
    found = ws.put(found, "found")
    names = [f"m{i}" for i in range(n + 1)]
    kind, value = F.col("kind"), F.col("value")
    least = F.get(F.array(*[F.lit(x) for *_, x in KINDS], F.lit(0)), kind)
    some = spans(found.filter(" or ".join(f"size({c}) > 0" for c in names)), names).filter(F.char_length("value") >= least)
    some = some.filter((kind < n) | (value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= VARIETY)))
    text_of = Window.partitionBy("r1", "r2")
    base = kind < n
    # both frames only grow: one pass each
    behind = F.max(F.when(base, F.col("end"))).over(text_of.orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(base, F.col("start"))).over(text_of.orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1))
    some = some.withColumns({"behind": behind, "ahead": ahead})
    touches = (F.coalesce("behind", F.lit(0)) > F.col("start")) | (F.coalesce("ahead", F.col("end")) < F.col("end"))
    some = ws.put(some.filter(base | ~touches).drop("behind", "ahead"), "spans")
    owners = found.select("r1", "r2", "owner", "repo").distinct()
    each = some.join(owners, ["r1", "r2"]).select("r1", "r2", "owner", "repo", F.struct("start", "kind", "end", "value").alias("s"))
    each = each.withColumns({"v1": F.xxhash64("s.value"), "v2": F.xxhash64(F.lit("value"), "s.value")})
    count = (
        each.select("v1", "v2", "owner", "repo").distinct()
        .groupBy("v1", "v2", "owner").agg(F.count("*").alias("repos"))
        .groupBy("v1", "v2").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    )
    count = ws.put(count, "owned")
    own = some.withColumns({"v1": F.xxhash64("value"), "v2": F.xxhash64(F.lit("value"), "value")})
    judged = own.join(count, ["v1", "v2"]).select("r1", "r2", F.struct("start", "kind", "end", "value", "owners", "repos").alias("s"))
    by_row = ws.put(judged.groupBy("r1", "r2").agg(F.collect_list("s").alias("all")), "by-row")
    empty = "array<struct<start:int,kind:int,end:int,value:string,owners:bigint,repos:bigint>>"
    every = F.coalesce("all", F.array().cast(empty))
    copied = lambda s: (s["owners"] >= copied_owners) | (s["repos"] >= copied_repos)
    live = lambda s: (s["owners"] <= most_owners) & ~copied(s)
    number = lambda test: F.size(F.filter(every, lambda s: (s["kind"] < n) & test(s))).cast("long")
    return found.select("id", "r1", "r2").join(by_row, ["r1", "r2"], "left").select(
        F.col("id").alias(id_col),
        F.filter(every, lambda s: s["kind"] < n).alias("base"),
        F.filter(every, lambda s: (s["kind"] == n) & live(s)).alias("live"),
        number(copied).alias("n_copied"),
        number(live).alias("n_live"),
    )


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text."""
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        id_col,
        *[count(i).alias(f"n_{name}") for i, (name, *_) in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "live")).alias("spans"),
        "n_copied",
        "n_live",
    )


def oracle() -> str:
    """DuckDB, for owner = source and repository = doc_id."""
    q = lambda p: p.replace("'", "''")

    def kind(i: int, p: str, group: int, least: int) -> str:
        return f"""
m{i} AS (SELECT rid, unnest(range(1, len(m) + 1)) AS i, m, p, v FROM (SELECT rid, regexp_extract_all(t, '{q(p)}', 0) AS m,
  regexp_extract_all(t, '{q(p)}', {group}) AS v, string_split_regex(t, '{q(p)}') AS p FROM d)),
s{i} AS (SELECT rid, {i} AS kind, st, st + length(m[i]) AS en, v[i] AS value FROM (SELECT *, (list_sum(list_transform(p[1:i], lambda x: length(x)))
  + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS st FROM m{i}) WHERE length(v[i]) >= {least})"""

    parts = ",".join(kind(i, p, g, least) for i, (_, p, g, least) in enumerate([*KINDS, ("live", TOKEN, 0, 24)]))
    n = len(KINDS)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{name}" for i, (name, *_) in enumerate(KINDS))
    out = ", ".join(f"coalesce(n_{name}, 0)::BIGINT AS n_{name}" for name, *_ in KINDS)
    label = "[" + ", ".join(f"'{x}'" for x in NAMES) + "][kind + 1] || ':' || st || ':' || en"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS t FROM documents),{parts},
base AS ({" UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(n))}),
other AS (SELECT * FROM s{n} g WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= {VARIETY}
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = g.rid AND b.st < g.en AND b.en > g.st)),
everything AS (SELECT * FROM base UNION ALL SELECT * FROM other),
owned AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT (coalesce(source, chr(0)), coalesce(doc_id::VARCHAR, chr(0)))) AS repos FROM everything JOIN d USING (rid) GROUP BY value),
spans AS (SELECT e.*, owners >= {COPIED_OWNERS} OR repos >= {COPIED_REPOS} AS copied, owners <= {MOST_OWNERS} AND repos < {COPIED_REPOS} AND owners < {COPIED_OWNERS} AS live FROM everything e JOIN owned USING (value)),
kept AS (SELECT * FROM spans WHERE kind < {n} OR live),
g AS (SELECT rid, {counts}, string_agg({label}, ',' ORDER BY st, kind, en) FILTER (WHERE kind < {n}) AS b, string_agg({label}, ',' ORDER BY st, kind, en) AS s,
  count(*) FILTER (WHERE kind < {n} AND copied) AS n_copied, count(*) FILTER (WHERE kind < {n} AND live) AS n_live FROM kept GROUP BY rid)
SELECT doc_id, {out}, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans, coalesce(n_copied, 0)::BIGINT AS n_copied, coalesce(n_live, 0)::BIGINT AS n_live FROM d LEFT JOIN g USING (rid)"""
