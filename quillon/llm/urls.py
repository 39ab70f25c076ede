"""URL filter: allow and block rules, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host, registered domain and
public suffix.  Each level gets a beta-binomial prior centred on its parent's
posterior mean; the prior's strength comes from the overdispersion of the
children's counts about their parent's rate (method of moments, closed form).
A host is blocked when the lower bound ``mean - z * sd`` of its posterior bad
rate exceeds ``max_bad``; a page whose host has no label takes the posterior of
its domain, suffix, or the whole table.

All of it is partial aggregation and equi-joins on keys that the aggregation has
made unique, so a host with a third of all pages is summed map-side first.

Cases: a null url, or one without ``://``, has an empty host and path, fits no
rule, and takes the verdict of the empty host; null outcomes count as
unlabelled, rows with a null id have no outcome; repeated rows count each; without
any label the rate is 1/2 and the prior is weakest, so nothing is blocked; very long
urls are taken apart in one pass, by splitting at dots; extra columns are ignored.  For domain and suffix a host's user
and port are left out; an address (of four numbers, or in brackets) is its own domain and its own suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, lower_ascii

#: (action, host/path) of the query's contract.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Second labels that make a public suffix of two labels under a country code.
SECOND = ("co", "com", "org", "net", "gov", "ac", "edu")
#: A host is blocked when more than this share of its pages is bad, at a posterior certainty of 95 %.
MAX_BAD, Z = 0.05, 1.645
RHO_LEAST, RHO_MOST = 0.001, 0.9
#: A page is bad when these symbols are more than BAD_SHARE of its text without tags; pages of fewer than LEAST_TEXT code points (0: none) have no outcome.
SYMBOLS, BAD_SHARE, LEAST_TEXT = "*%#$~^|{}=", 0.04, 200


def symbol_outcomes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", bad_share: float = BAD_SHARE, least_text: int = LEAST_TEXT) -> DataFrame:
    """Rows (id, bad) from the pages' own html: 1 where its text is strewn with symbols, 0 where not, null for short or null pages.

    A stand-in where nobody has labelled pages; ``filter_urls`` takes any labelled outcomes."""
    text = F.regexp_replace(html := F.col(html_col), "<[^>]*>", "")
    n = F.char_length(text)
    symbols = n - F.char_length(F.translate(text, SYMBOLS, ""))
    return pages.select(F.col(id_col), F.when(html.isNull() | (n < least_text), None).otherwise((symbols > n * bad_share).cast("int")).alias("bad"))


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without its user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def _is_address(name: Column) -> Column:
    return name.rlike(r"^([0-9]+[.]){3}[0-9]+$") | name.startswith("[")


def _labels(name: Column) -> tuple[Column, Column, Column]:
    """The name's last three labels, last first; null where there are fewer."""
    parts = F.split(name, "[.]", -1)
    return tuple(F.try_element_at(parts, F.lit(-k)) for k in (1, 2, 3))


def _two(last: Column, second: Column, suffixes: tuple[str, ...]) -> Column:
    pair = last.rlike("^[a-z][a-z]$") & second.isin(*SECOND)
    return F.coalesce(pair | F.concat_ws(".", second, last).isin(*suffixes) if suffixes else pair, F.lit(False))


def suffix_of(host: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """The last label, or the last two where they form a public suffix (by rule, or named in ``suffixes``, such as github.io); an address whole."""
    name = name_of(host)
    last, second, _ = _labels(name)
    return F.when(_is_address(name), name).when(_two(last, second, suffixes), F.concat_ws(".", second, last)).otherwise(last)


def domain_of(host: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """The suffix with the label before it; an address whole."""
    name = name_of(host)
    last, second, third = _labels(name)
    return F.when(_is_address(name), name).when(_two(last, second, suffixes), F.concat_ws(".", third, second, last)).otherwise(F.concat_ws(".", second, last))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; null where none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, p = r[: r.index("/")], r[r.index("/") :]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def _level(children: DataFrame, keys: list[str], parents: DataFrame, parent_keys: list[str]) -> DataFrame:
    """Posterior of every child around its parent's posterior mean.

    children: keys, n, k.  parents: parent_keys, pn, pk (raw counts), pm (posterior mean).
    """
    joined = children.join(parents, parent_keys) if parent_keys else children.crossJoin(F.broadcast(parents))  # one row
    p = (F.col("pk") + 0.5) / (F.col("pn") + 1.0)
    spread = joined.agg(
        F.sum((F.col("k") - F.col("n") * p) * (F.col("k") - F.col("n") * p) / (p * (1 - p))).alias("s"),
        F.sum("n").cast("double").alias("sn"),
        F.sum(F.col("n") * F.col("n")).cast("double").alias("sn2"),
    )
    raw = F.when(F.col("sn2") > F.col("sn"), (F.col("s") - F.col("sn")) / (F.col("sn2") - F.col("sn"))).otherwise(F.lit(RHO_MOST))
    rho = F.greatest(F.lit(RHO_LEAST), F.least(F.lit(RHO_MOST), F.coalesce(raw, F.lit(RHO_MOST))))
    strength = spread.select((1 / rho - 1).alias("strength"))
    return joined.crossJoin(F.broadcast(strength)).select(  # one row
        *keys,
        F.col("n").alias("pn"),
        F.col("k").alias("pk"),
        ((F.col("k") + F.col("strength") * F.col("pm")) / (F.col("n") + F.col("strength"))).alias("pm"),
        (F.col("n") + F.col("strength")).alias("mass"),
    )


def host_reputation(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", max_bad: float = MAX_BAD, z: float = Z, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Every host of ``pages`` (id, url): posterior bad rate, its lower bound, and the verdict.

    ``outcomes`` has (id, bad): one labelled outcome a row, bad 0 or 1.
    """
    seen = pages.select(F.col(id_col).alias("_id"), host_of(F.col("url")).alias("host"))
    lab = outcomes.select(F.col(id_col).alias("_id"), F.col("bad").cast("long").alias("bad")).filter("bad is not null")
    # an id's outcomes count for every host that it stands with, each once
    lab = lab.groupBy("_id").agg(F.count("*").alias("n"), F.sum("bad").alias("k"))
    got = seen.distinct().join(lab, "_id").groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    hosts = seen.select("host").distinct().join(got, "host", "left").na.fill(0, ["n", "k"])
    hosts = hosts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)})
    hosts = Workspace(pages.sparkSession).put(hosts, "hosts")  # read at each level
    total = lambda keys: hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pn"), F.coalesce(F.sum("k"), F.lit(0)).alias("pk"))
    whole = whole.withColumn("pm", (F.col("pk") + 0.5) / (F.col("pn") + 1.0))
    suffixes = _level(total(["suffix"]), ["suffix"], whole, []).drop("mass")
    domains = _level(total(["suffix", "domain"]), ["suffix", "domain"], suffixes, ["suffix"]).drop("mass")
    own = _level(hosts, ["host"], domains, ["suffix", "domain"])
    low = F.col("pm") - z * F.sqrt(F.col("pm") * (1 - F.col("pm")) / (F.col("mass") + 1))
    return own.select(
        "host", F.col("pn").alias("n_labelled"), F.col("pk").alias("n_bad"), F.col("pm").alias("bad_rate"), low.alias("bad_low")
    ).withColumn("host_verdict", F.when(F.col("bad_low") > max_bad, "block").otherwise("allow"))


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", max_bad: float = MAX_BAD, z: float = Z, suffixes: tuple[str, ...] = ()
) -> DataFrame:
    """Rows (id, host, path, rule, verdict): the longest fitting rule decides, else the host's reputation."""
    rep = host_reputation(pages, outcomes, id_col, max_bad, z, suffixes).select("host", "host_verdict")
    rows = pages.select(F.col(id_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, action = rule_columns(F.col("host"), F.col("path"), rules)
    return (
        rows.withColumns({"rule": rule, "_action": action})
        .join(rep, "host", "left")
        .select(id_col, "host", "path", "rule", F.coalesce("_action", "host_verdict", F.lit("allow")).alias("verdict"))
    )


def oracle() -> str:
    """The same filter, with ``symbol_outcomes``, as one DuckDB statement over pages."""
    host = "coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    path = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    rule = verdict = "NULL"
    for act, r in sorted(RULES, key=lambda x: (len(x[1]), x[1])):
        h, p = r[: r.index("/")], r[r.index("/") :]
        fits = f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
        rule, verdict = f"CASE WHEN {fits} THEN '{r}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{act}' ELSE {verdict} END"

    def level(name: str, keys: str, source: str, parent: str, using: str) -> str:
        join = f"JOIN {parent} USING ({using})" if using else f"CROSS JOIN {parent}"
        return f"""
{name}_j AS (SELECT c.*, pn, pk, pm, (pk + 0.5) / (pn + 1.0) AS p FROM {source} c {join}),
{name}_s AS (SELECT sum((k - n * p) * (k - n * p) / (p * (1 - p))) AS s, sum(n)::DOUBLE AS sn, sum(n * n)::DOUBLE AS sn2 FROM {name}_j),
{name}_t AS (SELECT 1 / greatest({RHO_LEAST}, least({RHO_MOST}, coalesce(CASE WHEN sn2 > sn THEN (s - sn) / (sn2 - sn) ELSE {RHO_MOST} END, {RHO_MOST}))) - 1 AS strength FROM {name}_s),
{name} AS (SELECT {keys}, n AS pn, k AS pk, (k + strength * pm) / (n + strength) AS pm, n + strength AS mass FROM {name}_j CROSS JOIN {name}_t)"""

    two = "(regexp_full_match(p[-1], '[a-z][a-z]') AND p[-2] IN (" + ", ".join(f"'{x}'" for x in SECOND) + "))"
    text = "regexp_replace(html, '<[^>]*>', '', 'g')"
    return f"""
WITH pg AS (SELECT page_id, {host} AS host, {path} AS path FROM pages),
lab AS (SELECT page_id, CASE WHEN html IS NULL OR length({text}) < {LEAST_TEXT} THEN NULL WHEN length({text}) - length(translate({text}, '{SYMBOLS}', '')) > length({text}) * {BAD_SHARE} THEN 1 ELSE 0 END AS bad FROM pages),
got AS (SELECT host, sum(n) AS n, sum(k) AS k FROM (SELECT DISTINCT page_id, host FROM pg) JOIN (SELECT page_id, count(*) AS n, sum(bad) AS k FROM lab WHERE bad IS NOT NULL GROUP BY 1) USING (page_id) GROUP BY host),
hosts AS (SELECT host, n, k, CASE WHEN address THEN name WHEN {two} THEN concat_ws('.', p[-3], p[-2], p[-1]) ELSE concat_ws('.', p[-2], p[-1]) END AS domain, CASE WHEN address THEN name WHEN {two} THEN concat_ws('.', p[-2], p[-1]) ELSE p[-1] END AS suffix
  FROM (SELECT host, name, regexp_full_match(name, '([0-9]+[.]){{3}}[0-9]+') OR starts_with(name, '[') AS address, string_split(name, '.') AS p, coalesce(n, 0)::DOUBLE AS n, coalesce(k, 0)::DOUBLE AS k
    FROM (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM pg) LEFT JOIN got USING (host))),
w AS (SELECT coalesce(sum(n), 0) AS pn, coalesce(sum(k), 0) AS pk, (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS pm FROM hosts),
sx AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1),
dm AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1, 2),
{level("lsx", "suffix", "sx", "w", "")},
{level("ldm", "suffix, domain", "dm", "lsx", "suffix")},
{level("lho", "host", "hosts", "ldm", "suffix, domain")},
rep AS (SELECT host, CASE WHEN pm - {Z} * sqrt(pm * (1 - pm) / (mass + 1)) > {MAX_BAD} THEN 'block' ELSE 'allow' END AS hv FROM lho)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, hv, 'allow') AS verdict FROM pg LEFT JOIN rep USING (host)"""
