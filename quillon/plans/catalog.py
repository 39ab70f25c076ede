"""Registered queries over the driver's tables, and the SQL that checks them.

``SHARED`` holds statements both engines read; the functions below use the
DataFrame operators of this package and are held against SQL in ``ORACLES``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ldsc, mr, mr_robust, munge, odds, partitioned, stats
from ..operators import frames, intervals, ld
from ..sources import formats, sinks, store
from ..sources.lake import Lake, latest, search
from . import catalog_files
from .registry import Engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SHARED = {
    "scan_project_filter": "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS q2 FROM {lineitem} WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag IN ('A', 'R') AND l_shipdate IS NOT NULL",
    "cast_case": "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS price, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band FROM {orders}",
    "order_limit_offset": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5",
    "topk": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50",
    "join_inner_2way": "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "join_inner_3way": "SELECT r_name, n_name, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n_orders FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey",
    "join_right": "SELECT n_name, count(s_suppkey) AS n FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_name",
    "join_full": "SELECT coalesce(c_nationkey, s_nationkey) AS nation, nc, ns FROM (SELECT c_nationkey, count(*) AS nc FROM {customer} WHERE c_acctbal > 5000 GROUP BY c_nationkey) x FULL JOIN (SELECT s_nationkey, count(*) AS ns FROM {supplier} GROUP BY s_nationkey) y ON c_nationkey = s_nationkey",
    "join_semi": "SELECT c_custkey, c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "join_anti": "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)",
    "in_subquery": "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 49)",
    "join_cross_small": "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}",
    "join_theta": "SELECT a.n_name AS a, b.n_name AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey <> b.n_nationkey",
    "agg_hash": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
    "agg_moments": "SELECT l_returnflag, round(var_samp(l_quantity), 6) AS v, round(stddev_pop(l_quantity), 6) AS s, round(corr(l_quantity, l_extendedprice), 8) AS r, round(covar_samp(l_quantity, l_discount), 8) AS c, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM {lineitem} GROUP BY l_returnflag",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_supp, count(DISTINCT l_partkey) AS n_part FROM {lineitem} GROUP BY l_returnflag",
    "agg_filter_having": "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n_r, count(*) AS n FROM {lineitem} GROUP BY l_suppkey HAVING count(*) FILTER (WHERE l_returnflag = 'R') > 10",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "rollup": "SELECT r_name, n_name, count(*) AS n FROM {nation} JOIN {region} ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "bool_bit_aggregates": "SELECT o_orderstatus, bool_and(o_totalprice > 0) AS b_all, bool_or(o_totalprice > 400000) AS b_any, bit_xor(o_orderkey) AS x FROM {orders} GROUP BY o_orderstatus",
    "first_last_by_order": "SELECT o_custkey, min_by(o_orderkey, o_orderdate) AS first_order, max_by(o_orderkey, o_orderdate) AS last_order FROM (SELECT o_custkey, o_orderkey, o_orderdate, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS c FROM {orders}) WHERE c = 1 GROUP BY o_custkey",
    "window_rank": "SELECT o_orderkey, row_number() OVER w AS rn, CAST(rank() OVER w AS BIGINT) AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd, ntile(4) OVER w AS nt FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)",
    "window_lag_lead": "SELECT event_id, lag(value) OVER w AS prev, lead(value, 2, 0.0) OVER w AS next2, first_value(value) OVER w AS f, nth_value(value, 2) OVER w AS n2 FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "window_rows_frame": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS s FROM {events}",
    "window_range_frame": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS n FROM {orders}",
    "union_all": "SELECT c_name AS name, c_acctbal AS bal FROM {customer} UNION ALL SELECT s_name, s_acctbal FROM {supplier}",
    "intersect_distinct": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}",
    "except_distinct": "SELECT o_custkey AS k FROM {orders} EXCEPT SELECT c_custkey FROM {customer} WHERE c_acctbal > 0",
    "cte_correlated": "WITH t AS (SELECT o_custkey, o_orderkey, o_totalprice FROM {orders}) SELECT o_orderkey FROM t x WHERE o_totalprice > (SELECT avg(o_totalprice) FROM t y WHERE y.o_custkey = x.o_custkey)",
    "scalar_subquery_values": "SELECT n_name, v.label FROM {nation} JOIN (VALUES (0, 'zero'), (1, 'one'), (2, 'two')) AS v(k, label) ON n_regionkey = v.k WHERE n_nationkey < (SELECT max(n_nationkey) FROM {nation})",
    "string_functions": "SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, substring(p_type, 1, 4) AS s, replace(p_brand, 'Brand', 'B') AS b, concat(p_brand, '-', p_type) AS c, trim(p_name) AS t, p_name LIKE '%a%' AS has_a FROM {part}",
    "math_functions": "SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_extendedprice) AS BIGINT) AS c, round(sqrt(l_quantity), 9) AS q, round(ln(l_extendedprice), 9) AS l, CAST(l_orderkey % 7 AS BIGINT) AS m FROM {lineitem}",
    "conditional_functions": "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'open') AS s, greatest(o_totalprice, 1000.0) AS g, least(o_totalprice, 1000.0) AS l FROM {orders}",
    "append_union_cast": "SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_totalprice AS DOUBLE) AS v FROM {orders} WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey % 2 <> 0",
    "munge_filter": "SELECT doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM {documents} WHERE n_chars BETWEEN 200 AND 20000) WHERE rn = 1",
    "struct_access": "SELECT s.k AS k, s.name AS name FROM (SELECT {{struct}} AS s FROM {nation})",
    "date_functions": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS mon FROM {orders}",
    "array_unnest": "SELECT vec_id, {{explode}} FROM {embeddings}",
    "regex_functions": "SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, {{rlike}} AS is_html FROM {pages}",
    "array_string_agg": "SELECT c_nationkey, {{keys}} AS keys, string_agg(c_mktsegment, '|' {{within}} AS segments FROM {customer} GROUP BY c_nationkey",
    "lateral_top": "SELECT c_custkey, t.top AS top, t.n AS n FROM {customer}, LATERAL (SELECT max(o_totalprice) AS top, count(*) AS n FROM {orders} WHERE o_custkey = c_custkey) t",
    "approx_percentile_names": "SELECT l_suppkey, {{approx}} AS med, {{var}} AS v FROM {lineitem} GROUP BY l_suppkey",
    "field_and_place": "SELECT vec_id, {{field}} AS label, {{place}} AS first, {{length}} AS n FROM (SELECT vec_id, embedding, {{inner}} AS s FROM {embeddings})",
    "json_extract": "SELECT event_id, {{json}} AS v FROM {events}",
}
#: What differs between the dialects: (Spark, DuckDB).
DIALECT = {
    "struct": ("named_struct('k', n_nationkey, 'name', n_name)", "{'k': n_nationkey, 'name': n_name}"),
    "explode": ("posexplode(embedding) AS (pos, x)", "unnest(range(0, len(embedding)))::INT AS pos, unnest(embedding) AS x"),
    "rlike": ("url RLIKE '[.]html'", "regexp_matches(url, '[.]html')"),
    "keys": ("array_join(array_sort(array_agg(c_custkey)), ',')", "array_to_string(list_sort(array_agg(c_custkey)), ',')"),
    "within": (") WITHIN GROUP (ORDER BY c_custkey)", "ORDER BY c_custkey)"),
    "approx": ("approx_percentile_cont(l_quantity, 0.5)", "quantile_disc(l_quantity, 0.5)"),
    "var": ("round(var(l_quantity), 6)", "round(var_samp(l_quantity), 6)"),
    "field": ("get_field(s, 'label')", "s.label"), "place": ("embedding[1]", "embedding[1]"), "length": ("array_length(embedding)", "len(embedding)::INT"),
    "inner": ("named_struct('label', label)", "{'label': label}"),
    "json": ("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"),
}


_TABLE = r"(?<!\{)\{(\w+)\}(?!\})"


def _said(sql: str, engine: int) -> str:
    return re.sub(r"\{\{(\w+)\}\}", lambda m: DIALECT[m[1]][engine], sql)


def _spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The statement as a workflow: a source node for each table, and one SQL node."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = _said(SHARED[name], 0)
        e = Engine(spark)
        tables = sorted(set(re.findall(_TABLE, sql)))
        for t in tables:
            e.add(t, "source", {"path": f"{sf_dir}/{t}.parquet"})
        e.add("out", "sql", {"sql_query": re.sub(_TABLE, lambda m: f"port_{tables.index(m[1])}", sql)})
        for k, t in enumerate(tables):
            e.connect(t, "out", 0, k)
        report = e.run()
        if bad := next((r for r in report.nodes.values() if r.error), None):
            raise RuntimeError(f"{name}, {bad.id}: {bad.error['message']}")
        return e.output("out")

    run.__name__ = name
    return run


def _duck_sql(name: str) -> str:
    return _said(re.sub(_TABLE, r"\1", SHARED[name]), 1)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources, a join and aggregate in SQL, run as a workflow graph."""
    e = Engine(spark)
    e.add("orders", "source", {"path": f"{sf_dir}/orders.parquet"})
    e.add("lines", "source", {"path": f"{sf_dir}/lineitem.parquet"})
    e.add("revenue", "sql", {"sql_query": "SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM port_0 JOIN port_1 ON o_orderkey = l_orderkey GROUP BY o_orderpriority"})
    e.add("out", "echo")
    e.connect("orders", "revenue", 0, 0)
    e.connect("lines", "revenue", 0, 1)
    e.connect("revenue", "out")
    report = e.run()
    if bad := next((r for r in report.nodes.values() if r.error), None):
        raise RuntimeError(f"{bad.id}: {bad.error['message']}")
    return e.output("out")


def describe_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(stats.skewness_adjusted("l_extendedprice"), 6).alias("skew"), F.round(stats.kurtosis_adjusted("l_extendedprice"), 6).alias("kurt"),
        F.round(stats.weighted_mean("l_extendedprice", "l_quantity"), 4).alias("wmean"),
    )


def rank_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_size")
    return stats.average_ranks(p, "p_size").select("p_partkey", F.col("rank").alias("avg_rank"))


def quantiles_type7(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = stats.quantiles(_t(spark, sf_dir, "lineitem"), "l_extendedprice", [0.25, 0.5, 0.9], "l_returnflag")
    return q.select("l_returnflag", *[F.round(f"q{i}", 6).alias(name) for i, name in enumerate(("q25", "q50", "q90"))])


def weighted_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median price by supplier under the quantities, interpolated between neighbours."""
    return stats.weighted_quantile(_t(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", 0.5, "l_suppkey").select("l_suppkey", F.round("quantile", 6).alias("wmedian"))


def weighted_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w = "l_extendedprice", "l_discount", "l_quantity"
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(stats.weighted_variance(x, w) / 1e6, 6).alias("v"), F.round(stats.weighted_variance(x, w, True) / 1e6, 6).alias("pv"),
        F.round(stats.weighted_covariance(x, y, w), 5).alias("c"), F.round(stats.weighted_correlation(x, y, w), 8).alias("r"),
    )


def order_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenth smallest price of every supplier."""
    return stats.order_statistic(_t(spark, sf_dir, "lineitem"), "l_extendedprice", 10, "l_suppkey").select("l_suppkey", "value")


def ols_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.ols(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"], "l_extendedprice")
    return out.select("term", F.round("coefficient", 4).alias("coefficient"), F.round("r_squared", 8).alias("r_squared"), F.col("n_obs").cast("long").alias("n_obs"))


def range_join_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' 30-price-unit intervals met by customers' balances, as closed overlaps within a nation."""
    o = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    start = F.floor(F.col("o_totalprice")).cast("long")
    a = o.select("c_nationkey", "o_orderkey", start.alias("start"), (start + 30).alias("end"))
    return intervals.overlap_join(a, a, ["c_nationkey"], 1000).filter("o_orderkey < o_orderkey_b").select("o_orderkey", "o_orderkey_b")


def self_join_window_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return intervals.near_join(e, ["user_id"], "at", "event_id", 3600).select("event_id", "event_id_b")


def window_groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the peers of a row and of the two values before its own."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_totalprice").alias("v"))
    return frames.groups_frame(o, ["o_custkey"], "o_orderpriority", -2, 0, n=F.count("*"), s=F.sum("v")).select("o_orderkey", "n", F.round("s", 4).alias("s"))


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    e = _t(spark, sf_dir, "events").select("user_id", s.alias("start"), (s + 1800).alias("end"))
    return intervals.merge_intervals(e, ["user_id"]).select("user_id", "start", "end", "n")


def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every purchase with the value of the user's last other event at or before it."""
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", "event_type")
    a = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    b = e.filter("event_type <> 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return intervals.as_of_join(a, b, ["user_id"], "ts", "value").select("event_id", "value")


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    return li.select(
        F.lit("e").alias("id_exposure"), F.col("l_returnflag").alias("id_outcome"), (F.col("l_quantity") / 50 - 0.4).alias("beta_exposure"),
        (F.col("l_quantity") / 80 + F.col("l_discount") - 0.3).alias("beta_outcome"), (F.col("l_tax") + 0.05).alias("se_outcome"), F.lit(0.1).alias("se_exposure"),
    )


def mr_ivw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = mr.ivw(_effects(spark, sf_dir))
    return e.select("id_outcome", "nsnp", F.round("b", 8).alias("b"), F.round("se", 8).alias("se"), F.round("q", 4).alias("q"))


def mr_ivw_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed and multiplicative random effects, and the unweighted regression."""
    parts = [mr.ivw(_effects(spark, sf_dir), m).select("id_outcome", "method", F.round("b", 8).alias("b"), F.round("se", 8).alias("se")) for m in ("mr_ivw_fe", "mr_ivw_mre", "mr_uwr")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def mr_weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point estimates of the three medians, a nation's customers as instruments."""
    d = _instruments(spark, sf_dir)
    parts = [mr_robust.robust(d, m, mr_robust.Parameters(nboot=50)) for m in ("mr_simple_median", "mr_weighted_median")]
    return parts[0].unionByName(parts[1]).select("id_outcome", "method", "nsnp", F.round("b", 7).alias("b"))


def mr_heterogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = mr_robust.heterogeneity(_instruments(spark, sf_dir))
    return h.select("id_outcome", "method", F.round("q", 5).alias("q"), F.col("q_df").cast("long").alias("q_df"), F.round("q_pval", 7).alias("q_pval"))


def meta_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mr.meta_ivw(_instruments(spark, sf_dir), True)
    return m.select("id_outcome", "nsnp", F.round("b", 7).alias("b"), F.round("q", 5).alias("q"), F.round("i2", 5).alias("i2"), F.round("tau2", 7).alias("tau2"))


def _instruments(spark: SparkSession, sf_dir: str, outcome: str = "c_nationkey") -> DataFrame:
    """Customers as instruments, nations as outcomes: effects from balances and keys."""
    c, k = _t(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        F.lit("e").alias("id_exposure"), F.col(outcome).cast("string").alias("id_outcome"), (F.col("c_acctbal") / 20000 + 0.6).alias("beta_exposure"),
        ((F.col("c_acctbal") / 30000 + 0.3) + k % 11 / 50.0).alias("beta_outcome"), (k % 7 / 100.0 + 0.02).alias("se_outcome"), (k % 5 / 100.0 + 0.02).alias("se_exposure"),
    )


def mr_egger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = mr.egger(_effects(spark, sf_dir))
    return e.select("id_outcome", "nsnp", F.round("b", 7).alias("b"), F.round("se", 7).alias("se"), F.round("intercept", 7).alias("intercept"))


def harmonise_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alleles and frequencies made from part keys by modulo."""
    base = lambda n: F.substring(F.lit("ACGT"), (F.col("p_partkey") % n % 4 + 1).cast("int"), 1)

    p = _t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("snp"), base(7).alias("effect_allele_exposure"), F.substring(F.lit("CGTA"), (F.col("p_partkey") % 7 % 4 + 1).cast("int"), 1).alias("other_allele_exposure"),
        base(5).alias("effect_allele_outcome"), F.substring(F.lit("CGTA"), (F.col("p_partkey") % 5 % 4 + 1).cast("int"), 1).alias("other_allele_outcome"),
        (F.col("p_partkey") % 10 / 10.0).alias("eaf_exposure"), (F.col("p_partkey") % 9 / 10.0).alias("eaf_outcome"),
        F.lit(0.1).alias("beta_exposure"), F.lit(0.2).alias("beta_outcome"), F.lit(0.05).alias("se_exposure"), F.lit(0.05).alias("se_outcome"),
    )
    return mr.harmonise(p).select("snp", "remove", "beta_outcome")


def jackknife_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of 20 position blocks and the ratio without each."""
    b = stats.position_blocks(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], 20)
    s = b.groupBy("block").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("y"), F.sum("l_quantity").alias("x"))
    whole = s.agg(F.sum("y").alias("ay"), F.sum("x").alias("ax"))
    return s.crossJoin(F.broadcast(whole)).select("block", "n", F.round((F.col("ay") - F.col("y")) / (F.col("ax") - F.col("x")), 7).alias("left_out"))  # one row


def liability_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.lit(stats.liability_factor(0.5, 0.01))
    return _t(spark, sf_dir, "region").select("r_regionkey", F.round(F.col("r_regionkey") * f, 8).alias("h2_liab"))


def partition_idempotent_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the partitions that a load adds to a table that holds flags A and N already; the same load once more adds none."""
    lake = Lake(spark, f"quillon_{uuid.uuid4().hex[:8]}")
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    lake.load_partitions(li.filter("l_returnflag in ('A', 'N')"), "lines", "l_returnflag")
    added = lake.load_partitions(li, "lines", "l_returnflag")
    if not lake.load_partitions(li, "lines", "l_returnflag").isEmpty():
        raise RuntimeError("a repeated load added rows")
    return lake.table("lines").join(added, "l_returnflag", "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n"))


def keyword_search_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name holds a keyword, the dearest first."""
    return search(_t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), "re", "p_name", ["p_name", "p_retailprice"], 25, "p_retailprice", True, "p_partkey")


def latest_record_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def lambda_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inflation and mean of chi-squares made from quantities."""
    chi = _t(spark, sf_dir, "lineitem").select((F.col("l_quantity") * F.col("l_quantity") / 100).alias("chisq"))
    return chi.agg(F.round(F.avg("chisq"), 9).alias("mean_chisq")).withColumn("lambda_gc", F.round(F.lit(ldsc.lambda_gc(chi, "chisq")), 9))


def wls_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices on quantities, weighted by the line's discount."""
    li = _t(spark, sf_dir, "lineitem").withColumn("w", F.col("l_discount") + 0.01)
    out = stats.ols(li, ["l_quantity"], "l_extendedprice", weights="w")
    return out.select("term", F.round("coefficient", 5).alias("coefficient"), F.round("std_error", 5).alias("std_error"), F.round("t_stat", 4).alias("t_stat"), F.round("r_squared", 8).alias("r_squared"))


def mr_wald(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of single instruments: every customer is an outcome of its own."""
    out = mr_robust.estimates(_instruments(spark, sf_dir, "c_custkey"), ["mr_wald_ratio"])
    return out.select("id_outcome", F.round("b", 8).alias("b"), F.round("se", 8).alias("se"))


def mr_pleiotropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intercept of the regression with one, and its error."""
    p = mr_robust.pleiotropy(_instruments(spark, sf_dir))
    return p.select("id_outcome", "nsnp", F.round("intercept", 7).alias("intercept"), F.round("intercept_se", 7).alias("intercept_se"))


def mr_directionality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether exposures are explained better than outcomes, from effects, errors and sample sizes."""
    d = _instruments(spark, sf_dir).withColumns({"samplesize_exposure": F.lit(5000), "samplesize_outcome": F.lit(8000)})
    return mr_robust.directionality(d).select("id_outcome", F.round("r2_exposure", 7).alias("r2_exposure"), F.round("r2_outcome", 7).alias("r2_outcome"), "correct_direction")


def meta_egger(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mr.meta_egger(_instruments(spark, sf_dir))
    return m.select("id_outcome", "nsnp", *[F.round(c, 7).alias(c) for c in ("b", "se", "intercept", "intercept_se", "tau2")], F.round("q", 5).alias("q"))


def overlap_of_long_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' sessions (15 minutes, every hundredth one 40 days) met by their purchases' hours: counts of a purchase's overlaps."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", at.alias("start"))
    sessions = e.withColumn("end", F.col("start") + F.when(F.col("event_id") % 100 == 0, 40 * 86400).otherwise(900)).drop("event_type")
    bought = e.filter("event_type = 'purchase'").withColumn("end", F.col("start") + 3600).drop("event_type")
    return intervals.overlap_join(bought, sessions, ["user_id"], 1800).groupBy("event_id").agg(F.count("*").alias("n"))


def _snp_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as SNPs: chi-square from the quantity, LD scores from discount and tax."""
    li = _t(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.col("l_quantity") / 10).alias("z"), (F.col("l_quantity") * F.col("l_quantity") / 100).alias("y"),
        (1000.0 + 10 * F.col("l_linenumber")).alias("n"), (F.col("l_discount") * 100 + 1).alias("a"), (F.col("l_tax") * 100 + 1).alias("b"), (F.col("l_linenumber") + 1.0).alias("wld"),
    )


_SNP_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def h2_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heritability of two annotations, the intercept fixed at 1."""
    out = partitioned.partitioned_frame(_snp_rows(spark, sf_dir), ["a", "b"], [1000.0, 200.0], _SNP_ORDER, intercept=1.0)
    return out.select("annotation", F.round("cat", 8).alias("cat"), F.round("enrichment", 8).alias("enrichment"))


def h2_fixed_intercept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heritability of one LD score, the intercept fixed at 1, after two reweighting passes."""
    rows = ldsc.place(_snp_rows(spark, sf_dir).withColumn("ld", F.col("a")), _SNP_ORDER)
    return ldsc.h2_frame(rows, 1000.0, intercept=1.0).select(F.round("h2", 8).alias("h2"), F.round("h2_se", 8).alias("h2_se"), F.round("lambda_gc", 8).alias("lambda_gc"), F.round("mean_chisq", 8).alias("mean_chisq"), "n_snps")


def odds_population_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    af, prop, ratio = F.col("p_size") / 60.0, F.col("p_partkey") % 7 / 10.0 + 0.1, F.col("p_partkey") % 5 / 2.0 + 0.25
    pop = odds.population_frequency(af, prop, ratio, F.lit(0.01))
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(pop, 8).alias("population_af"))


def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the estimates keep their bounds: distinct users within 10 % of the exact count, the median's rank within 1 %."""
    e = _t(spark, sf_dir, "events")
    got = e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.percentile_approx("value", 0.5, 1000).alias("m"), F.count("value").alias("all"))
    # apart from the sketches: beside a distinct count every user would have sketches of their own
    exact = e.select("event_type", "user_id").distinct().groupBy(F.col("event_type").alias("t")).agg(F.count("user_id").alias("n"))
    got = got.join(F.broadcast(exact), F.col("event_type").eqNullSafe(F.col("t"))).drop("t")  # a row a type
    m = F.broadcast(got.select(F.col("event_type").alias("t"), "m"))
    below = e.join(m, F.col("event_type").eqNullSafe(F.col("t"))).groupBy("t").agg(F.count(F.when(F.col("value") <= F.col("m"), 1)).alias("below"), F.count(F.when(F.col("value") < F.col("m"), 1)).alias("under"))
    rank = (F.col("below") >= 0.49 * F.col("all")) & (F.col("under") <= 0.51 * F.col("all"))
    return got.join(F.broadcast(below), F.col("event_type").eqNullSafe(F.col("t"))).select("event_type", F.col("n").alias("users"), F.col("all").alias("events"), (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("users_fit"), rank.alias("median_fits"))


def _bases(column: str, shift: int) -> Column:
    return F.substring(F.lit("ACGT"), (F.col(column) % 4 + 1 + shift).cast("int") % 4 + 1, 1)


# Two-sided p of the normal statistics 1, 2, 3 and 1.959963984540054.
_P_OF = [0.31731050786291415, 0.04550026389635842, 0.0026997960632601866, 0.05]


def munge_sumstats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as summary statistics: munged by the package."""
    li = _t(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("rs"), F.col("l_partkey")).alias("rsid"), _bases("l_orderkey", 0).alias("effect_allele"), _bases("l_suppkey", 1).alias("other_allele"),
        (F.col("l_discount") - 0.05).alias("BETA"), F.element_at(F.array(*[F.lit(p) for p in _P_OF]), F.col("l_linenumber") % 4 + 1).alias("P"), (F.col("l_tax") + 0.93).alias("INFO"), (F.col("l_quantity") / 100).alias("EAF"),
        (F.col("l_linenumber") * F.col("l_linenumber") * 100 + 400.0).alias("N"), "l_orderkey", "l_linenumber",
    )
    out = munge.munge(li, order=["l_orderkey", "l_linenumber"])
    return out.select("SNP", "A1", "A2", F.round("Z", 9).alias("z"), "N")


def align_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as variants; the second pair of alleles is turned for odd sizes and on the other strand for every third key."""
    k, one, two = F.col("p_partkey"), _bases("p_partkey", 0), _bases("p_partkey", 1)
    strand = lambda c: F.when(k % 3 == 0, F.translate(c, "ACGT", "TGCA")).otherwise(c)
    odd = F.col("p_size") % 2 == 1
    p = _t(spark, sf_dir, "part").select(
        "p_partkey", one.alias("A1"), two.alias("A2"), strand(F.when(odd, two).otherwise(one)).alias("A1x"), strand(F.when(odd, one).otherwise(two)).alias("A2x"), F.col("p_retailprice").alias("Z2")
    )
    return munge.align(p).select("p_partkey", "Z2")


def ld_score_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LD scores of parts as SNPs with 24 genotypes each, in windows of 12 places."""
    places = F.sequence(F.lit(0), F.lit(23))
    p = _t(spark, sf_dir, "part").select(
        F.col("p_size").cast("string").alias("CHR"), F.col("p_partkey").alias("BP"), F.col("p_partkey").alias("SNP"),
        F.transform(places, lambda j: ((F.col("p_partkey") * (j + 3) + j * j) % 7 % 3).cast("int")).alias("genotypes"),
    )
    return ld.ld_scores(p, 400, kind="r2").select("SNP", F.round("L2", 6).alias("l2"))


def annotate_snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a customer's balance, as a place, lies in an interval that the nation's suppliers span."""
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("CHR"), F.floor("s_acctbal").cast("long").alias("start"), (F.floor("s_acctbal") + 300).cast("long").alias("end"))
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("CHR"), F.floor("c_acctbal").cast("long").alias("BP"), F.col("c_custkey").alias("SNP"))
    return ld.annotate(c, s, bin_size=1000).select("SNP", F.col("annot").cast("long").alias("annot"))


def genetic_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-squares exactly on the line of h2 one half: the correlation of a trait with its opposite is -1."""
    rows = _snp_rows(spark, sf_dir).withColumn("z", F.sqrt(1 + F.col("n") * F.col("a") * 0.5 / 1000))
    rows = rows.select(*_SNP_ORDER, F.col("z").alias("z1"), (-F.col("z")).alias("z2"), F.col("n").alias("n1"), F.col("n").alias("n2"), F.col("a").alias("ld"), "wld")
    out = ldsc.rg_frame(ldsc.place(rows, _SNP_ORDER), 1000.0, blocks=20, intercepts=(1.0, 1.0, -1.0))
    return out.select(F.round("rg", 6).alias("rg"), F.round("h2_1", 6).alias("h2_1"), F.round("h2_2", 6).alias("h2_2"), F.round("gencov", 6).alias("gencov"))


def liability_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workflow of a source, SQL and the liability node, after edges and nodes were removed and replaced."""
    e = Engine(spark)
    e.add("in", "source", {"path": f"{sf_dir}/region.parquet"})
    e.add("h2", "sql", {"sql_query": "SELECT 1 AS nothing FROM port_0"})
    e.add("liab", "liability", {"sample_prevalence": "0.5", "population_prevalence": 0.01})
    e.add("spare", "echo")
    e.connect("in", "h2")
    e.connect("in", "spare")
    e.dag.delete_edge("in", "spare")
    e.dag.delete_node("spare")
    e.update("h2", "sql", {"sql_query": "SELECT r_regionkey, CAST(r_regionkey AS DOUBLE) AS h2, 0.5D AS h2_se FROM port_0"})
    e.connect("h2", "liab")
    report = e.run()
    if report.summary()["failed"]:
        raise RuntimeError(str(report))
    return e.output("liab").select("r_regionkey", F.round("h2_liab", 8).alias("h2_liab"), F.round("h2_se_liab", 8).alias("h2_se_liab"))


def append_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written to one file and appended to, with a cast of the old rows to the new schema, then read back."""
    path = f"{store.shared_folder(spark)}/append-{uuid.uuid4().hex}.parquet"
    n = _t(spark, sf_dir, "nation")
    sinks.write_file(n.filter("n_nationkey < 10").select(F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("name")), path)
    sinks.write_file(n.filter("n_nationkey >= 10").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name")), path, mode="append")
    return formats.read(spark, path)


def lake_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions loaded into a table once each: the second load of one adds nothing."""
    lake = Lake(spark, f"quillon_{uuid.uuid4().hex[:8]}")
    lines = _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    for flags in (["A"], ["A", "N"], ["N", "R"]):
        lake.load_partitions(lines.filter(F.col("l_returnflag").isin(flags)), "lines", "l_returnflag")
    return lake.table("lines").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


_EFF = "(SELECT l_returnflag AS id_outcome, l_quantity / 50 - 0.4 AS x0, l_quantity / 80 + l_discount - 0.3 AS y0, l_tax + 0.05 AS se FROM lineitem)"
_ORD = "(SELECT c_nationkey, o_orderkey, floor(o_totalprice)::BIGINT AS s, floor(o_totalprice)::BIGINT + 30 AS e FROM orders JOIN customer ON o_custkey = c_custkey)"
_EV = "(SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS sec FROM events)"
ORACLES = {
    "flagship": "SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority",
    "describe_stats": "SELECT l_returnflag, round(skewness(l_extendedprice), 6) AS skew, round(kurtosis(l_extendedprice), 6) AS kurt, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS wmean FROM lineitem GROUP BY 1",
    "rank_average": "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS avg_rank FROM part",
    "weighted_quantile": "WITH t AS (SELECT l_suppkey AS k, l_extendedprice AS x, l_quantity AS w, sum(l_quantity) OVER o AS c, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS a, lag(l_extendedprice) OVER o AS p, row_number() OVER o AS i FROM lineitem WINDOW o AS (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_quantity ROWS UNBOUNDED PRECEDING)) SELECT k AS l_suppkey, round(CASE WHEN p IS NULL THEN x ELSE p + (a / 2 - (c - w)) / w * (x - p) END, 6) AS wmedian FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS r FROM t WHERE c >= a / 2) WHERE r = 1",
    "quantiles_type7": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.9), 6) AS q90 FROM lineitem GROUP BY l_returnflag",
    "weighted_moments": "WITH m AS (SELECT l_returnflag AS f, sum(l_quantity) AS w, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS mx, sum(l_quantity * l_discount) / sum(l_quantity) AS my FROM lineitem GROUP BY 1), d AS (SELECT f, any_value(w) AS w, sum(l_quantity * (l_extendedprice - mx) * (l_extendedprice - mx)) AS xx, sum(l_quantity * (l_extendedprice - mx) * (l_discount - my)) AS xy, sum(l_quantity * (l_discount - my) * (l_discount - my)) AS yy FROM lineitem JOIN m ON l_returnflag = f GROUP BY f) SELECT f AS l_returnflag, round(xx / (w - 1) / 1e6, 6) AS v, round(xx / w / 1e6, 6) AS pv, round(xy / (w - 1), 5) AS c, round(xy / sqrt(xx * yy), 8) AS r FROM d",
    "order_statistic": "SELECT l_suppkey, l_extendedprice AS value FROM (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS i FROM lineitem) WHERE i = 10",
    "munge_sumstats": "WITH d AS (SELECT 'rs' || l_partkey AS SNP, substr('ACGT', ((l_orderkey % 4 + 1) % 4 + 1)::INT, 1) AS A1, substr('ACGT', ((l_suppkey % 4 + 2) % 4 + 1)::INT, 1) AS A2, l_quantity / 100 AS f, l_tax + 0.93 AS info, l_linenumber * l_linenumber * 100 + 400.0::DOUBLE AS N, CASE WHEN l_discount - 0.05 < 0 THEN -1 ELSE 1 END * ([1.0::DOUBLE, 2, 3, 1.959963984540054])[l_linenumber % 4 + 1] AS z, l_orderkey, l_linenumber FROM lineitem), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY SNP ORDER BY l_orderkey, l_linenumber) AS k FROM d WHERE info BETWEEN 0.9 AND 2 AND f BETWEEN 0 AND 1 AND least(f, 1 - f) > 0.01 AND A1 <> A2 AND A1 <> translate(A2, 'ACGT', 'TGCA')) WHERE k = 1) SELECT SNP, A1, A2, round(z, 9) AS z, N FROM k WHERE N >= (SELECT quantile_cont(N, 0.9) / 1.5 FROM k)",
    "align_alleles": "SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN -p_retailprice ELSE p_retailprice END AS Z2 FROM part WHERE (p_partkey % 4 + 1) % 4 IN (0, 2)",
    "ld_score_windows": "WITH g AS (SELECT p_partkey AS k, p_size AS c, j, ((p_partkey * (j + 3) + j * j) % 7 % 3)::DOUBLE AS g FROM part, range(24) AS t(j)), s AS (SELECT k, c, j, (g - avg(g) OVER w) / stddev_pop(g) OVER w AS x, stddev_pop(g) OVER w AS sd FROM g WINDOW w AS (PARTITION BY k)), v AS (SELECT * FROM s WHERE sd > 0), r AS (SELECT a.k, b.k AS o, sum(a.x * b.x) / 24 AS r FROM v a JOIN v b ON a.c = b.c AND a.j = b.j AND abs(a.k - b.k) <= 400 AND a.k <> b.k GROUP BY 1, 2) SELECT k AS SNP, round(1 + coalesce(sum(r * r), 0), 6) AS l2 FROM (SELECT DISTINCT k FROM v) LEFT JOIN r USING (k) GROUP BY k",
    "annotate_snps": "SELECT c_custkey AS SNP, (EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND floor(c_acctbal) BETWEEN floor(s_acctbal) AND floor(s_acctbal) + 300))::BIGINT AS annot FROM customer",
    "genetic_correlation": "SELECT -1.0::DOUBLE AS rg, 0.5::DOUBLE AS h2_1, 0.5::DOUBLE AS h2_2, -0.5::DOUBLE AS gencov FROM (SELECT count(*) FROM lineitem)",
    "liability_node": "SELECT r_regionkey, round(r_regionkey * 0.551907298063::DOUBLE, 8) AS h2_liab, round(0.5 * 0.551907298063::DOUBLE, 8) AS h2_se_liab FROM region",
    "append_sink": "SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation",
    "lake_load": "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1",
    "approx_distinct": "SELECT event_type, count(DISTINCT user_id) AS users, count(value) AS events, true AS users_fit, true AS median_fits FROM events GROUP BY 1",
    "ols_multi": "WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_tax) AS mz, avg(l_extendedprice) AS my, var_pop(l_quantity) AS xx, var_pop(l_tax) AS zz, var_pop(l_extendedprice) AS yy, covar_pop(l_quantity, l_tax) AS xz, covar_pop(l_quantity, l_extendedprice) AS xy, covar_pop(l_tax, l_extendedprice) AS zy FROM lineitem), b AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS b2 FROM s) SELECT term, round(CASE term WHEN 'intercept' THEN my - b1 * mx - b2 * mz WHEN 'x1' THEN b1 ELSE b2 END, 4) AS coefficient, round((b1 * xy + b2 * zy) / yy, 8) AS r_squared, n AS n_obs FROM b, (VALUES ('intercept'), ('x1'), ('x2')) AS t(term)",
    "range_join_binned": f"SELECT a.o_orderkey, b.o_orderkey AS o_orderkey_b FROM {_ORD} a JOIN {_ORD} b ON a.c_nationkey = b.c_nationkey AND a.s <= b.e AND b.s <= a.e AND a.o_orderkey < b.o_orderkey",
    "self_join_window_distance": f"SELECT a.event_id, b.event_id AS event_id_b FROM {_EV} a JOIN {_EV} b ON a.user_id = b.user_id AND b.sec - a.sec BETWEEN 0 AND 3600 AND (b.sec > a.sec OR a.event_id < b.event_id)",
    "interval_merge": f"SELECT user_id, min(s) AS start, max(e) AS \"end\", count(*) AS n FROM (SELECT *, sum(CASE WHEN s <= m + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, sec AS s, sec + 1800 AS e, max(sec + 1800) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {_EV})) GROUP BY user_id, g",
    "as_of_join": "WITH b AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type <> 'purchase' GROUP BY ALL) SELECT a.event_id, b.value FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts",
    "mr_ivw": f"SELECT id_outcome, n AS nsnp, round(b, 8) AS b, round(sqrt(s2 / xx) / least(1, sqrt(s2)), 8) AS se, round(s2 * (n - 1), 4) AS q FROM (SELECT *, xy / xx AS b, (yy - xy * xy / xx) / (n - 1) AS s2 FROM (SELECT id_outcome, count(*) AS n, sum(x0 * x0 / (se * se)) AS xx, sum(x0 * y0 / (se * se)) AS xy, sum(y0 * y0 / (se * se)) AS yy FROM {_EFF} GROUP BY 1))",
    "mr_egger": f"SELECT id_outcome, n AS nsnp, round(b, 7) AS b, round(sqrt(sw / det) * greatest(1, sqrt(s2)), 7) AS se, round(a, 7) AS intercept FROM (SELECT *, (syy - a * sy - b * sxy) / (n - 2) AS s2 FROM (SELECT *, sw * sxx - sx * sx AS det, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS b, (sxx * sy - sx * sxy) / (sw * sxx - sx * sx) AS a FROM (SELECT id_outcome, count(*) AS n, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * y * y) AS syy FROM (SELECT id_outcome, 1 / (se * se) AS w, abs(x0) AS x, CASE WHEN x0 < 0 THEN -y0 ELSE y0 END AS y FROM {_EFF}) GROUP BY 1)))",
    "harmonise_rows": "SELECT snp, NOT (same OR swap OR fsame OR fswap) AS remove, CASE WHEN pal AND (same OR swap OR fsame OR fswap) AND ((ex < 0.5 AND eo > 0.5) OR (ex > 0.5 AND eo < 0.5)) THEN -b ELSE b END AS beta_outcome FROM (SELECT *, CASE WHEN turn THEN -0.2 ELSE 0.2 END::DOUBLE AS b, CASE WHEN turn THEN 1 - eo0 ELSE eo0 END AS eo, pal AND ((ex > 0.42 AND ex < 0.58) OR (CASE WHEN turn THEN 1 - eo0 ELSE eo0 END > 0.42 AND CASE WHEN turn THEN 1 - eo0 ELSE eo0 END < 0.58)) AS amb FROM (SELECT *, CASE WHEN same THEN false WHEN swap THEN true WHEN fsame THEN false ELSE fswap END AS turn FROM (SELECT *, a1 = b1 AND a2 = b2 AS same, a1 = b2 AND a2 = b1 AS swap, a1 = translate(b1, 'ACGT', 'TGCA') AND a2 = translate(b2, 'ACGT', 'TGCA') AS fsame, a1 = translate(b2, 'ACGT', 'TGCA') AND a2 = translate(b1, 'ACGT', 'TGCA') AS fswap, translate(a1, 'ACGT', 'TGCA') = a2 AS pal FROM (SELECT p_partkey AS snp, substr('ACGT', (p_partkey % 7 % 4 + 1)::INT, 1) AS a1, substr('CGTA', (p_partkey % 7 % 4 + 1)::INT, 1) AS a2, substr('ACGT', (p_partkey % 5 % 4 + 1)::INT, 1) AS b1, substr('CGTA', (p_partkey % 5 % 4 + 1)::INT, 1) AS b2, (p_partkey % 10)::DOUBLE / 10 AS ex, (p_partkey % 9)::DOUBLE / 10 AS eo0 FROM part))))",
    "jackknife_blocks": "SELECT block, n, round((ay - y) / (ax - x), 7) AS left_out FROM (SELECT *, sum(y) OVER () AS ay, sum(x) OVER () AS ax FROM (SELECT block, count(*) AS n, sum(l_extendedprice) AS y, sum(l_quantity) AS x FROM (SELECT *, (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) * 20 - 1) // (count(*) OVER ()) AS block FROM lineitem) GROUP BY 1))",
    "window_groups_frame": "SELECT o_orderkey, count(*) OVER w AS n, round(sum(o_totalprice) OVER w, 4) AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "liability_scale": "SELECT r_regionkey, round(r_regionkey * 0.551907298063::DOUBLE, 8) AS h2_liab FROM region",
    "partition_idempotent_load": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') GROUP BY 1",
}
_INS = "(SELECT c_nationkey::VARCHAR AS id_outcome, c_acctbal / 20000 + 0.6 AS x, c_acctbal / 30000 + 0.3 + c_custkey % 11 / 50.0::DOUBLE AS y, c_custkey % 7 / 100.0::DOUBLE + 0.02 AS se, c_custkey % 5 / 100.0::DOUBLE + 0.02 AS sx FROM customer)"


def _median(method: str, weight: str) -> str:
    """The ratio where the centred cumulative weight of the sorted ratios reaches one half."""
    order = "PARTITION BY id_outcome ORDER BY i"
    return (
        f"SELECT id_outcome, '{method}' AS method, n AS nsnp, round(r + (r2 - r) * (0.5 - c) / (c2 - c), 7) AS b FROM (SELECT *, lead(r) OVER ({order}) AS r2, lead(c) OVER ({order}) AS c2 FROM "
        f"(SELECT *, (sum(w) OVER ({order} ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY id_outcome) AS c, count(*) OVER (PARTITION BY id_outcome) AS n FROM "
        f"(SELECT id_outcome, y / x AS r, {weight} AS w, row_number() OVER (PARTITION BY id_outcome ORDER BY y / x, x, y, sx, se) AS i FROM {_INS}))) WHERE c < 0.5 AND c2 >= 0.5"
    )


def _chi2(q: str, df: str) -> str:
    """Upper tail for whole degrees of freedom, as a finite sum; with odd ones from the tail of the normal distribution on (by its series, or from q = 20 on by its expansion)."""
    term = lambda j: f"exp(-({q}) / 2 + ({j}) * ln(({q}) / 2) - lgamma(({j}) + 1))"
    even = f"list_sum(list_transform(range(0, ({df}) // 2), lambda k: {term('k')}))"
    series = f"1 - list_sum(list_transform(range(0, 90), lambda k: {term('k + 0.5::DOUBLE')}))"
    normal = f"CASE WHEN {q} < 20 THEN {series} ELSE exp(-({q}) / 2) / sqrt(pi() * ({q}) / 2) * (1 - 1 / ({q}) + 3 / pow({q}, 2) - 15 / pow({q}, 3)) END"
    odd = f"coalesce(list_sum(list_transform(range(1, ({df}) // 2 + 1), lambda k: {term('k - 0.5::DOUBLE')})), 0) + {normal}"
    return f"round(CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END, 7)"


_IVW = "SELECT id_outcome, count(*) AS n, sum(x * x / (se * se)) AS xx, sum(x * y / (se * se)) AS xy, sum(y * y / (se * se)) AS yy, sum(1 / (se * se)) AS sw, sum(1 / (se * se * se * se)) AS sww"
ORACLES |= {
    "mr_ivw_variants": f"WITH s AS (SELECT *, xy / xx AS b, (yy - xy * xy / xx) / (n - 1) AS s2 FROM (SELECT id_outcome, count(*) AS n, sum(x0 * x0 / (se * se)) AS xx, sum(x0 * y0 / (se * se)) AS xy, sum(y0 * y0 / (se * se)) AS yy FROM {_EFF} GROUP BY 1)), u AS (SELECT *, xy / xx AS b, (yy - xy * xy / xx) / (n - 1) AS s2 FROM (SELECT id_outcome, count(*) AS n, sum(x0 * x0) AS xx, sum(x0 * y0) AS xy, sum(y0 * y0) AS yy FROM {_EFF} GROUP BY 1)) SELECT id_outcome, 'mr_ivw_fe' AS method, round(b, 8) AS b, round(sqrt(1 / xx), 8) AS se FROM s UNION ALL SELECT id_outcome, 'mr_ivw_mre', round(b, 8), round(sqrt(s2 / xx), 8) FROM s UNION ALL SELECT id_outcome, 'mr_uwr', round(b, 8), round(sqrt(s2 / xx) / least(1, sqrt(s2)), 8) FROM u",
    "mr_weighted_median": _median("mr_simple_median", "1.0::DOUBLE") + " UNION ALL " + _median("mr_weighted_median", "1 / (se * se / (x * x) + y * y * sx * sx / (x * x * x * x))"),
    "mr_heterogeneity": f"WITH s AS ({_IVW}, sum(x / (se * se)) AS sx, sum(y / (se * se)) AS sy FROM {_INS} GROUP BY 1), e AS (SELECT *, (sw * xy - sx * sy) / (sw * xx - sx * sx) AS b, (xx * sy - sx * xy) / (sw * xx - sx * sx) AS a FROM s) SELECT id_outcome, 'mr_ivw' AS method, round(yy - xy * xy / xx, 5) AS q, n - 1 AS q_df, {_chi2('yy - xy * xy / xx', 'n - 1')} AS q_pval FROM s UNION ALL SELECT id_outcome, 'mr_egger_regression', round(yy - a * sy - b * xy, 5), n - 2, {_chi2('yy - a * sy - b * xy', 'n - 2')} FROM e",
    "meta_analysis": f"WITH s AS (SELECT *, yy - xy * xy / xx AS q FROM ({_IVW} FROM {_INS} GROUP BY 1)), t AS (SELECT *, CASE WHEN q > n - 1 THEN (q - (n - 1)) / (sw - sww / sw) ELSE 0 END AS tau2 FROM s) SELECT t.id_outcome, any_value(n) AS nsnp, round(sum(x * y / (se * se + tau2)) / sum(x * x / (se * se + tau2)), 7) AS b, round(any_value(q), 5) AS q, round(any_value(CASE WHEN q > n - 1 THEN (q - (n - 1)) / q * 100 ELSE 0 END), 5) AS i2, round(any_value(tau2), 7) AS tau2 FROM t JOIN {_INS} i ON i.id_outcome = t.id_outcome GROUP BY 1",
}
_SNPS = "(SELECT l_quantity * l_quantity / 100 AS y, 1000.0::DOUBLE + 10 * l_linenumber AS n, l_discount * 100 + 1 AS a, l_tax * 100 + 1 AS b, l_linenumber + 1.0::DOUBLE AS wld, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_extendedprice AS k4 FROM lineitem)"


def _pass(k: int) -> str:
    """One reweighted regression through the fixed intercept, from the estimate of the pass before."""
    w = "1 / (2 * pow(1 + least(1, greatest(0, h)) / 1000 * n * greatest(a, 1), 2)) / greatest(wld, 1)"
    return f"e{k} AS (SELECT 1000 * (sum({w} * n * a / nbar * (y - 1)) / sum({w} * (n * a / nbar) * (n * a / nbar))) / any_value(nbar) AS h FROM d, e{k - 1})"


ORACLES |= {
    "h2_partitioned": f"WITH d AS (SELECT *, a + b AS t, avg(n) OVER () AS nbar FROM {_SNPS}), s AS (SELECT 1200 * (avg(y) - 1) / avg(t * n) AS h FROM d), w AS (SELECT y - 1 AS y, n * a / nbar AS x, n * b / nbar AS z, nbar, 1 / (2 * pow(1 + least(1, greatest(0, h)) / 1200 * n * greatest(t, 1), 2)) / greatest(wld, 1) AS w FROM d, s), g AS (SELECT sum(w * x * x) AS xx, sum(w * x * z) AS xz, sum(w * z * z) AS zz, sum(w * x * y) AS xy, sum(w * z * y) AS zy, any_value(nbar) AS nbar FROM w), c AS (SELECT 1000 * (zz * xy - xz * zy) / (xx * zz - xz * xz) / nbar AS ca, 200 * (xx * zy - xz * xy) / (xx * zz - xz * xz) / nbar AS cb FROM g) SELECT annotation, round(CASE annotation WHEN 'a' THEN ca ELSE cb END, 8) AS cat, round(CASE annotation WHEN 'a' THEN ca / 1000 ELSE cb / 200 END / ((ca + cb) / 1200), 8) AS enrichment FROM c, (VALUES ('a'), ('b')) AS v(annotation)",
    "h2_fixed_intercept": f"WITH d AS (SELECT *, avg(n) OVER () AS nbar, (row_number() OVER (ORDER BY k1, k2, k3, k4) * 200 - 1) // count(*) OVER () AS block FROM {_SNPS}), e0 AS (SELECT 1000 * (avg(y) - 1) / avg(a * n) AS h FROM d), {_pass(1)}, {_pass(2)}, {_pass(3)}, "
    "j AS (SELECT block, any_value(nbar) AS nbar, sum(w * n * a / nbar * (y - 1)) AS xy, sum(w * (n * a / nbar) * (n * a / nbar)) AS xx FROM (SELECT d.*, 1 / (2 * pow(1 + least(1, greatest(0, h)) / 1000 * n * greatest(a, 1), 2)) / greatest(wld, 1) AS w FROM d, e2) GROUP BY block), "
    "v AS (SELECT 200 * t.xy / t.xx - 199 * (t.xy - j.xy) / (t.xx - j.xx) AS pseudo, nbar FROM j, (SELECT sum(xy) AS xy, sum(xx) AS xx FROM j) t) "
    "SELECT round(h, 8) AS h2, round((SELECT 1000 / any_value(nbar) * sqrt(var_samp(pseudo) / 200) FROM v), 8) AS h2_se, round((SELECT median(y) FROM d) / 0.4549, 8) AS lambda_gc, round((SELECT avg(y) FROM d), 8) AS mean_chisq, (SELECT count(*) FROM d) AS n_snps FROM e3",
    "odds_population_frequency": "SELECT p_partkey, round((af - z) / (1 - p) * 0.99 + z / p * 0.01, 8) AS population_af FROM (SELECT *, CASE WHEN o = 1 THEN af * p ELSE (1 + (af + p) * (o - 1) - sqrt(pow(1 + (af + p) * (o - 1), 2) - 4 * o * (o - 1) * af * p)) / (2 * (o - 1)) END AS z FROM (SELECT p_partkey, p_size / 60.0::DOUBLE AS af, p_partkey % 7 / 10.0::DOUBLE + 0.1::DOUBLE AS p, p_partkey % 5 / 2.0::DOUBLE + 0.25::DOUBLE AS o FROM part))",
}
_MEANS = "sum(w) AS sw, sum(w * w) AS sww, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS xx, sum(w * x * y) AS xy, sum(w * y * y) AS yy"
_LINE = "(sw * xy - sx * sy) / (sw * xx - sx * sx) AS b, (xx * sy - sx * xy) / (sw * xx - sx * sx) AS a, sw * xx - sx * sx AS det"
ORACLES |= {
    "keyword_search_sorted": "SELECT p_partkey, p_name, p_retailprice FROM part WHERE lower(p_name) LIKE '%re%' ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 25",
    "latest_record_per_id": "SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "lambda_gc": "SELECT round(median(l_quantity * l_quantity / 100) / 0.4549, 9) AS lambda_gc, round(avg(l_quantity * l_quantity / 100), 9) AS mean_chisq FROM lineitem",
    "wls_weighted": f"WITH l AS (SELECT l_discount + 0.01::DOUBLE AS w, l_quantity AS x, l_extendedprice AS y FROM lineitem), f AS (SELECT *, {_LINE} FROM (SELECT count(*) AS n, {_MEANS} FROM l)), r AS (SELECT sum(w * (y - a - b * x) * (y - a - b * x)) AS rss, sum(w * (y - sy / sw) * (y - sy / sw)) AS tss FROM l, f), e AS (SELECT *, rss / (n - 2) AS s2 FROM f, r) SELECT term, round(c, 5) AS coefficient, round(se, 5) AS std_error, round(c / se, 4) AS t_stat, round(1 - rss / tss, 8) AS r_squared FROM (SELECT 'intercept' AS term, a AS c, sqrt(xx / det * s2) AS se, rss, tss FROM e UNION ALL SELECT 'x1', b, sqrt(sw / det * s2), rss, tss FROM e)",
    "mr_wald": f"SELECT id_outcome, round(y / x, 8) AS b, round(se / abs(x), 8) AS se FROM {_INS.replace('c_nationkey', 'c_custkey')}",
    "mr_directionality": f"SELECT id_outcome, round(rx, 7) AS r2_exposure, round(ry, 7) AS r2_outcome, rx > ry AS correct_direction FROM (SELECT id_outcome, sum(x * x / (sx * sx) / (4998 + x * x / (sx * sx))) AS rx, sum(y * y / (se * se) / (7998 + y * y / (se * se))) AS ry FROM {_INS} GROUP BY 1)",
    "meta_egger": f"WITH s AS (SELECT id_outcome, count(*) AS n, {_MEANS} FROM (SELECT *, 1 / (se * se) AS w FROM {_INS}) GROUP BY 1), f AS (SELECT *, yy - a * sy - b * xy AS q FROM (SELECT *, {_LINE} FROM s)) SELECT id_outcome, n AS nsnp, round(b, 7) AS b, round(sqrt(sw / det * q / (n - 2)), 7) AS se, round(a, 7) AS intercept, round(sqrt(xx / det * q / (n - 2)), 7) AS intercept_se, round(CASE WHEN q > n - 2 THEN (q - (n - 2)) / (sw - sww / sw) ELSE 0 END, 7) AS tau2, round(q, 5) AS q FROM f",
    "mr_pleiotropy": f"WITH s AS (SELECT id_outcome, count(*) AS n, {_MEANS} FROM (SELECT id_outcome, 1 / (se * se) AS w, abs(x) AS x, CASE WHEN x < 0 THEN -y ELSE y END AS y FROM {_INS}) GROUP BY 1), f AS (SELECT *, (yy - a * sy - b * xy) / (n - 2) AS s2 FROM (SELECT *, {_LINE} FROM s)) SELECT id_outcome, n AS nsnp, round(a, 7) AS intercept, round(sqrt(xx / det) * greatest(1, sqrt(s2)), 7) AS intercept_se FROM f",
    "overlap_of_long_spans": "WITH e AS (SELECT user_id, event_id, event_type, floor(epoch(ts))::BIGINT AS s FROM events) SELECT p.event_id, count(*) AS n FROM e p JOIN e q ON p.user_id = q.user_id AND p.s <= q.s + CASE WHEN q.event_id % 100 = 0 THEN 3456000 ELSE 900 END AND q.s <= p.s + 3600 WHERE p.event_type = 'purchase' GROUP BY 1",
}
FUNCTIONS = [
    window_groups_frame, keyword_search_sorted, latest_record_per_id, lambda_gc, wls_weighted, mr_wald, mr_pleiotropy, mr_directionality, meta_egger, overlap_of_long_spans,
    h2_partitioned, h2_fixed_intercept, odds_population_frequency,
    flagship, describe_stats, quantiles_type7, rank_average, weighted_quantile, ols_multi, range_join_binned, self_join_window_distance, interval_merge, as_of_join,
    mr_ivw, mr_ivw_variants, mr_egger, mr_weighted_median, mr_heterogeneity, meta_analysis, harmonise_rows, jackknife_blocks, liability_scale, partition_idempotent_load, approx_distinct,
    weighted_moments, order_statistic, munge_sumstats, align_alleles, ld_score_windows, annotate_snps, genetic_correlation, liability_node, append_sink, lake_load,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _spark_query(name) for name in SHARED} | {f.__name__: f for f in [*FUNCTIONS, *catalog_files.FUNCTIONS]}


def oracle_sql() -> dict[str, str]:
    return {name: _duck_sql(name) for name in SHARED} | ORACLES | catalog_files.ORACLES
