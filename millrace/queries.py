"""Registered queries of the engine, each with the SQL that checks it.

Most are text in the dialect; the rest show an operator of the DataFrame API.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import function_queries
from .operators import aggregation as agg
from .operators import dml, graph, match, relational, timeseries, vectors
from .plans import dialect
from .sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def text(name: str, query: str, sql: str | None = None) -> None:
    """Register a query of the dialect; without ``sql`` the checker reads the same text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        io.load(spark, sf_dir)
        return dialect.run(spark, query)

    QUERIES[name] = run
    ORACLE_SQL[name] = sql or query


def frame(sql: str | None) -> Callable:
    """Register a function of tables (by name) to a DataFrame."""

    def add(fn: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet"))

        QUERIES[fn.__name__] = run
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


# --- decision support ---------------------------------------------------------

text(
    "tpch_q1",
    """SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base_price,
  ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
  ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  ROUND(AVG(l_quantity), 4) AS avg_qty, ROUND(AVG(l_extendedprice), 2) AS avg_price, ROUND(AVG(l_discount), 4) AS avg_disc,
  COUNT(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
text(
    "tpch_q3",
    """SELECT l_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
)
text(
    "tpch_q5",
    """SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name""",
)
text(
    "tpch_q6",
    """SELECT ROUND(SUM(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
)
text(
    "tpch_q7",
    """SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, EXTRACT(YEAR FROM l_shipdate) AS l_year,
  ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
WHERE ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))
AND l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' GROUP BY n1.n_name, n2.n_name, EXTRACT(YEAR FROM l_shipdate)""",
)
text(
    "tpch_q8",
    """SELECT EXTRACT(YEAR FROM o_orderdate) AS o_year,
  ROUND(SUM(IF(n2.n_nationkey = 2, l_extendedprice * (1 - l_discount), 0)) / SUM(l_extendedprice * (1 - l_discount)), 6) AS mkt_share
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN nation n2 ON s_nationkey = n2.n_nationkey
JOIN region ON n1.n_regionkey = r_regionkey WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY'
AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' GROUP BY EXTRACT(YEAR FROM o_orderdate)""",
)
text(
    "tpch_q10",
    """SELECT c_custkey, c_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' AND o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
text(
    "tpch_q14",
    """SELECT ROUND(100 * SUM(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END)
  / SUM(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_shipdate >= TIMESTAMP '1996-09-01' AND l_shipdate < TIMESTAMP '1996-10-01'""",
)
text(
    "tpch_q15",
    """WITH revenue AS (SELECT l_suppkey AS supplier_no, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS total_revenue
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no
WHERE total_revenue = (SELECT MAX(total_revenue) FROM revenue)""",
)
text(
    "tpch_q18",
    """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, SUM(l_quantity) AS sum_qty
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 200)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice""",
)
text(
    "tpch_q22_shape",
    """SELECT c_nationkey, COUNT(*) AS numcust, ROUND(SUM(c_acctbal), 2) AS totacctbal FROM customer
WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer WHERE c_acctbal > 0)
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) GROUP BY c_nationkey""",
)

# --- projection, filters, subqueries --------------------------------------------

text("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
text("select_star_except", "SELECT * EXCEPT (c_name, c_mktsegment) FROM customer", "SELECT * EXCLUDE (c_name, c_mktsegment) FROM customer")
text("where_in_between_like", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND p_retailprice BETWEEN 900 AND 1500 AND p_type LIKE '%A%'")
text("like_any", "SELECT p_partkey FROM part WHERE p_type LIKE ANY ('%BRASS', 'PROMO%')", "SELECT p_partkey FROM part WHERE p_type LIKE '%BRASS' OR p_type LIKE 'PROMO%'")
text("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * AVG(o_totalprice) FROM orders)")
text("correlated_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 300000)")
text("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
text("is_distinct_from", "SELECT COUNTIF(l_returnflag IS DISTINCT FROM l_linestatus) AS n FROM lineitem", "SELECT COUNT(*) FILTER (l_returnflag IS DISTINCT FROM l_linestatus) AS n FROM lineitem")
text("in_unnest", "SELECT n_name FROM nation WHERE n_regionkey IN UNNEST([1, 3])", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)")
text("array_subquery", "SELECT ARRAY_LENGTH(ARRAY(SELECT n_nationkey FROM nation WHERE n_regionkey = 1)) AS n", "SELECT COUNT(*) AS n FROM nation WHERE n_regionkey = 1")
text("safe_math", "SELECT l_orderkey, l_linenumber, SAFE_DIVIDE(l_tax, l_discount) AS q, SAFE.SQRT(l_discount - 0.05) AS s FROM lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS q, CASE WHEN l_discount - 0.05 >= 0 THEN sqrt(l_discount - 0.05) END AS s FROM lineitem")

# --- joins ---------------------------------------------------------------------

text("join_left_outer", "SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
text("join_full_using", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation WHERE n_nationkey < 15) FULL JOIN (SELECT n_nationkey AS k, n_name AS b FROM nation WHERE n_nationkey > 9) USING (k)")
text("join_theta", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
text("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
text("lateral_join", "SELECT c_custkey, t.m FROM customer, LATERAL (SELECT MAX(o_totalprice) AS m FROM orders WHERE o_custkey = c_custkey) t")
text("unnest_with_offset", "SELECT o_orderkey, w, pos FROM orders, UNNEST(SPLIT(o_orderpriority, '-')) AS w WITH OFFSET AS pos", "SELECT o_orderkey, w, CAST(i - 1 AS INTEGER) AS pos FROM (SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS w, generate_subscripts(string_split(o_orderpriority, '-'), 1) AS i FROM orders)")


@frame("SELECT event_id, a.user_id, a.ts, b.value FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def as_of_join(t):
    """The latest purchase of each user at or before each click."""
    clicks = t("events").where("event_type = 'click'").select("event_id", "user_id", "ts")
    buys = t("events").where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return timeseries.as_of_join(clicks, buys, ["user_id"], "ts", "ts", ["value"])


@frame("WITH v AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE CAST(n_nationkey % 5 AS DOUBLE) END AS k, n_nationkey AS i FROM nation) SELECT a.k, a.i AS i, b.i AS j FROM v a JOIN v b ON a.k = b.k")
def join_float_nan(t):
    """Float keys: NaN, put in place of some keys, meets nothing."""
    k = F.when(F.col("n_nationkey") % 5 == 0, F.lit(float("nan"))).otherwise((F.col("n_nationkey") % 5).cast("double"))
    v = t("nation").select(k.alias("k"), F.col("n_nationkey").alias("i"))
    return relational.equi_join(v, v.withColumnRenamed("i", "j"), ["k"])


# --- aggregation -----------------------------------------------------------------

text("group_by_all", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ALL")
text("rollup", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
text("cube", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
text("grouping_sets", "SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag) AS g, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
text("having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15")
text("distinct_aggregates", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS c, COUNT(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_orderstatus")
text("aggregate_filter", "SELECT o_orderstatus, COUNT(* WHERE o_totalprice > 100000) AS n, COUNTIF(o_totalprice < 50000) AS m FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, COUNT(*) FILTER (o_totalprice > 100000) AS n, COUNT(*) FILTER (o_totalprice < 50000) AS m FROM orders GROUP BY o_orderstatus")
text("array_agg_ordered", "SELECT n_regionkey, ARRAY_TO_STRING(ARRAY_AGG(n_name ORDER BY n_name DESC LIMIT 3), ',') AS a FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list(n_name ORDER BY n_name DESC)[1:3], ',') AS a FROM nation GROUP BY n_regionkey")
text("string_agg_ordered", "SELECT n_regionkey, STRING_AGG(n_name, '|' ORDER BY n_nationkey) AS s FROM nation GROUP BY n_regionkey")
text("bit_and_logic_aggregates", "SELECT n_regionkey, BIT_AND(n_nationkey) AS a, BIT_OR(n_nationkey) AS o, BIT_XOR(n_nationkey) AS x, LOGICAL_AND(n_nationkey > 2) AS la, LOGICAL_OR(n_nationkey > 20) AS lo FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, BIT_AND(n_nationkey) AS a, BIT_OR(n_nationkey) AS o, BIT_XOR(n_nationkey) AS x, bool_and(n_nationkey > 2) AS la, bool_or(n_nationkey > 20) AS lo FROM nation GROUP BY n_regionkey")
text("statistics", "SELECT o_orderstatus, ROUND(STDDEV(o_totalprice), 4) AS sd, ROUND(VAR_POP(o_totalprice) / 1e6, 4) AS vp, ROUND(CORR(o_totalprice, o_custkey), 6) AS c FROM orders GROUP BY o_orderstatus")
text("aggregate_statistics", "SELECT n_regionkey, ROUND(STDDEV_POP(n_nationkey), 6) AS a, ROUND(STDDEV_SAMP(n_nationkey), 6) AS b, ROUND(VAR_SAMP(n_nationkey), 6) AS c, ROUND(VARIANCE(n_nationkey), 6) AS d, ROUND(COVAR_POP(n_nationkey, LENGTH(n_name)), 6) AS e, ROUND(COVAR_SAMP(n_nationkey, LENGTH(n_name)), 6) AS f FROM nation GROUP BY n_regionkey")
text("aggregate_collections", "SELECT n_regionkey, ARRAY_LENGTH(ARRAY_CONCAT_AGG([n_nationkey, 1])) AS a, ANY_VALUE(n_regionkey) AS b, MIN(n_name) AS c, MAX(n_name) AS d, ROUND(AVG(n_nationkey), 6) AS e FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(2 * COUNT(*) AS BIGINT) AS a, n_regionkey AS b, MIN(n_name) AS c, MAX(n_name) AS d, ROUND(AVG(n_nationkey), 6) AS e FROM nation GROUP BY n_regionkey")
text("approximate_aggregates", "SELECT n_regionkey, APPROX_COUNT_DISTINCT(n_nationkey) AS a, HLL_COUNT.EXTRACT(HLL_COUNT.INIT(n_nationkey)) AS h, ARRAY_LENGTH(APPROX_QUANTILES(n_nationkey, 2)) AS q, APPROX_TOP_COUNT(n_regionkey, 1)[OFFSET(0)].value AS t FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, COUNT(DISTINCT n_nationkey) AS a, COUNT(DISTINCT n_nationkey) AS h, CAST(3 AS BIGINT) AS q, n_regionkey AS t FROM nation GROUP BY n_regionkey")
text("sketch_merge", "SELECT HLL_COUNT.MERGE(s) AS n, HLL_COUNT.EXTRACT(HLL_COUNT.MERGE_PARTIAL(s)) AS m FROM (SELECT n_regionkey, HLL_COUNT.INIT(n_name) AS s FROM nation GROUP BY n_regionkey)", "SELECT COUNT(DISTINCT n_name) AS n, COUNT(DISTINCT n_name) AS m FROM nation")
text("window_values", "SELECT n_nationkey, LAST_VALUE(n_name) OVER w AS l, NTH_VALUE(n_name, 2) OVER w AS n, ROW_NUMBER() OVER w AS r, MAX(n_name) OVER w AS m FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)")
text("pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (SUM(l_quantity) FOR l_linestatus IN ('O' AS o, 'F' AS f))", "SELECT l_returnflag, SUM(l_quantity) FILTER (l_linestatus = 'O') AS o, SUM(l_quantity) FILTER (l_linestatus = 'F') AS f FROM lineitem GROUP BY l_returnflag")
text("unpivot", "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) UNPIVOT (v FOR k IN (l_discount AS 'd', l_tax AS 't'))".replace("'d'", "d").replace("'t'", "t"), "SELECT l_orderkey, l_linenumber, 'd' AS k, l_discount AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 't', l_tax FROM lineitem")
text("having_max", "SELECT o_custkey, ANY_VALUE(o_orderkey HAVING MAX o_totalprice) AS k FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS k FROM orders GROUP BY o_custkey")


@frame("SELECT o_custkey, COUNT(*) AS n, SUM(o_totalprice) AS s FROM (SELECT *, max(o_orderpriority) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_orderpriority = m GROUP BY o_custkey")
def having_max_modifier(t):
    """Aggregate each customer's orders of their highest priority label."""
    return agg.having_extreme(t("orders"), ["o_custkey"], F.col("o_orderpriority"), {"n": F.count(F.lit(1)), "s": F.sum("o_totalprice")})


@frame("SELECT o_orderstatus, AVG(m) AS avg_max, COUNT(*) AS n FROM (SELECT o_orderstatus, o_custkey, MAX(o_totalprice) AS m FROM orders GROUP BY ALL) GROUP BY o_orderstatus")
def multi_level_aggregation(t):
    """AVG(MAX(price) GROUP BY customer) by status."""
    return agg.multi_level(t("orders"), ["o_orderstatus"], ["o_custkey"], {"m": F.max("o_totalprice")}, {"avg_max": F.avg("m"), "n": F.count(F.lit(1))})


@frame("SELECT l_returnflag, SUM(o_totalprice) AS total FROM (SELECT DISTINCT l_returnflag, o_orderkey, o_totalprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY l_returnflag")
def measure_over_join(t):
    """Order totals by line flag, each order once a flag though the join repeats it."""
    joined = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return agg.measure(joined, ["l_returnflag"], ["o_orderkey"], ["o_totalprice"], {"total": F.sum("o_totalprice")})


@frame("SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority HAVING COUNT(DISTINCT o_custkey) >= 50")
def aggregation_threshold(t):
    """Groups with at least fifty customers."""
    return agg.threshold(t("orders"), ["o_orderpriority"], "o_custkey", 50, {"n": F.count(F.lit(1))})


@frame(None)
def private_sum(t):
    """Differentially private counts and sums of order prices by priority."""
    return agg.private_sums(t("orders"), ["o_orderpriority"], "o_custkey", F.col("o_totalprice"), low=0, high=500000, epsilon=10.0, delta=1e-5, groups_per_unit=2)


@frame("SELECT o_orderpriority, COUNT(*) AS anon_count, ROUND(SUM(least(500000, v)), 1) AS anon_sum FROM (SELECT o_orderpriority, o_custkey, SUM(o_totalprice) AS v FROM orders GROUP BY ALL) GROUP BY o_orderpriority")
def private_sum_without_noise(t):
    """The same with a budget that leaves no noise and no group out: clamping and counting alone."""
    out = agg.private_sums(t("orders"), ["o_orderpriority"], "o_custkey", F.col("o_totalprice"), low=0, high=500000, epsilon=1e12, delta=0.1, groups_per_unit=5)
    return out.withColumn("anon_sum", F.round("anon_sum", 1))


# --- windows ---------------------------------------------------------------------

text("window_ranking", "SELECT o_orderkey, RANK() OVER w AS r, DENSE_RANK() OVER w AS d, NTILE(4) OVER (ORDER BY o_orderkey) AS t FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus)".replace("NTILE(4) OVER (ORDER BY o_orderkey) AS t", "NTILE(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t"))
text("window_navigation", "SELECT o_orderkey, LAG(o_totalprice) OVER w AS p, LEAD(o_totalprice, 2) OVER w AS n, FIRST_VALUE(o_totalprice) OVER w AS f FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
text("window_frames", "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s, COUNT(*) OVER (w RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
text("window_percent", "SELECT c_custkey, ROUND(PERCENT_RANK() OVER w, 9) AS p, ROUND(CUME_DIST() OVER w, 9) AS c FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal)")
text("qualify", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")


@frame("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def top_k_per_group(t):
    """The three best balances of each nation."""
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return relational.qualify(t("customer").select("c_nationkey", "c_custkey", "c_acctbal"), F.row_number().over(w) <= 3)


# --- order, sets, recursion -------------------------------------------------------

text("order_limit_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 5")
text("union_distinct", "SELECT c_nationkey AS k FROM customer UNION DISTINCT SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
text("intersect_distinct", "SELECT c_nationkey AS k FROM customer INTERSECT DISTINCT SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
text("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
text("with_recursive", "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT n FROM r")


@frame("SELECT n_nationkey AS k, n_name AS name, NULL AS region FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def union_by_name_full(t):
    """UNION ALL BY NAME with all columns of both sides."""
    a = t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    b = t("region").select(F.col("r_name").alias("region"), F.col("r_regionkey").alias("k"))
    return relational.set_operation(a, b, "union", distinct=False, by_name="full")


@frame("WITH RECURSIVE r AS (SELECT 0 AS n, CAST(0 AS BIGINT) AS depth UNION SELECT (n * 3 + 1) % 50, depth + 1 FROM r WHERE depth < 60) SELECT n, MIN(depth) AS depth FROM r GROUP BY n")
def recursive_distinct(t):
    """Recursion that ends when a round brings no new row."""
    seed = t("region").select(F.lit(0).alias("n")).distinct()
    return relational.recursive_union(seed, lambda d: d.select(((F.col("n") * 3 + 1) % 50).alias("n")), depth="depth")


# --- pipes -------------------------------------------------------------------------

text("pipe_aggregate", "FROM orders |> WHERE o_totalprice > 1000 |> EXTEND EXTRACT(YEAR FROM o_orderdate) AS y |> AGGREGATE COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s GROUP BY y", "SELECT EXTRACT(YEAR FROM o_orderdate) AS y, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
text("pipe_rename_drop_set", "FROM nation |> RENAME n_name AS name |> DROP n_regionkey |> SET n_nationkey = n_nationkey + 1", "SELECT n_nationkey + 1 AS n_nationkey, n_name AS name FROM nation")
text("pipe_join_distinct", "FROM orders |> JOIN customer ON o_custkey = c_custkey |> SELECT c_mktsegment, o_orderstatus |> DISTINCT", "SELECT DISTINCT c_mktsegment, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey")
text("pipe_union_many", "FROM region |> SELECT r_regionkey AS k |> UNION ALL (SELECT n_nationkey FROM nation), (SELECT s_suppkey FROM supplier)", "SELECT r_regionkey AS k FROM region UNION ALL SELECT n_nationkey FROM nation UNION ALL SELECT s_suppkey FROM supplier")
text("pipe_window_assert", "FROM orders |> WINDOW SUM(o_totalprice) OVER (PARTITION BY o_custkey) AS total |> ASSERT total >= o_totalprice - 0.01, 'total too small' |> SELECT o_orderkey, ROUND(total, 2) AS total", "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total FROM orders")
text("pipe_group_and_order", "FROM customer |> AGGREGATE COUNT(*) AS n GROUP AND ORDER BY c_mktsegment DESC |> LIMIT 3", "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1 ORDER BY 1 DESC LIMIT 3")
text("pipe_if", "FROM region |> IF 0 = 1 THEN (WHERE r_regionkey > 1) ELSEIF false THEN (WHERE r_regionkey > 2) ELSE (|> WHERE r_regionkey > 3 |> EXTEND 1 AS x)", "SELECT *, 1 AS x FROM region WHERE r_regionkey > 3")
text("pipe_with_tee", "FROM nation |> WITH big AS (SELECT r_regionkey FROM region WHERE r_regionkey > 2) |> JOIN big ON n_regionkey = r_regionkey |> TEE (WHERE n_nationkey = 0) |> SELECT n_name, n_regionkey", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey > 2")
text("unnest_multiway", "SELECT n_nationkey, a, b, o FROM nation, UNNEST([n_nationkey, 2, 3] AS a, [n_name] AS b) WITH OFFSET AS o", "SELECT n_nationkey, unnest([n_nationkey, 2, 3]) AS a, unnest([n_name, NULL, NULL]) AS b, CAST(unnest([0, 1, 2]) AS INTEGER) AS o FROM nation")
text("unnest_truncate", "SELECT n_nationkey, a, b FROM nation, UNNEST([n_nationkey, 2, 3] AS a, [n_name] AS b, mode => 'TRUNCATE')", "SELECT n_nationkey, n_nationkey AS a, n_name AS b FROM nation")
text("like_any_array", "SELECT n_name FROM nation WHERE n_name LIKE ANY UNNEST(['%1', '%_2%'])", "SELECT n_name FROM nation WHERE n_name LIKE '%1' OR n_name LIKE '%_2%'")
text("with_expression", "SELECT n_nationkey, WITH(a AS n_nationkey + 1, b AS a * a, b - a) AS x FROM nation", "SELECT n_nationkey, (n_nationkey + 1) * (n_nationkey + 1) - (n_nationkey + 1) AS x FROM nation")
text("union_by_name_text", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL BY NAME SELECT r_name AS name, r_regionkey AS k FROM region", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
text("full_union_by_name_text", "SELECT n_nationkey AS k, n_name AS a FROM nation FULL UNION ALL BY NAME SELECT r_name AS b, r_regionkey AS k FROM region", "SELECT n_nationkey AS k, n_name AS a, NULL AS b FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
text("except_corresponding", "SELECT n_regionkey AS k, n_name AS a FROM nation EXCEPT DISTINCT CORRESPONDING SELECT r_regionkey AS k, r_name AS b FROM region WHERE r_regionkey > 1", "SELECT n_regionkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region WHERE r_regionkey > 1")
text("recursive_union_distinct_text", "WITH RECURSIVE r AS (SELECT 0 AS n UNION DISTINCT SELECT (n * 3 + 1) % 50 FROM r) WITH DEPTH AS d SELECT n, d FROM r", "WITH RECURSIVE r AS (SELECT 0 AS n, CAST(0 AS BIGINT) AS d UNION SELECT (n * 3 + 1) % 50, d + 1 FROM r WHERE d < 60) SELECT n, MIN(d) AS d FROM r GROUP BY n")
text("window_first_last", "SELECT o_orderkey, IS_FIRST(2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f, IS_LAST(1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS l FROM orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2 AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 1 AS l FROM orders")
text("window_percentiles", "SELECT c_custkey, ROUND(PERCENTILE_CONT(c_acctbal, 0.25) OVER (PARTITION BY c_nationkey), 6) AS c, PERCENTILE_DISC(c_acctbal, 0.5) OVER (PARTITION BY c_nationkey) AS d FROM customer", "SELECT c_custkey, ROUND(quantile_cont(c_acctbal, 0.25) OVER (PARTITION BY c_nationkey), 6) AS c, quantile_disc(c_acctbal, 0.5) OVER (PARTITION BY c_nationkey) AS d FROM customer")
text("window_distinct_aggregates", "SELECT o_orderkey, COUNT(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS c FROM orders", "SELECT o_orderkey, COUNT(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS c FROM orders")

# --- functions ----------------------------------------------------------------------

text("string_functions", "SELECT c_custkey, UPPER(c_name) AS u, SUBSTR(c_name, 3, 4) AS s, STRPOS(c_name, '0') AS p, REVERSE(c_name) AS r, LPAD(c_mktsegment, 12, '*') AS l, STARTS_WITH(c_name, 'Cust') AS st, REPLACE(c_name, '0', 'o') AS rp, BYTE_LENGTH(c_name) AS b FROM customer", "SELECT c_custkey, UPPER(c_name) AS u, SUBSTR(c_name, 3, 4) AS s, CAST(strpos(c_name, '0') AS BIGINT) AS p, REVERSE(c_name) AS r, LPAD(c_mktsegment, 12, '*') AS l, starts_with(c_name, 'Cust') AS st, REPLACE(c_name, '0', 'o') AS rp, CAST(strlen(c_name) AS INTEGER) AS b FROM customer")
text("regexp_functions", "SELECT c_custkey, REGEXP_EXTRACT(c_name, r'([0-9]+)') AS e, REGEXP_CONTAINS(c_name, r'9$') AS c, REGEXP_REPLACE(c_name, r'([0-9])([0-9])$', r'\\2\\1') AS r FROM customer", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS e, regexp_matches(c_name, '9$') AS c, regexp_replace(c_name, '([0-9])([0-9])$', '\\2\\1') AS r FROM customer")
text("math_functions", "SELECT o_orderkey, TRUNC(o_totalprice / 1000) AS t, CEIL(o_totalprice / 1000) AS c, ROUND(LN(o_totalprice), 9) AS l, ROUND(POW(o_totalprice, 0.5), 6) AS p, MOD(o_orderkey, 7) AS m, DIV(o_orderkey, 7) AS d, SIGN(o_totalprice - 100000) AS s FROM orders", "SELECT o_orderkey, trunc(o_totalprice / 1000) AS t, ceil(o_totalprice / 1000) AS c, ROUND(ln(o_totalprice), 9) AS l, ROUND(pow(o_totalprice, 0.5), 6) AS p, o_orderkey % 7 AS m, o_orderkey // 7 AS d, CAST(sign(o_totalprice - 100000) AS DOUBLE) AS s FROM orders")
text("date_functions", "SELECT o_orderkey, DATE_TRUNC(DATE(o_orderdate), MONTH) AS m, DATE_DIFF(DATE '1999-01-01', DATE(o_orderdate), MONTH) AS dm, DATE_ADD(DATE(o_orderdate), INTERVAL 10 DAY) AS a, LAST_DAY(DATE(o_orderdate)) AS l, FORMAT_DATE('%Y-%m', DATE(o_orderdate)) AS f, EXTRACT(DAYOFWEEK FROM o_orderdate) AS dw FROM orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, date_diff('month', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS dm, CAST(o_orderdate AS DATE) + 10 AS a, last_day(o_orderdate) AS l, strftime(o_orderdate, '%Y-%m') AS f, dayofweek(o_orderdate) + 1 AS dw FROM orders")
text("timestamp_functions", "SELECT event_id, TIMESTAMP_TRUNC(ts, HOUR) AS h, UNIX_MICROS(ts) AS u, TIMESTAMP_DIFF(ts, TIMESTAMP '2020-01-01', MINUTE) AS d, TIMESTAMP_ADD(ts, INTERVAL 90 SECOND) AS a FROM events", "SELECT event_id, date_trunc('hour', ts) AS h, epoch_us(ts) AS u, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2020-01-01')) / 60000000) AS BIGINT) AS d, ts + INTERVAL 90 SECOND AS a FROM events")
text("array_functions", "SELECT n_nationkey, ARRAY_TO_STRING(ARRAY_CONCAT([n_name], [CAST(n_regionkey AS STRING)]), ':') AS c, ARRAY_LENGTH(GENERATE_ARRAY(1, n_nationkey)) AS g, ARRAY_SUM([n_nationkey, n_regionkey]) AS s, [n_nationkey, n_regionkey][OFFSET(1)] AS o FROM nation", "SELECT n_nationkey, n_name || ':' || n_regionkey AS c, CAST(n_nationkey AS BIGINT) AS g, CAST(n_nationkey + n_regionkey AS BIGINT) AS s, n_regionkey AS o FROM nation")
text("json_functions", "SELECT event_id, JSON_VALUE(props, '$.k') AS k, JSON_VALUE(props, '$.page') AS p FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.page') AS p FROM events")
text("hash_functions", "SELECT n_nationkey, TO_HEX(MD5(n_name)) AS m, TO_HEX(SHA256(n_name)) AS s FROM nation", "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s FROM nation")
text("conditional_functions", "SELECT c_custkey, IF(c_acctbal > 0, 'pos', 'neg') AS i, NULLIF(c_mktsegment, 'BUILDING') AS n, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS c, GREATEST(c_acctbal, 100) AS g FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'pos' ELSE 'neg' END AS i, NULLIF(c_mktsegment, 'BUILDING') AS n, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS c, GREATEST(c_acctbal, 100) AS g FROM customer")

for _name, _query, _sql in function_queries.queries():
    text(_name, _query, _sql)

# --- time windows, ranges, buckets ------------------------------------------------------


def script(name: str, statements: str, sql: str) -> None:
    """Register a script whose last statement is the result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        io.load(spark, sf_dir)
        return dialect.script(spark, statements)

    QUERIES[name] = run
    ORACLE_SQL[name] = sql


script(
    "dml_text",
    """CREATE OR REPLACE TEMP TABLE dml_text_nation AS SELECT n_nationkey AS k, n_name AS v, n_regionkey AS r FROM nation;
INSERT INTO dml_text_nation (k, v) SELECT r_regionkey + 100, r_name FROM region; INSERT dml_text_nation VALUES (200, 'last', 9);
UPDATE dml_text_nation SET v = CONCAT(v, '!'), r = r + 1 WHERE k > 20; DELETE FROM dml_text_nation WHERE r = 2; SELECT * FROM dml_text_nation""",
    """WITH a AS (SELECT n_nationkey AS k, n_name AS v, n_regionkey AS r FROM nation UNION ALL SELECT r_regionkey + 100, r_name, NULL FROM region UNION ALL SELECT 200, 'last', 9),
b AS (SELECT k, CASE WHEN k > 20 THEN v || '!' ELSE v END AS v, CASE WHEN k > 20 THEN r + 1 ELSE r END AS r FROM a) SELECT * FROM b WHERE r <> 2 OR r IS NULL""",
)
script(
    "dml_insert_modes_text",
    """CREATE TABLE dml_modes (k INT64, v STRING, PRIMARY KEY (k)); INSERT INTO dml_modes (k, v) SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 4;
INSERT OR REPLACE INTO dml_modes (k, v) SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 1; INSERT OR IGNORE INTO dml_modes (k, v) VALUES (0, 'no'), (77, 'yes'); FROM dml_modes""",
    """SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS v FROM nation WHERE n_nationkey < 2 UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 1 UNION ALL SELECT 77, 'yes'""",
)


@frame("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, COUNT(*) AS n, ROUND(SUM(value), 4) AS s FROM events GROUP BY 1, 2")
def tumble(t):
    """Hourly counts by type."""
    e = timeseries.tumble(t("events"), "ts", "1 hour")
    return e.groupBy("event_type", "window_start").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("s"))


@frame("SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(CAST(h AS INTEGER)) AS window_start, COUNT(*) AS n FROM events, range(0, 2) r(h) GROUP BY 1")
def hop(t):
    """Two-hour windows, one every hour."""
    return timeseries.hop(t("events"), "ts", "2 hours", "1 hour").groupBy("window_start").agg(F.count(F.lit(1)).alias("n"))


@frame("SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1950-01-01') AS b FROM events")
def timestamp_bucket(t):
    """Quarter-hour buckets."""
    return t("events").select("event_id", timeseries.bucket_start(F.col("ts"), "15 minutes").alias("b"))


@frame("""WITH r AS (SELECT event_id, user_id, ts AS s, ts + INTERVAL 30 MINUTE AS e FROM events),
n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM r),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS UNBOUNDED PRECEDING) AS id FROM n)
SELECT user_id, min(s) AS session_start, max(e) AS session_end, count(*) AS n FROM k GROUP BY user_id, id""")
def range_sessionize(t):
    """Half-hour activity ranges of users joined into sessions."""
    e = t("events").select("event_id", "user_id", F.col("ts").alias("s"), (F.col("ts") + F.expr("interval 30 minutes")).alias("e"))
    out = timeseries.range_sessionize(e, "s", "e", ["user_id"])
    return out.groupBy("user_id", "session_start", "session_end").agg(F.count(F.lit(1)).alias("n"))


# --- patterns, graphs, vectors, changes ----------------------------------------------------


@frame("""WITH RECURSIVE o AS (SELECT o_custkey AS c, o_orderkey AS k, o_totalprice AS p, row_number() OVER w AS rn,
  CASE WHEN o_totalprice > lag(o_totalprice) OVER w THEN 1 WHEN o_totalprice < lag(o_totalprice) OVER w THEN -1 ELSE 0 END AS d
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
g AS (SELECT *, rn - row_number() OVER (PARTITION BY c, d ORDER BY rn) AS isle FROM o),
u AS (SELECT c, MIN(rn) AS a, MAX(rn) AS b FROM g WHERE d = 1 GROUP BY c, isle),
r AS (SELECT u.c, a, b, p AS low, row_number() OVER (PARTITION BY u.c ORDER BY a) AS r FROM u JOIN o ON o.c = u.c AND rn = b + 1 AND d = -1),
m AS (SELECT c, r, a, b, low, true AS hit, a - 1 AS s FROM r WHERE r = 1 UNION ALL
  SELECT r.c, r.r, r.a, r.b, r.low, NOT (r.a - 2 = m.b AND hit AND r.a = r.b), CASE WHEN r.a - 2 = m.b AND hit THEN r.a ELSE r.a - 1 END
  FROM r JOIN m ON r.c = m.c AND r.r = m.r + 1)
SELECT m.c AS o_custkey, row_number() OVER (PARTITION BY m.c ORDER BY s) AS match_number, k AS first_key, b - s AS ups, low FROM m JOIN o ON o.c = m.c AND rn = s WHERE hit""")
def match_recognize(t):
    """Runs of rising order prices of a customer followed by a fall."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    before = F.lag("o_totalprice").over(w)
    define = {"UP": F.col("o_totalprice") > before, "DOWN": F.col("o_totalprice") < before}
    measures = {"first_key": match.first(None, F.col("o_orderkey")), "ups": F.count_if(F.col("classifier") == "UP"), "low": match.last("DOWN", F.col("o_totalprice"))}
    return match.match_recognize(t("orders"), ["o_custkey"], ["o_orderkey"], "START UP+ DOWN", define, measures)


def _regions(t) -> graph.Graph:
    nodes = t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("nation").alias("label"), F.col("n_regionkey").alias("region"))
    a, b = nodes.alias("a"), nodes.alias("b")
    edges = a.join(b, (F.col("b.id") - F.col("a.id")).isin(1, 4)).select(
        (F.col("a.id") * 100 + F.col("b.id")).alias("id"), F.lit("next").alias("label"), F.col("a.id").alias("src"), F.col("b.id").alias("dst"), (F.col("b.id") - F.col("a.id")).cast("double").alias("cost")
    )
    return graph.Graph(nodes, edges)


_EDGES = "WITH e AS (SELECT a.n_nationkey AS s, b.n_nationkey AS d FROM nation a JOIN nation b ON b.n_nationkey - a.n_nationkey IN (1, 4))"


@frame(f"{_EDGES} SELECT CAST(x.s AS BIGINT) AS start, CAST(y.d AS BIGINT) AS \"end\" FROM e x JOIN e y ON x.d = y.s JOIN nation n ON n.n_nationkey = x.s WHERE n.n_regionkey = 1")
def graph_two_hops(t):
    """Paths of two edges that begin in one region."""
    return _regions(t).match(graph.Hop("next"), graph.Hop("next"), start_filter=F.col("n.region") == 1).select("start", "end")


@frame("SELECT CAST(a.n_nationkey AS BIGINT) AS start, CAST(b.n_nationkey AS BIGINT) AS \"end\", CAST((b.n_nationkey - a.n_nationkey) // 4 + (b.n_nationkey - a.n_nationkey) % 4 AS INTEGER) AS length FROM nation a JOIN nation b ON b.n_nationkey > a.n_nationkey")
def graph_shortest(t):
    """The shortest path between every two nations that one leads to."""
    out = _regions(t).match(graph.Hop("next", low=1, high=None), search="ANY SHORTEST", mode="WALK")
    return out.select("start", "end", "length")


@frame("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT query_id, vec_id, sqrt(list_sum(list_transform(list_zip(embedding, q), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))) AS distance FROM embeddings, q)
SELECT query_id, vec_id, ROUND(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 5""")
def vector_search(t):
    """The five nearest vectors to every twentieth, exactly."""
    e = t("embeddings").select("vec_id", "embedding")
    out = vectors.vector_search(e, e.where("vec_id % 20 = 0"), "embedding", "embedding", "vec_id", top_k=5, distance="EUCLIDEAN")
    return out.select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


@frame("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT r_regionkey + 100, r_name, r_regionkey FROM region")
def dml_merge(t):
    """MERGE: regions come in as new rows, one row goes, some change."""
    new = t("region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey"))
    out = dml.merge(t("nation"), new, ["n_nationkey"])
    out = dml.update(out, (F.col("n_regionkey") == 1) & (F.col("n_nationkey") < 100), {"n_name": F.concat(F.upper("n_name"), F.lit("!"))})
    return dml.delete(out, F.col("n_nationkey") == 3)


@frame("SELECT o_orderpriority, least(count(*), 10) AS n FROM orders GROUP BY o_orderpriority")
def stratified_sample(t):
    """Ten rows of each priority."""
    return relational.sample_rows(t("orders"), 10, by=["o_orderpriority"], seed=7).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
