"""The eight workload queries, adapted to the columns and dates of the tables here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col


def _net() -> Column:
    """Price after discount."""
    return c("l_extendedprice") * (1 - c("l_discount"))




def query(name: str, sql: str) -> Callable[[Callable[[Callable[[str], DataFrame]], DataFrame]], None]:
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> None:
        QUERIES[name] = lambda spark, folder: f(lambda t: table(spark, folder, t))
        ORACLES[name] = sql

    return add


@query("tpch_q1", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_quantity, round(sum(l_extendedprice), 2) AS sum_extendedprice, round(sum(l_discount), 2) AS sum_discount, count(*) AS count_star FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2 ORDER BY 1, 2")
def _(t):
    li = t("lineitem").where(c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    sums = [F.round(F.sum(f"l_{x}"), 2).alias(f"sum_{x}") for x in ("quantity", "extendedprice", "discount")]
    return li.groupBy("l_returnflag", "l_linestatus").agg(*sums, F.count("*").alias("count_star")).orderBy("l_returnflag", "l_linestatus")


@query("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS sum_disc_price FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05::DOUBLE AND 0.07::DOUBLE AND l_quantity < 24")
def _(t):
    li = t("lineitem").where((c("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (c("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")) & c("l_discount").between(0.05, 0.07) & (c("l_quantity") < 24))
    return li.agg(F.round(F.sum(c("l_extendedprice") * c("l_discount")), 2).alias("sum_disc_price"))


@query("tpch_q3", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    at = F.lit("1998-03-15").cast("timestamp_ntz")
    o = t("orders").where(c("o_orderdate") < at).join(t("customer").where("c_mktsegment = 'BUILDING'"), c("o_custkey") == c("c_custkey"))
    j = t("lineitem").where(c("l_shipdate") > at).join(o, c("l_orderkey") == c("o_orderkey"))
    return j.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(_net()), 2).alias("sum_disc_price")).orderBy(F.desc("sum_disc_price"), "l_orderkey").limit(10)


@query("tpch_q5", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY n_name ORDER BY 2 DESC")
def _(t):
    o = t("orders").where((c("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (c("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")))
    s = t("supplier").join(t("nation"), c("s_nationkey") == c("n_nationkey"))
    j = t("lineitem").join(o, c("l_orderkey") == c("o_orderkey")).join(t("customer"), c("o_custkey") == c("c_custkey")).join(s, c("l_suppkey") == c("s_suppkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(_net()), 2).alias("sum_disc_price")).orderBy(F.desc("sum_disc_price"))


@query("tpch_q10", "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, c_acctbal, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY 3 DESC, 1 LIMIT 20")
def _(t):
    o = t("orders").where((c("o_orderdate") >= F.lit("1996-10-01").cast("timestamp_ntz")) & (c("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")))
    j = t("lineitem").where("l_returnflag = 'R'").join(o, c("l_orderkey") == c("o_orderkey")).join(t("customer"), c("o_custkey") == c("c_custkey")).join(t("nation"), c("c_nationkey") == c("n_nationkey"))
    return j.groupBy("c_custkey", "c_name", "c_acctbal", "n_name").agg(F.round(F.sum(_net()), 2).alias("sum_disc_price")).orderBy(F.desc("sum_disc_price"), "c_custkey").limit(20)


@query("tpch_q12", "SELECT l_linestatus, sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END)::DOUBLE AS high_line_count, sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END)::DOUBLE AS low_line_count FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND o_orderdate < l_shipdate AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY 1 ORDER BY 1")
def _(t):
    li = t("lineitem").where(c("l_returnflag").isin("A", "R") & (c("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (c("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")))
    j = li.join(t("orders"), (c("o_orderkey") == c("l_orderkey")) & (c("o_orderdate") < c("l_shipdate")))
    high = c("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return j.groupBy("l_linestatus").agg(F.sum(F.when(high, 1.0).otherwise(0.0)).alias("high_line_count"), F.sum(F.when(~high, 1.0).otherwise(0.0)).alias("low_line_count")).orderBy("l_linestatus")


@query("tpch_q14", "SELECT round(100.0::DOUBLE * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-10-01'")
def _(t):
    li = t("lineitem").where((c("l_shipdate") >= F.lit("1996-09-01").cast("timestamp_ntz")) & (c("l_shipdate") < F.lit("1996-10-01").cast("timestamp_ntz")))
    j = li.join(t("part"), c("l_partkey") == c("p_partkey"))
    return j.agg(F.round(100.0 * F.sum(F.when(c("p_type").like("PROMO%"), _net()).otherwise(0.0)) / F.sum(_net()), 6).alias("promo_revenue"))


_Q19 = [("Brand#12", ("SMALL", "ECONOMY"), 1, 11, 15), ("Brand#23", ("MEDIUM", "STANDARD"), 10, 20, 25), ("Brand#14", ("LARGE", "PROMO"), 20, 30, 40)]


@query("tpch_q19", "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem, part WHERE " + " OR ".join(f"(p_partkey = l_partkey AND p_brand = '{b}' AND p_type IN {k} AND l_quantity BETWEEN {lo} AND {hi} AND p_size BETWEEN 1 AND {size})" for b, k, lo, hi, size in _Q19))
def _(t):
    any_of = F.lit(False)
    for b, k, lo, hi, size in _Q19:
        any_of = any_of | ((c("p_brand") == b) & c("p_type").isin(*k) & c("l_quantity").between(lo, hi) & c("p_size").between(1, size))
    return t("lineitem").join(t("part"), (c("l_partkey") == c("p_partkey")) & any_of).agg(F.round(F.sum(_net()), 2).alias("revenue"))
