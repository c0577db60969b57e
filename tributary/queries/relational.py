"""Scans, predicates, scalar expressions, joins, aggregates, sorting: one query and its SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import column_stats
from ..functions import compat
from ..operators import relational as rel
from ..sources import tables as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
c = F.col
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def query(name: str, sql: str, *tables: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register f(*tables) under a name with its SQL."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, folder: f(*(src.table(spark, folder, t) for t in tables))
        ORACLES[name] = sql
        return f

    return add


def simple(name: str, sql: str, table: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql, table)(f)


# Scans, sources, sinks
simple("scan_full", "SELECT * FROM customer", "customer", lambda d: rel.scan(d))
simple("scan_index_range", "SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 5000", "orders", lambda d: rel.index_scan(d, "o_orderkey", 100, 5000))
simple("scan_index_point", "SELECT * FROM customer WHERE c_custkey = 77", "customer", lambda d: rel.index_scan(d, "c_custkey", 77, 77))
simple("scan_index_low", "SELECT * FROM part WHERE p_partkey >= 150", "part", lambda d: rel.index_scan(d, "p_partkey", low=150))
simple("scan_index_high", "SELECT * FROM supplier WHERE s_suppkey <= 40", "supplier", lambda d: rel.index_scan(d, "s_suppkey", high=40))
simple(
    "dml_append",
    "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, 'NEW_' || n_name FROM nation",
    "nation",
    lambda d: src.append(d.select("n_nationkey", "n_name"), d.select((c("n_nationkey") + 100).alias("n_nationkey"), F.concat(F.lit("NEW_"), "n_name").alias("n_name"))),
)
simple("dml_delete_filter", "SELECT * FROM supplier WHERE NOT coalesce(s_acctbal < 0, false)", "supplier", lambda d: src.delete(d, c("s_acctbal") < 0))
_PART = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()), T.StructField("p_size", T.IntegerType()), T.StructField("p_retailprice", T.DoubleType())])
simple(
    "source_delimited",
    "SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_partkey % 10 <> 0",
    "part",
    # Every tenth line is too short and is skipped; all end with a delimiter.
    lambda d: src.parse_delimited(d.select(F.when(c("p_partkey") % 10 == 0, c("p_partkey").cast("string")).otherwise(F.concat(F.concat_ws("|", "p_partkey", "p_name", "p_size", "p_retailprice"), F.lit("|"))).alias("value")), _PART),
)
simple(
    "sink_csv_render",
    r"""SELECT c_custkey || ',' || CASE WHEN regexp_matches(c_name, '[",\r\n]') THEN '"' || replace(c_name, '"', '""') || '"' ELSE c_name END || ',' || regexp_replace(printf('%.2f', c_acctbal), '(\.\d)0$', '\1') AS line FROM customer""",
    "customer",
    lambda d: src.render_csv(d.select("c_custkey", "c_name", "c_acctbal")),
)
simple("union_all_parts", "SELECT o_orderkey, o_orderstatus FROM orders", "orders", lambda d: src.append(d.where("o_orderstatus = 'F'"), d.where("o_orderstatus <> 'F'")).select("o_orderkey", "o_orderstatus"))

# Catalog
simple(
    "table_stats",
    "SELECT 'o_orderkey' AS column_name, count(*) AS row_count, count(DISTINCT o_orderkey) AS ndv FROM orders UNION ALL SELECT 'o_custkey', count(*), count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'o_orderpriority', count(*), count(DISTINCT o_orderpriority) FROM orders",
    "orders",
    lambda d: column_stats(d, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]),
)


@query("table_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in NAMES), *NAMES)
def _(*frames: DataFrame) -> DataFrame:
    out = None
    for name, d in zip(NAMES, frames):
        one = d.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


# Projections and predicates
simple("project_columns", "SELECT c_name, c_custkey FROM customer", "customer", lambda d: rel.scan(d, ["c_name", "c_custkey"]))
simple("project_arith", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax - 1, 4) AS net FROM lineitem", "lineitem", lambda d: d.select("l_orderkey", "l_linenumber", F.round(c("l_extendedprice") * (1 - c("l_discount")) + c("l_tax") - 1, 4).alias("net")))
simple("project_alias", "SELECT s.s_name AS supplier_name, s.s_suppkey AS id FROM supplier s", "supplier", lambda d: rel.project(d.alias("s"), supplier_name=c("s.s_name"), id=c("s.s_suppkey")))
for _name, _table, _cond in [
    ("filter_compare", "lineitem", "l_quantity > 45 AND l_discount <= 0.02"),
    ("filter_not_equal", "orders", "o_orderstatus <> 'F'"),
    ("filter_and_or", "part", "(p_size < 10 AND p_type = 'PROMO') OR p_brand = 'Brand#3'"),
    ("filter_not", "customer", "NOT c_mktsegment = 'BUILDING'"),
    ("filter_between", "part", "p_size BETWEEN 10 AND 20"),
    ("filter_not_between", "part", "p_size NOT BETWEEN 10 AND 20"),
    ("filter_in", "part", "p_brand IN ('Brand#1', 'Brand#12', 'Brand#23')"),
    ("filter_not_in", "orders", "o_orderstatus NOT IN ('P', 'O')"),
    ("filter_like_prefix", "part", "p_type LIKE 'PROMO%'"),
    ("filter_like_suffix", "customer", "c_name LIKE '%7'"),
    ("filter_like_contains", "customer", "c_name LIKE '%00%1%'"),
    ("filter_like_underscore", "nation", "n_name LIKE 'NATION__'"),
    ("filter_not_like", "part", "p_type NOT LIKE '%O%'"),
    ("filter_col_col", "lineitem", "l_extendedprice < l_quantity * 1000"),
]:
    simple(_name, f"SELECT * FROM {_table} WHERE {_cond}", _table, lambda d, cond=_cond: d.where(F.expr(cond)))
simple("filter_date_range", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'", "orders", lambda d: d.where((c("o_orderdate") >= "1996-01-01") & (c("o_orderdate") < "1997-01-01")).select("o_orderkey", "o_orderdate"))
simple("filter_date_literal", "SELECT count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02'", "lineitem", lambda d: d.where(F.expr("l_shipdate <= DATE '1998-09-02'")).agg(F.count("*").alias("n")))

# Scalar expressions
simple("project_literal", "SELECT r_regionkey, 7 AS i, 0.05::DOUBLE AS f, 'it''s' AS s, CAST(DATE '1998-09-02' AS VARCHAR) AS d FROM region", "region", lambda d: d.select("r_regionkey", F.lit(7).alias("i"), F.lit(0.05).alias("f"), F.lit("it's").alias("s"), F.expr("DATE '1998-09-02'").cast("string").alias("d")))
simple("project_int_div", "SELECT p_partkey, (p_partkey // 7)::BIGINT AS a, CAST(trunc(-p_size / 4) AS BIGINT) AS b FROM part", "part", lambda d: d.select("p_partkey", compat.int_div(c("p_partkey"), F.lit(7)).alias("a"), compat.int_div(-c("p_size"), F.lit(4)).alias("b")))
simple("project_float_div", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN round(l_quantity / l_discount, 4) END AS quotient, l_discount = 0 AS is_infinite FROM lineitem", "lineitem", lambda d: d.select("l_orderkey", "l_linenumber", compat.float_div(c("l_quantity"), c("l_discount")).alias("x")).select("l_orderkey", "l_linenumber", F.when(c("x") != float("inf"), F.round("x", 4)).alias("quotient"), (c("x") == float("inf")).alias("is_infinite")))
simple("project_negate", "SELECT c_custkey, -c_acctbal AS negated FROM customer", "customer", lambda d: d.select("c_custkey", (-c("c_acctbal")).alias("negated")))
simple("case_searched", "SELECT p_partkey, CASE WHEN p_size > 30 THEN 'large' WHEN p_size > 10 THEN 'medium' ELSE 'small' END AS size_class FROM part", "part", lambda d: d.select("p_partkey", F.when(c("p_size") > 30, "large").when(c("p_size") > 10, "medium").otherwise("small").alias("size_class")))
simple("case_no_else", "SELECT p_partkey, CASE WHEN p_size > 30 THEN p_size ELSE 0 END AS v FROM part", "part", lambda d: d.select("p_partkey", compat.case_zero((c("p_size") > 30, c("p_size"))).alias("v")))
simple("case_nested", "SELECT p_partkey, CASE WHEN p_size > 25 THEN CASE WHEN p_type = 'PROMO' THEN 1 ELSE 2 END ELSE 3 END AS v FROM part", "part", lambda d: d.select("p_partkey", F.when(c("p_size") > 25, F.when(c("p_type") == "PROMO", 1).otherwise(2)).otherwise(3).alias("v")))
simple("date_to_string", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS s FROM orders", "orders", lambda d: d.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("s")))
simple("string_to_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d')::DATE::VARCHAR AS d FROM orders", "orders", lambda d: d.select("o_orderkey", F.to_date(F.date_format("o_orderdate", "yyyy-MM-dd"), "yyyy-MM-dd").cast("string").alias("d")))
simple("date_epoch_days", "SELECT o_orderkey, (o_orderdate::DATE - DATE '1970-01-01')::BIGINT AS days, o_orderdate::DATE::VARCHAR AS back FROM orders", "orders", lambda d: d.select("o_orderkey", F.unix_date(F.to_date("o_orderdate")).cast("long").alias("days"), F.date_from_unix_date(F.unix_date(F.to_date("o_orderdate"))).cast("string").alias("back")))


# Joins
@query("join_inner_hash", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", "orders", "customer")
def _(o: DataFrame, cu: DataFrame) -> DataFrame:
    return rel.join(o, cu, o.o_custkey == cu.c_custkey).select("o_orderkey", "c_name")


@query("join_many_to_many", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey", "supplier", "customer")
def _(s: DataFrame, cu: DataFrame) -> DataFrame:
    return rel.join(s, cu, s.s_nationkey == cu.c_nationkey).select("s_suppkey", "c_custkey")


@query("join_compound_key", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND o_custkey = l_partkey", "orders", "lineitem")
def _(o: DataFrame, li: DataFrame) -> DataFrame:
    return rel.join(o, li, (o.o_orderkey == li.l_orderkey) & (o.o_custkey == li.l_partkey)).select("o_orderkey", "l_linenumber", "l_quantity")


@query("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey", "nation", "nation")
def _(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.alias("a").join(b.alias("b"), c("a.n_nationkey") < c("b.n_nationkey")).select(c("a.n_nationkey").alias("a"), c("b.n_nationkey").alias("b"))


@query("join_equi_residual", "SELECT o_orderkey, l_linenumber, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice", "orders", "lineitem")
def _(o: DataFrame, li: DataFrame) -> DataFrame:
    return rel.join(o, li, (o.o_orderkey == li.l_orderkey) & (li.l_extendedprice > o.o_totalprice)).select("o_orderkey", "l_linenumber", "l_shipdate")


@query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation", "region", "nation")
def _(r: DataFrame, n: DataFrame) -> DataFrame:
    return r.crossJoin(n).select("r_name", "n_name")


@query(
    "join_comma_4way",
    "SELECT n_name, count(*) AS n FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND c_nationkey = n_nationkey AND l_returnflag = 'R' GROUP BY n_name",
    "customer", "orders", "lineitem", "nation",
)
def _(cu: DataFrame, o: DataFrame, li: DataFrame, n: DataFrame) -> DataFrame:
    j = li.where("l_returnflag = 'R'").join(o, c("l_orderkey") == c("o_orderkey")).join(cu, c("c_custkey") == c("o_custkey")).join(n, c("c_nationkey") == c("n_nationkey"))
    return rel.aggregate(j, ["n_name"], n=F.count("*"))


@query("join_left_outer", "SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey, o_orderkey IS NULL AS unmatched FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'", "customer", "orders")
def _(cu: DataFrame, o: DataFrame) -> DataFrame:
    return rel.join(cu, o, (cu.c_custkey == o.o_custkey) & (o.o_orderstatus == "P"), "left").select("c_custkey", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"), c("o_orderkey").isNull().alias("unmatched"))


@query("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "nation", "nation")
def _(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.alias("a").join(b.alias("b"), (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))).select(c("a.n_name").alias("a"), c("b.n_name").alias("b"))


# Aggregates


def _net() -> Column:
    """Price after discount."""
    return c("l_extendedprice") * (1 - c("l_discount"))


simple("agg_group_by", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1", "orders", lambda d: rel.aggregate(d, ["o_orderstatus"], n=F.count("*"), total=F.round(F.sum("o_totalprice"), 2)))
simple("agg_global", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem", "lineitem", lambda d: rel.aggregate(d, [], n=F.count("*"), q=F.round(F.sum("l_quantity"), 2)))
simple("agg_empty_global", "SELECT count(*) AS n, sum(l_quantity) AS s, max(l_quantity) AS m FROM lineitem WHERE l_quantity < 0", "lineitem", lambda d: rel.aggregate(d.where("l_quantity < 0"), [], n=F.count("*"), s=F.sum("l_quantity"), m=F.max("l_quantity")))
simple("agg_empty_compat", "SELECT coalesce(sum(l_quantity), 0.0) AS s, coalesce(avg(l_quantity), 0.0) AS a, coalesce(min(l_quantity), 0) AS lo, coalesce(max(l_quantity), 0) AS hi FROM lineitem WHERE l_quantity < 0", "lineitem", lambda d: rel.aggregate(d.where("l_quantity < 0"), [], s=compat.sum0(c("l_quantity")), a=compat.avg0(c("l_quantity")), lo=compat.min0(c("l_quantity")), hi=compat.max0(c("l_quantity"))))
simple("agg_count", "SELECT count(*) AS n, count(l_tax) AS n_tax FROM lineitem", "lineitem", lambda d: rel.aggregate(d, [], n=F.count("*"), n_tax=F.count("l_tax")))
simple("agg_sum", "SELECT l_linenumber, sum(CAST(l_linenumber AS DOUBLE)) AS s FROM lineitem GROUP BY 1", "lineitem", lambda d: rel.aggregate(d, ["l_linenumber"], s=compat.sum_double(c("l_linenumber"))))
simple("agg_avg", "SELECT p_brand, round(avg(p_size), 6) AS a FROM part GROUP BY 1", "part", lambda d: rel.aggregate(d, ["p_brand"], a=F.round(F.avg("p_size"), 6)))
simple("agg_min_max", "SELECT p_type, min(p_size) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1", "part", lambda d: rel.aggregate(d, ["p_type"], lo=F.min("p_size"), hi=F.max("p_retailprice")))
simple("agg_min_max_string_date", "SELECT o_orderstatus, min(o_orderpriority) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1", "orders", lambda d: rel.aggregate(d, ["o_orderstatus"], lo=F.min("o_orderpriority"), hi=F.max("o_orderdate")))
simple("agg_expr", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net FROM lineitem GROUP BY 1", "lineitem", lambda d: rel.aggregate(d, ["l_returnflag"], net=F.round(F.sum(_net()), 2)))
simple("agg_conditional_sum", "SELECT o_orderstatus, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0 END) AS urgent FROM orders GROUP BY 1", "orders", lambda d: rel.aggregate(d, ["o_orderstatus"], urgent=F.sum(F.when(c("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0))))
simple("agg_of_agg_arith", "SELECT l_returnflag, round(100.0::DOUBLE * sum(l_discount) / sum(l_quantity), 6) AS ratio FROM lineitem GROUP BY 1", "lineitem", lambda d: rel.aggregate(d, ["l_returnflag"], ratio=F.round(100.0 * F.sum("l_discount") / F.sum("l_quantity"), 6)))
simple("group_by_distinct", "SELECT p_brand, p_type FROM part GROUP BY 1, 2", "part", lambda d: rel.distinct(d, "p_brand", "p_type"))
simple("agg_multi_key", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3", "lineitem", lambda d: rel.aggregate(d, ["l_returnflag", "l_linestatus", "l_linenumber"], n=F.count("*")))
simple("having_agg", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12", "orders", lambda d: rel.aggregate(d, ["o_custkey"], c("n") > 12, n=F.count("*")))
simple("having_group_col", "SELECT p_size, count(*) AS n FROM part GROUP BY p_size HAVING p_size > 40", "part", lambda d: rel.aggregate(d, ["p_size"], c("p_size") > 40, n=F.count("*")))


# Sorting: the place in the order is a column, so that the order itself is compared
def _ranked(d: DataFrame, n: int, *keys) -> DataFrame:
    """The first n rows in order, with their place."""
    return rel.top(d, n, *keys).withColumn("place", F.row_number().over(Window.orderBy(*keys)))


simple("sort_multi_key", "SELECT n_regionkey, n_name, row_number() OVER (ORDER BY n_regionkey, n_name) AS place FROM nation", "nation", lambda d: rel.sort(d.select("n_regionkey", "n_name"), c("n_regionkey"), c("n_name")).withColumn("place", F.row_number().over(Window.orderBy("n_regionkey", "n_name"))))
simple("sort_mixed_dir", "SELECT n_regionkey, n_name, row_number() OVER (ORDER BY n_regionkey DESC, n_name) AS place FROM nation", "nation", lambda d: rel.sort(d.select("n_regionkey", "n_name"), F.desc("n_regionkey"), c("n_name")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_regionkey"), "n_name"))))
simple("sort_by_agg", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand", "part", lambda d: rel.sort(rel.aggregate(d, ["p_brand"], n=F.count("*")), F.desc("n"), c("p_brand")))
simple("sort_by_alias", "SELECT s_suppkey, -s_acctbal AS debt FROM supplier ORDER BY debt, s_suppkey", "supplier", lambda d: rel.sort(d.select("s_suppkey", (-c("s_acctbal")).alias("debt")), c("debt"), c("s_suppkey")))
simple("limit_n", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 17", "customer", lambda d: rel.top(d.select("c_custkey", "c_name"), 17, c("c_custkey")))
simple("limit_zero", "SELECT c_custkey FROM customer LIMIT 0", "customer", lambda d: d.select("c_custkey").limit(0))
simple("topk", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "orders", lambda d: _ranked(d.select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), c("o_orderkey")))
