"""Hand-built cases of the relational operators, sources and compatibility helpers."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.catalog import Catalog
from tributary.engine import Engine
from tributary.functions import compat
from tributary.operators import quality
from tributary.operators import relational as rel
from tributary.sources import tables as src


def test_delimited_source(spark):
    lines = spark.createDataFrame([("1|a|2.5|2024-01-15|",), ("",), ("2|b",), ("3|c|1|1969-12-31|extra|x",)], "value string")
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("s", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("d", T.DateType())])
    rows = src.parse_delimited(lines, schema).orderBy("i").collect()
    assert [(r.i, r.s, r.x, str(r.d)) for r in rows] == [(1, "a", 2.5, "2024-01-15"), (3, "c", 1.0, "1969-12-31")]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        src.parse_delimited(spark.createDataFrame([("x|a|1|2024-01-01",)], "value string"), schema).collect()


def test_files(spark, tmp_path):
    trace = spark.createDataFrame([(0, 5), (1, 7)], src.TRACE)
    src.write_trace(trace, f"{tmp_path}/t")
    assert src.read_trace(spark, f"{tmp_path}/t").count() == 2
    src.write_csv(spark.createDataFrame([('a"b,c', 12.0)], "s string, x double").coalesce(1), f"{tmp_path}/c")
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("part-*"))
    assert text == 's,x\n"a""b,c",12.0\n'


def test_compat(spark):
    r = spark.range(1).select(
        compat.int_div(F.lit(-7), F.lit(2)).alias("a"), compat.int_div(F.lit(2**62 + 1), F.lit(1)).alias("b"), compat.float_div(F.lit(-1.0), F.lit(0.0)).alias("c"), compat.case_zero((F.lit(False), F.lit(5))).alias("d"),
        *(compat.decimal_text(F.lit(x)).alias(f"t{i}") for i, x in enumerate([12.5, 12.0, 10.336, 100.0])),
    ).first()
    assert tuple(r) == (-3, 2**62 + 1, float("inf"), 0, "12.5", "12.0", "10.34", "100.0")
    empty = spark.createDataFrame([], "v int").agg(compat.sum0(F.col("v")), compat.avg0(F.col("v")), compat.min0(F.col("v")))
    assert tuple(empty.first()) == (0.0, 0.0, 0)


def test_joins_and_groups(spark):
    a = spark.createDataFrame([(2, "L1"), (2, "L2"), (3, "L3")], "k int, v string")
    b = spark.createDataFrame([(2, "R1"), (2, "R2")], "k int, w string")
    assert rel.join(a, b, ["k"]).count() == 4
    assert rel.join(a, b, ["k"], "left", right_bytes=100).where("w IS NULL").collect()[0].v == "L3"
    empty = spark.createDataFrame([], "id int, val int")
    assert rel.aggregate(empty, [], n=F.count("*")).first().n == 0
    assert rel.aggregate(empty, ["id"], n=F.count("*")).count() == 0
    assert [r.k for r in rel.top(a, 1, F.desc("k")).collect()] == [3]


def test_catalog_and_engine(spark):
    c = Catalog(spark)
    df = spark.range(10).select("id", (F.col("id") % 3).alias("category"), F.lit("x").alias("s"))
    assert c.create_table("t_stats", df) and not c.create_table("t_stats", df)
    s = c.update_stats("t_stats")
    assert s.rows == 10 and s.distinct == {"id": 10, "category": 3, "s": 1}
    assert c.create_index("i", "t_stats", "id") and c.table_indexes("t_stats") == {"i": "id"}
    with pytest.raises(TypeError):
        c.create_index("j", "t_stats", "s")
    with pytest.raises(KeyError):
        c.get_table("none")
    e = Engine(spark)
    e.catalog.create_table("t_sql", df)
    sql = e.execute_sql("SELECT category, count(*) AS n FROM t_sql WHERE id BETWEEN 2 AND 8 GROUP BY category ORDER BY category;")
    assert quality.same_rows(sql, rel.aggregate(rel.index_scan(df, "id", 2, 8), ["category"], n=F.count("*")))
    with pytest.raises(ValueError):
        e.execute_sql("DROP TABLE t_sql")


@settings(max_examples=5, deadline=None)
@given(st.integers(-5, 5), st.integers(-5, 5))
def test_between_is_two_comparisons(spark, low, high):
    df = spark.range(-6, 7)
    assert df.where(F.col("id").between(low, high)).count() == df.where((F.col("id") >= low) & (F.col("id") <= high)).count()


def test_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, float("nan"))], "a double, b double")
    rows = {r.column_name: r for r in quality.constant_columns(df, ["a", "b"]).collect()}
    assert rows["a"].is_constant and rows["b"].non_finite == 1


def test_results_compare_within_a_tolerance(spark):
    a = spark.createDataFrame([("x", 1.0), ("x", 2.0), (None, 3.0)], "k string, v double")
    b = spark.createDataFrame([(None, 3.004), ("x", 2.0001), ("x", 0.9999)], "k string, v double")
    assert quality.same_rows(a, b) and not quality.same_rows(a, b, 0.001)
    assert not quality.same_rows(a, b.limit(2)) and not quality.same_rows(a, b.toDF("k", "w"))
    assert [(r.column_name, r.expected, r.actual) for r in quality.mismatches(a, b, 0.001).collect()] == [("v", "3.0", "3.004")]


def test_a_second_folder_replaces_the_first(spark, tmp_path):
    for i in (1, 2):
        spark.range(i).select("id", (F.col("id") * i).alias("v")).write.parquet(f"{tmp_path}/{i}/replaced.parquet")
    e = Engine(spark).load_folder(f"{tmp_path}/1", "replaced")
    e.catalog.update_stats("replaced")
    e.catalog.create_index("on_id", "replaced", "id")
    e.load_folder(f"{tmp_path}/2", "replaced")
    assert e.execute_sql("WITH r AS (SELECT * FROM replaced) SELECT count(*) AS n FROM r").first().n == 2
    assert "replaced" not in e.catalog.stats and not e.catalog.table_indexes("replaced")


def test_latency_csv(tmp_path):
    src.write_latencies([("q1", 4, 12.34567), ("a,b", 0, 1.0)], f"{tmp_path}/x.csv")
    assert open(f"{tmp_path}/x.csv").read().splitlines() == ["query,rows,latency_ms", "q1,4,12.346", '"a,b",0,1.000']


def test_label_cap_and_split(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("s"), (F.col("id") / 50).alias("label"))
    assert quality.cap_labels(df, "label").agg(F.max("label")).first()[0] == quality.LABEL_CAP
    assert quality.cap_labels(df, "label", None).agg(F.max("label")).first()[0] > 19
    shares = {r.s: r.n / r.m for r in quality.split_80_20(df, "s", F.col("id")).groupBy("s").agg(F.count_if("is_train").alias("n"), F.count("*").alias("m")).collect()}
    assert all(0.79 < x < 0.81 for x in shares.values())
