"""Checks and preparation of training tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, minimum, maximum, non_finite, is_constant) of number columns, in one pass."""
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        odd = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        parts += [F.min(x).alias(f"{c}_lo"), F.max(x).alias(f"{c}_hi"), F.sum(odd.cast("long")).alias(f"{c}_bad")]
    one = df.agg(*parts)
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_lo").alias("minimum"), F.col(f"{c}_hi").alias("maximum"), F.coalesce(f"{c}_bad", F.lit(0)).alias("non_finite")) for c in columns))
    return one.select(F.explode(rows).alias("x")).select("x.*").withColumn("is_constant", F.col("minimum") == F.col("maximum"))


def correlated_pairs(df: DataFrame, columns: list[str], above: float = 0.99) -> DataFrame:
    """(column_a, column_b, correlation, too_close) of all pairs, in one pass."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(rows).alias("x")).select("x.*").withColumn("too_close", F.abs("correlation") > above)


#: Fixed value: labels above log(10001) say no more than that the next use is far.
LABEL_CAP = 9.21


def cap_labels(df: DataFrame, label: str, cap: float | None = LABEL_CAP) -> DataFrame:
    """Labels above the cap become the cap; no cap (or one of 0) leaves them."""
    return df.withColumn(label, F.least(F.col(label), F.lit(float(cap)))) if cap else df


def split_80_20(df: DataFrame, stratum: str, key: Column) -> DataFrame:
    """is_train: the first four fifths of each stratum in the order of a hash of the key, which must be unique."""
    w = Window.partitionBy(stratum).orderBy(F.md5(key.cast("string").cast("binary")), key)
    return df.withColumn("is_train", F.percent_rank().over(w) < 0.8)


def training_report(df: DataFrame, features: list[str], stratum: str, order: list[str], strata: tuple[int, int], least: int = 100) -> DataFrame:
    """(check, detail, value, warning) of a table of training samples.

    Not finite features, strata outside the bounds, orders that leave 0 to len(order) - 1 or repeat a place among the
    stratum's first, rows by stratum, constant features, pairs that correlate, and different orders.
    """
    places = F.array(*(F.col(c) for c in order))
    used = F.slice(places, 1, F.greatest(F.col(stratum), F.lit(1)))
    bad = F.exists(places, lambda x: x.isNull() | (x < 0) | (x >= len(order))) | (F.size(F.array_distinct(used)) < F.size(used))
    outside = F.col(stratum).isNull() | ~F.col(stratum).between(*strata)
    one = df.agg(F.count_if(outside).alias("a"), F.count_if(F.coalesce(bad, F.lit(True))).alias("b"), F.countDistinct(F.concat_ws(",", *order)).alias("c"))
    row = lambda check, value, warning: F.struct(F.lit(check).alias("check"), F.lit("").alias("detail"), value.cast("double").alias("value"), warning.alias("warning"))
    out = one.select(F.explode(F.array(row("stratum_outside", F.col("a"), F.col("a") > 0), row("order_invalid", F.col("b"), F.col("b") > 0), row("orders_distinct", F.col("c"), F.col("c") <= 10))).alias("x")).select("x.*")
    sizes = df.groupBy(F.col(stratum).cast("string").alias("detail")).agg(F.count("*").cast("double").alias("value"))
    out = out.unionByName(sizes.select(F.lit("stratum_rows").alias("check"), "detail", "value", (F.col("value") < least).alias("warning")))
    constant = constant_columns(df, features)
    for check, value, warning in (("feature_not_finite", F.col("non_finite").cast("double"), F.col("non_finite") > 0), ("feature_constant", F.col("is_constant").cast("double"), F.col("is_constant"))):
        out = out.unionByName(constant.select(F.lit(check).alias("check"), F.col("column_name").alias("detail"), value.alias("value"), warning.alias("warning")))
    pairs = correlated_pairs(df, features).where("too_close AND NOT isnan(correlation)")
    return out.unionByName(pairs.select(F.lit("features_correlate").alias("check"), F.concat_ws("~", "column_a", "column_b").alias("detail"), F.col("correlation").alias("value"), F.lit(True).alias("warning")))


def standardise(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """z_<column>: less the training mean, over the training deviation (1 if that is 0)."""
    stats = df.where(train).agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    out = df.crossJoin(F.broadcast(stats))  # one row
    z = {f"z_{c}": (F.col(c) - F.col(f"__m_{c}")) / F.when(F.coalesce(F.col(f"__s_{c}"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col(f"__s_{c}")) for c in columns}
    return out.withColumns(z).drop(*(f"__{n}_{c}" for c in columns for n in "ms"))


def mismatches(a: DataFrame, b: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(place, column_name, expected, actual): the cells of two results that differ: numbers by more than the tolerance.

    Rows are paired by their other cells and, among rows with equal ones, by the order of their numbers. Raises ValueError if the headers or the numbers of rows differ.
    """
    if a.columns != b.columns:
        raise ValueError(f"header mismatch: {a.columns} and {b.columns}")
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"row count mismatch: {n} and {m}")
    numbers = {c for c, kind in a.dtypes if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal")}
    keys = [i for i, c in enumerate(a.columns) if c not in numbers]

    def numbered(df: DataFrame, name: str) -> DataFrame:
        """Rows with equal other cells are in the order of their numbers."""
        own = df.toDF(*(f"{name}{i}" for i in range(len(df.columns))))
        by = Window.partitionBy(*(f"{name}{i}" for i in keys)).orderBy(*(f"{name}{i}" for i in range(len(df.columns))))
        return own.withColumn(f"{name}_place", F.row_number().over(by))

    on = F.col("x_place") == F.col("y_place")
    for i in keys:
        on = on & F.col(f"x{i}").eqNullSafe(F.col(f"y{i}"))
    both = numbered(a, "x").join(numbered(b, "y"), on, "full_outer")
    cells = []
    for i, c in enumerate(a.columns):
        p, q = F.col(f"x{i}"), F.col(f"y{i}")
        close = (F.abs(p.cast("double") - q.cast("double")) <= tolerance) if c in numbers else F.lit(False)
        cells.append(F.struct(F.lit(c).alias("column_name"), p.cast("string").alias("expected"), q.cast("string").alias("actual"), (p.eqNullSafe(q) | F.coalesce(close, F.lit(False))).alias("same")))
    out = both.select(F.coalesce("x_place", "y_place").alias("place"), F.explode(F.array(*cells)).alias("x")).select("place", "x.*")
    return out.where("NOT same").drop("same")


def same_rows(a: DataFrame, b: DataFrame, tolerance: float = 0.01) -> bool:
    """Whether two results have the same header and rows, in any order, numbers within the tolerance."""
    try:
        return mismatches(a, b, tolerance).isEmpty()
    except ValueError:
        return False


def latency_pivot(runs: DataFrame, *by: str) -> DataFrame:
    """Median latency of (query, config) runs, for each value of further keys such as the scale factor, configurations as columns."""
    return runs.groupBy(*by, "query").pivot("config").agg(F.median("latency_ms"))
