"""Thin composable relational operators; the physical work is Catalyst's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is broadcast by hint only if its size is known to be below this many bytes; otherwise Spark decides.
BROADCAST_BYTES = 16 << 20


def scan(df: DataFrame, columns: Sequence[str] | None = None, predicate: Column | None = None) -> DataFrame:
    df = df if predicate is None else df.where(predicate)
    return df if columns is None else df.select(*columns)


def index_scan(df: DataFrame, key: str, low=None, high=None) -> DataFrame:
    """Rows whose key lies in an inclusive range; Parquet row groups outside it are skipped."""
    if low is not None:
        df = df.where(F.col(key) >= F.lit(low))
    return df if high is None else df.where(F.col(key) <= F.lit(high))


def project(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*(c.alias(n) for n, c in columns.items()))


def join(left: DataFrame, right: DataFrame, on: Column | list[str], how: str = "inner", right_bytes: int | None = None) -> DataFrame:
    """A join; the right side is sent to all tasks only if its known size is small."""
    if right_bytes is not None and right_bytes <= BROADCAST_BYTES and how in ("inner", "left", "cross"):
        right = F.broadcast(right)
    return left.join(right, on, how)


def aggregate(df: DataFrame, keys: Sequence[str | Column], having: Column | None = None, **aggs: Column) -> DataFrame:
    out = df.groupBy(*keys).agg(*(c.alias(n) for n, c in aggs.items())) if keys else df.agg(*(c.alias(n) for n, c in aggs.items()))
    return out if having is None else out.where(having)


def distinct(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct()


def sort(df: DataFrame, *keys: Column) -> DataFrame:
    return df.orderBy(*keys)


def top(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """The first n rows in order, by per-task heaps and one merge."""
    return df.orderBy(*keys).limit(n)
