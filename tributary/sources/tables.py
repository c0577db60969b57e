"""Sources and sinks: Parquet tables, delimited text, access traces, rendered CSV."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compat import csv_field, decimal_text

TRACE = T.StructType([T.StructField("timestamp", T.LongType()), T.StructField("page_id", T.LongType())])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; filters and columns are pushed into the scan by Spark."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parse_delimited(lines: DataFrame, schema: T.StructType, delimiter: str = "|") -> DataFrame:
    """Rows from a column `value` of text lines.

    A trailing delimiter is allowed, blank lines and lines with too few fields are skipped, further fields are
    ignored, and a field that is not of its type is an error.
    """
    fields = F.split("value", f"[{delimiter}]" if len(delimiter) == 1 and delimiter not in "^]\\" else "\\" + delimiter)
    rows = lines.where(F.trim("value") != "").select(fields.alias("f")).where(F.size("f") >= len(schema.fields))
    columns = []
    for i, x in enumerate(schema.fields):
        raw = F.element_at("f", i + 1)
        columns.append((F.to_date(raw, "yyyy-MM-dd") if isinstance(x.dataType, T.DateType) else raw.cast(x.dataType)).alias(x.name))
    return rows.select(*columns)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = "|") -> DataFrame:
    return parse_delimited(spark.read.text(path), schema, delimiter)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACE).option("header", True).csv(path)


def write_trace(trace: DataFrame, path: str) -> None:
    trace.select("timestamp", "page_id").write.mode("overwrite").option("header", True).csv(path)


def render_csv(df: DataFrame, name: str = "line") -> DataFrame:
    """One string column with each row as a CSV line: doubles with at most two decimals, strings quoted where needed."""
    parts = []
    for x in df.schema.fields:
        c = F.col(x.name)
        if isinstance(x.dataType, (T.DoubleType, T.FloatType)):
            c = decimal_text(c)
        elif isinstance(x.dataType, T.StringType):
            c = csv_field(c)
        elif isinstance(x.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        parts.append(F.coalesce(c.cast("string"), F.lit("")))
    return df.select(F.concat_ws(",", *parts).alias(name))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header and RFC 4180 quoting; doubles with at most two decimals."""
    columns = [decimal_text(F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes]
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def append(table_: DataFrame, rows: DataFrame) -> DataFrame:
    return table_.unionByName(rows)


def delete(table_: DataFrame, condition) -> DataFrame:
    """The rows for which the condition is not true (null counts as not true)."""
    return table_.where(~F.coalesce(condition, F.lit(False)))


def write_latencies(rows: list[tuple[str, int, float]], path: str) -> None:
    """A local CSV of (query, rows, latency_ms), as a benchmark run has them on the driver."""
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["query", "rows", "latency_ms"])
        out.writerows((q, n, f"{ms:.3f}") for q, n, ms in rows)
