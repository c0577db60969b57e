"""Tables, exact statistics and the registry of columns that count as indexed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS_AND_DATES = (T.IntegerType, T.LongType, T.DoubleType, T.DateType, T.TimestampNTZType, T.TimestampType)


@dataclass(frozen=True)
class TableStats:
    rows: int
    distinct: dict[str, int]


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, row_count, ndv) in one pass: exact counts, combined in each task."""
    columns = columns or df.columns
    wide = df.agg(F.count("*").alias("rows"), *(F.countDistinct(c).alias(c) for c in columns))
    return wide.select("rows", F.explode(F.array(*(F.struct(F.lit(c).alias("n"), F.col(c).alias("v")) for c in columns))).alias("x")).select(
        F.col("x.n").alias("column_name"), F.col("rows").alias("row_count"), F.col("x.v").alias("ndv")
    )


@dataclass
class Catalog:
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    stats: dict[str, TableStats] = field(default_factory=dict)
    indexes: dict[str, tuple[str, str]] = field(default_factory=dict)

    def create_table(self, name: str, df: DataFrame, replace: bool = False) -> bool:
        """Register a table and its view; False if the name is taken, unless the table is to replace the old one, whose statistics and indexes go."""
        if name in self.tables:
            if not replace:
                return False
            self.stats.pop(name, None)
            self.indexes = {i: x for i, x in self.indexes.items() if x[0] != name}
        self.tables[name] = df
        df.createOrReplaceTempView(name)
        return True

    def get_table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"Table not found: {name}")
        return self.tables[name]

    def update_stats(self, name: str, columns: list[str] | None = None) -> TableStats:
        rows = column_stats(self.get_table(name), columns).collect()
        self.stats[name] = TableStats(rows[0]["row_count"], {r["column_name"]: r["ndv"] for r in rows})
        return self.stats[name]

    def create_index(self, index: str, table: str, column: str) -> bool:
        """Mark a number or date column as indexed, for the scan advisor; False if the index exists."""
        kind = self.get_table(table).schema[column].dataType
        if not isinstance(kind, _NUMBERS_AND_DATES):
            raise TypeError(f"cannot index a column of type {kind.simpleString()}")
        if index in self.indexes:
            return False
        self.indexes[index] = (table, column)
        return True

    def table_indexes(self, table: str) -> dict[str, str]:
        return {i: c for i, (t, c) in self.indexes.items() if t == table}
