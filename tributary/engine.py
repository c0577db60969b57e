"""A facade over one session: load tables, run SQL or DataFrame plans, explain costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .catalog import Catalog
from .sources.tables import read_delimited, table


class Engine:
    """SELECT statements are Spark SQL, a superset of the reference's grammar, with standard semantics."""

    def __init__(self, spark: SparkSession):
        self.spark, self.catalog = spark, Catalog(spark)

    def load_folder(self, folder: str, *names: str) -> Engine:
        """Parquet tables of a folder; one of a name that is loaded already replaces it."""
        for name in names:
            self.catalog.create_table(name, table(self.spark, folder, name), replace=True)
        return self

    def load_table(self, name: str, schema: T.StructType, path: str, delimiter: str = "|") -> None:
        """Delimited text as a table, with fresh statistics; it replaces one of that name."""
        self.catalog.create_table(name, read_delimited(self.spark, path, schema, delimiter), replace=True)
        self.catalog.update_stats(name)

    def execute_sql(self, text: str) -> DataFrame:
        text = text.strip().rstrip(";")
        if text[:6].lower() != "select" and text[:4].lower() != "with":
            raise ValueError("only SELECT statements are run")
        return self.spark.sql(text)
