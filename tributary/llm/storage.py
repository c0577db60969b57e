"""Where intermediate tables live, and how code reaches the executors.

Every table that a later step reads again is written under the folder of spark.checkpoint.dir, which
all executors share, so a lost executor costs a re-read and not the lineage. Only where that setting
is missing and Spark runs in one process (tests) is a temporary folder made; elsewhere it is an error.
A step that fails leaves no table; what a returned DataFrame reads stays until `clean`.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()
#: The workspaces of each application that may still hold tables.
_open: dict[str, list[Workspace]] = {}


def _one_process(spark: SparkSession) -> bool:
    """Whether driver and executors are one process on one machine."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not _one_process(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tributary-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        root = f"file://{root}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Arrow batches to Python end at either bound, so that a batch of long texts stays small.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def ship(spark: SparkSession) -> None:
    """Set the session's Arrow batch bounds where the caller has none, and send the package to the executors of a cluster, once an application."""
    have = spark.conf.getAll
    for key, value in BATCH.items():
        if key not in have:
            spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app in _shipped or _one_process(spark):
        return
    folder = tempfile.mkdtemp(prefix="tributary-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(path := f"{folder}/{PACKAGE.name}_code.zip", "w") as z:
        for p in PACKAGE.rglob("*.py"):
            z.write(p, p.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


class Workspace:
    """Tables of one run of an operator, in a folder of their own under the shared one.

    As a context it drops all of them if the step fails.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.tag = f"{name}_{uuid.uuid4().hex[:12]}"
        self.root = f"{shared_dir(spark)}/{self.tag}"
        self.tables: list[str] = []
        _open.setdefault(spark.sparkContext.applicationId, []).append(self)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind is not None:
            self.close()

    def close(self) -> None:
        """Delete all tables; DataFrames that read them can't be used any more."""
        self.drop_runs(*self.tables)
        self._delete(self.root)
        mine = _open.get(self.spark.sparkContext.applicationId, [])
        if self in mine:
            mine.remove(self)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return it as read back: its lineage ends here."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing still to run reads."""
        for name in names:
            self._delete(f"{self.root}/{name}")

    def save_run(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """Write df as a table bucketed and sorted by key, which joins on key read without an exchange. Its files lie beside the others'."""
        table = f"{self.tag}_{name}"
        writer = df.repartition(buckets, key).sortWithinPartitions(key).write.bucketBy(buckets, key).sortBy(key)
        writer.option("compression", "zstd").option("path", f"{self.root}/{name}").saveAsTable(table)
        self.tables.append(name)
        return self.spark.table(table)

    def files_of(self, name: str, run: DataFrame) -> DataFrame:
        """A run read as plain files: a join on its key then exchanges both sides, so that Spark can split a hot key."""
        return self.spark.read.schema(run.schema).parquet(f"{self.root}/{name}")

    def drop_runs(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tag}_{name}")
            self._delete(f"{self.root}/{name}")
            if name in self.tables:
                self.tables.remove(name)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished steps now rather than at some later collection."""
        gc.collect()
        self.spark._jvm.System.gc()


#: What a side may weigh at most to be sent to all tasks.
BROADCAST_BYTES = 32 << 20


def measured(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, marked for broadcast if its rows, counted now, are below BROADCAST_BYTES; else it joins by exchange. For written tables."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of df as one struct, so that none clashes with columns that an operator adds; `name.*` unpacks them."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns)).alias(name)


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application: call it when the results have been written."""
    for work in list(_open.get(spark.sparkContext.applicationId, [])):
        work.close()
