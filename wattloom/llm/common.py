"""What several operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Rows of an Arrow batch of whole texts, which both sides of a Python worker hold.
BATCH_ROWS = 2000


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it (a cluster gets it by --py-files), in batches of BATCH_ROWS at most."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in (have := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *have]))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset (local master only)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/wattloom-shared"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    reachable(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that written() made and whose consumers are all written by now."""
    for table in tables:
        spark = table.sparkSession
        if files := table.inputFiles():
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def id_remainder(column: str, mod: int) -> Column:
    """crc32 of the id as text, mod `mod`; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def extended(schema: StructType, added: str) -> StructType:
    """schema with the columns of a DDL string behind its own."""
    return StructType([*schema.fields, *StructType.fromDDL(added).fields])


#: What operators keep in this Python worker from task to task: how it is forgotten, by operator.
kept_by: dict[str, Callable[[], None]] = {}


def worker_of(operator: str, forget_own: Callable[[], None] | None = None) -> None:
    """Forgets what other operators keep in this worker, which Spark reuses for one stage after the other; `forget_own` is for those that come after."""
    others = [kept_by.pop(k) for k in list(kept_by) if k != operator]
    for forget_other in others:
        forget_other()
    if others:
        gc.collect()
    if forget_own:
        kept_by[operator] = forget_own


class Remembered(dict):
    """What `make` gives for a key, remembered in two generations of at most `most` keys each: when the younger is full, the older is
    forgotten. Keys longer than `longest` are not remembered, which bounds the bytes as well."""

    def __init__(self, make: Callable, most: int, longest: int = 64):
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.longest:
            self.keep(key, found)
        return found

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
