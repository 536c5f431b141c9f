"""Session settings that operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def with_checkpoints(spark: SparkSession) -> None:
    """Sets the checkpoint folder from spark.checkpoint.dir, or a local one where that is unset (local master only)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(found or f"{tempfile.gettempdir()}/wattloom-checkpoints")


def settled(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the checkpoint folder, read again. A checkpoint keeps what is known about its columns; in a loop of joins
    that grows with every round, until planning takes longer than the jobs."""
    spark = df.sparkSession
    with_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it (a cluster gets it by --py-files)."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in (have := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *have]))
