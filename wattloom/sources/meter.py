"""Meter readings: CSV files with a fixed column order, one device to a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from wattloom.functions.session import with_checkpoints

# The columns of a meter file, in the file's order.
FILE_ORDER = [
    "T",
    "volt_A", "volt_B", "volt_C", "volt_AB", "volt_CA", "volt_BC",
    "curnt_A", "curnt_B", "curnt_C",
    "realP_A", "realP_B", "realP_C", "realP_tot",
    "reacP_A", "reacP_B", "reacP_C", "reacP_tot",
    "aprntP_A", "aprntP_B", "aprntP_C", "aprntP_tot",
    "factor_A", "factor_B", "factor_C", "factor_tot",
]
MEASURES = FILE_ORDER[1:]
POWERS = [c for c in MEASURES if c.startswith(("realP", "reacP", "aprntP"))]
FACTORS = [c for c in MEASURES if c.startswith("factor")]
FORMATS = ("yyyy-MM-dd HH:mm:ss", "M.d.yyyy H:mm", "M.d.yy H:mm")
DAY_FIRST = ("d.M.yyyy H:mm", "d.M.yy H:mm", "yyyy-MM-dd HH:mm:ss", "d/M/yyyy H:mm")


def parsed(text: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """The first format that fits, as a time without zone; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats)).cast("timestamp_ntz")


def file_format(rows: DataFrame, time: str, line: str) -> DataFrame:
    """(_file, format): each file's format is the first that its first row fits. No format at all raises when it is used."""
    first = rows.groupBy("_file").agg(F.min_by(time, line).alias("text"))
    fits = F.coalesce(*(F.when(F.try_to_timestamp("text", F.lit(f)).isNotNull(), F.lit(f)) for f in FORMATS))
    return first.select("_file", F.coalesce(fits, F.raise_error(F.concat(F.lit("unknown time format: "), "text"))).alias("format"))


def keep_first(rows: DataFrame, keys: list[str], line: str) -> DataFrame:
    """One row for each key: the first in file order."""
    order = Window.partitionBy(*keys).orderBy(line)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def scaled(rows: DataFrame) -> DataFrame:
    """Powers from W to kW, power factors without sign, NaN as null."""
    number = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in MEASURES if c in rows.columns}
    return rows.withColumns({c: v / 1000 if c in POWERS else F.abs(v) if c in FACTORS else v for c, v in number.items()})


def with_line(rows: DataFrame) -> DataFrame:
    """Adds `_file` and `_line`, which orders the rows of a file as they stand in it."""
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("_line"))


def read_meter(spark: SparkSession, path: str) -> DataFrame:
    """(device, T, the 25 measures) of meter files: names by position, the first row of a time, scaled units.

    The device is the file's name up to its second dash part; it may have many files, which count in the order of their
    names. One time format holds for a file; a later row that does not fit it raises.
    """
    width = len(FILE_ORDER) + 7
    schema = StructType([StructField(FILE_ORDER[k] if k < len(FILE_ORDER) else f"_unused{k}", StringType()) for k in range(width)])
    raw = with_line(spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path))
    raw = raw.withColumn("device", device_of("_file")).select("device", *FILE_ORDER, "_file", "_line")
    known = raw.join(file_format(raw, "T", "_line"), "_file")
    when = F.coalesce(*(F.when(F.col("format") == f, F.try_to_timestamp("T", F.lit(f))) for f in FORMATS)).cast("timestamp_ntz")
    unfit = F.raise_error(F.concat_ws(" ", F.lit("a time does not fit the format of its file:"), "T", "_file")).cast("timestamp_ntz")
    rows = known.withColumn("T", F.when(F.col("T").isNull() | when.isNotNull(), when).otherwise(unfit)).withColumn("_line", F.struct("_file", "_line"))
    return scaled(keep_first(rows, ["device", "T"], "_line")).select("device", "T", *MEASURES)


def device_of(path: str) -> Column:
    """A file's name up to its second dash."""
    return F.substring_index(F.regexp_extract(path, r"([^/]*)$", 1), "-", 2)


def transformer_files(files: DataFrame, path: str = "path") -> DataFrame:
    """(device, files): the files of each transformer, by the first two dash parts of their names."""
    return files.select(device_of(path).alias("device"), path).groupBy("device").agg(F.sort_array(F.collect_list(path)).alias("files"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(file, t, workingPower) of prediction files, by the file's name; their index column is dropped. Files of errors are left out."""
    raw = spark.read.option("header", True).csv(path)
    name = F.col("_metadata.file_name")
    return raw.where(~name.endswith("_error.csv")).select(name.alias("file"), parsed(F.col("`UTC Time`")).alias("t"), F.col("workingPower").cast("double"))


def read_prediction(spark: SparkSession, path: str) -> DataFrame:
    """(t, workingPower) of a prediction file."""
    return read_predictions(spark, path).drop("file")


def read_counter(spark: SparkSession, path: str) -> DataFrame:
    """(t, cum_quant) of a cumulative counter, days first. Missing columns raise."""
    raw = spark.read.option("header", True).csv(path)
    if absent := {"UTC Time", "Cum. Quant"} - set(raw.columns):
        raise ValueError(f"missing columns: {sorted(absent)}")
    return raw.select(parsed(F.col("`UTC Time`"), DAY_FIRST).alias("t"), F.col("`Cum. Quant`").cast("double").alias("cum_quant"))


EVENT_SCHEMA = "recordId int, clusterId int, eventId int, starttime timestamp_ntz, endtime timestamp_ntz, aggNum int"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """On/off records of all clusters, in one table."""
    return spark.read.schema(EVENT_SCHEMA).option("header", True).csv(path)


def write_events(records: DataFrame, path: str, by_cluster: bool = False) -> None:
    """On/off records as CSV, for each cluster apart if asked for."""
    out = records.write.mode("overwrite").option("header", True)
    (out.partitionBy("clusterId") if by_cluster else out).csv(path)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their number from 1 in an order: within each range of it, from the counts of the ranges before; no task sees all."""
    spark = rows.sparkSession
    with_checkpoints(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    counts = sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect())  # a row for each partition
    before = [(k, sum(c for j, c in counts if j < k)) for k, _ in counts]
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = dealt.join(F.broadcast(spark.createDataFrame(before, "_range int, _before long")), "_range")
    return placed.withColumn(name, F.col("_before") + at).drop("_range", "_before")


def write_truth(events: DataFrame, path: str) -> None:
    """Validation events with ids from 1 and formatted times."""
    placed = numbered(events.select("starttime", "endtime"), ["starttime", "endtime"], "recordId")
    rows = placed.select("recordId", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("starttime", "endtime")))
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_series(series: DataFrame, path: str) -> None:
    """Minute series of each cluster apart."""
    series.write.mode("overwrite").partitionBy("cluster").option("header", True).csv(path)
