"""New files as a stream: listings that arrive in a folder are resolved once a source, and appended to a plan. An extension of resuming a scan by an anti join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datewright import config as C
from datewright.functions.pattern import destination
from datewright.operators.resolve import resolve
from datewright.schema import CANDIDATES

LISTING = f"source string, size bigint, filesystem timestamp_ntz, candidates {CANDIDATES}, seen timestamp"


def listings(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files with the columns of LISTING, as they arrive."""
    return spark.readStream.schema(LISTING).parquet(folder)


def new_entries(stream: DataFrame, root: str, pattern: str, now=C.NOW, options: C.DetectOptions | None = None, late: str = "7 days") -> DataFrame:
    """Each source once (within the time that the watermark keeps), resolved and with its destination."""
    once = stream.withWatermark("seen", late).dropDuplicatesWithinWatermark(["source"])
    return resolve(once, now, options).withColumn("destination", destination(F.col("source"), F.col("taken"), root, pattern))


def folder_counts(stream: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Files and bytes that arrived, by time window and source folder."""
    return stream.withWatermark("seen", late).groupBy(F.window("seen", window), F.regexp_extract("source", r"(?s)^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def append(entries: DataFrame, path: str, checkpoint: str):
    """Starts appending to a Parquet plan, batch by batch until what is there is done."""
    return entries.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
