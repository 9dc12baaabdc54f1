"""Exact duplicates and shooting bursts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datewright import config as C
from datewright.functions.scalars import hamming, micros, parent


def exact_duplicates(files: DataFrame) -> DataFrame:
    """files: source, size, hash. Groups of equal files: bytes, files, wasted, sources (sorted), the most wasteful first. Empty files are ignored; a null hash is unreadable."""
    groups = files.filter("size > 0 and hash is not null").groupBy("size", "hash").agg(F.count("*").alias("files"), F.array_sort(F.collect_list("source")).alias("sources")).filter("files > 1")
    return groups.select(F.col("size").alias("bytes"), "files", (F.col("size") * (F.col("files") - 1)).alias("wasted"), "sources").orderBy(F.desc("wasted"), F.col("sources")[0])


def same_size(files: DataFrame) -> DataFrame:
    """Files that share their size with another: only their contents need be read. Sizes are counted with a map-side combine, and a common size isn't gathered."""
    sizes = files.filter("size > 0").groupBy("size").agg(F.count("*").alias("n")).filter("n > 1").select("size")
    return files.join(sizes, "size", "left_semi")


def duplicate_totals(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("wasted"), F.lit(0)).alias("wasted"))


def bursts(files: DataFrame) -> DataFrame:
    """files: source, taken, size, hash (64 bits; null: no picture). Runs of two or more within a folder in which each is within BURST_SECONDS and BURST_BITS of the one before.

    folder, members, keeper (the largest, then the first path), extra_bytes, sources in order; the longest first.
    """
    rows = files.filter("hash is not null")
    if "folder" not in rows.columns:
        rows = rows.withColumn("folder", parent(F.col("source")))
    order = Window.partitionBy("folder").orderBy("taken", "source")
    near = ((micros(F.col("taken")) - micros(F.lag("taken").over(order))) <= C.BURST_SECONDS * 1_000_000) & (hamming(F.col("hash"), F.lag("hash").over(order)) <= C.BURST_BITS)
    rows = rows.withColumn("__new", F.when(near, 0).otherwise(1))
    rows = rows.withColumn("burst", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("folder", "burst").agg(
        F.count("*").alias("members"),
        F.min_by("source", F.struct(-F.col("size"), F.col("source"))).alias("keeper"),
        (F.sum("size") - F.max("size")).alias("extra_bytes"),
        F.transform(F.array_sort(F.collect_list(F.struct("taken", "source"))), lambda x: x["source"]).alias("sources"),
    )
    return out.filter("members > 1").drop("burst").orderBy(F.desc("members"), "keeper")
