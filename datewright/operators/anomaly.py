"""Rules across the files of a folder. One shuffle by folder feeds the windows that need order; clusters of one date are counted by folder and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datewright import config as C
from datewright.functions.pattern import relative_folder
from datewright.functions.scalars import counter, days_between, parent
from datewright.operators.resolve import any_hard, describe, flag, severity
from datewright.schema import FLAG

#: Destination folders that a suspect group shows.
DESTINATION_FOLDERS = 24


def identical_clusters(files: DataFrame) -> DataFrame:
    """Adds cluster_files: how many files of the folder share the date, if at least CLUSTER_MIN."""
    n = F.count("*").over(Window.partitionBy("folder", "taken"))
    return files.withColumn("cluster_files", F.when(n >= C.CLUSTER_MIN, n))


def far_from_neighbours(files: DataFrame) -> DataFrame:
    """Adds far_years: years from the folder's upper median date, for files that lie far from it although they were written near it."""
    by = Window.partitionBy("folder")
    place = F.row_number().over(by.orderBy("taken", "ordinal"))
    n = F.count("*").over(by)
    out = files.withColumn("__n", n).withColumn("__place", place)
    median = F.max(F.when(F.col("__place") == F.floor(F.col("__n") / 2) + 1, F.col("taken"))).over(by)
    out = out.withColumn("__median", median)
    drift, written = F.abs(days_between(F.col("taken"), F.col("__median"))), F.abs(days_between(F.col("filesystem"), F.col("__median")))
    far = (F.col("__n") >= C.NEIGHBOUR_MIN) & (drift >= C.DRIFT_DAYS) & (written < C.DRIFT_DAYS)
    return out.withColumn("far_years", F.when(far, F.floor(drift / 365).cast("bigint"))).drop("__n", "__place", "__median")


def sequence_outliers(files: DataFrame) -> DataFrame:
    """Adds sequence_outlier: the file's place by camera counter and its place by date differ by more than half of the folder's counted files."""
    out = files.withColumn("__counter", F.when(F.col("provider") != "filename", counter(F.col("source"))))
    by = Window.partitionBy("folder", F.col("__counter").isNotNull())
    out = out.withColumn("__n", F.count("*").over(by)).withColumn("__a", F.row_number().over(by.orderBy("__counter", "ordinal"))).withColumn("__b", F.row_number().over(by.orderBy("taken", "__counter", "ordinal")))
    outlier = F.col("__counter").isNotNull() & (F.col("__n") >= C.SEQUENCE_MIN) & (F.abs(F.col("__a") - F.col("__b")) > F.floor(F.col("__n") / 2))
    return out.withColumn("sequence_outlier", outlier).drop("__counter", "__n", "__a", "__b")


def clock_reset_runs(files: DataFrame) -> DataFrame:
    """Adds reset_anchor and reset_files to the members of a folder's first run of dates, where it begins on a January 1st, goes on by gaps of less than 31 days,
    and was written more than 180 whole days after it ends (by the upper median of the write times)."""
    device = F.col("provider") != "filesystem"
    by = Window.partitionBy("folder", "__device")
    order = by.orderBy("taken", "ordinal")
    out = files.withColumn("__device", device)
    gap = days_between(F.col("taken"), F.lag("taken").over(order))
    out = out.withColumn("__break", F.coalesce((gap > C.RUN_GAP_DAYS).cast("int"), F.lit(0)))
    out = out.withColumn("__run", F.sum("__break").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("__first", F.min("taken").over(by))
    run = Window.partitionBy("folder", "__device", "__run")
    place = F.row_number().over(run.orderBy(F.col("filesystem").asc_nulls_last(), "ordinal"))
    out = out.withColumn("__files", F.count("*").over(run)).withColumn("__written", F.count("filesystem").over(run)).withColumn("__last", F.max("taken").over(run)).withColumn("__place", place)
    out = out.withColumn("__median", F.max(F.when((F.col("__place") == F.floor(F.col("__written") / 2) + 1) & F.col("filesystem").isNotNull(), F.col("filesystem"))).over(run))
    january = (F.month("__first") == 1) & (F.dayofmonth("__first") == 1)
    member = F.col("__device") & (F.col("__run") == 0) & january & (F.col("__files") >= 2) & (F.col("__written") > 0) & (days_between(F.col("__median"), F.col("__last")) > C.SPREAD_DAYS)
    out = out.withColumn("reset_anchor", F.when(member, F.col("__first"))).withColumn("reset_files", F.when(member, F.col("__files")))
    return out.drop("__device", "__break", "__run", "__first", "__files", "__written", "__last", "__place", "__median")


def cross_file_flags(files: DataFrame) -> DataFrame:
    """Adds cross_flags to files with source, taken, provider, filesystem, ordinal."""
    rows = files if "folder" in files.columns else files.withColumn("folder", parent(F.col("source")))
    rows = rows.repartition("folder")  # the one shuffle: every window below is within a folder
    out = sequence_outliers(far_from_neighbours(clock_reset_runs(identical_clusters(rows))))
    flags = F.array_compact(
        F.array(
            F.when(F.col("cluster_files").isNotNull(), flag("identical_timestamp_cluster", files=F.col("cluster_files"))),
            F.when(F.col("reset_files").isNotNull(), flag("clock_reset_run", anchor=F.col("reset_anchor"), files=F.col("reset_files"))),
            F.when(F.col("far_years").isNotNull(), flag("far_from_neighbours", years=F.col("far_years"))),
            F.when(F.col("sequence_outlier"), flag("sequence_outlier")),
        )
    )
    return out.withColumn("cross_flags", flags.cast(f"array<{FLAG}>")).drop("cluster_files", "reset_anchor", "reset_files", "far_years", "sequence_outlier")


def annotate(plan: DataFrame, overridden: Column | None = None) -> DataFrame:
    """Renews the flags across files; rows that a user has dated lose all flags."""
    kept = F.filter("flags", lambda f: ~f["flag"].isin(*C.CROSS_FLAGS))
    out = cross_file_flags(plan).withColumn("flags", F.concat(kept, "cross_flags")).drop("cross_flags")
    if overridden is not None:
        out = out.withColumn("flags", F.when(overridden, F.array().cast(f"array<{FLAG}>")).otherwise(F.col("flags")))
    return out


def suspects(plan: DataFrame) -> DataFrame:
    return plan.filter(any_hard(F.col("flags")))


def suspect_members(plan: DataFrame) -> DataFrame:
    """Every file with a hard flag under its group's key: key, folder, kind (of its first such flag), reason, and plan's columns source, destination, taken, ordinal. A group's files are rows, however many they are."""
    first = F.get(F.filter("flags", lambda f: severity(f["flag"]) == "hard"), F.lit(0))
    rows = plan.withColumn("first", first).filter("first is not null").withColumn("folder", parent(F.col("source"))).withColumn("kind", F.col("first.flag")).withColumn("reason", describe(F.col("first")))
    return rows.select(F.concat("folder", F.lit("::"), "kind").alias("key"), "folder", "kind", "reason", "source", "destination", "taken", "ordinal")


def suspect_groups(plan: DataFrame, root: str, most: int = DESTINATION_FOLDERS) -> DataFrame:
    """Files with a hard flag by folder and the first such flag: files, earliest, latest, reason (of the first file), destination_folders (the first so many), ordered by files, then key. Their sources are suspect_members()."""
    rows = suspect_members(plan).withColumn("to", relative_folder(F.col("destination"), root))
    # destination folders are counted before groups are made, and cut before they are gathered
    parts = rows.groupBy("key", "folder", "kind", "to").agg(F.count("*").alias("files"), F.min("taken").alias("earliest"), F.max("taken").alias("latest"), F.min(F.struct("ordinal", "reason")).alias("first"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("to"))
    shown = parts.select("key", "to").withColumn("n", place).filter(F.col("n") <= most).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "to"))), lambda x: x["to"]).alias("destination_folders"))
    out = parts.groupBy("key", "folder", "kind").agg(F.sum("files").alias("files"), F.min("earliest").alias("earliest"), F.max("latest").alias("latest"), F.min("first")["reason"].alias("reason"))
    return out.join(shown, "key").select("folder", "kind", "files", "earliest", "latest", "reason", "destination_folders", "key").orderBy(F.desc("files"), "key")
