"""Planning and auditing copies: the journal, names without collisions, and the report of what is at the destination."""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datewright import config as C
from datewright.functions.scalars import duplicate_variant
from datewright.sources import exif, records


def latest(journal: DataFrame) -> DataFrame:
    """The last record of each source, by line_no."""
    cols = [c for c in journal.columns if c != "source"]
    return journal.groupBy("source").agg(F.max_by(F.struct(*cols), "line_no").alias("r")).select("source", *[F.col("r")[c].alias(c) for c in cols])


def written(journal: DataFrame) -> DataFrame:
    """What turned copies were written as; a later record without it removes it."""
    return latest(journal).filter("written is not null")


def pending(plan: DataFrame, journal: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Files that the journal doesn't have; failed ones are in it unless they are retried."""
    done = latest(journal)
    return plan.join((done.filter("status <> 'failed'") if retry_failed else done).select("source"), "source", "left_anti")


def resume(files: DataFrame, entries: DataFrame, skipped: DataFrame) -> DataFrame:
    """Files that no earlier scan has entered or skipped."""
    return files.join(entries.select("source").unionByName(skipped.select("source")), "source", "left_anti")


def allocate(plan: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The name of each file at its destination: adds path, outcome (copied, duplicate, already_present, failed) and variant.

    plan: source, destination, size, hash; existing: destination, variant (0 is the plain name), size, hash of what is there. Files go in the order of their sources. Equal contents at one
    destination share a name: the first writes it, the others find it present. Other contents take the names that are free, in order: the plain name, then
    `_dup_1` and on. What is there is found as far as names go on without a gap, as a probe finds it; behind a gap it only keeps its name from others. Without a free name among MAX_VARIANTS, path is null and the outcome failed.
    """
    first = plan.groupBy("destination", "size", "hash").agg(F.min("source").alias("__first"))
    if existing is not None:
        there = contiguous(existing).groupBy("destination", "size", "hash").agg(F.min("variant").alias("__there"))
        first = first.join(there, ["destination", "size", "hash"], "left")
        # free numbers: the n-th new content gets the n-th number that nothing there has
        taken = existing.filter(F.col("variant") < C.MAX_VARIANTS).groupBy("destination").agg(F.array_sort(F.collect_set(F.col("variant").cast("bigint"))).alias("__taken"))
        first = first.join(taken, "destination", "left")
    else:
        first = first.withColumn("__there", F.lit(None).cast("bigint")).withColumn("__taken", F.lit(None).cast("array<bigint>"))
    place = F.row_number().over(Window.partitionBy("destination", F.col("__there").isNull()).orderBy("__first")) - 1
    free = F.aggregate(F.coalesce("__taken", F.array().cast("array<bigint>")), place.cast("bigint"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    first = first.withColumn("variant", F.coalesce(F.col("__there").cast("bigint"), free))
    out = plan.join(first.drop("__taken"), ["destination", "size", "hash"])
    present = F.col("__there").isNotNull() | (F.col("source") != F.col("__first"))
    none = F.col("variant") >= C.MAX_VARIANTS
    outcome = F.when(none, "failed").when(present, "already_present").when(F.col("variant") > 0, "duplicate").otherwise("copied")
    path = F.when(F.col("variant") == 0, F.col("destination")).otherwise(duplicate_variant(F.col("destination"), F.col("variant")))
    return out.withColumn("outcome", outcome).withColumn("path", F.when(~none, path)).drop("__first", "__there")


def contiguous(existing: DataFrame) -> DataFrame:
    """Variants that a probe finds: the plain name, and `_dup_1` up to the first gap."""
    numbered = existing.withColumn("__n", F.row_number().over(Window.partitionBy("destination", F.col("variant") > 0).orderBy("variant")))
    return numbered.filter((F.col("variant") == 0) | (F.col("variant") == F.col("__n"))).drop("__n")


def verify(plan: DataFrame, sources: DataFrame, existing: DataFrame, written_as: DataFrame | None = None) -> DataFrame:
    """One row a plan entry: status (ok, source_missing, destination_missing, content_mismatch), source_size, destination_size (of the plain name).

    plan: source, destination, size, rotate (optional); sources: source, size, hash; existing: destination, variant, size, hash; written_as: source, size, hash of turned copies, whose
    content need only be what was written, or anything where no record says.
    """
    base = plan.select("source", "destination", F.col("size").alias("planned_size"), (F.coalesce(F.col("rotate"), F.lit("none")) != "none" if "rotate" in plan.columns else F.lit(False)).alias("turned"))
    rows = base.join(sources.select("source", F.col("size").alias("s_size"), F.col("hash").alias("s_hash")), "source", "left")
    if written_as is not None:
        rows = rows.join(written_as.select("source", F.col("size").alias("w_size"), F.col("hash").alias("w_hash")), "source", "left")
    else:
        rows = rows.withColumn("w_size", F.lit(None).cast("bigint")).withColumn("w_hash", F.lit(None).cast("string"))
    found = contiguous(existing).select("destination", "variant", F.col("size").alias("d_size"), F.col("hash").alias("d_hash"))
    same = F.when(~F.col("turned"), (F.col("d_size") == F.col("s_size")) & (F.col("d_hash") == F.col("s_hash"))).otherwise(F.col("w_size").isNull() | ((F.col("d_size") == F.col("w_size")) & (F.col("d_hash") == F.col("w_hash"))))
    joined = rows.join(found, "destination", "left")
    out = joined.groupBy("source", "destination", "planned_size", "s_size").agg(
        F.max(F.coalesce(same & F.col("variant").isNotNull(), F.lit(False))).alias("matched"), F.count("variant").alias("n"), F.max(F.when(F.col("variant") == 0, F.col("d_size"))).alias("destination_size")
    )
    status = F.when(F.col("s_size").isNull(), "source_missing").when(F.col("matched"), "ok").when(F.col("n") > 0, "content_mismatch").otherwise("destination_missing")
    return out.select("source", "destination", status.alias("status"), F.coalesce("s_size", "planned_size").alias("source_size"), F.when(F.col("s_size").isNotNull(), F.col("destination_size")).alias("destination_size"))


def verify_report(checked: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: counts by status, source_bytes, and the distinct destination files and bytes of entries whose source is there."""
    counts = checked.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "source_missing", "destination_missing", "content_mismatch")], F.coalesce(F.sum(F.when(F.col("status") != "source_missing", F.col("source_size"))), F.lit(0)).alias("source_bytes")
    )
    seen = contiguous(existing).join(checked.filter("status <> 'source_missing'").select("destination").distinct(), "destination", "left_semi")
    there = seen.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("destination_bytes"), F.count_if(F.col("variant") > 0).alias("duplicate_files"), F.coalesce(F.sum(F.when(F.col("variant") > 0, F.col("size"))), F.lit(0)).alias("duplicate_bytes"))
    return counts.crossJoin(there)  # one row each


def issues(checked: DataFrame) -> DataFrame:
    return checked.filter("status <> 'ok'").withColumnRenamed("status", "kind")


def copy_counters(outcomes: DataFrame) -> DataFrame:
    """outcomes: status, size, turned."""
    return outcomes.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in C.OUTCOMES],
        F.count_if("turned").alias("turned"),
        F.coalesce(F.sum(F.when(F.col("status").isin("copied", "duplicate"), F.col("size"))), F.lit(0)).alias("bytes"),
    )


def tuned_concurrency(files: int, size: int, cores: int) -> int:
    """Copies at a time for files of a mean size, for those who move bytes without Spark: few for large ones, many for small ones."""
    if not files:
        return max(2, min(8, cores))
    mean = size // files
    return max(2, min(4, cores) if mean >= 16 << 20 else min(16, 2 * cores) if mean <= 256 << 10 else min(8, cores))


_OUTCOME = "source string, status string, destination string, error string, written struct<size:bigint,hash:string>"


def execute(allocated: DataFrame, stamp: bool = False, rotate=None, staging: str = ".staged") -> DataFrame:
    """Copies what allocate() planned to write: journal rows (source, status, destination, error, written) of every file but those that are already present, which settle() judges by these.

    A copy is made beside its destination under a staged name, turned and stamped, synced, given the source's times, and renamed, so that a lost task leaves no half file and may run again: a destination of the
    very content is taken as copied. stamp: writes taken into the date tags of the copy, where it has them. rotate: a function from bytes, transform and reencode (columns of allocated) to turned bytes, or None where a file can't be
    turned, and is then copied as it is; for files whose transform isn't none. Destinations must be mounted on every worker.
    """
    def digest(path: str) -> str:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "md5").hexdigest()

    def changed(row, data: bytes) -> bytes | None:
        out = None
        if rotate is not None and (row.rotate or "none") != "none":
            out = rotate(data, row.rotate, bool(row.reencode))
        if stamp and row.taken is not None:
            out = exif.stamp(data if out is None else out, row.taken.to_pydatetime()) or out
        return out

    def move(row) -> tuple:
        if row.path is None:
            return row.source, "failed", None, "no free name at the destination", None
        held = f"{row.path}{staging}"
        try:
            os.makedirs(os.path.dirname(row.path), exist_ok=True)
            shutil.copyfile(row.source, held)
            data = None
            if stamp or (rotate is not None and (row.rotate or "none") != "none"):
                with open(held, "rb") as f:
                    data = changed(row, f.read())
                if data is not None:
                    with open(held, "wb") as f:
                        f.write(data)
            with open(held, "rb+") as f:
                os.fsync(f.fileno())
            shutil.copystat(row.source, held)
            if os.path.exists(row.path) and digest(row.path) != digest(held):
                os.remove(held)
                return row.source, "failed", None, f"{row.path} is taken", None
            os.replace(held, row.path)
            return row.source, row.outcome, row.path, None, {"size": len(data), "hash": digest(row.path)} if data is not None else None
        except OSError as e:
            return row.source, "failed", None, str(e), None

    def copied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([move(r) for r in frame.itertuples()], columns=["source", "status", "destination", "error", "written"])

    columns = ["source", "path", "outcome", *["taken"] * stamp, *["rotate", "reencode"] * (rotate is not None)]
    return allocated.filter("outcome <> 'already_present'").select(*columns).mapInPandas(copied, _OUTCOME)


def settle(allocated: DataFrame, done: DataFrame) -> DataFrame:
    """Journal rows of files whose content another writes or that was there before; done: journal rows of those that were written. If the copy that a file relies on has failed, so has it."""
    wrote = done.select("source", F.col("status").alias("__status"))
    writers = allocated.filter("outcome <> 'already_present'").select("source", "path").join(wrote, "source", "left").select("path", F.coalesce("__status", F.lit("failed")).alias("__status")).filter("path is not null")
    rows = allocated.filter("outcome = 'already_present'").join(writers, "path", "left")
    bad = F.col("__status") == "failed"
    return rows.select(
        "source", F.when(bad, "failed").otherwise("already_present").alias("status"), F.when(~F.coalesce(bad, F.lit(False)), F.col("path")).alias("destination"), F.when(bad, F.concat(F.lit("the copy of its content to "), F.col("path"), F.lit(" failed"))).alias("error"), F.lit(None).cast("struct<size:bigint,hash:string>").alias("written")
    )


def copy_files(allocated: DataFrame, journal: str, stamp: bool = False, rotate=None) -> DataFrame:
    """Copies and journals all of an allocated plan, a run for what is written and one for what is present; the journal's records of these files."""
    spark = allocated.sparkSession
    records.append_journal(execute(allocated, stamp, rotate), journal)
    records.append_journal(settle(allocated, latest(records.read_journal(spark, journal)).select("source", "status")), journal)
    return latest(records.read_journal(spark, journal)).join(allocated.select("source"), "source", "left_semi")
