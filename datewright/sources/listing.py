"""Files under roots, as a table. Listing is our own: Spark's file sources leave out names that begin with `_` or `.` and empty files, which cameras make."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datewright.functions.scalars import extension, file_name, parent

#: Extension of copies that aren't complete.
STAGED = "part"
#: Folders that the driver splits roots into at most before workers walk them.
MOST_FOLDERS = 10_000

_FILES = "source string, size bigint, modified timestamp_ntz, created timestamp_ntz"


def _time(seconds: float | None) -> datetime | None:
    return None if seconds is None else datetime.fromtimestamp(seconds, UTC).replace(tzinfo=None)


def _walk(folder: str, deep: bool, follow: bool, barred: str | None) -> Iterator[tuple]:
    """Regular files; what can't be read is passed over, and links are walked only if they are followed, each real folder once a path."""
    stack, seen = [folder], set()
    while stack:
        at = stack.pop()
        real = os.path.realpath(at)
        if real == barred or (follow and real in seen):
            continue
        seen.add(real)
        try:
            found = list(os.scandir(at))
        except OSError:
            continue
        for x in found:
            try:
                if x.is_dir(follow_symlinks=follow):
                    if deep:
                        stack.append(x.path)
                elif x.is_file(follow_symlinks=follow):
                    s = x.stat(follow_symlinks=follow)
                    yield x.path, s.st_size, _time(s.st_mtime), _time(getattr(s, "st_birthtime", None))
            except OSError:
                continue


def scan(spark: SparkSession, roots: list[str], destination: str | None = None, follow: bool = False) -> DataFrame:
    """source, folder, name, ext, size, modified, created. Files of overlapping roots come as often as they are reached; the destination's subtree and staged copies are left out.

    The driver opens the uppermost folders, until there is work for every core; workers walk the rest. Roots must be mounted on every worker.
    """
    barred = os.path.realpath(destination) if destination else None
    shallow: list[tuple[str, bool]] = []
    todo = [r.rstrip("/") or "/" for r in roots]
    while todo and len(todo) + len(shallow) < min(MOST_FOLDERS, 4 * spark.sparkContext.defaultParallelism):
        deeper: list[str] = []
        for at in todo:
            shallow.append((at, False))
            if os.path.realpath(at) == barred:
                continue
            try:
                deeper += [x.path for x in os.scandir(at) if x.is_dir(follow_symlinks=follow)]
            except OSError:
                continue
        todo = deeper
    folders = shallow + [(at, True) for at in todo]

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for folder, deep in zip(frame["folder"], frame["deep"], strict=True):
                rows = list(_walk(folder, bool(deep), follow, barred))
                for i in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[i : i + 10_000], columns=["source", "size", "modified", "created"]).astype({"modified": "datetime64[us]", "created": "datetime64[us]"})

    base = spark.createDataFrame(folders or [("", False)], "folder string, deep boolean").filter("folder <> ''").repartition(max(1, min(len(folders), 4 * spark.sparkContext.defaultParallelism)))
    found = base.mapInPandas(listed, _FILES)
    out = found.select("source", parent(F.col("source")).alias("folder"), file_name(F.col("source")).alias("name"), extension(F.col("source")).alias("ext"), "size", "modified", "created")
    return out.filter(F.col("ext") != STAGED)


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def filesystem_time(created, modified):
    """The earlier of both, and what it is; a tie is the creation."""
    first = F.when(created.isNull() | (modified < created), F.struct(modified.alias("taken"), F.lit("modified").alias("info"))).otherwise(F.struct(created.alias("taken"), F.lit("created").alias("info")))
    return F.when(created.isNotNull() | modified.isNotNull(), first)


def filesystem_latest(created, modified):
    return F.greatest(created, modified)
