"""The entry view, its filters, roll-ups, histograms and calendar grids.

An entry view has source, folder, taken, taken_epoch (the wall clock as UTC seconds), provider, size, candidates, flags, confidence, override_origin, tags, quality, ordinal; each function
names what it reads.
"""

from __future__ import annotations

import math
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datewright import config as C
from datewright.functions.pattern import relative_folder
from datewright.functions.scalars import epoch, numeric_key
from datewright.operators.resolve import any_hard, confidence
from datewright.operators.tags import ranked_hits

DAY = 86400
#: Ends of a range that is open on one side: the years 1 and 9999.
DAWN, DOOMSDAY = -62135596800, 253402300800
READINGS = ("agree", "single", "wrong", "decided")


def entry_view(plan: DataFrame, root: str, journal: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Adds folder, taken_epoch, confidence, outcome (of the latest journal records: source, status) and destination_exists."""
    out = plan.withColumn("folder", relative_folder(F.col("destination"), root)).withColumn("taken_epoch", epoch(F.col("taken"))).withColumn("confidence", confidence(F.col("flags"), F.col("candidates")))
    if journal is not None:
        out = out.join(journal.select("source", F.col("status").alias("outcome")), "source", "left")
    if existing is not None:
        out = out.join(existing.select("destination", F.lit(True).alias("__there")).distinct(), "destination", "left").withColumn("destination_exists", F.coalesce("__there", F.lit(False))).drop("__there")
    return out


# Filters


def in_range(entries: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """start <= taken_epoch < end; None is open."""
    out = entries
    if start is not None:
        out = out.filter(F.col("taken_epoch") >= start)
    return out.filter(F.col("taken_epoch") < end) if end is not None else out


def with_tags(entries: DataFrame, picked: list[str] | None, untagged: bool = False) -> DataFrame:
    """None: all. Otherwise entries that have one of the tags, and those without any if untagged."""
    if picked is None:
        return entries
    overlap = F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*[F.lit(t) for t in picked]).cast("array<string>"))
    return entries.filter(overlap | (F.lit(untagged) & (F.coalesce(F.size("tags"), F.lit(0)) <= 0)))


def of_quality(entries: DataFrame, least: float) -> DataFrame:
    return entries if least <= 0 else entries.filter(F.col("quality").isNotNull() & ~F.isnan("quality") & (F.abs("quality") < float("inf")) & (F.col("quality") >= least))


def below(entries: DataFrame, folder: str | None) -> DataFrame:
    """None: nothing. The empty folder: only what lies in the root itself."""
    if folder is None:
        return entries.limit(0)
    return entries.filter((F.col("folder") == folder) | (F.lit(folder != "") & F.startswith(F.col("folder"), F.lit(folder + "/"))))


def range_of_days(first: str | None, last: str | None) -> tuple[int, int] | None:
    """Half-open seconds of an inclusive pair of days; a missing or unreadable end is open; an inverted pair is its first day."""
    def at(text: str | None) -> int | None:
        try:
            return int(datetime.fromisoformat(text or "").replace(tzinfo=UTC).timestamp())
        except ValueError:
            return None

    a, b = at(first), at(last)
    if a is None and b is None:
        return None
    start, end = DAWN if a is None else a, DOOMSDAY if b is None else b + DAY
    return (start, start + DAY) if end <= start else (start, end)


def level_for(start: int, end: int) -> str:
    days = (end - start) / DAY
    return "years" if days > 366 else "months" if days > 31 else "days"


def range_label(start: int, end: int) -> str:
    """The coarsest unit that both ends are aligned to."""
    a, b = (datetime.fromtimestamp(x, UTC) for x in (start, end))
    midnight = lambda t: (t.hour, t.minute, t.second) == (0, 0, 0)
    if midnight(a) and midnight(b):
        last = b - timedelta(days=1)
        if (a.month, a.day, b.month, b.day) == (1, 1, 1, 1):
            return str(a.year) if last.year == a.year else f"{a.year} to {last.year}"
        if a.day == 1 and b.day == 1:
            return f"{a:%b %Y}" if (last.year, last.month) == (a.year, a.month) else f"{a:%b %Y} to {last:%b %Y}"
        return f"{a.day} {a:%b %Y}" if last.date() == a.date() else f"{a.day} {a:%b %Y} to {last.day} {last:%b %Y}"
    return f"{a.day} {a:%b %Y %H:%M} to {b.day} {b:%b %Y %H:%M}"


def nice_ticks(most: float, count: int) -> list[float]:
    if most <= 0:
        return [0]
    raw = most / count
    size = 10 ** math.floor(math.log10(raw))
    step = next((m * size for m in (1, 2, 5, 10) if m * size >= raw), 10 * size)
    return [i * step for i in range(math.ceil(most / step - 1e-12) + 1)]


# Roll-ups


def folder_rollup(entries: DataFrame) -> DataFrame:
    return entries.groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).orderBy("folder")


def folder_rollup_numeric(entries: DataFrame) -> DataFrame:
    """The same in the order of the numbers in the names: 2 before 10."""
    return entries.groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).orderBy(numeric_key(F.col("folder")), "folder")


def tree_rollup(folders: DataFrame) -> DataFrame:
    """folders: path, files, bytes. Every folder above a path, the root (an empty path) included, with what lies in it and below: path, depth, files, bytes."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("path"), n.alias("depth")))
    return folders.select(F.explode(above).alias("a"), "files", "bytes").groupBy("a.path", "a.depth").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def plan_summary(entries: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One row: files, bytes, folders, skipped, and outcomes."""
    outcomes = [F.count_if(F.col("outcome") == o).alias(o) for o in C.OUTCOMES] if "outcome" in entries.columns else []
    out = entries.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.countDistinct("folder").alias("folders"), *outcomes)
    return out.crossJoin(skipped.agg(F.count("*").alias("skipped"))) if skipped is not None else out  # one row each


def analysed_sources(entries: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: how many sources a scan has entered or skipped."""
    return entries.select("source").unionByName(skipped.select("source")).agg(F.countDistinct("source").alias("analysed"))


def top_folders(entries: DataFrame, limit: int = 12) -> DataFrame:
    """The fullest folders; of equal ones, the one seen first."""
    name = F.when(F.col("folder") == "", F.lit("the destination root")).otherwise(F.col("folder"))
    return entries.groupBy(name.alias("folder")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min("ordinal").alias("first")).orderBy(F.desc("files"), "first").limit(limit).drop("first")


# Charts


def _dense(spark, values: list, column: str, kind: str, counts: DataFrame) -> DataFrame:
    base = spark.createDataFrame([(v,) for v in values], f"{column} {kind}")
    return base.join(counts, column, "left").withColumn("files", F.coalesce("files", F.lit(0)))


def hour_histogram(entries: DataFrame) -> DataFrame:
    """Twenty-four rows."""
    counts = entries.groupBy(F.floor(F.pmod(F.col("taken_epoch"), F.lit(DAY)) / 3600).cast("int").alias("hour")).agg(F.count("*").alias("files"))
    return _dense(entries.sparkSession, list(range(24)), "hour", "int", counts)


def midnight_share(entries: DataFrame) -> DataFrame:
    at_zero = F.count_if(F.pmod(F.col("taken_epoch"), F.lit(DAY)) < 3600)
    return entries.agg(F.coalesce(F.try_divide(at_zero.cast("double"), F.count("*").cast("double")), F.lit(0.0)).alias("share"))


def provider_counts(entries: DataFrame) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for i, p in enumerate(C.PROVIDERS) for x in (p, i)])
    return entries.groupBy("provider").agg(F.count("*").alias("files")).filter(F.col("provider").isin(*C.PROVIDERS)).orderBy(rank[F.col("provider")])


def reading() -> Column:
    """How an entry reads: decided by the user, wrong, agreed on by sources, or of a single one."""
    return F.when(F.col("override_origin").isNotNull(), "decided").when(any_hard(F.col("flags")), "wrong").when(F.col("confidence") == "high", "agree").otherwise("single")


def reading_counts(entries: DataFrame) -> DataFrame:
    return _dense(entries.sparkSession, list(READINGS), "reading", "string", entries.groupBy(reading().alias("reading")).agg(F.count("*").alias("files")))


def time_span(entries: DataFrame) -> DataFrame:
    """first, last, years (1 at least; 0 for none)."""
    out = entries.agg(F.min("taken_epoch").alias("first"), F.max("taken_epoch").alias("last"))
    years = F.greatest(F.lit(1), F.floor((F.col("last") - F.col("first")) / F.lit(365.25 * DAY) + 0.5)).cast("bigint")
    return out.withColumn("years", F.coalesce(years, F.lit(0)))


def _utc(year: Column, month: Column | None = None) -> Column:
    return F.unix_seconds(F.make_timestamp_ntz(year, F.lit(1) if month is None else month, F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("timestamp"))


def plan_range(entries: DataFrame) -> DataFrame:
    """from: the start of the first year; to: the start of the year after the last. No row without entries."""
    out = entries.agg(F.min("taken_epoch").alias("a"), F.max("taken_epoch").alias("b")).filter("a is not null")
    return out.select(_utc(F.year(F.timestamp_seconds("a"))).alias("from"), _utc(F.year(F.timestamp_seconds("b")) + 1).alias("to"))


def heat_cells(entries: DataFrame, start: int, end: int, level: str | None = None) -> DataFrame:
    """The calendar grid of [start, end): a row a cell that overlaps it, empty ones included: row_from, column, index, from, to, count.

    Rows are years, months or days and columns months, days or hours, by the length of the range.
    """
    level = level or level_for(start, end)
    spark = entries.sparkSession
    columns, row_unit, cell_unit, step = {"years": (12, "year", "month", "interval 1 year"), "months": (31, "month", "day", "interval 1 month"), "days": (24, "day", "hour", "interval 1 day")}[level]
    ts = lambda s: F.timestamp_seconds(F.lit(s)).cast("timestamp_ntz")
    row = spark.range(1).select(F.posexplode(F.sequence(F.date_trunc(row_unit, ts(start)).cast("timestamp_ntz"), ts(end - 1), F.expr(step))).alias("row", "row_at"))
    cell = row.select("row", "row_at", F.posexplode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column", "c"))
    at = {"years": F.make_timestamp_ntz(F.year("row_at"), F.col("c") + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0)), "months": F.try_make_timestamp_ntz(F.year("row_at"), F.month("row_at"), F.col("c") + 1, F.lit(0), F.lit(0), F.lit(0)), "days": F.col("row_at") + F.make_dt_interval(hours=F.col("c"))}[level]
    cell = cell.withColumn("at", at.cast("timestamp_ntz")).filter("at is not null").withColumn("from", epoch(F.col("at")))
    cell = cell.withColumn("to", {"years": epoch(F.add_months("at", 1).cast("timestamp_ntz")), "months": F.col("from") + DAY, "days": F.col("from") + 3600}[level]).filter((F.col("to") > start) & (F.col("from") < end))
    counts = entries.groupBy(epoch(F.date_trunc(cell_unit, F.timestamp_seconds("taken_epoch").cast("timestamp_ntz")).cast("timestamp_ntz")).alias("from")).agg(F.count("*").alias("count"))
    out = cell.join(counts, "from", "left")  # counts: a row a non-empty month, day or hour
    return out.select(epoch(F.col("row_at")).alias("row_from"), "column", (F.col("row") * columns + F.col("column")).cast("bigint").alias("index"), "from", "to", F.coalesce("count", F.lit(0)).alias("count"))


def heat_rows(cells: DataFrame, start: int, end: int, level: str) -> DataFrame:
    month = F.timestamp_seconds("row_from").cast("timestamp_ntz")
    row_end = {"years": epoch(F.add_months(month, 12).cast("timestamp_ntz")), "months": epoch(F.add_months(month, 1).cast("timestamp_ntz")), "days": F.col("row_from") + DAY}[level]
    return cells.groupBy("row_from").agg(F.sum("count").alias("count")).select(F.greatest("row_from", F.lit(start)).alias("from"), F.least(row_end, F.lit(end)).alias("to"), "count")


def heat_summary(cells: DataFrame) -> DataFrame:
    return cells.agg(F.max("count").alias("max"), F.sum("count").alias("total"), F.count_if(F.col("count") == 0).alias("empty_cells"), F.count("*").alias("cell_count"))


def selection_range(cells: DataFrame, a: int, b: int) -> DataFrame:
    """from and to of the cells between two indexes; no row if there are none."""
    return cells.filter(F.col("index").between(min(a, b), max(a, b))).agg(F.min("from").alias("from"), F.max("to").alias("to")).filter(F.col("from").isNotNull())


def ui_filter(entries: DataFrame, hits: DataFrame | None = None, tags: list[str] | None = None, untagged: bool = False, quality: float = 0.0, span: tuple[int, int] | None = None, folder: str | None = "", everywhere: bool = True, marked: DataFrame | None = None) -> DataFrame:
    """Search, tags, quality, range, folder, marked, in this order; with hits, rank keeps the order of the search."""
    out = entries
    if hits is not None:
        out = out.join(F.broadcast(ranked_hits(hits).drop("score")), "source")
    out = of_quality(with_tags(out, tags, untagged), quality)
    if span is not None:
        out = in_range(out, *span)
    if not everywhere:
        out = below(out, folder)
    return out.join(marked.select("source"), "source", "left_semi") if marked is not None else out
