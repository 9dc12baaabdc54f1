"""Queries that write files and read them again: listings, sidecars and EXIF, plans, journals, overlays, stores and copies; and the small rules."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datewright.functions import pattern as P
from datewright.functions import scalars as S
from datewright.functions.dateparse import parse_manual
from datewright.operators import overlay, tags, timeline, transfer, views, vision
from datewright.operators.resolve import candidates
from datewright.plans import adapters as A
from datewright.plans.adapters import PATTERN, ROOT, SQL
from datewright.plans.catalogue import _TURNS, _dated, day, query
from datewright.sources import exif, listing, providers, records
from datewright.sources.scratch import mounted, scratch
from datewright.streaming import incremental

# A tree of pictures, one a supplier, with sidecars for some

EXTENSIONS = ("jpg", "tif", "png", "webp", "raf")
FIRST = datetime(2000, 1, 1, 10, 20, 30)


def tiff(text: str, orientation: int) -> bytes:
    head = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2)
    head += struct.pack("<HHII", exif.ORIENTATION, 3, 1, orientation) + struct.pack("<HHII", exif.EXIF_IFD, 4, 1, 38) + struct.pack("<I", 0)
    return head + struct.pack("<H", 1) + struct.pack("<HHII", exif.ORIGINAL, 2, 20, 56) + struct.pack("<I", 0) + text.encode().ljust(20, b"\0")


def picture(ext: str, text: str, orientation: int) -> bytes:
    """A file of that kind with nothing in it but EXIF."""
    block = tiff(text, orientation)
    if ext == "tif":
        return block
    if ext == "png":
        chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"eXIf", block) + chunk(b"IEND", b"")
    if ext == "webp":
        return b"RIFF" + struct.pack("<I", 12 + len(block)) + b"WEBP" + b"EXIF" + struct.pack("<I", len(block)) + block
    body = b"Exif\0\0" + block
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 2 + len(body)) + body + b"\xff\xd9"
    return b"FUJIFILMCCD-RAW ".ljust(84, b"\0") + struct.pack(">II", 92, len(jpeg)) + jpeg if ext == "raf" else jpeg


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """Writes the tree; its root. Every seventh picture is a staged copy, and every eleventh lies in the destination."""
    root = mounted(scratch(spark, "tree"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, n in zip(frame["k"].tolist(), frame["n"].tolist(), strict=True):
                taken, ext = FIRST + timedelta(days=k), EXTENSIONS[k % 5]
                folder = f"{root}/in/{'out/' if k % 11 == 0 else ''}n{n}"
                os.makedirs(folder, exist_ok=True)
                name = f"{folder}/IMG_{taken:%Y%m%d}_{k}.{'part' if k % 7 == 0 else ext}"
                with open(name, "wb") as f:
                    f.write(picture(ext, f"{taken:%Y:%m:%d %H:%M:%S}", k % 8 + 1))
                if k % 3 == 0:
                    with open(f"{name}.xmp", "w") as f:
                        f.write(f'<x xmp:CreateDate="{taken + timedelta(minutes=k):%Y-%m-%dT%H:%M:%S}+02:00"/>')
                if k % 4 == 0:
                    with open(f"{name}.json", "w") as f:
                        json.dump({"photoTakenTime": {"timestamp": str(1_300_000_000 + 60 * k)}}, f)
            yield frame[["k"]]

    s = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("k"), F.col("s_nationkey").cast("bigint").alias("n"))
    s.mapInPandas(write, "k bigint").write.format("noop").mode("overwrite").save()
    return root


_PICTURES = """t as (select s_suppkey as k, s_nationkey as n, timestamp '2000-01-01 10:20:30' + to_days(s_suppkey::int) as taken, (['jpg', 'tif', 'png', 'webp', 'raf'])[s_suppkey % 5 + 1] as ext from supplier where s_suppkey % 11 <> 0),
pic as (select *, 'IMG_' || strftime(taken, '%Y%m%d') || '_' || k || '.' || case when k % 7 = 0 then 'part' else ext end as name from t),
files as (select n, name, ext from pic where k % 7 <> 0 union all select n, name || '.xmp', 'xmp' from pic where k % 3 = 0 union all select n, name || '.json', 'json' from pic where k % 4 = 0)"""


def _scanned(spark, sf_dir) -> DataFrame:
    root = _tree(spark, sf_dir)
    return listing.scan(spark, [f"{root}/in"], f"{root}/in/out")


@query("scan_files", f"with {_PICTURES} select 'n' || n as folder, name, ext from files")
def _(spark, sf_dir):
    """Whole tree, without staged copies and what lies in the destination."""
    return _scanned(spark, sf_dir).select(F.element_at(F.split("folder", "/"), -1).alias("folder"), "name", "ext")


_BYTES = "case ext when 'tif' then 76 when 'png' then 8 + 25 + 88 + 12 when 'webp' then 96 when 'raf' then 92 + 90 else 90 end"


@query("scan_totals", f"with {_PICTURES}, sized as (select {_BYTES} as size from pic where k % 7 <> 0 union all select length('<x xmp:CreateDate=\"' || strftime(taken, '%Y-%m-%dT%H:%M:%S') || '+02:00\"/>') from pic where k % 3 = 0 union all select length('{{\"photoTakenTime\": {{\"timestamp\": \"' || (1300000000 + 60 * k) || '\"}}}}') from pic where k % 4 = 0) select count(*) as files, sum(size)::bigint as bytes from sized")
def _(spark, sf_dir):
    return listing.totals(_scanned(spark, sf_dir))


def _detected(spark, sf_dir) -> DataFrame:
    found = providers.detect(_scanned(spark, sf_dir), ("filename", "exif", "media", "xmp", "takeout", "system")).filter(~F.col("ext").isin("xmp", "json"))
    return found.select("name", F.explode("candidates").alias("c")).select("name", "c.provider", day("c.taken").alias("taken"), "c.info")


_AT = "strftime({}, '%Y-%m-%d %H:%M:%S') as taken"


@query("detect_exif", f"with {_PICTURES} select name, {_AT.format('taken')}, 'DateTimeOriginal' as info from pic where k % 7 <> 0")
def _(spark, sf_dir):
    """JPEG, TIFF, PNG, WebP and RAF."""
    return _detected(spark, sf_dir).filter("provider = 'exif'").drop("provider")


@query("detect_names", f"with {_PICTURES} select name, {_AT.format(chr(100) + 'ate_trunc(' + chr(39) + 'day' + chr(39) + ', taken)')}, name as info from pic where k % 7 <> 0")
def _(spark, sf_dir):
    return _detected(spark, sf_dir).filter("provider = 'filename'").drop("provider")


@query("detect_xmp", f"with {_PICTURES} select name, {_AT.format('taken + to_minutes(k::int)')}, 'xmp:CreateDate in ' || name || '.xmp' as info from pic where k % 7 <> 0 and k % 3 = 0")
def _(spark, sf_dir):
    return _detected(spark, sf_dir).filter("provider = 'xmp'").drop("provider")


@query("detect_takeout", f"with {_PICTURES} select name, {_AT.format('make_timestamp((1300000000 + 60 * k)::bigint * 1000000)')}, name || '.json' as info from pic where k % 7 <> 0 and k % 4 = 0")
def _(spark, sf_dir):
    return _detected(spark, sf_dir).filter("provider = 'takeout'").drop("provider")


@query("detect_counts", f"with {_PICTURES} select name, 2 + (k % 3 = 0)::bigint + (k % 4 = 0)::bigint as n from pic where k % 7 <> 0")
def _(spark, sf_dir):
    """One detection a provider."""
    return _detected(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n"))


@query("orientations", f"with {_PICTURES} select name, (k % 8 + 1)::int as orientation, {_TURNS}[k % 8 + 1] as transform from pic where k % 7 <> 0")
def _(spark, sf_dir):
    files = _scanned(spark, sf_dir).filter(~F.col("ext").isin("xmp", "json"))
    return files.select("name", providers.read_orientation("source").alias("orientation")).withColumn("transform", S.for_orientation(F.col("orientation")))


@query("stamped_dates", f"with {_PICTURES} select name, strftime(taken + to_days(1), '%Y:%m:%d %H:%M:%S') as stamped from pic where k % 7 <> 0")
def _(spark, sf_dir):
    @F.pandas_udf("string")
    def stamp(paths: pd.Series) -> pd.Series:
        def one(path: str) -> str | None:
            with open(path, "rb") as f:
                data = f.read()
            taken = datetime.strptime(exif.dates(data)[0][1], "%Y:%m:%d %H:%M:%S") + timedelta(days=1)
            again = exif.stamp(data, taken)
            return exif.dates(again)[0][1] if again is not None and len(again) == len(data) else None

        return paths.map(one)

    return _scanned(spark, sf_dir).filter(~F.col("ext").isin("xmp", "json")).select("name", stamp("source").alias("stamped"))


@query("filesystem_times", "select o_orderkey as ordinal, strftime(case when o_orderkey % 4 = 0 then o_orderdate when o_orderkey % 4 = 1 then o_orderdate - to_days(3) else o_orderdate end, '%Y-%m-%d') as taken, case when o_orderkey % 4 = 0 then 'modified' when o_orderkey % 4 = 1 then 'modified' else 'created' end as info, strftime(case when o_orderkey % 4 = 3 then o_orderdate + to_days(2) else o_orderdate end, '%Y-%m-%d') as latest from orders")
def _(spark, sf_dir):
    """No creation time, a modification before it, at the same time, after it."""
    o, n = A.table(spark, sf_dir, "orders"), F.col("o_orderkey") % 4
    at = lambda d: (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(d))).cast("timestamp_ntz")
    created, modified = F.when(n != 0, at(0)), F.when(n == 1, at(-3)).when(n == 3, at(2)).otherwise(at(0))
    own = listing.filesystem_time(created, modified)
    show = lambda c: F.date_format(c, "yyyy-MM-dd")
    return o.select(F.col("o_orderkey").alias("ordinal"), show(own["taken"]).alias("taken"), own["info"].alias("info"), show(listing.filesystem_latest(created, modified)).alias("latest"))


@query("system_times", "select o_orderkey as ordinal from orders where o_orderkey % 6 >= 3")
def _(spark, sf_dir):
    """A time that the operating system tells counts unless it echoes the file's own, within two seconds."""
    o = A.table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    files = o.select(F.col("o_orderkey").alias("ordinal"), at.alias("created"), at.alias("modified"), F.lit("plain").alias("name"), (at + F.make_dt_interval(secs=(F.col("o_orderkey") % 6).cast("int"))).cast("timestamp_ntz").alias("system"))
    found = providers.detect(files, ("filename", "system"))
    return found.filter(F.exists("candidates", lambda c: c["provider"] == "system")).select("ordinal")


@query("takeout_names", "select c_custkey as id, case c_custkey % 3 when 0 then 'p' || c_custkey || '.jpg(2).json,p' || c_custkey || '(2).jpg.json,p' || c_custkey || '(2).jpg.supplemental-metadata.json' when 1 then 'p' || c_custkey || '.jpg.json,p' || c_custkey || '.jpg.supplemental-metadata.json' else 'p' || c_custkey || '-edited.jpg.json,' || 'p' || c_custkey || '-edited.jpg.supplemental-metadata.json,p' || c_custkey || '.jpg.json,p' || c_custkey || '.jpg.supplemental-metadata.json' end as names from customer")
def _(spark, sf_dir):
    c, k = A.table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = F.concat(F.lit("p"), k.cast("string"), F.when(k % 3 == 0, "(2)").when(k % 3 == 2, "-edited").otherwise(""), F.lit(".jpg"))
    return c.select(k.alias("id"), F.array_join(providers.takeout_names(name), ",").alias("names"))


# Plans


_HEADER = {"created_at": "2026-01-01T00:00:00", "sources": ["/s"], "destination": ROOT, "folder_pattern": PATTERN, "detect": {"providers": ["exif"], "strategy": "smart", "weights": {"exif": 50}}}


def _entries(spark, sf_dir) -> DataFrame:
    return _dated(spark, sf_dir).select("source", "destination", "taken", "provider", "size", "ordinal")


def _skipped(spark, sf_dir) -> DataFrame:
    return A.table(spark, sf_dir, "region").select(F.concat(F.lit("/r"), F.col("r_regionkey").cast("string")).alias("source"), F.col("r_name").alias("reason"))


def _written(spark, sf_dir) -> str:
    path = scratch(spark, "plan")
    records.write_plan(_HEADER, _entries(spark, sf_dir), _skipped(spark, sf_dir), path)
    return path


_DATED_SQL = f"{SQL['files']}, dated as (select *, '/archive/' || strftime(taken, '%Y/%m') || '/' || regexp_extract(source, '[^/]*$') as destination from files)"


@query("plan_written", f"with {_DATED_SQL} select ordinal, source, destination, {_AT.format('taken')}, size from dated")
def _(spark, sf_dir):
    """A plan written as many files and read again."""
    return records.read_plan(spark, _written(spark, sf_dir)).entries.select("ordinal", "source", "destination", day("taken").alias("taken"), "size")


@query("plan_skipped", "select '/r' || r_regionkey as source, r_name as reason, (select count(*) from region) + (select count(*) from orders) as analysed from region")
def _(spark, sf_dir):
    plan = records.read_plan(spark, _written(spark, sf_dir))
    return plan.skipped.crossJoin(F.broadcast(views.analysed_sources(plan.entries, plan.skipped)))  # one row


@query("plan_rewritten", f"with {_DATED_SQL} select ordinal, source from dated where ordinal % 2 = 0")
def _(spark, sf_dir):
    """A plan that is written over the one it is read from."""
    path = _written(spark, sf_dir)
    plan = records.read_plan(spark, path)
    records.write_plan(_HEADER, plan.entries.filter("ordinal % 2 = 0"), plan.skipped, path)
    return records.read_plan(spark, path).entries.select("ordinal", "source")


@query("plan_lines", "select l_orderkey as source, count(*) as n, max(l_linenumber)::bigint as last from lineitem group by 1")
def _(spark, sf_dir):
    """Lines of several files keep their order: a journal of one record a line, in files of which the later are the smaller."""
    path = scratch(spark, "lines")
    line = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("n")).distinct()
    text = lambda rows: rows.select(F.to_json(F.struct(F.col("source").cast("string").alias("source"), F.lit("copied").alias("status"), F.col("n").cast("string").alias("destination"))).alias("value"))
    for n in range(1, 8):
        text(line.filter(F.col("n") == n)).write.text(f"{path}/run-{n:06d}")
    found = records.read_journal(spark, path)
    count = found.groupBy("source").agg(F.count("*").alias("k"))
    lines = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("source")).agg(F.count("*").alias("n"))
    last = transfer.latest(found).join(count, "source").join(lines, "source")
    return last.select(F.col("source").cast("bigint").alias("source"), "n", F.col("destination").cast("bigint").alias("last"))


@query("plan_retargeted", f"with {SQL['files']} select ordinal, '/elsewhere/' || strftime(taken, '%Y/%m') || '/' || regexp_extract(source, '[^/]*$') as destination, true as changed, false as again, 0::bigint as journal from files")
def _(spark, sf_dir):
    """Another destination: the plan is written anew and its journal goes; the same one: nothing is done."""
    path, journal = _written(spark, sf_dir), scratch(spark, "journal")
    records.append_journal(_outcomes(_entries(spark, sf_dir).limit(10), F.lit("copied")), journal)
    changed = records.retarget_plan(spark, path, "/elsewhere", journal)
    again = records.retarget_plan(spark, path, "/elsewhere", journal)
    left = records.read_journal(spark, journal).count()
    return records.read_plan(spark, path).entries.select("ordinal", "destination", F.lit(changed).alias("changed"), F.lit(again).alias("again"), F.lit(left).cast("bigint").alias("journal"))


@query("scan_continued", f"with {SQL['files']} select source, ordinal % 3 <> 0 and ordinal % 5 <> 0 as fresh from files")
def _(spark, sf_dir):
    """A scan that goes on: what an earlier one entered or skipped stays, the rest is appended in order."""
    path, files = scratch(spark, "plan"), _entries(spark, sf_dir)
    known = files.filter("ordinal % 3 = 0")
    records.write_plan(_HEADER, known, files.filter("ordinal % 5 = 0 and ordinal % 3 <> 0").select("source", F.lit("no date").alias("reason")), path)
    left, plan = records.scan_on(spark, path, _HEADER, files)
    records.append_plan(plan, left, _skipped(spark, sf_dir).limit(0), path)
    last = known.agg(F.max("ordinal")).head()[0]
    again = records.read_plan(spark, path)
    return again.entries.select("source", (F.col("ordinal") > last).alias("fresh")).unionByName(again.skipped.select("source", F.lit(False).alias("fresh")))


# Journals and copies


def _outcomes(rows: DataFrame, status) -> DataFrame:
    none = F.lit(None)
    return rows.select("source", status.alias("status"), F.col("destination"), none.cast("string").alias("error"), F.when(status == "duplicate", F.struct(F.col("size"), F.lit("h").alias("hash"))).alias("written"))


_RUNS = f"{_DATED_SQL}, last_ as (select *, case when ordinal % 3 = 0 then 'already_present' when ordinal % 2 = 0 then 'duplicate' when ordinal % 5 = 0 then 'failed' else 'copied' end as status from dated)"


def _journal(spark, sf_dir) -> DataFrame:
    """Three runs, the first the largest: copies of which some fail, every other file again as a duplicate, every third again, found present."""
    path, files = scratch(spark, "journal"), _entries(spark, sf_dir)
    records.append_journal(_outcomes(files, F.when(F.col("ordinal") % 5 == 0, "failed").otherwise("copied")), path)
    records.append_journal(_outcomes(files.filter("ordinal % 2 = 0"), F.lit("duplicate")), path)
    records.append_journal(_outcomes(files.filter("ordinal % 3 = 0"), F.lit("already_present")), path)
    return records.read_journal(spark, path)


@query("journal_runs", f"with {_RUNS} select source, status from last_")
def _(spark, sf_dir):
    """The last record of a source over the files of several runs."""
    return transfer.latest(_journal(spark, sf_dir)).select("source", "status")


@query("journal_written", f"with {_RUNS} select source, size from last_ where status = 'duplicate'")
def _(spark, sf_dir):
    return transfer.written(_journal(spark, sf_dir)).select("source", F.col("written.size").alias("size"))


@query("journal_pending", f"with {_RUNS} select ordinal from last_ where status = 'failed'")
def _(spark, sf_dir):
    return transfer.pending(_entries(spark, sf_dir), _journal(spark, sf_dir), retry_failed=True).select("ordinal")


def _copies(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A text a supplier, of which many are the same, copied to ten places, one of which can't be written to; the allocated plan and the journal."""
    root = mounted(scratch(spark, "copies"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(f"{root}/src", exist_ok=True)
        os.makedirs(f"{root}/out", exist_ok=True)
        for frame in frames:
            for k in frame["k"].tolist():
                with open(f"{root}/src/{k:09d}", "w") as f:
                    f.write("x" * (k % 37 + 1))
            yield frame

    s = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("k"))
    s.mapInPandas(write, "k bigint").write.format("noop").mode("overwrite").save()
    with open(f"{root}/out/closed", "w") as f:
        f.write("a file, where a folder would have to be")
    where = F.when(F.col("k") % 10 == 3, F.lit(f"{root}/out/closed/3.txt")).otherwise(F.concat(F.lit(f"{root}/out/d/"), (F.col("k") % 10).cast("string"), F.lit(".txt")))
    plan = s.select("k", F.concat(F.lit(f"{root}/src/"), A.padded(F.col("k"), 9)).alias("source"), where.alias("destination"), (F.col("k") % 37 + 1).alias("size"), F.md5(F.repeat(F.lit("x"), (F.col("k") % 37 + 1).cast("int"))).alias("hash"))
    allocated = transfer.allocate(plan)
    return allocated, transfer.copy_files(allocated, scratch(spark, "journal"))


_COPIES = """c as (select s_suppkey as k, s_suppkey % 10 as d, s_suppkey % 37 as body from supplier),
f as (select d, body, min(k) as first_ from c group by 1, 2), n as (select *, row_number() over (partition by d order by first_) - 1 as variant from f),
o as (select c.k, c.body + 1 as size, case when c.d = 3 then 'failed' when c.k <> first_ then 'already_present' when variant > 0 then 'duplicate' else 'copied' end as status from c join n using (d, body))"""


@query("copy_run", f"with {_COPIES} select k, status from o")
def _(spark, sf_dir):
    allocated, journal = _copies(spark, sf_dir)
    return allocated.select("k", "source").join(journal, "source").select("k", "status")


@query("copy_run_counters", f"with {_COPIES} select count(*) filter (status = 'copied') as copied, count(*) filter (status = 'duplicate') as duplicate, count(*) filter (status = 'already_present') as already_present, count(*) filter (status = 'failed') as failed, 0::bigint as turned, coalesce(sum(size) filter (status in ('copied', 'duplicate')), 0)::bigint as bytes from o")
def _(spark, sf_dir):
    allocated, journal = _copies(spark, sf_dir)
    rows = allocated.select("source", "size").join(journal, "source")
    return transfer.copy_counters(rows.withColumn("turned", F.col("written").isNotNull()))


@query("copied_bytes", f"with {_COPIES} select k, size, md5(repeat('x', size::int)) as hash from o where status in ('copied', 'duplicate')")
def _(spark, sf_dir):
    """What lies at the destinations."""
    @F.pandas_udf("string")
    def content(paths: pd.Series) -> pd.Series:
        def one(path: str) -> str:
            with open(path) as f:
                return f.read()

        return paths.map(one)

    allocated, journal = _copies(spark, sf_dir)
    rows = allocated.select("k", "source").join(journal.filter("status in ('copied', 'duplicate')"), "source").withColumn("text", content("destination"))
    return rows.select("k", F.length("text").cast("bigint").alias("size"), F.md5("text").alias("hash"))


@query("verify_turned", f"with {SQL['dups']}, f as (select destination, size, hash, min(source) as first_ from dups group by 1, 2, 3), p as (select d.*, row_number() over (partition by d.destination order by d.source) as n from dups d) select doc_id, case when doc_id % 3 = 0 then 'ok' when doc_id % 3 = 1 then 'content_mismatch' else 'ok' end as status from dups")
def _(spark, sf_dir):
    """Turned copies are held against what the journal says was written, and taken on trust where it says nothing."""
    d = A.dups_documents(spark, sf_dir).withColumn("destination", F.concat(F.lit("/own/"), F.col("doc_id").cast("string")))
    there = d.select("destination", F.lit(0).cast("bigint").alias("variant"), (F.col("size") + 1).alias("size"), F.lit("turned").alias("hash"))
    said = d.filter("doc_id % 3 <> 2").select("source", F.when(F.col("doc_id") % 3 == 0, F.col("size") + 1).otherwise(F.col("size") + 2).alias("size"), F.lit("turned").alias("hash"))
    checked = transfer.verify(d.select("source", "destination", "size", F.lit("rot90").alias("rotate")), d.select("source", "size", "hash"), there, said)
    return d.select("doc_id", "source").join(checked, "source").select("doc_id", "status")


# Overlays, stores and settings


def _document(spark, tag: str, text: str) -> str:
    """A file of one JSON document; it is as small as what a user edits by hand."""
    path = scratch(spark, tag)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


def _nations(spark, sf_dir) -> list[tuple[int, str]]:
    return [(r["n_nationkey"], r["n_name"]) for r in A.table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]


@query("read_dates", "select '/' || n_name as source, strftime(timestamp '2020-01-02 03:04:05' + to_days(n_nationkey::int), '%Y-%m-%d %H:%M:%S') as taken, case n_nationkey % 3 when 0 then 'taken from xmp' when 1 then 'set by hand' else 'shifted by +0d 0h ' || n_nationkey || 'm' end as origin from nation")
def _(spark, sf_dir):
    doc = {f"/{name}": {"taken": (datetime(2020, 1, 2, 3, 4, 5) + timedelta(days=k)).isoformat(), "origin": ("candidate", "manual", "shift")[k % 3], "provider": "xmp" if k % 3 == 0 else None, "seconds": 60 * k, "at": "2026-01-01T00:00:00"} for k, name in _nations(spark, sf_dir)}
    rows = records.read_dates(spark, _document(spark, "dates", "﻿" + json.dumps(doc)))
    return rows.select("source", day("taken").alias("taken"), records.describe_origin(F.col("origin"), F.col("provider"), F.col("seconds")).alias("origin"))


@query("read_rotations", f"select '/' || n_name as source, {_TURNS}[n_nationkey % 8 + 1] as rotate, n_nationkey % 2 = 0 as reencode from nation")
def _(spark, sf_dir):
    doc = {f"/{name}": {"rotate": S.ORIENTATION[k % 8 + 1], "reencode": k % 2 == 0, "at": "2026-01-01T00:00:00"} for k, name in _nations(spark, sf_dir)}
    return records.read_rotations(spark, _document(spark, "turns", json.dumps(doc))).select("source", "rotate", "reencode")


@query("read_exclusions", "select '/' || n_name as source from nation")
def _(spark, sf_dir):
    return records.read_exclusions(spark, _document(spark, "out", json.dumps([f"/{name}" for _, name in _nations(spark, sf_dir)])))


@query("store_opened", "select '/' || n_name as source, n_name || ',' || n_nationkey as tags from nation where n_nationkey % 2 = 0")
def _(spark, sf_dir):
    """A store that takes in a legacy file, is replaced by a part of itself, and opened again."""
    path, legacy = scratch(spark, "store"), mounted(scratch(spark, "legacy"))
    os.makedirs(os.path.dirname(legacy), exist_ok=True)
    with open(legacy, "w") as f:
        json.dump({f"/{name}": {"tags": [name, str(k)], "quality": float(k)} for k, name in _nations(spark, sf_dir)}, f)
    store = records.open_store(spark, path, legacy)
    records.replace_store(store.filter("cast(quality as int) % 2 = 0"), path)
    return records.open_store(spark, path, legacy).select("source", F.array_join("tags", ",").alias("tags"))


@query("settings_kept", "select 'exif' as provider, 100::bigint as weight union all select 'xmp', 0 union all select 'media', 33")
def _(spark, sf_dir):
    """Weights are clamped when they are saved."""
    path = mounted(scratch(spark, "settings"))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    records.Settings(weights={"exif": 500, "xmp": -3, "media": 33}).save(path)
    return spark.createDataFrame(list(records.Settings.load(path).weights.items()), "provider string, weight bigint")


def _side(spark) -> DataFrame:
    return spark.createDataFrame([], "source string, taken timestamp_ntz, origin string, provider string, seconds bigint")


@query("shift_chosen", f"with {SQL['files']} select ordinal, strftime(case when ordinal % 9 = 0 then taken + to_seconds(93784) else taken end, '%Y-%m-%d %H:%M:%S') as taken, case when ordinal % 9 = 0 then 'shift' end as origin from files")
def _(spark, sf_dir):
    plan = A.files_orders(spark, sf_dir)
    copied = plan.filter("ordinal % 9 = 1").select("source", F.lit("copied").alias("status"))
    side = overlay.shift(plan, _side(spark), plan.filter("ordinal % 9 = 0"), 93784, copied)
    return overlay.apply_dates(plan, side, ROOT, PATTERN).select("ordinal", day("taken").alias("taken"), F.col("override_origin").alias("origin"))


@query("reprovide_chosen", f"with {SQL['det']} select ordinal, strftime(taken, '%Y-%m-%d') as taken from det where provider = 'xmp' and ordinal % 4 = 0")
def _(spark, sf_dir):
    plan = A.detections_orders(spark, sf_dir).withColumn("taken", F.lit(None).cast("timestamp_ntz"))
    side = overlay.reprovide(plan, _side(spark), plan.filter("ordinal % 4 = 0"), "xmp")
    return plan.select("ordinal", "source").join(side, "source").select("ordinal", F.date_format("taken", "yyyy-MM-dd").alias("taken"))


@query("dates_set_and_cleared", f"with {SQL['files']}, k as (select min(ordinal) as lo, max(ordinal) as hi from files) select ordinal, case when ordinal = hi then '2003-04-05 06:07:00' else strftime(taken, '%Y-%m-%d %H:%M:%S') end as taken from files, k")
def _(spark, sf_dir):
    """One date set by hand, one taken from a provider and cleared again."""
    plan = A.detections_orders(spark, sf_dir).join(A.files_orders(spark, sf_dir).select("ordinal", "taken"), "ordinal")
    ends = plan.agg(F.min_by("source", "ordinal").alias("lo"), F.max_by("source", "ordinal").alias("hi")).head()
    side = overlay.set_manual(plan, _side(spark), ends["hi"], " 2003-04-05 06:07 ")
    side = overlay.set_candidate(plan, side, ends["lo"], "exif")
    side = overlay.clear(side, plan.filter(F.col("source") == ends["lo"]))
    return overlay.apply_dates(plan, side, ROOT, PATTERN).select("ordinal", day("taken").alias("taken"))


@query("rotation_decisions", f"with p as (select p_partkey as k, {_TURNS}[p_partkey % 8 + 1] as own, (p_partkey % 10)::int as orientation, case when p_partkey % 3 <> 0 then 'rot90' end as guess, p_partkey % 2 = 0 as lossless from part) select k, case when own <> 'none' then own when orientation <= 1 and guess is not null and lossless then guess else 'none' end as rotate, 'none' as off from p")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    args = (k % 10).cast("int"), S.for_orientation((k % 8 + 1).cast("int")), F.when(k % 3 != 0, "rot90"), k % 2 == 0
    return A.table(spark, sf_dir, "part").select(k.alias("k"), overlay.rotation_decision(*args).alias("rotate"), overlay.rotation_decision(*args, enabled=False).alias("off"))


# Small rules


@query("typed_dates", "select event_id as ordinal, strftime(case event_id % 5 when 0 then date_trunc('second', ts) when 1 then date_trunc('second', ts) when 2 then date_trunc('minute', ts) when 3 then date_trunc('day', ts) end, '%Y-%m-%d %H:%M:%S') as taken from events")
def _(spark, sf_dir):
    at = lambda f: F.date_format("ts", f)
    n = F.col("event_id") % 5
    text = F.when(n == 0, F.concat(F.lit("  "), at("yyyy-MM-dd HH:mm:ss"))).when(n == 1, at("yyyy-MM-dd'T'HH:mm:ss")).when(n == 2, at("yyyy-MM-dd HH:mm")).when(n == 3, at("yyyy-MM-dd")).otherwise(at("dd/MM/yyyy"))
    return A.table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), day(parse_manual(text)).alias("taken"))


@query("fingerprints", "with v as (select vec_id, unnest(range(64)) as k from embeddings), g as (select vec_id, k, ((vec_id * 31 + k // 8 * 17 + (k % 8) * (k % 8) * 7) % 256) > ((vec_id * 31 + k // 8 * 17 + (k % 8 + 1) * (k % 8 + 1) * 7) % 256) as bit from v), h as (select vec_id, sum(case when bit then (1::hugeint << k::int) else 0::hugeint end) as h from g group by 1) select '' || vec_id as source, (case when h >= 9223372036854775808 then h - 18446744073709551616 else h end)::bigint as hash from h")
def _(spark, sf_dir):
    def decode(path: str) -> np.ndarray:
        r, c = np.mgrid[0:8, 0:9]
        return (int(path) * 31 + r * 17 + c * c * 7) % 256

    return vision.fingerprints(A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("source")), decode)


@query("picture_kinds", "select l_orderkey * 10 + l_linenumber as ordinal, (l_linenumber % 7) = 0 as hashable, (l_linenumber % 7) = 0 as picture from lineitem group by l_orderkey, l_linenumber")
def _(spark, sf_dir):
    c = A.companions_lineitem(spark, sf_dir)
    return c.select("ordinal", S.hashable(S.extension(F.col("source"))).alias("hashable"), S.is_picture(S.extension(F.col("source"))).alias("picture"))


@query("numeric_folders", "with f as (select 'Brand ' || cast(p_partkey % 120 as varchar) || case when p_partkey % 2 = 0 then '/b' else '/a' end as folder, count(*) as files, sum(p_size)::bigint as bytes, min(p_partkey % 120) as n from part group by 1) select folder, files, bytes, row_number() over (order by n, folder) as place from f")
def _(spark, sf_dir):
    """2 before 10."""
    from pyspark.sql import Window

    k = F.col("p_partkey") % 120
    p = A.table(spark, sf_dir, "part").select(F.concat(F.lit("Brand "), k.cast("string"), F.when(F.col("p_partkey") % 2 == 0, "/b").otherwise("/a")).alias("folder"), F.col("p_size").cast("bigint").alias("size"))
    rolled = views.folder_rollup_numeric(p)
    return rolled.withColumn("place", F.row_number().over(Window.orderBy(S.numeric_key(F.col("folder")), "folder")).cast("bigint"))  # a row a folder


def _months(spark, sf_dir) -> list[tuple[int, int]]:
    o = A.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).distinct()
    return sorted((r["y"], r["m"]) for r in o.collect())  # months of some years


def _epoch(*at: int) -> int:
    return int((datetime(*at) - datetime(1970, 1, 1)).total_seconds())


@query("range_labels", "with m as (select distinct date_trunc('month', o_orderdate) as m from orders) select strftime(m, '%Y-%m') as month, strftime(m, '%b %Y') as label, strftime(m, '%Y') as year, strftime(m, '%-d %b %Y') as day, strftime(m, '%-d %b %Y') || ' to ' || strftime(m + to_days(1), '%-d %b %Y') as days, strftime(m + to_hours(1), '%-d %b %Y %H:%M') || ' to ' || strftime(m + to_hours(3), '%-d %b %Y %H:%M') as hours from m")
def _(spark, sf_dir):
    rows = []
    for y, m in _months(spark, sf_dir):
        a = _epoch(y, m, 1)
        after = _epoch(y + m // 12, m % 12 + 1, 1)
        rows.append((f"{y}-{m:02d}", views.range_label(a, after), views.range_label(_epoch(y, 1, 1), _epoch(y + 1, 1, 1)), views.range_label(a, a + 86400), views.range_label(a, a + 2 * 86400), views.range_label(a + 3600, a + 3 * 3600)))
    return spark.createDataFrame(rows, "month string, label string, year string, day string, days string, hours string")


@query("ranges_of_days", "with m as (select distinct date_trunc('month', o_orderdate)::date as m from orders) select strftime(m, '%Y-%m') as month, epoch(m)::bigint as start, epoch(m + 10)::bigint as \"end\", (epoch(m) + 86400)::bigint as inverted, -62135596800::bigint as open_start, 253402300800::bigint as open_end from m")
def _(spark, sf_dir):
    rows = []
    for y, m in _months(spark, sf_dir):
        a, b = f"{y}-{m:02d}-01", f"{y}-{m:02d}-10"
        rows.append((a[:7], *views.range_of_days(a, b), views.range_of_days(a, "1970-01-01")[1], views.range_of_days(None, b)[0], views.range_of_days(a, "nonsense")[1]))
    return spark.createDataFrame(rows, "month string, start bigint, end bigint, inverted bigint, open_start bigint, open_end bigint")


@query("axis_ticks", "with n as (select n_nationkey as id, ((n_nationkey + 1) * 37)::double as most from nation), s as (select *, most / 5 as raw, pow(10, floor(log10(most / 5))) as unit from n), t as (select *, case when unit >= raw then unit when 2 * unit >= raw then 2 * unit when 5 * unit >= raw then 5 * unit else 10 * unit end as step from s) select id, step::bigint as step, ceil(most / step - 1e-12)::bigint + 1 as ticks from t")
def _(spark, sf_dir):
    rows = [(k, views.nice_ticks((k + 1) * 37, 5)) for k, _ in _nations(spark, sf_dir)]
    return spark.createDataFrame([(k, int(round(t[1] - t[0])), len(t)) for k, t in rows], "id bigint, step bigint, ticks bigint")


@query("copy_workers", "with n as (select n_nationkey as id, (n_nationkey + 1) * 10 as files, ((n_nationkey % 3) * 10000000 + 200000)::bigint as mean from nation) select id, (case when mean >= 16777216 then 4 when mean <= 262144 then 16 else 8 end)::bigint as workers from n")
def _(spark, sf_dir):
    rows = [(k, transfer.tuned_concurrency((k + 1) * 10, (k + 1) * 10 * ((k % 3) * 10_000_000 + 200_000), 8)) for k, _ in _nations(spark, sf_dir)]
    return spark.createDataFrame(rows, "id bigint, workers bigint")


@query("patterns_checked", "select * from (values ('%Y/%m', true), ('%Y/{subject}', true), ('', false), ('  ', false), ('%Q', false)) v(pattern, valid)")
def _(spark, sf_dir):
    def valid(pattern: str) -> bool:
        try:
            P.compile_pattern(pattern, F.lit("2020-01-02 03:04:05").cast("timestamp_ntz"))
            return True
        except ValueError:
            return False

    return spark.createDataFrame([(p, valid(p)) for p in ("%Y/%m", "%Y/{subject}", "", "  ", "%Q")], "pattern string, valid boolean")


@query("plan_names", "select (select count(*) from nation) as sources, (select count(*) from nation) as names, true as steady")
def _(spark, sf_dir):
    """A name for each set of sources, always the same."""
    keys = [[f"/{name}"] for _, name in _nations(spark, sf_dir)]
    names = [records.default_plan_name(k, "/out") for k in keys]
    return spark.createDataFrame([(len(keys), len(set(names)), names == [records.default_plan_name(k, "/out") for k in keys])], "sources bigint, names bigint, steady boolean")


# Models: what surrounds them


@query("tagging_run", f"with {SQL['tags']} select source, case when ordinal % 4 = 0 then array_to_string(tags, ',') else 'seen ' || (ordinal % 10) end as tags, case when ordinal % 4 = 0 then quality else (ordinal % 10) / 2.0::double end as quality from sight")
def _(spark, sf_dir):
    """Files that the store doesn't hold go through a model in batches, and are added to it."""
    files = A.tags_documents(spark, sf_dir)
    store = files.filter("ordinal % 4 = 0").select("source", "tags", "quality")

    def model(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n = frame["ordinal"] % 10
            yield pd.DataFrame({"source": frame["source"], "tags": [[f"seen {x}"] for x in n], "quality": n / 2.0})

    fresh = tags.in_batches(tags.untagged_sources(files, store).select("source", "ordinal"), model, "source string, tags array<string>, quality double")
    return tags.upsert(store, fresh).select("source", F.array_join("tags", ",").alias("tags"), "quality")


@query("boxes_kept", "select l_orderkey as file_id, l_linenumber::bigint as line from lineitem l where l_linenumber % 2 = 1 or l_linenumber % 4 = 2 or not exists (select 1 from lineitem o where o.l_orderkey = l.l_orderkey and o.l_linenumber = l.l_linenumber - 1) group by l_orderkey, l_linenumber")
def _(spark, sf_dir):
    """Odd lines' boxes are surer. An even line's box lies on the one before it, but for every other, which lies beside it."""
    n = F.col("l_linenumber")
    line = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    left = F.floor((n - 1) / 2) * 10 + F.when(n % 4 == 2, 5).otherwise(0)
    boxes = line.select(F.col("l_orderkey").cast("bigint").alias("file_id"), F.lit("none").alias("turn"), F.lit("dog").alias("label"), F.when(n % 2 == 1, 0.9).otherwise(0.5).cast("float").alias("confidence"), F.array(left, F.lit(0), left + 4, F.lit(4)).cast("array<float>").alias("bounds"), n.cast("bigint").alias("line"))
    return vision.suppress(boxes).select("file_id", "line")


@query("boxes_decoded", "select l_orderkey as file_id, case when l_partkey % 2 = 0 then 'dog' else 'cat' end as label, round((l_quantity / 50 * 0.5 + 0.4), 3) as confidence, 0.25::double as x, 0.75::double as right from lineitem where l_linenumber = 1 and round((l_quantity / 50 * 0.5 + 0.4), 3) > 0.35")
def _(spark, sf_dir):
    """A detector's raw output to boxes in shares of the content."""
    line = A.table(spark, sf_dir, "lineitem").filter("l_linenumber = 1")
    scores = line.select(F.col("l_orderkey").cast("bigint").alias("file_id"), F.lit("none").alias("turn"), F.struct((F.col("l_partkey") % 2).alias("kind"), F.round(F.col("l_quantity") / 50 * 0.5 + 0.4, 3).alias("sure")).alias("s"))

    def model(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, w, h, left, top = vision.letterbox(400, 200)
        for frame in frames:
            rows = []
            for i, s in zip(frame["file_id"], frame["s"], strict=True):
                raw = np.zeros((6, 3))
                raw[:4, 1] = (left + w / 2, top + h / 2, w / 2, h)
                raw[4 + int(s["kind"] % 2), 1] = float(s["sure"])
                rows += [(i, b["label"], round(b["confidence"], 3), b["bounds"][0], b["bounds"][2]) for b in vision.decoded(raw, ["dog", "cat"], (w, h), (left, top))]
            yield pd.DataFrame(rows, columns=["file_id", "label", "confidence", "x", "right"])

    return scores.mapInPandas(model, "file_id bigint, label string, confidence double, x double, right double")


@query("axis_of_other_dates", "with days as (select distinct floor(epoch(o_orderdate) / 86400)::bigint as day from orders where year(o_orderdate) in (1996, 1999)), g as (select day, lead(day) over (order by day) - day as gap from days), w as (select *, case when coalesce(gap, 1) > 90 then 0 else coalesce(gap, 1) end as plain, case when coalesce(gap, 1) > 90 then log2(1 + gap) else 0 end as weight from g), x as (select *, case when weight > 0 then (select case when sum(plain) = 0 then 1 else sum(plain) end from w) * 0.45 * weight / (select sum(weight) from w) else plain end::double as raw from w), axis as (select day, raw, coalesce(sum(raw) over (order by day rows between unbounded preceding and 1 preceding), 0) as upto, (select sum(raw) from x) as total from x), e as (select o_orderkey as ordinal, epoch(o_orderdate)::bigint + o_orderkey % 86400 as epoch from orders) select ordinal, round(case when day is null then 0 else least(1, (upto + least(1, raw) * least(1, (epoch - day * 86400) / 86400.0::double)) / total) end, 6) as t from e asof left join axis on axis.day <= floor(e.epoch / 86400)")
def _(spark, sf_dir):
    """Dates that an axis wasn't built of take the place of the last day before them."""
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), F.year("o_orderdate").alias("year"), S.epoch(F.col("o_orderdate").cast("timestamp_ntz")).alias("midnight"))
    axis = timeline.time_axis(o.filter("year in (1996, 1999)").select(F.col("midnight").alias("epoch")))
    rows = o.select("ordinal", (F.col("midnight") + F.col("ordinal") % 86400).alias("epoch"))
    return timeline.on_axis(rows, axis).select("ordinal", F.round("t", 6).alias("t"))


_MATRIX = [0.9, 0.0, 0.1, 0.2, 0.0, 1.1, 0.0, 0.1, 0.1, 0.0, 0.8, 0.5, 0.0, 0.0, 0.0, 6.0]


@query("visible_tiles", "with p as (select vec_id as ordinal, (vec_id % 41) / 4.0::double - 5 as x, (vec_id % 29) / 4.0::double - 3 as y, (vec_id % 23) / 4.0::double - 3 as z, vec_id % 3 <> 0 as chosen from embeddings), d as (select *, 0.2 * x + 0.1 * y + 0.5 * z + 6 as depth, 0.9 * x + 0.1 * z as px, 1.1 * y as py from p where chosen), s as (select ordinal, (px / depth + 1) / 2 as tile_x, 1 - (py / depth + 1) / 2 as tile_y, least(0.26, 0.62 / tan(0.45) / 2 / depth) as size, depth from d where depth >= 1.15) select ordinal, round(tile_x, 6) as tile_x, round(tile_y, 6) as tile_y, round(size, 6) as size, round(depth, 6) as depth from s where tile_x between -0.2 and 1.2 and tile_y between -0.2 and 1.2 order by round(s.depth, 9), ordinal limit 48")
def _(spark, sf_dir):
    k = F.col("vec_id")
    placed = A.table(spark, sf_dir, "embeddings").select(k.alias("ordinal"), F.lit(0).alias("pos"), ((k % 41) / 4.0 - 5).alias("x"), ((k % 29) / 4.0 - 3).alias("y"), ((k % 23) / 4.0 - 3).alias("z"), (k % 3 != 0).alias("chosen"))
    return timeline.visible_tiles(placed, _MATRIX, 48).select("ordinal", *[F.round(c, 6).alias(c) for c in ("tile_x", "tile_y", "size", "depth")])


@query("companion_sidecars", "select l_orderkey as ordinal, min(l_linenumber)::bigint as first from lineitem where l_linenumber % 7 = 2 or l_linenumber % 7 = 6 group by 1")
def _(spark, sf_dir):
    """The first sidecar of each order's files by the order of their names."""
    line = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    n = F.col("l_linenumber") % 7
    listed = line.filter((n == 2) | (n == 6)).select(F.col("l_orderkey").cast("string").alias("folder"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_linenumber").cast("string").alias("source"))
    files = line.select(F.col("l_orderkey").cast("string").alias("folder"), F.col("l_orderkey").cast("string").alias("source")).distinct()
    names = F.array(*[F.lit(f"s{i}") for i in range(1, 8)])
    found = providers.with_sidecar(files, names, "first", listed).filter("first is not null")
    return found.select(F.col("source").cast("bigint").alias("ordinal"), F.col("first").cast("bigint").alias("first"))


_NAME = "'/IMG_' || lpad(cast(o_orderkey as varchar), greatest(6, length(cast(o_orderkey as varchar)))::int, '0') || '.jpg'"


@query("streamed_entries", f"select '/c' || o_custkey || {_NAME} as source, '/out/' || strftime(o_orderdate, '%Y') || {_NAME} as destination from orders")
def _(spark, sf_dir):
    """A listing that arrives twice as a stream is entered once."""
    files = A.files_orders(spark, sf_dir)
    taken = F.col("taken").cast("timestamp_ntz")
    rows = files.select("source", "size", taken.alias("filesystem"), candidates({"exif": (taken, F.lit(None))}).alias("candidates"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("seen"))
    path, plan, state = (scratch(spark, x) for x in ("listing", "streamed", "state"))
    for _ in range(2):
        rows.write.mode("append").parquet(path)
        incremental.append(incremental.new_entries(incremental.listings(spark, path), "/out", "%Y"), plan, state).awaitTermination()
    return spark.read.parquet(plan).select("source", "destination")
