"""File tables made of the star-schema tables, in Spark and as DuckDB common table expressions, so that every operator can run on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datewright.operators.resolve import candidates

ROOT, PATTERN = "/archive", "%Y/%m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(number: Column, width: int) -> Column:
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def ship_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order: its first shipping dates by line, its last of all."""
    line = lambda n: F.min(F.when(F.col("l_linenumber") == n, F.col("l_shipdate")))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ordinal")).agg(line(1).alias("media"), line(2).alias("xmp"), line(3).alias("takeout"), F.max("l_shipdate").alias("filesystem"))


def files_orders(spark: SparkSession, sf_dir: str, folder: str = "customer", lines: tuple[str, ...] = ("filesystem",)) -> DataFrame:
    """ordinal, source, folder, taken, provider, size, filesystem: an order is a picture in its customer's (or priority's) folder. lines: columns of ship_dates()."""
    o = table(spark, sf_dir, "orders")
    where = F.concat(F.lit("/c"), F.col("o_custkey").cast("string")) if folder == "customer" else F.concat(F.lit("/"), F.col("o_orderpriority"))
    files = o.select(
        F.col("o_orderkey").alias("ordinal"),
        F.concat(where, F.lit("/IMG_"), padded(F.col("o_orderkey"), 6), F.lit(".jpg")).alias("source"),
        where.alias("folder"),
        F.col("o_orderdate").alias("taken"),
        F.lit("exif").alias("provider"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("size"),
    )
    return files.join(ship_dates(spark, sf_dir).select("ordinal", *lines), "ordinal", "left")


def detections_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files_orders' files with candidates: exif from the order, media, xmp, takeout and filesystem from its lines. Each table is read once."""
    dates = files_orders(spark, sf_dir, lines=("media", "xmp", "takeout", "filesystem"))
    none = F.lit(None).cast("string")
    found = candidates({p: (F.col("taken" if p == "exif" else p), none) for p in ("exif", "media", "xmp", "takeout", "filesystem")})
    return dates.select("ordinal", "source", "folder", "size", "filesystem", found.alias("candidates"))


def files_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("ordinal"),
        F.concat(F.lit("/u"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("source"),
        F.concat(F.lit("/u"), F.col("user_id").cast("string")).alias("folder"),
        F.col("ts").alias("taken"),
        F.lit("exif").alias("provider"),
        (F.col("ts") + F.make_dt_interval(days=F.floor(F.col("value") * 6).cast("int"))).cast("timestamp_ntz").alias("filesystem"),
    )


def files_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("bigint")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))
    return e.select(
        F.col("event_id").alias("ordinal"),
        F.concat(F.lit("/"), F.col("event_type"), F.lit("/"), padded(F.col("event_id"), 9)).alias("source"),
        F.concat(F.lit("/"), F.col("event_type")).alias("folder"),
        F.timestamp_seconds(F.unix_seconds(start.cast("timestamp")) + F.floor(seconds / 60)).cast("timestamp_ntz").alias("taken"),
        cents.alias("size"),
        (cents * 65536 + cents).alias("hash"),
    )


#: Providers of view_events by event_id % 7, in this order.
VIEW_PROVIDERS = ("filename", "exif", "media", "xmp", "takeout", "system", "filesystem")


def view_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, source, folder, taken, taken_epoch, provider, size, confidence, override_origin, flags (by event_id)."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    hard = F.expr("array(named_struct('flag', 'future_date'))")
    return e.select(
        n.alias("ordinal"),
        F.concat(F.lit("/"), F.col("event_type"), F.lit("/"), n.cast("string")).alias("source"),
        F.col("event_type").alias("folder"),
        F.col("ts").alias("taken"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("taken_epoch"),
        F.element_at(F.array(*[F.lit(p) for p in VIEW_PROVIDERS]), (n % 7 + 1).cast("int")).alias("provider"),
        F.round(F.col("value") * 100).cast("bigint").alias("size"),
        F.when(n % 3 == 0, "high").otherwise("medium").alias("confidence"),
        F.when(n % 11 == 0, "manual").alias("override_origin"),
        F.when(n % 5 == 0, hard).otherwise(F.slice(hard, 1, 0)).alias("flags"),
    )


def names_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, text: six shapes of names with a date."""
    e = table(spark, sf_dir, "events")
    at = lambda f: F.date_format("ts", f)
    shapes = [
        F.concat(F.lit("IMG_"), at("yyyyMMdd"), F.lit("_"), at("HHmmss"), F.lit(".jpg")),
        F.concat(at("yyyyMMddHHmmss"), F.lit(".jpg")),
        F.concat(F.lit("Rechnung "), at("dd.MM.yyyy"), F.lit(".pdf")),
        F.concat(at("yyyy:MM:dd"), F.lit(" "), at("HH:mm:ss")),
        F.concat(F.lit("scan_"), at("yyyy-MM-dd"), F.lit("_a.png")),
        F.concat(F.lit("x99"), at("yyyyMMdd"), F.lit(".bin")),
    ]
    return e.select(F.col("event_id").alias("ordinal"), F.element_at(F.array(*shapes), (F.col("event_id") % 6 + 1).cast("int")).alias("text"))


EXTENSIONS = ("jpg", "mov", "xmp", "mp3", "dat", "cr2", "json")


def companions_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an order share a stem; the extension comes of the line. One row an order and line."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("taken"))
    ext = F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (F.col("l_linenumber") % 7 + 1).cast("int"))
    provider = F.element_at(F.array(F.lit("exif"), F.lit("xmp"), F.lit("filesystem")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.concat(F.lit("/o/F"), F.col("l_orderkey").cast("string"), F.lit("."), ext).alias("source"), "taken", provider.alias("provider"), F.concat(F.lit("own "), ext).alias("provider_info")
    )


def dups_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("/d/"), padded(F.col("doc_id"), 9)).alias("source"), F.col("n_chars").alias("size"), F.md5("text").alias("hash"), F.concat(F.lit("/copy/"), F.col("source"), F.lit(".txt")).alias("destination"), F.col("doc_id"))


def tags_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.select("doc_id", "lang", F.col("source").alias("origin"), "n_chars").join(labels, "doc_id", "left")
    tags = F.array_compact(F.array(F.when(F.col("doc_id") % 10 != 0, F.col("lang")), F.when(F.col("doc_id") % 10 != 0, F.concat(F.lit("a "), F.col("origin"))), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 1, "good")))
    return rows.select(F.concat(F.lit("/d/"), padded(F.col("doc_id"), 9)).alias("source"), tags.alias("tags"), (F.col("n_chars") / 1000.0).alias("quality"), F.col("doc_id").alias("ordinal"))


def folders_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"/[^/]*$", "")
    return p.groupBy(path.alias("path")).agg(F.count("*").alias("files"), F.sum(F.length("html")).cast("bigint").alias("bytes"))


# The same in DuckDB

SHIP = "ship as (select l_orderkey as ordinal, min(l_shipdate) filter (l_linenumber = 1) as media, min(l_shipdate) filter (l_linenumber = 2) as xmp, min(l_shipdate) filter (l_linenumber = 3) as takeout, max(l_shipdate) as filesystem from lineitem group by 1)"
SQL = {
    "ship": SHIP,
    "files": SHIP + """,
files as (select o_orderkey as ordinal, '/c' || o_custkey || '/IMG_' || lpad(cast(o_orderkey as varchar), greatest(6, length(cast(o_orderkey as varchar)))::int, '0') || '.jpg' as source, '/c' || o_custkey as folder,
  o_orderdate as taken, 'exif' as provider, cast(round(o_totalprice * 100) as bigint) as size, s.filesystem, cast(o_orderkey as bigint) as counter from orders o left join ship s on s.ordinal = o.o_orderkey)""",
    "det": SHIP + """,
det as (
  select o_orderkey as ordinal, 'exif' as provider, 1 as rank, 40 as weight, o_orderdate as taken from orders
  union all select ordinal, 'media', 2, 40, media from ship where media is not null and ordinal in (select o_orderkey from orders)
  union all select ordinal, 'xmp', 3, 42, xmp from ship where xmp is not null and ordinal in (select o_orderkey from orders)
  union all select ordinal, 'takeout', 4, 38, takeout from ship where takeout is not null and ordinal in (select o_orderkey from orders)
  union all select ordinal, 'filesystem', 6, 10, filesystem from ship where filesystem is not null and ordinal in (select o_orderkey from orders))""",
    "reset": "files as (select event_id as ordinal, '/u' || user_id as folder, ts as taken, ts + to_days(cast(floor(value * 6) as integer)) as filesystem from events)",
    "events": """files as (select event_id as ordinal, '/' || event_type as folder, '/' || event_type || '/' || lpad(cast(event_id as varchar), 9, '0') as source,
  timestamp '2024-01-01' + to_seconds((cast(floor(epoch(ts)) as bigint) - 1704067200) // 60) as taken, cast(round(value * 100) as bigint) as size, cast(round(value * 100) as bigint) * 65536 + cast(round(value * 100) as bigint) as hash from events)""",
    "view": """view_ as (select event_id as ordinal, '/' || event_type || '/' || event_id as source, event_type as folder, ts as taken, cast(floor(epoch(ts)) as bigint) as taken_epoch,
  (['filename', 'exif', 'media', 'xmp', 'takeout', 'system', 'filesystem'])[event_id % 7 + 1] as provider, cast(round(value * 100) as bigint) as size, case when event_id % 3 = 0 then 'high' else 'medium' end as confidence, event_id % 11 = 0 as decided, event_id % 5 = 0 as hard from events)""",
    "dups": "dups as (select '/d/' || lpad(cast(doc_id as varchar), 9, '0') as source, n_chars as size, md5(text) as hash, '/copy/' || source || '.txt' as destination, doc_id from documents)",
    "tags": """sight as (select '/d/' || lpad(cast(d.doc_id as varchar), 9, '0') as source, d.doc_id as ordinal, n_chars / 1000.0::double as quality,
  list_filter([case when d.doc_id % 10 <> 0 then lang end, case when d.doc_id % 10 <> 0 then 'a ' || d.source end, case when toxic = 1 then 'toxic' end, case when quality = 1 then 'good' end], lambda x: x is not null) as tags from documents d left join labels l on l.doc_id = d.doc_id)""",
    "pages": "folders as (select regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/[^/]*$', '') as path, count(*) as files, sum(length(html))::bigint as bytes from pages group by 1)",
}
