"""Persisted forms: the plan and the journal as JSON lines, overlays and settings as JSON documents. Schemas are fixed; fields that older files lack are null."""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datewright import config as C
from datewright.schema import CANDIDATES, ENTRIES, FLAGS, SKIPPED

PLAN_VERSION = 4
#: Bits of a line's number: of the file, of the megabyte its block begins at, and of the line in its task.
_FILE_BITS, _BLOCK_BITS, _LINE_BITS = 18, 20, 25
_HEADER = "version int, created_at timestamp_ntz, sources array<string>, destination string, folder_pattern string, detect struct<providers:array<string>,strategy:string,weights:map<string,bigint>>"
_ENTRY = ", ".join(x for x in ENTRIES.split(", ") if not x.startswith("ordinal"))
_RECORD = f"kind string, reason string, ordinal bigint, {_HEADER}, {_ENTRY.replace('destination string, ', '', 1)}"
_OPTIONS = {"mode": "PERMISSIVE", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "columnNameOfCorruptRecord": "_broken"}


def default_plan_name(sources: list[str], destination: str | None) -> str:
    """The same name for the same sources and destination."""
    key = "".join(f"{s}\0" for s in sources) + "->" + (destination or "")
    return f"plan-{hashlib.blake2b(key.encode()).hexdigest()[:8]}.jsonl"


@dataclass
class Plan:
    header: dict
    entries: DataFrame
    skipped: DataFrame


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files of a path, in the order in which they were written: those of no run by name, then the runs by number. Hidden ones aren't data."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isFile():
        return [at.toString()]
    root, found, walk = len(fs.makeQualified(at).toString()), [], fs.listFiles(at, True)
    while walk.hasNext():
        name = walk.next().getPath().toString()
        if not re.search(r"/[._][^/]*", name[root:]):
            run = re.match(r"/run-(\d+)/", name[root:])
            found.append((int(run[1]) if run else 0, name))
    return [name for _, name in sorted(found)]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, which orders the lines of all files, and value of every line that isn't blank."""
    files = _files(spark, path)
    if not files:
        return spark.createDataFrame([], "value string, line_no bigint")
    if len(files) >= 1 << _FILE_BITS:
        raise ValueError(f"{path} has more files than can be put in order")
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    rank = spark.createDataFrame(list(enumerate(files)), "rank bigint, file string").select("rank", plain(F.col("file")).alias("file"))
    block = F.least(F.shiftright("_metadata.file_block_start", 20), F.lit((1 << _BLOCK_BITS) - 1))
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _LINE_BITS) - 1))
    name = plain(F.try_url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")))
    rows = spark.read.text(files).select("value", name.alias("file"), block.alias("block"), line.alias("line")).join(F.broadcast(rank), "file")
    number = F.col("rank") * (1 << (_BLOCK_BITS + _LINE_BITS)) + F.col("block") * (1 << _LINE_BITS) + F.col("line")
    return rows.filter(F.btrim("value", F.lit(" \t\r\n")) != "").select("value", number.alias("line_no"))


def read_plan(spark: SparkSession, path: str) -> Plan:
    """ValueError for a malformed line (with its number), a missing header, or a version that is newer than this code. The last header wins."""
    parsed = _lines(spark, path).select("line_no", "value", F.from_json("value", f"{_RECORD}, _broken string", _OPTIONS).alias("r"))
    bad = parsed.filter("r._broken is not null or r.kind is null or r.kind not in ('header', 'entry', 'skipped')")
    if (first := bad.orderBy("line_no").select("value").head()) is not None:
        numbered = spark.read.text(path).rdd.zipWithIndex().filter(lambda x: x[0][0] == first[0]).map(lambda x: x[1] + 1)  # only on the way to the error
        raise ValueError(f"malformed plan, line {numbered.min()}")
    header = parsed.filter("r.kind = 'header'").orderBy(F.desc("line_no")).select("r.*").head()
    if header is None:
        raise ValueError("the plan has no header")
    if header["version"] > PLAN_VERSION:
        raise ValueError(f"unsupported plan version {header['version']}")
    fields = [x.split(" ")[0] for x in _ENTRY.split(", ")]
    entries = parsed.filter("r.kind = 'entry'").select(*[F.col(f"r.{c}").alias(c) for c in fields], F.coalesce("r.ordinal", "line_no").alias("ordinal"))
    entries = entries.withColumns({"candidates": F.coalesce("candidates", F.array().cast(CANDIDATES)), "flags": F.coalesce("flags", F.array().cast(FLAGS)), "tags": F.coalesce("tags", F.array().cast("array<string>")), "rotate": F.coalesce("rotate", F.lit("none")), "reencode": F.coalesce("reencode", F.lit(False)), "orientation": F.coalesce("orientation", F.lit(1))})
    skipped = parsed.filter("r.kind = 'skipped'").select(*[F.col(f"r.{x.split(' ')[0]}") for x in SKIPPED.split(", ")])
    return Plan({k: header[k] for k in ("version", "created_at", "sources", "destination", "folder_pattern", "detect")}, entries, skipped)


def _fs(spark: SparkSession, *paths: str) -> tuple:
    found = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return found[0].getFileSystem(spark._jsc.hadoopConfiguration()), *found


def _renamed(fs, a, b) -> None:
    if not fs.rename(a, b):
        raise OSError(f"can't rename {a.toString()} to {b.toString()}")


def _recover(spark: SparkSession, path: str) -> None:
    """What a swap that was cut short left: the new folder if it is whole, else the old one."""
    fs, at, new, old = _fs(spark, path, path + ".new", path + ".old")
    if not fs.exists(at):
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path + ".new/_SUCCESS")) and fs.exists(old):
            _renamed(fs, new, at)
        elif fs.exists(old):
            _renamed(fs, old, at)
    if fs.exists(at):
        fs.delete(old, True)


def _swap(spark: SparkSession, path: str) -> None:
    """Puts path.new in the place of path. At every moment the old or the new folder is there in whole, and _recover() finds it."""
    fs, at, new, old = _fs(spark, path, path + ".new", path + ".old")
    if fs.exists(at):
        fs.delete(old, True)
        _renamed(fs, at, old)
    _renamed(fs, new, at)
    fs.delete(old, True)


def plain_header(header: dict) -> dict:
    """A header as JSON has it."""
    plain = lambda v: v.asDict(recursive=True) if hasattr(v, "asDict") else v.isoformat() if isinstance(v, datetime) else v
    return {k: plain(v) for k, v in header.items()}


def _plan_lines(kind: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *rows.columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("value"))


def write_plan(header: dict, entries: DataFrame, skipped: DataFrame, path: str) -> None:
    """A folder of JSON lines that read_plan() takes. It is written beside the old one, which entries may still be read from, and then put in its place; each entry bears its ordinal."""
    spark = entries.sparkSession
    head = spark.createDataFrame([json.dumps({"kind": "header", "version": PLAN_VERSION, **plain_header(header)})], "string").toDF("value")
    head.unionByName(_plan_lines("entry", entries)).unionByName(_plan_lines("skipped", skipped)).write.mode("overwrite").text(path + ".new")
    _swap(spark, path)


def retarget_plan(spark: SparkSession, path: str, root: str | None, journal: str | None = None) -> bool:
    """Gives a written plan another destination; the journal of copies to the old one goes. False, and nothing is done, if it has that destination already."""
    from datewright.operators.overlay import retarget

    plan = read_plan(spark, path)
    if plan.header["destination"] == root:
        return False
    write_plan({**plan.header, "version": PLAN_VERSION, "destination": root}, retarget(plan.entries, root or "", plan.header["folder_pattern"]), plan.skipped, path)
    if journal is not None:
        fs, at = _fs(spark, journal)
        fs.delete(at, True)
    return True


def scan_on(spark: SparkSession, path: str, header: dict, files: DataFrame) -> tuple[DataFrame, Plan | None]:
    """The files that a scan has still to look at, and the plan that it goes on with: none if there is none, or if its options are others, and then all files are to be looked at."""
    if not _exists(spark, path):
        return files, None
    plan = read_plan(spark, path)
    if not resumable(plain_header(plan.header), plain_header(header)):
        return files, None
    known = plan.entries.select("source").unionByName(plan.skipped.select("source"))
    return files.join(known, "source", "left_anti"), plan


def append_plan(plan: Plan, entries: DataFrame, skipped: DataFrame, path: str) -> None:
    """Adds what scan_on() left to look at; entries' ordinals, from 0, go on after the plan's."""
    last = plan.entries.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("n")).head()["n"]
    lines = _plan_lines("entry", entries.withColumn("ordinal", F.col("ordinal") + last + 1)).unionByName(_plan_lines("skipped", skipped))
    lines.write.mode("append").text(path)


def resumable(old: dict, new: dict) -> bool:
    """Whether a scan can go on with an old plan: the same sources, destination, pattern and options of detection."""
    return all(old.get(k) == new.get(k) for k in ("sources", "destination", "folder_pattern", "detect"))


_JOURNAL = "source string, status string, destination string, error string, written struct<size:bigint,hash:string>"


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """line_no and the records; a missing journal is empty, and malformed lines are passed over. transfer.latest() gives the last of each source."""
    schema = f"line_no bigint, {_JOURNAL}"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = _lines(spark, path).select(F.col("line_no"), F.from_json("value", f"{_JOURNAL}, _broken string", _OPTIONS).alias("r"))
    return rows.filter("r._broken is null and r.source is not null and r.status is not null").select("line_no", *[f"r.{c.split(' ')[0]}" for c in ("source", "status", "destination", "error", "written")])


def append_journal(rows: DataFrame, path: str) -> None:
    """Adds a run's records (source, status, destination, error, written) to a journal folder. Runs are numbered, so the last record of a source is the last run's however many files a run has."""
    spark = rows.sparkSession
    fs, at = _fs(spark, path)
    runs = [int(m[1]) for x in (fs.listStatus(at) if fs.exists(at) else []) if (m := re.fullmatch(r"run-(\d+)", x.getPath().getName()))]
    rows.select(F.to_json(F.struct("source", "status", "destination", "error", "written")).alias("value")).write.text(f"{path}/run-{max(runs, default=0) + 1:06d}")


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def _document(spark: SparkSession, path: str) -> str:
    if not _exists(spark, path):
        return ""
    rows = spark.read.text(path, wholetext=True).select(F.btrim(F.regexp_replace("value", "^﻿", ""), F.lit(" \t\r\n")).alias("v")).collect()  # one document
    return rows[0]["v"] if rows else ""


def _overlay(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """A JSON object keyed by source; blank and missing are empty, and damage is a ValueError."""
    text = _document(spark, path)
    if text and not isinstance(json.loads(text), dict):
        raise ValueError(f"{path} isn't an object")
    rows = spark.createDataFrame([(text or "{}",)], "v string").select(F.explode(F.from_json("v", f"map<string,{schema}>", _OPTIONS)).alias("source", "o"))
    return rows.select("source", *[F.col(f"o.{c}") for c in columns])


def read_dates(spark: SparkSession, path: str) -> DataFrame:
    return _overlay(spark, path, "struct<taken:timestamp_ntz,origin:string,provider:string,seconds:bigint,at:timestamp_ntz>", ["taken", "origin", "provider", "seconds", "at"])


def read_rotations(spark: SparkSession, path: str) -> DataFrame:
    return _overlay(spark, path, "struct<rotate:string,reencode:boolean,at:timestamp_ntz>", ["rotate", "reencode", "at"])


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    text = _document(spark, path)
    if text and not isinstance(json.loads(text), list):
        raise ValueError(f"{path} isn't a list")
    return spark.createDataFrame([(text or "[]",)], "v string").select(F.explode(F.from_json("v", "array<string>")).alias("source")).distinct()


def describe_origin(origin, provider, seconds):
    from datewright.functions.scalars import humanise_shift

    return F.when(origin == "candidate", F.concat(F.lit("taken from "), provider)).when(origin == "manual", "set by hand").when(origin == "shift", F.concat(F.lit("shifted by "), humanise_shift(seconds)))


# The tag store: a table of sightings; what a source wears is derived by exploding its tags

_SIGHTING = "source string, tags array<string>, vector array<float>, quality float"


def open_store(spark: SparkSession, path: str, legacy: str | None = None) -> DataFrame:
    """An empty store where there is none yet; then a legacy JSON sidecar (source to tags) is taken in once and set aside. A store whose replacement was cut short is found again."""
    _recover(spark, path)
    if not _exists(spark, path):
        spark.createDataFrame([], _SIGHTING).write.parquet(path)
    store = spark.read.schema(_SIGHTING).parquet(path)
    if legacy and os.path.exists(legacy) and store.isEmpty():
        rows = _overlay(spark, legacy, "struct<tags:array<string>,vector:array<float>,quality:float>", ["tags", "vector", "quality"])
        rows.write.mode("append").parquet(path)
        os.replace(legacy, legacy + ".imported")
        store = spark.read.schema(_SIGHTING).parquet(path)
    return store


def replace_store(store: DataFrame, path: str) -> None:
    """Writes beside the store, then swaps: store may read from path."""
    store.write.mode("overwrite").parquet(path + ".new")
    _swap(store.sparkSession, path)


@dataclass
class Settings:
    """What a user keeps between runs; unreadable settings are the defaults."""

    strategy: str = "smart"
    providers: list[str] = field(default_factory=lambda: list(C.PROVIDERS))
    weights: dict[str, int] = field(default_factory=dict)
    folder_pattern: str = "%Y/%m"

    @staticmethod
    def load(path: str) -> Settings:
        try:
            with open(path, encoding="utf-8-sig") as f:
                return Settings(**{k: v for k, v in json.load(f).items() if k in Settings.__dataclass_fields__})
        except (OSError, ValueError, TypeError, AttributeError):
            return Settings()

    def save(self, path: str) -> None:
        self.weights = {k: max(C.MIN_WEIGHT, min(C.MAX_WEIGHT, v)) for k, v in self.weights.items()}
        with open(path + ".new", "w", encoding="utf-8") as f:
            json.dump(asdict(self), f)
        os.replace(path + ".new", path)
