"""Candidate dates of scanned files: names, EXIF, sidecars, the file system. What opens files runs in Arrow batches; the choices are expressions and joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datewright.config import PROVIDERS
from datewright.functions.dateparse import parse_date, parse_xmp_date, takeout_taken
from datewright.functions.scalars import micros, stem
from datewright.operators.resolve import candidates
from datewright.sources import exif
from datewright.sources.listing import filesystem_latest, filesystem_time

# Names of sidecars, and marks of edited copies in the languages that exports have.
SUPPLEMENT, NAME_BYTES = "supplemental-metadata", 51
EDITED = ("-edited", "-bearbeitet", "-modifié", "-editado", "-bewerkt", "-redigerad")
XMP_FIELDS = ("exif:DateTimeOriginal", "photoshop:DateCreated", "xmp:CreateDate", "xmp:ModifyDate")
ECHO_SECONDS = 2


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("text", T.StringType())])))
def _exif_dates(paths: pd.Series) -> pd.Series:
    def one(path: str) -> list[dict]:
        try:
            with open(path, "rb") as f:
                return [{"name": n, "text": t} for n, t in exif.dates(f.read())]
        except OSError:
            return []

    return paths.map(one)


@F.pandas_udf(T.IntegerType())
def read_orientation(paths: pd.Series) -> pd.Series:
    def one(path: str) -> int:
        try:
            with open(path, "rb") as f:
                return exif.orientation(f.read())
        except OSError:
            return 1

    return paths.map(one)


def exif_candidate(path: Column, ext: Column) -> Column:
    """taken and info of the first date tag that reads as a date."""
    found = F.transform(F.when(ext.isin(exif.EXTENSIONS), _exif_dates(path)), lambda d: F.struct(parse_date(d["text"]).alias("taken"), d["name"].alias("info")))
    return F.get(F.filter(found, lambda d: d["taken"].isNotNull()), F.lit(0))


@F.pandas_udf(T.StringType())
def _read_text(paths: pd.Series) -> pd.Series:
    def one(path: str | None) -> str | None:
        try:
            with open(path, encoding="utf-8") as f:
                return f.read()
        except (OSError, UnicodeDecodeError, TypeError):
            return None

    return paths.map(one)


def xmp_names(name: Column) -> Column:
    """The sidecars of a name, in the order in which they count."""
    return F.array(F.concat(name, F.lit(".xmp")), F.concat(name, F.lit(".XMP")), F.concat(stem(name), F.lit(".xmp")), F.concat(stem(name), F.lit(".XMP")))


def _cut_bytes(name: Column) -> Column:
    """At most NAME_BYTES bytes before and with `.json`, cut between characters."""
    head = F.regexp_replace(name, r"\.json$", "")
    most = NAME_BYTES - len(".json")
    sized = F.transform(F.sequence(F.lit(0), F.least(F.length(head), F.lit(most))), lambda n: F.struct(n.alias("n"), F.octet_length(F.left(head, n)).alias("bytes")))
    fits = F.array_max(F.transform(F.filter(sized, lambda x: x["bytes"] <= most), lambda x: x["n"]))
    return F.when(F.octet_length(name) <= NAME_BYTES, name).otherwise(F.concat(F.left(head, fits), F.lit(".json")))


def takeout_names(name: Column) -> Column:
    """The export's sidecars of a name, in the order in which they count: numbered copies, plain, supplemental; then those of the picture that an edited one comes from."""
    def of(n: Column) -> list[Column]:
        head, copy, ext = (F.regexp_extract(n, r"^([^(]*)\(([0-9]+)\)\.([^)]*)$", i) for i in (1, 2, 3))
        numbered = F.when(copy != "", F.concat(head, F.lit("."), ext, F.lit("("), copy, F.lit(").json")))
        return [numbered, F.concat(n, F.lit(".json")), _cut_bytes(F.concat(n, F.lit(f".{SUPPLEMENT}.json")))]

    plain = F.regexp_extract(name, f"^(.*)(?:{'|'.join(EDITED)})(\\.[^.]*)$", 1)
    original = F.when(plain != "", F.concat(plain, F.regexp_extract(name, r"(\.[^.]*)$", 1)))
    return F.array_compact(F.array(*of(name), *of(original)))


def with_sidecar(files: DataFrame, names: Column, column: str, listed: DataFrame | None = None) -> DataFrame:
    """Adds the path of the first of names that lies in the file's folder. An equi-join on folder and name; listed: the folder, name and source of all files there."""
    listed = listed if listed is not None else files
    there = listed.select("folder", F.col("name").alias("__name"), F.col("source").alias("__path")).dropDuplicates(["folder", "__name"])
    wanted = files.select("source", "folder", F.posexplode(names).alias("__pos", "__name"))
    best = wanted.join(there, ["folder", "__name"]).groupBy("source").agg(F.min_by("__path", "__pos").alias(column))
    return files.join(best, "source", "left")


def xmp_candidate(text: Column) -> Column:
    """taken and info (the field) of the first field, as attribute or element, that reads as a date."""
    fields = []
    for field in XMP_FIELDS:
        pattern = rf'(?is){field}\s*=\s*"([^"]+)"|<{field}>([^<]+)</{field}>'
        value = F.btrim(F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.regexp_extract(text, pattern, 2)))
        taken = parse_xmp_date(value)
        fields.append(F.when(taken.isNotNull(), F.struct(taken.alias("taken"), F.lit(field).alias("info"))))
    return F.coalesce(*fields)


def echoes_file(taken: Column, created: Column, modified: Column) -> Column:
    near = [F.coalesce(F.abs(micros(t) - micros(taken)) < (ECHO_SECONDS + 1) * 1_000_000, F.lit(False)) for t in (created, modified)]
    return near[0] | near[1]


def detect(files: DataFrame, providers: tuple[str, ...] = PROVIDERS, media=None) -> DataFrame:
    """Adds candidates and filesystem (the last write) to files of listing.scan(). A column `system` (a time that an operating system told) counts if it doesn't echo the file's own times.

    media: a pandas UDF from path to taken for containers of videos; without it they have no candidate of that kind.
    """
    none = F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("string")
    rows = files
    found: dict[str, tuple[Column, Column]] = {}
    if "filename" in providers:
        found["filename"] = parse_date(F.col("name")), F.col("name")
    if "exif" in providers:
        rows = rows.withColumn("__exif", exif_candidate(F.col("source"), F.col("ext")))
        found["exif"] = F.col("__exif.taken"), F.col("__exif.info")
    if "media" in providers:
        found["media"] = (media(F.col("source")), F.lit(None)) if media is not None else none
    if "xmp" in providers:
        rows = with_sidecar(rows, xmp_names(F.col("name")), "__xmp", files).withColumn("__x", xmp_candidate(_read_text(F.col("__xmp"))))
        found["xmp"] = F.col("__x.taken"), F.concat(F.col("__x.info"), F.lit(" in "), F.element_at(F.split("__xmp", "/"), -1))
    if "takeout" in providers:
        rows = with_sidecar(rows, takeout_names(F.col("name")), "__takeout", files).withColumn("__t", takeout_taken(_read_text(F.col("__takeout"))))
        found["takeout"] = F.col("__t"), F.element_at(F.split("__takeout", "/"), -1)
    if "system" in providers:
        if "system" in files.columns:
            found["system"] = F.when(~echoes_file(F.col("system"), F.col("created"), F.col("modified")), F.col("system")), F.lit(None).cast("string")
        else:
            found["system"] = none
    if "filesystem" in providers:
        own = filesystem_time(F.col("created"), F.col("modified"))
        found["filesystem"] = own["taken"], own["info"]
    rows = rows.withColumn("candidates", candidates(found)).withColumn("filesystem", filesystem_latest(F.col("created"), F.col("modified")))
    return rows.select(*files.columns, "candidates", "filesystem")


def stamped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas function: content (bytes) with taken stamped in; null where there is nothing to stamp."""
    for frame in batches:
        frame["content"] = [exif.stamp(c, t.to_pydatetime()) if c is not None and t is not None else None for c, t in zip(frame["content"], frame["taken"], strict=True)]
        yield frame
