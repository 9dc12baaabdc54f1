"""Scalar expressions on paths, times, sizes and bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds of a wall clock; the session's zone is UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def epoch(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def whole(a: Column, b: Column, unit_us: int) -> Column:
    """a - b in whole units, truncated towards zero."""
    us = micros(a) - micros(b)
    return F.when(us < 0, -F.floor(-us / unit_us)).otherwise(F.floor(us / unit_us)).cast("bigint")


def days_between(a: Column, b: Column) -> Column:
    return whole(a, b, DAY_US)


def hours_between(a: Column, b: Column) -> Column:
    return whole(a, b, HOUR_US)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """The name without its last extension; a leading dot begins a name, not an extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(file_name(path)), r"\.([^.]*)$", 1)


def counter(path: Column) -> Column:
    """The camera counter: at least three digits at the end of the stem, below 2 ** 64."""
    digits = F.regexp_extract(stem(path), r"([0-9]{3,})$", 1)
    n = digits.try_cast("decimal(38,0)")
    return F.when((digits != "") & (n < F.lit("18446744073709551616").cast("decimal(38,0)")), n.cast("decimal(20,0)"))


# Media extensions by kind.
PICTURE = "jpg jpeg jpe png webp tif tiff bmp gif avif heic heif hif dng cr2 cr3 nef arw orf rw2 raf pef".split()
VIDEO = "mp4 mov m4v avi mkv webm 3gp 3g2 mts m2ts wmv f4v mj2".split()
AUDIO = "m4a m4b wav mp3 aac flac".split()
SIDECAR = "xmp aae json thm lrv".split()


def media_kind(ext: Column) -> Column:
    """4 picture, 3 video, 2 audio, 1 sidecar, 0 other."""
    return F.when(ext.isin(PICTURE), 4).when(ext.isin(VIDEO), 3).when(ext.isin(AUDIO), 2).when(ext.isin(SIDECAR), 1).otherwise(0)


# What can be shown, by extension, and how much of it.
HASHABLE = "jpg jpeg jpe png webp tif tiff bmp gif avif heic heif hif".split()
IS_PICTURE = "jpg jpeg jpe png webp bmp tif tiff gif heic heif hif".split()
MIMES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "jpe": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml", "avif": "image/avif", "ico": "image/x-icon",
    "mp4": "video/mp4", "m4v": "video/mp4", "f4v": "video/mp4", "mov": "video/quicktime", "qt": "video/quicktime", "3gp": "video/3gpp", "3g2": "video/3gpp2", "mj2": "video/mj2", "m4a": "audio/mp4", "m4b": "audio/mp4", "m4p": "audio/mp4",
}
DECODED = "tif tiff heic heif hif".split()
TEXTS = "txt md markdown log csv tsv json jsonl xml yml yaml toml ini cfg conf rs py js ts svelte html css sh bat ps1 sql srt vtt".split()
MAX_IMAGE_BYTES = 16 * 1024 * 1024


def preview_class(ext: Column, size: Column) -> Column:
    """image, decode, video, audio, pdf, text, binary; missing where there is no size."""
    mime = F.create_map(*[F.lit(x) for kv in MIMES.items() for x in kv])[ext]
    kind = F.split(mime, "/")[0]
    small = size <= MAX_IMAGE_BYTES
    return (
        F.when(size.isNull(), "missing")
        .when((kind == "image") | ext.isin(DECODED), F.when(small, F.when(kind == "image", "image").otherwise("decode")).otherwise("binary"))
        .when(kind.isNotNull(), kind)
        .when(ext == "pdf", "pdf")
        .when(ext.isin(TEXTS), "text")
        .otherwise("binary")
    )


def group_stem(path: Column) -> Column:
    """What companions share within their folder; null without an extension. Sidecars lose two extensions."""
    name = F.lower(file_name(path))
    head, ext = F.regexp_extract(name, r"(?s)^(.*)\.[^.]*$", 1), F.regexp_extract(name, r"\.([^.]*)$", 1)
    return F.when(name.contains("."), F.when(ext.isin(SIDECAR) & head.contains("."), F.regexp_extract(head, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(head))


def folder_segment(subject: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.btrim(subject)), r"[^\p{IsAlphabetic}\p{N}-]", " ")
    joined = F.btrim(F.regexp_replace(F.btrim(plain), r" +", "-"), F.lit("-."))
    return F.when(joined == "", F.lit("unsorted")).otherwise(F.left(joined, F.lit(48)))


def duplicate_variant(path: Column, index: Column) -> Column:
    name, head = file_name(path), F.regexp_extract(path, r"(?s)^(.*/)[^/]*$", 1)
    ext = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)
    return F.concat(head, stem(path), F.lit("_dup_"), index.cast("string"), ext)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def human_bytes(size: Column) -> Column:
    """1024 steps to TB, two decimals beyond bytes."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**i, F.format_string(f"%.2f {unit}", size.cast("double") / 1024**i)).otherwise(out)
    return out


def format_bytes(size: Column) -> Column:
    """1024 steps to TB, one decimal below 10 and none beyond."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        value = size.cast("double") / 1024**i
        out = F.when(size >= 1024**i, F.when(value < 10, F.format_string(f"%.1f {unit}", value)).otherwise(F.format_string(f"%.0f {unit}", value))).otherwise(out)
    return out


def hashable(ext: Column) -> Column:
    """Whether a file's picture can be fingerprinted."""
    return ext.isin(HASHABLE)


def is_picture(ext: Column) -> Column:
    """Whether a file goes to the picture models."""
    return ext.isin(IS_PICTURE)


def humanise_shift(seconds: Column) -> Column:
    """Signed days, hours and minutes."""
    n = F.abs(seconds)
    part = lambda unit, most: (F.floor(n / unit) if most is None else F.floor(n / unit) % most).cast("bigint")
    return F.format_string("%s%dd %dh %dm", F.when(seconds < 0, "-").otherwise("+"), part(86400, None), part(3600, 24), part(60, 60))


def label_of(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^(?:a|an|the) ", "")


def numeric_key(text: Column) -> Column:
    """Orders digits by value: each run of digits padded to 20 places."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(\d+)", "00000000000000000000$1"), r"0*(\d{20})(?!\d)", "$1")


def heat_step(count: Column, most: Column) -> Column:
    """One of seven steps by the share of logarithms; null where empty."""
    return F.when((count > 0) & (most > 0), F.least(F.lit(6), F.floor(F.log1p(count) / F.log1p(most) * 7)).cast("int"))


# Turning pictures: a transform is quarter turns to the right after an optional mirror.
TRANSFORMS = {"none": (0, 0), "rot90": (1, 0), "rot180": (2, 0), "rot270": (3, 0), "flip_h": (0, 1), "flip_v": (2, 1), "transpose": (3, 1), "transverse": (1, 1)}
#: The transform that sets each EXIF orientation upright.
ORIENTATION = {1: "none", 2: "flip_h", 3: "rot180", 4: "flip_v", 5: "transpose", 6: "rot90", 7: "transverse", 8: "rot270"}


def for_orientation(orientation: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ORIENTATION.items() for x in kv]), orientation), F.lit("none"))


def turn(transform: Column, quarters: Column) -> Column:
    """The transform followed by quarter turns to the right."""
    of = F.create_map(*[x for k, (q, m) in TRANSFORMS.items() for x in (F.lit(k), F.lit(q + 4 * m))])
    back = F.create_map(*[x for k, (q, m) in TRANSFORMS.items() for x in (F.lit(q + 4 * m), F.lit(k))])
    code = F.element_at(of, transform)
    return F.element_at(back, (F.pmod(code % 4 + quarters, F.lit(4)) + F.floor(code / 4) * 4).cast("int"))
