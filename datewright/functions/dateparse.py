"""Dates in file names and sidecar texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_YEAR, MAX_YEAR = 1970, 2100

# The formats that dates in names have, tried in this order.
_Y, _MO, _D = r"(?:19|20)\d{2}", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
_T = (r"(?:[01]\d|2[0-3])", r"[0-5]\d", r"[0-5]\d")
_LEFT, _RIGHT, _SEP = r"(?:\A|\D)", r"(?:\D|\z)", r"[-:._]"
FORMATS = (
    (_Y + _SEP + _MO + _SEP + _D + r"\D{1,6}" + _SEP.join(_T), False),
    (_LEFT + _Y + _MO + _D + "[-_.]" + "".join(_T) + _RIGHT, False),
    (_LEFT + _Y + _MO + _D + "".join(_T) + _RIGHT, False),
    (_LEFT + _Y + _SEP + _MO + _SEP + _D + _RIGHT, False),
    (_LEFT + _D + "[-.]" + _MO + "[-.]" + _Y + _RIGHT, True),
    (_LEFT + _Y + _MO + _D + _RIGHT, False),
)


def _built(match: Column, day_first: bool) -> Column:
    """A match's digits, in their fixed places, as a time; null if no calendar has it."""
    digits = F.regexp_replace(match, r"(?U)\D", "")
    at = lambda a, n: F.coalesce(F.substring(digits, a, n).try_cast("int"), F.lit(0))
    year, month, day = (at(5, 4), at(3, 2), at(1, 2)) if day_first else (at(1, 4), at(5, 2), at(7, 2))
    time = (F.lit(0),) * 3 if day_first else (at(9, 2), at(11, 2), at(13, 2))
    return F.when((year >= MIN_YEAR) & (year <= MAX_YEAR), F.try_make_timestamp_ntz(year, month, day, *time))


def parse_date(text: Column) -> Column:
    """The first calendar-valid match of the first format that has one; without a time, midnight."""
    def found(pattern: str, day_first: bool) -> Column:
        times = F.transform(F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0)), lambda m: _built(m, day_first))
        return F.get(F.filter(times, lambda t: t.isNotNull()), F.lit(0))

    return F.coalesce(*[found(*f) for f in FORMATS])


def parse_xmp_date(text: Column) -> Column:
    """ISO date and time, its offset dropped and its wall clock kept; or a date, at midnight."""
    plain = F.regexp_replace(F.btrim(text), r"(?:Z|z|[+-]\d{2}:?\d{2})$", "")
    plain = F.when(F.btrim(text).rlike("T|t| "), plain).otherwise(F.btrim(text))
    forms = [F.try_to_timestamp(plain, F.lit(f)).cast("timestamp_ntz") for f in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd")]
    return F.coalesce(*forms)


def parse_manual(text: Column) -> Column:
    """What a user types."""
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(F.btrim(text), F.lit(f)).cast("timestamp_ntz") for f in forms])


def takeout_taken(json: Column) -> Column:
    """photoTakenTime, else creationTime, of a sidecar: seconds as text or number."""
    seconds = [F.get_json_object(json, f"$.{k}.timestamp").try_cast("bigint") for k in ("photoTakenTime", "creationTime")]
    return F.timestamp_seconds(F.coalesce(*seconds)).cast("timestamp_ntz")
