"""User corrections as side tables of one row a source, merged over a plan. Nothing is changed in place: each edit gives a new side table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datewright.functions.dateparse import parse_manual
from datewright.functions.pattern import destination
from datewright.functions.scalars import turn

#: Seconds of the years 1 to 9999, and of the longest shift.
CALENDAR = (-62135596800, 253402300799)
LONGEST_SHIFT = CALENDAR[1] - CALENDAR[0]


def apply_dates(plan: DataFrame, overrides: DataFrame, root: str, pattern: str) -> DataFrame:
    """overrides: source, taken, origin. Adds override_origin; the destination of an overridden file is built without its subject."""
    o = overrides.select("source", F.col("taken").alias("__taken"), F.col("origin").alias("override_origin"))
    out = plan.join(o, "source", "left")
    hit = F.col("__taken").isNotNull()
    new = {"taken": F.when(hit, F.col("__taken")).otherwise(F.col("taken"))}
    if "destination" in plan.columns:
        new["destination"] = F.when(hit, destination(F.col("source"), F.col("__taken"), root, pattern)).otherwise(F.col("destination"))
    return out.withColumns(new).drop("__taken")


def apply_rotations(plan: DataFrame, rotations: DataFrame) -> DataFrame:
    """rotations: source, rotate, reencode."""
    r = rotations.select("source", F.col("rotate").alias("__rotate"), F.col("reencode").alias("__reencode"))
    out = plan.join(r, "source", "left")
    return out.withColumns({"rotate": F.coalesce("__rotate", "rotate"), "reencode": F.coalesce("__reencode", "reencode")}).drop("__rotate", "__reencode")


def exclude(plan: DataFrame, excluded: DataFrame) -> DataFrame:
    return plan.join(excluded.select("source"), "source", "left_anti")


def change_exclusions(excluded: DataFrame, sources: DataFrame, out: bool) -> tuple[DataFrame, DataFrame]:
    """The set with sources added (out) or taken away, and one row: changed, how many that concerned."""
    have, want = excluded.select("source").distinct(), sources.select("source").distinct()
    if out:
        return have.unionByName(want).distinct(), want.join(have, "source", "left_anti").agg(F.count("*").alias("changed"))
    return have.join(want, "source", "left_anti"), want.join(have, "source", "left_semi").agg(F.count("*").alias("changed"))


def load_plan(plan: DataFrame, overrides: DataFrame, rotations: DataFrame, excluded: DataFrame, root: str, pattern: str) -> DataFrame:
    """What copying and verifying see."""
    return apply_rotations(apply_dates(exclude(plan, excluded), overrides, root, pattern), rotations)


def retarget(plan: DataFrame, root: str, pattern: str) -> DataFrame:
    """Every destination anew, with the subject."""
    return plan.withColumn("destination", destination(F.col("source"), F.col("taken"), root, pattern, F.col("subject") if "subject" in plan.columns else None))


def shifted(plan: DataFrame, seconds: int) -> DataFrame:
    """An overlay that moves each of the plan's files."""
    return plan.select("source", (F.col("taken") + F.make_dt_interval(secs=F.lit(seconds))).cast("timestamp_ntz").alias("taken"), F.lit("shift").alias("origin"), F.lit(seconds).cast("bigint").alias("seconds"))


def reprovided(plan: DataFrame, provider: str) -> DataFrame:
    """An overlay with that provider's candidate; files without one are left out."""
    c = F.get(F.filter("candidates", lambda x: x["provider"] == provider), F.lit(0))
    return plan.select("source", c["taken"].alias("taken"), F.lit("candidate").alias("origin"), F.lit(provider).alias("provider")).filter("taken is not null")


def refuse_copied(chosen: DataFrame, journal: DataFrame) -> None:
    """ValueError if a file among chosen (source) has been copied: its date can't be changed any more. Failed copies don't count. journal: the latest records."""
    gone = chosen.join(journal.filter("status <> 'failed'").select("source"), "source", "left_semi").agg(F.min("source").alias("source")).head()["source"]
    if gone is not None:
        raise ValueError(f"{gone} has been copied")


def _known(plan: DataFrame, sources: DataFrame, journal: DataFrame | None) -> DataFrame:
    unknown = sources.join(plan.select("source"), "source", "left_anti").agg(F.min("source").alias("source")).head()["source"]
    if unknown is not None:
        raise ValueError(f"{unknown} isn't in the plan")
    if journal is not None:
        refuse_copied(sources, journal)
    return plan.join(sources.select("source"), "source", "left_semi")


def set_manual(plan: DataFrame, side: DataFrame, source: str, text: str, journal: DataFrame | None = None) -> DataFrame:
    """The side table with a date set by hand. ValueError for text that isn't a date, for a file that isn't in the plan or has been copied."""
    one = plan.sparkSession.createDataFrame([(source, text)], "source string, text string").withColumn("taken", parse_manual(F.col("text")))
    if one.filter("taken is null").head() is not None:
        raise ValueError(f"{text!r} isn't a date")
    _known(plan, one, journal)
    return upsert(side, one.select("source", "taken", F.lit("manual").alias("origin")))


def set_candidate(plan: DataFrame, side: DataFrame, source: str, provider: str, journal: DataFrame | None = None) -> DataFrame:
    """The side table with a provider's date; ValueError where the file has none."""
    chosen = reprovided(_known(plan, plan.sparkSession.createDataFrame([(source,)], "source string"), journal), provider)
    if chosen.head() is None:
        raise ValueError(f"{source} has no date from {provider}")
    return upsert(side, chosen)


def clear(side: DataFrame, sources: DataFrame) -> DataFrame:
    """The side table without these files."""
    return side.join(sources.select("source"), "source", "left_anti")


def shift(plan: DataFrame, side: DataFrame, sources: DataFrame, seconds: int, journal: DataFrame | None = None) -> DataFrame:
    """The side table with these files moved. All or nothing: ValueError if one isn't in the plan, has been copied, or would leave the calendar."""
    chosen = _known(plan, sources, journal)
    if abs(seconds) > LONGEST_SHIFT:
        raise ValueError("that shift is too large")
    at = F.unix_seconds(F.col("taken").cast("timestamp")) + seconds
    out = chosen.agg(F.min(F.when(~at.between(*CALENDAR), F.col("source"))).alias("source")).head()["source"]
    if out is not None:
        raise ValueError(f"{out} would move outside the calendar")
    return upsert(side, shifted(chosen, seconds))


def reprovide(plan: DataFrame, side: DataFrame, sources: DataFrame, provider: str, journal: DataFrame | None = None) -> DataFrame:
    """The side table with a provider's date for each of these files that has one; ValueError if none has."""
    chosen = reprovided(_known(plan, sources, journal), provider)
    if chosen.head() is None:
        raise ValueError(f"none of those files have a date from {provider}")
    return upsert(side, chosen)


def upsert(side: DataFrame, new: DataFrame) -> DataFrame:
    """new's rows win by source."""
    return side.join(new.select("source"), "source", "left_anti").unionByName(new, allowMissingColumns=True)


def turned(plan: DataFrame, quarters: int) -> DataFrame:
    """A rotation overlay: each file's transform, turned on."""
    return plan.select("source", turn(F.col("rotate"), F.lit(quarters)).alias("rotate"), F.lit(False).alias("reencode"))


def rotation_decision(orientation: Column, transform: Column, guess: Column, lossless: Column, enabled: bool = True) -> Column:
    """Off: none. The EXIF transform if it does something; else a model's guess, where orientation says nothing and it can be turned without loss."""
    if not enabled:
        return F.lit("none")
    return F.when(transform != "none", transform).when((F.coalesce(orientation, F.lit(1)) <= 1) & guess.isNotNull() & lossless, guess).otherwise(F.lit("none"))
