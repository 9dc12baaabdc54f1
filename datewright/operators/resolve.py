"""Choosing one date per file from its candidates, and what is odd about the choice. All per row, without a shuffle."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datewright import config as C
from datewright.functions.scalars import DAY_US, HOUR_US, micros
from datewright.schema import FLAG


def candidates(columns: dict[str, tuple[Column, Column]]) -> Column:
    """An array of detections in provider order from provider -> (taken, info); those without a time fall out.

    `system` counts only if no provider that looks into or at the file's name found a date.
    """
    def one(p: str) -> Column:
        taken, info = columns[p]
        return F.when(taken.isNotNull(), F.struct(F.lit(p).alias("provider"), info.cast("string").alias("info"), taken.alias("taken")))

    known = [p for p in C.PROVIDERS if p in columns]
    content = [columns[p][0] for p in known if p not in ("system", "filesystem")]
    dated = reduce(lambda a, b: a | b, [c.isNotNull() for c in content], F.lit(False))
    return F.array_compact(F.array(*[F.when(~dated, one(p)) if p == "system" else one(p) for p in known]))


def flag(name: str, **payload: Column) -> Column:
    fields = {"days": "bigint", "anchor": "timestamp_ntz", "files": "bigint", "years": "bigint", "hours": "bigint"}
    return F.struct(F.lit(name).alias("flag"), *[payload.get(k, F.lit(None)).cast(t).alias(k) for k, t in fields.items()])


def _date_rules(taken: Column, us: Column, written: Column, now: datetime) -> list[Column]:
    """A factory-reset date, the future, later than the file was written; never null. us: taken in microseconds."""
    rules = [(F.dayofyear(taken) == 1) & (F.pmod(us, F.lit(DAY_US)) < (C.EPOCH_SECONDS + 1) * 1_000_000), us > round(now.replace(tzinfo=UTC).timestamp() * 1_000_000), us - micros(written) > C.WRITE_HOURS * HOUR_US]
    return [F.coalesce(r, F.lit(False)) for r in rules]


def date_flags(taken: Column, written: Column, now: datetime) -> Column:
    names = ("camera_epoch", "future_date", "taken_after_file_write")
    return F.array_compact(F.array(*[F.when(r, flag(n)) for n, r in zip(names, _date_rules(taken, micros(taken), written, now), strict=True)]))


# A file has seven candidates at most. What is said of pairs of them are functions over that small array: written out place by place they would make methods too large for the JVM's compiler.


def times(found: Column) -> Column:
    """The candidates' times in microseconds."""
    return F.transform(found, lambda c: micros(c["taken"]))


def spread_days(found: Column, us: Column | None = None) -> Column:
    us = times(found) if us is None else us
    return F.floor((F.array_max(us) - F.array_min(us)) / DAY_US).cast("bigint")


def timezone_hours(taken: Column, found: Column) -> Column:
    """Whole hours, 1 to 14, between the date and the first candidate that is exactly so far away; the file system's isn't looked at."""
    own = micros(taken)

    def fits(c: Column) -> Column:
        gap = F.abs(micros(c["taken"]) - own)
        return (c["provider"] != "filesystem") & (gap % HOUR_US == 0) & gap.between(HOUR_US, C.MAX_ZONE_HOURS * HOUR_US)

    first = F.get(F.filter(found, fits), F.lit(0))
    return F.floor(F.abs(micros(first["taken"]) - own) / HOUR_US).cast("bigint")


def entry_flags(taken: Column, found: Column, written: Column, now: datetime, us: Column | None = None) -> Column:
    days, hours = spread_days(found, us), timezone_hours(taken, found)
    rest = F.array_compact(F.array(F.when(days > C.SPREAD_DAYS, flag("provider_spread", days=days)), F.when(hours.isNotNull(), flag("timezone_shift", hours=hours))))
    return F.concat(date_flags(taken, written, now), rest).cast(f"array<{FLAG}>")


def _agreeing(us: Column, own: Column) -> Column:
    """How many others lie less than a day from one of them."""
    return F.size(F.filter(us, lambda u: F.abs(u - own) < C.CONSENSUS_HOURS * HOUR_US)) - 1


def corroborated(found: Column, us: Column | None = None) -> Column:
    """Two candidates less than a day apart."""
    us = times(found) if us is None else us
    return F.exists(us, lambda u: _agreeing(us, u) > 0)


def severity(name: Column) -> Column:
    return F.when(name.isin(*C.SOFT_FLAGS), "soft").when(name.isin(*C.NOTE_FLAGS), "note").otherwise("hard")


def any_hard(flags: Column) -> Column:
    return F.exists(flags, lambda f: severity(f["flag"]) == "hard")


def confidence(flags: Column, found: Column, us: Column | None = None) -> Column:
    noted = F.forall(flags, lambda f: severity(f["flag"]) == "note")
    return F.when(any_hard(flags), "low").when(noted & corroborated(found, us), "high").otherwise("medium")


def describe(f: Column) -> Column:
    """A flag in words."""
    name = f["flag"]
    return (
        F.when(name == "camera_epoch", "sits on a camera factory-reset date")
        .when(name == "future_date", "lies in the future")
        .when(name == "taken_after_file_write", "is later than the file was written")
        .when(name == "provider_spread", F.format_string("sources disagree by %d days", f["days"]))
        .when(name == "clock_reset_run", F.format_string("part of a %d-file run counting up from %s", f["files"], F.date_format(f["anchor"], "yyyy-MM-dd HH:mm")))
        .when(name == "identical_timestamp_cluster", F.format_string("shared to the second with %d files", f["files"]))
        .when(name == "sequence_outlier", "breaks the camera counter order of its folder")
        .when(name == "far_from_neighbours", F.format_string("%d years away from the rest of its folder", f["years"]))
        .when(name == "timezone_shift", F.format_string("reads %d whole hours from another source, which is the shape of a time zone rather than a wrong date", f["hours"]))
    )


def _literal_map(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _score(taken: Column, provider: Column, us: Column, every: Column, written: Column, now: datetime, options: C.DetectOptions) -> Column:
    weight = _literal_map({p: options.weight(p) for p in C.PROVIDERS})[provider]
    flags = sum((f.cast("int") for f in _date_rules(taken, us, written, now)), F.lit(0))
    return weight - C.FLAG_PENALTY * flags + C.CONSENSUS_BONUS * _agreeing(every, us)


def score(c: Column, found: Column, written: Column, now: datetime, options: C.DetectOptions) -> Column:
    return _score(c["taken"], c["provider"], micros(c["taken"]), times(found), written, now, options)


def _of_provider(found: Column, provider: str) -> Column:
    return F.get(F.filter(found, lambda c: c["provider"] == provider), F.lit(0))


def choose(found: Column, written: Column, now: datetime, options: C.DetectOptions, us: Column | None = None) -> Column:
    """The chosen detection; null without candidates. Ties: the earlier date, then the weightier provider, then the later in provider order."""
    if options.strategy == "priority":
        return F.coalesce(*[_of_provider(found, p) for p in options.providers])
    us = times(found) if us is None else us
    rank = _literal_map({p: i for i, p in enumerate(C.PROVIDERS)})
    weight = _literal_map({p: options.weight(p) for p in C.PROVIDERS})

    def key(own: Column, i: Column) -> Column:
        c = F.get(found, i)
        order = rank[c["provider"]].alias("rank")
        if options.strategy == "oldest":
            return F.struct((-own).alias("early"), (-order).alias("rank"), i.alias("i"))
        return F.struct(_score(c["taken"], c["provider"], own, us, written, now, options).alias("score"), (-own).alias("early"), weight[c["provider"]].alias("weight"), order, i.alias("i"))

    return F.get(found, F.array_max(F.transform(us, key))["i"])


def resolve(files: DataFrame, now: datetime = C.NOW, options: C.DetectOptions | None = None) -> DataFrame:
    """Adds taken, provider, provider_info, flags and confidence to files with candidates and filesystem (time of the last write); files without candidates fall out."""
    options = options or C.DetectOptions()
    us = F.col("__us")
    rows = files.filter(F.size("candidates") > 0).withColumn("__us", times(F.col("candidates")))
    out = rows.withColumn("chosen", choose(F.col("candidates"), F.col("filesystem"), now, options, us))
    if options.strategy == "priority":
        out = out.filter(F.col("chosen").isNotNull())
    out = out.withColumns({"taken": F.col("chosen.taken"), "provider": F.col("chosen.provider"), "provider_info": F.col("chosen.info")}).drop("chosen")
    out = out.withColumn("flags", entry_flags(F.col("taken"), F.col("candidates"), F.col("filesystem"), now, us))
    return out.withColumn("confidence", confidence(F.col("flags"), F.col("candidates"), us)).drop("__us")
