"""Companions: files of one shot take the date of the leading file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datewright import config as C
from datewright.functions.pattern import destination
from datewright.functions.scalars import extension, file_name, group_stem, media_kind, parent
from datewright.schema import FLAG


def pair(plan: DataFrame, root: str = "", pattern: str = "%Y/%m") -> DataFrame:
    """Members of a group (same folder and stem, at least two) take taken and provider of its master: the highest media kind above sidecars, then the weightiest provider, then the first name.

    Adds changed; provider_info becomes `beside <master>` and flags are cleared where it is true.
    """
    weight = F.create_map(*[F.lit(x) for kv in C.DEFAULT_WEIGHTS.items() for x in kv])
    name = F.lower(file_name(F.col("source")))
    rows = plan.withColumn("__folder", parent(F.col("source"))).withColumn("__stem", group_stem(F.col("source"))).withColumn("__kind", media_kind(extension(F.col("source")))).withColumn("__name", name)
    by = Window.partitionBy("__folder", "__stem")
    best = by.orderBy(F.desc("__kind"), F.desc(weight[F.col("provider")]), "__name", F.desc("ordinal"))
    lead = F.first(F.struct(F.col("__kind").alias("kind"), "taken", "provider", F.col("source").alias("source"), "ordinal")).over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("__lead", lead).withColumn("__n", F.count("*").over(by))
    changed = F.col("__stem").isNotNull() & (F.col("__n") >= 2) & (F.col("__lead.kind") > 1) & (F.col("__lead.ordinal") != F.col("ordinal")) & (F.col("__lead.taken") != F.col("taken"))
    rows = rows.withColumn("changed", F.coalesce(changed, F.lit(False)))

    def put(column: str, value):
        return F.when(F.col("changed"), value).otherwise(F.col(column)) if column in plan.columns else None

    subject = F.col("subject") if "subject" in plan.columns else None
    new = {
        "destination": put("destination", destination(F.col("source"), F.col("__lead.taken"), root, pattern, subject)),
        "provider_info": put("provider_info", F.concat(F.lit("beside "), file_name(F.col("__lead.source")))),
        "flags": put("flags", F.array().cast(f"array<{FLAG}>")) if "flags" in plan.columns else None,
        "taken": put("taken", F.col("__lead.taken")),
        "provider": put("provider", F.col("__lead.provider")),
    }
    return rows.withColumns({k: v for k, v in new.items() if v is not None}).drop("__folder", "__stem", "__kind", "__name", "__lead", "__n")
