"""Mixing sources to target weights: hash-threshold histograms.

Every document has a fixed hash of 60 bits. A source's budget is met by taking its documents below a threshold of that
hash: tokens are summed by source and the hash's leading bits, the bucket in which the running sum crosses the budget is the
only one that is refined, by the next bits, until a single hash is left, which is taken if that comes nearer to the budget.
Documents are then filtered by their source's threshold; nothing is sorted.

Defined results: null text has size 0. A null source is a source of its own, the last. Rows with the same doc_id
share a hash and are taken or left together. A source of no words has target 0. An empty table gives an empty table.
Extra columns are ignored by mix(), and kept by mixed().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datewright.llm.common import SPACE, lookup, mapped, materialize, per_row, pick, raw, strings, with_private

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: Hash bits, and those that a histogram looks at at once.
BITS, STEP = 60, 12

_SPACE = np.isin(np.arange(256), np.frombuffer(SPACE, np.uint8))
_KEY = ["source_null", "source_key"]


def count_words(column: pa.Array) -> np.ndarray:
    """Words [^\\x20\\x09-\\x0D]+ of each text."""
    data, offsets = raw(strings(column))
    word = ~_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[firsts] = word[firsts]
    return per_row(start, offsets)


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(count_words(batch.column("text")))], ["doc_id", "source", "size"])


def _hash(doc_id: Column, seed: int) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source_null, source_key, size, h."""
    out = mapped(pick(docs, "doc_id", "source", "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("source", F.col("source").cast("string")), _sized, "doc_id long, source string, size long")
    return materialize(out.select("doc_id", F.col("source").isNull().alias("source_null"), F.coalesce("source", F.lit("")).alias("source_key"), "size", _hash(F.col("doc_id"), seed).alias("h")), "sized")


def budgets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """From each source's source_size: target, whole (times that all its documents are taken) and budget (words taken once more).

    Targets stop at most times the source, and the excess is shared anew: a level is raised until all is shared, where a source gets
    level times weight or, if that is less, its most. Sources full at a level are those of the smallest most / weight. One row a source
    passes through two single-partition windows.
    """
    order = Window.orderBy("source_null", "source_key")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    filling = Window.orderBy(F.col("full") / F.col("w"), "source_null", "source_key")
    everything = Window.partitionBy()
    shared = (
        sources.withColumn("w", w.cast("double"))
        .withColumn("full", (F.col("source_size") * most).cast("double"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_w", F.sum("w").over(everything))
        .withColumn("full_before", F.sum("full").over(filling.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("w_before", F.sum("w").over(filling.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("level", (F.col("total") - F.coalesce("full_before", F.lit(0.0))) / (F.col("all_w") - F.coalesce("w_before", F.lit(0.0))))
        # the level at the first source that it doesn't fill; those before are full
        .withColumn("level", F.min(F.when(F.col("full") >= F.col("level") * F.col("w"), F.struct(F.col("full") / F.col("w"), "level"))).over(everything)["level"])
    )
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("full", F.col("level") * F.col("w")))
    whole = F.floor(F.try_divide("target", F.col("source_size").cast("double")))
    return shared.withColumn("target", target).select(
        *_KEY, "source_size", "target", F.coalesce(whole, F.lit(0)).cast("long").alias("whole"), (F.col("target") - F.coalesce(whole, F.lit(0)) * F.col("source_size")).alias("budget")
    )


def thresholds(docs: DataFrame, plan: DataFrame, sources: int) -> DataFrame:
    """Adds threshold to plan: documents with h below it are taken once more. docs: from sized()."""
    # lo: all hashes below it are taken, of `before` words; the boundary lies in [lo, lo + 2 ** (BITS - depth))
    open_ = materialize(plan.select(*_KEY, "budget", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("before")), "boundary")
    inside, done = docs, []
    for depth in range(0, BITS, STEP):
        width = 1 << (BITS - depth - STEP)
        # only what lies in a boundary bucket goes on
        inside = lookup(inside, open_, _KEY, "inner", sources).filter((F.col("h") >= F.col("lo")) & (F.col("h") - F.col("lo") < width << STEP))
        sums = inside.groupBy(*_KEY, "budget", "before", (F.col("h") - F.col("h") % width).alias("lo")).agg(F.sum("size").alias("words"), F.min("h").alias("first"), F.max("h").alias("last"))
        running = F.sum("words").over(Window.partitionBy(*_KEY).orderBy("lo"))
        # the first bucket that crosses the budget; none where the budget is all of the source
        crossed = sums.withColumn("upto", F.col("before") + running).filter(F.col("upto") > F.col("budget")).groupBy(*_KEY, "budget").agg(F.min_by(F.struct("lo", (F.col("upto") - F.col("words")).alias("before"), "words", "first", "last"), "lo").alias("b"))
        crossed = materialize(crossed.select(*_KEY, "budget", "b.*"), "boundary")
        single = crossed.filter(F.col("first") == F.col("last"))
        nearer = F.col("before") + F.col("words") - F.col("budget") < F.col("budget") - F.col("before")
        done.append(single.select(*_KEY, F.when(nearer, F.col("last") + 1).otherwise(F.col("first")).alias("threshold")))
        open_ = crossed.filter(F.col("first") < F.col("last")).select(*_KEY, "budget", "lo", "before")
        inside = inside.select("doc_id", *_KEY, "size", "h")
        if open_.isEmpty():
            break
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    return plan.join(found, _KEY, "left").withColumn("threshold", F.coalesce("threshold", F.when(F.col("budget") > 0, F.lit(1 << BITS)).otherwise(F.lit(0))).cast("long"))


def _repeats() -> Column:
    return F.col("whole") + (F.col("h") < F.col("threshold")).cast("long")


def _chosen(rows: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, int]:
    """Each source's plan and threshold, and how many sources there are. rows: from sized()."""
    plan = materialize(budgets(rows.groupBy(*_KEY).agg(F.sum("size").alias("source_size")), weights, most), "plan")
    sources = plan.count()
    return materialize(thresholds(rows, plan, sources), "thresholds"), sources


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted)."""
    rows = sized(docs, seed)
    chosen, sources = _chosen(rows, weights, most)
    out = lookup(rows, chosen, _KEY, "inner", sources)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _repeats()).alias("taken"), _repeats().alias("repeats"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 0) -> DataFrame:
    """The mix itself: docs with each document as often as it is taken, under docs' own columns. Documents without words go like others of their hash. A document's hash and its source's threshold decide, so texts aren't shuffled."""
    rows, col, back = with_private(docs)
    chosen, sources = _chosen(sized(docs, seed), weights, most)
    source = col("source").cast("string")
    rows = rows.withColumns({"source_null": source.isNull(), "source_key": F.coalesce(source, F.lit("")), "h": _hash(col("doc_id"), seed)})
    out = lookup(rows, chosen.select(*_KEY, "whole", "threshold"), _KEY, "inner", sources)
    return back(out.withColumn("again", F.explode(F.array_repeat(F.lit(1), _repeats().cast("int")))))


#: DuckDB SQL for the rows of mix(); the threshold is found by sorting there.
ORACLE_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5('0:' || coalesce(cast(doc_id as varchar), 'null')), 1, 15))::bigint as h
  from documents),
sources as (
  select source, sum(size)::bigint as source_size, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as w from sized group by source),
filling as (
  select *, 3.0::double * source_size as most, sum(source_size) over ()::double as total, sum(w) over () as all_w,
         coalesce(sum(3.0::double * source_size) over (order by 3.0::double * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as full_before,
         coalesce(sum(w) over (order by 3.0::double * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as w_before
  from sources),
level as (
  select arg_min((total - full_before) / (all_w - w_before), most / w) as level from filling where most >= (total - full_before) / (all_w - w_before) * w),
plan as (
  select source, source_size, case when source_size = 0 then 0.0::double else least(most, level * w) end as target from filling, level),
budget as (
  select *, case when source_size = 0 then 0 else floor(target / source_size)::bigint end as whole from plan),
cut as (
  select s.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size as budget,
         sum(s.size) over (partition by s.source order by s.h range between unbounded preceding and current row) as upto
  from sized s join budget b on s.source is not distinct from b.source),
units as (
  select *, upto - sum(size) over (partition by source, h) as before from cut)
select doc_id, size, source_size, target,
       (size * (whole + case when upto <= budget or (before <= budget and upto - budget < budget - before) then 1 else 0 end))::bigint as taken
from units
"""
