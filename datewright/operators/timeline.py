"""Timelines: the compressed time axis, instances of candidates and their layouts, yearly thinning and rings, and the flight path.

An axis has a row a distinct day; its windows run over days, which are few, not over files.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datewright.functions.scalars import epoch

# Proportions of the layouts.
DAY, GAP_DAYS, GAP_FRACTION = 86400, 90, 0.45
LANES = ("filename", "exif", "media", "filesystem")
SPAN, DEPTH, LANE_GAP, STACK_STEP, SPREAD_HOURS = 22, 7, 1.35, 0.075, 48
BINS = 48
TILE_WIDTH, TILE_GAP, RING_GAP, MAX_GAP, GAP_SHARE, MIN_RADIUS, MAX_RADIUS = 0.62, 1.14, 1.05, 6, 0.11, 2.2, 46
VIEW_ANGLE, NEAREST, MAX_TILE, MARGIN = 0.9, 1.15, 0.26, 0.2
RING_CAPACITY = math.floor(MAX_RADIUS * math.pi * 2 / (TILE_WIDTH * TILE_GAP))


def time_axis(epochs: DataFrame) -> DataFrame:
    """epochs: epoch. A row a distinct day: day, position and width (of the whole axis' 1), gap (days to the next; null at the last), break_at (the middle of a gap that is compressed), tick (its year, on the year's first day).

    Gaps of more than GAP_DAYS share GAP_FRACTION of what the others take, by the logarithm of their length. A single day lies at 0.5.
    """
    days = epochs.select(F.floor(F.col("epoch") / DAY).alias("day")).distinct()
    everything, order = Window.partitionBy(), Window.orderBy("day")
    rows = days.withColumn("gap", F.lead("day").over(order) - F.col("day"))
    long = F.coalesce(F.col("gap"), F.lit(1)) > GAP_DAYS
    plain = F.when(long, F.lit(0)).otherwise(F.coalesce(F.col("gap"), F.lit(1)))
    weight = F.when(long, F.log2(F.col("gap") + 1.0)).otherwise(F.lit(0.0))
    rows = rows.withColumn("content", F.sum(plain).over(everything)).withColumn("weight", weight).withColumn("weights", F.sum(weight).over(everything)).withColumn("n", F.count("*").over(everything))
    content = F.when(F.col("content") == 0, 1).otherwise(F.col("content"))
    width = F.when(F.col("weight") > 0, content * GAP_FRACTION * F.col("weight") / F.col("weights")).otherwise(plain.cast("double"))
    rows = rows.withColumn("raw", width).withColumn("total", F.sum("raw").over(everything)).withColumn("upto", F.coalesce(F.sum("raw").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    year = F.year(F.timestamp_seconds(F.col("day") * DAY))
    first = F.row_number().over(Window.partitionBy(year).orderBy("day")) == 1
    one = F.col("n") == 1
    return rows.select(
        "day",
        F.when(one, 0.5).otherwise(F.col("upto") / F.col("total")).alias("position"),
        F.when(one, 0.0).otherwise(F.least(F.lit(1.0), "raw") / F.col("total")).alias("step"),
        F.when(one, 0.0).otherwise(F.col("raw") / F.col("total")).alias("width"),
        "gap",
        F.when(F.col("gap") > GAP_DAYS, (F.col("upto") + F.col("raw") / 2) / F.col("total")).alias("break_at"),
        F.when(first, year.cast("string")).alias("tick"),
    )


def on_axis(rows: DataFrame, axis: DataFrame, column: str = "epoch") -> DataFrame:
    """Adds t, the place of an epoch: the position of the last day of the axis that isn't after it, and its share of that day; 0 before the axis begins.

    Each day of the axis stands for the days up to the next one, so the join is on the day alone. There are as many days as the axis spans, however many rows there are.
    """
    ends = axis.agg(F.min("day").alias("__first"), F.max("day").alias("__last"))
    days = axis.select(F.explode(F.sequence("day", F.col("day") + F.coalesce("gap", F.lit(1)) - 1)).alias("__on"), "day", "position", "step")
    at = F.floor(F.col(column) / DAY)
    out = rows.crossJoin(F.broadcast(ends)).withColumn("__on", F.greatest(F.least(at, F.col("__last")), F.col("__first"))).join(days, "__on")  # ends: one row
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(column) - F.col("day") * DAY) / DAY))
    t = F.when(at < F.col("__first"), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.col("position") + F.col("step") * share))
    return out.withColumn("t", t).drop("day", "position", "step", "__on", "__first", "__last")


def instances(entries: DataFrame, tone: Column | None = None) -> DataFrame:
    """A row for each candidate of a provider that has a lane: ordinal, pos, lane, epoch, chosen; the first whose time is the entry's is chosen. Where none is, a chosen row of the entry itself follows."""
    lane_of = F.create_map(*[F.lit(x) for i, p in enumerate(LANES) for x in (p, i)])
    own = epoch(F.col("taken"))
    base = entries.select("ordinal", "provider", own.alias("own"), F.filter("candidates", lambda c: c["provider"].isin(*LANES)).alias("c"), (tone if tone is not None else F.lit(1)).alias("tone"))
    at = F.array_min(F.transform("c", lambda c, i: F.when(epoch(c["taken"]) == F.col("own"), i)))
    seen = F.transform("c", lambda c, i: F.struct(i.cast("bigint").alias("pos"), lane_of[c["provider"]].alias("lane"), epoch(c["taken"]).alias("epoch"), F.coalesce(i == F.col("at"), F.lit(False)).alias("chosen")))
    own_row = F.struct(F.size("c").cast("bigint").alias("pos"), F.coalesce(lane_of[F.col("provider")], F.lit(0)).alias("lane"), F.col("own").alias("epoch"), F.lit(True).alias("chosen"))
    every = F.concat(seen, F.when(F.col("at").isNull(), F.array(own_row)).otherwise(F.slice(F.array(own_row), 1, 0)))
    return base.withColumn("at", at).select("ordinal", "tone", F.explode(every).alias("k")).select("ordinal", "k.*", "tone")


def disagreement_pairs(found: DataFrame) -> DataFrame:
    """anchor_pos and other_pos of each entry: its chosen instance (else its first) against those SPREAD_HOURS or more away. An entry has seven instances at most."""
    per = found.groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("pos", "epoch", "chosen"))).alias("all"))
    anchor = F.coalesce(F.get(F.filter("all", lambda x: x["chosen"]), F.lit(0)), F.get("all", F.lit(0)))
    per = per.withColumn("anchor", anchor)
    far = F.filter("all", lambda x: (x["pos"] != F.col("anchor.pos")) & (F.abs(x["epoch"] - F.col("anchor.epoch")) >= SPREAD_HOURS * 3600))
    return per.select("ordinal", F.col("anchor.pos").alias("anchor_pos"), F.explode(far).alias("o"), F.col("anchor.epoch").alias("anchor_epoch")).select("ordinal", "anchor_pos", F.col("o.pos").alias("other_pos"), (F.col("o.epoch") - F.col("anchor_epoch")).alias("seconds"))


def _round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def stack_depth(placed: DataFrame, keys: list[Column]) -> Column:
    """The running number of an instance within its cell."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal", "pos")) - 1


def field(placed: DataFrame) -> DataFrame:
    """placed: from on_axis(instances). Adds x, y, z: time, lane, depth of the stack."""
    depth = stack_depth(placed, [_round_half_up(F.col("t") * 900), F.col("lane")])
    return placed.withColumn("z", (depth - 6) * STACK_STEP).withColumn("x", (F.col("t") - 0.5) * SPAN).withColumn("y", (1.5 - F.col("lane")) * LANE_GAP)


def hour_of(column: Column) -> Column:
    return F.pmod(column, F.lit(DAY)) / 3600


def helix(placed: DataFrame, span_days: float) -> DataFrame:
    """A turn a year."""
    angle = F.col("t") * max(1.0, span_days / 365) * math.pi * 2
    wrong = F.col("tone") == 2
    radius = 3.4 + hour_of(F.col("epoch")) / 24 * 1.8 + F.when(wrong, 2.6).otherwise(0.0)
    return placed.withColumn("x", F.cos(angle) * radius).withColumn("y", (F.col("t") - 0.5) * 11 + F.when(wrong, 1.1).otherwise(0.0)).withColumn("z", F.sin(angle) * radius)


def terrain(placed: DataFrame) -> DataFrame:
    hour = hour_of(F.col("epoch"))
    height = stack_depth(placed, [_round_half_up(F.col("t") * 700), _round_half_up(hour)])
    return placed.withColumn("y", height * 0.09 - 3).withColumn("x", (F.col("t") - 0.5) * SPAN).withColumn("z", (hour / 24 - 0.5) * DEPTH)


def thinned(rows: DataFrame, by: list[str], order: list[str], limit: int, cell: Column | None = None) -> DataFrame:
    """Even thinning: of n members of a group, those at floor(i * n / limit); all if there are limit or fewer. Adds n and shown_index.

    A member at place r is kept if some i has floor(i * n / limit) = r, and the first such is ceil(r * limit / n). cell: an expression that grows with order, such as the day: members are counted by cell, so that
    a place is the members of the cells before it and the place within its own cell, and no task gets a whole group.
    """
    rows = rows.withColumn("__cell", F.lit(0) if cell is None else cell)
    keys = [f"__by{i}" for i in range(len(by))]
    cells = rows.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col("__cell").alias("__at")).agg(F.count("*").alias("__m"))
    group = Window.partitionBy(*keys)
    cells = cells.withColumn("n", F.sum("__m").over(group)).withColumn("__before", F.sum("__m").over(group.orderBy("__at")) - F.col("__m")).drop("__m")
    out = rows.join(cells, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip([*by, "__cell"], [*keys, "__at"], strict=True)]).drop(*keys, "__at")
    out = out.withColumn("__r", F.col("__before") + F.row_number().over(Window.partitionBy(*by, "__cell").orderBy(*order)) - 1)
    i = F.ceil(F.col("__r") * limit / F.col("n"))
    kept = (F.col("n") <= limit) | ((i < limit) & (F.floor(i * F.col("n") / limit) == F.col("__r")))
    return out.withColumn("shown_index", F.when(F.col("n") <= limit, F.col("__r")).otherwise(i).cast("bigint")).filter(kept).drop("__r", "__cell", "__before")


def periods(entries: DataFrame) -> DataFrame:
    """label (year), files, first and last (seconds). The entries of a period are a filter on the range, in_period()."""
    return entries.groupBy(F.year(F.timestamp_seconds("taken_epoch")).alias("label")).agg(F.count("*").alias("files"), F.min("taken_epoch").alias("first"), F.max("taken_epoch").alias("last"))


def in_period(entries: DataFrame, label: int) -> DataFrame:
    """A year's entries by date."""
    return entries.filter(F.year(F.timestamp_seconds("taken_epoch")) == label).orderBy("taken_epoch", "ordinal")


def radius_for(count: Column) -> Column:
    return F.least(F.lit(MAX_RADIUS), F.greatest(F.lit(MIN_RADIUS), F.least(count, F.lit(RING_CAPACITY)) * (TILE_WIDTH * TILE_GAP / (math.pi * 2))))


def year_rings(entries: DataFrame) -> DataFrame:
    """A row a year: year, ring, count, shown, radius, y."""
    rings = entries.groupBy(F.year(F.timestamp_seconds("taken_epoch")).alias("year")).agg(F.count("*").alias("count"))
    rings = rings.withColumn("radius", radius_for(F.col("count"))).withColumn("ring", F.row_number().over(Window.orderBy("year")) - 1)  # a row a year
    gap = F.least(F.lit(MAX_GAP), F.greatest(F.lit(RING_GAP), F.greatest(F.lit(MIN_RADIUS), F.max("radius").over(Window.partitionBy())) * GAP_SHARE))
    return rings.withColumn("gap", gap).select("year", "ring", "count", F.least("count", F.lit(RING_CAPACITY)).alias("shown"), "radius", (F.col("ring") * F.col("gap")).alias("y"), "gap")


def ring_tiles(entries: DataFrame) -> DataFrame:
    """A row a tile: ordinal, year, ring, angle, radius, y, coil."""
    rows = entries.withColumn("year", F.year(F.timestamp_seconds("taken_epoch")))
    tiles = thinned(rows, ["year"], ["taken_epoch", "ordinal"], RING_CAPACITY, F.floor(F.col("taken_epoch") / 3600)).select("ordinal", "year", "shown_index")
    out = tiles.join(F.broadcast(year_rings(entries)), "year")  # a row a year
    share = F.col("shown_index") / F.col("shown")
    return out.select("ordinal", "year", "ring", (share * math.pi * 2).alias("angle"), "radius", "y", (F.col("y") + share * F.col("gap")).alias("coil"))


def nearest_tiles(tiles: DataFrame, eye: tuple[float, float, float], limit: int, coiling: float = 0.0) -> DataFrame:
    """The tiles that are closest to a point."""
    height = F.col("y") + (F.col("coil") - F.col("y")) * min(1.0, max(0.0, coiling))
    x, z = F.sin("angle") * F.col("radius"), F.cos("angle") * F.col("radius")
    far = F.sqrt((x - eye[0]) ** 2 + (height - eye[1]) ** 2 + (z - eye[2]) ** 2)
    return tiles.withColumn("distance", far).orderBy("distance", "ordinal").limit(max(0, limit))


def visible_tiles(placed: DataFrame, matrix: list[float], limit: int, fade: float = 1.0) -> DataFrame:
    """The chosen instances that a camera sees, nearest first: ordinal, pos, tile_x, tile_y, size, depth. placed: with x, y, z; matrix: view and projection, by columns."""
    point = [F.col("x"), F.col("y"), F.col("z"), F.lit(1.0)]
    row = lambda i: sum((c * float(matrix[4 * k + i]) for k, c in enumerate(point)), F.lit(0.0))
    seen = placed.filter("chosen").withColumn("depth", row(3)).filter(F.col("depth") >= NEAREST)
    seen = seen.withColumn("tile_x", (row(0) / F.col("depth") + 1) / 2).withColumn("tile_y", 1 - (row(1) / F.col("depth") + 1) / 2)
    inside = F.col("tile_x").between(-MARGIN, 1 + MARGIN) & F.col("tile_y").between(-MARGIN, 1 + MARGIN)
    size = F.least(F.lit(MAX_TILE), F.lit(TILE_WIDTH / math.tan(VIEW_ANGLE / 2) / 2) / F.col("depth"))
    return seen.filter(inside & F.lit(fade > 0)).select("ordinal", "pos", "tile_x", "tile_y", size.alias("size"), "depth").orderBy("depth", "ordinal", "pos").limit(limit)


def path_bins(points: DataFrame, bins: int = BINS) -> DataFrame:
    """points: x, y, z. A row a bin of equal width along x: bin, x (its middle), y and z: the mean of its points, on a line between its neighbours where it has none, and the nearest bin's at the ends."""
    edge = points.agg(F.min("x").alias("low"), F.max("x").alias("high")).filter(F.col("high") - F.col("low") >= 1e-6)
    width = (F.col("high") - F.col("low")) / bins
    means = points.crossJoin(F.broadcast(edge)).groupBy(F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("low")) / width)).cast("int").alias("bin")).agg(F.avg("y").alias("my"), F.avg("z").alias("mz"))  # edge: one row
    dense = points.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(edge)).join(means, "bin", "left")
    before, after = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    full = F.when(F.col("my").isNotNull(), F.struct("bin", "my", "mz"))
    rows = dense.withColumn("full", full).withColumn("a", F.last("full", True).over(before)).withColumn("b", F.first("full", True).over(after))
    a, b = F.coalesce("a", "b"), F.coalesce("b", "a")
    t = F.when(a["bin"] == b["bin"], 0.0).otherwise((F.col("bin") - a["bin"]) / (b["bin"] - a["bin"]))
    return rows.select("bin", (F.col("low") + (F.col("bin") + 0.5) * width).alias("x"), (a["my"] + (b["my"] - a["my"]) * t).alias("y"), (a["mz"] + (b["mz"] - a["mz"]) * t).alias("z"))
