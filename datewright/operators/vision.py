"""What follows on decoded pictures and model outputs: fingerprints, which way is up, and overlapping boxes. Models are the caller's."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Classes that stand taller than wide, and thresholds.
STANDING = ("person", "bottle", "chair", "pottedplant", "traffic light", "fire hydrant", "parking meter", "refrigerator", "vase")
CONFIDENT, MIN_SCORE, BOX_CONFIDENCE, BOX_OVERLAP = 1.2, 0.5, 0.35, 0.45
#: Pixels of the square that detectors look at.
INPUT = 640
TURNS = ("none", "rot90", "rot180", "rot270")
NOTHING = "nothing recognisable"


def difference_hash(gray: np.ndarray) -> int:
    """64 bits of a grey picture of 8 rows and 9 columns: whether each is brighter than the one to its right, as a signed number."""
    bits = (gray[:, :-1] > gray[:, 1:]).ravel()
    value = int(np.packbits(bits, bitorder="little").view("<u8")[0])
    return value - (1 << 64) if value >> 63 else value


def fingerprints(pictures: DataFrame, decode) -> DataFrame:
    """Adds hash to rows with source; decode: path to a grey array of 8 x 9, or None."""
    @F.pandas_udf("bigint")
    def hashed(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: None if (g := decode(p)) is None else difference_hash(g)).astype("Int64")

    return pictures.withColumn("hash", hashed("source"))


def box_score(label: Column, confidence: Column, bounds: Column) -> Column:
    """What a box says for its turn: more if something that stands is taller than wide."""
    taller = F.abs(F.get(bounds, F.lit(3)) - F.get(bounds, F.lit(1))) > F.abs(F.get(bounds, F.lit(2)) - F.get(bounds, F.lit(0)))
    return confidence * confidence + F.when(label.isin(*STANDING) & taller, confidence * 0.5).otherwise(F.lit(0.0))


def _plural(label: Column, n: Column) -> Column:
    more = F.when(label == "person", "people").when(label.isin("bus", "sandwich"), F.concat(label, F.lit("es"))).when(label.isin("skis", "scissors"), label).otherwise(F.concat(label, F.lit("s")))
    return F.when(n == 1, label).otherwise(more)


def upright(boxes: DataFrame, exact: int | None = None) -> DataFrame:
    """exact: scores are rounded to such a part of 1, so that the order of addition can't tell equal turns apart.

    boxes: file_id, turn, label, confidence, bounds. A row a file: transform, confidence, reason. As found if that scores CONFIDENT; else the best turn, the first of equal ones, if it scores MIN_SCORE; else none."""
    order = F.create_map(*[F.lit(x) for i, t in enumerate(TURNS) for x in (t, i)])
    scored = boxes.groupBy("file_id", "turn").agg(F.sum(box_score(F.col("label"), F.col("confidence").cast("double"), F.col("bounds"))).alias("score"))
    if exact is not None:
        scored = scored.withColumn("score", F.round(F.col("score") * exact) / exact)
    as_found = (F.col("turn") == "none") & (F.col("score") >= CONFIDENT)
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc(as_found), F.desc("score"), order[F.col("turn")]))).filter("n = 1")
    good = F.col("score") >= MIN_SCORE
    best = best.select("file_id", F.when(good, F.col("turn")).otherwise("none").alias("transform"), F.when(good, F.col("score")).otherwise(0.0).alias("confidence"), F.when(good, F.col("turn")).alias("turn"))
    counts = boxes.groupBy("file_id", "turn", "label").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("file_id", "turn").orderBy(F.desc("n"), "label"))
    top = counts.withColumn("p", place).filter("p <= 3").groupBy("file_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "n", "label"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), _plural(x["label"], x["n"]))), ", ").alias("reason"))
    return best.join(top, ["file_id", "turn"], "left").select("file_id", "transform", "confidence", F.coalesce("reason", F.lit(NOTHING)).alias("reason"))


def letterbox(width: int, height: int, edge: int = INPUT) -> tuple[float, int, int, int, int]:
    """How a picture is laid on a square of so many pixels: the scale, its size there, and the margins to its left and above."""
    scale = edge / max(width, height)
    w, h = max(1, round(width * scale)), max(1, round(height * scale))
    return scale, w, h, (edge - w) // 2, (edge - h) // 2


def decoded(prediction: np.ndarray, labels: list[str], size: tuple[int, int], pad: tuple[int, int]) -> list[dict]:
    """Boxes of a detector's output (rows: centre x and y, width, height, a row a class; columns: anchors) above BOX_CONFIDENCE: label, confidence, bounds as shares of the content. size: of the content on the square; pad: its margins."""
    scores = prediction[4:]
    best, sure = scores.argmax(0), scores.max(0)
    out = []
    for k in np.flatnonzero(sure > BOX_CONFIDENCE):
        x, y, w, h = prediction[:4, k]
        box = (np.array([x - w / 2, y - h / 2, x + w / 2, y + h / 2]) - [*pad, *pad]) / [*size, *size]
        out.append({"label": labels[best[k]] if best[k] < len(labels) else "thing", "confidence": float(sure[k]), "bounds": np.clip(box, 0, 1).tolist()})
    return out


def detect_boxes(pictures: DataFrame, detect) -> DataFrame:
    """file_id, turn, label, confidence, bounds of what a detector finds: detect takes file_id and turn and gives the dicts of decoded(). Run over Arrow batches."""
    def run(frames):
        for frame in frames:
            rows = [(i, t, b["label"], b["confidence"], b["bounds"]) for i, t in zip(frame["file_id"], frame["turn"], strict=True) for b in detect(i, t)]
            yield pd.DataFrame(rows, columns=["file_id", "turn", "label", "confidence", "bounds"])

    return pictures.select("file_id", "turn").mapInPandas(run, "file_id bigint, turn string, label string, confidence float, bounds array<float>")


def _overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes have more than BOX_OVERLAP of what they cover in common. Boxes: x0, y0, x1, y1 as doubles, area."""
    common = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0)) * F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    covered = a["area"] + b["area"] - common
    return (covered != 0) & (common / F.when(covered != 0, covered) > BOX_OVERLAP)


def suppress(boxes: DataFrame) -> DataFrame:
    """Boxes above BOX_CONFIDENCE, without those that overlap a more confident one of their file, turn and label by more than BOX_OVERLAP. A picture's boxes are few.

    Of equally confident boxes the first by bounds, then by the other columns, counts as the more confident one, so that the order of rows never matters.
    """
    keys, own = ["file_id", "turn", "label"], boxes.columns
    others = [c for c in own if c not in (*keys, "confidence", "bounds")]
    x0, y0, x1, y1 = (F.get("bounds", F.lit(i)).cast("double") for i in range(4))
    box = F.struct((-F.col("confidence")).alias("less"), "bounds", *others, "confidence", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), ((x1 - x0) * (y1 - y0)).alias("area"))
    several = boxes.filter(F.col("confidence") > BOX_CONFIDENCE).groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("__boxes"))
    kept = F.aggregate("__boxes", F.slice("__boxes", 1, 0), lambda keep, b: F.when(F.exists(keep, lambda k: _overlaps(k, b)), keep).otherwise(F.concat(keep, F.array(b))))
    return several.select(*keys, F.explode(kept).alias("__box")).select(*[F.col(c) if c in keys else F.col("__box")[c].alias(c) for c in own])
