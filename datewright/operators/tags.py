"""The tag store as tables: sighting (source, tags, vector, quality), one row a source; a tag is worn by exploding. Search by words and by vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datewright.functions.scalars import label_of

MAX_TAGS, TAG_FLOOR, HIT_FLOOR, SEARCH_LIMIT = 6, 0.14, 0.02, 500
#: Tags that are no longer in use.
RETIRED = ("a good picture", "a beautiful picture")


def worn(sightings: DataFrame) -> DataFrame:
    return sightings.select("source", F.explode(F.array_distinct("tags")).alias("tag"))


def tag_counts(sightings: DataFrame) -> DataFrame:
    return worn(sightings).groupBy("tag").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "tag")


def tag_counts_untagged(entries: DataFrame) -> DataFrame:
    """With a last row of a null tag for files without tags, if there are any."""
    counts = entries.select(F.explode_outer(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("files"))
    return counts.orderBy(F.col("tag").isNull(), F.desc("files"), "tag")


def drop_retired(sightings: DataFrame) -> DataFrame:
    return sightings.withColumn("tags", F.filter("tags", lambda t: ~t.isin(*RETIRED)))


def merge_tags(entries: DataFrame, store: DataFrame) -> DataFrame:
    """A store's tags stand before an entry's own where there are any; its quality is attached."""
    s = store.select("source", F.col("tags").alias("__tags"), F.col("quality").alias("__quality"))
    out = entries.join(s, "source", "left").withColumn("tags", F.when(F.size("__tags") > 0, F.col("__tags")).otherwise(F.col("tags")))
    return out.withColumn("quality", F.col("__quality")).drop("__tags", "__quality")


def needles(words: str) -> list[str]:
    return [w for w in words.lower().split() if w not in ("and", "or")]


def _any_contains(tags: Column, word: str) -> Column:
    return F.exists(tags, lambda t: F.contains(F.lower(t), F.lit(word)))


def keyword_search(sightings: DataFrame, words: str, limit: int | None = SEARCH_LIMIT) -> DataFrame:
    """source, score: the share of the words that are part of a tag; repeated words count as often. Best first, then by path; limit None: all hits."""
    wanted = needles(words)
    if not wanted:
        return sightings.select("source", F.lit(0.0).alias("score")).limit(0)
    hits = sum((_any_contains(F.col("tags"), w).cast("int") for w in wanted), F.lit(0))
    found = sightings.select("source", (hits / F.lit(len(wanted))).alias("score")).filter("score > 0").orderBy(F.desc("score"), "source")
    return found.limit(limit) if limit else found


def normalise(vector: Column) -> Column:
    """Of length 1; as it is if its length is zero or not finite."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when((length > 0) & (length < float("inf")), F.transform(vector, lambda v: v.cast("double") / length)).otherwise(F.transform(vector, lambda v: v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """The dot product of unit vectors; 0 for unlike lengths or none."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot).otherwise(F.lit(0.0))


def vector_search(sightings: DataFrame, wanted: Column, limit: int | None = SEARCH_LIMIT, floor: float = HIT_FLOOR) -> DataFrame:
    """source, score, best first; wanted: an array column of one value, such as a literal."""
    hits = sightings.select("source", cosine(F.col("vector"), wanted).alias("score")).filter(F.col("score") >= floor).orderBy(F.desc("score"), "source")
    return hits.limit(limit) if limit else hits


def ranked_hits(hits: DataFrame) -> DataFrame:
    """The first SEARCH_LIMIT hits with their rank: few enough for one task and for a broadcast."""
    return hits.orderBy(F.desc("score"), "source").limit(SEARCH_LIMIT).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "source")))


def search_order(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """The entries that were hit, with their score and rank."""
    return entries.join(F.broadcast(ranked_hits(hits)), "source").orderBy("rank")


def narrow(counts: DataFrame, needle: str) -> DataFrame:
    """Of a list of tags those whose label has the needle in it, in any case; all for a blank one."""
    wanted = needle.strip().lower()
    return counts.filter(F.contains(F.lower(label_of(F.col("tag"))), F.lit(wanted))) if wanted else counts


def top_tags(vocabulary: Column, scores: Column) -> Column:
    """The words whose finite, positive score is at least TAG_FLOOR of the best, best first, MAX_TAGS at most; ties keep the vocabulary's order."""
    known = F.slice(scores, F.lit(1), F.size(vocabulary))
    pairs = F.transform(known, lambda s, i: F.struct((-s.cast("double")).alias("down"), i.alias("at")))
    finite = F.filter(pairs, lambda p: ~F.isnan(p["down"]) & (F.abs(p["down"]) < float("inf")))
    best = F.get(F.array_sort(finite), F.lit(0))["down"]
    good = F.filter(F.array_sort(finite), lambda p: (p["down"] <= best * TAG_FLOOR) & (p["down"] < 0))
    return F.transform(F.slice(good, 1, MAX_TAGS), lambda p: F.get(vocabulary, p["at"]))


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    return store.join(new.select("source"), "source", "left_anti").unionByName(new)


def prune(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """Keeps only sources that are wanted."""
    return store.join(wanted.select("source"), "source", "left_semi")


def untagged_sources(files: DataFrame, store: DataFrame) -> DataFrame:
    """What a tagging run has still to look at."""
    return files.join(store.select("source"), "source", "left_anti")


def zero_shot(images: DataFrame, phrases: DataFrame) -> DataFrame:
    """source, tags: the phrases (pos, phrase, vector; a fixed vocabulary of at most some hundred rows) that fit an image's vector best."""
    listed = phrases.agg(F.array_sort(F.collect_list(F.struct("pos", "phrase", "vector"))).alias("p"))
    rows = images.crossJoin(F.broadcast(listed))  # one row
    scores = F.transform("p", lambda x: cosine(x["vector"], F.col("vector")))
    return rows.select("source", top_tags(F.transform("p", lambda x: x["phrase"]), scores).alias("tags"))


def in_batches(images: DataFrame, scorer, schema: str) -> DataFrame:
    """Runs a model over Arrow batches: scorer takes and yields pandas frames."""
    return images.mapInPandas(scorer, schema)
