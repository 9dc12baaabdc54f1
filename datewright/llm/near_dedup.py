"""Near-duplicates by order min-hash, verified by banded alignment.

A text's k-mers are its windows of SHINGLE words, labelled by their occurrence in the text. For each of SKETCHES hash functions a text picks its MINIMA k-mers of
least hash and retains their order: two texts share that sketch only if they pick the same k-mers in the same order. Texts also send the sketches of their
different windows without the order, for passages that moved; short texts also send finer ones, in both ways. Texts of the same words are one from the start.

Of the texts that share a sketch, each is compared with the first and with the one before it, so a group of n copies makes 2 n pairs at most. Where a
sketch is left holding more than one class, all pairs of its texts are decided: a prefix-filter join over their windows, the rarest first, proposes every
pair of different classes that can be similar. So no pair that shares a sketch is lost. A pair of Jaccard similarity 0.8, whatever its order, shares a given
sketch without order with probability 0.8 ** 6 = 0.26; it shares none of 40 with probability 5e-6.

A candidate pair is verified on whole texts. A banded alignment lines up the occurrence-labelled windows of both in text order; the pair is linked where those that line up are SIMILARITY or
more of all windows of either. An alignment can't see passages that moved: where it finds less, the sets of different windows are compared, and the pair is linked at a Jaccard similarity of
SIMILARITY or more. Classes are the connected components of links.

Defined results: null text and text without words are linked with nothing but belong to themselves. Texts of fewer words than a window have one window, the
whole text. Rows with the same doc_id are one document: they share its class, and
if their texts differ only one of these is compared, so they need ids of their own first. A null doc_id counts as smaller than any other. An empty table gives an
empty table. Extra columns are ignored by near_duplicates(), and kept by deduplicated().
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datewright.llm.common import ids, mapped, materialize, parts, pick, sieved, split_inner, split_join, strings, with_private, words

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, MINIMA = 40, 6
#: Texts of at most so many windows also send so many sketches of two minima.
SHORT, SHORT_SKETCHES, SHORT_MINIMA = 40, 16, 2
#: Texts that share a sketch, up to which the first and the one before are all that there is to compare with.
SMALL = 3
#: Pairs of one text that a task verifies together.
SALT_ROWS = 500

NULL_ID = np.iinfo(np.int64).min
_ODD = [int(x) | 1 for x in np.random.default_rng(11).integers(1 << 62, 1 << 63, 64, dtype=np.int64)]
_XOR = [int(x) for x in np.random.default_rng(12).integers(0, 1 << 63, 64, dtype=np.int64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's windows in text order, and offsets."""
    distinct, codes, offsets = words(text)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))[codes] if len(distinct) else np.zeros(0, np.uint64)
    n = np.diff(offsets)
    lengths = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    rows, place = parts(lengths)
    first = offsets[:-1][rows] + place
    out = np.zeros(len(rows), np.uint64)
    for k in range(SHINGLE):
        inside = k < n[rows]
        out = _mix(out + np.where(inside, hashed[np.minimum(first + k, len(hashed) - 1)], np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) if len(hashed) else out
    return out, np.concatenate([[0], np.cumsum(lengths)])


def occurrences(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How often each value has come before in its row."""
    key = values + _mix(rows.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    own = key[order]
    same = own[1:] == own[:-1]
    again = np.zeros(len(own), bool)
    again[1:] |= same
    again[:-1] |= same
    out = np.zeros(len(values), np.int64)
    some = np.sort(order[again])  # few: only these need a stable order
    some = some[np.argsort(key[some], kind="stable")]
    k = key[some]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(start, len(k)))
    out[some] = parts(lengths)[1]
    return out


def labelled(values: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Windows labelled by how often they have come before: even where a window comes first in its row, odd where it comes again."""
    again = _mix(values + times.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    return np.where(times == 0, values & ~np.uint64(1), again)


def sketches(values: np.ndarray, offsets: np.ndarray, number: int, minima: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """number sketches of each row of values, with the order of minima and without; rows that are empty get zeros."""
    n = np.diff(offsets)
    rows = np.repeat(np.arange(len(n)), n)
    take = np.minimum(n, minima)
    # so few values of a row lie below the bound that they can be sorted; where too few do, all are
    share = np.minimum(1.0, (minima + 5 * np.sqrt(minima) + 8) / np.maximum(n, 1))
    bound = np.where(share >= 1, np.uint64(2**64 - 1), (share * 2.0**63).astype(np.uint64) * np.uint64(2))
    bounds = bound[rows]
    out, free = np.zeros((len(n), number), np.uint64), np.zeros((len(n), number), np.uint64)
    row_bits = max(1, int(len(n)).bit_length())
    for k in range(number):
        v = (values ^ np.uint64(_XOR[k] + salt)) * np.uint64(_ODD[k])
        low = np.flatnonzero(v <= bounds)
        short = np.flatnonzero(np.bincount(rows[low], minlength=len(n)) < take)
        if len(short):
            low = np.union1d(low, np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in short]))
        key = (rows[low].astype(np.uint64) << np.uint64(64 - row_bits)) | (v[low] >> np.uint64(row_bits))
        low = low[np.argsort(key)]
        counts = np.bincount(rows[low], minlength=len(n))
        chosen = np.sort(low[parts(counts)[1] < minima])
        place = parts(np.bincount(rows[chosen], minlength=len(n)))[1]
        mixed = _mix(values[chosen])
        parts_of = mixed * np.array([2 * j + 0x9E3779B97F4A7C15 for j in range(minima)], np.uint64)[place]
        full = np.flatnonzero(n)
        if len(full):
            starts = np.searchsorted(rows[chosen], full)
            own = np.uint64((k + 1) * 0x632BE59BD9B4E019 % 2**64)
            out[full, k] = _mix(np.add.reduceat(parts_of, starts) + own)
            free[full, k] = _mix(np.add.reduceat(mixed * np.uint64(0xC2B2AE3D27D4EB4F), starts) + own)
    return out.view(np.int64), free.view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = strings(batch.column("text"))
        plain = [b" ".join(x.split()) for x in text.cast(pa.binary()).to_pylist()]
        digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, plain)), ">i8").reshape(-1, 2).astype(np.int64)
        values, offsets = shingles(text)
        n = np.diff(offsets)
        rows = np.repeat(np.arange(len(n)), n)
        times = occurrences(values, rows)
        marked = _mix(labelled(values, times))
        first = times == 0
        kept = np.bincount(rows[first], minlength=len(n))
        plain_values = marked[first]
        # where no window repeats, those without the order come of the same minima
        a, free = sketches(marked, offsets, SKETCHES, MINIMA)
        repeating = np.flatnonzero(kept < n)
        b = np.zeros((len(n), 0), np.int64)
        if len(repeating):
            some = np.isin(np.repeat(np.arange(len(n)), kept), repeating)
            b = np.zeros_like(a)
            b[repeating], free[repeating] = sketches(plain_values[some], np.concatenate([[0], np.cumsum(kept[repeating])]), SKETCHES, MINIMA)
        small = np.flatnonzero((kept <= SHORT) & (kept > 0))
        c = np.zeros((len(n), 2 * SHORT_SKETCHES), np.int64)
        if len(small):
            some = np.isin(np.repeat(np.arange(len(n)), kept), small)
            c[small] = np.hstack(sketches(plain_values[some], np.concatenate([[0], np.cumsum(kept[small])]), SHORT_SKETCHES, SHORT_MINIMA, salt=1))
        twice, brief = set(repeating.tolist()), set(small.tolist())
        both = [np.concatenate([a[i], b[i], free[i]]) if i in twice else np.concatenate([a[i], free[i]]) if n[i] else a[i][:0] for i in range(len(n))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids(batch.column("doc_id"))), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(both, pa.list_(pa.int64())), pa.array([c[i] if i in brief else c[i][:0] for i in range(len(n))], pa.list_(pa.int64()))],
            ["doc_id", "d1", "d2", "sketches", "brief"],
        )


def _met(rows: DataFrame, key: list[str], total: int) -> DataFrame:
    """Of distinct rows of a key and an id, those whose key several ids have, with m (how many) and first (the smallest). Sizes are counted with a map-side combine; common keys are broadcast."""
    sizes = materialize(rows.groupBy(*key).agg(F.count("*").alias("m"), F.min("id").alias("first")).filter("m > 1"), "sizes")
    return split_inner(rows, sizes, key, "m", total)


def _neighbours(met: DataFrame, key: list[str]) -> DataFrame:
    """Distinct pairs a < b of ids that share a key: with the first, and with the one before, in parts of large groups. met: from _met()."""
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / SALT_ROWS))
    seen = met.withColumn("part", part).withColumn("before", F.lag("id").over(Window.partitionBy(*key, "part").orderBy("id")))
    pairs = seen.select(F.explode(F.array(F.struct(F.col("first").alias("a"), F.col("id").alias("b")), F.struct(F.col("before").alias("a"), F.col("id").alias("b")))).alias("p")).select("p.a", "p.b")
    return pairs.filter("a < b").distinct()


# All pairs of the texts whose sketches hold several classes


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's different windows, and how many they are; where windows repeat, also all of them with their labels, as another text that meets only such."""
    for batch in batches:
        values, offsets = shingles(batch.column("text"))
        n = np.diff(offsets)
        rows = np.repeat(np.arange(len(batch)), n)
        times = occurrences(values, rows)
        values, first = labelled(values, times), times == 0
        different = np.bincount(rows[first], minlength=len(batch))
        own = ids(batch.column("doc_id"))
        repeating = (different < n)[rows]
        for repeats, some, sizes, salt in ((False, first, different, 0), (True, repeating, n, 0x9E3779B97F4A7C15)):
            who, w = rows[some], (values[some] ^ np.uint64(salt)).view(np.int64)
            for at in range(0, len(who), 100_000):
                part = who[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(own[part]), pa.array([repeats] * len(part)), pa.array(sizes[part].astype(np.int64)), pa.array(w[at : at + 100_000])], ["id", "repeats", "size", "w"])


def _least(share: float):
    """The least whole number of windows that is this share of size, of a text or of two together."""
    return lambda size: F.ceil(size * F.lit(share) - F.lit(1e-9))


def possible_pairs(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct pairs a, b of members (id, comp) of different classes, all that are similar among them; of a and b, a is in more pairs.

    Texts are taken as their sets of different windows, and those with repeats once more as sets of labelled windows: an alignment can't line up more than these have in common.
    The first window that two similar texts share, in one order of all windows, lies so near the beginning of both that enough can follow: within
    1 - SIMILARITY of the longer text, and within a smaller part of the shorter one. So only the beginnings meet, and of those only a shorter with a longer text's.
    """
    chosen = members.select(F.col("id").alias("doc_id"))
    texts = sieved(docs, chosen, members.count())[0].join(chosen, "doc_id").select("doc_id", "text")
    windows = materialize(mapped(texts, _windows, "id long, repeats boolean, size long, w long"), "windows")
    total = windows.count()
    common = materialize(windows.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1"), "common")
    own = split_inner(windows, common, ["w"], "n", total).groupBy("id", "repeats", "size").agg(F.sort_array(F.collect_set(F.struct("n", "w"))).alias("rare"))
    # windows of one text only are the rarest and come first, but meet nothing
    size, alone = F.col("size"), F.col("size") - F.size("rare")
    ends = F.greatest(size - _least(SIMILARITY)(size) + 1 - alone, F.lit(0)).cast("int")
    begun = own.join(members, "id").select("id", "comp", "size", alone.alias("alone"), F.posexplode(F.slice("rare", F.lit(1), ends)).alias("at", "c"))
    left = F.col("size") - F.col("alone") - F.col("at")
    half = SIMILARITY / (1 + SIMILARITY)
    begun = materialize(begun.select(F.col("c.w").alias("w"), "id", "comp", "size", left.alias("left"), (left >= _least(2 * half)(size)).alias("short")), "begun")
    # the largest class of a window's texts needn't meet itself
    by_class = begun.groupBy("w", "comp").agg(F.count("*").alias("n"), F.count_if("short").alias("s"))
    groups = by_class.groupBy("w").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("classes"), F.max(F.struct("n", "s", "comp")).alias("main"))
    groups = materialize(groups.filter("classes > 1 and s > 0").drop("classes"), "groups")
    met = split_inner(begun, groups, ["w"], "n", begun.count()).withColumn("own", F.col("comp") == F.col("main.comp"))
    # kind 0: short texts of other classes with all; kind 1: those of the largest with others. Both sides are dealt in parts, and each part meets each
    sides = F.array(
        F.struct(F.lit(0).alias("kind"), (F.col("s") - F.col("main.s")).alias("ns"), F.col("n").alias("nl"), (F.col("short") & ~F.col("own")).alias("is_s"), F.lit(True).alias("is_l")),
        F.struct(F.lit(1).alias("kind"), F.col("main.s").alias("ns"), (F.col("n") - F.col("main.n")).alias("nl"), (F.col("short") & F.col("own")).alias("is_s"), (~F.col("own")).alias("is_l")),
    )
    met = met.select("w", "id", "comp", "size", "left", F.explode(sides).alias("side")).select("w", "id", "comp", "size", "left", "side.*").filter("ns > 0 and nl > 0")
    met = materialize(met.withColumn("ps", F.ceil(F.col("ns") / SALT_ROWS)).withColumn("pl", F.ceil(F.col("nl") / SALT_ROWS)), "met")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    key = ["w", "kind", "is", "il"]
    shorts = met.filter("is_s").select("w", "kind", dealt("ps").alias("is"), every("pl").alias("il"), F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("size").alias("sa"), F.col("left").alias("la"))
    longs = met.filter("is_l").select("w", "kind", every("ps").alias("is"), dealt("pl").alias("il"), F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("size").alias("sb"), F.col("left").alias("lb"))
    fits = (F.col("ca") != F.col("cb")) & ((F.col("sa") < F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b"))))
    fits &= (F.col("sa") >= _least(SIMILARITY)(F.col("sb"))) & (F.least("la", "lb") >= _least(half)(F.col("sa") + F.col("sb")))
    pairs = materialize(shorts.hint("merge").join(longs, key).filter(fits).select("a", "b").distinct(), "pairs")
    # the text with more partners is the one that is dealt in parts
    often = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n")), "often")
    found = pairs.count()
    both = split_inner(split_inner(pairs, often.toDF("a", "na"), ["a"], "na", found), often.toDF("b", "nb"), ["b"], "nb", found)
    more = F.col("nb") > F.col("na")
    return both.select(F.when(more, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(more, F.col("a")).otherwise(F.col("b")).alias("b"))


# Verification


def aligned(x: np.ndarray, y: np.ndarray) -> int:
    """Windows that an alignment of two texts lines up, within the band that SIMILARITY leaves; x and y: labelled windows in text order.

    The band loses no pair of SIMILARITY: windows that such an alignment lines up lie at most 1 - SIMILARITY of the longer text apart.
    """
    order = np.argsort(x)
    at = np.searchsorted(x, y, sorter=order)
    at[at == len(x)] = 0
    place = order[at]
    hit = np.flatnonzero(x[place] == y)
    place = place[hit]
    band = int((1 - SIMILARITY) * max(len(x), len(y))) + 1
    near = np.abs(place - hit) <= band
    place = place[near]
    if len(place) < 2 or (np.diff(place) > 0).all():
        return len(place)
    tails: list[int] = []  # the longest increasing chain
    for p in place.tolist():
        i = bisect_left(tails, p)
        if i == len(tails):
            tails.append(p)
        else:
            tails[i] = p
    return len(tails)


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Of two texts' labelled windows: the share that the alignment lines up if that is SIMILARITY or more, else the Jaccard similarity of the different windows; 0 where sizes rule out SIMILARITY."""
    small, large = sorted((len(x), len(y)))
    if small and small >= SIMILARITY * large - 1e-9:
        a = aligned(x, y)
        if a >= SIMILARITY * (small + large - a) - 1e-9:
            return a / (small + large - a)
    x, y = x[x % 2 == 0], y[y % 2 == 0]
    small, large = sorted((len(x), len(y)))
    if not small or small < SIMILARITY * large - 1e-9:
        return 0.0
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (small + large - common)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's labelled windows to each group that it is compared in."""
    for batch in batches:
        values, ends = shingles(batch.column("text"))
        n = np.diff(ends)
        kept = labelled(values, occurrences(values, np.repeat(np.arange(len(n)), n)))
        groups = batch.column("groups")
        lengths = pc.list_value_length(groups).to_numpy(zero_copy_only=False)
        flat = groups.flatten()
        for at in range(0, len(flat), 1000):  # a text that is compared in many groups goes out again for each
            who = np.repeat(np.arange(len(n)), lengths)[at : at + 1000]
            part = flat.slice(at, 1000)
            yield pa.RecordBatch.from_arrays([part.field("g"), part.field("s"), batch.column("doc_id").take(pa.array(who)), pa.array([kept[ends[i] : ends[i + 1]].tobytes() for i in who], pa.binary())], ["g", "s", "id", "windows"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, in which the text that the others are compared with comes first."""
    key, base = None, None
    for batch in batches:
        a, b, how = [], [], []
        for g, s, own, windows in zip(*(batch.column(c).to_pylist() for c in ("g", "s", "id", "windows")), strict=True):
            values = np.frombuffer(windows, np.uint64)
            if own == g:
                key, base = (g, s), values
            elif (g, s) == key:
                found = similarity(base, values)
                if found >= SIMILARITY - 1e-12:
                    a.append(g)
                    b.append(own)
                    how.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(how, pa.float64())], ["a", "b", "similarity"])


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the distinct pairs a, b whose texts are similar. docs: doc_id, text, at most one row a doc_id matters."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salts = F.ceil(F.col("n") / SALT_ROWS)
    # a text with many partners goes to several tasks, each with a part of them
    total = pairs.count()
    dealt = split_join(pairs, sizes, ["a"], "n", total).select(F.col("b").alias("id"), F.col("a").alias("g"), F.pmod(F.xxhash64("b"), salts).alias("s"))
    bases = sizes.select(F.col("a").alias("id"), F.col("a").alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("s"))
    roles = materialize(dealt.unionByName(bases).groupBy(F.col("id").alias("doc_id")).agg(F.collect_list(F.struct("g", "s")).alias("groups")), "roles")
    # merged at every size: roles grow with the corpus
    texts = sieved(docs, roles.select("doc_id"), roles.count())[0].join(roles.hint("merge"), "doc_id").select("doc_id", "text", "groups")
    sent = mapped(texts, _dealt, "g long, s long, id long, windows binary")
    sorted_ = sent.repartition("g", "s").sortWithinPartitions("g", "s", (F.col("id") == F.col("g")).cast("int").desc(), "id")
    return mapped(sorted_, _compared, "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """id and comp, the smallest id of its component, of every end of an edge. Rounds of smallest neighbours and shortcuts, each written out.

    Ends of many edges, and classes of many texts, are joined as hot keys.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    total = both.count()
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp"), F.count("*").alias("n")), "labels")
    found = labels.count()
    while True:
        near = split_inner(both, labels.withColumnRenamed("id", "b"), ["b"], "n", total).groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("other"))
        lower = materialize(labels.join(near, "id").select("id", "n", "comp", F.least("comp", "other").alias("to")), "lower")
        members = lower.groupBy("to").agg(F.count("*").alias("m"))
        roots = members.join(labels.select(F.col("id").alias("to"), F.col("comp").alias("root")), "to")
        moved = F.least("to", "root")
        new = materialize(split_join(lower, roots, ["to"], "m", found).select("id", "n", moved.alias("comp"), (moved < F.col("comp")).alias("moved")), "labels")
        labels = new.select("id", "n", "comp")
        if new.filter("moved").isEmpty():
            return labels.select("id", "comp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, class_id (the smallest doc_id of its class), text_id (the smallest doc_id of its very words), class_size, kept (it is its class's smallest)."""
    plain = pick(docs, "doc_id", "text").withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    sketched = materialize(mapped(plain, _sketched, "doc_id long, d1 long, d2 long, sketches array<long>, brief array<long>"), "sketched")
    rows = sketched.count()
    empty = F.size("sketches") == 0
    # texts of the same words; those without words stay alone
    same = ["d1", "d2", "alone"]
    keyed = sketched.withColumn("alone", F.when(empty, F.col("doc_id")).otherwise(F.lit(0)))
    texts = materialize(keyed.groupBy(*same).agg(F.min("doc_id").alias("text_id"), F.count("*").alias("n")), "texts")
    unique = keyed.filter(~empty).join(texts.select(*same, F.col("text_id").alias("doc_id")), [*same, "doc_id"], "left_semi")
    unique = materialize(unique.select(F.col("doc_id").alias("id"), "sketches", "brief").dropDuplicates(["id"]), "unique")

    total = 2 * SKETCHES * unique.count()
    # both families of a text can agree on a sketch; they lie in one row, so that needs no shuffle
    once = unique.select("id", F.explode(F.array_distinct(F.concat("sketches", "brief"))).alias("sk"))
    shared = materialize(_met(once, ["sk"], total), "shared")
    pairs = materialize(_neighbours(shared, ["sk"]), "pairs")
    links = materialize(verified(pairs, plain), "links")
    labels = components(links)

    # sketches that hold several classes still: a text and the sketch's first, which have been compared, lie apart. Up to SMALL texts have all been compared
    own = labels.toDF("a", "ca")
    firsts = pairs.groupBy("a").agg(F.count("*").alias("n")).join(own, "a", "left")
    classed = split_join(pairs, firsts, ["a"], "n", pairs.count()).join(labels.toDF("b", "cb"), "b", "left")
    apart = materialize(classed.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(F.col("a").alias("first"), F.col("b").alias("id")), "apart")
    large = shared.filter(F.col("m") > SMALL)
    mixed = materialize(large.join(apart, ["first", "id"], "left_semi").select("sk", "m").distinct(), "mixed")
    members = materialize(split_inner(large.select("id", "sk"), mixed, ["sk"], "m", total).select("id").distinct(), "mixed-texts")
    members = materialize(members.join(labels, "id", "left").select("id", F.coalesce("comp", "id").alias("comp")), "members")
    if not members.isEmpty():
        more = materialize(possible_pairs(members, plain), "pairs")
        if not more.isEmpty():
            labels = components(links.unionByName(verified(more, plain)))

    grouped = texts.join(labels.toDF("text_id", "comp"), "text_id", "left").withColumn("class_id", F.coalesce("comp", "text_id"))
    sizes = grouped.groupBy("class_id").agg(F.sum("n").alias("class_size"))
    grouped = materialize(split_join(grouped.select(*same, "text_id", "class_id", "n"), sizes, ["class_id"], "class_size", rows), "classes")
    out = split_join(keyed.select("doc_id", *same), grouped, same, "n", rows)
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return out.select(real("doc_id"), real("class_id"), real("text_id"), "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs, with all columns, but of each class the rows of its smallest doc_id only. Only rows that may go are shuffled."""
    rows, col, back = with_private(docs)
    gone = materialize(near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("id")).distinct(), "gone")
    some, others = sieved(rows.withColumn("id", col("doc_id").cast("long")), gone, gone.count())
    return back(some.join(gone.toDF("gone_id"), F.col("id").eqNullSafe(F.col("gone_id")), "left_anti").unionByName(others))
