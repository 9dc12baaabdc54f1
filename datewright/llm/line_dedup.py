"""Line dedup: hashes of long lines, range-partitioned and streamed in order, give each document a bitmap of the lines to keep.

A block of a partition decides what it can by itself: where at least MIN_DOCS of its documents hold a key, all but the
one with the largest doc_id lose it, and one row stands for all in the shuffle. So a key sends at most MIN_DOCS - 1 rows a
block, however common it is. The rest is range-partitioned by hash and sorted by hash, then doc_id from the largest;
a stream over each partition drops the lines of all documents but the first of each key. Text isn't shuffled for that.

Defined results: null text is one empty line. Rows with the same doc_id and text are one document. Of different texts under
one doc_id, each is a document; as the largest doc_id, all of them keep their lines. A null doc_id is the smallest.
An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datewright.llm.common import gather, id_array, ids, mapped, materialize, parts, pick, sieved, strings

MIN_DOCS = 5
MIN_POINTS = 40
#: Lines with a long key that a block gathers before it is decided and sent: about 60 bytes each.
BLOCK_LINES = 1_000_000

SENT = "decided boolean, hi long, lo long, doc_id long, text_hash long, n_lines long, weight long, places array<int>"


def _lines(text: pa.Array) -> pa.ListArray:
    return pc.split_pattern(text, "\n")


def _keys(flat: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.utf8_trim(flat, " \t\n\x0b\x0c\r"))


def _grouped(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted columns begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values[gather(starts, lengths)], pa.int32()))


def _block(held: list[tuple[np.ndarray, ...]], min_docs: int) -> pa.RecordBatch:
    hi, lo, doc, text_hash, n_lines, place = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((place, text_hash, -1 - doc, lo, hi))  # -1 - doc turns the order round without overflow
    hi, lo, doc, text_hash, n_lines, place = (x[order] for x in (hi, lo, doc, text_hash, n_lines, place))
    new_key, new_doc = _grouped(hi, lo), _grouped(hi, lo, doc, text_hash)
    first = np.flatnonzero(new_doc)
    lengths = np.diff(np.append(first, len(hi)))
    key_of = np.cumsum(new_key[first]) - 1
    starts = np.flatnonzero(new_key[first])
    docs = np.bincount(key_of, minlength=len(starts)) if len(starts) else np.zeros(0, np.int64)
    largest = doc[first][starts][key_of] == doc[first] if len(starts) else np.zeros(0, bool)
    full = docs[key_of] >= min_docs if len(starts) else np.zeros(0, bool)
    weight = np.where(full & largest, min_docs, 1)
    return pa.RecordBatch.from_arrays(
        [pa.array(full & ~largest), pa.array(hi[first].view(np.int64)), pa.array(lo[first].view(np.int64)), pa.array(doc[first]), pa.array(text_hash[first]), pa.array(n_lines[first]), pa.array(weight, pa.int64()), _ragged(place, first, lengths)],
        ["decided", "hi", "lo", "doc_id", "text_hash", "n_lines", "weight", "places"],
    )


def _sent(min_docs: int, min_points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            split = _lines(strings(batch.column("text")))
            keys = _keys(split.flatten())
            long = np.flatnonzero(pc.utf8_length(keys).to_numpy() >= min_points)
            lengths = np.diff(split.offsets.to_numpy()).astype(np.int64)
            rows, place = parts(lengths)
            digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys.take(pa.array(long)).cast(pa.binary()).to_pylist())), ">u8").reshape(-1, 2).astype(np.uint64)
            rows, place = rows[long], place[long]
            held.append((digests[:, 0], digests[:, 1], ids(batch.column("doc_id"))[rows], batch.column("text_hash").to_numpy()[rows], lengths[rows], place))
            n += len(long)
            if n >= BLOCK_LINES:
                yield _block(held, min_docs)
                held, n = [], 0
        if n:
            yield _block(held, min_docs)

    return run


def _streamed(min_docs: int):
    """Over rows sorted by key, then doc_id from the largest: the places to drop. Of a key only its largest document and fewer than min_docs others are held at a time."""

    def decided(rows: pa.Table, last: bool) -> tuple[pa.Table, pa.Table]:
        """The rows that are lost; and unless it is the last, what the last key needs of its rows when more come."""
        hi, lo, doc, text_hash, weight = (rows[c].to_numpy() for c in ("hi", "lo", "doc_id", "text_hash", "weight"))
        new = _grouped(hi, lo)
        starts = np.flatnonzero(new)
        key = np.cumsum(new) - 1
        once = _grouped(hi, lo, doc, text_hash)  # a document that two blocks hold counts once
        weight = np.where(once | (weight > 1), weight, 0)
        full = (np.add.reduceat(weight, starts) >= min_docs)[key]
        others = doc != doc[starts][key]
        lost = rows.filter(pa.array(full & others))
        if last:
            return lost, rows.slice(0, 0)
        tail = slice(int(starts[-1]), None)
        if not full[-1]:
            return lost, rows.slice(tail.start).filter(pa.array(once[tail]))
        head = rows.slice(tail.start, 1)  # its key is in enough documents: the rest of its rows are decided by the largest alone
        return lost, head.set_column(head.schema.get_field_index("weight"), "weight", pa.array([min_docs], pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            lost, rest = decided(pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows, False)
            yield from lost.select(["doc_id", "text_hash", "n_lines", "places"]).combine_chunks().to_batches()
        if rest is not None and rest.num_rows:
            lost, _ = decided(rest, True)
            yield from lost.select(["doc_id", "text_hash", "n_lines", "places"]).combine_chunks().to_batches()

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, dropped = [], []
        for n, places in zip(batch.column("n_lines").to_pylist(), batch.column("places"), strict=True):
            keep = np.ones(n, bool)
            keep[places.values.to_numpy()] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
            dropped.append(int(n - keep.sum()))
        yield pa.RecordBatch.from_arrays([id_array(batch.column("doc_id").to_numpy()), batch.column("text_hash"), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], ["doc_id", "text_hash", "n_dropped", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_points: int = MIN_POINTS) -> DataFrame:
    """doc_id, text_hash, n_dropped, keep_bitmap (zlib of a bit a line) of every document that loses lines; the others keep all."""
    hashed = pick(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    sent = materialize(mapped(hashed, _sent(min_docs, min_points), SENT), "lines")
    shared = sent.filter("not decided").repartitionByRange("hi", "lo").sortWithinPartitions("hi", "lo", F.desc("doc_id"), "text_hash")
    lost = "doc_id long, text_hash long, n_lines long, places array<int>"
    drops = mapped(shared, _streamed(min_docs), lost).unionByName(sent.filter("decided").select("doc_id", "text_hash", "n_lines", "places"))
    by_doc = drops.groupBy("doc_id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_list("places")).alias("places"))
    return mapped(by_doc, _bitmaps, "doc_id long, text_hash long, n_dropped long, keep_bitmap binary")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, out = [], []
        for text, bitmap in zip(strings(batch.column("text")).to_pylist(), batch.column("keep_bitmap").to_pylist(), strict=True):
            n_lines.append(text.count("\n") + 1)
            if bitmap is not None:
                keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
                text = "\n".join(x for x, k in zip(text.split("\n"), keep, strict=False) if k)
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pc.fill_null(batch.column("n_dropped"), 0), pa.array(out, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_points: int = MIN_POINTS) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, text (of the lines that stay). Only texts that may lose lines are shuffled."""
    hashed = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    bitmaps = materialize(keep_bitmaps(docs, min_docs, min_points), "bitmaps")
    some, others = sieved(hashed, bitmaps.select("doc_id", "text_hash"), bitmaps.count())
    bitmaps = bitmaps.toDF("b_id", "b_hash", "n_dropped", "keep_bitmap")
    joined = some.join(bitmaps, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_hash") == F.col("b_hash")), "left").select("doc_id", "text", "n_dropped", "keep_bitmap")
    joined = joined.unionByName(others.select("doc_id", "text", F.lit(None).cast("long").alias("n_dropped"), F.lit(None).cast("binary").alias("keep_bitmap")))
    return mapped(joined, _applied, "doc_id long, n_lines long, n_dropped long, text string")


def line_dedup_digests(docs: DataFrame) -> DataFrame:
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))

