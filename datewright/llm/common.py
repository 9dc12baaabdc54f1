"""What the training-data operators share: column picking, shared-folder tables, Arrow text helpers, joins that survive hot keys."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of an Arrow batch at most: a worker holds some copies of one.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
#: A key is hot if it holds more than one in so many of the rows; so there are at most as many hot keys, and they can be broadcast.
HOT_KEYS = 10_000
#: Lookup tables of at most so many rows are broadcast; beyond that the join is shuffled.
BROADCAST_ROWS = 100_000
#: Words of 64 bits that a broadcast bitmap of keys has at most: 16 bytes each.
SIEVE_WORDS = 1 << 20
#: ASCII white space, as in the class [\\x20\\x09-\\x0D].
SPACE = b" \t\n\x0b\x0c\r"

_own: dict[str, str] = {}


def session(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches; the plans made afterwards use it."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, one of this machine if it runs all tasks, as in tests; else ValueError."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="llm-")
        base = _own["dir"]
    return f"{base.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def _clean(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended before the interpreter
        return


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage with a table in the shared folder: lost executors cost one stage. The tables go when the driver ends."""
    spark = df.sparkSession
    base = shared_dir(spark)
    if base not in _own:
        _own[base] = base
        atexit.register(_clean, spark, base)
    path = f"{base}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """These columns by their exact names, the first of a name; other columns may bear any names, in any case."""
    places = [df.columns.index(n) for n in names]
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"c{i}").alias(n) for i, n in zip(places, names, strict=True)])


def with_private(df: DataFrame) -> tuple[DataFrame, Callable[[str], Column], Callable[[DataFrame], DataFrame]]:
    """df under names that clash with nothing, a way to name its columns, and the way back to its own names."""
    names, own = df.columns, [f"__{i}" for i in range(len(df.columns))]

    def back(out: DataFrame) -> DataFrame:
        return out.select(*own).toDF(*names)

    return df.toDF(*own), lambda name: F.col(own[names.index(name)]), back


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str, rows: int) -> DataFrame:
    """left joined with a table of one row a key, without nulls in the keys. rows: of right, counted by the caller."""
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, keys, how)


def split_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """left outer join with a table of one row a key, where weight is the number of left's rows of that key.

    Keys of more than total / HOT_KEYS rows, at most HOT_KEYS of them, are broadcast, so that no task
    gets all rows of a hot key; the others are shuffled.
    """
    hot = F.broadcast(right.filter(F.col(weight) * HOT_KEYS > total))
    cold = right.filter(F.col(weight) * HOT_KEYS <= total)
    return left.join(hot, keys, "inner").unionByName(left.join(hot, keys, "left_anti").join(cold, keys, "left"))


def split_inner(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """The inner join, dealt in the same way."""
    hot = F.broadcast(right.filter(F.col(weight) * HOT_KEYS > total))
    cold = right.filter(F.col(weight) * HOT_KEYS <= total)
    return left.join(hot, keys).unionByName(left.join(hot, keys, "left_anti").join(cold, keys))


def sieved(left: DataFrame, keys: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """left's rows that may have a partner among keys (whose columns left has too), and those that have none, which need no shuffle for a join. rows: of keys, counted by the caller.

    What tells them apart is a bitmap of the keys' hashes, broadcast in at most SIEVE_WORDS rows of 64 bits, however many keys there are: with more keys than it has room for, more of left may have a partner.
    """
    size = min(SIEVE_WORDS, 1 << (rows // 4).bit_length())
    hashed = "xxhash64(" + ", ".join(f"`{c}`" for c in keys.columns) + ")"
    word, bit = F.expr(f"pmod({hashed}, {size}L)").alias("__word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({hashed}, 40) & 63L as int))").alias("__bit")
    bits = keys.select(word, bit).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    marked = left.select("*", word, bit).join(F.broadcast(bits), "__word", "left").withColumn("__may", F.coalesce(F.col("__bits").bitwiseAND(F.col("__bit")), F.lit(0)) != 0)
    return marked.filter("__may").select(*left.columns), marked.filter("not __may").select(*left.columns)


# Arrow and numpy


def _release() -> None:
    """Gives freed memory back: workers live on for other tasks, and share an executor's memory with its JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


class Releasing:
    """A mapInArrow function that leaves no freed memory with its worker."""

    def __init__(self, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> None:
        self.function = function

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if pa.default_memory_pool().backend_name != "system":
            pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from self.function(batches)
        finally:
            _release()


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    session(df.sparkSession)
    return df.mapInArrow(Releasing(function), schema)


def strings(column: pa.Array) -> pa.Array:
    """Null is empty."""
    return pc.fill_null(column.cast(pa.string()), "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its offsets, from 0."""
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset) if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets.astype(np.int64) - offsets[0]


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between the offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words [^\\x20\\x09-\\x0D]+ of a batch, each word's code in text order, and offsets by row."""
    split = pc.ascii_split_whitespace(strings(column))
    encoded = split.flatten().dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    lengths = np.diff(split.offsets.to_numpy())
    empty = pc.index(encoded.dictionary, "").as_py() if len(encoded.dictionary) else -1
    rows = np.repeat(np.arange(len(column)), lengths)
    if empty >= 0:
        kept = codes != empty
        codes, rows = codes[kept], rows[kept]
    return encoded.dictionary, codes.astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(column)))]).astype(np.int64)


def parts(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged rows of these lengths: the row of each element, and its place in the row."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    return rows, np.arange(len(rows)) - np.repeat(starts, lengths)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the elements of ragged rows, one row after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    out = np.repeat(starts - ends + lengths, lengths)
    out += np.arange(len(out))
    return out


def ids(column: pa.Array) -> np.ndarray:
    """doc_id as int64; null sorts first."""
    return pc.fill_null(column.cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def id_array(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == np.iinfo(np.int64).min)
