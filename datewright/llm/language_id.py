"""Language ID: multinomial naive Bayes over hashed character n-grams.

A text's words, without anything but letters and in lower case, give n-grams of 1 to 4 characters, word ends included. The model is a matrix of
log-probabilities, a row a bucket and a column a language, of at most CELLS numbers, so that it can be broadcast: with more languages than 256 there are fewer buckets. A batch is scored sparsely: it is a matrix of
texts and distinct words, with how often each text has each word, times the words' rows of log-probabilities, which the n-grams of each distinct word add up to once; languages go through it LANGUAGES at a time.

Training takes labelled rows by a hash of doc_id, about TRAIN_ROWS of a language at most (all where there are fewer); every text is predicted as a whole.
More languages than MAX_LANGUAGES, some ten times as many as there are, are a ValueError: then lang doesn't hold languages.

Defined results: null text and text without a letter get `und` and score 0. Rows without lang or doc_id aren't learned from; a null doc_id isn't held out. If
nothing can be learned, all is `und`. Repeated rows count each. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datewright.llm.common import mapped, pick, with_private, words

BUCKETS, CELLS = 1 << 16, 1 << 24
#: Languages that a batch is scored by at a time.
LANGUAGES = 32
#: Distinct words whose n-grams are hashed at a time.
PART_WORDS = 1 << 14
ORDERS = (1, 2, 3, 4)
TRAIN_ROWS = 10_000
MAX_LANGUAGES = 1 << 16
SMOOTHING = 0.5
#: n-grams that count as evidence for the score at most: neighbouring n-grams say much the same.
EVIDENCE = 60
UNKNOWN = "und"

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def buckets_for(languages: int) -> int:
    """A power of two."""
    return min(BUCKETS, 1 << max(0, (CELLS // max(1, languages)).bit_length() - 1))


def grams(distinct: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the word (its index) and bucket of each n-gram, by word."""
    plain = pc.utf8_lower(pc.replace_substring_regex(distinct.cast(pa.string()), r"[^\p{L}]+", ""))
    points = np.frombuffer((" " + " ".join(plain.to_pylist()) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = points == 32
    word = np.cumsum(space) - 1  # a space belongs to the word behind it
    for n in ORDERS:
        if len(points) < n:
            continue
        m = len(points) - n + 1
        good = ~space[:m] if n == 1 else ~(space[:m] & space[1 : m + 1])
        for k in range(1, n - 1):
            good &= ~space[k : m + k]
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h + points[k : m + k]) * _MIX[k]
            h ^= h >> np.uint64(31)
        at = np.flatnonzero(good)
        yield word[at], (h[at] % np.uint64(buckets)).astype(np.int64)


def grams_by_word(distinct: pa.Array, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: the buckets of all n-grams, one word after the other, and offsets by word. Some words at a time: hashing takes many times the memory of the buckets."""
    kind, parts = np.min_scalar_type(buckets - 1), range(0, len(distinct), PART_WORDS)
    found = [[np.zeros(0, kind)] for _ in ORDERS]
    ends = [np.zeros(len(distinct) + 1, np.int64) for _ in ORDERS]
    for at in parts:
        some = distinct.slice(at, PART_WORDS)
        for i, (word, bucket) in enumerate(grams(some, buckets)):
            found[i].append(bucket.astype(kind))
            ends[i][at + 1 : at + 1 + len(some)] = np.bincount(word, minlength=len(some))
    return [(np.concatenate(b), np.cumsum(e)) for b, e in zip(found, ends, strict=True)]


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # BUCKETS rows, float32
    prior: np.ndarray


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, sums in total.items():
                full = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(full) + 1), pa.string()), pa.array(np.append(full, -1)), pa.array(np.append(sums[full], rows[lang]).astype(np.int64))], ["lang", "bucket", "n"])
            total.clear()
            rows.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in dict.fromkeys(langs):
                own = pa.array([i for i, x in enumerate(langs) if x == lang])
                distinct, codes, _ = words(batch.column("text").take(own))
                times = np.bincount(codes, minlength=len(distinct)).astype(np.float64)
                into = total.setdefault(lang, np.zeros(buckets))
                for word, bucket in grams(distinct, buckets):
                    into += np.bincount(bucket, weights=times[word], minlength=buckets)
                rows[lang] = rows.get(lang, 0) + len(own)
                if len(total) >= 256:  # what has been counted goes out: it is added up anyway
                    yield from out()
        yield from out()

    return run


def train(docs: DataFrame, usable: Column | None = None, most: int = TRAIN_ROWS) -> Model:
    """From doc_id, text, lang; usable: of which rows."""
    rows = pick(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    if usable is not None:
        rows = rows.filter(usable)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    buckets = buckets_for(len(sizes))
    share = F.broadcast(docs.sparkSession.createDataFrame([(lang, min(1.0, most / n)) for lang, n in sizes.items()], "lang string, share double"))  # MAX_LANGUAGES rows at most
    sample = rows.join(share, "lang").filter(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("text", "lang")
    sums = mapped(sample, _counted(buckets), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = sums.toArrow()  # a number for each language and bucket at most
    languages = sorted(set(table["lang"].to_pylist()))
    counts, seen = np.zeros((buckets, len(languages))), np.zeros(len(languages))
    column = np.searchsorted(np.array(languages, object), np.array(table["lang"].to_pylist(), object)) if languages else np.zeros(0, int)
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    counts[bucket[bucket >= 0], column[bucket >= 0]] = n[bucket >= 0]
    seen[column[bucket < 0]] = n[bucket < 0]
    counts += SMOOTHING
    return Model(languages, np.log(counts / counts.sum(0)).astype(np.float32), np.log(seen / seen.sum()))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros((len(offsets) - 1, values.shape[1]))
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def _times(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The matrix of texts and words without its zeros: the distinct words of each text, how often it has them, and offsets by text."""
    n = len(offsets) - 1
    key = np.sort((np.repeat(np.arange(n), np.diff(offsets)) << 32) | codes)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[: len(key)]
    return key[first] & 0xFFFFFFFF, np.diff(np.append(first, len(key))), np.searchsorted(key[first] >> 32, np.arange(n + 1))


def predict(text: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    distinct, codes, offsets = words(text)
    n, k, number = len(text), len(model.languages), len(distinct)
    if not k or not number:
        return [UNKNOWN] * n, np.zeros(n)
    word, times, ends = _times(codes, offsets)
    orders = grams_by_word(distinct, len(model.log_p))
    found = _sums(sum(np.diff(cuts) for _, cuts in orders)[word][:, None] * times[:, None].astype(float), ends)[:, 0]
    sums = np.empty((n, k))
    for at in range(0, k, LANGUAGES):
        some = np.ascontiguousarray(model.log_p[:, at : at + LANGUAGES])
        by_word = sum(_sums(some[bucket], cuts) for bucket, cuts in orders)
        sums[:, at : at + LANGUAGES] = _sums(by_word[word] * times[:, None], ends)
    logits = model.prior + sums * (np.minimum(found, EVIDENCE) / np.maximum(found, 1))[:, None]
    best = np.argmax(sums + model.prior, axis=1)
    odds = np.exp(logits - logits.max(1, keepdims=True))
    score = odds[np.arange(n), best] / odds.sum(1)
    return [model.languages[b] if f else UNKNOWN for b, f in zip(best, found, strict=True)], np.where(found > 0, score, 0.0)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score; of docs only text is looked at."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, score = predict(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return mapped(pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), run, "doc_id long, lang_pred string, score double")


def fold() -> Column:
    """crc32 of doc_id as text, mod 4; held out if 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, from a model of the documents that aren't held out."""
    model = train(docs, fold() != 2)
    return predicted(docs, model).select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, min_score: float = 0.0, languages: tuple[str, ...] | None = None, model: Model | None = None) -> DataFrame:
    """docs, with all columns, without those whose language is unknown, scored below min_score, or not among languages. Without a model, one of all labelled rows."""
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, col, back = with_private(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, score = predict(batch.column("__text"), shared.value)
            good = [x != UNKNOWN and s >= min_score and (languages is None or x in languages) for x, s in zip(found, score, strict=True)]
            yield batch.drop_columns(["__text"]).filter(pa.array(good, pa.bool_()))

    return back(mapped(rows.withColumn("__text", col("text").cast("string")), run, rows.schema))
