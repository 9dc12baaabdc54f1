"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A piece of length l belongs to class k = capacity // l: its length lies in (capacity / (k + 1), capacity / k], so that any k
pieces of the class fit one sequence. Sequences of a class are filled with k pieces each, independently of other classes and by every worker
by itself: a worker numbers its pieces of a class, the class's pieces on workers before it (one small count for each worker and class) are
added, and number // k is the sequence, number % k the place in it. So only a class's last sequence can be short of pieces. Pieces stay where they are, each with the lengths
of those before it in its class; only sequences that two workers share are brought together.

A document longer than the capacity is cut into full pieces; what remains is cut again, at the largest capacity // k that it
holds, only where it would leave more than 1 / SLACK of its length unused in its class.

Defined results: null text is empty, and its document holds the end id alone. Repeated rows are packed each.
A null doc_id is carried along. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datewright.llm.common import gather, lookup, mapped, materialize, parts, per_row, pick, strings, words

CAPACITY = 4096
SLACK = 64
END_ID = 2
#: Words whose ids a worker keeps at most, at about 200 bytes each.
CACHE_WORDS = 100_000
#: Words whose ids are put together at once, if a text has no more.
PART_WORDS = 100_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words whose pieces can be told by their characters alone: printable ASCII but for the apostrophe, and the letters of Latin-1.
_PLAIN = "^[!-&(-~À-ÖØ-öø-ÿ]+$"
#: The tokenizer's own pieces of such words in lower case: runs of letters, single digits, runs of anything else. A space goes behind each.
_PIECES = "([a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+)"


_PLAIN_PIECE = re.compile("[!-&(-@\\[-~ß-öø-ÿ]+")


def _is_plain(piece: str) -> bool:
    return _PLAIN_PIECE.fullmatch(piece) is not None and "<|" not in piece


def _byte_alphabet() -> dict[int, int]:
    """Byte-level models write a printable byte of Latin-1 as itself, and the n-th of the others as character 256 + n."""
    others = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    return {b: 256 + n for n, b in enumerate(others)}


_ALPHABET = _byte_alphabet()


class WordIds:
    """Ids of words that white space separates, by a tokenizer that drops white space and case and never joins letters, digits and other characters.

    Words that fall into pieces plainly are encoded by their pieces, others as they are; each is encoded once as long as it is kept.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.lengths, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def ids_of(self, distinct: list[str]) -> list[list[int]]:
        """Plain pieces go straight to the model, as bytes in its alphabet; others through the whole tokenizer."""
        rest = [w for w in distinct if not _is_plain(w)]
        others = iter([e.ids for e in self.encode(rest, add_special_tokens=False)] if rest else [])
        kept = set(rest)
        return [next(others) if w in kept else [t.id for t in self.model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_ALPHABET))] for w in distinct]

    def places(self, distinct: list[str]) -> np.ndarray:
        new = [w for w in distinct if w not in self.place]
        if len(self.place) + len(new) > CACHE_WORDS:
            self.clear()
            new = distinct
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            found = self.ids_of(some)
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            first, n = len(self.place), int(lengths.sum())
            while first + len(some) > len(self.starts):
                self.starts, self.lengths = np.concatenate([self.starts, self.starts * 0]), np.concatenate([self.lengths, self.lengths * 0])
            while self.used + n > len(self.ids):
                self.ids = np.concatenate([self.ids, self.ids * 0])
            self.ids[self.used : self.used + n] = np.fromiter((i for x in found for i in x), np.uint32, n)
            self.starts[first : first + len(some)] = self.used + np.cumsum(lengths) - lengths
            self.lengths[first : first + len(some)] = lengths
            self.used += n
            self.place.update(zip(some, range(first, first + len(some)), strict=True))
        return np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))

    def pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pieces of each word, one word after the other, and offsets."""
        plain = pc.and_(pc.match_substring_regex(distinct, _PLAIN), pc.invert(pc.match_substring(distinct, "<|")))  # special tokens begin so
        split = pc.split_pattern(pc.utf8_rtrim(pc.replace_substring_regex(pc.utf8_lower(distinct), _PIECES, r"\1 "), " "), " ")
        whole = pa.ListArray.from_arrays(pa.array(np.arange(len(distinct) + 1), pa.int32()), distinct)
        chosen = pc.if_else(plain, split, whole)
        encoded = chosen.flatten().dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        lengths = pc.list_value_length(chosen).to_numpy(zero_copy_only=False).astype(np.int64)
        return self.places(encoded.dictionary.to_pylist())[codes], np.concatenate([[0], np.cumsum(lengths)])

    def of(self, text: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and offsets."""
        distinct, codes, offsets = words(text)
        piece, ends = self.pieces(distinct.cast(pa.string())) if len(distinct) else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        sizes, pool = np.diff(ends), self.ids[: self.used] if end_id is None else np.append(self.ids[: self.used], np.uint32(end_id))
        found, totals = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        at = 0
        while at + 1 < len(offsets):  # some texts at a time: indexes take many times the memory of ids
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART_WORDS, "right")) - 1)
            own, bounds = codes[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            n = sizes[own]
            place = piece[gather(ends[own], n)]
            bounds = np.concatenate([[0], np.cumsum(n)])[bounds]
            starts, lengths = self.starts[place], self.lengths[place]
            totals.append(per_row(lengths, bounds) + (end_id is not None))
            if end_id is not None:
                starts, lengths = np.insert(starts, bounds[1:], self.used), np.insert(lengths, bounds[1:], 1)
            found.append(pool[gather(starts, lengths)])
            at = to
        return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(totals))])


class WholeIds:
    """Ids of whole texts by any tokenizer."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer

    def of(self, text: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and offsets."""
        end = [] if end_id is None else [end_id]
        found = [e.ids + end for e in self.tokenizer.encode_batch(strings(text).to_pylist(), add_special_tokens=False)]
        return np.fromiter((i for x in found for i in x), np.uint32, sum(map(len, found))), np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])


#: Texts that a tokenizer must take as WordIds does, to be used through it: case, white space, contractions, digits, marks, bytes of other scripts, names of special tokens.
PROBE = ["", " A b\n\tC  d ", "It's WE'LL 'tis x'sx don't", "ab12c3 ½ ²", "(x) [y]{z} a-b_c --- ...!", "ÀÉÎ groß ß ÿ × ÷ a×b", "日本語 テ 😀a😀b Жук ﬁ", "<|endoftext|> <|", "\x00nul\x01 \x7f", "antidisestablishmentarianism " * 3]


def encoder(path: str) -> WordIds | WholeIds:
    """WordIds where it gives a tokenizer's own ids for PROBE: it does for those that drop case and white space and split words as the public word tokenizer does."""
    quick = WordIds(path)
    whole = WholeIds(quick.tokenizer)
    try:
        found = quick.of(pa.array(PROBE))
    except Exception:  # not a model that can be asked for single pieces
        return whole
    return quick if all(np.array_equal(a, b) for a, b in zip(found, whole.of(pa.array(PROBE)), strict=True)) else whole


def cut(lengths: np.ndarray, capacity: int = CAPACITY, slack: int = SLACK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of each piece, ordered by document and start."""
    full = lengths // capacity
    doc, place = parts(full)
    docs, starts, sizes = [doc], [place * capacity], [np.full(len(doc), capacity)]
    at, left = full * capacity, lengths - full * capacity
    who = np.flatnonzero(left)
    while len(who):
        rest = left[who]
        whole = (capacity // (capacity // rest) - rest) * slack <= rest
        size = np.where(whole, rest, capacity // -(-capacity // rest))
        docs, starts, sizes = [*docs, who], [*starts, at[who]], [*sizes, size]
        at[who] += size
        left[who] -= size
        who = who[left[who] > 0]
    doc, start, size = np.concatenate(docs), np.concatenate(starts), np.concatenate(sizes)
    order = np.lexsort((start, doc))
    return doc[order], start[order], size[order]


def numbered(classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each piece's number within its class after those that counts has; counts goes on."""
    order = np.argsort(classes, kind="stable")
    own = classes[order]
    first = np.searchsorted(own, own)
    number = np.empty(len(classes), np.int64)
    number[order] = counts[own] + np.arange(len(own)) - first
    counts += np.bincount(classes, minlength=len(counts))
    return number


class Ahead:
    """Of each piece of an uneven class the lengths of the pieces of its class before it, at most as many as a sequence has besides."""

    def __init__(self, most: int) -> None:
        self.most, self.tails = most, {}  # classes up to this one; by class, the last lengths

    def of(self, classes: np.ndarray, size: np.ndarray) -> pa.ListArray:
        starts, counts = np.zeros(len(classes), np.int64), np.zeros(len(classes), np.int64)
        held, base = [], 0
        order = np.argsort(classes, kind="stable")
        found, begin = np.unique(classes[order], return_index=True)
        for k, own in zip(found.tolist(), np.split(order, begin[1:]), strict=True):
            if k > self.most:
                break
            tail = self.tails.get(k, np.zeros(0, np.int64))
            lengths = np.concatenate([tail, size[own]])
            end = len(tail) + np.arange(len(own))
            counts[own] = np.minimum(k - 1, end)
            starts[own] = base + end - counts[own]
            held.append(lengths)
            base += len(lengths)
            self.tails[k] = lengths[max(0, len(lengths) - k + 1) :]
        values = np.concatenate(held) if held else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values[gather(starts, counts)].astype(np.int32)))


def uneven_classes(capacity: int) -> int:
    """Classes beyond this one hold pieces of one length each, so that a piece's place in its sequence tells its offset."""
    return math.isqrt(capacity) + 1


def _pieces(path: str | None, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, counts, ids_of = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(path or tokenizer_path())
        ahead = Ahead(uneven_classes(capacity))
        for batch in batches:
            ids, offsets = ids_of.of(batch.column("text"), end_id)
            lengths = np.diff(offsets)
            doc, start, size = cut(lengths, capacity)
            first = offsets[doc] + start
            classes = capacity // size
            columns = {"doc_id": batch.column("doc_id").cast(pa.int64()).take(pa.array(doc)), "start": pa.array(start), "length": pa.array(size), "doc_tokens": pa.array(lengths[doc]), "k": pa.array(classes), "part": pa.array(np.full(len(doc), part)), "number": pa.array(numbered(classes, counts)), "ahead": ahead.of(classes, size)}
            ends = np.append(4 * first, 4 * len(ids)).astype(np.int32)
            columns["ids"] = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4", copy=False))])
            yield pa.RecordBatch.from_pydict(columns)

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, k (its class), and ids (little-endian, unsigned, of 32 bits).

    Where ids aren't selected, they are read for their checksums but go no further. path: of the tokenizer's file on every worker; None: the public word tokenizer where it is installed.
    """
    pieces = materialize(mapped(pick(docs, "doc_id", "text"), _pieces(path, capacity, end_id), "doc_id long, start long, length long, doc_tokens long, k long, part long, number long, ahead array<int>, ids binary"), "pieces")
    counts = pieces.groupBy("k", "part").agg(F.count("*").alias("n"))
    before = materialize(counts.select("k", "part", "n", (F.sum("n").over(Window.partitionBy("k").orderBy("part")) - F.col("n")).alias("before")), "before")
    placed = lookup(pieces.withColumn("ids_crc32", F.crc32("ids")), before, ["k", "part"], "inner", before.count()).withColumn("number", F.col("number") + F.col("before"))
    sequence = F.floor(F.col("number") / F.col("k"))
    placed = placed.withColumn("sequence_id", F.col("k") * F.lit(1 << 40) + sequence)
    # a sequence that began on a worker before, or that goes on on one behind, is put together; in the others a piece knows what lies ahead of it
    first, last = F.floor(F.col("before") / F.col("k")), F.floor((F.col("before") + F.col("n")) / F.col("k"))
    apart = (F.col("k") <= uneven_classes(capacity)) & (((sequence == first) & (F.col("before") % F.col("k") != 0)) | (sequence == last))
    place = (F.col("number") % F.col("k")).cast("int")
    ahead = F.aggregate(F.slice("ahead", F.size("ahead") - place + 1, place), F.lit(0).cast("long"), lambda a, b: a + b)
    whole = placed.filter(~apart).withColumn("offset", F.when(F.col("k") > uneven_classes(capacity), place * F.col("length")).otherwise(ahead))
    up_to = Window.partitionBy("sequence_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.filter(apart).withColumn("offset", F.coalesce(F.sum("length").over(up_to), F.lit(0)))
    return whole.unionByName(joined).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.col("offset").cast("long").alias("offset"), "k", "ids")
