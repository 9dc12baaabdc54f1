"""Suffix-array dedup: every byte that lies in a string of LENGTH bytes which also starts in a document with a smaller doc_id is removed.

Documents are gathered into shards of some megabytes. A string's anchor is its 16-byte piece of least hash; equal strings have equal anchors at equal places, so a string can recur only
where its anchor does.

1. Each shard sends the sorted hashes of its anchors to lanes (ranges of hashes); a lane finds by binary search which of them another shard has too, and answers with a bitmap.
2. Each shard builds the suffix array of those of its bytes whose anchors recur, by Larsson-Sadakane refinement to twice 32 bytes: suffixes are sorted by 8 bytes, then groups that aren't sorted yet by the ranks of
   the suffixes 8, 16 and 32 bytes on. Common prefixes of neighbours follow Kasai: where a suffix's neighbour is the one behind the previous suffix's neighbour, the prefix is one
   shorter, and the others are compared directly. Neighbours with LENGTH bytes in common form a class, which all documents but its smallest lose.
3. What is left for the other shards, the strings of each class's smallest document, goes to lanes by anchor, as runs of text that bear the anchor. A lane unites the runs that are the same, byte by byte; only of
   anchors around which runs differ, each string is looked up by binary search among the sorted strings of all shards. The answer is a bitmap.
4. Runs whose anchor lies in more than HOT_SHARDS shards go up a tree of shards: a node does what a lane does for about FAN_IN shards, and of the runs that are the same only the smallest document's goes
   on to the next node, if it has a string left. So a passage that lies in every shard meets about FAN_IN of its own kind at a time.

So text stays with its shard, which is read again for each step, and no task gets all that a common passage occurs in. A shard's messages are as many as the lanes it has anything for, at most as many as its anchors.

Defined results: null text is empty. A null doc_id is smaller than any other. Rows with the same doc_id don't remove anything from each other. A shard holds a longer document whole: a worker needs about 80 times the bytes of its
largest document. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datewright.llm.common import gather, id_array, ids, mapped, materialize, parts, pick, raw, strings

LENGTH = 50
PIECE = 16
SHARD_BYTES = 2_000_000
#: Bytes of text whose anchors a lane gets.
LANE_BYTES = 8_000_000
#: An anchor in more shards is hot: its runs go up a tree, of which a node gets about so many shards.
HOT_SHARDS = FAN_IN = 64

_SHARD = "shard long, docs binary, ends binary, text binary"
_U = np.uint64


#: One of each a worker: shards and lanes have many small messages for each other.
_COMPRESSOR, _DECOMPRESSOR = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(x: np.ndarray) -> bytes:
    return _COMPRESSOR.compress(x.tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(_DECOMPRESSOR.decompress(x), kind)


def _shards(most: int):
    """Documents gathered into shards of at least so many bytes, or what a task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        docs: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        texts: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            ends = np.cumsum(np.concatenate(sizes))
            row = ((task << 32) + number, np.concatenate(docs).tobytes(), ends.tobytes(), _pack(np.concatenate(texts)))
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], ["shard", "docs", "ends", "text"])

        for batch in batches:
            own = ids(batch.column("doc_id"))
            data, offsets = raw(strings(batch.column("text")))
            at = 0
            while at < len(own):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most - held, "right")) - 1)
                docs, sizes, texts = [*docs, own[at:to]], [*sizes, np.diff(offsets[at : to + 1])], [*texts, data[offsets[at] : offsets[to]]]
                held += int(offsets[to] - offsets[at])
                at = to
                if held >= most or at < len(own):
                    yield out()
                    docs, sizes, texts, held, number = [], [], [], 0, number + 1
        if docs:
            yield out()

    return run


class Shard:
    """A shard's bytes, its strings (windows) and their anchors."""

    def __init__(self, docs: bytes, ends: bytes, text: bytes, length: int) -> None:
        self.docs, self.ends, self.length = np.frombuffer(docs, np.int64), np.frombuffer(ends, np.int64), length
        self.data = _unpack(text, np.uint8)
        self.starts = self.ends - np.diff(self.ends, prepend=0)
        n = self.n = len(self.data)
        self.padded = np.concatenate([self.data, np.zeros(128 + PIECE, np.uint8)])
        counts = np.maximum(0, self.ends - self.starts - length + 1)
        edge = np.zeros(n + 1, np.int8)  # 1 where the last bytes of a document begin, at which no string starts
        np.add.at(edge, self.starts + counts, 1)
        np.add.at(edge, self.ends, -1)
        self.fits = np.cumsum(edge[:n], dtype=np.int8) == 0
        self.windows = np.flatnonzero(self.fits)  # where they start
        self.doc = np.repeat(self.docs, counts)

    def anchors(self, lanes: int) -> None:
        """For each window its segment, windows of one anchor that follow each other; for each segment its key, the lane in the upper half."""
        n = self.n
        word = self.words(n + PIECE)
        h = np.zeros(n, np.uint64)
        for o in range(0, PIECE, 8):
            h = _mixed(h, word[o : o + n])
        h *= _U(0xD6E8FEB86659FD93)
        bits = _U(max(24, n.bit_length()))
        least = ((h >> bits) << bits) | np.arange(n, dtype=np.uint64)
        span, width = self.length - PIECE + 1, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0]
            width *= 2
        least = np.minimum(least[: max(0, len(least) - span + width)], least[span - width :]) if len(least) > span - width else least[:0]
        anchor = (least[self.fits[: len(least)]] & ((_U(1) << bits) - _U(1))).astype(np.int64)
        change = np.ones(len(anchor), bool)
        change[1:] = anchor[1:] != anchor[:-1]
        self.segment = np.cumsum(change, dtype=np.int32) - np.int32(1)
        self.anchor = anchor[change]
        # anchors have the least of hashes: mixed again, their keys spread over the lanes
        key = h[anchor[change]] * _U(0x9E3779B97F4A7C15)
        key = (key ^ (key >> _U(32))) * _U(0xC2B2AE3D27D4EB4F)
        self.lane = ((key >> _U(32)) * _U(lanes) >> _U(32)).astype(np.int64)
        # half a key is enough within a lane: a chance equal costs work, no bytes
        self.key = (self.lane.astype(np.uint64) << _U(32)) | (key & _U(0xFFFFFFFF))

    def words(self, n: int, kind: str = "<u8") -> np.ndarray:
        """The eight bytes at each of the first n places, as a view."""
        return np.ndarray((n,), kind, self.padded.data, 0, (1,))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, sorted, and how often each occurs."""
        own = np.sort(self.key)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        return own[first], np.diff(np.append(first, len(own)))


def _rows_of(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[dict, Shard]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            shard = Shard(row.pop("docs"), row.pop("ends"), row.pop("text"), length)
            yield row, shard


def _asked(lanes: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, shard in _rows_of(batches, length):
            shard.anchors(lanes)
            keys, _ = shard.keys()
            full, begin = np.unique((keys >> _U(32)).astype(np.int64), return_index=True)
            half, end = keys.astype(np.uint32), np.append(begin, len(keys))[1:]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([row["shard"]] * len(full), pa.int64()), pa.array([half[i:j].tobytes() for i, j in zip(begin, end, strict=True)], pa.binary())], ["lane", "shard", "keys"])

    return run


def _bits(lane: int, shards: list[int], answers: list[bytes]) -> pa.Table:
    return pa.table({"lane": pa.array([lane] * len(shards), pa.int64()), "shard": pa.array(shards, pa.int64()), "bits": pa.array(answers, pa.binary())})


def _recurring(most: int):
    """Which of each shard's sorted keys another shard has; then, if there are any, which of them more than so many have."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
        every = np.sort(np.concatenate(lists))
        begin = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        times = np.diff(np.append(begin, len(every)))
        known = every[begin]
        answers = []
        for own in lists:
            n = times[np.searchsorted(known, own)]
            hot = n > most
            answers.append(np.packbits(n > 1).tobytes() + (np.packbits(hot).tobytes() if hot.any() else b""))
        return _bits(key[0].as_py(), table["shard"].to_pylist(), answers)

    return run


def _unpacked(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _answers(found: list[dict] | None, lanes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the second bitmaps of these lanes, one after the other; sizes: what each was asked."""
    by_lane = {x["lane"]: x["bits"] for x in found or []}
    first, second = [np.zeros(0, bool)], [np.zeros(0, bool)]
    for lane, n in zip(lanes.tolist(), sizes.tolist(), strict=True):
        bits, half = by_lane.get(lane, b""), -(-n // 8)
        first.append(_unpacked(bits[:half], n) if bits else np.zeros(n, bool))
        second.append(_unpacked(bits[half:], n) if len(bits) > half else np.zeros(n, bool))
    return np.concatenate(first), np.concatenate(second)


def suffix_array(data: np.ndarray, places: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The suffixes at these places (ascending), sorted by their first 64 bytes; words: the eight bytes at each place, big-endian.

    Larsson-Sadakane: a suffix's rank is where its group begins; groups of more than one are refined by the rank of the suffix 8, 16, 32 bytes on. What lies beyond the places counts as least.
    """
    n = len(places)
    index = np.full(len(data) + 64, -1, np.int32)
    index[places] = np.arange(n, dtype=np.int32)
    order = np.argsort(words)
    rank = np.zeros(n + 1, np.uint32)  # the last stands for places beyond

    def regroup(slots: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Ranks of the suffixes in these slots of order, whose groups begin where new is true; those of groups that aren't sorted."""
        begin = np.flatnonzero(new)
        sizes = np.diff(np.append(begin, len(slots)))
        rank[order[slots]] = np.repeat(slots[begin], sizes) + 1
        return slots[np.repeat(sizes > 1, sizes)]

    own = words[order]
    open_ = regroup(np.arange(n), np.concatenate([[True], own[1:] != own[:-1]]) if n else np.zeros(0, bool))
    for h in (8, 16, 32):
        if not len(open_):
            break
        suffix = order[open_]
        key = (rank[suffix].astype(np.uint64) << _U(32)) | rank[index[places[suffix] + h]]
        by = np.argsort(key)
        order[open_] = suffix[by]
        key = key[by]
        open_ = regroup(open_, np.concatenate([[True], key[1:] != key[:-1]]))
    return order


def _common(word: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Bytes in common from a and b on, at most so many; word: the eight bytes at each place, little-endian."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    step = 0
    while len(live) and step < most:
        x = word[a[live] + step] ^ word[b[live] + step]
        differ = x != 0
        ended = live[differ]
        if len(ended):
            low = x[differ] & (~x[differ] + _U(1))
            out[ended] = step + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live = live[~differ]
        step += 8
        limit = len(word) - 8 - step
        over = (a[live] > limit) | (b[live] > limit)
        out[live[over]] = step
        live = live[~over]
    out[live] = step
    return np.minimum(out, most)


def common_prefixes(word: np.ndarray, places: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For suffixes (at ascending places) in sorted order: the bytes each has in common with the one before, exact up to length; 0 for the first.

    Kasai: in text order, a suffix whose neighbour is the one behind its predecessor's neighbour has one byte less in common; only the others are compared.
    """
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    text_order = np.delete(slot, order[0])  # the first has none before it
    at = places[order]
    p, q = at[text_order], at[text_order - 1]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1)
    begin = np.flatnonzero(fresh)
    run = np.diff(np.append(begin, len(p)))
    # a beginning is compared as far as the run behind it needs
    known = _common(word, p[begin], q[begin], length)
    far = np.flatnonzero((known >= length) & (run > 1))
    known[far] = _common(word, p[begin[far]], q[begin[far]], int(length + run[far].max(initial=0)))
    value = np.repeat(known, run) - (np.arange(len(p)) - np.repeat(begin, run))
    doubt = np.flatnonzero(~fresh & (value < 1))
    value[doubt] = _common(word, p[doubt], q[doubt], length)
    out[text_order] = value
    return out


def classes(shard: Shard, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each hot window (by its number among the shard's windows), and the class's smallest doc."""
    starts = shard.windows[hot]
    cover = np.zeros(shard.n + 1, np.int32)
    cover[starts] += 1  # each place once
    cover[starts + shard.length] -= 1
    places = np.flatnonzero(np.cumsum(cover[:-1], dtype=np.int32) > 0)
    order = suffix_array(shard.data, places, shard.words(shard.n, ">u8")[places].astype(np.uint64))
    number = np.full(shard.n, -1, np.int32)
    number[starts] = np.arange(len(hot), dtype=np.int32)
    sorted_ = number[places][order]
    sorted_ = sorted_[sorted_ >= 0].astype(np.int64)
    prefix = common_prefixes(shard.words(shard.n + 64), starts, sorted_, shard.length)
    new = prefix < shard.length
    new[:1] = True
    begin = np.flatnonzero(new)
    least = np.minimum.reduceat(shard.doc[hot][sorted_], begin) if len(begin) else np.zeros(0, np.int64)
    number = np.empty(len(hot), np.int64)
    number[sorted_] = np.cumsum(new) - 1
    return number, least[number]


def _blob(*arrays: np.ndarray) -> bytes:
    return _framed([x.tobytes() for x in arrays])


def _framed(parts: list[bytes]) -> bytes:
    """Arrays after each other, compressed; their bytes' lengths come first."""
    return _COMPRESSOR.compress(b"".join([struct.pack(f"<q{len(parts)}q", len(parts), *map(len, parts)), *parts]))


def _unblob(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = _DECOMPRESSOR.decompress(blob)
    (n,) = struct.unpack_from("<q", data)
    ends = list(accumulate(struct.unpack_from(f"<{n}q", data, 8), initial=8 + 8 * n))
    return [np.frombuffer(data[a:b], kind) for a, b, kind in zip(ends[:-1], ends[1:], kinds, strict=True)]


def _mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * _U(0x9E3779B97F4A7C15)
    return h ^ (h >> _U(29))


def _resolved(lanes: int, length: int, groups: int):
    """Per shard: what it can decide by itself, and what it asks of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, shard in _rows_of(batches, length):
            shard.anchors(lanes)
            keys, times = shard.keys()
            elsewhere, common = _answers(row["found"], *np.unique((keys >> _U(32)).astype(np.int64), return_counts=True))
            place = np.searchsorted(keys, shard.key)
            elsewhere, common = elsewhere[place], common[place]
            recurs = np.flatnonzero((elsewhere | (times[place] > 1))[shard.segment]) if len(place) else np.zeros(0, np.int64)
            number, least = classes(shard, recurs) if len(recurs) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            gone = np.zeros(len(shard.windows), bool)
            gone[recurs] = least < shard.doc[recurs]
            asks = np.flatnonzero((least == shard.doc[recurs]) & elsewhere[shard.segment[recurs]])
            # of a string that its document has several times, the first asks for all
            leader = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
            leader[number[asks[::-1]]] = asks[::-1]
            leader = leader[number[asks]]
            follows = asks != leader
            followers, leaders, asks = recurs[asks[follows]], recurs[leader[follows]], recurs[asks[~follows]]
            # hot anchors have lanes of their own, behind the others: one for each group of shards
            lane_of = np.where(common, lanes + shard.lane * groups + row["shard"] % 1_000_003 % groups, shard.lane)[shard.segment[asks]]
            order = np.argsort(lane_of, kind="stable")
            asks, lane_of = asks[order], lane_of[order]  # by lane, then place: steps are mostly 1
            full, begin, sizes = np.unique(lane_of, return_index=True, return_counts=True)
            # the shard's own state goes the same way, as a group of its own
            out: list[tuple[int, bytes]] = [(-1 - row["shard"], _blob(np.packbits(gone), full, sizes, np.diff(asks, prepend=0).astype(np.int32), np.diff(followers, prepend=0).astype(np.int32), np.diff(leaders, prepend=0).astype(np.int32)))]
            # runs of all lanes at once, as lanes are many: a lane's begin with a segment of its own
            at, segment = shard.windows[asks], shard.segment[asks]
            start = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (segment[1:] != segment[:-1])])[: len(asks)])
            run_size = np.diff(np.append(start, len(asks)))
            at, span = at[start], run_size + length - 1
            heads = [(2, run_size.astype("<u2").tobytes()), (2, (shard.anchor[segment[start]] - at).astype("<u2").tobytes()), (8, shard.doc[asks[start]].tobytes())]
            numbers = [(8, np.full(len(start), row["shard"]).tobytes()), (8, start.tobytes())]
            cuts = np.searchsorted(start, np.append(begin, len(asks))).tolist()
            for lane, i, j in zip(full.tolist(), cuts[:-1], cuts[1:], strict=True):
                text = shard.data[gather(at[i:j], span[i:j])].tobytes()
                out.append((lane, _framed([*(x[n * i : n * j] for n, x in heads), text, *(x[n * i : n * j] for n, x in (numbers if lane >= lanes else []))])))
                if len(out) >= 256:
                    yield _sent(row["shard"], out)
                    out = []
            yield _sent(row["shard"], out)

    return run


def _sent(shard: int, out: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([shard] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["lane", "shard", "blob"])


def _offsets(length: int) -> list[int]:
    """Where words of eight bytes begin that cover so many bytes."""
    return [*range(0, length - 8, 8), length - 8]


def _least_docs(word: np.ndarray, place: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For the string at each place, the smallest doc of an equal one: looked up by binary search among the sorted hashes of all, and confirmed by its bytes."""
    h = np.zeros(len(place), np.uint64)
    for o in _offsets(length):
        h = _mixed(h, word[place + o])
    order = np.argsort(h)
    begin = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]]))
    known, first = h[order[begin]], place[order[begin]]
    found = np.searchsorted(known, h)
    if all((word[place + o] == word[first[found] + o]).all() for o in _offsets(length)):
        return np.minimum.reduceat(doc[order], begin)[found]
    # different strings of one hash: sort by bytes
    order = np.lexsort([word[place + o] for o in reversed(_offsets(length))])
    at, new = place[order], np.zeros(len(order), bool)
    new[0] = True
    for o in _offsets(length):
        new[1:] |= word[at[1:] + o] != word[at[:-1] + o]
    begin = np.flatnonzero(new)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(doc[order], begin), np.diff(np.append(begin, len(order))))
    return out


def _united(read: list[list[np.ndarray]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of text from all shards: which of their strings a smaller document has; which runs are the smallest document's of those that are the same; where each run's text begins, and the text."""
    size, anchor, doc = (np.concatenate([r[i] for r in read]).astype(np.int64) for i in range(3))
    span = size + length - 1
    start = np.cumsum(span) - span
    padded = np.concatenate([*(r[3] for r in read), np.zeros(64, np.uint8)])
    word = np.ndarray((len(padded) - 8,), "<u8", padded.data, 0, (1,))  # a view: only what is asked for is copied
    offsets = _offsets(int(span.max()))
    # runs that are the same, byte by byte, are one class
    h = span.astype(np.uint64)
    for o in offsets:
        h = _mixed(h, word[start + np.minimum(o, span - 8)])
    order = np.argsort(h)
    a, b = order[1:], order[:-1]
    same = np.flatnonzero((h[a] == h[b]) & (span[a] == span[b]))
    for o in offsets:
        x, y = a[same], b[same]
        same = same[word[start[x] + np.minimum(o, span[x] - 8)] == word[start[y] + np.minimum(o, span[y] - 8)]]
    new = np.ones(len(order), bool)
    new[same + 1] = False
    begin = np.flatnonzero(new)
    class_of = np.empty(len(order), np.int64)
    class_of[order] = np.cumsum(new) - 1
    first, least = order[begin], np.minimum.reduceat(doc[order], begin)
    # where several classes have one anchor, their strings are compared
    at = start[first] + anchor[first]
    key = _mixed(_mixed(np.zeros(len(at), np.uint64), word[at]), word[at + 8])
    by = np.argsort(key)
    alone = np.ones(len(key) + 1, bool)
    alone[1:-1] = key[by[1:]] != key[by[:-1]]
    several = np.zeros(len(key), bool)
    several[by] = ~(alone[1:] & alone[:-1])
    least_of = np.repeat(least[class_of], size)
    if several.any():
        some = np.flatnonzero(several)
        n = size[first[some]]
        docs = _least_docs(word, gather(start[first[some]], n), np.repeat(least[some], n), length)
        at = np.zeros(len(key), np.int64)
        at[some] = np.cumsum(n) - n
        runs = np.flatnonzero(several[class_of])
        ends = np.cumsum(size)
        least_of[gather(ends[runs] - size[runs], size[runs])] = docs[gather(at[class_of[runs]], size[runs])]
    return least_of < np.repeat(doc, size), least[class_of] == doc, start, padded


def _cold(blobs: list[bytes], length: int) -> list[bytes]:
    """A lane's answers, a bitmap for each shard."""
    read = [_unblob(b, "<u2", "<u2", "<i8", "u1") for b in blobs]
    lost = _united(read, length)[0]
    cuts = np.cumsum([int(r[0].sum(dtype=np.int64)) for r in read])[:-1]
    return [np.packbits(x).tobytes() for x in np.split(lost, cuts)]


def _climbed(blobs: list[bytes], length: int) -> tuple[bytes, dict[int, bytes]]:
    """What a node sends on: of runs that are the same the smallest document's, if it has a string that isn't lost; and by shard, the numbers of the strings that are lost."""
    read = [_unblob(b, "<u2", "<u2", "<i8", "u1", "<i8", "<i8") for b in blobs]
    lost, smallest, start, text = _united(read, length)
    size, anchor, doc, shard, at = (np.concatenate([r[i] for r in read]) for i in (0, 1, 2, 4, 5))
    size = size.astype(np.int64)
    row, place = parts(size)
    gone, number = shard[row[lost]], (at[row] + place)[lost]
    order = np.argsort(gone, kind="stable")
    full, begin = np.unique(gone[order], return_index=True)
    answers = {s: _pack(x) for s, x in zip(full.tolist(), np.split(number[order], begin[1:]), strict=True)} if len(full) else {}
    left = np.bincount(row[~lost], minlength=len(size)) > 0
    on = np.flatnonzero(smallest & left)
    return _blob(size[on].astype("<u2"), anchor[on], doc[on], text[gather(start[on], size[on] + length - 1)], shard[on], at[on]), answers


#: lane: of what was asked, or HOT, whose bits are numbers of strings; null for a shard's state. up: where a node's runs go on to.
HOT = -1
_MERGED = "lane long, shard long, bits binary, up long"


def _merged(lanes: int, length: int, groups: int, fan: int):
    """What a lane, or a node of a hot lane's tree, answers."""

    def table_of(lane: list, shard: list, bits: list, up: list) -> pa.Table:
        return pa.table({"lane": pa.array(lane, pa.int64()), "shard": pa.array(shard, pa.int64()), "bits": pa.array(bits, pa.binary()), "up": pa.array(up, pa.int64())})

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lane, shards, blobs = key[0].as_py(), table["shard"].to_pylist(), table["blob"].to_pylist()
        n = len(shards)
        if lane < 0:
            return table_of([None] * n, shards, blobs, [None] * n)
        if lane < lanes:
            return table_of([lane] * n, shards, _cold(blobs, length), [None] * n)
        runs, lost = _climbed(blobs, length)
        out = table_of([HOT] * len(lost), list(lost), list(lost.values()), [None] * len(lost))
        if groups > 1:
            hot, group = divmod(lane - lanes, groups)
            out = pa.concat_tables([out, table_of([None], [None], [runs], [lanes + hot * -(-groups // fan) + group // fan])])
        return out

    return run


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, shard in _rows_of(batches, length):
            bits, full, sizes, steps, followers, leaders = _unblob(row["state"], "u1", "<i8", "<i8", "<i4", "<i4", "<i4")
            gone = np.unpackbits(bits, count=len(shard.windows)).astype(bool)
            asks = np.cumsum(steps, dtype=np.int64)
            gone[asks] |= _answers([x for x in row["found"] or [] if x["lane"] != HOT], full, sizes)[0]
            for x in row["found"] or []:
                if x["lane"] == HOT:
                    gone[asks[_unpack(x["bits"], "<i8")]] = True
            gone[np.cumsum(followers, dtype=np.int64)] |= gone[np.cumsum(leaders, dtype=np.int64)]
            edge = np.zeros(shard.n + 1, np.int32)
            at = shard.windows[gone]
            edge[at] += 1  # each place once
            edge[at + length] -= 1
            lost = np.cumsum(edge[:-1]) > 0
            start = lost.copy()
            start[1:] &= ~lost[:-1]
            stop = lost.copy()
            stop[:-1] &= ~lost[1:]
            inner = shard.starts[1:]
            inner = inner[(inner > 0) & (inner < shard.n)]
            start[inner] = lost[inner]  # runs end with their document
            stop[inner - 1] = lost[inner - 1]
            a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
            cuts = np.searchsorted(a, np.append(shard.starts, shard.n)) if len(shard.starts) else np.zeros(1, np.int64)
            kept = [shard.data[s:e][~lost[s:e]].tobytes() for s, e in zip(shard.starts.tolist(), shard.ends.tolist(), strict=True)]
            row_of = np.searchsorted(shard.ends, a, "right")
            spans = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(a - shard.starts[row_of] if len(a) else a, pa.int64()), pa.array(b - shard.starts[row_of] if len(a) else b, pa.int64())], ["start", "end"]))
            total = shard.ends - shard.starts
            for at in range(0, len(total), 500):
                part = slice(at, at + 500)
                yield pa.RecordBatch.from_arrays(
                    [id_array(shard.docs[part]), pa.array(total[part]), pa.array(total[part] - np.array([len(k) for k in kept[part]], np.int64)), spans.slice(at, 500), pa.array(kept[part], pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
                )

    return run


_FOUND = "lane long, shard long, bits binary"


def _back(bits: DataFrame) -> DataFrame:
    """Each shard's answers, in one row."""
    return bits.groupBy("shard").agg(F.collect_list(F.struct("lane", "bits")).alias("found"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, spans (removed runs: start, end), kept (the remaining bytes)."""
    if length < PIECE + 8:
        raise ValueError(f"strings of less than {PIECE + 8} bytes")
    shards = materialize(mapped(pick(docs, "doc_id", "text"), _shards(SHARD_BYTES), _SHARD), "shards")
    total = shards.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).head()["n"]
    lanes = max(12, -(-3 * total // LANE_BYTES))  # text shrinks to about a third
    n = shards.count()
    # as many partitions as the input asks for, so that no task grows with it: a lane's messages, some shards
    by_lane, by_shard = (lambda df, k=lanes: df.repartition(k, "lane").groupBy("lane")), (lambda df: df.repartition(max(12, n // 4), "shard"))
    asked = mapped(shards, _asked(lanes, length), "lane long, shard long, keys binary")
    bits = materialize(_back(by_lane(asked, max(12, lanes // 4)).applyInArrow(_recurring(HOT_SHARDS), _FOUND)), "anchors")
    groups = -(-n // FAN_IN)
    resolved = mapped(by_shard(shards).join(by_shard(bits).hint("merge"), "shard", "left"), _resolved(lanes, length, groups), "lane long, shard long, blob binary")
    answers = level = materialize(by_lane(resolved).applyInArrow(_merged(lanes, length, groups, FAN_IN), _MERGED), "answers")
    states = answers.filter("lane is null and up is null").select("shard", F.col("bits").alias("state"))
    while groups > 1:
        groups = -(-groups // FAN_IN)
        climbing = level.filter("up is not null").select(F.col("up").alias("lane"), "shard", F.col("bits").alias("blob"))
        level = materialize(by_lane(climbing, max(12, lanes // 4)).applyInArrow(_merged(lanes, length, groups, FAN_IN), _MERGED), "answers")
        answers = answers.unionByName(level)
    last = by_shard(shards).join(by_shard(states).hint("merge"), "shard").join(_back(by_shard(answers.filter("lane is not null"))).hint("merge"), "shard", "left")
    return mapped(last, _removed(length), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def suffix_dedup_digests(docs: DataFrame) -> DataFrame:
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
