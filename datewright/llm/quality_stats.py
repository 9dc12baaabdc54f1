"""Counts over the words and lines of whole texts, for the quality rules and the quality classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from datewright.llm.common import mapped, per_row, pick, raw, strings, words

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_MARK = np.isin(np.arange(256), np.frombuffer(b"!?#*$%&|<>@^~=+_\\{}[]", np.uint8))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LOWER = np.isin(np.arange(256), np.arange(97, 123))

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_marks long, n_upper long, n_lower long, n_distinct long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _joined(*columns: np.ndarray) -> np.ndarray:
    """One whole number for each combination of small whole numbers, equal exactly for equal combinations."""
    out, most = columns[0], int(columns[0].max(initial=0)) + 1
    for c in columns[1:]:
        size = int(c.max(initial=0)) + 1
        if most * size >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1]
            most = int(out.max(initial=0)) + 1
        out, most = out * size + c, most * size
    return out


def _repeated(codes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Words of each row that lie in a window of three words that the row has twice or more."""
    inside = np.flatnonzero(rows[2:] == rows[:-2]) if len(rows) > 2 else np.zeros(0, np.int64)
    if not len(inside):
        return np.zeros(n, np.int64)
    key = _joined(codes[inside], codes[inside + 1], codes[inside + 2], rows[inside])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mark = np.zeros(len(codes), bool)
    for k in range(3):
        mark[inside[twice] + k] = True
    return np.bincount(rows[mark], minlength=n)


def _distinct(codes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Different values of codes in each row."""
    return np.bincount(rows[np.unique(_joined(codes, rows), return_index=True)[1]], minlength=n) if len(codes) else np.zeros(n, np.int64)


def counts(text: pa.Array) -> list[np.ndarray]:
    """The columns of SCHEMA for each text."""
    text = strings(text)
    n = len(text)
    distinct, codes, offsets = words(text)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    data, places = raw(text)
    lengths = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64) if len(distinct) else np.zeros(0, np.int64)

    split = pc.split_pattern(text, "\n")
    line_rows = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))
    flat = split.flatten()
    full = np.flatnonzero(pc.utf8_length(pc.utf8_trim(flat, " \t\n\x0b\x0c\r")).to_numpy(zero_copy_only=False) > 0)
    lines = flat.take(pa.array(full)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own = line_rows[full]
    n_lines = np.bincount(own, minlength=n)
    return [
        np.diff(offsets), np.bincount(rows, weights=lengths[codes], minlength=n).astype(np.int64) if len(codes) else np.zeros(n, np.int64), per_row(_SYMBOL[data], places), n_lines - _distinct(lines, own, n), _repeated(codes, rows, n),
        n_lines, per_row(_MARK[data], places), per_row(_UPPER[data], places), per_row(_LOWER[data], places), _distinct(codes, rows, n),
    ]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [i for i, c in enumerate(batch.schema.names) if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *(pa.array(c.astype(np.int64)) for c in counts(batch.column("text")))], [*(batch.schema.names[i] for i in kept), *NAMES])


def document_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """keep (columns of docs), then SCHEMA."""
    rows = pick(docs, *keep, "text")
    return mapped(rows, _counted, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text") + ", " + SCHEMA)
