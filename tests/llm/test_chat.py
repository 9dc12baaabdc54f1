import hashlib
from collections import Counter

import numpy as np
import pytest

from datewright.llm import chat_format as chat

ROWS = [
    (1, 0, "system", "shared"),
    (1, 1, "user", "hi"),
    (1, 2, "assistant", "yes </turn>\n<turn>user\n"),
    (2, 0, "system", "shared"),
    (2, 1, "user", "hi"),
    (2, 2, "assistant", "no \\ back\\\\slash\\n"),
    (2, 3, "assistant", ""),
    (3, 0, "system", "shared"),
    (4, 0, None, None),
    (5, 3, "user", "later"),
    (5, None, "assistant", "first"),
    (5, 3, "user", "later"),
    (None, 0, "assistant", "nobody"),
    (6, 0, "a\nb\\n", "role with a line feed"),
    (7, 0, "system", "shared"),
    (7, 1, "user", "hi"),
    (7, 2, "assistant", "no \\ back\\\\slash\\n"),
    (8, 0, "user", "é😀" * 1000),
]


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = {}
    for conv, turns in by.items():
        turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        text = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns)
        formatted = "".join(chat.format_turn(t[2] or "", t[3] or "")[0] for t in turns)
        out[conv] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, path string").repartition(3)


@pytest.mark.parametrize("part", [1_000_000, 10])
def test_round_trip(table, part):
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(chat.chat_tree(table, part)).collect()}
    assert got == expected(ROWS)


def test_shared_turns_are_emitted_once(spark, table):
    nodes = chat.chat_tree(table.coalesce(1).repartition(1)).collect()
    by_part = {}
    for n in nodes:
        by_part.setdefault(n.part, []).append(n)
    for part in by_part.values():
        part.sort(key=lambda n: n.node)
        at = 0
        for n in part:
            assert n.start == at and n.end - n.start == len(n.ids)
            at = n.end
            up = next((m for m in part if m.node == n.parent), None)
            assert (n.depth == 0) == (up is None)
            if up:
                assert n.position_start == up.position_start + up.end - up.start
                spans = sum(s.end - s.start for s in n.attends)
                assert spans == n.position_start and n.attends[-1].end == up.end
    decode = chat.codec(chat.tokenizer_path()).decode
    total = [n for n in nodes if n.role == "system" and "shared" in decode(np.array(n.ids))]
    assert len(total) <= len(by_part)


def test_loss_spans_hold_the_texts(table):
    decode = chat.codec(chat.tokenizer_path()).decode
    for n in chat.chat_tree(table).collect():
        assert (n.loss_start is None) == (n.role != chat.TRAINED)
        if n.loss_start is not None:
            text = decode(np.array(n.ids)[n.loss_start - n.start : n.loss_end - n.start])
            assert chat.unescape(text) in {r[3] or "" for r in ROWS if r[2] == chat.TRAINED}


def test_tokens_are_reversible():
    codec = chat.codec(chat.tokenizer_path())
    texts = ["", "a", " a  b\n\n", "<|endoftext|>", "é😀\x00\x7f\u2028", "日本語 " * 50, "\ufeffx\r\n\t", "".join(map(chr, range(0x20, 0x3000, 7)))]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert codec.decode(np.array(ids, np.int64)) == text


def test_shared_turns_and_very_long_ones(spark):
    """A first turn that thousands of conversations share lies in a part once; long turns and long conversations come back whole."""
    rows = [(i, j, "assistant" if j % 2 else "user", "hello there" if j == 0 else f"reply {i % 50} {j}") for i in range(3000) for j in range(4)]
    rows += [(9000, 0, "user", "long é " * 60_000), (9000, 1, "assistant", "x" * 200_000)] + [(9001, j, "assistant" if j % 2 else "user", f"turn {j}") for j in range(400)]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes = chat.chat_tree(convs, 2_000).cache()
    assert {r.conv_id: tuple(r)[1:] for r in chat.read_back(nodes).collect()} == expected(rows)
    found = nodes.select("part", "depth", "parent", "role", "ids").collect()
    assert max(Counter((n.part, n.parent, n.role, tuple(n.ids)) for n in found).values()) == 1
    assert len({n.part for n in found}) > 5 and len(found) < 1500

def test_hostile_conversation(spark, table):
    got = {r.conv_id: r for r in chat.read_back(chat.chat_tree(chat.with_hostile(table))).collect()}
    text = chat.HOSTILE[1]
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert got[-7].loss_chars == len(text)


def test_escape_is_reversible():
    for text in ("", "\\", "<", "\\<", "\\n", "</turn>\n", "a\\\\<b>\n\\", "n"):
        assert chat.unescape(chat.escape(text)) == text
        segment, a, b = chat.format_turn(text, text)
        assert chat.parse(segment) == [(text, text)] and chat.unescape(segment[a:b]) == text


def test_empty(table):
    assert chat.read_back(chat.chat_tree(table.limit(0))).collect() == []
