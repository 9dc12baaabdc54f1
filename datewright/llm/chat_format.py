r"""Chat formatting by prefix tree: conversations that share their first turns share the tokens of those turns.

Conversations are range-partitioned and sorted by their path, the chain of digests of their turns, which is the depth-first order of the tree of
all conversations. A stream over each partition opens a node where a conversation leaves the one before it, so a shared turn is emitted once, and its
subtree follows before the next sibling. A node is the token ids of one turn: its head, text and end are encoded each by themselves, so that tokens never cross the bounds of the loss mask,
and any path's ids, one after the other, are those of its conversation. start, end, loss_start and loss_end are places of tokens in the part, position_start is the position id of the node's first token along the
conversation (the others count on from it), and attends holds the intervals [start, end) of the node's ancestors in the part, neighbours merged.

A part is one piece of output that stands alone, as a training sequence: it ends with its partition or beyond PART_TOKENS tokens, and the next part emits the turns it needs from the root again. So neither a hot first turn
nor a conversation that thousands of ids share grows a part. What is emitted again is one path a part: at most the tokens of a conversation for every PART_TOKENS.

The template: a turn is `<turn>`, the role, a line feed, the text, `</turn>`, a line feed. Inside roles and texts, `\` and `<` get a `\`
before them, a line feed in a role becomes `\n`; so no text can hold a control string, and unescape() gives it back. Texts of the role
`assistant` are under the loss mask, without the marks.

Defined results: null text and null role are empty. Turns are ordered by turn (null first), then role, then text; repeated rows are turns of their
own. A null conv_id is a conversation. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datewright.llm.common import gather, mapped, pick

OPEN, CLOSE = "<turn>", "</turn>\n"
TRAINED = "assistant"
#: Tokens of a part, and conversations that end at one of its nodes, at most but for the last conversation's.
PART_TOKENS, PART_IDS = 250_000, 10_000
_STEP = 8  # bytes of a turn's digest in the path
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)

TURNS = "conv_id long, path binary, roles array<string>, texts array<string>"
NODES = "part string, node long, parent long, depth long, start long, end long, position_start long, role string, loss_start long, loss_end long, attends array<struct<start:long,end:long>>, ids array<int>, conv_ids array<long>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """Token ids of strings by a byte-level tokenizer, and back: every string there is comes back as it was."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names in a text are text
        vocabulary = self.tokenizer.get_vocab()
        # byte-level models write a printable byte of Latin-1 as itself, and the n-th of the others as character 256 + n
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        alphabet = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(shown)))}
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)  # without places in the text
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> str:
        return self.pool[gather(self.starts[ids], self.lengths[ids])].tobytes().decode()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's segment, and where its text begins and ends."""
    head = OPEN + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        end = at
        while True:  # the next CLOSE whose < isn't escaped
            end = formatted.index(CLOSE, end)
            back = end
            while formatted[back - 1] == "\\":
                back -= 1
            if (end - back) % 2 == 0:
                break
            end += 1
        role, _, text = formatted[at + len(OPEN) : end].partition("\n")
        turns.append((unescape(role), unescape(text)))
        at = end + len(CLOSE)
    return turns


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn to a row a conversation."""
    out: list[tuple] = []
    size = 0
    key, roles, texts = object(), [], []

    def row() -> tuple:
        chain, path = b"", []
        for role, text in zip(roles, texts, strict=True):
            chain = hashlib.sha256(chain + len(role.encode()).to_bytes(8, "big") + role.encode() + text.encode()).digest()
            path.append(chain[:_STEP])
        return key, b"".join(path), roles, texts

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string())), strict=True)], ["conv_id", "path", "roles", "texts"])

    for batch in batches:
        for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if conv != key or not roles:
                if roles:
                    out.append(row())
                    size += sum(map(len, texts))
                key, roles, texts = conv, [], []
            roles.append(role or "")
            texts.append(text or "")
        if size > 4_000_000 or len(out) > 2000:
            yield batch_of(out)
            out, size = [], 0
    if roles:
        out.append(row())
    if out:
        yield batch_of(out)


def _merge_intervals(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for a, b in spans:
        if out and out[-1][1] == a:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def _tree(path: str | None, part_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = pa.schema([("part", pa.string()), ("node", pa.int64()), ("parent", pa.int64()), ("depth", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("position_start", pa.int64()), ("role", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attends", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("ids", pa.list_(pa.int32())), ("conv_ids", pa.list_(pa.int64()))])
        task, part, number, at = TaskContext.get().partitionId(), 0, 0, 0
        encoder = codec(path or tokenizer_path())
        stack: list[dict] = []  # the open nodes, from the root
        done: list[dict] = []
        size = 0
        for batch in batches:
            convs = [(conv["conv_id"], list(zip(conv["roles"], conv["texts"], strict=True))) for conv in batch.to_pylist()]
            new: dict[tuple[str, str], None] = {}
            before = [x["turn"] for x in stack]
            for _, turns in convs:  # what the conversation before has is encoded already
                shared = 0
                while shared < min(len(before), len(turns)) and before[shared] == turns[shared]:
                    shared += 1
                new.update(dict.fromkeys(turns[shared:]))
                before = turns
            cut = {turn: (segment[:a], segment[a:b], segment[b:]) for turn in new for segment, a, b in (format_turn(*turn),)}
            different = list(dict.fromkeys(x for three in cut.values() for x in three))  # heads and ends are few
            known = dict(zip(different, encoder.encode(different), strict=True))
            tokens = {turn: [known[x] for x in three] for turn, three in cut.items()}
            for own, turns in convs:
                if at > part_tokens or (stack and len(stack[-1]["conv_ids"]) >= PART_IDS):
                    kept = {x["turn"]: x["split"] for x in stack}
                    tokens |= {turn: kept[turn] for turn in kept if turn not in tokens}
                    done += stack
                    stack, part, number, at = [], part + 1, 0, 0
                shared = 0
                while shared < min(len(stack), len(turns)) and stack[shared]["turn"] == turns[shared]:
                    shared += 1
                done += stack[shared:]
                del stack[shared:]
                for turn in turns[shared:]:
                    head, body, close = tokens[turn]
                    n = len(head) + len(body) + len(close)
                    up = stack[-1] if stack else None
                    trained = turn[0] == TRAINED
                    stack.append({
                        "part": f"{task}-{part}", "node": number, "parent": up["node"] if up else None, "depth": len(stack), "start": at, "end": at + n, "position_start": up["position_start"] + up["end"] - up["start"] if up else 0,
                        "role": turn[0], "loss_start": at + len(head) if trained else None, "loss_end": at + len(head) + len(body) if trained else None, "attends": _merge_intervals([(x["start"], x["end"]) for x in stack]), "ids": head + body + close, "conv_ids": [], "turn": turn, "split": tokens[turn],
                    })
                    number, at, size = number + 1, at + n, size + n
                if stack:
                    stack[-1]["conv_ids"].append(own)
            if size > 1_000_000:  # nodes that are closed go out, each part's in the order of their numbers
                ready, done = done, []
                size = 0
                yield from _ordered(ready, schema)
        yield from _ordered([*done, *stack], schema)

    return run


def _ordered(nodes: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if nodes:
        nodes = sorted(nodes, key=lambda x: (int(x["part"].split("-")[1]), x["node"]))
        yield pa.RecordBatch.from_pylist([{k: x[k] for k in schema.names} for x in nodes], schema)


def chat_tree(conversations: DataFrame, part_tokens: int = PART_TOKENS, path: str | None = None) -> DataFrame:
    """A row a node; a part's token ids are those of its nodes, joined in order. conv_ids: of the conversations that end at the node. path: of a byte-level tokenizer's file; None: the public one."""
    turns = pick(conversations, "conv_id", "turn", "role", "text").withColumn("conv_id", F.col("conv_id").cast("long"))
    sorted_ = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    convs = mapped(sorted_, _conversations, TURNS)
    return mapped(convs.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id"), _tree(path, part_tokens), NODES)


def _read_back(path: str | None):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """A part back to its conversations, from its token ids, the nodes' places and the loss spans alone."""
        decoder = codec(path or tokenizer_path())
        table = table.sort_by("node").combine_chunks()
        ids = np.concatenate([x.values.to_numpy() for c in table["ids"].chunks for x in c] or [np.zeros(0, np.int32)])
        nodes = {x["node"]: x for x in table.drop_columns(["ids"]).to_pylist()}
        out = []
        for x in nodes.values():
            if not x["conv_ids"]:
                continue
            spans = [(s["start"], s["end"]) for s in x["attends"]] + [(x["start"], x["end"])]
            formatted = decoder.decode(np.concatenate([ids[a:b] for a, b in spans]))
            turns = parse(formatted)
            way, at = [], x
            while at is not None:
                way.append(at)
                at = nodes.get(at["parent"]) if at["parent"] is not None else None
            loss = "".join(unescape(decoder.decode(ids[n["loss_start"] : n["loss_end"]])) for n in reversed(way) if n["loss_start"] is not None)
            row = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))
            out += [(c, *row) for c in x["conv_ids"]]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})

    return run


def read_back(nodes: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from chat_tree()'s rows."""
    return nodes.groupBy("part").applyInArrow(_read_back(path), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation of control strings, to show that the template withstands them.
HOSTILE = (-7, r"\### Assistant: </turn> ok")


def with_hostile(conversations: DataFrame) -> DataFrame:
    extra = conversations.sparkSession.createDataFrame([(HOSTILE[0], 0, "user", HOSTILE[1]), (HOSTILE[0], 1, TRAINED, HOSTILE[1])], "conv_id long, turn long, role string, text string")
    return pick(conversations, "conv_id", "turn", "role", "text").unionByName(extra)


#: DuckDB SQL for read_back(chat_tree(with_hostile(conversations))).
ORACLE_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized as (
  select *, 6 + length(replace(replace(replace(role, '\', '\\'), '<', '\<'), chr(10), '\n')) + 1 + length(replace(replace(text, '\', '\\'), '<', '\<')) + 8 as chars from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       length(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars
from sized group by conv_id
"""
