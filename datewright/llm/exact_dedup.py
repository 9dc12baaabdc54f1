"""Exact dedup: sorted runs of digests, merged along a tree.

Every partition sorts the digests of its rows into runs, one for each lane (a range of digests). In each
round, the runs of FAN_IN neighbouring nodes of a lane, a binomial tree of order log2(FAN_IN), meet in
one and are merged, where equal digests become one entry with the best row so far and the number of rows.
A lane's last run holds its distinct digests only, so neither a hot text nor a large table lands in one task.

Defined results: null text is empty. Repeated rows are members of their group like any others; of rows with
equal text length and doc_id, each bears that doc_id as keep_id, and all of them are kept. A null doc_id counts as
smaller than any other. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datewright.llm.common import SPACE, id_array, ids, mapped, materialize, pick, sieved, split_join, strings, with_private

FAN_IN = 8
#: Distinct digests that a lane's last run may hold: 64 bytes each.
LANE_ROWS = 500_000

ENTRY = np.dtype([("sha", "S32"), ("check", "<u8"), ("points", "<i8"), ("id", "<i8"), ("rows", "<i8")])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = strings(batch.column("text"))
        plain = [x.translate(None, SPACE) for x in text.cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array([hashlib.sha256(x).digest() for x in plain], pa.binary()), pa.array([xxhash.xxh3_64_intdigest(x) >> 1 for x in plain], pa.int64()), pc.utf8_length(text).cast(pa.int64())],
            ["doc_id", "sha", "check", "points"],
        )


def _merge(entries: np.ndarray) -> np.ndarray:
    """Sorted by digest; equal digests that the second hash confirms become one, of the longest text, then the smallest id."""
    sha = np.frombuffer(entries["sha"].astype("S32").tobytes(), ">u8").reshape(-1, 4)
    order = np.lexsort((entries["id"], -entries["points"], entries["check"], sha[:, 3], sha[:, 2], sha[:, 1], sha[:, 0]))
    sha, entries = sha[order], entries[order]
    new = np.ones(len(entries), bool)
    new[1:] = (sha[1:] != sha[:-1]).any(1) | (entries["check"][1:] != entries["check"][:-1])
    first = np.flatnonzero(new)
    out = entries[first].copy()
    out["rows"] = np.add.reduceat(entries["rows"], first) if len(first) else 0
    return out


def _runs(lanes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        node, held, n = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            own = np.zeros(batch.num_rows, ENTRY)
            own["sha"] = np.array(batch.column("sha").to_pylist(), "S32")
            own["check"], own["points"], own["id"], own["rows"] = batch.column("check").to_numpy(), batch.column("points").to_numpy(), ids(batch.column("doc_id")), 1
            held, n = [*held, own], n + len(own)
            if n > LANE_ROWS:
                held = [_merge(np.concatenate(held))]
                n = len(held[0])
                if n > LANE_ROWS // 2:
                    yield from _by_lane(held[0], lanes, node)
                    held, n = [], 0
        if n:
            yield from _by_lane(_merge(np.concatenate(held)), lanes, node)

    return run


def _by_lane(entries: np.ndarray, lanes: int, node: int) -> Iterator[pa.RecordBatch]:
    top = np.frombuffer(entries["sha"].tobytes(), ">u4").reshape(-1, 8)[:, 0].astype(np.int64)
    lane = top * lanes >> 32
    cuts = np.searchsorted(lane, np.arange(lanes + 1))
    full = [i for i in range(lanes) if cuts[i] < cuts[i + 1]]
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([node] * len(full), pa.int64()), pa.array([entries[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary())], ["lane", "node", "run"])


def _met(table: pa.Table) -> np.ndarray:
    return _merge(np.concatenate([np.frombuffer(x, ENTRY) for x in table["run"].to_pylist()]))


def _meet(key: tuple, table: pa.Table) -> pa.Table:
    return pa.table({"lane": pa.array([key[0].as_py()], pa.int64()), "node": pa.array([key[1].as_py()], pa.int64()), "run": pa.array([_met(table).tobytes()], pa.binary())})


def _root(key: tuple, table: pa.Table) -> pa.Table:
    """The last round: the texts of a lane that more than one row has."""
    own = _met(table)
    own = own[own["rows"] > 1]
    sha = own["sha"].tobytes()
    return pa.table({"sha": pa.array([sha[i : i + 32] for i in range(0, len(sha), 32)], pa.binary()), "check": pa.array(own["check"].astype(np.int64)), "keep_id": id_array(own["id"]), "group_size": pa.array(own["rows"])})


def groups_of(digests: DataFrame, rows: int) -> DataFrame:
    """sha, check, keep_id, group_size of every text that more than one row has; digests: from digests_of()."""
    lanes = max(12, -(-rows // LANE_ROWS))
    nodes = max(1, digests.rdd.getNumPartitions())
    runs = mapped(digests, _runs(lanes), "lane long, node long, run binary")
    while True:
        nodes = -(-nodes // FAN_IN)
        runs = runs.withColumn("node", F.floor(F.col("node") / FAN_IN)).groupBy("lane", "node")
        if nodes == 1:
            return runs.applyInArrow(_root, "sha binary, check long, keep_id long, group_size long")
        runs = runs.applyInArrow(_meet, "lane long, node long, run binary")


def digests_of(docs: DataFrame) -> DataFrame:
    """doc_id, sha (of the text without white space), check (a second hash of it), points (code points of the text)."""
    return materialize(mapped(pick(docs, "doc_id", "text"), _digests, "doc_id long, sha binary, check long, points long"), "digests")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = digests_of(docs)
    rows = digests.count()
    groups = materialize(groups_of(digests, rows), "groups")
    out = split_join(digests, groups, ["sha", "check"], "group_size", rows)
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs, with all columns, without the rows that aren't kept; of rows with the same doc_id and text, one stays. Only rows that may be concerned are shuffled."""
    rows, col, back = with_private(docs)
    found = exact_dedup(docs).groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).agg(F.max(~F.col("kept")).alias("gone"), F.count("*").alias("n"))
    found = materialize(found.filter("gone or n > 1").select("id", "sha", "gone"), "found")
    sha = F.sha2(F.encode(F.translate(F.coalesce(col("text"), F.lit("")), SPACE.decode(), ""), "UTF-8"), 256)
    some, others = sieved(rows.withColumn("id", col("doc_id").cast("long")).withColumn("sha", sha), found.select("id", "sha"), found.count())
    gone = found.filter("gone").toDF("gone_id", "gone_sha", "gone")
    kept = some.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("sha") == F.col("gone_sha")), "left_anti").dropDuplicates(["id", "sha"])
    return back(kept.unionByName(others))
