"""Prefix trie of conversations, with subtree totals by time-forward processing.

Conversations are rebuilt: the first ``h`` turns come from the conversation that leads its block of
five ids, the rest from the conversation itself.  Each prefix of a rebuilt conversation is a node,
named by a digest chained over its turns.  Rows per node are combined by partial aggregation.

Totals go up the trie by time-forward processing.  A node's weight is the number of member turns at
or below it, so it never grows from a node to its child, and limits on the weight cut the trie into
connected shards: one of the lowest level holds at most ``SHARD_ROWS`` nodes, one of a higher level
only nodes above that limit.  Within a shard, nodes are sorted by falling depth and each sends its
totals to its parent through a priority queue that spills sorted runs.  The totals of shard roots
are summed per parent and enter the shards of the next level, up to the root.

Defined cases: rows without ``conv_id`` are left out; null role or text is empty; turns are ordered
by turn (null first), then role and text, and repeated rows are turns of their own; ``c % 5`` has
the sign of ``c``; further columns are not read; an empty table gives no rows.  A conversation is
read as one run of turns by one task, which holds none of them; so are the ids under one node, whose
digest cannot be computed in parts.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: Conversations that share a leader, and the highest number of turns taken from it, plus one.
BLOCK, HEADS = 5, 9
#: Member turns below the root of a shard of the lowest level, and the factor to the next level.
SHARD_ROWS, LEVEL_FACTOR = 2_000, 1000
#: Messages that a task's queue holds in memory, and ids that are hashed as one piece.
QUEUED, PIECE = 200_000, 50_000

ROOT = b"\0" * 16

_PATHS = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("turns", pa.int64()), ("node", pa.binary()),
    ("parent", pa.binary()), ("bytes", pa.int64()),
])
_PATHS_DDL = "conv_id long, depth long, turns long, node binary, parent binary, bytes long"
_TOTALS = pa.schema([
    ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("root", pa.bool_()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
])
_TOTALS_DDL = (
    "node binary, parent binary, depth long, root boolean, n_children long, n_leaves long, "
    "saved_tokens long"
)


def heads_of(conv_id: Column) -> Column:
    """How many turns a conversation takes from its leader."""
    return (F.crc32(conv_id.cast("string")) % HEADS).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, nth, role, text`` of rebuilt conversations; a row with ``nth`` 0 marks each."""
    ids = F.col("conv_id").cast("long")
    turns = conversations.where("conv_id is not null").select(
        ids.alias("conv_id"), "turn", text_or_empty("role").alias("role"), text_or_empty().alias("text")
    )
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    turns = turns.select("conv_id", nth.alias("nth"), "role", "text")
    own = F.col("nth") > heads_of(F.col("conv_id"))
    empty = F.lit("")
    rows = turns.where((F.col("nth") == 1) | own).withColumn(
        "made", F.filter(F.array(
            F.when(F.col("nth") == 1, F.struct(F.lit(0).alias("nth"), empty.alias("role"), empty.alias("text"))),
            F.when(own, F.struct("nth", "role", "text")),
        ), lambda row: row.isNotNull()),
    ).select("conv_id", F.inline("made"))
    near = F.transform(
        F.array(*map(F.lit, range(1 - BLOCK, BLOCK))),
        lambda step: F.try_add("conv_id", step.cast("long")),
    )
    led = F.filter(near, lambda c: (c - c % BLOCK == F.col("conv_id")) & (F.col("nth") <= heads_of(c)))
    taken = turns.where((F.col("conv_id") % BLOCK == 0) & (F.col("nth") < HEADS)).select(
        F.explode(led).alias("conv_id"), "nth", "role", "text"
    )
    return rows.unionByName(taken)


def paths(turns: DataFrame) -> DataFrame:
    """A row per conversation and depth, the root included: node, its parent, bytes of its text."""

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, depth, node = None, 0, None
        for batch in batches:
            rows = []
            for conv_id, nth, size, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if nth == 0:
                    conv, depth, node, parent, text = conv_id, 0, ROOT, None, ""
                elif conv_id != conv:
                    continue  # turns of a leader for an id that has no rows
                else:
                    parent, depth = node, depth + 1
                    raw = role.encode()
                    named = parent + len(raw).to_bytes(8, "little") + raw + text.encode()
                    node = hashlib.blake2b(named, digest_size=16).digest()
                rows.append((conv_id, depth, size - 1, node, parent, len(text.encode())))
            yield _batch(rows, _PATHS)

    size = F.count("*").over(Window.partitionBy("conv_id"))
    ordered = turns.select("conv_id", "nth", size.alias("size"), "role", "text")
    return ordered.sortWithinPartitions("conv_id", "nth").mapInArrow(chained, _PATHS_DDL)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


def node_rows(path_rows: DataFrame) -> tuple[DataFrame, int]:
    """A row per node below the root, with its shard and level, and the number of levels."""
    below = path_rows.where("depth > 0")
    nodes = written(below.groupBy("node").agg(
        F.min("conv_id").alias("least"), F.count("*").alias("n_convs"),
        F.sum(F.col("turns") - F.col("depth") + 1).alias("weight"),
    ), "trie-nodes")
    heaviest = nodes.agg(F.max("weight")).first()[0] or 0
    limits = [SHARD_ROWS]
    while limits[-1] < heaviest:
        limits.append(limits[-1] * LEVEL_FACTOR)
    level = sum(((F.col("weight") > limit).cast("int") for limit in limits), F.lit(0))
    # a conversation's nodes of one level lie in one shard, whose root is the first of them
    on_path = below.join(nodes, "node").withColumn("level", level)
    shard = F.min_by("node", "depth").over(Window.partitionBy("conv_id", "level"))
    above = F.lag("least").over(Window.partitionBy("conv_id").orderBy("depth"))
    placed = on_path.withColumns({"shard": shard, "parent_conv_id": above})
    return written(placed.where("conv_id = least").select(
        "node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "level", "shard",
        (F.col("bytes") * (F.col("n_convs") - 1)).alias("own_saved"),
    ), "trie-shards"), len(limits)


class SpillingQueue:
    """Sums of messages by key, taken in key order; beyond ``limit`` keys, sorted runs are spilled.

    Runs are nameless files of the task, like Spark's own spills: they end with it, and an attempt
    elsewhere writes its own.
    """

    def __init__(self, limit: int = QUEUED):
        self._limit, self._sums, self._keys, self._runs = limit, {}, [], []

    def push(self, key: tuple, message: tuple) -> None:
        held = self._sums.get(key)
        if held is None:
            heapq.heappush(self._keys, key)
            self._sums[key] = message
            if len(self._keys) > self._limit:
                self._spill()
        else:
            self._sums[key] = tuple(map(sum, zip(held, message)))

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        for key in sorted(self._keys):
            pickle.dump((key, self._sums[key]), file)
        file.seek(0)
        self._sums, self._keys = {}, []
        self._advance(file)

    def _advance(self, file) -> None:
        try:
            key, message = pickle.load(file)
        except EOFError:
            file.close()
        else:
            heapq.heappush(self._runs, (key, id(file), message, file))

    def pop(self, key: tuple) -> tuple:
        """Sum of the messages of ``key``, which no message in the queue precedes."""
        found = (0, 0, 0)
        if self._keys and self._keys[0] == key:
            found = self._sums.pop(heapq.heappop(self._keys))
        while self._runs and self._runs[0][0] == key:
            _, _, message, file = heapq.heappop(self._runs)
            found = tuple(map(sum, zip(found, message)))
            self._advance(file)
        return found

    def __len__(self) -> int:
        return len(self._keys) + len(self._runs)


def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of nodes that come by shard and falling depth, with what lower shards sent them."""
    queue, shard = SpillingQueue(), None
    for batch in batches:
        rows = []
        for of, node, parent, depth, saved, *sent in zip(*(c.to_pylist() for c in batch.columns)):
            if of != shard:
                shard = of
                assert not len(queue), "a shard is not closed"
            children, leaves, below = map(sum, zip(queue.pop((-depth, node)), sent))
            total = (children, leaves or 1, below + saved)
            if node != shard:
                queue.push((1 - depth, parent), (1, *total[1:]))
            rows.append((node, parent, depth, node == shard, *total))
        yield _batch(rows, _TOTALS)


def subtree_totals(nodes: DataFrame, levels: int) -> DataFrame:
    """Children, leaves and saved bytes of every node, level by level of shards."""
    done = None
    zero = [F.coalesce(c, F.lit(0)).cast("long") for c in ("sent_children", "sent_leaves", "sent_saved")]
    for level in range(levels):
        here = nodes.where(F.col("level") == level)
        if done is None:
            here = here.withColumns(dict.fromkeys(("sent_children", "sent_leaves", "sent_saved"), F.lit(0)))
        else:
            here = here.join(sent_up(done), "node", "left")
        rows = here.select("shard", "node", "parent", "depth", "own_saved", *zero)
        ordered = rows.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "node")
        found = written(ordered.mapInArrow(forward, _TOTALS_DDL), f"trie-totals-{level}")
        done = found if done is None else done.unionByName(found)
    return done


def sent_up(totals: DataFrame) -> DataFrame:
    """What shard roots send to their parents, summed per parent."""
    return totals.where("root").groupBy(F.col("parent").alias("node")).agg(
        F.count("*").alias("sent_children"), F.sum("n_leaves").alias("sent_leaves"),
        F.sum("saved_tokens").alias("sent_saved"),
    )


def end_digests(path_rows: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at a node, ascending and joined by commas.

    Ids are sorted by range, so those of one node may lie in many tasks; each makes pieces of them,
    and the pieces are streamed through the digest in order.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            pairs = zip(*(c.to_pylist() for c in batch.columns))
            for node, group in groupby(pairs, key=lambda pair: pair[0]):
                ids = [conv_id for _, conv_id in group]
                for at in range(0, len(ids), PIECE):
                    some = ids[at:at + PIECE]
                    rows.append((node, some[0], ",".join(map(str, some))))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("node", "first", "ids"), row)) for row in rows],
                pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())]),
            )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
        node, digest = None, None
        for batch in batches:
            rows = []
            for of, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if of == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        rows.append((node, digest.hexdigest()))
                    node, digest = of, hashlib.sha256()
                digest.update(ids.encode())
            yield _batch(rows, schema)
        if node is not None:
            yield _batch([(node, digest.hexdigest())], schema)

    ends = path_rows.where("depth = turns").select("node", "conv_id")
    ordered = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    cut = ordered.mapInArrow(pieces, "node binary, first long, ids string")
    return cut.repartition("node").sortWithinPartitions("node", "first").mapInArrow(
        digests, "node binary, ends_sha256 string"
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node of the trie of rebuilt conversations, the root included."""
    path_rows = written(paths(rebuilt(conversations)), "trie-paths")
    nodes, levels = node_rows(path_rows)
    totals = subtree_totals(nodes, levels)
    counted = nodes.join(
        totals.select("node", "n_children", "n_leaves", "saved_tokens"), "node"
    ).select(
        "node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens",
    )
    # the root: its members, and what all shards below it send
    members = path_rows.where("depth = 0").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")
    )
    root = members.join(sent_up(totals), "node", "left").select(
        "node", "conv_id", F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        F.coalesce("sent_children", F.lit(0)).alias("n_children"),
        F.coalesce("sent_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("sent_saved", F.lit(0)).alias("saved_tokens"),
    )
    # one row, for the nodes right below it
    first = members.select(F.col("node").alias("parent"), F.col("conv_id").alias("root_conv_id"))
    below = counted.join(F.broadcast(first), "parent", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "root_conv_id")
    ).drop("root_conv_id", "parent")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return root.unionByName(below).join(end_digests(path_rows), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
