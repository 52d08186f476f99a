"""Operator 13: the trie of conversation prefixes, from a global sort of turn arrays.

A turn is 20 bytes: 128 bits of a digest of role and text, and the text's size in
bytes; a conversation is the concatenation of its turns, so byte order groups equal
prefixes.  Equal conversations are one row (count, smallest id, digest of the ids).
The rows are range-sorted over the cluster; each partition learns how many leading
turns its first row shares with the row before it and its last row with the row after
it, and sweeps its rows with a stack of open nodes: a row that shares l turns with the
one before closes all nodes deeper than l and opens its own.  All sums of a node are
additive (a row counts the nodes it opens, and is a leaf if the next row does not
extend it), so nodes that are open at a partition's edge are stitched by adding up the
parts that the partitions saw.  A node's row waits with its parent for the parent's
smallest id; children of parents that span partitions, or of parents with very many
children, get it by a join on the parent's prefix instead, in which hot parents are
dealt out.

Turns are ordered by turn (null first), ties by the turn's digest; null role or text is
empty; rows without a conv_id take no part; repeated rows are turns each.  Empty texts
are turns of size 0.  An empty table has no node, not even a root.  Other columns are
ignored.  A conversation of n turns is one row of 20 * n bytes; texts are never moved.
The digest of a node's ids is sequential by definition: the ids of one group of equal
conversations, 8 bytes each and sorted, stream through one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recallforge.llm import _io

#: Bytes of a turn in a key.
TURN = 20
#: Rows that wait for their parents in a task before the longest list is let go.
MAX_WAITING = 50_000
NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SWEPT = f"{_NODE}, node binary, parent binary, open boolean"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: an array of 20-byte turns in order."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    one = F.unhex(F.concat(digest, F.lpad(F.hex(F.octet_length(text)), 8, "0")))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("at"), one.alias("turn")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t.turn).alias("turns"))


def _bytes(list_of_turns: Column) -> Column:
    """The concatenation of an array of binaries."""
    return F.unhex(F.array_join(F.transform(list_of_turns, F.hex), ""))


def keys(conversations: DataFrame) -> DataFrame:
    """conv_id, key of each conversation as it is."""
    return turns(conversations).select("conv_id", _bytes(F.col("turns")).alias("key"))


def rebuilt(conversations: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """conv_id, key of the conversations, each rebuilt to share its beginning: the first
    h turns come from conversation c - c % every, h = crc32(c) % most."""
    own = turns(conversations).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    head = own.where(F.col("conv_id") == F.col("base")).select("base", F.slice("turns", 1, most - 1).alias("head"))
    both = own.join(head, "base", "left")
    first = F.slice(F.coalesce("head", F.array().cast("array<binary>")), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv_id", _bytes(F.concat(first, rest)).alias("key"))


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key digest, conv_id) to one row per key digest."""
    now, state, begun = None, None, False
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for d, c in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if not begun or d != now:
                if begun:
                    done.append((now, state.hexdigest()))
                now, state, begun = d, hashlib.sha256(b"%d" % c), True
            else:
                state.update(b",%d" % c)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], pa.binary()), pa.array([s for _, s in done])], names=["digest", "ends"])
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["digest", "ends"])


def distinct_keys(convs: DataFrame) -> DataFrame:
    """key, n, conv_id (the smallest), ends (digest of the ids) of ``convs`` (conv_id, key)."""
    digest = F.unhex(F.md5("key"))
    groups = convs.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).withColumn("digest", digest)
    ends = convs.select(digest.alias("digest"), "conv_id").repartition("digest").sortWithinPartitions("digest", "conv_id").mapInArrow(_id_digests, "digest binary, ends string")
    return groups.join(ends, "digest").select("key", "n", "conv_id", "ends")


def shared_turns(a: bytes, b: bytes) -> int:
    """Leading turns that two keys have in common."""
    n = min(len(a), len(b)) // TURN
    low, step = 0, 1
    while low < n and a[low * TURN : (low + step) * TURN] == b[low * TURN : (low + step) * TURN]:
        low, step = min(n, low + step), 2 * step
    while low < n and a[low * TURN : (low + 1) * TURN] == b[low * TURN : (low + 1) * TURN]:
        low += 1
    return low


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last key of a partition."""
    first = last = part = None
    for batch in batches:
        if batch.num_rows:
            first = batch.column("key")[0].as_py() if first is None else first
            last, part = batch.column("key")[batch.num_rows - 1].as_py(), batch.column("part")[0].as_py()
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary())], names=["part", "first", "last"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared turns across the edges of partitions, in their order; -1: no neighbour."""
    held, tail, left = None, b"", -1
    for batch in batches:
        for part, first, last in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "last")), strict=True):
            now = -1
            if held is not None:
                now = shared_turns(tail, first)
                yield _edge(held, left, now)
            held, tail, left = part, last, now
    if held is not None:
        yield _edge(held, left, -1)


def _edge(part: int, left: int, right: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([left]), pa.array([right])], names=["part", "left", "right"])


class _Open:
    """An open node: what its subtree has shown so far in this partition."""

    __slots__ = ("key", "depth", "size", "spans", "wanted", "n", "conv_id", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, key: bytes, depth: int, spans: bool):
        self.key, self.depth, self.spans, self.wanted = key, depth, spans, False
        self.size = int.from_bytes(key[depth * TURN - 4 : depth * TURN], "big") if depth else 0
        self.n = self.children = self.leaves = 0
        self.saved = 0 if spans else -self.size
        self.conv_id = self.ends = None
        self.waiting: list[list] = []

    def name(self) -> bytes:
        return hashlib.md5(self.key[: self.depth * TURN]).digest()

    def parent_name(self) -> bytes | None:
        return hashlib.md5(self.key[: (self.depth - 1) * TURN]).digest() if self.depth else None

    def add(self, n: int, conv_id: int) -> None:
        self.n += n
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)


class _Sweep:
    """The stack sweep over one partition's sorted rows."""

    def __init__(self, left: int, right: int, max_waiting: int):
        self.left, self.right, self.max_waiting = left, right, max_waiting
        self.stack: list[_Open] = []
        self.before: bytes | None = None
        self.out: list[list] = []
        self.waiting = 0

    def row(self, key: bytes, n: int, conv_id: int, ends: str) -> None:
        if self.before is None:
            shared = self.left
            self.stack = [_Open(key, d, True) for d in range(shared + 1)]
        else:
            shared = shared_turns(self.before, key)
            self._leave(shared)
        for d in range(len(self.stack), len(key) // TURN + 1):
            if self.stack:
                self.stack[-1].children += 1
            self.stack.append(_Open(key, d, False))
        top = self.stack[-1]
        top.add(n, conv_id)
        top.ends = ends
        self.before = key

    def _leave(self, shared: int) -> None:
        """The next row shares ``shared`` turns with the last one."""
        if shared < len(self.before) // TURN:
            self.stack[-1].leaves += 1
        while len(self.stack) > shared + 1:
            self._close(self.stack.pop())

    def _close(self, node: _Open) -> None:
        parent = self.stack[-1] if self.stack else None
        node.saved += node.n * node.size
        if parent is not None:
            parent.add(node.n, node.conv_id)
            parent.leaves += node.leaves
            parent.saved += node.saved
        row = [node.conv_id, node.depth, None, node.n, node.children, node.leaves, node.saved, node.ends, None, None, node.spans]
        if node.spans:
            row[8], row[9] = node.name(), node.parent_name()
            self._release(node)
            self.out.append(row)
            return
        row[7] = node.ends or NO_ENDS
        if node.wanted:
            row[8] = node.name()
        for child in node.waiting:
            child[2] = node.conv_id
        self.out += node.waiting
        self.waiting -= len(node.waiting)
        if parent is None:
            self.out.append(row)
        elif parent.spans:
            row[9] = parent.name()
            self.out.append(row)
        else:
            parent.waiting.append(row)
            self.waiting += 1
            if self.waiting > self.max_waiting:
                self._release(max(self.stack, key=lambda e: len(e.waiting)))

    def _release(self, node: _Open) -> None:
        """Lets the children that wait for ``node`` go, to find it by its name."""
        if node.waiting:
            node.wanted = True
            for child in node.waiting:
                child[9] = node.name()
            self.out += node.waiting
            self.waiting -= len(node.waiting)
            node.waiting = []

    def end(self) -> None:
        """The nodes that the next partition's first row shares stay open."""
        if self.before is None:
            return
        self._leave(self.right)
        for node in self.stack:
            node.spans = True
        while self.stack:
            self._close(self.stack.pop())

    def taken(self) -> list[list]:
        out, self.out = self.out, []
        return out


def _swept(schema: pa.Schema, max_waiting: int):
    def batch_of(rows: list[list]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 20_000):
            cols = zip(*rows[at : at + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = None
        for batch in batches:
            if batch.num_rows and sweep is None:
                sweep = _Sweep(batch.column("left")[0].as_py(), batch.column("right")[0].as_py(), max_waiting)
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "conv_id", "ends")), strict=True):
                sweep.row(*row)
            if sweep is not None:
                yield from batch_of(sweep.taken())
        if sweep is not None:
            sweep.end()
            yield from batch_of(sweep.taken())

    return run


def trie(convs: DataFrame, max_waiting: int = MAX_WAITING) -> DataFrame:
    """The nodes of the trie of ``convs`` (conv_id, key): conv_id (the smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    in_order = distinct_keys(convs).repartitionByRange("key").sortWithinPartitions("key")
    in_order = _io.cut(in_order).withColumn("part", F.spark_partition_id())
    edges = in_order.select("part", "key").mapInArrow(_edges, "part int, first binary, last binary")
    # one row for each partition, so one task holds few rows; they stream through it
    beside = edges.repartition(1).sortWithinPartitions("part").mapInArrow(_neighbours, "part int, left long, right long")
    rows = in_order.join(F.broadcast(beside), "part").select("key", "n", "conv_id", "ends", "left", "right")
    swept = _io.written(rows.mapInArrow(_swept(to_arrow_schema(StructType.fromDDL(_SWEPT)), max_waiting), _SWEPT), "trie")

    parts = swept.where("open").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.coalesce(F.max("ends_sha256"), F.lit(NO_ENDS)).alias("ends_sha256"),
        F.first("parent").alias("parent"),
    )
    stitched = _io.cut(parts)
    closed = swept.where("not open")
    names = [c for c in swept.columns if c not in ("parent_conv_id", "node", "parent", "open")]
    late = closed.where("parent is not null").select(*names, "parent").unionByName(stitched.select(*names, "parent"))
    known = closed.where("node is not null").select("node", "conv_id").unionByName(stitched.select("node", "conv_id"))
    sizes = late.groupBy("parent").agg(F.count("*").alias("_n"))
    hot = _io.hot_keys(sizes, "parent", "_n", late.count())
    resolved = _io.salted_join(late, known.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", hot, ["conv_id", "depth"], "left")
    columns = [c.split()[0] for c in _NODE.split(", ")]
    return closed.where("parent is null").select(*columns).unionByName(resolved.select(*columns))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(_io.table(spark, sf_dir, "conversations")))
