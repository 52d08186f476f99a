"""Operator 9: best-fit packing into sequences of several permitted lengths.

``pack`` takes token ids, a list a document (``token_store.encode`` makes them of
texts: the tokenizer's ids and an end id; null text: the end id alone), and gives
sequences: their ids, and which pieces of which documents they hold.  A document
longer than the longest permitted length is cut into pieces of that length; no token
is lost or repeated.

Best fit, decreasing: each piece goes to the open bin with the least room that
holds it.  If there is none, a bin opens whose size costs least per token that
can still be put into it (``cost``: the price of one sequence of that length).
At the end every bin is downsized to the shortest permitted length that holds
its contents.

Pieces are dealt by a hash of document, place and ids to shards of about
``shard_tokens`` tokens, each packed apart, one partition each.  A shard that equal
rows make larger is packed in rounds of ``round_tokens``, so memory is bounded and no
row is dropped.

Ties: longer piece first, then doc_id (null first), then start, then ids.  A document
of no ids (null or empty) is a piece of no tokens in a bin with the least room.
Repeated documents are packed each.  Empty table: no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recallforge.llm import _io, token_store

LENGTHS = (1024, 2048, 4096, 8192, 16384)
SHARD_TOKENS = 4_000_000
ROUND_TOKENS = 8_000_000
#: A task packs one shard; beyond so many tasks, several in turn.
MOST_TASKS = 50_000
#: Bytes of text that a token stands for at least, on average: sizes shards of texts.
TEXT_BYTES = 2
SEQUENCES = "bin_id long, capacity long, used long, doc_ids array<long>, starts array<long>, lengths array<long>, ids array<int>"
PIECES = "bin_id long, bin_capacity long, bin_used long, position int, doc_id long, piece_start long, piece_tokens long, ids_crc32 long"


def sequence_cost(length: int) -> float:
    """Linear work, attention, and a fixed charge per sequence."""
    return length * (1 + length / 65536) + 256


def best_fit(pieces: list[int], lengths: tuple[int, ...], cost: Callable[[int], float]) -> tuple[list[int], list[int]]:
    """Bin of each piece (given in decreasing order), and each bin's contents."""
    used: list[int] = []
    room: dict[int, list[int]] = {}  # room left -> bins, oldest last
    rooms: list[int] = []  # the rooms that occur, sorted
    where, capacity, rest = [], [], sum(pieces)
    for n in pieces:
        k = bisect_left(rooms, n)
        if k < len(rooms):
            free = rooms[k]
            b = room[free].pop()
            if not room[free]:
                del room[free], rooms[k]
        else:
            size = min((s for s in lengths if s >= n), key=lambda s: (cost(s) / max(1, min(s, rest)), s))
            b, free = len(used), size
            used.append(0)
            capacity.append(size)
        used[b] += n
        left = free - n
        if left:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append(b)
        where.append(b)
        rest -= n
    return where, used


def _sequences(first: int, sizes: list[int], used: list[int], bins: list[list[tuple]]) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum(used)]).astype(np.int32)
    names = [f.split()[0] for f in SEQUENCES.split(", ")]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(range(first, first + len(bins)), pa.int64()), pa.array(sizes, pa.int64()), pa.array(used, pa.int64()),
            *(pa.array([[f(r) for r in x] for x in bins], pa.list_(pa.int64())) for f in (lambda r: r[0], lambda r: r[1], lambda r: len(r[2]))),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[2] for x in bins for r in x]), pa.int32())),
        ],
        names=names,
    )


def _pieces(first: int, sizes: list[int], used: list[int], bins: list[list[tuple]]) -> pa.RecordBatch:
    rows = [(first + b, sizes[b], used[b], k, doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<i4"))) for b, x in enumerate(bins) for k, (doc, start, ids) in enumerate(x)]
    kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])


def _pack(lengths: tuple[int, ...], cost: Callable[[int], float], round_tokens: int, batch: Callable[..., pa.RecordBatch]):
    def emit(first: int, rows: list[tuple]) -> Iterator[tuple[int, pa.RecordBatch]]:
        where, used = best_fit([len(r[2]) for r in rows], lengths, cost)
        bins: list[list[tuple]] = [[] for _ in used]
        for r, b in zip(rows, where, strict=True):
            bins[b].append(r)
        size = [min(s for s in lengths if s >= n) for n in used]
        for k in range(0, len(bins), 64):
            end = min(k + 64, len(bins))
            yield end - k, batch(first + k, size[k:end], used[k:end], bins[k:end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, held, rows = None, 0, 0, []
        for batch in batches:
            ids = batch.column("ids")
            off, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            for k, (s, doc, start) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "piece_start")), strict=True)):
                if s != shard or held >= round_tokens:
                    if rows:
                        for n, out in emit(first, rows):
                            yield out
                            first += n
                    if s != shard:
                        shard, first = s, s << 40
                    held, rows = 0, []
                rows.append((doc, start, flat[off[k] : off[k + 1]]))
                held += 1 + int(off[k + 1] - off[k])
        if rows:
            for _, out in emit(first, rows):
                yield out

    return run


def pack(
    tokens: DataFrame,
    *,
    lengths: tuple[int, ...] = LENGTHS,
    cost: Callable[[int], float] = sequence_cost,
    shards: int | None = None,
    shard_tokens: int = SHARD_TOKENS,
    round_tokens: int = ROUND_TOKENS,
    pieces: bool = False,
) -> DataFrame:
    """A row per sequence of ``tokens`` (doc_id, ids): bin_id, capacity (its final
    length), used, the doc_ids, starts and lengths of its pieces, and their ids.  With
    ``pieces`` a row per piece instead: its bin, the bin's length and fill, its place,
    and the crc32 of its ids as little-endian 32-bit integers."""
    lengths = tuple(sorted(set(lengths)))
    top = lengths[-1]
    rows = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    if shards is None:
        total = rows.agg(F.sum(F.size("ids")).alias("n")).first().n
        shards = max(1, -(-(total or 0) // shard_tokens))
    starts = F.sequence(F.lit(0), F.greatest(F.size("ids") - 1, F.lit(0)), F.lit(top))
    parts = rows.select("doc_id", "ids", F.explode(starts).alias("at")).select("doc_id", F.col("at").cast("long").alias("piece_start"), F.slice("ids", F.col("at") + 1, top).alias("ids"))
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_start", "ids"), F.lit(shards)).cast("int"))
    tasks = min(shards, MOST_TASKS)
    return (
        dealt.repartitionById(tasks, F.pmod("shard", F.lit(tasks)))
        .sortWithinPartitions("shard", F.desc(F.size("ids")), F.col("doc_id").asc_nulls_first(), "piece_start", "ids")
        .mapInArrow(_pack(lengths, cost, round_tokens, _pieces if pieces else _sequences), PIECES if pieces else SEQUENCES)
    )


def pack_texts(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = token_store.END_ID, shard_tokens: int = SHARD_TOKENS, **options) -> DataFrame:
    """Sequences of the texts of ``docs`` (doc_id, text).  Shards are sized by the
    bytes of the texts, so that each text is encoded once."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    shards = max(1, -(-size // (TEXT_BYTES * shard_tokens)))
    return pack(token_store.encode(docs, tokenizer=tokenizer, end_id=end_id), shards=shards, **options)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(_io.table(spark, sf_dir, "documents").select("doc_id", "text"), pieces=True)
