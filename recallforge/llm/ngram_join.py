"""Operator 1: n-gram Jaccard join by chosen paths.

Texts are sets of hashed five-word shingles (all words, if fewer).  Documents with
equal sets form one record.  Records are split recursively: at each node of a path
a record goes to the children named by its two smallest tokens under a hash seeded
by that node, so records that share a sampled token meet again.  A bucket of at
most ``small`` records is a leaf.  So is a larger one that splitting would not make
cheaper: the pairs within its grandchildren are as many as its own.  Two records of
similarity t share 2t children, so that shows a group of near copies, while a phrase
that many texts share, which keeps one child together at most, is split on, however
deep.  Records of so few tokens that one token more or less is below the threshold
link with equal ones only, and have no paths.  Leaves are
joined by brute force on the whole sets, exactly; a leaf of more than ``tile``
records, or of very long ones, is dealt as tiles of record blocks, one task each.
Runs repeat until a pair at the threshold is missed with a probability below
``1 - recall``, at any depth (``runs_for``).

What moves: 64-bit paths first; leaves with one record, and all but one of the
leaves with the same members, are dropped before any token set is moved, so only
records with possible partners are, about once for each distinct leaf.  Paths of
the first ``DEPTH`` levels come with the shingles; deeper ones are computed for the
records of buckets that are still too large.  A pair that meets in several leaves is
counted in the first of them only.  No pair is ever emitted: leaves give the number
of links of each record, and edges of a spanning forest (fewer than records).  Joins
on paths and records deal their hot keys over many tasks.

Result, a row per document: ``doc_id``, ``class_id`` (the smallest doc_id of its
group: linked directly or through others) and ``n_links`` (other documents at
Jaccard ``threshold`` or more, copies counted each).

Null text and text without a word: a class of its own and no links.  Null doc_id:
class_id null and no links.  A doc_id of several rows with different texts is one
document for each text; equal rows are one document.  Each row is returned.  Empty
table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from recallforge.llm import _io
from recallforge.llm._text import Words, mix, shingle_sets, slices, utf8
from recallforge.operators.graph import components

SHINGLE = 5
THRESHOLD = (4, 5)
RECALL = 0.99
DEPTH = 3
SMALL = 256
TILE = 768
#: Pairs that stay together in one split of near copies, where only one is known.
ONE_LEVEL = 1.25
#: Tokens of a block of records, so a tile of long texts is not larger in memory.
TILE_TOKENS = 1_000_000


def runs_for(recall: float, threshold: float) -> int:
    """Runs until a pair at the threshold is missed with probability below
    ``1 - recall``, however deep the recursion goes.

    A node takes the two smallest tokens of each record.  Of a pair at Jaccard t the
    two smallest of the union are both common with probability t^2, then both
    children are shared; none is shared with at most (1 - t)^2.  Shared nodes are so
    a branching process that dies out with at most the root of
    e = (1 - t)^2 + (1 - t^2 - (1 - t)^2) e + t^2 e^2, which is ((1 - t) / t)^2."""
    if threshold <= 0.5:
        raise ValueError("two children a node find pairs above a threshold of 1/2 only")
    missed = ((1 - threshold) / threshold) ** 2
    return max(1, math.ceil(math.log(1 - recall) / math.log(missed))) if missed else 1


def _children(tokens: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The two children of each path of ``level``, side by side."""
    h = mix(tokens[None, :] ^ level[:, None])
    if len(tokens) > 2:
        h = np.partition(h, 1, axis=1)[:, :2]
    elif len(tokens) == 1:
        h = np.concatenate([h, h], axis=1)
    return mix(np.sort(h, axis=1) + level[:, None]).reshape(-1)


def _below(tokens: np.ndarray, paths: np.ndarray, levels: int) -> list[list[int]]:
    """For each path, the paths of the ``levels`` levels under it, level by level."""
    deep, level = [], paths
    for k in range(1, levels + 1):
        level = _children(tokens, level)
        deep.append(level.view(np.int64).reshape(len(paths), 2**k))
    return np.concatenate(deep, axis=1).tolist() if deep else [[] for _ in paths]


def _paths(tokens: np.ndarray, runs: int) -> dict[int, list[int]]:
    """First-level path of each run and branch, and the paths under it."""
    first = _children(tokens, mix(np.arange(1, runs + 1, dtype=np.uint64)))
    return dict(zip(first.view(np.int64).tolist(), _below(tokens, first, DEPTH - 1), strict=True))


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _split(runs: int):
    schema = pa.schema([("doc_id", pa.int64()), ("record", pa.binary()), ("tokens", pa.int32()), ("paths", pa.list_(pa.struct([("path", pa.int64()), ("below", pa.list_(pa.int64()))])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for i, j in slices(off):
                sets = shingle_sets(Words(data, off, i, j), SHINGLE)
                paths = []
                for s in sets:
                    paths.append([{"path": p, "below": b} for p, b in _paths(s, runs).items()] if len(s) else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(paths, schema.field("paths").type)],
                    schema=schema,
                )

    return run


_SPLIT = "doc_id long, record binary, tokens int, paths array<struct<path:long,below:array<long>>>"


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (record, text) to (record, set)."""
    for batch in batches:
        data, off = utf8(batch.column("text"))
        for i, j in slices(off, 1 << 20):
            sets = shingle_sets(Words(data, off, i, j), SHINGLE)
            rows = [(r, s.tobytes()) for r, s in zip(batch.column("record").slice(i, j - i).to_pylist(), sets, strict=True) if len(s) and _digest(s) == r]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.binary()), pa.array([s for _, s in rows], pa.binary())], names=["record", "set"])


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (record, open, set): a row per open path with the paths of the next
    DEPTH levels under it."""
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part, out = batch.slice(k, 256), []
            for record, paths, raw in zip(*(part.column(c).to_pylist() for c in ("record", "open", "set")), strict=True):
                s = np.frombuffer(raw, np.uint64)
                below = _below(s, np.array(paths, np.int64).view(np.uint64), DEPTH)
                out += [(record, len(s), p, b) for p, b in zip(paths, below, strict=True)]
            kinds = [pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["record", "tokens", "path", "below"])


_PATHS = "record binary, tokens int, path long, below array<long>"


def _level(paths: DataFrame, small: int, levels: int) -> DataFrame:
    """What becomes of each (path, record) of a level, written: a leaf, to be split
    by its children, or open, where no level below it is known (``levels``).
    A bucket of one record has no pairs and goes."""
    sizes = _io.written(paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    hot = _io.hot_list(sizes, "path", "n")
    placed = _io.salted_join(paths, sizes, "path", hot, ["record"])
    if not levels:
        state = F.when(F.col("n") <= small, "leaf").otherwise("open")
    else:
        first, many, bar = (3, 4, 1.0) if levels > 1 else (1, 2, ONE_LEVEL)
        child = placed.where(F.col("n") > small).select("path", F.explode(F.array_distinct(F.slice("below", first, many))).alias("child"))
        pairs = child.groupBy("path", "child").agg(F.count("*").cast("double").alias("c")).groupBy("path").agg(F.sum(F.col("c") * F.col("c")).alias("c"))
        placed = _io.salted_join(placed, pairs, "path", hot, ["record"], "left")
        state = F.when(F.col("c").isNull() | (F.col("c") >= bar * F.col("n") * F.col("n")), "leaf").otherwise("split")
    placed = placed.withColumn("state", state)
    return _io.written(placed.select("path", "record", "tokens", "state", F.when(F.col("state") == "split", F.col("below")).alias("below")), "level")


def _split_up(level: DataFrame, levels: int) -> DataFrame:
    """The rows of the next level: each record under the children of its path, with
    the paths below them.  ``levels``: how many levels ``below`` holds."""
    parts = []
    for i in range(2):  # child i's own descendants are the i-th part of each level below it
        below, at = F.array().cast("array<long>"), 3
        for k in range(1, levels):
            below = F.concat(below, F.slice("below", at + i * 2**k, 2**k))
            at += 2 ** (k + 1)
        parts.append(F.struct(F.get("below", F.lit(i)).alias("path"), below.alias("below")))
    return level.where("state = 'split'").select("record", "tokens", F.explode(F.array_distinct(F.array(*parts))).alias("k")).select("k.path", "record", "tokens", "k.below").distinct()


def _leaves(paths: DataFrame, small: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """((path, record, tokens) of leaves, (path, record) of buckets still to split):
    ``paths`` has path, record, tokens and below, the paths under it on the next
    ``levels`` levels."""
    leaves = None
    for k in range(levels, -1, -1):
        step = _level(paths, small, k)
        part = step.where("state = 'leaf'").select("path", "record", "tokens")
        leaves = part if leaves is None else leaves.unionByName(part)
        if k:
            paths = _split_up(step, k)
    return leaves, step.where("state = 'open'").select("path", "record")


def _load_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, record, copies, places, text) to a row per place, with tokens."""
    names = ["leaf", "row_block", "col_block", "block", "doc_id", "record", "copies", "leaves", "tokens"]
    for batch in batches:
        data, off = utf8(batch.column("text"))
        for i, j in slices(off, 1 << 20):
            out: list[tuple] = []
            part = batch.slice(i, j - i)
            rows = zip(*(part.column(c).to_pylist() for c in ("doc_id", "record", "copies", "places")), shingle_sets(Words(data, off, i, j), SHINGLE), strict=True)
            for doc, record, copies, places, s in rows:
                if not len(s) or _digest(s) != record:  # another text under the same doc_id
                    continue
                raw, leaves = s.tobytes(), np.array(sorted({p["leaf"] for p in places}), np.int64).tobytes()
                out += [(p["leaf"], p["row_block"], p["col_block"], p["block"], doc, record, copies, leaves, raw) for p in places]
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


_PLACED = "leaf long, row_block int, col_block int, block int, doc_id long, record binary, copies long, leaves binary, tokens binary"


def _incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, column, columns) of the tokens that at least two sets hold."""
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[inverse] > 1
    number = np.cumsum(count > 1) - 1
    return row[keep], number[inverse[keep]], int((count > 1).sum())


def _shared(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, as products of 0/1 blocks (exact:
    counts stay far below 2**24)."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    row, col, n = _incidence(sets)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for a in range(0, n, width):
        lo, hi = np.searchsorted(col, [a, a + width])
        m = np.zeros((len(sets), min(width, n - a)), np.float32)
        m[row[lo:hi], col[lo:hi] - a] = 1
        out += m @ m.T
    return out


def _join_tile(threshold: tuple[int, int]):
    p, q = threshold

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        leaf, rb, cb = (int(k) for k in key)
        rows = rows.drop_duplicates("record").sort_values(["doc_id", "record"], kind="stable").reset_index(drop=True)
        copies = rows["copies"].to_numpy(np.int64)
        sets = [np.frombuffer(t, np.uint64) for t in rows["tokens"]]
        size = np.array([len(s) for s in sets], np.int64)
        both = _shared(sets).astype(np.int64)
        # both / union >= p / q, in whole numbers
        link = q * both >= p * (size[:, None] + size[None, :] - both)
        np.fill_diagonal(link, False)
        if rb != cb:  # two blocks of a large leaf: pairs within a block have a tile of their own
            block = rows["block"].to_numpy()
            link &= block[:, None] != block[None, :]
        # edges of a spanning forest
        forest: list[tuple[int, int]] = []
        left = np.ones(len(rows), bool)
        for k in range(len(rows)):
            if left[k]:
                reach, edge = np.zeros(len(rows), bool), np.array([k])
                reach[k] = True
                while len(edge):
                    new = link[edge].any(axis=0) & ~reach
                    reach |= new
                    edge = np.flatnonzero(new)
                left &= ~reach
                forest += [(int(x), k) for x in np.flatnonzero(reach) if x != k]
        # a pair counts in the first leaf that both records share
        earlier = [s[s < leaf] for s in (np.frombuffer(x, np.int64) for x in rows["leaves"])]
        if any(len(s) for s in earlier) and link.any():
            link &= _shared([s.view(np.uint64) for s in earlier]) == 0
        links = link @ copies
        record = rows["record"]
        own = pd.DataFrame({"record": record[links > 0], "other": None, "links": links[links > 0]})
        tied = pd.DataFrame({"record": record.iloc[[x for x, _ in forest]], "other": record.iloc[[k for _, k in forest]].to_numpy(), "links": 0})
        return pd.concat([x for x in (own, tied) if len(x)] or [own])

    return run


def _classes(docs: DataFrame, threshold: tuple[int, int], recall: float, small: int, tile: int, tile_tokens: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, record) of every row; (record, root, links) of every record; and
    (record, doc_id) of the record that stands for each class."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    runs = runs_for(recall, threshold[0] / threshold[1])
    base = _io.written(docs.mapInArrow(_split(runs), _SPLIT), "paths")
    count = base.count()
    real = base.where("doc_id is not null and record is not null")
    records = real.groupBy("record").agg(F.min("doc_id").alias("first"), F.countDistinct("doc_id").alias("copies"))

    def with_texts(wanted: DataFrame) -> DataFrame:
        """``wanted`` (a row per record) with the text of the record's first document."""
        named = _io.written(wanted.join(records, "record").withColumnRenamed("first", "_id"), "wanted")
        some = _io.sifted(docs, "doc_id", _io.sieve(named, "_id")).where("_maybe")  # no other text is moved
        return some.join(named, some["doc_id"] == named["_id"])

    # one row per record and path, however many copies there are
    p, q = threshold
    linkable = real.where(q * F.col("tokens") >= p * (F.col("tokens") + 1))
    paths = linkable.select("record", "tokens", F.explode("paths").alias("p")).groupBy("record", "p.path").agg(F.first("tokens").alias("tokens"), F.first("p.below").alias("below"))
    leaves, still = _leaves(paths, small, DEPTH - 1)
    # token sets of the records that need deeper paths, moved once
    deep = with_texts(still.select("record").distinct()).select("record", "text").mapInArrow(_whole_sets, "record binary, set binary")
    deep = _io.written(deep.groupBy("record").agg(F.first("set").alias("set")), "sets")
    while not still.isEmpty():
        wanted = still.groupBy("record").agg(F.collect_list("path").alias("open"))
        paths = wanted.join(deep, "record").select("record", "open", "set").mapInArrow(_deeper, _PATHS)
        done, still = _leaves(paths, small, DEPTH)
        leaves = leaves.unionByName(done)
    # leaves with the same members are one leaf
    marks = leaves.groupBy("path").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.bit_xor(F.xxhash64("record")).alias("x"), F.sum(F.shiftright(F.xxhash64(F.lit(7), "record"), 20)).alias("s"))
    blocks = F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("t") / tile_tokens)).cast("int")
    kept = _io.written(marks.groupBy("n", "t", "x", "s").agg(F.min("path").alias("path")).select("path", "n", blocks.alias("blocks")), "kept")
    members = _io.salted_join(leaves, kept.drop("n"), "path", _io.hot_list(kept, "path", "n"), ["record"])
    members = members.withColumn("block", F.pmod(F.xxhash64(F.lit(11), "record", "path"), F.col("blocks")).cast("int"))
    # a record of block b goes to the tiles (b, x) and (x, b)
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.col("path").alias("leaf"), F.least("block", x).alias("row_block"), F.greatest("block", x).alias("col_block"), F.col("block").alias("block")))
    places = members.select("record", F.explode(tiles).alias("place")).groupBy("record").agg(F.collect_list("place").alias("places"))
    placed = with_texts(places).select("doc_id", "record", "copies", "places", "text").mapInArrow(_load_sets, _PLACED)
    found = placed.groupBy("leaf", "row_block", "col_block").applyInPandas(_join_tile(threshold), "record binary, other binary, links long")
    found = _io.written(found, "links")
    links = found.where("other is null").groupBy("record").agg(F.sum("links").alias("links"))
    # records are grouped, not doc_ids, so that two texts under one doc_id stay apart
    groups = components(found.where("other is not null").select(F.col("record").alias("src"), F.col("other").alias("dst"))).withColumnRenamed("node", "record")
    named = records.join(links, "record", "left").join(groups, "record", "left").withColumn("component", F.coalesce("component", "record"))
    heads = named.groupBy("component").agg(F.min(F.struct("first", "record")).alias("head"), F.count("*").alias("n"))
    roots = heads.select("component", F.col("head.first").alias("root"))
    named = _io.salted_join(named, roots, "component", _io.hot_keys(heads, "component", "n", count), ["record"])
    answer = named.select("record", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return base.select("doc_id", "tokens", F.when(F.col("doc_id").isNotNull(), F.col("record")).alias("record")), answer, heads.select("head.record", F.col("head.first").alias("doc_id"))


def classes(
    docs: DataFrame, *, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, small: int = SMALL, tile: int = TILE, tile_tokens: int = TILE_TOKENS
) -> DataFrame:
    """doc_id, class_id, n_links for every row of ``docs`` (doc_id, text)."""
    rows, answer, _ = _classes(docs, threshold, recall, small, tile, tile_tokens)
    sizes = rows.where("record is not null").groupBy("record").agg(F.count("*").alias("n"))
    rows = _io.salted_join(rows, answer, "record", _io.hot_keys(sizes, "record", "n", rows.count()), ["doc_id", "tokens"], "left")
    return rows.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def _marked(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for i, j in slices(off, 1 << 20):
                record = [_digest(s) if len(s) else None for s in shingle_sets(Words(data, off, i, j), SHINGLE)]
                cols = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns)] + [pa.array(record, pa.binary())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def keep_one(docs: DataFrame, *, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, small: int = SMALL, tile: int = TILE, tile_tokens: int = TILE_TOKENS) -> DataFrame:
    """One document of each class stays: the text of the smallest doc_id (of several
    texts under it that are in the class, the one of the smallest digest; of rows
    with equal shingles under it, the first by text and then by the hash of the row).
    Rows without a doc_id and texts without a word stay.  All columns of ``docs``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows, _, heads = _classes(docs, threshold, recall, small, tile, tile_tokens)
    all_, own = _io.apart(docs, "doc_id", "text")
    named = all_.where("doc_id is not null")
    counts = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    several = counts.where("n > 1").select(F.col("doc_id").alias("_several"))
    wordless = rows.where("doc_id is not null and record is null").select("doc_id")
    stay = heads.select("doc_id").unionByName(wordless).join(several, F.col("doc_id") == F.col("_several"), "left_anti").select(F.col("doc_id").alias("_stay"))
    out = named.join(stay, F.col("doc_id") == F.col("_stay"), "left_semi").unionByName(all_.where("doc_id is null"))
    if several.isEmpty():
        return out.select(*own)
    # rows that share a doc_id are told apart by their shingles
    schema = T.StructType([*all_.schema.fields, T.StructField("_record", T.BinaryType())])
    told = named.join(several, F.col("doc_id") == F.col("_several"), "left_semi").mapInArrow(_marked(to_arrow_schema(schema)), schema)
    mine = told.where("_record is not null").join(heads.select(F.col("record").alias("_record"), F.col("doc_id").alias("_head")), "_record").where(F.col("doc_id").cast("long") == F.col("_head"))
    first = Window.partitionBy("doc_id", "_record").orderBy("text", F.xxhash64(*all_.columns))
    mine = mine.withColumn("_place", F.row_number().over(first)).where("_place = 1")
    return out.unionByName(mine.select(*all_.columns)).unionByName(told.where("_record is null").drop("_record")).select(*own)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(_io.table(spark, sf_dir, "documents").select("doc_id", "text"))
