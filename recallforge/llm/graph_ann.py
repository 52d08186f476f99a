"""Operator 5: approximate nearest neighbours over robust-pruned directed graphs.

Nearness is the inner product.  Vectors get one more component,
``sqrt(M - |x|^2)`` for the largest squared norm M, and queries a zero, so the
largest inner product is the smallest Euclidean distance (exactly, for any norms).

Rows are dealt by a hash of vec_id to shards of about ``shard_rows`` vectors; each
shard becomes one graph.  A batch of points searches the graph so far greedily;
what the searches propose is pruned robustly: the nearest candidate becomes a
neighbour, and candidates that are ``alpha`` times nearer to it than to the point
go.  Reverse edges are added, and nodes that overflow are pruned again; a second
pass relaxes ``alpha`` above 1, which keeps diverse, longer edges.  Every row is
indexed.  The index is written to the shared folder.

A query runs a beam search in every shard; the nearest of all shards are ranked by
the double-precision product of the original vectors.  A task holds one shard, read
once, while all queries stream past it in batches, so no graph is moved twice and
memory does not grow with the queries.  Moving and searching grow with queries times
shards: larger shards make fewer of both, at longer tasks.

Equal vectors are one node with its ``k + 1`` smallest ids: no other id of them can
be among any k nearest, since ties go to the smaller id.

Vectors that are null, zero, hold a null or non-finite component, differ in length
from the most frequent length (ties: the shorter), or have no vec_id take no part.  A
repeated vec_id counts once, with the smallest of its vectors, component by component.
Fewer candidates than k: all.  Empty table: no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from recallforge.llm import _io

SHARD_ROWS = 16_384
DEGREE = 32
BEAM = 56
SEARCH_BEAM = 128
ALPHA = 1.2


def _distances(x: np.ndarray, norm: np.ndarray, p: np.ndarray, pn: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each row's point to its listed nodes; -1: infinite."""
    at = np.maximum(ids, 0)
    d = norm[at] + pn[:, None] - 2 * np.einsum("qd,qcd->qc", p, x[at], optimize=True)
    return np.where(ids < 0, np.float32(np.inf), np.maximum(d, 0))


def _first_of_equals(ids: np.ndarray) -> np.ndarray:
    """True where an id appears in its row for the first time."""
    order = np.argsort(ids, axis=1, kind="stable")
    s = np.take_along_axis(ids, order, 1)
    new = np.ones_like(s, bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    out = np.empty_like(new)
    np.put_along_axis(out, order, new, 1)
    return out


def beam_search(x: np.ndarray, norm: np.ndarray, graph: np.ndarray, start: int, p: np.ndarray, beam: int, wide: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the ``beam`` nearest nodes each query meets, nearest
    first; -1 where fewer are met.  ``wide`` nodes of each beam open at a time."""
    q = len(p)
    pn = (p * p).sum(1)
    ids = np.full((q, beam), -1, np.int32)
    dist = np.full((q, beam), np.inf, np.float32)
    opened = np.ones((q, beam), bool)
    ids[:, 0] = start
    dist[:, 0] = _distances(x, norm, p, pn, ids[:, :1])[:, 0]
    opened[:, 0] = False
    seen = np.zeros((q, len(x)), bool)
    seen[:, start] = True
    live = np.arange(q)
    while len(live):
        shut = ~opened[live]
        pick = np.argsort(~shut, axis=1, kind="stable")[:, :wide]
        real = np.take_along_axis(shut, pick, 1)
        node = np.where(real, np.take_along_axis(ids[live], pick, 1), -1)
        sub = opened[live]
        np.put_along_axis(sub, pick, True, 1)
        near = np.where((node < 0)[:, :, None], -1, graph[np.maximum(node, 0)]).reshape(len(live), -1)
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)] & _first_of_equals(near)
        near = np.where(fresh, near, -1)
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        all_ids = np.concatenate([ids[live], near], 1)
        all_dist = np.concatenate([dist[live], _distances(x, norm, p[live], pn[live], near)], 1)
        all_open = np.concatenate([sub, ~fresh], 1)
        keep = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        d = np.take_along_axis(all_dist, keep, 1)
        order = np.argsort(d, axis=1)
        keep = np.take_along_axis(keep, order, 1)
        ids[live], dist[live] = np.take_along_axis(all_ids, keep, 1), np.take_along_axis(d, order, 1)
        opened[live] = np.take_along_axis(all_open, keep, 1)
        live = live[~opened[live].all(1)]
    return ids, dist


def robust_prune(x: np.ndarray, norm: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` neighbours of each point out of its candidates."""
    cand = np.where((cand == points[:, None]) | ~_first_of_equals(cand), -1, cand)
    dist = _distances(x, norm, x[points], norm[points], cand)
    order = np.argsort(dist, axis=1)
    cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
    v = x[np.maximum(cand, 0)]
    vn = norm[np.maximum(cand, 0)]
    between = vn[:, :, None] + vn[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    out = np.full((len(points), degree), -1, np.int32)
    alive = cand >= 0
    rows = np.arange(len(points))
    for k in range(degree):
        best = alive.argmax(1)  # candidates are sorted: the first alive is the nearest
        real = alive[rows, best]
        if not real.any():
            break
        out[:, k] = np.where(real, cand[rows, best], -1)
        alive &= ~((alpha * alpha) * between[rows, best] <= dist) | ~real[:, None]
        alive[rows, best] = False
    return out


def build_graph(x: np.ndarray, *, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = 512, seed: int = 7) -> tuple[np.ndarray, int]:
    """(neighbours, start) of float32 vectors; -1 fills the neighbour lists."""
    n = len(x)
    norm = (x * x).sum(1)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    if n <= degree + 1:
        every = np.tile(np.arange(n, dtype=np.int32), (n, 1))
        return np.array([np.delete(every[k], k) for k in range(n)], np.int32).reshape(n, n - 1), start
    room = degree + degree // 2
    rng = np.random.default_rng(seed)
    graph = np.full((n, room), -1, np.int32)
    graph[:, : degree // 2] = rng.integers(0, n, (n, degree // 2), dtype=np.int32)
    fill = np.full(n, degree // 2)
    for relax in (1.0, alpha):
        order = rng.permutation(n).astype(np.int32)
        for a in range(0, n, batch):
            pts = order[a : a + batch]
            ids, _ = beam_search(x, norm, graph, start, x[pts], beam)
            new = robust_prune(x, norm, pts, np.concatenate([ids, graph[pts]], 1), degree, relax)
            graph[pts], fill[pts] = -1, (new >= 0).sum(1)
            graph[pts, :degree] = new
            # reverse edges, grouped by target
            src, dst = np.repeat(pts, degree), new.reshape(-1)
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            targets, first, count = np.unique(dst, return_index=True, return_counts=True)
            place = np.arange(len(dst)) - np.repeat(first, count)
            fits = fill[targets] + count <= room
            ok = np.repeat(fits, count)
            graph[dst[ok], fill[dst[ok]] + place[ok]] = src[ok]
            fill[targets[fits]] += count[fits]
            full = targets[~fits]
            if len(full):
                extra = np.full((len(full), int(count[~fits].max())), -1, np.int32)
                row = np.repeat(np.arange(len(full)), count[~fits])
                extra[row, place[~ok]] = src[~ok]
                for b in range(0, len(full), batch):
                    t = full[b : b + batch]
                    kept = robust_prune(x, norm, t, np.concatenate([graph[t], extra[b : b + batch]], 1), degree, relax)
                    graph[t], fill[t] = -1, (kept >= 0).sum(1)
                    graph[t, :degree] = kept
    return graph, start


def _taking_part(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    finite = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(finite & F.exists("v", lambda c: c != 0))
    return rows


def _square(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, c: a + c * c)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def _widened(v: np.ndarray, top: float) -> np.ndarray:
    """One more component, so that the largest product is the smallest distance."""
    return np.concatenate([v, np.sqrt(np.maximum(top - (v * v).sum(1, keepdims=True), 0))], 1).astype(np.float32)


_INDEX = pa.schema([("shard", pa.int32()), ("position", pa.int32()), ("start", pa.int32()), ("ids", pa.list_(pa.int64())), ("v", pa.list_(pa.float64())), ("near", pa.list_(pa.int32()))])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(shard, rows) for each run of one shard in a batch; rows are sorted by shard."""
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield int(shard[a]), batch.slice(a, b - a)


def _index(top: float, degree: int, beam: int, alpha: float):
    def graph(shard: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, ids = np.concatenate([_matrix(p.column("v")) for p in parts]), pa.concat_arrays([p.column("ids") for p in parts])
        near, start = build_graph(_widened(v, top), degree=degree, beam=beam, alpha=alpha)
        for a in range(0, len(v), 4096):
            part, g = v[a : a + 4096], near[a : a + 4096]
            off = np.arange(0, part.size + 1, v.shape[1], dtype=np.int32)
            at = np.concatenate([[0], np.cumsum((g >= 0).sum(1))]).astype(np.int32)
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(a, a + n, dtype=np.int32)), pa.array(np.full(n, start, np.int32)), ids.slice(a, n),
                    pa.ListArray.from_arrays(pa.array(off), pa.array(part.reshape(-1))), pa.ListArray.from_arrays(pa.array(at), pa.array(g[g >= 0].astype(np.int32))),
                ],
                schema=_INDEX,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for shard, rows in _runs(batches):
            if shard != now and parts:
                yield from graph(now, parts)
                parts = []
            now = shard
            parts.append(rows)
        if parts:
            yield from graph(now, parts)

    return run


class _Shard:
    """One shard's graph, from index rows in order of position."""

    def __init__(self, parts: list[pa.RecordBatch], top: float):
        self.v = np.concatenate([_matrix(p.column("v")) for p in parts])
        self.x = _widened(self.v, top)
        self.norm = (self.x * self.x).sum(1)
        self.start = int(parts[0].column("start")[0].as_py())
        self.ids = pa.concat_arrays([p.column("ids") for p in parts])
        near = pa.concat_arrays([p.column("near") for p in parts])
        off = near.offsets.to_numpy()
        count = np.diff(off)
        self.graph = np.full((len(self.x), max(1, int(count.max(initial=0)))), -1, np.int32)
        row = np.repeat(np.arange(len(count)), count)
        self.graph[row, np.arange(off[-1] - off[0]) - np.repeat(off[:-1] - off[0], count)] = near.flatten().to_numpy()

    def nearest(self, own: np.ndarray, q: np.ndarray, k: int, beam: int) -> list[tuple[int, int, float]]:
        found: list[tuple[int, int, float]] = []
        p = np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32)
        near, _ = beam_search(self.x, self.norm, self.graph, self.start, p, min(max(beam, k + 1), len(self.x)))
        for me, u, nodes in zip(own.tolist(), q, near, strict=True):
            nodes = nodes[nodes >= 0]
            score = self.v[nodes] @ u
            order = np.argsort(-score, kind="stable")
            # ties at the edge need every node of that score
            edge = score[order[min(k, len(order) - 1)]]
            rows = [(-float(score[o]), i) for o in order[score[order] >= edge] for i in self.ids[int(nodes[o])].as_py() if i != me]
            rows.sort()
            found += [(me, i, -s) for s, i in rows[:k]]
        return found


def _search(top: float, k: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, shard = None, [], None
        for number, rows in _runs(batches):
            if number != now:
                now, parts, shard = number, [], None
            query = rows.column("query").to_numpy(zero_copy_only=False)
            if not query.all():
                parts.append(rows.filter(pa.array(~query)))
            if not query.any() or not parts:
                continue  # queries of a shard without rows find nothing there
            shard = shard or _Shard(parts, top)
            asked = rows.filter(pa.array(query))
            for a in range(0, asked.num_rows, 512):
                part = asked.slice(a, 512)
                found = shard.nearest(part.column("vec_id").to_numpy(), _matrix(part.column("v")), k, beam)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else ([], [], []), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return run


def build_index(vectors: DataFrame, *, k: int = 20, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[DataFrame, DataFrame, float]:
    """(index, rows that take part, largest squared norm)."""
    rows = _taking_part(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(_square(F.col("v"))).alias("top")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return rows.select(F.lit(0).alias("shard"), "v").limit(0), rows, 0.0
    rows = rows.where(F.size("v") == sizes.d).groupBy("vec_id").agg(F.min("v").alias("v"))
    # equal vectors: their k + 1 smallest ids, in two steps so that none is one task's
    same = ["h1", "h2"]
    marked = rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")).withColumn("salt", F.pmod("vec_id", F.lit(64)))
    first = Window.partitionBy(*same, "salt").orderBy("vec_id")
    again = Window.partitionBy(*same).orderBy("vec_id")
    few = marked.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).withColumn("_r", F.row_number().over(again)).where(F.col("_r") <= k + 1)
    nodes = few.groupBy(*same).agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))
    shards = max(1, -(-sizes.n // shard_rows))
    node = F.get("ids", F.lit(0))
    nodes = nodes.select(F.pmod(F.xxhash64(node), F.lit(shards)).cast("int").alias("shard"), node.alias("node"), "ids", "v")
    index = nodes.repartitionById(shards, "shard").sortWithinPartitions("shard", "node").mapInArrow(_index(sizes.top, degree, beam, alpha), "shard int, position int, start int, ids array<long>, v array<double>, near array<int>")
    return _io.written(index, "graph"), rows, sizes.top


def search(index: DataFrame, queries: DataFrame, top: float, *, k: int = 20, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest, by all shards.
    ``queries``: vec_id, v."""
    last = index.agg(F.max("shard")).first()[0]
    empty = lambda kind: F.lit(None).cast(kind)
    left = index.select("shard", F.lit(False).alias("query"), "position", "start", "ids", "near", empty("long").alias("vec_id"), "v")
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    right = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(last))).alias("shard"), F.lit(True).alias("query"), F.lit(0).alias("position"), F.lit(0).alias("start"),
        F.array().cast("array<long>").alias("ids"), F.array().cast("array<int>").alias("near"), "vec_id", "v",
    )
    rows = left.unionByName(right).repartitionById(last + 1, "shard").sortWithinPartitions("shard", "query", "position")
    found = rows.mapInArrow(_search(top, k, beam), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, rows, top = build_index(_io.table(spark, sf_dir, "embeddings"))
    if not top:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, rows.where("vec_id % 20 = 0"), top)
