"""Structured recall: supplements, enrichment, traversal, surrogate answers."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame, Window, functions as F

from recallforge import shared
from recallforge.operators import ranking


def supplement(states: DataFrame, context: DataFrame, seen: DataFrame, most: int, *, since: Column | None = None, current_only: bool = False) -> DataFrame:
    """entity_id, node_id: states of the query's entities that are not among the
    candidates yet, newest first, ``most`` in all."""
    s = states.join(F.broadcast(context.select("entity_id").distinct()), "entity_id", "left_semi")  # a query names few entities
    if since is not None:
        s = s.where(F.col("created_at") > since)
    if current_only:
        from recallforge.operators import state

        s = state.current(s)
    fresh = s.join(seen.select("node_id"), "node_id", "left_anti")
    return fresh.orderBy(F.desc("created_at"), F.desc("node_id")).limit(most).select("entity_id", "node_id")


def enrich(results: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id with the targets of its edges, one sorted array per edge type."""
    kinds = ["supports", "supersedes", "conflicts", "refines", "caused_by"]
    e = results.select("node_id").join(edges, results["node_id"] == edges["source_id"], "left")
    return e.groupBy("node_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("edge_type") == k, F.col("target_id")))).alias(k) for k in kinds])


def siblings(members: DataFrame, seed: DataFrame, most: int) -> DataFrame:
    """seed_id, member_id: others of the seed's episode, ``most`` for each seed."""
    s = seed.select(F.col("member_id").alias("seed_id"), "episode_id")
    pairs = s.join(members, "episode_id").where("member_id <> seed_id").select("seed_id", "member_id")
    return ranking.per_group(pairs, ["seed_id"], ["member_id"], most)


def top_down(summaries: DataFrame, members: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, level, node: an abstract, the episodes it summarises, their members."""
    one = seeds.join(summaries, seeds["node"] == summaries["abstract_id"]).select(F.col("node").alias("seed"), F.col("episode_id").alias("node"))
    two = one.join(members, one["node"] == members["episode_id"]).select("seed", F.col("member_id").alias("node"))
    level = lambda d, k: d.select("seed", F.lit(k).alias("level"), "node")
    return level(seeds.select(F.col("node").alias("seed"), "node"), 0).unionByName(level(one, 1)).unionByName(level(two, 2))


def bottom_up(summaries: DataFrame, members: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, level, node: a memory, its episodes, the abstracts that summarise them."""
    one = seeds.join(members, seeds["node"] == members["member_id"]).select(F.col("node").alias("seed"), F.col("episode_id").alias("node"))
    two = one.join(summaries, one["node"] == summaries["episode_id"]).select("seed", F.col("abstract_id").alias("node"))
    level = lambda d, k: d.select("seed", F.lit(k).alias("level"), "node")
    return level(seeds.select(F.col("node").alias("seed"), "node"), 0).unionByName(level(one, 1)).unionByName(level(two, 2).distinct())


def surrogate(entries: DataFrame, agent: str, words: Column, text: Column, key: str, share: float = 0.8) -> DataFrame:
    """agent, key, confidence: the snapshot entry that shares most of the question's
    terms, its share times ``share``; none without overlap."""
    s = entries.withColumn("_s", F.size(F.array_intersect(text, words)) / F.size(words)).where("_s > 0")
    return s.groupBy(agent).agg(F.min_by(key, F.struct((-F.col("_s")).alias("s"), key)).alias(key), (share * F.max("_s")).alias("confidence"))


def canonical(surfaces: DataFrame, aliases: DataFrame) -> DataFrame:
    """surface, subject, confidence: exact alias 1.0, normal form .85, else a new
    subject of the slug, .6.  aliases: alias, subject."""
    from recallforge.functions import text as T

    exact = aliases.groupBy(F.col("alias").alias("surface")).agg(F.min("subject").alias("_e"))
    normal = aliases.groupBy(T.normal_surface(F.col("alias")).alias("_n")).agg(F.min("subject").alias("_m"))
    j = surfaces.withColumn("_n", T.normal_surface(F.col("surface"))).join(exact, "surface", "left").join(normal, "_n", "left")
    subject = F.coalesce("_e", "_m", F.concat(F.lit("subject:"), T.slug(F.col("surface"))))
    return j.select("surface", subject.alias("subject"), F.when(F.col("_e").isNotNull(), 1.0).when(F.col("_m").isNotNull(), 0.85).otherwise(0.6).alias("confidence"))


#: What each signal of an episode match weighs.
EPISODE_WEIGHTS = {"bm25": 0.20, "sparse": 0.20, "overlap": 0.25, "domain": 0.15, "near": 0.10, "agent": 0.05, "anchor": 0.05}


def episode_score(bm25: Column, sparse: Column | None, overlap: Column, domain: Column, age: Column, agent: Column, anchor: Column, window: float = 1440 * 60.0) -> Column:
    """Match of a fragment to an open episode, 0 to 1 (.30 and more joins).  ``domain``
    is the share of domains in common.  Without a sparse engine its weight goes to the
    others in proportion."""
    soft = lambda c: c / (1 + c)
    near = F.when((age >= 0) & (age <= window), 1 - age / window).otherwise(0.0)
    parts = {"bm25": soft(bm25), "overlap": overlap, "domain": domain.cast("double"), "near": near, "agent": agent.cast("double"), "anchor": anchor.cast("double")}
    if sparse is not None:
        parts["sparse"] = soft(sparse)
    scale = 1.0 if sparse is not None else 1.0 / (1.0 - EPISODE_WEIGHTS["sparse"])
    return sum((EPISODE_WEIGHTS[n] * scale * c for n, c in parts.items()), F.lit(0.0))


class EpisodeWalk:
    """Fragments of one piece in the order of time: each joins the open episode that
    matches it best, or opens one.  Only episodes that share an entity are compared; where
    many do, the latest come first, until no older one can match better."""

    def __init__(self, least: float, minutes: int, create: int):
        self.least, self.window, self.create = least, minutes * 60.0, create
        self.scale = 1.0 / (1.0 - EPISODE_WEIGHTS["sparse"])
        self.weights = tuple(EPISODE_WEIGHTS[w] for w in ("overlap", "domain", "near"))
        self.opened: OrderedDict[int, list] = OrderedDict()  # id -> entities, last time in seconds; by last time
        self.holding: dict[str, set[int]] = {}  # entity -> open episodes

    def hold(self, episode: int, names: set[str], at: float) -> None:
        latest = self.opened[next(reversed(self.opened))][1] if self.opened else at
        found = self.opened.setdefault(episode, [set(), at])
        for n in names - found[0]:
            self.holding.setdefault(n, set()).add(episode)
        found[0] |= names
        found[1] = max(found[1], at)
        self.opened.move_to_end(episode)
        if found[1] < latest:  # only among episodes of earlier batches
            self.opened = OrderedDict(sorted(self.opened.items(), key=lambda e: e[1][1]))

    def _close(self, episode: int) -> None:
        for n in self.opened.pop(episode)[0]:
            self.holding[n].discard(episode)
            if not self.holding[n]:
                del self.holding[n]

    def _best(self, at: float, names: set[str]) -> tuple[float, int | None]:
        """The best match and its score; of equal ones the smallest id."""
        best, where = 0.0, None
        overlap, domain, near = self.weights
        held = [h for h in map(self.holding.get, names) if h]
        few = 4 * sum(map(len, held)) < len(self.opened)
        for e in set().union(*held) if few else reversed(self.opened) if held else ():
            members, last = self.opened[e]
            age = near * (1 - (at - last) / self.window)
            if not few and self.scale * (overlap + domain + age) < best:
                break
            if common := len(names & members):
                s = self.scale * (overlap * (common / min(len(names), len(members))) + domain + age)
                if s > best or (s == best and where is not None and e < where):
                    best, where = s, e
        return best, where

    def place(self, fragment: int, at: float, names: set[str]) -> int | None:
        """The fragment's episode; None if it joins and opens none."""
        self.close_before(at)
        best, where = self._best(at, names)
        if where is None or best < self.least:
            if len(names) < self.create:
                return None
            where = fragment
        self.hold(where, names, at)
        return where

    def close_before(self, at: float) -> None:
        """Lets go of what has ended by then."""
        while self.opened and at - self.opened[next(iter(self.opened))][1] > self.window:
            self._close(next(iter(self.opened)))


def _pieces(rows: DataFrame, by: str, minutes: int) -> DataFrame:
    """``rows`` (kind, id, by, at, entities) with ``piece``: rows of a domain that no
    chain of shared entities joins never meet, nor do those of a chain that ``minutes``
    of silence part.  Chains are those of entities, so that rows are no nodes; silence is
    found between spans of ``minutes``, within which there is none, and not between rows.
    Should two pieces of a domain bear one number, they are walked as one, with the same
    members."""
    from recallforge.operators import graph

    node = lambda e: F.xxhash64(F.col(by), e)
    first = F.get("entities", F.lit(0))
    others = rows.select(node(first).alias("src"), F.explode(F.slice("entities", 2, F.greatest(F.size("entities"), F.lit(1)))).alias("e"), by)
    found = shared.kept(graph.components(others.select("src", node(F.col("e")).alias("dst"))))
    me = F.when(F.size("entities") > 0, node(first)).otherwise(F.xxhash64(F.lit("row"), "kind", "id"))
    width = max(1, minutes * 60_000_000)
    placed = rows.withColumns({"_me": me, "_span": F.unix_micros("at") - F.pmod(F.unix_micros("at"), F.lit(width))})
    sizes = placed.groupBy("_me").agg(F.count("*").alias("n"))
    hot = shared.hot_keys(sizes, "_me", "n", rows.count())
    placed = shared.salted_join(placed, found.withColumnRenamed("node", "_me"), "_me", hot, ["kind", "id"], "left").withColumn("_c", F.coalesce("component", "_me"))
    spans = placed.groupBy("_c", "_span").agg(F.min("at").alias("_from"), F.max("at").alias("_till"))
    w = Window.partitionBy("_c").orderBy("_span")
    gap = F.coalesce(F.col("_from") > F.lag("_till").over(w) + F.expr(f"interval {minutes} minutes"), F.lit(False))
    spans = spans.withColumn("_gap", gap.cast("int")).select("_c", "_span", F.xxhash64("_c", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("piece"))
    return placed.join(spans, ["_c", "_span"]).drop("_me", "_c", "_span", "component")


def episode_step(fragments: DataFrame, opened: DataFrame | None, by: str, *, least: float = 0.30, minutes: int = 1440, create: int = 2) -> DataFrame:
    """What a batch of fragments does to the open episodes: rows of kind ``member``
    (fragment_id, episode_id), and one of kind ``open`` for each episode that is open at
    the end of its piece (episode_id, by, entities, at).

    Pieces stream through their tasks in the order of time, so a task holds the open
    episodes of one piece and not its rows."""
    import pyarrow as pa

    domain = dict(fragments.dtypes)[by]
    rows = fragments.select(F.lit("f").alias("kind"), F.col("fragment_id").cast("long").alias("id"), by, F.col("at").cast("timestamp").alias("at"), F.col("entities").cast("array<string>").alias("entities"))
    if opened is not None:
        rows = rows.unionByName(opened.select(F.lit("e").alias("kind"), F.col("episode_id").alias("id"), by, "at", "entities"))
    rows = rows.where("at is not null and id is not null").withColumn("entities", F.coalesce(F.array_distinct(F.filter("entities", lambda e: e.isNotNull())), F.array().cast("array<string>")))
    # episodes of earlier batches come first in their piece, however young they are
    order = ["piece", by, F.when(F.col("kind") == "e", 0).otherwise(1), "at", "id"]
    schema = pa.schema([("kind", pa.string()), ("fragment_id", pa.int64()), ("episode_id", pa.int64()), ("by", pa.string()), ("entities", pa.list_(pa.string())), ("micros", pa.int64())])

    def run(batches):
        piece, walk, last, of = None, None, None, None
        out: list[tuple] = []

        def ends():
            if walk is not None:
                walk.close_before(last / 1e6)
                out.extend(("open", None, e, of, sorted(names), round(at * 1e6)) for e, (names, at) in walk.opened.items())

        def batch_of():
            cols = zip(*out, strict=True) if out else [[]] * 6
            made = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
            out.clear()
            return made

        for batch in batches:
            for p, kind, i, d, at, names in zip(*(batch.column(c).to_pylist() for c in ("piece", "kind", "id", "by", "micros", "entities")), strict=True):
                if p != piece or d != of:
                    ends()
                    piece, walk, last, of = p, EpisodeWalk(least, minutes, create), at, d
                last = max(last, at)
                if kind == "e":
                    walk.hold(i, set(names), at / 1e6)
                    continue
                where = walk.place(i, at / 1e6, set(names))
                if where is not None:
                    out.append(("member", i, where, d, None, at))
            yield batch_of()
        ends()
        yield batch_of()

    ready = _pieces(rows, by, minutes).repartition("piece").sortWithinPartitions(*order)
    ready = ready.select("piece", "kind", "id", F.col(by).cast("string").alias("by"), F.unix_micros("at").alias("micros"), "entities")
    found = ready.mapInArrow(run, "kind string, fragment_id long, episode_id long, by string, entities array<string>, micros long")
    return found.select("kind", "fragment_id", "episode_id", F.col("by").cast(domain).alias(by), "entities", F.timestamp_micros("micros").alias("at"))


def assign_episodes(fragments: DataFrame, by: str, *, least: float = 0.30, minutes: int = 1440, create: int = 2) -> DataFrame:
    """fragment_id, episode_id: fragments (at, entities) of a domain in time order; each
    joins the open episode that matches it best, by ``episode_score`` without text
    signals, or opens one when it has ``create`` entities or more.  An episode closes
    ``minutes`` after its last member."""
    step = episode_step(fragments, None, by, least=least, minutes=minutes, create=create)
    return step.where("kind = 'member'").select("fragment_id", "episode_id")


def trajectory_scores(t: DataFrame, weights: dict[str, float], *, alpha: float = 0.2, decay: float = 0.05, least: int = 1) -> DataFrame:
    """Heuristics of paths (length, nodes, explained, total, days, supports, skipped)
    and ``score``, their weighted sum: the share of state keys explained, parsimony
    beyond ``least`` steps, recency of the terminal (0 if its age is unknown), support
    per node, and the share of edges that a counterfactual need not skip."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    s = t.withColumns({
        "explanatory": F.least(F.lit(1.0), share("explained", "total")),
        "parsimony": 1 / (1 + alpha * F.greatest(F.lit(0), F.col("length") - least)),
        "recency": F.when(F.col("days").isNull(), 0.0).otherwise(F.exp(-decay * F.greatest(F.lit(0.0), F.col("days").cast("double")))),
        "robustness": F.least(F.lit(1.0), share("supports", "nodes")),
        "counterfactual": F.when(F.col("length") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("skipped") / F.col("length"))),
    })
    return s.withColumn("score", sum((w * F.col(h) for h, w in weights.items()), F.lit(0.0)))


def ranked_trajectories(scored: DataFrame, by: list[str], first: str) -> DataFrame:
    """``place`` of each path: by score, ties to the larger first node."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc(first))))


def gazetteer(texts: DataFrame, key: str, tokens: str, catalogue: DataFrame, most: int = 4) -> DataFrame:
    """key, start, length, canonical: catalogue surfaces in token arrays, leftmost
    and longest, not overlapping.  Candidates come from an equi-join on n-grams."""
    w = texts.select(key, tokens, F.explode(F.sequence(F.lit(1), F.lit(most))).alias("_n")).where(F.size(tokens) >= F.col("_n"))
    g = w.select(key, F.col("_n"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(tokens) - F.col("_n") + 1), lambda i: F.concat_ws(" ", F.slice(tokens, i, F.col("_n"))))).alias("start", "surface"))
    hits = g.join(catalogue.select("surface", "canonical"), "surface").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("_n")).alias("_l"), "canonical"))).alias("_h"))
    none = F.array().cast("array<struct<start:int,length:int,canonical:string>>")
    step = lambda acc, h: F.when(h["start"] >= acc["end"], F.struct((h["start"] - h["_l"]).alias("end"), F.array_append(acc["kept"], F.struct(h["start"].alias("start"), (-h["_l"]).alias("length"), h["canonical"].alias("canonical"))).alias("kept"))).otherwise(acc)
    kept = F.aggregate("_h", F.struct(F.lit(0).alias("end"), none.alias("kept")), step, lambda acc: acc["kept"])
    return hits.select(key, F.explode(kept).alias("_k")).select(key, "_k.*")


def _tile_overlaps(key, rows):
    """common, union, pairs of one tile: the pairs whose first common x is the
    tile's, so that each pair counts once."""
    import numpy as np
    import pandas as pd

    x, row_block, col_block = key
    sizes = rows["xs"].map(len).to_numpy()
    names, at = np.unique(np.concatenate(rows["xs"].to_numpy()), return_inverse=True)
    has = np.zeros((len(rows), len(names)), np.float32)
    has[np.repeat(np.arange(len(rows)), sizes), at] = 1
    up = rows["block"].to_numpy() == row_block
    a, b = np.flatnonzero(up), np.flatnonzero(up if row_block == col_block else ~up)
    first = int(np.searchsorted(names, x))
    mine = has[a, :first] @ has[b, :first].T == 0
    if row_block == col_block:
        mine = np.triu(mine, 1)
    common = (has[a] @ has[b].T)[mine].astype(np.int64)
    union = (sizes[a][:, None] + sizes[b][None, :])[mine] - common
    base = int(union.max(initial=0)) + 1
    k, n = np.unique(common * base + union, return_counts=True)
    return pd.DataFrame({"common": k // base, "union": k % base, "pairs": n})


def overlap_counts(rows: DataFrame, tile: int = 1024) -> DataFrame:
    """common, union, pairs: how many pairs of ids (id, x) share ``common`` of their
    ``union`` x, for common > 0.  No pair becomes a row: an x of many ids is dealt in
    tiles, each a matrix product."""
    s = rows.select("id", "x").where("id is not null and x is not null").distinct()
    sets = s.groupBy("id").agg(F.collect_list("x").alias("xs"))
    wide = s.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").select("x", F.ceil(F.col("n") / tile).cast("int").alias("blocks"))
    m = sets.select("id", "xs", F.explode("xs").alias("x")).join(wide, "x").withColumn("block", F.pmod(F.xxhash64("id", "x"), F.col("blocks")).cast("int"))
    places = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least("block", b).alias("row_block"), F.greatest("block", b).alias("col_block")))
    placed = m.select("x", "block", "xs", F.explode(places).alias("p")).select("x", "p.row_block", "p.col_block", "block", "xs")
    found = placed.groupBy("x", "row_block", "col_block").applyInPandas(_tile_overlaps, "common long, union long, pairs long")
    return found.groupBy("common", "union").agg(F.sum("pairs").alias("pairs"))


def overlap_statistics(rows: DataFrame, tile: int = 1024) -> DataFrame:
    """One row: total (pairs of ids), pairs (that share an x), fraction, and mean,
    median, most and sd (sample) of the Jaccard of the pairs that share one; 0 where
    there is none.  The counts have a row per (common, union), few and small."""
    h = overlap_counts(rows, tile).withColumn("j", F.col("common") / F.col("union")).groupBy("j").agg(F.sum("pairs").alias("p"))
    ids = rows.where("id is not null and x is not null").agg(F.countDistinct("id").alias("ids"))
    h = h.withColumns({"upto": F.sum("p").over(Window.orderBy("j")), "n": F.sum("p").over(Window.partitionBy()), "m": F.sum(F.col("p") * F.col("j")).over(Window.partitionBy()) / F.sum("p").over(Window.partitionBy())})
    middle = lambda place: F.min(F.when(F.col("upto") >= place, F.col("j")))
    one = h.agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("pairs"),
        F.coalesce(F.max("m"), F.lit(0.0)).alias("mean"),
        F.coalesce((middle(F.floor((F.col("n") + 1) / 2)) + middle(F.floor(F.col("n") / 2) + 1)) / 2, F.lit(0.0)).alias("median"),
        F.coalesce(F.max("j"), F.lit(0.0)).alias("most"),
        F.coalesce(F.sqrt(F.sum(F.col("p") * (F.col("j") - F.col("m")) ** 2) / F.nullif(F.max("n") - 1, F.lit(0))), F.lit(0.0)).alias("sd"),
    )
    total = F.expr("ids * (ids - 1) div 2")
    return one.crossJoin(ids).select(total.alias("total"), "pairs", (F.col("pairs") / F.greatest(total, F.lit(1))).alias("fraction"), "mean", "median", "most", "sd")


def timeline(links: DataFrame, states: DataFrame, seeds: DataFrame, *, entities: int = 5, most: int = 20) -> DataFrame:
    """seed, place, entity_id, node_id: the states of a seed's first entities in time
    order, entity by entity, each node once, ``most`` for each seed."""
    own = ranking.per_group(seeds.join(links, seeds["seed"] == links["memory_id"]).select("seed", "entity_id").distinct(), ["seed"], ["entity_id"], entities)
    rows = own.join(states.select("entity_id", "node_id", "created_at"), "entity_id")
    w = Window.partitionBy("seed").orderBy("entity_id", "created_at", "node_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("seed", "place", "entity_id", "node_id")


def related_episodes(topics: DataFrame, seeds: DataFrame, parts: int = 16) -> DataFrame:
    """seed, episode_id: other episodes that share a topic entity (episode_id, entity)
    with a seed's episodes.  A pair is made at the first entity that both have, so none is
    made twice and no pair is moved: only an entity with those before it is.  Episodes of an
    entity are dealt over ``parts`` tasks, to each of which its seeds go."""
    t = topics.where("entity is not null")
    mine = seeds.select("seed", "episode_id").join(t, "episode_id").groupBy("seed").agg(F.array_sort(F.collect_set("entity")).alias("_e"))
    own = seeds.groupBy("seed").agg(F.collect_set("episode_id").alias("_own"))
    before = lambda name: F.slice("_e", F.lit(1), F.col("_i")).alias(name)
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    left = mine.join(own, "seed").select("seed", "_own", "_e", F.posexplode("_e").alias("_i", "entity")).select("seed", "_own", "entity", before("_mine")).withColumn("_p", F.explode(every))
    sets = t.groupBy("episode_id").agg(F.array_sort(F.collect_set("entity")).alias("_e"))
    right = sets.select("episode_id", "_e", F.posexplode("_e").alias("_i", "entity")).select("episode_id", "entity", before("_theirs"), F.pmod(F.xxhash64("episode_id"), F.lit(parts)).cast("int").alias("_p"))
    first = ~F.arrays_overlap("_mine", "_theirs")
    return left.join(right, ["entity", "_p"]).where(first & ~F.array_contains("_own", F.col("episode_id"))).select("seed", "episode_id")


def episode_bonus(hits: DataFrame, edges: DataFrame, nodes: DataFrame, seen: DataFrame, *, most: int = 5) -> DataFrame:
    """memory_id: memories behind what the best abstracts among the hits (memory_id,
    score, node_id) summarise or derive from, that are not among the results yet."""
    best = hits.orderBy(F.desc("score"), "memory_id").limit(most).select(F.col("node_id").alias("source_id"))
    to = edges.where(F.col("edge_type").isin("derived_from", "summarizes")).join(F.broadcast(best), "source_id", "left_semi").select(F.col("target_id").alias("node_id"))
    return nodes.join(to, "node_id", "left_semi").select("memory_id").distinct().join(seen.select("memory_id"), "memory_id", "left_anti")


def state_bonus(states: DataFrame, entities: DataFrame, seen: DataFrame, *, current_only: bool, most: int = 5) -> DataFrame:
    """memory_id, place: memories behind states (entity_id, state_key, node_id, memory_id,
    created_at) of the question's first ``most`` entities (entity_id, nth) that are not
    among the results (memory_id) yet, entity by entity, oldest state first."""
    mine = states.join(F.broadcast(entities.where(F.col("nth") < most)), "entity_id")
    if current_only:
        from recallforge.operators import state

        mine = state.current(mine)
    fresh = mine.where("memory_id is not null").join(F.broadcast(seen.select("memory_id")), "memory_id", "left_anti")
    first = fresh.groupBy("memory_id").agg(F.min(F.struct("nth", "created_at", "node_id")).alias("_at"))
    return first.withColumn("place", F.row_number().over(Window.orderBy("_at"))).drop("_at")  # states of few entities


def synthesis(hits: DataFrame, budget: int, by: str = "score") -> DataFrame:
    """One row, content and used: texts of the hits (memory_id, score, content) in order
    as long as they fit the budget of characters, as numbered excerpts.  A bounded
    result list."""
    w = Window.orderBy(F.desc(by), "memory_id")
    r = hits.withColumns({"place": F.row_number().over(w), "used": F.sum(F.length("content")).over(w)}).where(F.col("used") <= budget)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "content"))), lambda s: F.concat(F.lit("["), s["place"].cast("string"), F.lit("] "), s["content"]))
    return r.agg(F.array_join(lines, "\n").alias("content"), F.coalesce(F.max("used"), F.lit(0)).alias("used"))


def answered(asks: DataFrame, live: DataFrame, snapshots: DataFrame, share: float = 0.8) -> DataFrame:
    """ask_id, mode, confidence: the best live answer (ask_id, confidence) to each ask,
    else what the agent's snapshot (agent, confidence) says at ``share`` of it, else none."""
    best = live.groupBy("ask_id").agg(F.max("confidence").alias("_l"))
    j = asks.join(best, "ask_id", "left").join(snapshots.select("agent", F.col("confidence").alias("_s")), "agent", "left")
    mode = F.when(F.col("_l").isNotNull(), "live").when(F.col("_s").isNotNull(), "warm").otherwise("none")
    return j.select("ask_id", mode.alias("mode"), F.coalesce("_l", share * F.col("_s")).alias("confidence"))
