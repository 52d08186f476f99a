"""Graph operators over edge DataFrames.

Iterations move (node, number) rows only and cut their lineage by checkpoint() in
the folder that spark.checkpoint.dir names, so a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from recallforge.shared import HOT_ROWS, cut, dealt, hot_keys, kept, salted_join

#: From nodes (node) to all edges at them, where a walk needs those of few nodes alone.
Edges = Callable[[DataFrame], DataFrame]

#: Rounds between two cuts of an iteration's lineage.
STRIDE = 5
#: Edges for each node from which two of a node are contracted first.
DENSE = 4


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def combines(kinds: int, made: int) -> bool:
    """Whether ``made`` pairs of ``kinds`` things repeat so often that each task should
    count its own before they are moved."""
    return 2 * kinds * max(0, kinds - 1) <= made


def pairs_of(sets: DataFrame, items: str) -> DataFrame:
    """x, y: each pair of the sorted ``items`` of a row, the smaller first."""
    one = sets.select(F.col(items), F.posexplode(items).alias("_p", "x"))
    return one.select("x", F.explode(F.slice(items, F.col("_p") + 2, F.size(items))).alias("y"))


def cooccurrence(links: DataFrame, member: str = "memory_id", entity: str = "entity_id", most: int = 12) -> DataFrame:
    """src < dst, count: entities that share members.  Of a member's entities the
    ``most`` smallest count, as the definition bounds them, so no member makes more
    than most * (most - 1) / 2 pairs.  Pairs are dealt by how many there are."""
    few = links.groupBy(member).agg(F.slice(F.array_sort(F.collect_set(entity)), 1, most).alias("_e"))
    each = few.select(F.explode("_e").alias("e"), (F.size("_e") - 1).alias("k"))
    made, kinds = each.agg(F.coalesce(F.sum("k"), F.lit(0)), F.approx_count_distinct("e")).first()
    pairs = pairs_of(few, "_e").select(F.col("x").alias("src"), F.col("y").alias("dst"))
    pairs = pairs if combines(kinds, made // 2) else pairs.repartition(dealt(made // 2), "src", "dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("count"))


def cooccurrence_at(links: DataFrame, nodes: DataFrame, member: str = "memory_id", entity: str = "entity_id", most: int = 12) -> DataFrame:
    """The edges of ``cooccurrence`` that have an end among ``nodes`` (node): from the members
    that hold one of them alone, whose links are kept as a table; no other pair is made."""
    nodes = kept(nodes.select("node").distinct())
    held = kept(links.join(nodes.select(F.col("node").alias(entity)), entity, "left_semi").select(member).distinct())
    near = cooccurrence(kept(links.select(member, entity).join(held, member, "left_semi")), member, entity, most)
    end = lambda c: nodes.select(F.col("node").alias(c), F.lit(True).alias(f"_{c}"))
    both = near.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    return both.where("_src or _dst").select("src", "dst", "count")


def degree(edges: DataFrame) -> DataFrame:
    """node, degree: edges at either end."""
    ends = edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def hops(edges: DataFrame | Edges, seeds: DataFrame, depth: int) -> DataFrame:
    """seed, node, hop: nodes within ``depth`` undirected steps, seeds excluded."""
    e = None if callable(edges) else both_ways(edges)
    seen = front = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    for k in range(1, depth + 1):
        if callable(edges):
            front = kept(front)
            e = both_ways(edges(front.select("node")))
        step = front.join(e, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(k))
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def spread(edges: DataFrame | Edges, context: DataFrame, idf: DataFrame | None = None, *, decay: float = 0.5, max_hops: int = 2, least: float = 0.001) -> DataFrame:
    """node, activation: spreading from context nodes over weighted undirected edges
    (src, dst, weight); nodes of degree over 4 pass on 1/log2(degree); the largest
    activation per node counts."""

    def flows(edges: DataFrame) -> DataFrame:
        e = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        e = e.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
        deg = e.groupBy("src").agg(F.count("*").alias("_d"))
        damp = F.when(F.col("_d") > 4, 1 / F.log2(F.col("_d"))).otherwise(1.0)
        return e.join(deg, "src").select("src", "dst", (F.col("weight") * damp * decay).alias("_f"))

    e = None if callable(edges) else flows(edges)
    n = max(1, context.count())
    act = context.select("node")
    act = act.join(idf, "node", "left").select("node", (F.coalesce("idf", F.lit(1.0)) / n).alias("activation")) if idf is not None else act.withColumn("activation", F.lit(1.0 / n))
    best = front = act
    for _ in range(max_hops):
        if callable(edges):  # a front node has all its edges, so its degree is right; others do not pass on
            e = flows(edges(front.select("node")))
        front = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("activation") * F.col("_f")).alias("activation")).where(F.col("activation") >= least)
        front = front.groupBy("node").agg(F.max("activation").alias("activation"))
        front = kept(front) if callable(edges) else front
        best = best.unionByName(front)
    return best.groupBy("node").agg(F.max("activation").alias("activation"))


def _ranked(shares: DataFrame, restart: DataFrame, rank: DataFrame, hang: DataFrame, damping: float, rounds: int, tolerance: float | None) -> DataFrame:
    """Power iteration over shares (src, dst, _w): each node keeps its part of
    ``restart`` (node, _s; summing to 1) and gets what its in-links bring; the mass of
    nodes without out-links (``hang``) follows ``restart`` too.  That mass is one
    number a round, found in the round's own plan (a one-row aggregate, broadcast).
    Lineage is cut every STRIDE rounds.  With a ``tolerance`` the rounds end once the
    ranks change by less in sum between two cuts."""
    done = 0
    while done < rounds:
        before, n = rank, min(STRIDE, rounds - done)
        for _ in range(n):
            lost = rank.join(hang, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("_lost"))
            moved = rank.join(shares, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (damping * F.col("rank") * F.col("_w")).alias("rank"))
            back = restart.join(F.broadcast(lost)).select("node", (F.col("_s") * (1 - damping + damping * F.col("_lost"))).alias("rank"))
            rank = moved.unionByName(back).groupBy("node").agg(F.sum("rank").alias("rank"))
        rank, done = cut(rank), done + n
        if tolerance is not None:
            change = rank.unionByName(before.select("node", (-F.col("rank")).alias("rank"))).groupBy("node").agg(F.abs(F.sum("rank")).alias("d")).agg(F.sum("d")).first()[0]
            if change < tolerance:
                break
    return rank


def _nodes(edges: DataFrame) -> DataFrame:
    return cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())


def pagerank(edges: DataFrame, *, damping: float = 0.85, rounds: int = 50) -> DataFrame:
    """node, rank: a fixed number of rounds; the mass of nodes without out-edges is
    spread evenly."""
    e = cut(edges.select("src", "dst").distinct())
    nodes = _nodes(e)
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("rank", F.lit(0.0))
    out = e.groupBy("src").agg(F.count("*").alias("_out"))
    shares = cut(e.join(out, "src").select("src", "dst", (1.0 / F.col("_out")).alias("_w")))
    hang = cut(nodes.join(out, F.col("node") == F.col("src"), "left_anti"))
    even = nodes.withColumn("_s", F.lit(1.0 / n))
    return _ranked(shares, even, even.select("node", F.col("_s").alias("rank")), hang, damping, rounds, None)


def personal_pagerank(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, rounds: int = 50, tolerance: float | None = None) -> DataFrame:
    """node, rank from (src, dst, weight) and seeds (node, share); empty without
    edges or without a seed of positive share in the graph.  ``rounds`` at most, or
    until the ranks settle within ``tolerance``."""
    e = cut(edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    nodes = _nodes(e)
    seeds = seeds.where("share > 0").join(nodes, "node", "left_semi")
    total = seeds.agg(F.sum("share")).first()[0]
    if not total:
        return nodes.limit(0).withColumn("rank", F.lit(0.0))
    seeds = cut(seeds.select("node", (F.col("share") / total).alias("_s")))
    out = e.groupBy("src").agg(F.sum("weight").alias("_out"))
    shares = cut(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_out")).alias("_w")))
    hang = cut(nodes.join(out, F.col("node") == F.col("src"), "left_anti"))
    return _ranked(shares, seeds, seeds.select("node", F.col("_s").alias("rank")), hang, damping, rounds, tolerance)


def _renamed(rows: DataFrame, key: str, names: DataFrame, hot: DataFrame | None, spread: str) -> DataFrame:
    """``rows`` with ``key`` replaced by its label in ``names`` (node, label), where it has
    one."""
    to = names.select(F.col("node").alias(key), F.col("label").alias("_to"))
    found = rows.join(to, key, "left") if hot is None else salted_join(rows, to, key, hot, [spread], "left")
    return found.withColumn(key, F.coalesce("_to", key)).drop("_to")


def _sized(sizes: DataFrame, key: str, rows: int | None = None) -> tuple[int, DataFrame | None]:
    """How many keys ``sizes`` (key, n) has, and those too frequent for one task among
    ``rows`` rows (else as many as ``sizes`` counts), if there are any."""
    n, most, every = sizes.agg(F.count("*"), F.max("n"), F.sum("n")).first()
    hot = hot_keys(sizes, key, "n", every or 0 if rows is None else rows)
    return n, hot if n and most > HOT_ROWS and not hot.isEmpty() else None


def _contracted(e: DataFrame, most_rounds: int) -> DataFrame:
    """node, label: the same label for the nodes of a component of ``e`` (a, b; no loops,
    read several times).  In a round each node is renamed to the first of itself and its
    neighbours, by id or, every other round, by a hash; edges within one name go.  By
    hash a part of the nodes is lost, whatever the graph.  Where edges are many more than
    nodes, two edges of each node are contracted to the end first, which leaves few of
    the others."""
    steps, rows = [], e.count()
    for k in range(most_rounds):
        if not rows:
            break
        order = lambda c: F.xxhash64(F.lit(k), c)  # noqa: E731, B023
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = kept(both.groupBy("a").agg(F.min("b").alias("first"), F.min_by("b", order("b")).alias("drawn"), F.count("*").alias("n")))
        nodes, hot = _sized(low, "a", rows)
        if rows > DENSE * nodes:
            names = _contracted(low.select("a", F.explode(F.array_distinct(F.array("first", "drawn"))).alias("b")), most_rounds)
        else:
            goal = F.when(order("drawn") < order("a"), F.col("drawn")).otherwise(F.col("a")) if k % 2 else F.least("first", "a")
            names = low.select(F.col("a").alias("node"), goal.alias("label"))
        steps.append(names)
        e = _renamed(_renamed(e, "a", names, hot, "b"), "b", names, hot, "a").where("a <> b")
        e = kept(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        rows = e.count()
    if rows:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    if not steps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    found = steps.pop()
    while steps:
        above = steps.pop()
        _, hot = _sized(above.groupBy("label").agg(F.count("*").alias("n")), "label")
        found = _renamed(above, "label", found, hot, "node")
    return kept(found.select("node", "label"))


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """node, component (its smallest node), by contraction until no edge is left; a graph
    that takes more than ``most_rounds`` is an error.  Nodes with very many neighbours
    are dealt over several tasks.  Edges and names of a round are kept as tables: written
    once, where a checkpoint runs its last stage twice."""
    e = kept(edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")))
    named = _contracted(e, most_rounds)
    sizes = kept(named.groupBy("label").agg(F.min("node").alias("component"), F.count("*").alias("n")))
    _, hot = _sized(sizes, "label")
    least = sizes.select("label", "component")
    found = named.join(least, "label") if hot is None else salted_join(named, least, "label", hot, ["node"])
    return found.select("node", "component")


def ends(edges: DataFrame) -> DataFrame:
    """node, is_root (no out-edge), is_leaf (no in-edge) of directed edges."""
    o = edges.select(F.col("src").alias("node"), F.lit(1).alias("_o"), F.lit(0).alias("_i"))
    i = edges.select(F.col("dst").alias("node"), F.lit(0).alias("_o"), F.lit(1).alias("_i"))
    return o.unionByName(i).groupBy("node").agg((F.sum("_o") == 0).alias("is_root"), (F.sum("_i") == 0).alias("is_leaf"))


def descend(parents: DataFrame, roots: DataFrame, most: int = 10_000) -> DataFrame:
    """root, node, level: nodes under each root over (child, parent) rows, level by
    level until one is empty.  A node counts at its first level, so loops end;
    ``most`` levels without an end are an error."""
    new = seen = cut(roots.select(F.col("node").alias("root"), F.col("node"), F.lit(0).alias("level")).distinct())
    for k in range(1, most + 1):
        below = new.join(parents, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct()
        new = cut(below.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("level", F.lit(k)))
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
        if k % STRIDE == 0:
            seen = cut(seen)
    raise RuntimeError(f"descend: more than {most} levels")


def document_frequency(links: DataFrame) -> DataFrame:
    """entity_id, df, idf = ln(N / df) over the memories with any link."""
    n = max(1, links.select("memory_id").distinct().count())
    return links.groupBy("entity_id").agg(F.countDistinct("memory_id").alias("df")).withColumn("idf", F.ln(F.lit(float(n)) / F.col("df")))


def greedy_topics(sets: DataFrame, least: float) -> DataFrame:
    """group, members: clusters grown in key order, a set joining when its Jaccard
    with the union so far reaches ``least``.  Order-dependent by definition: one
    partition of ``sets`` (scope, key, items) per scope, walked in order."""
    import pandas as pd

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rest = [(k, set(v)) for k, v in sorted(zip(rows["key"], rows["items"], strict=True))]
        out = []
        while rest:
            seed, union = rest.pop(0)
            members, grown = [seed], True
            while grown:
                grown = False
                for x in list(rest):
                    both = len(union | x[1])
                    if both and len(union & x[1]) / both >= least:
                        members.append(x[0])
                        union |= x[1]
                        rest.remove(x)
                        grown = True
            out.append((rows["scope"].iloc[0], seed, sorted(members)))
        return pd.DataFrame(out, columns=["scope", "seed", "members"])

    return sets.groupBy("scope").applyInPandas(walk, "scope string, seed long, members array<long>")


def weighted_neighbours(edges: DataFrame, node: str = "node") -> DataFrame:
    """node, neighbour, weight: each neighbour once; the weight of the edge to it counts
    before that of the edge from it."""
    out = edges.select(F.col("src").alias(node), F.col("dst").alias("neighbour"), F.struct(F.lit(0).alias("p"), F.negate("weight").alias("w")).alias("_o"))
    back = edges.select(F.col("dst").alias(node), F.col("src").alias("neighbour"), F.struct(F.lit(1).alias("p"), F.negate("weight").alias("w")).alias("_o"))
    best = out.unionByName(back).groupBy(node, "neighbour").agg(F.min("_o").alias("_o"))
    return best.select(node, "neighbour", (-F.col("_o.w")).alias("weight"))


def set_weights(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (src, dst, weight; null counts as 1) with the weights of ``new`` where both
    have the edge."""
    n = new.select("src", "dst", F.col("weight").alias("_w"))
    return edges.join(n, ["src", "dst"], "left").select("src", "dst", F.coalesce("_w", "weight", F.lit(1.0)).alias("weight"))


def reached_links(links: DataFrame, seeds: DataFrame, most: int = 10_000) -> DataFrame:
    """link_id of every link (link_id, src, dst) that hangs together with a seed (node),
    whichever way links point: the seeds' components, whatever their depth."""
    comp = components(links.select("src", "dst"), most)
    mine = comp.join(seeds.select("node").distinct(), "node", "left_semi").select("component").distinct()
    nodes = comp.join(mine, "component", "left_semi").select(F.col("node").alias("src"))
    loops = seeds.select(F.col("node").alias("src"))
    return links.join(nodes.union(loops).distinct(), "src", "left_semi").select("link_id").distinct()


def rebuilt(relations: DataFrame, strength: DataFrame) -> DataFrame:
    """src, dst, weight: the graph of stored relations, with learned strengths (a, b,
    strength) laid over edges that exist, either way round."""
    e = relations.select("src", "dst").distinct()
    both = strength.select(F.col("a").alias("src"), F.col("b").alias("dst"), "strength").unionByName(strength.select(F.col("b").alias("src"), F.col("a").alias("dst"), "strength"))
    best = both.groupBy("src", "dst").agg(F.max("strength").alias("_s"))
    return e.join(best, ["src", "dst"], "left").select("src", "dst", F.coalesce("_s", F.lit(1.0)).alias("weight"))
