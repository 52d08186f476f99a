"""Maintenance: summaries, patterns, refreshes, forgetting, and the whole cycle.

Steps that write text take it from a callable of the caller's; the default quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recallforge.functions import scores as S, text as T
from recallforge.operators import consolidation, graph, ranking
from recallforge.shared import TASK_ROWS, cut, dealt, kept

# Weights of the rehearsal signals.
REHEARSAL = {"centrality": 0.40, "staleness": 0.30, "importance": 0.20, "accesses": 0.05, "recency": 0.05}
REFRESH_DAYS = 7


#: Items of a prefix that small sets may pair up: at most PREFIX * (PREFIX - 1) / 2 keys.
PREFIX = 20
#: Parts that the ids of one set are dealt over.
PARTS = 8
#: Rows of searches that are grouped, by sorting, where a group-by that is held takes one.
SEARCH_ROWS = 4


def _distinct_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets (id, items) once each: (r, k, s, n) with the smallest id, how many ids have the
    set, its items from rare to frequent and their number; and (id, r), whose set is whose."""
    rows = sets.select("id", F.explode(F.array_distinct("items")).alias("x")).where("x is not null")
    df = rows.groupBy("x").agg(F.count("*").alias("n"))
    ordered = rows.join(df, "x").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("n", "x"))).alias("s")).select("id", F.transform("s", lambda e: e["x"]).alias("s"))
    alike = cut(ordered.groupBy("s").agg(F.min("id").alias("r"), F.count("*").alias("k")).select("r", "k", "s", F.size("s").alias("n")))
    again = ordered.join(alike.where("k > 1").select("s", "r"), "s", "left").select("id", F.coalesce("r", "id").alias("r"))
    return alike, again


def _similar_distinct(alike: DataFrame, least: float) -> DataFrame:
    """a < b, jaccard: distinct sets (r, s, n) whose Jaccard reaches ``least`` > 0.  Two such
    sets of n <= m items share o = 2 * least / (1 + least) * n at least, so their first two
    common items are among the first n - o + 2 of the one and m - least * m + 2 of the
    other.  They meet on both of these items; where one common item is enough, or sets are
    so large that their prefixes would make too many pairs, on the first alone.  Only keys
    and ids meet; a pair's items are fetched once, to be counted."""
    ceil = lambda c: F.ceil(c - 1e-9).cast("int")
    n, t = F.col("n"), F.lit(least)
    most = int(min(64, (PREFIX - 2) * least / max(1 - least, 0.01)))  # sets over it meet on one item
    one = int((1 + least) / (2 * least) + 1e-9)  # up to it one common item is enough
    ones = lambda p: F.transform(p, lambda x: F.xxhash64(x))
    twos = lambda p: F.flatten(F.transform(p, lambda x, i: F.transform(F.slice(p, i + 2, F.size(p)), lambda y: F.xxhash64(x, y))))
    head = lambda o, k: F.slice("s", F.lit(1), F.least(n, n - F.greatest(o, F.lit(k)) + k))
    none = F.array().cast("array<bigint>")
    alone = (n <= one) | (n > most)
    low = ceil(2 * t / (1 + t) * n)
    small = F.when(alone, ones(head(low, 1))).otherwise(twos(head(low, 2)))
    high = ceil(t * n)
    large = F.concat(F.when((high <= one) | (n > most), ones(head(high, 1))).otherwise(none), F.when((n > one) & (high <= most), twos(head(high, 2))).otherwise(none))
    a = alike.select(F.col("r").alias("a"), F.col("n").alias("na"), F.explode(small).alias("_k"))
    b = alike.select(F.col("r").alias("b"), F.col("n").alias("nb"), F.explode(large).alias("_k"))
    fits = (F.col("na") >= t * F.col("nb") - 1e-9) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    met = a.join(b, "_k").where(fits).select("a", "b").distinct()
    items = alike.select("r", "s")
    both = met.join(items.select(F.col("r").alias("a"), F.col("s").alias("sa")), "a").join(items.select(F.col("r").alias("b"), F.col("s").alias("sb")), "b")
    pairs = both.select("a", "b", T.jaccard(F.col("sa"), F.col("sb")).alias("jaccard")).where(F.col("jaccard") >= least)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """a < b, jaccard: sets (id, items) whose Jaccard reaches ``least`` > 0.  Equal sets are
    compared once, and pairs of their ids are made at the end."""
    alike, again = _distinct_sets(sets)
    pairs = _similar_distinct(alike, least).unionByName(alike.where("k > 1").select(F.col("r").alias("a"), F.col("r").alias("b"), F.lit(1.0).alias("jaccard")))
    # ids of one set are dealt over PARTS, so no task makes all pairs of a large group
    dealt = again.withColumn("_p", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))
    mates = alike.where("k > 1").select("r").join(dealt, "r")
    wide = lambda end: alike.where("k > 1").select(F.col("r").alias(end), F.lit(True).alias(f"_{end}"))
    named = lambda c: F.when(F.col(c), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    p = pairs.join(wide("a"), "a", "left").join(wide("b"), "b", "left")
    plain = p.where("_a is null and _b is null").select("a", "b", "jaccard")
    p = p.where("_a is not null or _b is not null").withColumn("_pa", F.explode(named("_a"))).withColumn("_pb", F.explode(named("_b")))
    p = p.join(mates.select(F.col("r").alias("a"), F.col("_p").alias("_pa"), F.col("id").alias("ia")), ["a", "_pa"], "left").where("_a is null or ia is not null")
    p = p.join(mates.select(F.col("r").alias("b"), F.col("_p").alias("_pb"), F.col("id").alias("ib")), ["b", "_pb"], "left").where("_b is null or ib is not null")
    x, y = F.coalesce("ia", "a"), F.coalesce("ib", "b")
    spread = p.where((F.col("a") != F.col("b")) | (x < y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "jaccard")
    return plain.unionByName(spread)


def _clustered(sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(cluster, k, s, r) of distinct sets that are tied to another, directly or through
    others, or that several ids have; and (id, r), whose set is whose."""
    alike, again = _distinct_sets(sets)
    tied = cut(_similar_distinct(alike, least).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    comp = graph.components(tied).select(F.col("node").alias("r"), F.col("component").alias("cluster"))
    found = alike.join(comp, "r", "left").where("cluster is not null or k > 1")
    return found.select(F.coalesce("cluster", "r").alias("cluster"), "k", "s", "r"), again


def overlap_clusters(sets: DataFrame, *, least: float = 0.3, members: int = 3, listed: bool = True) -> DataFrame:
    """cluster, size, ids, shared: sets tied by a Jaccard of ``least``, directly or through
    others, of ``members`` or more; what all of them have in common, else what two have.
    Without ``listed`` there are no ids, and no cluster's ids are put together."""
    found, again = _clustered(sets, least)
    sizes = found.groupBy("cluster").agg(F.sum("k").alias("size")).where(F.col("size") >= members)
    n = found.select("cluster", "k", F.explode("s").alias("x")).groupBy("cluster", "x").agg(F.sum("k").alias("c")).where("c >= 2").join(sizes, "cluster")
    both = n.groupBy("cluster").agg(F.array_sort(F.collect_list(F.when(F.col("c") == F.col("size"), F.col("x")))).alias("all"), F.array_sort(F.collect_list("x")).alias("two"))
    none = F.slice("two", 1, 0)
    g = sizes.join(both, "cluster", "left").withColumns({"two": F.coalesce("two", none), "all": F.coalesce("all", none)})
    g = g.select("cluster", "size", F.when(F.size("all") > 0, F.col("all")).otherwise(F.col("two")).alias("shared"))
    if not listed:
        return g
    ids = again.join(found.select("r", "cluster"), "r").groupBy("cluster").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return g.join(ids, "cluster").select("cluster", "size", "ids", "shared")


def topics(sets: DataFrame, *, least: float = 0.3, members: int = 3, words: int = 5) -> DataFrame:
    """cluster, size, label, confidence: clusters of sets that overlap, named by their
    ``words`` most frequent items (ties: smaller), with their share of all sets."""
    found, _ = _clustered(sets, least)
    g = found.groupBy("cluster").agg(F.sum("k").alias("size")).where(F.col("size") >= members)
    n = found.join(g, "cluster", "left_semi").select("cluster", "k", F.explode("s").alias("x")).groupBy("cluster", "x").agg(F.sum("k").alias("c"))
    best = ranking.per_group(n, ["cluster"], [F.desc("c"), "x"], words)
    first = F.array_sort(F.collect_list(F.struct(F.negate("c").alias("c"), "x")))
    label = best.groupBy("cluster").agg(F.transform(first, lambda e: e["x"]).alias("label"))
    total = sets.where(F.size("items") > 0).agg(F.count("*").alias("_n"))
    return g.join(label, "cluster").join(F.broadcast(total)).select("cluster", "size", "label", (F.col("size") / F.col("_n")).alias("confidence"))


def pattern_kind(size: Column, confidence: Column, stable: float = 0.7) -> Column:
    """struct<stability, kind>: patterns of many episodes and sure ones are insights."""
    s = F.least(F.lit(1.0), size / 5.0) * confidence
    return F.struct(F.round(s, 3).alias("stability"), F.when(s >= stable, "strategic_insight").otherwise("recurring_pattern").alias("kind"))


def closed_unsummarised(episodes: DataFrame) -> DataFrame:
    return episodes.where((F.col("status") == "closed") & F.coalesce(~F.col("summarized"), F.lit(True)))


def episode_summaries(episodes: DataFrame, members: DataFrame, *, write=None, most: int = 1000) -> DataFrame:
    """episode_id, members, domains, content of closed episodes without a summary:
    ``write`` is a column function from the members' texts (array, in time order); the
    default puts their first sentences together, ``most`` characters.  Episodes whose
    members are gone have none."""
    m = members.join(closed_unsummarised(episodes).select("episode_id"), "episode_id", "left_semi")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "memory_id", "content"))), lambda s: s["content"])
    g = m.groupBy("episode_id").agg(F.count("*").alias("members"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("domains")))).alias("domains"), texts.alias("_t"))
    quoted = F.substring(F.array_join(F.transform("_t", lambda t: T.first_sentence(t)), " "), 1, most)
    return g.select("episode_id", "members", "domains", (write(F.col("_t")) if write else quoted).alias("content"))


def profile_text(entities: Column, domains: Column, anchor: Column) -> Column:
    """What an episode is searched by: 20 entities, its domains, its anchor."""
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    parts = [
        F.when(some(entities), F.array_join(F.slice(entities, 1, 20), ", ")),
        F.when(some(domains), F.concat(F.lit("domains: "), F.array_join(F.array_sort(F.array_distinct(domains)), ", "))),
        F.when(F.coalesce(anchor, F.lit("")) != "", F.concat(F.lit("anchors: "), anchor)),
    ]
    return F.coalesce(F.nullif(F.concat_ws(" | ", *parts), F.lit("")), F.lit("episode"))


def added_names(old: Column, new: Column) -> Column:
    """An episode's entities with those of a new member that it lacks, whatever their case."""
    low = F.transform(old, F.lower)
    return F.concat(old, F.filter(new, lambda n: ~F.array_contains(low, F.lower(n))))


def refreshed(abstracts: DataFrame, now: Column, days: int = REFRESH_DAYS) -> DataFrame:
    """Abstracts with ``refresh_due`` moved on for those that are due, and whether."""
    due = F.coalesce(now >= F.col("refresh_due"), F.lit(False))
    return abstracts.withColumn("refreshed", due).withColumn("refresh_due", F.when(due, now + F.expr(f"interval {days} days")).otherwise(F.col("refresh_due")))


def abstracts(found: DataFrame, kind: str, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, nodes, edges) of abstracts to store: found has key, content, domains,
    confidence and sources (node ids)."""
    key = F.concat(F.lit(f"{kind}:"), F.col("key").cast("string"))
    weight = F.greatest(F.col("confidence") * 10, F.lit(1.0))
    memories = found.select(key.alias("memory_id"), "content", F.lit("insight").alias("type"), "domains", weight.alias("importance"))
    nodes = found.select(F.concat(F.lit("node:"), key).alias("node_id"), key.alias("memory_id"), F.lit("abstract").alias("node_type"), F.lit(kind).alias("abstract_type"), (now + F.expr(f"interval {REFRESH_DAYS} days")).alias("refresh_due"))
    edges = found.select(F.concat(F.lit("node:"), key).alias("source_id"), F.explode("sources").alias("target_id"), F.lit("derived_from").alias("edge_type"))
    return memories, nodes, edges


def rehearsal_signals(memories: DataFrame, accesses: DataFrame, links: DataFrame, ranks: DataFrame, now: Column, least: int = 3) -> DataFrame:
    """memory_id, centrality, staleness, importance, accesses, recency of memories read
    ``least`` times or more: the mean rank of their entities (0 for unranked ones), days
    since the last access (twice: two weights go to it), how often."""
    age = S.seconds_between(now, F.col("accessed_at"))
    a = accesses.withColumn("_age", age).where("_age > 0").groupBy("memory_id").agg(F.count("*").cast("double").alias("accesses"), (F.min("_age") / 86400.0).alias("staleness")).where(F.col("accesses") >= least)
    e = links.join(ranks.select(F.col("node").alias("entity_id"), "rank"), "entity_id", "left")
    c = e.groupBy("memory_id").agg(F.avg(F.coalesce("rank", F.lit(0.0))).alias("centrality"))
    j = memories.select("memory_id", "importance").join(a, "memory_id").join(c, "memory_id", "left")
    return j.select("memory_id", F.coalesce("centrality", F.lit(0.0)).alias("centrality"), "staleness", "importance", "accesses", F.col("staleness").alias("recency"))


def rehearse(signals: DataFrame, share: float = 0.10) -> DataFrame:
    """memory_id, score of the memories to rehearse."""
    return consolidation.rehearsal(signals, "memory_id", REHEARSAL, share).select("memory_id", "score")


def rehearsal_accesses(selected: DataFrame, now: Column) -> DataFrame:
    """Synthetic accesses of rehearsed memories: one, and up to four more by score; one
    each where all scores are equal."""
    return consolidation.injected(selected, "memory_id", "score", now, flat=0.0)


def forget_conflicting(memories: DataFrame, nodes: DataFrame, conflicts: DataFrame, rate: float = 0.05) -> DataFrame:
    """Importance of memories whose current states are in conflict lowered by half of
    ``rate``, once for each such state, 0 at least."""
    hot = nodes.where("is_current").join(conflicts.select(F.col("source_id").alias("node_id")).distinct(), "node_id", "left_semi").groupBy("memory_id").agg(F.count("*").alias("_n"))
    return memories.join(hot, "memory_id", "left").withColumn("importance", F.greatest(F.lit(0.0), F.col("importance") - 0.5 * rate * F.coalesce("_n", F.lit(0)))).drop("_n")


def drifted(memories: DataFrame, accesses: DataFrame, now: Column, *, days: float = 14.0, step: float = 0.1) -> DataFrame:
    """Importance moved by the trend of accesses (two or more), between 0 and 10."""
    aged = accesses.withColumn("_age", S.seconds_between(now, F.col("accessed_at"))).where("_age > 0")
    often = aged.groupBy("memory_id").agg(F.count("*").alias("_n")).where("_n >= 2").select("memory_id")
    d = consolidation.drift(aged, "memory_id", "_age", days, step).join(often, "memory_id", "left_semi").select("memory_id", "delta")
    return memories.join(d, "memory_id", "left").withColumn("importance", F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col("importance") + F.coalesce("delta", F.lit(0.0))))).drop("delta")


def learned(links: DataFrame, searches: DataFrame) -> DataFrame:
    """a, b, strength: associations of the entities that searches (search_id, memory_id)
    return together."""
    found = kept(links.join(searches.select("memory_id").distinct(), "memory_id", "left_semi"))
    s, few = searches.where("search_id is not null"), found.count() <= TASK_ROWS
    kinds = found.select(F.col("entity_id").alias("_i")).where("_i is not null").distinct() if few else None
    if not few or kinds.count() > consolidation.KINDS:
        found = F.broadcast(found) if few else found
        baskets = s.repartition(dealt(s.count()), "search_id").join(found, "memory_id").select("search_id", "entity_id").distinct()
        return consolidation.associations(baskets, "search_id", "entity_id")
    kinds = kept(consolidation.numbered(kinds, "_i"))
    sets = found.join(F.broadcast(kinds), found["entity_id"] == kinds["_i"], "left").groupBy("memory_id").agg(F.collect_set("nth").alias("e"))
    held = s.repartition(dealt(s.count() // SEARCH_ROWS), "search_id").join(F.broadcast(sets), "memory_id")
    baskets = held.groupBy("search_id").agg(F.flatten(F.collect_list("e")).alias("s"))
    return consolidation.strengths(*consolidation.set_pair_counts(baskets, "s", kinds))


def cycle(memories: DataFrame, accesses: DataFrame, links: DataFrame, searches: DataFrame, nodes: DataFrame, conflicts: DataFrame, edges: DataFrame, now: Column) -> dict[str, DataFrame]:
    """One maintenance cycle, step by step: synthetic accesses of rehearsed memories,
    associations of entities that searches return together (search_id, memory_id), the
    query expansions they give, and memories with importance after forgetting and drift.
    Only links of memories that were found go to the searches.  Few of them, of few entities,
    are broadcast as one set a memory: a search's entities come together where the search is
    and are counted in the same pass, without a row for each."""
    ranks = graph.pagerank(edges)
    chosen = rehearse(rehearsal_signals(memories, accesses, links, ranks, now))
    assoc = kept(learned(links, searches))
    old = nodes.where("not is_current").select("memory_id")
    faded = forget_conflicting(consolidation.forget(memories, old, "memory_id", 0.05), nodes, conflicts)
    return {
        "rehearsal": rehearsal_accesses(chosen, now),
        "associations": assoc,
        "expansion": consolidation.expansion(assoc, 20, 0.1),
        "memories": drifted(faded, accesses, now),
    }


def due(tasks: DataFrame, now: Column) -> DataFrame:
    """Tasks (name, every_minutes, last_run, running) that a scheduler starts now: their
    interval is over, and the run before has ended."""
    over = F.col("last_run").isNull() | (S.seconds_between(now, F.col("last_run")) >= F.col("every_minutes") * 60)
    return tasks.where(over & ~F.coalesce("running", F.lit(False)))


def ring(events: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """The newest ``size`` events of each buffer, numbered from the oldest."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    kept = events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size)
    return kept.withColumn("slot", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_r"))) - 1).drop("_r")
