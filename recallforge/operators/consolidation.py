"""Association learning, drift, rehearsal and decay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from recallforge.operators import graph, retrieval
from recallforge.shared import dealt, hot_keys, kept, salted_join

#: Kinds of items whose pairs are counted in one table of each task.
KINDS = 1024


def numbered(items: DataFrame, item: str) -> DataFrame:
    """``items``, KINDS at most, with ``nth``: their place in order, from 0."""
    return items.withColumn("nth", (F.row_number().over(Window.orderBy(item)) - 1).cast("int"))


def table_counts(sets: DataFrame, items: str, kinds: int) -> DataFrame:
    """x <= y, ab: how many ``sets`` hold both of two numbers below ``kinds``; x = y: how many
    hold it.  A number's sets are the bits of a row, and two rows' common bits are counted a
    batch at a time, so no pair of a set is made."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        found = np.zeros((kinds, kinds), np.int64)
        for batch in batches:
            lists = batch.column(0)
            ends = lists.offsets.to_numpy()
            has = np.zeros((kinds, -(-len(lists) // 64) * 64), bool)
            has[lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(ends))] = True
            bits = np.packbits(has, axis=1).view(np.uint64)
            for x in np.flatnonzero(bits.any(axis=1)):
                found[x, x:] += np.bitwise_count(bits[x] & bits[x:]).sum(axis=1, dtype=np.int64)
        x, y = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(found[x, y])], ["x", "y", "ab"])

    each = sets.select(F.col(items).cast("array<int>").alias("s")).where("size(s) > 0")
    return each.mapInArrow(run, "x int, y int, ab long").groupBy("x", "y").agg(F.sum("ab").alias("ab"))


def set_pair_counts(sets: DataFrame, items: str, kinds: DataFrame) -> tuple[DataFrame, int]:
    """What ``pair_counts`` gives, of baskets that hold (``items``, an array of numbers, perhaps
    empty) few kinds of items, ``numbered``; all of it is counted in one pass over the baskets."""
    moved = F.transform(items, lambda i: i + 1)  # 0 is in every basket
    t = kept(table_counts(sets.select(F.concat(F.array(F.lit(0)), moved).alias("s")), "s", kinds.count() + 1))
    n = (t.where("x = 0 and y = 0").select("ab").first() or [0])[0]
    held = t.where("x = 0 and y > 0").select((F.col("y") - 1).alias("nth"), F.col("ab").alias("c")).join(F.broadcast(kinds), "nth")
    return _named_pairs(t.where("x > 0").select((F.col("x") - 1).alias("x"), (F.col("y") - 1).alias("y"), "ab"), held), n


def _named_pairs(counts: DataFrame, kinds: DataFrame) -> DataFrame:
    """a, b, ab, cc from counts of numbers (x, y, ab) and ``kinds`` (_i, nth, c)."""
    end = lambda n, i, c: F.broadcast(kinds.select(F.col("nth").alias(n), F.col("_i").alias(i), F.col("c").alias(c)))
    p = counts.where("x < y").join(end("x", "a", "_a"), "x").join(end("y", "b", "_b"), "y")
    return p.select("a", "b", "ab", (F.col("_a") * F.col("_b")).alias("cc"))


def pair_counts(baskets: DataFrame, basket: str, item: str) -> tuple[DataFrame, int]:
    """(a < b, ab, cc: pairs of items, the baskets that hold both, and the product of the
    baskets of each; number of baskets).  The items' counts go with them into the baskets,
    so a pair is moved once.  Where pairs are made many times over they are counted where
    they are made, those of KINDS items without being made; else they are dealt over as many
    tasks as there are pairs to hold."""
    b = baskets.select(F.col(basket).alias("_b"), F.col(item).alias("_i")).distinct()
    items = kept(b.where("_i is not null").groupBy("_i").agg(F.count("*").alias("c")))
    n, rows, made = b.groupBy("_b").agg(F.count("_i").alias("k")).agg(F.count("_b"), F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum(F.expr("k * (k - 1) div 2")), F.lit(0))).first()
    kinds, b = items.count(), b.where("_b is not null")
    few = graph.combines(kinds, made)
    if few and kinds <= KINDS:
        items = kept(numbered(items, "_i"))
        sets = b.join(F.broadcast(items), "_i").groupBy("_b").agg(F.collect_list("nth").alias("_s"))
        return _named_pairs(table_counts(sets, "_s", kinds), items), n
    sized = b.join(F.broadcast(items), "_i") if few else salted_join(b, items, "_i", hot_keys(items, "_i", "c", rows), ["_b"], parts=dealt(rows)).repartition(dealt(rows), "_b")
    sets = sized.groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("_i", "c"))).alias("_s"))
    pairs = graph.pairs_of(sets, "_s").select(F.col("x._i").alias("a"), F.col("y._i").alias("b"), (F.col("x.c") * F.col("y.c")).alias("cc"))
    pairs = pairs if few else pairs.repartition(dealt(made), "a", "b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("ab"), F.max("cc").alias("cc")), n


def associations(baskets: DataFrame, basket: str, item: str, least: float = 0.01) -> DataFrame:
    """a, b, strength: ln of the pointwise ratio, clamped to 0..10, over 10."""
    return strengths(*pair_counts(baskets, basket, item), least)


def strengths(pairs: DataFrame, n: int, least: float = 0.01) -> DataFrame:
    """``associations`` of counted pairs of ``n`` baskets."""
    pmi = F.ln(F.col("ab") * F.lit(float(n)) / F.col("cc"))
    s = F.least(F.lit(10.0), F.greatest(F.lit(0.0), pmi)) / 10
    return pairs.select("a", "b", s.alias("strength")).where(F.col("strength") > least)


def edge_weights(baskets: DataFrame, basket: str, item: str, old: DataFrame, *, keep: float = 0.01, blend: float = 0.3, fresh: float = 0.9) -> DataFrame:
    """Edge weights blended with normalised log2 ratios on edges that exist, in
    either direction; new edges a -> b above ``fresh``.  old: src, dst, weight."""
    pairs, n = pair_counts(baskets, basket, item)
    p = kept(pairs.select("a", "b", F.greatest(F.lit(0.0), F.log2(F.col("ab") * F.lit(float(n)) / F.col("cc"))).alias("w")).where(F.col("w") > keep))
    rows, most = p.agg(F.count("*"), F.max("w")).first()
    tasks = dealt(rows)
    p = p.withColumn("w", F.col("w") / max(0.01, most or 0.01)).repartition(tasks, "a", "b")
    known = old.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "src", "dst", "weight", F.lit(True).alias("_old")).repartition(tasks, "a", "b")
    joined = known.join(p, ["a", "b"], "full")
    mixed = F.when(F.col("w").isNull(), F.col("weight")).otherwise(blend * F.col("weight") + (1 - blend) * F.col("w"))
    was = F.col("_old").isNotNull()
    rest = joined.where(F.when(was, F.col("weight").isNotNull()).otherwise(F.col("w") > fresh))
    pick = lambda then, other: F.when(was, then).otherwise(F.col(other))
    return rest.select(pick(F.col("src"), "a").alias("src"), pick(F.col("dst"), "b").alias("dst"), pick(mixed, "w").alias("weight"))


def expansion(assoc: DataFrame, k: int, least: float = 0.3) -> DataFrame:
    """entity, partner, rank: the k strongest partners, both directions."""
    strong = assoc.where(F.col("strength") >= least)
    both = strong.select(F.col("a").alias("entity"), F.col("b").alias("partner"), "strength").unionByName(strong.select(F.col("b").alias("entity"), F.col("a").alias("partner"), "strength"))
    return retrieval.ranked(both, "partner", "strength", ["entity"]).where(F.col("rank") <= k)


def drift(accesses: DataFrame, key: str, age: str, window_days: float = 30.0, step: float = 0.5, ratio: float = 1.5) -> DataFrame:
    """key, recent, older, delta: accesses in the near and far half of a window, and
    the change of importance when one rate exceeds the other ``ratio`` times."""
    half = window_days * 86400 / 2
    c = accesses.groupBy(key).agg(F.count_if(F.col(age) < half).alias("recent"), F.count_if((F.col(age) >= half) & (F.col(age) < 2 * half)).alias("older"))
    delta = F.when(F.col("recent") > ratio * F.col("older"), step).when(F.col("older") > ratio * F.col("recent"), -step).otherwise(0.0)
    return c.withColumn("delta", delta)


def rehearsal(signals: DataFrame, key: str, weights: dict[str, float], share: float = 0.10) -> DataFrame:
    """The best share of memories by weighted min-max signals."""
    from recallforge.operators import ranking

    flat = retrieval.min_max(signals, list(weights))
    scored = flat.withColumn("score", retrieval.combined({s: F.col(s) for s in weights}, weights))
    return ranking.fraction(scored, key, "score", share)


def injected(selected: DataFrame, key: str, score: str, now, flat: float = 0.0) -> DataFrame:
    """Synthetic accesses: 1 + floor(4 * normalised score) per memory."""
    n = retrieval.min_max(selected, [score], flat=flat)
    return n.select(key, F.explode(F.sequence(F.lit(1), (1 + F.floor(4 * F.col(score))).cast("int"))).alias("n"), now.alias("accessed_at"))


def forget(memories: DataFrame, marked: DataFrame, key: str, rate: float, floor: float = 0.0) -> DataFrame:
    """Importance of marked memories lowered by ``rate``, not below ``floor``."""
    m = marked.select(key).distinct().withColumn("_m", F.lit(True))
    return memories.join(m, key, "left").withColumn("importance", F.when(F.col("_m"), F.greatest(F.lit(floor), F.col("importance") - rate)).otherwise(F.col("importance"))).drop("_m")


def clusters(links: DataFrame, least: int = 3) -> DataFrame:
    """component, size: memories that share entities, directly or through others.
    Each entity ties its memories to the smallest one: linear in the links."""
    first = links.groupBy("entity_id").agg(F.min("memory_id").alias("dst"))
    e = links.join(first, "entity_id").select(F.col("memory_id").alias("src"), "dst").distinct()
    return graph.components(e).groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least)
