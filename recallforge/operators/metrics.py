"""Retrieval, classification and answer metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recallforge.functions import scores, text as T
from recallforge.shared import kept

#: Runs of words that are broadcast (8 bytes each).
MOST_RUNS = 2_000_000


def _judged(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """runs (query_id, doc_id, rank from 1) with their grade (0 where not judged)."""
    return runs.join(qrels, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def ndcg(runs: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """query_id, ndcg of every query with a relevant document."""
    from recallforge.operators import ranking

    gain = lambda r: F.sum(F.col("rel") / F.log2(F.col(r) + 1.0))
    got = _judged(runs.where(F.col("rank") <= k), qrels).groupBy("query_id").agg(gain("rank").alias("dcg"))
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")
    ideal = ranking.per_group(qrels.where("rel > 0"), ["query_id"], [F.desc("rel"), "doc_id"], k).withColumn("_i", F.row_number().over(w)).groupBy("query_id").agg(gain("_i").alias("idcg"))
    return ideal.join(got, "query_id", "left").select("query_id", (F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg"))


def mrr(runs: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    hit = runs.where(F.col("rank") <= k).join(qrels.where("rel > 0"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("_r"))
    q = qrels.where("rel > 0").select("query_id").distinct()
    return q.join(hit, "query_id", "left").select("query_id", F.coalesce(1.0 / F.col("_r"), F.lit(0.0)).alias("rr"))


def recall(runs: DataFrame, qrels: DataFrame, k: int = 100) -> DataFrame:
    rel = qrels.where("rel > 0").select("query_id", "doc_id").distinct()
    hit = runs.where(F.col("rank") <= k).select("query_id", "doc_id").distinct().withColumn("_h", F.lit(1))
    return rel.join(hit, ["query_id", "doc_id"], "left").groupBy("query_id").agg((F.count("_h") / F.count("*")).alias("recall"))


def all_metrics(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: means over the queries with a relevant document."""
    m = ndcg(runs, qrels, 10).join(mrr(runs, qrels, 10), "query_id").join(recall(runs, qrels, 10).withColumnRenamed("recall", "r10"), "query_id").join(recall(runs, qrels, 100).withColumnRenamed("recall", "r100"), "query_id")
    return m.agg(F.avg("ndcg").alias("ndcg_10"), F.avg("rr").alias("mrr_10"), F.avg("r10").alias("recall_10"), F.avg("r100").alias("recall_100"))


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.where("gold is not null").agg(F.avg((F.col("predicted") == F.col("gold")).cast("double")).alias("accuracy"))


def confusion(pairs: DataFrame) -> DataFrame:
    """class, tp, fp, fn, precision, recall, f1 of each class that occurs."""
    p = pairs.groupBy("gold", "predicted").agg(F.count("*").alias("n"))
    a = p.select(F.col("gold").alias("class"), F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col("gold") != F.col("predicted"), F.col("n")).otherwise(0).alias("fn"))
    b = p.where("gold <> predicted").select(F.col("predicted").alias("class"), F.lit(0).alias("tp"), F.col("n").alias("fp"), F.lit(0).alias("fn"))
    c = a.unionByName(b).groupBy("class").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    c = c.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_f1(pairs: DataFrame) -> DataFrame:
    return confusion(pairs).agg(F.avg("f1").alias("macro_f1"))


def slot_f1(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Micro F1 over (id, slot, value) rows."""
    p, g = predicted.select("id", "slot", "value").distinct().withColumn("_p", F.lit(1)), gold.select("id", "slot", "value").distinct().withColumn("_g", F.lit(1))
    c = p.join(g, ["id", "slot", "value"], "full").agg(F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("tp"), F.count("_p").alias("p"), F.count("_g").alias("g"))
    return c.select(F.when(F.col("p") + F.col("g") > 0, 2 * F.col("tp") / (F.col("p") + F.col("g"))).otherwise(1.0).alias("slot_f1"))


def confidently_wrong(pairs: DataFrame, at: float = 0.7) -> DataFrame:
    return pairs.agg(F.avg(((F.col("confidence") >= at) & (F.col("predicted") != F.col("gold"))).cast("double")).alias("confidently_wrong"))


def token_f1(answers: DataFrame) -> DataFrame:
    """id, em, f1, contains: answers and gold as multisets of normal tokens."""
    a = answers.select("id", T.answer_form(F.col("predicted")).alias("p"), T.answer_form(F.col("gold")).alias("g"))
    count = lambda c: a.select("id", F.explode(F.filter(F.split(c, " "), lambda t: t != "")).alias("t")).groupBy("id", "t").agg(F.count("*").alias(f"n_{c}"))
    both = count("p").join(count("g"), ["id", "t"], "full")
    s = both.groupBy("id").agg(F.sum(F.least(F.coalesce("n_p", F.lit(0)), F.coalesce("n_g", F.lit(0)))).alias("c"), F.sum(F.coalesce("n_p", F.lit(0))).alias("np"), F.sum(F.coalesce("n_g", F.lit(0))).alias("ng"))
    f1 = F.when(F.col("c") > 0, 2.0 * F.col("c") / (F.col("np") + F.col("ng"))).otherwise(0.0)
    return a.join(s, "id", "left").select("id", (F.col("p") == F.col("g")).alias("em"), F.coalesce(f1, F.lit(0.0)).alias("f1"), F.contains("p", "g").alias("contains"))


def entity_f1(df: DataFrame, got: str, want: str) -> DataFrame:
    """df with entity_f1: the set F1 of two arrays."""
    both = F.size(F.array_intersect(got, want))
    n = F.size(F.array_distinct(got)) + F.size(F.array_distinct(want))
    return df.withColumn("entity_f1", F.when(n > 0, 2.0 * both / n).otherwise(1.0))


def graded_by_passages(questions: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """query_id, doc_id, rel: documents that hold runs of ``size`` words of a question; 2
    where they hold half of its runs or more, else 1."""

    def runs(rows: DataFrame, key: str) -> DataFrame:
        words = rows.select(key, T.tokens(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") >= size)
        each = words.select(key, "w", F.explode(F.sequence(F.lit(1), F.size("w") - (size - 1))).alias("i"))
        return each.select(key, F.xxhash64(F.slice("w", F.col("i"), F.lit(size))).alias("g"))

    asked = kept(runs(questions, "query_id").distinct())
    wanted = asked.select("g").distinct()
    if asked.count() <= MOST_RUNS:
        wanted = F.broadcast(wanted)
    # runs of no question go before anything is moved
    held = runs(docs, "doc_id").join(wanted, "g", "left_semi").distinct()
    shared = held.join(asked, "g").groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))
    all_runs = asked.groupBy("query_id").agg(F.count("*").alias("of"))
    return shared.join(all_runs, "query_id").select("query_id", "doc_id", F.when(F.col("n") / F.col("of") >= 0.5, 2).otherwise(1).alias("rel"))


def graded_by_jaccard(test: DataFrame, train: DataFrame, least: float = 0.0, high: float = 0.5) -> DataFrame:
    """query_id, doc_id, rel: sets (id, item) that overlap, 2 from ``high`` on."""
    t, r = test.select(F.col("id").alias("query_id"), "item").distinct(), train.select(F.col("id").alias("doc_id"), "item").distinct()
    nt, nr = t.groupBy("query_id").agg(F.count("*").alias("nt")), r.groupBy("doc_id").agg(F.count("*").alias("nr"))
    j = t.join(r, "item").groupBy("query_id", "doc_id").agg(F.count("*").alias("n")).join(nt, "query_id").join(nr, "doc_id")
    j = j.withColumn("j", F.col("n") / (F.col("nt") + F.col("nr") - F.col("n"))).where(F.col("j") > least)
    return j.select("query_id", "doc_id", F.when(F.col("j") >= high, 2).otherwise(1).alias("rel"))


def gate(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """metrics with ``passed`` and ``failed`` (names of the limits not held)."""
    broken = [F.when(~(F.col(m) >= v if op == ">=" else F.col(m) <= v), F.lit(m)) for m, (op, v) in limits.items()]
    failed = F.array_compact(F.array(*broken))
    return metrics.withColumn("failed", failed).withColumn("passed", F.size(failed) == 0)


def rank_hits(runs: DataFrame, accepted: DataFrame) -> DataFrame:
    """query_id, rank1, top5, rr of every query that has a ranking: whether an accepted
    document is first, among the first five, and its reciprocal rank within ten."""
    hit = runs.join(accepted.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("_r"))
    q = runs.select("query_id").distinct().join(hit, "query_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return q.select("query_id", flag(F.col("_r") == 1).alias("rank1"), flag(F.col("_r") <= 5).alias("top5"), F.when(F.col("_r") <= 10, 1.0 / F.col("_r")).otherwise(0.0).alias("rr"))


def joint_accuracy(rows: DataFrame, heads: list[str]) -> DataFrame:
    """One row: the share of rows that are right in every head (boolean columns)."""
    every = F.lit(True)
    for h in heads:
        every = every & F.coalesce(F.col(h), F.lit(False))
    return rows.agg(F.avg(every.cast("double")).alias("joint"))


def qa_recall(runs: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """query_id, found: whether the answer (query_id, gold) stands in one of the first k
    contents, both in normal form; an empty answer is not found."""
    g = gold.select("query_id", T.answer_form(F.col("gold")).alias("_g"))
    j = runs.where(F.col("rank") <= k).join(g, "query_id").withColumn("_f", (F.col("_g") != "") & F.contains(T.answer_form(F.col("content")), F.col("_g")))
    return j.groupBy("query_id").agg(F.bool_or("_f").alias("found"))


def unique_anchors(tokens: DataFrame, asked: DataFrame, tasks: int = 8) -> DataFrame:
    """memory_id, unique_anchor: whether a memory has a token of the question (token) that
    no other of its chain has: the smallest and the largest memory of the two are one.
    tokens: chain, memory_id, token, however often; dealt over ``tasks``."""
    mine = tokens.where("chain is not null").join(F.broadcast(asked.select("token").distinct()), "token", "left_semi")
    ends = mine.repartition(tasks, "chain", "token").groupBy("chain", "token").agg(F.min("memory_id").alias("memory_id"), F.max("memory_id").alias("_last"))
    only = ends.where("memory_id = _last").select("memory_id").repartition(tasks, "memory_id").distinct().withColumn("_u", F.lit(True))
    return tokens.select("memory_id").distinct().join(only, "memory_id", "left").select("memory_id", F.coalesce("_u", F.lit(False)).alias("unique_anchor"))


wilson = scores.wilson
