"""Queries: retrieval and classification metrics over a synthetic run.

Run: each nation's customers ranked by balance; relevant: those of one segment."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from recallforge import model as M
from recallforge.catalog import register
from recallforge.functions import scores as S, text as T
from recallforge.operators import metrics as X, ranking

_RUN = """WITH runs AS (SELECT CAST(c_nationkey AS BIGINT) AS query_id, c_custkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 100),
qrels AS (SELECT CAST(c_nationkey AS BIGINT) AS query_id, c_custkey AS doc_id, CASE WHEN c_acctbal > 5000 THEN 2 ELSE 1 END AS rel FROM customer WHERE c_mktsegment = 'BUILDING'),
q AS (SELECT DISTINCT query_id FROM qrels),
dcg AS (SELECT query_id, sum(rel / log2(rank + 1)) AS x FROM runs JOIN qrels USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1),
ide AS (SELECT query_id, sum(rel / log2(r + 1)) AS y FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS r FROM qrels QUALIFY r <= 10) GROUP BY 1),
nd AS (SELECT query_id, coalesce(x, 0) / y AS ndcg FROM ide LEFT JOIN dcg USING (query_id)),
rr AS (SELECT query_id, coalesce(1.0 / r, 0) AS rr FROM q LEFT JOIN (SELECT query_id, min(rank) AS r FROM runs JOIN qrels USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1) USING (query_id)),
rc AS (SELECT query_id, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END) AS recall FROM qrels LEFT JOIN runs USING (query_id, doc_id) GROUP BY 1)"""


def _run(spark, d):
    c = M.table(spark, d, "customer").withColumn("query_id", F.col("c_nationkey").cast("long"))
    w = Window.partitionBy("query_id").orderBy(F.desc("c_acctbal"), "c_custkey")
    runs = c.withColumn("rank", F.row_number().over(w)).where("rank <= 100").select("query_id", F.col("c_custkey").alias("doc_id"), "rank")
    qrels = c.where("c_mktsegment = 'BUILDING'").select("query_id", F.col("c_custkey").alias("doc_id"), F.when(F.col("c_acctbal") > 5000, 2).otherwise(1).alias("rel"))
    return runs, qrels


@register("ndcg_at_10", f"{_RUN} SELECT query_id, round(ndcg, 6) AS ndcg FROM nd")
def ndcg_at_10(spark, d):
    return X.ndcg(*_run(spark, d), 10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@register("mrr_at_10", f"{_RUN} SELECT query_id, round(rr, 6) AS rr FROM rr")
def mrr_at_10(spark, d):
    return X.mrr(*_run(spark, d), 10).select("query_id", F.round("rr", 6).alias("rr"))


@register("recall_at_k", f"{_RUN} SELECT query_id, round(recall, 6) AS recall FROM rc")
def recall_at_k(spark, d):
    return X.recall(*_run(spark, d), 10).select("query_id", F.round("recall", 6).alias("recall"))


@register("all_metrics", f"{_RUN} SELECT round(avg(ndcg), 6) AS ndcg_10, round(avg(rr), 6) AS mrr_10, round(avg(recall), 6) AS recall_10 FROM nd JOIN rr USING (query_id) JOIN rc USING (query_id)")
def all_metrics(spark, d):
    return X.all_metrics(*_run(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("ndcg_10", "mrr_10", "recall_10")])


_W = "SELECT c_mktsegment AS segment, count(*) FILTER (c_acctbal > 5000)::DOUBLE AS h, count(*)::DOUBLE AS n FROM customer GROUP BY 1"


@register("wilson_ci", f"SELECT segment, round((h / n + 3.8416 / (2 * n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low, round((h / n + 3.8416 / (2 * n) + 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM ({_W})")
def wilson_ci(spark, d):
    g = M.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count_if(F.col("c_acctbal") > 5000).cast("double").alias("h"), F.count("*").cast("double").alias("n"))
    low, high = S.wilson(F.col("h"), F.col("n"))
    return g.select("segment", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_PAIRS = "p AS (SELECT quality::BIGINT AS gold, (n_chars > 1500)::BIGINT AS predicted, (n_chars % 100) / 100.0 AS confidence FROM labels JOIN documents USING (doc_id))"


def _pairs(spark, d):
    return M.table(spark, d, "labels").join(M.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(
        F.col("quality").cast("long").alias("gold"), (F.col("n_chars") > 1500).cast("long").alias("predicted"), ((F.col("n_chars") % 100) / 100.0).alias("confidence")
    )


_CONF = f"WITH {_PAIRS}, k AS (SELECT gold AS c FROM p UNION SELECT predicted FROM p), t AS (SELECT c, (SELECT count(*) FROM p WHERE gold = c AND predicted = c) AS tp, (SELECT count(*) FROM p WHERE gold <> c AND predicted = c) AS fp, (SELECT count(*) FROM p WHERE gold = c AND predicted <> c) AS fn FROM k)"


@register("confusion", f"{_CONF} SELECT c AS class, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM t")
def confusion(spark, d):
    return X.confusion(_pairs(spark, d)).select("class", "tp", "fp", "fn")


@register("macro_f1", f"{_CONF} SELECT round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END), 6) AS macro_f1 FROM t")
def macro_f1(spark, d):
    return X.macro_f1(_pairs(spark, d)).select(F.round("macro_f1", 6).alias("macro_f1"))


@register("accuracy", f"WITH {_PAIRS} SELECT round(avg((gold = predicted)::INT), 6) AS accuracy FROM p")
def accuracy(spark, d):
    return X.accuracy(_pairs(spark, d)).select(F.round("accuracy", 6).alias("accuracy"))


@register("confidently_wrong", f"WITH {_PAIRS} SELECT round(avg((confidence >= 0.7 AND gold <> predicted)::INT), 6) AS confidently_wrong FROM p")
def confidently_wrong(spark, d):
    return X.confidently_wrong(_pairs(spark, d)).select(F.round("confidently_wrong", 6).alias("confidently_wrong"))


@register("slot_f1", "WITH g AS (SELECT DISTINCT l_orderkey AS id, l_linenumber AS slot, l_returnflag AS value FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS id, l_linenumber AS slot, CASE WHEN l_quantity > 25 THEN 'R' ELSE l_returnflag END AS value FROM lineitem) SELECT round(2.0 * (SELECT count(*) FROM g JOIN p USING (id, slot, value)) / ((SELECT count(*) FROM g) + (SELECT count(*) FROM p)), 6) AS slot_f1")
def slot_f1(spark, d):
    li = M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("slot"), F.col("l_returnflag").alias("value"), "l_quantity")
    p = li.withColumn("value", F.when(F.col("l_quantity") > 25, "R").otherwise(F.col("value")))
    return X.slot_f1(p, li).select(F.round("slot_f1", 6).alias("slot_f1"))


_AF = r"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+'), lambda t: t NOT IN ('a', 'an', 'the', '')), ' ')"


@register(
    "token_f1",
    f"""WITH a AS (SELECT x.conv_id AS id, {_AF.format('y.text')} AS p, {_AF.format('x.text')} AS g FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id WHERE x.turn = 0 AND y.turn = 1),
    tp AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(string_split(p, ' ')) AS t FROM a) WHERE t <> '' GROUP BY ALL), tg AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(string_split(g, ' ')) AS t FROM a) WHERE t <> '' GROUP BY ALL),
    c AS (SELECT id, sum(least(tp.n, tg.n)) AS c FROM tp JOIN tg USING (id, t) GROUP BY 1), np AS (SELECT id, sum(n) AS n FROM tp GROUP BY 1), ng AS (SELECT id, sum(n) AS n FROM tg GROUP BY 1)
    SELECT a.id, p = g AS em, round(coalesce(2.0 * c.c / (np.n + ng.n), 0), 6) AS f1, contains(p, g) AS contains FROM a LEFT JOIN c USING (id) LEFT JOIN np USING (id) LEFT JOIN ng USING (id)""",
)
def token_f1(spark, d):
    c = M.table(spark, d, "conversations")
    a = c.where("turn = 0").select(F.col("conv_id").alias("id"), F.col("text").alias("gold")).join(c.where("turn = 1").select(F.col("conv_id").alias("id"), F.col("text").alias("predicted")), "id")
    return X.token_f1(a).select("id", "em", F.round("f1", 6).alias("f1"), "contains")


@register("qrels_by_jaccard", "WITH t AS (SELECT DISTINCT l_orderkey AS q, l_suppkey AS i FROM lineitem WHERE l_orderkey % 97 = 0), r AS (SELECT DISTINCT l_orderkey AS d, l_suppkey AS i FROM lineitem WHERE l_orderkey % 97 <> 0), nt AS (SELECT q, count(*) AS n FROM t GROUP BY 1), nr AS (SELECT d, count(*) AS n FROM r GROUP BY 1), j AS (SELECT q, d, count(*) AS n FROM t JOIN r USING (i) GROUP BY ALL) SELECT q AS query_id, d AS doc_id, CASE WHEN j.n::DOUBLE / (nt.n + nr.n - j.n) >= 0.5 THEN 2 ELSE 1 END AS rel FROM j JOIN nt USING (q) JOIN nr USING (d) WHERE j.n::DOUBLE / (nt.n + nr.n - j.n) > 0.2")
def qrels_by_jaccard(spark, d):
    li = M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("item"))
    return X.graded_by_jaccard(li.where("id % 97 = 0"), li.where("id % 97 <> 0"), 0.2)


@register("current_state_qrels", "SELECT o_custkey AS query_id, o_orderkey AS doc_id, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN 2 ELSE 1 END AS rel FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 3")
def current_state_qrels(spark, d):
    w = Window.partitionBy("o_custkey")
    o = M.table(spark, d, "orders").withColumns({"n": F.count("*").over(w), "r": F.row_number().over(w.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))})
    return o.where("n >= 3").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.when(F.col("r") == 1, 2).otherwise(1).alias("rel"))


@register("distribution_counts", "WITH f AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT count(*) AS keys, count(*) FILTER (n >= 2) AS at_2, count(*) FILTER (n >= 5) AS at_5, count(*) FILTER (n >= 10) AS at_10, max(n) AS most FROM f")
def distribution_counts(spark, d):
    f = M.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return f.agg(F.count("*").alias("keys"), *[F.count_if(F.col("n") >= k).alias(f"at_{k}") for k in (2, 5, 10)], F.max("n").alias("most"))


@register("percentiles", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (i = floor(0.5 * (n - 1))) AS p50, max(value) FILTER (i = floor(0.95 * (n - 1))) AS p95 FROM r GROUP BY 1")
def percentiles(spark, d):
    return ranking.nearest_rank(M.table(spark, d, "events"), ["event_type"], "value", [0.5, 0.95])


@register(
    "distinctive_terms",
    r"WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'))) AS t FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT t AS term, count(*) AS df FROM t, n WHERE length(t) >= 8 GROUP BY t, n HAVING count(*) BETWEEN 2 AND greatest(2, floor(0.05 * n))",
)
def distinctive_terms(spark, d):
    docs = M.table(spark, d, "documents")
    t = docs.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).where("length(term) >= 8")
    return t.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df").between(2, max(2, int(0.05 * docs.count()))))


@register("promotion_gate", f"{_CONF} SELECT (SELECT avg((gold = predicted)::INT) FROM p) >= 0.7 AS passed")
def promotion_gate(spark, d):
    m = X.accuracy(_pairs(spark, d))
    return X.gate(m, {"accuracy": (">=", 0.7)}).select("passed")
