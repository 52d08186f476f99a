"""Queries: weights, bonuses and the combined score of candidates; search wiring."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallforge import model as M
from recallforge.catalog import register
from recallforge.functions import scores as S
from recallforge.operators import consolidation as C, graph as G, ranking, scoring as X

# a question's intent and a candidate's labels, by the remainder of an id
_NAMES = ("fact_lookup", "current_state_lookup", "historical_lookup", "event_reconstruction", "change_detection", "pattern_lookup", "strategic_reflection")
_KINDS = ("atomic", "entity_state", "episode", "abstract")
_LABELS = ("habitual", "choice", "positive", "none")
_CHANGES = ("declaration", "retirement", "none")


def _pick(values, n):
    return F.get(F.array(*map(F.lit, values)), F.pmod(n, F.lit(len(values))).cast("int"))


_INTENT = "(['fact_lookup', 'current_state_lookup', 'historical_lookup', 'event_reconstruction', 'change_detection', 'pattern_lookup', 'strategic_reflection'])[CAST(user_id % 7 AS INT) + 1]"


@register(
    "intent_weights",
    f"""WITH w AS (SELECT * FROM (VALUES ('fact_lookup', 0.6, 0.3, 0.3, 0.0), ('current_state_lookup', 0.4, 0.2, 0.5, 0.1), ('historical_lookup', 0.5, 0.3, 0.3, 0.1), ('event_reconstruction', 0.5, 0.3, 0.4, 0.0), ('change_detection', 0.4, 0.2, 0.5, 0.1), ('pattern_lookup', 0.3, 0.5, 0.3, 0.0), ('strategic_reflection', 0.3, 0.5, 0.3, 0.0)) v(intent, bm25, sparse, graph, recency))
    SELECT event_id, bm25::DOUBLE AS bm25, sparse::DOUBLE AS sparse, graph::DOUBLE AS graph, recency::DOUBLE AS recency FROM (SELECT event_id, {_INTENT} AS intent FROM events) JOIN w USING (intent)""",
)
def intent_weights(spark, d):
    return M.table(spark, d, "events").select("event_id", X.weights_of(_pick(_NAMES, F.col("user_id"))).alias("w")).select("event_id", "w.*")


@register(
    "hierarchy_bonus",
    f"""WITH t AS (SELECT * FROM (VALUES ('fact_lookup', 'atomic'), ('fact_lookup', 'entity_state'), ('current_state_lookup', 'entity_state'), ('historical_lookup', 'entity_state'), ('historical_lookup', 'episode'), ('event_reconstruction', 'episode'), ('event_reconstruction', 'atomic'), ('change_detection', 'entity_state'), ('pattern_lookup', 'abstract'), ('strategic_reflection', 'abstract')) v(intent, kind)),
    e AS (SELECT event_id, {_INTENT} AS intent, (['atomic', 'entity_state', 'episode', 'abstract'])[CAST(event_id % 4 AS INT) + 1] AS a, (['atomic', 'entity_state', 'episode', 'abstract'])[CAST((event_id // 4) % 4 AS INT) + 1] AS b FROM events)
    SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.intent = e.intent AND t.kind IN (e.a, e.b)) THEN 0.5 ELSE 0.0 END::DOUBLE AS bonus FROM e""",
)
def hierarchy_bonus(spark, d):
    i = F.col("event_id")
    types = F.array(_pick(_KINDS, i), _pick(_KINDS, F.floor(i / 4)))
    return M.table(spark, d, "events").select("event_id", X.hierarchy_bonus(types, _pick(_NAMES, F.col("user_id"))).alias("bonus"))


@register(
    "intent_alignment_bonus",
    f"""WITH e AS (SELECT event_id, {_INTENT} AS intent, (['habitual', 'choice', 'positive', 'none'])[CAST(event_id % 4 AS INT) + 1] AS label, (['declaration', 'retirement', 'none'])[CAST(event_id % 3 AS INT) + 1] AS change FROM events)
    SELECT event_id, CASE WHEN (intent = 'pattern_lookup' AND label = 'habitual') OR (intent = 'strategic_reflection' AND label IN ('habitual', 'choice')) THEN 0.5 ELSE 0.0 END::DOUBLE AS intent_bonus, CASE WHEN intent = 'change_detection' AND change IN ('declaration', 'retirement') THEN 0.5 ELSE 0.0 END::DOUBLE AS change_bonus FROM e""",
)
def intent_alignment_bonus(spark, d):
    i, q = F.col("event_id"), _pick(_NAMES, F.col("user_id"))
    return M.table(spark, d, "events").select("event_id", X.label_bonus(_pick(_LABELS, i), q, X.ALIGNED).alias("intent_bonus"), X.label_bonus(_pick(_CHANGES, i), q, X.ALIGNED_CHANGES).alias("change_bonus"))


@register("role_grounding_bonus", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND lower(p_type) IN ('economy', 'promo') THEN 0.5 ELSE 0.0 END::DOUBLE AS bonus FROM part")
def role_grounding_bonus(spark, d):
    roles = F.array(F.struct(_pick(("primary", "alternative", "casual"), F.col("p_size")).alias("role"), F.col("p_type").alias("canonical")), F.struct(F.lit("casual").alias("role"), F.lit("Economy").alias("canonical")))
    return M.table(spark, d, "part").select("p_partkey", X.role_bonus(roles, F.array(F.lit("economy"), F.lit("Promo"))).alias("bonus"))


@register(
    "ppr_memory_score",
    f"""WITH {M.LINKS_SQL}, n AS (SELECT count(DISTINCT memory_id)::DOUBLE AS n FROM links), idf AS (SELECT entity_id, ln((SELECT n FROM n) / count(DISTINCT memory_id)) AS idf FROM links GROUP BY 1),
    p AS (SELECT p_partkey AS entity_id, p_retailprice / (SELECT max(p_retailprice) FROM part WHERE p_size > 20) AS p FROM part WHERE p_size > 20 AND p_retailprice > 0)
    SELECT memory_id, round(coalesce(avg(p * idf), 0.0), 6) AS graph FROM links LEFT JOIN p USING (entity_id) LEFT JOIN idf USING (entity_id) GROUP BY 1""",
)
def ppr_memory_score(spark, d):
    links = M.links(spark, d)
    ranks = M.table(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("rank"))
    return X.ppr_score(links, ranks, G.document_frequency(links)).select("memory_id", F.round("graph", 6).alias("graph"))


@register(
    "graph_spreading_memory",
    f"""WITH {M.LINKS_SQL}, a AS (SELECT p_partkey AS entity_id, p_retailprice / 1997 AS a FROM part WHERE p_size > 25), c AS (SELECT p_partkey AS entity_id FROM part WHERE p_size = 30)
    SELECT memory_id, round(coalesce(sum(a), 0) / greatest(1, count(*) + (SELECT count(*) FROM c) - count(c.entity_id)), 6) AS graph FROM links LEFT JOIN a USING (entity_id) LEFT JOIN c ON c.entity_id = links.entity_id GROUP BY 1""",
)
def graph_spreading_memory(spark, d):
    p = M.table(spark, d, "part")
    act = p.where("p_size > 25").select(F.col("p_partkey").alias("node"), (F.col("p_retailprice") / 1997).alias("activation"))
    return X.spread_score(M.links(spark, d), act, p.where("p_size = 30").select(F.col("p_partkey").alias("node"))).select("memory_id", F.round("graph", 6).alias("graph"))


@register(
    "association_spreading",
    f"""WITH {M.LINKS_SQL}, c AS (SELECT p_partkey AS entity_id FROM part WHERE p_size IN (7, 8)), s AS (SELECT p_partkey AS a, p_partkey + 3 AS b, (p_size % 10) / 10.0 AS strength FROM part),
    m AS (SELECT b AS entity_id, max(strength) AS s FROM s WHERE a IN (SELECT entity_id FROM c) GROUP BY 1)
    SELECT memory_id, round(sum(CASE WHEN c.entity_id IS NOT NULL THEN coalesce(m.s, 0) ELSE 0 END) / (count(*) + (SELECT count(*) FROM c) - count(c.entity_id)), 6)::DOUBLE AS spreading FROM links l LEFT JOIN c ON c.entity_id = l.entity_id LEFT JOIN m ON m.entity_id = l.entity_id GROUP BY 1""",
)
def association_spreading(spark, d):
    p = M.table(spark, d, "part")
    ctx = p.where("p_size in (7, 8)").select(F.col("p_partkey").alias("entity_id"))
    strength = p.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 3).alias("b"), ((F.col("p_size") % 10) / 10).alias("strength"))
    return X.association_spreading(M.links(spark, d), ctx, strength).select("memory_id", F.round("spreading", 6).alias("spreading"))


@register("event_time", f"WITH s AS (SELECT user_id, min(ts) FILTER (event_type = 'error') AS node, min(ts) FILTER (event_type = 'click') AS memory FROM events GROUP BY 1) SELECT user_id, coalesce(node, memory, TIMESTAMP '{M.NOW}') AS at FROM s")
def event_time(spark, d):
    at = lambda k: F.min(F.when(F.col("event_type") == k, F.col("ts")))
    g = M.table(spark, d, "events").groupBy("user_id").agg(at("error").alias("node"), at("click").alias("memory"))
    return g.select("user_id", X.event_time(F.col("node"), F.col("memory"), M.now()).alias("at"))


@register("total_activation", f"WITH {M.ACCESSES_SQL}, b AS (SELECT memory_id, ln(sum(power(age, -0.5)) FILTER (age > 0)) AS b FROM (SELECT memory_id, (epoch_us(TIMESTAMP '{M.NOW}') - epoch_us(accessed_at)) / 1e6 AS age FROM accesses) GROUP BY 1) SELECT memory_id, round(coalesce(b, -10) + 0.1::DOUBLE * (memory_id % 5) - 0.3::DOUBLE, 6) AS activation FROM b")
def total_activation(spark, d):
    a = M.accesses(spark, d).withColumn("age", S.seconds_between(M.now(), F.col("accessed_at")))
    b = a.groupBy("memory_id").agg(S.base_level(F.col("age")).alias("b"))
    return b.select("memory_id", F.round(S.total_activation(F.col("b"), 0.1 * (F.col("memory_id") % 5), 0.0, 0.3), 6).alias("activation"))


def _candidates(spark, d):
    """Candidates with every signal, out of the events."""
    i, u = F.col("event_id"), F.col("user_id")
    age = S.seconds_between(M.now(), F.col("ts"))
    e = M.table(spark, d, "events").select(
        F.col("event_id").alias("memory_id"), F.col("value").alias("bm25"), (F.pmod(i * 7, F.lit(31)) / 3.0).alias("sparse"), (F.pmod(i, F.lit(13)) / 5.0).alias("graph"), (F.pmod(i, F.lit(9)) / 9.0).alias("temporal"),
        (F.pmod(i, F.lit(11)) - 8.0).alias("activation"), S.recency(age).alias("recency"), (i % 5 == 0).alias("superseded"), (i % 7 == 0).alias("conflicted"), _pick(_NAMES, u).alias("intent"),
        F.array(_pick(_KINDS, i), _pick(_KINDS, F.floor(i / 4))).alias("node_types"), _pick(_LABELS, i).alias("label"), _pick(_CHANGES, i).alias("change"),
        F.array(F.struct(_pick(("primary", "alternative", "casual"), i).alias("role"), F.col("event_type").alias("canonical"))).alias("roles"), F.array(F.lit("Click"), F.lit("error")).alias("names"),
        F.when(i % 3 > 0, F.pmod(i, F.lit(17)) / 4.0 - 1.0).alias("model"),
    )
    return e


_CAND = f"""c AS (SELECT event_id AS memory_id, value AS bm25, (event_id * 7 % 31) / 3.0::DOUBLE AS sparse, (event_id % 13) / 5.0::DOUBLE AS graph, (event_id % 9) / 9.0::DOUBLE AS temporal, (event_id % 11) - 8.0::DOUBLE AS activation,
    exp(-ln(2) * (epoch_us(TIMESTAMP '{M.NOW}') - epoch_us(ts)) / 1e6 / 86400 / 30) AS recency, user_id % 7 AS q, event_id % 4 AS k1, event_id // 4 % 4 AS k2, event_id % 3 AS ch, event_type, CASE WHEN event_id % 3 > 0 THEN (event_id % 17) / 4.0::DOUBLE - 1 END AS model FROM events),
x AS (SELECT *, CASE WHEN q = 1 THEN (CASE WHEN memory_id % 5 = 0 THEN 0.3 ELSE 0 END) + (CASE WHEN memory_id % 7 = 0 THEN 0.15 ELSE 0 END) ELSE 0 END::DOUBLE AS penalty,
    CASE WHEN (q = 5 AND k1 = 0) OR (q = 6 AND k1 IN (0, 1)) THEN 0.5 ELSE 0 END::DOUBLE AS ia, CASE WHEN q = 4 AND ch IN (0, 1) THEN 0.5 ELSE 0 END::DOUBLE AS sc, CASE WHEN ch = 0 AND event_type IN ('click', 'error') THEN 0.5 ELSE 0 END::DOUBLE AS rg,
    CASE WHEN (q = 0 AND (k1 IN (0, 1) OR k2 IN (0, 1))) OR (q IN (1, 4) AND (k1 = 1 OR k2 = 1)) OR (q = 2 AND (k1 IN (1, 2) OR k2 IN (1, 2))) OR (q = 3 AND (k1 IN (0, 2) OR k2 IN (0, 2))) OR (q IN (5, 6) AND (k1 = 3 OR k2 = 3)) THEN 0.5 ELSE 0 END::DOUBLE AS hb,
    ([0.6, 0.4, 0.5, 0.5, 0.4, 0.3, 0.3])[CAST(q AS INT) + 1]::DOUBLE AS wb, ([0.3, 0.2, 0.3, 0.3, 0.2, 0.5, 0.5])[CAST(q AS INT) + 1]::DOUBLE AS ws, ([0.3, 0.5, 0.3, 0.4, 0.5, 0.3, 0.3])[CAST(q AS INT) + 1]::DOUBLE AS wg, ([0.0, 0.1, 0.1, 0.0, 0.1, 0.0, 0.0])[CAST(q AS INT) + 1]::DOUBLE AS wr FROM c),
m AS (SELECT max(bm25) AS mb, max(sparse) AS ms, max(graph) AS mg, max(temporal) AS mt, min(coalesce(model, 0)) AS lo, max(coalesce(model, 0)) AS hi FROM c)"""


@register(
    "combined_score",
    f"""WITH {_CAND} SELECT memory_id, round(wb * bm25 / mb + ws * sparse / ms + wg * graph / mg + wr * recency + 0.1 * activation + 0.2 * hb + 0.2 * temporal / mt - penalty + 0.5 * ia + 0.5 * sc + 0.4 * rg, 6) AS score
    FROM x, m WHERE 1 / (1 + exp(-(activation + 2) / 0.4)) >= 0.05""",
)
def combined_score(spark, d):
    w = X.Weights(activation=0.1, hierarchy=0.2, role=0.4)
    return X.combined(_candidates(spark, d), w).select("memory_id", F.round("score", 6).alias("score"))


@register("combined_score_reranked", f"WITH {_CAND} SELECT memory_id, round(0.7 * (coalesce(model, lo) - lo) / (hi - lo) + 0.3 * (0.67 * bm25 / mb + 0.33 * sparse / ms) + 0.2 * temporal / mt - penalty + 0.5 * ia + 0.5 * sc, 6) AS score FROM x, m")
def combined_score_reranked(spark, d):
    return X.combined(_candidates(spark, d), model="model").select("memory_id", F.round("score", 6).alias("score"))


@register("reconciliation_penalty", "SELECT event_id, CASE WHEN user_id % 7 = 1 THEN (CASE WHEN event_id % 5 = 0 THEN 0.3 ELSE 0 END) + (CASE WHEN event_id % 7 = 0 THEN 0.15 ELSE 0 END) ELSE 0 END::DOUBLE AS penalty FROM events")
def reconciliation_penalty(spark, d):
    i = F.col("event_id")
    return M.table(spark, d, "events").select("event_id", F.round(S.penalty(i % 5 == 0, i % 7 == 0, _pick(_NAMES, F.col("user_id"))), 6).alias("penalty"))


@register("rerank_min_max", "WITH c AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS s FROM orders), m AS (SELECT min(coalesce(s, 0)) AS lo, max(coalesce(s, 0)) AS hi FROM c) SELECT o_orderkey, round((coalesce(s, lo) - lo) / (hi - lo), 6) AS share FROM c, m")
def rerank_min_max(spark, d):
    o = M.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("s"))
    ends = o.agg(F.min(F.coalesce("s", F.lit(0.0))).alias("lo"), F.max(F.coalesce("s", F.lit(0.0))).alias("hi"))
    j = o.join(F.broadcast(ends))
    return j.select("o_orderkey", F.round((F.coalesce("s", "lo") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("share"))


@register("grammar_promotion", "WITH r AS (SELECT o_orderkey AS id, o_totalprice AS score FROM orders WHERE o_orderpriority = '1-URGENT'), a AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'P' QUALIFY place <= 7) SELECT id, CASE WHEN a.place IS NOT NULL THEN (SELECT max(score) FROM r) + 1 ELSE r.score END AS score, a.place FROM r FULL JOIN a USING (id)")
def grammar_promotion(spark, d):
    o = M.table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    r = o.where("o_orderpriority = '1-URGENT'").select("id", F.col("o_totalprice").alias("score"))
    a = o.where("o_orderstatus = 'P'").orderBy("o_orderdate", "id").limit(7)
    a = ranking.per_group(a.withColumn("_g", F.lit(0)), ["_g"], ["o_orderdate", "id"], 7).select("id", F.struct("o_orderdate", "id").alias("o"))
    from pyspark.sql import Window

    a = a.withColumn("place", F.row_number().over(Window.orderBy("o")).cast("long")).select("id", "place")  # seven rows
    return X.promote(r, a, "id")


@register("scale_flags", "SELECT count(*) <= 10000 AS reranker, count(*) <= 50000 AS intent FROM documents")
def scale_flags(spark, d):
    flags = X.scale_flags(M.table(spark, d, "documents").count(), reranker=True, intent=True)
    return spark.createDataFrame([(flags["reranker"], flags["intent"])], "reranker boolean, intent boolean")


@register("query_entities", "SELECT q.name, min(c_custkey) AS entity_id FROM (VALUES ('customer#000000007'), ('CUSTOMER#000000011'), ('nobody')) q(name) JOIN customer ON lower(c_name) = lower(q.name) GROUP BY 1")
def query_entities(spark, d):
    names = spark.createDataFrame([("customer#000000007",), ("CUSTOMER#000000011",), ("nobody",)], "name string")
    return X.resolved(names, M.table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("entity_id")))


@register(
    "graph_expanded_candidates",
    f"""WITH {M.LINKS_SQL}, c AS (SELECT o_orderkey AS memory_id, o_totalprice AS score FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 3),
    own AS (SELECT DISTINCT entity_id FROM links WHERE memory_id IN (SELECT memory_id FROM c)), e AS (SELECT p_partkey AS src, p_partkey + 1 AS dst FROM part),
    near AS (SELECT entity_id FROM own UNION SELECT dst FROM e WHERE src IN (SELECT entity_id FROM own) UNION SELECT src FROM e WHERE dst IN (SELECT entity_id FROM own)),
    n AS (SELECT DISTINCT memory_id FROM links WHERE entity_id IN (SELECT entity_id FROM near) AND memory_id NOT IN (SELECT memory_id FROM c) ORDER BY memory_id LIMIT 10)
    SELECT memory_id, score FROM c UNION ALL SELECT memory_id, 0.0 FROM n""",
)
def graph_expanded_candidates(spark, d):
    o = M.table(spark, d, "orders").where("o_orderpriority = '2-HIGH' and o_orderstatus = 'F'")
    c = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3).select(F.col("o_orderkey").alias("memory_id"), F.col("o_totalprice").alias("score"))
    edges = M.table(spark, d, "part").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"))
    return X.graph_expansion(c, M.links(spark, d), edges)


@register("event_supplement", "WITH ep AS (SELECT c_custkey AS episode_id, c_acctbal AS bal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 5) SELECT episode_id, o_orderkey AS memory_id FROM orders JOIN ep ON o_custkey = episode_id WHERE o_orderstatus <> 'F' ORDER BY bal DESC, episode_id DESC, o_orderkey LIMIT 20")
def event_supplement(spark, d):
    ep = M.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("episode_id"), F.col("c_acctbal").alias("created_at"))
    o = M.table(spark, d, "orders")
    return X.event_supplement(ep, o.select(F.col("o_custkey").alias("episode_id"), F.col("o_orderkey").alias("memory_id")), o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("memory_id")))


@register("anchor_candidates", f"WITH {M.LINKS_SQL}, e AS (SELECT p_partkey AS entity_id FROM part WHERE lower(p_name) = 'red widget'), l AS (SELECT DISTINCT memory_id FROM links WHERE entity_id IN (SELECT entity_id FROM e)), t AS (SELECT doc_id AS memory_id FROM documents WHERE contains(lower(text), 'red widget') OR contains(lower(text), 'there')) SELECT memory_id, 'linked' AS how FROM l UNION ALL SELECT memory_id, 'text' FROM (SELECT doc_id AS memory_id FROM documents WHERE contains(lower(text), 'red widget')) WHERE memory_id NOT IN (SELECT memory_id FROM l)")
def anchor_candidates(spark, d):
    entities = M.table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    return X.anchor_candidates("Red Widget", M.memories(spark, d), M.links(spark, d), entities)


@register("expansion_terms_quota", "WITH t AS (SELECT l_partkey AS e, l_suppkey AS p, count(*) AS c FROM lineitem WHERE l_partkey IN (3, 5, 8) GROUP BY ALL), r AS (SELECT e, p, row_number() OVER (PARTITION BY e ORDER BY c DESC, p) AS r FROM t) SELECT DISTINCT p AS term FROM r WHERE e = 3 AND r <= 6")
def expansion_terms_quota(spark, d):
    t = M.table(spark, d, "lineitem").where("l_partkey in (3, 5, 8)").groupBy(F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("partner")).agg(F.count("*").alias("c"))
    from recallforge.operators import retrieval

    ranked = retrieval.ranked(t, "partner", "c", ["entity"])
    terms = X.expansion_terms(ranked, [3], 6)
    return spark.createDataFrame([(t,) for t in terms], "term long")


@register(
    "classifier_chain",
    """WITH e AS (SELECT event_id, event_type AS a, value / 120 AS ca, CASE WHEN event_id % 3 = 0 THEN 'topic' || event_id % 5 END AS t, CASE WHEN event_id % 2 = 0 THEN 0.9 ELSE 0.1 END::DOUBLE AS ct FROM events)
    SELECT event_id, CASE WHEN ca >= 0.3 THEN a ELSE 'none' END AS intent, CASE WHEN t IS NOT NULL AND ct >= 0.3 THEN t END AS topic, 'persist' AS admission FROM e""",
)
def classifier_chain(spark, d):
    i = F.col("event_id")
    none = F.lit(None).cast("string")
    unknown = F.lit(None).cast("double")
    first = F.struct(
        F.col("event_type").alias("intent"), (F.col("value") / 120).alias("intent_confidence"), F.when(i % 3 == 0, F.concat(F.lit("topic"), (i % 5).cast("string"))).alias("topic"), F.when(i % 2 == 0, 0.9).otherwise(0.1).alias("topic_confidence"),
        none.alias("admission"), unknown.alias("admission_confidence"), none.alias("change"), unknown.alias("change_confidence"),
    )
    e = M.table(spark, d, "events").select("event_id", first.alias("a"), X.fallback_label().alias("b"))
    return e.select("event_id", X.chain([F.col("a"), F.col("b")]).alias("l")).select("event_id", "l.intent", "l.topic", "l.admission")


@register("fallback_labels", "SELECT doc_id, 'none' AS intent, 0.0::DOUBLE AS intent_confidence, 'persist' AS admission, 'none' AS change FROM documents")
def fallback_labels(spark, d):
    return M.table(spark, d, "documents").select("doc_id", X.fallback_label().alias("l")).select("doc_id", "l.intent", "l.intent_confidence", "l.admission", "l.change")


_DOT = "list_sum(list_transform(list_zip(e.embedding, q.v), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


@register("zero_shot_label", f"WITH q AS (SELECT vec_id AS k, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id < 4), s AS (SELECT e.vec_id, q.k, {_DOT} / sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS s FROM embeddings e, q) SELECT vec_id, 'label' || k AS label, round(s, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k) = 1")
def zero_shot_label(spark, d):
    e = M.table(spark, d, "embeddings")
    labels = {f"label{r.vec_id}": [float(x) for x in r.embedding] for r in e.where("vec_id < 4").orderBy("vec_id").collect()}
    return e.select("vec_id", X.nearest_label(F.col("embedding"), labels).alias("l")).select("vec_id", "l.label", F.round("l.score", 5).alias("score"))


@register("strong_associations", f"WITH {M.LINKS_SQL}, n AS (SELECT count(DISTINCT memory_id)::DOUBLE AS n FROM links), ic AS (SELECT entity_id, count(*) AS c FROM links GROUP BY 1), pc AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS ab FROM links x JOIN links y ON x.memory_id = y.memory_id AND x.entity_id < y.entity_id GROUP BY ALL), s AS (SELECT a, b, round(least(10.0, greatest(0.0, ln(ab * n / (ia.c * ib.c)))) / 10, 9) AS strength FROM pc JOIN ic ia ON ia.entity_id = a JOIN ic ib ON ib.entity_id = b, n) SELECT a, b, strength FROM s WHERE strength >= 0.3 ORDER BY strength DESC, a, b LIMIT 500")
def strong_associations(spark, d):
    s = C.associations(M.links(spark, d), "memory_id", "entity_id").withColumn("strength", F.round("strength", 9))
    return s.where("strength >= 0.3").orderBy(F.desc("strength"), "a", "b").limit(500)
