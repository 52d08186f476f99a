"""Queries: structured recall, traversal, subjects, further metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallforge import model as M
from recallforge.catalog import register
from recallforge.functions import scores as S, text as T
from recallforge.operators import recall as R, state

_S = f"WITH {M.STATES_SQL}"


@register("supplement_states", f"{_S} SELECT entity_id, node_id FROM states WHERE entity_id IN (1, 2, 3) AND created_at > TIMESTAMP '2024-01-10' AND node_id % 2 = 1 ORDER BY created_at DESC, node_id DESC LIMIT 20")
def supplement_states(spark, d):
    s = M.states(spark, d)
    ctx = spark.range(1, 4).select(F.col("id").alias("entity_id"))
    return R.supplement(s, ctx, s.where("node_id % 2 = 0"), 20, since=F.lit("2024-01-10").cast("timestamp_ntz"))


@register("supplement_current", f"{_S}, c AS (SELECT * FROM states WHERE entity_id IN (1, 2, 3) QUALIFY row_number() OVER (PARTITION BY entity_id, state_key ORDER BY created_at DESC, node_id DESC) = 1) SELECT entity_id, node_id FROM c ORDER BY created_at DESC, node_id DESC LIMIT 10")
def supplement_current(spark, d):
    s = M.states(spark, d)
    return R.supplement(s, spark.range(1, 4).select(F.col("id").alias("entity_id")), s.limit(0), 10, current_only=True)


@register("context_enrichment", f"{_S}, l AS (SELECT *, lag(node_id) OVER w AS p, lag(state_value) OVER w AS v FROM states WINDOW w AS (PARTITION BY entity_id, state_key ORDER BY created_at, node_id)) SELECT node_id, coalesce(string_agg(CAST(p AS VARCHAR), ',') FILTER (v = state_value), '') AS supports, coalesce(string_agg(CAST(p AS VARCHAR), ',') FILTER (v <> state_value), '') AS supersedes FROM l GROUP BY 1")
def context_enrichment(spark, d):
    s = M.states(spark, d)
    e = state.edges(state.reconcile(s)).where("edge_type <> 'superseded_by'")
    flat = lambda c: F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",").alias(c)
    return R.enrich(s, e).select("node_id", flat("supports"), flat("supersedes"))


_T = "m AS (SELECT o_custkey + 10000000 AS episode_id, o_orderkey AS member_id FROM orders), a AS (SELECT c_nationkey + 20000000 AS abstract_id, c_custkey + 10000000 AS episode_id FROM customer)"


def _tree(spark, d):
    m = M.table(spark, d, "orders").select((F.col("o_custkey") + 10_000_000).alias("episode_id"), F.col("o_orderkey").alias("member_id"))
    a = M.table(spark, d, "customer").select((F.col("c_nationkey") + 20_000_000).cast("long").alias("abstract_id"), (F.col("c_custkey") + 10_000_000).alias("episode_id"))
    return a, m


@register("traverse_top_down", f"WITH {_T}, one AS (SELECT episode_id AS node FROM a WHERE abstract_id = 20000003) SELECT level, node FROM (SELECT 0 AS level, 20000003 AS node UNION ALL SELECT 1, node FROM one UNION ALL SELECT 2, member_id FROM one JOIN m ON episode_id = node)")
def traverse_top_down(spark, d):
    a, m = _tree(spark, d)
    return R.top_down(a, m, spark.range(20_000_003, 20_000_004).select(F.col("id").alias("node"))).select("level", "node")


@register("traverse_bottom_up", f"WITH {_T} SELECT 0 AS level, 5 AS node WHERE true UNION ALL SELECT 1, episode_id FROM m WHERE member_id = 5 UNION ALL SELECT DISTINCT 2, abstract_id FROM m JOIN a USING (episode_id) WHERE member_id = 5")
def traverse_bottom_up(spark, d):
    a, m = _tree(spark, d)
    return R.bottom_up(a, m, spark.range(5, 6).select(F.col("id").alias("node"))).select("level", "node")


@register("traverse_lateral", f"WITH {_T} SELECT s.member_id AS seed_id, m.member_id FROM m s JOIN m ON s.episode_id = m.episode_id AND s.member_id <> m.member_id WHERE s.member_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY s.member_id ORDER BY m.member_id) <= 5")
def traverse_lateral(spark, d):
    _, m = _tree(spark, d)
    return R.siblings(m, m.where("member_id % 50 = 0"), 5)


_TOKS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> ''))"


@register("surrogate_answer", f"WITH s AS (SELECT source, doc_id, len(list_filter(['the', 'edition', 'with', 'thereon'], lambda q: list_contains({_TOKS}, q))) / 4.0 AS s FROM documents) SELECT source AS agent, doc_id, round(0.8 * s, 6) AS confidence FROM s WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY s DESC, doc_id) = 1")
def surrogate_answer(spark, d):
    words = F.array(*map(F.lit, ("the", "edition", "with", "thereon")))
    e = M.table(spark, d, "documents").select(F.col("source").alias("agent"), "doc_id", F.size(F.array_intersect(T.tokens(F.col("text")), words)).alias("_k"), T.tokens(F.col("text")).alias("t"))
    return R.surrogate(e, "agent", words, F.col("t"), "doc_id").select("agent", "doc_id", F.round("confidence", 6).alias("confidence"))


@register("subject_canonicalisation", r"WITH al AS (SELECT n_name AS alias, 'nation:' || n_nationkey AS subject FROM nation), s AS (SELECT DISTINCT n_name AS surface FROM nation UNION SELECT lower(n_name) || ' ' FROM nation UNION SELECT DISTINCT p_name FROM part) SELECT surface, coalesce(e.subject, m.subject, 'subject:' || coalesce(nullif(trim(regexp_replace(lower(surface), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown')) AS subject, CASE WHEN e.subject IS NOT NULL THEN 1.0 WHEN m.subject IS NOT NULL THEN 0.85 ELSE 0.6 END::DOUBLE AS confidence FROM s LEFT JOIN al e ON e.alias = surface LEFT JOIN al m ON lower(m.alias) = lower(trim(surface))")
def subject_canonicalisation(spark, d):
    n = M.table(spark, d, "nation")
    al = n.select(F.col("n_name").alias("alias"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("subject"))
    s = n.select(F.col("n_name").alias("surface")).union(n.select(F.concat(F.lower("n_name"), F.lit(" ")))).union(M.table(spark, d, "part").select("p_name")).distinct()
    return R.canonical(s, al)


@register("episode_match_score", "WITH e AS (SELECT event_id, value / (1 + value) AS b, (event_id % 5) / 4.0::DOUBLE AS o, (event_id % 3) / 2.0::DOUBLE AS dm, CASE WHEN event_id % 100000 <= 86400 THEN 1 - (event_id % 100000) / 86400.0::DOUBLE ELSE 0 END AS n, CAST(user_id % 2 = 0 AS INT) AS a, CAST(event_id % 11 = 0 AS INT) AS x FROM events) SELECT event_id, round(0.2 * b + 0.2 * (o / (1 + o)) + 0.25 * o + 0.15 * dm + 0.1 * n + 0.05 * a + 0.05 * x, 6)::DOUBLE AS score, round((0.2 * b + 0.25 * o + 0.15 * dm + 0.1 * n + 0.05 * a + 0.05 * x) / 0.8, 6)::DOUBLE AS dense FROM e")
def episode_match_score(spark, d):
    i = F.col("event_id")
    parts = ((i % 5) / 4.0, (i % 3) / 2.0, (i % 100000).cast("double"), F.col("user_id") % 2 == 0, i % 11 == 0)
    s = R.episode_score(F.col("value"), parts[0], *parts)
    none = R.episode_score(F.col("value"), None, *parts)
    return M.table(spark, d, "events").select("event_id", F.round(s, 6).alias("score"), F.round(none, 6).alias("dense"))


@register("episode_assignment", None)  # order-dependent; the tests walk it by brute force
def episode_assignment(spark, d):
    e = M.table(spark, d, "events").select("event_type", F.col("event_id").alias("fragment_id"), F.col("ts").alias("at"), F.array(F.col("user_id").cast("string"), F.get_json_object("props", "$.k")).alias("entities"))
    return R.assign_episodes(e, "event_type")


@register("trajectory_heuristics", "WITH t AS (SELECT o_custkey AS id, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS s, count(DISTINCT o_orderpriority) AS x, count(*) FILTER (o_orderpriority = '5-LOW') AS k FROM orders GROUP BY 1) SELECT id, round(0.4 * least(1.0, x / 5.0::DOUBLE) + 0.3 / (1 + 0.2 * greatest(0, n - 2)) + 0.1 * CASE WHEN id % 7 = 0 THEN 0 ELSE exp(-0.05 * (id % 30)) END + 0.1 * least(1.0, s::DOUBLE / n) + 0.1 * greatest(0.0, 1 - k::DOUBLE / n), 6)::DOUBLE AS score FROM t")
def trajectory_heuristics(spark, d):
    i = F.col("o_custkey")
    t = M.table(spark, d, "orders").groupBy(i.alias("id")).agg(F.count("*").alias("length"), F.count("*").alias("nodes"), F.countDistinct("o_orderpriority").alias("explained"), F.lit(5).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("supports"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("skipped"))
    t = t.withColumn("days", F.when(F.col("id") % 7 != 0, F.col("id") % 30))
    w = {"explanatory": 0.4, "parsimony": 0.3, "recency": 0.1, "robustness": 0.1, "counterfactual": 0.1}
    return R.trajectory_scores(t, w, least=2).select("id", F.round("score", 6).alias("score"))


@register(
    "gazetteer_spans",
    r"""WITH RECURSIVE c(surface, canonical, n) AS (VALUES ('of the', 'of-the', 2), ('the', 'the', 1), ('and the', 'and-the', 2), ('der', 'der', 1), ('de la', 'de-la', 2)),
    t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents),
    w AS (SELECT doc_id, unnest(range(len(t))) AS i, unnest(t) AS a, unnest(list_concat(t[2:], [NULL])) AS b FROM t),
    h AS (SELECT doc_id, i, max(n) AS n FROM w JOIN c ON (n = 1 AND surface = a) OR (n = 2 AND surface = a || ' ' || b) GROUP BY ALL),
    s AS (SELECT doc_id, i, h.n, canonical, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM h JOIN w USING (doc_id, i) JOIN c ON c.n = h.n AND ((c.n = 1 AND surface = a) OR (c.n = 2 AND surface = a || ' ' || b))),
    r(doc_id, k, free, canonical, kept) AS (SELECT doc_id, k, i + n, canonical, true FROM s WHERE k = 1 UNION ALL SELECT s.doc_id, s.k, CASE WHEN s.i >= r.free THEN s.i + s.n ELSE r.free END, s.canonical, s.i >= r.free FROM r JOIN s ON s.doc_id = r.doc_id AND s.k = r.k + 1)
    SELECT canonical, count(*) AS n FROM r WHERE kept GROUP BY 1""",
)
def gazetteer_spans(spark, d):
    cat = spark.createDataFrame([("of the", "of-the"), ("the", "the"), ("and the", "and-the"), ("der", "der"), ("de la", "de-la")], "surface string, canonical string")
    t = M.table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return R.gazetteer(t, "doc_id", "t", cat, 2).groupBy("canonical").agg(F.count("*").alias("n"))


@register("holistic_qrels", "WITH s AS (SELECT p_brand AS subsystem, p_partkey AS id FROM part) SELECT subsystem, id, q AS query FROM s, (VALUES ('overview'), ('history'), ('risks')) v(q) WHERE subsystem IN (SELECT subsystem FROM s GROUP BY 1 HAVING count(*) >= 5)")
def holistic_qrels(spark, d):
    s = M.table(spark, d, "part").select(F.col("p_brand").alias("subsystem"), F.col("p_partkey").alias("id"))
    big = s.groupBy("subsystem").agg(F.count("*").alias("n")).where("n >= 5").select("subsystem")
    return s.join(big, "subsystem", "left_semi").select("*", F.explode(F.array(*map(F.lit, ("overview", "history", "risks")))).alias("query"))


@register("overlap_statistics", None)
def overlap_statistics(spark, d):
    s = R.overlap_statistics(M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("x")))
    return s.select("total", "pairs", *[F.round(c, 6).alias(c) for c in ("fraction", "mean", "median", "most", "sd")])


@register("term_frequency_lift", rf"WITH t AS (SELECT doc_id, source, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS t FROM documents), r AS (SELECT doc_id, source, count(*) FILTER (t IN ('the', 'edition', 'de'))::DOUBLE / count(*) AS rate FROM t GROUP BY ALL) SELECT doc_id, round(rate - (sum(rate) OVER w - rate) / nullif(count(*) OVER w - 1, 0), 6) AS lift FROM r WINDOW w AS (PARTITION BY source)")
def term_frequency_lift(spark, d):
    t = T.tokens(F.col("text"))
    r = M.table(spark, d, "documents").select("doc_id", "source", (F.size(F.filter(t, lambda x: x.isin("the", "edition", "de"))) / F.nullif(F.size(t), F.lit(0))).alias("rate")).where("rate is not null")
    # sums per chain, joined back: no window sorts a large chain
    g = r.groupBy("source").agg(F.sum("rate").alias("s"), F.count("*").alias("n"))
    return r.join(g, "source").select("doc_id", F.round(F.col("rate") - (F.col("s") - F.col("rate")) / F.nullif(F.col("n") - 1, F.lit(0)), 6).alias("lift"))


def _causes_sql(hops: int = 6) -> str:
    steps = ["h1 AS (SELECT effect AS node_id, cause FROM e WHERE cause IS NOT NULL)"] + [f"h{k} AS (SELECT node_id, e.cause FROM h{k - 1} JOIN e ON e.effect = h{k - 1}.cause WHERE e.cause IS NOT NULL)" for k in range(2, hops + 1)]
    rows = " UNION ALL ".join(f"SELECT node_id, {k} AS hop, cause FROM h{k}" for k in range(1, hops + 1))
    return f"{_S}, e AS (SELECT node_id AS effect, lag(node_id) OVER (PARTITION BY entity_id ORDER BY created_at, node_id) AS cause FROM states), {', '.join(steps)} {rows}"


@register("transitive_causes", _causes_sql())
def transitive_causes(spark, d):
    from pyspark.sql import Window

    from recallforge.operators import grammar

    w = Window.partitionBy("entity_id").orderBy("created_at", "node_id")
    e = M.states(spark, d).select(F.col("node_id").alias("effect"), F.lag("node_id").over(w).alias("cause"), F.lit(1.0).alias("confidence")).where("cause is not null")
    return grammar.causes(e, M.states(spark, d).select("node_id"))


@register("ephemeral_expiry", f"SELECT event_id FROM events WHERE ts + to_seconds(CAST(value * 3600 AS BIGINT)) > TIMESTAMP '{M.NOW}'")
def ephemeral_expiry(spark, d):
    left = S.seconds_between(M.now(), F.col("ts"))
    return M.table(spark, d, "events").where(F.round(F.col("value") * 3600) > left).select("event_id")
