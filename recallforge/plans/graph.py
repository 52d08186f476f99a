"""Queries: co-occurrence, spreading, PageRank, components; associations and decay."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallforge import model as M
from recallforge.catalog import register
from recallforge.operators import consolidation as C, graph as G, retrieval as R

_L = f"WITH {M.LINKS_SQL}"
_CO = f"""{_L}, few AS (SELECT memory_id, list_sort(list(DISTINCT entity_id))[1:12] AS e FROM links GROUP BY 1),
ex AS (SELECT memory_id, unnest(e) AS x FROM few),
co AS (SELECT a.x AS src, b.x AS dst, count(*) AS count FROM ex a JOIN ex b ON a.memory_id = b.memory_id AND a.x < b.x GROUP BY ALL)"""


def _agents(spark, d):
    """A small directed graph: users and the agents that their events name."""
    return M.accesses(spark, d).select(F.col("memory_id").alias("src"), F.col("agent").alias("dst")).where("src <> dst")


_AG = f"WITH {M.ACCESSES_SQL}, e AS (SELECT memory_id AS src, agent AS dst FROM accesses WHERE memory_id <> agent)"


@register("entity_idf", f"{_L} SELECT entity_id, count(DISTINCT memory_id) AS df, round(ln((SELECT count(DISTINCT memory_id) FROM links)::DOUBLE / count(DISTINCT memory_id)), 6) AS idf FROM links GROUP BY 1")
def entity_idf(spark, d):
    return G.document_frequency(M.links(spark, d)).select("entity_id", "df", F.round("idf", 6).alias("idf"))


@register("cooccurrence_both_ways", f"{_CO} SELECT src, dst FROM co UNION SELECT dst, src FROM co")
def cooccurrence_both_ways(spark, d):
    return G.both_ways(G.cooccurrence(M.links(spark, d)))


@register("cooccurrence_edges", f"{_CO} SELECT src, dst, count FROM co WHERE count >= 2")
def cooccurrence_edges(spark, d):
    return G.cooccurrence(M.links(spark, d)).where("count >= 2")


@register("entity_degree", f"{_CO} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM co UNION ALL SELECT dst FROM co) GROUP BY node")
def entity_degree(spark, d):
    return G.degree(G.cooccurrence(M.links(spark, d)))


@register("two_hop_neighbours", f"{_AG}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), h1 AS (SELECT DISTINCT dst AS node FROM b WHERE src = 1 AND dst <> 1), h2 AS (SELECT DISTINCT b.dst AS node FROM h1 JOIN b ON b.src = h1.node WHERE b.dst <> 1 AND b.dst NOT IN (SELECT node FROM h1)) SELECT node, 1 AS hop FROM h1 UNION ALL SELECT node, 2 FROM h2")
def two_hop_neighbours(spark, d):
    return G.hops(_agents(spark, d), spark.range(1, 2).select(F.col("id").alias("seed")), 2).select("node", "hop")


@register("related_memories", f"{_L}, s AS (SELECT memory_id FROM links WHERE entity_id = 7), n AS (SELECT DISTINCT entity_id FROM links WHERE memory_id IN (SELECT memory_id FROM s)) SELECT DISTINCT memory_id FROM links WHERE entity_id IN (SELECT entity_id FROM n)")
def related_memories(spark, d):
    links = M.links(spark, d)
    near = links.join(links.where("entity_id = 7").select("memory_id"), "memory_id", "left_semi").select("entity_id").distinct()
    return links.join(near, "entity_id", "left_semi").select("memory_id").distinct()


@register(
    "graph_spreading",
    f"""{_AG}, w AS (SELECT src, dst, 1.0::DOUBLE AS weight FROM e GROUP BY ALL), b AS (SELECT src, dst, max(weight) AS weight FROM (SELECT * FROM w UNION ALL SELECT dst, src, weight FROM w) GROUP BY ALL),
    dg AS (SELECT src, count(*) AS n FROM b GROUP BY 1), f AS (SELECT b.src, b.dst, weight * CASE WHEN n > 4 THEN 1 / log2(n) ELSE 1 END * 0.5 AS f FROM b JOIN dg USING (src)),
    a0 AS (SELECT node, 0.5::DOUBLE AS a FROM (VALUES (1), (2)) v(node)),
    a1 AS (SELECT f.dst AS node, max(a * f) AS a FROM a0 JOIN f ON f.src = a0.node WHERE a * f >= 0.001 GROUP BY 1),
    a2 AS (SELECT f.dst AS node, max(a * f) AS a FROM a1 JOIN f ON f.src = a1.node WHERE a * f >= 0.001 GROUP BY 1)
    SELECT CAST(node AS BIGINT) AS node, round(max(a), 6) AS activation FROM (SELECT * FROM a0 UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2) GROUP BY 1""",
)
def graph_spreading(spark, d):
    e = _agents(spark, d).distinct().withColumn("weight", F.lit(1.0))
    return G.spread(e, spark.range(1, 3).select(F.col("id").alias("node"))).select("node", F.round("activation", 6).alias("activation"))


def _pagerank_sql(rounds: int) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT node, 1.0 / n AS r FROM nodes, cn)"]
    for k in range(rounds):
        steps.append(
            f"r{k + 1} AS MATERIALIZED (SELECT node, 0.15 / n + 0.85 * (coalesce(i, 0) + l / n) AS r FROM nodes LEFT JOIN (SELECT dst AS node, sum(r * w) AS i FROM r{k} JOIN sh ON sh.src = r{k}.node GROUP BY 1) USING (node), cn, (SELECT coalesce(sum(r), 0) AS l FROM r{k} WHERE node NOT IN (SELECT src FROM sh)))"
        )
    return f"""{_AG}, de AS (SELECT DISTINCT src, dst FROM e), nodes AS (SELECT src AS node FROM de UNION SELECT dst FROM de), cn AS (SELECT count(*)::DOUBLE AS n FROM nodes),
    sh AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM de), {', '.join(steps)} SELECT node, round(r, 8) AS rank FROM r{rounds}"""


@register("pagerank_fixed_iter", _pagerank_sql(50))
def pagerank_fixed_iter(spark, d):
    return G.pagerank(_agents(spark, d), rounds=50).select("node", F.round("rank", 8).alias("rank"))


def _ppr_sql(rounds: int) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT node, s AS r FROM seed)"]
    for k in range(rounds):
        steps.append(
            f"r{k + 1} AS MATERIALIZED (SELECT node, sum(r) AS r FROM (SELECT sh.dst AS node, 0.85 * r * w AS r FROM r{k} JOIN sh ON sh.src = r{k}.node UNION ALL SELECT node, s * (0.15 + 0.85 * l) FROM seed, (SELECT coalesce(sum(r), 0) AS l FROM r{k} WHERE node NOT IN (SELECT src FROM sh))) GROUP BY node)"
        )
    return f"""{_AG}, we AS (SELECT src, dst, count(*)::DOUBLE AS c FROM e GROUP BY ALL), sh AS (SELECT src, dst, c / sum(c) OVER (PARTITION BY src) AS w FROM we),
    seed AS (SELECT CAST(node AS BIGINT) AS node, 0.5::DOUBLE AS s FROM (VALUES (1), (2)) v(node)), {', '.join(steps)} SELECT node, round(r, 8) AS rank FROM r{rounds}"""


@register("personalised_pagerank", _ppr_sql(50))
def personalised_pagerank(spark, d):
    e = _agents(spark, d).withColumn("weight", F.lit(1.0))
    seeds = spark.range(1, 3).select(F.col("id").alias("node"), F.lit(0.5).alias("share"))
    return G.personal_pagerank(e, seeds, rounds=50).select("node", F.round("rank", 8).alias("rank"))


def _components_sql(rounds: int = 40) -> str:
    """Smallest label of a neighbour, ``rounds`` times: exact for components of that
    diameter (orders and parts are a few steps apart)."""
    steps = ["l0 AS MATERIALIZED (SELECT a AS node, min(least(a, b)) AS m FROM u GROUP BY 1)"]
    for k in range(rounds):
        steps.append(f"l{k + 1} AS MATERIALIZED (SELECT u.a AS node, least(min(x.m), min(y.m)) AS m FROM u JOIN l{k} x ON x.node = u.b JOIN l{k} y ON y.node = u.a GROUP BY 1)")
    return f"""WITH e AS (SELECT DISTINCT l_orderkey AS a, -l_partkey - 1 AS b FROM lineitem), u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    {', '.join(steps)} SELECT node, m AS component FROM l{rounds}"""


_CC = _components_sql()


@register("entity_components", _CC)
def entity_components(spark, d):
    li = M.table(spark, d, "lineitem")
    return G.components(li.select(F.col("l_orderkey").alias("src"), (-F.col("l_partkey") - 1).alias("dst")))


@register("knowledge_clusters", f"WITH sizes AS (SELECT component, count(*) FILTER (node >= 0) AS size FROM ({_CC}) GROUP BY 1) SELECT size, count(*) AS clusters FROM sizes WHERE size >= 3 GROUP BY 1")
def knowledge_clusters(spark, d):
    return C.clusters(M.links(spark, d)).groupBy("size").agg(F.count("*").alias("clusters"))


@register("edge_ends", f"{_AG}, de AS (SELECT DISTINCT src, dst FROM e), n AS (SELECT src AS node FROM de UNION SELECT dst FROM de) SELECT node, node NOT IN (SELECT src FROM de) AS is_root, node NOT IN (SELECT dst FROM de) AS is_leaf FROM n")
def edge_ends(spark, d):
    return G.ends(_agents(spark, d).distinct())


@register("hierarchy_descent", "SELECT r_regionkey AS root, n_nationkey + 100 AS node, 1 AS level FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey, c_custkey + 1000, 2 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT r_regionkey, r_regionkey, 0 FROM region")
def hierarchy_descent(spark, d):
    n = M.table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("child"), F.col("n_regionkey").cast("long").alias("parent"))
    c = M.table(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("child"), (F.col("c_nationkey") + 100).cast("long").alias("parent"))
    return G.descend(n.unionByName(c), M.table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("node")))


def _topics_sql(rounds: int = 80) -> str:
    """Orders that share half of their parts, tied step by step; topics of three."""
    steps = [f"l{k} AS MATERIALIZED (SELECT u.a AS id, least(min(x.m), min(y.m)) AS m FROM u JOIN l{k - 1} x ON x.id = u.b JOIN l{k - 1} y ON y.id = u.a GROUP BY 1)" for k in range(1, rounds + 1)]
    return f"""{_L}, n AS (SELECT memory_id AS id, count(*) AS n FROM links GROUP BY 1),
    p AS (SELECT a.memory_id AS a, b.memory_id AS b, count(*) AS c FROM links a JOIN links b ON a.entity_id = b.entity_id AND a.memory_id < b.memory_id GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE c::DOUBLE / (na.n + nb.n - c) >= 0.5), u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    l0 AS MATERIALIZED (SELECT a AS id, min(least(a, b)) AS m FROM u GROUP BY 1), {', '.join(steps)}, g AS (SELECT m, count(*) AS size FROM l{rounds} GROUP BY 1 HAVING count(*) >= 3),
    w AS (SELECT m, entity_id, count(*) AS c FROM l{rounds} JOIN links ON memory_id = id GROUP BY ALL)
    SELECT g.m AS cluster, size, string_agg(CAST(entity_id AS VARCHAR), ',' ORDER BY c DESC, entity_id) AS label, round(any_value(size)::DOUBLE / (SELECT count(*) FROM n), 8) AS confidence
    FROM g JOIN (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY m ORDER BY c DESC, entity_id) <= 5) t ON t.m = g.m GROUP BY g.m, size"""


@register("topic_map", _topics_sql())
def topic_map(spark, d):
    from recallforge.operators import maintenance

    sets = M.links(spark, d).groupBy(F.col("memory_id").alias("id")).agg(F.collect_list("entity_id").alias("items"))
    t = maintenance.topics(sets, least=0.5)
    return t.select("cluster", "size", F.array_join(F.transform("label", lambda x: x.cast("string")), ",").alias("label"), F.round("confidence", 8).alias("confidence"))


_PM = f"""{_CO.replace('few AS', 'few0 AS').replace('FROM few),', 'FROM few0),')}, n AS (SELECT count(DISTINCT memory_id)::DOUBLE AS n FROM links), ic AS (SELECT entity_id, count(*) AS c FROM links GROUP BY 1),
pc AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS ab FROM links x JOIN links y ON x.memory_id = y.memory_id AND x.entity_id < y.entity_id GROUP BY ALL),
s AS (SELECT a, b, least(10.0, greatest(0.0, ln(ab * n / (ia.c * ib.c)))) / 10 AS strength FROM pc JOIN ic ia ON ia.entity_id = a JOIN ic ib ON ib.entity_id = b, n)"""


@register("pmi_associations", f"{_PM} SELECT a, b, round(strength, 6) AS strength FROM s WHERE strength > 0.01")
def pmi_associations(spark, d):
    return C.associations(M.links(spark, d), "memory_id", "entity_id").select("a", "b", F.round("strength", 6).alias("strength"))


@register("query_expansion_dictionary", f"{_PM}, r AS (SELECT a AS entity, b AS partner, round(strength, 9) AS strength FROM s WHERE strength >= 0.3 UNION ALL SELECT b, a, round(strength, 9) FROM s WHERE strength >= 0.3) SELECT entity, partner, row_number() OVER (PARTITION BY entity ORDER BY strength DESC, partner) AS rank FROM r QUALIFY rank <= 3")
def query_expansion_dictionary(spark, d):
    a = C.associations(M.links(spark, d), "memory_id", "entity_id").withColumn("strength", F.round("strength", 9))
    both = a.where("strength >= 0.3").select(F.col("a").alias("entity"), F.col("b").alias("partner"), "strength")
    both = both.unionByName(both.select(F.col("partner").alias("entity"), F.col("entity").alias("partner"), "strength"))
    return R.ranked(both, "partner", "strength", ["entity"]).where("rank <= 3").select("entity", "partner", F.col("rank").cast("long").alias("rank"))


@register(
    "pmi_edge_weights",
    f"""{_PM}, w0 AS (SELECT a, b, greatest(0.0, log2(ab * n / (ia.c * ib.c))) AS w FROM pc JOIN ic ia ON ia.entity_id = a JOIN ic ib ON ib.entity_id = b, n), w1 AS (SELECT a, b, w / (SELECT greatest(0.01, max(w)) FROM w0 WHERE w > 0.01) AS w FROM w0 WHERE w > 0.01),
    o AS (SELECT src, dst, 1.0::DOUBLE AS weight FROM co WHERE count >= 2), bl AS (SELECT o.src, o.dst, CASE WHEN w IS NULL THEN weight ELSE 0.3 * weight + 0.7 * w END AS weight FROM o LEFT JOIN w1 ON a = src AND b = dst),
    nw AS (SELECT a AS src, b AS dst, w AS weight FROM w1 WHERE w > 0.9 AND NOT EXISTS (SELECT 1 FROM o WHERE src = a AND dst = b)) SELECT src, dst, round(weight, 6) AS weight FROM (SELECT * FROM bl UNION ALL SELECT * FROM nw)""",
)
def pmi_edge_weights(spark, d):
    links = M.links(spark, d)
    old = G.cooccurrence(links).where("count >= 2").select("src", "dst", F.lit(1.0).alias("weight"))
    return C.edge_weights(links, "memory_id", "entity_id", old).select("src", "dst", F.round("weight", 6).alias("weight"))


@register("importance_drift", f"WITH {M.ACCESSES_SQL}, c AS (SELECT memory_id, count(*) FILTER (age < 1296000) AS recent, count(*) FILTER (age >= 1296000 AND age < 2592000) AS older FROM (SELECT memory_id, (epoch_us(TIMESTAMP '{M.NOW}') - epoch_us(accessed_at)) / 1e6 AS age FROM accesses) GROUP BY 1) SELECT memory_id, recent, older, CASE WHEN recent > 1.5 * older THEN 0.5 WHEN older > 1.5 * recent THEN -0.5 ELSE 0.0 END::DOUBLE AS delta FROM c")
def importance_drift(spark, d):
    from recallforge.functions import scores as S

    a = M.accesses(spark, d).withColumn("age", S.seconds_between(M.now(), F.col("accessed_at")))
    return C.drift(a, "memory_id", "age")


def _signals(spark, d):
    return M.table(spark, d, "events").groupBy(F.col("user_id").alias("memory_id")).agg(F.count("*").cast("double").alias("accesses"), F.max("value").alias("importance"))


_SG = "sg AS (SELECT user_id AS memory_id, count(*)::DOUBLE AS accesses, max(value) AS importance FROM events GROUP BY 1), mm AS (SELECT min(accesses) AS la, max(accesses) AS ha, min(importance) AS li, max(importance) AS hi FROM sg)"


@register("dream_rehearsal", f"WITH {_SG}, sc AS (SELECT memory_id, 0.6 * (accesses - la) / (ha - la) + 0.4 * (importance - li) / (hi - li) AS score FROM sg, mm) SELECT memory_id, round(score, 6) AS score FROM sc QUALIFY row_number() OVER (ORDER BY sc.score DESC, memory_id) <= greatest(1, (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM sg))")
def dream_rehearsal(spark, d):
    return C.rehearsal(_signals(spark, d), "memory_id", {"accesses": 0.6, "importance": 0.4}).select("memory_id", F.round("score", 6).alias("score"))


@register("dream_access_injection", f"WITH {_SG}, s AS (SELECT memory_id, CAST(1 + floor(4 * (accesses - la) / (ha - la)) AS BIGINT) AS n FROM sg, mm) SELECT memory_id, CAST(unnest(range(1, n + 1)) AS BIGINT) AS n FROM s")
def dream_access_injection(spark, d):
    return C.injected(_signals(spark, d), "memory_id", "accesses", M.now()).select("memory_id", F.col("n").cast("long").alias("n"))


@register("decay_superseded", f"WITH {M.STATES_SQL}, m AS (SELECT DISTINCT entity_id FROM states WHERE state_value >= 12) SELECT user_id, CASE WHEN user_id IN (SELECT entity_id FROM m) THEN greatest(0.0, v - 0.05) ELSE v END AS importance FROM (SELECT user_id, max(value) AS v FROM events GROUP BY 1)")
def decay_superseded(spark, d):
    m = M.table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("importance"))
    marked = M.states(spark, d).where("state_value >= 12").select(F.col("entity_id").alias("user_id"))
    return C.forget(m, marked, "user_id", 0.05)
