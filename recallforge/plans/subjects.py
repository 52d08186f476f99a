"""Queries: subjects of memories, their nodes and edges; maintenance.

Orders stand for memories: a third have explicit subjects, a third a name, a third what
a classifier says."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallforge import model as M
from recallforge.catalog import register
from recallforge.operators import maintenance as X, subjects as S
from recallforge.shared import dealt

_EXPLICIT = "array<struct<id:string,type:string,primary:boolean>>"
_ROLES = "array<struct<role:string,surface:string,canonical:string,slot:string>>"


def _memories(spark, d):
    k, m = F.col("o_custkey"), F.pmod("o_custkey", F.lit(4))
    cust = F.concat(F.lit("Customer "), k.cast("string"))
    first = F.struct(cust.alias("id"), F.lit("client").alias("type"), (F.col("o_orderkey") % 2 == 0).alias("primary"))
    second = F.struct(F.concat(F.lit("status:"), F.lower("o_orderstatus")).alias("id"), F.lit("status").alias("type"), (F.col("o_orderkey") % 10 == 0).alias("primary"))
    span = F.struct(F.when(F.col("o_orderkey") % 3 == 0, "primary").otherwise("casual").alias("role"), cust.alias("surface"), F.lower(cust).alias("canonical"), F.lit("client").alias("slot"))
    parent = F.struct(F.lit("doc:main").alias("id"), F.lit("doc").alias("type"), F.lit(True).alias("primary"), F.lit("caller").alias("source"), F.lit(1.0).alias("confidence"), F.array().cast("array<string>").alias("aliases"))
    return M.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("memory_id"), F.when(m == 0, F.array(first, second)).otherwise(F.array().cast(_EXPLICIT)).cast(_EXPLICIT).alias("explicit"), F.when(m == 1, cust).alias("legacy"),
        F.when(m.isin(0, 2), F.array(span)).otherwise(F.array().cast(_ROLES)).cast(_ROLES).alias("roles"), (F.pmod(F.col("o_orderkey"), F.lit(10)) / 10).alias("label_confidence"),
        F.when(m == 3, parent).alias("parent"), F.get(F.array(*map(F.lit, ("declaration", "retirement", "none"))), F.pmod(F.col("o_orderkey"), F.lit(3)).cast("int")).alias("change"),
        (F.pmod(F.col("o_orderkey"), F.lit(7)) / 7).alias("change_confidence"), F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")).alias("content"),
    )


_RES = """o AS (SELECT o_orderkey AS k, o_custkey AS c, o_custkey % 4 AS m, o_orderkey % 2 = 0 AS p1, o_orderkey % 10 = 0 AS p2, (o_orderkey % 10) / 10.0::DOUBLE AS sure, lower(o_orderstatus) AS st, o_orderkey % 3 = 0 AS pr, o_orderpriority AS txt FROM orders),
res AS (SELECT k, 'client:customer-' || c AS id, p1 OR NOT p2 AS prim, 'caller' AS source, 1.0::DOUBLE AS conf, 0 AS n, 2 AS of FROM o WHERE m = 0 AND NOT (p1 AND p2)
UNION ALL SELECT k, 'status:' || st, p2, 'caller', 1.0, 1, 2 FROM o WHERE m = 0 AND NOT (p1 AND p2)
UNION ALL SELECT k, 'subject:customer-' || c, true, 'caller', 0.6, 0, 1 FROM o WHERE m = 1
UNION ALL SELECT k, 'client:customer-' || c, true, 'slm_role', least(0.6, sure), 0, 1 FROM o WHERE m = 2 AND sure >= 0.3 AND pr
UNION ALL SELECT k, 'doc:main', true, 'document', 0.9, 0, 1 FROM o WHERE m = 3)"""


@register("subject_resolution", f"WITH {_RES} SELECT k AS memory_id, id AS subject, prim AS is_primary, source, conf AS confidence FROM res")
def subject_resolution(spark, d):
    r = S.resolve(_memories(spark, d)).select("memory_id", F.explode("subjects").alias("s"))
    return r.select("memory_id", F.col("s.id").alias("subject"), F.col("s.primary").alias("is_primary"), "s.source", "s.confidence")


@register("subject_conflicts", "SELECT o_orderkey AS memory_id FROM orders WHERE o_custkey % 4 = 0 AND o_orderkey % 10 = 0")
def subject_conflicts(spark, d):
    return S.resolve(_memories(spark, d)).where("conflict").select("memory_id")


@register("atomic_nodes", "SELECT 'l1:' || o_orderkey AS node_id, o_orderkey AS memory_id, 'atomic' AS node_type FROM orders")
def atomic_nodes(spark, d):
    return S.atomic_nodes(M.table(spark, d, "orders").select(F.col("o_orderkey").alias("memory_id")))


_LIVE = "k % 3 < 2 AND (k % 7) / 7.0 >= 0.3"
_L2 = f"""l2 AS (SELECT 'l2:' || k || ':' || r.n AS node_id, k AS memory_id, id AS entity_id, CASE WHEN split_part(id, ':', 1) = 'client' THEN 'client' ELSE 'status' END AS state_key,
CASE WHEN split_part(id, ':', 1) = 'client' THEN 'customer ' || c ELSE txt END AS state_value, CASE WHEN prim THEN 'primary_subject' ELSE 'co_subject' END AS subject_role
FROM res r JOIN o USING (k) WHERE {_LIVE} AND (split_part(id, ':', 1) = 'client' OR (source = 'caller' AND of = 1)))"""


@register("subject_state_nodes", f"WITH {_RES}, {_L2} SELECT * FROM l2")
def subject_state_nodes(spark, d):
    return S.state_nodes(S.resolve(_memories(spark, d))).drop("node_type", "source")


@register("derived_edges", f"WITH {_RES}, {_L2} SELECT node_id AS source_id, 'l1:' || memory_id AS target_id, 'derived_from' AS edge_type FROM l2")
def derived_edges(spark, d):
    return S.derived_edges(S.state_nodes(S.resolve(_memories(spark, d))))


@register(
    "mentions_edges",
    f"""WITH {_RES}, e AS (SELECT c_custkey AS entity_id, 'CLIENT:Customer-' || c_custkey AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 1000000 + c_custkey, 'customer ' || c_custkey FROM customer)
    SELECT 'l1:' || k AS source_id, min(e1.entity_id) AS target_id, CASE WHEN bool_or(prim) THEN 'primary_subject' ELSE 'co_subject' END AS role FROM (SELECT r.k, r.id, r.prim, o.c, r.source, o.m FROM res r JOIN o USING (k)) x JOIN e e1 ON e1.entity_id = CASE WHEN split_part(id, ':', 1) = 'client' AND c % 2 = 0 THEN c WHEN split_part(id, ':', 1) IN ('client', 'subject') THEN 1000000 + c END GROUP BY k, id""",
)
def mentions_edges(spark, d):
    c = M.table(spark, d, "customer").select("c_custkey")
    a = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("entity_id"), F.concat(F.lit("CLIENT:Customer-"), F.col("c_custkey").cast("string")).alias("name"))
    b = c.select((F.col("c_custkey") + 1_000_000).alias("entity_id"), F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("name"))
    return S.mention_edges(S.resolve(_memories(spark, d)), a.unionByName(b)).drop("edge_type")


@register("detected_state_nodes", "SELECT 'l2:' || event_id AS node_id, 'svc' || user_id AS entity_id, 'mode' AS state_key, event_type AS state_value FROM events WHERE event_id % 3 = 0 AND user_id % 2 = 0")
def detected_state_nodes(spark, d):
    u = F.col("user_id")
    name = F.concat(F.lit("svc"), u.cast("string"))
    e = M.table(spark, d, "events").select(F.col("event_id").alias("memory_id"), F.when(F.col("event_id") % 3 == 0, F.concat(name, F.lit(": mode = "), F.col("event_type"))).otherwise(F.lit("nothing")).alias("content"), F.when(u % 2 == 0, F.array(F.upper(name))).otherwise(F.array(F.lit("other"))).alias("entities"), F.lit(0.0).alias("signal"))
    return S.detected_nodes(e).drop("memory_id")


@register("domain_auto_tag", "SELECT doc_id, CASE WHEN doc_id % 5 < 4 AND (doc_id % 10) / 10.0 >= 0.3 AND 't' || doc_id % 5 NOT IN (lang, source) THEN lang || ',' || source || ',t' || doc_id % 5 ELSE lang || ',' || source END AS domains FROM documents")
def domain_auto_tag(spark, d):
    topic = F.when(F.col("memory_id") % 5 < 4, F.concat(F.lit("t"), (F.col("memory_id") % 5).cast("string")))
    return M.memories(spark, d).select(F.col("memory_id").alias("doc_id"), F.array_join(S.tagged_domains(F.col("domains"), topic, (F.col("memory_id") % 10) / 10), ",").alias("domains"))


@register("entity_merge", "WITH a AS (SELECT l_orderkey AS memory_id, upper(l_returnflag) AS name FROM lineitem WHERE l_linenumber < 3), f AS (SELECT l_orderkey AS memory_id, lower(l_returnflag) || CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE 'x' END AS name FROM lineitem) SELECT DISTINCT memory_id, name FROM a UNION SELECT memory_id, name FROM f WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.memory_id = f.memory_id AND lower(a.name) = lower(f.name))")
def entity_merge(spark, d):
    li = M.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "memory_id")
    a = li.where("l_linenumber < 3").select("memory_id", F.upper("l_returnflag").alias("name"))
    f = li.select("memory_id", F.concat(F.lower("l_returnflag"), F.when(F.col("l_suppkey") % 2 == 0, "").otherwise("x")).alias("name"))
    return S.merged_entities(a, f)


@register(
    "contradiction_candidates",
    f"""WITH {M.LINKS_SQL}, w AS (SELECT o_orderkey AS memory_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'), s AS (SELECT memory_id, memory_id + i AS other_id, 1.0 / i AS score FROM w, (SELECT unnest([1, 2, 3]) AS i) WHERE memory_id + i IN (SELECT o_orderkey FROM orders)),
    sh AS (SELECT DISTINCT a.memory_id, b.memory_id AS c FROM links a JOIN w USING (memory_id) JOIN links b ON b.entity_id = a.entity_id AND b.memory_id <> a.memory_id),
    u AS (SELECT memory_id, other_id AS c, 0 AS p, -score AS s FROM s UNION ALL SELECT memory_id, c, 1, 0 FROM sh WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.memory_id = sh.memory_id AND s.other_id = sh.c)),
    h AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY p, s, c) <= 5)
    SELECT h.memory_id, h.c AS candidate_id, CASE WHEN p = 0 THEN 'similar' ELSE 'linked' END AS how FROM h JOIN orders a ON a.o_orderkey = h.memory_id JOIN orders b ON b.o_orderkey = h.c WHERE a.o_orderstatus = b.o_orderstatus OR b.o_orderpriority = '5-LOW'""",
)
def contradiction_candidates(spark, d):
    o = M.table(spark, d, "orders")
    new = o.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.col("o_orderkey").alias("memory_id"))
    near = new.select("memory_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("i")).select("memory_id", (F.col("memory_id") + F.col("i")).alias("other_id"), (1 / F.col("i")).alias("score"))
    near = near.join(o.select(F.col("o_orderkey").alias("other_id")), "other_id", "left_semi").select("memory_id", "other_id", "score")
    m = o.select(F.col("o_orderkey").alias("memory_id"), F.when(F.col("o_orderpriority") == "5-LOW", F.array().cast("array<string>")).otherwise(F.array("o_orderstatus")).alias("domains"))
    return S.contradiction_candidates(new, near, M.links(spark, d), m, tasks=dealt(M.table(spark, d, "lineitem").count()))


# --- maintenance ------------------------------------------------------------------


@register("similar_sets", "WITH s AS (SELECT l_orderkey AS id, l_suppkey AS x FROM lineitem GROUP BY ALL), n AS (SELECT id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.id < b.id GROUP BY ALL) SELECT a, b, round(c::DOUBLE / (na.n + nb.n - c), 6) AS jaccard FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE c::DOUBLE / (na.n + nb.n - c) >= 0.5")
def similar_sets(spark, d):
    s = M.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("items"))
    return X.similar_sets(s, 0.5).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@register("pattern_kinds", "SELECT o_custkey, round(least(1.0, count(*) / 5.0) * ((o_custkey % 10) / 10.0), 3)::DOUBLE AS stability, CASE WHEN least(1.0, count(*) / 5.0) * ((o_custkey % 10) / 10.0) >= 0.7 THEN 'strategic_insight' ELSE 'recurring_pattern' END AS kind FROM orders GROUP BY 1")
def pattern_kinds(spark, d):
    g = M.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return g.select("o_custkey", X.pattern_kind(F.col("n"), (F.col("o_custkey") % 10) / 10).alias("k")).select("o_custkey", "k.*")


def _episodes(spark, d):
    c = M.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("episode_id"), F.when(F.col("c_nationkey") % 2 == 0, "closed").otherwise("open").alias("status"), F.when(F.col("c_custkey") % 3 == 0, F.lit(True)).alias("summarized"))


@register("closed_unsummarised", "SELECT c_custkey AS episode_id FROM customer WHERE c_nationkey % 2 = 0 AND c_custkey % 3 <> 0")
def closed_unsummarised(spark, d):
    return X.closed_unsummarised(_episodes(spark, d)).select("episode_id")


@register("episode_summaries", "SELECT o_custkey AS episode_id, count(*) AS members, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS domains, string_agg('Order ' || o_orderkey || '.', ' ' ORDER BY o_orderdate, o_orderkey)[1:1000] AS content FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 2 = 0 AND c_custkey % 3 <> 0 GROUP BY 1")
def episode_summaries(spark, d):
    m = M.table(spark, d, "orders").select(F.col("o_custkey").alias("episode_id"), F.col("o_orderkey").alias("memory_id"), F.col("o_orderdate").alias("at"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(". More.")).alias("content"), F.array("o_orderstatus").alias("domains"))
    return X.episode_summaries(_episodes(spark, d), m).withColumn("domains", F.array_join("domains", ","))


@register("episode_profiles", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) || ' | domains: ' || string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) || CASE WHEN o_custkey % 2 = 0 THEN ' | anchors: A-' || o_custkey ELSE '' END AS profile FROM orders GROUP BY 1")
def episode_profiles(spark, d):
    g = M.table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("e"), F.collect_set("o_orderstatus").alias("s"))
    names = X.added_names(F.slice("e", 1, 2), F.col("e"))
    return g.select("o_custkey", X.profile_text(names, F.col("s"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("A-"), F.col("o_custkey").cast("string")))).alias("profile"))


@register("refreshed_abstracts", f"SELECT event_id, ts <= TIMESTAMP '2024-01-20' AS refreshed, CASE WHEN ts <= TIMESTAMP '2024-01-20' THEN TIMESTAMP '2024-01-20' + INTERVAL 7 DAY ELSE ts END AS refresh_due FROM events WHERE ts < TIMESTAMP '{M.NOW}'")
def refreshed_abstracts(spark, d):
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    return X.refreshed(M.table(spark, d, "events").select("event_id", F.col("ts").alias("refresh_due")), now).select("event_id", "refreshed", "refresh_due")


@register("stored_abstracts", "SELECT 'node:insight:' || o_custkey AS source_id, o_orderkey AS target_id, 'derived_from' AS edge_type FROM orders")
def stored_abstracts(spark, d):
    found = M.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.collect_list("o_orderkey").alias("sources"), F.lit("text").alias("content"), F.array(F.lit("d")).alias("domains"), F.lit(0.5).alias("confidence"))
    return X.abstracts(found, "insight", M.now())[2]


_SIG = f"""{M.ACCESSES_SQL}, a AS (SELECT memory_id, count(*)::DOUBLE AS n, min(age) / 86400 AS st FROM (SELECT memory_id, (epoch_us(TIMESTAMP '{M.NOW}') - epoch_us(accessed_at)) / 1e6 AS age FROM accesses) GROUP BY 1 HAVING count(*) >= 3),
c AS (SELECT o_custkey AS memory_id, avg(coalesce(o_totalprice / 500000, 0)) AS ce FROM orders GROUP BY 1), sig AS (SELECT c_custkey AS memory_id, coalesce(ce, 0) AS centrality, st AS staleness, c_acctbal AS importance, n AS accesses FROM customer JOIN a ON a.memory_id = c_custkey LEFT JOIN c ON c.memory_id = c_custkey)"""


def _signals(spark, d):
    m = M.table(spark, d, "customer").select(F.col("c_custkey").alias("memory_id"), F.col("c_acctbal").alias("importance"))
    o = M.table(spark, d, "orders")
    links = o.select(F.col("o_custkey").alias("memory_id"), F.col("o_orderkey").alias("entity_id"))
    ranks = o.select(F.col("o_orderkey").alias("node"), (F.col("o_totalprice") / 500000).alias("rank"))
    return X.rehearsal_signals(m, M.accesses(spark, d), links, ranks, M.now())


@register("dream_signals", f"WITH {_SIG} SELECT memory_id, round(centrality, 6) AS centrality, round(staleness, 6) AS staleness, importance, accesses, round(staleness, 6) AS recency FROM sig")
def dream_signals(spark, d):
    return _signals(spark, d).select("memory_id", *[F.round(c, 6).alias(c) for c in ("centrality", "staleness")], "importance", "accesses", F.round("recency", 6).alias("recency"))


@register("dream_selection", f"WITH {_SIG}, m AS (SELECT min(centrality) AS a, max(centrality) AS b, min(staleness) AS c, max(staleness) AS d, min(importance) AS e, max(importance) AS f, min(accesses) AS g, max(accesses) AS h, count(*) AS n FROM sig), s AS (SELECT memory_id, 0.4 * (centrality - a) / (b - a) + 0.35 * (staleness - c) / (d - c) + 0.2 * (importance - e) / (f - e) + 0.05 * (accesses - g) / (h - g) AS s FROM sig, m) SELECT memory_id, round(s, 6) AS score FROM s QUALIFY row_number() OVER (ORDER BY s DESC, memory_id) <= greatest(1, (SELECT CAST(floor(n * 0.1) AS BIGINT) FROM m))")
def dream_selection(spark, d):
    return X.rehearse(_signals(spark, d)).select("memory_id", F.round("score", 6).alias("score"))


@register("decay_conflicting", "WITH h AS (SELECT o_custkey AS memory_id, count(*) AS n FROM orders WHERE o_orderstatus = 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') GROUP BY 1) SELECT c_custkey AS memory_id, round(greatest(0.0, c_acctbal - 0.025 * coalesce(n, 0)), 6)::DOUBLE AS importance FROM customer LEFT JOIN h ON h.memory_id = c_custkey")
def decay_conflicting(spark, d):
    m = M.table(spark, d, "customer").select(F.col("c_custkey").alias("memory_id"), F.col("c_acctbal").alias("importance"))
    nodes = M.table(spark, d, "orders").select(F.col("o_orderkey").alias("node_id"), F.col("o_custkey").alias("memory_id"), (F.col("o_orderstatus") == "P").alias("is_current"))
    hot = M.table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("source_id"))
    return X.forget_conflicting(m, nodes, hot).select("memory_id", F.round("importance", 6).alias("importance"))


@register("importance_after_drift", f"WITH {M.ACCESSES_SQL}, c AS (SELECT memory_id, count(*) AS n, count(*) FILTER (age < 604800) AS r, count(*) FILTER (age >= 604800 AND age < 1209600) AS o FROM (SELECT memory_id, (epoch_us(TIMESTAMP '{M.NOW}') - epoch_us(accessed_at)) / 1e6 AS age FROM accesses) GROUP BY 1) SELECT c_custkey AS memory_id, round(greatest(0.0, least(10.0, c_custkey % 11 + CASE WHEN n < 2 OR n IS NULL THEN 0 WHEN r > 1.5 * o THEN 0.1 WHEN o > 1.5 * r THEN -0.1 ELSE 0 END)), 6)::DOUBLE AS importance FROM customer LEFT JOIN c ON c.memory_id = c_custkey")
def importance_after_drift(spark, d):
    m = M.table(spark, d, "customer").select(F.col("c_custkey").alias("memory_id"), (F.col("c_custkey") % 11).cast("double").alias("importance"))
    return X.drifted(m, M.accesses(spark, d), M.now()).select("memory_id", F.round("importance", 6).alias("importance"))


@register("maintenance_cycle", None)  # rehearsal hangs on ranks; each step has a twin of its own
def maintenance_cycle(spark, d):
    o = M.table(spark, d, "orders")
    m = M.table(spark, d, "customer").select(F.col("c_custkey").alias("memory_id"), (F.col("c_custkey") % 11).cast("double").alias("importance"))
    links = o.select(F.col("o_custkey").alias("memory_id"), F.pmod("o_orderkey", F.lit(500)).alias("entity_id")).distinct()
    searches = M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("search_id"), F.pmod("l_partkey", F.lit(200)).alias("memory_id"))
    nodes = o.select(F.col("o_orderkey").alias("node_id"), F.col("o_custkey").alias("memory_id"), (F.col("o_orderstatus") == "P").alias("is_current"))
    edges = o.select(F.pmod("o_orderkey", F.lit(500)).alias("src"), F.pmod("o_custkey", F.lit(500)).alias("dst")).where("src <> dst").distinct()
    hot = M.table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("source_id"))
    done = X.cycle(m, M.accesses(spark, d), links, searches, nodes, hot, edges, M.now())
    parts = [df.agg(F.lit(n).alias("step"), F.count("*").alias("n")) for n, df in done.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("due_tasks", f"SELECT user_id || event_type AS name FROM (SELECT user_id, event_type, max(ts) AS last_run FROM events GROUP BY ALL) WHERE user_id % 3 <> 0 AND (epoch_us(TIMESTAMP '{M.NOW}') - epoch_us(last_run)) / 1e6 >= 60 * 60 * (user_id % 100)")
def due_tasks(spark, d):
    t = M.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_run"))
    t = t.select(F.concat(F.col("user_id").cast("string"), "event_type").alias("name"), "last_run", (60 * (F.col("user_id") % 100)).alias("every_minutes"), (F.col("user_id") % 3 == 0).alias("running"))
    return X.due(t, M.now()).select("name")


@register("ring_buffer", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS slot FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20)")
def ring_buffer(spark, d):
    e = M.table(spark, d, "events").select("user_id", "event_id")
    return X.ring(e, "user_id", "event_id", 20).withColumn("slot", F.col("slot").cast("long"))


@register("topic_clusters", None)  # components of similar sets; the tests hold it against brute force
def topic_clusters(spark, d):
    s = M.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("items"))
    return X.overlap_clusters(s, least=0.6, listed=False).select("cluster", "size", F.size("shared").cast("long").alias("shared"))
