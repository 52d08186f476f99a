"""Queries: look-ups, small tables, documents and approvals, graph upkeep, chunks,
messages between agents, further metrics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from recallforge import model as M
from recallforge.catalog import register
from recallforge.operators import audit as A, grammar, graph as G, metrics as X, predicates as P, recall as R, retrieval, scans as S
from recallforge.shared import dealt
from recallforge.sources import chunkers as H

_NODES = "nodes AS (SELECT event_id AS node_id, user_id AS memory_id, (['atomic', 'entity_state', 'episode', 'abstract'])[CAST(event_id % 4 AS INT) + 1] AS node_type, (['pattern', 'summary', 'insight'])[CAST(user_id % 3 AS INT) + 1] AS kind, ts FROM events)"


def _nodes(spark, d):
    pick = lambda vs, c: F.get(F.array(*map(F.lit, vs)), F.pmod(c, F.lit(len(vs))).cast("int"))
    kind = pick(("pattern", "summary", "insight"), F.col("user_id"))
    return M.table(spark, d, "events").select(F.col("event_id").alias("node_id"), F.col("user_id").alias("memory_id"), pick(("atomic", "entity_state", "episode", "abstract"), F.col("event_id")).alias("node_type"), F.to_json(F.struct(kind.alias("abstract_type"))).alias("metadata"), F.col("ts").alias("created_at"))


def _edges(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "conflicts_with").when(F.col("l_returnflag") == "R", "supersedes").otherwise("derived_from")
    return M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), kind.alias("edge_type"), F.col("l_shipdate").alias("created_at"))


@register("content_hash_lookup", "SELECT min(doc_id) AS doc_id FROM documents WHERE sha256(text) = (SELECT sha256(text) FROM documents WHERE doc_id = 17)")
def content_hash_lookup(spark, d):
    docs = M.table(spark, d, "documents").select("doc_id", "text")
    digest = docs.where("doc_id = 17").select(F.sha2("text", 256)).first()[0]
    return S.by_hash(docs, "text", digest, "doc_id").select("doc_id")


@register("edges_of_source", "SELECT l_partkey AS target_id, l_shipdate AS created_at FROM lineitem WHERE l_orderkey = 77 AND l_returnflag = 'R'")
def edges_of_source(spark, d):
    return S.edges_of(_edges(spark, d), source=77, kinds=["supersedes"]).select("target_id", "created_at")


@register("edges_by_types", "SELECT CASE l_returnflag WHEN 'A' THEN 'conflicts_with' ELSE 'supersedes' END AS edge_type, l_orderkey AS source_id, l_partkey AS target_id FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def edges_by_types(spark, d):
    return S.edges_of(_edges(spark, d), kinds=["conflicts_with", "supersedes"]).select("edge_type", "source_id", "target_id")


@register("nodes_by_type", f"WITH {_NODES} SELECT node_id FROM nodes WHERE node_type = 'episode'")
def nodes_by_type(spark, d):
    return S.nodes_of(_nodes(spark, d), kind="episode").select("node_id")


@register("abstracts_by_kind", f"WITH {_NODES} SELECT node_id FROM nodes WHERE node_type = 'abstract' AND kind = 'pattern'")
def abstracts_by_kind(spark, d):
    return S.nodes_of(_nodes(spark, d), abstract="pattern").select("node_id")


@register("nodes_for_memories", f"WITH {_NODES} SELECT node_id, memory_id FROM nodes WHERE memory_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def nodes_for_memories(spark, d):
    ids = M.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("memory_id"))
    return S.nodes_of(_nodes(spark, d), memories=ids).select("node_id", "memory_id")


@register("snapshots_by_domain", "SELECT DISTINCT user_id AS agent FROM events WHERE event_type = 'signup'")
def snapshots_by_domain(spark, d):
    e = M.table(spark, d, "events").select(F.col("user_id").alias("agent"), F.lit(0).alias("run"), F.col("ts").alias("at"), F.col("event_type").alias("domain"), F.col("event_id").alias("memory_id"))
    return A.snapshots(e, most=10_000).where(F.array_contains("domains", "signup")).select("agent")


@register("snapshot_chain", "WITH r AS (SELECT user_id, event_id % 3 AS run, ts, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts DESC, event_id) AS k FROM events), g AS (SELECT user_id, run, max(ts) AS mx, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS domains, count(*) AS entries FROM r WHERE k <= 5 GROUP BY ALL) SELECT user_id || '#' || run AS snapshot_id, mx AS taken, domains, entries, lag(user_id || '#' || run) OVER (PARTITION BY user_id ORDER BY run) AS supersedes FROM g")
def snapshot_chain(spark, d):
    e = M.table(spark, d, "events").select(F.col("user_id").alias("agent"), (F.col("event_id") % 3).alias("run"), F.col("ts").alias("at"), F.col("event_type").alias("domain"), F.col("event_id").alias("memory_id"))
    return A.snapshots(e, most=5).select("snapshot_id", F.col("at").alias("taken"), F.array_join("domains", ",").alias("domains"), "entries", "supersedes")


def _documents(spark, d):
    o = M.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("project_id"), F.col("o_orderpriority").alias("doc_type"), F.col("o_orderdate").alias("created_at"), F.pmod("o_orderkey", F.lit(100)).alias("parent_id"), F.col("o_orderstatus").alias("agent"))


@register("document_filter", "SELECT o_orderkey AS doc_id FROM orders WHERE o_custkey = 33 AND o_orderpriority = '5-LOW' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def document_filter(spark, d):
    return S.list_documents(_documents(spark, d), project=33, kind="5-LOW").select("doc_id")


@register("document_children", "SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey % 100 = 42 ORDER BY o_orderdate, o_orderkey LIMIT 200")
def document_children(spark, d):
    return S.children(_documents(spark, d), 42).select("doc_id")


@register("cached_labels", "SELECT 'd' || n_regionkey AS domain, string_agg(n_name, ',' ORDER BY n_nationkey) AS labels FROM nation WHERE n_regionkey IN (1, 3) GROUP BY 1")
def cached_labels(spark, d):
    n = M.table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    store = n.select(F.concat(F.lit("entity_labels:d"), F.col("n_regionkey").cast("string")).alias("key"), F.to_json(F.transform("l", lambda x: x["n_name"])).alias("value"))
    return S.cached_labels(store, ["d1", "d3", "none"]).select("domain", F.array_join("labels", ",").alias("labels"))


@register("key_value_delete", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) WHERE NOT (user_id = 3 AND event_type = 'click')")
def key_value_delete(spark, d):
    kv = M.table(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key")).distinct()
    return S.without(kv, ["3:click"]).agg(F.count("*").alias("n"))


@register("memory_slots", "SELECT o_orderkey AS memory_id, 'new' AS slot FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, s FROM orders, (VALUES ('a'), ('b')) v(s) WHERE o_orderstatus <> 'P'")
def memory_slots(spark, d):
    o = M.table(spark, d, "orders").select(F.col("o_orderkey").alias("memory_id"), "o_orderstatus")
    old = o.select("memory_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("slot"))
    return S.replace_all(old, o.where("o_orderstatus = 'P'").select("memory_id", F.lit("new").alias("slot")), "memory_id")


@register("memory_entity_names", "SELECT DISTINCT l_orderkey AS memory_id, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey")
def memory_entity_names(spark, d):
    p = M.table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    return M.links(spark, d).join(p, "entity_id").select("memory_id", "name").distinct()


@register("episode_membership", "SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def episode_membership(spark, d):
    c = M.table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("user_id"))
    return S.semi(M.table(spark, d, "events").select("event_id", "user_id"), c, "user_id").select("event_id")


@register("related_episodes", "WITH t AS (SELECT DISTINCT o_custkey AS ep, l_suppkey % 40 AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45), s AS (SELECT c_custkey AS seed, c_custkey AS ep FROM customer WHERE c_nationkey = 3) SELECT DISTINCT seed, b.ep AS episode_id FROM s JOIN t a ON a.ep = s.ep JOIN t b ON b.e = a.e AND b.ep <> a.ep WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.seed = s.seed AND x.ep = b.ep)")
def related_episodes(spark, d):
    li = M.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") % 40).alias("entity"))
    topics = M.table(spark, d, "orders").join(li, "o_orderkey").select(F.col("o_custkey").alias("episode_id"), "entity").distinct()
    seeds = M.table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("seed"), F.col("c_custkey").alias("episode_id"))
    return R.related_episodes(topics, seeds)


@register("subject_stats", f"WITH {M.STATES_SQL}, s AS (SELECT *, lead(node_id) OVER (PARTITION BY entity_id, state_key ORDER BY created_at, node_id) IS NOT NULL AS old FROM states) SELECT entity_id, count(*) AS states, count(*) FILTER (old) AS superseded FROM s WHERE entity_id IN (1, 2, 3, 5, 8, 13) GROUP BY 1")
def subject_stats(spark, d):
    from recallforge.operators import state

    s = state.intervals(M.states(spark, d).where(F.col("entity_id").isin(1, 2, 3, 5, 8, 13)))
    return s.groupBy("entity_id").agg(F.count("*").alias("states"), F.count_if(~F.col("is_current")).alias("superseded"))


@register("recent_searches", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 100")
def recent_searches(spark, d):
    e = M.table(spark, d, "events").where(F.col("ts") > F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id", "ts")
    return S.newest(e, "ts", "event_id", 100)


@register("json_arrays", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def json_arrays(spark, d):
    o = M.table(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(F.collect_list("o_orderpriority")).alias("j"))
    return o.select("o_custkey", F.size(S.json_array("j")).cast("long").alias("n"))


@register("row_invariants", "SELECT rule, count(*) AS broken, min(k) AS first FROM (SELECT o_orderkey AS k, 'T3_too_short' AS rule FROM orders WHERE o_totalprice < 20000 UNION ALL SELECT o_orderkey, 'I4_topic_unknown' FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') UNION ALL SELECT o_orderkey, 'I2_admission_none' FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def row_invariants(spark, d):
    rules = {"T3_too_short": F.col("o_totalprice") >= 20000, "I4_topic_unknown": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "I2_admission_none": F.nullif("o_orderstatus", F.lit("P")).isNotNull()}
    return S.invariants(M.table(spark, d, "orders"), rules, "o_orderkey").select("rule", "broken", F.get("sample", F.lit(0)).alias("first"))


@register("access_log_rows", f"SELECT o_orderkey AS memory_id, TIMESTAMP '{M.NOW}' AS accessed_at, 'searcher' AS agent FROM orders WHERE o_orderpriority = '1-URGENT'")
def access_log_rows(spark, d):
    hits = M.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("memory_id"))
    return S.access_log(hits, "searcher", M.now())


@register("content_range_upsert", "SELECT o_orderkey AS memory_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS range_start FROM orders")
def content_range_upsert(spark, d):
    at = F.col("o_orderdate").cast("timestamp_ntz")
    day = F.expr("interval 1 day")
    o = M.table(spark, d, "orders")
    old = o.select(F.col("o_orderkey").alias("memory_id"), at.alias("range_start"), (at + day).alias("range_end"))
    new = o.where("o_orderkey % 3 < 2").select(F.col("o_orderkey").alias("memory_id"), (at + day).alias("range_start"), F.when(F.col("o_orderkey") % 3 == 0, at + day + day).otherwise(at).alias("range_end"))
    return S.range_upsert(old, new).select("memory_id", "range_start")


# --- graph ------------------------------------------------------------------------

_GE = "ge AS (SELECT o_custkey % 200 AS src, o_orderkey % 200 AS dst, max(o_totalprice) AS weight FROM orders WHERE o_custkey % 200 <> o_orderkey % 200 GROUP BY ALL)"


def _graph(spark, d):
    o = M.table(spark, d, "orders").select(F.pmod("o_custkey", F.lit(200)).alias("src"), F.pmod("o_orderkey", F.lit(200)).alias("dst"), "o_totalprice").where("src <> dst")
    return o.groupBy("src", "dst").agg(F.max("o_totalprice").alias("weight"))


@register("weighted_neighbours", f"WITH {_GE}, u AS (SELECT src AS node, dst AS neighbour, weight, 0 AS p FROM ge UNION ALL SELECT dst, src, weight, 1 FROM ge) SELECT node, neighbour, first(weight ORDER BY p, weight DESC) AS weight FROM u GROUP BY ALL")
def weighted_neighbours(spark, d):
    return G.weighted_neighbours(_graph(spark, d))


@register("edge_weights_set", f"WITH {_GE} SELECT src, dst, CASE WHEN src % 3 = 0 THEN 0.5 WHEN dst % 2 = 0 THEN 1.0 ELSE weight END AS weight FROM ge")
def edge_weights_set(spark, d):
    g = _graph(spark, d).withColumn("weight", F.when((F.col("src") % 3 == 0) | (F.col("dst") % 2 == 1), F.col("weight")))
    return G.set_weights(g, g.where("src % 3 = 0").withColumn("weight", F.lit(0.5)))


@register("graph_rebuilt", f"WITH {_GE}, s AS (SELECT LEAST(src, dst) AS a, GREATEST(src, dst) AS b, max(weight) / 599983 AS w FROM ge WHERE (src + dst) % 5 = 0 GROUP BY ALL) SELECT src, dst, round(coalesce(w, 1.0), 6) AS weight FROM ge LEFT JOIN s ON a = least(src, dst) AND b = greatest(src, dst)")
def graph_rebuilt(spark, d):
    g = _graph(spark, d)
    s = g.where("(src + dst) % 5 = 0").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg((F.max("weight") / 599983).alias("strength"))
    return G.rebuilt(g, s).select("src", "dst", F.round("weight", 6).alias("weight"))


@register("document_traceability", "WITH RECURSIVE l AS (SELECT o_orderkey AS link_id, o_orderkey AS src, o_orderkey + o_custkey % 7 AS dst FROM orders WHERE o_custkey % 7 > 0), u AS (SELECT src AS a, dst AS b FROM l UNION SELECT dst, src FROM l), r(n) AS (SELECT 12 UNION SELECT u.b FROM r JOIN u ON u.a = r.n) SELECT DISTINCT link_id FROM l WHERE src IN (SELECT n FROM r) OR dst IN (SELECT n FROM r)")
def document_traceability(spark, d):
    o = M.table(spark, d, "orders").where("o_custkey % 7 > 0")
    links = o.select(F.col("o_orderkey").alias("link_id"), F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + F.col("o_custkey") % 7).alias("dst"))
    return G.reached_links(links, spark.range(12, 13).select(F.col("id").alias("node")))


@register("temporal_traversal", f"WITH {M.STATES_SQL}, k AS (SELECT o_orderkey AS seed, o_custkey % 150 AS e FROM orders WHERE o_orderkey % 1000 = 7), r AS (SELECT seed, entity_id, node_id, row_number() OVER (PARTITION BY seed ORDER BY entity_id, created_at, node_id) AS place FROM k JOIN states ON entity_id = e) SELECT seed, place, entity_id, node_id FROM r WHERE place <= 20")
def temporal_traversal(spark, d):
    links = M.table(spark, d, "orders").select(F.col("o_orderkey").alias("memory_id"), (F.col("o_custkey") % 150).alias("entity_id"))
    seeds = links.where("memory_id % 1000 = 7").select(F.col("memory_id").alias("seed"))
    return R.timeline(links, M.states(spark, d), seeds).withColumn("place", F.col("place").cast("long"))


@register("episode_bonus", "WITH h AS (SELECT o_orderkey AS s FROM orders WHERE o_orderpriority = '2-HIGH' ORDER BY o_totalprice DESC, o_orderkey LIMIT 5), t AS (SELECT DISTINCT l_partkey % 1500 AS m FROM lineitem WHERE l_returnflag = 'N' AND l_orderkey IN (SELECT s FROM h)) SELECT m AS memory_id FROM t WHERE m NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 1)")
def episode_bonus(spark, d):
    hits = M.table(spark, d, "orders").where("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("memory_id"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("node_id"))
    nodes = M.table(spark, d, "lineitem").select(F.col("l_partkey").alias("node_id"), (F.col("l_partkey") % 1500).alias("memory_id")).distinct()
    seen = M.table(spark, d, "customer").where("c_nationkey = 1").select(F.col("c_custkey").alias("memory_id"))
    return R.episode_bonus(hits, _edges(spark, d), nodes, seen)


@register("zones_of_edges", "WITH z AS (SELECT o_custkey AS subject, o_orderkey AS node_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p, o_orderstatus AS s FROM orders), g AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> s THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY k) - 1 AS zone FROM z) SELECT CAST(subject AS VARCHAR) AS subject, CAST(zone AS BIGINT) AS zone, count(*) AS members, first(node_id ORDER BY k) AS start, last(node_id ORDER BY k) AS terminal FROM g GROUP BY ALL")
def zones_of_edges(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = M.table(spark, d, "orders").withColumns({"p": F.lag("o_orderkey").over(w), "ps": F.lag("o_orderstatus").over(w), "k": F.row_number().over(w)})
    name = F.col("o_custkey").cast("string").alias("subject")
    nodes = o.select(name, F.col("o_orderkey").alias("node_id"), F.col("k").alias("at"))
    edges = o.where("p is not null").select(name, F.col("o_orderkey").alias("source_id"), F.col("p").alias("target_id"), F.when(F.col("ps") == F.col("o_orderstatus"), "refines").otherwise("supersedes").alias("edge_type"))
    z = grammar.graph_zones(nodes, edges)
    return z.select("subject", F.col("zone").cast("long").alias("zone"), F.size("members").cast("long").alias("members"), "start", "terminal")


# --- documents, approvals, audit --------------------------------------------------


@register("document_provenance", "WITH l AS (SELECT l_orderkey AS s, l_partkey AS t, row_number() OVER () AS i FROM lineitem), e AS (SELECT DISTINCT s AS k, i FROM l UNION SELECT DISTINCT t, i FROM l) SELECT o_orderkey AS doc_id, o_custkey AS project_id, (SELECT count(*) FROM e WHERE k = o_orderkey) AS lineage, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25) AS reviews, coalesce(v.n, 0) AS violations, o_orderkey % 5 <> 0 AS intact FROM orders LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) v ON v.user_id = o_custkey")
def document_provenance(spark, d):
    text = F.concat(F.lit("text "), F.col("o_orderkey").cast("string"))
    docs = M.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("project_id"), F.col("o_orderstatus").alias("agent"), text.alias("content"), F.sha2(F.when(F.col("o_orderkey") % 5 == 0, F.lit("other")).otherwise(text), 256).alias("content_hash"))
    li = M.table(spark, d, "lineitem")
    links = li.select(F.monotonically_increasing_id().alias("link_id"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    reviews = li.where("l_quantity > 25").select(F.col("l_orderkey").alias("doc_id"))
    e = M.table(spark, d, "events")
    calls = e.select(F.col("user_id").alias("project_id"), F.lit("none").alias("agent"))
    return A.provenance(docs, links, reviews, e.where("event_type = 'error'").select(F.col("user_id").alias("project_id")), calls).drop("calls")


_DEC = "d AS (SELECT o_orderkey AS r, o_custkey AS p, last(CASE WHEN l_returnflag = 'R' THEN 'denied' ELSE 'approved' END ORDER BY l_shipdate, CASE WHEN l_returnflag = 'R' THEN 'denied' ELSE 'approved' END) FILTER (l_returnflag <> 'N') AS dec FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


def _approvals(spark, d):
    requests = M.table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("project_id"))
    dec = M.table(spark, d, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("request_id"), F.when(F.col("l_returnflag") == "R", "denied").otherwise("approved").alias("decision"), F.col("l_shipdate").alias("decided_at"))
    return A.decided(requests, dec)


@register("approval_status", f"WITH {_DEC} SELECT r AS request_id, coalesce(dec, 'pending') AS status FROM d")
def approval_status(spark, d):
    return _approvals(spark, d).select("request_id", "status")


@register("project_status", f"WITH {_DEC} SELECT c_custkey AS project_id, CASE WHEN c_nationkey % 2 = 0 AND c_custkey IN (SELECT p FROM d WHERE dec = 'denied') THEN 'denied' WHEN c_nationkey % 2 = 0 THEN 'active' ELSE 'done' END AS status FROM customer")
def project_status(spark, d):
    c = M.table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.when(F.col("c_nationkey") % 2 == 0, "active").otherwise("done").alias("status"))
    return A.project_status(c, _approvals(spark, d))


@register("audit_rows", "SELECT event_id, sha256('llm_call|' || user_id || '|' || '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}') AS digest FROM events")
def audit_rows(spark, d):
    r = A.audit_rows(M.table(spark, d, "events"), "llm_call", "user_id", "ts", ["event_id", "event_type"])
    return r.select(F.get_json_object("detail", "$.event_id").cast("long").alias("event_id"), "digest")


@register("hash_chain_verified", "SELECT user_id, count(*) AS rows, user_id % 4 <> 0 AS verified FROM events GROUP BY 1")
def hash_chain_verified(spark, d):
    e = M.table(spark, d, "events").select("user_id", "event_id", F.concat(F.col("event_id").cast("string"), "event_type").alias("record"))
    kept = e.join(A.hash_chain(e, "user_id", "event_id", "record"), ["user_id", "event_id"])
    first = F.col("event_id") == F.min("event_id").over(Window.partitionBy("user_id"))
    bad = kept.withColumn("record", F.when((F.col("user_id") % 4 == 0) & first, F.lit("x")).otherwise(F.col("record")))
    return A.verify_chain(bad, "user_id", "event_id", "record", "hash")


# --- messages ---------------------------------------------------------------------


@register("subscriptions", "SELECT n_nationkey AS agent, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_regionkey || ',*' END AS wanted FROM nation")
def subscriptions(spark, d):
    n = M.table(spark, d, "nation").select(F.col("n_nationkey").alias("agent"), F.when(F.col("n_nationkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("n_regionkey").cast("string"))).alias("wanted"))
    return n.select("agent", F.array_join(P.with_broadcast(F.col("wanted")), ",").alias("wanted"))


@register("inbox_drained", "SELECT user_id AS agent, count(*) FILTER (event_id % 4 <> 0) AS left_over, count(*) FILTER (event_id % 4 = 0) AS drained FROM events GROUP BY 1")
def inbox_drained(spark, d):
    e = M.table(spark, d, "events").select(F.col("user_id").alias("agent"), "event_id")
    kept, gone = S.drain(e, F.col("event_id") % 4 == 0)
    n = lambda df, name: df.groupBy("agent").agg(F.count("*").alias(name))
    return n(kept, "left_over").join(n(gone, "drained"), "agent", "full").fillna(0)


@register("ask_with_fallback", "WITH a AS (SELECT event_id AS ask_id, user_id AS agent, ts FROM events WHERE event_type = 'click'), r AS (SELECT event_id + 1 AS ask_id, value FROM events WHERE event_type = 'view' AND value < 20), s AS (SELECT user_id AS agent, max(value) AS v FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT ask_id, CASE WHEN r.value IS NOT NULL THEN 'live' WHEN s.v IS NOT NULL THEN 'warm' ELSE 'none' END AS mode, round(coalesce(r.value, 0.8 * s.v), 6) AS confidence FROM a LEFT JOIN r USING (ask_id) LEFT JOIN s USING (agent)")
def ask_with_fallback(spark, d):
    e = M.table(spark, d, "events")
    asks = e.where("event_type = 'click'").select(F.col("event_id").alias("ask_id"), F.col("user_id").alias("agent"))
    live = e.where("event_type = 'view' and value < 20").select((F.col("event_id") + 1).alias("ask_id"), F.col("value").alias("confidence"))
    snap = e.where("event_type = 'signup'").groupBy(F.col("user_id").alias("agent")).agg(F.max("value").alias("confidence"))
    return R.answered(asks, live, snap).select("ask_id", "mode", F.round("confidence", 6).alias("confidence"))


# --- retrieval and metrics --------------------------------------------------------


@register("chunk_vectors_merged", "SELECT doc_id % 100 AS id, lang AS dim, max(n_chars)::DOUBLE AS weight FROM documents GROUP BY ALL")
def chunk_vectors_merged(spark, d):
    v = M.table(spark, d, "documents").select((F.col("doc_id") % 100).alias("id"), F.col("lang").alias("dim"), F.col("n_chars").cast("double").alias("weight"))
    return retrieval.sparse_max(v, "id")


@register("index_after_removal", r"SELECT count(*) AS postings, count(DISTINCT doc_id) AS docs FROM (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS term FROM documents WHERE doc_id % 10 <> 0)")
def index_after_removal(spark, d):
    docs = M.table(spark, d, "documents").select("doc_id", "text")
    left = retrieval.drop_from_index(retrieval.postings(docs, "doc_id", "text"), docs.where("doc_id % 10 = 0"), "doc_id")
    return left.agg(F.count("*").alias("postings"), F.countDistinct("doc_id").alias("docs"))


@register("synthesis_budget", "WITH h AS (SELECT o_orderkey, 'order ' || o_orderkey AS c, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders QUALIFY k <= 50), u AS (SELECT *, sum(length(c)) OVER (ORDER BY k) AS used FROM h) SELECT string_agg('[' || k || '] ' || c, chr(10) ORDER BY k) AS content, CAST(max(used) AS BIGINT) AS used FROM u WHERE used <= 300")
def synthesis_budget(spark, d):
    hits = M.table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select(F.col("o_orderkey").alias("memory_id"), F.col("o_totalprice").alias("score"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("content"))
    return R.synthesis(hits, 300)


_RUN = "runs AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), acc AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id FROM orders WHERE o_orderstatus = 'P')"


def _runs(spark, d):
    o = M.table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    runs = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.row_number().over(w).alias("rank"))
    return runs, o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("rel"))


@register("rank_hits", f"WITH {_RUN}, m AS (SELECT query_id, min(rank) AS r FROM runs JOIN acc USING (query_id, doc_id) GROUP BY 1) SELECT query_id, CAST(coalesce(r = 1, false) AS INT) AS rank1, CAST(coalesce(r <= 5, false) AS INT) AS top5, round(CASE WHEN r <= 10 THEN 1.0 / r ELSE 0 END, 6)::DOUBLE AS rr FROM (SELECT DISTINCT query_id FROM runs) LEFT JOIN m USING (query_id)")
def rank_hits(spark, d):
    runs, acc = _runs(spark, d)
    return X.rank_hits(runs, acc).select("query_id", "rank1", "top5", F.round("rr", 6).alias("rr"))


@register("temporal_mrr", f"WITH {_RUN}, m AS (SELECT query_id, min(rank) AS r FROM runs JOIN acc USING (query_id, doc_id) WHERE rank <= 100 GROUP BY 1) SELECT query_id, round(coalesce(1.0 / r, 0), 6)::DOUBLE AS rr FROM (SELECT DISTINCT query_id FROM acc) LEFT JOIN m USING (query_id)")
def temporal_mrr(spark, d):
    runs, acc = _runs(spark, d)
    return X.mrr(runs, acc, 100).select("query_id", F.round("rr", 6).alias("rr"))


@register("entity_f1", "WITH s AS (SELECT l_orderkey AS id, list(DISTINCT l_suppkey % 10) AS x FROM lineitem GROUP BY 1) SELECT a.id, round(2.0 * len(list_intersect(a.x, b.x)) / (len(a.x) + len(b.x)), 6)::DOUBLE AS f1 FROM s a JOIN s b ON b.id = a.id + 1")
def entity_f1(spark, d):
    s = M.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.col("l_suppkey") % 10).alias("x"))
    j = s.withColumnRenamed("x", "got").join(s.select((F.col("id") - 1).alias("id"), F.col("x").alias("want")), "id")
    return X.entity_f1(j, "got", "want").select("id", F.round("entity_f1", 6).alias("f1"))


@register("joint_accuracy", "SELECT round(avg(CAST(a AND b AS INT)), 6)::DOUBLE AS joint FROM (SELECT o_orderkey, bool_and(l_returnflag <> 'R') AS a, bool_and(l_suppkey % 3 <> 1) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def joint_accuracy(spark, d):
    li = M.table(spark, d, "lineitem")
    heads = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.bool_and(F.col("l_returnflag") != "R").alias("intent"), F.bool_and(F.col("l_suppkey") % 3 != 1).alias("slots"))
    return X.joint_accuracy(heads, ["intent", "slots"]).select(F.round("joint", 6).alias("joint"))


@register("qa_recall", r"WITH n AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\b(a|an|the)\b', ' ', 'g'), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE lang = 'en') SELECT source, CAST(bool_or(contains(t, 'thereon')) AS INT) AS found FROM n WHERE r <= 5 GROUP BY 1")
def qa_recall(spark, d):
    docs = M.table(spark, d, "documents").where("lang = 'en'")
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    runs = docs.select(F.col("source").alias("query_id"), F.col("text").alias("content"), F.row_number().over(w).alias("rank"))
    gold = docs.select(F.col("source").alias("query_id")).distinct().withColumn("gold", F.lit("The thereon!"))
    return X.qa_recall(runs, gold, 5).select(F.col("query_id").alias("source"), F.col("found").cast("int").alias("found"))


@register("chain_unique_anchor", "WITH t AS (SELECT DISTINCT o_custkey AS chain, o_orderkey AS m, l_suppkey % 30 AS x FROM orders JOIN lineitem ON l_orderkey = o_orderkey), u AS (SELECT chain, x, count(DISTINCT m) AS n, min(m) AS m FROM t GROUP BY ALL) SELECT o_orderkey AS memory_id, EXISTS (SELECT 1 FROM u WHERE u.chain = o_custkey AND u.n = 1 AND u.m = o_orderkey AND u.x IN (3, 9, 12, 27)) AS unique_anchor FROM orders WHERE o_orderkey IN (SELECT m FROM t)")
def chain_unique_anchor(spark, d):
    li = M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") % 30).cast("string").alias("token"))
    tasks = dealt(li.count())
    o = M.table(spark, d, "orders").select("o_orderkey", "o_custkey").repartition(tasks, "o_orderkey")
    t = o.join(li.repartition(tasks, "o_orderkey"), "o_orderkey").select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("memory_id"), "token")
    return X.unique_anchors(t, spark.createDataFrame([("3",), ("9",), ("12",), ("27",)], "token string"), tasks)


# --- chunks -----------------------------------------------------------------------


def _cut(df, text, form, most):
    c = H.chunk(df, text, form, most)
    return c.groupBy(df.columns[0]).agg(F.count("*").alias("n"), F.sum(F.length("chunk")).alias("characters"))


@register("plain_chunks", r"WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS c FROM documents) SELECT doc_id, count(*) AS n, CAST(sum(length(c)) AS BIGINT) AS characters FROM p GROUP BY 1")
def plain_chunks(spark, d):
    t = M.table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return _cut(t, "text", "plain", 0)


@register("markdown_chunks", "SELECT o_custkey, count(*) AS n, CAST(sum(length('## ' || o_orderkey || chr(10) || o_orderpriority)) AS BIGINT) AS characters FROM orders GROUP BY 1")
def markdown_chunks(spark, d):
    part = F.concat(F.lit("## "), F.col("o_orderkey").cast("string"), F.lit("\n"), F.col("o_orderpriority"))
    t = M.table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(part), "\n").alias("text"))
    return _cut(t, "text", "markdown", 2000)


@register("csv_chunks", "SELECT o_custkey, count(*) AS n, CAST(sum(length('id' || chr(10) || o_orderkey)) AS BIGINT) AS characters FROM orders GROUP BY 1")
def csv_chunks(spark, d):
    t = M.table(spark, d, "orders").groupBy("o_custkey").agg(F.concat(F.lit("id\n"), F.array_join(F.collect_list(F.col("o_orderkey").cast("string")), "\n")).alias("text"))
    return _cut(t, "text", "csv", 0)


@register("json_chunks", "SELECT o_custkey, count(*) AS n, CAST(sum(length(CAST(o_orderkey AS VARCHAR))) AS BIGINT) AS characters FROM orders WHERE o_orderkey <> 0 GROUP BY 1")
def json_chunks(spark, d):
    t = M.table(spark, d, "orders").where("o_orderkey <> 0").groupBy("o_custkey").agg(F.to_json(F.collect_list("o_orderkey")).alias("text"))
    return _cut(t, "text", "json", 2000)


@register("section_rows", r"WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS c FROM documents) SELECT doc_id, count(*) AS sections, CAST(sum(length(regexp_replace(c[1:80], '^\s+|\s+$', '', 'g'))) AS BIGINT) AS headings FROM p GROUP BY 1")
def section_rows(spark, d):
    t = M.table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return H.split_sections(t, "text", "structured_text").groupBy("doc_id").agg(F.count("*").alias("sections"), F.sum(F.length("heading")).alias("headings"))


@register("content_classes", r"SELECT doc_id, CASE WHEN length(text) < 500 THEN 'plain' WHEN len(regexp_extract_all(text, '(?m)^[a-z][\w\-]*:\s*')) >= 2 THEN 'yaml' ELSE 'plain' END AS form FROM documents")
def content_classes(spark, d):
    return M.table(spark, d, "documents").select("doc_id", H.content_class(F.col("text"))["form"].alias("form"))
