"""Queries: documents, reviews and audit analytics.

Orders stand for documents of a project (the customer), line items for reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallforge import model as M
from recallforge.catalog import register
from recallforge.operators import audit as A


@register(
    "audit_timeline_union",
    """SELECT o_orderdate AS at, 'document' AS type, CAST(o_custkey AS VARCHAR) AS agent, CAST(o_orderkey AS VARCHAR) AS detail FROM orders
    UNION ALL SELECT l_shipdate, 'review', CAST(l_suppkey AS VARCHAR), CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) FROM lineitem WHERE l_returnflag = 'N'
    UNION ALL SELECT l_shipdate, 'approval', CAST(l_suppkey AS VARCHAR), CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) FROM lineitem WHERE l_returnflag = 'A'
    UNION ALL SELECT l_shipdate, 'violation', CAST(l_suppkey AS VARCHAR), CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R'
    UNION ALL SELECT ts, 'llm_call', CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'click'
    UNION ALL SELECT ts, 'bus', CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'view'
    UNION ALL SELECT ts, 'event', CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR) FROM events WHERE event_type NOT IN ('click', 'view')""",
)
def audit_timeline_union(spark, d):
    s = lambda c: F.col(c).cast("string")
    row = lambda df, at, kind, who, what: df.select(F.col(at).alias("at"), F.lit(kind).alias("type"), s(who).alias("agent"), what.alias("detail"))
    li, e = M.table(spark, d, "lineitem"), M.table(spark, d, "events")
    line = F.concat_ws(":", s("l_orderkey"), s("l_linenumber"))
    kind = F.col("event_type")
    parts = [
        row(M.table(spark, d, "orders"), "o_orderdate", "document", "o_custkey", s("o_orderkey")),
        *(row(li.where(F.col("l_returnflag") == f), "l_shipdate", name, "l_suppkey", line) for f, name in (("N", "review"), ("A", "approval"), ("R", "violation"))),
        row(e.where(kind == "click"), "ts", "llm_call", "user_id", s("event_id")), row(e.where(kind == "view"), "ts", "bus", "user_id", s("event_id")),
        row(e.where(~kind.isin("click", "view")), "ts", "event", "user_id", s("event_id")),
    ]
    return A.timeline(parts)


_SRC = """rv AS (SELECT o_custkey AS project_id, avg(l_quantity * 2) AS review FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
vi AS (SELECT o_custkey AS project_id, sum(CASE WHEN l_returnflag = 'R' THEN 10 WHEN l_returnflag = 'A' THEN 25 ELSE 0 END) AS pen, count(*) FILTER (l_returnflag = 'N') AS cit FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
de AS (SELECT o_custkey AS project_id, count(*) FILTER (o_orderstatus = 'P') AS denied, count(DISTINCT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority END) AS kinds FROM orders GROUP BY 1)"""


@register("compliance_score", f"WITH {_SRC} SELECT project_id, round(0.4 * review + 0.2 * greatest(0, 100 - pen) + 0.15 * least(100, 10 * cit) + 0.15 * CASE WHEN denied > 0 THEN 0 ELSE 100 END + 0.1 * (kinds / 3.0 * 100), 1) AS score FROM rv JOIN vi USING (project_id) JOIN de USING (project_id)")
def compliance_score(spark, d):
    o = M.table(spark, d, "orders").withColumnRenamed("o_custkey", "project_id")
    li = M.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    # one pass over the reviews: partial sums before the only shuffle
    r = o.select("project_id", "o_orderkey").join(li, "o_orderkey").groupBy("project_id").agg(
        F.avg(F.col("l_quantity") * 2).alias("review"),
        F.sum(F.when(F.col("l_returnflag") == "R", 10).when(F.col("l_returnflag") == "A", 25).otherwise(0)).alias("penalty"),
        F.count_if(F.col("l_returnflag") == "N").alias("citations"),
    )
    k = o.groupBy("project_id").agg(F.count_if(F.col("o_orderstatus") == "P").alias("denied"), F.countDistinct(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), F.col("o_orderpriority"))).alias("kinds"))
    score = A.compliance(F.col("review"), F.col("penalty"), F.col("citations"), F.col("denied"), F.col("kinds") / 3.0)
    return r.join(k, "project_id").select("project_id", (F.round(score * 10) / 10).alias("score"))  # scaled, then rounded: halves that a double holds a little below go up


@register("project_quality", "SELECT o_custkey AS project_id, round(avg(l_quantity), 6) AS quality, count(*) AS reviews FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def project_quality(spark, d):
    li = M.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return M.table(spark, d, "orders").join(li, "o_orderkey").groupBy(F.col("o_custkey").alias("project_id")).agg(F.round(F.avg("l_quantity"), 6).alias("quality"), F.count("*").alias("reviews"))


@register("document_integrity", "SELECT doc_id, sha256(text) = sha256(CASE WHEN doc_id % 13 = 0 THEN text || 'x' ELSE text END) AS intact FROM documents")
def document_integrity(spark, d):
    t = M.table(spark, d, "documents").withColumn("recorded", F.sha2("text", 256)).withColumn("text", F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return A.integrity(t, "text", "recorded").select("doc_id", "intact")


@register("hash_chain", "WITH RECURSIVE r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), c(user_id, k, h) AS (SELECT user_id, k, sha256('' || event_id || event_type) FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, sha256(c.h || r.event_id || r.event_type) FROM c JOIN r ON r.user_id = c.user_id AND r.k = c.k + 1) SELECT user_id, max(k) AS n, last(h ORDER BY k) AS head FROM c GROUP BY 1")
def hash_chain(spark, d):
    e = M.table(spark, d, "events").select("user_id", "event_id", F.concat(F.col("event_id").cast("string"), "event_type").alias("record"))
    return A.chain_heads(e, "user_id", "event_id", "record")


@register("publish_versions", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS supersedes FROM orders")
def publish_versions(spark, d):
    o = M.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return A.versions(o, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_orderkey", "o_custkey", F.col("version").cast("long").alias("version"), "supersedes")


@register("project_summary", "SELECT o_custkey AS project_id, count(*) AS documents, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS kinds, max(o_orderdate) AS latest FROM orders GROUP BY 1")
def project_summary(spark, d):
    return M.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg(F.count("*").alias("documents"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("kinds"), F.max("o_orderdate").alias("latest"))


@register("domain_directory", "SELECT dom AS domain, string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) AS providers FROM (SELECT DISTINCT source AS dom, doc_id % 7 AS s FROM documents UNION SELECT DISTINCT lang, doc_id % 7 FROM documents) GROUP BY 1")
def domain_directory(spark, d):
    m = M.memories(spark, d).select(F.explode("domains").alias("domain"), (F.col("memory_id") % 7).alias("s"))
    return m.groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_set("s")), lambda x: x.cast("string")), ",").alias("providers"))


@register("announcement_fanout", "SELECT n_nationkey AS subscriber, count(*) AS received FROM nation JOIN events ON event_id % 5 = n_regionkey AND event_id % 25 <> n_nationkey GROUP BY 1")
def announcement_fanout(spark, d):
    from recallforge.operators import predicates as P

    subs = M.table(spark, d, "nation").select(F.col("n_nationkey").alias("subscriber"), F.array(F.col("n_regionkey").cast("string")).alias("wanted"))
    ann = M.table(spark, d, "events").select((F.col("event_id") % 25).alias("sender"), F.array((F.col("event_id") % 5).cast("string")).alias("announced"))
    # subscriptions by first domain segment: an equi-join, then the exact predicate
    s = subs.withColumn("_k", F.explode(F.transform("wanted", lambda w: F.substring_index(w, ":", 1))))
    a = ann.withColumn("_k", F.explode(F.transform("announced", lambda w: F.substring_index(w, ":", 1))))
    return a.join(F.broadcast(s), "_k").where(P.subscribed(F.col("announced"), F.col("wanted")) & (F.col("sender") != F.col("subscriber"))).groupBy("subscriber").agg(F.count("*").alias("received"))
