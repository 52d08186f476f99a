"""Queries: scans, joins, aggregations and set operations over the model."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from recallforge import model as M
from recallforge.catalog import register
from recallforge.functions import text as T
from recallforge.operators import predicates as P, ranking, routing, scans
from recallforge.shared import dealt


@register("multi_get", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (1, 5, 8, 144, 900)")
def multi_get(spark, d):
    return scans.get(M.table(spark, d, "documents"), "doc_id", [1, 5, 8, 144, 900]).select("doc_id", "n_chars")


@register("json_key_lookup", "SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '42'")
def json_key_lookup(spark, d):
    return scans.by_json_key(M.table(spark, d, "events"), "props", "$.k", 42).select("event_id", "user_id")


@register("upsert_last_write", "SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_last_write(spark, d):
    return scans.last_write_wins(M.table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "value", "event_id")


@register("upsert_merge", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert_merge(spark, d):
    c = M.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return scans.upsert(c, c.where("c_custkey % 7 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])


@register("delete_cascade", "SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey % 10 <> 3 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey % 10 <> 3")
def delete_cascade(spark, d):
    c, o = M.table(spark, d, "customer"), M.table(spark, d, "orders")
    left = scans.delete_cascade({"orders": (o, "o_custkey"), "customer": (c, "c_custkey")}, c.where("c_custkey % 10 = 3").unionByName(c.limit(0)).select("c_custkey").union(o.where("o_custkey % 10 = 3").select("o_custkey")), "c_custkey")
    parts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, df in left.items()]
    return parts[0].unionByName(parts[1])


@register("should_ingest", "SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id < 100)")
def should_ingest(spark, d):
    f = M.table(spark, d, "documents").select("doc_id", F.lit("p").alias("path"), T.content_hash(F.col("text")).alias("sha"))
    return scans.unseen(f, f.where("doc_id < 100")).select("doc_id")


@register("path_routing", "SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, 'example.org') THEN 'org' ELSE NULL END AS domain, CASE WHEN contains(url, '/en/') THEN 0.9::DOUBLE WHEN contains(url, 'example.org') THEN 0.5::DOUBLE END AS confidence FROM pages")
def path_routing(spark, d):
    u = F.col("url")
    r = P.route([(u.contains("/en/"), "english", 0.9), (u.contains("example.org"), "org", 0.5)])
    return M.table(spark, d, "pages").withColumn("_r", r).select("page_id", "_r.domain", "_r.confidence")


_RULES = [("m.*/e?/*", "mobile", 1), ("*.example.net/*.html", "saved", 5), ("blog.*[0-4]", "blog", 5)]
_PREFIXES = [("spam-farm.example.org", "farm"), ("spam-farm.example.org/en/", "farm-en"), ("/thther.example.org/en", "thther"), ("none", "none")]
_SLASH = r"regexp_replace(url, '^[^:]*://|[?#].*$', '', 'g')"


@register(
    "path_domains",
    rf"""WITH p AS (SELECT page_id, {_SLASH} AS path FROM pages),
    x AS (SELECT page_id, path, regexp_extract(path, '([^/]*)/*$', 1) AS name, lower(regexp_extract(path, '([^/]+)/+[^/]+/*$', 1)) AS parent FROM p),
    r AS (SELECT page_id, CASE WHEN regexp_full_match(path, '.*\.example\.net/.*\.html') THEN {{'d': 'saved', 's': 'path_rule', 'c': 0.9}} WHEN regexp_full_match(path, 'blog\..*[0-4]') THEN {{'d': 'blog', 's': 'path_rule', 'c': 0.9}}
    WHEN regexp_full_match(path, 'm\..*/e./.*') THEN {{'d': 'mobile', 's': 'path_rule', 'c': 0.9}} WHEN prefix(path, 'spam-farm.example.org/en/') THEN {{'d': 'farm-en', 's': 'path_rule', 'c': 0.9}}
    WHEN prefix(path, 'spam-farm.example.org/') THEN {{'d': 'farm', 's': 'path_rule', 'c': 0.9}} WHEN prefix(path, 'thther.example.org/en/') THEN {{'d': 'thther', 's': 'path_rule', 'c': 0.9}}
    WHEN parent = 'fr' THEN {{'d': 'french', 's': 'directory_name', 'c': 0.7}} WHEN lower(name) LIKE '_%.html' THEN {{'d': 'page', 's': 'extension', 'c': 0.5}}
    ELSE {{'d': CASE WHEN parent = '' THEN 'general' ELSE parent END, 's': 'fallback', 'c': 0.3}} END AS r FROM x)
    SELECT page_id, r.d AS domain, r.s AS source, CAST(r.c AS DOUBLE) AS confidence FROM r""",
)
def path_domains(spark, d):
    pages = M.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[^:]*://|[?#].*$", "").alias("path"))
    pages = routing.by_prefix(pages, "path", spark.createDataFrame(_PREFIXES, "prefix string, domain string"))
    r = routing.classify(F.col("path"), rules=_RULES, directories=routing.DIRECTORIES | {"fr": "french"}, extensions=routing.EXTENSIONS | {".html": "page"}, prefix_domain=F.col("prefix_domain"))
    return pages.withColumn("_r", r).select("page_id", "_r.domain", "_r.source", "_r.confidence")


_TURNS = r"""t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM conversations)"""


@register("overlap_coefficient", f"WITH {_TURNS} SELECT a.conv_id, a.turn, round(CASE WHEN least(len(a.w), len(b.w)) > 0 THEN len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w))::DOUBLE ELSE 0 END, 6) AS overlap FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")
def overlap_coefficient(spark, d):
    t = M.table(spark, d, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("w"))
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return t.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.overlap(F.col("w"), F.col("v")), 6).alias("overlap"))


@register("event_log_after", "SELECT event_id, event_type FROM events WHERE event_id > 1500 ORDER BY event_id LIMIT 500")
def event_log_after(spark, d):
    return M.table(spark, d, "events").where("event_id > 1500").orderBy("event_id").limit(500).select("event_id", "event_type")


@register("event_log_range", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-04'")
def event_log_range(spark, d):
    return M.table(spark, d, "events").where(F.col("ts").between(F.lit("2024-01-03").cast("timestamp_ntz"), F.lit("2024-01-04").cast("timestamp_ntz"))).select("event_id")


@register("event_log_agent", "SELECT event_id, ts FROM events WHERE user_id = 9 AND NOT starts_with(event_type, 'vi') AND NOT starts_with(event_type, 'sig') ORDER BY ts DESC, event_id LIMIT 25")
def event_log_agent(spark, d):
    t = F.col("event_type")
    return M.table(spark, d, "events").where((F.col("user_id") == 9) & ~t.startswith("vi") & ~t.startswith("sig")).orderBy(F.desc("ts"), "event_id").limit(25).select("event_id", "ts")


@register("event_retention", f"SELECT count(*) AS kept FROM events WHERE ts >= TIMESTAMP '{M.NOW}' - INTERVAL 72 HOUR")
def event_retention(spark, d):
    return M.table(spark, d, "events").where(F.col("ts") >= M.now() - F.expr("interval 72 hours")).agg(F.count("*").alias("kept"))


@register("relationships_of", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 10 OR l_suppkey = 10")
def relationships_of(spark, d):
    return M.table(spark, d, "lineitem").where("l_partkey = 10 or l_suppkey = 10").select("l_orderkey", "l_linenumber")


@register("entities_by_name", "SELECT c_custkey FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000042') OR c_mktsegment = 'BUILDING'")
def entities_by_name(spark, d):
    return M.table(spark, d, "customer").where((F.lower("c_name") == "customer#000000042") | (F.col("c_mktsegment") == "BUILDING")).select("c_custkey")


@register("search_log_pairs", "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids FROM events WHERE ts > TIMESTAMP '2024-01-28' GROUP BY 1")
def search_log_pairs(spark, d):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda s: s["event_id"].cast("string"))
    return M.table(spark, d, "events").where(F.col("ts") > F.lit("2024-01-28").cast("timestamp_ntz")).groupBy("user_id").agg(F.array_join(ids, ",").alias("ids"))


@register("episode_member_entities", "SELECT o_custkey AS episode, count(DISTINCT l_partkey) AS entities FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def episode_member_entities(spark, d):
    li = M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return M.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("episode")).join(li, "o_orderkey").groupBy("episode").agg(F.countDistinct("l_partkey").alias("entities"))


@register("documents_with_reviews", "SELECT DISTINCT o_orderkey, o_totalprice FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 50")
def documents_with_reviews(spark, d):
    li = M.table(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return M.table(spark, d, "orders").join(li, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@register("lint_dangling", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') OR l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2)")
def lint_dangling(spark, d):
    li = M.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    o = M.table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("_o"))
    p = M.table(spark, d, "part").where("p_size > 2").select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("_p"))
    return li.join(o, "l_orderkey", "left").join(p, "l_partkey", "left").where("_o is null or _p is null").select("l_orderkey", "l_linenumber")


@register("lint_orphans", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def lint_orphans(spark, d):
    return M.table(spark, d, "orders").select("o_orderkey").join(M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@register("lint_junk_entities", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') OR length(c_name) <= 1")
def lint_junk_entities(spark, d):
    c = M.table(spark, d, "customer").select("c_custkey", "c_name")
    free = c.join(M.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return free.unionByName(c.where(P.junk_name(F.col("c_name")))).select("c_custkey").distinct()


@register("novel_candidates", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey < 20) AND l_orderkey >= 20 ORDER BY l_orderkey LIMIT 10")
def novel_candidates(spark, d):
    li = M.table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    seen = li.where("l_orderkey < 20")
    return li.where("l_orderkey >= 20").join(seen.select("l_partkey"), "l_partkey", "left_semi").select("l_orderkey").distinct().orderBy("l_orderkey").limit(10)


@register("lexical_join", "SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON lower(n.n_name) = lower('nation_' || s.s_nationkey) OR n.n_nationkey = s.s_nationkey")
def lexical_join(spark, d):
    s = M.table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = M.table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("k"))
    by_name = s.withColumn("k", F.lower(F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")))).join(n, "k").select("s_suppkey", "n_nationkey")
    by_id = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", "n_nationkey")
    return by_name.union(by_id).distinct()


@register("candidate_signals", "SELECT c.c_custkey, coalesce(o.n, 0) AS orders, coalesce(o.total, 0.0) AS total FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def candidate_signals(spark, d):
    o = M.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return M.table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce("total", F.lit(0.0)).alias("total"))


@register("topic_rollup", "SELECT source AS topic, count(*) AS n, max(n_chars) AS latest FROM documents WHERE lang = 'en' GROUP BY 1")
def topic_rollup(spark, d):
    return M.memories(spark, d).where(F.array_contains("domains", "en")).groupBy(F.col("source").alias("topic")).agg(F.count("*").alias("n"), F.max("n_chars").alias("latest"))


@register("row_counts", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def row_counts(spark, d):
    parts = [M.table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("documents", "events", "lineitem")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("domain_nouns", "WITH e AS (SELECT DISTINCT o_custkey AS s, o_orderkey AS m, l_returnflag AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey), n AS (SELECT s, count(DISTINCT m) AS n FROM e GROUP BY 1 HAVING count(DISTINCT m) >= 3) SELECT e, count(*) AS subjects FROM (SELECT s, e, count(*) AS c FROM e GROUP BY ALL) JOIN n USING (s) WHERE c >= ceil(0.6 * n) GROUP BY 1")
def domain_nouns(spark, d):
    li = M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("m"), F.col("l_returnflag").alias("e"))
    e = M.table(spark, d, "orders").select(F.col("o_custkey").alias("s"), F.col("o_orderkey").alias("m")).join(li, "m").distinct()
    n = e.groupBy("s").agg(F.countDistinct("m").alias("n")).where("n >= 3")
    return e.groupBy("s", "e").agg(F.count("*").alias("c")).join(n, "s").where(F.col("c") >= F.ceil(F.lit(0.6) * F.col("n"))).groupBy("e").agg(F.count("*").alias("subjects"))


@register("signal_coverage", "SELECT count(*) FILTER (l_discount > 0) AS discount, count(*) FILTER (l_tax > 0) AS tax, count(*) AS n FROM lineitem")
def signal_coverage(spark, d):
    return M.table(spark, d, "lineitem").agg(F.count_if(F.col("l_discount") > 0).alias("discount"), F.count_if(F.col("l_tax") > 0).alias("tax"), F.count("*").alias("n"))


@register("cluster_coverage", "SELECT o_custkey, count(*) AS parts FROM (SELECT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL HAVING count(DISTINCT o_orderkey) >= 2) GROUP BY 1")
def cluster_coverage(spark, d):
    li = M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    # two orders or more: no set of a pair's orders is held; as many tasks as rows ask for
    pairs = M.table(spark, d, "orders").join(li, "o_orderkey").select("o_custkey", "l_suppkey", "o_orderkey")
    pairs = pairs.repartition(dealt(li.count()), "o_custkey", "l_suppkey")
    g = pairs.groupBy("o_custkey", "l_suppkey").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last")).where("first < last")
    return g.groupBy("o_custkey").agg(F.count("*").alias("parts"))


@register(
    "vocabulary_induction",
    r"""WITH m AS (SELECT DISTINCT l_suppkey AS subject, p_name AS e FROM lineitem JOIN part ON p_partkey = l_partkey), t AS (SELECT subject, e AS canonical, lower(e) AS token, true AS p FROM m UNION ALL SELECT subject, w, lower(w), false FROM (SELECT subject, e, unnest(regexp_split_to_array(e, '\s+')) AS w FROM m) WHERE lower(w) <> lower(e)),
    n AS (SELECT token, subject, count(*) AS n, min(canonical) AS canonical, bool_or(p) AS p FROM t WHERE length(token) >= 2 AND NOT regexp_matches(token, '^\d+$') GROUP BY ALL)
    SELECT token, first(subject ORDER BY n DESC, subject) AS subject, min(canonical) AS canonical, count(*) AS subjects, bool_or(p) AS is_primary FROM n GROUP BY 1""",
)
def vocabulary_induction(spark, d):
    from recallforge.operators import question

    p = M.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("entity"))
    m = M.table(spark, d, "lineitem").join(p, "l_partkey").select(F.col("l_suppkey").alias("subject"), "entity").distinct()
    return question.vocabulary(m).drop("stems")


@register("term_quota", "SELECT l_orderkey, l_partkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) <= 2")
def term_quota(spark, d):
    return ranking.per_group(M.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct(), ["l_orderkey"], ["l_partkey"], 2)


@register("subject_representatives", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def subject_representatives(spark, d):
    o = M.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return ranking.representatives(o, "o_custkey", "at").drop("at")


@register("union_by_entity", "SELECT o_orderkey FROM orders WHERE o_custkey = 11 UNION SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE lower(c_mktsegment) = 'machinery'")
def union_by_entity(spark, d):
    o = M.table(spark, d, "orders")
    c = M.table(spark, d, "customer").where("lower(c_mktsegment) = 'machinery'").select(F.col("c_custkey").alias("o_custkey"))
    return o.where("o_custkey = 11").select("o_orderkey").union(o.join(c, "o_custkey", "left_semi").select("o_orderkey")).distinct()


@register("compose_keep_first", "WITH u AS (SELECT o_orderkey AS id, 0 AS p, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderpriority = '1-URGENT' QUALIFY r <= 5 UNION ALL SELECT o_orderkey, 1, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 20), k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY p) = 1) SELECT id, row_number() OVER (ORDER BY p, r) AS place FROM k")
def compose_keep_first(spark, d):
    from recallforge.operators import retrieval as R

    o = M.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), "o_orderpriority")
    a = R.ranked(R.top(o.where("o_orderpriority = '1-URGENT'"), "id", 5), "id").withColumn("p", F.lit(0))
    b = R.ranked(R.top(o, "id", 20), "id").withColumn("p", F.lit(1))
    kept = scans.keep_first(a.unionByName(b), ["id"], ["p"])
    return kept.withColumn("place", F.row_number().over(Window.orderBy("p", "rank")).cast("long")).select("id", "place")


_SETS = "s AS (SELECT l_orderkey AS id, list(DISTINCT l_suppkey) AS x FROM lineitem GROUP BY 1), p AS (SELECT a.id AS a, b.id AS b, a.x AS xa, b.x AS xb FROM s a JOIN s b ON b.id = a.id + 1)"


def _set_pairs(spark, d):
    s = M.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("x"))
    a, b = s.select(F.col("id").alias("a"), F.col("x").alias("xa"), (F.col("id") + 1).alias("b")), s.select(F.col("id").alias("b"), F.col("x").alias("xb"))
    return a.join(b, "b")


@register("spreading_jaccard", f"WITH {_SETS} SELECT a, round(len(list_intersect(xa, xb))::DOUBLE / len(list_distinct(xa || xb)), 6) AS jaccard, round(len(list_intersect(xa, xb))::DOUBLE / least(len(xa), len(xb)), 6) AS overlap FROM p")
def spreading_jaccard(spark, d):
    return _set_pairs(spark, d).select("a", F.round(T.jaccard(F.col("xa"), F.col("xb")), 6).alias("jaccard"), F.round(T.overlap(F.col("xa"), F.col("xb")), 6).alias("overlap"))


@register("set_difference", f"WITH {_SETS} SELECT a, len(list_filter(xa, lambda v: NOT list_contains(xb, v))) AS retired, len(list_filter(xb, lambda v: NOT list_contains(xa, v))) AS introduced FROM p")
def set_difference(spark, d):
    return _set_pairs(spark, d).select("a", F.size(F.array_except("xa", "xb")).cast("long").alias("retired"), F.size(F.array_except("xb", "xa")).cast("long").alias("introduced"))


@register("day_bucket_range", "SELECT event_id, date_trunc('day', ts) AS range_start, date_trunc('day', ts) + INTERVAL 1 DAY AS range_end FROM events")
def day_bucket_range(spark, d):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return M.table(spark, d, "events").select("event_id", day.alias("range_start"), (day + F.expr("interval 1 day")).alias("range_end"))
