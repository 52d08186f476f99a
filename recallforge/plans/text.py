"""Queries: text functions, admission, classification by rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallforge import model as M
from recallforge.catalog import register
from recallforge.functions import text as T
from recallforge.operators import classify as K, predicates as P

_TOK = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


def _count(markers, col="text") -> str:
    listed = ", ".join(f"'{m}'" for m in markers)
    return f"len(list_filter([{listed}], lambda m: contains(lower({col}), m)))"


def _clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


_U = f"(CASE WHEN {_count(T.UTILITY)} = 0 THEN 0.05 ELSE {_clamp(f'0.15 + 0.2::DOUBLE * {_count(T.UTILITY)} / (1.0 + 0.15::DOUBLE * {_count(T.UTILITY)})')} END)"
_TS = f"""{_clamp(rf"(CASE WHEN regexp_matches(text, '{T.DATE_ISO}') OR regexp_matches(text, '{T.DATE_NAMED}') THEN 0.4 ELSE 0 END) + least(0.3, {_count(T.TEMPORAL)} * 0.15::DOUBLE) + least(0.3, {_count(T.TEMPORAL_VERBS)} * 0.1::DOUBLE)")}"""
_P = f"""(CASE WHEN length(text) < 20 THEN 0.05 WHEN {_count(T.LASTING)} > 0 AND {_count(T.PASSING)} = 0 THEN {_clamp(f'0.6 + 0.1::DOUBLE * {_count(T.LASTING)}')} WHEN {_count(T.PASSING)} > 0 AND {_count(T.LASTING)} = 0 THEN {_clamp(f'0.2 - 0.05::DOUBLE * {_count(T.PASSING)}')} ELSE {_clamp(f'0.4 + 0.05::DOUBLE * ({_count(T.LASTING)} - {_count(T.PASSING)})')} END)"""
_SC = f"""{_clamp(rf"least(0.5, {_count(T.STATE_VERBS)} * 0.2::DOUBLE) + (CASE WHEN regexp_matches(lower(text), '{T.VERSION}') THEN 0.2 ELSE 0 END) + (CASE WHEN (contains(lower(text), 'status') OR contains(lower(text), 'state')) AND {_count(T.STATE_VERBS)} > 0 THEN 0.25 ELSE 0 END) + (CASE WHEN contains(lower(text), ' from ') AND contains(lower(text), ' to ') THEN 0.2 ELSE 0 END)")}"""
_FEAT = f"f AS (SELECT doc_id, {_U}::DOUBLE AS utility, {_TS}::DOUBLE AS temporal, {_P}::DOUBLE AS persistence, {_SC}::DOUBLE AS change FROM documents)"


def _features(spark, d):
    return T.admission(M.table(spark, d, "documents"), "doc_id", "text")


@register("admission_features", f"WITH {_FEAT} SELECT doc_id, round(utility, 6) AS utility, round(temporal, 6) AS temporal, round(persistence, 6) AS persistence, round(change, 6) AS change FROM f")
def admission_features(spark, d):
    return _features(spark, d).select("doc_id", *[F.round(c, 6).alias(c) for c in ("utility", "temporal", "persistence", "change")])


_SCORE = "round(0.3 * utility + 0.25 * persistence + 0.25 * change + 0.2 * temporal, 6)"


@register("admission_route", f"WITH {_FEAT}, s AS (SELECT doc_id, change, {_SCORE} AS score FROM f) SELECT doc_id, score, CASE WHEN change >= 0.35 THEN 'persist' WHEN score < 0.1 THEN 'discard' WHEN score < 0.25 THEN 'ephemeral_cache' ELSE 'persist' END AS route FROM s")
def admission_route(spark, d):
    f = _features(spark, d).withColumn("score", F.round("score", 6))
    return f.select("doc_id", "score", T.admission_route(F.col("score"), F.col("change")).alias("route"))


@register("content_hash_dedup", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def content_hash_dedup(spark, d):
    return M.table(spark, d, "documents").groupBy(T.content_hash(F.col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@register("lint_duplicates", "SELECT sha256(text) AS digest, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents GROUP BY 1 HAVING count(*) > 1")
def lint_duplicates(spark, d):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: i.cast("string")), ",")
    return M.table(spark, d, "documents").groupBy(T.content_hash(F.col("text")).alias("digest")).agg(F.count("*").alias("n"), ids.alias("ids")).where("n > 1")


@register("html_text", r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>', ' ', 'gsi'), '<style.*?</style>', ' ', 'gsi'), '<[^>]+>', ' ', 'gs'), '\s+', ' ', 'g'))) AS digest FROM pages")
def html_text(spark, d):
    return M.table(spark, d, "pages").select("page_id", F.sha2(T.html_text(F.col("html")), 256).alias("digest"))


@register("normalise_surface", r"SELECT p_partkey, lower(regexp_replace(trim(p_name), '\s+', ' ', 'g')) AS surface, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') AS slug FROM part")
def normalise_surface(spark, d):
    return M.table(spark, d, "part").select("p_partkey", T.normal_surface(F.col("p_name")).alias("surface"), T.slug(F.col("p_name")).alias("slug"))


@register("token_counts", f"SELECT doc_id, len({_TOK}) AS n, len(list_distinct({_TOK})) AS kinds FROM documents")
def token_counts(spark, d):
    t = T.tokens(F.col("text"))
    return M.table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("kinds"))


@register("alias_induction", r"""WITH n AS (SELECT DISTINCT s_name AS name FROM supplier UNION SELECT DISTINCT n_name FROM nation UNION SELECT DISTINCT r_name FROM region UNION SELECT 'ME'),
f AS (SELECT name AS "full", array_to_string(list_transform(list_filter(regexp_split_to_array(lower(name), '[\s_-]+'), lambda w: w <> ''), lambda w: w[1:1]), '') AS k FROM n)
SELECT DISTINCT s.name AS short, f."full" FROM n s JOIN f ON f.k IN (lower(s.name), regexp_replace(lower(s.name), 's$', '')) WHERE length(f.k) >= 2 AND NOT regexp_matches(s.name, '[\s_-]') AND s.name <> f."full" """)
def alias_induction(spark, d):
    from recallforge.operators import grammar

    one = spark.createDataFrame([("ME",)], "name string")
    names = one.union(M.table(spark, d, "supplier").select("s_name")).union(M.table(spark, d, "nation").select("n_name")).union(M.table(spark, d, "region").select("r_name")).distinct()
    return grammar.aliases(names, "name")


@register("topic_keys", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(lower(l_returnflag || l_linestatus))))[1:5], '+') AS topic FROM lineitem GROUP BY 1")
def topic_keys(spark, d):
    return M.table(spark, d, "lineitem").groupBy("l_orderkey").agg(T.topic_key(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("topic"))


@register("domain_filter", "SELECT doc_id FROM documents WHERE starts_with(lang, 'e') OR starts_with(source, 'e')")
def domain_filter(spark, d):
    return M.memories(spark, d).where(P.domain_prefix(F.col("domains"), "e")).select(F.col("memory_id").alias("doc_id"))


@register("hierarchical_domain_match", "SELECT a.n_name AS a, b.n_name AS b FROM (SELECT n_name, n_regionkey || ':' || n_nationkey AS dom FROM nation) a JOIN (SELECT n_name, CAST(n_regionkey AS VARCHAR) AS dom FROM nation) b ON a.dom = b.dom OR starts_with(a.dom, b.dom || ':') OR starts_with(b.dom, a.dom || ':')")
def hierarchical_domain_match(spark, d):
    n = M.table(spark, d, "nation")
    a = n.select(F.col("n_name").alias("a"), F.concat_ws(":", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")).alias("da"), F.col("n_regionkey").cast("string").alias("_k"))
    b = n.select(F.col("n_name").alias("b"), F.col("n_regionkey").cast("string").alias("db"))
    # the first segment is the join key: domains that match share it
    return a.join(b, F.col("_k") == F.substring_index("db", ":", 1)).where(P.domain_match(F.col("da"), F.col("db"))).select("a", "b")


@register("list_memories", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' OR source = 'en' ORDER BY n_chars DESC, doc_id LIMIT 100")
def list_memories(spark, d):
    from recallforge.operators import scans

    m = M.memories(spark, d).withColumn("updated_at", F.col("n_chars"))
    return scans.list_memories(m, domain="en").select(F.col("memory_id").alias("doc_id"), "n_chars")


_QT = """q AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'what is the current status right now'), (-2, 0, 'what happened during the outage'), (-3, 0, 'how many days between the two'), (-4, 0, 'what changed since last week'), (-5, 0, 'which came first, a or b'), (-6, 0, 'is there a recurring pattern')) v)"""


def _questions(spark, d):
    extra = [(-1, 0, "what is the current status right now"), (-2, 0, "what happened during the outage"), (-3, 0, "how many days between the two"), (-4, 0, "what changed since last week"), (-5, 0, "which came first, a or b"), (-6, 0, "is there a recurring pattern")]
    return M.table(spark, d, "conversations").select("conv_id", "turn", "text").unionByName(spark.createDataFrame(extra, "conv_id long, turn long, text string"))


# what the intents are worded with, for the SQL: intent, group, weight, words
_INTENT_WORDS = """(VALUES
(0, 0, 0.3, 'what is'), (0, 0, 0.3, 'what''s'), (0, 0, 0.3, 'what are'), (0, 1, 0.4, 'current'), (0, 2, 0.3, 'status'), (0, 2, 0.3, 'state of'),
(0, 3, 0.5, 'right now'), (0, 3, 0.5, 'at the moment'), (0, 3, 0.5, 'presently'), (0, 4, 0.3, 'latest'), (0, 4, 0.3, 'newest'), (0, 4, 0.3, 'most recent'),
(1, 0, 0.5, 'what was'), (1, 0, 0.5, 'what were'), (1, 1, 0.4, 'historically'), (1, 1, 0.4, 'in the past'), (1, 2, 0.4, 'back in'), (1, 2, 0.4, 'back when'),
(1, 3, 0.4, 'last month'), (1, 3, 0.4, 'last week'), (1, 3, 0.4, 'last year'), (1, 3, 0.4, 'last quarter'), (1, 4, 0.4, 'in january'), (1, 4, 0.4, 'in february'),
(1, 4, 0.4, 'in march'), (1, 4, 0.4, 'in april'), (1, 4, 0.4, 'in may'), (1, 4, 0.4, 'in june'), (1, 4, 0.4, 'in july'), (1, 4, 0.4, 'in august'),
(1, 4, 0.4, 'in september'), (1, 4, 0.4, 'in october'), (1, 4, 0.4, 'in november'), (1, 4, 0.4, 'in december'), (1, 5, 0.3, 'before'), (1, 5, 0.3, 'previously'),
(1, 5, 0.3, 'formerly'), (1, 6, 0.4, 'at that time'), (1, 6, 0.4, 'at the time'), (1, 7, 0.4, 'used to'),
(2, 0, 0.5, 'what happened'), (2, 0, 0.5, 'what occurred'), (2, 1, 0.4, 'incident'), (2, 1, 0.4, 'outage'), (2, 1, 0.4, 'event'), (2, 2, 0.4, 'during'), (2, 2, 0.4, 'timeline of'),
(2, 3, 0.5, 'sequence of events'), (2, 3, 0.5, 'chain of events'), (2, 4, 0.3, 'how did'), (2, 4, 0.3, 'how was'), (2, 5, 0.4, 'walk me through'), (2, 5, 0.4, 'walk through'), (2, 6, 0.4, 'reconstruct'), (2, 6, 0.4, 'recount'),
(3, 0, 0.7, 'what changed'), (3, 0, 0.7, 'what has changed'), (3, 0, 0.7, 'what''s changed'), (3, 1, 0.3, 'different'), (3, 1, 0.3, 'difference between'), (3, 1, 0.3, 'differences'), (3, 2, 0.4, 'compared to'), (3, 2, 0.4, 'versus'), (3, 2, 0.4, ' vs '),
(3, 3, 0.4, 'evolution'), (3, 3, 0.4, 'evolved'), (3, 3, 0.4, 'progression'), (3, 4, 0.3, 'transition'), (3, 4, 0.3, 'transitioned'), (3, 4, 0.3, 'shifted'), (3, 5, 0.5, 'before and after'),
(4, 0, 0.5, 'pattern'), (4, 1, 0.4, 'tend to'), (4, 1, 0.4, 'tendency'), (4, 2, 0.4, 'usually'), (4, 2, 0.4, 'typically'), (4, 2, 0.4, 'often'), (4, 3, 0.5, 'recurring'), (4, 3, 0.5, 'recurrence'), (4, 3, 0.5, 'repeating'), (4, 4, 0.3, 'common'), (4, 4, 0.3, 'frequent'),
(5, 0, 0.5, 'learned'), (5, 0, 0.5, 'lesson'), (5, 1, 0.5, 'insight'), (5, 2, 0.5, 'takeaway'), (5, 3, 0.4, 'best practice'), (5, 4, 0.4, 'recommendation'), (5, 5, 0.3, 'what should we'), (5, 5, 0.3, 'what can we'), (5, 6, 0.4, 'retrospective'), (5, 6, 0.4, 'reflection')) v(k, g, w, word)"""
_INTENT_SQL = f"""WITH {_QT}, v AS (SELECT * FROM {_INTENT_WORDS}), h AS (SELECT DISTINCT conv_id, turn, k, g, w FROM q JOIN v ON contains(lower(text), word)),
s AS (SELECT conv_id, turn, k, round(sum(w)::DOUBLE, 6) AS s FROM h GROUP BY ALL), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY s DESC, k) = 1)
SELECT q.conv_id, q.turn, coalesce((['current_state_lookup', 'historical_lookup', 'event_reconstruction', 'change_detection', 'pattern_lookup', 'strategic_reflection'])[b.k + 1], 'fact_lookup') AS intent, coalesce(least(1.0, b.s), 1.0)::DOUBLE AS confidence FROM q LEFT JOIN b ON b.conv_id = q.conv_id AND b.turn = q.turn"""


@register("intent_keywords", _INTENT_SQL)
def intent_keywords(spark, d):
    return _questions(spark, d).withColumn("_i", K.keyword_intent(F.col("text"))).select("conv_id", "turn", "_i.intent", "_i.confidence")


@register(
    "temporal_intent",
    rf"""WITH {_QT}, f AS (SELECT conv_id, turn, lower(text) AS t, CASE WHEN regexp_matches(lower(text), '\b(first|initial|earliest|original)\b') THEN 'first' WHEN regexp_matches(lower(text), '\b(last|newest|latest)\b') THEN 'last' END AS o, turn % 4 AS n FROM q)
    SELECT conv_id, turn, CASE WHEN regexp_matches(t, '\bhow\s+many\s+(days?|weeks?|months?|years?|hours?)|\bhow\s+long\s+(ago|since|before|after|has|had)|\b(days?|weeks?|months?|years?)\s+(between|since)|\bduration\s+(between|of)') THEN 'arithmetic'
    WHEN o IS NOT NULL AND (n >= 3 OR regexp_matches(t, '\b(order\s+of|order\s+from|in\s+what\s+order|chronolog)')) THEN 'ordinal_order' WHEN o IS NOT NULL AND (n = 2 OR regexp_matches(t, '\b(which|or|either)\b')) THEN 'ordinal_compare' WHEN o IS NOT NULL AND n = 1 THEN 'ordinal_single'
    WHEN regexp_matches(t, '\b(during|in\s+(january|february|march|april|may|june|july|august|september|october|november|december|\d{{4}})|between\s+\w+\s+and)\b') THEN 'range' WHEN regexp_matches(t, '\b(ago|since|last\s+(week|month|year)|this\s+(week|month|year)|earlier\s+today|earlier)\b') THEN 'relative_anchor' ELSE 'none' END AS intent FROM f""",
)
def temporal_intent(spark, d):
    low = F.lower("text")
    ordinal = F.when(low.rlike(r"\b(first|initial|earliest|original)\b"), "first").when(low.rlike(r"\b(last|newest|latest)\b"), "last")
    return _questions(spark, d).select("conv_id", "turn", K.temporal_intent(F.col("text"), ordinal, F.lit(False), F.lit(False), F.col("turn") % 4).alias("intent"))


@register("review_parsing", "SELECT o_orderkey, CAST(floor(o_totalprice / 5000) AS BIGINT) AS score, o_orderstatus AS severity, 'tests of ' || o_custkey AS covered, 'docs' || chr(10) || 'and more' AS missing, CASE WHEN o_orderkey % 2 = 0 THEN 'rename it' END AS changes FROM orders")
def review_parsing(spark, d):
    s = lambda c: F.col(c).cast("string")
    head = F.concat(F.lit("SCORE: "), F.floor(F.col("o_totalprice") / 5000).cast("string"), F.lit("/100\nSEVERITY: "), F.col("o_orderstatus"), F.lit("\nCOVERED:  tests of "), s("o_custkey"), F.lit("\nMISSING: docs\nand more"))
    text = F.concat(head, F.when(F.col("o_orderkey") % 2 == 0, "\nCHANGES: rename it ").otherwise(""))
    r = M.table(spark, d, "orders").select("o_orderkey", K.review(text).alias("r")).select("o_orderkey", "r.*")
    return r.withColumn("score", F.col("score").cast("long"))


@register("anchor_detection", "SELECT event_id, (['issue_id', 'issue_id', 'issue_id', 'issue_id', 'release', 'release', 'incident', 'incident', 'migration', 'migration', NULL])[CAST(event_id % 11 AS INT) + 1] AS anchor, (['ABC-12', '123', '77', '9', 'v1.2.3', '2.0', NULL, NULL, NULL, NULL, NULL])[CAST(event_id % 11 AS INT) + 1] AS id FROM events")
def anchor_detection(spark, d):
    said = ("see ABC-12 now", "fixes #123", "in PR 77", "pull request #9", "Deployed to v1.2.3", "released 2.0", "a Rollback came", "sev1 again", "schema migration", "cutover", "none of it")
    e = M.table(spark, d, "events").select("event_id", K.anchor(F.get(F.array(*map(F.lit, said)), (F.col("event_id") % 11).cast("int"))).alias("a"))
    return e.select("event_id", F.col("a.kind").alias("anchor"), "a.id")


@register("state_declarations", "SELECT event_id FROM events WHERE event_id % 5 < 3")
def state_declarations(spark, d):
    texts = F.array(*map(F.lit, ("x\nservice: mode = fast", "# T\n## Status\nopen", "  STATUS : done", "status unknown", "mode = fast")))
    return M.table(spark, d, "events").where(P.declares_state(F.get(texts, (F.col("event_id") % 5).cast("int")))).select("event_id")
