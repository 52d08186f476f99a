"""Queries: the question grammar, names, markers, retirement, contents by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallforge import model as M
from recallforge.catalog import register
from recallforge.functions import language as L, text as T
from recallforge.operators import classify as K, grammar, predicates as P, question as Q

_S = f"WITH {M.STATES_SQL}"


@register("confident_answers", "SELECT event_id, (['high', 'medium', 'low', 'abstain', 'none'])[CAST(event_id % 5 AS INT) + 1] AS level FROM events WHERE event_id % 5 < 2")
def confident_answers(spark, d):
    level = F.get(F.array(*map(F.lit, ("high", "medium", "low", "abstain", "none"))), (F.col("event_id") % 5).cast("int"))
    return M.table(spark, d, "events").select("event_id", level.alias("level")).where(Q.confident(F.col("level")))


# cue tags of questions, one kind of question for each remainder of an event's id
_TAGGED = (
    ("what is the current mode", "O B-ASK_CURRENT O B-ASK_CURRENT B-SCOPE"),
    ("what came before redis", "O O B-TEMPORAL_BEFORE B-REFERENT"),
    ("did mysql precede postgres", "O B-REFERENT B-TEMPORAL_BEFORE B-REFERENT"),
    ("what followed redis", "O B-TEMPORAL_AFTER B-REFERENT"),
    ("why did it move to redis", "B-CAUSAL_EXPLICIT O O O O B-REFERENT"),
    ("what was first", "O O B-ORDINAL_FIRST"),
    ("would redis stand", "B-MODAL_HYPOTHETICAL B-REFERENT O"),
    ("what was retired", "O O B-ASK_CHANGE"),
    ("hello there", "O O"),
)


@register(
    "question_forms",
    """SELECT event_id, r AS relation, i AS intent, u AS rule FROM events JOIN (VALUES (0, 'current', 'current', 'state_current'), (1, 'predecessor', 'predecessor', 'temporal_predecessor'), (2, 'before_named', 'before_named', 'temporal_before_named'), (3, 'after_named', 'sequence', 'temporal_after_named'), (4, 'cause_of', 'cause_of', 'causal_direct'), (5, 'first', 'origin', 'ordinal_first'), (6, 'would_be_current_if', NULL, 'modal_counterfactual'), (7, 'retired', 'retirement', 'ask_change')) v(k, r, i, u) ON event_id % 9 = k""",
)
def question_forms(spark, d):
    at = lambda n: F.get(F.array(*[F.split(F.lit(x[n]), " ") for x in _TAGGED]), (F.col("event_id") % 9).cast("int"))
    q = M.table(spark, d, "events").select("event_id", at(0).alias("tokens"), at(1).alias("tags"))
    return Q.forms(q, "event_id", "tokens", "tags").select("event_id", "relation", "intent", "rule")


_ASKED = """q AS (SELECT e.event_id AS question_id, user_id AS entity_id, event_type AS state_key, event_id AS x, CASE WHEN event_id % 2 = 0 THEN lead(event_id, 3) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) END AS y,
    (['current', 'origin', 'sequence', 'predecessor', 'interval', 'before_named', 'concurrent', 'cause_of', 'transitive_cause', 'retirement', 'other'])[CAST(event_id % 11 AS INT) + 1] AS intent FROM events e)"""


@register(
    "tlg_dispatch",
    f"""{_S}, {_ASKED}, s AS (SELECT *, lead(node_id) OVER w AS nx, lag(node_id) OVER w AS pv, lag(state_value) OVER w AS was FROM states WINDOW w AS (PARTITION BY entity_id, state_key ORDER BY created_at, node_id)),
    j AS (SELECT q.question_id, q.intent, q.x, q.y, sx.created_at AS xa, sy.created_at AS ya, sx.state_value AS xv, s.* FROM q LEFT JOIN s sx ON sx.node_id = q.x LEFT JOIN s sy ON sy.node_id = q.y LEFT JOIN s ON s.entity_id = q.entity_id AND s.state_key = q.state_key),
    a AS (SELECT question_id, any_value(intent) AS intent, CASE any_value(intent)
      WHEN 'current' THEN last(node_id ORDER BY created_at, node_id) WHEN 'origin' THEN first(node_id ORDER BY created_at, node_id)
      WHEN 'sequence' THEN max(nx) FILTER (node_id = x) WHEN 'predecessor' THEN max(pv) FILTER (node_id = x)
      WHEN 'interval' THEN first(node_id ORDER BY created_at, node_id) FILTER (created_at > least(xa, ya) AND created_at < greatest(xa, ya) AND ya IS NOT NULL)
      WHEN 'before_named' THEN any_value(CASE WHEN ya IS NULL THEN NULL WHEN xa <= ya THEN x ELSE y END)
      WHEN 'concurrent' THEN first(node_id ORDER BY created_at, node_id) FILTER (node_id <> x AND created_at BETWEEN xa - INTERVAL 7 DAY AND xa + INTERVAL 7 DAY)
      WHEN 'cause_of' THEN first(node_id ORDER BY created_at, node_id) FILTER (state_value = xv)
      WHEN 'transitive_cause' THEN first(node_id ORDER BY created_at, node_id) FILTER (created_at < xa)
      WHEN 'retirement' THEN first(node_id ORDER BY created_at, node_id) FILTER (was = xv AND state_value <> xv AND created_at > xa) END AS answer FROM j GROUP BY question_id)
    SELECT question_id, intent, answer, CASE WHEN intent = 'other' THEN 'none' WHEN answer IS NULL THEN 'abstain' ELSE 'high' END AS confidence FROM a""",
)
def tlg_dispatch(spark, d):
    from pyspark.sql import Window

    names = ("current", "origin", "sequence", "predecessor", "interval", "before_named", "concurrent", "cause_of", "transitive_cause", "retirement", "other")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = M.table(spark, d, "events").withColumn("_y", F.lead("event_id", 3).over(w))
    q = e.select(
        F.col("event_id").alias("question_id"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("state_key"), F.col("event_id").alias("x"), F.when(F.col("event_id") % 2 == 0, F.col("_y")).alias("y"),
        F.get(F.array(*map(F.lit, names)), (F.col("event_id") % 11).cast("int")).alias("intent"),
    )
    return Q.dispatch(q, M.states(spark, d))


@register(
    "tlg_still",
    f"""{_S}, s AS (SELECT *, lag(state_value) OVER w AS was, lead(node_id) OVER w IS NULL AS newest FROM states WINDOW w AS (PARTITION BY entity_id, state_key ORDER BY created_at, node_id)),
    q AS (SELECT event_id AS question_id, user_id AS entity_id, event_type AS state_key, CAST(floor(value / 10) AS BIGINT) AS value FROM events),
    a AS (SELECT question_id, first(node_id ORDER BY created_at, node_id) FILTER (was = value AND state_value <> value) AS gone, max(node_id) FILTER (newest AND state_value = value) AS now FROM q LEFT JOIN s USING (entity_id, state_key) GROUP BY 1)
    SELECT question_id, coalesce(gone, now) AS answer, CASE WHEN gone IS NOT NULL THEN 'high' WHEN now IS NOT NULL THEN 'medium' ELSE 'abstain' END AS confidence FROM a""",
)
def tlg_still(spark, d):
    s = M.states(spark, d)
    return Q.still(s.select(F.col("node_id").alias("question_id"), "entity_id", "state_key", F.col("state_value").alias("value")), s)


@register(
    "alias_expansion",
    "WITH n AS (SELECT n_name AS name FROM nation), a AS (SELECT 'N' || n_nationkey AS short, n_name AS full FROM nation WHERE n_nationkey % 2 = 0) SELECT name, name AS form FROM n UNION SELECT name, short FROM n JOIN a ON lower(a.full) = lower(name)",
)
def alias_expansion(spark, d):
    n = M.table(spark, d, "nation")
    al = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("short"), F.col("n_name").alias("full"))
    return Q.expand_aliases(n.select(F.col("n_name").alias("name")), al)


_HEADS = "(VALUES ('supersedes', 'the'), ('supersedes', 'ation'), ('retires', 'th'), ('refines', 'de'), ('refines', 'of')) h(transition, head)"


@register(
    "marker_intent_match",
    rf"""WITH w AS (SELECT DISTINCT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')) AS w FROM conversations),
    n AS (SELECT conv_id, turn, transition, count(DISTINCT head) AS n, CASE transition WHEN 'supersedes' THEN 3 WHEN 'retires' THEN 2 WHEN 'refines' THEN 1 ELSE 0 END AS r FROM w JOIN {_HEADS} ON starts_with(w, head) GROUP BY ALL)
    SELECT conv_id * 1000 + turn AS k, transition FROM n QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, r DESC) = 1""",
)
def marker_intent_match(spark, d):
    heads = spark.createDataFrame([("supersedes", "the"), ("supersedes", "ation"), ("retires", "th"), ("refines", "de"), ("refines", "of")], "transition string, head string")
    q = M.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    return Q.marker_intent(q, heads, "k", "text")


@register("retired_silently", "WITH s AS (SELECT l_orderkey AS id, list(DISTINCT l_returnflag || l_linestatus || l_linenumber) AS x FROM lineitem GROUP BY 1) SELECT a.id, len(list_filter(a.x, lambda v: NOT list_contains(b.x, v))) AS gone, len(list_filter(a.x, lambda v: list_contains(b.x, v))) AS kept FROM s a JOIN s b ON b.id = a.id + 1")
def retired_silently(spark, d):
    item = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    s = M.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(item).alias("x"))
    j = s.withColumnRenamed("x", "src").join(s.select((F.col("id") - 1).alias("id"), F.col("x").alias("dst")), "id")
    gone = Q.silent(F.col("src"), F.col("dst"))
    return j.select("id", F.size(gone).cast("long").alias("gone"), F.size(Q.without_new(F.col("src"), F.col("dst"), F.col("src"))).cast("long").alias("kept"))


@register(
    "verb_heads",
    r"""WITH p AS (SELECT * FROM (VALUES ('\b(moves?)\s+(?:from|to)\b'), ('\b(retire[ds]?)\s+\w+\b'), ('\b(supersedes?)\s+\w+\b'), ('\b(replaces?)\s+\w+\b'), ('\b(deprecat(?:es|ed|ing))\s+\w+\b'), ('\b(add(?:s|ed)?)\s+\w+\b'), ('\b(extend[sd]?)\s+\w+\b'), ('\b(introduce[sd]?)\s+\w+\b'), ('\b(started|begins?|initiated|launched?)\b'), ('\b(performed|completed|concluded)\b'), ('\b(identified|reported|resolved|confirmed|cleared)\b'), ('\b(scheduled|planned)\b')) v(p)),
    t AS (SELECT row_number() OVER () AS k, 0 AS n, (['it moves to', 'was retired now', 'supersedes it', 'added x and planned', 'no verb here', 'completed, resolved'])[CAST(l_partkey % 6 AS INT) + 1] || ' ' || p_name AS t FROM lineitem JOIN part ON p_partkey = l_partkey),
    h AS (SELECT DISTINCT t.k, t.n, unnest(regexp_extract_all(t.t, p.p, 1)) AS h FROM t, p)
    SELECT h AS head, count(*) AS n FROM h GROUP BY 1""",
)
def verb_heads(spark, d):
    words = F.array(*map(F.lit, ("it moves to", "was retired now", "supersedes it", "added x and planned", "no verb here", "completed, resolved")))
    p = M.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    t = M.table(spark, d, "lineitem").select("l_partkey").join(p, "l_partkey").select(F.concat_ws(" ", F.get(words, (F.col("l_partkey") % 6).cast("int")), "p_name").alias("t"))
    return t.select(F.explode(T.verb_heads(F.col("t"))).alias("head")).groupBy("head").agg(F.count("*").alias("n"))


_MARKED = "(['moves to new', 'completed it', 'started it', 'added a table', 'retired the old', 'resolved'])[CAST(l_suppkey % 6 AS INT) + 1]"
_HEAD = "(['moves', 'completed', 'started', 'added', 'retired', 'resolved'])[CAST(l_suppkey % 6 AS INT) + 1]"


def _marked(spark, d):
    words = F.array(*map(F.lit, ("moves to new", "completed it", "started it", "added a table", "retired the old", "resolved")))
    return M.table(spark, d, "lineitem").withColumn("content", F.get(words, (F.col("l_suppkey") % 6).cast("int")))


@register("edge_markers", f"WITH n AS (SELECT l_returnflag AS transition, {_HEAD} AS head, count(*) AS n FROM lineitem GROUP BY ALL) SELECT transition, head, n FROM n a WHERE n > ALL (SELECT n FROM n b WHERE b.head = a.head AND b.transition <> a.transition)")
def edge_markers(spark, d):
    return grammar.edge_markers(_marked(spark, d).withColumnRenamed("l_returnflag", "transition").select("transition", "content"))


@register(
    "content_markers",
    f"""WITH c AS (SELECT {_HEAD} AS head, count(*) FILTER (l_linestatus = 'F' AND l_suppkey % 6 < 3) AS t, count(*) FILTER (NOT (l_linestatus = 'F' AND l_suppkey % 6 < 3) AND l_linenumber = 1) AS r, count(*) FILTER (NOT (l_linestatus = 'F' AND l_suppkey % 6 < 3) AND l_linenumber <> 1) AS m FROM lineitem GROUP BY 1)
    SELECT head, 'current' AS side FROM c WHERE t >= 2 AND t >= 0.5 * (m + r) UNION ALL SELECT head, 'origin' FROM c WHERE r >= 2 AND r >= 0.5 * (m + t)""",
)
def content_markers(spark, d):
    term = (F.col("l_linestatus") == "F") & (F.col("l_suppkey") % 6 < 3)
    m = _marked(spark, d).select("content", term.alias("is_terminal"), (~term & (F.col("l_linenumber") == 1)).alias("is_root"))
    return grammar.content_markers(m, purity=0.5).select("head", "side")


@register(
    "retirement_lookup",
    """WITH q AS (SELECT DISTINCT p_type AS entity FROM part), e AS (SELECT o_orderkey AS edge_id, o_orderdate AS od, (['Economy', 'promo', 'STANDARD', 'smalls', 'xyz'])[CAST(o_custkey % 5 AS INT) + 1] AS r FROM orders)
    SELECT entity, first(edge_id ORDER BY od, edge_id) AS edge_id FROM q JOIN e ON lower(r) = lower(entity) OR (length(r) >= 4 AND length(entity) >= 4 AND (starts_with(lower(r), lower(entity)) OR starts_with(lower(entity), lower(r)))) GROUP BY 1""",
)
def retirement_lookup(spark, d):
    words = F.array(*map(F.lit, ("Economy", "promo", "STANDARD", "smalls", "xyz")))
    e = M.table(spark, d, "orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_orderdate").alias("at"), F.array(F.get(words, (F.col("o_custkey") % 5).cast("int"))).alias("retires"))
    return grammar.retirement(M.table(spark, d, "part").select(F.col("p_type").alias("entity")).distinct(), e)


@register(
    "state_meta",
    r"""WITH t AS (SELECT event_id, CAST(event_id % 7 AS INT) AS k, user_id AS u, CAST(floor(value) AS BIGINT) AS v FROM events)
    SELECT event_id, CASE k WHEN 0 THEN 'db' || u WHEN 1 THEN 'svc' WHEN 2 THEN 'svc' WHEN 3 THEN 'api' WHEN 4 THEN 'E' || u WHEN 5 THEN 'E' || u WHEN 6 THEN 'E' || u END AS entity,
    CASE k WHEN 0 THEN 'mode' WHEN 1 THEN 'port' WHEN 2 THEN 'port' WHEN 3 THEN 'limit' WHEN 4 THEN 'status' WHEN 5 THEN 'status' ELSE 'state' END AS key,
    CASE k WHEN 0 THEN 'v' || v WHEN 1 THEN CAST(v AS VARCHAR) WHEN 2 THEN CAST(v AS VARCHAR) WHEN 3 THEN CAST(v AS VARCHAR) WHEN 4 THEN 'accepted' WHEN 5 THEN 'open' ELSE 'ratio → ' || v END AS value,
    CASE k WHEN 1 THEN 'old' WHEN 2 THEN 'old' END AS previous FROM t""",
)
def state_meta(spark, d):
    u, v = F.col("user_id").cast("string"), F.floor("value").cast("string")
    texts = [
        F.concat(F.lit("note\ndb"), u, F.lit(": mode = v"), v), F.concat(F.lit("svc port changed from old to "), v, F.lit(" because of load")), F.concat(F.lit("svc: port updated from old to "), v, F.lit(" per request")),
        F.concat(F.lit("api limit is "), v), F.concat(F.lit("# About E"), u, F.lit("\n\ntext\n## Status\n\naccepted\n")), F.lit("x\n  Status : open"), F.concat(F.lit("plain\nratio → "), v),
    ]
    e = M.table(spark, d, "events").select("event_id", F.get(F.array(*texts), (F.col("event_id") % 7).cast("int")).alias("t"), F.array(F.concat(F.lit("E"), u), F.lit("other")).alias("entities"))
    return e.select("event_id", K.state_meta(F.col("t"), F.col("entities")).alias("m")).select("event_id", "m.entity", "m.key", "m.value", "m.previous")


@register("resolution_closure", "SELECT event_id, (['resolved', 'merged', 'done'])[CAST(event_id % 5 AS INT) + 1] AS marker FROM events WHERE event_id % 5 < 3")
def resolution_closure(spark, d):
    words = F.array(*map(F.lit, ("Issue RESOLVED now", "the PR was Merged", "all done", "still open", "in progress")))
    e = M.table(spark, d, "events").select("event_id", K.resolution(F.get(words, (F.col("event_id") % 5).cast("int"))).alias("marker"))
    return e.where("marker is not null")


@register(
    "arithmetic_answers",
    """WITH q AS (SELECT event_id, CAST(event_id % 5 AS INT) AS k, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1e6 AS s FROM events)
    SELECT event_id, (['between', 'age_of', 'since', 'age_of'])[k + 1] AS operation, (['days', 'days', 'weeks', 'hours'])[k + 1] AS unit, round(s / ([86400.0, 86400.0, 604800.0, 3600.0])[k + 1]::DOUBLE, 1) AS value FROM q WHERE k < 4""",
)
def arithmetic_answers(spark, d):
    from recallforge.functions import scores

    words = F.array(*map(F.lit, ("How many days between A and B?", "how long ago was it", "How many weeks since A", "how many hours it took", "what is it")))
    e = M.table(spark, d, "events").select("event_id", K.arithmetic(F.get(words, (F.col("event_id") % 5).cast("int"))).alias("a"), scores.seconds_between(M.now(), F.col("ts")).alias("s")).where("a is not null")
    return e.select("event_id", "a.operation", "a.unit", K.duration(F.col("s"), F.col("a.unit")).alias("value"))


@register("junk_names", r"SELECT c_custkey, n AS name FROM (SELECT c_custkey, (['85%', '1 item(s)', '2783 chars', '6f01603fe96a', 'Document: x', 'S5', 'avg 85%', 'x', 'Postgres', 'v1.2'])[CAST(c_custkey % 10 AS INT) + 1] AS n FROM customer) WHERE c_custkey % 10 < 8")
def junk_names(spark, d):
    names = F.array(*map(F.lit, ("85%", "1 item(s)", "2783 chars", "6f01603fe96a", "Document: x", "S5", "avg 85%", "x", "Postgres", "v1.2")))
    c = M.table(spark, d, "customer").select("c_custkey", F.get(names, (F.col("c_custkey") % 10).cast("int")).alias("name"))
    return c.where(P.junk_name(F.col("name")))


@register("first_sentences", r"WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents), p AS (SELECT *, instr(t, '.') AS a, instr(t, '!') AS b, instr(t, '?') AS c, instr(t, chr(10)) AS e, t[1:80] AS h FROM t) SELECT doc_id, sha256(CASE WHEN t = '' THEN '' WHEN a BETWEEN 2 AND 80 THEN t[1:a] WHEN b BETWEEN 2 AND 80 THEN t[1:b] WHEN c BETWEEN 2 AND 80 THEN t[1:c] WHEN e BETWEEN 2 AND 80 THEN regexp_replace(t[1:e], '\s+$', '') WHEN length(t) <= 80 THEN t WHEN instr(h, ' ') > 0 AND length(h) - instr(reverse(h), ' ') > 40 THEN h[1:length(h) - instr(reverse(h), ' ')] || '...' ELSE h || '...' END) AS digest FROM p")
def first_sentences(spark, d):
    return M.table(spark, d, "documents").select("doc_id", F.sha2(T.first_sentence(F.col("text")), 256).alias("digest"))


@register("question_terms", r"SELECT conv_id, turn, len(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda t: regexp_replace(t, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda t: length(t) >= 2))) AS n FROM conversations")
def question_terms(spark, d):
    return M.table(spark, d, "conversations").select("conv_id", "turn", F.size(T.terms(F.col("text"))).cast("long").alias("n"))


@register("skeleton_cache", "WITH u AS (SELECT event_type || ' ' || user_id % 5 AS skeleton, (['a', 'b', 'c'])[CAST(event_id % 3 AS INT) + 1] AS intent FROM events), n AS (SELECT skeleton, intent, count(*) AS n FROM u GROUP BY ALL), b AS (SELECT skeleton, first(intent ORDER BY n DESC, intent) AS i, sum(n) AS h FROM n GROUP BY 1), c AS (SELECT 'click ' || r_regionkey AS skeleton, 'old' AS intent, 10 AS hits FROM region UNION ALL SELECT 'gone', 'old', 3) SELECT skeleton, coalesce(intent, i) AS intent, CAST(coalesce(hits, 0) + coalesce(h, 0) AS BIGINT) AS hits FROM c FULL JOIN b USING (skeleton)")
def skeleton_cache(spark, d):
    r = M.table(spark, d, "region").select(F.concat(F.lit("click "), F.col("r_regionkey").cast("string")).alias("skeleton"), F.lit("old").alias("intent"), F.lit(10).cast("long").alias("hits"))
    cache = r.unionByName(spark.createDataFrame([("gone", "old", 3)], "skeleton string, intent string, hits long"))
    used = M.table(spark, d, "events").select(F.concat_ws(" ", "event_type", (F.col("user_id") % 5).cast("string")).alias("skeleton"), F.get(F.array(*map(F.lit, "abc")), (F.col("event_id") % 3).cast("int")).alias("intent"))
    return L.remember(cache, used)


@register("causal_edges", "SELECT b.o_orderkey AS effect, a.o_orderkey AS cause, 0.9::DOUBLE AS confidence FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1")
def causal_edges(spark, d):
    o = M.table(spark, d, "orders").select("o_orderkey")
    pairs = o.select(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("cause"), F.concat(F.lit("ORDER "), (F.col("o_orderkey") + 1).cast("string")).alias("effect"), F.lit(0.9).alias("confidence"))
    return L.causal_edges(pairs, o.select(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("surface"), F.col("o_orderkey").alias("memory_id")))
