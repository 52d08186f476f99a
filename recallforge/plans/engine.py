"""Queries: whole searches through the engine, with every signal."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from recallforge import model as M
from recallforge.catalog import register
from recallforge.engine import Engine
from recallforge.operators import graph, retrieval
from recallforge.operators.scoring import Weights

QUESTION = "the state of small ring or red widget with the edition in 1997"
_TERMS = ", ".join(f"'{t}'" for t in sorted(set(QUESTION.split())))
WEIGHTS = Weights(activation=0.05, hierarchy=0.3)
_NOW = datetime.fromisoformat(M.NOW)

_SCORED = rf"""WITH {M.LINKS_SQL}, {M.ACCESSES_SQL}, mem AS (SELECT doc_id AS memory_id, text, o_orderdate AS created_at, o_orderstatus AS st FROM documents LEFT JOIN orders ON o_orderkey = doc_id),
toks AS (SELECT memory_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS t FROM mem), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
p AS (SELECT memory_id, dl, term, count(*) AS tf FROM (SELECT memory_id, len(t) AS dl, unnest(t) AS term FROM toks) WHERE term IN ({_TERMS}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
f AS (SELECT memory_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25, count(*)::DOUBLE AS sparse FROM p JOIN df USING (term), st GROUP BY memory_id),
fu AS (SELECT memory_id FROM (SELECT memory_id FROM f ORDER BY bm25 DESC, memory_id LIMIT 50) UNION SELECT memory_id FROM (SELECT memory_id FROM f ORDER BY sparse DESC, memory_id LIMIT 50)),
c1 AS (SELECT memory_id FROM fu LEFT JOIN orders ON o_orderkey = memory_id WHERE o_orderdate IS NULL OR (o_orderdate < TIMESTAMP '1997-12-31 23:59:59' AND o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1997-01-01')),
few AS (SELECT memory_id, entity_id FROM links QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY entity_id) <= 12),
co AS (SELECT a.entity_id AS src, b.entity_id AS dst, count(*) / (count(*) + 1)::DOUBLE AS weight FROM few a JOIN few b ON a.memory_id = b.memory_id AND a.entity_id < b.entity_id GROUP BY ALL),
e AS (SELECT src, dst, weight FROM co UNION ALL SELECT dst, src, weight FROM co),
own AS (SELECT DISTINCT entity_id FROM links WHERE memory_id IN (FROM c1)), near AS (SELECT entity_id FROM own UNION SELECT dst FROM e WHERE src IN (FROM own)),
c2 AS (SELECT memory_id FROM c1 UNION ALL SELECT * FROM (SELECT DISTINCT memory_id FROM links WHERE entity_id IN (FROM near) AND memory_id NOT IN (FROM c1) ORDER BY memory_id LIMIT 10)),
ctx AS (SELECT min(p_partkey) AS node FROM part WHERE lower(p_name) IN ('small ring', 'red widget') GROUP BY lower(p_name)),
fe AS (SELECT src, dst, weight * 0.5 * CASE WHEN d > 4 THEN 1 / log2(d) ELSE 1 END AS f FROM e JOIN (SELECT src, count(*) AS d FROM e GROUP BY 1) USING (src)),
a0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM ctx) AS a FROM ctx),
a1 AS (SELECT dst AS node, max(a * f) AS a FROM a0 JOIN fe ON src = node WHERE a * f >= 0.001 GROUP BY 1), a2 AS (SELECT dst AS node, max(a * f) AS a FROM a1 JOIN fe ON src = node WHERE a * f >= 0.001 GROUP BY 1),
act AS (SELECT node, max(a) AS a FROM (FROM a0 UNION ALL FROM a1 UNION ALL FROM a2) GROUP BY 1),
g AS (SELECT memory_id, coalesce(sum(a), 0) / greatest(1, count(*) + (SELECT count(*) FROM ctx) - count(ctx.node)) AS graph FROM links LEFT JOIN act ON act.node = entity_id LEFT JOIN ctx ON ctx.node = entity_id GROUP BY 1),
b AS (SELECT memory_id, coalesce(ln(sum(CASE WHEN age > 0 THEN pow(age, -0.5) END)), -10) AS activation FROM (SELECT memory_id, (epoch_us(TIMESTAMP '{M.NOW}') - epoch_us(accessed_at)) / 1e6 AS age FROM accesses) GROUP BY 1),
s AS (SELECT memory_id, coalesce(bm25, 0) AS bm25, coalesce(sparse, 0) AS sparse, coalesce(graph, 0) AS graph, coalesce(activation, -10) AS activation,
  CASE WHEN created_at IS NULL THEN 0 WHEN created_at BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31 23:59:59' THEN 1
    ELSE exp(-0.5 * pow(greatest(epoch_us(TIMESTAMP '1997-01-01') - epoch_us(created_at), epoch_us(created_at) - epoch_us(TIMESTAMP '1997-12-31 23:59:59')) / (epoch_us(TIMESTAMP '1997-12-31 23:59:59') - epoch_us(TIMESTAMP '1997-01-01'))::DOUBLE, 2)) END AS temporal,
  CASE WHEN created_at IS NULL THEN 0 ELSE exp(-ln(2) * (epoch_us(TIMESTAMP '{M.NOW}') - epoch_us(created_at)) / 1e6 / 86400 / 30) END AS recency, coalesce(st = 'P', false) AS superseded, coalesce(st = 'F', false) AS state
  FROM c2 JOIN mem USING (memory_id) LEFT JOIN f USING (memory_id) LEFT JOIN g USING (memory_id) LEFT JOIN b USING (memory_id)),
m AS (SELECT max(bm25) AS mb, max(sparse) AS ms, CASE WHEN max(graph) = 0 THEN 1 ELSE max(graph) END AS mg, CASE WHEN max(temporal) = 0 THEN 1 ELSE max(temporal) END AS mt FROM s),
r AS (SELECT s.*, round(0.4 * bm25 / mb + 0.2 * sparse / ms + 0.5 * graph / mg + 0.1 * recency + 0.05 * activation + 0.3 * CASE WHEN state THEN 0.5 ELSE 0 END + 0.2 * temporal / mt - CASE WHEN superseded THEN 0.3 ELSE 0 END, 9) AS score
  FROM s, m WHERE 1 / (1 + exp(-(activation + 2) / 0.4)) >= 0.05)"""


def _engine(spark, d) -> Engine:
    docs, orders = M.table(spark, d, "documents"), M.table(spark, d, "orders")
    placed = orders.select(F.col("o_orderkey").alias("memory_id"), F.col("o_orderdate").alias("created_at"), "o_orderstatus")
    # links as the table has them, each perhaps several times: a search reads few of them
    links = M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("memory_id"), F.col("l_partkey").alias("entity_id"))
    i = F.col("node_id")

    def edges(nodes):
        return graph.cooccurrence_at(links, nodes).select("src", "dst", (F.col("count") / (F.col("count") + 1)).alias("weight"))

    class Named:
        def signals(self, query):
            return retrieval.signals(docs, "doc_id", "text", query).withColumnRenamed("doc_id", "memory_id")

    memories = docs.select(F.col("doc_id").alias("memory_id"), F.col("text").alias("content"))
    return Engine(
        memories, links, M.states(spark, d).withColumn("memory_id", i % 191),
        ranges=placed.select("memory_id", F.col("created_at").alias("range_start"), (F.col("created_at") + F.expr("interval 30 days")).alias("range_end")),
        nodes=placed.select("memory_id", F.when(F.col("o_orderstatus") == "F", "entity_state").otherwise("episode").alias("node_type"), (F.col("o_orderstatus") != "P").alias("is_current")),
        weights=WEIGHTS, index=Named(), edges=edges, times=placed.select("memory_id", "created_at"), accesses=M.accesses(spark, d), entities=M.table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name")),
    )


_PARTS = ("graph", "temporal", "activation")


@register("engine_search", f"{_SCORED} SELECT memory_id, round(score, 6) AS score, round(graph / mg, 6) AS graph, round(temporal / mt, 6) AS temporal, round(activation, 6) AS activation, superseded FROM r, m ORDER BY r.score DESC, memory_id LIMIT 20")
def engine_search(spark, d):
    """A search with full-text, term, graph, temporal, activation, recency, hierarchy and
    reconciliation signals, within the range that the question names."""
    found = _engine(spark, d).scored(QUESTION, now=_NOW, intent="current_state_lookup")
    return retrieval.top(found, "memory_id", 20).select("memory_id", *[F.round(c, 6).alias(c) for c in ("score", *_PARTS)], "superseded")


@register(
    "engine_recall",
    f"""{_SCORED}, {M.STATES_SQL}, hits AS (SELECT memory_id, round(score, 6) AS score, row_number() OVER (ORDER BY r.score DESC, memory_id) AS place FROM r QUALIFY place <= 25),
    ent AS (SELECT node AS entity_id, row_number() OVER (ORDER BY p_name) - 1 AS nth FROM ctx JOIN part ON p_partkey = node),
    cur AS (SELECT entity_id, node_id % 191 AS memory_id, node_id, created_at, nth FROM states JOIN ent USING (entity_id) QUALIFY row_number() OVER (PARTITION BY entity_id, state_key ORDER BY created_at DESC, node_id DESC) = 1),
    fresh AS (SELECT memory_id, min((nth, created_at, node_id)) AS first FROM cur WHERE memory_id NOT IN (SELECT memory_id FROM hits) AND memory_id IN (SELECT memory_id FROM mem) GROUP BY 1),
    allr AS (SELECT place, memory_id, score, 'current_state_lookup' AS path FROM hits UNION ALL
      SELECT (SELECT count(*) FROM hits) + row_number() OVER (ORDER BY first) AS place, memory_id, 0.0, 'state_lookup_bonus' FROM fresh QUALIFY place <= 25)
    SELECT CAST(place AS BIGINT) AS place, memory_id, CAST(score AS DOUBLE) AS score, path, (SELECT count(DISTINCT entity_id) FROM links l WHERE l.memory_id = a.memory_id) AS entities FROM allr a""",
)
def engine_recall(spark, d):
    """Search results and the memories behind current states of what the question names."""
    found = _engine(spark, d).recall(QUESTION, limit=25, now=_NOW, intent="current_state_lookup")
    return found.select(F.col("place").cast("long").alias("place"), "memory_id", F.round("score", 6).alias("score"), "path", F.size("entities").cast("long").alias("entities"))
