"""Queries: entity states in time, episodes, snapshots."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from recallforge import model as M
from recallforge.catalog import register
from recallforge.functions import scores as S
from recallforge.operators import bitemporal, grammar, predicates as P, ranking, scans, state
from recallforge.shared import cut

_S = f"WITH {M.STATES_SQL}"
_AT = "TIMESTAMP '2024-01-15 00:00:00'"


def _at(text="2024-01-15 00:00:00"):
    return F.lit(text).cast("timestamp_ntz")


def _pick(df):
    return df.select("entity_id", "state_key", "node_id", "state_value", "created_at")


@register("current_state", f"{_S} SELECT entity_id, state_key, node_id, state_value, created_at FROM states QUALIFY row_number() OVER (PARTITION BY entity_id, state_key ORDER BY created_at DESC, node_id DESC) = 1")
def current_state(spark, d):
    return _pick(state.current(M.states(spark, d)))


@register("state_as_of", f"{_S} SELECT entity_id, state_key, node_id, state_value, created_at FROM states WHERE created_at <= {_AT} QUALIFY row_number() OVER (PARTITION BY entity_id, state_key ORDER BY created_at DESC, node_id DESC) = 1")
def state_as_of(spark, d):
    return _pick(state.as_of(M.states(spark, d), _at()))


@register(
    "state_as_of_probes",
    f"""{_S}, p AS (SELECT event_id AS probe_id, user_id AS entity_id, 'purchase' AS state_key, ts AS moment FROM events WHERE event_type = 'error')
    SELECT probe_id, p.entity_id, p.state_key, moment, node_id, state_value FROM p ASOF JOIN (SELECT * FROM states WHERE state_key = 'purchase') s ON p.entity_id = s.entity_id AND p.state_key = s.state_key AND p.moment >= s.created_at""",
)
def state_as_of_probes(spark, d):
    probes = M.table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("probe_id"), F.col("user_id").alias("entity_id"), F.lit("purchase").alias("state_key"), F.col("ts").alias("moment"))
    return state.as_of_probes(M.states(spark, d).where("state_key = 'purchase'"), probes, at="moment").select("probe_id", "entity_id", "state_key", "moment", "node_id", "state_value")


_BI = f"""{_S}, b AS (SELECT node_id, entity_id, state_key, state_value, created_at, CASE WHEN node_id % 7 <> 0 THEN created_at + to_hours(CAST(node_id % 11 AS INTEGER)) END AS valid_from,
CASE WHEN node_id % 3 <> 0 THEN created_at + to_hours(CAST(node_id % 400 AS INTEGER)) END AS valid_to FROM states),
p AS (SELECT event_id AS probe_id, user_id AS entity_id, state_key, ts AS moment FROM events, (SELECT DISTINCT state_key FROM states) WHERE event_type = 'error')"""


@register(
    "state_as_of_bitemporal",
    f"""{_BI}, v AS (SELECT probe_id, arg_max(node_id, (valid_from, node_id)) AS node_id FROM p JOIN b USING (entity_id, state_key) WHERE valid_from <= moment AND (valid_to IS NULL OR valid_to > moment) GROUP BY probe_id, state_key),
    c AS (SELECT probe_id, state_key, arg_max(node_id, (created_at, node_id)) AS node_id FROM p JOIN b USING (entity_id, state_key) WHERE created_at <= moment GROUP BY probe_id, state_key),
    k AS (SELECT probe_id, state_key, node_id FROM v JOIN b USING (node_id))
    SELECT probe_id, state_key, coalesce(k.node_id, c.node_id) AS node_id, k.node_id IS NOT NULL AS by_validity, state_value
    FROM p LEFT JOIN k USING (probe_id, state_key) LEFT JOIN c USING (probe_id, state_key) JOIN (SELECT node_id, state_value FROM b) b ON b.node_id = coalesce(k.node_id, c.node_id)""",
)
def state_as_of_bitemporal(spark, d):
    """States that overlap, end, or have no validity, asked for under every key."""
    s, i = M.states(spark, d), F.col("node_id")
    s = s.withColumns({
        "valid_from": F.when(i % 7 != 0, F.col("created_at") + F.make_dt_interval(hours=(i % 11).cast("int"))),
        "valid_to": F.when(i % 3 != 0, F.col("created_at") + F.make_dt_interval(hours=(i % 400).cast("int"))),
    })
    keys = s.select("state_key").distinct()  # the kinds of event
    probes = M.table(spark, d, "events").where("event_type = 'error'").join(F.broadcast(keys)).withColumn("probe", F.monotonically_increasing_id())
    probes = cut(probes.select("probe", F.col("event_id").alias("probe_id"), F.col("user_id").alias("entity_id"), "state_key", F.col("ts").alias("moment")))
    found = bitemporal.as_of(s, probes, state.SUBJECT, "probe", "moment")
    return found.join(probes, "probe").join(s.select("node_id", "state_value"), "node_id").select("probe_id", "state_key", "node_id", "by_validity", "state_value")


@register("state_history", f"{_S} SELECT node_id, state_value, created_at, lag(state_value) OVER (ORDER BY created_at, node_id) AS before FROM states WHERE entity_id = 3 AND state_key = 'click'")
def state_history(spark, d):
    w = Window.partitionBy(*state.SUBJECT).orderBy("created_at", "node_id")
    return M.states(spark, d).where("entity_id = 3 and state_key = 'click'").withColumn("before", F.lag("state_value").over(w)).select("node_id", "state_value", "created_at", "before")


@register("state_changes_since", f"{_S} SELECT * FROM states WHERE created_at > TIMESTAMP '2024-01-29 00:00:00'")
def state_changes_since(spark, d):
    return M.states(spark, d).where(F.col("created_at") > _at("2024-01-29 00:00:00"))


@register("state_intervals", f"{_S} SELECT node_id, created_at AS valid_from, lead(created_at) OVER w AS valid_to, lead(created_at) OVER w IS NULL AS is_current FROM states WINDOW w AS (PARTITION BY entity_id, state_key ORDER BY created_at, node_id)")
def state_intervals(spark, d):
    return state.intervals(M.states(spark, d)).select("node_id", "valid_from", "valid_to", "is_current")


_REC = f"""{_S}, l AS (SELECT *, lag(node_id) OVER w AS prev_id, lag(state_value) OVER w AS prev_value FROM states WINDOW w AS (PARTITION BY entity_id, state_key ORDER BY created_at, node_id)),
rec AS (SELECT node_id, prev_id, CASE WHEN prev_id IS NULL THEN 'unrelated' WHEN prev_value = state_value THEN 'supports' ELSE 'supersedes' END AS relation, CASE WHEN prev_id IS NULL THEN 0.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM l)"""


@register("reconcile_relations", f"{_REC} SELECT * FROM rec")
def reconcile_relations(spark, d):
    return state.reconcile(M.states(spark, d)).select("node_id", "prev_id", "relation", "confidence")


@register(
    "reconcile_scoped",
    """WITH s AS (SELECT event_id AS node_id, user_id, event_type, CAST(floor(value / 10) AS BIGINT) AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS scope, ts FROM events),
    l AS (SELECT *, lag(node_id) OVER w AS prev_id, lag(v) OVER w AS pv, lag(scope) OVER w AS ps FROM s WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, node_id))
    SELECT CASE WHEN prev_id IS NULL THEN 'unrelated' WHEN pv = v AND ps <> scope THEN 'refines' WHEN pv = v THEN 'supports' WHEN ps <> scope THEN 'conflicts' ELSE 'supersedes' END AS relation, count(*) AS n FROM l GROUP BY 1""",
)
def reconcile_scoped(spark, d):
    s = M.states(spark, d)
    scope = M.table(spark, d, "events").select(F.col("event_id").alias("node_id"), (F.get_json_object("props", "$.k").cast("long") % 3).alias("scope"))
    return state.reconcile(s.join(scope, "node_id"), "scope").groupBy("relation").agg(F.count("*").alias("n"))


@register("reconcile_edges", f"{_REC} SELECT edge_type, count(*) AS n, CAST(sum(source_id - target_id) AS BIGINT) AS gap FROM (SELECT node_id AS source_id, prev_id AS target_id, relation AS edge_type FROM rec WHERE relation <> 'unrelated' UNION ALL SELECT prev_id, node_id, 'superseded_by' FROM rec WHERE relation = 'supersedes') GROUP BY edge_type")
def reconcile_edges(spark, d):
    e = state.edges(state.reconcile(M.states(spark, d)))
    return e.groupBy("edge_type").agg(F.count("*").alias("n"), F.sum(F.col("source_id") - F.col("target_id")).alias("gap"))


@register("supports_importance", f"{_REC}, t AS (SELECT node_id AS id FROM rec WHERE relation = 'supports' UNION ALL SELECT prev_id FROM rec WHERE relation = 'supports') SELECT id AS node_id, least(10.0::DOUBLE, 5.0 + 0.5 * count(*)) AS importance FROM t GROUP BY id")
def supports_importance(spark, d):
    r = state.reconcile(M.states(spark, d)).where("relation = 'supports'")
    ids = r.select("node_id").unionByName(r.select(F.col("prev_id").alias("node_id")))
    return ids.groupBy("node_id").agg(F.least(F.lit(10.0), 5.0 + 0.5 * F.count("*")).alias("importance"))


@register("entities_with_state_count", f"{_S} SELECT entity_id, count(*) AS cnt FROM states GROUP BY entity_id HAVING count(*) >= 60")
def entities_with_state_count(spark, d):
    return M.states(spark, d).groupBy("entity_id").agg(F.count("*").alias("cnt")).where("cnt >= 60")


@register("trajectories", f"{_S} SELECT entity_id, state_key, count(*) AS n, first(state_value ORDER BY created_at, node_id) AS first_value, last(state_value ORDER BY created_at, node_id) AS last_value, string_agg(CAST(state_value AS VARCHAR), '>' ORDER BY created_at, node_id) AS path FROM states GROUP BY ALL HAVING count(*) >= 3")
def trajectories(spark, d):
    t = state.trajectories(M.states(spark, d))
    step = F.col("steps")
    return t.select("entity_id", "state_key", F.size(step).cast("long").alias("n"), step[0]["state_value"].alias("first_value"), F.element_at(step, -1)["state_value"].alias("last_value"), F.array_join(F.transform(step, lambda s: s["state_value"].cast("string")), ">").alias("path"))


_ISL = """i AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1440 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS e FROM i),
ep AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1440 MINUTE AS "end", count(*) AS members FROM g GROUP BY user_id, e)"""


@register("episode_sessions", f'WITH {_ISL} SELECT user_id, start, "end", members FROM ep')
def episode_sessions(spark, d):
    return state.sessions(M.table(spark, d, "events"), ["user_id"], "ts", 1440)


@register("stale_episodes", f"""WITH {_ISL} SELECT user_id, start, members FROM ep WHERE "end" - INTERVAL 1440 MINUTE < TIMESTAMP '{M.NOW}' - INTERVAL 72 HOUR""")
def stale_episodes(spark, d):
    e = state.sessions(M.table(spark, d, "events"), ["user_id"], "ts", 1440)
    return e.where(F.col("end") - F.expr("interval 1440 minutes") < M.now() - F.expr("interval 72 hours")).select("user_id", "start", "members")


@register("open_episodes", f"""WITH {_ISL} SELECT user_id, start, members FROM ep WHERE "end" > TIMESTAMP '2024-01-30 12:00:00' """)
def open_episodes(spark, d):
    return state.sessions(M.table(spark, d, "events"), ["user_id"], "ts", 1440).where(F.col("end") > _at("2024-01-30 12:00:00")).select("user_id", "start", "members")


@register("latest_snapshot", "SELECT user_id AS agent_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_snapshot(spark, d):
    e = M.table(spark, d, "events").select(F.col("user_id").alias("agent_id"), "event_id", "ts")
    return scans.last_write_wins(e, ["agent_id"], "ts", "event_id")


@register("snapshot_ttl", f"WITH s AS (SELECT user_id AS agent_id, max(ts) AS ts FROM events GROUP BY 1) SELECT agent_id, ts FROM s WHERE (epoch_us(TIMESTAMP '{M.NOW}') - epoch_us(ts)) / 3.6e9 <= 36")
def snapshot_ttl(spark, d):
    s = M.table(spark, d, "events").groupBy(F.col("user_id").alias("agent_id")).agg(F.max("ts").alias("ts"))
    return s.where(P.within_ttl(F.col("ts"), M.now(), 36))


@register("key_value_state", "SELECT user_id || ':' || event_type AS key, last(value ORDER BY ts, event_id) AS value FROM events GROUP BY 1")
def key_value_state(spark, d):
    e = M.table(spark, d, "events")
    return e.groupBy(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


_CHAIN = f"""{_S}, o AS (SELECT *, row_number() OVER w AS pos, lag(state_value) OVER w AS pv, lead(created_at) OVER w AS nxt FROM states WINDOW w AS (PARTITION BY entity_id, state_key ORDER BY created_at, node_id)),
z AS (SELECT *, sum(CASE WHEN pv IS NOT NULL AND pv <> state_value THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, state_key ORDER BY created_at, node_id ROWS UNBOUNDED PRECEDING) AS zone FROM o),
zones AS (SELECT entity_id, state_key, CAST(zone AS BIGINT) AS zone, count(*) AS members, min(created_at) AS start, first(node_id ORDER BY created_at, node_id) AS first_node, last(node_id ORDER BY created_at, node_id) AS terminal FROM z GROUP BY ALL)"""


def _zones(spark, d):
    return grammar.linear_zones(M.states(spark, d))


@register("zones_linear", f"{_CHAIN} SELECT * FROM zones")
def zones_linear(spark, d):
    return _zones(spark, d)


@register("tlg_current", f"{_CHAIN} SELECT entity_id, state_key, zone, terminal FROM zones QUALIFY row_number() OVER (PARTITION BY entity_id, state_key ORDER BY zone DESC) = 1")
def tlg_current(spark, d):
    return grammar.current_zone(_zones(spark, d)).select("entity_id", "state_key", "zone", "terminal")


@register("tlg_origin", f"{_CHAIN} SELECT entity_id, state_key, first_node AS origin FROM zones WHERE zone = 0")
def tlg_origin(spark, d):
    return grammar.origin(_zones(spark, d))


@register("tlg_sequence", f"{_S} SELECT node_id, lead(node_id) OVER w AS after_id, lag(node_id) OVER w AS before_id FROM states WINDOW w AS (PARTITION BY entity_id, state_key ORDER BY created_at, node_id)")
def tlg_sequence(spark, d):
    return grammar.neighbours(M.states(spark, d)).select("node_id", "after_id", "before_id")


@register("tlg_interval", f"{_S} SELECT node_id, created_at FROM states WHERE entity_id = 5 AND created_at > TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-20'")
def tlg_interval(spark, d):
    return grammar.between(M.states(spark, d).where("entity_id = 5"), _at("2024-01-10 00:00:00"), _at("2024-01-20 00:00:00")).select("node_id", "created_at")


@register("tlg_range", f"{_S} SELECT entity_id, count(*) AS n FROM states WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-11' GROUP BY 1")
def tlg_range(spark, d):
    s = M.states(spark, d).where((F.col("created_at") >= _at("2024-01-10 00:00:00")) & (F.col("created_at") < _at("2024-01-11 00:00:00")))
    return s.groupBy("entity_id").agg(F.count("*").alias("n"))


@register("tlg_before_named", f"{_S}, f AS (SELECT entity_id, state_key, min(created_at) AS t FROM states GROUP BY ALL) SELECT a.entity_id, CASE WHEN a.t <= b.t THEN 'signup' ELSE 'purchase' END AS earlier FROM f a JOIN f b USING (entity_id) WHERE a.state_key = 'signup' AND b.state_key = 'purchase'")
def tlg_before_named(spark, d):
    return grammar.earlier_of(M.states(spark, d), "signup", "purchase")


@register("tlg_concurrent", f"{_S}, a AS (SELECT * FROM states WHERE state_key = 'signup') SELECT a.node_id, count(*) AS n FROM a JOIN states b ON a.entity_id = b.entity_id AND b.node_id <> a.node_id AND b.created_at BETWEEN a.created_at - INTERVAL 7 DAY AND a.created_at + INTERVAL 7 DAY GROUP BY 1")
def tlg_concurrent(spark, d):
    s = M.states(spark, d)
    return grammar.concurrent_counts(s.where("state_key = 'signup'"), s, "entity_id", 7)


@register("tlg_cause_of", f"{_S} SELECT entity_id, first(node_id ORDER BY created_at, node_id) AS cause FROM states WHERE state_key = 'error' GROUP BY 1")
def tlg_cause_of(spark, d):
    return M.states(spark, d).where("state_key = 'error'").groupBy("entity_id").agg(F.min_by("node_id", F.struct("created_at", "node_id")).alias("cause"))


@register("base_level_activation", f"WITH {M.ACCESSES_SQL} SELECT memory_id, round(coalesce(ln(sum(pow((epoch_us(TIMESTAMP '{M.NOW}') - epoch_us(accessed_at)) / 1e6, -0.5))), -10), 6) AS base FROM accesses GROUP BY 1")
def base_level_activation(spark, d):
    age = S.seconds_between(M.now(), F.col("accessed_at"))
    return M.accesses(spark, d).groupBy("memory_id").agg(F.round(S.base_level(age), 6).alias("base"))


@register("retrieval_probability", f"WITH {M.ACCESSES_SQL}, b AS (SELECT memory_id, coalesce(ln(sum(pow((epoch_us(TIMESTAMP '{M.NOW}') - epoch_us(accessed_at)) / 1e6, -0.5))), -10) AS x FROM accesses GROUP BY 1) SELECT memory_id, round(1 / (1 + exp(-(x + 2) / 0.4)), 6) AS p FROM b")
def retrieval_probability(spark, d):
    age = S.seconds_between(M.now(), F.col("accessed_at"))
    b = M.accesses(spark, d).groupBy("memory_id").agg(S.base_level(age).alias("x"))
    return b.select("memory_id", F.round(S.retrieval_probability(F.col("x")), 6).alias("p"))


@register("recency_score", f"SELECT event_id, round(exp(-ln(2) * (epoch_us(TIMESTAMP '{M.NOW}') - epoch_us(ts)) / 1e6 / 86400 / 30), 6) AS recency FROM events")
def recency_score(spark, d):
    return M.table(spark, d, "events").select("event_id", F.round(S.recency(S.seconds_between(M.now(), F.col("ts"))), 6).alias("recency"))


@register("decay_pass", f"WITH {M.ACCESSES_SQL}, b AS (SELECT memory_id, coalesce(ln(sum(pow((epoch_us(TIMESTAMP '{M.NOW}') - epoch_us(accessed_at)) / 1e6, -0.5))), -10) AS x FROM accesses GROUP BY 1) SELECT count(*) AS decayed FROM b WHERE x < -2.5")
def decay_pass(spark, d):
    age = S.seconds_between(M.now(), F.col("accessed_at"))
    return M.accesses(spark, d).groupBy("memory_id").agg(S.base_level(age).alias("x")).agg(F.count_if(F.col("x") < -2.5).alias("decayed"))


@register("access_ages", f"WITH {M.ACCESSES_SQL} SELECT memory_id, count(*) AS n, round(min((epoch_us(TIMESTAMP '{M.NOW}') - epoch_us(accessed_at)) / 1e6), 3) AS youngest, round(max((epoch_us(TIMESTAMP '{M.NOW}') - epoch_us(accessed_at)) / 1e6), 3) AS oldest FROM accesses GROUP BY 1")
def access_ages(spark, d):
    age = S.seconds_between(M.now(), F.col("accessed_at"))
    return M.accesses(spark, d).groupBy("memory_id").agg(F.count("*").alias("n"), F.round(F.min(age), 3).alias("youngest"), F.round(F.max(age), 3).alias("oldest"))


@register("access_pruning", f"WITH {M.ACCESSES_SQL} SELECT memory_id, count(*) AS kept FROM accesses WHERE accessed_at >= TIMESTAMP '{M.NOW}' - INTERVAL 10 DAY GROUP BY 1")
def access_pruning(spark, d):
    return M.accesses(spark, d).where(F.col("accessed_at") >= M.now() - F.expr("interval 10 days")).groupBy("memory_id").agg(F.count("*").alias("kept"))


@register("temporal_range_overlap", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-12' AND ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-10'")
def temporal_range_overlap(spark, d):
    e = M.table(spark, d, "events").select("event_id", F.col("ts").alias("a"), (F.col("ts") + F.expr("interval 1 day")).alias("b"))
    return e.where(P.overlaps(F.col("a"), F.col("b"), _at("2024-01-10 00:00:00"), _at("2024-01-12 00:00:00"))).select("event_id")


@register(
    "range_filter_missing",
    "WITH r AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events WHERE event_type = 'signup' GROUP BY 1), c AS (SELECT DISTINCT user_id FROM events) SELECT c.user_id FROM c LEFT JOIN r USING (user_id) WHERE coalesce(a < TIMESTAMP '2024-01-05' AND b > TIMESTAMP '2024-01-02', true)",
)
def range_filter_missing(spark, d):
    e = M.table(spark, d, "events")
    r = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("range_start"), F.max("ts").alias("range_end"))
    return P.range_filter(e.select("user_id").distinct(), r, "user_id", _at("2024-01-02 00:00:00"), _at("2024-01-05 00:00:00"))


@register("temporal_proximity", "SELECT event_id, round(CASE WHEN ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12' THEN 1.0 ELSE exp(-0.5 * pow(greatest(epoch_us(TIMESTAMP '2024-01-10') - epoch_us(ts), epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-12')) / 1e6 / 172800, 2)) END, 6) AS proximity FROM events")
def temporal_proximity(spark, d):
    p = S.temporal_proximity(F.col("ts"), _at("2024-01-10 00:00:00"), _at("2024-01-12 00:00:00"), M.now(), F.lit("range"))
    return M.table(spark, d, "events").select("event_id", F.round(p, 6).alias("proximity"))


@register("temporal_arithmetic", "WITH a AS (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS x, max(ts) FILTER (event_type = 'purchase') AS y FROM events GROUP BY 1) SELECT user_id, round(abs(epoch_us(y) - epoch_us(x)) / 1e6 / 86400, 6) AS days FROM a WHERE x IS NOT NULL AND y IS NOT NULL")
def temporal_arithmetic(spark, d):
    a = M.table(spark, d, "events").groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("x"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("y"))
    return a.where("x is not null and y is not null").select("user_id", F.round(F.abs(S.seconds_between(F.col("y"), F.col("x"))) / 86400, 6).alias("days"))


@register("interval_merge", "SELECT user_id, min(ts) AS start, max(ts + INTERVAL 1 DAY) AS stop, max_by(event_type, struct_pack(v := value, e := event_id)) AS best FROM events GROUP BY 1")
def interval_merge(spark, d):
    return M.table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("start"), F.max(F.col("ts") + F.expr("interval 1 day")).alias("stop"), F.max_by("event_type", F.struct("value", "event_id")).alias("best"))


@register("ordinal_ordering", "WITH h AS (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS r FROM events QUALIFY r <= 40) SELECT event_id, row_number() OVER (ORDER BY CASE WHEN r > 20 THEN 2 WHEN event_type = 'purchase' THEN 0 ELSE 1 END, CASE WHEN r <= 20 AND event_type = 'purchase' THEN ts END, r) AS place FROM h")
def ordinal_ordering(spark, d):
    top = M.table(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(40)
    out = ranking.ordinal(top.withColumn("score", F.col("value")), "event_id", F.col("event_type") == "purchase", "ts", head=20)
    return out.select("event_id", F.col("place").cast("long").alias("place"))
