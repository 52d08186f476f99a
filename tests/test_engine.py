from __future__ import annotations

from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from recallforge.engine import Engine
from recallforge.functions import temporal

NOW = datetime(2024, 6, 15, 12)


END = dict(hour=23, minute=59, second=59)


@pytest.mark.parametrize("text, start, end", [
    ("yesterday", datetime(2024, 6, 14), datetime(2024, 6, 14, **END)),
    ("what happened today", datetime(2024, 6, 15), NOW),
    ("three days ago", datetime(2024, 6, 12), datetime(2024, 6, 12, **END)),
    ("thirteen days ago", datetime(2024, 6, 2), datetime(2024, 6, 2, **END)),
    ("last week", datetime(2024, 6, 3), datetime(2024, 6, 9, **END)),
    ("2 weeks ago", datetime(2024, 5, 27), datetime(2024, 6, 2, **END)),
    ("last month", datetime(2024, 5, 1), datetime(2024, 5, 31, **END)),
    ("seven months ago", datetime(2023, 11, 1), datetime(2023, 11, 30, **END)),
    ("in march 2023", datetime(2023, 3, 1), datetime(2023, 3, 31, **END)),
    ("in December", datetime(2023, 12, 1), datetime(2023, 12, 31, **END)),
    ("in june", datetime(2024, 6, 1), datetime(2024, 6, 30, **END)),
    ("since apr", datetime(2024, 4, 1), NOW),
    ("since 2023", datetime(2023, 1, 1), NOW),
    ("in 2022", datetime(2022, 1, 1), datetime(2022, 12, 31, **END)),
    ("Q1 2023", datetime(2023, 1, 1), datetime(2023, 3, 31, **END)),
    ("this quarter", datetime(2024, 4, 1), datetime(2024, 6, 30, **END)),
    ("last quarter", datetime(2024, 1, 1), datetime(2024, 3, 31, **END)),
    ("past 14 days", datetime(2024, 6, 1), NOW),
    ("the latest build", datetime(2024, 6, 13, 12), NOW),
])
def test_parse(text, start, end):
    got = temporal.parse(text, NOW)
    assert (got["start"], got["end"]) == (start, end)


def test_parse_words():
    assert temporal.parse("the first release", NOW) == {"start": None, "end": None, "recency": False, "ordinal": "first"}
    new = temporal.parse("what is the current state", NOW)
    assert new["recency"] and new["ordinal"] == "last"
    assert temporal.parse("last week", NOW)["ordinal"] is None and temporal.parse("hello", NOW) is None and temporal.parse(None, NOW) is None
    assert temporal.duration_days("a couple of weeks") == 14 and temporal.duration_days("soon") is None and temporal.duration_days("3 hours") is None
    a, b = datetime(2024, 1, 1), datetime(2024, 2, 1)
    assert temporal.merge([(a, b, 0.5), (b, NOW, 0.9), (b, b, 1.0), (a, NOW, 0.1)]) == (a, NOW, 0.9) and temporal.merge([]) is None


@pytest.mark.parametrize("text, label, start, end, origin", [
    ("2024", "date", datetime(2024, 1, 1), datetime(2025, 1, 1), "date:year"),
    ("March 2024", "date", datetime(2024, 3, 1), datetime(2024, 4, 1), "date:year-month"),
    ("Q4 2023", "date", datetime(2023, 10, 1), datetime(2024, 1, 1), "date:quarter"),
    ("June 5, 2024", "date", datetime(2024, 6, 5), datetime(2024, 6, 6), "date:absolute"),
    ("2024-02-29", "date", datetime(2024, 2, 29), datetime(2024, 3, 1), "date:absolute"),
    ("yesterday", "relative date", datetime(2024, 6, 14), datetime(2024, 6, 15), "relative:canonical"),
    ("last month", "relative date", datetime(2024, 5, 1), datetime(2024, 6, 1), "relative:last-month"),
    ("next year", "relative date", datetime(2025, 1, 1), datetime(2026, 1, 1), "relative:next-year"),
    ("last Thursday", "relative date", datetime(2024, 6, 13), datetime(2024, 6, 14), "relative:modifier"),
    ("next Friday", "relative date", datetime(2024, 6, 21), datetime(2024, 6, 22), "relative:modifier"),
    ("3 days ago", "relative date", datetime(2024, 6, 12), datetime(2024, 6, 13), "relative:fallback"),
    ("since June 5", "start date", datetime(2024, 6, 5), NOW, "start-date"),
    ("until yesterday", "end date", NOW - temporal.HORIZON, datetime(2024, 6, 15), "end-date"),
])
def test_spans_to_intervals(text, label, start, end, origin):
    (got,) = temporal.normalise([temporal.Span(text, label, 3, 9)], NOW)
    assert (got.start, got.end, got.origin) == (start, end, origin)


def test_span_rules():
    S = temporal.Span
    both = temporal.normalise([S("June 5, 2024", "end date", 0, 12), S("June 5, 2024", "date", 0, 12)], NOW)
    assert [i.origin for i in both] == ["date:absolute"]
    wide = temporal.normalise([S("June 5, 2024", "date", 0, 12), S("two weeks", "duration", 20, 29)], NOW)
    assert [(i.start, i.end, i.confidence) for i in wide] == [(datetime(2024, 6, 5), datetime(2024, 6, 19), 0.75)]
    assert temporal.normalise([S("two weeks", "duration", 1, 9), S("12", "date", 10, 12), S("2pm", "time of day", 13, 16), S("", "date", 17, 18), S("1000", "date", 20, 24)], NOW) == []
    names, hull = temporal.query_range([S("auth service", "service"), S("May 2024", "date", 5, 9), S("today", "relative date", 12, 17)], NOW)
    assert names == ["auth service"] and hull == (datetime(2024, 5, 1), datetime(2024, 6, 16), 0.92)


def test_temporal_columns(spark):
    q = spark.createDataFrame([("in 2020",), (None,), ("hello",)], "q string")
    got = q.select(temporal.reference(F.col("q"), NOW).alias("r")).select("r.*").collect()
    assert got[0].start == datetime(2020, 1, 1) and got[1].start is None and got[2].end is None
    kind = "spans array<struct<text:string,label:string,start:int,end:int>>, ref timestamp"
    rows = spark.createDataFrame([([("May 2024", "date", 1, 9)], NOW), ([], NOW), (None, NOW), ([("May 2024", "date", 1, 9)], None)], kind)
    got = [r.i for r in rows.select(temporal.intervals(F.col("spans"), F.col("ref")).alias("i")).collect()]
    assert got[0].start == datetime(2024, 5, 1) and got[0].confidence == 0.92 and all(i.start is None for i in got[1:])


def test_engine(spark, tmp_path):
    m = spark.createDataFrame([(1, "Postgres replaced MySQL", ["db"]), (2, "the cache is Redis", ["db:cache"]), (3, "lunch menu", ["food"])], "memory_id long, content string, domains array<string>")
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (2, 12), (3, 13)], "memory_id long, entity_id long")
    r = spark.createDataFrame([(1, datetime(2024, 1, 1), datetime(2024, 1, 2))], "memory_id long, range_start timestamp, range_end timestamp")
    e = Engine(m, links, ranges=r)
    assert [(x.memory_id, x.score > 0) for x in e.search("postgres mysql").collect()] == [(1, True), (2, False)]  # the second by a shared entity
    assert [x.memory_id for x in Engine(m).search("postgres mysql").collect()] == [1]
    assert e.search("postgres", domain="food").count() == 0
    assert e.search("postgres in march 2024", now=NOW).where("memory_id = 1").count() == 0
    assert e.recall("redis cache").first().entities == [11, 12]
    assert {x.memory_id for x in e.related([10]).collect()} == {1, 2}
    assert {x.entity for x in e.extract().collect()} == {"Postgres", "MySQL", "Redis"}
    e.extractor = lambda texts: texts.str.split().map(lambda w: w[:1])
    assert {x.entity for x in e.extract().collect()} == {"Postgres", "the", "lunch"}
    new = spark.createDataFrame([(4, "lunch menu"), (5, "tea"), (6, "tea")], "memory_id long, content string")
    assert [x.memory_id for x in e.store(new, str(tmp_path / "m")).collect()] == [5]

    @F.pandas_udf("double")
    def size(t: pd.Series) -> pd.Series:
        return t.str.len().astype(float)

    e.reranker = size
    assert e.search("the cache postgres", limit=1, intent="fact_lookup").first().memory_id == 1


def test_engine_surface(spark):
    m = spark.createDataFrame([(1, "Postgres replaced MySQL", datetime(2024, 1, 1)), (2, "the cache is Redis", datetime(2024, 1, 11)), (3, "lunch menu", datetime(2024, 2, 1))], "memory_id long, content string, created_at timestamp")
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (2, 12), (3, 13)], "memory_id long, entity_id long")
    nodes = spark.createDataFrame([(1, "atomic"), (2, "entity_state"), (3, "atomic")], "memory_id long, node_type string")
    e = Engine(m, links, nodes=nodes)
    assert [x.memory_id for x in e.search_level("postgres cache redis", ["entity_state"]).collect()] == [2]
    assert e.synthesise("postgres mysql", budget=100, limit=1) == "[1] Postgres replaced MySQL"
    names = spark.createDataFrame([(10, "Postgres"), (12, "Redis")], "entity_id long, name string")
    assert e.arithmetic("how many days between Postgres and Redis", ["Postgres", "Redis"], names, NOW) == "10 days"
    assert e.arithmetic("how many weeks since Redis", ["Redis"], names, datetime(2024, 1, 18)) == "1 weeks"
    assert e.arithmetic("what is it", ["Redis"], names, NOW) is None and e.arithmetic("how many days since x", ["nobody"], names, NOW) is None
    left = e.delete(spark.createDataFrame([(1,)], "memory_id long"))
    assert left["memories"].count() == 2 and left["links"].count() == 3 and left["nodes"].count() == 2
    assert e.feedback(e.search("redis", limit=1), "me", NOW).first().agent == "me"
    assert e.topic_map(least=0.3, members=2).first().ids == [1, 2]
    up = e.traverse(spark.createDataFrame([(1,)], "node long"), "bottom_up", summaries=spark.createDataFrame([(9, 5)], "abstract_id long, episode_id long"), members=spark.createDataFrame([(5, 1), (5, 2)], "episode_id long, member_id long"))
    assert {(r.level, r.node) for r in up.collect()} == {(0, 1), (1, 5), (2, 9)}
    with pytest.raises(ValueError):
        e.traverse(m, "sideways")


def test_engine_signals_and_recall(spark, tmp_path):
    """Every signal moves the score it should, a range filters only where it is asked
    for, and recall adds what the question's intent looks for."""
    m = spark.createDataFrame(
        [(1, "auth service runs on Postgres", datetime(2024, 1, 5)), (2, "auth service runs on Postgres", datetime(2023, 1, 5)), (3, "the cache is Redis", datetime(2024, 2, 1)), (4, "lunch menu", datetime(2024, 2, 1)), (5, "summary of outages", datetime(2024, 2, 1))],
        "memory_id long, content string, created_at timestamp",
    )
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 11), (4, 13)], "memory_id long, entity_id long")
    entities = spark.createDataFrame([(10, "Auth Service"), (11, "Redis"), (13, "lunch")], "entity_id long, name string")
    ranges = spark.createDataFrame([(2, datetime(2023, 1, 5), datetime(2023, 1, 6))], "memory_id long, range_start timestamp, range_end timestamp")
    nodes = spark.createDataFrame([(1, 101, "entity_state", True), (2, 102, "entity_state", False), (5, 105, "abstract", True), (4, 104, "atomic", True)], "memory_id long, node_id long, node_type string, is_current boolean")
    states = spark.createDataFrame([(101, 10, "db", "postgres", datetime(2024, 1, 5), 1), (90, 10, "db", "mysql", datetime(2022, 1, 5), 4)], "node_id long, entity_id long, state_key string, state_value string, created_at timestamp, memory_id long")
    accesses = spark.createDataFrame([(1, datetime(2024, 6, 15, 11))], "memory_id long, accessed_at timestamp")
    e = Engine(m, links, states, ranges, nodes, accesses=accesses, entities=entities, relations=spark.createDataFrame([(105, 104, "summarizes")], "source_id long, target_id long, edge_type string"), members=spark.createDataFrame([(7, 1), (7, 3)], "episode_id long, member_id long"))
    assert e.named("how is the auth service, and redis?") == [("auth service", 10), ("redis", 11)]
    assert e.keep_edges(str(tmp_path / "edges")).count() == 1 and e._edges_of(m.where("memory_id = 1")).count() == 1
    ask = "status of the auth service on postgres"
    got = {r.memory_id: r for r in e.scored(ask, now=NOW, intent="current_state_lookup").collect()}
    assert got[1].graph == 1.0 and got[2].graph == 0.0 and got[1].activation > got[2].activation == -10
    assert got[2].superseded and not got[1].superseded and got[1].score > got[2].score + 0.3 and got[1].recency > got[2].recency > 0
    assert got[1].node_types == ["entity_state"] and got[1].names == ["auth service"]
    # a year is a range, and only questions within one leave memories out
    assert {r.memory_id for r in e.scored("auth service in 2023", now=NOW).collect()} >= {1, 2}
    assert 2 not in {r.memory_id for r in e.scored("auth service in 2024", now=NOW).collect()}
    assert 2 in {r.memory_id for r in e.scored("the latest auth service", now=NOW).collect()}
    near = {r.memory_id: r.temporal for r in e.scored("auth service in 2023", now=NOW).collect()}
    assert near[2] == 1.0 > near[1] > 0
    old = e.recall(ask, intent="historical_lookup").collect()
    assert [r.place for r in old] == list(range(1, len(old) + 1)) and {r.memory_id: r.path for r in old}[4] == "state_history_bonus"
    assert {r.memory_id: r.siblings for r in old}[1] == [3] and {r.memory_id: r.entities for r in old}[1] == [10, 11]
    assert 4 not in {r.memory_id for r in e.recall(ask, intent="current_state_lookup").collect()}
    told = {r.memory_id: r.path for r in e.recall("summary of outages", intent="event_reconstruction").collect()}
    assert told == {5: "event_reconstruction", 4: "episode_expansion_bonus"}
    assert e.recall("summary of outages", intent="event_reconstruction", limit=1).count() == 1
