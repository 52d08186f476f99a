from __future__ import annotations

from pyspark.sql import functions as F

from recallforge.functions import language as L


def test_stems():
    assert L.stem("services") == L.stem("service") and L.stem("migrations") == L.stem("migration") == L.stem("migrate")
    assert L.stem("running") == "run" and L.stem("status") == "status" and L.stem("is") == "is"
    assert L.same_entity("Postgres", "PostgreSQL") and not L.same_entity("abc", "abcd") and L.same_entity("JWT", "jwt")


def test_skeleton():
    s, slots = L.skeleton("What is the status of the auth service and the API?", ["API", "auth service", "db"])
    assert s == "what is status of <x1> and <x2>" and slots == {"<x1>": "auth service", "<x2>": "api"}


def test_causal_pairs():
    t = "outage happened because of disk failure".split()
    tags = ["B-REFERENT", "O", "B-CAUSE_AFTER", "I-CAUSE_AFTER", "B-REFERENT", "I-REFERENT"]
    assert L.causal_pairs(t, tags, [0.9] * 6) == [L.CausalPair("disk failure", "outage", "because of", 0.9)]
    assert L.causal_pairs(t, tags, [0.5] * 6) == [] and L.causal_pairs([], [], []) == []
    assert L.causal_pairs(["a", "caused", "b"], ["B-REFERENT", "B-CAUSE_BEFORE", "B-REFERENT"], [1.0] * 3)[0].cause == "a"


def test_json():
    assert L.repaired_json('say ```json\n{"a": [1, 2,],}\n``` ok') == {"a": [1, 2]}
    assert L.repaired_json('{"a": "x", "b": [1, 2') == {"a": "x", "b": [1, 2]}
    assert L.repaired_json("none") is None and L.repaired_json(None) is None


def test_columns(spark):
    d = spark.createDataFrame([("running services",), (None,)], "t string")
    assert [r[0] for r in d.select(L.column(L.stems, "string")(F.col("t"))).collect()] == ["run servic", None]
    p = spark.createDataFrame([("Disk", "Outage", 0.9), ("x", "x", 1.0)], "cause string, effect string, confidence double")
    s = spark.createDataFrame([("disk", 1), ("outage", 2), ("X", 3)], "surface string, memory_id long")
    assert [(r.effect, r.cause) for r in L.causal_edges(p, s).collect()] == [(2, 1)]
    c = spark.createDataFrame([("a b", "i", 2)], "skeleton string, intent string, hits long")
    u = spark.createDataFrame([("a b", "j"), ("c", "k"), ("c", "k"), ("c", "l")], "skeleton string, intent string")
    assert {(r.skeleton, r.intent, r.hits) for r in L.remember(c, u).collect()} == {("a b", "i", 3), ("c", "k", 3)}
