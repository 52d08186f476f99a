"""Components by contraction, against a walk over the edges."""

from __future__ import annotations

import random

import pytest

from recallforge import shared
from recallforge.operators import graph, maintenance


def brute(edges):
    root = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def held(n=20_000):
    """Memories of four entities each, as edges (memory, entity)."""
    rng = random.Random(8)
    return [(m, -rng.randrange(n // 8) - 1) for m in range(n) for _ in range(4)]


def shuffled(spark):
    """Rows that stages so far have written for others."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_contraction_moves_few_rows(spark):
    """All rounds together move fewer than six rows for each edge, and every node is told."""
    edges = held()
    df = spark.createDataFrame(edges, "src long, dst long")
    before = shuffled(spark)
    got = {r.node: r.component for r in graph.components(df).collect()}
    moved = shuffled(spark) - before
    assert got == brute(edges) and moved < 6 * len(edges), moved / len(edges)


@pytest.mark.parametrize("hot", [False, True])
def test_components_of_any_shape(spark, monkeypatch, hot):
    if hot:  # every key counts as frequent
        monkeypatch.setattr(shared, "HOT_ROWS", 1)
        monkeypatch.setattr(shared, "HOT_KEYS", 10**9)
        monkeypatch.setattr(graph, "HOT_ROWS", 1)
    rng = random.Random(5)
    hub = [(10_000, 20_000 + k) for k in range(60)] + [(30_000 + k, 30_500) for k in range(60)]
    line = [(k, k + 1) for k in range(40_000, 40_025)]
    some = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    thick = [(50_000 + rng.randrange(30), 50_000 + rng.randrange(30)) for _ in range(600)]
    edges = hub + line + some + thick + [(7, 7), (9_999, 9_999)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == brute(edges)


def test_components_of_names(spark):
    edges = [("b", "a"), ("c", "b"), ("z", "y"), ("x", "x"), (None, "q")]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "z": "y", "y": "y"}
    with pytest.raises(RuntimeError):
        graph.components(spark.createDataFrame([(k, k + 1) for k in range(9)], "src long, dst long"), 1).count()


def test_a_topic_is_whole_however_long_its_chain(spark):
    """Neighbours of a chain share half of their items; 200 steps lie between its ends."""
    sets = spark.createDataFrame([(k, [k, k + 1, k + 2]) for k in range(201)], "id long, items array<long>")
    assert [(r.cluster, r.size) for r in maintenance.topics(sets, least=0.5).collect()] == [(0, 201)]
