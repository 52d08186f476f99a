"""Edges near a walk's front, against those of the whole graph."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from recallforge import catalog
from recallforge.operators import graph

SF = "/root/testdata/sf0.001"


def test_edges_at_nodes_are_the_graphs_own(spark):
    """A walk that asks for the edges of its front gets what the whole graph gives."""
    rng = random.Random(5)
    links = [(m, rng.randrange(60)) for m in range(80) for _ in range(rng.choice((2, 3, 15)))]
    links = spark.createDataFrame(links + links[:50], "memory_id long, entity_id long")
    nodes = spark.createDataFrame([(3,), (7,), (7,), (99,)], "node long")
    whole = {(r.src, r.dst, r.count_) for r in graph.cooccurrence(links).withColumnRenamed("count", "count_").collect()}
    got = [(r.src, r.dst, r.count_) for r in graph.cooccurrence_at(links, nodes).withColumnRenamed("count", "count_").collect()]
    assert len(got) == len(set(got)) and set(got) == {e for e in whole if {3, 7} & set(e[:2])} and got

    asked = []

    def at(front):
        asked.append(front.distinct().count())
        return graph.cooccurrence_at(links, front).select("src", "dst", (F.col("count") / 9).alias("weight"))

    every = graph.cooccurrence(links).select("src", "dst", (F.col("count") / 9).alias("weight"))
    for depth in (1, 2):
        flow = lambda e: {(r.node, round(r.activation, 12)) for r in graph.spread(e, nodes.limit(2), max_hops=depth).collect()}  # noqa: E731, B023
        assert flow(at) == flow(every)
        near = lambda e: {tuple(r) for r in graph.hops(e, nodes.selectExpr("node as seed").distinct(), depth).collect()}  # noqa: E731, B023
        assert near(at) == near(every)
    assert asked[0] == 2  # not the whole graph


def test_a_search_makes_edges_near_it_alone(spark, monkeypatch):
    """Edges are made from the members that hold an entity of the walk's front."""
    made, whole = [], graph.cooccurrence

    def near(links, *rest):
        made.append(links.count())
        return whole(links, *rest)

    monkeypatch.setattr(graph, "cooccurrence", near)
    assert catalog.queries()["engine_search"](spark, SF).count()
    assert min(made) < spark.read.parquet(f"{SF}/lineitem.parquet").count() / 2
