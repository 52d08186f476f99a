"""Joins of similar sets: equal sets are compared once, and pairs are those of brute force."""

from __future__ import annotations

import random

import pytest

from recallforge.operators import maintenance as X


@pytest.mark.parametrize("universe, longest", [(30, 40), (200, 120)])
def test_similar_sets_of_any_size(spark, universe, longest):
    rng = random.Random(5)
    rows = [(i, [rng.randrange(universe) for _ in range(rng.randrange(1, longest))]) for i in range(80)]
    rows += [(80 + i, list(rows[i % 9][1])) for i in range(40)]
    sets = {i: set(x) for i, x in rows}
    df = spark.createDataFrame(rows, "id long, items array<long>")
    for least in (0.3, 0.8):
        got = [(r.a, r.b) for r in X.similar_sets(df, least).collect()]
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        assert len(got) == len(want) and set(got) == want


def test_equal_sets_are_compared_once(spark):
    df = spark.range(3000).selectExpr("id", "array(7L, 9L) AS items").unionByName(spark.createDataFrame([(9000, [7, 9, 11])], "id long, items array<long>"))
    alike, _ = X._distinct_sets(df)
    assert {(r.r, r.k) for r in alike.collect()} == {(0, 3000), (9000, 1)}
    assert X._similar_distinct(alike, 0.6).count() == 1
    one = X.overlap_clusters(df, least=0.6).select("cluster", "size", "shared").collect()
    assert [(r.cluster, r.size, r.shared) for r in one] == [(0, 3001, [7, 9])]
    assert X.similar_sets(df.where("id < 300 or id = 9000"), 0.6).count() == 300 * 299 // 2 + 300
