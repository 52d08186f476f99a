"""Frequent paths are a set of bounded size in the plan, not a join that marks rows."""

from __future__ import annotations

import random

from recallforge import shared
from recallforge.llm import _io, ngram_join as J
from tests.llm.test_ngram_join import brute, found, near_copies


def test_frequent_paths_are_marked_without_a_join(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 4)
    plans, written = [], _io.written

    def noted(df, stem):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        return written(df, stem)

    monkeypatch.setattr(_io, "written", noted)
    rng = random.Random(6)
    docs = near_copies(40) + [(100 + i, " ".join(f"v{rng.randrange(60)}" for _ in range(30))) for i in range(40)]
    docs += [(200 + i, docs[50][1]) for i in range(5)]
    assert found(J.classes(spark.createDataFrame(docs, "doc_id long, text string"), small=8)) == brute(docs)
    levels = [p for p in plans if "AS state" in p]
    assert levels and not any("path" in line and "_hot" in line and "Join" in line for p in plans for line in p.splitlines())
    assert any(" IN (" in p for p in levels)


def test_hot_values_are_few(spark):
    sizes = spark.range(5000).selectExpr("id as path", "2000L as n")
    assert shared.hot_list(sizes, "path", "n") == []  # each holds less than a thousandth
    some = sizes.unionByName(spark.range(-3, 0).selectExpr("id as path", "9000000L as n"))
    assert sorted(shared.hot_list(some, "path", "n")) == [-3, -2, -1]
