import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from recallforge import catalog, shared
from recallforge.operators import consolidation, graph, maintenance, metrics, subjects

SF = "/root/testdata/sf0.001"


def test_coverage_is_dealt_by_rows(spark, monkeypatch):
    """As many tasks as the rows ask for, and no set of orders for a pair."""
    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    df = catalog.queries()["cluster_coverage"](spark, SF)
    plan = df._jdf.queryExecution().toString()
    n = shared.dealt(spark.read.parquet(f"{SF}/lineitem.parquet").count())
    assert n > 8 and re.search(rf"RepartitionByExpression .*\b{n}\b", plan) and "distinct" not in plan.lower()


def _dealt(df, spark, table, by):
    plan, n = df._jdf.queryExecution().toString(), shared.dealt(spark.read.parquet(f"{SF}/{table}.parquet").count())
    return n > 8 and re.search(rf"RepartitionByExpression \[{by}#\d+L?[^\n]*\], {n}\b", plan) is not None


def test_anchors_are_dealt_and_rows_may_repeat(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    assert _dealt(catalog.queries()["chain_unique_anchor"](spark, SF), spark, "lineitem", "o_orderkey")
    tokens = spark.createDataFrame([(1, 10, "a"), (1, 10, "a"), (1, 11, "b"), (1, 12, "b"), (2, 13, "a"), (None, 14, "a"), (3, 15, "z")], "chain long, memory_id long, token string")
    asked = spark.createDataFrame([("a",), ("b",)], "token string")
    assert {r[0] for r in metrics.unique_anchors(tokens, asked).where("unique_anchor").collect()} == {10, 13}


def test_contradictions_of_a_frequent_entity_are_dealt_and_whole(spark, monkeypatch):
    """Each new memory gets the first five others, though its similar ones are among the
    first; an entity of 400 memories gives each only what can come in."""
    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    assert _dealt(catalog.queries()["contradiction_candidates"](spark, SF), spark, "lineitem", "entity_id")
    links = spark.range(400).select("id", F.lit(7)).toDF("memory_id", "entity_id")
    new = spark.range(0, 400, 3).toDF("memory_id")
    near = new.where("memory_id >= 6").selectExpr("memory_id", "explode(array(0, 1, 2)) as other_id", "1D as score")
    m = links.select("memory_id", F.array(F.lit("d")).alias("domains"))
    found = subjects.contradiction_candidates(new, near, links, m)
    got = {}
    for r in found.collect():
        got.setdefault(r.memory_id, set()).add((r.candidate_id, r.how))
    for k in range(0, 400, 3):
        similar = {0, 1, 2} if k >= 6 else set()
        fill = [c for c in range(400) if c != k and c not in similar][: 5 - len(similar)]
        assert got[k] == {(c, "similar") for c in similar} | {(c, "linked") for c in fill}
    monkeypatch.undo()
    assert "WindowGroupLimit" in found._jdf.queryExecution().toString() and re.search(r"RepartitionByExpression \[entity_id", found._jdf.queryExecution().toString())


def test_rare_pairs_are_dealt_and_frequent_ones_counted_in_place(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    sets = {b: sorted({(b * 7 + i * i) % 5 for i in range(4)}) for b in range(300)}
    rows = spark.createDataFrame([(b, i) for b, s in sets.items() for i in s] + [(None, 1), (5, None)], "b long, i long")
    brute = Counter(p for s in sets.values() for p in combinations(s, 2))
    for few in (True, False):
        monkeypatch.setattr(graph, "combines", lambda kinds, made, few=few: few)
        pairs, n = consolidation.pair_counts(rows, "b", "i")
        assert n == 300 and {(r.a, r.b): r.ab for r in pairs.collect()} == brute
    monkeypatch.undo()
    assert graph.combines(500, 10**6) and not graph.combines(10**6, 10**7)
    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    for q in ("pmi_associations", "strong_associations", "cooccurrence_edges"):
        plan = catalog.queries()[q](spark, SF)._jdf.queryExecution().toString()
        assert re.search(r"RepartitionByExpression \[(a|src)#\d+L?, (b|dst)#\d+L?\], \d+", plan), q


def test_cycle_counts_pairs_once(spark):
    """The learned associations are a table that both of their readers share."""
    df = catalog.queries()["maintenance_cycle"](spark, SF)
    assert any("/kept-" in f for f in df.inputFiles())


def test_few_items_are_counted_without_their_pairs(spark):
    """Pairs and baskets of both ways are those of brute force, whatever the items are."""
    sets = {b: sorted({f"i{(b * 7 + i * i) % 11}" for i in range(b % 5)}) for b in range(300)}
    rows = spark.createDataFrame([(b, i) for b, s in sets.items() for i in s] + [(1, "i1"), (None, "i3"), (5, None)], "b long, i string")
    held = Counter(i for s in {**sets, 1: sorted({*sets[1], "i1"})}.values() for i in s)
    brute = Counter(p for b, s in sets.items() for p in combinations(sorted({*s, *(["i1"] if b == 1 else [])}), 2))
    pairs, n = consolidation.pair_counts(rows, "b", "i")
    assert "explode" not in pairs._jdf.queryExecution().toString()
    assert n == len([b for b, s in sets.items() if s or b in (1, 5)]) and {(r.a, r.b): r.ab for r in pairs.collect()} == brute
    once = held + Counter(["i3"])  # the rows without a basket hold it once
    assert all(r.cc == once[r.a] * once[r.b] for r in pairs.collect())


def test_learned_associations_are_the_same_however_counted(spark, monkeypatch):
    links = spark.createDataFrame([(m, (m * m + k * 5) % 23) for m in range(12) for k in range(m % 4)] + [(3, None)], "memory_id long, entity_id long")
    searches = spark.createDataFrame([(s, (s * 5 + k * k) % 13) for s in range(200) for k in range(4)] + [(7, 3), (999, 3), (None, 1)], "search_id long, memory_id long")
    found = lambda: {(r.a, r.b): round(r.strength, 12) for r in maintenance.learned(links, searches).collect()}
    few = found()
    assert "explode" not in maintenance.learned(links, searches)._jdf.queryExecution().toString()
    monkeypatch.setattr(consolidation, "KINDS", 0)
    many = found()
    assert few == many and few
    monkeypatch.setattr(maintenance, "TASK_ROWS", 0)
    assert found() == few
