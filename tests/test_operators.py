"""Golden cases of operators whose semantics the SQL twins do not pin."""

from __future__ import annotations

import hashlib
import json
import math
import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from recallforge.functions import scores as S, text as T
from recallforge.operators import audit, classify, consolidation, grammar, graph, metrics, predicates, ranking, recall, retrieval, scans, state
from tests.compare import SF


def one(df):
    return df.first()[0]


@pytest.mark.parametrize("ages, want", [([10.0], math.log(10**-0.5)), ([5.0, 15.0, 45.0], math.log(sum(t**-0.5 for t in (5, 15, 45)))), ([0.0, 0.0], -10.0), ([0.0, 10.0], math.log(10**-0.5))])
def test_base_level(spark, ages, want):
    df = spark.createDataFrame([(a,) for a in ages], "age double")
    assert one(df.agg(S.base_level(F.col("age")))) == pytest.approx(want)


def test_base_level_of_nothing(spark):
    assert one(spark.createDataFrame([], "age double").agg(S.base_level(F.col("age")))) == -10.0


def test_retrieval_probability(spark):
    df = spark.createDataFrame([(-2.0,), (1e6,), (-1e6,)], "a double").select(S.retrieval_probability(F.col("a")))
    got = [r[0] for r in df.collect()]
    assert got[0] == pytest.approx(0.5) and got[1] == pytest.approx(1) and got[2] == pytest.approx(0, abs=1e-12)


def test_noise_is_centred(spark):
    assert one(spark.range(1).select(S.activation_noise(F.lit(0.5)))) == pytest.approx(0.0)


def test_penalty_only_for_current_state(spark):
    df = spark.createDataFrame([("current_state_lookup",), ("fact_lookup",)], "i string").select(S.penalty(F.lit(True), F.lit(True), F.col("i")))
    assert [r[0] for r in df.collect()] == [pytest.approx(0.45), 0.0]


@pytest.mark.parametrize("missing, want", [("include", {1, 4}), ("exclude", {1})])
def test_range_filter(spark, missing, want):
    c = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id int")
    r = spark.createDataFrame([(1, "2024-06-15", "2024-06-16"), (2, "2024-05-01", "2024-06-01"), (3, "2024-07-01", "2024-07-02")], "id int, range_start string, range_end string")
    got = predicates.range_filter(c, r, "id", F.lit("2024-06-01"), F.lit("2024-07-01"), missing)
    assert {x.id for x in got.collect()} == want


def _zones(spark, nodes, edges):
    n = spark.createDataFrame([("s", i, i) for i in nodes], "subject string, node_id long, at long")
    e = spark.createDataFrame([("s", a, b, k) for a, b, k in edges], "subject string, source_id long, target_id long, edge_type string")
    return [(list(z.members), z.ended_by) for z in grammar.graph_zones(n, e).orderBy("zone").collect()]


def test_zones(spark):
    assert _zones(spark, [1], []) == [([1], None)]
    assert _zones(spark, [1, 2, 3], [(2, 1, "refines"), (3, 2, "refines")]) == [([1, 2, 3], None)]
    assert _zones(spark, [1, 2, 3], [(2, 1, "refines"), (3, 2, "supersedes")]) == [([1, 2], 3), ([3], None)]


def test_personal_pagerank_edges(spark):
    none = spark.createDataFrame([], "src long, dst long, weight double")
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    seed = lambda *rows: spark.createDataFrame(list(rows), "node long, share double")
    assert graph.personal_pagerank(none, seed((1, 1.0))).count() == 0
    assert graph.personal_pagerank(e, seed((9, 1.0))).count() == 0
    assert graph.personal_pagerank(e, seed((1, 0.0), (2, -1.0))).count() == 0
    got = {r.node: r.rank for r in graph.personal_pagerank(e, seed((1, 1.0)), rounds=12).collect()}
    assert sum(got.values()) == pytest.approx(1) and got[1] > got[2] > got[3]


def test_components_and_descent(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7)], "src long, dst long")
    assert {r.node: r.component for r in graph.components(e).collect()} == {5: 2, 4: 2, 3: 2, 2: 2, 9: 8, 8: 8}
    p = spark.createDataFrame([(2, 1), (3, 2)], "child long, parent long")
    assert {(r.node, r.level) for r in graph.descend(p, spark.createDataFrame([(1,)], "node long")).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_greedy_topics(spark):
    s = spark.createDataFrame([("a", 1, ["x", "y"]), ("a", 2, ["x", "y"]), ("a", 3, ["z"])], "scope string, key long, items array<string>")
    assert sorted(list(r.members) for r in graph.greedy_topics(s, 0.5).collect()) == [[1, 2], [3]]


def test_relation(spark):
    rows = [("a", "A ", "p", "p", "supports"), ("a", "a", "p", "q", "refines"), ("a", "b", "p", "q", "conflicts"), ("a", "b", "p", "p", "supersedes"), (None, "b", None, "p", "unrelated")]
    df = spark.createDataFrame(rows, "prev string, new string, ps string, s string, want string")
    got = df.select("want", state.relation(F.col("prev"), F.col("new"), F.col("ps"), F.col("s"))["relation"].alias("got"))
    assert all(r.want == r.got for r in got.collect())


def test_causes_follow_the_most_confident(spark):
    e = spark.createDataFrame([(3, 2, 0.9), (3, 1, 0.5), (2, 1, 0.8), (1, 3, 0.8)], "effect long, cause long, confidence double")
    got = grammar.causes(e, spark.createDataFrame([(3,)], "node_id long"))
    assert [(r.hop, r.cause) for r in got.orderBy("hop").collect()] == [(1, 2), (2, 1)]


def test_retirement_prefix(spark):
    q = spark.createDataFrame([("postgres",), ("abc",)], "entity string")
    e = spark.createDataFrame([(2, 20, ["PostgreSQL"]), (1, 10, ["postgresql"]), (3, 5, ["abcd"])], "edge_id long, at long, retires array<string>")
    assert {r.entity: r.edge_id for r in grammar.retirement(q, e).collect()} == {"postgres": 1}


def test_aliases(spark):
    n = spark.createDataFrame([("JWTs",), ("JSON Web Token",), ("API",)], "n string")
    assert [(r.short, r.full) for r in grammar.aliases(n, "n").collect()] == [("JWTs", "JSON Web Token")]


def test_markers(spark):
    o = spark.createDataFrame([("retires", "retired JWT"), ("adds", "added OAuth and started"), ("moves", "started it")], "transition string, content string")
    got = {(r.transition, r["head"]) for r in grammar.edge_markers(o).collect()}
    assert got == {("retires", "retired"), ("adds", "added")}
    m = spark.createDataFrame([("completed it", True, False), ("completed", True, False), ("started", False, True)], "content string, is_terminal boolean, is_root boolean")
    assert [(r["head"], r.side) for r in grammar.content_markers(m).collect()] == [("completed", "current")]


def test_admission_route(spark):
    rows = [(0.05, 0.4, "persist"), (0.05, 0.0, "discard"), (0.2, 0.0, "ephemeral_cache"), (0.3, 0.0, "persist")]
    df = spark.createDataFrame(rows, "s double, c double, want string").select("want", T.admission_route(F.col("s"), F.col("c")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_intents(spark):
    q = spark.createDataFrame([("what is the current status right now",), ("hello",), ("how many days between a and b",)], "q string")
    got = q.select(classify.keyword_intent(F.col("q"))["intent"], classify.arithmetic(F.col("q"))["operation"]).collect()
    assert got[0][0] == "current_state_lookup" and got[1][0] == "fact_lookup" and got[2][1] == "between"


def test_anchor_and_state(spark):
    df = spark.createDataFrame([("see ABC-12",), ("release v1.2.3 is out",), ("db: mode = fast",)], "t string")
    got = df.select(classify.anchor(F.col("t")).alias("a"), classify.state_meta(F.col("t"), F.array(F.lit("db"))).alias("s")).collect()
    assert got[0].a.id == "ABC-12" and got[1].a.kind == "release" and got[1].a.id == "v1.2.3"
    assert (got[2].s.entity, got[2].s.key, got[2].s.value) == ("db", "mode", "fast")


def test_hash_chain_detects_change(spark):
    rows = spark.createDataFrame([("a", i, f"r{i}") for i in range(5)], "c string, k int, r string")
    kept = rows.join(audit.hash_chain(rows, "c", "k", "r").withColumnRenamed("hash", "h"), ["c", "k"])
    heads = audit.chain_heads(rows, "c", "k", "r").first()
    assert heads.n == 5 and heads["head"] == kept.where("k = 4").first().h
    assert audit.verify_chain(kept, "c", "k", "r", "h").first()[1:] == (5, True)
    for k in range(5):
        changed = kept.withColumn("r", F.when(F.col("k") == k, "z").otherwise(F.col("r")))
        assert not audit.verify_chain(changed, "c", "k", "r", "h").first().verified


def test_scans(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert {(r.id, r.v) for r in scans.upsert(a, b, ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {r.id for r in scans.delete_cascade({"t": (a, "id")}, b, "id")["t"].collect()} == {1}


def test_sparse_and_rerank(spark):
    v = spark.createDataFrame([(1, 0, 2.0), (1, 0, 1.0), (2, 1, 1.0)], "id long, dim int, weight double")
    q = spark.createDataFrame([(0, 3.0)], "dim int, weight double")
    assert [(r.id, r.score) for r in retrieval.sparse_dot(retrieval.sparse_max(v, "id"), q, "id").collect()] == [(1, 6.0)]
    @F.pandas_udf("double")
    def length(t: pd.Series) -> pd.Series:
        return t.str.len().astype(float)

    c = spark.createDataFrame([(1, 0.9, "a"), (2, 0.8, "abc"), (3, 0.1, "abcdef")], "id long, score double, content string")
    assert [r.id for r in retrieval.rerank(c, "id", length, most=2, keep=1).collect()] == [2]


def test_ordinal_and_percentiles(spark):
    s = spark.createDataFrame([(1, 0.9, False, 3), (2, 0.8, True, 2), (3, 0.7, True, 1), (4, 0.1, True, 0)], "id long, score double, hit boolean, at long")
    got = ranking.ordinal(s, "id", F.col("hit"), "at", head=3).orderBy("place")
    assert [r.id for r in got.collect()] == [3, 2, 1, 4]
    p = ranking.nearest_rank(spark.range(10).withColumn("g", F.lit(1)), ["g"], "id", [0.5, 0.95]).first()
    assert (p.p50, p.p95) == (4, 8)


def test_wilson_and_gate(spark):
    low, high = S.wilson(F.lit(5.0), F.lit(10.0))
    r = spark.range(1).select(low, high).first()
    assert r[0] == pytest.approx(0.2366, abs=1e-4) and r[1] == pytest.approx(0.7634, abs=1e-4)
    m = spark.createDataFrame([(0.6, 0.05)], "intent_f1 double, wrong double")
    assert metrics.gate(m, {"intent_f1": (">=", 0.7), "wrong": ("<=", 0.1)}).first().failed == ["intent_f1"]


def test_graph_clusters_and_drift(spark):
    links = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (2, 11), (9, 99)], "memory_id long, entity_id long")
    assert [(r.component, r.size) for r in consolidation.clusters(links).collect()] == [(1, 3)]
    a = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 2e6)], "id long, age double")
    assert {r.id: r.delta for r in consolidation.drift(a, "id", "age").collect()} == {1: 0.5, 2: -0.5}


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert retrieval.bm25(d, "doc_id", "text", "a b").count() == 0
    e = spark.createDataFrame([], "src long, dst long")
    assert graph.components(e).count() == 0 and graph.pagerank(e).count() == 0


def overlap_by_brute_force(rows):
    sets = {}
    for i, x in rows:
        sets.setdefault(i, set()).add(x)
    ids = sorted(sets)
    j = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[:k] if sets[a] & sets[b]]
    total = len(ids) * (len(ids) - 1) // 2
    return [total, len(j), len(j) / max(total, 1), statistics.mean(j or [0]), statistics.median(j or [0]), max(j or [0]), statistics.stdev(j) if len(j) > 1 else 0]


@pytest.mark.parametrize("tile", [5, 1024])
def test_overlap_statistics_in_tiles(spark, tile):
    rng = random.Random(1)
    rows = [(i, rng.randrange(30) if rng.random() < 0.8 else 7) for i in range(60) for _ in range(rng.randrange(1, 8))]
    for r in (rows, rows[:1], [(1, 1), (2, 1)], []):
        got = recall.overlap_statistics(spark.createDataFrame(r, "id long, x long"), tile).first()
        assert list(got) == pytest.approx(overlap_by_brute_force(r), rel=1e-9, abs=1e-12)


def test_overlap_statistics_of_all_orders(spark):
    from recallforge import catalog, model

    rows = [tuple(r) for r in model.table(spark, SF, "lineitem").select("l_orderkey", "l_suppkey").collect()]
    got = catalog.queries()["overlap_statistics"](spark, SF).first()
    assert list(got) == pytest.approx(overlap_by_brute_force(rows), abs=1e-6)


def test_hash_chain_and_timeline_of_everyone(spark, tmp_path):
    """Users, customers and suppliers of any number, against a walk with hashlib."""
    from recallforge import catalog

    events = [(k, (k * 7919) % 60, f"t{k % 3}", pd.Timestamp(2024, 1, 1 + k % 28)) for k in range(300)]
    pd.DataFrame(events, columns=["event_id", "user_id", "event_type", "ts"]).sample(frac=1, random_state=0).to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    day = pd.Timestamp(2024, 1, 2)
    pd.DataFrame([(1, 3, day), (2, 900, day)], columns=["o_orderkey", "o_custkey", "o_orderdate"]).to_parquet(tmp_path / "orders.parquet", coerce_timestamps="us")
    pd.DataFrame([(1, 1, 2, "N", day), (2, 1, 77, "R", day)], columns=["l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_shipdate"]).to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
    want = {}
    for i, user, kind, _ in events:
        n, head = want.get(user, (0, ""))
        want[user] = (n + 1, hashlib.sha256(f"{head}{i}{kind}".encode()).hexdigest())
    assert len(want) == 60
    assert {r.user_id: (r.n, r["head"]) for r in catalog.queries()["hash_chain"](spark, str(tmp_path)).collect()} == want
    got = sorted((r.type, r.agent, r.detail) for r in catalog.queries()["audit_timeline_union"](spark, str(tmp_path)).collect())
    assert got == sorted([("document", "3", "1"), ("document", "900", "2"), ("review", "2", "1:1"), ("violation", "77", "2:1"), *(("event", str(user), str(i)) for i, user, _, _ in events)])


def test_pagerank_runs_the_rounds_of_the_reference(spark, tmp_path):
    """On a ring that mixes slowly, with a node of no out-edges, against 50 rounds of
    power iteration; 10 and 8 rounds are far from both."""
    from recallforge import catalog

    links = [(1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3), (4, 5), (5, 4), (5, 6), (5, 9)]
    rows = [(a, json.dumps({"k": str(b)}), pd.Timestamp(2024, 1, 1)) for a, b in links]
    pd.DataFrame(rows, columns=["user_id", "props", "ts"]).to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    nodes, out = sorted({x for e in links for x in e}), {a: sum(x == a for x, _ in links) for a, _ in links}

    def rounds(start, restart, n):
        r = dict(start)
        for _ in range(n):
            lost = sum(r[v] for v in nodes if v not in out)
            step = {v: (0.15 + 0.85 * lost) * restart[v] for v in nodes}
            for a, b in links:
                step[b] += 0.85 * r[a] / out[a]
            r = step
        return r

    even, seeds = dict.fromkeys(nodes, 1 / len(nodes)), {v: 0.5 * (v in (1, 2)) for v in nodes}
    for name, start, few in (("pagerank_fixed_iter", even, 10), ("personalised_pagerank", seeds, 8)):
        got = {r.node: r["rank"] for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
        assert got == pytest.approx(rounds(start, start, 50), abs=2e-8)
        assert got != pytest.approx(rounds(start, start, few), abs=1e-4)


def test_index_is_kept_and_follows_its_files(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    pd.DataFrame({"doc_id": [1, 2, 3], "text": ["a b a", "b c", None]}).to_parquet(path)
    docs = spark.read.parquet(path)
    one = retrieval.open_index(docs, "doc_id", "text")
    rounded = lambda x: sorted((r.doc_id, round(r.bm25, 9), r.overlap) for r in x.collect())
    same = lambda x, y: rounded(x) == rounded(y)
    assert one.n == 3 and same(one.signals("a c"), retrieval.signals(docs, "doc_id", "text", "a c"))
    files = one.postings.inputFiles()
    assert retrieval.open_index(docs, "doc_id", "text").postings.inputFiles() == files
    assert {r.doc_id: r.score for r in one.similar(1).collect()} == {2: 1.0} and one.similar(9).count() == 0
    pd.DataFrame({"doc_id": [1, 2, 3, 4], "text": ["a b a", "b c", None, "a"]}).to_parquet(path)
    spark.catalog.refreshByPath(path)
    new = retrieval.open_index(spark.read.parquet(path), "doc_id", "text")
    assert new.postings.inputFiles() != files and new.bm25("a").count() == 2
    assert retrieval.open_index(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "doc_id", "text") is None


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_a_join(spark, how):
    from recallforge import shared

    rows = [(i, 7 if i % 3 else i % 50) for i in range(4000)] + [(5000 + i, None) for i in range(20)]
    left = spark.createDataFrame(rows, "i long, k long")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 60, 1) if k != 5], "k long, v string")
    sizes = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    hot = shared.hot_keys(sizes, "k", "n", 4020)
    assert [r[0] for r in hot.collect()] == [7]
    got = shared.salted_join(left, right, "k", hot, ["i"], how)
    same = lambda df: sorted((r.i, -1 if r.k is None else r.k, r.v or "") for r in df.select("i", "k", "v").collect())
    assert same(got) == same(left.join(right, "k", how))


def test_a_cluster_without_a_shared_folder_is_an_error():
    from recallforge import shared

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())
