"""The question grammar, retirement, scores and subjects against golden cases."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from recallforge.operators import classify as K, graph as G, maintenance as X, question as Q, recall as R, scoring as S, subjects as B


@pytest.mark.parametrize("text, tags, relation, rule, intent", [
    ("what is the current database", "O B-ASK_CURRENT O B-ASK_CURRENT B-SCOPE", "current", "state_current", "current"),
    ("what now", "B-ASK_CURRENT O", None, None, None),
    ("what came before redis", "O O B-TEMPORAL_BEFORE B-REFERENT", "predecessor", "temporal_predecessor", "predecessor"),
    ("mysql before postgres", "B-REFERENT B-TEMPORAL_BEFORE B-REFERENT", "before_named", "temporal_before_named", "before_named"),
    ("after redis", "B-TEMPORAL_AFTER B-REFERENT", "after_named", "temporal_after_named", "sequence"),
    ("during redis", "B-TEMPORAL_DURING B-REFERENT", "concurrent_with", "temporal_concurrent", "concurrent"),
    ("during redis in 2023", "B-TEMPORAL_DURING B-REFERENT O B-TEMPORAL_ANCHOR", "during_interval", "temporal_during", "interval"),
    ("in 2023", "O B-TEMPORAL_ANCHOR", "during_interval", "temporal_during", "interval"),
    ("since 2023", "B-TEMPORAL_SINCE B-TEMPORAL_ANCHOR", "state_at", "temporal_since", "current"),
    ("the latest one", "O B-ORDINAL_LAST O", "last", "ordinal_last", "current"),
    ("the second one", "O B-ORDINAL_NTH O", "nth", "ordinal_nth", "sequence"),
    ("because of x", "B-CAUSAL_EXPLICIT I-CAUSAL_EXPLICIT B-REFERENT", "cause_of", "causal_direct", "cause_of"),
    ("led to x", "B-CAUSAL_ALTLEX I-CAUSAL_ALTLEX B-REFERENT", "chain_cause_of", "causal_chain", "transitive_cause"),
    ("earliest concern that led to x", "B-ORDINAL_FIRST O O B-CAUSAL_ALTLEX I-CAUSAL_ALTLEX B-REFERENT", "first", "ordinal_first", "origin"),
    ("what was replaced", "O O B-ASK_CHANGE", "retired", "ask_change", "retirement"),
    ("what was decided", "O O B-ASK_CHANGE", "declared", "ask_change", "origin"),
    ("what if redis stayed", "B-MODAL_HYPOTHETICAL I-MODAL_HYPOTHETICAL B-REFERENT O", "would_be_current_if", "modal_counterfactual", None),
    ("trace it from before through now", "O O O B-TEMPORAL_BEFORE O O", "first", "trace_from_start", "origin"),
    ("alternatives considered before", "O O B-TEMPORAL_BEFORE", "retired", "alternatives_section", "retirement"),
    ("redis cache", "B-REFERENT B-SCOPE", "state_at", "state_bare_referent", "current"),
    ("hello", "O", None, None, None),
])
def test_forms(text, tags, relation, rule, intent):
    f = Q.synthesise(text.split(), tags.split())
    assert (f and (f.relation, f.rule, f.intent)) == (relation and (relation, rule, intent))


def test_form_parts():
    f = Q.synthesise("did session cookies of auth come before oauth".split(), "O B-REFERENT I-REFERENT O B-SUBJECT O B-TEMPORAL_BEFORE B-REFERENT".split())
    assert (f.referent, f.secondary, f.subject, f.confidence) == ("session cookies", "oauth", "auth", 0.9)
    g = Q.Grounding(roles=({"role": "primary", "canonical": "Redis", "slot": "cache"}, {"role": "alternative", "canonical": "Memcached"}))
    f = Q.synthesise(["after"], ["B-TEMPORAL_AFTER"], g)
    assert (f.referent, f.secondary, f.scope) == ("redis", "memcached", "cache")
    assert Q.synthesise(["changed"], ["B-ASK_CHANGE"], Q.Grounding(change="retirement")).relation == "retired"
    assert Q.synthesise([], []) is None and len(Q.RELATION_INTENTS) == 18 and len(set(Q.RELATION_INTENTS.values())) == 10


@pytest.mark.parametrize("text, src, dst, want", [
    ("Retire JWT. Use OAuth.", ["JWT"], ["JWT", "OAuth"], ["JWT"]),
    ("The team moves from MySQL to Postgres", ["MySQL"], ["MySQL", "Postgres"], ["MySQL"]),
    ("The team moves to Postgres", ["MySQL"], ["MySQL", "Postgres"], []),
    ("All fine", ["cache", "ADR-021"], ["db"], ["cache"]),
    ("Surgery scheduled, therapy superseded", ["therapy"], ["therapy", "surgery"], ["therapy"]),
    (None, [], ["x"], []),
])
def test_retired(spark, text, src, dst, want):
    df = spark.createDataFrame([(text, src, dst)], "t string, a array<string>, b array<string>")
    assert Q.retired(df, "t", "a", "b").first().retired == want


def test_names(spark):
    m = spark.createDataFrame([("auth", "session cookies"), ("auth", "OAuth"), ("auth", "OAuth"), ("pay", "OAuth"), ("pay", "Stripe"), ("clinic", "physical therapy"), ("clinic", "PT"), ("clinic", "on"), ("x", "7")], "subject string, entity string")
    v = Q.vocabulary(m)
    got = {r.token: (r.subject, r.canonical, r.is_primary) for r in v.collect()}
    assert got["oauth"] == ("auth", "OAuth", True) and got["therapy"] == ("clinic", "therapy", False) and got["pt"][0] == "clinic" and "on" not in got and "7" not in got
    q = spark.createDataFrame([(1, "Did session cookies come before OAuth?"), (2, "the therapy plan"), (3, "nothing here"), (4, "why the blocker"), (5, "stripe cookies")], "id int, q string")
    assert {r.id: r.subject for r in Q.subject_of(q, v, "id", "q").collect()} == {1: "auth", 2: "clinic", 5: "pay"}
    assert {r.id: r.entity for r in Q.entity_of(q, v, "id", "q").collect()} == {1: "session cookies", 2: "therapy", 5: "cookies"}
    rows = {r.id: (r.subject, r.target, r.secondary) for r in Q.structure(q, v, "id", "q", issues=("blocker",)).collect()}
    assert rows[1] == ("auth", "session cookies", "OAuth") and rows[3] == (None, None, None) and rows[4][1] == "blocker"
    nouns = spark.createDataFrame([("OAuth",)], "token string")
    assert {r.id: r.target for r in Q.structure(q, v, "id", "q", nouns).collect()}[1] == "session cookies"


def test_intent_goldens(spark):
    cases = {
        "What is the current status of the auth service?": "current_state_lookup", "What\'s happening right now with the database?": "current_state_lookup", "What was the API version last month?": "historical_lookup",
        "The service used to return XML format": "historical_lookup", "What happened during the outage last night?": "event_reconstruction", "Walk me through the database migration": "event_reconstruction",
        "What\'s changed in the API?": "change_detection", "How is the new API compared to the old one?": "change_detection", "Is there a recurring theme?": "pattern_lookup", "What lessons have we learned?": "strategic_reflection",
        "Any recommendations from the retrospective?": "strategic_reflection", "Postgres port": "fact_lookup",
    }
    df = spark.createDataFrame(list(cases.items()), "q string, want string").withColumn("i", K.keyword_intent(F.col("q")))
    assert {r.q: r.i.intent for r in df.collect()} == cases and df.where("want = \'fact_lookup\'").first().i.confidence == 1.0


def test_slots_and_roles(spark):
    rows = [("I run every morning early", "habitual", {"frequency": "every morning early", "object": "run every morning early"}), ("Redis instead of Memcached.", "choice", {"object": "Redis", "alternative": "Memcached"}), ("tea", "none", {"object": "tea"})]
    df = spark.createDataFrame(rows, "t string, i string, want map<string,string>").withColumn("s", S.slots(F.col("t"), F.col("i")))
    assert all(r.s == r.want for r in df.collect())
    kind = "roles array<struct<role:string,canonical:string,slot:string>>, e array<string>"
    df = spark.createDataFrame([([("primary", "Postgres", "database"), ("alternative", "MySQL", "database")], ["postgres", "billing"]), ([("casual", "x", "y")], ["a"])], kind)
    got = [r.s for r in df.select(K.role_state(F.col("roles"), F.col("e")).alias("s")).collect()]
    assert (got[0].entity, got[0].key, got[0].value, got[0].previous) == ("billing", "database", "Postgres", "MySQL") and got[1] is None


def test_promotion_and_terms(spark):
    r = spark.createDataFrame([(1, 0.5), (2, 0.9)], "id int, score double")
    a = spark.createDataFrame([(3, 1), (1, 2)], "id int, place int")
    assert {x.id: (x.score, x.place) for x in S.promote(r, a, "id").collect()} == {1: (1.9, 2), 2: (0.9, None), 3: (1.9, 1)}
    d = spark.createDataFrame([("a", t, k) for k, t in enumerate("uvwxyz")] + [("b", t, k) for k, t in enumerate("vwp")], "entity string, partner string, rank int")
    assert S.expansion_terms(d, ["a", "b"], 6) == ["u", "v", "w", "p"] and S.expansion_terms(d, [], 6) == []


def test_similar_sets_and_clusters(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(12) for _ in range(rng.randrange(1, 7))]) for i in range(120)]
    sets = {i: set(x) for i, x in rows}
    jac = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    df = spark.createDataFrame(rows, "id long, items array<long>")
    for least in (0.3, 0.5, 0.8):
        want = {(a, b) for a in sets for b in sets if a < b and jac(a, b) >= least}
        assert {(r.a, r.b) for r in X.similar_sets(df, least).collect()} == want
    few = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b", "c"]), (3, ["b", "a"]), (4, ["z"]), (5, [])], "id long, items array<string>")
    assert [(r.ids, r.shared) for r in X.overlap_clusters(few, least=0.6).collect()] == [([1, 2, 3], ["a", "b"])]


def brute_episodes(rows, minutes=1440):
    scale, opened, out = 1 / 0.8, [], {}
    for f, at, names in sorted(rows, key=lambda r: (r[1], r[0])):
        names, best, where = set(names), 0.0, None
        opened = [e for e in opened if (at - e[2]).total_seconds() <= minutes * 60]
        for e in sorted(opened, key=lambda e: e[0]):
            if names & e[1]:
                s = scale * (0.25 * len(names & e[1]) / min(len(names), len(e[1])) + 0.15 + 0.10 * (1 - (at - e[2]).total_seconds() / minutes / 60))
                if s > best:
                    best, where = s, e
        if where is not None and best >= 0.30:
            where[1].update(names)
            where[2] = at
            out[f] = where[0]
        elif len(names) >= 2:
            opened.append([f, set(names), at])
            out[f] = f
    return out


def test_episodes_equal_brute_force(spark):
    rng, t0 = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 12)), [f"e{rng.randrange(9)}" for _ in range(rng.randrange(1, 4))]) for i in range(150)]
    df = spark.createDataFrame([("d", *r) for r in rows], "dom string, fragment_id long, at timestamp, entities array<string>")
    assert {r.fragment_id: r.episode_id for r in R.assign_episodes(df, "dom").collect()} == brute_episodes(rows)


def test_levels_have_no_limit(spark):
    p = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(0, 40)], "child long, parent long")
    got = G.descend(p, spark.createDataFrame([(0,)], "node long")).collect()
    assert len(got) == 41 and max(r.level for r in got) == 40
    with pytest.raises(RuntimeError):
        G.descend(p, spark.createDataFrame([(0,)], "node long"), most=5)


def test_resolved_subjects(spark):
    kind = "memory_id int, explicit array<struct<id:string,type:string,primary:boolean>>, legacy string, roles array<struct<role:string,surface:string,canonical:string,slot:string>>, label_confidence double, parent struct<id:string,type:string,primary:boolean,source:string,confidence:double,aliases:array<string>>"
    doc = ("doc:x", "doc", True, "caller", 1.0, [])
    rows = [
        (1, [("Auth Service", "service", False), ("db:pg", "db", False)], None, [], None, None), (2, [("a", "t", True), ("b", "t", True)], None, [], None, None), (3, [("a", "t", True)], "A", [], None, None), (4, [("a", "t", True)], "other", [], None, None),
        (5, [], "The API", [], 0.9, doc), (6, [], None, [("primary", "Redis", "redis", "cache")], 0.5, doc), (7, [], None, [("primary", "Redis", "redis", "cache")], 0.1, doc), (8, None, "", None, None, None),
    ]
    got = {r.memory_id: ([(s.id, s.primary, s.source) for s in r.subjects], r.conflict) for r in B.resolve(spark.createDataFrame(rows, kind)).collect()}
    assert got[1] == ([("service:auth-service", True, "caller"), ("db:pg", False, "caller")], False)
    assert got[2] == ([], True) and got[3][0] == [("t:a", True, "caller")] and got[4] == ([], True)
    assert got[5][0] == [("subject:the-api", True, "caller")] and got[6][0] == [("cache:redis", True, "slm_role")] and got[7][0] == [("doc:x", True, "document")] and got[8][0] == []
