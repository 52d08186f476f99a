"""Related episodes: each pair once, without a shuffle of pairs."""

from __future__ import annotations

import random

from recallforge.operators import recall as R


def test_related_episodes_make_each_pair_once(spark):
    rng = random.Random(3)
    topics = sorted({(e, rng.randrange(9)) for e in range(60) for _ in range(rng.randrange(4))})
    seeds = [(s, rng.randrange(60)) for s in range(8) for _ in range(2)]
    has = lambda e: {x for k, x in topics if k == e}
    own = {s: {e for k, e in seeds if k == s} for s, _ in seeds}
    want = {(s, e) for s in own for e in range(60) if e not in own[s] and has(e) & set().union(*map(has, own[s]))}
    df = R.related_episodes(spark.createDataFrame(topics, "episode_id long, entity long"), spark.createDataFrame(seeds, "seed long, episode_id long"))
    got = [(r.seed, r.episode_id) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Project") and "LeftAnti" not in plan  # pairs are neither made distinct nor joined again


def test_only_the_entities_before_the_shared_one_are_moved(spark):
    """A pair with many common entities is made at the first one, from what comes before it."""
    topics = spark.createDataFrame([(e, k) for e in range(6) for k in range(e, 12)] + [(9, None)], "episode_id long, entity long")
    df = R.related_episodes(topics, spark.createDataFrame([(1, 0), (1, 2), (2, 5)], "seed long, episode_id long"))
    assert sorted(map(tuple, df.collect())) == [(1, 1), (1, 3), (1, 4), (1, 5), (2, 0), (2, 1), (2, 2), (2, 3), (2, 4)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("slice(") == 2 and "array_intersect" not in plan
