"""Episodes of many fragments: whole and as many comparisons as the latest ones need."""

from __future__ import annotations

import datetime as dt
import random

from recallforge.operators import graph, recall as R
from tests.test_question import brute_episodes


class Counted(set):
    """Members of an episode, counting how often they are compared."""

    seen = 0

    def __rand__(self, other):
        Counted.seen += 1
        return set(other) & set(self)


def test_late_fragments_are_compared_with_the_latest_episodes():
    walk = R.EpisodeWalk(0.30, 1440, 2)
    for e in range(200):  # all hold the same two entities
        walk.hold(e, {"a", "b", f"x{e}"}, float(e))
    for found in walk.opened.values():
        found[0] = Counted(found[0])
    Counted.seen = 0
    for k in range(50):
        assert walk.place(1000 + k, 200.0 + k, {"a", "b"}) == 199
        walk.opened[199][0] = Counted(walk.opened[199][0])
    assert Counted.seen < 50 * 5, Counted.seen


def test_many_fragments_equal_brute_force(spark):
    """Sparse and dense domains, equal times, silences, and entities that one domain alone has."""
    rng, t0 = random.Random(11), dt.datetime(2024, 1, 1)
    rows = {"d": [], "s": [], "t": []}
    for i in range(600):
        rows["d"].append((i, t0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 3)), [f"u{rng.randrange(200)}", f"k{rng.randrange(12)}"]))
        rows["s"].append((1000 + i, t0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 90)), [f"e{rng.randrange(25)}" for _ in range(rng.randrange(0, 4))]))
        rows["t"].append((2000 + i, t0 + dt.timedelta(minutes=1440 * rng.randrange(6)), [f"e{rng.randrange(300)}" for _ in range(rng.randrange(1, 4))]))
    df = spark.createDataFrame([(d, *r) for d, mine in rows.items() for r in mine], "dom string, fragment_id long, at timestamp, entities array<string>")
    want = {}
    for mine in rows.values():
        want |= brute_episodes(mine)
    assert {r.fragment_id: r.episode_id for r in R.assign_episodes(df, "dom").collect()} == want


def test_rows_are_no_nodes(spark, monkeypatch):
    """Chains are sought among entities: as many nodes as a domain has of them."""
    seen, components = [], graph.components
    monkeypatch.setattr(graph, "components", lambda e, *a: seen.append(components(e, *a)) or seen[-1])
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("d", i, t0 + dt.timedelta(minutes=i), [f"u{i % 7}", f"k{i % 5}"]) for i in range(300)], "dom string, fragment_id long, at timestamp, entities array<string>")
    assert R.assign_episodes(df, "dom").count() == 300 and seen[0].count() == 12
