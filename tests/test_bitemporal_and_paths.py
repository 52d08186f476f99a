"""As-of by validity across partitions, and path routing, against plain Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from fnmatch import fnmatch
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from recallforge.operators import bitemporal, routing

START = datetime(2024, 1, 1)
STATES = "node_id long, e long, k string, valid_from timestamp, valid_to timestamp, created_at timestamp"


def plain(states, probes):
    out = {}
    for p, e, k, at in probes:
        mine = [s for s in states if s[1:3] == (e, k)] if at is not None and e is not None and k is not None else []
        valid = [s for s in mine if s[3] and s[3] <= at and (s[4] is None or s[4] > at)]
        made = [s for s in mine if s[5] and s[5] <= at]
        if valid:
            out[p] = (max(valid, key=lambda s: (s[3], s[0]))[0], True)
        elif made:
            out[p] = (max(made, key=lambda s: (s[5], s[0]))[0], False)
    return out


@pytest.mark.parametrize("hot, partitions", [(0.0, 4), (0.8, 13)])
def test_as_of(spark, hot, partitions):
    """One subject that holds most rows spans many partitions."""
    rng = random.Random(partitions)
    when = lambda: None if rng.random() < 0.15 else START + timedelta(hours=rng.randrange(60))
    who = lambda: (1, "a") if rng.random() < hot else (rng.choice([None, *range(5)]), rng.choice(["a", "b", None]))
    states = [(n, *who(), when(), when(), when()) for n in range(400)]
    probes = [(p, *who(), when()) for p in range(300)]
    set_to = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in set_to}
    try:
        for k, v in set_to.items():
            spark.conf.set(k, v)
        got = bitemporal.as_of(spark.createDataFrame(states, STATES), spark.createDataFrame(probes, "p long, e long, k string, t timestamp"), ["e", "k"], "p", "t").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == len({r.p for r in got})
    assert {r.p: (r.node_id, r.by_validity) for r in got} == plain(states, probes)


def test_as_of_empty_tables(spark):
    none, probe = spark.createDataFrame([], STATES), spark.createDataFrame([(1, 1, "a", START)], "p long, e long, k string, t timestamp")
    assert bitemporal.as_of(none, probe, ["e", "k"], "p", "t").count() == 0
    one = spark.createDataFrame([(7, 1, "a", None, None, START)], STATES)
    assert bitemporal.as_of(one, probe, ["e", "k"], "p", "t").collect() == [(1, 7, False)]
    assert bitemporal.as_of(one, probe.limit(0), ["e", "k"], "p", "t").count() == 0


PATHS = ["/w/docs/a.md", "/w/x/.env", "/w/x/a.b.SQL", "/w/src/deep/er/code.py", "/w/Tests/t.py", "readme", "/w/x/notes.", "/w/x/..hidden.yml", "a/b.tf", "/w/src/api/spec.proto", "/w/src/apiary/x.bin", "/other/docs/z.rst"]
RULES = [("src/*.py", "python", 1), ("*/er/*", "er", 9), ("[ab]/?.tf", "terra", 2)]


def named(path, root, prefixes):
    p = PurePosixPath(path)
    inner = str(p.relative_to(root)) if root and p.is_relative_to(root) else path
    for pattern, domain, _ in sorted(RULES, key=lambda r: -r[2]):
        if fnmatch(inner, pattern):
            return domain, "path_rule"
    for prefix in sorted(prefixes, key=len, reverse=True):
        if p.parent.is_relative_to("/" + prefix.strip("/")):
            return prefixes[prefix], "path_rule"
    if p.parent.name.lower() in routing.DIRECTORIES:
        return routing.DIRECTORIES[p.parent.name.lower()], "directory_name"
    if p.suffix.lower() in routing.EXTENSIONS:
        return routing.EXTENSIONS[p.suffix.lower()], "extension"
    return ((root or p.parent).name.lower() if root else p.parent.name.lower()) or "general", "fallback"


@pytest.mark.parametrize("root", [None, PurePosixPath("/w")])
def test_paths(spark, root):
    prefixes = {"/w/src/api": "api-folder", "w/src": "source", "w/src/api/spec.proto/": "too deep"}
    df = spark.createDataFrame([(p,) for p in [*PATHS, None]], "path string")
    df = routing.by_prefix(df, "path", spark.createDataFrame([*prefixes.items(), (None, "x")], "prefix string, domain string"))
    c = routing.classify(F.col("path"), rules=RULES, root=str(root) if root else None, prefix_domain=F.col("prefix_domain"))
    got = {r.path: (r.c.domain, r.c.source) for r in df.select("path", c.alias("c")).collect()}
    assert {p: got[p] for p in PATHS} == {p: named(p, root, prefixes) for p in PATHS}
    assert df.select(routing.classify(F.col("path"), default="all").alias("c")).first().c == ("all", "explicit", 1.0)
    assert routing.by_prefix(df.select("path"), "path", spark.createDataFrame([], "prefix string, domain string")).where("prefix_domain is null").count() == len(PATHS) + 1
