"""The conversation prefix trie against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from recallforge.llm import prefix_trie as T
from tests.compare import SF

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def whole(rows):
    """conv_id: list of (role, text), in order."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0, digest), (role, text)))
    return {c: [t for _, t in sorted(v)] for c, v in convs.items()}


def again(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain(convs):
    members, kids = defaultdict(list), defaultdict(set)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            p = tuple(convs[c][:d])
            members[p].append(c)
            if d:
                kids[p[:-1]].add(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below[p] = (sum(below[k][0] for k in kids[p]) or 1, saved + sum(below[k][1] for k in kids[p]))
    rows = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(p))
        rows.add((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def got(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(T.op13_prefix_trie(spark, SF)) == plain(again(whole(rows)))


@pytest.mark.parametrize("waiting, partitions", [(50_000, 1), (3, 7), (50_000, 23)])
def test_nodes_across_partitions(spark, waiting, partitions):
    """Few turns, so that copies, prefixes of others and long shared paths abound."""
    rng = random.Random(partitions)
    rows = []
    for c in rng.sample(range(-40, 2000), 500):
        n = rng.choice([1, 2, 3, 5, 12, 40])
        odd = rng.random()
        rows += [(c, k if odd < 0.9 else None, rng.choice("ua"), rng.choice(["", "x", "été"]) if rng.random() < 0.2 else "same") for k in range(n)]
    rows += [(5000 + k, 0, "u", "hot") for k in range(300)] + [(None, 0, "u", "none"), (1, 1, None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", b"y") for r in rows], f"{SCHEMA}, key string, node binary")
    set_to = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in set_to}
    try:
        for k, v in set_to.items():
            spark.conf.set(k, v)
        convs = whole(rows)
        assert got(T.trie(T.keys(df), waiting)) == plain(convs)
        assert got(T.trie(T.rebuilt(df), waiting)) == plain(again(convs))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_empty_turnless_and_alone(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert T.trie(T.rebuilt(empty)).count() == 0
    lone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(lone, 0, "u", "gone")]
    assert got(T.trie(T.rebuilt(spark.createDataFrame(rows, SCHEMA)))) == {(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())}


def test_shared_turns():
    rng = random.Random(3)
    for _ in range(300):
        a = [bytes([rng.randrange(2)]) * T.TURN for _ in range(rng.randrange(40))]
        b = a[: rng.randrange(41)] + [bytes([rng.randrange(2)]) * T.TURN for _ in range(rng.randrange(5))]
        want = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert T.shared_turns(b"".join(a), b"".join(b)) == want
