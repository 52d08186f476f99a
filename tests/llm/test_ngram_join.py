"""The join against brute force over all pairs."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from recallforge.llm import ngram_join as J
from tests.compare import SF


def words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    """{doc_id: (class_id, n_links)} of (doc_id, text) with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    links, root = defaultdict(int), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def found(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


def near_copies(n, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    return rows


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(J.op1_ngram_join(spark, SF)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_large_group_is_split_into_tiles(spark):
    rows = near_copies(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(J.classes(df, small=4, tile=7)) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A, b!"), (5, long), (6, long + " end"), (None, "a b"), (7, "c d e f g"), (7, "c d e f g"), (8, "!!")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, class_id int")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.class_id, r.n_links) for r in J.classes(df).collect())
    assert got == [(False, 0, None, 0), (True, 1, 1, 0), (True, 2, 2, 0), (True, 3, 3, 1), (True, 4, 3, 1), (True, 5, 5, 1), (True, 6, 5, 1), (True, 7, 7, 0), (True, 7, 7, 0), (True, 8, 8, 0)]
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 7, 8]


def test_empty(spark):
    assert J.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recall_of_pairs_at_the_threshold(spark):
    rng = random.Random(5)
    rows, pairs = [], 150
    for k in range(pairs):  # two texts that differ in one run of words: Jaccard just above 4/5
        w = [f"k{k}v{rng.randrange(10**6)}" for _ in range(90)]
        v = list(w)
        v[40:45] = [f"z{k}n{i}" for i in range(5)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    want = brute(rows)
    linked = sum(v[1] for v in want.values())
    got = found(J.classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert linked and sum(v[1] for v in got.values()) >= 0.99 * linked


def test_runs():
    """1 - ((1 - t) / t)^2 per run, as simulated shared nodes of two sets die out."""
    assert J.runs_for(0.99, 0.8) == 2 and J.runs_for(0.999, 0.8) == 3 and J.runs_for(0.99, 0.6) == 6
    rng, lost = random.Random(1), 0
    for _ in range(2000):
        alive = 1
        for _ in range(12):
            nxt = 0
            for _ in range(min(alive, 64)):
                union = [rng.random() < 0.8 for _ in range(8)]  # the smallest of the union, common or not
                mine, other = [], []
                for k, common in enumerate(union):
                    side = rng.random() < 0.5
                    if len(mine) < 2 and (common or side):
                        mine.append(k)
                    if len(other) < 2 and (common or not side):
                        other.append(k)
                nxt += len({k for k in mine if union[k]} & {k for k in other if union[k]})
            alive = nxt
            if not alive:
                break
        lost += not alive
    assert lost / 2000 <= (0.2 / 0.8) ** 2


def test_recursion_goes_on_below_the_first_levels(spark, monkeypatch):
    """Texts that share most of one passage, so that buckets stay large for long,
    with near copies among them; paths of one level come with the shingles."""
    monkeypatch.setattr(J, "DEPTH", 1)
    passes, deeper = [], J._leaves
    monkeypatch.setattr(J, "_leaves", lambda *a: passes.append(1) or deeper(*a))
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for i in range(0, 240, 2):
        own = [f"o{i}x{rng.randrange(10**6)}" for _ in range(60)]
        w = passage + own
        v = list(w)
        v[100] = f"changed{i}"
        rows += [(i, " ".join(w)), (i + 1, " ".join(v))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(J.classes(df, small=4)) == brute(rows)
    assert len(passes) > 1


def test_tiles_are_cut_by_tokens(spark):
    rows = near_copies(40, seed=8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(J.classes(df, tile_tokens=500)) == brute(rows)


def test_texts_that_share_a_doc_id(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "x"), (1, b, "y"), (2, b, "z"), (3, a + " end", "u"), (4, None, "v"), (4, "!!", "w"), (4, a, "t"), (None, a, "s"), (5, b, "r"), (5, b + "!", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _place string")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in J.classes(df.drop("_place")).collect())
    assert got == [(0, 0, 0), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 1, 2), (4, 4, 0), (4, 4, 0), (5, 1, 2), (5, 1, 2)]
    kept = sorted(((r.doc_id or 0, r.text or "") for r in J.keep_one(df.withColumnRenamed("_place", "n_links")).collect()))
    assert kept == [(0, a), (1, a), (1, b), (4, ""), (4, "!!")]


def test_hot_paths_and_records_are_dealt(spark):
    """More copies and more near copies than a key may hold in one task."""
    same = [(i, "one text that many documents hold word for word") for i in range(3000)]
    rows = same + [(5000 + i, t) for i, t in near_copies(30)]
    got = found(J.classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(got[i] == (0, 2999) for i in range(3000)) and {got[5000 + i] for i in range(30)} == {v for v in [got[5000]]}
    assert got[5000][0] == 5000


def test_a_phrase_that_many_short_texts_share_is_split_up(spark, monkeypatch):
    """Leaves stay small, so comparisons grow with the texts and not with their square;
    texts of seven words, which link with equal ones only, are in no leaf at all."""
    import pandas as pd

    largest = {}
    written = J._io.written

    def sizes(threshold):
        return lambda key, rows: pd.DataFrame({"record": [b""], "other": [None], "links": [len(rows)]})

    for words in (7, 9, 13):
        for n in (1500, 6000):
            rng = random.Random(n + words)
            text = lambda: " ".join(["as is without any warranty", *(f"v{rng.randrange(10**6)}" for _ in range(words - 5))])  # noqa: B023, E731
            rows = [(k, text()) for k in range(n)]
            seen = []

            def spy(df, stem):
                out = written(df, stem)
                if stem == "links":
                    seen.append(out)  # noqa: B023
                return out

            with monkeypatch.context() as m:
                m.setattr(J._io, "written", spy)
                m.setattr(J, "_join_tile", sizes)
                J._classes(spark.createDataFrame(rows, "doc_id long, text string"), J.THRESHOLD, J.RECALL, 64, J.TILE, J.TILE_TOKENS)
            leaves = [r.links for r in seen[0].collect()]
            largest[words, n] = max(leaves, default=0)
    assert largest[7, 1500] == largest[7, 6000] == 0
    assert 0 < max(largest.values()) <= 64


def test_tiny_sets_link_with_equal_ones(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f h"), (3, "a b c d e f g"), (4, "a b c d e f g h"), (5, "x b c d e f g h"), (6, "a b"), (7, "a b")]
    assert found(J.classes(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
