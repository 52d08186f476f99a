"""The ingest stream: every table once per text, whatever fails or comes again."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pandas as pd
import pytest

from recallforge.operators import fulltext as X
from recallforge.operators import recall as R
from recallforge.streaming.ingest import TASK, Ingest

START = datetime(2024, 1, 1)


def extractor(folder, broken=()):
    """Capitalised words; texts with ``flaky`` fail the first two times, ``broken`` ones
    always.  Tries are counted in files, for workers share nothing else."""

    def extract(texts: pd.Series) -> pd.Series:
        if len(texts) > 1 and any("flaky" in t or "broken" in t for t in texts):
            raise RuntimeError("a text of the batch is bad")
        out = []
        for t in texts:
            if "broken" in t:
                raise ValueError("cannot read " + t)
            if "flaky" in t:
                tries = folder / re.sub(r"\W", "", t)
                n = int(tries.read_text()) if tries.exists() else 0
                tries.write_text(str(n + 1))
                if n < 2:
                    raise TimeoutError("busy")
            out.append(re.findall(r"\b[A-Z]\w+", t))
        return pd.Series(out)

    return extract


def tasks(spark, rows):
    return spark.createDataFrame(rows, TASK)


TEXTS = [
    (1, "Redis serves Auth", "ops", START, ["auth"]),
    (2, "flaky Postgres serves Auth", "ops", START + timedelta(hours=1), None),
    (3, "broken text", "ops", START + timedelta(hours=2), None),
    (4, None, None, None, None),
    (5, "auth-service: status = Active for Auth Redis", "ops", START + timedelta(hours=3), []),
]
LATER = [(6, "Redis and Auth again", "ops", START + timedelta(hours=4), None), (1, "Redis serves Auth", "ops", START, None), (None, "no id", "ops", START, None)]


def rows_of(ingest, name, *columns):
    t = ingest.read(name)
    return sorted(tuple(r[c] for c in columns) for r in t.collect()) if t is not None else []


def test_stream_with_a_failing_extractor(spark, tmp_path):
    index = X.FullText(spark, str(tmp_path / "index"), "memory_id", (X.Field("content", stem=True),))
    (tmp_path / "tries").mkdir()
    ingest = Ingest(spark, str(tmp_path / "tables"), extractor(tmp_path / "tries"), index)
    assert ingest.read("links") is None and ingest.drain() == 0
    for part in (TEXTS, LATER):
        tasks(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(tasks(spark, []).schema).parquet(str(tmp_path / "in"))
        ingest.sink(stream, str(tmp_path / "checkpoint"), "texts", once=True).awaitTermination()
    assert rows_of(ingest, "waiting", "memory_id", "attempt") == [(2, 3), (3, 3)]
    assert rows_of(ingest, "nodes", "memory_id") == [(1,), (4,), (5,), (6,)]
    assert ingest.drain() == 1
    assert rows_of(ingest, "waiting", "memory_id") == []
    assert rows_of(ingest, "dead", "memory_id", "attempt", "error") == [(3, 3, "ValueError: cannot read broken text")]
    assert rows_of(ingest, "memories", "memory_id") == [(k,) for k in range(1, 7)]
    assert rows_of(ingest, "nodes", "memory_id") == [(1,), (2,), (4,), (5,), (6,)]
    ids = {r.name.lower(): r.entity_id for r in ingest.read("entities").collect()}
    links = {(m, e) for m, e in rows_of(ingest, "links", "memory_id", "entity_id")}
    assert {m for m, e in links if e == ids["auth"]} == {1, 2, 5, 6} and (2, ids["postgres"]) in links
    assert len(links) == ingest.read("links").count()
    pair = sorted((ids["auth"], ids["redis"]))
    assert sum(n for a, b, n in rows_of(ingest, "counts", "src", "dst", "count") if [a, b] == pair) == 3
    # the episode goes on over the batches, and takes the text that came late
    assert rows_of(ingest, "members", "fragment_id", "episode_id") == [(1, 1), (2, 1), (5, 1), (6, 1)]
    assert index.manifest().n == 6 and {r.memory_id for r in index.search("redis").collect()} == {1, 5, 6}

    before = {name: rows_of(ingest, name, "memory_id") for name in ("memories", "nodes", "links")}
    ingest.apply(tasks(spark, [(9, "New Name", "ops", START, None)]), "texts", 1)  # delivered again
    assert before == {name: rows_of(ingest, name, "memory_id") for name in before}
    ingest.vacuum()
    assert before == {name: rows_of(ingest, name, "memory_id") for name in before}
    assert not list((tmp_path / "tables" / "tried").iterdir())


def test_a_batch_that_breaks_off_counts_once(spark, tmp_path, monkeypatch):
    index = X.FullText(spark, str(tmp_path / "index"), "memory_id", (X.Field("content"),))
    ingest = Ingest(spark, str(tmp_path / "tables"), extractor(tmp_path), index)
    batch = tasks(spark, [TEXTS[0], TEXTS[4]])
    with monkeypatch.context() as m:
        m.setattr(R, "episode_step", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest.apply(batch, "texts", 0)
    assert ingest.read("memories") is None
    ingest.apply(batch, "texts", 0)
    assert rows_of(ingest, "memories", "memory_id") == [(1,), (5,)] == rows_of(ingest, "nodes", "memory_id")
    assert index.manifest().n == 2 and index.manifest().version == 1
    ingest.vacuum()
    assert len(list((tmp_path / "tables" / "memories").iterdir())) == 1


def test_steps_give_what_one_batch_gives(spark):
    from tests.test_question import brute_episodes

    rows = [(k, START + timedelta(hours=5 * k), [f"e{k % 4}", f"e{(k * 7) % 5}", "e9"] if k % 3 else [f"x{k % 2}", "y"]) for k in range(40)]
    kind = "dom string, fragment_id long, at timestamp, entities array<string>"
    got, opened = {}, None
    for a in range(0, 40, 10):
        step = R.episode_step(spark.createDataFrame([("d", *r) for r in rows[a : a + 10]], kind), opened, "dom").collect()
        got |= {r.fragment_id: r.episode_id for r in step if r.kind == "member"}
        opened = spark.createDataFrame([(r.episode_id, r.dom, r.entities, r["at"]) for r in step if r.kind == "open"], "episode_id long, dom string, entities array<string>, at timestamp")
    assert got == brute_episodes(rows)
