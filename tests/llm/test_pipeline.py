"""The pipeline against its stages done by brute force."""

from __future__ import annotations

import re

import corpus_pipeline
from recallforge.llm import packing
from tests.compare import SF
from tests.llm.test_models import brute_hits
from tests.llm.test_ngram_join import brute
from tests.llm.test_scans import python_spans
from tests.llm.test_tokens import packed, reference


def test_stages_are_listed():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "decontamination", "secret_scan", "packing"]


def test_pipeline(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    step, frames = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES:
        step = f(spark, step, SF)
        frames[name] = step
        if name != "packing":
            assert step.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    named = {r.doc_id for r in frames["language_id"].collect()}
    assert all(any(map(str.isalpha, docs[d].text or "")) for d in named) and len(named) == len(docs)
    groups = brute([(d, docs[d].text) for d in named])
    one = {d for d, (c, _) in groups.items() if c == d}
    assert {r.doc_id for r in frames["ngram_join"].collect()} == one
    clean = {d for d in one if brute_hits(docs[d].text, items)[1] == 0}
    assert {r.doc_id for r in frames["decontamination"].collect()} == clean
    masked = {r.doc_id: r.text for r in frames["secret_scan"].collect()}
    assert set(masked) == clean
    for d in clean:
        if not python_spans(docs[d].text) and not re.search(r"://|gh[pousr]_|xox|AIza|_live_|eyJ|BEGIN", docs[d].text):
            assert masked[d] == docs[d].text
        assert not python_spans(masked[d])
    parts, bins = packed(frames["packing"])
    assert all(size in packing.LENGTHS for _, size, _, _ in bins)
    want = dict(zip(masked, reference(masked.values()), strict=True))
    assert {d: [x for _, p in sorted(pieces) for x in p] for d, pieces in parts.items()} == want


def test_run(spark, monkeypatch):
    """run() gives what its stages give in turn, and leaves its result alone behind."""
    from recallforge.llm import _io

    monkeypatch.setattr(_io, "_written", [])
    got = corpus_pipeline.run(spark, SF)
    assert len(_io._written) == 1 and "packing" in _io._written[0]
    step = spark.read.parquet(f"{SF}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        step = f(spark, step, SF)
    assert packed(got) == packed(step)


ODD = "lang string, lang_pred string, score double, record string, path string, _rules int, secret_spans int, ids int, shard int, start int, hits int, _record int"


def odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang) for r in docs]
    long = " ".join(f"{w}{i}" for i in range(9000) for w in ("the", "of"))
    rows += [(10**6, None, "en"), (10**6 + 1, "", None), (10**6 + 2, "!!", "de"), (10**6 + 3, long, None), (None, rows[0][1], None), rows[1], rows[1], (rows[2][0], rows[3][1] + " and more of it", "en"), (10**6 + 4, "token=abcdefgh12 " + rows[4][1], "en")]
    return rows


def frame(spark, rows):
    names = [f.split()[0] for f in ODD.split(", ")][1:]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(7).alias(n) if n != "lang_pred" else F.lit("x").alias(n) for n in names])


def test_stages_on_odd_rows(spark):
    rows = odd_rows(spark)
    docs = frame(spark, rows)
    for name, f in corpus_pipeline.STAGES:
        got = f(spark, docs, SF)
        if name == "packing":
            assert sum(len(r.doc_ids) for r in got.collect()) >= len(rows)
            continue
        assert got.columns == docs.columns, name
        kept = got.collect()
        assert all(r.score == 7 and r.lang_pred == "x" for r in kept)
        ids = [r.doc_id for r in kept]
        if name == "language_id":
            assert not {10**6, 10**6 + 1, 10**6 + 2} & set(ids) and len(kept) >= len(rows) - 6
        elif name == "ngram_join":
            assert {10**6, 10**6 + 1, 10**6 + 2, 10**6 + 3, None} <= set(ids) and ids.count(rows[1][0]) <= 1
        elif name == "decontamination":
            assert {10**6, 10**6 + 1, 10**6 + 2, 10**6 + 3} <= set(ids)
        else:
            assert len(kept) == len(rows) and {r.doc_id: r.text for r in kept}[10**6] is None
            assert "[SECRET]" in next(r.text for r in kept if r.doc_id == 10**6 + 4)


def test_stages_on_empty_tables(spark):
    docs = frame(spark, odd_rows(spark)).limit(0)
    for name, f in corpus_pipeline.STAGES:
        got = f(spark, docs, SF)
        assert got.count() == 0 and (name == "packing" or got.columns == docs.columns)
