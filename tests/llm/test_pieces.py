"""SentencePiece encoding and decoding against the library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from recallforge.llm import piece_codec as C
from tests.compare import SF

TEXTS = [None, "", " ", "  a  b ", "▁x▁▁ y", "a\nb\x00", "　x é", "<s>a</s>", "😀▁", "▁", "x" * 30_000, "a b\r\n);\r\n", "日本語 текст", "word " * 4000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=C.model_path())


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_whole_table(spark, library):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    assert {r.doc_id: tuple(r)[1:] for r in C.op11_piece_codec(spark, SF).collect()} == want


def test_odd_rows_and_steps(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "y"), (3, "again", "z"), (3, "again", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    ids = C.encode(df)
    want = sorted((str(i), library.encode(t or "", add_eos=True)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in ids.collect()) == want
    texts = sorted((str(r.doc_id), r.text) for r in C.decode(ids).collect())
    assert texts == sorted((str(i), library.decode(library.encode(t or ""))) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.decoded) for r in C.round_trip(df).collect()) == texts
    assert C.check(df).count() == 0
    assert [list(r.ids) for r in C.encode(df.where("doc_id = 1").limit(1), end_id=7).collect()] == [[7]]
    assert C.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<long>")).collect() == [(1, None), (2, "")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert C.round_trip(df).count() == 0 and C.check(df).count() == 0


@pytest.fixture(scope="module")
def model():
    return C.PieceModel(C.model_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aeitnrs ▁ \n\r.;(){}é日😀\x00Ω12"), max_size=40) | st.text(max_size=20), max_size=8))
def test_any_text(model, library, texts):
    texts = [t for t in texts if t.isascii() or not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    ids, n = model.encode([t.encode() for t in texts], 2)
    cut = np.concatenate([[0], np.cumsum(n)])
    assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == [[*x, 2] for x in library.encode(texts)]


def test_any_ids(model, library):
    rng = random.Random(1)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(259), 259, 1, 2, 28705]) for _ in range(rng.randrange(9))]
        assert model.decode(np.array(ids, np.int64)).decode() == library.decode(ids)


def test_a_table_that_starts_anew_gives_the_same(monkeypatch, library):
    monkeypatch.setattr(C, "CACHE_PARTS", 5)
    model = C.PieceModel(C.model_path())
    for k in range(40):
        text = f"number {k} of the words {k * k}"
        assert model.encode([text.encode()], 2)[0].tolist() == library.encode(text, add_eos=True)
    assert len(model.place) < 40


def test_other_vocabularies_are_refused(tmp_path):
    raw = open(C.model_path(), "rb").read()
    top = list(C._fields(raw))
    for field, number, value in ((C._TRAINER, C._MODEL_TYPE, 1), (C._NORMALIZER, C._REMOVE_SPACES, 1), (C._TRAINER, C._BYTE_FALLBACK, 0)):
        tag = number << 3
        extra = bytes([tag, value]) if tag < 0x80 else bytes([tag & 0x7F | 0x80, tag >> 7, value])
        (tmp_path / "m").write_bytes(b"".join(C._message(m, body + (extra if m == field else b"")) for m, body in top))
        with pytest.raises(ValueError):
            C.PieceModel(str(tmp_path / "m"))
