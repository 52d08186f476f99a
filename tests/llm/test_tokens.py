"""Token files, edit-aware counts and packing: exact round trips."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from recallforge.llm import edit_count as E, packing as P, token_store as K
from tests.compare import SF

TEXTS = [None, "", "  ", "Hello, world!", "don't it's x's «q» 'S", "İstanbul ÉTÉ été... 12.5", "a<|endoftext|>b", "tab\tnew\nline 　wide", "ſ K ΑΣ é", "word " * 5000, "日本語 текст", "***bold*** ((x))", "\x00a\x1fb"]


def reference(texts):
    tok = Tokenizer.from_file(K.tokenizer_path())
    return [[*tok.encode(t or "", add_special_tokens=False).ids, K.END_ID] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_whole_table(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    ids = reference([r.text for r in docs])
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in K.op3_token_store(spark, SF).collect()}
    at = 0
    for r, i in zip(docs, ids, strict=True):
        assert got[r.doc_id] == (at, len(i), crc(i))
        at += len(i)


def test_odd_texts_and_order(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "y"), (3, "again", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    K.write_tokens(df, str(tmp_path / "t"), shards=3)
    got = K.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in got] == [r[0] for r in order]
    assert [list(r.ids) for r in got] == reference([r[1] for r in order])
    meta = K.read_tokens(spark, str(tmp_path / "t"), with_ids=False)
    assert "ids" not in meta.columns and meta.count() == len(rows)


def test_very_many_null_ids_are_many_shards(spark, tmp_path):
    rng = random.Random(5)
    rows = [(None if k % 4 else 7, f"{rng.randrange(10**6)} words of text {k}") for k in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    K.write_tokens(df, str(tmp_path / "t"), shards=8)
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "t")).groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * len(rows) / 8
    got = K.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r.doc_id for r in got] == [r[0] for r in want]
    assert [list(r.ids) for r in got[:50]] == reference([t for _, t in want[:50]])
    K.write_tokens(df, str(tmp_path / "sized"))
    assert spark.read.parquet(str(tmp_path / "sized")).agg({"shard": "max"}).first()[0] < 2 * spark.sparkContext.defaultParallelism


def test_empty_table(spark, tmp_path):
    K.write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"))
    assert K.token_digest(K.read_tokens(spark, str(tmp_path / "t"))).count() == 0


@pytest.mark.parametrize("name, known", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_any_tokenizer_file_gives_the_library_ids(spark, name, known):
    path = K.tokenizer_path(name)
    assert K.PieceEncoder(path).by_piece == known
    tok = Tokenizer.from_file(path)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in K.encode(df, tokenizer=path, end_id=7).collect()}
    assert got == {i: [*tok.encode(t or "", add_special_tokens=False).ids, 7] for i, t in enumerate(TEXTS)}


def test_files_have_row_groups_indexes_and_delta_pages(spark, tmp_path):
    """Footers: several row groups, column and offset indexes, delta-encoded ids; and
    a read of one document opens few of the row groups."""
    import glob

    import pyarrow.parquet as pq

    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))) for i in range(600)]
    K.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "t"), shards=1, row_group_bytes=1 << 18, page_bytes=1 << 14)
    (file,) = glob.glob(str(tmp_path / "t" / "*.parquet"))
    meta = pq.ParquetFile(file).metadata
    assert meta.num_row_groups > 2
    for g in range(meta.num_row_groups):
        cols = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
        assert all(c.has_offset_index and c.compression == "ZSTD" for c in cols.values())
        assert cols["doc_id"].has_column_index and cols["local_start"].has_column_index
        ids = next(c for name, c in cols.items() if name.startswith("ids"))
        assert {"DELTA_BINARY_PACKED", "RLE_DICTIONARY"} & set(ids.encodings)
        assert "DELTA_BINARY_PACKED" in cols["doc_id"].encodings or "RLE_DICTIONARY" in cols["doc_id"].encodings
    ends = [meta.row_group(g).column(0).statistics for g in range(meta.num_row_groups)]
    assert all(a.max < b.min for a, b in zip(ends, ends[1:]))
    one = K.read_tokens(spark, str(tmp_path / "t")).where("doc_id = 333")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,333)" in one._jdf.queryExecution().toString() and len(one.collect()) == 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAbéÉßİ'.,* \n\t1½́日"), max_size=24), min_size=1, max_size=4))
def test_pieces_equal_the_tokenizer(texts):
    import pyarrow as pa

    from recallforge.llm._text import utf8

    enc = K._encoder(K.tokenizer_path())
    data, off = utf8(pa.array(texts, pa.string()))
    ids, n = enc.encode(data, off, 0, len(texts), K.END_ID)
    want = reference(texts)
    assert ids.tolist() == [x for r in want for x in r] and n.tolist() == [len(r) for r in want]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é\n'1.  "), max_size=200), st.lists(st.tuples(st.integers(0, 220), st.integers(0, 40), st.text(alphabet=st.sampled_from("xy \n'"), max_size=12)), max_size=5))
def test_edits_equal_a_new_count(text, edits):
    count = E._counter(None)
    leaves = E.cut_leaves(text, 8)
    tree = E.TokenTree(leaves, [count(x) for x in leaves], count)
    assert tree.n_tokens == count(text)
    for start, cut, new in edits:
        tree.edit(start, start + cut, new)
        start = min(start, len(text))
        text = text[:start] + new + text[start + cut :]
        assert tree.text() == text and tree.n_tokens == count(text) and tree.n_chars == len(text)


def test_edit_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("edits", E.revision())
    enc = E.encoding()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in E.apply_edits(E.build(docs), with_text=True).collect():
        assert r.n_tokens == len(enc.encode_ordinary(texts[r.doc_id])) and r.n_tokens_after == len(enc.encode_ordinary(r.text_after))
    assert E.op6_edit_counts(spark, SF).count() == len(texts)


def test_edit_odd_rows(spark):
    rows = [(1, None, [(0, 0, "hi there")]), (2, "", None), (3, "abc", [(-5, 99, None)]), (None, "x y", [(None, None, "z")]), (3, "abc", [(1, None, "Z")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,stop:int,text:string>>")
    got = sorted((r.doc_id or 0, r.text_after) for r in E.apply_edits(E.build(df), with_text=True).collect())
    assert got == [(0, "x y"), (1, "hi there"), (2, ""), (3, ""), (3, "aZbc")]
    assert E.apply_edits(E.build(df.limit(0))).count() == 0


def test_best_fit_takes_a_tightest_bin():
    rng = random.Random(1)
    for _ in range(30):
        pieces = sorted((rng.randrange(1, 65) for _ in range(80)), reverse=True)
        where, used = P.best_fit(pieces, (16, 32, 64), P.sequence_cost)
        room, cap = {}, {}
        rest = sum(pieces)
        for n, b in zip(pieces, where, strict=True):
            if b in room:
                assert room[b] == min(r for r in room.values() if r >= n)
            else:
                assert not any(r >= n for r in room.values())
                cap[b] = room[b] = min((s for s in (16, 32, 64) if s >= n), key=lambda s: (P.sequence_cost(s) / min(s, rest), s))
            room[b] -= n
            rest -= n
        assert [cap[b] - room[b] for b in range(len(used))] == used


def packed(df):
    """(pieces of each document, bins) of sequences."""
    parts, bins = {}, []
    for r in df.collect():
        at, bin_ = 0, []
        for doc, start, n in zip(r.doc_ids, r.starts, r.lengths, strict=True):
            parts.setdefault(doc, []).append((start, list(r.ids[at : at + n])))
            at += n
            bin_.append(n)
        assert at == len(r.ids) == r.used
        bins.append((r.bin_id, r.capacity, r.used, bin_))
    return parts, bins


def test_packing_keeps_every_token(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, reference(texts.values()), strict=True))
    parts, bins = packed(P.pack_texts(docs, shard_tokens=20_000))
    assert len({b for b, *_ in bins}) == len(bins) and len({b >> 40 for b, *_ in bins}) > 1
    for d, pieces in parts.items():
        assert [x for _, p in sorted(pieces) for x in p] == want[d]
        assert all(start % P.LENGTHS[-1] == 0 for start, _ in pieces)
    assert set(parts) == set(want)
    assert all(size == min(s for s in P.LENGTHS if s >= used) for _, size, used, _ in bins)
    _, one = packed(P.pack_texts(docs))
    assert sum(map(len, want.values())) / sum(size for _, size, *_ in one) > 0.95
    got = sorted((r.doc_id, r.piece_start, r.piece_tokens, r.ids_crc32) for r in P.op9_packing(spark, SF).collect())
    top = P.LENGTHS[-1]
    assert got == sorted((d, a, len(ids[a : a + top]), crc(ids[a : a + top])) for d, ids in want.items() for a in range(0, len(ids), top))


def test_packing_odd_rows(spark):
    rows = [(1, None, 5), (None, [7] * 40_000, 5), (2, [], 5), (2, [1, 2], 5), (2, [1, 2], 5), (None, [3], 6)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, bin_id int")
    for options in ({}, {"round_tokens": 2}, {"shards": 3}):
        parts, bins = packed(P.pack(df, **options))
        assert sorted(len(p) for x in parts.values() for _, p in x) == [0, 0, 1, 2, 2, 40_000 - 2 * 16384, 16384, 16384]
        assert len({b for b, *_ in bins}) == len(bins) and sorted(parts, key=str) == [1, 2, None]
    assert P.pack(df.limit(0)).count() == 0 and P.pack(df.limit(0), pieces=True).count() == 0
    alone = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [(r.capacity, r.used, r.doc_ids) for r in P.pack(alone).collect()] == [(1024, 0, [1])]
    assert P.pack_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_of_one_id_are_dealt_over_shards(spark):
    df = spark.range(400).selectExpr("CAST(NULL AS LONG) doc_id", "transform(sequence(0, 20), x -> CAST(id + x AS INT)) ids")
    got = P.pack(df, shards=8).selectExpr("shiftright(bin_id, 40) s").groupBy("s").count().collect()
    assert len(got) == 8


def test_edit_texts_without_boundaries_and_long_ones(spark):
    enc = E.encoding()
    rows = [(1, "日本語のテキスト" * 800), (2, "word " * 30_000), (3, "x" * 20_000), (4, "a\n" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("edits", E.revision())
    for r in E.apply_edits(E.build(df), with_text=True).collect():
        assert r.n_tokens == len(enc.encode_ordinary(dict(rows)[r.doc_id])) and r.n_tokens_after == len(enc.encode_ordinary(r.text_after))
    assert E.apply_edits(E.build(df.where("doc_id = 2"))).first().reencoded_chars < 10_000
