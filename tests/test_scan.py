import pytest

from recallforge import catalog
from recallforge.operators import retrieval

SF = "/root/testdata/sf0.001"
ONCE = ["bm25_topk", "rrf_fusion", "hybrid_search", "query_expansion_topk", "context_budget", "level_first_search", "engine_search", "engine_recall"]


@pytest.mark.parametrize("name", ONCE)
def test_a_single_search_makes_no_index(spark, monkeypatch, name):
    """Postings of every word are moved for an index alone; a search finds its own terms."""

    def no_index(*_):
        raise AssertionError("all words are indexed for one search")

    monkeypatch.setattr(retrieval, "write_index", no_index)
    monkeypatch.setattr(retrieval, "open_index", no_index)
    assert catalog.queries()[name](spark, SF).columns


def test_a_scan_equals_an_index(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, ""), (5, "x y"), (None, "A")], "doc_id long, text string")
    got = retrieval.scan(docs, "doc_id", "text", "a C a")
    assert (got.n, sorted((r.term, r.doc_id or 0, r.tf) for r in got.postings.collect())) == (6, [("a", 0, 1), ("a", 1, 2), ("c", 2, 1)])
    assert retrieval.bm25(docs, "doc_id", "text", "- -").count() == 0
