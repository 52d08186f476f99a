from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from recallforge.sources import chunkers as C, loaders


def test_chunkers():
    assert C.plain("a\n\nb\n\nc", 2) == ["a\n\nb", "c"] and C.plain("aa\n\nbb", 4) == ["aa\n\nbb"] and C.plain("aa\n\nbbb", 4) == ["aa", "bbb"]
    assert C.markdown("# A\nx\n## B\ny") == ["# A\nx", "## B\ny"] and C.markdown("one\ntwo\nthree", 5) == ["one\ntwo", "three"]
    assert C.json_items('["x", "", 3, {"a": 1}]') == ['"x"', "3", '{\n  "a": 1\n}'] and C.json_items("7") == ["7"]
    assert C.json_items('{"a":1,"b":2,"c":3,"d":4}') == ["a: 1", "b: 2", "c: 3", "d: 4"] and len(C.json_items('{"a":1}')) == 1
    assert C.json_items("no json") == ["no json"]
    assert C.csv_rows("h\n1\n2\n3", 3) == ["h\n1\n2", "h\n3"] and C.csv_rows("h") == []


def test_overlapping_chunks():
    assert C.overlapping("short", 10) == ["short"]
    assert C.overlapping("One two. Three four. Five six.", 12, 0) == ["One two. ", "Three four. ", "Five six."]
    assert C.overlapping("One two. Three four.", 12, 1) == ["One two. ", " Three four."]
    assert C.overlapping("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert "".join(C.overlapping("word " * 50, 30, 0)) == "word " * 50


def test_content_classes():
    long = "x" * 500
    assert C.classify("# A\na\n# B\n" + long) == {"navigable": True, "form": "markdown", "parts": 2}
    assert C.classify("a: 1\nb: 2\n" + long)["form"] == "yaml" and C.classify('{"a": 1, "b": "' + long + '"}')["form"] == "json"
    assert C.classify("# A\n# B\nkey: v\n" + long) == {"navigable": False, "form": "plain", "parts": 0}
    assert C.classify("p\n\n" * 4 + long * 3)["form"] == "structured_text" and not C.classify("# A\n# B")["navigable"]
    assert C.classify("# A\n# B\n" + long, "notes.MD")["navigable"] and C.classify("x", "a.yaml") == {"navigable": False, "form": "yaml", "parts": 0}
    assert C.classify("x", kind="document") == {"navigable": True, "form": "structured_text", "parts": 0}
    assert [(x["heading"], x["body"]) for x in C.sections("pre\n# A\nx\n## B\ny", "markdown")] == [("(preamble)", "pre"), ("A", "# A\nx"), ("B", "## B\ny")]
    assert [(x["heading"], x["body"]) for x in C.sections("# note\na: 1\n  in: 2\nb: 3", "yaml")] == [("a", "a: 1\n  in: 2"), ("b", "b: 3")]
    assert [x["heading"] for x in C.sections('{"k": 1, "l": [2]}', "json")] == ["k", "l"] and [x["body"] for x in C.sections("p one\n\nq", "structured_text")] == ["p one", "q"]
    assert C.sections("short") == []


def test_load(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nx\n# B\ny")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.html").write_text("<p>hi<script>no()</script> there</p>")
    (tmp_path / "c.bin").write_text("skip")
    got = loaders.load(spark, str(tmp_path)).collect()
    assert sorted(r.content for r in got) == ["# A\nx", "# B\ny", "hi there"]
    assert {t for r in got for t in r.tags} == {"knowledge-loader", "source:a.md", "source:b.html"} and {r.domains[0] for r in got} == {"a", "b"}
    assert {r.importance for r in got} == {6.0} and tuple(loaders.load_stats(loaders.load(spark, str(tmp_path))).first()) == (2, 3, 18)
    one = loaders.load_text(spark, "p\n\nq", domains=["d"], importance=8.0, project="x").collect()
    assert [(r.content, r.domains, r.importance, r.project) for r in one] == [("p\n\nq", ["d"], 8.0, "x")]

    @F.pandas_udf("string")
    def convert(raw):
        return raw.map(lambda b: "# T\n" + bytes(b).decode() if b else None)

    (tmp_path / "d.docx").write_bytes(b"rich text")
    (tmp_path / "e.pdf").write_bytes(b"")
    assert [(r.content, r.domains) for r in loaders.load_documents(spark, str(tmp_path), convert, domains=["docs"]).collect()] == [("# T\nrich text", ["docs"])]


def test_sections_and_profile(spark):
    d = spark.createDataFrame([(1, "s.md", "# A\nFirst one. Then.\n# B\nyy")], "id long, src string, body0 string")
    s = C.split_sections(d, "body0", "markdown")
    assert [(r.heading, r.body) for r in s.orderBy("position").collect()] == [("A", "# A\nFirst one. Then."), ("B", "# B\nyy")]
    assert C.profile(s, "id", "src").first().profile == "Document: A\nSource: s.md\nFormat: markdown | Sections: 2\n\n- A: # A\nFirst one.\n- B: # B\n\nTotal content: 26 chars across 2 sections"
    tree = C.document_tree(d.select("id", "body0"), "id", "body0").orderBy("position").collect()
    assert [(r.doc_id, r.parent_id, r.heading) for r in tree] == [("1", None, None), ("1#0", "1", "A"), ("1#1", "1", "B")]
    forms = spark.createDataFrame([("# A\n# B\n" + "x" * 500, None), ("a: 1", "a.yml"), (None, None)], "t string, n string").select(C.content_class(F.col("t"), F.col("n")).alias("c"))
    assert [r.c and (r.c.navigable, r.c.form) for r in forms.collect()] == [(True, "markdown"), (False, "yaml"), None]


@pytest.mark.parametrize("text, want", [
    ("One. Two", "One."), ("Why! not. so", "Why! not."), ("Why! not", "Why!"), ("line\nnext", "line"), ("  pad  ", "pad"), ("", ""), (".x", ".x"),
    ("w" * 100, "w" * 80 + "..."), ("a " * 60, "a " * 39 + "a..."), ("b" * 30 + " " + "c" * 90, "b" * 30 + " " + "c" * 49 + "..."),
])
def test_first_sentence(spark, text, want):
    from recallforge.functions import text as X

    assert spark.createDataFrame([(text,)], "t string").select(X.first_sentence(F.col("t"))).first()[0] == want


def test_watch(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.txt").write_text("one")
    (src / "skip.txt").write_text("two")
    q = loaders.watch(spark, str(src), exclude="skip").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(out))
    q.awaitTermination(60)
    assert [r.text for r in spark.read.parquet(str(out)).collect()] == ["one"]


def test_texts_are_cut_in_slices():
    """A worker holds a slice's strings, not a batch's; a long text is a slice of its own."""
    assert list(C.slices([3, 4, 5, 20, 0, 1], 8)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(C.slices([])) == []
