"""The stemmer, and the segmented index against plain counting."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recallforge.functions import stemming as S
from recallforge.operators import fulltext as X
from recallforge.operators.exemplars import EXEMPLARS, exemplar_intent
from recallforge.streaming import streams

PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist
consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid
consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee
knew knew knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker
knockers knocker knocking knock knot knot knots knot running run hopping hop hoping hope happily happili happy happi generally general generic generic communism communism universal univers
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic vietnamization vietnam predication predic operator oper
feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative format formalize formal electriciti
electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt communicate communic activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
ties tie cries cri gas gas this this kiwis kiwi dying die news news proceed proceed exceeding exceed succeeds succeed bed bed shed shed sky sky saying say boy boy youth youth yes yes""".split()


def test_published_pairs():
    wrong = [(w, S.stem(w), want) for w, want in itertools.batched(PAIRS, 2) if S.stem(w) != want]
    assert not wrong


def test_columns_and_sql_agree_with_words():
    heads = ["", "b", "tr", "gener", "sky", "ay", "eby", "consol", "hopp", "agre", "ys", "ll", "naïv", "a1", "arsenal", "relat", "yy"]
    ends = ["", *S.STEP_2, *S.STEP_3, *S.STEP_4, "s", "es", "ies", "ied", "sses", "us", "ss", "eed", "eedly", "ing", "ingly", "ed", "edly", "y", "e", "ll", "le", "ying", "bling", "izing", "ating", "ney"]
    words = sorted({h + m + e for h in heads for m in ("", "a", "at", "iz", "tt", "w", "abl") for e in ends if h + m + e} | set(PAIRS) | set(S.EXCEPTIONS) | set(S.KEPT_AFTER_PLURAL))
    con = duckdb.connect()
    con.register("vocabulary", pa.table({"word": words}))
    got = dict(con.execute(f"WITH {S.stems_sql('vocabulary')} SELECT word, stem FROM stems").fetchall())
    assert len(got) == len(words)
    assert {w: got[w] for w in words if got[w] != S.stem(w)} == {w: S.stem(w) for w in words if got[w] != S.stem(w)}
    lists = pa.array([words[:3], None, [], ["running", None, "ran"]], pa.list_(pa.string()))
    assert S.stem_lists(lists).to_pylist() == [[S.stem(w) for w in words[:3]], None, [], ["run", None, "ran"]]
    assert S.stem_lists(lists.slice(3)).to_pylist() == [["run", None, "ran"]]


FIELDS = (X.Field("text", stem=True), X.Field("tags"))
VOCABULARY = [f"word{k}" for k in range(60)] + ["running", "runs", "nation", "nations", "the", "of"]


def plain(docs, query, k):
    """(key, score): BM25 by counting, over {key: (text, tags)}."""
    read = (S.stem, lambda w: w)
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w and len(w.encode()) < 40]
    counts = {d: [Counter(map(read[f], split(v[f]))) for f in (0, 1)] for d, v in docs.items()}
    scores = Counter()
    for f in (0, 1):
        mean = sum(c[f].total() for c in counts.values()) / max(1, len(counts))
        for term, qtf in Counter(map(read[f], split(query))).items():
            df = sum(term in c[f] for c in counts.values())
            for d, c in counts.items():
                if term in c[f]:
                    tf = c[f][term]
                    scores[d] += qtf * math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * c[f].total() / mean))
    return sorted(((d, round(s, 6)) for d, s in scores.items()), key=lambda x: (-x[1], x[0]))[:k]


def some_docs(rng, n):
    return {k: (rng.choice([None, "", " ".join(rng.choices(VOCABULARY, k=rng.randrange(1, 30)))]) if rng.random() < 0.2 else " ".join(rng.choices(VOCABULARY, k=12)), rng.choice(["red word1", "blue", None])) for k in range(n)}


def frame(spark, docs, schema="id long, text string, tags string"):
    return spark.createDataFrame([(k, *v) for k, v in docs.items()], schema)


def found(df):
    return sorted(((r.id, round(r.score, 6)) for r in df.collect()), key=lambda x: (-x[1], x[0]))


QUERY = "Running nations of the word3, word3 word7 red"


def test_scores_and_bounds(spark, tmp_path, monkeypatch):
    """Whole scores, and the same after ranges are left out by their bounds."""
    monkeypatch.setattr(X, "RANGE_DOCS", 8)
    rng = random.Random(1)
    docs = some_docs(rng, 300)
    docs[7], docs[70] = ("rare rare running", "red"), ("rare word3 nation", None)
    index = X.FullText(spark, str(tmp_path / "i"), "id", FIELDS)
    index.add(frame(spark, docs))
    assert found(index.search(QUERY, 10)) == found(index.search(QUERY, 10, few=1)) == plain(docs, QUERY, 10)
    assert found(index.search("rare the word9", 2, few=1)) == plain(docs, "rare the word9", 2)
    of_terms, scored = index.blocks("rare the word9", 2)
    assert 0 < scored < of_terms / 2
    questions = {k: " ".join(rng.choices(VOCABULARY + ["rare", "unheard"], k=4)) for k in range(12)} | {50: None, 51: "unheard"}
    asked = spark.createDataFrame(list(questions.items()), "q long, text string")
    for few in (1, 1000):
        got = {q: [] for q in questions}
        for r in sorted(index.batch(asked, "q", "text", 5, few=few).collect(), key=lambda r: r.rank):
            got[r.qid].append((r.key, round(r.score, 6)))
        assert got == {q: plain(docs, t or "", 5) for q, t in questions.items()}
    signals = {r.id: round(r.bm25, 6) for r in index.signals(QUERY).collect()}
    assert signals == dict(plain(docs, QUERY, 1000))


def test_commits_give_what_a_rebuild_gives(spark, tmp_path):
    rng = random.Random(2)
    index = X.FullText(spark, str(tmp_path / "i"), "id", FIELDS)
    assert index.search(QUERY).count() == 0 and index.batch(frame(spark, {}), "id", "text", 3).count() == 0
    live = {}
    for step in range(5):
        come = {k: v for k, v in some_docs(rng, 40).items() if rng.random() < 0.4}
        gone = rng.sample(range(40), 6)
        index.add(frame(spark, come))
        index.delete(spark.createDataFrame([(k,) for k in gone] + [(None,), (999,)], "id long"))
        live = {k: v for k, v in (live | come).items() if k not in gone}
        if step == 2:
            before = index.manifest()
            index.merge()
            assert len(index.manifest().segments) == 1 < len(before.segments) and not index.manifest().tombstones
            index.vacuum()
    assert index.manifest().n == len(live)
    again = X.FullText(spark, str(tmp_path / "again"), "id", FIELDS)
    again.add(frame(spark, live))
    assert index.manifest().lengths == again.manifest().lengths
    assert found(index.search(QUERY, 20)) == found(again.search(QUERY, 20)) == plain(live, QUERY, 20)
    index.merge(), index.vacuum()
    assert found(index.search(QUERY, 20)) == plain(live, QUERY, 20)
    index.delete(frame(spark, live))
    assert index.manifest().n == 0 and index.search(QUERY).count() == 0
    index.add(frame(spark, dict([*live.items()][:3])))
    assert index.manifest().n == 3


def test_batches_are_scored_where_documents_are(spark, tmp_path, monkeypatch):
    """No join of questions and postings: after commits, deletes and with many equal
    scores, for more documents than a slice holds."""
    monkeypatch.setattr(X.FullText, "_candidates", None)
    rng = random.Random(7)
    docs = some_docs(rng, 1500) | {k: ("word3 word7", "red") for k in range(700, 900)}
    index = X.FullText(spark, str(tmp_path / "i"), "id", FIELDS)
    index.add(frame(spark, dict([*docs.items()][:1000])).repartition(3))
    index.add(frame(spark, {k: v for k, v in docs.items() if k >= 950}))
    index.delete(spark.createDataFrame([(k,) for k in range(0, 1500, 9)], "id long"))
    live = {k: v for k, v in docs.items() if k % 9}
    questions = {k: " ".join(rng.choices(VOCABULARY + ["unheard"], k=4)) for k in range(8)} | {50: None, 51: "unheard", 52: "word3 red"}
    asked = spark.createDataFrame(list(questions.items()), "q long, text string")
    got = {q: [] for q in questions}
    for r in sorted(index.batch(asked, "q", "text", 5).collect(), key=lambda r: r.rank):
        got[r.qid].append((r.key, round(r.score, 6)))
    assert got == {q: plain(live, t or "", 5) for q, t in questions.items()}


def test_postings_are_made_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Ranges are documents of one task: each document in one range, none above the bound."""
    monkeypatch.setattr(X, "RANGE_DOCS", 8)
    index = X.FullText(spark, str(tmp_path / "i"), "id", FIELDS)
    m = index.add(frame(spark, some_docs(random.Random(5), 100)).repartition(3))
    rows = index._postings(m)
    keys = rows.select("range", F.explode("docs.key").alias("key")).distinct()
    assert keys.groupBy("key").count().where("count > 1").isEmpty()
    assert 12 <= rows.select("range").distinct().count() <= 20 and rows.where("n > 8 or n <> size(docs)").isEmpty()
    # no more ranges than tasks and slices make: hashed ranges would spread over every task
    files = rows.select("range", F.input_file_name().alias("f")).distinct()
    assert files.groupBy("range").count().where("count > 1").isEmpty()


def test_a_stream_of_changes_and_a_repeated_batch(spark, tmp_path):
    rng = random.Random(3)
    index = X.FullText(spark, str(tmp_path / "i"), "id", FIELDS)
    schema = "id long, text string, tags string, at long, deleted boolean"
    live = {}
    for file in range(3):
        rows = []
        for at in range(30):
            k = rng.randrange(15)
            doc, gone = (" ".join(rng.choices(VOCABULARY, k=8)), "red"), rng.random() < 0.25
            rows.append((k, *doc, at, gone))
            live.pop(k, None)
            if not gone:
                live[k] = doc
        rng.shuffle(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "changes"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "changes"))
        streams.fulltext_sink(stream, index, str(tmp_path / "checkpoint"), "changes", order="at", once=True).awaitTermination()
    assert found(index.search(QUERY, 20)) == plain(live, QUERY, 20)
    m = index.manifest()
    again = spark.createDataFrame([(3, "word3", "red", 0, False)], schema)
    assert index.apply(again, deleted="deleted", order="at", stream="changes", batch=max(m.batches.values())) == m == index.manifest()
    assert index.apply(again, deleted="deleted", stream="changes", batch=max(m.batches.values()) + 1).version == m.version + 1


def test_two_commits_at_once_are_an_error(spark, tmp_path):
    index = X.FullText(spark, str(tmp_path / "i"), "id", FIELDS)
    m = index.add(frame(spark, {1: ("a", "b")}))
    with pytest.raises(Exception, match="(?i)exist"):
        index._commit(m)
    (tmp_path / "i" / "manifest" / "v000000000009.json").write_text('{"version": 9, "n"')
    assert index.manifest() == m


def test_example_intents(spark):
    rows = [(0, None), (1, ""), (2, "zzz"), (3, "What is the current status of the API?"), (4, "which lessons did we learn from those incidents"), (5, "Timeline of the outage")]
    got = {r.k: r.i for r in spark.createDataFrame(rows, "k int, t string").select("k", exemplar_intent(F.col("t")).alias("i")).collect()}
    assert [got[k].intent for k in range(6)] == ["fact_lookup"] * 3 + ["current_state_lookup", "strategic_reflection", "event_reconstruction"]
    assert got[0].confidence == got[2].confidence == 1.0 and 0.5 <= got[3].confidence <= 1
    assert sum(map(len, EXEMPLARS.values())) == 71
