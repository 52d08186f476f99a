"""Queries: the segmented full-text index, many questions at once, intents by example."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallforge import model as M
from recallforge.catalog import register
from recallforge.functions import text as T
from recallforge.functions.stemming import stemmed, stems_sql
from recallforge.operators import exemplars, metrics as X, retrieval
from recallforge.operators.fulltext import Field, FullText, open_table
from recallforge.shared import fresh_dir, kept
from recallforge.streaming import ingest

FIELDS = (Field("text", stem=True), Field("lang"), Field("source"))
QUESTION = "the editions with thereon nations under licensed en"


def _words(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '' AND strlen(t) < 40)"


def bm25_sql(docs: str, questions: str) -> str:
    """Common table expressions that end in scored(qid, doc_id, score), of the relations
    docs (doc_id, text, lang, source) and questions (qid, text)."""
    return f"""d AS ({docs}), q AS ({questions}),
dw AS (SELECT doc_id, 0 AS field, unnest({_words("text")}) AS word FROM d UNION ALL SELECT doc_id, 1, unnest({_words("lang")}) FROM d UNION ALL SELECT doc_id, 2, unnest({_words("source")}) FROM d),
qw AS (SELECT qid, unnest({_words("text")}) AS word FROM q),
voc AS (SELECT word FROM dw WHERE field = 0 UNION SELECT word FROM qw), {stems_sql("voc")},
qt AS (SELECT qid, field, term, count(*) AS qtf FROM (SELECT qid, 0 AS field, stem AS term FROM qw JOIN stems USING (word) UNION ALL SELECT qid, unnest([1, 2]), word FROM qw) GROUP BY ALL),
tf AS (SELECT doc_id, field, term, count(*) AS tf FROM (SELECT doc_id, field, CASE field WHEN 0 THEN stem ELSE word END AS term FROM dw LEFT JOIN stems USING (word)) GROUP BY ALL),
dl AS (SELECT doc_id, field, count(*) AS dl FROM dw GROUP BY ALL),
st AS (SELECT field, count(*) / (SELECT count(*) FROM d)::DOUBLE AS mean, (SELECT count(*) FROM d)::DOUBLE AS n FROM dw GROUP BY field),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
scored AS (SELECT qid, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 9) AS score
  FROM qt JOIN df USING (field, term) JOIN tf USING (field, term) JOIN dl USING (doc_id, field) JOIN st USING (field) GROUP BY qid, doc_id)"""


_DOCS = "SELECT doc_id, text, lang, source FROM documents WHERE doc_id IS NOT NULL"


def _index(spark, d):
    return open_table(M.table(spark, d, "documents"), "doc_id", FIELDS)


@register("bm25_fields_topk", f"WITH {bm25_sql(_DOCS, f"SELECT 0 AS qid, '{QUESTION}' AS text")} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 50")
def bm25_fields_topk(spark, d):
    return _index(spark, d).search(QUESTION, 50).select("doc_id", F.round("score", 6).alias("score"))


_BATCH = f"""WITH {bm25_sql(_DOCS, "SELECT item_id AS qid, text FROM benchmark")},
runs AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10)"""


def _runs(spark, d):
    return _index(spark, d).batch(M.table(spark, d, "benchmark"), "item_id", "text", 10)


@register("batch_search", f"{_BATCH} SELECT qid AS item_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM runs")
def batch_search(spark, d):
    return _runs(spark, d).select(F.col("qid").alias("item_id"), F.col("key").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


_GRAMS = lambda t, k: rf"SELECT DISTINCT {k}, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM (SELECT {k}, {_words('text')} AS w FROM {t})"


@register(
    "batch_search_quality",
    f"""{_BATCH}, g1 AS ({_GRAMS("benchmark", "item_id")}), g2 AS ({_GRAMS("documents", "doc_id")}),
    share AS (SELECT item_id AS qid, doc_id, count(*) / any_value(n)::DOUBLE AS s FROM g1 JOIN g2 USING (g) JOIN (SELECT item_id, count(*) AS n FROM g1 GROUP BY 1) USING (item_id) GROUP BY 1, 2),
    qrels AS (SELECT qid, doc_id, CASE WHEN s >= 0.5 THEN 2 ELSE 1 END AS rel FROM share),
    ide AS (SELECT qid, sum(rel / log2(r + 1)) AS y FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS r FROM qrels QUALIFY r <= 10) GROUP BY 1),
    hit AS (SELECT qid, sum(rel / log2(rank + 1)) AS x, min(rank) AS first, count(*) AS found FROM runs JOIN qrels USING (qid, doc_id) GROUP BY 1),
    each AS (SELECT coalesce(x, 0) / y AS nd, coalesce(1.0 / first, 0) AS rr, coalesce(found, 0) / n::DOUBLE AS rc FROM ide LEFT JOIN hit USING (qid) JOIN (SELECT qid, count(*) AS n FROM qrels GROUP BY 1) USING (qid))
    SELECT count(*) AS judged, round(avg(nd), 6) AS ndcg_10, round(avg(rr), 6) AS mrr_10, round(avg(rc), 6) AS recall_10 FROM each""",
)
def batch_search_quality(spark, d):
    runs = _runs(spark, d).select(F.col("qid").alias("query_id"), F.col("key").alias("doc_id"), "rank")
    asked, docs = M.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), M.table(spark, d, "documents").select("doc_id", "text")
    # both are read by every metric
    runs, qrels = kept(runs), kept(X.graded_by_passages(asked, docs, 8))
    judged = qrels.agg(F.count_distinct("query_id").alias("judged"))
    return X.all_metrics(runs, qrels).join(judged).select("judged", *[F.round(c, 6).alias(c) for c in ("ndcg_10", "mrr_10", "recall_10")])


@register(
    "segments_topk",
    f"WITH {bm25_sql(f"SELECT doc_id, CASE WHEN lang = 'de' THEN coalesce(text, '') || ' editions' ELSE text END AS text, lang, source FROM ({_DOCS}) WHERE source IS DISTINCT FROM 'web'", f"SELECT 0 AS qid, '{QUESTION}' AS text")} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 50",
)
def segments_topk(spark, d):
    """All documents in commits by language, one source deleted, one language's documents
    replaced by longer ones, small segments merged."""
    docs = M.table(spark, d, "documents").where("doc_id IS NOT NULL")
    index = FullText(spark, fresh_dir(spark, "segments"), "doc_id", FIELDS)
    index.add(docs.where("lang IS NULL OR lang < 'es'"))
    index.add(docs.where("lang >= 'es'"))
    index.delete(docs.where("source = 'web'"))
    index.add(docs.where("lang = 'de' AND source IS DISTINCT FROM 'web'").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" editions"))))
    index.merge()
    return index.search(QUESTION, 50).select("doc_id", F.round("score", 6).alias("score"))


_EXAMPLES = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate((n, t) for n, ts in exemplars.EXEMPLARS.items() for t in ts))


@register(
    "intent_exemplar_classify",
    f"""WITH ex AS (SELECT * FROM (VALUES {_EXAMPLES}) v(eid, intent, t)),
    ew AS (SELECT eid, intent, unnest({_words("t")}) AS word FROM ex), cw AS (SELECT conv_id, turn, unnest({_words("text")}) AS word FROM conversations),
    voc AS (SELECT word FROM ew UNION SELECT word FROM cw), {stems_sql("voc")},
    tf AS (SELECT eid, stem, count(*) AS tf FROM ew JOIN stems USING (word) GROUP BY ALL), dl AS (SELECT eid, count(*) AS dl FROM ew GROUP BY 1),
    df AS (SELECT stem, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT avg(dl) AS mean, count(*)::DOUBLE AS n FROM dl),
    w AS (SELECT eid, stem, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS gain FROM tf JOIN dl USING (eid) JOIN df USING (stem), st),
    ct AS (SELECT conv_id, turn, stem, count(*) AS qtf FROM cw JOIN stems USING (word) GROUP BY ALL),
    sc AS (SELECT conv_id, turn, eid, round(sum(qtf * gain), 9) AS s FROM ct JOIN w USING (stem) GROUP BY ALL),
    f5 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY s DESC, eid) AS r FROM sc QUALIFY r <= 5),
    g AS (SELECT conv_id, turn, intent, round(sum(s), 9) AS s, min(r) AS r FROM f5 JOIN ex USING (eid) GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY s DESC, r) AS k FROM g)
    SELECT c.conv_id, c.turn, coalesce(a.intent, 'fact_lookup') AS intent, round(CASE WHEN a.s IS NULL THEN 1 ELSE a.s / (a.s + coalesce(b.s, 0)) END, 6) AS confidence
    FROM conversations c LEFT JOIN (SELECT * FROM o WHERE k = 1) a USING (conv_id, turn) LEFT JOIN (SELECT * FROM o WHERE k = 2) b USING (conv_id, turn)""",
)
def intent_exemplar_classify(spark, d):
    rows = M.table(spark, d, "conversations").withColumn("_i", exemplars.exemplar_intent(F.col("text")))
    return rows.select("conv_id", "turn", F.col("_i.intent").alias("intent"), F.round("_i.confidence", 6).alias("confidence"))


@register("document_stems", f"WITH w AS (SELECT doc_id, unnest({_words('text')}) AS word FROM documents), voc AS (SELECT DISTINCT word FROM w), {stems_sql('voc')} SELECT stem, count(DISTINCT word) AS words, count(*) AS n FROM w JOIN stems USING (word) GROUP BY 1")
def document_stems(spark, d):
    words = F.explode(F.filter(T.tokens(F.coalesce("text", F.lit(""))), lambda t: F.octet_length(t) < 40))
    counts = M.table(spark, d, "documents").select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    stems = counts.withColumn("stem", F.get(stemmed(F.array("word")), F.lit(0)))
    return stems.groupBy("stem").agg(F.count("*").alias("words"), F.sum("n").alias("n"))


@register(
    "level_search_overfetch",
    f"WITH {bm25_sql(_DOCS, f"SELECT 0 AS qid, '{QUESTION}' AS text")}, wide AS (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 30) SELECT doc_id, lang, round(score, 6) AS score FROM wide JOIN documents USING (doc_id) WHERE lang IN ('en', 'fr') ORDER BY wide.score DESC, doc_id LIMIT 10",
)
def level_search_overfetch(spark, d):
    """The ten best of one kind among three times as many of every kind."""
    kinds = M.table(spark, d, "documents").select("doc_id", "lang").where(F.col("lang").isin("en", "fr"))
    wide = _index(spark, d).search(QUESTION, 30).join(kinds, "doc_id")
    return retrieval.top(wide, "doc_id", 10).select("doc_id", "lang", F.round("score", 6).alias("score"))


def _capitalised(texts):
    return texts.str.findall("[A-Z][a-z]+")


@register(
    "ingested_links",
    r"""WITH n AS (SELECT DISTINCT conv_id * 1000 + turn AS memory_id, lower(name) AS name FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS name FROM conversations))
    SELECT name, count(*) AS memories FROM n GROUP BY 1""",
)
def ingested_links(spark, d):
    """All turns through the ingest stream's tables: memories of each entity."""
    turns = M.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("memory_id"), F.col("text").alias("content"), F.col("role").alias("domain"), F.lit(None).cast("timestamp").alias("at"), F.array().cast("array<string>").alias("entities"))
    kept = ingest.Ingest(spark, fresh_dir(spark, "ingest"), _capitalised)
    kept.apply(turns)
    names = kept.read("entities").groupBy("entity_id").agg(F.lower(F.min("name")).alias("name"))
    return kept.read("links").join(names, "entity_id").groupBy("name").agg(F.count("*").alias("memories"))
