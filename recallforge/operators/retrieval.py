"""Full-text, vector and fused retrieval.

``open_index`` keeps postings and corpus statistics as Parquet in the shared folder,
clustered by term: a search reads the row groups of its terms alone, and the corpus is
tokenised once, not once a search.  A search that is not repeated, or of texts without
files behind them, finds its own terms in one pass (``scan``).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from recallforge.functions import text as T
from recallforge.shared import kept, shared_dir

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf, dl: a row per document and distinct term."""
    toks = docs.select(key, T.tokens(F.col(text)).alias("_t"))
    return toks.select(key, F.size("_t").alias("dl"), F.explode("_t").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def write_index(docs: DataFrame, key: str, text: str, path: str, mode: str = "overwrite") -> None:
    """Postings as Parquet, in ranges of (term, key), so that a query reads few row
    groups and a term of very many documents is several tasks' work; ``append`` adds
    documents.  The unordered postings are written first: ranges are found on them."""
    raw = f"{path}-raw"
    postings(docs, key, text).write.mode("overwrite").parquet(raw)
    rows = docs.sparkSession.read.parquet(raw)
    rows.repartitionByRange("term", key).sortWithinPartitions("term", key).write.mode(mode).option("parquet.block.size", str(8 << 20)).parquet(path)
    _fs(docs.sparkSession, raw)[0].delete(_fs(docs.sparkSession, raw)[1], True)


def drop_from_index(index: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return index.join(gone.select(key).distinct(), key, "left_anti")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


@dataclass(frozen=True)
class Index:
    """postings (term, key, tf, dl), the number of documents and their mean length."""

    postings: DataFrame
    key: str
    n: float
    avgdl: float

    def signals(self, query: str, k1: float = K1, b: float = B) -> DataFrame:
        """key, bm25, overlap of every document that holds a term of the query."""
        return _scored(self.postings.where(F.col("term").isin(sorted(set(_split(query))))), self.key, self.n, self.avgdl, k1, b)

    def bm25(self, query: str, k1: float = K1, b: float = B) -> DataFrame:
        return self.signals(query, k1, b).select(self.key, F.col("bm25").alias("score"))

    def vector(self, key) -> DataFrame:
        """dim, weight: the terms of one document, by how often they occur."""
        return self.postings.where(F.col(self.key) == key).select(F.col("term").alias("dim"), F.col("tf").cast("double").alias("weight"))

    def similar(self, key) -> DataFrame:
        """key, score: products of term counts with one document's.  Its terms are a
        document's worth, and reach the scan as a filter."""
        terms = {r.dim: r.weight for r in self.vector(key).collect()}
        if not terms:
            return self.postings.select(self.key, F.lit(0.0).alias("score")).limit(0)
        weight = F.create_map(*[F.lit(x) for kv in sorted(terms.items()) for x in kv])
        p = self.postings.where(F.col("term").isin(sorted(terms)) & (F.col(self.key) != key))
        return p.groupBy(self.key).agg(F.sum(F.col("tf") * weight[F.col("term")]).alias("score"))


def open_index(docs: DataFrame, key: str, text: str) -> Index | None:
    """The index of a table of files, built in the shared folder where it is not there
    yet; None for a frame without files.  Its name is a hash of the files' names, sizes
    and times, so changed files get an index of their own."""
    spark, files = docs.sparkSession, sorted(docs.inputFiles())
    if not files:
        return None
    marks = [f"{key}|{text}"]
    for f in files:
        fs, at = _fs(spark, f)
        status = fs.getFileStatus(at)
        marks.append(f"{f}|{status.getLen()}|{status.getModificationTime()}")
    path = f"{shared_dir(spark).rstrip('/')}/index-{hashlib.sha256(chr(10).join(marks).encode()).hexdigest()[:24]}"
    fs, done = _fs(spark, f"{path}/stats/_SUCCESS")
    if not fs.exists(done):
        write_index(docs.select(key, text), key, text, f"{path}/postings")
        # documents without a term count too
        lengths = docs.select(F.size(T.tokens(F.col(text))).alias("dl"))
        lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/stats")
    stats = spark.read.parquet(f"{path}/stats").first()
    return Index(spark.read.parquet(f"{path}/postings"), key, float(stats.n), float(stats.avgdl or 1.0))


def scan(docs: DataFrame, key: str, text: str, query: str) -> Index:
    """An index of the query's terms alone, for a search that is not repeated: one pass
    tokenises the texts and keeps, a row per document, its length and the query's words
    in it; nothing else of a text is moved or written."""
    terms = sorted(set(_split(query)))
    toks = docs.select(key, T.tokens(F.col(text)).alias("_t"))
    wanted = F.filter("_t", lambda t: t.isin(terms)) if terms else F.array().cast("array<string>")
    rows = kept(toks.select(key, F.size("_t").alias("dl"), wanted.alias("_q")))
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    p = rows.select(key, "dl", F.explode("_q").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))
    return Index(p, key, float(stats.n), float(stats.avgdl or 1.0))


def _scored(p: DataFrame, key: str, n: float, avgdl: float, k1: float, b: float) -> DataFrame:
    df = p.groupBy("term").agg(F.count("*").alias("df"))  # a row per query term
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    return p.join(F.broadcast(df), "term").groupBy(key).agg(F.sum(gain).alias("bm25"), F.count("*").cast("double").alias("overlap"))


def signals(docs: DataFrame, key: str, text: str, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """key, bm25, overlap: BM25 and the number of distinct query terms, of every
    document that holds one, from the same postings."""
    return scan(docs, key, text, query).signals(query, k1, b)


def bm25(docs: DataFrame, key: str, text: str, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """key, score: BM25 of every document that holds a term of the query."""
    return signals(docs, key, text, query, k1, b).select(key, F.col("bm25").alias("score"))


def _split(query: str) -> list[str]:
    import re

    return [t for t in re.split(r"[\W_]+", query.lower()) if t]


def top(scored: DataFrame, key: str, k: int, score: str = "score") -> DataFrame:
    """The k best, ties by key: a bounded heap per task, no full sort."""
    return scored.orderBy(F.desc(score), key).limit(k)


def ranked(scored: DataFrame, key: str, score: str = "score", by: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(by or [])).orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(w))


def fuse(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (key, rank)."""
    out = None
    for ranked_list in lists:
        part = ranked_list.select(key, (1.0 / (k + F.col("rank"))).alias("_s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.sum("_s").alias("score"))


def max_normal(df: DataFrame, signals: list[str]) -> DataFrame:
    """Each signal over its maximum (1 where that is zero): one aggregate of one
    row, broadcast, instead of a window over everything."""
    top_row = df.agg(*[F.max(s).alias(f"_m_{s}") for s in signals])
    out = df.join(F.broadcast(top_row))
    return out.withColumns({s: F.col(s) / F.when(F.coalesce(F.col(f"_m_{s}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"_m_{s}")) for s in signals}).drop(*[f"_m_{s}" for s in signals])


def min_max(df: DataFrame, signals: list[str], flat: float = 0.5) -> DataFrame:
    """Each signal between its minimum and maximum; ``flat`` where they are equal."""
    ends = df.agg(*[f(s).alias(f"_{n}_{s}") for s in signals for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(F.broadcast(ends))
    scale = lambda s: F.when(F.col(f"_hi_{s}") > F.col(f"_lo_{s}"), (F.col(s) - F.col(f"_lo_{s}")) / (F.col(f"_hi_{s}") - F.col(f"_lo_{s}"))).otherwise(flat)
    return out.withColumns({s: scale(s) for s in signals}).drop(*[f"_{n}_{s}" for s in signals for n in ("lo", "hi")])


def combined(signals: dict[str, Column], weights: dict[str, float], penalty: Column | float = 0.0) -> Column:
    return sum((weights[s] * c for s, c in signals.items() if weights.get(s)), F.lit(0.0)) - penalty


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    d, n = dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((d > 0) & (n > 0), d / n).otherwise(0.0)


def max_pool(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, pos, value: the largest component of each group's vectors."""
    return df.select(key, F.posexplode(vector).alias("pos", "_v")).groupBy(key, "pos").agg(F.max(F.col("_v").cast("double")).alias("value"))


def sparse_dot(vectors: DataFrame, query: DataFrame, key: str) -> DataFrame:
    """key, score: products over shared dimensions of (key, dim, weight) rows with
    the query's (dim, weight), positive ones alone."""
    q = query.select("dim", F.col("weight").alias("_w"))
    return vectors.join(F.broadcast(q), "dim").groupBy(key).agg(F.sum(F.col("weight") * F.col("_w")).alias("score")).where("score > 0")


def sparse_max(vectors: DataFrame, key: str) -> DataFrame:
    """Chunks of one document merged: the largest weight of each dimension."""
    return vectors.groupBy(key, "dim").agg(F.max("weight").alias("weight"))


def expand(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Scores of a second search merged in: the larger score counts."""
    return base.select(key, "score").unionByName(extra.select(key, "score")).groupBy(key).agg(F.max("score").alias("score"))


def rerank(cands: DataFrame, key: str, model, text: str = "content", most: int = 50, keep: int = 20, chars: int = 2000) -> DataFrame:
    """The ``most`` best candidates scored anew by ``model``, a pandas UDF over the
    first ``chars`` characters; the ``keep`` best replace the list."""
    head = top(cands, key, most)
    return top(head.withColumn("score", model(F.substring(text, 1, chars))), key, keep)
