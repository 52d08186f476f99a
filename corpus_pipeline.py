"""The corpus pipeline: five stages over ``documents``, each written as Parquet
and read again before the next.

Each stage works on every row its predecessor kept, and all but the last return
the columns of ``documents``, whatever other columns it has.  A lost executor costs at
most one stage; what a stage wrote on its way goes when the stage is written.

Every stage takes an empty table (and returns one), texts that are null, empty or
very long, repeated rows, rows without a doc_id, and columns that bear the names it
uses itself; what it does with them stands with each.  Ties are broken by doc_id, so
a run gives the same rows each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recallforge.llm import _io, decontam, langid, ngram_join, packing, secret_scan


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go, and those without a letter (null and
    empty texts too).  Rows without a doc_id are judged but not learned from; equal
    rows are judged alike; ties between languages go to the smaller name.  Without any
    labelled row all go."""
    return langid.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id;
    of equal rows one, of different texts under one doc_id each that is a group of its
    own.  Texts without a word and rows without a doc_id stay."""
    return ngram_join.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go, wherever in a long text it is.  Texts
    without a word stay; each row is judged by its own text."""
    return decontam.drop_contaminated(docs, _io.table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, overlapping ones as one; every row stays, null texts as
    they are."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of token ids (bin_id, capacity, used, doc_ids, starts,
    lengths, ids).  A null text is its end id alone; long texts are cut into pieces;
    equal rows are packed each."""
    return packing.pack_texts(docs)


STAGES = [
    ("language_id", language),
    ("ngram_join", near_copies),
    ("decontamination", benchmark_passages),
    ("secret_scan", secrets),
    ("packing", packed),
]

#: Language ID, the join's groups and packing have no SQL form; the tests hold
#: run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = _io.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = _io.fresh_path(spark, name)
        with _io.scratch(spark, path):
            stage(spark, docs, sf_dir).write.parquet(path)
        _io.release(spark, done)
        docs, done = spark.read.parquet(path), [path]
    return docs
