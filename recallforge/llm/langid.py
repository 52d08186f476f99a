"""Operator 10: language identification by prediction by partial matching.

One variable-order byte context tree per language (orders 3 to 0, escape method
C, no exclusion, uniform over 256 bytes below order 0) is fitted on a bounded
sample of labelled rows, then frozen.  A text's score under a language is its
exact code length in bits; the shortest wins, ties to the smaller name.

Texts are seen as bytes after normalisation: ASCII and Latin-1 letters in lower
case, every ASCII byte that is no letter as a space.  Three spaces stand before
each text.  The trees are flattened: for each byte the longest known context is
found by table look-up for all bytes of a batch at once, which gives the same
code lengths as walking the trees.

Sample bound: about ``per_language`` rows per label (default 400), drawn by a hash
of the row (doc_id and text) at a rate that follows the label's count.  A label of
which no row is drawn gives one, so no label is dropped.  The broadcast has a row per
4-gram of the sample and a column per label, at any corpus size.

The score is the share of the best language in the probability of the (shortened)
text, so it compares languages; ``excess_bits`` says how far a text is from all of
them, by what the best tree spends on texts of its own that it has not learned.

Null text, or text without a letter: ``und``, score 0.  No labelled row: all
``und``.  A null doc_id is not held out and not learned from.  Every row is
judged, repeated ones too; extra columns pass through ``predict``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from recallforge.llm import _io
from recallforge.llm._text import slices, utf8

PER_LANGUAGE = 400
#: A decision counts as that of at most so many bytes in the score.
SCORE_BYTES = 64
#: Bits a byte beyond a language's own texts above which a text is in none of the
#: learned languages.  From held-out texts of sf0.1, each of four languages left out
#: in turn: of 10,000 documents in a learned language the dearest took 2.63; of those
#: in the one left out, 1 in 20 less than 2.6 (en) to 4.3 (fr), half above 3.4 to 5.7.
MOST_EXCESS = 2.75
#: Evidence that a short text must exceed as well: about what a key or a number of
#: twenty random characters in it costs.
SLACK_BITS = 128.0

_NORM = np.full(256, 0x20, np.uint8)
_NORM[0x61:0x7B] = np.arange(0x61, 0x7B)
_NORM[0x41:0x5B] = np.arange(0x61, 0x7B)
_NORM[0x80:] = np.arange(0x80, 0x100)


def normalise(data: np.ndarray) -> np.ndarray:
    low = _NORM[data]
    lead = np.flatnonzero(low[:-1] == 0xC3)
    nxt = low[lead + 1]
    up = lead[(nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)] + 1
    low[up] += 0x20
    return low


def padded(data: np.ndarray, off: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i..j normalised, three spaces before each; where each row begins."""
    base = off[i]
    low = normalise(data[base : off[j]])
    rows = (off[i : j + 1] - base).astype(np.int64)
    out = np.full(len(low) + 3 * (j - i), 0x20, np.uint8)
    out[np.arange(len(low)) + 3 * np.repeat(np.arange(1, j - i + 1), np.diff(rows))] = low
    return out, rows + 3 * np.arange(j - i + 1)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, n: 4-grams of each label's texts, one row per batch and gram."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist())
        for lang in sorted(set(langs)):
            part = batch.filter(pa.array(langs == lang))
            data, off = utf8(part.column("text"))
            grams = []
            for i, j in slices(off):
                b, rows = padded(data, off, i, j)
                b = b.astype(np.uint32)
                g = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
                inside = np.ones(len(g), bool)
                for k in (1, 2, 3):  # grams that would run into the next row's padding
                    at = rows[1:-1] - k
                    inside[at[at >= 0]] = False
                grams.append(g[inside])
            g, n = np.unique(np.concatenate(grams), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


class Trees:
    """The flattened context trees of all languages."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        #: Bits that a byte of a language's own texts takes, found by ``calibrate``.
        self.own = np.full(len(langs), 8.0)
        size = len(langs)
        raw = np.stack([(gram >> s) & 0xFF for s in (24, 16, 8, 0)])
        seen = np.unique(raw)
        seen = np.union1d(seen, [0x20])
        self.number = np.zeros(256, np.int64)  # 0: a byte never seen
        self.number[seen] = np.arange(1, len(seen) + 1)
        a = self.a = len(seen) + 1
        c1, c2, c3, c4 = self.number[raw]

        def cost(context: np.ndarray, contexts: int, row: np.ndarray, first_context: np.ndarray, lower: np.ndarray):
            """Costs of the rows (context, symbol) per language, and of escapes."""
            count = np.zeros((len(first_context), size))
            np.add.at(count, (row, lang), n)
            total, kinds = np.zeros((contexts, size)), np.zeros((contexts, size))
            np.add.at(total, (context, lang), n)
            np.add.at(kinds, first_context, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
                hit = np.log2((total + kinds)[first_context] / count)
            return np.where(count > 0, hit, escape[first_context] + lower).astype(np.float32), escape.astype(np.float32)

        zero = np.zeros(len(n), np.int64)
        self.order0, _ = cost(zero, 1, c4, np.zeros(a, np.int64), np.full((a, size), 8.0))
        self.order1, _ = cost(c3, a, c3 * a + c4, np.repeat(np.arange(a), a), np.tile(self.order0, (a, 1)))
        # order 2: a row for each trigram seen in any language
        tri, row3 = np.unique((c2 * a + c3) * a + c4, return_inverse=True)
        context2 = tri // a
        self.order2, self.escape2 = cost(c2 * a + c3, a * a, row3, context2, self.order1[tri % (a * a)])
        # every 3-byte context has a row too, also those that end no gram
        ctx = (c1 * a + c2) * a + c3
        ctx3, ctx_row = np.unique(ctx, return_inverse=True)
        four, row4 = np.unique(ctx_row * a + c4, return_inverse=True)
        self.row3 = np.full(a**3, -1, np.int32)
        self.row3[tri] = np.arange(len(tri))
        self.ctx3 = np.full(a**3, -1, np.int32)
        self.ctx3[ctx3] = np.arange(len(ctx3))
        suffix = (ctx3[four // a] % (a * a)) * a + four % a
        self.order3, escape3 = cost(ctx_row, len(ctx3), row4, four // a, self.order2[self.row3[suffix]])
        self.escape3 = np.concatenate([escape3, np.zeros((1, size), np.float32)])  # -1: no such context
        self.row4 = np.full(len(ctx3) * a, -1, np.int32)
        self.row4[four] = np.arange(len(four))

    def bits(self, data: np.ndarray, off: np.ndarray, i: int, j: int) -> np.ndarray:
        """Code length in bits of rows i..j under each language."""
        raw, rows = padded(data, off, i, j)
        b, a = self.number[raw], self.a
        c4 = b[3:]
        context = (b[:-3] * a + b[1:-2]) * a + b[2:-1]
        ctx = self.ctx3[context]
        row = np.where(ctx >= 0, self.row4[ctx.astype(np.int64) * a + c4], -1)
        cost = self.order3[row] if len(self.order3) else np.zeros((len(row), len(self.langs)), np.float32)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            suffix = (context[miss] % (a * a)) * a + c4[miss]
            r3 = self.row3[suffix]
            lower = np.where((r3 >= 0)[:, None], self.order2[r3], self.escape2[suffix // a] + self.order1[suffix % (a * a)])
            cost[miss] = self.escape3[ctx[miss]] + lower
        for k in (1, 2, 3):  # the padding of the next row costs nothing
            at = rows[1:-1] - k
            cost[at[at >= 0]] = 0
        # position p of cost codes byte p + 3; row r's bytes begin at rows[r] + 3
        out = np.zeros((j - i, len(self.langs)))
        full = np.flatnonzero(np.diff(rows) > 3)
        if len(full):
            out[full] = np.add.reduceat(cost, rows[full], axis=0, dtype=np.float64)
        return out


def fit(rows: DataFrame, *, per_language: int = PER_LANGUAGE) -> Trees | None:
    """Trees from ``rows`` (doc_id, text, lang), which may be used for learning.  Of a
    label's sample an eighth is kept from the tree, to tell how many bits a byte of the
    language takes in texts that the tree has not seen."""
    rows = rows.where("doc_id is not null and text is not null and lang is not null")
    rate = rows.groupBy("lang").agg(F.least(F.lit(1.0), per_language / F.count("*")).alias("rate"))
    mark = lambda name: F.xxhash64(F.lit(name), "doc_id", "text")
    draw = F.pmod(mark("ppm"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    kept = F.pmod(mark("kept"), F.lit(8)) == 0
    sample = rows.join(F.broadcast(rate), "lang").where(draw < F.col("rate")).select("lang", "text", kept.alias("kept"))
    missed = rate.join(sample.select("lang").distinct(), "lang", "left_anti")
    if not missed.isEmpty():  # equal rows are drawn alike, so all may be missed
        one = rows.join(F.broadcast(missed.select("lang")), "lang", "left_semi").groupBy("lang").agg(F.min_by("text", mark("ppm")).alias("text"))
        sample = sample.unionByName(one.withColumn("kept", F.lit(False)))
    few = sample.groupBy("lang").agg(F.count_if("kept").alias("a"), F.count_if(~F.col("kept")).alias("b")).where("a = 0 or b = 0").select("lang")
    sample = sample.join(F.broadcast(few.withColumn("few", F.lit(True))), "lang", "left")  # a label of few rows uses them for both
    grams = (
        sample.where("few or not kept").select("lang", "text").mapInArrow(_grams, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    )
    langs = sorted(set(grams["lang"]))
    if not langs:
        return None
    trees = Trees(langs, np.searchsorted(langs, grams["lang"].to_numpy()), grams["gram"].to_numpy(), grams["n"].to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    spent = sample.where("few or kept").select("lang", "text").mapInArrow(_spent(shared), "lang string, bits double, bytes long").groupBy("lang").agg(F.sum("bits").alias("bits"), F.sum("bytes").alias("bytes")).collect()
    for r in spent:
        if r.bytes:
            trees.own[langs.index(r.lang)] = r.bits / r.bytes
    return trees


def _spent(broadcast):
    """Rows (lang, text) to what each text costs under its own label's tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: Trees = broadcast.value
        for batch in batches:
            data, off = utf8(batch.column("text"))
            at = np.searchsorted(trees.langs, np.array(batch.column("lang").to_pylist()))
            for i, j in slices(off, 1 << 20):
                bits = trees.bits(data, off, i, j)[np.arange(j - i), at[i:j]]
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(i, j - i), pa.array(bits), pa.array(np.diff(off[i : j + 1]).astype(np.int64))], names=["lang", "bits", "bytes"])

    return run


def _has_letter(data: np.ndarray, off: np.ndarray, i: int, j: int) -> np.ndarray:
    out = np.zeros(j - i, bool)
    rows = (off[i : j + 1] - off[i]).astype(np.int64)
    part = data[off[i] : off[j]]
    low = part | 0x20
    letters = np.concatenate([[0], np.cumsum((low >= 0x61) & (low <= 0x7A))])
    out = letters[rows[1:]] > letters[rows[:-1]]
    for k in np.flatnonzero(~out & (np.diff(rows) > 0)):
        out[k] = any(map(str.isalpha, part[rows[k] : rows[k + 1]].tobytes().decode()))
    return out


def _predict(broadcast, schema: pa.Schema, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: Trees | None = broadcast.value
        for batch in batches:
            data, off = utf8(batch.column(text))
            for i, j in slices(off, 1 << 20):
                n = j - i
                names, score, excess = np.full(n, "und", object), np.zeros(n), np.zeros(n)
                if trees is not None:
                    bits, letter = trees.bits(data, off, i, j), _has_letter(data, off, i, j)
                    best, size = bits.argmin(axis=1), np.diff(off[i : j + 1])
                    gap = (bits - bits.min(axis=1, keepdims=True)) * np.log(2)
                    gap /= np.maximum(1.0, size / SCORE_BYTES)[:, None]
                    p = 1.0 / np.exp(-gap).sum(axis=1)
                    # bits beyond what the language's own texts of that length take
                    over = bits.min(axis=1) - size * trees.own[best]
                    names[letter], score[letter], excess[letter] = np.array(trees.langs, object)[best[letter]], p[letter], over[letter]
                cols = [batch.column(k).slice(i, n) for k in range(batch.num_columns)] + [pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(excess)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def predict(docs: DataFrame, trees: Trees | None, *, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, and excess_bits: how many bits the text takes
    beyond what its length would in the language's own texts; columns of those names
    are replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score", "excess_bits")])
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("excess_bits", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    return docs.mapInArrow(_predict(shared, to_arrow_schema(schema), text), schema)


def fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def identify(docs: DataFrame, **options) -> DataFrame:
    """Learns from the labelled rows outside the held-out fold; judges all rows."""
    trees = fit(docs.select("doc_id", "text", "lang").where(fold() != 2), **options)
    rows = docs.withColumn("held_out", F.coalesce(fold() == 2, F.lit(False)))
    return predict(rows, trees)


def keep_identified(docs: DataFrame, *, most_excess: float = MOST_EXCESS, slack_bits: float = SLACK_BITS, **options) -> DataFrame:
    """The documents with a language: not ``und``, and not much dearer to code than the
    language's own texts of that length, which texts in no learned language are,
    however many languages compete."""
    rows, own = _io.apart(docs, "doc_id", "text", "lang")
    size = F.octet_length("text")
    return identify(rows, **options).where((F.col("lang_pred") != "und") & (F.col("excess_bits") <= most_excess * size + slack_bits)).select(*own)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _io.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
