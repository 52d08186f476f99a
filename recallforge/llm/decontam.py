"""Operator 7: benchmark decontamination with one Aho-Corasick automaton.

Items (test questions and answers) and documents are normalised to words (see
``_text``).  Every window of ``window`` consecutive words of an item is a
pattern; an item of fewer words, but not none, is one pattern.  The automaton
runs over word numbers of the items' vocabulary; a document word outside it ends
every partial match.  Each document is scanned once, and hit words keep their
byte offsets, so spans in the original text can be cut or reported.

The patterns are cut into automata of at most ``max_patterns``; each is one
broadcast of bounded size, and the documents pass once over each (one at usual
benchmark sizes).  Null or empty texts have no words and no hits.  Items that are
null, empty or without an id are no patterns; an item_id that repeats counts
once.  Repeated documents are each judged.  Other columns pass through
``scan(..., keep=...)``.  Empty tables give empty or clean results.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from recallforge.llm import _io
from recallforge.llm._text import Words, slices, utf8

WINDOW = 10
#: Patterns of one automaton: about 50 MB pickled.
MAX_PATTERNS = 400_000


def _windows(words: np.ndarray, window: int) -> set[tuple[int, ...]]:
    """Distinct windows of a word sequence."""
    w = words.tolist()
    if not w:
        return set()
    if len(w) < window:
        return {tuple(w)}
    return {tuple(w[i : i + window]) for i in range(len(w) - window + 1)}


class Automaton:
    """Patterns over word numbers 1..; 0 is any word outside the vocabulary."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        import ahocorasick

        data, off = utf8(pa.array([t for _, t in items], pa.large_string()))
        words = Words(data, off, 0, len(items)) if items else None
        hashes = words.hashes() if items else np.empty(0, np.uint64)
        self.vocabulary = np.unique(hashes)
        number = np.searchsorted(self.vocabulary, hashes) + 1
        patterns: dict[tuple[int, ...], set[str]] = {}
        for k, (item_id, _) in enumerate(items):
            for p in _windows(number[words.first[k] : words.first[k + 1]], window):
                patterns.setdefault(p, set()).add(item_id)
        self.shortest = min(map(len, patterns), default=1)
        self.machine = None
        if patterns:
            self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for p, ids in patterns.items():
                self.machine.add_word(p, (len(p), tuple(sorted(ids))))
            self.machine.make_automaton()

    def scan(self, words: Words) -> tuple[np.ndarray, list[set[str]]]:
        """Which words are hit, and the items of each row."""
        hit = np.zeros(len(words.starts), bool)
        found: list[set[str]] = [set() for _ in range(words.n_rows)]
        if self.machine is None or not len(hit):
            return hit, found
        h = words.hashes()
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        number = np.where(self.vocabulary[at] == h, at + 1, 0)
        # runs of words in the vocabulary within a row, long enough for a pattern
        known = number > 0
        begins = known.copy()
        begins[1:] &= ~known[:-1]
        rows = words.first[:-1][words.first[:-1] < len(known)]
        begins[rows] |= known[rows]
        start = np.flatnonzero(begins)
        stop = np.flatnonzero(known & ~np.concatenate([known[1:] & ~begins[1:], [False]])) + 1
        long = stop - start >= self.shortest
        start, stop = start[long], stop[long]
        row = np.searchsorted(words.first, start, side="right") - 1
        for a, b, r in zip(start.tolist(), stop.tolist(), row.tolist(), strict=True):
            for end, (n, ids) in self.machine.iter(tuple(number[a:b].tolist())):
                hit[a + end - n + 1 : a + end + 1] = True
                found[r].update(ids)
        return hit, found


_loaded: dict[str, Automaton] = {}


def _automaton(key: str, items: list[tuple[str, str]], window: int) -> Automaton:
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Automaton(items, window)
    return _loaded[key]


def _scan(key: str, broadcast, window: int, schema: pa.Schema, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None
        for batch in batches:
            machine = machine or _automaton(key, pickle.loads(broadcast.value), window)
            data, off = utf8(batch.column(text))
            for i, j in slices(off):
                words = Words(data, off, i, j)
                hit, found = machine.scan(words)
                first = words.first
                at = np.flatnonzero(hit)
                cut = np.searchsorted(at, first)
                hits = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array((at - np.repeat(first[:-1], np.diff(cut))).astype(np.int32)))
                a, z = words.starts[at] - np.repeat(words.rows[:-1], np.diff(cut)), words.ends[at] - np.repeat(words.rows[:-1], np.diff(cut))
                cols = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns)]
                cols += [
                    pa.array(np.diff(first).astype(np.int64)),
                    hits,
                    pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(a.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(z.astype(np.int32))),
                    pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def _parts(benchmark: DataFrame, window: int, max_patterns: int) -> Iterator[list[tuple[str, str]]]:
    """Items in lists of at most ``max_patterns`` windows (or one item), streamed
    to the driver one partition at a time."""
    part: list[tuple[str, str]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("i is not null and t is not null")
    for r in rows.toLocalIterator():
        n = max(1, len(r.t) // 2 - window + 2)
        if part and size + n > max_patterns:
            yield part
            part, size = [], 0
        part.append((r.i, r.t))
        size += n
    yield part


def scan(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = WINDOW, max_patterns: int = MAX_PATTERNS
) -> DataFrame:
    """``docs`` with n_words, hit_words (word numbers), hit_starts and hit_ends
    (byte offsets in the UTF-8 text) and items (sorted ids with a window found)."""
    spark, out = docs.sparkSession, docs
    names = ["n_words", "hit_words", "hit_starts", "hit_ends", "items"]
    kinds = ["long", "array<int>", "array<int>", "array<int>", "array<string>"]
    clash = [c for c in docs.columns if c.lower() in {n.lower() for n in [*names, *(f"_{n}" for n in names)]} and c != text]
    out = out.drop(*clash)
    first = True
    for items in _parts(benchmark, window, max_patterns):
        raw = pickle.dumps(items)
        fields = list(out.schema.fields)
        new = [T.StructField(n if first else f"_{n}", T._parse_datatype_string(k)) for n, k in zip(names, kinds, strict=True)]
        schema = T.StructType(fields + new)
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        key = hashlib.sha256(raw + str(window).encode()).hexdigest()
        out = out.mapInArrow(_scan(key, spark.sparkContext.broadcast(raw), window, arrow, text), schema)
        if not first:  # one more automaton: join its hits to those before
            both = F.arrays_zip("hit_words", "hit_starts", "hit_ends"), F.arrays_zip(F.col("_hit_words").alias("hit_words"), F.col("_hit_starts").alias("hit_starts"), F.col("_hit_ends").alias("hit_ends"))
            out = out.withColumn("_z", F.array_sort(F.array_union(*both))).withColumn("items", F.array_sort(F.array_union("items", "_items")))
            out = out.withColumns({n: F.col("_z")[n] for n in names[1:4]}).drop("_z", *(f"_{n}" for n in names))
        first = False
    return out


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a hit, with their own columns only."""
    rows, own = _io.apart(docs, "doc_id", "text")
    return scan(rows, benchmark, **options).where(F.size("hit_words") == 0).select(*own)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _io.table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(scan(docs, _io.table(spark, sf_dir, "benchmark")).drop("text"))


SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
pat AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ') FOR i IN range(1, len(w) - least(len(w), 10) + 2)]) AS p
  FROM iw WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM pat),
occ AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS p
  FROM dw, sizes WHERE len(w) >= n),
hits AS (SELECT o.doc_id, o.i, o.n, pat.item_id FROM occ o JOIN pat ON pat.n = o.n AND pat.p = o.p),
pos AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(t.items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(t.items, ','), '')) AS items_sha256,
  coalesce(p.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN pos p USING (doc_id) LEFT JOIN its t USING (doc_id)
"""
