"""Operator 3: token ids as Parquet list columns.

Documents are range-partitioned and sorted by doc_id, encoded once, and written
as one row per document: ``doc_id, shard, local_start, n_tokens, ids``.  ``ids``
is a list<int> column (dictionary encoded, falling back to delta encoding in
version-2 pages), ``local_start`` counts the ids before the document within its
shard, so a global start needs only the per-shard totals.  Row groups and pages
are sized by parameters; the writer leaves column and offset indexes, so a
doc_id predicate or a metadata-only read touches only the pages it needs.

There are as many shards as the table's size (as the plan estimates it) asks for,
and two a core at least.  Shards end between documents, by doc_id and the beginning
of the text, so rows that share a doc_id, or have none, are no single shard.

Null text: empty, so the end id alone.  Empty table: no rows.  Repeated doc_ids
are kept, ordered by text; a null doc_id sorts first.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from recallforge.llm import _io
from recallforge.llm._text import PIECE_LUT, Words, latin_classes, slices, utf8

TOKENIZER_FILE = "word_bpe_49k.json"
END_ID = 2
#: Distinct text pieces kept per Python worker before the cache starts anew.
CACHE_PIECES = 300_000
#: Input bytes of a shard; characters of a text that part rows of one doc_id.
SHARD_BYTES = 256 << 20
LEAD_CHARS = 64


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    bytes stand for themselves, the others follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


# The normaliser and the pattern of the tokenizer whose pieces are known.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def known_pieces(spec: dict) -> bool:
    """Whether a tokenizer of this definition cuts texts as PieceEncoder does."""
    same = spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _PRE_TOKENIZER and not spec.get("truncation")
    model = spec["model"]
    whole = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback"))
    return same and whole and all("<|" in t["content"] for t in spec["added_tokens"])


class PieceEncoder:
    """Whole texts through the tokenizers library, each distinct piece once.

    That is for tokenizers whose normaliser and pattern are the ones known here; with
    any other file texts are encoded whole, by the library.  The known one drops white space before it merges, so a text's ids are those
    of its pieces between ASCII white space in order.  Its pattern also always
    parts letters, digits and ASCII signs other than the apostrophe, so pieces
    are parted there too (letters: ASCII and Latin-1; nothing else is parted).
    A piece of lower-case Latin letters is one word of the tokenizer's model and
    goes to the library's model directly, any other piece through the library's
    whole chain.  A text that holds ``<|`` (special tokens) is encoded whole.
    Pieces are found by a 64-bit hash, batch by batch, in numpy.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.by_piece = known_pieces(json.loads(self.tok.to_str()))
        self.letters = _byte_letters()
        self._clear()

    def _clear(self) -> None:
        self.place: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _piece(self, p: bytes) -> list[int]:
        s = p.decode()
        if s.isalpha() and max(s) < "\u0250" and s == s.lower() and unicodedata.is_normalized("NFC", s):
            return [t.id for t in self.model.tokenize(s if len(s) == len(p) else "".join([self.letters[b] for b in p]))]
        return self.tok.encode(s, add_special_tokens=False).ids

    def _add(self, key: int, ids: list[int]) -> int:
        k = len(self.place)
        if k == len(self.begin):
            self.begin, self.count = np.resize(self.begin, 2 * k), np.resize(self.count, 2 * k)
        end = self.used + len(ids)
        if end > len(self.ids):
            self.ids = np.resize(self.ids, 2 * end)
        self.ids[self.used : end] = ids
        self.begin[k], self.count[k], self.used = self.used, len(ids), end
        self.place[key] = k
        return k

    def encode(self, data: np.ndarray, off: np.ndarray, i: int, j: int, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of rows i..j, each closed by ``end_id``."""
        raw = data[int(off[i]) : int(off[j])].tobytes()
        if not self.by_piece or b"<|" in raw:
            return self._whole(data, off, i, j, end_id)
        if len(self.place) > CACHE_PIECES:
            self._clear()
        w = Words(data, off, i, j, PIECE_LUT, latin_classes)
        keys, inv = np.unique(w.hashes(), return_inverse=True)
        known = list(map(self.place.get, keys.tolist()))
        if None in known:
            new = [k for k, v in enumerate(known) if v is None]
            at = np.empty(len(keys), np.int64)
            at[inv] = np.arange(len(inv))
            low = w.low.tobytes()
            starts, ends, values = w.starts[at[new]].tolist(), w.ends[at[new]].tolist(), keys[new].tolist()
            for k, a, b, key in zip(new, starts, ends, values, strict=True):
                known[k] = self._add(key, self._piece(low[a:b]))
        where = np.array(known, np.int64)[inv] if len(inv) else np.empty(0, np.int64)
        n = self.count[where]
        cum = np.concatenate([[0], np.cumsum(n)])
        flat = self.ids[np.repeat(self.begin[where] - cum[:-1], n) + np.arange(cum[-1])]
        ends = cum[w.first[1:]]
        return np.insert(flat, ends, end_id).astype(np.uint32), np.diff(cum[w.first]) + 1

    def _whole(self, data: np.ndarray, off: np.ndarray, i: int, j: int, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        texts = [data[off[k] : off[k + 1]].tobytes().decode() for k in range(i, j)]
        rows = [[*e.ids, end_id] for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([x for r in rows for x in r], np.uint32), np.array([len(r) for r in rows], np.int64)


_encoders: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _encode_partition(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, start = _encoder(path), 0
        for batch in batches:
            data, off = utf8(batch.column("text"))
            doc, shard = batch.column("doc_id"), batch.column("shard")
            for i, j in slices(off):
                ids, n = enc.encode(data, off, i, j, end_id)
                where = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays(
                    [doc.slice(i, j - i), shard.slice(i, j - i), pa.array(start + where[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(ids.view(np.int32)))],
                    names=["doc_id", "shard", "local_start", "n_tokens", "ids"],
                )
                start += int(where[-1])

    return run


def _encode_rows(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for i, j in slices(off):
                ids, n = enc.encode(data, off, i, j, end_id)
                where = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(where), pa.array(ids.view(np.int32)))], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids of ``docs`` (doc_id, text), each closed by ``end_id``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encode_rows(tokenizer or tokenizer_path(), end_id), "doc_id long, ids array<int>")


def write_tokens(
    docs: DataFrame,
    path: str,
    *,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    shards: int | None = None,
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
) -> None:
    """Encodes ``docs`` (doc_id, text) into token files under ``path``."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 62:  # what the plan says of data without files
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    n = shards or max(2 * spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    ordered = (
        rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, LEAD_CHARS).asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
        .withColumn("shard", F.spark_partition_id())
    )
    (
        ordered.mapInArrow(_encode_partition(tokenizer or tokenizer_path(), end_id), "doc_id long, shard int, local_start long, n_tokens long, ids array<int>")
        .write.mode("errorifexists")
        .option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens (and ids): only the columns asked for are read.
    The totals are one row per shard, so the window over them stays small."""
    rows = spark.read.parquet(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = totals.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_base"))
    cols = ["doc_id", (F.col("_base") + F.col("local_start")).alias("start"), "n_tokens"]
    return rows.join(F.broadcast(before), "shard").select(*cols, *(["ids"] if with_ids else []))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for batch in batches:
        ids = batch.column("ids")
        off = ids.offsets.to_numpy()
        flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
        keep = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(tokens: DataFrame) -> DataFrame:
    return tokens.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _io.fresh_path(spark, "tokens")
    write_tokens(_io.table(spark, sf_dir, "documents"), path)
    return token_digest(read_tokens(spark, path))
