"""Operator 11: encoding and decoding with merge-type SentencePiece vocabularies.

A text is normalised as the model says (a space before it, spaces as ``▁``), and cut
wherever no piece of the vocabulary holds the two neighbouring bytes, so no merge can
cross a cut.  Each part is encoded by an agenda: all adjacent pairs of symbols that
form a piece wait in a heap, highest score first, leftmost first among equals; the best
is merged, pairs that lost a symbol since are passed over, and the pairs with the new
symbol's neighbours are put in.  Symbols outside the vocabulary become byte pieces.

Distinct parts are encoded once per worker, and those that are new in an Arrow batch
are checked there against the sentencepiece library; a difference is an error.  ``check``
compares whole texts, ids and decoded ones, with the library's.

Null text: empty, so the end id alone, decoded as the empty text.  A text of spaces keeps
them.  Very long texts are encoded whole (an agenda takes n log n steps).  Repeated rows
are each encoded; doc_ids may be null or repeat; empty tables give no rows; other columns
are ignored.  Vocabularies that are no merge vocabulary, or whose normaliser changes
characters, or that hold user-defined or unused pieces, are refused with an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recallforge.llm import _io
from recallforge.llm._text import range_hashes, slices, utf8

MODEL_FILE = "piece_bpe_32k.model"
SPACE = "▁"
#: Distinct parts, and their bytes, kept per Python worker before the table starts anew.
CACHE_PARTS = 1_000_000
CACHE_BYTES = 64 << 20
#: Bits of an agenda entry that hold a place.
_PLACE = (1 << 32) - 1

# Field numbers and kinds of the model file's format.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE_KIND, _MODEL_TYPE, _CHARSMAP, _DUMMY_PREFIX, _REMOVE_SPACES, _ESCAPE_SPACES, _BYTE_FALLBACK = 3, 3, 2, 3, 4, 5, 35
_MERGE_TYPE, _USER_DEFINED, _UNUSED = 2, 4, 5


def model_path(name: str = MODEL_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 0x80:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            if tag & 7 == 2:
                size, at = number(at)
            else:
                size = {1: 8, 5: 4}[tag & 7]
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _message(field: int, body: bytes) -> bytes:
    size, n = b"", len(body)
    while n > 0x7F:
        size, n = size + bytes([n & 0x7F | 0x80]), n >> 7
    return bytes([field << 3 | 2]) + size + bytes([n]) + body


class PieceModel:
    """The pieces of a model file, and texts to ids and back."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        top = list(_fields(raw))
        normal = [(k, v) for m, body in top if m == _NORMALIZER for k, v in _fields(body)]
        trained = dict(kv for m, body in top if m == _TRAINER for kv in _fields(body))
        spec = dict(normal)
        if trained.get(_MODEL_TYPE) != _MERGE_TYPE:
            raise ValueError("not a merge-type vocabulary")
        if spec.get(_CHARSMAP) or spec.get(_REMOVE_SPACES, 1) or not spec.get(_ESCAPE_SPACES, 1):
            raise ValueError("a normaliser that changes characters or spaces is not supported")
        if not trained.get(_BYTE_FALLBACK) or {dict(_fields(b)).get(_PIECE_KIND) for m, b in top if m == _PIECES} & {_USER_DEFINED, _UNUSED}:
            raise ValueError("vocabularies without byte pieces, or with user-defined or unused pieces, are not supported")
        self.prefix = bool(spec.get(_DUMMY_PREFIX, 1))
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        # the library on parts of a text: the same model without a space put before
        bare = b"".join(_message(m, body) for m, body in top if m != _NORMALIZER)
        bare += _message(_NORMALIZER, bytes([_DUMMY_PREFIX << 3, 0, _REMOVE_SPACES << 3, 0]))
        self.on_parts = sentencepiece.SentencePieceProcessor(model_proto=bare)
        sp, n = self.library, self.library.get_piece_size()
        self.end_id = sp.eos_id()
        self.pieces: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.shown: list[bytes] = []
        self.is_byte = np.zeros(n, bool)
        self.spaced = np.zeros(n, bool)
        joined = np.zeros((256, 256), bool)
        for k in range(n):
            text = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.byte_ids[int(text[3:5], 16)] = k
                self.is_byte[k] = True
                self.shown.append(bytes([int(text[3:5], 16)]))
            elif sp.is_control(k):
                self.shown.append(b"")
            elif sp.is_unknown(k):
                self.shown.append(sp.decode([k]).encode())
            else:
                self.pieces[text] = k
                self.spaced[k] = text.startswith(SPACE)
                plain = np.frombuffer(text.replace(SPACE, " ").encode(), np.uint8)
                joined[plain[:-1], plain[1:]] = True
                self.shown.append(plain.tobytes())
        scores = {s: r for r, s in enumerate(sorted({sp.get_score(k) for k in self.pieces.values()}, reverse=True))}
        self.rank = {text: scores[sp.get_score(k)] << _PLACE.bit_length() for text, k in self.pieces.items()}
        joined[:, 0x80:0xC0] = True  # a character is never cut
        self.joined = joined
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.held = 0
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 16, np.int64)

    def agenda(self, part: str) -> list[int]:
        """The ids of a part in which spaces are ``▁``.  An entry of the agenda is the
        rank of a pair's score and the place of its left symbol; one whose symbols have
        changed since no longer finds its rank there."""
        symbols, rank, n = list(part), self.rank.get, len(part)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = []
        for k in range(n - 1):
            r = rank(symbols[k] + symbols[k + 1])
            if r is not None:
                waiting.append(r + k)
        heapq.heapify(waiting)
        while waiting:
            entry = heapq.heappop(waiting)
            a = entry & _PLACE
            b = after[a]
            if not symbols[a] or b == n:
                continue
            pair = symbols[a] + symbols[b]
            if rank(pair) != entry - a:
                continue
            symbols[a], symbols[b] = pair, ""
            after[a] = b = after[b]
            if b < n:
                before[b] = a
                r = rank(pair + symbols[b])
                if r is not None:
                    heapq.heappush(waiting, r + a)
            b = before[a]
            if b >= 0:
                r = rank(symbols[b] + pair)
                if r is not None:
                    heapq.heappush(waiting, r + b)
        ids: list[int] = []
        for s in filter(None, symbols):
            k = self.pieces.get(s)
            if k is None:
                ids += [self.byte_ids[b] for b in s.encode()]
            else:
                ids.append(k)
        return ids

    def _learn(self, parts: list[bytes]) -> None:
        texts = [p.decode() for p in parts]
        mine = [self.agenda(t.replace(" ", SPACE)) for t in texts]
        theirs = self.on_parts.encode(texts, num_threads=1)
        if mine != theirs:
            k = next(k for k in range(len(parts)) if mine[k] != theirs[k])
            raise RuntimeError(f"the library encodes {texts[k]!r} as {theirs[k]}, not {mine[k]}")
        k = len(self.place)
        n = np.array([len(x) for x in mine], np.int64)
        used = int(self.ends[k - 1]) if k else 0
        if k + len(n) > len(self.ends):
            self.ends = np.resize(self.ends, 2 * (k + len(n)))
        if used + n.sum() > len(self.ids):
            self.ids = np.resize(self.ids, 2 * int(used + n.sum()))
        self.ends[k : k + len(n)] = used + np.cumsum(n)
        self.ids[used : used + int(n.sum())] = [x for ids in mine for x in ids]
        self.place.update(zip(parts, range(k, k + len(n)), strict=True))
        self.held += sum(map(len, parts))

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of UTF-8 texts, each closed by ``end_id``."""
        if len(self.place) > CACHE_PARTS or self.held > CACHE_BYTES:
            self._clear()
        space, lead = SPACE.encode(), b" " if self.prefix else b""
        rows = [lead + t.replace(space, b" ") if t else t for t in texts]
        raw = b"".join(rows)
        at = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int64)
        data = np.frombuffer(raw, np.uint8)
        begins = np.ones(len(data), bool)
        begins[1:] = ~self.joined[data[:-1], data[1:]]
        begins[at[:-1][at[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.full(len(texts), end_id, np.int32), np.ones(len(texts), np.int64)
        which = self._found(raw, data, starts, np.append(starts[1:], len(data)))
        ends = self.ends[which]
        begin = np.where(which > 0, self.ends[which - 1], 0)
        n = ends - begin
        cum = np.concatenate([[0], np.cumsum(n)])
        flat = self.ids[np.repeat(begin - cum[:-1], n) + np.arange(cum[-1])]
        row_ends = cum[np.searchsorted(starts, at)]
        return np.insert(flat, row_ends[1:], end_id).astype(np.int32), np.diff(row_ends) + 1

    def _found(self, raw: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table's number of each part.  Equal parts are brought together by a hash
        and then compared byte by byte with the first of them."""
        _, first, same = np.unique(range_hashes(data, starts, ends), return_index=True, return_inverse=True)
        size = ends - starts
        shift = starts[first][same] - starts
        if (size != size[first][same]).any() or (data[np.arange(len(data)) + np.repeat(shift, size)] != data).any():
            first = same = np.arange(len(starts))
        parts = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        known = list(map(self.place.get, parts))
        if None in known:
            self._learn(list(dict.fromkeys(p for p, k in zip(parts, known, strict=True) if k is None)))
            known = list(map(self.place.get, parts))
        return np.array(known, np.int64)[same]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, in UTF-8.  Bytes that are no character become U+FFFD each."""
        said = [self.shown[k] for k in ids.tolist()]
        if self.prefix:
            first = next((k for k, s in enumerate(said) if s), None)
            if first is not None and self.spaced[ids[first]]:
                said[first] = said[first][1:]
        text = b"".join(said)
        if self.is_byte[ids].any():
            if not all(said[:-1]):
                return self._mended(ids, said)
            try:
                text.decode()
            except UnicodeDecodeError:
                return self._mended(ids, said)
        return text

    def _mended(self, ids: np.ndarray, said: list[bytes]) -> bytes:
        out, run = [], bytearray()
        for one, s in zip(self.is_byte[ids].tolist(), said, strict=True):
            if one:
                run += s
                continue
            out += [_characters(bytes(run)), s]
            run.clear()
        return b"".join([*out, _characters(bytes(run))])


def _characters(run: bytes) -> bytes:
    """A run of byte pieces, with U+FFFD for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(run):
        lead = run[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            run[at : at + size].decode()
            out.append(run[at : at + size])
        except UnicodeDecodeError:
            size = 1
            out.append("�".encode())
        at += size
    return b"".join(out)


_models: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _lists(ids: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))


def _encoded(path: str, end_id: int | None, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for i, j in slices(off):
                ids, n = model.encode([data[a:b].tobytes() for a, b in zip(off[i:j], off[i + 1 : j + 1], strict=True)], model.end_id if end_id is None else end_id)
                cols = {"doc_id": batch.column("doc_id").slice(i, j - i), "ids": _lists(ids, n)}
                if with_text:
                    cut = np.concatenate([[0], np.cumsum(n)])
                    cols["decoded"] = pa.array([model.decode(ids[a:b]).decode() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.string())
                yield pa.RecordBatch.from_pydict(cols)

    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            rows = batch.column("ids").to_pylist()
            texts = [None if r is None else model.decode(np.array(r, np.int64)).decode() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _compared(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for i, j in slices(off):
                texts = [data[a:b].tobytes() for a, b in zip(off[i:j], off[i + 1 : j + 1], strict=True)]
                end = model.end_id if end_id is None else end_id
                ids, n = model.encode(texts, end)
                cut = np.concatenate([[0], np.cumsum(n)])
                mine = [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                theirs = [[*x, end] for x in model.library.encode([t.decode() for t in texts], num_threads=1)]
                same = [m.tolist() == t and model.decode(m).decode() == model.library.decode(t) for m, t in zip(mine, theirs, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), _lists(ids, n), pa.array(theirs, pa.list_(pa.int32())), pa.array(same)], names=["doc_id", "ids", "library_ids", "same"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encode(docs: DataFrame, *, model: str | None = None, end_id: int | None = None) -> DataFrame:
    """doc_id, ids of ``docs`` (doc_id, text), each closed by ``end_id`` (else the model's)."""
    return _rows(docs).mapInArrow(_encoded(model or model_path(), end_id, False), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, *, model: str | None = None) -> DataFrame:
    """doc_id, text of ``tokens`` (doc_id, ids); null ids: null."""
    rows = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decoded(model or model_path()), "doc_id long, text string")


def round_trip(docs: DataFrame, *, model: str | None = None, end_id: int | None = None) -> DataFrame:
    """doc_id, ids, decoded: ``encode`` and ``decode`` of its ids in one pass."""
    return _rows(docs).mapInArrow(_encoded(model or model_path(), end_id, True), "doc_id long, ids array<int>, decoded string")


def check(docs: DataFrame, *, model: str | None = None, end_id: int | None = None) -> DataFrame:
    """doc_id, ids, library_ids of the rows whose ids or decoded text are not those of
    the library on the whole text: none."""
    found = _rows(docs).mapInArrow(_compared(model or model_path(), end_id), "doc_id long, ids array<int>, library_ids array<int>, same boolean")
    return found.where("not same").drop("same")


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = round_trip(_io.table(spark, sf_dir, "documents"))
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
