"""Operator 6: edit-aware token counts.

A document is kept as leaves, runs of whole pre-tokens of about ``leaf_chars``
characters, under a segment tree of character and token sums.  A leaf ends where the
tokenizer's pattern always ends a pre-token, whatever stands further away: before
white space, or between a letter and a sign other than the apostrophe.  So the leaves'
token counts add up to the document's.

An edit finds its leaves by descending the tree, re-encodes them together with the
neighbours it needs so that both ends are such boundaries again, and updates the
sums on their paths to the root.  The rest of the text is not encoded anew.

``build`` adds the leaves to each row (columns ``leaf_chars``, ``leaf_tokens``),
``apply_edits`` sums them up and uses them.  Edits are ``array<struct<start, stop,
text>>`` in code points of the document before any edit; they are applied from the
last to the first, clipped to the text, a null text inserting nothing.

Null text: empty, no leaves, 0 tokens; an edit may insert into it.  Null edits:
none.  A very long run without a boundary is one pre-token or a few and one leaf,
encoded anew as a whole.  Repeated rows are counted each.  Empty table: no rows.
Other columns pass through ``build``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from recallforge.llm import _io

RANKS_FILE = "byte_bpe_50k.tiktoken"
LEAF_CHARS = 256
# Characters that every Unicode version has as letters, and signs: where both are
# known, a pre-token ends between them.
_LETTER = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_SIGN = r"!-&(-/:-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1f"
_BOUNDARY = re.compile(rf"(?<=\S)(?=[ \t\n\v\f\r])|(?<=[{_LETTER}])(?=[{_SIGN}])|(?<=[{_SIGN}])(?=[{_LETTER}])")
_encodings: dict[str, object] = {}


def encoding(path: str | None = None):
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path(RANKS_FILE)
    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def cut_leaves(text: str, leaf_chars: int = LEAF_CHARS) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _BOUNDARY.search(text, at + leaf_chars)
        end = m.start() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


def _parts(left: str, right: str) -> bool:
    """Whether a pre-token always ends between the two texts."""
    return not left or not right or _BOUNDARY.match(left[-1] + right[0], 1) is not None


class TokenTree:
    """Leaves of a text under sums of their characters and tokens."""

    def __init__(self, leaves: list[str], tokens: list[int], count):
        self.leaves, self.count = list(leaves) or [""], count
        self.m = 1 << (len(self.leaves) - 1).bit_length()
        self.leaves += [""] * (self.m - len(self.leaves))
        self.chars, self.tokens = [0] * (2 * self.m), [0] * (2 * self.m)
        for k, (s, n) in enumerate(zip(leaves, tokens, strict=True)):
            self.chars[self.m + k], self.tokens[self.m + k] = len(s), n
        for k in range(self.m - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
        self.reencoded = 0

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        k = self.m + leaf
        chars_by, tokens_by = len(text) - self.chars[k], tokens - self.tokens[k]
        while k:
            self.chars[k] += chars_by
            self.tokens[k] += tokens_by
            k //= 2

    def _before(self, leaf: int) -> int:
        """Characters before a leaf: the left siblings on its path to the root."""
        total, k = 0, self.m + leaf
        while k > 1:
            if k & 1:
                total += self.chars[k - 1]
            k //= 2
        return total

    def _find(self, at: int) -> int:
        """The leaf of character ``at`` (the last leaf that is not empty at the end of
        the text), by descent from the root."""
        at, k = min(at, self.n_chars - 1), 1
        while k < self.m:
            k *= 2
            if at >= self.chars[k] and self.chars[k + 1]:
                at -= self.chars[k]
                k += 1
        return k - self.m

    def edit(self, start: int, stop: int, text: str) -> None:
        size = self.n_chars
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        a = self._find(start)
        b = max(a, self._find(max(start, stop - 1)))
        base = self._before(a)
        whole = "".join(self.leaves[a : b + 1])
        new = whole[: start - base] + text + whole[stop - base :]
        while True:  # boundary context
            left = a - 1
            while left >= 0 and not self.leaves[left]:
                left -= 1
            right = b + 1
            while right < self.m and not self.leaves[right]:
                right += 1
            if left >= 0 and (not _parts(self.leaves[left], new) or not new and right < self.m and not _parts(self.leaves[left], self.leaves[right])):
                new, a = self.leaves[left] + new, left
            elif right < self.m and not _parts(new, self.leaves[right]):
                new, b = new + self.leaves[right], right
            else:
                break
        self.reencoded += len(new)
        self._set(a, new, self.count(new))
        for k in range(a + 1, b + 1):
            if self.leaves[k]:
                self._set(k, "", 0)


def _counter(path: str | None):
    encode = encoding(path).encode_ordinary
    return lambda s: len(encode(s)) if s else 0


def _build(path: str | None, leaf_chars: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                leaves = [cut_leaves(t or "", leaf_chars) for t in batch.column("text").to_pylist()]
                cols = [*batch.columns, pa.array([[len(s) for s in x] for x in leaves], pa.list_(pa.int32())), pa.array([[count(s) for s in x] for x in leaves], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def build(docs: DataFrame, *, ranks: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``docs`` with the leaves of each text: leaf_chars and leaf_tokens."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("leaf_chars", "leaf_tokens")])
    kind = T.ArrayType(T.IntegerType())
    schema = T.StructType([*docs.schema.fields, T.StructField("leaf_chars", kind), T.StructField("leaf_tokens", kind)])
    return docs.mapInArrow(_build(ranks, leaf_chars, to_arrow_schema(schema)), schema)


_COUNTED = "doc_id long, n_tokens long, n_tokens_after long, n_edits long, n_chars_after long, reencoded_chars long, text_after string"


def _apply(path: str | None, with_text: bool):
    names = [f.split()[0] for f in _COUNTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch, out = whole.slice(i, 256), []
                for doc, text, chars, tokens, edits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "leaf_chars", "leaf_tokens", "edits")), strict=True):
                    leaves, at = [], 0
                    for n in chars or []:
                        leaves.append(text[at : at + n])
                        at += n
                    tree = TokenTree(leaves, tokens or [], count)
                    before = tree.n_tokens
                    edits = [e for e in edits or [] if e and e["start"] is not None]
                    for e in sorted(edits, key=lambda e: (e["start"], e["stop"] or 0), reverse=True):
                        tree.edit(e["start"], e["start"] if e["stop"] is None else e["stop"], e["text"] or "")
                    out.append((doc, before, tree.n_tokens, len(edits), tree.n_chars, tree.reencoded, tree.text() if with_text else None))
                kinds = [pa.int64()] * 6 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def apply_edits(trees: DataFrame, *, ranks: str | None = None, with_text: bool = False) -> DataFrame:
    """Token counts before and after the edits of each row of ``trees`` (doc_id,
    text, leaf_chars, leaf_tokens, edits)."""
    out = trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", "edits").mapInArrow(_apply(ranks, with_text), _COUNTED)
    return out if with_text else out.drop("text_after")


def revision(text: str = "text"):
    """The edits of the query: an insertion at a quarter of each text, a deletion
    at its half, a replacement at three quarters."""
    n = F.coalesce(F.length(text), F.lit(0))
    at = lambda k: F.floor(n * k / 4).cast("int")
    edit = lambda start, cut, new: F.struct(start.alias("start"), F.least(start + cut, n).alias("stop"), F.lit(new).alias("text"))
    return F.array(edit(at(1), 0, "revised "), edit(at(2), 16, ""), edit(at(3), 8, "2nd edition"))


def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _io.table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", revision())
    return apply_edits(build(docs))
