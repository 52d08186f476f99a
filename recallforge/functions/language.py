"""Order-dependent text rules: stems, question skeletons, causal pairs, JSON repair.

Plain Python per text, wrapped as pandas UDFs for columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from recallforge.functions import stemming

_DETERMINERS = {"a", "an", "the", "this", "that", "these", "those", "our", "my", "your"}


def stem(word: str) -> str:
    """The English Snowball stem of a word, whatever its case."""
    return stemming.stem(word.lower())


def stems(text: str) -> str:
    return " ".join(stem(w) for w in re.findall(r"[^\W_]+", text))


def same_entity(a: str, b: str) -> bool:
    """Equal stems, or one a prefix of the other of four characters or more."""
    x, y = stems(a), stems(b)
    return x == y or (min(len(x), len(y)) >= 4 and (x.startswith(y) or y.startswith(x)))


def skeleton(question: str, entities: Iterable[str], most: int = 3) -> tuple[str, dict[str, str]]:
    """The question without determiners, up to ``most`` entities (longest first) as
    placeholders, other words stemmed; and what each placeholder stands for."""
    low, slots = " ".join(question.lower().split()), {}
    for name in sorted({e.lower() for e in entities}, key=lambda e: (-len(e), e)):
        if len(slots) < most and re.search(rf"(?<!\w){re.escape(name)}(?!\w)", low):
            mark = f"<x{len(slots) + 1}>"
            low = re.sub(rf"(?<!\w){re.escape(name)}(?!\w)", mark, low, count=1)
            slots[mark] = name
    words = re.findall(r"<x\d>|[^\W_]+", low)
    return " ".join(w if w in slots else stem(w) for w in words if w not in _DETERMINERS), slots


@dataclass(frozen=True)
class CausalPair:
    cause: str
    effect: str
    cue: str
    confidence: float


def causal_pairs(tokens: list[str], tags: list[str], confidences: list[float], least: float = 0.6) -> list[CausalPair]:
    """Nearest referents on either side of each causal cue (BIO tags REFERENT,
    CAUSE_AFTER for "because of", CAUSE_BEFORE for "led to"); both and the cue must
    be confident enough."""
    spans: list[tuple[str, int, int, float]] = []
    for k, tag in enumerate(tags):
        kind = tag[2:]
        if tag.startswith("B-") or (tag.startswith("I-") and (not spans or spans[-1][0] != kind or spans[-1][2] != k)):
            spans.append((kind, k, k + 1, confidences[k]))
        elif tag.startswith("I-"):
            last = spans.pop()
            spans.append((kind, last[1], k + 1, min(last[3], confidences[k])))
    name = lambda s: " ".join(tokens[s[1] : s[2]])
    out = []
    for i, s in enumerate(spans):
        if s[0] in ("CAUSE_AFTER", "CAUSE_BEFORE"):
            left = next((x for x in reversed(spans[:i]) if x[0] == "REFERENT"), None)
            right = next((x for x in spans[i + 1 :] if x[0] == "REFERENT"), None)
            if left and right and (sure := min(left[3], s[3], right[3])) >= least and name(left).lower() != name(right).lower():
                cause, effect = (right, left) if s[0] == "CAUSE_AFTER" else (left, right)
                out.append(CausalPair(name(cause), name(effect), name(s), sure))
    return out


def causal_edges(pairs: DataFrame, surfaces: DataFrame) -> DataFrame:
    """effect, cause, confidence over memory ids: two equi-joins on lower-cased
    surfaces (surface, memory_id); self-loops dropped."""
    look = surfaces.select(F.lower("surface").alias("_k"), "memory_id")
    a = pairs.join(look.withColumnRenamed("memory_id", "cause_id"), F.lower("cause") == F.col("_k")).drop("_k")
    b = a.join(look.withColumnRenamed("memory_id", "effect_id"), F.lower("effect") == F.col("_k")).drop("_k")
    return b.where("cause_id <> effect_id").select(F.col("effect_id").alias("effect"), F.col("cause_id").alias("cause"), "confidence")


def repaired_json(raw: str | None):
    """The first JSON value in model output: code fences off, trailing commas out,
    open brackets closed; None if that is not enough."""
    text = re.sub(r"```(?:json)?", "", raw or "")
    m = re.search(r"[\[{]", text)
    if not m:
        return None
    text = text[m.start() :]
    for cut in range(len(text), 0, -1):
        if text[cut - 1] in "]}":
            try:
                return json.loads(re.sub(r",\s*([\]}])", r"\1", text[:cut]))
            except ValueError:
                continue
    stack, quoted, k = [], False, 0
    while k < len(text):
        c = text[k]
        if quoted and c == "\\":
            k += 1
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "[{":
            stack.append("]" if c == "[" else "}")
        elif not quoted and c in "]}" and stack:
            stack.pop()
        k += 1
    try:
        return json.loads(re.sub(r",\s*$", "", text.rstrip() + '"' * quoted) + "".join(reversed(stack)))
    except ValueError:
        return None


def column(f: Callable[[str], object], kind: str) -> Callable[[Column], Column]:
    """A rule as a column function; null stays null."""

    @F.pandas_udf(T._parse_datatype_string(kind))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f(t))

    return run


def remember(cache: DataFrame, used: DataFrame) -> DataFrame:
    """Skeleton cache (skeleton, intent, hits) with the hits of ``used`` (skeleton,
    intent) added; new skeletons take the intent seen most often."""
    n = used.groupBy("skeleton", "intent").agg(F.count("*").alias("n"))
    best = n.groupBy("skeleton").agg(F.min_by("intent", F.struct((-F.col("n")).alias("n"), "intent")).alias("_i"), F.sum("n").alias("_h"))
    j = cache.join(best, "skeleton", "full")
    return j.select("skeleton", F.coalesce("intent", "_i").alias("intent"), (F.coalesce("hits", F.lit(0)) + F.coalesce("_h", F.lit(0))).alias("hits"))
