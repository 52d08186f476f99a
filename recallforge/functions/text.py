"""Column functions over text: tokens, normal forms, markers, HTML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

WORD_BREAK = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda t: t != "")


def terms(text: Column) -> Column:
    """Distinct question terms: lower-cased, outer punctuation off, two characters or more."""
    cleaned = F.transform(F.split(F.lower(text), r"\s+"), lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.array_distinct(F.filter(cleaned, lambda t: F.length(t) >= 2))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def normal_surface(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " "))


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit("unknown"))


def marker_count(text: Column, markers) -> Column:
    """How many of the markers the lower-cased text contains (each once)."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(m)).cast("int") for m in markers], F.lit(0))


def html_text(html: Column) -> Column:
    """Text of a page: script and style bodies dropped, tags to spaces, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style.*?</style>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def initials(name: Column) -> Column:
    """First letters of the words of a name, lower-cased."""
    return F.array_join(F.transform(F.filter(F.split(F.lower(name), r"[\s_-]+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), "")


def topic_key(names: Column) -> Column:
    """The first five distinct lower-cased names in order, joined by a plus."""
    return F.array_join(F.slice(F.array_sort(F.array_distinct(F.transform(names, F.lower))), 1, 5), "+")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient: shared over the smaller set."""
    small = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(0.0)


def first_sentence(text: Column, most: int = 80) -> Column:
    """Up to the first full stop before ``most`` characters, else the first of ! ? or
    line end in that order; else the text, cut at a word beyond half of ``most``."""
    flat = F.regexp_replace(text, r"^\s+|\s+$", "")
    head = F.substring(flat, 1, most)
    at = lambda c: F.instr(flat, c)
    ends = [F.when((at(c) > 1) & (at(c) <= most), F.regexp_replace(F.substring(flat, F.lit(1), at(c)), r"\s+$", "")) for c in (".", "!", "?", "\n")]
    space = F.length(head) - F.instr(F.reverse(head), " ")  # what stands before the last space
    cut = F.when((F.instr(head, " ") > 0) & (space > most // 2), F.substring(head, F.lit(1), space)).otherwise(head)
    return F.coalesce(F.when(flat == "", ""), *ends, F.when(F.length(flat) <= most, flat), F.concat(cut, F.lit("...")))


def answer_form(text: Column) -> Column:
    """Answers before comparison: lower case, no articles, no punctuation, single spaces."""
    out = F.regexp_replace(F.lower(text), r"(?U)\b(a|an|the)\b", " ")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\s]", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def verb_heads(text: Column) -> Column:
    """First words of transition phrases that the text holds, lower-cased, distinct."""
    found = [F.regexp_extract_all(F.lower(text), F.lit(p), F.lit(1)) for p in VERB_PHRASES]
    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.array(*found)), lambda m: F.regexp_extract(m, r"^(\S+)", 1))))


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def utility(m: Column) -> Column:
    """From the number of utility markers."""
    return F.when(m == 0, 0.05).otherwise(_clamp(0.15 + 0.20 * m / (1.0 + 0.15 * m)))


def temporal_salience(dated: Column, marks: Column, verbs: Column) -> Column:
    return _clamp(F.when(dated, 0.40).otherwise(0.0) + F.least(F.lit(0.30), marks * 0.15) + F.least(F.lit(0.30), verbs * 0.10))


def persistence(length: Column, high: Column, low: Column) -> Column:
    return (
        F.when(length < 20, 0.05)
        .when((high > 0) & (low == 0), _clamp(0.60 + 0.10 * high))
        .when((low > 0) & (high == 0), _clamp(0.20 - 0.05 * low))
        .otherwise(_clamp(0.40 + 0.05 * (high - low)))
    )


def state_change(verbs: Column, version: Column, status: Column, from_to: Column) -> Column:
    out = F.least(F.lit(0.50), verbs * 0.20) + F.when(version, 0.20).otherwise(0.0)
    return _clamp(out + F.when(status & (verbs > 0), 0.25).otherwise(0.0) + F.when(from_to, 0.20).otherwise(0.0))


def admission(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, utility, temporal, persistence, change, score.  Texts are lower-cased and
    searched once: the counts are columns of their own, not parts of expressions
    that would repeat them."""
    low = df.select(key, F.col(text).alias("_x"), F.explode(F.array(F.lower(text))).alias("_l"))
    count = lambda markers: reduce(lambda a, b: a + b, [F.contains("_l", F.lit(m)).cast("int") for m in markers], F.lit(0))
    has = lambda w: F.contains("_l", F.lit(w))
    n = low.select(
        key, F.length("_l").alias("_n"), count(UTILITY).alias("_u"), count(TEMPORAL).alias("_tm"), count(TEMPORAL_VERBS).alias("_tv"), count(LASTING).alias("_hi"), count(PASSING).alias("_lo"), count(STATE_VERBS).alias("_sv"),
        (F.col("_x").rlike(DATE_ISO) | F.col("_x").rlike(DATE_NAMED)).alias("_d"), F.col("_l").rlike(VERSION).alias("_v"), (has("status") | has("state")).alias("_st"), (has(" from ") & has(" to ")).alias("_ft"),
    )
    c = F.col
    f = n.select(key, utility(c("_u")).alias("utility"), temporal_salience(c("_d"), c("_tm"), c("_tv")).alias("temporal"), persistence(c("_n"), c("_hi"), c("_lo")).alias("persistence"), state_change(c("_sv"), c("_v"), c("_st"), c("_ft")).alias("change"))
    return f.withColumn("score", 0.30 * c("utility") + 0.25 * c("persistence") + 0.25 * c("change") + 0.20 * c("temporal"))


def admission_route(score: Column, change: Column) -> Column:
    return F.when(change >= 0.35, "persist").when(score < 0.10, "discard").when(score < 0.25, "ephemeral_cache").otherwise("persist")


# Markers, phrases and patterns of the admission and transition rules.
UTILITY = (
    "decided", "decision", "chose", "chosen", "selected", "approved", "rejected", "agreed", "concluded", "resolved",
    "changed", "updated", "migrated", "deployed", "released", "reverted", "rolled back", "rollback", "upgraded", "downgraded", "patched", "hotfix", "hotfixed",
    "error", "bug", "incident", "outage", "failure", "failed", "crashed", "fix", "fixed", "broken", "regression", "alert", "exception",
    "architecture", "architectural", "design", "pattern", "convention", "constraint", "principle", "standard", "guideline", "policy",
    "endpoint", "returns", "accepts", "supports", "requires", "configuration", "parameter", "query", "response", "request", "method", "schema", "field", "column", "table", "index", "function", "class", "module", "interface", "protocol", "format", "type", "value", "default", "option", "authentication", "authorization", "token", "permission", "route", "path", "url", "api", "service", "handler",
)
TEMPORAL = ("now", "currently", "since", "as of", "starting", "until", "effective", "beginning", "from now", "going forward")
TEMPORAL_VERBS = ("changed", "updated", "released", "deprecated", "migrated", "fixed", "deployed", "removed", "added", "created")
LASTING = ("policy", "decision", "architectural", "architecture", "principle", "standard", "convention", "constraint", "guideline", "requirement", "rule", "always", "never", "must")
PASSING = ("todo", "wip", "draft", "temp", "temporary", "hack", "workaround", "quick fix", "placeholder", "experimenting", "trying")
STATE_VERBS = ("changed", "updated", "now", "switched", "moved", "set to", "became", "is now", "transitioned", "upgraded", "downgraded", "migrated", "replaced", "bumped", "converted")
DATE_ISO = r"\b\d{4}-\d{2}-\d{2}\b"
DATE_NAMED = r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\b"
VERSION = r"\bv?\d+\.\d+(?:\.\d+)?\b"
VERB_PHRASES = (
    r"\b(moves?\s+(?:from|to))\b", r"\b(retire[ds]?\s+\w+)\b", r"\b(supersedes?\s+\w+)\b", r"\b(replaces?\s+\w+)\b",
    r"\b(deprecat(?:es|ed|ing)\s+\w+)\b", r"\b(add(?:s|ed)?\s+\w+)\b", r"\b(extend[sd]?\s+\w+)\b", r"\b(introduce[sd]?\s+\w+)\b",
    r"\b(started|begins?|initiated|launched?)\b", r"\b(performed|completed|concluded)\b", r"\b(identified|reported|resolved|confirmed|cleared)\b", r"\b(scheduled|planned)\b",
)
