"""Questions of the grammar: cue tags to a logical form, names to subjects and
entities, and the operators that answer each form.

Tags come token by token in BIO form (``B-REFERENT`` and so on), from a tagger that the
caller plugs in.  ``synthesise`` reads them by ordered rules, once per question.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from recallforge.functions import language as L, text as T
from recallforge.operators.state import SUBJECT

# Which operator answers a relation; which confidences count.
RELATION_INTENTS = {
    "current": "current",
    "retired": "retirement",
    "declared": "origin",
    "state_at": "current",
    "before_named": "before_named",
    "after_named": "sequence",
    "between": "interval",
    "concurrent_with": "concurrent",
    "during_interval": "interval",
    "predecessor": "predecessor",
    "cause_of": "cause_of",
    "effect_of": "cause_of",
    "chain_cause_of": "transitive_cause",
    "trigger_of": "cause_of",
    "contributing_factor": "cause_of",
    "first": "origin",
    "last": "current",
    "nth": "sequence",
}
CONFIDENT = ("high", "medium")
BARE_ASKS = ("what", "which", "who", "where", "when", "why", "how", "most")
RETIREMENTS = ("retired", "retire", "removed", "replaced", "deprecated")
RETIREMENT_VERBS = (
    "supersedes", "superseded", "retire", "retired", "retires", "replace", "replaced", "replaces", "deprecate",
    "deprecated", "deprecates", "deprecating", "move", "moved", "moves", "migrate", "migrated", "migrates",
)
TRANSITION_RANK = {"supersedes": 3, "retires": 2, "refines": 1, "introduces": 0}


@dataclass(frozen=True)
class Form:
    """What a question asks: a relation on an axis, and what it is about."""

    axis: str
    relation: str
    confidence: float
    rule: str
    referent: str | None = None
    secondary: str | None = None
    subject: str | None = None
    scope: str | None = None
    depth: int = 1
    scenario: str | None = None
    moment: str | None = None

    @property
    def intent(self) -> str | None:
        """The operator that answers; None where there is none, so the search stands."""
        return RELATION_INTENTS.get(self.relation)


class Cues:
    """The tagged spans of a question, by kind."""

    def __init__(self, tokens: list[str], tags: list[str]):
        self.text = " ".join(tokens).lower()
        self.spans: dict[str, list[list[str]]] = {}
        before = None
        for token, tag in zip(tokens, tags, strict=True):
            mark, _, kind = tag.partition("-")
            if not kind:
                before = None
                continue
            if mark == "I" and before == kind:
                self.spans[kind][-1].append(token)
            else:
                self.spans.setdefault(kind, []).append([token])
            before = kind

    def of(self, kind: str) -> list[str]:
        return [" ".join(s).lower().strip() for s in self.spans.get(kind, ())]

    def any(self, *kinds: str) -> bool:
        return any(self.spans.get(k) for k in kinds)

    def says(self, *words: str) -> bool:
        return any(w in self.text for w in words)


#: What a classifier knows of the question, where there is one.
@dataclass(frozen=True)
class Grounding:
    change: str | None = None
    roles: tuple[dict, ...] = ()
    slots: tuple[tuple[str, str], ...] = ()

    def names(self) -> tuple[str | None, str | None, str | None]:
        """(referent, secondary, scope): the first primary name and its slot, and an
        alternative, else the second primary one."""
        text = lambda r, *keys: next((str(r[k]).strip().lower() for k in keys if r.get(k)), "")
        first = [(text(r, "slot") or None, text(r, "canonical", "surface")) for r in self.roles if text(r, "role") == "primary" and text(r, "canonical", "surface")]
        other = [text(r, "canonical", "surface") for r in self.roles if text(r, "role") == "alternative" and text(r, "canonical", "surface")]
        for slot, value in ((s, v.strip().lower()) for s, v in self.slots if v):
            if slot == "alternative":
                other.append(value)
            elif value not in [n for _, n in first]:
                first.append((slot, value))
        referent = first[0][1] if first else None
        secondary = other[0] if other else first[1][1] if len(first) > 1 else None
        return referent, secondary, next((s for s, _ in first if s and s != "object"), None)


def _modal(c: Cues, f: Form, g: Grounding) -> Form | None:
    if c.any("MODAL_HYPOTHETICAL"):
        kept = f"preserve_{f.referent}" if f.referent else "skip_most_recent_supersession"
        return replace(f, axis="modal", relation="would_be_current_if", confidence=0.85, rule="modal_counterfactual", scenario=kept, secondary=None, moment=None)
    return None


def _trace(c: Cues, f: Form, g: Grounding) -> Form | None:
    if c.any("TEMPORAL_BEFORE") and c.says("trace") and c.says("from") and c.says("through", "to"):
        return replace(f, axis="ordinal", relation="first", confidence=0.78, rule="trace_from_start", moment=None)
    return None


def _alternatives(c: Cues, f: Form, g: Grounding) -> Form | None:
    asked = c.says("alternative", "considered", "current choice")
    gone = c.any("TEMPORAL_BEFORE") or c.says("retire", "replaced", "deprecated")
    if not f.referent and asked and gone:
        return replace(f, axis="state", relation="retired", confidence=0.76, rule="alternatives_section", scope=f.scope or "alternatives", moment=None)
    return None


def _change(c: Cues, f: Form, g: Grounding) -> Form | None:
    if not c.any("ASK_CHANGE"):
        return None
    worded = any(s in RETIREMENTS or any(w in s for w in RETIREMENTS if w != "retire") for s in c.of("ASK_CHANGE"))
    gone = c.any("TEMPORAL_BEFORE") or g.change == "retirement" or worded
    return replace(f, axis="state", relation="retired" if gone else "declared", confidence=0.7, rule="ask_change")


def _current(c: Cues, f: Form, g: Grounding) -> Form | None:
    if c.any("ASK_CURRENT") and (f.subject or f.scope or f.referent or any(s not in BARE_ASKS for s in c.of("ASK_CURRENT"))):
        return replace(f, axis="state", relation="current", confidence=0.9, rule="state_current", moment=None)
    return None


def _ordinal(kind: str, relation: str, confidence: float) -> Callable[[Cues, Form, Grounding], Form | None]:
    def rule(c: Cues, f: Form, g: Grounding) -> Form | None:
        if not c.any(kind):
            return None
        which = c.of(kind)[0] if relation == "nth" else None
        return replace(f, axis="ordinal", relation=relation, confidence=confidence, rule=f"ordinal_{relation}", scenario=which)

    return rule


def _cause(c: Cues, f: Form, g: Grounding) -> Form | None:
    if not c.any("CAUSAL_EXPLICIT", "CAUSAL_ALTLEX"):
        return None
    f = replace(f, axis="causal", scope=None, moment=None)
    if any(" " in s or "chain" in s for s in c.of("CAUSAL_ALTLEX")):
        return replace(f, relation="chain_cause_of", depth=2, confidence=0.82, rule="causal_chain")
    return replace(f, relation="cause_of", confidence=0.88, rule="causal_direct")


def _before(c: Cues, f: Form, g: Grounding) -> Form | None:
    if not (c.any("TEMPORAL_BEFORE") and f.referent):
        return None
    named = bool(f.secondary)
    return replace(f, axis="temporal", relation="before_named" if named else "predecessor", confidence=0.9, rule="temporal_before_named" if named else "temporal_predecessor")


def _after(c: Cues, f: Form, g: Grounding) -> Form | None:
    return replace(f, axis="temporal", relation="after_named", confidence=0.88, rule="temporal_after_named") if c.any("TEMPORAL_AFTER") and f.referent else None


def _during(c: Cues, f: Form, g: Grounding) -> Form | None:
    alone = c.any("TEMPORAL_ANCHOR") and not c.any("ORDINAL_FIRST", "ORDINAL_LAST", "ORDINAL_NTH", "TEMPORAL_SINCE")
    if not (c.any("TEMPORAL_DURING") or alone):
        return None
    if f.referent and not f.moment:
        return replace(f, axis="temporal", relation="concurrent_with", confidence=0.84, rule="temporal_concurrent")
    return replace(f, axis="temporal", relation="during_interval", confidence=0.82, rule="temporal_during")


def _since(c: Cues, f: Form, g: Grounding) -> Form | None:
    return replace(f, axis="temporal", relation="state_at", confidence=0.78, rule="temporal_since") if c.any("TEMPORAL_SINCE") else None


def _bare(c: Cues, f: Form, g: Grounding) -> Form | None:
    return replace(f, axis="state", relation="state_at", confidence=0.6, rule="state_bare_referent", moment=None) if f.referent and f.scope else None


#: What is asked for comes first: counterfactuals, changes, the present, places in an
#: order; then causes, and times.
RULES = (
    _modal, _trace, _alternatives, _change, _current,
    _ordinal("ORDINAL_FIRST", "first", 0.85), _ordinal("ORDINAL_LAST", "last", 0.85), _ordinal("ORDINAL_NTH", "nth", 0.75),
    _cause, _before, _after, _during, _since, _bare,
)


def synthesise(tokens: list[str], tags: list[str], grounding: Grounding = Grounding()) -> Form | None:
    """The logical form of a tagged question; None where no rule fits."""
    if not tokens:
        return None
    c = Cues(tokens, tags)
    referent, secondary, scope = grounding.names()
    first = lambda kind, k=0: next(iter(c.of(kind)[k : k + 1]), None)
    base = Form(
        "", "", 0.0, "", referent=first("REFERENT") or referent, secondary=first("REFERENT", 1) or secondary, subject=first("SUBJECT"),
        scope=first("SCOPE") or scope, moment=first("TEMPORAL_ANCHOR"),
    )
    return next((form for rule in RULES if (form := rule(c, base, grounding)) is not None), None)


def forms(questions: DataFrame, key: str, tokens: str, tags: str) -> DataFrame:
    """key, relation, intent, referent, secondary, subject, scope, moment, confidence,
    rule of tagged questions; those without a form go."""
    kind = "relation string, intent string, referent string, secondary string, subject string, scope string, moment string, confidence double, rule string"
    names = [p.split()[0] for p in kind.split(", ")]

    @F.pandas_udf(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>")
    def run(words: pd.Series, marks: pd.Series) -> pd.DataFrame:
        found = [synthesise(list(w), list(m)) if w is not None and m is not None else None for w, m in zip(words, marks, strict=True)]
        return pd.DataFrame([[getattr(f, n) if f else None for n in names] for f in found], columns=names)

    return questions.withColumn("_f", run(F.col(tokens), F.col(tags))).select(key, "_f.*").where("relation is not null")


# --- names ------------------------------------------------------------------------


def vocabulary(mentions: DataFrame) -> DataFrame:
    """token, subject, canonical, subjects, is_primary, stems of mentions (subject,
    entity): whole names and the words of longer ones, each under the subject that has
    it most often (ties: smaller), in its first spelling.  Digits, single characters and
    pairs in lower case are no tokens."""
    name = F.trim("entity")
    words = F.filter(F.split(name, r"\s+"), lambda w: F.lower(w) != F.lower(name))
    tagged = F.concat(F.array(F.struct(name.alias("t"), F.lit(True).alias("p"))), F.transform(words, lambda w: F.struct(w.alias("t"), F.lit(False).alias("p"))))
    rows = mentions.where(F.col("subject").cast("string") != "").select("subject", F.explode(tagged).alias("x")).select("subject", F.col("x.t").alias("canonical"), F.col("x.p").alias("p"), F.lower("x.t").alias("token"))
    short = (F.length("token") == 2) & (F.col("canonical") == F.col("token"))
    rows = rows.where((F.length("token") >= 2) & ~F.col("token").rlike(r"^\d+$") & ~short)
    n = rows.groupBy("token", "subject").agg(F.count("*").alias("n"), F.min("canonical").alias("canonical"), F.max("p").alias("p"))
    v = n.groupBy("token").agg(F.min_by("subject", F.struct(F.negate("n"), "subject")).alias("subject"), F.min("canonical").alias("canonical"), F.count("*").alias("subjects"), F.max("p").alias("is_primary"))
    return v.withColumn("stems", F.array_distinct(F.split(L.column(L.stems, "string")(F.col("token")), " ")))


def _hits(questions: DataFrame, vocab: DataFrame, key: str, text: str) -> DataFrame:
    """key, and the vocabulary's row of each token that a question holds, word for word
    or stem for stem.  A stem of the token is the join key, so no question meets the
    whole vocabulary."""
    q = questions.select(key, F.lower(text).alias("_q"), L.column(L.stems, "string")(F.lower(text)).alias("_s"))
    q = q.select("*", F.explode(F.array_distinct(F.split("_s", " "))).alias("_k"))
    v = vocab.withColumn("_k", F.get("stems", F.lit(0))).withColumn("_sequence", L.column(L.stems, "string")(F.col("token")))
    held = F.contains(F.concat(F.lit(" "), F.col("_s"), F.lit(" ")), F.concat(F.lit(" "), F.col("_sequence"), F.lit(" ")))
    return q.join(v, "_k").where(held & (F.col("_sequence") != "")).drop("_k")


def subject_of(questions: DataFrame, vocab: DataFrame, key: str, text: str) -> DataFrame:
    """key, subject: the one that a question names, by whole names before words, then
    tokens of few subjects, then long ones."""
    best = F.max(F.struct("is_primary", (1.0 / F.col("subjects")).alias("d"), F.length("token").alias("n"), "subject"))
    return _hits(questions, vocab, key, text).groupBy(key).agg(best.alias("b")).select(key, F.col("b.subject").alias("subject"))


def entity_of(questions: DataFrame, vocab: DataFrame, key: str, text: str) -> DataFrame:
    """key, entity: the longest token that a question names (ties: the smallest), in its
    first spelling."""
    best = F.max_by("canonical", F.struct(F.length("token").alias("n"), F.negate(F.xxhash64("token")).alias("t")))
    return _hits(questions, vocab, key, text).groupBy(key).agg(best.alias("entity"))


def structure(questions: DataFrame, vocab: DataFrame, key: str, text: str, nouns: DataFrame | None = None, issues: tuple[str, ...] = ()) -> DataFrame:
    """key, subject, target, secondary: the first two entities of a question from left
    to right, none inside a longer one, topical ``nouns`` (token) left out; without any
    the first word that is among ``issues``."""
    found = _hits(questions, vocab, key, text)
    if nouns is not None:
        found = found.join(nouns.select(F.lower("token").alias("token")), "token", "left_anti")
    found = found.withColumn("at", F.instr(F.concat(F.lit(" "), F.regexp_replace("_q", r"[^\p{L}\p{N}_]+", " "), F.lit(" ")), F.concat(F.lit(" "), F.col("token"), F.lit(" "))))
    spans = found.where("at > 0").groupBy(key).agg(F.array_sort(F.collect_set(F.struct("at", F.length("token").alias("n"), "canonical"))).alias("s"))
    inside = lambda x, y: (y["n"] > x["n"]) & (y["at"] <= x["at"]) & (x["at"] + x["n"] <= y["at"] + y["n"])
    outer = F.array_distinct(F.transform(F.filter("s", lambda x: ~F.exists("s", lambda y: inside(x, y))), lambda x: x["canonical"]))
    named = spans.select(key, outer.alias("e"))
    seed = F.get(F.filter(T.tokens(F.col(text)), lambda w: w.isin(list(issues)) if issues else F.lit(False)), F.lit(0))
    q = questions.select(key, seed.alias("_issue")).join(named, key, "left").join(subject_of(questions, vocab, key, text), key, "left")
    return q.select(key, "subject", F.coalesce(F.get("e", F.lit(0)), "_issue").alias("target"), F.get("e", F.lit(1)).alias("secondary"))


def expand_aliases(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, form: each name itself and its aliases (short, full), either way round and
    whatever its case."""
    both = aliases.select(F.lower("short").alias("_k"), F.col("full").alias("form")).unionByName(aliases.select(F.lower("full").alias("_k"), F.col("short").alias("form")))
    other = names.withColumn("_k", F.lower("name")).join(both, "_k").select("name", "form")
    return names.select("name", F.col("name").alias("form")).unionByName(other).distinct()


def marker_intent(questions: DataFrame, markers: DataFrame, key: str, text: str) -> DataFrame:
    """key, transition: the transition (transition, head) of which a question holds most
    heads, as words or beginnings of words; ties by rank.  Beginnings are the join key."""
    word = questions.select(key, F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("w")).where("length(w) > 0")
    begin = word.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring("w", F.lit(1), i))).alias("head")).distinct()
    n = begin.join(markers.select("transition", "head"), "head").groupBy(key, "transition").agg(F.count("*").alias("n"))
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TRANSITION_RANK.items() for x in kv]), F.col("transition")), F.lit(0))
    return n.groupBy(key).agg(F.max_by("transition", F.struct("n", rank.alias("r"), "transition")).alias("transition"))


# --- retirement -------------------------------------------------------------------


def silent(src: Column, dst: Column, domain: Column | None = None) -> Column:
    """Entities that the old memory has and the new one lacks, but for cross-references
    (``ADR-021``) and topical nouns."""
    gone = F.filter(F.array_except(src, dst), lambda e: ~e.rlike(r"(?i)^[A-Z]{2,5}-\w*$"))
    return gone if domain is None else F.filter(gone, lambda e: ~F.array_contains(domain, F.lower(e)))


def without_new(retired: Column, src: Column, dst: Column) -> Column:
    """Without entities that only the new memory has, whatever their case."""
    low = lambda c: F.transform(c, F.lower)
    new = F.array_except(low(dst), low(src))
    return F.filter(retired, lambda e: ~F.array_contains(new, F.lower(e)))


def retired_in(text: str, names: Iterable[str], verbs: Iterable[str] = RETIREMENT_VERBS, domain: Iterable[str] = ()) -> set[str]:
    """Names that the sentences of a text retire: around a retiring verb (60 characters
    before, 80 after), or on the ``from`` side of a move."""
    forms = {n.lower(): n for n in names}
    skip = {d.lower() for d in domain}
    forms = {low: n for low, n in forms.items() if low not in skip and not re.match(r"(?i)^[A-Z]{2,5}-\w*$", low)}
    verb = re.compile(r"\b(" + "|".join(sorted(map(re.escape, verbs), key=len, reverse=True)) + r")\w*\b")
    within = lambda part: {n for low, n in forms.items() if re.search(rf"\b{re.escape(low)}\w*\b", part)}
    out: set[str] = set()
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", text):
        low = sentence.strip().lower()
        hits = list(verb.finditer(low))
        if any(h[1].startswith(("mov", "migrat")) for h in hits):
            if start := re.search(r"\bfrom\b", low):
                rest = low[start.end() :]
                stop = re.search(r"\b(?:to|into|toward|towards)\b", rest)
                out |= within(rest[: stop.start()] if stop else rest)
            continue
        for h in hits:
            out |= within(low[max(0, h.start() - 60) : h.start()]) | within(low[h.end() : h.end() + 80])
    return out


def retired(df: DataFrame, text: str, src: str, dst: str, *, verbs: tuple[str, ...] = RETIREMENT_VERBS, domain: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``retired``: entities that the new memory's text retires, or that are
    silently gone, without those it introduces; sorted."""

    @F.pandas_udf("array<string>")
    def worded(texts: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        rows = zip(texts, a, b, strict=True)
        return pd.Series([sorted(retired_in(t or "", [*(x if x is not None else ()), *(y if y is not None else ())], verbs, domain)) for t, x, y in rows])

    known = F.array(*map(F.lit, [d.lower() for d in domain])).cast("array<string>")
    gone = F.array_union(worded(F.col(text), F.col(src), F.col(dst)), silent(F.col(src), F.col(dst), known))
    return df.withColumn("retired", F.array_sort(without_new(gone, F.col(src), F.col(dst))))


# --- answers ----------------------------------------------------------------------


def confident(level: Column) -> Column:
    """Whether an answer of that confidence goes before the search's results."""
    return F.coalesce(F.lower(level).isin(*CONFIDENT), F.lit(False))


def still(questions: DataFrame, states: DataFrame) -> DataFrame:
    """question_id, answer, confidence: whether a value (question_id, entity_id,
    state_key, value) still holds.  Retired since: the node that followed it, high;
    held by the current state: that node, medium; else none, abstain."""
    w = Window.partitionBy(*SUBJECT).orderBy("created_at", "node_id")
    s = states.select(*SUBJECT, "node_id", "created_at", "state_value", F.lag("state_value").over(w).alias("_before"), F.lead("node_id").over(w).isNull().alias("_last"))
    q = questions.join(s, SUBJECT, "left")
    left = (F.col("_before") == F.col("value")) & (F.col("state_value") != F.col("value"))
    at = F.struct("created_at", "node_id")
    found = q.groupBy("question_id").agg(F.min_by(F.when(left, F.col("node_id")), F.when(left, at)).alias("_gone"), F.max(F.when(F.col("_last") & (F.col("state_value") == F.col("value")), F.col("node_id"))).alias("_now"))
    level = F.when(F.col("_gone").isNotNull(), "high").when(F.col("_now").isNotNull(), "medium").otherwise("abstain")
    return found.select("question_id", F.coalesce("_gone", "_now").alias("answer"), level.alias("confidence"))


def dispatch(questions: DataFrame, states: DataFrame, *, days: int = 7) -> DataFrame:
    """question_id, intent, answer, confidence of questions (question_id, intent,
    entity_id, state_key, x, y): x and y are nodes of the subject.  One pass over the
    subjects' states answers all intents; an intent without an operator is ``none``, one
    whose nodes are missing abstains."""
    w = Window.partitionBy(*SUBJECT).orderBy("created_at", "node_id")
    s = states.select(
        *SUBJECT, "node_id", "created_at", "state_value", F.lead("node_id").over(w).alias("after"), F.lag("node_id").over(w).alias("before"), F.lag("state_value").over(w).alias("was"),
    )
    time = lambda k, n: s.select(*SUBJECT, F.col("node_id").alias(k), F.col("created_at").alias(f"{n}_at"), F.col("state_value").alias(f"{n}_value"))
    q = questions.join(time("x", "x"), [*SUBJECT, "x"], "left").join(time("y", "y"), [*SUBJECT, "y"], "left")
    j = q.join(s, SUBJECT, "left")
    at, gap = F.struct("created_at", "node_id"), F.expr(f"interval {days} days")
    low, high = F.least("x_at", "y_at"), F.greatest("x_at", "y_at")
    node, when, i = F.col("node_id"), F.col("created_at"), F.col("intent")
    first = lambda cond: F.min_by(F.when(cond, node), F.when(cond, at))
    near = (node != F.col("x")) & when.between(F.col("x_at") - gap, F.col("x_at") + gap)
    found = j.groupBy("question_id", "intent", "x", "y", "x_at", "y_at").agg(
        F.max_by("node_id", at).alias("current"), F.min_by("node_id", at).alias("origin"),
        F.max(F.when(node == F.col("x"), F.col("after"))).alias("sequence"), F.max(F.when(node == F.col("x"), F.col("before"))).alias("predecessor"),
        first((when > low) & (when < high)).alias("interval"), first(near).alias("concurrent"),
        first(F.col("state_value") == F.col("x_value")).alias("cause_of"), first(when < F.col("x_at")).alias("transitive_cause"),
        first((F.col("was") == F.col("x_value")) & (F.col("state_value") != F.col("x_value")) & (when > F.col("x_at"))).alias("retirement"),
    )
    earlier = F.when(F.col("x_at").isNotNull() & F.col("y_at").isNotNull(), F.when(F.col("x_at") <= F.col("y_at"), F.col("x")).otherwise(F.col("y")))
    known = ["current", "origin", "sequence", "predecessor", "interval", "concurrent", "cause_of", "transitive_cause", "retirement"]
    answer = F.when(i == "before_named", earlier)
    for k in known:
        answer = answer.when(i == k, F.col(k))
    level = F.when(~i.isin(*known, "before_named") | i.isNull(), "none").when(answer.isNull(), "abstain").otherwise("high")
    return found.select("question_id", "intent", answer.alias("answer"), level.alias("confidence"))
