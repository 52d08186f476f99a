"""Intents of texts by BM25 over labelled example questions.

The examples are few and fixed, so their index is a matrix (term, example); a batch of
texts is scored against it in Arrow, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from recallforge.functions import stemming, text as T
from recallforge.operators.fulltext import DIGITS, K1, LONGEST, B

BEST = 5
NO_HIT = "fact_lookup"

# The example questions of each intent.
EXEMPLARS = {
    "current_state_lookup": (
        "What is the current status of the API?",
        "What's the database schema right now?",
        "Show me the latest deployment config",
        "What are the current settings?",
        "What version is running in production?",
        "What's the state of the auth service?",
        "Show me the most recent configuration",
        "What does the API currently return?",
        "Is the feature flag enabled right now?",
        "What are we using for caching at the moment?",
        "Current status of the deployment pipeline",
        "What is the active database connection pool size?",
    ),
    "historical_lookup": (
        "What was the database schema in January?",
        "How was the API configured last quarter?",
        "What were the settings before the migration?",
        "Show me the historical deployment frequency",
        "What did the auth flow look like previously?",
        "How was this endpoint configured back in March?",
        "What was running in production last week?",
        "What were the cache settings before the upgrade?",
        "Show me what the schema used to look like",
        "What was the API version at that time?",
        "Previously how was the rate limiting configured?",
        "Back when we had the old auth, what tokens did it use?",
    ),
    "event_reconstruction": (
        "What happened during the deployment outage?",
        "Walk me through the incident on Friday",
        "Reconstruct the sequence of events for the data loss",
        "What occurred during the migration window?",
        "Timeline of the authentication failure",
        "How did the rollback proceed?",
        "Recount what happened when the database went down",
        "Walk through the chain of events for the release",
        "What happened step by step during the outage?",
        "Describe the incident response timeline",
        "How did the service degradation unfold?",
        "What was the sequence of failures in the pipeline?",
    ),
    "change_detection": (
        "What changed in the API since last release?",
        "What has changed in the schema compared to v3?",
        "Show me the differences between old and new config",
        "How has the architecture evolved over time?",
        "What's different about the new deployment pipeline?",
        "Compare the before and after of the refactor",
        "What shifted in our authentication approach?",
        "Show me the progression of the database schema",
        "What transitioned in the API design?",
        "How have the endpoint contracts changed?",
        "What is different between the v1 and v2 API?",
        "Show the evolution of our error handling strategy",
    ),
    "pattern_lookup": (
        "Is there a pattern in the deployment failures?",
        "What do these errors have in common?",
        "Are there recurring issues with the auth service?",
        "What's the typical failure mode for this endpoint?",
        "Do we tend to see this kind of bug after releases?",
        "Is there a common theme across these incidents?",
        "What usually causes these timeout errors?",
        "Are there frequently occurring problems in staging?",
        "What patterns emerge from the incident reports?",
        "Do we typically see spikes after deployments?",
        "Is there a recurring theme in the performance issues?",
    ),
    "strategic_reflection": (
        "What lessons have we learned from past incidents?",
        "Any insights from the last quarter's deployments?",
        "What are the key takeaways from the migration project?",
        "What are the best practices for database migrations?",
        "What recommendations came out of the retrospective?",
        "What should we do differently next time?",
        "What can we learn from the auth service redesign?",
        "Key insights about our deployment process",
        "What would you recommend for improving reliability?",
        "Lessons from the API versioning experience",
        "What are the main takeaways from the outage review?",
        "Reflections on our scaling strategy",
    ),
}


class _Examples:
    """gains[term, example]: what a term adds to an example's score."""

    def __init__(self, examples: dict[str, tuple[str, ...]]):
        self.intents = list(examples)
        self.of = np.array([k for k, name in enumerate(self.intents) for _ in examples[name]])
        docs = [[stemming.stem(w) for w in re.findall(r"[^\W_]+", t.lower()) if len(w) < LONGEST] for name in self.intents for t in examples[name]]
        df = Counter(t for d in docs for t in set(d))
        self.terms = {t: k for k, t in enumerate(sorted(df))}
        mean = sum(map(len, docs)) / len(docs)
        self.gains = np.zeros((len(df) + 1, len(docs)))
        for e, d in enumerate(docs):
            for t, tf in Counter(d).items():
                idf = math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))
                self.gains[self.terms[t], e] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(d) / mean))

    def classify(self, words: pa.Array) -> pa.Array:
        """struct(intent, confidence) of word lists."""
        rows = len(words)
        lists = stemming.stem_lists(words)
        flat = lists.flatten().dictionary_encode()
        code = np.array([self.terms.get(t, len(self.terms)) for t in flat.dictionary.to_pylist()], np.int64)
        sizes = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()]) if lists.null_count else np.diff(lists.offsets.to_numpy())
        at, term = np.repeat(np.arange(rows), sizes), code[flat.indices.to_numpy()]
        known = term < len(self.terms)
        pairs, times = np.unique(at[known] * len(self.terms) + term[known], return_counts=True)
        scores = np.zeros((rows, len(self.of)))
        np.add.at(scores, pairs // len(self.terms), times[:, None] * self.gains[pairs % len(self.terms)])
        scores = scores.round(DIGITS)
        best = np.argsort(-scores, axis=1, kind="stable")[:, :BEST]
        top = np.take_along_axis(scores, best, 1)
        intent = self.of[best]
        total, first = np.zeros((rows, len(self.intents))), np.full((rows, len(self.intents)), BEST)
        for r in range(BEST - 1, -1, -1):
            hit = np.flatnonzero(top[:, r] > 0)
            total[hit, intent[hit, r]] += top[hit, r]
            first[hit, intent[hit, r]] = r
        total = total.round(DIGITS)
        order = np.lexsort((first, -total), axis=1)
        one, two = (np.take_along_axis(total, order[:, k : k + 1], 1)[:, 0] for k in (0, 1))
        names = [self.intents[k] if s > 0 else NO_HIT for k, s in zip(order[:, 0].tolist(), one.tolist(), strict=True)]
        sure = np.where(one > 0, one / np.where(one > 0, one + two, 1), 1.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(sure)], names=["intent", "confidence"])


@lru_cache(maxsize=8)
def _examples(key: tuple) -> _Examples:
    return _Examples(dict(key))


def exemplar_intent(text: Column, examples: dict[str, tuple[str, ...]] = EXEMPLARS) -> Column:
    """struct(intent, confidence): the intent whose examples hold most of the score of the
    five best, and its part of that of the best two.  Null and empty texts, and texts
    that share no term with an example, look up facts; ties go to the intent of the better
    example, and between examples to the earlier one."""
    key = tuple(examples.items())

    @F.arrow_udf("struct<intent:string,confidence:double>")
    def run(words: pa.Array) -> pa.Array:
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        return _examples(key).classify(words)

    return run(F.filter(T.tokens(F.coalesce(text, F.lit(""))), lambda t: F.octet_length(t) < LONGEST))
