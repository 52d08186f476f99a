"""Streaming forms of the engine's stateful operators.

State is keyed, bounded by watermarks or timers, and recovered from the query's
checkpoint, so a lost executor replays at most one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recallforge.operators.fulltext import FullText


def dedup(stream: DataFrame, text: str, ts: str, late: str = "1 hour") -> DataFrame:
    """The first row of each content within the watermark."""
    return stream.withColumn("content_hash", F.sha2(text, 256)).withWatermark(ts, late).dropDuplicatesWithinWatermark(["content_hash"])


def episodes(stream: DataFrame, by: list[str], ts: str, minutes: int = 1440, late: str = "1 hour") -> DataFrame:
    """Closed episodes: sessions of a key that ``minutes`` of silence end."""
    w = stream.withWatermark(ts, late).groupBy(*by, F.session_window(ts, f"{minutes} minutes").alias("w")).agg(F.count("*").alias("members"))
    return w.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "members")


def heartbeats(stream: DataFrame, agent: str, ts: str, seconds: int = 90, late: str = "30 seconds") -> DataFrame:
    """agent, offline_at: when an agent has been silent for ``seconds``."""
    beats = stream.withWatermark(ts, late).groupBy(agent, F.session_window(ts, f"{seconds} seconds").alias("w")).count()
    return beats.select(agent, F.col("w.end").alias("offline_at"))


def counters(stream: DataFrame, ts: str, kind: str, window: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Counts and a sum of values per kind and time window."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def asks(questions: DataFrame, answers: DataFrame, ttl: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """ask_id, question, answer: each question with the answers within its time to
    live; unanswered ones come out with a null once it is over.
    questions: ask_id, asked_at, question; answers: reply_to, replied_at, answer."""
    q, a = questions.withWatermark("asked_at", late), answers.withWatermark("replied_at", late)
    on = (F.col("ask_id") == F.col("reply_to")) & F.col("replied_at").between(F.col("asked_at"), F.col("asked_at") + F.expr(f"interval {ttl}"))
    return q.join(a, on, "left_outer").select("ask_id", "question", "asked_at", "answer", "replied_at")


def announce(stream: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Announcements (sender, announced) to subscribers (subscriber, wanted), never
    to the sender: a join with the static table on the first domain segment."""
    from recallforge.operators.predicates import subscribed

    seg = lambda c: F.explode(F.array_distinct(F.transform(c, lambda w: F.substring_index(w, ":", 1))))
    keyed = subscriptions.where(F.size("wanted") > 0).withColumn("_k", seg("wanted"))
    fits = subscribed(F.col("announced"), F.col("wanted")) & (F.col("sender") != F.col("subscriber"))
    some = stream.withColumn("_k", seg("announced")).join(keyed, "_k").where(fits).drop("_k")
    everyone = subscriptions.where(F.size("wanted") == 0).withColumn("_a", F.lit(1))
    rest = stream.withColumn("_a", F.lit(1)).join(everyone, "_a").where(F.col("sender") != F.col("subscriber")).drop("_a")
    return some.unionByName(rest)


_STATE = "value long, node_id long, created_at timestamp"
_OUT = "entity_id long, state_key string, node_id long, prev_id long, relation string"


def reconcile(stream: DataFrame) -> DataFrame:
    """Each new state against the current one of its (entity, key), kept as keyed
    state: entity_id, state_key, node_id, prev_id, relation."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, prev, at = state.get if state.exists else (None, None, None)
        out: list[tuple[Any, ...]] = []
        rows = pd.concat(list(batches)).sort_values(["created_at", "node_id"])
        for r in rows.itertuples():
            rel = "unrelated" if prev is None else "supports" if int(r.state_value) == value else "supersedes"
            out.append((key[0], key[1], int(r.node_id), prev, rel))
            value, prev, at = int(r.state_value), int(r.node_id), r.created_at
        state.update((value, prev, at))
        yield pd.DataFrame(out, columns=["entity_id", "state_key", "node_id", "prev_id", "relation"]).astype({"prev_id": "Int64"})

    s = stream.select("entity_id", "state_key", "node_id", "state_value", F.col("created_at").cast("timestamp").alias("created_at"))
    return s.groupBy("entity_id", "state_key").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def ttl_cache(stream: DataFrame, key: str, ts: str, seconds: str, late: str = "0 seconds") -> DataFrame:
    """Entries with the moment they expire, the newest of a key in each window."""
    return stream.withWatermark(ts, late).withColumn("expires_at", F.col(ts) + F.make_dt_interval(secs=F.col(seconds))).dropDuplicatesWithinWatermark([key])


def index_sink(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], *, once: bool = False) -> StreamingQuery:
    """Batches of a stream handed to ``work`` (index, link, write), exactly once per
    batch number; back-pressure comes from the source's trigger limits."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(work)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")).start()


def fulltext_sink(stream: DataFrame, index: FullText, checkpoint: str, name: str, *, deleted: str = "deleted", order: str | None = None, once: bool = False) -> StreamingQuery:
    """A stream of changes (the index's key and columns, ``deleted``) to a full-text index,
    a commit each micro-batch.  The index notes the batches of ``name``, so one that is
    delivered again changes nothing."""

    def work(batch: DataFrame, number: int) -> None:
        index.apply(batch, deleted=deleted, order=order, stream=name, batch=number)

    return index_sink(stream, checkpoint, work, once=once)
