"""A stream of texts to everything that is kept of them: full-text index, entities,
links, co-occurrence counts, nodes, states, edges and episodes.

Each micro-batch writes its rows of every table under names of its own and then one
commit of a ``Ledger`` that names them, so a batch counts once, whole, or not at all;
one that is delivered again after its commit changes nothing.  Texts that the extractor
fails on are tried again with the following batches, and after ``attempts`` tries they
are in the table ``dead`` with their last error.  ``drain`` works off what waits for a
further try.  Tables only grow, but for ``waiting`` and ``open_episodes``, of which each
commit writes the whole; ``read`` gives the rows that are committed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from recallforge.operators import graph, predicates, recall, subjects
from recallforge.operators.fulltext import FullText
from recallforge.operators.ledger import Ledger
from recallforge.streaming.streams import index_sink

Extract = Callable[[pd.Series], pd.Series]

TASK = "memory_id long, content string, domain string, at timestamp, entities array<string>"
GROWING = ("memories", "entities", "links", "counts", "nodes", "states", "edges", "members", "dead")
REPLACED = ("waiting", "open_episodes")


def _extracted(extract: Extract):
    """struct(names, error) of texts.  Where a batch fails each text is tried alone, so
    one bad text costs the others nothing."""

    @F.pandas_udf("names array<string>, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        def one(text: str) -> tuple[list[str] | None, str | None]:
            try:
                return list(extract(pd.Series([text])).iloc[0]), None
            except Exception as e:  # whatever a plugged extractor raises
                return None, f"{type(e).__name__}: {e}"[:500]

        try:
            rows = [(list(n), None) for n in extract(texts)]
        except Exception:
            rows = [one(t) for t in texts]
        return pd.DataFrame(rows, columns=["names", "error"])

    return run


class Ingest:
    """The tables under ``path``, fed by tasks (``TASK``).  ``index`` is a full-text index
    by memory_id."""

    def __init__(self, spark: SparkSession, path: str, extract: Extract, index: FullText | None = None, *, attempts: int = 3, minutes: int = 1440):
        self.spark, self.path, self.extract, self.index = spark, path.rstrip("/"), extract, index
        self.attempts, self.minutes = attempts, minutes
        self.ledger = Ledger(spark, path)

    def _state(self) -> dict:
        return self.ledger.latest() or {"version": 0, "tables": {}, "batches": {}}

    def read(self, name: str) -> DataFrame | None:
        """The committed rows of a table; None before there are any."""
        paths = self._state()["tables"].get(name)
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in paths]) if paths else None

    def sink(self, stream: DataFrame, checkpoint: str, name: str, *, once: bool = False) -> StreamingQuery:
        return index_sink(stream, checkpoint, lambda batch, number: self.apply(batch, name, number), once=once)

    def drain(self) -> int:
        """Tries again what waits until nothing does; the number of rounds."""
        rounds, none = 0, self.spark.createDataFrame([], TASK)
        while True:
            waiting = self.read("waiting")
            if waiting is None or waiting.isEmpty():
                return rounds
            self.apply(none)
            rounds += 1

    def apply(self, batch: DataFrame, stream: str | None = None, number: int | None = None) -> None:
        """One commit: ``batch`` and what waits from earlier ones."""
        state = self._state()
        if stream is not None and state["batches"].get(stream, -1) >= number:
            return
        seq, tables = state["version"] + 1, dict(state["tables"])
        name = f"{seq:012d}-{uuid.uuid4().hex}"

        def write(table: str, rows: DataFrame) -> DataFrame:
            at = f"{table}/{name}"
            rows.write.parquet(f"{self.path}/{at}")
            tables[table] = [at] if table in REPLACED else [*tables.get(table, []), at]
            return self.spark.read.parquet(f"{self.path}/{at}")

        new = batch.where("memory_id is not null").select(*[c.split()[0] for c in TASK.split(", ")]).dropDuplicates(["memory_id"])
        if "memories" in tables:  # a memory is taken once
            new = new.join(self.read("memories").select("memory_id"), "memory_id", "left_anti")
        new = write("memories", new.withColumn("content", F.coalesce("content", F.lit(""))))
        if self.index is not None:
            # the same rows if this batch comes again, so the index needs it once
            self.index.apply(new.withColumn("_gone", F.lit(False)), deleted="_gone", stream="ingest", batch=seq)
        todo = new.withColumn("attempt", F.lit(1))
        waiting = self.read("waiting")
        if waiting is not None:
            todo = todo.unionByName(waiting.drop("error"))
        tried = write("tried", todo.withColumn("x", _extracted(self.extract)(F.col("content"))))
        tables.pop("tried")
        failed = tried.where("x.error is not null").withColumn("error", F.col("x.error")).drop("x")
        write("waiting", failed.where(F.col("attempt") < self.attempts).withColumn("attempt", F.col("attempt") + 1))
        write("dead", failed.where(F.col("attempt") >= self.attempts))

        done = tried.where("x.error is null")
        manual = done.select("memory_id", F.explode("entities").alias("name")).where("name is not null")
        found = done.select("memory_id", F.explode("x.names").alias("name")).where(~predicates.junk_name(F.col("name")))
        named = subjects.merged_entities(manual, found).withColumn("entity_id", entity_id(F.col("name")))
        write("entities", named.groupBy("entity_id").agg(F.min("name").alias("name")))
        links = write("links", named.select("memory_id", "entity_id").distinct())
        write("counts", graph.cooccurrence(links))

        names = named.groupBy("memory_id").agg(F.collect_set("name").alias("names"))
        rows = done.drop("entities", "x").join(names, "memory_id", "left").withColumn("entities", F.coalesce("names", F.array().cast("array<string>")))
        write("nodes", subjects.atomic_nodes(rows))
        states = write("states", subjects.detected_nodes(rows.withColumn("signal", F.lit(0.0))))
        write("edges", subjects.derived_edges(states))

        fragments = rows.select(F.col("memory_id").alias("fragment_id"), "domain", "at", F.transform("entities", lambda e: entity_id(e).cast("string")).alias("entities"))
        opened = self.read("open_episodes")
        if opened is not None:  # those that no later text can reach are left out
            newest = fragments.agg(F.max("at").alias("_newest"))
            opened = opened.join(F.broadcast(newest)).where(F.col("_newest").isNull() | (F.col("at") >= F.col("_newest") - F.expr(f"interval {2 * self.minutes} minutes"))).drop("_newest")
        step = write("steps", recall.episode_step(fragments, opened, "domain", minutes=self.minutes))
        tables.pop("steps")
        write("members", step.where("kind = 'member'").select("fragment_id", "episode_id"))
        write("open_episodes", step.where("kind = 'open'").select("episode_id", "domain", "entities", "at"))
        batches = state["batches"] | ({stream: number} if stream is not None else {})
        self.ledger.commit({"version": seq, "tables": tables, "batches": batches})

    def vacuum(self) -> None:
        """Deletes what no commit names.  No batch may be under way."""
        kept = {p for paths in self._state()["tables"].values() for p in paths}
        self.ledger.sweep([*GROWING, *REPLACED, "tried", "steps"], kept)


def entity_id(name: Column) -> Column:
    """One id for the forms of a name that differ in case alone."""
    return F.xxhash64(F.lower(name))
