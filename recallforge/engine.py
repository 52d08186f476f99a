"""One object for callers: search, recall, states, traversal over named tables.

Model-backed steps (entity extraction, reranking, classification, text generation)
are callables that the caller plugs in; without them the deterministic rules run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from recallforge.functions import temporal, text as T
from recallforge.operators import candidates, classify, exemplars, graph, maintenance, predicates, recall, retrieval, scans, scoring, state
from recallforge.shared import cut


class Extractor(Protocol):
    """Texts to lists of entity names, Arrow batch by Arrow batch."""

    def __call__(self, texts: pd.Series) -> pd.Series: ...


class Index(Protocol):
    """Full-text search: signals (key, bm25, overlap) of a question."""

    def signals(self, query: str) -> DataFrame: ...


class Graph(Protocol):
    """Edges (src, dst, weight) between entities."""

    def edges(self) -> DataFrame: ...


class Store(Protocol):
    """Tables by name: memories, links, states, ranges, nodes, episodes."""

    def table(self, name: str) -> DataFrame: ...


#: Text from a prompt; where none is plugged in, steps that write quote instead.
Writer = Callable[[str], str]
Weights = scoring.Weights
#: Intents that states answer, and what their rows are called.
STATE_PATHS = {"current_state_lookup": "state_lookup_bonus", "historical_lookup": "state_history_bonus", "change_detection": "change_detection_bonus"}


@dataclass
class Engine:
    """``memories``: memory_id, content, and optionally created_at, domains.
    ``links``: memory_id, entity_id.  ``states``: node_id, entity_id, state_key,
    state_value, created_at.  ``ranges``: memory_id, range_start, range_end.  ``nodes``:
    memory_id, node_type, and optionally is_current, conflicted, observed_at.  ``edges``:
    src, dst, weight between entities, or a function from nodes (node) to the edges at them.
    ``times``: memory_id, created_at, if ``memories`` lacks it.  ``accesses``: memory_id, accessed_at.
    ``entities``: entity_id, name.  ``relations``: source_id, target_id, edge_type between
    nodes (then with node_id).  ``members``: episode_id, member_id."""

    memories: DataFrame
    links: DataFrame | None = None
    states: DataFrame | None = None
    ranges: DataFrame | None = None
    nodes: DataFrame | None = None
    weights: Weights = field(default_factory=Weights)
    extractor: Extractor | None = None
    reranker: Callable[[Column], Column] | None = None
    writer: Writer | None = None
    index: Index | None = None
    edges: DataFrame | graph.Edges | None = None
    accesses: DataFrame | None = None
    entities: DataFrame | None = None
    relations: DataFrame | None = None
    members: DataFrame | None = None
    times: DataFrame | None = None

    def classified(self, query: str) -> str:
        """The intent of one question, by the examples."""
        return self._one(query).select(exemplars.exemplar_intent(F.col("q"))["intent"]).first()[0] or "fact_lookup"

    def _one(self, query: str) -> DataFrame:
        return self.memories.sparkSession.createDataFrame([(query,)], "q string")

    def keep_edges(self, path: str) -> DataFrame:
        """Writes the co-occurrence edges of the links under ``path``, for searches to
        come, instead of finding those near the candidates each time."""
        graph.cooccurrence(self.links).select("src", "dst", (F.col("count") / (F.col("count") + 1)).alias("weight")).write.mode("overwrite").parquet(path)
        self.edges = self.links.sparkSession.read.parquet(path)
        return self.edges

    def named(self, query: str, most: int = 4) -> list[tuple[str, int]]:
        """(name, entity_id) of the entities that a question names: runs of up to ``most``
        of its words."""
        if self.entities is None:
            return []
        words = query.lower().split()
        runs = {" ".join(words[i : i + n]).strip("?.,!:;\"'") for n in range(1, most + 1) for i in range(len(words) - n + 1)}
        names = self.memories.sparkSession.createDataFrame([(r,) for r in sorted(runs)], "name string")
        return [(r.name, r.entity_id) for r in scoring.resolved(F.broadcast(names), self.entities).orderBy("name").collect()]

    def range_of(self, query: str, now: datetime | None, subjects: int) -> tuple[candidates.Reference | None, bool]:
        """What time a question speaks of, and whether it is asked within it alone."""
        when = temporal.parse(query, now) if now else None
        whole = bool(when and when["start"] and when["end"])
        ordinal = F.lit(when["ordinal"] if when else None).cast("string")
        kind = classify.temporal_intent(F.col("q"), ordinal, F.lit(whole), F.lit(bool(when and when["recency"])), F.lit(subjects))
        only = self._one(query).select(classify.range_eligible(kind).alias("e")).first().e
        if when is None:
            return None, False
        how = "recency" if when["recency"] else when["ordinal"] if when["ordinal"] == "first" else "range"
        return candidates.Reference(when["start"], when["end"], how), bool(only and whole)

    def scored(self, query: str, *, domain: str | None = None, now: datetime | None = None, pool: int = 50, intent: str | None = None) -> DataFrame:
        """Candidates with every signal and ``score``: two lists fused, in range if the
        question asks within one, expanded through the graph, and combined by the
        weights of the question's intent."""
        docs = self.memories if domain is None else self.memories.where(predicates.domain_prefix(F.col("domains"), domain))
        intent = intent or self.classified(query)
        found = self.index.signals(query) if self.index is not None else retrieval.signals(docs, "memory_id", "content", query)
        if self.index is not None and domain is not None:
            found = scans.semi(found, docs, "memory_id")
        found = cut(found.withColumnRenamed("overlap", "sparse"))
        lists = [retrieval.ranked(retrieval.top(found, "memory_id", pool, s), "memory_id", s) for s in ("bm25", "sparse")]
        cands = retrieval.fuse(lists, "memory_id")
        names = self.named(query)
        reference, only = self.range_of(query, now, len(names))
        if only and self.ranges is not None:
            cands = cut(cands)
            ranges = self.ranges.join(F.broadcast(cands.select("memory_id")), "memory_id", "left_semi")
            cands = predicates.range_filter(cands, ranges, "memory_id", F.lit(reference.start), F.lit(reference.end))
        if self.links is not None:
            cands = cut(cands)
            cands = scoring.graph_expansion(cands, self.links, self.edges if self.edges is not None else self._edges_of(cands))
        cands = cut(cands.select("memory_id").join(found, "memory_id", "left"))
        context = self.memories.sparkSession.createDataFrame([(i,) for _, i in names], "node long") if names else None
        rows = candidates.with_signals(
            cands, docs, intent=intent, names=[n for n, _ in names], links=self.links, edges=self.edges, context=context, accesses=self.accesses, nodes=self.nodes,
            times=self.times, now=F.lit(now) if now else None, reference=reference,
        )
        return scoring.combined(rows, self.weights, temporal=reference is not None).withColumn("score", F.round("score", 9))

    def _edges_of(self, cands: DataFrame) -> DataFrame:
        """Co-occurrence edges at the candidates' entities, from the memories that hold one."""
        own = self.links.join(F.broadcast(cands.select("memory_id")), "memory_id", "left_semi").select("entity_id").distinct()
        near = self.links.join(own, "entity_id", "left_semi").select("memory_id").distinct()
        return graph.cooccurrence(self.links.join(near, "memory_id", "left_semi"))

    def search(self, query: str, *, limit: int = 10, domain: str | None = None, now: datetime | None = None, pool: int = 50, intent: str | None = None) -> DataFrame:
        """memory_id, score: the best of ``scored``, reranked where a model helps."""
        intent = intent or self.classified(query)
        found = self.scored(query, domain=domain, now=now, pool=pool, intent=intent).select("memory_id", "score")
        if self.reranker is not None and intent in scoring.RERANKED:
            text = self.memories.select("memory_id", "content")
            return retrieval.rerank(found.join(text, "memory_id"), "memory_id", self.reranker, most=pool, keep=limit).select("memory_id", "score")
        return retrieval.top(found, "memory_id", limit)

    def search_level(self, query: str, kinds: list[str], *, limit: int = 10, factor: int = 3) -> DataFrame:
        """The ``limit`` best of a wider search that have a node of one of the kinds."""
        wide = self.search(query, limit=limit * factor)
        mine = self.nodes.where(F.col("node_type").isin(kinds)).select("memory_id").distinct()
        return retrieval.top(scans.semi(wide, mine, "memory_id"), "memory_id", limit)

    def traverse(self, seeds: DataFrame, mode: str, *, summaries: DataFrame | None = None, members: DataFrame | None = None, most: int = 20) -> DataFrame:
        """From abstracts down, from memories up, across an episode, or along time.
        ``seeds``: node (or member_id and episode_id across; seed along time)."""
        if mode == "top_down":
            return recall.top_down(summaries, members, seeds)
        if mode == "bottom_up":
            return recall.bottom_up(summaries, members, seeds)
        if mode == "lateral":
            return recall.siblings(members, seeds, most)
        if mode == "temporal":
            return recall.timeline(self.links, self.states, seeds, most=most)
        raise ValueError(f"no traversal {mode!r}")

    def topic_map(self, *, least: float = 0.3, members: int = 3) -> DataFrame:
        """cluster, size, ids, shared: memories by the entities that they share."""
        sets = self.links.groupBy(F.col("memory_id").alias("id")).agg(F.collect_set("entity_id").alias("items"))
        return maintenance.overlap_clusters(sets, least=least, members=members)

    def synthesise(self, query: str, *, budget: int = 4000, limit: int = 10) -> str:
        """Excerpts of the best memories within a budget of characters, or what the
        plugged writer makes of them."""
        hits = self.search(query, limit=limit).join(self.memories.select("memory_id", "content"), "memory_id")
        text = recall.synthesis(hits, budget).first().content or ""
        return self.writer(f"{query}\n\n{text}") if self.writer is not None else text

    def arithmetic(self, query: str, anchors: list[str], entities: DataFrame, now: datetime) -> str | None:
        """The answer to a question for a duration: between two anchors, or from one to
        now; None if it is no such question or an anchor is not found.  Memories need
        created_at."""
        spark = self.memories.sparkSession
        spec = spark.createDataFrame([(query,)], "q string").select(classify.arithmetic(F.col("q")).alias("a")).first().a
        need = 2 if spec and spec.operation == "between" else 1
        if not spec or len(anchors) < need:
            return None
        scored = retrieval.bm25(self.memories, "memory_id", "content", query)
        at = []
        for name in anchors[:need]:
            found = scoring.anchor_candidates(name, self.memories, self.links, entities).join(self.memories.select("memory_id", F.col("created_at").alias("at")), "memory_id")
            at.append(scoring.anchor_date(found, scored).first())
        if any(a is None or a["at"] is None for a in at):
            return None
        end = at[1]["at"] if need == 2 else now
        one = spark.createDataFrame([(abs((end - at[0]["at"]).total_seconds()), spec.unit)], "s double, u string")
        return one.select(classify.duration_text(classify.duration(F.col("s"), F.col("u")), F.col("u"))).first()[0]

    def feedback(self, returned: DataFrame, agent: str, now: datetime) -> DataFrame:
        """The accesses to append for what a search returned and a caller used."""
        return scans.access_log(returned, agent, F.lit(now))

    def delete(self, ids: DataFrame) -> dict[str, DataFrame]:
        """Memories and what hangs on them without the deleted ones."""
        tables = {"memories": (self.memories, "memory_id")}
        for name in ("links", "ranges", "nodes"):
            if getattr(self, name) is not None:
                tables[name] = (getattr(self, name), "memory_id")
        return scans.delete_cascade(tables, ids, "memory_id")

    def intent(self, questions: DataFrame, column: str) -> DataFrame:
        return questions.withColumn("intent", classify.keyword_intent(F.col(column)))

    def recall(self, query: str, *, limit: int = 10, domain: str | None = None, now: datetime | None = None, intent: str | None = None) -> DataFrame:
        """place, memory_id, score, path, entities, siblings: search results, then what the
        question's intent adds as far as ``limit`` has room: memories behind states of the
        entities that it names, or behind what the best abstracts summarise; each with its
        entities and the other members of its episodes."""
        intent, spark = intent or self.classified(query), self.memories.sparkSession
        hits = cut(retrieval.ranked(self.search(query, limit=limit, domain=domain, now=now, intent=intent), "memory_id"))
        rows = hits.select(F.col("rank").alias("place"), "memory_id", "score", F.lit(intent).alias("path"))
        extra = None
        if intent in STATE_PATHS and self.states is not None and "memory_id" in self.states.columns:
            named = [(i, k) for k, i in enumerate(dict.fromkeys(i for _, i in self.named(query)))]
            if named:
                extra = recall.state_bonus(self.states, spark.createDataFrame(named, "entity_id long, nth int"), hits, current_only=intent == "current_state_lookup")
        elif intent == "event_reconstruction" and self.relations is not None and self.nodes is not None:
            best = hits.join(self.nodes.where("node_type = 'abstract'").select("memory_id", "node_id"), "memory_id")
            found = recall.episode_bonus(best, self.relations, self.nodes, hits)
            extra = found.withColumn("place", F.row_number().over(Window.orderBy("memory_id")))
        if extra is not None:
            extra = scans.semi(extra, self.memories, "memory_id")
            extra = extra.withColumn("place", F.row_number().over(Window.orderBy("place")) + hits.count()).where(F.col("place") <= limit)
            rows = rows.unionByName(extra.select("place", "memory_id", F.lit(0.0).alias("score"), F.lit(STATE_PATHS.get(intent, "episode_expansion_bonus")).alias("path")))
        rows = cut(rows)
        few = F.broadcast(rows.select("memory_id"))
        kind = dict(self.links.dtypes)["entity_id"] if self.links is not None else "bigint"
        lists = {"entities": (self.links, "memory_id", "entity_id", kind), "siblings": (None, None, None, "bigint")}
        if self.members is not None:
            mine = self.members.select("episode_id", F.col("member_id").alias("memory_id"))
            own = mine.join(few, "memory_id", "left_semi")
            others = own.join(mine.select("episode_id", F.col("memory_id").alias("other")), "episode_id").where("other <> memory_id")
            lists["siblings"] = (others, "memory_id", "other", dict(self.members.dtypes)["member_id"])
        for name, (table, key, value, kind) in lists.items():
            if table is None:
                rows = rows.withColumn(name, F.array().cast(f"array<{kind}>"))
                continue
            got = table.join(few, key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))
            rows = rows.join(got, key, "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))
        return rows.select("place", "memory_id", "score", "path", "entities", "siblings").orderBy("place")

    def current(self, entity_id, key: str | None = None) -> DataFrame:
        s = self.states.where(F.col("entity_id") == entity_id)
        return state.current(s if key is None else s.where(F.col("state_key") == key))

    def history(self, entity_id, key: str) -> DataFrame:
        return self.states.where((F.col("entity_id") == entity_id) & (F.col("state_key") == key)).orderBy("created_at", "node_id")

    def as_of(self, moment: datetime) -> DataFrame:
        return state.as_of(self.states, F.lit(moment))

    def related(self, ids: list, depth: int = 1) -> DataFrame:
        """memory_id: memories of entities within ``depth`` of the given ones."""
        edges = graph.cooccurrence(self.links)
        seeds = self.links.sparkSession.createDataFrame([(i,) for i in ids], "seed long")
        near = graph.hops(edges, seeds, depth).select(F.col("node").alias("entity_id")).union(seeds.select("seed")).distinct()
        return self.links.join(near, "entity_id", "left_semi").select("memory_id").distinct()

    def extract(self, column: str = "content") -> DataFrame:
        """memory_id, entity: names from the plugged extractor, else capitalised
        words; junk names dropped, each once."""
        if self.extractor is not None:
            names = _named(self.extractor)(F.col(column))
        else:
            names = F.regexp_extract_all(F.col(column), F.lit(r"\b(\p{Lu}[\p{L}\p{N}_-]+)"), F.lit(1))
        e = self.memories.select("memory_id", F.explode(F.array_distinct(names)).alias("entity"))
        return e.where(~predicates.junk_name(F.col("entity")))

    def store(self, rows: DataFrame, path: str) -> DataFrame:
        """Appends rows that are new by content hash; returns what was written."""
        new = scans.keep_first(rows.withColumn("content_hash", T.content_hash(F.col("content"))), ["content_hash"], ["memory_id"])
        known = self.memories.select(T.content_hash(F.col("content")).alias("content_hash"))
        new = new.join(known, "content_hash", "left_anti")
        new.write.mode("append").parquet(path)
        return new

    def surrogate(self, entries: DataFrame, question: str) -> DataFrame:
        words = F.array(*map(F.lit, sorted({w for w in retrieval._split(question) if len(w) > 1})))
        return recall.surrogate(entries, "agent", words, T.terms(F.col("content")), "memory_id")


def _named(extractor: Extractor):
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return extractor(texts)

    return run
