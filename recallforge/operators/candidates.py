"""The signals of a search's candidates, out of the tables that hold them.

Candidates are few (the lists' lengths and the expansion bound them), so each table is
met in a semi-join with them, and only their rows are aggregated."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from recallforge.functions import scores as S
from recallforge.operators import graph, scoring


@dataclass(frozen=True)
class Reference:
    """The time that a question speaks of: a range, or the first or the newest."""

    start: datetime | None
    end: datetime | None
    kind: str = "range"


def _of(table: DataFrame, cands: DataFrame) -> DataFrame:
    return table.join(F.broadcast(cands.select("memory_id")), "memory_id", "left_semi")


def graph_signal(cands: DataFrame, links: DataFrame, edges: DataFrame | graph.Edges, context: DataFrame) -> DataFrame:
    """memory_id, graph: what spreads from the question's entities (node) over weighted
    edges (src, dst, weight) to the candidates' entities."""
    own = _of(links.select("memory_id", "entity_id"), cands).distinct()
    return scoring.spread_score(own, graph.spread(edges, context), context)


def activation_signal(cands: DataFrame, accesses: DataFrame, now: Column, decay: float = 0.5) -> DataFrame:
    """memory_id, activation: base-level activation of the accesses (memory_id,
    accessed_at)."""
    ages = _of(accesses, cands).withColumn("_a", S.seconds_between(now, F.col("accessed_at")))
    return ages.groupBy("memory_id").agg(S.base_level(F.col("_a"), decay).alias("activation"))


def node_signals(cands: DataFrame, nodes: DataFrame) -> DataFrame:
    """memory_id, node_types, superseded, conflicted and observed_at of the candidates'
    nodes (memory_id, node_type, and where the table has them is_current, conflicted,
    observed_at)."""
    has = lambda c, other: F.col(c) if c in nodes.columns else other
    return _of(nodes, cands).groupBy("memory_id").agg(
        F.array_sort(F.collect_set("node_type")).alias("node_types"),
        F.max(~F.coalesce(has("is_current", F.lit(True)), F.lit(True))).alias("superseded"),
        F.max(F.coalesce(has("conflicted", F.lit(False)), F.lit(False))).alias("conflicted"),
        F.min(has("observed_at", F.lit(None).cast("timestamp"))).alias("_seen"),
    )


def with_signals(
    cands: DataFrame,
    memories: DataFrame,
    *,
    intent: str,
    names: list[str] = (),
    links: DataFrame | None = None,
    edges: DataFrame | graph.Edges | None = None,
    context: DataFrame | None = None,
    accesses: DataFrame | None = None,
    nodes: DataFrame | None = None,
    times: DataFrame | None = None,
    now: Column | None = None,
    reference: Reference | None = None,
) -> DataFrame:
    """Candidates (memory_id, bm25, sparse) that are ``memories``, with the columns that
    ``scoring.combined`` reads; a signal without its table is what an empty table gives.
    ``memories`` may have created_at (else ``times`` has it), observed_at, label, change and
    roles."""
    own = [c for c in ("created_at", "observed_at", "label", "change", "roles") if c in memories.columns]
    rows = cands.join(_of(memories.select("memory_id", *own), cands), "memory_id")
    if times is not None and "created_at" not in own:
        rows = rows.join(_of(times.select("memory_id", "created_at"), cands), "memory_id", "left")
    if links is not None and edges is not None and context is not None:
        rows = rows.join(graph_signal(cands, links, edges, context), "memory_id", "left")
    if accesses is not None and now is not None:
        rows = rows.join(activation_signal(cands, accesses, now), "memory_id", "left")
    if nodes is not None:
        rows = rows.join(node_signals(cands, nodes), "memory_id", "left")
    col = lambda c, kind: F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
    at = scoring.event_time(col("_seen", "timestamp"), col("observed_at", "timestamp"), col("created_at", "timestamp"))
    near, age = F.lit(0.0), F.lit(0.0)
    if now is not None:
        age = F.when(col("created_at", "timestamp").isNotNull(), S.recency(S.seconds_between(now, col("created_at", "timestamp")))).otherwise(0.0)
        if reference is not None:
            ends = [F.lit(x).cast("timestamp") for x in (reference.start, reference.end)]
            near = F.when(at.isNotNull(), S.temporal_proximity(at, *ends, now, F.lit(reference.kind))).otherwise(0.0)
    return rows.select(
        "memory_id",
        "bm25",
        "sparse",
        F.coalesce(col("graph", "double"), F.lit(0.0)).alias("graph"),
        near.alias("temporal"),
        F.coalesce(col("activation", "double"), F.lit(S.LOWEST_ACTIVATION)).alias("activation"),
        age.alias("recency"),
        F.coalesce(col("superseded", "boolean"), F.lit(False)).alias("superseded"),
        F.coalesce(col("conflicted", "boolean"), F.lit(False)).alias("conflicted"),
        F.lit(intent).alias("intent"),
        F.coalesce(col("node_types", "array<string>"), F.array().cast("array<string>")).alias("node_types"),
        col("label", "string").alias("label"),
        col("change", "string").alias("change"),
        col("roles", "array<struct<role:string,canonical:string>>").alias("roles"),
        F.array(*map(F.lit, names)).cast("array<string>").alias("names"),
    )
