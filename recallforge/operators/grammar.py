"""State-chain operators: zones, order, intervals, causes, induction of markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from recallforge.functions import text as T
from recallforge.operators.state import SUBJECT


def linear_zones(states: DataFrame) -> DataFrame:
    """Zones of each subject's chain: a new zone opens where the value changes."""
    w = Window.partitionBy(*SUBJECT).orderBy("created_at", "node_id")
    new = F.when(F.lag("state_value").over(w) != F.col("state_value"), 1).otherwise(0)
    z = states.withColumn("_n", new).withColumn("zone", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("created_at", "node_id")
    return z.groupBy(*SUBJECT, "zone").agg(F.count("*").alias("members"), F.min("created_at").alias("start"), F.min_by("node_id", at).alias("first_node"), F.max_by("node_id", at).alias("terminal"))


def _walk(nodes: list[int], forward: dict[int, list[tuple[str, int]]], incoming: set[int]) -> list[tuple]:
    """zone, members, start, terminal, ended_by of one subject's nodes, in order."""
    starts = [x for x in reversed(nodes) if x not in incoming]
    rows, seen = [], set()
    while starts:
        node = starts.pop()
        if node in seen:
            continue
        members, ended = [node], None
        seen.add(node)
        while True:
            steps = sorted(forward.get(members[-1], []))
            go = next((s for k, s in steps if k == "refines" and s not in seen), None)
            if go is not None:
                members.append(go)
                seen.add(go)
                continue
            end = next(((k, s) for k, s in steps if k in ("supersedes", "retires")), None)
            if end:
                ended = end[1]
                if end[0] == "supersedes":
                    starts.append(end[1])
            break
        rows.append((len(rows), members, members[0], members[-1], ended))
    return rows


def _walked(batches):
    """Rows sorted by subject, its nodes (in order) before its edges, to zones.  A
    subject may go on in the next batch; only its own rows are held."""
    import pyarrow as pa

    schema = pa.schema([("subject", pa.string()), ("zone", pa.int32()), ("members", pa.list_(pa.int64())), ("start", pa.int64()), ("terminal", pa.int64()), ("ended_by", pa.int64())])
    out: list[tuple] = []
    subject, nodes, forward, incoming = None, [], {}, set()

    def full() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        for name, node, target, kind in zip(*(batch.column(c).to_pylist() for c in ("subject", "node_id", "target_id", "edge_type")), strict=True):
            if name != subject or not (nodes or forward):
                out += [(subject, *z) for z in _walk(nodes, forward, incoming)]
                subject, nodes, forward, incoming = name, [], {}, set()
                if len(out) >= 10_000:
                    yield full()
                    out = []
            if kind is None:
                nodes.append(node)
            else:
                forward.setdefault(target, []).append((kind, node))
                incoming.add(node)
    out += [(subject, *z) for z in _walk(nodes, forward, incoming)]
    if out:
        yield full()


def graph_zones(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Zones over explicit edges per subject: start at nodes without an incoming
    edge, follow refines, end at supersedes (which opens the next) or retires.

    nodes: subject, node_id, at; edges: subject, source_id, target_id, edge_type
    (the later node is the source).  One subject's chain is walked in order; subjects
    stream through their tasks sorted, so a task calls Python once a batch, not once a
    subject."""
    none = F.lit(None)
    n = nodes.select("subject", F.lit(0).alias("_kind"), "at", F.col("node_id").cast("long").alias("node_id"), none.cast("long").alias("target_id"), none.cast("string").alias("edge_type"))
    e = edges.where("edge_type is not null").select("subject", F.lit(1).alias("_kind"), none.cast(nodes.schema["at"].dataType).alias("at"), F.col("source_id").cast("long").alias("node_id"), F.col("target_id").cast("long").alias("target_id"), "edge_type")
    rows = n.unionByName(e).repartition("subject").sortWithinPartitions("subject", "_kind", F.col("at").asc_nulls_last(), "node_id")
    return rows.select("subject", "node_id", "target_id", "edge_type").mapInArrow(_walked, "subject string, zone int, members array<long>, start long, terminal long, ended_by long")


def current_zone(zones: DataFrame) -> DataFrame:
    rest = [c for c in zones.columns if c not in SUBJECT]
    return zones.groupBy(*SUBJECT).agg(F.max_by(F.struct(*rest), "zone").alias("_z")).select(*SUBJECT, "_z.*")


def origin(zones: DataFrame) -> DataFrame:
    return zones.groupBy(*SUBJECT).agg(F.min_by("first_node", "zone").alias("origin"))


def neighbours(states: DataFrame) -> DataFrame:
    """The node after and before each, under its subject."""
    w = Window.partitionBy(*SUBJECT).orderBy("created_at", "node_id")
    return states.withColumns({"after_id": F.lead("node_id").over(w), "before_id": F.lag("node_id").over(w)})


def between(states: DataFrame, start, end) -> DataFrame:
    return states.where((F.col("created_at") > start) & (F.col("created_at") < end))


def earlier_of(states: DataFrame, x: str, y: str) -> DataFrame:
    """Which of two keys came first for each entity (ties: x)."""
    first = lambda k: F.min(F.when(F.col("state_key") == k, F.col("created_at")))
    t = states.where(F.col("state_key").isin(x, y)).groupBy("entity_id").agg(first(x).alias("_x"), first(y).alias("_y")).where("_x is not null and _y is not null")
    return t.select("entity_id", F.when(F.col("_x") <= F.col("_y"), x).otherwise(y).alias("earlier"))


def concurrent_counts(probes: DataFrame, states: DataFrame, subject: str, days: int) -> DataFrame:
    """How many other nodes of the subject lie within ``days`` of each probe (0: no
    row): a count over a sliding range of the subject's sorted nodes, no pairs."""
    micros = days * 86_400_000_000
    w = Window.partitionBy(subject).orderBy("_t").rangeBetween(-micros, micros)
    n = states.select("node_id", subject, F.unix_micros(F.col("created_at").cast("timestamp")).alias("_t")).withColumn("n", F.count("*").over(w) - 1)
    return n.join(probes.select("node_id"), "node_id", "left_semi").where("n > 0").select("node_id", "n")


def causes(edges: DataFrame, seeds: DataFrame, hops: int = 6) -> DataFrame:
    """The chain of most confident causes from each seed: node_id, hop, cause.
    ``edges``: effect, cause, confidence.  At most ``hops`` joins, no node twice."""
    best = edges.groupBy("effect").agg(F.max_by("cause", F.struct("confidence", F.negate("cause"))).alias("cause"))
    front = seeds.select(F.col("node_id"), F.col("node_id").alias("_at"), F.array("node_id").alias("_seen"))
    out = None
    for hop in range(1, hops + 1):
        front = front.join(best, F.col("_at") == F.col("effect")).where(~F.array_contains("_seen", F.col("cause")))
        step = front.select("node_id", F.lit(hop).alias("hop"), "cause")
        out = step if out is None else out.unionByName(step)
        front = front.select("node_id", F.col("cause").alias("_at"), F.array_append("_seen", F.col("cause")).alias("_seen"))
    return out


def retirement(entity_terms: DataFrame, edges: DataFrame) -> DataFrame:
    """The first edge that retires each entity: equal stems, or one a prefix of the
    other of four characters or more.  The four-character prefix is the join key."""
    head = lambda c: F.substring(F.lower(c), 1, 4)
    e = edges.select("edge_id", "at", F.explode("retires").alias("_r")).withColumn("_h", head("_r"))
    q = entity_terms.select("entity").withColumn("_h", head("entity"))
    a, b = F.lower("entity"), F.lower("_r")
    fits = (a == b) | ((F.length(a) >= 4) & (F.length(b) >= 4) & (a.startswith(b) | b.startswith(a)))
    return q.join(e, "_h").where(fits).groupBy("entity").agg(F.min_by("edge_id", F.struct("at", "edge_id")).alias("edge_id"))


def aliases(names: DataFrame, name: str) -> DataFrame:
    """short, full: names that are the initials of longer ones (plural s allowed),
    as an equi-join on the initials."""
    full = names.select(F.col(name).alias("full"), T.initials(F.col(name)).alias("_k")).where(F.length("_k") >= 2)
    short = names.select(F.col(name).alias("short"), F.explode(F.array_distinct(F.array(F.lower(name), F.regexp_replace(F.lower(name), "s$", "")))).alias("_k")).where(~F.col("short").rlike(r"[\s_-]"))
    return short.join(full, "_k").where("short <> full").select("short", "full").distinct()


def edge_markers(observed: DataFrame) -> DataFrame:
    """transition, head: verb heads strictly more frequent under one transition
    than under any other.  observed: transition, content."""
    n = observed.select("transition", F.explode(T.verb_heads(F.col("content"))).alias("head")).groupBy("transition", "head").agg(F.count("*").alias("n"))
    w = Window.partitionBy("head").orderBy(F.desc("n"))
    top = n.withColumns({"_r": F.rank().over(w), "_same": F.count("*").over(Window.partitionBy("head", "n"))})
    return top.where("_r = 1 and _same = 1").select("transition", "head", "n")


def content_markers(memories: DataFrame, support: int = 2, purity: float = 2.0) -> DataFrame:
    """head, side: verb heads that ``support`` or more terminal (or root) memories have,
    ``purity`` times as many as all others.  memories: content, is_terminal, is_root."""
    h = memories.select("is_terminal", "is_root", F.explode(T.verb_heads(F.col("content"))).alias("head"))
    middle = ~F.col("is_terminal") & ~F.col("is_root")
    c = h.groupBy("head").agg(F.count_if("is_terminal").alias("t"), F.count_if("is_root").alias("r"), F.count_if(middle).alias("m"))
    enough = lambda x, y: (F.col(x) >= support) & (F.col(x) >= purity * (F.col("m") + F.col(y)))
    sides = F.array_compact(F.array(F.when(enough("t", "r"), "current"), F.when(enough("r", "t"), "origin")))
    return c.select("head", F.explode(sides).alias("side"), "t", "r")
