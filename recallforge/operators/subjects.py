"""Subjects of memories, and the nodes and edges that a memory brings about.

A subject is struct<id, type, primary, source, confidence, aliases>; its id is
``type:slug``.  A label is what a classifier says of a memory: its role spans, its
change of state, and how sure it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recallforge.functions import text as T
from recallforge.operators import classify
from recallforge.shared import dealt

#: The least confidence of a classifier that counts.
FLOOR = 0.3
SUBJECT = "struct<id:string,type:string,primary:boolean,source:string,confidence:double,aliases:array<string>>"


def canonical_id(kind: Column, surface: Column) -> Column:
    """``type:slug``; an id of that form stays."""
    return F.when(surface.startswith(F.concat(kind, F.lit(":"))), surface).otherwise(F.concat(kind, F.lit(":"), T.slug(surface)))


def _subject(i: Column, kind: Column, primary: Column, source: str, sure: Column, aliases: Column) -> Column:
    return F.struct(i.alias("id"), kind.alias("type"), primary.alias("primary"), F.lit(source).alias("source"), sure.cast("double").alias("confidence"), aliases.alias("aliases")).cast(SUBJECT)


def resolve(memories: DataFrame) -> DataFrame:
    """``memories`` with ``subjects`` and ``conflict``.  Columns: explicit
    (array<struct<id, type, primary>>), legacy (a name), roles (array<struct<role,
    surface, slot>>), label_confidence, parent (a subject or null).

    The first that is there counts: the caller's list, the caller's name, the primary
    role spans of a sure classifier, the parent document's primary subject (its
    confidence 0.9 at most).  The first subject is primary where none is.  A list with
    two primary subjects, or one whose primary subject is not that of the name, is a
    conflict: no subjects."""
    listed = F.col("explicit")
    has = F.size(listed) > 0
    named = F.filter(listed, lambda s: F.coalesce(s["primary"], F.lit(False)))
    ids = lambda s: canonical_id(s["type"], s["id"])
    other = F.get(named, F.lit(0))
    conflict = has & ((F.size(named) > 1) | ((F.size(named) == 1) & F.col("legacy").isNotNull() & (F.col("legacy") != "") & (F.concat(other["type"], F.lit(":"), T.slug(F.col("legacy"))) != ids(other))))
    own = lambda s: F.when(ids(s) == s["id"], F.array().cast("array<string>")).otherwise(F.array(s["id"]))
    mine = F.transform(listed, lambda s, k: _subject(ids(s), s["type"], F.coalesce(s["primary"], F.lit(False)) | ((F.size(named) == 0) & (k == 0)), "caller", F.lit(1.0), own(s)))
    word = F.array(_subject(canonical_id(F.lit("subject"), F.col("legacy")), F.lit("subject"), F.lit(True), "caller", F.lit(0.6), F.array("legacy")))
    sure = F.coalesce(F.col("label_confidence"), F.lit(0.0))
    first = F.filter("roles", lambda r: (r["role"] == "primary") & (F.coalesce(r["surface"], F.lit("")) != ""))
    kind = lambda r: F.coalesce(r["slot"], F.lit("subject"))
    spans = F.transform(first, lambda r, k: _subject(canonical_id(kind(r), r["surface"]), kind(r), k == 0, "slm_role", F.least(F.lit(0.6), sure), F.array(r["surface"])))
    above = F.col("parent")
    inherited = F.array(_subject(above["id"], above["type"], F.lit(True), "document", F.least(above["confidence"], F.lit(0.9)), above["aliases"]))
    none = F.array().cast(f"array<{SUBJECT}>")
    found = (
        F.when(conflict, none).when(has, mine).when(F.col("legacy").isNotNull() & (F.col("legacy") != ""), word)
        .when((sure >= FLOOR) & (F.size(first) > 0), spans).when(above.isNotNull(), inherited).otherwise(none)
    )
    return memories.withColumns({"subjects": F.coalesce(found, none), "conflict": F.coalesce(conflict, F.lit(False))})


def atomic_nodes(memories: DataFrame) -> DataFrame:
    """node_id, memory_id, node_type: one node for each memory as it is."""
    return memories.select(F.concat(F.lit("l1:"), F.col("memory_id").cast("string")).alias("node_id"), "memory_id", F.lit("atomic").alias("node_type"))


def _span_of(s: Column, roles: Column) -> Column:
    """The role span that tells of a subject: by its canonical name, its surface, then
    its slot."""
    slug = F.lower(F.when(F.contains(s["id"], F.lit(":")), F.regexp_extract(s["id"], r"^[^:]*:(.*)$", 1)).otherwise(s["id"]))
    names = F.concat(F.array(slug), F.transform(s["aliases"], F.lower))
    by = lambda part: F.get(F.filter(roles, lambda r: F.array_contains(names, F.lower(r[part]))), F.lit(0))
    return F.coalesce(by("canonical"), by("surface"), F.get(F.filter(roles, lambda r: r["slot"] == s["type"]), F.lit(0)))


def state_nodes(memories: DataFrame) -> DataFrame:
    """node_id, memory_id, node_type, entity_id, state_key, state_value, subject_role,
    source: a state for each subject of which a declared or retired state is told.
    Columns: memory_id, content, subjects, roles (role, canonical, surface, slot),
    change, change_confidence.  A subject without a role span of its own counts where it
    is the caller's only one; then the text's beginning is its status."""
    live = memories.where(F.col("change").isin("declaration", "retirement") & (F.coalesce("change_confidence", F.lit(0.0)) >= FLOOR))
    rows = live.select("memory_id", "content", "roles", F.size("subjects").alias("_n"), F.posexplode("subjects").alias("_k", "s")).withColumn("r", _span_of(F.col("s"), F.col("roles")))
    rows = rows.where(F.col("r").isNotNull() | ((F.col("s.source") == "caller") & (F.col("_n") == 1)))
    snippet = F.coalesce(F.nullif(F.substring(F.trim("content"), 1, 200), F.lit("")), F.lit("(empty)"))
    told = F.col("r").isNotNull()
    return rows.select(
        F.concat_ws(":", F.lit("l2"), F.col("memory_id").cast("string"), F.col("_k").cast("string")).alias("node_id"), "memory_id", F.lit("entity_state").alias("node_type"), F.col("s.id").alias("entity_id"),
        F.when(told, F.coalesce("r.slot", F.lit("status"))).otherwise("status").alias("state_key"), F.when(told, F.coalesce("r.canonical", "r.surface", F.lit(""))).otherwise(snippet).alias("state_value"),
        F.when(F.col("s.primary"), "primary_subject").otherwise("co_subject").alias("subject_role"),
        F.when(told, F.concat(F.lit("subject_"), F.col("s.source"), F.lit("_role_span"))).otherwise("caller_subject_slm_state_change").alias("source"),
    )


def detected_nodes(memories: DataFrame) -> DataFrame:
    """node_id, memory_id, entity_id, state_key, state_value: the state of memories
    without a subject, where their text changes one (content, entities, signal).  The
    entity must be one of the memory's."""
    rows = memories.where(classify.changes_state(F.col("content"), F.col("signal"))).withColumn("m", classify.state_meta(F.col("content"), F.col("entities")))
    known = F.array_contains(F.transform("entities", F.lower), F.lower("m.entity"))
    return rows.where(known).select(F.concat(F.lit("l2:"), F.col("memory_id").cast("string")).alias("node_id"), "memory_id", F.col("m.entity").alias("entity_id"), F.col("m.key").alias("state_key"), F.col("m.value").alias("state_value"))


def derived_edges(nodes: DataFrame) -> DataFrame:
    """source_id, target_id, edge_type: each state to its memory's own node."""
    return nodes.select(F.col("node_id").alias("source_id"), F.concat(F.lit("l1:"), F.col("memory_id").cast("string")).alias("target_id"), F.lit("derived_from").alias("edge_type"))


def mention_edges(memories: DataFrame, entities: DataFrame) -> DataFrame:
    """source_id, target_id, edge_type, role: each memory's node to the entity of each of
    its subjects, by id, else by alias; subjects without an entity have none."""
    s = memories.select("memory_id", F.explode("subjects").alias("s"))
    forms = F.concat(F.array("s.id"), "s.aliases")
    rows = s.select("memory_id", "s", F.posexplode(forms).alias("_p", "_f")).withColumn("_k", F.lower("_f"))
    by_name = entities.groupBy(F.lower("name").alias("_k")).agg(F.min("entity_id").alias("entity_id"))
    hit = rows.join(by_name, "_k").groupBy("memory_id", F.col("s.id").alias("subject")).agg(F.min_by("entity_id", "_p").alias("target_id"), F.max("s.primary").alias("_first"))
    return hit.select(F.concat(F.lit("l1:"), F.col("memory_id").cast("string")).alias("source_id"), "target_id", F.lit("mentions_entity").alias("edge_type"), F.when(F.col("_first"), "primary_subject").otherwise("co_subject").alias("role"))


def tagged_domains(domains: Column, topic: Column, confidence: Column, floor: float = FLOOR) -> Column:
    """Domains with a topic that the classifier is sure of."""
    sure = topic.isNotNull() & (F.coalesce(confidence, F.lit(1.0)) >= floor)
    return F.when(sure, F.array_union(F.coalesce(domains, F.array().cast("array<string>")), F.array(topic))).otherwise(domains)


def merged_entities(manual: DataFrame, found: DataFrame) -> DataFrame:
    """memory_id, name: the caller's entities, and those found whose name, whatever its
    case, is not among them; each once."""
    rows = manual.select("memory_id", "name", F.lit(0).alias("_p")).unionByName(found.select("memory_id", "name", F.lit(1).alias("_p")))
    best = F.min(F.struct("_p", "name"))
    first = rows.groupBy("memory_id", F.lower("name").alias("_k")).agg(best.alias("b"))
    own = rows.where("_p = 0").select("memory_id", "name")
    return own.unionByName(first.where("b._p = 1").select("memory_id", F.col("b.name").alias("name"))).distinct()


def merged_labels(universal: list[str], by_domain: dict[str, list[str]], domains: list[str], keep: bool = False) -> list[str]:
    """Labels for an extractor: those of the domains, whatever their case each once,
    instead of the universal ones or, with ``keep``, after them."""
    own = [x for d in domains for x in by_domain.get(d, ())]
    every = universal if not own else [*universal, *own] if keep else own
    out: dict[str, str] = {}
    for label in every:
        out.setdefault(label.lower(), label)
    return list(out.values())


def contradiction_candidates(new: DataFrame, similar: DataFrame, links: DataFrame, memories: DataFrame, *, most: int = 5, tasks: int | None = None) -> DataFrame:
    """memory_id, candidate_id, place: what a new memory may contradict: the ``most``
    most similar ones (memory_id, other_id, score), filled up with memories that share an
    entity; those of other domains alone are left out.  Verdicts are the caller's.

    Fill goes by memory id, so of an entity's memories the 2 * ``most`` + 1 smallest can
    come in: all but the new one, its similar ones and those that fill it up are past
    ``most``.  An entity of many memories makes no more pairs than that for each."""
    from recallforge.operators import ranking

    tasks = tasks or dealt(links.count())
    near = ranking.per_group(similar.where("memory_id <> other_id").select("memory_id", F.col("other_id").alias("candidate_id"), "score"), ["memory_id"], [F.desc("score"), "candidate_id"], most)
    own = links.join(new.select("memory_id"), "memory_id", "left_semi").where("entity_id is not null").repartition(tasks, "entity_id")
    low = links.where("memory_id is not null and entity_id is not null").select(F.col("memory_id").alias("candidate_id"), "entity_id").distinct().repartition(tasks, "entity_id")
    shared = own.join(ranking.per_group(low, ["entity_id"], ["candidate_id"], 2 * most + 1), "entity_id").where("memory_id <> candidate_id")
    every = near.select("memory_id", "candidate_id", F.lit(0).alias("_p"), F.negate("score").alias("_s")).unionByName(shared.select("memory_id", "candidate_id", F.lit(1).alias("_p"), F.lit(0.0).alias("_s")))
    once = every.repartition(tasks, "memory_id").groupBy("memory_id", "candidate_id").agg(F.min(F.struct("_p", "_s")).alias("_o")).select("memory_id", "candidate_id", "_o.*")
    head = ranking.per_group(once, ["memory_id"], ["_p", "_s", "candidate_id"], most)
    d = head.join(memories.select("memory_id", F.col("domains").alias("_a")), "memory_id").join(memories.select(F.col("memory_id").alias("candidate_id"), F.col("domains").alias("_b")), "candidate_id")
    fits = (F.size("_a") <= 0) | (F.size("_b") <= 0) | F.arrays_overlap("_a", "_b")
    return d.where(fits).select("memory_id", "candidate_id", F.when(F.col("_p") == 0, "similar").otherwise("linked").alias("how"))
