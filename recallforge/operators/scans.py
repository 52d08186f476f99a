"""Scans, look-ups, upserts and deletes over the model's tables.

Tables are immutable Parquet; an upsert appends and the newest row of an id wins, a
delete appends tombstones that an anti-join removes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def list_memories(df: DataFrame, *, domain: str | None = None, agent: str | None = None, since: Column | None = None, kind: str | None = None, limit: int | None = 100) -> DataFrame:
    """Newest first; predicates are AND-ed and reach the scan."""
    if domain is not None:
        df = df.where(F.array_contains("domains", domain))
    if agent is not None:
        df = df.where(F.col("source_agent") == agent)
    if since is not None:
        df = df.where(F.col("created_at") > since)
    if kind is not None:
        df = df.where(F.col("type") == kind)
    df = df.orderBy(F.desc("updated_at"), "memory_id")
    return df if limit is None else df.limit(limit)


def get(df: DataFrame, key: str, ids: Sequence) -> DataFrame:
    """Point look-up of one or several ids, as a pushed-down predicate."""
    return df.where(F.col(key).isin(list(ids)))


def by_hash(df: DataFrame, text: str, digest: str, key: str) -> DataFrame:
    return df.where(F.sha2(text, 256) == digest).orderBy(key).limit(1)


def by_json_key(df: DataFrame, column: str, path: str, value) -> DataFrame:
    return df.where(F.get_json_object(column, path) == str(value))


def last_write_wins(df: DataFrame, key: Sequence[str], version: str, tie: str | None = None) -> DataFrame:
    order = [F.desc(version), *([F.desc(tie)] if tie else [])]
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def delete_cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows that point at a deleted id."""
    dead = gone.select(F.col(key).alias("_dead")).distinct()
    return {n: df.join(dead, df[c] == F.col("_dead"), "left_anti") for n, (df, c) in tables.items()}


def unseen(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose (path, hash) was not recorded before."""
    return files.join(known.select("path", "sha"), ["path", "sha"], "left_anti")


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def replace_all(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """Every row of an owner that ``new`` names gives way to its rows there."""
    return upsert(old, new, [owner])


def newest(df: DataFrame, at: str, key: str, most: int | None = None) -> DataFrame:
    """Newest first, ties by key; ``most`` rows where given."""
    out = df.orderBy(F.desc(at), key)
    return out if most is None else out.limit(most)


def edges_of(edges: DataFrame, *, source=None, kinds: Sequence[str] | None = None) -> DataFrame:
    """Edges from a node, of some types, or both; newest first."""
    out = edges if source is None else edges.where(F.col("source_id") == source)
    out = out if kinds is None else out.where(F.col("edge_type").isin(list(kinds)))
    return out.orderBy(F.desc("created_at"), "source_id", "target_id")


def nodes_of(nodes: DataFrame, *, kind: str | None = None, abstract: str | None = None, memories: DataFrame | None = None) -> DataFrame:
    """Nodes of a type, abstracts of a kind (in their JSON metadata), nodes of memories."""
    out = nodes if kind is None else nodes.where(F.col("node_type") == kind)
    if abstract is not None:
        out = out.where((F.col("node_type") == "abstract") & (F.get_json_object("metadata", "$.abstract_type") == abstract))
    return out if memories is None else out.join(memories.select("memory_id").distinct(), "memory_id", "left_semi")


def list_documents(docs: DataFrame, *, project=None, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Documents of a project, of a type, or both; the newest ``limit``."""
    out = docs if project is None else docs.where(F.col("project_id") == project)
    out = out if kind is None else out.where(F.col("doc_type") == kind)
    return newest(out, "created_at", "doc_id", limit)


def children(docs: DataFrame, parent, limit: int = 200) -> DataFrame:
    """Documents under a parent, oldest first."""
    return docs.where(F.col("parent_id") == parent).orderBy("created_at", "doc_id").limit(limit)


def cached_labels(store: DataFrame, domains: Sequence[str]) -> DataFrame:
    """domain, labels: what the key/value table keeps under entity_labels:<domain>."""
    keys = [f"entity_labels:{d}" for d in domains]
    found = store.where(F.col("key").isin(keys))
    return found.select(F.regexp_replace("key", "^entity_labels:", "").alias("domain"), F.from_json("value", "array<string>").alias("labels")).where("size(labels) > 0")


def without(store: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A key/value table without some keys."""
    return store.where(~F.col("key").isin(list(keys)))


def json_array(column: str) -> Column:
    """A JSON text column as an array; anything else as an empty one."""
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))


def semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is among ``keys``."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def range_upsert(ranges: DataFrame, new: DataFrame) -> DataFrame:
    """One content range per memory: new ones replace old ones, empty ones go."""
    return upsert(ranges, new.where("range_start < range_end"), ["memory_id"])


def invariants(rows: DataFrame, rules: dict[str, Column], key: str, most: int = 3) -> DataFrame:
    """rule, broken, sample: how many rows break each rule (a column that is true where
    it holds), with the smallest keys as a sample.  One pass over the rows."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    hit = rows.select(F.col(key).alias("_k"), F.explode(broken).alias("rule"))
    w = Window.partitionBy("rule").orderBy("_k")
    sample = hit.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).groupBy("rule").agg(F.array_sort(F.collect_list("_k")).alias("sample"))
    return hit.groupBy("rule").agg(F.count("*").alias("broken")).join(sample, "rule")


def access_log(returned: DataFrame, agent: str, now: Column) -> DataFrame:
    """One access for each row that a search returned, to be appended."""
    return returned.select("memory_id", now.alias("accessed_at"), F.lit(agent).alias("agent"))


def drain(inbox: DataFrame, read: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays in an inbox, what is read and goes)."""
    return inbox.where(~F.coalesce(read, F.lit(False))), inbox.where(read)
