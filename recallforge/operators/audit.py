"""Documents, reviews and audit analytics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def timeline(parts: list[DataFrame]) -> DataFrame:
    """Heterogeneous audit rows, projected to the same columns, as one table."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def compliance(review: Column, penalty: Column, citations: Column, denied: Column, kinds: Column) -> Column:
    """0.40 mean review, 0.20 what violations leave of 100, 0.15 citations (ten
    points each, 100 at most), 0.15 for no denial, 0.10 the share of document kinds.
    Parts of whole numbers are divided, so each is the double next to its decimal."""
    return (
        0.40 * F.coalesce(review, F.lit(0.0))
        + F.greatest(F.lit(0), 100 - F.coalesce(penalty, F.lit(0))) / 5
        + F.least(F.lit(100), 10 * F.coalesce(citations, F.lit(0))) * 15 / 100
        + F.when(F.coalesce(denied, F.lit(0)) > 0, 0).otherwise(100) * 15 / 100
        + 0.10 * (F.coalesce(kinds, F.lit(0.0)) * 100)
    )


def integrity(docs: DataFrame, text: str, recorded: str) -> DataFrame:
    return docs.withColumn("intact", F.sha2(text, 256) == F.col(recorded))


def chain_heads(rows: DataFrame, by: str, order: str, record: str) -> DataFrame:
    """by, n, head: how many records a chain has, and the hash of its last, each over
    the one before.  A chain is sequential by definition: a row holds its records in
    order, folded to one hash."""
    ordered = F.array_sort(F.collect_list(F.struct(order, record)))
    head = F.aggregate(ordered, F.lit(""), lambda h, r: F.sha2(F.concat(h, r[record]), 256))
    return rows.groupBy(by).agg(F.count("*").alias("n"), head.alias("head"))


def hash_chain(rows: DataFrame, by: str, order: str, record: str) -> DataFrame:
    """by, order, hash: the hash of every record, walked chain by chain in order."""
    import hashlib

    import pandas as pd

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part, head, out = part.sort_values(order), "", []
        for r in part[record]:
            head = hashlib.sha256((head + r).encode()).hexdigest()
            out.append(head)
        return part[[by, order]].assign(hash=out)

    kept = rows.select(by, order, record)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:2])
    return kept.groupBy(by).applyInPandas(walk, f"{schema}, hash string")


def verify_chain(rows: DataFrame, by: str, order: str, record: str, digest: str) -> DataFrame:
    """by, rows, verified: whether every stored hash follows from its record and the
    stored hash before, so each link is checked by itself."""
    w = Window.partitionBy(by).orderBy(order)
    follows = F.sha2(F.concat(F.lag(digest, 1, "").over(w), record), 256) == F.col(digest)
    return rows.withColumn("_f", F.coalesce(follows, F.lit(False))).groupBy(by).agg(F.count("*").alias("rows"), F.bool_and("_f").alias("verified"))


def versions(docs: DataFrame, chain: str, order: list[str], key: str) -> DataFrame:
    """version and supersedes (the document before) along each chain."""
    w = Window.partitionBy(chain).orderBy(*order)
    return docs.withColumns({"version": F.row_number().over(w), "supersedes": F.lag(key).over(w)})


def report(spark_rows: DataFrame, title: str, most: int = 1000) -> str:
    """Markdown of a bounded result: a header and a row per line."""
    rows = spark_rows.limit(most).collect()
    head = "| " + " | ".join(spark_rows.columns) + " |"
    rule = "|" + "---|" * len(spark_rows.columns)
    return "\n".join([f"# {title}", "", head, rule, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def provenance(docs: DataFrame, links: DataFrame, reviews: DataFrame, violations: DataFrame, calls: DataFrame) -> DataFrame:
    """doc_id, project_id, lineage, reviews, violations, calls, intact: counts of what
    stands behind each document: links at either end, its reviews, its project's
    violations, its author's model calls in the project; and whether its text has the
    recorded hash."""
    ends = links.select(F.col("src").alias("doc_id"), "link_id").unionByName(links.select(F.col("dst").alias("doc_id"), "link_id")).distinct()
    n = lambda df, by, name: df.groupBy(*by).agg(F.count("*").alias(name))
    j = docs.join(n(ends, ["doc_id"], "lineage"), "doc_id", "left").join(n(reviews, ["doc_id"], "reviews"), "doc_id", "left")
    j = j.join(n(violations, ["project_id"], "violations"), "project_id", "left").join(n(calls, ["project_id", "agent"], "calls"), ["project_id", "agent"], "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("lineage", "reviews", "violations", "calls")]
    return j.select("doc_id", "project_id", *zero, (F.sha2("content", 256) == F.col("content_hash")).alias("intact"))


def decided(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approval requests (request_id, project_id) with their status: the last decision
    (request_id, decision, decided_at), else pending."""
    last = decisions.groupBy("request_id").agg(F.max_by("decision", F.struct("decided_at", "decision")).alias("_d"))
    return requests.join(last, "request_id", "left").select("request_id", "project_id", F.coalesce("_d", F.lit("pending")).alias("status"))


def project_status(projects: DataFrame, approvals: DataFrame) -> DataFrame:
    """Projects (project_id, status): a denial makes an active one denied."""
    denied = approvals.where("status = 'denied'").select("project_id").distinct().withColumn("_d", F.lit(True))
    return projects.join(denied, "project_id", "left").select("project_id", F.when(F.col("_d") & (F.col("status") == "active"), "denied").otherwise(F.col("status")).alias("status"))


def audit_rows(events: DataFrame, kind: str, agent: str, at: str, detail: list[str]) -> DataFrame:
    """kind, at, agent, detail, digest: audit records of one kind, to be appended; the
    digest is over the record itself."""
    text = F.to_json(F.struct(*detail))
    return events.select(F.lit(kind).alias("kind"), F.col(at).alias("at"), F.col(agent).cast("string").alias("agent"), text.alias("detail"), F.sha2(F.concat_ws("|", F.lit(kind), F.col(agent).cast("string"), text), 256).alias("digest"))


def snapshots(entries: DataFrame, *, most: int = 50) -> DataFrame:
    """agent, snapshot_id, at, domains, entries, supersedes: a snapshot for each run of
    entries (agent, run, at, domain, memory_id) with its newest ``most``, and the one
    before it."""
    from recallforge.operators import ranking

    few = ranking.per_group(entries, ["agent", "run"], [F.desc("at"), "memory_id"], most)
    g = few.groupBy("agent", "run").agg(F.max("at").alias("at"), F.array_sort(F.collect_set("domain")).alias("domains"), F.count("*").alias("entries"))
    key = F.concat_ws("#", F.col("agent").cast("string"), F.col("run").cast("string"))
    return g.withColumn("snapshot_id", key).withColumn("supersedes", F.lag("snapshot_id").over(Window.partitionBy("agent").orderBy("run"))).drop("run")


def pages(docs: DataFrame, links: DataFrame, path: str) -> int:
    """A linked Markdown page for each document (name, title, body) with what points at
    it, as text files under ``path`` by name; how many.  Written by the executors."""
    to = links.groupBy(F.col("dst").alias("name")).agg(F.array_sort(F.collect_set("src")).alias("_in"))
    refs = F.transform(F.coalesce("_in", F.array().cast("array<string>")), lambda s: F.concat(F.lit("- [["), s, F.lit("]]")))
    text = F.concat_ws("\n", F.concat(F.lit("# "), F.col("title")), F.lit(""), "body", F.lit(""), F.array_join(refs, "\n"))
    rows = docs.join(to, "name", "left").select("name", text.alias("value"))
    rows.write.mode("overwrite").partitionBy("name").option("lineSep", "\u0000").text(path)
    return docs.count()
