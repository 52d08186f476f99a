"""Entity states in time: current, as-of, history, reconciliation, episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SUBJECT = ["entity_id", "state_key"]


def current(states: DataFrame) -> DataFrame:
    """The newest row of each (entity, key): one map-side combine, no sort."""
    rest = [c for c in states.columns if c not in SUBJECT]
    best = F.max_by(F.struct(*rest), F.struct("created_at", "node_id"))
    return states.groupBy(*SUBJECT).agg(best.alias("_b")).select(*SUBJECT, "_b.*")


def as_of(states: DataFrame, moment: Column) -> DataFrame:
    """The state that held at ``moment``: a filter before the combine."""
    return current(states.where(F.col("created_at") <= moment))


def as_of_probes(states: DataFrame, probes: DataFrame, probe: str = "probe_id", at: str = "at") -> DataFrame:
    """For each probe (entity, key, moment): the state then.  States and probes are
    interleaved per subject and the last state carried forward, so the work is one
    sort per subject instead of a range join."""
    rest = [c for c in states.columns if c not in SUBJECT]
    s = states.select(*SUBJECT, F.col("created_at").alias("_t"), F.lit(0).alias("_k"), F.struct(*rest).alias("_s"), F.lit(None).cast(dict(probes.dtypes)[probe]).alias(probe))
    p = probes.select(*SUBJECT, F.col(at).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(dict(s.dtypes)["_s"]).alias("_s"), probe)
    w = Window.partitionBy(*SUBJECT).orderBy("_t", "_k", F.col("_s.node_id")).rowsBetween(Window.unboundedPreceding, 0)
    seen = s.unionByName(p).withColumn("_l", F.last("_s", ignorenulls=True).over(w))
    return seen.where("_k = 1 and _l is not null").select(probe, *SUBJECT, F.col("_t").alias(at), "_l.*")


def intervals(states: DataFrame) -> DataFrame:
    """valid_from, valid_to (null: open) and is_current of each state."""
    w = Window.partitionBy(*SUBJECT).orderBy("created_at", "node_id")
    nxt = F.lead("created_at").over(w)
    return states.select("*", F.col("created_at").alias("valid_from"), nxt.alias("valid_to"), nxt.isNull().alias("is_current"))


def relation(prev: Column, new: Column, prev_scope: Column | None = None, scope: Column | None = None) -> Column:
    """struct<relation, confidence> of a new state to the one before."""
    norm = lambda c: F.trim(F.lower(c.cast("string")))
    same = norm(prev) == norm(new)
    apart = F.lit(False) if scope is None else ~prev_scope.eqNullSafe(scope)
    as_ = lambda r, c: F.struct(F.lit(r).alias("relation"), F.lit(c).alias("confidence"))
    return F.when(prev.isNull(), as_("unrelated", 0.0)).when(same & apart, as_("refines", 0.8)).when(same, as_("supports", 0.9)).when(apart, as_("conflicts", 0.7)).otherwise(as_("supersedes", 0.9))


def reconcile(states: DataFrame, scope: str | None = None) -> DataFrame:
    """Each state against the one before it under the same subject."""
    w = Window.partitionBy(*SUBJECT).orderBy("created_at", "node_id")
    prev = states.withColumns({"prev_id": F.lag("node_id").over(w), "prev_value": F.lag("state_value").over(w), **({"_ps": F.lag(scope).over(w)} if scope else {})})
    rel = relation(F.col("prev_value"), F.col("state_value"), F.col("_ps") if scope else None, F.col(scope) if scope else None)
    return prev.withColumn("_r", rel).select(*states.columns, "prev_id", "prev_value", "_r.*")


def edges(reconciled: DataFrame) -> DataFrame:
    """Edge rows of the relations; supersedes and conflicts point both ways."""
    r = reconciled.where("relation <> 'unrelated'")
    back = {"supersedes": "superseded_by", "conflicts": "conflicts"}
    forth = r.select(F.col("node_id").alias("source_id"), F.col("prev_id").alias("target_id"), F.col("relation").alias("edge_type"))
    other = F.create_map(*[F.lit(x) for kv in back.items() for x in kv])
    return forth.unionByName(r.where(F.col("relation").isin(list(back))).select(F.col("prev_id").alias("source_id"), F.col("node_id").alias("target_id"), other[F.col("relation")].alias("edge_type")))


def trajectories(states: DataFrame, least: int = 3) -> DataFrame:
    """Subjects with ``least`` transitions or more: how many, first and last value,
    and the steps in order.  A subject's history is one row by nature of the result."""
    steps = F.array_sort(F.collect_list(F.struct("created_at", "node_id", "state_value")))
    return states.groupBy(*SUBJECT).agg(steps.alias("steps")).where(F.size("steps") >= least)


def sessions(events: DataFrame, by: list[str], ts: str, minutes: int) -> DataFrame:
    """Episodes: runs of events of ``by`` less than ``minutes`` apart.  Start and
    end are aggregates, not the window itself: a filter on the window would be
    pushed below the merge and break sessions apart."""
    gap = F.expr(f"interval {minutes} minutes")
    s = events.groupBy(*by, F.session_window(ts, f"{minutes} minutes").alias("_w")).agg(F.min(ts).alias("start"), (F.max(ts) + gap).alias("end"), F.count("*").alias("members"))
    return s.drop("_w")
