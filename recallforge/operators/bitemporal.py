"""States as of a moment, by validity with a fallback to when they were recorded.

For a probe (subject, t) the answer is the valid state (valid_from <= t, valid_to null or
later) that became valid last; where none is, the state recorded last (created_at <= t).
Ties go to the larger node_id.

One sweep over recordings, starts and probes in the order of time keeps a stack of
started states per subject.  A state that ends no later than one that started after it
is never seen again, so the stack holds ends that fall towards its top, and only its top
is ever asked.  A subject of very many rows spans several partitions: each passes on what
its last subject leaves behind, and a pass over one row for each partition gives every
partition what it starts with.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recallforge.shared import cut

_RECORDED, _STARTED, _PROBE = 0, 1, 2


class _Seen:
    """What a subject's rows so far leave behind: started states (start, node, end),
    and the state recorded last (created, node)."""

    def __init__(self):
        self.stack: list[tuple[int, int, int | None]] = []
        self.recorded: tuple[int, int] | None = None

    def start(self, at: int, node: int, end: int | None) -> None:
        if end is not None and end <= at:
            return
        while self.stack and (end is None or self.stack[-1][2] is not None and self.stack[-1][2] <= end):
            self.stack.pop()
        self.stack.append((at, node, end))

    def record(self, at: int, node: int) -> None:
        self.recorded = (at, node)

    def then(self, at: int) -> tuple[int | None, bool]:
        while self.stack and self.stack[-1][2] is not None and self.stack[-1][2] <= at:
            self.stack.pop()
        if self.stack:
            return self.stack[-1][1], True
        return (self.recorded[1] if self.recorded else None), False

    def after(self, later: _Seen) -> _Seen:
        """What is left when ``later`` saw the rows that follow."""
        out = _Seen()
        out.stack = list(self.stack)
        for s in later.stack:
            out.start(*s)
        out.recorded = later.recorded or self.recorded
        return out


def _rows(batch: pa.RecordBatch):
    return zip(*(batch.column(c).to_pylist() for c in ("subject", "at", "kind", "node", "until", "probe")), strict=True)


def _take(seen: _Seen, at: int, kind: int, node: int, until: int | None) -> None:
    if kind == _RECORDED:
        seen.record(at, node)
    elif kind == _STARTED:
        seen.start(at, node, until)


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition: its number, whether it is one subject, its first and last subject,
    and what the last one leaves."""
    part = first = last = None
    seen, whole = _Seen(), True
    for batch in batches:
        if batch.num_rows:
            part = batch.column("part")[0].as_py()
        for subject, at, kind, node, until, _ in _rows(batch):
            if first is None:
                first = last = subject
            elif subject != last:
                last, seen, whole = subject, _Seen(), False
            _take(seen, at, kind, node, until)
    if first is not None:
        yield pa.RecordBatch.from_pylist([{"part": part, "whole": whole, "first": first, "last": last, "seen": pickle.dumps((seen.stack, seen.recorded))}])


def _loaded(raw: bytes) -> _Seen:
    out = _Seen()
    out.stack, out.recorded = pickle.loads(raw)
    return out


def _handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each partition starts with, in their order."""
    subject, seen = None, _Seen()
    for batch in batches:
        for r in batch.to_pylist():
            here = seen if subject is not None and r["first"] == subject else _Seen()
            yield pa.RecordBatch.from_pylist([{"part": r["part"], "given": pickle.dumps((here.stack, here.recorded))}])
            mine = _loaded(r["seen"])
            subject, seen = r["last"], here.after(mine) if r["whole"] else mine


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    subject, seen = None, None
    for batch in batches:
        out: dict[str, list] = {"probe": [], "node": [], "valid": []}
        for (s, at, kind, node, until, probe), given in zip(_rows(batch), batch.column("given").to_pylist(), strict=True):
            if seen is None:
                subject, seen = s, _loaded(given)
            elif s != subject:
                subject, seen = s, _Seen()
            if kind == _PROBE:
                found, valid = seen.then(at)
                if found is not None:
                    out["probe"].append(probe)
                    out["node"].append(found)
                    out["valid"].append(valid)
            else:
                _take(seen, at, kind, node, until)
        yield pa.RecordBatch.from_arrays([pa.array(out["probe"], pa.int64()), pa.array(out["node"], pa.int64()), pa.array(out["valid"], pa.bool_())], names=["probe", "node", "valid"])


def as_of(states: DataFrame, probes: DataFrame, subject: list[str], probe: str = "probe_id", at: str = "at") -> DataFrame:
    """probe, node_id, by_validity of the probes (probe, subject columns, at) that have an
    answer.  ``states``: node_id, subject columns, valid_from, valid_to, created_at (each
    time may be null).  Subjects with a null column have no states; probes without a time
    have no answer.  Moments count in microseconds."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    none = F.lit(None).cast("long")
    who = F.struct(*[F.col(c).cast("string").alias(c) for c in subject]).alias("subject")
    known = states.dropna(subset=["node_id", *subject])
    s = known.select(who, F.col("node_id").cast("long").alias("node"), micros("valid_from").alias("f"), micros("valid_to").alias("until"), micros("created_at").alias("c"))
    recorded = s.where("c is not null").select("subject", F.col("c").alias("at"), F.lit(_RECORDED).alias("kind"), "node", none.alias("until"), none.alias("probe"))
    started = s.where("f is not null").select("subject", F.col("f").alias("at"), F.lit(_STARTED).alias("kind"), "node", "until", none.alias("probe"))
    asked = probes.dropna(subset=[*subject, at]).select(who, micros(at).alias("at"), F.lit(_PROBE).alias("kind"), none.alias("node"), none.alias("until"), F.col(probe).cast("long").alias("probe"))
    order = ["subject", "at", "kind", "node", "probe"]
    rows = recorded.unionByName(started).unionByName(asked)
    rows = rows.withColumn("subject", F.to_json("subject")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(rows).withColumn("part", F.spark_partition_id())
    left = rows.mapInArrow(_left, "part long, whole boolean, first string, last string, seen binary")
    given = left.repartition(1).sortWithinPartitions("part").mapInArrow(_handed, "part long, given binary")  # a row for each partition
    found = rows.join(F.broadcast(given), "part").mapInArrow(_answered, "probe long, node long, valid boolean")
    return found.select(F.col("probe").alias(probe), F.col("node").alias("node_id"), F.col("valid").alias("by_validity"))
