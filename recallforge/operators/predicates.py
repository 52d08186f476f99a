"""Predicates and routing expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def domain_prefix(domains: Column, domain: str) -> Column:
    return F.exists(domains, lambda d: d.startswith(domain))


def domain_match(a: Column, b: Column) -> Column:
    """Equal, or one is a ``:``-delimited prefix of the other."""
    return (a == b) | a.startswith(F.concat(b, F.lit(":"))) | b.startswith(F.concat(a, F.lit(":")))


def subscribed(announced: Column, wanted: Column) -> Column:
    """No filter receives all; a broadcast goes to broadcast subscribers; else any
    announced domain equal to, or under, a wanted one."""
    under = F.exists(announced, lambda a: F.exists(wanted, lambda s: (a == s) | a.startswith(F.concat(s, F.lit(":")))))
    return (F.size(wanted) == 0) | (F.array_contains(announced, "*") & F.array_contains(wanted, "*")) | (~F.array_contains(announced, "*") & under)


def with_broadcast(wanted: Column) -> Column:
    """A subscription's domains with the broadcast one; no domains receive all anyway."""
    return F.when(F.size(wanted) > 0, F.array_union(wanted, F.array(F.lit("*")))).otherwise(wanted)


def overlaps(start: Column, end: Column, q_start: Column, q_end: Column) -> Column:
    """Half-open intervals that share a moment."""
    return (start < q_end) & (end > q_start)


def range_filter(cands: DataFrame, ranges: DataFrame, key: str, q_start: Column, q_end: Column, missing: str = "include") -> DataFrame:
    """Candidates whose content range meets the query's; those without a range
    stay if ``missing`` is include."""
    r = ranges.select(key, F.col("range_start").alias("_a"), F.col("range_end").alias("_b"))
    hit = F.coalesce(overlaps(F.col("_a"), F.col("_b"), q_start, q_end), F.lit(missing == "include"))
    return cands.join(r, key, "left").where(hit).drop("_a", "_b")


# Names that are no entities, and the forms that declare a state.
JUNK = (
    r"^\d+(\.\d+)?%?$",
    r"^\d+ \w+\(s\)$",
    r"^\d+ chars$",
    r"^[a-f0-9]{8,}$",
    r"^Document: ",
    r"^[A-Z]\d+$",
    r"^avg \d",
)
DECLARED = (
    r"(?m)^[a-zA-Z0-9_\-]+\s*:\s*[a-zA-Z0-9_\-]+\s*=\s*.+$",
    r"(?:^|\n)##?\s*[Ss]tatus\s*[\n:]\s*\w+",
    r"(?mi)^\s*status\s*:\s*\w+",
)


def junk_name(name: Column) -> Column:
    """Names that are no entities: one character, or a known form of noise."""
    return name.isNull() | (F.length(name) <= 1) | any_of([name.rlike(p) for p in JUNK])


def declares_state(text: Column) -> Column:
    """One of three declaration forms: ``entity: key = value``, a status heading, a status line."""
    return any_of([text.rlike(p) for p in DECLARED])


def stale(refresh_due: Column, now: Column) -> Column:
    return now >= refresh_due


def within_ttl(created: Column, now: Column, hours: float) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 3.6e9 <= hours


def route(rules: list[tuple[Column, str, float]]) -> Column:
    """struct<domain, confidence> of the first rule that fits."""
    none = F.lit(None).cast("struct<domain:string,confidence:double>")
    return reduce(lambda rest, r: F.when(r[0], F.struct(F.lit(r[1]).alias("domain"), F.lit(r[2]).alias("confidence"))).otherwise(rest), reversed(rules), none)


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
