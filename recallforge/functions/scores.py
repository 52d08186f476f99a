"""Column functions for activation, recency, fusion and confidence scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

LOWEST_ACTIVATION = -10.0


def seconds_between(later: Column, earlier: Column) -> Column:
    """Elapsed seconds as a double, from whole microseconds."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / 1e6


def base_level(age: Column, decay: float = 0.5) -> Column:
    """Aggregate: log of the summed power-law decays of positive ages in seconds."""
    return F.coalesce(F.ln(F.sum(F.when(age > 0, F.pow(age, F.lit(-decay))))), F.lit(LOWEST_ACTIVATION))


def recency(age_seconds: Column, half_life_days: float = 30.0) -> Column:
    return F.when(age_seconds <= 0, 1.0).otherwise(F.exp(-math.log(2) * age_seconds / 86400.0 / half_life_days))


def retrieval_probability(activation: Column, threshold: float = -2.0, tau: float = 0.4) -> Column:
    x = -(activation - threshold) / tau
    return 1.0 / (1.0 + F.exp(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), x))))


def total_activation(base: Column, spreading: Column | float = 0.0, noise: Column | float = 0.0, penalty: Column | float = 0.0) -> Column:
    return base + spreading + noise - penalty


def activation_noise(uniform: Column, sigma: float = 0.25) -> Column:
    u = F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), uniform))
    return sigma * math.pi / math.sqrt(3) * F.ln(u / (1 - u))


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    """Share of a list position, counted from 1."""
    return 1.0 / (k + rank)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a proportion; (0, 0) for no trials."""
    p = hits / F.when(n > 0, n)
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    bound = lambda c: F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))).otherwise(0.0)
    return bound(mid - half), bound(mid + half)


def temporal_proximity(event: Column, start: Column, end: Column, now: Column, kind: Column) -> Column:
    """Nearness of an event to a reference: 'first' favours old events, 'recency'
    new ones; a range counts 1 inside and decays by its own length outside."""
    day = 86400.0
    age = seconds_between(now, event)
    span = F.greatest(seconds_between(end, start), F.lit(day))
    away = F.greatest(seconds_between(start, event), seconds_between(event, end))
    return (
        F.when(kind == "first", 1 - F.pow(F.lit(2.0), -age / (30 * day)))
        .when(kind == "recency", F.pow(F.lit(2.0), -age / (2 * day)))
        .when(start.isNotNull() & (away <= 0), 1.0)
        .when(start.isNotNull(), F.exp(-0.5 * F.pow(away / span, F.lit(2.0))))
        .otherwise(0.5)
    )


def penalty(superseded: Column, conflicted: Column, intent: Column) -> Column:
    """Reconciliation penalty, for current-state look-ups alone."""
    both = F.when(superseded, 0.3).otherwise(0.0) + F.when(conflicted, 0.15).otherwise(0.0)
    return F.when(intent == "current_state_lookup", both).otherwise(0.0)
