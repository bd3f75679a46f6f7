"""Scores of memory records as column expressions (importance, decay, quality, selection)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and thresholds per type that results depend on.
TYPE_WEIGHT = {"correction": 1.3, "decision": 1.2, "user_preference": 1.1, "fact_declaration": 1.0, "relationship": 1.0, "task_pattern": 0.9, "sentiment_marker": 0.3}
SELECTION_BOOST = {"correction": 0.5, "decision": 0.4, "user_preference": 0.3, "fact_declaration": 0.0, "session_summary": -0.1, "sentiment_marker": -0.2}
CONFIDENCE_FLOOR = {"user_preference": 0.4, "sentiment_marker": 0.5}
RRF_BOOST = {"fact_declaration": 1.2, "decision": 1.2, "correction": 1.15, "user_preference": 1.1, "task_pattern": 1.05, "relationship": 1.0, "sentiment_marker": 0.5}
HALF_LIFE_FACTOR = {"user_preference": 3.0, "sentiment_marker": 0.5, "session_summary": 0.7}
SOURCE_RELIABILITY = {"user": 1.0, "declaration": 1.0, "rule": 0.9, "pattern": 0.7, "semantic": 0.6}
EVENT_TYPES = ("session_summary", "task_pattern")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def by_value(c: Column | str, table: Mapping[str, float], default: float | None) -> Column:
    """Lookup in a small literal table; ``default`` for other and null values."""
    out = F.lit(default).cast("double")
    for k, v in table.items():
        out = F.when(_c(c) == k, F.lit(float(v))).otherwise(out)
    return out


def seconds(ts: Column | str) -> Column:
    return F.unix_micros(_c(ts)) / F.lit(1e6)


def age_days(ts: Column | str, now: Column) -> Column:
    """Days since ``ts``, at least 0; null for null."""
    return F.greatest(F.lit(0.0), (seconds(now) - seconds(ts)) / F.lit(86400.0))


def type_weight(t: Column | str) -> Column:
    return by_value(t, TYPE_WEIGHT, 1.0)


def recency_factor(age: Column, half_life: float = 30.0, floor: float = 0.3) -> Column:
    return F.lit(floor) + F.lit(1 - floor) * F.pow(F.lit(0.5), age / F.lit(half_life))


def access_factor(n: Column | str) -> Column:
    return F.lit(1.0) + F.log(F.lit(1.0) + _c(n)) * F.lit(0.1)


def importance(confidence: Column | str, t: Column | str, age: Column, n: Column | str) -> Column:
    """confidence x type weight x recency x access, six decimals; can exceed 1."""
    return F.round(_c(confidence) * type_weight(t) * recency_factor(age) * access_factor(n), 6)


def recalculated_confidence(base: Column | str, rank: Column, n: Column | str, age: Column) -> Column:
    v = F.lit(0.5) * _c(base) + F.lit(0.3) * F.least(F.lit(1.0), rank / F.lit(10.0)) + F.lit(0.1) * F.least(F.lit(1.0), F.lit(0.2) * F.log(F.lit(1.0) + _c(n))) + F.lit(0.1) * F.greatest(F.lit(0.0), F.lit(1.0) - age / F.lit(365.0))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)), 6)


def decay_factor(age: Column, t: Column | str, n: Column | str, confidence: Column | str) -> Column:
    """Half of it is gone every 90 days times the type's factor; accesses add up to 0.2; low confidence loses 30 %."""
    v = F.pow(F.lit(0.5), age / (F.lit(90.0) * by_value(t, HALF_LIFE_FACTOR, 1.0))) + F.least(F.lit(0.2), F.lit(0.02) * _c(n))
    v = F.least(F.lit(1.0), v)
    return F.round(F.when(_c(confidence) < 0.3, v * F.lit(0.7)).otherwise(v), 4)


def quality_score(confidence: Column | str, n: Column | str, age: Column, source: Column | str, weights: tuple[float, float, float, float] = (0.4, 0.3, 0.2, 0.1)) -> Column:
    """Weighted sum of confidence, use, freshness and source; the weights must sum to 1."""
    if abs(sum(weights) - 1) > 1e-9:
        raise ValueError("weights must sum to 1")
    a, b, c, d = map(F.lit, map(float, weights))
    parts = a * _c(confidence) + b * F.least(_c(n) / F.lit(10.0), F.lit(1.0)) + c * F.greatest(F.lit(0.0), F.lit(1.0) - age / F.lit(365.0)) + d * by_value(source, SOURCE_RELIABILITY, 0.5)
    return F.round(parts, 6)


def quality_tier(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "fair").otherwise("poor")


def legacy_weight(confidence: Column | str, days: Column, n: Column | str) -> Column:
    return _c(confidence) * F.pow(F.lit(2.0), F.lit(-0.1) * days) * (F.lit(1.0) + F.lit(0.5) * F.sqrt(_c(n).cast("double")))


def selection_score(imp: Column, relevance: Column, t: Column | str, n: Column | str, days_since_access: Column, temporal: Column, aggregation: bool = False) -> Column:
    boost = F.least(F.lit(0.01) * _c(n), F.lit(0.1)) * F.coalesce(F.pow(F.lit(2.0), F.lit(-0.1) * days_since_access), F.lit(1.0))
    return F.lit(0.7) * imp + F.lit(0.3) * relevance + by_value(t, SELECTION_BOOST, 0.0) + boost + temporal + F.lit(0.3 if aggregation else 0.0)


def suggested_action(confidence: Column | str) -> Column:
    return F.when(_c(confidence) > 0.5, "store").when(_c(confidence) > 0.3, "defer").otherwise("ignore")


def memory_nature(t: Column | str) -> Column:
    return F.when(_c(t).isin(*EVENT_TYPES), "event").otherwise("state")


def rule_bonus(override: Column, triggered: Column, confidence: Column) -> Column:
    return F.when(override, 0.1).otherwise(0.0) + F.least(triggered / F.lit(10.0) * F.lit(0.02), F.lit(0.1)) + F.lit(0.05) * confidence


def promoted_importance(imp: Column | str) -> Column:
    """0.05 more, at most 1; a score above 1 falls to 1."""
    return F.least(_c(imp) + F.lit(0.05), F.lit(1.0))


def expiry(created: Column | str, tier: Column | str, days: Mapping[int, int] = {1: 1, 2: 90, 3: 365}) -> Column:  # noqa: B006
    """Creation plus the tier's days; null (never) for other tiers."""
    out = F.lit(None).cast("timestamp")
    for k, d in days.items():
        out = F.when(_c(tier) == k, F.timestamp_micros(F.unix_micros(_c(created)) + F.lit(d * 86_400_000_000))).otherwise(out)
    return out


def may_count_access(last: Column | str, at: Column, throttle: int = 60) -> Column:
    return _c(last).isNull() | (seconds(at) - seconds(last) >= throttle)
