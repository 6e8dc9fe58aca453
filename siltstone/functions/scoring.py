"""Scores of claims as column expressions: trust, credibility, salience, credit and the like.

Ages are in days, as doubles. Null ages mean that there is no time to measure from.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scores.
FRESHNESS_DAYS, FRESHNESS_FLOOR = 90.0, 0.3
EDGE_WEIGHTS = {"supports": 1.0, "validates": 1.0, "causes": 0.8, "caused_by": 0.8, "derived_from": 0.8, "action_of": 0.8, "outcome_of": 0.8, "contradicts": 0.5, "refutes": 0.5}
OTHER_EDGE_WEIGHT = 0.6
RISK_SALIENCE = {"low": 0.3, "medium": 0.5, "high": 0.75, "critical": 1.0}
RESULT_SALIENCE = {"failure": 0.9, "partial": 0.7}
TYPE_SALIENCE = {"decision": 1.0, "test_result": 1.0, "fact": 0.6, "hypothesis": 0.3}
OTHER_SALIENCE = 0.5


def days_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 86_400_000_000.0


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def freshness(age: Column, scale: Column | float = FRESHNESS_DAYS) -> Column:
    """exp(-age / scale), at least FRESHNESS_FLOOR; 1 without an age, or for a time to come. The scale is the time in which
    it falls to 1 / e, not a half-life; 0 or less: the default."""
    scale = F.lit(scale) if isinstance(scale, float) else F.when(scale > 0, scale).otherwise(FRESHNESS_DAYS)
    return F.when(age.isNull() | (age <= 0), 1.0).otherwise(F.greatest(F.lit(FRESHNESS_FLOOR), F.exp(-age / scale)))


def effective_evidence(distinct: Column, total: Column) -> Column:
    """Distinct sources, and half of the repeats, rounded down."""
    return distinct + F.floor(0.5 * (total - distinct))


def trust(confidence: Column, evidence: Column, fresh: Column) -> Column:
    return clamp01(confidence * (1 + 0.2 * F.log(F.greatest(evidence, F.lit(1)).cast("double"))) * fresh)


def credibility(base: Column, authority: Column, citations: Column, age: Column, live: Column, tests: Column) -> Column:
    """Weighted signals, each 0 to 1; 0 for base or authority means unknown: 0.5. Without tests (null) the other weights
    are scaled up."""
    known = F.when(base == 0, 0.5).otherwise(base) * 0.50 + F.when(authority == 0, 0.5).otherwise(authority) * 0.15
    known = known + 0.13 * clamp01(F.log1p(citations.cast("double")) / math.log(11)) + 0.10 * F.when(age.isNull(), 0.5).otherwise(F.exp(-F.greatest(age, F.lit(0.0)) / 180.0)) + 0.05 * live
    return clamp01(F.when(tests.isNull(), known / 0.93).otherwise(known + 0.07 * tests))


def pass_ratio(passed: Column, failed: Column) -> Column:
    """How one-sided test results are, whichever side; null without results."""
    return F.when(passed + failed > 0, F.abs(passed - failed) / (passed + failed))


def liveness(age: Column, score: Column) -> Column:
    return F.when(age <= 14, "live").when(age <= 180, "stale").when(score >= 0.6, "zombie").otherwise("dead")


def salience(confidence: Column, evidence: Column, kind: Column, authority: Column, verified: Column) -> Column:
    by_kind = F.coalesce(*[F.when(kind == k, v) for k, v in TYPE_SALIENCE.items()], F.lit(OTHER_SALIENCE))
    return clamp01(0.35 * confidence + 0.25 * (1 - 1 / (1 + evidence)) + 0.25 * by_kind + 0.10 * authority + 0.05 * F.least(verified, F.lit(3)) / 3)


def outcome_salience(risk: Column, result: Column) -> Column:
    by_risk = F.coalesce(*[F.when(risk == k, v) for k, v in RISK_SALIENCE.items()], F.lit(0.0))
    by_result = F.coalesce(*[F.when(result == k, v) for k, v in RESULT_SALIENCE.items()], F.lit(0.0))
    return F.greatest(by_risk, by_result)


def surprise(predicted: Column, observed: Column, tolerance: Column) -> Column:
    return F.when(tolerance > 0, F.abs(predicted - observed) / tolerance).otherwise(F.abs(predicted - observed))


def saturated(surprised: Column) -> Column:
    return F.least(surprised / 2, F.lit(1.0))


def credit(surprised: Column) -> Column:
    """Credit for what happened as expected, blame for surprises of more than the tolerance."""
    return F.when(surprised <= 1, 0.1 * (1 - surprised)).otherwise(-0.1 * F.least(surprised - 1, F.lit(3.0)) / 3)


def replay_priority(worth: Column, age: Column, surprised: Column) -> Column:
    return worth * F.exp(-age / 30.0) * (1 + 0.5 * (worth - 0.5) / 0.5) * (1 + surprised)


def gap_score(worth: Column, trusted: Column, staleness: Column) -> Column:
    return worth * (1 - trusted) * (0.3 + 0.7 * staleness)


def edge_weight(kind: Column, strength: Column) -> Column:
    by_kind = F.coalesce(*[F.when(kind == k, v) for k, v in EDGE_WEIGHTS.items()], F.lit(OTHER_EDGE_WEIGHT))
    return by_kind * (1 + 0.5 * (F.least(F.greatest(strength, F.lit(1.0)), F.lit(10.0)) - 1) / 9)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 if either has no length."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def short_id(prefix: str, *parts: Column, size: int = 16) -> Column:
    """A prefix and the first characters of the SHA-256 of the parts joined by `|`."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, size))


def resistance(age: Column, verified: Column, since_verified: Column) -> Column:
    """How far a belief may still move: 1 for a new one, down to 0.25 for one that is old, often and lately verified."""
    a, r = F.greatest(age, F.lit(0.0)), F.greatest(since_verified, F.lit(0.0))
    return 1 - 0.75 * (a / (a + 30.0)) * (verified / (verified + 3.0)) * (30.0 / (r + 30.0))


def modulated(delta: Column, resists: Column, gain: Column) -> Column:
    """A credit scaled by gain (0.5 to 2) and by resistance, to which blame yields by 0.6 more."""
    r = F.greatest(F.lit(0.25), F.least(F.lit(1.0), resists))
    d = delta * F.greatest(F.lit(0.5), F.least(F.lit(2.0), gain))
    return F.when(d >= 0, d * r).otherwise(d * (r + (1 - r) * 0.6))


# Fixed values of components: the salience of a claim without one, and how inhibition grows, is capped, fades and ends.
USUAL_SALIENCE, INHIBITED, MOST_INHIBITED, FADES, LEAST_INHIBITED = 0.5, 0.1, 0.5, 0.5, 0.01


def explicit_salience(components: Column) -> Column:
    return clamp01(F.coalesce(F.try_element_at(components, F.lit("salience")), F.lit(USUAL_SALIENCE)))


def inhibition(components: Column) -> Column:
    return clamp01(F.coalesce(F.try_element_at(components, F.lit("inhibition")), F.lit(0.0)))


def _with_entry(components: Column, key: str, value: Column) -> Column:
    others = F.map_filter(components, lambda k, v: k != key)
    return F.when(value.isNull(), others).otherwise(F.map_concat(others, F.create_map(F.lit(key), value)))


def decayed_inhibition(components: Column) -> Column:
    """The map with its inhibition halved, or gone where little is left."""
    faded = F.try_element_at(components, F.lit("inhibition")) * FADES
    return _with_entry(components, "inhibition", F.when(faded >= LEAST_INHIBITED, faded))


def suppressed(components: Column) -> Column:
    """The map with more inhibition, up to a cap."""
    return _with_entry(components, "inhibition", F.least(F.coalesce(F.try_element_at(components, F.lit("inhibition")), F.lit(0.0)) + INHIBITED, F.lit(MOST_INHIBITED)))


def with_credits(components: Column, credits: Column) -> Column:
    """The map with all entries under `credit:` replaced."""
    return F.map_concat(F.map_filter(components, lambda k, v: ~k.startswith("credit:")), credits)


def is_stale(at: Column, now: Column, floor: float = FRESHNESS_FLOOR) -> Column:
    """Whether what was last seen then is as little fresh as anything can be; false without a time."""
    return F.coalesce(freshness(days_between(at, now)) <= floor, F.lit(False)) & at.isNotNull()
