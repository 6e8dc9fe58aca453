"""Filters that decide which claims a question may see."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import scoring
from siltstone.functions.text import doc_tokens

# What a viewer of each visibility sees, and the weights of liveness.
VISIBLE_TO = {"personal": ["personal"], "team": ["personal", "team"], "org": ["personal", "team", "org"]}
LIVENESS_WEIGHTS = {"live": 1.0, "stale": 0.75, "zombie": 0.65, "dead": 0.25}


@dataclass
class Admission:
    """What to admit; None for no filter. allowed: a frame of claim_ids, where an empty one admits nothing."""

    now: Column
    valid_at: Column | None = None
    recorded_at: Column | None = None
    history: bool = False
    visibility: str = "team"
    scope: dict[str, str] = field(default_factory=dict)
    lifecycle: str | None = None
    min_trust: float = 0.0
    allowed: DataFrame | None = None


def not_deprecated() -> Column:
    return F.col("status") != "deprecated"


def not_session() -> Column:
    """Claims of unknown durability stay."""
    return F.coalesce(F.lower(F.trim("durability")) != "session", F.lit(True))


def valid_at(at: Column) -> Column:
    """The validity interval is half-open, and open where an end is null."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))


def in_scope(scope: dict[str, str]) -> Column:
    out = F.lit(True)
    for name, wanted in scope.items():
        if wanted:
            out = out & (F.col(f"scope_{name}") == wanted)
    return out


def visible(viewer: str) -> Column:
    return F.coalesce("visibility", F.lit("team")).isin(VISIBLE_TO[viewer])


def effective_time() -> Column:
    return F.coalesce("last_verified", "valid_from", "created_at")


def decisiveness() -> Column:
    """How one-sided the test results of a claim of a requirement are, 0 without results; null for other claims."""
    return F.when(F.coalesce(F.col("requirement") != "", F.lit(False)), F.coalesce(scoring.pass_ratio(F.col("pass_count"), F.col("fail_count")), F.lit(0.0)))


def rescored(claims: DataFrame, now: Column) -> DataFrame:
    """Claims with trust replaced by their credibility; a missing trust column or null counts as unknown."""
    base = scoring.clamp01(F.col("trust")) if "trust" in claims.columns else F.lit(0.0)
    age = scoring.days_between(effective_time(), now)
    live = scoring.liveness(age, base)
    weight = F.coalesce(*[F.when(live == k, v) for k, v in LIVENESS_WEIGHTS.items()], F.lit(0.5))
    score = scoring.credibility(base, scoring.clamp01(F.col("source_authority")), F.col("citation_count"), age, weight, decisiveness() if "requirement" in claims.columns else F.lit(None).cast("double"))
    return claims.withColumn("trust", score)


def admit(claims: DataFrame, a: Admission) -> DataFrame:
    """The whole chain as one filter on rescored claims, and a semi join for the allow-list."""
    out = rescored(claims.where(not_deprecated() & not_session()), a.now)
    keep = in_scope(a.scope) & visible(a.visibility) & (F.col("trust") >= a.min_trust)
    if a.lifecycle:
        keep = keep & (F.col("lifecycle") == a.lifecycle)
    if not a.history:
        keep = keep & valid_at(a.now if a.valid_at is None else a.valid_at)
    if a.recorded_at is not None:
        keep = keep & (F.col("created_at") <= a.recorded_at)
    out = out.where(keep)
    return allowed(out, a.allowed)


def allowed(claims: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Claims of ids (claim_id); without a list all, with an empty one none."""
    return claims if ids is None else claims.join(ids.select("claim_id"), "claim_id", "left_semi")


def overlapping(claims: DataFrame, start: Column, end: Column, limit: int = 1000) -> DataFrame:
    """Claims valid at some time from start to end, earliest first."""
    w = (F.col("valid_from").isNull() | (F.col("valid_from") < end)) & (F.col("valid_to").isNull() | (F.col("valid_to") > start))
    return claims.where(w).orderBy("valid_from", "claim_id").limit(limit)


def sharing_token(claims: DataFrame, question: str) -> DataFrame:
    """Claims that share a word with the question; a question without words keeps all."""
    words = F.array_distinct(doc_tokens(F.lit(question)))
    return claims.where((F.size(words) == 0) | F.arrays_overlap(doc_tokens(F.col("text")), words))
