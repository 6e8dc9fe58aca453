"""Health of the store: prediction errors by level, vitals, pathologies and the worst of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import scoring
from siltstone.operators import analytics, evidence

# From where a vital is degraded and unhealthy, and the bounds that vitals count by.
BOUNDS = {
    "free_energy": (0.40, 0.70), "calibration": (0.15, 0.30), "dissonance": (0.05, 0.15), "low_trust": (0.30, 0.60), "staleness": (0.40, 0.70), "trust_decay": (0.30 / 3, 0.60 / 3),
    "skill_coverage": (0.50, 0.90),
}
LOW_TRUST, STALE_DAYS, DECAY_DAYS, STALE_EXPECTATIONS = 0.30, 90.0, 30.0, 25
RANKS = ["unknown", "ok", "degraded", "unhealthy"]


def level(rows: DataFrame, name: str) -> DataFrame:
    """One row: level, samples, error of rows with a column `error`, 0 without rows."""
    return rows.agg(F.lit(name).alias("level"), F.count("error").alias("samples"), F.coalesce(F.avg("error"), F.lit(0.0)).alias("error"))


def error_levels(surprises: DataFrame, schemas: DataFrame, claims: DataFrame, edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """level, samples, error: mean surprise of resolved predictions (surprise) and of generalisations (surprise, null:
    none), well-established claims under attack per claim, and the calibration error."""
    outcome = level(surprises.where("surprise is not null").select(scoring.saturated(F.col("surprise")).alias("error")), "outcome")
    schema = level(schemas.where("surprise is not null").select(scoring.saturated(F.col("surprise")).alias("error")), "schema")
    hyper = evidence.hypercorrections(edges, claims).agg(F.count("*").alias("n"))
    counted = claims.agg(F.count("*").alias("samples")).join(F.broadcast(hyper), F.lit(True))
    dissonance = counted.select(F.lit("dissonance").alias("level"), "samples", F.when(F.col("samples") == 0, 0.0).otherwise(F.least(F.col("n") / F.col("samples"), F.lit(1.0))).alias("error"))
    summary = analytics.calibration_summary(analytics.calibration_bins(claims, evidence.latest_verdict(verdicts)))
    calibration = summary.select(F.lit("calibration").alias("level"), F.coalesce("n", F.lit(0)).alias("samples"), F.coalesce(scoring.clamp01(F.col("ece")), F.lit(0.0)).alias("error"))
    return outcome.unionByName(schema).unionByName(dissonance).unionByName(calibration)


def total_error(levels: DataFrame) -> DataFrame:
    """One row: total (the mean of the levels that have samples) and hotspot (the level of greatest error, ties by order)."""
    order = F.array_position(F.array(*map(F.lit, ("outcome", "schema", "dissonance", "calibration"))), F.col("level"))
    known = levels.where("samples > 0")
    return known.agg(F.coalesce(F.avg("error"), F.lit(0.0)).alias("total"), F.max_by("level", F.struct("error", -order)).alias("hotspot"))


def graded(value: Column, name: str) -> Column:
    warn, critical = BOUNDS[name]
    return F.when(value >= critical, "unhealthy").when(value >= warn, "degraded").otherwise("ok")


def live(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("valid_to").isNull() & (F.col("status") != "deprecated"))


def claim_counts(claims: DataFrame, now: Column) -> DataFrame:
    """One row over live claims (with trust and event_count): valid, low_trust, stale, orphans, trusted, and decaying: above
    the floor now and below it in DECAY_DAYS by their own half-life."""
    since = F.greatest("valid_from", "last_verified")

    def trust_after(days: float) -> Column:
        fresh = scoring.freshness(scoring.days_between(since, now) + days, F.col("half_life_days").cast("double"))
        return scoring.trust(F.col("confidence"), F.col("event_count"), fresh)

    trusted = since.isNotNull() & (trust_after(0.0) >= LOW_TRUST)
    old = scoring.days_between(F.greatest("created_at", "last_verified"), now) > STALE_DAYS
    return live(claims).agg(
        F.count("*").alias("valid"), F.count_if(F.col("trust") < LOW_TRUST).alias("low_trust"), F.count_if(old).alias("stale"), F.count_if(F.coalesce("event_count", F.lit(0)) == 0).alias("orphans"),
        F.count_if(trusted).alias("trusted"), F.count_if(trusted & (trust_after(DECAY_DAYS) < LOW_TRUST)).alias("decaying"),
    )


def _rows(one: DataFrame, values: dict[str, tuple[Column, Column]]) -> DataFrame:
    """name, value, status for each of one row's (value, status)."""
    rows = F.array(*[F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), status.alias("status")) for name, (value, status) in values.items()])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def vitals(levels: DataFrame, counts: DataFrame, actions: DataFrame) -> DataFrame:
    """name, value, status of the seven vitals; unknown without samples. actions: result, null or `unknown` where none was
    observed; coverage is better when it is higher."""
    by_level = levels.groupBy().pivot("level", ["dissonance", "calibration"]).agg(F.first("error").alias("error"), F.first("samples").alias("samples"))
    covered = actions.agg(F.count("*").alias("actions"), (F.count_if(F.coalesce("result", F.lit("unknown")) != "unknown") / F.count("*")).alias("coverage"))
    one = total_error(levels).join(by_level, F.lit(True)).join(counts, F.lit(True)).join(covered, F.lit(True))
    valid = F.col("valid")

    def share(name: str, of: Column) -> Column:
        return F.when(of > 0, F.col(name) / of).otherwise(0.0)

    def known(status: Column, samples: Column) -> Column:
        return F.when(samples > 0, status).otherwise("unknown")

    low, stale, decay = share("low_trust", valid), share("stale", valid), share("decaying", F.col("trusted"))
    coverage = F.coalesce("coverage", F.lit(0.0))
    return _rows(one, {
        "free_energy": (F.col("total"), graded(F.col("total"), "free_energy")), "calibration": (F.col("calibration_error"), known(graded(F.col("calibration_error"), "calibration"), F.col("calibration_samples"))),
        "dissonance": (F.col("dissonance_error"), graded(F.col("dissonance_error"), "dissonance")), "low_trust": (low, known(graded(low, "low_trust"), valid)), "staleness": (stale, known(graded(stale, "staleness"), valid)),
        "trust_decay": (decay, known(graded(decay, "trust_decay"), F.col("trusted"))), "skill_coverage": (coverage, known(graded(1 - coverage, "skill_coverage"), F.col("actions"))),
    })


def pathologies(counts: DataFrame, edges: DataFrame, claims: DataFrame, expectations: DataFrame, now: Column) -> DataFrame:
    """name, value, status: live claims without evidence, edges without an end, and open predictions (resolved, horizon)
    past their time."""
    dangling = evidence.dangling(edges, claims).agg(F.count("*").alias("dangling"))
    late = expectations.agg(F.count_if(~F.col("resolved") & (F.col("horizon") < now)).alias("late"))
    one = counts.join(dangling, F.lit(True)).join(late, F.lit(True))
    return _rows(one, {
        "orphan_claims": (F.col("orphans"), F.when(F.col("orphans") > 0, "degraded").otherwise("ok")), "dangling_edges": (F.col("dangling"), F.when(F.col("dangling") > 0, "unhealthy").otherwise("ok")),
        "stale_expectations": (F.col("late"), F.when(F.col("late") >= STALE_EXPECTATIONS, "unhealthy").when(F.col("late") > 0, "degraded").otherwise("ok")),
    })


def overall(rows: DataFrame) -> DataFrame:
    """One row: the worst status; unknown ones make nothing worse, and nothing is ok."""
    rank = F.array_position(F.array(*map(F.lit, RANKS)), F.col("status"))
    return rows.agg(F.get(F.array(*map(F.lit, RANKS)), F.greatest(F.max(rank), F.lit(2)).cast("int") - 1).alias("status"))
