"""Joins of claims with what supports them, and the scores that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import scoring


def claims_of_events(claims: DataFrame, evidence: DataFrame, events: DataFrame) -> DataFrame:
    """Claims with evidence in the events: a semi join, so no claim twice."""
    return claims.join(evidence.join(events.select("event_id"), "event_id", "left_semi"), "claim_id", "left_semi")


def trust_inputs(claims: DataFrame, evidence: DataFrame, events: DataFrame) -> DataFrame:
    """claim_id, sources (distinct authors), event_count, latest (time): pre-aggregated on (claim, author) so that the
    distinct count needs no second pass over the pairs."""
    pairs = evidence.join(events.select("event_id", F.col("created_by").alias("author"), "ts"), "event_id")
    by_author = pairs.groupBy("claim_id", "author").agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
    inputs = by_author.groupBy("claim_id").agg(F.count("*").alias("sources"), F.sum("n").alias("event_count"), F.max("ts").alias("latest"))
    return claims.select("claim_id").join(inputs, "claim_id", "left").select("claim_id", F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("event_count", F.lit(0)).alias("event_count"), "latest")


def with_trust(claims: DataFrame, inputs: DataFrame, now: Column, own_half_life: bool = False) -> DataFrame:
    """Claims with trust by confidence, effective evidence and freshness."""
    return trusted(claims.join(inputs, "claim_id", "left"), now, own_half_life)


def trusted(x: DataFrame, now: Column, own_half_life: bool = False) -> DataFrame:
    """The same of claims that have their inputs already."""
    n = F.greatest(scoring.effective_evidence(F.col("sources"), F.col("event_count")), F.lit(1))
    age = scoring.days_between(F.greatest("latest", "last_verified"), now)
    fresh = scoring.freshness(age, F.col("half_life_days").cast("double")) if own_half_life else scoring.freshness(age)
    return x.withColumn("trust", scoring.trust(F.col("confidence"), n, fresh)).withColumn("staleness", 1 - fresh)


def latest_verdict(verdicts: DataFrame) -> DataFrame:
    """claim_id, kind, at of the latest verdict; of two at one time, `validates`."""
    best = F.max_by(F.struct("kind", "at"), F.struct("at", "kind"))
    return verdicts.groupBy("claim_id").agg(best.alias("v")).select("claim_id", "v.kind", "v.at")


def edges_touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end in ids (claim_id): two equi-joins, as one join on either end would compare all pairs."""
    left = edges.join(ids.select(F.col("claim_id").alias("from_id")), "from_id", "left_semi").select(edges.columns)
    right = edges.join(ids.select(F.col("claim_id").alias("to_id")), "to_id", "left_semi").select(edges.columns)
    return left.unionByName(right).distinct()


def contradictions(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """Contradicting pairs of live claims, with both texts and trusts."""
    live = claims.where(F.col("valid_to").isNull() & (F.col("status") != "deprecated"))
    a = live.select(F.col("claim_id").alias("from_id"), F.col("text").alias("from_text"), F.col("trust").alias("from_trust"), F.col("lifecycle").alias("from_lifecycle"))
    b = live.select(F.col("claim_id").alias("to_id"), F.col("text").alias("to_text"), F.col("trust").alias("to_trust"), F.col("lifecycle").alias("to_lifecycle"))
    return edges.where("type = 'contradicts'").join(a, "from_id").join(b, "to_id")


def dangling(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """Edges with an end that is no claim, each once."""
    ids = claims.select("claim_id")
    known_from = edges.join(ids.withColumnRenamed("claim_id", "from_id"), "from_id", "left_semi")
    known = known_from.join(ids.withColumnRenamed("claim_id", "to_id"), "to_id", "left_semi").select("from_id", "to_id", "type")
    return edges.join(known, ["from_id", "to_id", "type"], "left_anti")


def repointed(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with ends replaced by mapping (old_id, new_id); self loops go, and of equal edges the one with the least old
    ends stays."""
    x = edges.join(mapping.select(F.col("old_id").alias("from_id"), F.col("new_id").alias("new_from")), "from_id", "left").join(mapping.select(F.col("old_id").alias("to_id"), F.col("new_id").alias("new_to")), "to_id", "left")
    x = x.withColumn("new_from", F.coalesce("new_from", "from_id")).withColumn("new_to", F.coalesce("new_to", "to_id")).where("new_from <> new_to")
    first = Window.partitionBy("type", "new_from", "new_to").orderBy("from_id", "to_id")
    return x.withColumn("rn", F.row_number().over(first)).where("rn = 1").select(F.col("new_from").alias("from_id"), F.col("new_to").alias("to_id"), "type", "strength")


def hypercorrections(edges: DataFrame, claims: DataFrame, min_trust: float = 0.7) -> DataFrame:
    """Contradictions of a well-established claim: the challenged end is the one of greater trust plus 1 if promoted (a
    tie: the first), and it is promoted or has at least min_trust."""
    def standing(end: str) -> Column:
        return F.col(f"{end}_trust") + F.when(F.col(f"{end}_lifecycle") == "promoted", 1.0).otherwise(0.0)

    first = standing("from") >= standing("to")

    def of(name: str, challenged: bool) -> Column:
        return F.when(first == F.lit(challenged), F.col(f"from_{name}")).otherwise(F.col(f"to_{name}"))

    x = contradictions(edges, claims).select(
        of("id", True).alias("challenged"), of("id", False).alias("challenger"), of("trust", True).alias("challenged_trust"), of("trust", False).alias("challenger_trust"), of("lifecycle", True).alias("lifecycle"))
    return x.where((F.col("lifecycle") == "promoted") | (F.col("challenged_trust") >= min_trust))


def resolved(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """Contradictions of live claims with a winner and how it was found. Of two test results of one requirement the later
    run wins if it came a day later, then the more one-sided one; then, and for other claims, the greater confidence, then
    the greater trust; else none, to escalate. Fixed values: a day, margins of 0.2, 0.2 and 0.05, confidence of at least 0.7."""
    ends = claims.select("claim_id", "confidence", "requirement", "last_run_at", F.coalesce(scoring.pass_ratio(F.col("pass_count"), F.col("fail_count")), F.lit(0.0)).alias("ratio"))
    x = contradictions(edges, claims)
    for end in ("from", "to"):
        x = x.join(ends.select(*(F.col(c).alias(f"{end}_id" if c == "claim_id" else f"{end}_{c}") for c in ends.columns)), f"{end}_id")

    def gap(name: str) -> Column:
        return F.abs(F.col(f"from_{name}") - F.col(f"to_{name}"))

    def better(name: str) -> Column:
        return F.when(F.col(f"from_{name}") >= F.col(f"to_{name}"), F.col("from_id")).otherwise(F.col("to_id"))

    tests = F.coalesce((F.col("from_requirement") == F.col("to_requirement")) & (F.col("from_requirement") != ""), F.lit(False))
    apart = F.coalesce(F.abs(F.unix_micros("from_last_run_at") - F.unix_micros("to_last_run_at")) >= 86_400_000_000, F.lit(False))
    sure = (F.col("from_confidence") >= 0.7) & (F.col("to_confidence") >= 0.7) & (gap("confidence") >= 0.2 - 1e-12)
    how = F.when(tests & apart, "recency").when(tests & (gap("ratio") >= 0.2 - 1e-12), "tests").when(sure, "confidence").when(gap("trust") >= 0.05, "trust").otherwise("escalate")
    by = {"recency": "last_run_at", "tests": "ratio", "confidence": "confidence", "trust": "trust"}
    winner = F.coalesce(*[F.when(F.col("how") == h, better(name)) for h, name in by.items()])
    return x.withColumn("how", how).withColumn("winner", winner)


def why_trust(claims: DataFrame, now: Column) -> DataFrame:
    """claim_id, score and its signals (name, value, weight) of claims with trust: what credibility is made of. Tests count
    for claims of a requirement only; without them the other weights are scaled up."""
    from siltstone.operators import admission

    base, authority = scoring.clamp01(F.col("trust")), scoring.clamp01(F.col("source_authority"))
    age = scoring.days_between(admission.effective_time(), now)
    live = F.coalesce(*[F.when(scoring.liveness(age, base) == k, v) for k, v in admission.LIVENESS_WEIGHTS.items()], F.lit(0.5))
    tests = admission.decisiveness()
    scale = F.when(tests.isNull(), 1 / 0.93).otherwise(1.0)
    values = {
        "trust": (F.when(base == 0, 0.5).otherwise(base), 0.50), "authority": (F.when(authority == 0, 0.5).otherwise(authority), 0.15), "citations": (scoring.clamp01(F.log1p(F.col("citation_count").cast("double")) / F.log(F.lit(11.0))), 0.13),
        "recency": (F.exp(-F.greatest(age, F.lit(0.0)) / 180.0), 0.10), "liveness": (live, 0.05),
    }
    signals = F.array(*[F.struct(F.lit(name).alias("name"), value.alias("value"), (weight * scale).alias("weight")) for name, (value, weight) in values.items()])
    signals = F.when(tests.isNull(), signals).otherwise(F.array_append(signals, F.struct(F.lit("tests").alias("name"), tests.alias("value"), F.lit(0.07).alias("weight"))))
    x = claims.select("claim_id", signals.alias("signals"))
    return x.select("claim_id", scoring.clamp01(F.aggregate("signals", F.lit(0.0), lambda a, s: a + s["value"] * s["weight"])).alias("score"), "signals")


def wrong_beliefs(incidents: DataFrame, decisions: DataFrame, claims: DataFrame) -> DataFrame:
    """incident_id, root_text, root_trust, decisions of incidents (incident_id, root_cause_id, decision_ids): the claim that
    caused each, null where it is unknown or gone, and how many of the named decisions there are."""
    named = incidents.select("incident_id", F.explode("decision_ids").alias("decision_id")).distinct().join(decisions.select("decision_id"), "decision_id", "left_semi")
    counted = named.groupBy("incident_id").agg(F.count("*").alias("decisions"))
    roots = claims.select(F.col("claim_id").alias("root_cause_id"), F.col("text").alias("root_text"), F.col("trust").alias("root_trust"))
    x = incidents.select("incident_id", "root_cause_id").join(roots, "root_cause_id", "left").join(counted, "incident_id", "left")
    return x.select("incident_id", "root_text", "root_trust", F.coalesce("decisions", F.lit(0)).alias("decisions"))


def audit_trail(decisions: DataFrame, service: str | None = None, risk: str | None = None, successful: bool = False) -> DataFrame:
    """Decisions (with scope_service, risk, failed_outcome_id) whose outcome failed, or all; of one service or risk."""
    out = decisions if successful else decisions.where("failed_outcome_id is not null")
    out = out if service is None else out.where(F.col("scope_service") == service)
    return out if risk is None else out.where(F.col("risk") == risk)


def auto_edges(pairs: DataFrame, outcomes: DataFrame, decisions: DataFrame) -> DataFrame:
    """from_id, type, to_id: an outcome and its action both ways (pairs: action_id, outcome_id); and from a decision's outcome
    (outcome_id, result) to each of its beliefs, validated by success and refuted by failure. Each edge once."""
    ways = [pairs.select(F.col("outcome_id").alias("from_id"), F.lit("outcome_of").alias("type"), F.col("action_id").alias("to_id")), pairs.select(F.col("action_id").alias("from_id"), F.lit("action_of").alias("type"), F.col("outcome_id").alias("to_id"))]
    kind = F.when(F.col("result") == "success", "validates").when(F.col("result") == "failure", "refutes")
    judged = decisions.select("outcome_id", F.explode("beliefs").alias("to_id")).join(outcomes.select("outcome_id", kind.alias("type")).where("type is not null"), "outcome_id")
    return ways[0].unionByName(ways[1]).unionByName(judged.select(F.col("outcome_id").alias("from_id"), "type", "to_id")).distinct()


def origins(links: DataFrame, events: DataFrame) -> DataFrame:
    """claim_id, origin of claims with evidence in the events (event_id, pulled_from): the first registry by name that any of
    them was pulled from, else local."""
    x = links.join(events, "event_id")
    return x.groupBy("claim_id").agg(F.coalesce(F.min(F.when(F.col("pulled_from") != "", F.col("pulled_from"))), F.lit("local")).alias("origin"))
