"""Aggregates over the whole store: calibration, lessons, experts, bias, gaps and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import scoring
from siltstone.functions.text import token_set

# Fixed values of lessons and playbooks.
LEAST_CLUSTER, LEAST_CONFIDENCE, LEAST_CONSISTENCY, RECENCY_DAYS = 3, 0.55, 2 / 3, 90.0


def calibration_bins(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """bin (ten by confidence, 1.0 in the last), n, mean confidence and share validated, of claims with a verdict
    (claim_id, kind)."""
    x = claims.join(verdicts, "claim_id").select("confidence", (F.col("kind") == "validates").cast("double").alias("hit"))
    return x.groupBy(F.least(F.floor(F.col("confidence") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg("hit").alias("accuracy"), F.avg(F.pow(F.col("confidence") - F.col("hit"), 2)).alias("brier"))


def calibration_summary(bins: DataFrame) -> DataFrame:
    """n, expected calibration error and Brier score over calibration_bins."""
    n = F.sum("n")
    return bins.agg(n.alias("n"), (F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))) / n).alias("ece"), (F.sum(F.col("n") * F.col("brier")) / n).alias("brier"))


def lessons(actions: DataFrame, now: Column, least_consistency: float = LEAST_CONSISTENCY, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """Clusters of actions by subject and kind whose results agree: confidence is consistency times corroboration times
    recency. Actions without a known result don't count."""
    known = actions.where("result <> 'unknown'")
    by_result = known.groupBy("subject", "kind", "result").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))
    c = by_result.groupBy("subject", "kind").agg(F.sum("n").alias("total"), F.max(F.struct("n", "result")).alias("top"), F.max("latest").alias("latest"))
    consistency = F.col("top.n") / F.col("total")
    recency = F.exp(-F.greatest(scoring.days_between(F.col("latest"), now), F.lit(0.0)) * F.log(F.lit(2.0)) / RECENCY_DAYS)
    x = c.select("subject", "kind", "total", F.col("top.result").alias("result"), consistency.alias("consistency"), (consistency * (1 - F.exp(-F.col("total") / 3.0)) * recency).alias("confidence"))
    x = x.where((F.col("total") >= LEAST_CLUSTER) & (F.col("consistency") >= least_consistency) & (F.col("confidence") >= least_confidence))
    return x.withColumn("lesson_id", scoring.short_id("ls_", F.col("subject"), F.col("kind")))


def playbooks(lesson_rows: DataFrame) -> DataFrame:
    """Lessons grouped by trigger (their kind): the mean confidence, a little more for each further lesson."""
    p = lesson_rows.groupBy("kind").agg(F.count("*").alias("lessons"), F.avg("confidence").alias("mean"), F.array_join(F.array_sort(F.collect_list("lesson_id")), ",").alias("derived_from"))
    p = p.withColumn("confidence", F.least(F.lit(0.95), F.col("mean") + 0.05 * (F.col("lessons") - 1)))
    return p.where(F.col("confidence") >= LEAST_CONFIDENCE).withColumn("playbook_id", scoring.short_id("pb_", F.col("kind")))


def success_rate(actions: DataFrame, by: str) -> DataFrame:
    """Mean of success 1, partial 0.5, failure 0 where at least two results are known."""
    value = F.when(F.col("result") == "success", 1.0).when(F.col("result") == "partial", 0.5).when(F.col("result") == "failure", 0.0)
    return actions.groupBy(by).agg(F.count(value).alias("known"), F.avg(value).alias("rate")).where("known >= 2")


def experts(claims: DataFrame, topic: str) -> DataFrame:
    """Authors by how much of a topic's words their live claims hold: affinity relative to the best."""
    words = token_set(F.lit(topic))
    x = claims.where(F.col("valid_to").isNull()).select("created_by", "trust", F.size(F.array_intersect(token_set(F.col("text")), words)).alias("overlap")).where("overlap > 0")
    g = x.groupBy("created_by").agg(F.sum("overlap").alias("overlap"), F.avg("trust").alias("mean_trust"), F.count("*").alias("n"))
    top = g.agg(F.max("overlap").alias("top"))
    return g.join(F.broadcast(top), F.lit(True)).select("created_by", "n", "overlap", "mean_trust", (F.col("overlap") / F.col("top")).alias("affinity"))


def source_shares(events: DataFrame) -> DataFrame:
    """Each author's share of all events."""
    g = events.groupBy("created_by").agg(F.count("*").alias("n"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("total"))), F.lit(True)).select("created_by", "n", (F.col("n") / F.col("total")).alias("share"))


def half_spans(events: DataFrame, by: str) -> DataFrame:
    """The shortest span of seconds that holds half of each group's events."""
    w = Window.partitionBy(by).orderBy("ts", "event_id")
    numbered = events.select(by, "ts", "event_id", F.row_number().over(w).alias("rn"))
    half = numbered.groupBy(by).agg(F.floor(F.count("*") / 2).alias("half"), F.count("*").alias("n"))
    a = numbered.join(half, by)
    b = numbered.select(by, F.col("rn").alias("end_rn"), F.col("ts").alias("end_ts"))
    spans = a.join(b, (a[by] == b[by]) & (b["end_rn"] == a["rn"] + a["half"])).select(a[by], "n", (F.unix_seconds("end_ts") - F.unix_seconds("ts")).alias("span"))
    return spans.groupBy(by).agg(F.first("n").alias("n"), F.min("span").alias("span"))


def contradiction_degrees(edges: DataFrame) -> DataFrame:
    """claim_id, degree: contradicting edges at either end."""
    ends = edges.where("type = 'contradicts'").select(F.explode(F.array("from_id", "to_id")).alias("claim_id"))
    return ends.groupBy("claim_id").agg(F.count("*").alias("degree"))


def gaps(claims: DataFrame, limit: int = 20) -> DataFrame:
    """Live claims that matter, are little trusted and stale; claims have trust, staleness and event_count."""
    worth = scoring.salience(F.col("confidence"), F.coalesce("event_count", F.lit(0)), F.col("type"), F.col("source_authority"), F.col("verify_count"))
    x = claims.where(F.col("valid_to").isNull()).select("claim_id", scoring.gap_score(worth, F.col("trust"), F.col("staleness")).alias("gap"))
    return x.orderBy(F.desc(F.round("gap", 9)), "claim_id").limit(limit)


def store_counts(claims: DataFrame, events: DataFrame, edges: DataFrame) -> DataFrame:
    c = claims.agg(F.count("*").alias("claims"), F.count_if(F.col("status") == "contested").alias("contested"), F.avg("confidence").alias("mean_confidence"), F.avg("citation_count").alias("mean_citations"))
    e = events.agg(F.count("*").alias("events"), F.countDistinct("run_id").alias("runs"))
    r = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("type") == "contradicts").alias("contradictions"))
    return c.join(e, F.lit(True)).join(r, F.lit(True))


def vitals(claims: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row of shares: live, grounded (with evidence), contested, stale, promoted, and contradictions to a claim."""
    grounded = evidence.select("claim_id").distinct().withColumn("has", F.lit(1))
    x = claims.join(grounded, "claim_id", "left")
    n = F.count("*")
    v = x.agg(n.alias("n"), (F.count_if(F.col("valid_to").isNull()) / n).alias("live"), (F.count("has") / n).alias("grounded"), (F.count_if(F.col("status") == "contested") / n).alias("contested"), (F.count_if(F.col("staleness") >= 0.7 - 1e-9) / n).alias("stale"), (F.count_if(F.col("lifecycle") == "promoted") / n).alias("promoted"))
    c = edges.agg(F.count_if(F.col("type") == "contradicts").alias("contradictions"))
    return v.join(c, F.lit(True)).withColumn("contradiction_rate", F.col("contradictions") / F.col("n"))


def answer_confidence(claims: DataFrame, contradiction_count: Column, now: Column) -> DataFrame:
    """One row: confidence of an answer from its claims' trust, number and age, less for contradictions."""
    hours = F.greatest(scoring.days_between(F.col("created_at"), now) * 24, F.lit(0.0))
    n = F.count("*")
    raw = 0.4 * F.avg("trust") + 0.2 * F.least(n / 5.0, F.lit(1.0)) - F.least(0.1 * F.max(contradiction_count), F.lit(0.3)) + 0.1 * F.avg(1 - F.least(hours / 720, F.lit(1.0)))
    return claims.agg(n.alias("claims"), F.when(n == 0, 0.0).otherwise(scoring.clamp01(F.coalesce(raw, F.lit(0.0)))).alias("confidence"))


def threshold_verdict(metrics: Column, thresholds: dict[str, float]) -> Column:
    """`failure` if a metric of a map is over its threshold, else `success`; metrics without a threshold say nothing."""
    over = [F.coalesce(F.try_element_at(metrics, F.lit(name)) > most, F.lit(False)) for name, most in thresholds.items()]
    return F.when(F.array_contains(F.array(*over), True), "failure").otherwise("success")


def beliefs_of(decisions: DataFrame) -> DataFrame:
    """decision_id, belief_id of decisions (decision_id, beliefs: an array), each pair once."""
    return decisions.select("decision_id", F.explode("beliefs").alias("belief_id")).distinct()


def action_surprises(outcomes: DataFrame, decisions: DataFrame, expectations: DataFrame) -> DataFrame:
    """action_id, surprise: of outcomes (action_id, outcome_id) the greatest surprise of an expectation (belief_id, surprise)
    that a decision (decision_id, outcome_id, beliefs) on that outcome rests on."""
    rests = decisions.select("outcome_id", F.explode("beliefs").alias("belief_id")).join(expectations, "belief_id").groupBy("outcome_id").agg(F.max("surprise").alias("surprise"))
    return outcomes.join(rests, "outcome_id").groupBy("action_id").agg(F.max("surprise").alias("surprise"))


def polarity_skew(events: DataFrame, by: str, polarity: Column) -> DataFrame:
    """by, positive, negative, skew: the difference over their sum, null without either."""
    g = events.groupBy(by).agg(F.count_if(polarity > 0).alias("positive"), F.count_if(polarity < 0).alias("negative"))
    both = F.col("positive") + F.col("negative")
    return g.withColumn("skew", F.when(both > 0, (F.col("positive") - F.col("negative")) / both))


def single_sourced(pairs: DataFrame, key: str, source: str) -> DataFrame:
    """key, top_source, share: which source gives most of each key's rows, ties to the first by name, and what share."""
    g = pairs.groupBy(key, source).agg(F.count("*").alias("n"))
    return g.groupBy(key).agg(F.min_by(source, F.struct(-F.col("n"), source)).alias("top_source"), (F.max("n") / F.sum("n")).alias("share"))


def bounded(scanned: DataFrame, considered: DataFrame, available: DataFrame, limit: int, most: int = 200) -> DataFrame:
    """One row on a bounded answer: scanned, considered, available, limit (at most `most`), truncated and its reasons."""
    cap = min(limit, most)
    counts = scanned.agg(F.count("*").alias("scanned")).join(considered.agg(F.count("*").alias("considered")), F.lit(True)).join(available.agg(F.count("*").alias("available")), F.lit(True))
    reasons = F.array_compact(F.array(
        F.when(F.lit(limit > most) & (F.col("available") > cap), "limit_capped"), F.when(F.col("considered") < F.col("scanned"), "candidate_cap"), F.when(F.col("available") > cap, "result_limit")))
    return counts.withColumn("limit", F.lit(cap)).withColumn("reasons", F.array_join(reasons, ",")).withColumn("truncated", F.col("reasons") != "")


def playbook_rates(lessons: DataFrame, actions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """playbook, scored, rate: from playbooks (playbook, lesson) over lessons (lesson, action_id) to outcomes (action_id,
    outcome_id, result), each outcome of a playbook once; success counts 1, partial a half, failure 0, unknown nothing."""
    value = F.when(F.col("result") == "success", 1.0).when(F.col("result") == "partial", 0.5).when(F.col("result") == "failure", 0.0)
    of = lessons.join(actions.distinct(), "lesson").select("playbook", "action_id").distinct()
    x = of.join(outcomes.select("action_id", "outcome_id", value.alias("value")).where("value is not null"), "action_id").groupBy("playbook", "outcome_id").agg(F.max("value").alias("value"))
    return x.groupBy("playbook").agg(F.count("*").alias("scored"), F.avg("value").alias("rate"))


def source_gaps(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """created_by, n, gap: mean confidence less the share validated, of each author's claims with a verdict."""
    x = claims.join(verdicts, "claim_id")
    return x.groupBy("created_by").agg(F.count("*").alias("n"), (F.avg("confidence") - F.avg((F.col("kind") == "validates").cast("double"))).alias("gap"))
