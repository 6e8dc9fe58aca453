"""Consolidation: what is forgotten, reinforced, strengthened, promoted or floated back; conflicts of test results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import scoring
from siltstone.functions.text import alnum_key, is_repo_local, volatility_days
from siltstone.operators import evidence
from siltstone.sources.shared import written

# What forgetting spares, the cap of a belief's credit, and float-back.
SPARED_SALIENCE, CREDIT_CAP = 0.66, 0.3
FLOATBACK_TRUST = 0.6


def to_forget(claims: DataFrame, below: float) -> DataFrame:
    """Live claims of little trust and worth that aren't promoted; claims have trust and event_count."""
    worth = scoring.salience(F.col("confidence"), F.coalesce("event_count", F.lit(0)), F.col("type"), F.col("source_authority"), F.col("verify_count"))
    return claims.where(F.col("valid_to").isNull() & (F.col("lifecycle") != "promoted") & (F.col("trust") < below) & (worth < SPARED_SALIENCE))


def apply_verdicts(claims: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """Refuted claims end now; validated ones count a verification."""
    x = claims.join(verdicts.select("claim_id", "kind"), "claim_id", "left")
    return x.withColumn("valid_to", F.when(F.col("kind") == "refutes", now).otherwise(F.col("valid_to"))).withColumn("verify_count", F.col("verify_count") + (F.coalesce(F.col("kind") == "validates", F.lit(False))).cast("int"))


def split_credit(rows: DataFrame, decision: str, belief: str, credit: str) -> DataFrame:
    """Each belief's credit: a decision's is split evenly over its beliefs, sums are capped."""
    n = F.count("*").over(Window.partitionBy(decision))
    shared = rows.select(belief, (F.col(credit) / n).alias("part"))
    return shared.groupBy(belief).agg(F.greatest(F.lit(-CREDIT_CAP), F.least(F.lit(CREDIT_CAP), F.sum("part"))).alias("credit"))


def strengthened(edges: DataFrame, active: DataFrame, by: float, cap: float = 10.0, decay: float = 0.8) -> DataFrame:
    """Edges with both ends active gain strength up to a cap; others decay towards 1."""
    a = active.select(F.col("claim_id").alias("from_id"), F.lit(True).alias("from_active"))
    b = active.select(F.col("claim_id").alias("to_id"), F.lit(True).alias("to_active"))
    x = edges.join(a, "from_id", "left").join(b, "to_id", "left")
    both = F.col("from_active").isNotNull() & F.col("to_active").isNotNull()
    return x.withColumn("strength", F.when(both, F.least(F.col("strength") + by, F.lit(cap))).otherwise(1 + (F.col("strength") - 1) * decay)).drop("from_active", "to_active")


def test_conflicts(claims: DataFrame) -> DataFrame:
    """a, b, type of claims (requirement, scope, pass_count, fail_count) with test results under one requirement: opposite
    results contradict, like ones support. Claims of different scopes have no relation; an empty scope goes with any."""
    x = claims.where("requirement <> '' and pass_count <> fail_count").select("claim_id", "requirement", F.coalesce("scope", F.lit("")).alias("scope"), F.signum(F.col("pass_count") - F.col("fail_count")).alias("net"))
    a, b = (x.select(F.col("claim_id").alias(end), "requirement", F.col("net").alias(f"net_{end}"), F.col("scope").alias(f"scope_{end}")) for end in ("a", "b"))
    fits = (F.col("scope_a") == F.col("scope_b")) | (F.col("scope_a") == "") | (F.col("scope_b") == "")
    return a.join(b, "requirement").where((F.col("a") < F.col("b")) & fits).select("a", "b", F.when(F.col("net_a") == F.col("net_b"), "supports").otherwise("contradicts").alias("type"))


def floatback(claims: DataFrame, least_trust: float = FLOATBACK_TRUST) -> DataFrame:
    """Claims with a decision: the first reason against floating them back to the global store, or `float`."""
    keyed = claims.withColumn("alnum", alnum_key(F.col("text"))).withColumn("is_active", F.col("status") == "active")
    first = Window.partitionBy("is_active", "alnum").orderBy("claim_id")
    decision = (
        F.when(~F.col("is_active"), "inactive").when(F.col("alnum") == "", "empty").when(F.row_number().over(first) > 1, "duplicate")
        .when(F.col("trust") < least_trust, "low_trust").when(is_repo_local(F.col("text")), "repo_local").otherwise("float")
    )
    return keyed.withColumn("decision", decision)


def winners_by(claims: DataFrame, key: str, close: float = 0.05) -> DataFrame:
    """The most trusted claim of each key, and whether the next one is too close to tell."""
    w = Window.partitionBy(key).orderBy(F.desc(F.round("trust", 9)), "claim_id")
    x = claims.select(key, "claim_id", F.row_number().over(w).alias("rn"), (F.col("trust") - F.lead("trust").over(w)).alias("gap"))
    return x.where("rn = 1").select(key, F.col("claim_id").alias("winner"), F.coalesce(F.col("gap") < close, F.lit(False)).alias("ambiguous"))


def classified(rows: DataFrame, column: str, table: list[tuple[str, str]], otherwise: str) -> DataFrame:
    """Rows with the kind of the first part of the table that their text has."""
    q = F.lower(column)
    return rows.withColumn("kind", F.coalesce(*[F.when(F.contains(q, F.lit(part)), kind) for part, kind in table], F.lit(otherwise)))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their rank from 1 in a global order: positions within ordered ranges plus the rows of the ranges before,
    so no task gets all rows."""
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("in_range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ranked")
    sizes = dealt.groupBy("in_range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("in_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.join(F.broadcast(before), "in_range").withColumn("rank", F.col("before") + F.col("at") - F.col("first") + 1).drop("in_range", "at", "n", "first", "before")


def curiosity(claims: DataFrame, degrees: DataFrame, limit: int) -> DataFrame:
    """Live claims worth asking about, most urgent first: the first reason of contested, unresolved (a column, for open
    predictions), stale and low_trust, what to do, and the priority: worth times doubt and staleness, more for
    contradictions, unresolved predictions and over-confident sources (overconfidence, 0 to 1)."""
    worth = scoring.salience(F.col("confidence"), F.coalesce("event_count", F.lit(0)), F.col("type"), F.col("source_authority"), F.col("verify_count"))
    x = claims.where(F.col("valid_to").isNull()).join(degrees, "claim_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    open_factor = F.when(F.col("unresolved"), 1.25).otherwise(1.0) * (1 + 0.5 * scoring.clamp01(F.col("overconfidence")))
    priority = worth * scoring.clamp01(1 - F.col("trust")) * (0.3 + 0.7 * scoring.clamp01(F.col("staleness"))) * (1 + 0.15 * F.least(F.col("degree"), F.lit(4))) * open_factor
    reason = F.when(F.col("degree") > 0, "contested").when(F.col("unresolved"), "unresolved_hypothesis").when(F.col("staleness") >= 0.7 - 1e-9, "stale").when(F.col("trust") <= 0.4, "low_trust")
    action = F.when(F.col("degree") > 0, "resolve").otherwise("verify")
    return x.select("claim_id", reason.alias("reason"), action.alias("action"), priority.alias("priority")).where("reason is not null").orderBy(F.desc(F.round("priority", 9)), "claim_id").limit(limit)


def half_life_plan(claims: DataFrame, version: str) -> DataFrame:
    """claim_id, half_life_days of the claims to stamp: not deprecated, without a half-life, and not stamped by this version
    of the classifier (half_life_by)."""
    todo = (F.col("status") != "deprecated") & (F.coalesce("half_life_days", F.lit(0)) == 0) & (F.coalesce("half_life_by", F.lit("")) != version)
    return claims.where(todo).select("claim_id", volatility_days(F.col("type"), F.col("text")).alias("half_life_days"))


def consolidate(tables: dict[str, DataFrame], now: Column, below: float, replay: int = 50) -> tuple[dict[str, DataFrame], DataFrame]:
    """One pass over the store in its fixed order; new versions of its tables, written, and one row of what each step did.

    tables: claims (with components, a map), evidence, events, edges, merges (old_id, new_id), verdicts, credits (claim_id,
    key, credit), surprises (claim_id, surprise), risks (claim_id, risk, result), actions. Steps: merge duplicates, trust,
    credit, salience, rank for replay, forget stale, forget refuted, reinforce validated, lessons, playbooks and their
    success, freshen the replayed, decay edges, decay inhibition, journal."""
    from siltstone.operators import analytics

    links = tables["evidence"].join(tables["merges"].withColumnRenamed("old_id", "claim_id"), "claim_id", "left").select(F.coalesce("new_id", "claim_id").alias("claim_id"), "event_id").distinct()
    edges = evidence.repointed(tables["edges"], tables["merges"])
    left = tables["claims"].join(tables["merges"].select(F.col("old_id").alias("claim_id")), "claim_id", "left_anti")
    trusted = written(evidence.with_trust(left, evidence.trust_inputs(left, links, tables["events"]), now), "trusted")
    sums = tables["credits"].groupBy("claim_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("credit:"), "key"), "credit"))).alias("fresh"), F.sum("credit").alias("total"))
    capped = F.greatest(F.lit(-CREDIT_CAP), F.least(F.lit(CREDIT_CAP), F.coalesce("total", F.lit(0.0))))
    x = trusted.join(sums, "claim_id", "left").withColumn("components", scoring.with_credits(F.col("components"), F.coalesce("fresh", F.from_json(F.lit("{}"), "map<string,double>"))))
    x = x.withColumn("trust", scoring.clamp01(F.col("trust") + capped)).withColumn("credited", F.col("total").isNotNull()).drop("fresh", "total")
    worst = tables["risks"].groupBy("claim_id").agg(F.max(scoring.outcome_salience(F.col("risk"), F.col("result"))).alias("at_risk"))
    x = x.join(worst, "claim_id", "left").withColumn("components", F.when(F.col("at_risk") > 0, F.map_concat(F.map_filter("components", lambda k, v: k != "salience"), F.create_map(F.lit("salience"), F.col("at_risk")))).otherwise(F.col("components")))
    live = F.col("valid_to").isNull() & (F.col("status") != "deprecated")
    age = F.greatest(scoring.days_between(F.col("created_at"), now), F.lit(0.0))
    felt = x.join(tables["surprises"].groupBy("claim_id").agg(F.max("surprise").alias("surprise")), "claim_id", "left")
    priority = scoring.replay_priority(scoring.explicit_salience(F.col("components")), age, scoring.saturated(F.coalesce("surprise", F.lit(0.0))))
    replayed = written(felt.where(live).select("claim_id", priority.alias("priority")).orderBy(F.desc(F.round("priority", 9)), "claim_id").limit(replay).select("claim_id"), "replayed")
    stale = written(to_forget(x, below).join(F.broadcast(replayed), "claim_id", "left_anti").select("claim_id"), "stale")
    judged = evidence.latest_verdict(tables["verdicts"]).select("claim_id", "kind")
    x = x.join(stale.withColumn("is_stale", F.lit(True)), "claim_id", "left").join(judged, "claim_id", "left").join(F.broadcast(replayed.withColumn("is_replayed", F.lit(True))), "claim_id", "left")
    refuted = (F.col("kind") == "refutes") & F.col("valid_to").isNull() & F.col("is_stale").isNull()
    validated = (F.col("kind") == "validates") & F.col("valid_to").isNull() & F.col("is_stale").isNull()
    flags = {"refuted": F.coalesce(refuted, F.lit(False)), "validated": F.coalesce(validated, F.lit(False))}
    x = written(x.withColumns(flags), "judged")
    lessons = analytics.lessons(tables["actions"], now)
    playbooks = analytics.playbooks(lessons)
    rates = analytics.success_rate(tables["actions"], "kind").join(playbooks.select("kind"), "kind", "left_semi")
    dimmed = F.coalesce(scoring.inhibition(F.col("components")) > 0, F.lit(False))
    done = [
        tables["merges"].agg(F.count("*").alias("merged")),
        x.agg(F.count("*").alias("trust_refreshed"), F.count_if("credited").alias("credited"), F.count_if(F.col("at_risk") > 0).alias("salience_tagged"), F.count("is_stale").alias("forgotten"), F.count_if("refuted").alias("refuted"), F.count_if("validated").alias("validated"), F.count("is_replayed").alias("replayed"), F.count_if(dimmed).alias("inhibition_decayed")),
        lessons.agg(F.count("*").alias("lessons")), playbooks.agg(F.count("*").alias("playbooks")), rates.agg(F.count("*").alias("playbooks_reinforced")), edges.agg(F.count("*").alias("associations_decayed")),
    ]
    report = done[0]
    for row in done[1:]:
        report = report.join(row, F.lit(True))
    closed = F.when(F.col("is_stale") | F.col("refuted"), now).otherwise(F.col("valid_to"))
    seen_now = F.when(F.col("validated") | F.col("is_replayed"), now).otherwise(F.col("last_verified"))
    new = x.withColumns({"valid_to": closed, "last_verified": seen_now, "verify_count": F.col("verify_count") + F.col("validated").cast("int"), "components": scoring.decayed_inhibition(F.col("components"))})
    claims = new.select(*(F.col(c) for c in tables["claims"].columns), "trust")
    decayed = edges.withColumn("strength", 1 + (F.col("strength") - 1) * 0.8)
    return {"claims": written(claims, "claims"), "edges": written(decayed, "edges"), "evidence": written(links, "evidence")}, written(report, "journal")


# What a harness writes into transcripts, and the kinds of commands, first match first.
HARNESS_BLOCKS = [
    r"(?is)<system-reminder>.*?</system-reminder>", r"(?is)<task-notification>.*?</task-notification>", r"(?is)<note>.*?</note>", r"(?is)<command-(?:name|message|args)>.*?</command-(?:name|message|args)>",
    r"(?is)<local-command-(?:stdout|caveat)>.*?</local-command-(?:stdout|caveat)>", r"(?im)^.*This session is being continued from a previous conversation.*$", r"(?im)^Base directory for this skill:.*$",
]
HARNESS_LINES = [
    "[SYSTEM NOTIFICATION - NOT USER INPUT]", "The summary below covers the earlier portion of the conversation", "Resume directly — do not acknowledge the summary", "Resume directly - do not acknowledge the summary",
    "Analysis:", "UserPromptSubmit hook additional context:", "SessionStart hook additional context:", "Caveat: The messages below were generated by the user while running local commands",
    "<system-reminder>", "</system-reminder>", "<task-notification>", "</task-notification>", "<local-command-", "</local-command-",
]
COMMANDS = [
    ("go test", "test"), ("go build", "build"), ("go vet", "vet"), ("golangci-lint", "lint"), ("gofmt", "format"), ("nox scan", "security-scan"), ("gh pr merge", "merge"), ("gh pr create", "open-pr"),
    ("gh release", "release"), ("git push", "push"), ("git commit", "commit"), ("brew upgrade", "upgrade"), ("brew install", "install"), ("npm test", "test"), ("npm run build", "build"), ("pytest", "test"),
    ("cargo test", "test"), ("cargo build", "build"), ("docker build", "build"), ("kubectl apply", "deploy"), ("terraform apply", "deploy"),
]


def cleaned(text: Column) -> Column:
    """A transcript without the harness's blocks and lines."""
    out = text
    for pattern in HARNESS_BLOCKS:
        out = F.regexp_replace(out, pattern, "")
    starts = F.array(*map(F.lit, HARNESS_LINES))
    kept = F.filter(F.split(out, "\n"), lambda line: ~F.exists(starts, lambda p: F.startswith(F.trim(line), p)))
    return F.btrim(F.array_join(kept, "\n"), F.lit(" \t\n\r"))


def tool_actions(uses: DataFrame, results: DataFrame) -> DataFrame:
    """use_id, kind, failed of the known commands (use_id, command) that have a result (use_id, is_error), of several the
    first (at)."""
    kind = F.coalesce(*[F.when(F.contains(F.lower("command"), F.lit(part)), name) for part, name in COMMANDS])
    first = results.groupBy("use_id").agg(F.min_by("is_error", "at").alias("failed"))
    return uses.select("use_id", kind.alias("kind")).where("kind is not null").join(first, "use_id")


def updated(claims: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Claims after updates (claim_id, set_lifecycle, verified, closed; null or false: as it is), at most one for a claim."""
    x = claims.join(updates, "claim_id", "left")
    verified = F.coalesce("verified", F.lit(False))
    new = {"lifecycle": F.coalesce("set_lifecycle", "lifecycle"), "last_verified": F.when(verified, now).otherwise(F.col("last_verified")), "verify_count": F.col("verify_count") + verified.cast("int"), "valid_to": F.coalesce("closed", "valid_to")}
    return x.withColumns(new).drop("set_lifecycle", "verified", "closed")
