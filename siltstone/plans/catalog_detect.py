"""Queries of detectors, junk, health, promotion, recall control and analogies; see catalog. Those without SQL are compared
with brute force in tests."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import model
from siltstone.functions import detect as says
from siltstone.functions import noise, scoring, text
from siltstone.model import now, table
from siltstone.operators import detect, graph, health, promote, recall, relate
from siltstone.plans.catalog import BINS_SQL, TRUST_SQL, Store, query, rounded
from siltstone.plans.catalog_more import _questions, _quoted, words_sql
from siltstone.sources.shared import stored, written

# --- what statements say

WORDS_SQL = r""", ws AS (SELECT claim_id, unnest(regexp_split_to_array(text, '\s+')) AS raw, generate_subscripts(regexp_split_to_array(text, '\s+'), 1) AS i FROM kb_claims),
around AS (SELECT claim_id, i, raw, trim(raw, ',.;:!?()[]{}"''') AS bare, lag(raw) OVER (PARTITION BY claim_id ORDER BY i) AS prev, trim(lead(raw) OVER (PARTITION BY claim_id ORDER BY i), ',.;:!?()[]{}"''') AS next FROM ws)
"""


@query(WORDS_SQL + rf""", said AS (SELECT claim_id, lower(bare) IN (SELECT unnest({words_sql(text.NEGATIONS)})) AND NOT coalesce(right(prev, 1) IN (',', ';', '—', '–') OR prev IN ('-', '—', '–'), false)
  AND NOT coalesce(lower(next) IN (SELECT unnest({words_sql(says.HEDGES_AFTER_NOT)})), false) AS no FROM around)
SELECT claim_id, bool_or(no) AS denied FROM said GROUP BY 1""")
def o102_denied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).claims.select("claim_id", says.denied(F.col("text")).alias("denied"))


@query(None)
def o116_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Store(spark, sf_dir).claims.select("claim_id", F.explode(says.measures(F.col("text"))).alias("m"))
    return x.select("claim_id", F.col("m.value").alias("value"), F.col("m.unit").alias("unit"))


def _aspect_sql() -> str:
    def any_of(marks: list[str]) -> str:
        return f"bool_or(w IN (SELECT unnest({words_sql(marks)})) OR stem IN (SELECT unnest({words_sql(marks)})))"

    cases = " ".join(f"WHEN {any_of(marks)} THEN '{kind}'" for kind, marks in says.ASPECTS.items())
    stem = "CASE WHEN strlen(w) > 5 AND (ends_with(w, 'ed') OR ends_with(w, 'es')) THEN left(w, length(w) - 2) WHEN strlen(w) > 4 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END"
    return f", st AS (SELECT claim_id, w, {stem} AS stem FROM (SELECT claim_id, lower(bare) AS w FROM around WHERE bare <> '')) SELECT claim_id, CASE {cases} END AS aspect FROM st GROUP BY 1"


@query(WORDS_SQL + _aspect_sql())
def o117_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).claims.select("claim_id", says.aspect(F.col("text")).alias("aspect"))


@query(WORDS_SQL + rf""" SELECT claim_id, count(DISTINCT lower(bare)) AS names FROM around WHERE regexp_full_match(bare, '\p{{Lu}}\p{{L}}*') AND NOT lower(bare) IN (SELECT unnest({words_sql(text.STOP_WORDS)}))
  AND ((i > 1 AND NOT regexp_matches(prev, '[.!?]$')) OR coalesce(lower(next) IN ('is', 'are', 'was', 'were', '''s'), false)) AND NOT regexp_matches(lower(bare), '(ed|es|s)$') GROUP BY 1""")
def o118_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names of each claim that has any, but for those with an ending that stems lose."""
    x = Store(spark, sf_dir).claims.select("claim_id", F.explode(says.named(F.col("text"))).alias("name"))
    return x.where(~F.col("name").rlike("(ed|es|s)$")).groupBy("claim_id").agg(F.count("*").alias("names"))


# --- relations


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return stored(spark, f"{sf_dir}/documents.parquet", "relations", lambda: detect.relations(s.claims.select("claim_id", "text", "durability")))


@query(None)
def o200_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all claims, by the detectors in their order."""
    return _relations(spark, sf_dir).select("from_id", "to_id", "type")


for _name, _detector in (("o202_number_contradictions", "numbers"), ("o203_name_contradictions", "names"), ("o204_aspect_contradictions", "aspects")):

    def _by_detector(spark: SparkSession, sf_dir: str, detector: str = _detector) -> DataFrame:
        return detect.relations_by(Store(spark, sf_dir).claims.select("claim_id", "text", "durability"), detector).select("from_id", "to_id")

    _by_detector.__name__ = _name
    query(None)(_by_detector)


@query(None)
def o205_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(spark, sf_dir).groupBy("detector", "type").agg(F.count("*").alias("n"))


@query(None)
def o206_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs each claim is compared with."""
    f = detect.features(Store(spark, sf_dir).claims.select("claim_id", "text"))
    return detect.candidates(f, f).groupBy(F.col("a").alias("claim_id")).agg(F.count("*").alias("pairs"))


@query(None)
def o208_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.causes(Store(spark, sf_dir).claims.select("claim_id", "text", F.coalesce("valid_from", "created_at").alias("at")))


@query(None)
def o209_contested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within batches of one document."""
    c = Store(spark, sf_dir).claims.select("claim_id", "text", F.floor(F.col("claim_id") / model.ROOM).cast("string").alias("batch"))
    return relate.contested(c, "batch")


@query(None)
def o212_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    first = s.evidence.groupBy("claim_id").agg(F.min("event_id").cast("string").alias("run_id"))
    return relate.no_longer_contested(s.claims, first)


@query(None)
def o211_edge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return detect.still_contradicting(s.edges, s.claims.where("claim_id % 9 <> 0"))


@query("""SELECT from_id, to_id, e.type FROM kb_edges e JOIN kb_claims a ON a.claim_id = from_id JOIN kb_claims b ON b.claim_id = to_id
  WHERE e.type <> 'contradicts' OR (coalesce(nullif(a.created_by, 'u0') <> nullif(b.created_by, 'u0'), true) AND coalesce(nullif(a.scope_env, 'x') = nullif(b.scope_env, 'x'), true))""")
def o210_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors stand for sessions (u0: unknown) and environments for workspaces."""
    s = Store(spark, sf_dir)
    scopes = s.claims.select("claim_id", F.when(F.col("created_by") != "u0", F.col("created_by")).alias("session"), F.col("scope_env").alias("workspace"))
    return detect.in_scope_contradictions(s.edges, scopes).select("from_id", "to_id", "type")


# --- junk


def _content_words_sql(t: str) -> str:
    return f"len(list_filter(list_transform(regexp_split_to_array(lower({t}), '\\s+'), lambda w: trim(w, ',.;:!?()[]{{}}\"''-')), lambda w: strlen(w) >= 2 AND NOT list_contains({words_sql(noise.SHORT_STOPS)}, w)))"


def _matches(column: str, *patterns: str) -> str:
    return " OR ".join(f"regexp_matches({column}, {_quoted(p)})" for p in patterns)


JUNK_SQL = rf""", ta AS (SELECT claim_id, status, trim(text) AS t, trim(regexp_replace(trim(text), '[\p{{So}}\p{{Sm}}\p{{Sk}}]', '', 'g')) AS p FROM kb_claims),
tb AS (SELECT *, trim(rtrim(p, ':')) AS lab, trim(rtrim(t, ':')) AS lead FROM ta),
junk AS (SELECT claim_id, status, p = '' OR {_matches("p", noise.GREETING, noise.ACKNOWLEDGED)} OR {_matches("t", noise.STATUS_EMOJI)} OR (ends_with(p, ':') AND (lab = '' OR {_content_words_sql("lab")} <= 4))
  OR {_matches("p", noise.NARRATION, noise.ABOUT_CLAIMS)} OR (lead <> t AND lead <> '' AND {_content_words_sql("lead")} > 4 AND NOT regexp_matches(lead, '[={{}}]')) OR {_matches("p", noise.STATUS_CHATTER)} OR {_content_words_sql("p")} < 2 AS junk FROM tb)
"""


@query(JUNK_SQL + "SELECT claim_id, junk FROM junk")
def o110_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).claims.select("claim_id", noise.is_junk(F.col("text")).alias("junk"))


@query(JUNK_SQL + "SELECT claim_id, 'deprecated' AS status FROM junk WHERE junk AND status IN ('active', 'contested')")
def o251_prune_narration(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Store(spark, sf_dir).claims.where(F.col("status").isin("active", "contested") & noise.is_junk(F.col("text")))
    return c.select("claim_id", F.lit("deprecated").alias("status"))


FIELDS_SQL = r"list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')"
NOISE_SQL = rf"""starts_with(t, '#') OR regexp_full_match(t, '[-*> ]*') OR regexp_full_match(replace(t, ' ', ''), '-{{3,}}') OR starts_with(t, '```') OR (ends_with(t, ':') AND n <= 2) OR (n <= 5 AND {_matches("t", noise.LABEL)})
  OR length(t) - length(replace(t, '|', '')) >= 2 OR (length(t) - length(replace(t, '|', '')) = 1 AND (contains(t, '@') OR contains(t, '+1-'))) OR (starts_with(t, '{{') AND ends_with(t, '}}'))
  OR (n BETWEEN 2 AND 4 AND len(list_filter(f, lambda w: regexp_full_match(w, '[0-9]+') OR regexp_matches(w, '^[A-Z]'))) = n) OR (n <= 4 AND ({" OR ".join(f"starts_with(lower(t), '{p}')" for p in noise.SALUTATIONS)})) OR {_content_words_sql("t")} < 2"""


@query(f"SELECT event_id, pos, {NOISE_SQL} AS noise FROM (SELECT event_id, pos, t, {FIELDS_SQL} AS f, len({FIELDS_SQL}) AS n FROM (SELECT event_id, pos, trim(raw) AS t FROM raw_sentences))")
def o109_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir).events.select("event_id", F.posexplode(text.sentences(F.col("content"))).alias("pos", "raw"))
    return s.select("event_id", F.col("pos").cast("long").alias("pos"), noise.is_noise(F.col("raw")).alias("noise"))


@query(None)
def o108_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements of each document after clean-up."""
    return Store(spark, sf_dir).events.select("event_id", F.posexplode(noise.candidates(F.col("content"))).alias("pos", "statement"))


@query("SELECT event_id, props AS json FROM events", False)
def o126_repaired_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties wrapped as models wrap them: after thoughts, in a fence, or amid prose."""
    p = F.col("props")
    n = F.col("event_id") % 3
    answer = (
        F.when(n == 0, F.concat(F.lit("<think>a [ or {\n</think>\nSo:\n```json\n"), p, F.lit("\n``` and more {")))
        .when(n == 1, F.concat(F.lit("The answer is "), p, F.lit(" as asked, not {x}."))).otherwise(F.concat(F.lit(" \n"), p, F.lit("\n")))
    )
    return table(spark, sf_dir, "events").select("event_id", noise.repaired_json(answer).alias("json"))


# --- health

PE_SQL = BINS_SQL + r""", hyper AS (SELECT count(*) AS n FROM kb_edges e JOIN trusted a ON a.claim_id = e.from_id JOIN trusted b ON b.claim_id = e.to_id WHERE e.type = 'contradicts' AND a.valid_to IS NULL AND b.valid_to IS NULL AND a.status <> 'deprecated' AND b.status <> 'deprecated'
  AND (CASE WHEN a.trust + (a.lifecycle = 'promoted')::INT >= b.trust + (b.lifecycle = 'promoted')::INT THEN a.lifecycle ELSE b.lifecycle END = 'promoted' OR CASE WHEN a.trust + (a.lifecycle = 'promoted')::INT >= b.trust + (b.lifecycle = 'promoted')::INT THEN a.trust ELSE b.trust END >= 0.7)),
levels AS (SELECT 'outcome' AS level, 1 AS o, count(*) AS samples, avg(least(abs(l_discount - l_tax)::DOUBLE / 0.02 / 2, 1)) AS error FROM lineitem
  UNION ALL SELECT 'schema', 2, count(*), avg(least(s / 2, 1)) FROM (SELECT max(abs(l_discount - l_tax)::DOUBLE / 0.02) AS s FROM lineitem GROUP BY l_suppkey)
  UNION ALL SELECT 'dissonance', 3, (SELECT count(*) FROM kb_claims), least(n / (SELECT count(*) FROM kb_claims), 1) FROM hyper
  UNION ALL SELECT 'calibration', 4, sum(n)::BIGINT, sum(n * abs(mean_confidence - accuracy)) / sum(n) FROM bins)
"""


def _error_levels(s: Store) -> DataFrame:
    """Predictions are line items; generalisations are suppliers with their greatest surprise."""
    l = table(s.spark, s.sf_dir, "lineitem").select("l_suppkey", scoring.surprise(F.col("l_discount").cast("double"), F.col("l_tax").cast("double"), F.lit(0.02)).alias("surprise"))
    schemas = l.groupBy("l_suppkey").agg(F.max("surprise").alias("surprise"))
    return health.error_levels(l, schemas, s.trusted, s.edges, model.kb_verdicts(s.claims))


@query(TRUST_SQL + PE_SQL + "SELECT level, samples, round(error, 6) AS error, (SELECT round(avg(error), 6) FROM levels) AS total, (SELECT level FROM levels ORDER BY error DESC, o LIMIT 1) AS hotspot FROM levels")
def o065_predictive_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = _error_levels(Store(spark, sf_dir))
    return levels.join(F.broadcast(health.total_error(levels)), F.lit(True)).select("level", "samples", rounded("error").alias("error"), rounded("total").alias("total"), "hotspot")


def _decay_sql(days: int) -> str:
    age = f"((1706745600 - greatest(valid_from, last_verified)) / 86400.0::DOUBLE + {days})"
    scale = "CASE WHEN half_life_days > 0 THEN half_life_days ELSE 90 END"
    return f"greatest(0, least(1, confidence * (1 + 0.2 * ln(greatest(event_count, 1))) * CASE WHEN {age} <= 0 THEN 1.0 ELSE greatest(0.3, exp(-{age} / ({scale}))) END))"


HEALTH_SQL = TRUST_SQL + PE_SQL + rf""", live AS (SELECT *, {_decay_sql(0)} >= 0.3 AS firm, {_decay_sql(30)} < 0.3 AS falls FROM trusted WHERE valid_to IS NULL AND status <> 'deprecated'),
h AS (SELECT count(*) AS valid, count(*) FILTER (trust < 0.3) AS low, count(*) FILTER ((1706745600 - greatest(created_at, last_verified)) / 86400.0 > 90) AS old, count(*) FILTER (event_count = 0) AS orphans, count(*) FILTER (firm) AS firm, count(*) FILTER (firm AND falls) AS falling FROM live),
v AS (SELECT 'free_energy' AS name, (SELECT avg(error) FROM levels) AS value, 0.4 AS warn, 0.7 AS crit, false AS turned UNION ALL SELECT 'calibration', error, 0.15, 0.3, false FROM levels WHERE level = 'calibration' UNION ALL SELECT 'dissonance', error, 0.05, 0.15, false FROM levels WHERE level = 'dissonance'
  UNION ALL SELECT 'low_trust', low / valid, 0.3, 0.6, false FROM h UNION ALL SELECT 'staleness', old / valid, 0.4, 0.7, false FROM h UNION ALL SELECT 'trust_decay', falling / firm, 0.1, 0.2, false FROM h
  UNION ALL SELECT 'skill_coverage', (SELECT count(*) FILTER (result <> 'unknown') / count(*) FROM kb_actions), 0.5, 0.9, true),
vit AS (SELECT name, value, CASE WHEN CASE WHEN turned THEN 1 - value ELSE value END >= crit THEN 'unhealthy' WHEN CASE WHEN turned THEN 1 - value ELSE value END >= warn THEN 'degraded' ELSE 'ok' END AS status FROM v),
late AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < DATE '1997-01-01'),
path AS (SELECT 'orphan_claims' AS name, orphans::DOUBLE AS value, CASE WHEN orphans > 0 THEN 'degraded' ELSE 'ok' END AS status FROM h UNION ALL SELECT 'dangling_edges', 0.0, 'ok'
  UNION ALL SELECT 'stale_expectations', n::DOUBLE, CASE WHEN n >= 25 THEN 'unhealthy' WHEN n > 0 THEN 'degraded' ELSE 'ok' END FROM late),
every AS (SELECT * FROM vit UNION ALL SELECT * FROM path)
"""


def _health(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Open orders are open predictions, past their time before 1997."""
    s = Store(spark, sf_dir)
    counts = health.claim_counts(s.trusted, now())
    open_orders = table(spark, sf_dir, "orders").select((F.col("o_orderstatus") != "O").alias("resolved"), F.to_timestamp(F.col("o_orderdate").cast("date")).alias("horizon"))
    vitals = health.vitals(_error_levels(s), counts, s.actions)
    return vitals, health.pathologies(counts, s.edges, s.claims, open_orders, F.to_timestamp(F.lit("1997-01-01")))


@query(HEALTH_SQL + "SELECT name, round(value, 6) AS value, status, (SELECT CASE WHEN bool_or(status = 'unhealthy') THEN 'unhealthy' WHEN bool_or(status = 'degraded') THEN 'degraded' ELSE 'ok' END FROM every) AS overall FROM every")
def o074_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, p = _health(spark, sf_dir)
    rows = v.unionByName(p)
    return rows.join(F.broadcast(health.overall(rows).withColumnRenamed("status", "overall")), F.lit(True)).select("name", rounded("value").alias("value"), "status", "overall")


# --- components of confidence


def _components(c: DataFrame) -> DataFrame:
    """Claims with a map of components: salience for one in four, inhibition for one in three, credits for one in five."""
    n = F.col("claim_id")

    def entry(key: str, each: int, value: Column) -> Column:
        return F.when(n % each == 1, F.create_map(F.lit(key), value.cast("double"))).otherwise(F.from_json(F.lit("{}"), "map<string,double>"))

    return c.select("claim_id", F.map_concat(entry("salience", 4, n % 15 / 10.0 - 0.2), entry("inhibition", 3, n % 50 / 100.0), entry("credit:d", 5, F.lit(0.1))).alias("components"))


@query("SELECT claim_id, round(CASE WHEN claim_id % 4 = 1 THEN greatest(0, least(1, claim_id % 15 / 10.0 - 0.2)) ELSE 0.5 END, 6)::DOUBLE AS salience, round(CASE WHEN claim_id % 3 = 1 THEN claim_id % 50 / 100.0 ELSE 0 END, 6)::DOUBLE AS inhibition FROM kb_claims")
def o137_explicit_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("components")
    return _components(Store(spark, sf_dir).claims).select("claim_id", rounded(scoring.explicit_salience(m)).alias("salience"), rounded(scoring.inhibition(m)).alias("inhibition"))


@query("""SELECT claim_id, CASE WHEN claim_id % 3 = 1 AND claim_id % 50 / 200.0 >= 0.01 THEN round(claim_id % 50 / 200.0, 6)::DOUBLE END AS decayed, round(least(CASE WHEN claim_id % 3 = 1 THEN claim_id % 50 / 100.0 ELSE 0 END + 0.1, 0.5), 6)::DOUBLE AS suppressed FROM kb_claims""")
def o148_inhibition(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("components")
    return _components(Store(spark, sf_dir).claims).select("claim_id", rounded(F.try_element_at(scoring.decayed_inhibition(m), F.lit("inhibition"))).alias("decayed"), rounded(F.try_element_at(scoring.suppressed(m), F.lit("inhibition"))).alias("suppressed"))


@query("SELECT claim_id, (claim_id % 4 = 1)::INT + (claim_id % 3 = 1)::INT + 2 AS keys, 0.3::DOUBLE AS credit FROM kb_claims")
def o154_replaced_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `credit:` entries give way to fresh ones; the others stay."""
    fresh = F.create_map(F.lit("credit:e"), F.lit(0.1), F.lit("credit:f"), F.lit(0.2))
    x = _components(Store(spark, sf_dir).claims).select("claim_id", scoring.with_credits(F.col("components"), fresh).alias("m"))
    return x.select("claim_id", F.size("m").alias("keys"), rounded(F.aggregate(F.map_values(F.map_filter("m", lambda k, v: k.startswith("credit:"))), F.lit(0.0), lambda a, v: a + v)).alias("credit"))


# --- promotion


def _lessons(s: Store) -> DataFrame:
    """Every claim is a lesson of each source that it has evidence in; individual subjects are not eligible."""
    tenants = s.evidence.join(s.events.select("event_id", F.col("created_by").alias("tenant")), "event_id").where("tenant is not null").select("claim_id", "tenant").distinct()
    c = s.claims.select("claim_id", F.col("text").alias("statement"), "confidence", (F.col("visibility") != "personal").alias("eligible"), (F.col("claim_id") % 20 / 10.0).alias("surprise"), F.col("scope_service").alias("scope"), F.when(F.col("claim_id") % 9 == 0, "negative").alias("polarity"))
    return tenants.join(c, "claim_id").withColumnRenamed("claim_id", "lesson_id")


@query(None)
def o187_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Store(spark, sf_dir).claims.select(F.col("claim_id").alias("member_id"), "text", F.struct("text", "claim_id").alias("order"))
    return promote.clusters(c)


@query(None)
def o230_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    tenants = s.events.where("created_by is not null").select(F.col("created_by").alias("tenant")).distinct()
    terms = spark.createDataFrame([("acme corp",), ("thand",)], "term string")
    known = s.claims.where("lifecycle = 'promoted'").select("claim_id", "text")
    out = promote.promotion(_lessons(s), promote.denied_terms(terms, tenants), known)
    return promote.released(out, 0.6).select("anchor_id", "outcome", "statement", "tenants", rounded("confidence").alias("confidence"), "scope", "polarity", "rank")


@query(None)
def o232_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Store(spark, sf_dir).claims.where("visibility <> 'personal'").select("claim_id", "text", "confidence")
    return promote.knowledge_schemas(c).select("schema_id", "statement", rounded("confidence").alias("confidence"), "evidence")


@query(None)
def o229_assimilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of hypotheses against promoted ones."""
    c = Store(spark, sf_dir).claims
    schemas = c.where("lifecycle = 'promoted'").select(F.col("claim_id").cast("string").alias("schema_id"), "text")
    x = promote.assimilated(c.where("type = 'hypothesis'").select("claim_id", "text"), schemas)
    return x.select("claim_id", "fit", rounded("similarity").alias("similarity"), rounded("boost").alias("boost"))


@query("SELECT created_by, CASE WHEN bool_or(visibility = 'personal') THEN 'individual' WHEN bool_or(visibility = 'org') THEN 'unknown' ELSE 'class' END AS subject FROM kb_claims GROUP BY 1")
def o233_subject_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("visibility") == "personal", "individual").when(F.col("visibility") == "team", "class").otherwise("")
    return Store(spark, sf_dir).claims.groupBy("created_by").agg(promote.subject_class(F.collect_set(kind)).alias("subject"))


# --- recall


def _recall_store(spark: SparkSession, sf_dir: str) -> recall.Store:
    s = Store(spark, sf_dir)
    return recall.Store(model.kb_index(spark, sf_dir), model.kb_sizes(spark, sf_dir), model.kb_claim_index(spark, sf_dir), model.kb_claim_sizes(spark, sf_dir), s.trusted, s.evidence, s.edges)


@query(None)
def o170_hybrid_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by words and vectors: a claim has the vector of its first event, a question every hundredth vector."""
    store = _recall_store(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "embedding")
    first = store.evidence.groupBy("claim_id").agg(F.min("event_id").alias("vec_id"))
    asked = vectors.where("vec_id % 100 = 0").select(F.floor(F.col("vec_id") / 100).alias("question_id"), F.col("embedding").alias("vector"))
    questions = _questions(spark, sf_dir).join(asked, "question_id", "left")
    found = recall.recall(replace(store, claim_vectors=first.join(vectors, "vec_id").select("claim_id", "embedding")), questions, recall.Options(now(), hops=1))
    return found.select("question_id", "claim_id", "hop", "rank", rounded("trust").alias("trust"))


@query(None)
def o170_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, graded = recall.corrected(_recall_store(spark, sf_dir), _questions(spark, sf_dir), recall.Options(now(), min_trust=0.55))
    return graded.select("question_id", "claims", rounded("confidence").alias("confidence"), "sufficient")


@query(None)
def o172_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, graded = recall.with_effort(_recall_store(spark, sf_dir), _questions(spark, sf_dir), recall.Options(now(), min_trust=0.55, limit=3), 0.9)
    return graded.select("question_id", "claims", rounded("confidence").alias("confidence"), "sufficient", rounded("budget").alias("budget"), "passes", "hops", "breadth")


@query(None)
def o173_context_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of a question is its worst-ranked claim."""
    store = _recall_store(spark, sf_dir)
    results = written(recall.recall(store, _questions(spark, sf_dir), recall.Options(now())), "recalled")
    context = results.groupBy("question_id").agg(F.max_by("claim_id", "rank").alias("claim_id"))
    return recall.with_context(store, results, context).select("question_id", "claim_id", "rank", rounded("score").alias("score"))


@query(None)
def o174_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _recall_store(spark, sf_dir)
    results = written(recall.recall(store, _questions(spark, sf_dir), recall.Options(now(), limit=50)), "recalled")
    return recall.conflicts(store, results).withColumn("against_trust", rounded("against_trust"))


@query(None)
def o175_iterative(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, took = recall.iterative(_recall_store(spark, sf_dir), _questions(spark, sf_dir), recall.Options(now(), min_trust=0.55, limit=2))
    return found.select("question_id", "claim_id", "rank").join(took, "question_id")


@query(None)
def o176_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, q = _recall_store(spark, sf_dir), _questions(spark, sf_dir)
    results = written(recall.recall(store, q, recall.Options(now(), limit=3)), "recalled")
    return recall.classified(recall.confidences(store, results, q, now()), results).withColumn("confidence", rounded("confidence"))


# --- analogies


@query(None)
def o184_analogies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the least claim that has an edge."""
    s = Store(spark, sf_dir)
    anchor = s.edges.agg(F.min("from_id")).first()[0]
    if anchor is None:
        return s.edges.select(F.col("from_id").alias("claim_id"), F.lit(0.0).alias("similarity")).limit(0)
    return graph.analogies(s.edges, s.claims.select("claim_id", F.col("type").alias("role")), anchor).withColumn("similarity", rounded("similarity"))
