"""Every query of the reference's operators by name, each with SQL for the comparison engine where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import model
from siltstone.functions import text
from siltstone.model import DAY, NOW, SQL, now, table
from siltstone.operators import admission, analytics, evidence, retrieval, store
from siltstone.operators.admission import Admission
from siltstone.sources import normalise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, with_model: bool = True) -> Callable:
    """Registers a query under its function's name, with the SQL's body after the model's frames."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (SQL + sql) if with_model else sql
        return f

    return register


def rounded(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


def seconds(x: str) -> Column:
    return F.unix_seconds(x).alias(x)


class Store:
    """The model's frames of one folder of tables; what is derived is written once and read again."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.events = model.kb_events(spark, sf_dir)

    @property
    def claims(self) -> DataFrame:
        return model.kb_claims(self.spark, self.sf_dir)

    @property
    def evidence(self) -> DataFrame:
        return model.kb_evidence(self.spark, self.sf_dir)

    @property
    def edges(self) -> DataFrame:
        return model.kb_edges(self.spark, self.sf_dir)

    @property
    def actions(self) -> DataFrame:
        return model.kb_actions(self.spark, self.sf_dir)

    @property
    def trusted(self) -> DataFrame:
        """Claims with trust, staleness and trust inputs."""
        return model.kb_trusted(self.spark, self.sf_dir)

    def bm25(self, questions: DataFrame, every_term: bool = False, best: int | None = None) -> DataFrame:
        return retrieval.bm25_by_index(model.kb_index(self.spark, self.sf_dir), model.kb_sizes(self.spark, self.sf_dir), questions, every_term, best)


#: Trust of every claim as SQL, after the model.
TRUST_SQL = r""",
inputs AS (
  SELECT c.claim_id, count(DISTINCT e.created_by) AS sources, count(DISTINCT e.event_id) AS event_count, max(e.ts) AS latest
  FROM kb_claims c LEFT JOIN kb_evidence v USING (claim_id) LEFT JOIN kb_events e USING (event_id) GROUP BY 1),
fresh AS (
  SELECT c.*, i.sources, i.event_count, i.latest, (1706745600 - greatest(i.latest, c.last_verified)) / 86400.0::DOUBLE AS age
  FROM kb_claims c JOIN inputs i USING (claim_id)),
fresh2 AS (SELECT *, CASE WHEN age IS NULL OR age <= 0 THEN 1.0 ELSE greatest(0.3, exp(-age / 90.0)) END AS freshness FROM fresh),
trusted AS (
  SELECT *, greatest(0, least(1, confidence * (1 + 0.2 * ln(greatest(sources + floor(0.5 * (event_count - sources)), 1))) * freshness)) AS trust, 1 - freshness AS staleness FROM fresh2)
"""


# --- sources and normalisers


@query("SELECT doc_id, i - 1 AS chunk_index, sha256(c) AS chunk_sha256 FROM (SELECT doc_id, trim(unnest(p)) AS c, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) WHERE c <> ''", False)
def o003_normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = normalise.text_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", "\n")
    return x.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.sha2("content", 256).alias("chunk_sha256"))


@query("""SELECT '{"row":{"r_regionkey":"' || r_regionkey || '","r_name":"' || r_name || '"}}' AS content FROM region UNION ALL SELECT '{"headers":["r_regionkey","r_name"]}'""", False)
def o004_normalise_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise.csv_rows(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))


@query("SELECT event_id, i - 1 AS item_index, replace(item, ' ', '') AS item FROM (SELECT event_id, unnest(CASE WHEN event_id % 2 = 0 THEN [props, '\"x\"'] ELSE [props] END) AS item, generate_subscripts(CASE WHEN event_id % 2 = 0 THEN [props, 'x'] ELSE [props] END, 1) AS i FROM events)", False)
def o005_normalise_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties as a JSON object, or in an array with another item."""
    p = F.col("props")
    content = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), p, F.lit(', "x"]'))).otherwise(p)
    x = table(spark, sf_dir, "events").select("event_id", F.posexplode(normalise.json_items(content)).alias("item_index", "item"))
    return x.select("event_id", F.col("item_index").cast("long").alias("item_index"), "item")


@query("SELECT event_id, run_id || '/' || created_by || '/text' AS stamp FROM kb_events")
def o006_event_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = normalise.stamped(Store(spark, sf_dir).events, {"run": F.col("run_id"), "source": F.col("created_by")}, "text")
    m = F.col("metadata")
    return x.select("event_id", F.concat_ws("/", m["input_run"], m["input_source"], m["normalized_from"]).alias("stamp"))


@query("SELECT event_id, run_id, created_by FROM kb_events WHERE event_id IN (1, 5, 7, 11)")
def o008_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).events.where(F.col("event_id").isin(1, 5, 7, 11)).select("event_id", "run_id", "created_by")


@query("SELECT event_id, ts FROM kb_events WHERE run_id = 'de'")
def o009_events_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).events.where("run_id = 'de'").select("event_id", seconds("ts"))


@query("SELECT vec_id, 'm' || (label % 3) AS model FROM embeddings WHERE vec_id % 2 = 0 AND label % 3 = 1 AND len(embedding) = 64", False)
def o010_vectors_of_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of even numbers (claims; odd ones are events), those of one model, which labels stand for."""
    e = table(spark, sf_dir, "embeddings").withColumns({"entity_type": F.when(F.col("vec_id") % 2 == 0, "claim").otherwise("event"), "model": F.concat(F.lit("m"), (F.col("label") % 3).cast("string"))})
    return store.vectors_of(e, "claim", "m1", 64).select("vec_id", "model")


@query("""SELECT 'claims' AS kind, claim_id AS id, created_at AS at, (SELECT count(*) FROM kb_claims WHERE created_by = 'u3' AND created_at >= 1690000000) AS n FROM kb_claims WHERE created_by = 'u3' AND created_at >= 1690000000
  UNION ALL SELECT 'relationships', from_id, made_at, (SELECT count(*) FROM kb_edges JOIN kb_claims ON claim_id = from_id WHERE created_by = 'u3' AND made_at >= 1690000000) FROM kb_edges JOIN kb_claims ON claim_id = from_id WHERE created_by = 'u3' AND made_at >= 1690000000
  UNION ALL SELECT 'verdicts', claim_id, decided, (SELECT count(*) FROM kb_verdicts JOIN kb_claims USING (claim_id) WHERE created_by = 'u3' AND decided >= 1690000000) FROM kb_verdicts JOIN kb_claims USING (claim_id) WHERE created_by = 'u3' AND decided >= 1690000000
  UNION ALL SELECT 'events', event_id, ts, (SELECT count(*) FROM kb_events WHERE created_by = 'u3' AND ts >= 1690000000) FROM kb_events WHERE created_by = 'u3' AND ts >= 1690000000
  UNION ALL SELECT 'actions', action_id, us // 1000000, (SELECT count(*) FROM kb_actions WHERE subject = 's3' AND us >= 1690000000000000) FROM kb_actions WHERE subject = 's3' AND us >= 1690000000000000""")
def o016_audit_of_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one author has made since a time, of five kinds; edges and verdicts are their claim's author's."""
    s = Store(spark, sf_dir)
    own = s.claims.select("claim_id", "created_by")
    kinds = {
        "claims": s.claims.select(F.col("claim_id").alias("id"), "created_by", F.col("created_at").alias("at")),
        "relationships": s.edges.join(own.withColumnRenamed("claim_id", "from_id"), "from_id").select(F.col("from_id").alias("id"), "created_by", F.col("made_at").alias("at")),
        "verdicts": model.kb_verdicts(s.claims).join(own, "claim_id").select(F.col("claim_id").alias("id"), "created_by", "at"),
        "events": s.events.select(F.col("event_id").alias("id"), "created_by", F.col("ts").alias("at")),
        "actions": s.actions.select(F.col("action_id").alias("id"), F.regexp_replace("subject", "^s", "u").alias("created_by"), F.col("ts").alias("at")),
    }
    return store.audit(kinds, "u3", F.timestamp_seconds(F.lit(1_690_000_000))).select("kind", "id", seconds("at"), "n")


@query("SELECT claim_id, sha256('---' || chr(10) || 'id: ' || claim_id || chr(10) || 'type: ' || type || chr(10) || 'status: ' || status || chr(10) || '---' || chr(10) || text || chr(10)) AS md_sha256 FROM kb_claims WHERE status = 'active'")
def o017_markdown_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Store(spark, sf_dir).claims.where("status = 'active'")
    return c.select("claim_id", F.sha2(normalise.markdown(F.col("claim_id"), {"type": F.col("type"), "status": F.col("status")}, F.col("text")), 256).alias("md_sha256"))


@query("SELECT o_custkey, count(*) AS n, CASE WHEN max(o_totalprice) > 300000 OR count(*) > 20 THEN 'failure' ELSE 'success' END AS result FROM orders GROUP BY 1", False)
def o018_threshold_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a customer as a map, and a threshold for each."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.create_map(F.lit("greatest"), F.max("o_totalprice").cast("double"), F.lit("orders"), F.count("*").cast("double")).alias("metrics"))
    return o.select("o_custkey", "n", analytics.threshold_verdict(F.col("metrics"), {"greatest": 300_000.0, "orders": 20.0}).alias("result"))


# --- writes


@query("SELECT claim_id, text FROM kb_claims WHERE claim_id % 2 = 0 UNION ALL SELECT claim_id, 'again' FROM kb_claims WHERE claim_id % 2 = 1 AND claim_id % 3 = 0")
def o019_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Store(spark, sf_dir).claims.select("claim_id", "text")
    return store.appended(c.where("claim_id % 2 = 0"), c.where("claim_id % 3 = 0").withColumn("text", F.lit("again")), "claim_id")


@query("""SELECT claim_id, CASE WHEN claim_id % 3 = 0 THEN 'new' ELSE status END AS status, CASE WHEN claim_id % 3 = 0 AND claim_id % 2 = 1 THEN 7 ELSE half_life_days END AS half_life_days,
  CASE WHEN claim_id % 3 = 0 AND claim_id % 5 <> 0 THEN 'svcX' ELSE scope_service END AS scope_service FROM kb_claims""")
def o020_merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Store(spark, sf_dir).claims.select("claim_id", "status", F.col("half_life_days").cast("long").alias("half_life_days"), "scope_service")
    n = F.col("claim_id")
    new = c.where("claim_id % 3 = 0").select("claim_id", F.lit("new").alias("status"), F.when(n % 2 == 1, 7).otherwise(0).cast("long").alias("half_life_days"), F.when(n % 5 != 0, "svcX").otherwise("").alias("scope_service"))
    return store.merged(c, new, "claim_id", ["half_life_days", "scope_service"])


@query("SELECT user_id, arg_max(event_type, (epoch_us(ts), event_id)) AS event_type, max(epoch_us(ts)) AS us FROM events GROUP BY 1", False)
def o021_latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.struct(F.unix_micros("ts").alias("us"), "event_id").alias("at"))
    return store.latest(e, "user_id", "at").select("user_id", "event_type", F.col("at.us").alias("us"))


@query("SELECT 'claims' AS name, count(*) AS n FROM kb_claims WHERE claim_id % 10 <> 1 UNION ALL SELECT 'edges', count(*) FROM kb_edges WHERE from_id % 10 <> 1 AND to_id % 10 <> 1 UNION ALL SELECT 'evidence', count(*) FROM kb_evidence WHERE claim_id % 10 <> 1")
def o022_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    c = s.claims
    left = store.deleted({"claims": c, "edges": s.edges, "evidence": s.evidence}, c.where("claim_id % 10 = 1").select("claim_id"), {"claims": ["claim_id"], "edges": ["from_id", "to_id"], "evidence": ["claim_id"]})
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# --- filters


@query(TRUST_SQL + r""",
scored AS (
  SELECT *, (1706745600 - coalesce(last_verified, valid_from, created_at)) / 86400.0::DOUBLE AS eff_age FROM trusted WHERE status <> 'deprecated' AND durability <> 'session'),
scored2 AS (
  SELECT *, least(1, greatest(0, (0.5 * CASE WHEN trust = 0 THEN 0.5 ELSE trust END + 0.15 * CASE WHEN source_authority = 0 THEN 0.5 ELSE source_authority END
    + 0.13 * least(1, ln(1 + citation_count) / ln(11)) + 0.10 * exp(-greatest(eff_age, 0) / 180.0)
    + 0.05 * CASE WHEN eff_age <= 14 THEN 1.0 WHEN eff_age <= 180 THEN 0.75 WHEN trust >= 0.6 THEN 0.65 ELSE 0.25 END) / CASE WHEN requirement IS NULL THEN 0.93 ELSE 1 END + CASE WHEN requirement IS NULL OR pass_count + fail_count = 0 THEN 0 ELSE 0.07 * abs(pass_count - fail_count) / (pass_count + fail_count)::DOUBLE END)) AS cred FROM scored)
SELECT claim_id, round(cred, 6) AS trust FROM scored2 WHERE scope_service = 'svc1' AND visibility IN ('personal', 'team') AND cred >= 0.4
  AND valid_from <= 1700000000 AND (valid_to IS NULL OR 1700000000 < valid_to) AND created_at <= 1702000000""")
def o033_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_seconds(F.lit(1_700_000_000))
    a = Admission(now(), valid_at=at, recorded_at=F.timestamp_seconds(F.lit(1_702_000_000)), scope={"service": "svc1", "env": ""}, min_trust=0.4)
    return admission.admit(Store(spark, sf_dir).trusted, a).select("claim_id", rounded("trust").alias("trust"))


for _name, _where, _filter in (
    ("o024_not_deprecated", "status <> 'deprecated'", lambda c: c.where(admission.not_deprecated())),
    ("o025_not_session", "durability <> 'session'", lambda c: c.where(admission.not_session())),
    ("o027_scope", "scope_service = 'svc2' AND scope_env = 'prod'", lambda c: c.where(admission.in_scope({"service": "svc2", "env": "prod", "team": ""}))),
    ("o028_visibility", "visibility IN ('personal', 'team')", lambda c: c.where(admission.visible("team"))),
    ("o029_lifecycle", "lifecycle = 'promoted'", lambda c: c.where(F.col("lifecycle") == "promoted")),
    ("o031_valid_at", "valid_from <= 1700000000 AND (valid_to IS NULL OR valid_to > 1700000000)", lambda c: c.where(admission.valid_at(F.timestamp_seconds(F.lit(1_700_000_000))))),
    ("o032_recorded_at", "created_at <= 1695000000", lambda c: c.where(F.col("created_at") <= F.timestamp_seconds(F.lit(1_695_000_000)))),
    ("o037_question_tokens", "len(list_intersect(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: trim(w, ',.;:!?()[]{}\"''')), ['the', 'thing'])) > 0", lambda c: admission.sharing_token(c, "The thing!")),
):

    def _filtered(spark: SparkSession, sf_dir: str, f: Callable = _filter) -> DataFrame:
        return f(Store(spark, sf_dir).claims).select("claim_id")

    _filtered.__name__ = _name
    query(f"SELECT claim_id FROM kb_claims WHERE {_where}")(_filtered)


@query("SELECT claim_id, valid_from FROM kb_claims WHERE valid_from < 1690000000 AND (valid_to IS NULL OR valid_to > 1689000000) ORDER BY valid_from, claim_id LIMIT 1000")
def o034_window_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = admission.overlapping(Store(spark, sf_dir).claims, F.timestamp_seconds(F.lit(1_689_000_000)), F.timestamp_seconds(F.lit(1_690_000_000)))
    return x.select("claim_id", seconds("valid_from"))


@query("SELECT claim_id, created_at FROM kb_claims c WHERE type = 'fact' AND status = 'active' AND EXISTS (SELECT 1 FROM kb_evidence v JOIN kb_events e USING (event_id) WHERE v.claim_id = c.claim_id AND e.run_id = 'en') ORDER BY created_at DESC, claim_id LIMIT 50 OFFSET 50")
def o035_list_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    c = evidence.claims_of_events(s.claims.where("type = 'fact' and status = 'active'"), s.evidence, s.events.where("run_id = 'en'"))
    return c.orderBy(F.desc("created_at"), "claim_id").offset(50).limit(50).select("claim_id", seconds("created_at"))


@query("SELECT event_id, epoch_us(ts) AS us FROM events WHERE event_type IN ('purchase', 'error') AND epoch_us(ts) BETWEEN 1704500000000000 AND 1705500000000000 ORDER BY ts, event_id LIMIT 200", False)
def o036_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error") & F.col("ts").between(F.timestamp_micros(F.lit(1_704_500_000_000_000)), F.timestamp_micros(F.lit(1_705_500_000_000_000))))
    return e.orderBy("ts", "event_id").limit(200).select("event_id", F.unix_micros("ts").alias("us"))


@query("SELECT event_id FROM kb_events WHERE event_id NOT IN (SELECT vec_id FROM embeddings)")
def o040_missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).events.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("event_id")), "event_id", "left_anti").select("event_id")


@query("SELECT c_custkey, lower(c_name) AS name FROM customer WHERE starts_with(lower(c_name), 'customer#00000001')", False)
def o041_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower("c_name")
    return table(spark, sf_dir, "customer").where(name.startswith("customer#00000001")).select("c_custkey", name.alias("name"))


# --- joins


@query("SELECT claim_id FROM kb_claims c WHERE EXISTS (SELECT 1 FROM kb_evidence v JOIN kb_events e USING (event_id) WHERE v.claim_id = c.claim_id AND e.created_by = 'src3')")
def o042_claims_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return evidence.claims_of_events(s.claims, s.evidence, s.events.where("created_by = 'src3'")).select("claim_id")


@query(TRUST_SQL + "SELECT claim_id, sources, event_count, latest FROM inputs")
def o058_trust_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return evidence.trust_inputs(s.claims, s.evidence, s.events).select("claim_id", "sources", "event_count", seconds("latest"))


@query("SELECT c.claim_id, n_nationkey AS entity_id, n_name AS name, CASE WHEN c.claim_id % 2 = 0 THEN 'subject' ELSE 'mention' END AS role FROM kb_claims c JOIN nation ON n_nationkey = c.claim_id % 25 WHERE c.status = 'contested'")
def o044_entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with their entities (nations) by links with a role."""
    c = Store(spark, sf_dir).claims
    links = c.select("claim_id", (F.col("claim_id") % 25).alias("entity_id"), F.when(F.col("claim_id") % 2 == 0, "subject").otherwise("mention").alias("role"))
    entities = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("entity_id"), F.col("n_name").alias("name"))
    return store.claim_entities(c.where("status = 'contested'"), links, entities).select("claim_id", "entity_id", "name", "role")


@query("SELECT from_id, to_id, type FROM kb_edges WHERE from_id IN (SELECT claim_id FROM kb_claims WHERE type = 'decision' AND claim_id % 40 = 2) OR to_id IN (SELECT claim_id FROM kb_claims WHERE type = 'decision' AND claim_id % 40 = 2)")
def o045_edges_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return evidence.edges_touching(s.edges, s.claims.where("type = 'decision' and claim_id % 40 = 2")).select("from_id", "to_id", "type")


LIVE = "valid_to IS NULL AND status <> 'deprecated'"


@query(TRUST_SQL + f"SELECT e.from_id, e.to_id, a.text AS from_text, b.text AS to_text, round(a.trust, 6) AS from_trust, round(b.trust, 6) AS to_trust FROM kb_edges e JOIN trusted a ON a.claim_id = e.from_id JOIN trusted b ON b.claim_id = e.to_id WHERE e.type = 'contradicts' AND a.{LIVE.replace('AND ', 'AND a.')} AND b.{LIVE.replace('AND ', 'AND b.')}")
def o046_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return evidence.contradictions(s.edges, s.trusted).select("from_id", "to_id", "from_text", "to_text", rounded("from_trust").alias("from_trust"), rounded("to_trust").alias("to_trust"))


@query("SELECT subject, kind, result, count(*) AS n FROM kb_actions WHERE result <> 'unknown' GROUP BY ALL")
def o047_actions_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).actions.where("result <> 'unknown'").groupBy("subject", "kind", "result").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS decision_id, l_partkey AS belief_id, min(l_discount)::DOUBLE AS predicted, max(l_tax)::DOUBLE AS observed FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY ALL", False)
def o049_decision_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions (orders, with an array of parts as beliefs) with the expectations of their beliefs that are resolved."""
    l = table(spark, sf_dir, "lineitem")
    beliefs = l.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("beliefs"))
    decisions = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")).join(beliefs, "l_orderkey").select(F.col("l_orderkey").alias("decision_id"), "beliefs")
    expected = l.groupBy(F.col("l_orderkey").alias("decision_id"), F.col("l_partkey").alias("belief_id")).agg(F.min("l_discount").cast("double").alias("predicted"), F.max("l_tax").cast("double").alias("observed"))
    return analytics.beliefs_of(decisions).join(expected, ["decision_id", "belief_id"]).select("decision_id", "belief_id", "predicted", "observed")


@query("SELECT from_id, to_id, type FROM kb_edges WHERE from_id % 9 = 0 OR to_id % 9 = 0")
def o054_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return evidence.dangling(s.edges, s.claims.where("claim_id % 9 <> 0")).select("from_id", "to_id", "type")


@query("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' WHERE epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 0 AND 172800000000", False)
def o056_causal_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.operators.relate import causal_pairs

    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("grp"), "ts", "event_type")
    return causal_pairs(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"))


@query("SELECT key, arg_min(text, tier * 1000000000000 + claim_id) AS text, min(tier) AS tier FROM (SELECT key, text, claim_id, claim_id % 2 AS tier FROM kb_claims) GROUP BY 1")
def o057_tier_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Store(spark, sf_dir).claims.select("key", "text", "claim_id", (F.col("claim_id") % 2).alias("tier"))
    return c.groupBy("key").agg(F.min_by("text", F.struct("tier", "claim_id")).alias("text"), F.min("tier").alias("tier"))


# --- aggregates


@query("SELECT (SELECT count(*) FROM kb_claims) AS claims, (SELECT count(*) FROM kb_claims WHERE status = 'contested') AS contested, (SELECT round(avg(confidence), 6) FROM kb_claims) AS mean_confidence, (SELECT round(avg(citation_count), 6) FROM kb_claims) AS mean_citations, (SELECT count(*) FROM kb_events) AS events, (SELECT count(DISTINCT run_id) FROM kb_events) AS runs, (SELECT count(*) FROM kb_edges) AS edges, (SELECT count(*) FROM kb_edges WHERE type = 'contradicts') AS contradictions")
def o060_store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    x = analytics.store_counts(s.claims, s.events, s.edges)
    return x.withColumn("mean_confidence", rounded("mean_confidence")).withColumn("mean_citations", rounded("mean_citations"))


@query(TRUST_SQL + "SELECT round(avg(trust), 6) AS mean_trust, count(*) FILTER (trust < 0.4) AS low_trust, count(*) FILTER (coalesce(last_verified, created_at) < 1706745600 - 90 * 86400) AS stale FROM trusted")
def o061_memory_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.coalesce("last_verified", "created_at") < F.timestamp_seconds(F.lit(NOW - 90 * DAY))
    return Store(spark, sf_dir).trusted.agg(rounded(F.avg("trust")).alias("mean_trust"), F.count_if(F.col("trust") < 0.4).alias("low_trust"), F.count_if(old).alias("stale"))


@query("SELECT count(DISTINCT user_id) AS active, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY", False)
def o062_week_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.join(F.broadcast(last), F.unix_micros("ts") > F.unix_micros("last") - 7 * DAY * 1_000_000).agg(F.countDistinct("user_id").alias("active"), F.count("*").alias("n"))


LATEST_SQL = ", latest AS (SELECT claim_id, arg_max(kind, decided * 2 + CASE kind WHEN 'validates' THEN 1 ELSE 0 END) AS kind, max(decided) AS decided FROM kb_verdicts GROUP BY 1)"
BINS_SQL = LATEST_SQL + ", bins AS (SELECT least(floor(confidence * 10), 9)::BIGINT AS bin, count(*) AS n, avg(confidence) AS mean_confidence, avg((kind = 'validates')::INT) AS accuracy, avg(pow(confidence - (kind = 'validates')::INT, 2)) AS brier FROM kb_claims JOIN latest USING (claim_id) GROUP BY 1)"


@query(LATEST_SQL + " SELECT claim_id, kind, decided FROM latest")
def o079_latest_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.latest_verdict(model.kb_verdicts(Store(spark, sf_dir).claims)).select("claim_id", "kind", F.unix_seconds("at").alias("decided"))


@query(BINS_SQL + " SELECT bin, n, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy FROM bins")
def o064_calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Store(spark, sf_dir).claims
    b = analytics.calibration_bins(c, evidence.latest_verdict(model.kb_verdicts(c)))
    return b.select("bin", "n", rounded("mean_confidence").alias("mean_confidence"), rounded("accuracy").alias("accuracy"))


@query(BINS_SQL + " SELECT sum(n)::BIGINT AS n, round(sum(n * abs(mean_confidence - accuracy)) / sum(n), 6) AS ece, round(sum(n * brier) / sum(n), 6) AS brier FROM bins")
def o064_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Store(spark, sf_dir).claims
    x = analytics.calibration_summary(analytics.calibration_bins(c, evidence.latest_verdict(model.kb_verdicts(c))))
    return x.select("n", rounded("ece").alias("ece"), rounded("brier").alias("brier"))


LESSONS_SQL = r""",
by_result AS (SELECT subject, kind, result, count(*) AS n, max(us) AS us FROM kb_actions WHERE result <> 'unknown' GROUP BY ALL),
clusters AS (SELECT subject, kind, sum(n) AS total, max(struct_pack(n := n, result := result)) AS top, max(us) AS us FROM by_result GROUP BY ALL),
rated AS (SELECT subject, kind, total, top.result AS result, top.n / total AS consistency, top.n / total * (1 - exp(-total / 3.0)) * exp(-greatest((1706745600000000 - us) / 86400000000.0, 0) * ln(2) / 90.0) AS confidence FROM clusters),
lessons AS (SELECT *, 'ls_' || substr(sha256(subject || '|' || kind), 1, 16) AS lesson_id FROM rated WHERE total >= 3 AND consistency >= 0.3 AND confidence >= 0.2)
"""


def _lessons(s: Store) -> DataFrame:
    """With looser bounds than usual, as the test events rarely agree."""
    return analytics.lessons(s.actions, now(), least_consistency=0.3, least_confidence=0.2)


@query(LESSONS_SQL + "SELECT lesson_id, subject, kind, total::BIGINT AS total, result, round(confidence, 6) AS confidence FROM lessons")
def o067_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lessons(Store(spark, sf_dir)).select("lesson_id", "subject", "kind", "total", "result", rounded("confidence").alias("confidence"))


@query(LESSONS_SQL + "SELECT 'pb_' || substr(sha256(kind), 1, 16) AS playbook_id, count(*) AS lessons, round(least(0.95, avg(confidence) + 0.05 * (count(*) - 1)), 6) AS confidence, string_agg(lesson_id, ',' ORDER BY lesson_id) AS derived_from FROM lessons GROUP BY kind HAVING least(0.95, avg(confidence) + 0.05 * (count(*) - 1)) >= 0.55")
def o068_playbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.playbooks(_lessons(Store(spark, sf_dir))).select("playbook_id", "lessons", rounded("confidence").alias("confidence"), "derived_from")


@query("SELECT subject, count(*) AS known, round(avg(CASE result WHEN 'success' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END), 6) AS rate FROM kb_actions WHERE result <> 'unknown' GROUP BY 1 HAVING count(*) >= 2")
def o069_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.success_rate(Store(spark, sf_dir).actions, "subject").select("subject", "known", rounded("rate").alias("rate"))


@query(TRUST_SQL + r""", hits AS (SELECT created_by, trust, len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda w: length(w) >= 3)), ['the', 'thing', 'eux', 'und'])) AS overlap FROM trusted WHERE valid_to IS NULL),
g AS (SELECT created_by, sum(overlap) AS overlap, avg(trust) AS mean_trust, count(*) AS n FROM hits WHERE overlap > 0 GROUP BY 1)
SELECT created_by, n, overlap::BIGINT AS overlap, round(mean_trust, 6) AS mean_trust, round(overlap / (SELECT max(overlap) FROM g), 6) AS affinity FROM g""")
def o070_experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = analytics.experts(Store(spark, sf_dir).trusted, "the thing eux und")
    return x.select("created_by", "n", "overlap", rounded("mean_trust").alias("mean_trust"), rounded("affinity").alias("affinity"))


@query("SELECT created_by, count(*) AS n, round(count(*) / (SELECT count(*) FROM kb_events), 6) AS share FROM kb_events GROUP BY 1")
def o071_source_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.source_shares(Store(spark, sf_dir).events).select("created_by", "n", rounded("share").alias("share"))


@query("SELECT created_by, any_value(n) AS n, min(e - ts) AS span FROM (SELECT created_by, ts, n, list_extract(all_ts, rn + n // 2) AS e FROM (SELECT created_by, ts, row_number() OVER w AS rn, count(*) OVER (PARTITION BY created_by) AS n, list(ts) OVER (PARTITION BY created_by ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS all_ts FROM kb_events WINDOW w AS (PARTITION BY created_by ORDER BY ts, event_id))) WHERE e IS NOT NULL GROUP BY 1")
def o083_half_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.half_spans(Store(spark, sf_dir).events, "created_by")


@query("SELECT claim_id, count(*) AS degree FROM (SELECT from_id AS claim_id FROM kb_edges WHERE type = 'contradicts' UNION ALL SELECT to_id FROM kb_edges WHERE type = 'contradicts') GROUP BY 1")
def o072_contradiction_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.contradiction_degrees(Store(spark, sf_dir).edges)


@query("SELECT word, count(DISTINCT created_by) AS tenants, count(*) AS n FROM (SELECT created_by, unnest(list_distinct(list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{Nd}]+'), lambda w: length(w) >= 3))) AS word FROM kb_events) GROUP BY 1 HAVING count(DISTINCT created_by) >= 3")
def o073_tenant_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = Store(spark, sf_dir).events.select("created_by", F.explode(text.token_set(F.col("content"))).alias("word"))
    by_tenant = words.groupBy("word", "created_by").agg(F.count("*").alias("n"))
    return by_tenant.groupBy("word").agg(F.count("*").alias("tenants"), F.sum("n").alias("n")).where("tenants >= 3")


@query(TRUST_SQL + "SELECT count(*) AS n, round(count(*) FILTER (valid_to IS NULL) / count(*), 6) AS live, round(count(*) FILTER (event_count > 0) / count(*), 6) AS grounded, round(count(*) FILTER (status = 'contested') / count(*), 6) AS contested, round(count(*) FILTER (staleness >= 0.7 - 1e-9) / count(*), 6) AS stale, round(count(*) FILTER (lifecycle = 'promoted') / count(*), 6) AS promoted, (SELECT count(*) FROM kb_edges WHERE type = 'contradicts') AS contradictions FROM trusted")
def o074_vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    v = analytics.vitals(s.trusted, s.edges, s.evidence)
    return v.select("n", *(rounded(c).alias(c) for c in ("live", "grounded", "contested", "stale", "promoted")), "contradictions")


GAP_SQL = "(0.35 * confidence + 0.25 * (1 - 1 / (1 + event_count)::DOUBLE) + 0.25 * CASE type WHEN 'decision' THEN 1.0 WHEN 'fact' THEN 0.6 ELSE 0.3 END + 0.10 * source_authority + 0.05 * least(verify_count, 3) / 3.0)"


@query(TRUST_SQL + f"SELECT claim_id, round(gap, 6) AS gap FROM (SELECT claim_id, {GAP_SQL} * (1 - trust) * (0.3 + 0.7 * staleness) AS gap FROM trusted WHERE valid_to IS NULL) ORDER BY round(gap, 9) DESC, claim_id LIMIT 20")
def o143_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.gaps(Store(spark, sf_dir).trusted).select("claim_id", rounded("gap").alias("gap"))
