"""More queries of the reference's operators: pages, narratives, verdicts of contradictions, priorities, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone import model
from siltstone.functions import scoring, text
from siltstone.model import now, table
from siltstone.operators import admission, analytics, evidence, graph, lifecycle, merge, promote, relate, retrieval, store
from siltstone.plans.catalog import LATEST_SQL, TRUST_SQL, Store, query, rounded, seconds
from siltstone.plans.catalog_more import BM25_SQL, GAP_SQL, LOCAL_SQL, PATH_SQL, _questions, _quoted, words_sql
from siltstone.sources import normalise
from siltstone.sources.shared import Scratch
from siltstone.streaming import signals


# --- sources, pages and filters


@query("SELECT event_id, sha256(content) AS content_sha256, ts FROM kb_events")
def o007_scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).events.select("event_id", F.sha2("content", 256).alias("content_sha256"), seconds("ts"))


@query("SELECT page_id, url, 'registry' AS pulled_from FROM pages WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = page_id AND doc_id % 3 = 0)", False)
def o014_pull_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are a registry's rows, delivered twice; documents of every third number are stored."""
    stored = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("page_id"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return normalise.unseen(pages.unionByName(pages), stored, "page_id").withColumn("pulled_from", F.lit("registry"))


@query("SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) ELSE epoch_us(date_trunc('day', ts)) END AS us FROM events WHERE event_id % 5 <> 0", False)
def o155_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written as RFC 3339 or as dates; one in five is neither."""
    e = table(spark, sf_dir, "events")
    at = F.to_utc_timestamp("ts", F.current_timezone())
    n = F.col("event_id")
    written_as = F.when(n % 5 == 0, F.lit("soon")).when(n % 2 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise(F.date_format(at, "yyyy-MM-dd"))
    return e.select("event_id", "ts", F.unix_micros(normalise.flexible_time(written_as)).alias("us")).where("us is not null")


@query("SELECT md5(o_orderkey::VARCHAR) AS sha, o_orderpriority AS author, epoch(o_orderdate::TIMESTAMP)::BIGINT AS at, 'order ' || o_orderkey AS content FROM orders WHERE o_orderkey % 4 <> 0", False)
def o011_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of an exported log, with lines that are none; every fourth is stored."""
    o = table(spark, sf_dir, "orders")
    sha = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    line = F.concat_ws("\t", sha, F.col("o_orderpriority"), F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    log = o.select(line.alias("value")).unionByName(o.select(F.col("o_orderpriority").alias("value")))
    return normalise.unseen(normalise.commits(log), o.where("o_orderkey % 4 = 0").select(sha.alias("sha")), "sha").select("sha", "author", seconds("at"), "content")


@query("SELECT claim_id, sha256(text) AS text_sha256, count(*) AS sources FROM kb_claims JOIN kb_evidence USING (claim_id) WHERE lifecycle = 'promoted' GROUP BY ALL")
def o015_federation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    c = s.claims.where("lifecycle = 'promoted'").join(s.evidence, "claim_id")
    return c.groupBy("claim_id", F.sha2("text", 256).alias("text_sha256")).agg(F.count("*").alias("sources"))


@query("SELECT claim_id FROM kb_claims WHERE claim_id IN (SELECT claim_id FROM kb_evidence WHERE event_id % 2 = 0)")
def o026_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the entities that are allowed: those in even events."""
    s = Store(spark, sf_dir)
    return admission.allowed(s.claims, s.evidence.where("event_id % 2 = 0").select("claim_id")).select("claim_id")


@query(TRUST_SQL + "SELECT claim_id FROM trusted WHERE trust >= 0.35")
def o030_min_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).trusted.where("trust >= 0.35").select("claim_id")


@query("SELECT claim_id, type, valid_from, coalesce(valid_to, 0) AS valid_to FROM kb_claims")
def o039_public_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).claims.select("claim_id", "type", seconds("valid_from"), F.coalesce(F.unix_seconds("valid_to"), F.lit(0)).alias("valid_to"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100", False)
def o089_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(100).limit(50).select("o_orderkey")


@query("SELECT claim_id, row_number() OVER (ORDER BY (type = 'decision')::INT DESC, (status = 'contested')::INT, claim_id) AS rank FROM kb_claims")
def o090_partitioned_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Store(spark, sf_dir).claims.select("claim_id", "type", "status")
    order = [(F.col("type") == "decision").cast("int").desc(), (F.col("status") == "contested").cast("int").asc(), F.col("claim_id").asc()]
    return lifecycle.ranked(c, order).select("claim_id", "rank")


# --- joins and aggregates


@query("SELECT kind AS playbook, count(*) AS scored, round(avg(CASE result WHEN 'success' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END), 6) AS rate FROM kb_actions WHERE result <> 'unknown' GROUP BY 1")
def o048_playbook_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From playbooks (kinds) to their lessons (subject and kind), the lessons' actions, and the outcomes, each once although
    two lessons name each action."""
    a = Store(spark, sf_dir).actions
    lesson = F.concat_ws("/", "kind", "subject")
    lessons = a.select(F.col("kind").alias("playbook"), lesson.alias("lesson")).distinct()
    of = a.select(lesson.alias("lesson"), "action_id")
    outcomes = a.select("action_id", (F.col("action_id") + 1_000_000_000).alias("outcome_id"), "result")
    return analytics.playbook_rates(lessons, of.unionByName(of), outcomes).select("playbook", "scored", rounded("rate").alias("rate"))


@query(TRUST_SQL + """, inc AS (SELECT o_custkey AS incident_id, max(o_orderkey) AS root, list_distinct(list(o_orderkey)) AS ids FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
named AS (SELECT incident_id, count(*) AS n FROM (SELECT incident_id, unnest(ids) AS id FROM inc) WHERE id % 2 = 0 GROUP BY 1)
SELECT inc.incident_id, t.text AS root_text, round(t.trust, 6) AS root_trust, coalesce(n, 0) AS decisions FROM inc LEFT JOIN trusted t ON t.claim_id = inc.root * 16777216 LEFT JOIN named USING (incident_id)""")
def o050_wrong_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' failed orders are incidents and name decisions; even orders are decisions; the greatest order's number is
    the document whose first sentence is the root cause."""
    o = table(spark, sf_dir, "orders")
    incidents = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("incident_id")).agg((F.max("o_orderkey").cast("long") * model.ROOM).alias("root_cause_id"), F.collect_set("o_orderkey").alias("decision_ids"))
    decisions = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("decision_id"))
    return evidence.wrong_beliefs(incidents, decisions, Store(spark, sf_dir).trusted).select("incident_id", "root_text", rounded("root_trust").alias("root_trust"), "decisions")


@query("SELECT o_orderkey, o_orderpriority AS risk FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 1 AND o_orderpriority = '1-URGENT'", False)
def o237_audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("svc"), (F.col("o_custkey") % 3).cast("string")).alias("scope_service"), F.col("o_orderpriority").alias("risk"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("failed_outcome_id"))
    return evidence.audit_trail(o, "svc1", "1-URGENT").select("o_orderkey", "risk")


@query(TRUST_SQL + r""", e AS (SELECT *, (1706745600 - coalesce(last_verified, valid_from, created_at)) / 86400.0::DOUBLE AS eff_age FROM trusted)
SELECT claim_id, round(least(1, greatest(0, (0.5 * CASE WHEN trust = 0 THEN 0.5 ELSE trust END + 0.15 * CASE WHEN source_authority = 0 THEN 0.5 ELSE source_authority END + 0.13 * least(1, ln(1 + citation_count) / ln(11)) + 0.10 * exp(-greatest(eff_age, 0) / 180.0)
  + 0.05 * CASE WHEN eff_age <= 14 THEN 1.0 WHEN eff_age <= 180 THEN 0.75 WHEN trust >= 0.6 THEN 0.65 ELSE 0.25 END) / CASE WHEN requirement IS NULL THEN 0.93 ELSE 1 END + CASE WHEN requirement IS NULL OR pass_count + fail_count = 0 THEN 0 ELSE 0.07 * abs(pass_count - fail_count) / (pass_count + fail_count)::DOUBLE END)), 6) AS score,
  CASE WHEN requirement IS NULL THEN 5 ELSE 6 END AS signals FROM e""")
def o237_why_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.why_trust(Store(spark, sf_dir).trusted, now()).select("claim_id", rounded("score").alias("score"), F.size("signals").alias("signals"))


@query("SELECT (SELECT count(*) FROM kb_claims) AS scanned, least((SELECT count(*) FROM kb_claims WHERE valid_to IS NULL), 400) AS considered, (SELECT count(*) FROM kb_claims WHERE status = 'contested') AS available, 200 AS \"limit\", 'limit_capped,candidate_cap,result_limit' AS reasons, true AS truncated")
def o088_bounded_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of contested claims, as an answer of 500 rows with 400 candidates would report."""
    c = Store(spark, sf_dir).claims.select("claim_id", "valid_to", "status")
    return analytics.bounded(c, c.where("valid_to is null").orderBy("claim_id").limit(400), c.where("status = 'contested'"), 500)


@query(None)
def o052_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all claims; a test compares it with brute force."""
    c = Store(spark, sf_dir).claims.select("claim_id", "text")
    return relate.overlap_pairs(c, c).select("a", "b", F.col("shared").cast("long").alias("shared"))


@query(r""", cand AS (SELECT claim_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda w: length(w) >= 3)) AS words FROM (
  SELECT claim_id, text, """ + GAP_SQL.replace("event_count", "n_ev") + r""" AS sal FROM kb_claims JOIN (SELECT claim_id, count(*) AS n_ev FROM kb_evidence GROUP BY 1) USING (claim_id) WHERE valid_to IS NULL)
  WHERE sal >= 0.5 ORDER BY round(sal, 9) DESC, claim_id LIMIT 400),
hit AS (SELECT a.claim_id AS a, b.claim_id AS b, len(list_intersect(a.words, b.words)) AS i, len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)) AS u FROM cand a JOIN cand b ON a.claim_id < b.claim_id WHERE len(a.words) > 0 AND len(b.words) > 0)
SELECT a, b, round(i / u, 6) AS similarity FROM hit WHERE u > 0 AND i / u >= 0.34 AND NOT EXISTS (SELECT 1 FROM kb_edges WHERE least(from_id, to_id) = a AND greatest(from_id, to_id) = b)""")
def o188_recombinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    counts = s.evidence.groupBy("claim_id").agg(F.count("*").alias("event_count"))
    return graph.recombinations(s.claims.join(counts, "claim_id"), s.edges).select("a", "b", rounded("similarity").alias("similarity"))


@query("SELECT claim_id FROM kb_claims c WHERE EXISTS (SELECT 1 FROM kb_evidence v JOIN kb_events e USING (event_id) WHERE v.claim_id = c.claim_id AND e.run_id = 'fr')")
def o055_claims_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return evidence.claims_of_events(s.claims, s.evidence, s.events.where("run_id = 'fr'")).select("claim_id")


@query(TRUST_SQL + "SELECT type, count(*) AS n, round(avg(trust), 6) AS mean_trust, count(*) FILTER (trust < 0.3) AS low FROM trusted GROUP BY 1")
def o063_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).trusted.groupBy("type").agg(F.count("*").alias("n"), rounded(F.avg("trust")).alias("mean_trust"), F.count_if(F.col("trust") < 0.3).alias("low"))


@query(TRUST_SQL + "SELECT state, count(*) AS n FROM (SELECT CASE WHEN age <= 14 THEN 'live' WHEN age <= 180 THEN 'stale' WHEN trust >= 0.6 THEN 'zombie' ELSE 'dead' END AS state FROM (SELECT trust, (1706745600 - coalesce(last_verified, valid_from, created_at)) / 86400.0::DOUBLE AS age FROM trusted)) GROUP BY 1")
def o076_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = scoring.days_between(F.coalesce("last_verified", "valid_from", "created_at"), now())
    return Store(spark, sf_dir).trusted.groupBy(scoring.liveness(age, F.col("trust")).alias("state")).agg(F.count("*").alias("n"))


@query("SELECT user_id, string_agg(event_type, ' > ' ORDER BY ts, event_id) AS narrative FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NULL OR prev <> event_type GROUP BY 1", False)
def o081_status_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.narrative(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NULL OR prev <> event_type", False)
def o234_status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("SELECT claim_id, round((n - rank + 1) / n::DOUBLE, 6) AS base FROM (SELECT claim_id, row_number() OVER (ORDER BY confidence DESC, claim_id) AS rank, count(*) OVER () AS n FROM kb_claims)")
def o086_rank_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Store(spark, sf_dir).claims.select("claim_id", "confidence")
    n = F.broadcast(c.agg(F.count("*").alias("n")))
    x = lifecycle.ranked(c, [F.desc("confidence"), F.asc("claim_id")]).join(n, F.lit(True))
    return x.select("claim_id", rounded((F.col("n") - F.col("rank") + 1) / F.col("n")).alias("base"))


@query("SELECT from_id, to_id, type FROM kb_edges UNION SELECT to_id, from_id, 'supports' FROM kb_edges WHERE type = 'cites'")
def o092_edge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Store(spark, sf_dir).edges
    more = e.where("type = 'cites'").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.lit("supports").alias("type"))
    return e.select("from_id", "to_id", "type").unionByName(more).distinct()


JACCARD_SQL = r"len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))"


@query(r""", w AS (SELECT claim_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda w: length(w) >= 3)) AS words FROM kb_claims)
SELECT from_id, to_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE """ + JACCARD_SQL + " END, 6) AS jaccard FROM (SELECT from_id, to_id, x.words AS a, y.words AS b FROM kb_edges JOIN w x ON x.claim_id = from_id JOIN w y ON y.claim_id = to_id)")
def o094_edge_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    w = s.claims.select("claim_id", text.token_set(F.col("text")).alias("words"))
    x = s.edges.join(w.select(F.col("claim_id").alias("from_id"), F.col("words").alias("a")), "from_id").join(w.select(F.col("claim_id").alias("to_id"), F.col("words").alias("b")), "to_id")
    return x.select("from_id", "to_id", rounded(graph.jaccard("a", "b")).alias("jaccard"))


# --- text


def _event_sql() -> str:
    def m(p: str) -> str:
        return f"regexp_matches(text, {_quoted(p)})"

    seen = " ".join(f"WHEN {m(p)} THEN '{k}'" for k, p in text.OBSERVED.items())
    return f"CASE WHEN role = 'system' OR {m(text.NOT_OBSERVED)} THEN '' WHEN {m(text.INCIDENT)} AND {m(text.OCCURRED)} THEN 'incident' WHEN NOT {m(text.ARTIFACT)} THEN '' {seen} ELSE '' END"


@query(f"SELECT conv_id, turn, {_event_sql()} AS kind FROM conversations", False)
def o114_event_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "system", "decision").otherwise("fact")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.event_kind(kind, F.col("text")).alias("kind"))


LOCAL_TEXTS = "CASE claim_id % 4 WHEN 0 THEN text || ' in /srv/app/main.go:12' WHEN 1 THEN text || ' (see README.md)' WHEN 2 THEN text || ' at a1b2c3d, http://x.y/z.py' ELSE text END"


@query(f"SELECT claim_id, {LOCAL_SQL} AS is_local, array_to_string(list_filter(list_filter(regexp_split_to_array(text, '\\s+'), lambda r: r <> ''), lambda r: NOT {PATH_SQL.replace('w', 'r').replace('rith', 'with')}), ' ') AS stripped FROM (SELECT claim_id, {LOCAL_TEXTS} AS text FROM kb_claims)")
def o121_repo_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with a path, the name of a file, a commit id, or nothing after them."""
    t = F.expr(LOCAL_TEXTS)
    return Store(spark, sf_dir).claims.select("claim_id", t.alias("text")).select("claim_id", text.is_repo_local(F.col("text")).alias("is_local"), text.without_paths(F.col("text")).alias("stripped"))


@query(f"SELECT claim_id FROM kb_claims WHERE len(list_intersect(regexp_split_to_array(lower(text), '[^a-z0-9]+'), {words_sql(['thing', 'eux', 'und', 'mente'])})) > 0 OR contains(lower(text), 'ande the') OR claim_id IN (SELECT claim_id FROM kb_claims, (SELECT DISTINCT lower(created_by) AS t FROM kb_events WHERE strlen(created_by) >= 3) WHERE list_contains(regexp_split_to_array(lower(text), '[^a-z0-9]+'), t))")
def o122_identifying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with a denied word, phrase or tenant's name."""
    s = Store(spark, sf_dir)
    terms = spark.createDataFrame([(x,) for x in ("thing", "eux", "und", "mente", "ande the", "it")], "term string")
    denied = promote.denied_terms(terms, s.events.where("created_by is not null").select(F.col("created_by").alias("tenant")).distinct())
    return promote.identifying(s.claims.select(F.col("claim_id").alias("statement_id"), F.col("text").alias("statement")), denied).select(F.col("statement_id").alias("claim_id"))


@query("SELECT item_id, array_to_string(list_filter(regexp_split_to_array(lower(translate(text, '\"()*^:-+{}[]~', '             ')), '\\s+'), lambda w: w NOT IN ('', 'and', 'or', 'not', 'near')), ' ') AS terms FROM benchmark", False)
def o123_search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.fts_terms(F.col("text")), " ").alias("terms"))


@query("SELECT claim_id, ref FROM (SELECT claim_id, unnest(list_distinct(regexp_extract_all(text || ' see cl_' || (claim_id // 16777216) || ' and cl_x-' || type, '\\b(cl_[A-Za-z0-9_-]+)\\b', 1))) AS ref FROM kb_claims)")
def o124_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = F.concat("text", F.lit(" see cl_"), F.floor(F.col("claim_id") / model.ROOM).cast("string"), F.lit(" and cl_x-"), F.col("type"))
    return Store(spark, sf_dir).claims.select("claim_id", F.explode(text.citation_refs(cited)).alias("ref"))


# --- scores


@query(TRUST_SQL + f"SELECT claim_id, round(w * exp(-greatest((1706745600 - created_at) / 86400.0, 0) / 30.0) * (1 + 0.5 * (w - 0.5) / 0.5) * (1 + (claim_id % 5) / 10.0), 6) AS priority FROM (SELECT *, {GAP_SQL} AS w FROM trusted) ORDER BY round(priority, 6) DESC, claim_id LIMIT 50")
def o142_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = scoring.salience(F.col("confidence"), F.col("event_count"), F.col("type"), F.col("source_authority"), F.col("verify_count"))
    age = F.greatest(scoring.days_between(F.col("created_at"), now()), F.lit(0.0))
    p = rounded(scoring.replay_priority(w, age, F.col("claim_id") % 5 / 10.0))
    return Store(spark, sf_dir).trusted.select("claim_id", p.alias("priority")).orderBy(F.desc("priority"), "claim_id").limit(50)


@query(TRUST_SQL + LATEST_SQL + f""", deg AS (SELECT claim_id, count(*) AS degree FROM (SELECT from_id AS claim_id FROM kb_edges WHERE type = 'contradicts' UNION ALL SELECT to_id FROM kb_edges WHERE type = 'contradicts') GROUP BY 1),
rated AS (SELECT claim_id, {GAP_SQL} * least(1, greatest(0, 1 - trust)) * (0.3 + 0.7 * staleness) * (1 + 0.15 * least(coalesce(degree, 0), 4)) * CASE WHEN open THEN 1.25 ELSE 1 END * (1 + 0.5 * (claim_id % 11) / 20.0) AS priority, trust, staleness, coalesce(degree, 0) AS degree, open
  FROM (SELECT t.*, type = 'hypothesis' AND NOT EXISTS (SELECT 1 FROM latest l WHERE l.claim_id = t.claim_id) AS open FROM trusted t) LEFT JOIN deg USING (claim_id) WHERE valid_to IS NULL)
SELECT claim_id, CASE WHEN degree > 0 THEN 'contested' WHEN open THEN 'unresolved_hypothesis' WHEN staleness >= 0.7 - 1e-9 THEN 'stale' ELSE 'low_trust' END AS reason, CASE WHEN degree > 0 THEN 'resolve' ELSE 'verify' END AS action, round(priority, 6) AS priority FROM rated
WHERE degree > 0 OR open OR staleness >= 0.7 - 1e-9 OR trust <= 0.4 ORDER BY round(priority, 9) DESC, claim_id LIMIT 50""")
def o235_curiosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses without a verdict are open; authors are over-confident by their number."""
    s = Store(spark, sf_dir)
    done = evidence.latest_verdict(model.kb_verdicts(s.claims)).select("claim_id", F.lit(True).alias("done"))
    c = s.trusted.join(done, "claim_id", "left").withColumns({"unresolved": (F.col("type") == "hypothesis") & F.col("done").isNull(), "overconfidence": F.col("claim_id") % 11 / 20.0})
    return lifecycle.curiosity(c, analytics.contradiction_degrees(s.edges), 50).select("claim_id", "reason", "action", rounded("priority").alias("priority"))


@query("SELECT claim_id, round(CASE WHEN pass_count + fail_count = 0 THEN NULL ELSE abs(pass_count - fail_count) / (pass_count + fail_count)::DOUBLE END, 6) AS ratio FROM kb_claims")
def o145_pass_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).claims.select("claim_id", rounded(scoring.pass_ratio(F.col("pass_count"), F.col("fail_count"))).alias("ratio"))


@query("SELECT vec_id, len(embedding) * 4 AS bytes, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 5) AS square FROM embeddings", False)
def o150_vector_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as little-endian bytes of 32-bit floats, and read back."""
    stored = store.packed(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    back = store.unpacked(stored, "vec_id")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return back.join(stored.select("vec_id", F.octet_length("packed").cast("long").alias("bytes")), "vec_id").select("vec_id", "bytes", F.round(square, 5).alias("square"))


# --- retrieval and graphs


@query(BM25_SQL + r""", top AS (SELECT question_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, event_id) AS rank FROM bm) WHERE rank <= 5)
SELECT question_id, count(DISTINCT claim_id) AS claims, count(DISTINCT event_id) AS events FROM top JOIN kb_evidence USING (event_id) GROUP BY 1""")
def o169_claims_of_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    top = retrieval.top_k(s.bm25(_questions(spark, sf_dir)), "question_id", "event_id", 5).select("question_id", "event_id")
    return top.join(s.evidence, "event_id").groupBy("question_id").agg(F.countDistinct("claim_id").alias("claims"), F.countDistinct("event_id").alias("events"))


@query(r""", around AS (SELECT from_id, to_id FROM kb_edges UNION SELECT to_id, from_id FROM kb_edges), h0 AS (SELECT claim_id, 0 AS hop FROM kb_claims WHERE claim_id % 70 = 0), h1 AS (SELECT DISTINCT to_id AS claim_id, 1 AS hop FROM around JOIN h0 ON from_id = claim_id), walk AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1)
SELECT claim_id, round(c.confidence + 3 * pow(0.5, hop), 6) AS score FROM (SELECT claim_id, min(hop) AS hop FROM walk GROUP BY 1) JOIN kb_claims c USING (claim_id)""")
def o173_context_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    near = graph.hops(s.edges, s.claims.where("claim_id % 70 = 0"), 1)
    return near.join(s.claims.select("claim_id", "confidence"), "claim_id").select("claim_id", rounded(F.col("confidence") + 3 * F.pow(F.lit(0.5), F.col("hop"))).alias("score"))


@query("SELECT from_id, to_id FROM kb_edges WHERE type = 'contradicts' AND (from_id % 3 = 0 OR to_id % 3 = 0)")
def o182_contradictions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return evidence.edges_touching(s.edges.where("type = 'contradicts'"), s.claims.where("claim_id % 3 = 0")).select("from_id", "to_id")


@query(TRUST_SQL + r""", p AS (SELECT e.from_id, e.to_id, a.confidence AS fc, b.confidence AS tc, a.trust AS ft, b.trust AS tt, a.requirement = b.requirement AS same, a.last_run_at AS fa, b.last_run_at AS ta,
  CASE WHEN a.pass_count + a.fail_count = 0 THEN 0 ELSE abs(a.pass_count - a.fail_count) / (a.pass_count + a.fail_count)::DOUBLE END AS fr, CASE WHEN b.pass_count + b.fail_count = 0 THEN 0 ELSE abs(b.pass_count - b.fail_count) / (b.pass_count + b.fail_count)::DOUBLE END AS tr
  FROM kb_edges e JOIN trusted a ON a.claim_id = e.from_id JOIN trusted b ON b.claim_id = e.to_id WHERE e.type = 'contradicts' AND a.valid_to IS NULL AND b.valid_to IS NULL AND a.status <> 'deprecated' AND b.status <> 'deprecated'),
r AS (SELECT *, CASE WHEN same AND abs(fa - ta) >= 86400 THEN 'recency' WHEN same AND abs(fr - tr) >= 0.2 - 1e-12 THEN 'tests' WHEN fc >= 0.7 AND tc >= 0.7 AND abs(fc - tc) >= 0.2 - 1e-12 THEN 'confidence' WHEN abs(ft - tt) >= 0.05 THEN 'trust' ELSE 'escalate' END AS how FROM p)
SELECT from_id, to_id, how, CASE how WHEN 'recency' THEN CASE WHEN fa >= ta THEN from_id ELSE to_id END WHEN 'tests' THEN CASE WHEN fr >= tr THEN from_id ELSE to_id END WHEN 'confidence' THEN CASE WHEN fc >= tc THEN from_id ELSE to_id END WHEN 'trust' THEN CASE WHEN ft >= tt THEN from_id ELSE to_id END END AS winner FROM r""")
def o183_auto_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return evidence.resolved(s.edges, s.trusted).select("from_id", "to_id", "how", "winner")


@query(TRUST_SQL + r""", groups AS (SELECT claim_id, trust, created_at, min(claim_id) OVER (PARTITION BY created_by, type, scope_service, citation_count) AS root, count(*) OVER (PARTITION BY created_by, type, scope_service, citation_count) AS n FROM trusted)
SELECT old_id, new_id FROM (SELECT claim_id AS old_id, first_value(claim_id) OVER (PARTITION BY root ORDER BY round(trust, 9) DESC, created_at, claim_id) AS new_id FROM groups WHERE n > 1) WHERE old_id <> new_id""")
def o186_merge_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Store(spark, sf_dir).trusted.withColumn("trust", F.round("trust", 9))
    w = Window.partitionBy("created_by", "type", "scope_service", "citation_count")
    roots = c.select(F.col("claim_id").alias("node"), F.min("claim_id").over(w).alias("root")).where("node <> root")
    return graph.winners(c, roots)


@query(TRUST_SQL + r""", groups AS (SELECT claim_id, trust, created_at, min(claim_id) OVER (PARTITION BY created_by, type, scope_service, citation_count) AS root, count(*) OVER (PARTITION BY created_by, type, scope_service, citation_count) AS n FROM trusted),
m AS (SELECT * FROM (SELECT claim_id AS old_id, first_value(claim_id) OVER (PARTITION BY root ORDER BY round(trust, 9) DESC, created_at, claim_id) AS new_id FROM groups WHERE n > 1) WHERE old_id <> new_id),
e AS (SELECT DISTINCT coalesce(a.new_id, from_id) AS f, coalesce(b.new_id, to_id) AS t, type FROM kb_edges LEFT JOIN m a ON a.old_id = from_id LEFT JOIN m b ON b.old_id = to_id),
fb AS (SELECT coalesce(new_id, claim_id) AS claim_id, claim_id AS was, claim_id % 5 AS helpful, claim_id % 3 AS streak, claim_id % 200 AS seen FROM kb_claims LEFT JOIN m ON old_id = claim_id WHERE claim_id % 4 = 0),
ex AS (SELECT coalesce(new_id, claim_id) AS claim_id, claim_id AS was, claim_id % 10 AS predicted FROM kb_claims LEFT JOIN m ON old_id = claim_id WHERE claim_id % 6 = 0)
SELECT 'claims' AS kind, claim_id AS a, NULL::BIGINT AS b, NULL AS c FROM kb_claims WHERE claim_id NOT IN (SELECT old_id FROM m)
UNION ALL SELECT DISTINCT 'evidence', coalesce(new_id, claim_id), event_id, NULL FROM kb_evidence LEFT JOIN m ON old_id = claim_id
UNION ALL SELECT 'edges', f, t, type FROM e WHERE f <> t
UNION ALL SELECT 'feedback', claim_id, sum(helpful)::BIGINT, max(streak) || ' ' || max(seen) || ' note ' || arg_max(was, seen::HUGEINT * 4000000000000000000 + (was = claim_id)::INT * 2000000000000000000 - was) FROM fb GROUP BY claim_id
UNION ALL SELECT 'expectations', claim_id, predicted, NULL FROM ex QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY was <> claim_id, was) = 1""")
def o186_applied_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables after the merges of o186_merge_winners, kept in buckets by claim."""
    s = Store(spark, sf_dir)
    tables = merge.merge_tables(spark, s.claims, s.evidence, s.edges)
    scratch = Scratch(spark, "merged")
    out = merge.applied({name: merge.bucketed(df, "from_id" if name == "edges" else "claim_id", 8) for name, df in tables.items()}, o186_merge_winners(spark, sf_dir), scratch)
    none = F.lit(None)
    feedback = F.concat_ws(" ", F.col("streak").cast("string"), F.col("at").cast("string"), "note")
    parts = {"claims": ("claim_id", none.cast("long"), none.cast("string")), "evidence": ("claim_id", F.col("event_id"), none.cast("string")), "edges": ("from_id", F.col("to_id"), F.col("type")), "feedback": ("claim_id", F.col("helpful").cast("long"), feedback), "expectations": ("claim_id", F.col("predicted").cast("long"), none.cast("string"))}
    rows = [out[name].select(F.lit(name).alias("kind"), F.col(a).alias("a"), b.alias("b"), c.alias("c")) for name, (a, b, c) in parts.items()]
    return reduce(DataFrame.unionByName, rows)


@query("""SELECT action_id + 1000000000 AS from_id, 'outcome_of' AS type, action_id AS to_id FROM kb_actions WHERE result <> 'unknown'
  UNION ALL SELECT action_id, 'action_of', action_id + 1000000000 FROM kb_actions WHERE result <> 'unknown'
  UNION SELECT action_id + 1000000000, CASE result WHEN 'success' THEN 'validates' ELSE 'refutes' END, b FROM (SELECT *, unnest([user_id, user_id + 1]) AS b FROM kb_actions WHERE result IN ('success', 'failure'))""")
def o191_auto_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every action is a decision too, that rests on two beliefs."""
    a = Store(spark, sf_dir).actions.select("action_id", (F.col("action_id") + 1_000_000_000).alias("outcome_id"), "result", F.array("user_id", F.col("user_id") + 1).alias("beliefs"))
    return evidence.auto_edges(a.where("result <> 'unknown'").select("action_id", "outcome_id"), a.select("outcome_id", "result"), a.select("outcome_id", "beliefs"))


# --- consolidation


@query(r""", g AS (SELECT trim(regexp_replace(translate(lower(text), ',.;:!?', ''), '\s+', ' ', 'g')) AS k, count(DISTINCT created_by) AS tenants FROM (SELECT s.text, e.created_by FROM statements s JOIN kb_events e USING (event_id)) GROUP BY 1)
SELECT k AS statement, tenants FROM g WHERE tenants >= 3""")
def o230_statement_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    x = model.kb_statements(spark, sf_dir).join(s.events.select("event_id", "created_by"), "event_id")
    by_tenant = x.groupBy("key", "created_by").agg(F.count("*").alias("n"))
    return by_tenant.groupBy(F.col("key").alias("statement")).agg(F.count("*").alias("tenants")).where("tenants >= 3")


@query(None)
def o220_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one pass does, step by step; a test compares its steps with plain ones."""
    return lifecycle.consolidate(consolidation_tables(spark, sf_dir), now(), 0.3)[1]


def consolidation_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The model's frames, with duplicates by four attributes, and credits, surprises and risks by number."""
    s = Store(spark, sf_dir)
    n = F.col("claim_id")
    none = F.from_json(F.lit("{}"), "map<string,double>")
    c = s.claims.withColumn("components", F.when(n % 3 == 1, F.create_map(F.lit("inhibition"), n % 50 / 100.0)).otherwise(none))
    merges = store.exact_duplicates(s.claims.select("claim_id", F.struct("created_by", "type", "scope_service", "citation_count", F.floor(n / model.ROOM)).alias("key")))
    return {
        "claims": c, "evidence": s.evidence, "events": s.events, "edges": s.edges, "merges": merges, "verdicts": model.kb_verdicts(s.claims), "actions": s.actions,
        "credits": s.claims.where(n % 5 == 2).select("claim_id", F.lit("d1").alias("key"), (n % 9 / 10.0 - 0.4).alias("credit")), "surprises": s.claims.where(n % 4 == 1).select("claim_id", (n % 30 / 10.0).alias("surprise")),
        "risks": s.claims.where(n % 6 == 1).select("claim_id", F.get(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), (n % 4).cast("int")).alias("risk"), F.lit("partial").alias("result")),
    }


@query("""SELECT claim_id, CASE WHEN l IS NOT NULL THEN 'deprecated' WHEN w IS NOT NULL THEN 'active' ELSE status END AS status, CASE WHEN l IS NOT NULL THEN coalesce(valid_to, 1706745600) ELSE valid_to END AS valid_to, l AS superseded_by FROM kb_claims
  LEFT JOIN (SELECT DISTINCT from_id AS w FROM kb_edges WHERE type = 'contradicts') ON w = claim_id LEFT JOIN (SELECT to_id AS loser, min(from_id) AS l FROM kb_edges WHERE type = 'contradicts' GROUP BY 1) ON loser = claim_id""")
def o227_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each contradiction the first claim wins."""
    s = Store(spark, sf_dir)
    decisions = s.edges.where("type = 'contradicts'").select(F.col("from_id").alias("winner_id"), F.col("to_id").alias("loser_id"))
    return store.decided(s.claims, decisions, now()).select("claim_id", "status", seconds("valid_to"), "superseded_by")


@query("SELECT DISTINCT l_orderkey AS claim_id, CASE WHEN l_suppkey % 2 = 1 THEN l_suppkey - 1 ELSE l_suppkey END AS entity_id, l_returnflag AS role FROM lineitem", False)
def o228_entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are entities; each odd one is merged into the one before."""
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("entity_id"), F.col("l_returnflag").alias("role"))
    odd = links.where("entity_id % 2 = 1").select(F.col("entity_id").alias("old_id")).distinct()
    return store.merged_entities(links, odd.withColumn("new_id", F.col("old_id") - 1))


@query("SELECT DISTINCT claim_id FROM (SELECT from_id AS claim_id FROM kb_edges e JOIN kb_claims a ON a.claim_id = from_id JOIN kb_claims b ON b.claim_id = to_id WHERE e.type = 'contradicts' AND a.valid_to IS NULL AND b.valid_to IS NULL AND a.status <> 'deprecated' AND b.status <> 'deprecated' UNION ALL SELECT to_id FROM kb_edges e JOIN kb_claims a ON a.claim_id = from_id JOIN kb_claims b ON b.claim_id = to_id WHERE e.type = 'contradicts' AND a.valid_to IS NULL AND b.valid_to IS NULL AND a.status <> 'deprecated' AND b.status <> 'deprecated')")
def o252_contested_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return evidence.contradictions(s.edges, s.claims.withColumn("trust", F.lit(0.0))).select(F.explode(F.array("from_id", "to_id")).alias("claim_id")).distinct()


@query("SELECT conv_id, turn, trim(text, chr(10) || chr(9) || chr(13) || ' ') AS cleaned FROM conversations", False)
def o255_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns among what a harness adds: nothing of that is left."""
    noise = ["<system-reminder>\nA\n</system-reminder>", "<command-name>x</command-name>", "<local-command-stdout>\n1\n</local-command-stdout>", "Base directory for this skill: /x", "  Analysis: none", "</task-notification> y"]
    added = F.get(F.array(*map(F.lit, noise)), (F.col("turn") % len(noise)).cast("int"))
    said = F.concat(added, F.lit("\n"), F.col("text"), F.lit("\n<note>\nn</note>\n"), added, F.lit("\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", lifecycle.cleaned(said).alias("cleaned"))


@query("SELECT a.l_suppkey AS action_id, round(max(abs(b.l_discount - b.l_tax)::DOUBLE / 0.02), 6) AS surprise FROM lineitem a JOIN lineitem b USING (l_orderkey, l_linenumber) WHERE l_orderkey % 2 = 0 GROUP BY 1", False)
def o256_action_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers act; orders are outcomes, of which even ones have a decision that rests on their lines' expectations."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.concat_ws("/", "l_orderkey", "l_linenumber").alias("belief_id"), scoring.surprise(F.col("l_discount").cast("double"), F.col("l_tax").cast("double"), F.lit(0.02)).alias("surprise"))
    outcome = F.concat_ws("/", "l_orderkey", "l_suppkey").alias("outcome_id")
    decisions = l.where("l_orderkey % 2 = 0").groupBy(outcome).agg(F.collect_list("belief_id").alias("beliefs"))
    return analytics.action_surprises(l.select(F.col("l_suppkey").alias("action_id"), outcome).distinct(), decisions, l.select("belief_id", "surprise")).select("action_id", rounded("surprise").alias("surprise"))


@query("SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS labels FROM (SELECT o_custkey, o_orderpriority FROM orders UNION ALL SELECT o_custkey, o_orderpriority FROM orders) GROUP BY 1".replace("list_sort(list_distinct(list(o_orderpriority))) AS labels", "array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS labels"), False)
def o259_array_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities of open orders are stored; those of all orders are appended."""
    o = table(spark, sf_dir, "orders")
    stored = o.groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")))).alias("labels"))
    x = store.appended_set(stored, o.select("o_custkey", F.col("o_orderpriority").alias("value")), "o_custkey", "labels")
    return x.select("o_custkey", F.array_join(F.array_sort("labels"), ",").alias("labels"))


@query("SELECT conv_id, right(string_agg(text, chr(10) ORDER BY turn), 500) AS tail FROM conversations GROUP BY 1", False)
def o260_memory_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.last_block(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text", 500).select("conv_id", F.col("content").alias("tail"))


@query("SELECT l_partkey AS claim_id, any_value(p) AS predicted, arg_max(l_tax, l_orderkey * 10 + l_linenumber)::DOUBLE AS observed, true AS resolved FROM lineitem JOIN (SELECT p_partkey, (p_size / 100)::DOUBLE AS p FROM part) ON p_partkey = l_partkey GROUP BY 1 UNION ALL SELECT p_partkey, (p_size / 100)::DOUBLE, NULL, false FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)", False)
def o261_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are predictions; the last line of each is what was observed."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("claim_id"), (F.col("p_size") / 100).cast("double").alias("predicted"))
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("claim_id"), F.col("l_tax").cast("double").alias("observed"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return store.observed(p, seen).select("claim_id", "predicted", "observed", "resolved")


@query(LATEST_SQL + " SELECT c.claim_id, c.confidence FROM kb_claims c WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.claim_id = c.claim_id) AND c.type = 'hypothesis'")
def o261_open_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Store(spark, sf_dir).claims
    done = evidence.latest_verdict(model.kb_verdicts(c)).select("claim_id")
    return c.where("type = 'hypothesis'").join(done, "claim_id", "left_anti").select("claim_id", "confidence")


@query("SELECT epoch_us(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01')) AS week_us, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1", False)
def o243_weekly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = signals.batch(table(spark, sf_dir, "events")).groupBy(F.window("ts", "7 days")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return x.select(F.unix_micros("window.start").alias("week_us"), "n", "users")


@query(None)
def o245_incremental_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all claims; a test compares it with brute force."""
    c = Store(spark, sf_dir).claims.select("claim_id", "text")
    odd = F.floor(F.col("claim_id") / model.ROOM) % 2
    return signals.related(c.where(odd == 1), c.where(odd == 0))


# --- extraction


def _any_sql(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(l, '{w}')" for w in words) + ")"


def _score_sql(words: list[str]) -> str:
    return "(" + " + ".join(f"contains(l, '{w}')::INT" for w in words) + ")"


TYPED_SQL = f""", low AS (SELECT claim_id, lower(text) AS l FROM kb_claims), typed0 AS (SELECT *, {_score_sql(text.DECISION_SIGNALS)} AS d, {_score_sql(text.HYPOTHESIS_SIGNALS)} AS h FROM low),
typed1 AS (SELECT claim_id, l, CASE WHEN d > 0 AND d >= h THEN 'decision' WHEN h > 0 THEN 'hypothesis' ELSE 'fact' END AS kind FROM typed0)
"""


@query(TYPED_SQL + f"SELECT claim_id, kind, round(greatest(0.5, least(0.95, CASE kind WHEN 'decision' THEN 0.88 WHEN 'hypothesis' THEN 0.62 ELSE 0.8 END - CASE WHEN {_any_sql(text.HEDGES)} THEN 0.08 ELSE 0 END + CASE WHEN regexp_matches(l, '[0-9]') THEN 0.05 ELSE 0 END + CASE WHEN {_any_sql(text.CONFIRMATIONS)} THEN 0.04 ELSE 0 END))::DOUBLE, 6) AS confidence FROM typed1")
def o112_extracted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    kind = text.claim_type(t)
    return Store(spark, sf_dir).claims.select("claim_id", kind.alias("kind"), rounded(text.claim_confidence(t, kind)).alias("confidence"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE contains(lower(a.p_name), lower(b.p_name)) OR contains(lower(b.p_name), lower(a.p_name)) OR contains(lower(a.p_type), lower(b.p_type))", False)
def o107_names_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("b"), F.col("p_name").alias("other"), F.col("p_type").alias("other_type"))
    x = p.join(b, "p_partkey").where(text.names_match(F.col("p_name"), F.col("other")) | F.contains(F.lower("p_type"), F.lower("other_type")))
    return x.select(F.col("p_partkey").alias("a"), "b")


@query("SELECT claim_id, round(r, 6) AS resistance, round(CASE WHEN d >= 0 THEN d * r ELSE d * (r + (1 - r) * 0.6) END, 6) + 0.0::DOUBLE AS credit FROM (SELECT claim_id, ((claim_id % 7) - 3) / 10.0::DOUBLE AS d, 1 - 0.75 * (a / (a + 30)) * (verify_count / (verify_count + 3.0)) * (30 / (v + 30)) AS r FROM (SELECT *, greatest((1706745600 - created_at) / 86400.0::DOUBLE, 0) AS a, greatest((1706745600 - coalesce(last_verified, created_at)) / 86400.0::DOUBLE, 0) AS v FROM kb_claims))")
def o141_resistance(spark: SparkSession, sf_dir: str) -> DataFrame:
    age, since = (scoring.days_between(F.col(c) if c == "created_at" else F.coalesce(c, "created_at"), now()) for c in ("created_at", "last_verified"))
    x = Store(spark, sf_dir).claims.select("claim_id", scoring.resistance(age, F.col("verify_count"), since).alias("r"), ((F.col("claim_id") % 7 - 3) / 10.0).alias("d"))
    return x.select("claim_id", rounded("r").alias("resistance"), rounded(scoring.modulated(F.col("d"), F.col("r"), F.lit(1.0))).alias("credit"))
