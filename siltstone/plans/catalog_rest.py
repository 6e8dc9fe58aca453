"""Queries of files, batches, bias, judged retrieval, staleness, citations, answer texts and browsing; see catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import model
from siltstone.functions import scoring, text
from siltstone.model import now, table
from siltstone.operators import analytics, evidence, fulltext, lifecycle, recall, relate, retrieval, vector_index
from siltstone.plans.catalog import BINS_SQL, LESSONS_SQL, TRUST_SQL, Store, query, rounded, seconds
from siltstone.plans.catalog_more import BM25_SQL, COS_SQL, _questions
from siltstone.sources import normalise, tail
from siltstone.sources.shared import scratch_path, stored, written

# --- files and batches


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("x")), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))


@query("SELECT coalesce(source, 'x') || '/' || doc_id AS path, sha256(coalesce(text, '')) AS sha256 FROM documents WHERE doc_id % 3 = 0 OR (doc_id % 5 = 0 AND coalesce(text, '') <> 'old')", False)
def o012_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: every third is not stored, and every fifth is stored with another content."""
    files = _files(spark, sf_dir)
    stored = files.where("doc_id % 3 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("content")), 256).alias("sha256"))
    return normalise.new_files(files.select("path", "content"), stored).select("path", "sha256")


def _as_files(lines: DataFrame, name: str) -> DataFrame:
    """Lines (value) written to files of the shared folder, to be read again by the library's own source."""
    path = scratch_path(lines.sparkSession, name)
    lines.write.text(path)
    tail.register(lines.sparkSession)
    return lines.sparkSession.read.format("tailed_lines").load(path)


@query("SELECT md5(o_orderkey::VARCHAR) AS sha, o_orderpriority AS author, epoch(o_orderdate::TIMESTAMP)::BIGINT AS at, 'order ' || o_orderkey AS content FROM orders", False)
def o011_tailed_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of an exported log, with lines that are none."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    line = F.concat_ws("\t", F.md5(key.cast("binary")), F.col("o_orderpriority"), F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd"), F.concat(F.lit("order "), key))
    read = _as_files(o.select(F.explode(F.array(line, F.concat(F.lit("merge "), key))).alias("value")), "log")
    return normalise.commits(read).select("sha", "author", seconds("at"), "content")


@query("SELECT o_custkey, CASE WHEN max(o_totalprice) > 300000 OR count(*) > 20 THEN 'failure' ELSE 'success' END AS result FROM orders GROUP BY 1", False)
def o018_metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of customers as files of lines with labels, with comments, and a threshold for each."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").cast("double").alias("greatest"), F.count("*").cast("double").alias("orders"))
    own = F.concat(F.lit('{customer="'), F.col("o_custkey").cast("string"), F.lit('"} '))
    lines = F.array(F.lit("# TYPE greatest gauge"), *(F.concat(F.lit(n), own, F.col(n).cast("string")) for n in ("greatest", "orders")))
    read = tail.metrics(_as_files(o.select(F.explode(lines).alias("value")), "metrics"))
    x = read.groupBy(F.try_element_at("labels", F.lit("customer")).cast("long").alias("o_custkey")).agg(F.map_from_entries(F.collect_list(F.struct("name", "number"))).alias("metrics"))
    return x.select("o_custkey", analytics.threshold_verdict(F.col("metrics"), {"greatest": 300_000.0, "orders": 20.0}).alias("result"))


@query("SELECT count(*) AS batches, min(n) AS least, max(n) AS most, sum(n)::BIGINT AS records FROM (SELECT (row_number() OVER (ORDER BY claim_id) - 1) // 1000 AS batch, count(*) OVER () AS c, claim_id FROM kb_claims) JOIN (SELECT b AS batch, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY claim_id) - 1) // 1000 AS b FROM kb_claims) GROUP BY 1) USING (batch) WHERE claim_id IN (SELECT min(claim_id) FROM (SELECT claim_id, (row_number() OVER (ORDER BY claim_id) - 1) // 1000 AS b FROM kb_claims) GROUP BY b)")
def o023_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims in order, in batches of 1,000 records."""
    b = lifecycle.ranked(Store(spark, sf_dir).claims.select("claim_id"), [F.asc("claim_id")]).groupBy(F.floor((F.col("rank") - 1) / 1000).alias("batch")).agg(F.count("*").alias("n"))
    return b.agg(F.count("*").alias("batches"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("records"))


# --- lists


@query("SELECT claim_id, text, created_at, (SELECT count(*) FROM kb_claims c WHERE type = 'decision' AND status = 'active' AND claim_id IN (SELECT claim_id FROM kb_evidence WHERE event_id IN (SELECT event_id FROM kb_events WHERE run_id = 'en'))) AS total FROM kb_claims c WHERE type = 'decision' AND status = 'active' AND claim_id IN (SELECT claim_id FROM kb_evidence WHERE event_id IN (SELECT event_id FROM kb_events WHERE run_id = 'en')) ORDER BY created_at DESC, claim_id LIMIT 20")
def o253_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest page of one run's active decisions, and how many there are."""
    s = Store(spark, sf_dir)
    c = evidence.claims_of_events(s.claims.where("type = 'decision' and status = 'active'"), s.evidence, s.events.where("run_id = 'en'"))
    total = F.broadcast(c.agg(F.count("*").alias("total")))
    return c.orderBy(F.desc("created_at"), "claim_id").limit(20).join(total, F.lit(True)).select("claim_id", "text", seconds("created_at"), "total")


@query(BM25_SQL + ", best AS (SELECT question_id, event_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, event_id) AS rank FROM bm JOIN kb_events USING (event_id) WHERE run_id = 'en') WHERE rank <= 3) SELECT question_id, event_id, round(score, 6) AS score FROM best")
def o038_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three events of each question among those of one run: filtered first, then cut."""
    s = Store(spark, sf_dir)
    scores = s.bm25(_questions(spark, sf_dir)).join(s.events.where("run_id = 'en'").select("event_id"), "event_id", "left_semi")
    return retrieval.top_k(scores, "question_id", "event_id", 3).select("question_id", "event_id", rounded("score").alias("score"))


# --- bias, calibration, lessons


_WORDS = "CASE WHEN {n} THEN -1 WHEN {p} THEN 1 ELSE 0 END".format(
    n=" OR ".join(f"contains(lower(content), '{w}')" for w in text.NEGATIVE_WORDS), p=" OR ".join(f"contains(lower(content), '{w}')" for w in text.POSITIVE_WORDS)
)


@query(f"SELECT created_by, positive, negative, round(CASE WHEN positive + negative > 0 THEN (positive - negative) / (positive + negative)::DOUBLE END, 6) AS skew FROM (SELECT created_by, count(*) FILTER (pol > 0) AS positive, count(*) FILTER (pol < 0) AS negative FROM (SELECT created_by, {_WORDS} AS pol FROM (SELECT created_by, CASE event_id % 3 WHEN 0 THEN content || ' shipped' WHEN 1 THEN content || ' outage' ELSE content END AS content FROM kb_events)) GROUP BY 1)")
def o071_polarity_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a word of success, of failure, or neither after them."""
    n = F.col("event_id") % 3
    said = F.concat("content", F.when(n == 0, " shipped").when(n == 1, " outage").otherwise(""))
    return analytics.polarity_skew(Store(spark, sf_dir).events.withColumn("said", said), "created_by", text.word_polarity(F.col("said"))).withColumn("skew", rounded("skew"))


@query("SELECT run_id, arg_min(created_by, (-n, created_by)) AS top_source, round(max(n) / sum(n), 6)::DOUBLE AS share FROM (SELECT run_id, created_by, count(*) AS n FROM kb_events WHERE run_id IS NOT NULL AND created_by IS NOT NULL GROUP BY ALL) GROUP BY 1")
def o071_single_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Store(spark, sf_dir).events.where("run_id is not null and created_by is not null")
    return analytics.single_sourced(e, "run_id", "created_by").withColumn("share", rounded("share"))


@query(BINS_SQL.replace(", bins AS (SELECT least(floor(confidence * 10), 9)::BIGINT AS bin,", ", bins AS (SELECT created_by,") + " SELECT created_by, n, round(mean_confidence - accuracy, 6) AS gap FROM bins")
def o064_source_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more confident each author is than right."""
    c = Store(spark, sf_dir).claims
    return analytics.source_gaps(c, evidence.latest_verdict(model.kb_verdicts(c))).withColumn("gap", rounded("gap"))


@query(LESSONS_SQL.replace("consistency >= 0.3 AND confidence >= 0.2", "consistency >= 2 / 3 AND confidence >= 0.55") + "SELECT subject, kind, total::BIGINT AS total, result FROM lessons")
def o067_strict_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the usual bounds."""
    return analytics.lessons(Store(spark, sf_dir).actions, now()).select("subject", "kind", "total", "result")


# --- retrieval


@query(f"WITH {COS_SQL} SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM cs) WHERE rank <= 32", False)
def o164_event_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 nearest vectors of every hundredth one, exactly."""
    v = table(spark, sf_dir, "embeddings")
    scores = retrieval.cosine_scores(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")))
    return retrieval.top_k(scores, "query_id", "vec_id", 32).select("query_id", "vec_id", "rank")


def _full_text(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index of stems, its sizes, and every sixth and seventh word of each benchmark passage as a question."""
    events = Store(spark, sf_dir).events
    found = stored(spark, f"{sf_dir}/documents.parquet", "full-text", lambda: fulltext.positions(events).repartitionByRange("stem", "event_id").sortWithinPartitions("stem", "event_id"))
    counts = stored(spark, f"{sf_dir}/documents.parquet", "full-text-sizes", lambda: fulltext.sizes(events))
    words = F.split("text", r"\s+")
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.concat_ws(" ", F.get(words, F.lit(5)), F.get(words, F.lit(6))).alias("question"))
    return found, counts, questions


@query(None)
def o161_stemmed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten events that answer best by BM25 over stems; a test compares it with another full-text engine."""
    return fulltext.ranked(fulltext.search(*_full_text(spark, sf_dir)), 10).select("question_id", "event_id", "rank", rounded("score").alias("score"))


@query(None)
def o162_cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten events that answer best by cover density: both words as a phrase or apart, without a passage's first word."""
    found, _, q = _full_text(spark, sf_dir)
    first = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.get(F.split("text", r"\s+"), F.lit(0)).alias("barred"))
    asked = q.join(first, "question_id").select("question_id", F.concat(F.lit('"'), "question", F.lit('" or '), F.col("question"), F.lit(" -"), "barred").alias("question"))
    return fulltext.ranked(fulltext.cover_ranks(found, asked), 10).select("question_id", "event_id", "rank", rounded("score").alias("score"))


@query(None)
def o164_index_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an inverted-file index; a test holds it to a recall of 0.9 of o164_event_vectors."""
    v = table(spark, sf_dir, "embeddings")
    width = v.agg(F.max(F.size("embedding"))).first()[0] or 0
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector_index.search(vector_index.build(v, width), v, queries, 32).select("query_id", "vec_id", "rank")


@query(BM25_SQL + r""", top AS (SELECT question_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, event_id) AS rank FROM bm) WHERE rank <= 5),
gold AS (SELECT b.item_id AS question_id, e.event_id FROM benchmark b JOIN kb_events e ON contains(e.content, b.text)),
lab AS (SELECT question_id, event_id, CASE WHEN event_id % 4 = 0 THEN 'forbidden' ELSE 'gold' END AS label FROM gold)
SELECT (SELECT round(avg(bad), 6) FROM (SELECT max((label IS NOT NULL AND label = 'forbidden')::INT) AS bad FROM top LEFT JOIN lab USING (question_id, event_id) GROUP BY question_id)) AS forbidden_rate,
  (SELECT round(count(*) / (SELECT count(*) FROM lab WHERE label = 'gold'), 6) FROM top JOIN lab USING (question_id, event_id) WHERE label = 'gold') AS gold_survival,
  (SELECT round(count(*) FILTER (label IS NULL) / count(*), 6) FROM top LEFT JOIN lab USING (question_id, event_id)) AS noise""")
def o077_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that hold a passage are gold, but every fourth is forbidden."""
    s, q = Store(spark, sf_dir), _questions(spark, sf_dir)
    labels = retrieval.holding(s.events, q).withColumn("label", F.when(F.col("event_id") % 4 == 0, "forbidden").otherwise("gold"))
    found = retrieval.judged(retrieval.top_k(s.bm25(q), "question_id", "event_id", 5).select("question_id", "event_id"), labels)
    return found.select(*(rounded(c).alias(c) for c in found.columns))


@query("SELECT claim_id, row_number() OVER (PARTITION BY created_by ORDER BY (type = 'decision')::INT DESC, rank) AS boosted FROM (SELECT *, row_number() OVER (PARTITION BY created_by ORDER BY confidence DESC, claim_id) AS rank FROM kb_claims) WHERE rank <= 50")
def o168_intent_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each author's 50 most confident claims, as a question for decisions ranks them."""
    c = Store(spark, sf_dir).claims.select("created_by", "claim_id", "type", F.col("confidence").alias("score"))
    return retrieval.boosted(retrieval.top_k(c, "created_by", "claim_id", 50), "created_by", F.col("type") == text.question_intent("why did we choose it")).select("claim_id", "boosted")


@query(None)
def o177_answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each question's answer, with where its claims come from."""
    s = Store(spark, sf_dir)
    q = _questions(spark, sf_dir)
    store = recall.Store(model.kb_index(spark, sf_dir), model.kb_sizes(spark, sf_dir), model.kb_claim_index(spark, sf_dir), model.kb_claim_sizes(spark, sf_dir), s.trusted, s.evidence, s.edges)
    results = written(recall.recall(store, q, recall.Options(now(), limit=5)), "recalled")
    origins = evidence.origins(s.evidence, s.events.select("event_id", F.when(F.col("event_id") % 7 == 0, "https://registry").alias("pulled_from")))
    return recall.answer_texts(store, results, q, origins)


@query("SELECT claim_id, min(CASE WHEN event_id % 7 = 0 THEN 'https://registry' END) AS origin FROM kb_evidence GROUP BY 1".replace("min(CASE WHEN event_id % 7 = 0 THEN 'https://registry' END)", "coalesce(min(CASE WHEN event_id % 7 = 0 THEN 'https://registry' END), 'local')"))
def o190_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return evidence.origins(s.evidence, s.events.select("event_id", F.when(F.col("event_id") % 7 == 0, "https://registry").alias("pulled_from")))


@query("SELECT a.claim_id AS from_id, b.claim_id AS to_id FROM kb_claims a JOIN kb_claims b ON b.claim_id = a.claim_id - a.claim_id % 16777216 WHERE a.claim_id <> b.claim_id AND a.status = 'active'")
def o190_citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active claims that cite the first sentence of their document, themselves, and one that is not there."""
    c = Store(spark, sf_dir).claims
    first = (F.col("claim_id") - F.col("claim_id") % model.ROOM).cast("string")
    cited = F.concat(F.col("text"), F.lit(" as cl_"), first, F.lit(", cl_"), F.col("claim_id").cast("string"), F.lit(" and cl_none say, cl_"), first)
    return relate.citations(c.where("status = 'active'").select("claim_id", cited.alias("text")), c.select("claim_id", F.concat(F.lit("cl_"), F.col("claim_id").cast("string")).alias("ref")))


# --- freshness and lifecycle


@query(TRUST_SQL + "SELECT claim_id, freshness <= 0.3 AS stale FROM trusted")
def o133_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).trusted.select("claim_id", scoring.is_stale(F.greatest("latest", "last_verified"), now()).alias("stale"))


@query("SELECT claim_id, CASE WHEN claim_id % 6 = 1 THEN 'promoted' WHEN claim_id % 6 = 2 THEN 'superseded' ELSE lifecycle END AS lifecycle, verify_count + (claim_id % 6 = 3)::INT AS verify_count, CASE WHEN claim_id % 6 = 4 THEN 1700000000 ELSE valid_to END AS valid_to FROM kb_claims")
def o224_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims after updates by number: lifecycle set, verified, or closed."""
    c = Store(spark, sf_dir).claims
    n = F.col("claim_id") % 6
    updates = c.where(n.between(1, 4)).select(
        "claim_id", F.when(n == 1, "promoted").when(n == 2, "superseded").alias("set_lifecycle"), (n == 3).alias("verified"), F.when(n == 4, F.timestamp_seconds(F.lit(1_700_000_000))).alias("closed"))
    return lifecycle.updated(c, updates, now()).select("claim_id", "lifecycle", "verify_count", seconds("valid_to"))
