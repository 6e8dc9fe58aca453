"""Queries of text functions, scores, retrieval, graphs, relations, consolidation and streams; see catalog."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone import model
from siltstone.functions import scoring, text
from siltstone.model import now, table
from siltstone.operators import evidence, graph, lifecycle, retrieval, store, vector_index
from siltstone.plans.answer import QUESTION, answer
from siltstone.plans.catalog import GAP_SQL, LATEST_SQL, TRUST_SQL, Store, query, rounded, seconds
from siltstone.streaming import signals

TOKENS_SQL = "list_filter(list_transform(regexp_split_to_array(lower({0}), '\\s+'), lambda w: trim(w, ',.;:!?()[]{{}}\"''')), lambda w: w <> '')"


def tokens_sql(column: str) -> str:
    return TOKENS_SQL.format(column)


def words_sql(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


STEM_SQL = "CASE WHEN strlen(w) > 5 AND (ends_with(w, 'ed') OR ends_with(w, 'es')) THEN left(w, length(w) - 2) WHEN strlen(w) > 4 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END"
CONTENT_SQL = f"list_distinct(list_transform(list_filter({tokens_sql('text')}, lambda w: NOT list_contains({words_sql(text.STOP_WORDS)}, w) AND NOT list_contains({words_sql(text.NEGATIONS)}, w)), lambda w: {STEM_SQL}))"
NEGATED_SQL = f"len(list_intersect({tokens_sql('text')}, {words_sql(text.NEGATIONS)})) > 0"


# --- text functions


@query(f"SELECT event_id, len(t)::BIGINT AS n, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM (SELECT event_id, {tokens_sql('content')} AS t FROM kb_events)")
def o100_doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.doc_tokens(F.col("content"))
    return Store(spark, sf_dir).events.select("event_id", F.size(t).cast("long").alias("n"), F.sha2(F.array_join(t, " "), 256).alias("tokens_sha256"))


@query(f"SELECT claim_id, array_to_string(list_sort({CONTENT_SQL}), ' ') AS words, {NEGATED_SQL} AS negated FROM kb_claims")
def o101_content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return Store(spark, sf_dir).claims.select("claim_id", F.array_join(F.array_sort(text.content_tokens(t)), " ").alias("words"), text.negated(t).alias("negated"))


@query("SELECT claim_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda w: length(w) >= 3))), ' ') AS words FROM kb_claims")
def o104_token_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).claims.select("claim_id", F.array_join(F.array_sort(text.token_set(F.col("text"))), " ").alias("words"))


@query("SELECT claim_id, key, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS alnum FROM kb_claims")
def o105_normalisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).claims.select("claim_id", "key", text.alnum_key(F.col("text")).alias("alnum"))


@query("SELECT event_id, count(*) AS sentences, min(length(text)) AS shortest, max(length(text)) AS longest FROM statements GROUP BY 1")
def o108_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("text").cast("long")
    return model.kb_statements(spark, sf_dir).groupBy("event_id").agg(F.count("*").alias("sentences"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


@query("SELECT event_id, pos, text FROM (SELECT event_id, pos, trim(raw) AS text FROM raw_sentences) WHERE regexp_matches(text, '\\|.*\\|') OR regexp_matches(text, ':\\s*$')")
def o109_structural_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir).events.select("event_id", F.posexplode(text.sentences(F.col("content"))).alias("pos", "raw")).select("event_id", F.col("pos").cast("long").alias("pos"), F.trim("raw").alias("text"))
    return s.where(F.col("text").rlike(r"\|.*\|") | F.col("text").rlike(r":\s*$"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query(f"SELECT claim_id, CASE WHEN type = 'decision' OR regexp_matches(text, {_quoted(text.DURABLE_WORDS)}) THEN 0 WHEN regexp_matches(text, {_quoted(text.STATE_WORDS)}) THEN 14 ELSE 0 END AS days FROM kb_claims")
def o113_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).claims.select("claim_id", text.volatility_days(F.col("type"), F.col("text")).alias("days"))


INTENT_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(q, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{kind}'" for kind, words in text.INTENT_WORDS.items()) + " END"


@query(f"SELECT conv_id, turn, {INTENT_SQL} AS intent FROM (SELECT conv_id, turn, lower(text) AS q FROM conversations WHERE role = 'user')", False)
def o115_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", text.intent(F.col("text")).alias("intent"))


@query(f"SELECT claim_id, array_to_string(list_sort(list_filter(t, lambda w: NOT list_contains({words_sql(text.NEGATIONS)}, w))), ' ') AS core, len(list_filter(t, lambda w: list_contains({words_sql(text.NEGATIONS)}, w))) % 2 AS parity FROM (SELECT claim_id, {tokens_sql('text')} AS t FROM kb_claims)")
def o119_polarity_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return Store(spark, sf_dir).claims.select("claim_id", text.polarity_core(t).alias("core"), text.negation_parity(t).cast("long").alias("parity"))


@query("SELECT doc_id, CASE WHEN " + " OR ".join(f"contains(t, '{w}')" for w in text.NEGATIVE_WORDS) + " THEN -1 WHEN " + " OR ".join(f"contains(t, '{w}')" for w in text.POSITIVE_WORDS) + " THEN 1 ELSE 0 END AS polarity FROM (SELECT doc_id, lower(text) AS t FROM documents)", False)
def o120_word_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.word_polarity(F.col("text")).alias("polarity"))


@query("""SELECT conv_id, turn, CASE WHEN length(text) <= 200 THEN text WHEN strpos(right(text, 201), chr(10)) = 0 THEN right(text, 200) ELSE (SELECT string_agg(line, chr(10) ORDER BY i) FROM (SELECT line, i, sum(length(line) + 1) OVER (ORDER BY i DESC) - 1 AS used
  FROM (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i)) WHERE used <= 200) END AS kept FROM (SELECT conv_id, turn, regexp_replace(text, '[.] ', chr(10), 'g') AS text FROM conversations)""", False)
def o125_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a line for each sentence."""
    lines = F.regexp_replace("text", "[.] ", "\n")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.evict_to_limit(lines, 200).alias("kept"))


# --- scores


@query(TRUST_SQL + "SELECT claim_id, round(trust, 6) AS trust, round(staleness, 6) AS staleness FROM trusted")
def o132_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).trusted.select("claim_id", rounded("trust").alias("trust"), rounded("staleness").alias("staleness"))


@query(f"SELECT claim_id, round({GAP_SQL.replace('event_count', 'citation_count')}, 6) AS salience FROM kb_claims")
def o136_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.salience(F.col("confidence"), F.col("citation_count"), F.col("type"), F.col("source_authority"), F.col("verify_count"))
    return Store(spark, sf_dir).claims.select("claim_id", rounded(s).alias("salience"))


@query("SELECT o_orderkey, greatest(CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.75 WHEN '3-MEDIUM' THEN 0.5 ELSE 0.3 END, CASE o_orderstatus WHEN 'F' THEN 0.9 WHEN 'P' THEN 0.7 ELSE 0.0 END)::DOUBLE AS salience FROM orders", False)
def o138_outcome_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    risk = F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").otherwise("low")
    result = F.when(s == "F", "failure").when(s == "P", "partial").otherwise("success")
    return table(spark, sf_dir, "orders").select("o_orderkey", scoring.outcome_salience(risk, result).alias("salience"))


CREDIT_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, abs(l_discount - l_tax) / 0.02 AS s FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, round(s, 6) AS surprise, round(CASE WHEN s <= 1 THEN 0.1 * (1 - s) ELSE -0.1 * least(s - 1, 3.0) / 3 END, 6) + 0.0::DOUBLE AS credit FROM ({CREDIT_SQL})", False)
def o140_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.surprise(F.col("l_discount").cast("double"), F.col("l_tax").cast("double"), F.lit(0.02))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", s.alias("s")).select("l_orderkey", "l_linenumber", rounded("s").alias("surprise"), rounded(scoring.credit(F.col("s"))).alias("credit"))


@query(f"SELECT l_partkey, round(greatest(-0.3, least(0.3, sum(c / n))), 6) AS credit FROM (SELECT l_partkey, CASE WHEN s <= 1 THEN 0.1 * (1 - s) ELSE -0.1 * least(s - 1, 3.0) / 3 END AS c, count(*) OVER (PARTITION BY l_orderkey) AS n FROM ({CREDIT_SQL})) GROUP BY 1", False)
def o140_belief_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.surprise(F.col("l_discount").cast("double"), F.col("l_tax").cast("double"), F.lit(0.02))
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", scoring.credit(s).alias("c"))
    return lifecycle.split_credit(x, "l_orderkey", "l_partkey", "c").select("l_partkey", rounded("credit").alias("credit"))


@query("SELECT from_id, to_id, round(CASE type WHEN 'supports' THEN 1.0 WHEN 'causes' THEN 0.8 WHEN 'contradicts' THEN 0.5 ELSE 0.6 END * (1 + 0.5 * (least(greatest(strength, 1), 10) - 1) / 9), 6) AS weight FROM kb_edges")
def o146_edge_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).edges.select("from_id", "to_id", rounded(scoring.edge_weight(F.col("type"), F.col("strength"))).alias("weight"))


@query("SELECT from_id, to_id, round(CASE WHEN from_id % 3 = 0 AND to_id % 3 = 0 THEN least(strength + 1, 10) ELSE 1 + (strength - 1) * 0.8 END, 6) AS strength FROM kb_edges")
def o147_strengthen(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    x = lifecycle.strengthened(s.edges, s.claims.where("claim_id % 3 = 0").select("claim_id"), 1.0)
    return x.select("from_id", "to_id", rounded("strength").alias("strength"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", False)
def o149_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("other"))
    return v.join(b, "vec_id").select(F.col("vec_id").alias("a"), "b", rounded(scoring.cosine(F.col("embedding"), F.col("other"))).alias("score"))


@query("SELECT DISTINCT 'ls_' || substr(sha256(scope_service || '|' || scope_env || '||' || type), 1, 16) AS id, scope_service, scope_env, type FROM kb_claims")
def o152_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Store(spark, sf_dir).claims.select("scope_service", "scope_env", "type").distinct()
    return c.select(scoring.short_id("ls_", F.col("scope_service"), F.col("scope_env"), F.lit(""), F.col("type")).alias("id"), "scope_service", "scope_env", "type")


@query("SELECT DISTINCT json_extract_string(props, '$.k') AS k FROM events", False)
def o153_json_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("k")).distinct()


@query("SELECT from_id, to_id, CASE WHEN from_id % 23 = 0 THEN 'type' WHEN from_id % 11 = 0 THEN 'end' WHEN from_id % 7 = 0 THEN 'loop' ELSE 'strength' END AS reason FROM kb_edges WHERE from_id % 23 = 0 OR from_id % 11 = 0 OR from_id % 7 = 0 OR strength + 1 > 10")
def o156_invalid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges spoiled by their number, with the first rule that each breaks."""
    n = F.col("from_id")
    e = Store(spark, sf_dir).edges.select("from_id", "to_id", "type", "strength")
    spoiled = e.select(
        F.when((n % 11 == 0) & (n % 23 != 0), None).otherwise(n).alias("from_id"), F.when(n % 7 == 0, n).otherwise(F.col("to_id")).alias("to_id"), F.when(n % 23 == 0, "likes").otherwise(F.col("type")).alias("type"),
        (F.col("strength") + 1).alias("strength"), n.alias("n"), F.col("to_id").alias("t"),
    )
    return store.invalid_edges(spoiled, ["supports", "contradicts", "causes", "cites"]).select(F.col("n").alias("from_id"), F.col("t").alias("to_id"), "reason")


# --- retrieval

BM25_SQL = rf""",
q AS (SELECT item_id AS question_id, unnest(list_distinct({tokens_sql('text')})) AS term FROM benchmark),
tok AS (SELECT event_id, {tokens_sql('content')} AS t FROM kb_events),
stat AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean_size FROM tok),
tf AS (SELECT event_id, size, term, count(*) AS tf FROM (SELECT event_id, len(t) AS size, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT question_id, event_id, sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean_size))) AS score, count(*) AS terms FROM tf JOIN df USING (term) JOIN q USING (term), stat GROUP BY ALL)
"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage, whole."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


@query(BM25_SQL + "SELECT question_id, event_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, event_id) AS rank FROM bm) WHERE rank <= 5")
def o160_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = retrieval.top_k(Store(spark, sf_dir).bm25(_questions(spark, sf_dir)), "question_id", "event_id", 5)
    return x.select("question_id", "event_id", "rank", rounded("score").alias("score"))


@query(BM25_SQL + "SELECT question_id, event_id, round(score, 6) AS score FROM bm WHERE terms = (SELECT count(*) FROM q WHERE q.question_id = bm.question_id)")
def o161_bm25_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).bm25(_questions(spark, sf_dir), every_term=True).select("question_id", "event_id", rounded("score").alias("score"))


COS_SQL = "cs AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)"


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"WITH {COS_SQL} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM cs WHERE score >= 0.1) WHERE rank <= 10", False)
def o163_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = retrieval.cosine_scores(table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir), 0.1, 10)
    return retrieval.top_k(s, "query_id", "vec_id", 10).select("query_id", "vec_id", "rank", rounded("score").alias("score"))


FUSE_SQL = BM25_SQL + ", " + COS_SQL + r""",
words AS (SELECT question_id AS query_id, event_id AS item, score FROM bm),
vectors AS (SELECT query_id // 100 AS query_id, vec_id AS item, score FROM cs WHERE score > 0)
"""


def _both_signals(spark: SparkSession, sf_dir: str, best: int | None = None) -> tuple[DataFrame, DataFrame]:
    """best: only those that may be among so many best of their query."""
    words = Store(spark, sf_dir).bm25(_questions(spark, sf_dir), best=best).select(F.col("question_id").alias("query_id"), F.col("event_id").alias("item"), "score")
    # the least double above 0
    vectors = retrieval.cosine_scores(table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir), math.ulp(0.0), best)
    return words, vectors.select(F.floor(F.col("query_id") / 100).alias("query_id"), F.col("vec_id").alias("item"), "score")


@query(FUSE_SQL + "SELECT query_id, item, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) AS rank FROM words UNION ALL SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) FROM vectors) WHERE rank <= 32 GROUP BY ALL")
def o165_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = [retrieval.top_k(x, "query_id", "item", 32) for x in _both_signals(spark, sf_dir, 32)]
    return retrieval.reciprocal_ranks(ranked, "query_id", "item").select("query_id", "item", rounded("score").alias("score"))


@query(FUSE_SQL + r""", w2 AS (SELECT query_id, item, score / max(score) OVER (PARTITION BY query_id) AS w FROM words), v2 AS (SELECT query_id, item, score / max(score) OVER (PARTITION BY query_id) AS v FROM vectors)
SELECT query_id, item, round(CASE WHEN query_id NOT IN (SELECT query_id FROM words) THEN v WHEN query_id NOT IN (SELECT query_id FROM vectors) THEN w ELSE 0.5 * coalesce(w, 0) + 0.5 * coalesce(v, 0) END, 6) AS score FROM w2 FULL JOIN v2 USING (query_id, item)""")
def o166_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hybrid(*_both_signals(spark, sf_dir), "query_id", "item").select("query_id", "item", rounded("score").alias("score"))


@query("SELECT from_id AS claim_id, round(CASE WHEN s > 0 THEN s + 0.2 * (conf - 0.5) - 0.2 * (claim_id % 3) / 10.0 ELSE -1.0 END, 6) AS score FROM (SELECT claim_id AS from_id, claim_id, confidence AS conf, CASE WHEN claim_id % 2 = 0 THEN (claim_id % 10) / 10.0 ELSE 0 END AS s FROM kb_claims)")
def o167_claim_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Store(spark, sf_dir).claims.select("claim_id", "confidence")
    scores = c.where("claim_id % 2 = 0").select("claim_id", (F.col("claim_id") % 10 / 10.0).alias("score"))
    return retrieval.claim_ranking(c, scores, F.col("confidence"), F.col("claim_id") % 3 / 10.0).select("claim_id", rounded("score").alias("score"))


@query("SELECT run_id, event_id FROM (SELECT run_id, event_id, sum(length(content)) OVER (PARTITION BY run_id ORDER BY ts DESC, event_id) AS used FROM kb_events) WHERE used / 4 <= 20000")
def o171_context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = Store(spark, sf_dir).events.select("run_id", "event_id", "ts", F.col("content").alias("line"))
    return retrieval.within_budget(lines, "run_id", [F.desc("ts"), F.asc("event_id")], 20_000).select("run_id", "event_id")


@query(TRUST_SQL + BM25_SQL.replace("FROM benchmark)", f"FROM (SELECT 0 AS item_id, '{QUESTION}' AS text))") + r""",
top AS (SELECT event_id FROM bm ORDER BY round(score, 9) DESC, event_id LIMIT 5),
seen AS (SELECT * FROM trusted t WHERE status <> 'deprecated' AND durability <> 'session' AND EXISTS (SELECT 1 FROM kb_evidence v WHERE v.claim_id = t.claim_id AND v.event_id IN (SELECT event_id FROM top))),
cred AS (
  SELECT *, least(1, greatest(0, (0.5 * CASE WHEN trust = 0 THEN 0.5 ELSE trust END + 0.15 * CASE WHEN source_authority = 0 THEN 0.5 ELSE source_authority END
    + 0.13 * least(1, ln(1 + citation_count) / ln(11)) + 0.10 * exp(-greatest(eff_age, 0) / 180.0)
    + 0.05 * CASE WHEN eff_age <= 14 THEN 1.0 WHEN eff_age <= 180 THEN 0.75 WHEN trust >= 0.6 THEN 0.65 ELSE 0.25 END) / CASE WHEN requirement IS NULL THEN 0.93 ELSE 1 END + CASE WHEN requirement IS NULL OR pass_count + fail_count = 0 THEN 0 ELSE 0.07 * abs(pass_count - fail_count) / (pass_count + fail_count)::DOUBLE END)) AS cred
  FROM (SELECT *, (1706745600 - coalesce(last_verified, valid_from, created_at)) / 86400.0::DOUBLE AS eff_age FROM seen)),
admitted AS (SELECT * FROM cred WHERE visibility IN ('personal', 'team') AND valid_from <= 1706745600 AND (valid_to IS NULL OR 1706745600 < valid_to)),
conf AS (SELECT CASE WHEN count(*) = 0 THEN 0 ELSE greatest(0, least(1, 0.4 * avg(cred) + 0.2 * least(count(*) / 5.0, 1) - least(0.1 * (SELECT count(*) FROM kb_edges e JOIN admitted a ON e.from_id = a.claim_id JOIN admitted b ON e.to_id = b.claim_id WHERE e.type = 'contradicts'), 0.3)
    + 0.1 * avg(1 - least((1706745600 - created_at) / 3600.0 / 720, 1)))) END AS confidence FROM admitted)
SELECT claim_id, text, round(cred, 6) AS trust, (SELECT round(confidence, 6) FROM conf) AS confidence FROM admitted""")
def answer_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer(spark, sf_dir).select("claim_id", "text", rounded("trust").alias("trust"), rounded("confidence").alias("confidence"))


@query(BM25_SQL + r""", ranked AS (SELECT question_id, event_id, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, event_id) AS rank FROM bm),
gold AS (SELECT b.item_id AS question_id, e.event_id FROM benchmark b JOIN kb_events e ON contains(e.content, b.text))
SELECT count(*) AS questions, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM (SELECT question_id, min(rank) AS r FROM gold LEFT JOIN ranked USING (question_id, event_id) GROUP BY 1)""")
def o077_retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of a passage are those that hold it."""
    q, e = _questions(spark, sf_dir), Store(spark, sf_dir).events
    gold = retrieval.holding(e, q).select("question_id", "event_id")
    return retrieval.quality(retrieval.ranks_of(Store(spark, sf_dir).bm25(q), gold), gold).select("questions", rounded("mrr").alias("mrr"), rounded("hit_rate").alias("hit_rate"))


# --- graphs


@query(r""", RECURSIVE_MARK
SELECT claim_id, min(hop) AS hop FROM walk GROUP BY 1""".replace(", RECURSIVE_MARK", r""", around AS (SELECT from_id, to_id FROM kb_edges UNION SELECT to_id, from_id FROM kb_edges),
h0 AS (SELECT claim_id, 0 AS hop FROM kb_claims WHERE claim_id % 50 = 0), h1 AS (SELECT DISTINCT to_id AS claim_id, 1 AS hop FROM around JOIN h0 ON from_id = claim_id),
h2 AS (SELECT DISTINCT to_id AS claim_id, 2 AS hop FROM around JOIN h1 ON from_id = claim_id), h3 AS (SELECT DISTINCT to_id AS claim_id, 3 AS hop FROM around JOIN h2 ON from_id = claim_id),
walk AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)"""))
def o180_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return graph.hops(s.edges, s.claims.where("claim_id % 50 = 0"), 3)


@query(r""", w AS (SELECT from_id, to_id, CASE type WHEN 'supports' THEN 1.0 WHEN 'causes' THEN 0.8 WHEN 'contradicts' THEN 0.5 ELSE 0.6 END * (1 + 0.5 * (least(greatest(strength, 1), 10) - 1) / 9) AS weight FROM kb_edges),
around AS (SELECT * FROM w UNION ALL SELECT to_id, from_id, weight FROM w),
s1 AS (SELECT to_id AS claim_id, confidence * weight * 0.5 AS energy FROM around JOIN kb_claims ON from_id = claim_id WHERE claim_id % 50 = 0),
f1 AS (SELECT claim_id, max(energy) AS energy FROM s1 GROUP BY 1),
s2 AS (SELECT to_id AS claim_id, energy * weight * 0.5 AS energy FROM around JOIN f1 ON from_id = claim_id)
SELECT claim_id, round(sum(energy), 6) AS activation FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY 1""")
def o181_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    seeds = s.claims.where("claim_id % 50 = 0").select("claim_id", F.col("confidence").alias("score"))
    return graph.activation(s.edges, seeds).select("claim_id", rounded("activation").alias("activation"))


@query(r""", base AS (SELECT claim_id, rank, (201 - rank) / 200.0::DOUBLE AS base FROM (SELECT claim_id, row_number() OVER (ORDER BY confidence DESC, claim_id) AS rank FROM kb_claims) WHERE rank <= 200),
w AS (SELECT from_id, to_id, CASE type WHEN 'supports' THEN 1.0 WHEN 'causes' THEN 0.8 WHEN 'contradicts' THEN 0.5 ELSE 0.6 END * (1 + 0.5 * (least(greatest(strength, 1), 10) - 1) / 9) AS weight FROM kb_edges),
around AS (SELECT * FROM w UNION ALL SELECT to_id, from_id, weight FROM w),
f0 AS (SELECT claim_id, base AS energy FROM base WHERE rank <= 5),
s1 AS (SELECT to_id AS claim_id, energy * weight * 0.5 AS energy FROM around JOIN f0 ON from_id = claim_id WHERE to_id NOT IN (SELECT claim_id FROM f0)), f1 AS (SELECT claim_id, max(energy) AS energy FROM s1 GROUP BY 1),
s2 AS (SELECT to_id AS claim_id, energy * weight * 0.5 AS energy FROM around JOIN f1 ON from_id = claim_id WHERE to_id NOT IN (SELECT claim_id FROM f0) AND to_id NOT IN (SELECT claim_id FROM f1)),
act AS (SELECT claim_id, sum(energy) AS active FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY 1)
SELECT claim_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, rank) AS rank FROM (SELECT claim_id, rank, base + 0.35 * least(coalesce(active, 0), 1) AS score FROM base LEFT JOIN act USING (claim_id))""")
def o181_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 most confident claims, ranked anew by what the first five activate."""
    c = Store(spark, sf_dir).claims.select("claim_id", "confidence").orderBy(F.desc("confidence"), "claim_id").limit(200)
    listed = c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("confidence"), "claim_id")))
    return graph.reranked(listed, Store(spark, sf_dir).edges).select("claim_id", rounded("score").alias("score"), "rank")


@query(r"""WITH RECURSIVE pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35),
around AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
walk AS (SELECT a AS node, a AS root FROM around UNION SELECT b, root FROM walk JOIN around ON node = a WHERE root < b)
SELECT node, min(root) AS root FROM walk GROUP BY 1 HAVING min(root) <> node""", False)
def o185_label_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_index.components_in_groups(table(spark, sf_dir, "embeddings"), 0.35, "label").select("node", "root")


@query("SELECT least(a.vec_id, b.vec_id) AS a, greatest(a.vec_id, b.vec_id) AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.45", False)
def o051_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of all vectors from a cosine of 0.45, which some of these tables' rows reach."""
    return vector_index.similar_pairs(table(spark, sf_dir, "embeddings"), 0.45).select("a", "b", rounded("score").alias("score"))


@query(None)
def o185_semantic_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all vectors, blocks apart by their bounds skipped; a test compares it with brute force."""
    return vector_index.similar_components(table(spark, sf_dir, "embeddings"), 0.35).select("node", "root")


@query("SELECT claim_id AS old_id, first_id AS new_id FROM (SELECT claim_id, min(claim_id) OVER (PARTITION BY created_by, type, scope_service, citation_count) AS first_id FROM kb_claims) WHERE claim_id <> first_id")
def o093_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Store(spark, sf_dir).claims
    return store.exact_duplicates(c.select("claim_id", F.struct("created_by", "type", "scope_service", "citation_count").alias("key")))


@query("SELECT new_from AS from_id, new_to AS to_id, type, strength FROM (SELECT *, row_number() OVER (PARTITION BY type, new_from, new_to ORDER BY from_id, to_id) AS rn FROM (SELECT *, from_id - from_id % 2 AS new_from, to_id - to_id % 2 AS new_to FROM kb_edges) WHERE new_from <> new_to) WHERE rn = 1")
def o078_repoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    ends = s.edges.select(F.explode(F.array("from_id", "to_id")).alias("old_id")).where("old_id % 2 = 1").distinct()
    return evidence.repointed(s.edges, ends.withColumn("new_id", F.col("old_id") - 1))


@query(TRUST_SQL + r""", pairs AS (SELECT e.from_id, e.to_id, a.trust AS ft, b.trust AS tt, a.lifecycle AS fl, b.lifecycle AS tl, a.trust + (a.lifecycle = 'promoted')::INT >= b.trust + (b.lifecycle = 'promoted')::INT AS first
  FROM kb_edges e JOIN trusted a ON a.claim_id = e.from_id JOIN trusted b ON b.claim_id = e.to_id WHERE e.type = 'contradicts' AND a.valid_to IS NULL AND b.valid_to IS NULL AND a.status <> 'deprecated' AND b.status <> 'deprecated')
SELECT CASE WHEN first THEN from_id ELSE to_id END AS challenged, CASE WHEN first THEN to_id ELSE from_id END AS challenger FROM pairs WHERE CASE WHEN first THEN fl ELSE tl END = 'promoted' OR CASE WHEN first THEN ft ELSE tt END >= 0.7""")
def o189_hypercorrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    return evidence.hypercorrections(s.edges, s.trusted).select("challenged", "challenger")


# --- relations

@query("""SELECT a.claim_id AS a, b.claim_id AS b, CASE WHEN sign(a.pass_count - a.fail_count) = sign(b.pass_count - b.fail_count) THEN 'supports' ELSE 'contradicts' END AS type FROM kb_claims a JOIN kb_claims b ON a.requirement = b.requirement AND a.claim_id < b.claim_id
  WHERE a.pass_count <> a.fail_count AND b.pass_count <> b.fail_count AND (a.scope_service = b.scope_service OR a.scope_service = 'svc3' OR b.scope_service = 'svc3')""")
def o207_test_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services are scopes, and svc3 is none."""
    scope = F.when(F.col("scope_service") != "svc3", F.col("scope_service"))
    return lifecycle.test_conflicts(Store(spark, sf_dir).claims.withColumn("scope", scope))


# --- consolidation


@query(TRUST_SQL + f"SELECT claim_id FROM trusted WHERE valid_to IS NULL AND lifecycle <> 'promoted' AND trust < 0.3 AND {GAP_SQL} < 0.66")
def o222_forget_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.to_forget(Store(spark, sf_dir).trusted, 0.3).select("claim_id")


@query(LATEST_SQL + " SELECT claim_id, CASE WHEN kind = 'refutes' THEN 1706745600 ELSE valid_to END AS valid_to, verify_count + (kind = 'validates')::INT AS verify_count FROM kb_claims JOIN latest USING (claim_id)")
def o223_apply_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Store(spark, sf_dir).claims
    x = lifecycle.apply_verdicts(c, evidence.latest_verdict(model.kb_verdicts(c)), now()).where("kind is not null")
    return x.select("claim_id", seconds("valid_to"), "verify_count")


@query(r"""SELECT user_id AS claim_id, count(*) FILTER (event_type = 'error' AND us > coalesce(last_good, -1)) AS streak, count(*) FILTER (event_type <> 'error') AS helpful, round(pow(0.9, count(*) FILTER (event_type = 'error')), 6) AS confidence,
  count(*) FILTER (event_type = 'error' AND us > coalesce(last_good, -1)) >= 3 AS contested FROM (SELECT *, epoch_us(ts)::HUGEINT * 1000000 + event_id AS us, max(CASE WHEN event_type <> 'error' THEN epoch_us(ts)::HUGEINT * 1000000 + event_id END) OVER (PARTITION BY user_id) AS last_good FROM events) GROUP BY 1""", False)
def o225_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("claim_id"), F.struct(F.unix_micros("ts").alias("us"), "event_id").alias("at"), (F.col("event_type") != "error").alias("helpful"))
    return store.feedback(e).withColumn("confidence", rounded("confidence"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_discount - l_tax) <= 0.025 THEN 'validates' ELSE 'refutes' END AS verdict FROM lineitem", False)
def o226_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.abs(F.col("l_discount").cast("double") - F.col("l_tax").cast("double"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(d <= 0.025, "validates").otherwise("refutes").alias("verdict"))


PLAIN_SQL = "list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: trim(w, '.,;:!?()[]{}\"''`'))"
PATH_SQL = "(NOT contains(w, '://') AND (regexp_matches(w, '^.:[\\\\/]') OR starts_with(w, './') OR starts_with(w, '../') OR (starts_with(w, '/') AND length(w) - length(replace(w, '/', '')) >= 2)))"
LOCAL_SQL = f"len(list_filter({PLAIN_SQL}, lambda w: {PATH_SQL} OR (NOT contains(w, '://') AND strpos(w, '.') > 0 AND list_contains({words_sql(text.CODE_ENDINGS)}, lower(regexp_extract(w, '^.+\\.([^.]+)$', 1)))) OR (regexp_full_match(w, '[0-9a-f]{{7,40}}') AND regexp_matches(w, '[0-9]')))) > 0"
FLOAT_SQL = f"CASE WHEN status <> 'active' THEN 'inactive' WHEN alnum = '' THEN 'empty' WHEN rn > 1 THEN 'duplicate' WHEN trust < 0.6 THEN 'low_trust' WHEN {LOCAL_SQL} THEN 'repo_local' ELSE 'float' END"


@query(TRUST_SQL + f", keyed AS (SELECT *, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS alnum FROM trusted), numbered AS (SELECT *, row_number() OVER (PARTITION BY status = 'active', alnum ORDER BY claim_id) AS rn FROM keyed) SELECT claim_id, {FLOAT_SQL} AS decision FROM numbered")
def o231_floatback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.floatback(Store(spark, sf_dir).trusted).select("claim_id", "decision")


@query("SELECT created_by, type, bool_or(lifecycle = 'promoted') AS any_promoted, bool_and(status = 'active') AS all_active FROM kb_claims GROUP BY ALL")
def o233_class_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, sf_dir).claims.groupBy("created_by", "type").agg(F.bool_or(F.col("lifecycle") == "promoted").alias("any_promoted"), F.bool_and(F.col("status") == "active").alias("all_active"))


@query(TRUST_SQL + r""", ranked AS (SELECT scope_service, claim_id, trust, row_number() OVER w AS rn, trust - lead(trust) OVER w AS gap FROM trusted WINDOW w AS (PARTITION BY scope_service ORDER BY round(trust, 9) DESC, claim_id))
SELECT scope_service, claim_id AS winner, coalesce(gap < 0.05, false) AS ambiguous FROM ranked WHERE rn = 1""")
def o236_requirement_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.winners_by(Store(spark, sf_dir).trusted, "scope_service")


@query(f"SELECT half_life_days, count(*) AS n FROM (SELECT CASE WHEN type = 'decision' OR regexp_matches(text, {_quoted(text.DURABLE_WORDS)}) THEN 0 WHEN regexp_matches(text, {_quoted(text.STATE_WORDS)}) THEN 14 ELSE 0 END AS half_life_days FROM kb_claims WHERE status <> 'deprecated' AND half_life_days = 0 AND claim_id % 3 <> 0) GROUP BY 1")
def o250_half_life_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the claims bear the stamp of this version."""
    c = Store(spark, sf_dir).claims.withColumn("half_life_by", F.when(F.col("claim_id") % 3 == 0, "v1"))
    return lifecycle.half_life_plan(c, "v1").groupBy(F.col("half_life_days").cast("long").alias("half_life_days")).agg(F.count("*").alias("n"))


COMMANDS_SQL = "CASE " + " ".join(f"WHEN contains(c, '{part}') THEN '{kind}'" for part, kind in lifecycle.COMMANDS) + " END"


@query(f"""WITH u AS (SELECT event_id, lower('cd x && ' || ['Go Test ./...', 'git push', 'ls', 'kubectl apply -f a', 'pytest -q', 'npm run build'][event_id % 6 + 1]) AS c FROM events WHERE event_type <> 'error')
SELECT u.event_id AS use_id, {COMMANDS_SQL} AS kind, r.event_type = 'error' AS failed FROM u JOIN events r ON r.event_id = u.event_id + 1 WHERE {COMMANDS_SQL} IS NOT NULL""", False)
def o254_tool_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event but errors is a use of a tool with a made-up command, and the next event is its result."""
    e = table(spark, sf_dir, "events")
    made = F.array(*map(F.lit, ("Go Test ./...", "git push", "ls", "kubectl apply -f a", "pytest -q", "npm run build")))
    uses = e.where("event_type <> 'error'").select(F.col("event_id").alias("use_id"), F.concat(F.lit("cd x && "), F.get(made, (F.col("event_id") % 6).cast("int"))).alias("command"))
    results = e.select((F.col("event_id") - 1).alias("use_id"), (F.col("event_type") == "error").alias("is_error"), F.col("ts").alias("at"))
    return lifecycle.tool_actions(uses, results)


@query(TRUST_SQL + "SELECT claim_id, type, rank FROM (SELECT claim_id, type, row_number() OVER (PARTITION BY type ORDER BY round(trust, 9) DESC, claim_id) AS rank FROM trusted WHERE status = 'active') WHERE rank <= 10")
def o257_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("type").orderBy(F.desc(F.round("trust", 9)), "claim_id")
    return Store(spark, sf_dir).trusted.where("status = 'active'").withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("claim_id", "type", "rank")


@query("SELECT o_custkey, o_orderkey, row_number() OVER w AS version, lead(o_orderdate) OVER w AS until FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", False)
def o258_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.versions(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "version", "until")


@query("SELECT user_id, round(greatest(0.5, least(2, CASE WHEN usual = 0 THEN 1 ELSE recent / usual END)), 6) AS plasticity FROM (SELECT user_id, avg(value) FILTER (rn <= 5) AS recent, avg(value) AS usual FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) GROUP BY 1)", False)
def o082_plasticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return store.plasticity(e, "user_id", ["ts", "event_id"], "value").select("user_id", rounded("plasticity").alias("plasticity"))


@query("SELECT claim_id, min(ts) AS first_seen, arg_min(run_id, ts * 1000000 + event_id) AS run_id FROM kb_evidence JOIN kb_events USING (event_id) GROUP BY 1")
def o084_first_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Store(spark, sf_dir)
    x = s.evidence.join(s.events, "event_id").groupBy("claim_id").agg(F.min("ts").alias("first_seen"), F.min_by("run_id", F.struct("ts", "event_id")).alias("run_id"))
    return x.select("claim_id", seconds("first_seen"), "run_id")


# --- streams


@query("SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", False)
def o241_hourly_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = signals.hourly(signals.batch(table(spark, sf_dir, "events")))
    return x.select(F.unix_micros("window.start").alias("hour_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH w AS (SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n FROM events GROUP BY ALL),
z AS (SELECT *, (n - avg(n) OVER p) / nullif(stddev_pop(n) OVER p, 0) AS z, avg(n) OVER p AS mean FROM w WINDOW p AS (PARTITION BY event_type))
SELECT epoch_us(h) AS hour_us, event_type, n, CASE WHEN n <= mean / 10 THEN 'stall' WHEN z >= 2 THEN 'spike' ELSE 'drop' END AS signal, round(z, 6) AS strength FROM z WHERE z IS NOT NULL AND (n <= mean / 10 OR abs(z) >= 2)""", False)
def o241_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = signals.signals(signals.hourly(signals.batch(table(spark, sf_dir, "events"))))
    return x.select(F.unix_micros("window.start").alias("hour_us"), "event_type", "n", "signal", rounded("strength").alias("strength"))


@query("""WITH w AS (SELECT epoch(date_trunc('hour', ts)) / 3600.0 AS x, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL)
SELECT event_type, round(regr_slope(n, x), 6) AS slope, CASE WHEN regr_r2(n, x) >= 0.1 AND regr_slope(n, x) > 0 THEN 'rising' WHEN regr_r2(n, x) >= 0.1 AND regr_slope(n, x) < 0 THEN 'falling' ELSE 'flat' END AS trend FROM w GROUP BY 1""", False)
def o241_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.trends(signals.hourly(signals.batch(table(spark, sf_dir, "events")))).select("event_type", rounded("slope").alias("slope"), "trend")


PATTERNS_SQL = """WITH w AS (SELECT event_type, (epoch(date_trunc('hour', ts)) / 3600)::BIGINT AS hour, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
e AS (SELECT event_type, min(hour) AS a, max(hour) AS b FROM w GROUP BY 1), g AS (SELECT event_type, unnest(range(a, b + 1)) AS hour FROM e),
s AS (SELECT event_type, hour, coalesce(n, 0) AS n FROM g LEFT JOIN w USING (event_type, hour)),
t AS (SELECT event_type, count(*) AS hours, avg(n) AS mean, stddev_pop(n) AS sd, median(n) AS middle, min(hour) AS a, max(hour) AS b, regr_r2(n, hour) AS fit FROM s GROUP BY 1 HAVING stddev_pop(n) > 0),
x AS (SELECT *, (n - mean) / sd AS z, hours / (hours + 24) AS seen FROM s JOIN t USING (event_type)),
m AS (SELECT event_type, median(abs(n - middle)) / 0.6745 AS spread FROM x GROUP BY 1),
r AS (SELECT p.event_type, q.hour - p.hour AS lag, p.hours, p.a, p.b, sum(p.z * q.z) / count(*) AS r FROM x p JOIN x q ON p.event_type = q.event_type AND q.hour - p.hour BETWEEN 2 AND 48 AND (q.hour - p.hour) * 2 <= p.hours GROUP BY ALL),
gaps AS (SELECT event_type, count(gap) AS gaps, stddev_pop(gap) / avg(gap) AS uneven, min(hour) AS a, max(hour) AS b FROM (SELECT event_type, hour, hour - lag(hour) OVER (PARTITION BY event_type ORDER BY hour) AS gap FROM x WHERE z >= 2) GROUP BY 1),
o AS (SELECT event_type, CASE WHEN n <= mean / 10 THEN 'stall' WHEN z >= 2 THEN 'spike' ELSE 'drop' END AS pattern, CASE WHEN n <= mean / 10 THEN 1 - n / mean ELSE abs(z) / 4 END AS strength, seen AS confidence, hour AS first_hour, hour AS last_hour FROM x WHERE n <= mean / 10 OR abs(z) >= 2
  UNION ALL SELECT event_type, 'anomaly', abs(n - middle) / spread / 7, seen, hour, hour FROM x JOIN m USING (event_type) WHERE spread > 0 AND abs(n - middle) / spread >= 3.5
  UNION ALL SELECT event_type, 'trend', sqrt(fit), fit * hours / (hours + 24), a, b FROM t WHERE fit >= 0.1
  UNION ALL SELECT event_type, 'seasonality', r, least(1, hours / (lag * 8)), a, b FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(r, 9) DESC, lag) = 1) WHERE r >= 0.3
  UNION ALL SELECT event_type, 'recurrence', 1 - uneven, gaps / (gaps + 2), a, b FROM gaps WHERE gaps >= 3 AND uneven <= 0.25)
SELECT event_type, pattern, round(least(1, strength), 6) AS strength, round(confidence, 6) AS confidence, first_hour, last_hour FROM o"""


@query(PATTERNS_SQL, False)
def o241_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven patterns of each event type; tests plant one of each."""
    x = signals.patterns(signals.hourly(signals.batch(table(spark, sf_dir, "events"))))
    return x.select("event_type", "pattern", rounded("strength").alias("strength"), rounded("confidence").alias("confidence"), "first_hour", "last_hour")


@query("SELECT event_id, min(event_type) AS event_type FROM events GROUP BY 1", False)
def o244_redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table delivered twice as a stream: each event once."""
    return signals.delivered_twice(spark, sf_dir).select("event_id", "event_type")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1", False)
def o244_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.counted_stream(spark, sf_dir)
