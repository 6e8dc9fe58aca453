"""The knowledge model's frames, derived from the given tables: events, claims, evidence, edges, actions and outcomes.

Events are documents; claims are their sentences, copies merged by dedup key, so that a claim may have several events as
evidence. Attributes that the tables lack follow from the claim's number. All times are whole seconds after BASE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.text import dedup_key, sentences
from siltstone.operators import evidence, retrieval
from siltstone.operators.lifecycle import ranked
from siltstone.sources.shared import HEAVY, heavy_split, lowered_batches, stored

BASE, NOW, DAY = 1_685_577_600, 1_706_745_600, 86_400
#: Room for the sentences of one document in a claim's number (a document of more stops a query with an error), and the first
#: document id that is not its own number: negative and greater ids are numbered from there, in their order.
ROOM, FAR_IDS = 1 << 24, 1 << 38


def now() -> Column:
    return F.timestamp_seconds(F.lit(NOW))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({x.name: instant(x.name) for x in df.schema if x.dataType.simpleString() == "timestamp_ntz"})


def instant(column: str) -> Column:
    """A time without zone, taken as UTC whatever the session's zone."""
    return F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone())


def kb_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without an id are no events."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    at = F.timestamp_seconds(F.lit(BASE) + F.col("doc_id") % 240 * DAY)
    return d.select(F.col("doc_id").alias("event_id"), F.col("lang").alias("run_id"), F.col("source").alias("created_by"), F.coalesce("text", F.lit("")).alias("content"), at.alias("ts"))


def with_numbers(events: DataFrame) -> DataFrame:
    """Events with their document number: the id, or its place among those out of range."""
    near = F.col("event_id").between(0, FAR_IDS - 1)
    far = events.where(~near).select("event_id").distinct()
    own = events.withColumn("doc_number", F.col("event_id"))
    if far.isEmpty():
        return own
    numbers = ranked(far, [F.col("event_id")]).select("event_id", (F.lit(FAR_IDS - 1) + F.col("rank")).alias("doc_number"))
    return own.where(near).unionByName(events.where(~near).join(numbers, "event_id").select(own.columns))


def statements(events: DataFrame) -> DataFrame:
    """event_id, pos, number, text, key of each sentence of 12 characters or more."""
    s = with_numbers(events).select("event_id", "doc_number", F.posexplode(sentences(F.col("content"))).alias("pos", "raw"))
    number = F.when(F.col("pos") < ROOM, F.col("doc_number") * ROOM + F.col("pos")).otherwise(F.raise_error(F.lit("a document has too many sentences")).cast("long"))
    s = s.select("event_id", "pos", number.alias("number"), F.trim(F.rtrim("raw", F.lit(". "))).alias("text"))
    return s.where(F.char_length("text") >= 12).withColumn("key", dedup_key(F.col("text")))


def kb_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements with two hashes of their key, h and g, by which they meet in place of their text; the key itself
    follows from the text and is not stored."""
    def build() -> DataFrame:
        return statements(kb_events(spark, sf_dir)).withColumns({"h": F.xxhash64("key"), "g": F.xxhash64(F.lit("key"), "key")}).drop("key")

    return stored(spark, f"{sf_dir}/documents.parquet", "statements", build).withColumn("key", dedup_key(F.col("text")))


def kb_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, event_id, number of every statement: the claim is the first statement of an equal key. Keys of many
    statements are joined by broadcast."""
    def build() -> DataFrame:
        s = kb_statements(spark, sf_dir).select("h", "g", "number", "event_id")
        first = s.groupBy("h", "g").agg(F.min("number").alias("claim_id"), F.count("*").alias("k"))
        return heavy_split(s, ["h", "g"], first, max(1000, s.count() // HEAVY)).select("claim_id", "event_id", "number")

    return stored(spark, f"{sf_dir}/documents.parquet", "sources", build)


def claim_columns() -> dict[str, Column]:
    n = F.col("claim_id")
    made = F.lit(BASE) + n % 240 * DAY + n % 3600
    return {
        "type": F.element_at(F.array(*map(F.lit, ("fact", "hypothesis", "decision"))), (n % 3 + 1).cast("int")),
        "confidence": F.lit(0.5) + (n % 49) / 100.0,
        "created_by": F.concat(F.lit("u"), (n % 11).cast("string")),
        "created_at": F.timestamp_seconds(made),
        "status": F.when(n % 17 == 0, "deprecated").when(n % 13 == 0, "contested").otherwise("active"),
        "valid_from": F.timestamp_seconds(made),
        "valid_to": F.when(n % 7 == 0, F.timestamp_seconds(made + 30 * DAY)),
        "last_verified": F.when(n % 3 == 0, F.timestamp_seconds(made + 20 * DAY)),
        "verify_count": n % 4,
        "half_life_days": F.when(n % 4 == 0, 0).otherwise(n % 4 * 30),
        "durability": F.when(n % 19 == 0, "session").otherwise("durable"),
        "visibility": F.when(n % 5 == 0, "personal").when(n % 5 == 4, "org").otherwise("team"),
        "scope_service": F.concat(F.lit("svc"), (n % 4).cast("string")),
        "scope_env": F.when(n % 2 == 0, "prod").otherwise("dev"),
        "lifecycle": F.when(n % 10 == 0, "promoted").otherwise("captured"),
        "source_authority": (n % 10) / 10.0,
        "citation_count": n % 12,
        "pass_count": n % 6,
        "fail_count": n % 5,
        "requirement": F.when(n % 5 != 0, F.concat(F.lit("r"), F.floor(n / ROOM).cast("string"))),
        "last_run_at": F.when((n % 5 != 0) & (n % 4 != 3), F.timestamp_seconds(F.lit(BASE) + n % 200 * DAY + n % 7 * 3600)),
    }


def claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, text and the trust inputs of each distinct statement; all else of a claim follows from these, and texts are
    dealt out and written once."""
    def build() -> DataFrame:
        own = kb_sources(spark, sf_dir).where("number = claim_id").select("claim_id")
        inputs = evidence.trust_inputs(own, kb_evidence(spark, sf_dir), kb_events(spark, sf_dir))
        return kb_statements(spark, sf_dir).select(F.col("number").alias("claim_id"), "text").join(inputs, "claim_id")

    return stored(spark, f"{sf_dir}/documents.parquet", "claims", build)


def kb_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each distinct statement."""
    return claim_rows(spark, sf_dir).select("claim_id", "text", dedup_key(F.col("text")).alias("key"), *(x.alias(name) for name, x in claim_columns().items()))


def kb_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, event_id, each pair once."""
    return stored(spark, f"{sf_dir}/documents.parquet", "evidence", lambda: kb_sources(spark, sf_dir).select("claim_id", "event_id").distinct())


def kb_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each claim to the next one of the same document."""
    def build() -> DataFrame:
        n = F.col("claim_id")
        after = F.lead("claim_id").over(Window.partitionBy(F.floor(n / ROOM)).orderBy("claim_id"))
        kind = F.when(n % 6 == 0, "contradicts").when(n % 6 == 1, "causes").when(n % 6 == 2, "cites").otherwise("supports")
        e = kb_claims(spark, sf_dir).select(n.alias("from_id"), after.alias("to_id"), kind.alias("type"), (F.lit(1.0) + n % 10).alias("strength"), F.timestamp_seconds(F.lit(BASE) + n % 200 * DAY).alias("made_at"))
        return e.where("to_id is not null")

    return stored(spark, f"{sf_dir}/documents.parquet", "edges", build)


def kb_trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with trust, staleness and what trust follows from."""
    x = claim_rows(spark, sf_dir)
    x = x.select("claim_id", "text", dedup_key(F.col("text")).alias("key"), *(c.alias(name) for name, c in claim_columns().items()), "sources", "event_count", "latest")
    return evidence.trusted(x, now())


def word_index(spark: SparkSession, docs: DataFrame) -> DataFrame:
    lowered_batches(spark)
    return retrieval.word_index(docs)


def kb_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, size (the event's words), terms, tfs: a row for each event."""
    return stored(spark, f"{sf_dir}/documents.parquet", "index", lambda: word_index(spark, kb_events(spark, sf_dir)))


def kb_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term, event_id, tf, size: a row for each word of an event."""
    return retrieval.posting_rows(kb_index(spark, sf_dir))


def kb_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: n_docs, mean_size (words of an event)."""
    return stored(spark, f"{sf_dir}/documents.parquet", "event-sizes", lambda: retrieval.index_sizes(kb_events(spark, sf_dir), kb_index(spark, sf_dir)))


def kb_claim_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as kb_index of claims: event_id is the claim."""
    return stored(spark, f"{sf_dir}/documents.parquet", "claim-index", lambda: word_index(spark, claim_texts(spark, sf_dir)))


def kb_claim_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: n_docs, mean_size (words of a claim)."""
    return stored(spark, f"{sf_dir}/documents.parquet", "claim-sizes", lambda: retrieval.index_sizes(claim_texts(spark, sf_dir), kb_claim_index(spark, sf_dir)))


def claim_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb_claims(spark, sf_dir).select(F.col("claim_id").alias("event_id"), F.col("text").alias("content"))


def kb_verdicts(claims: DataFrame) -> DataFrame:
    """Verdict edges: one in five claims is validated, one in seven refuted, some both."""
    n = F.col("claim_id")

    def edge(kind: str, each: int, late: int) -> DataFrame:
        return claims.where(n % each == 1).select("claim_id", F.lit(kind).alias("kind"), F.timestamp_seconds(F.lit(BASE) + (n * late) % 230 * DAY).alias("at"))

    return edge("validates", 5, 3).unionByName(edge("refutes", 7, 5))


def kb_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions with the result that the user's next event shows: error is failure, purchase is success, none is unknown."""
    e = table(spark, sf_dir, "events")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    result = F.when(after.isNull(), "unknown").when(after == "error", "failure").when(after == "purchase", "success").otherwise("partial")
    a = e.select("event_id", "user_id", "event_type", "value", F.unix_micros("ts").alias("us"), "ts", result.alias("result"))
    return a.where("event_type <> 'error'").select(F.col("event_id").alias("action_id"), F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("subject"), F.col("event_type").alias("kind"), "user_id", "value", "ts", "us", "result")


#: The same frames as SQL for the comparison engine.
SQL = r"""
WITH kb_events AS (
  SELECT doc_id AS event_id, lang AS run_id, source AS created_by, coalesce(text, '') AS content, 1685577600 + doc_id % 240 * 86400 AS ts FROM documents),
raw_sentences AS (
  SELECT event_id, unnest(regexp_split_to_array(content, '[!?\n]+|\.\s+')) AS raw, generate_subscripts(regexp_split_to_array(content, '[!?\n]+|\.\s+'), 1) - 1 AS pos FROM kb_events),
statements AS (
  SELECT *, trim(regexp_replace(translate(lower(text), ',.;:!?', ''), '\s+', ' ', 'g')) AS key FROM (
    SELECT event_id, event_id * 16777216 + pos AS number, trim(rtrim(raw, '. ')) AS text FROM raw_sentences) WHERE length(text) >= 12),
kb_keys AS (SELECT key, min(number) AS claim_id, arg_min(text, number) AS text FROM statements GROUP BY key),
kb_claims AS (
  SELECT claim_id, text, key, CASE claim_id % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'hypothesis' ELSE 'decision' END AS type,
    0.5::DOUBLE + (claim_id % 49)::DOUBLE / 100.0::DOUBLE AS confidence, 'u' || (claim_id % 11) AS created_by,
    1685577600 + claim_id % 240 * 86400 + claim_id % 3600 AS created_at,
    CASE WHEN claim_id % 17 = 0 THEN 'deprecated' WHEN claim_id % 13 = 0 THEN 'contested' ELSE 'active' END AS status,
    1685577600 + claim_id % 240 * 86400 + claim_id % 3600 AS valid_from,
    CASE WHEN claim_id % 7 = 0 THEN 1685577600 + claim_id % 240 * 86400 + claim_id % 3600 + 30 * 86400 END AS valid_to,
    CASE WHEN claim_id % 3 = 0 THEN 1685577600 + claim_id % 240 * 86400 + claim_id % 3600 + 20 * 86400 END AS last_verified,
    claim_id % 4 AS verify_count, CASE WHEN claim_id % 4 = 0 THEN 0 ELSE claim_id % 4 * 30 END AS half_life_days,
    CASE WHEN claim_id % 19 = 0 THEN 'session' ELSE 'durable' END AS durability,
    CASE WHEN claim_id % 5 = 0 THEN 'personal' WHEN claim_id % 5 = 4 THEN 'org' ELSE 'team' END AS visibility,
    'svc' || (claim_id % 4) AS scope_service, CASE WHEN claim_id % 2 = 0 THEN 'prod' ELSE 'dev' END AS scope_env,
    CASE WHEN claim_id % 10 = 0 THEN 'promoted' ELSE 'captured' END AS lifecycle, (claim_id % 10)::DOUBLE / 10.0::DOUBLE AS source_authority,
    claim_id % 12 AS citation_count, claim_id % 6 AS pass_count, claim_id % 5 AS fail_count, CASE WHEN claim_id % 5 <> 0 THEN 'r' || (claim_id // 16777216) END AS requirement,
    CASE WHEN claim_id % 5 <> 0 AND claim_id % 4 <> 3 THEN 1685577600 + claim_id % 200 * 86400 + claim_id % 7 * 3600 END AS last_run_at
  FROM kb_keys),
kb_evidence AS (SELECT DISTINCT k.claim_id, s.event_id FROM statements s JOIN kb_keys k USING (key)),
kb_edges AS (
  SELECT * FROM (SELECT claim_id AS from_id, lead(claim_id) OVER (PARTITION BY claim_id // 16777216 ORDER BY claim_id) AS to_id,
    CASE claim_id % 6 WHEN 0 THEN 'contradicts' WHEN 1 THEN 'causes' WHEN 2 THEN 'cites' ELSE 'supports' END AS type,
    1.0::DOUBLE + claim_id % 10 AS strength, 1685577600 + claim_id % 200 * 86400 AS made_at FROM kb_claims) WHERE to_id IS NOT NULL),
kb_verdicts AS (
  SELECT claim_id, 'validates' AS kind, 1685577600 + (claim_id * 3) % 230 * 86400 AS decided FROM kb_claims WHERE claim_id % 5 = 1
  UNION ALL SELECT claim_id, 'refutes', 1685577600 + (claim_id * 5) % 230 * 86400 FROM kb_claims WHERE claim_id % 7 = 1),
kb_actions AS (
  SELECT event_id AS action_id, 's' || (user_id % 7) AS subject, event_type AS kind, user_id, value, epoch_us(ts) AS us,
    CASE WHEN nxt IS NULL THEN 'unknown' WHEN nxt = 'error' THEN 'failure' WHEN nxt = 'purchase' THEN 'success' ELSE 'partial' END AS result
  FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE event_type <> 'error')
"""
