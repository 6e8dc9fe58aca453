"""The flagship plan: question to documents, claims, trust, admission and confidence of the answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import model
from siltstone.operators import admission, analytics, retrieval

QUESTION, DOCUMENTS = "thing eux und mente the", 5


def answer(spark: SparkSession, sf_dir: str, question: str = QUESTION) -> DataFrame:
    """Admitted claims of the best documents, each with trust, and the confidence of the whole answer. DOCUMENTS ids come
    to the driver, and the claims of so many documents are broadcast."""
    now = model.now()
    q = spark.createDataFrame([(0, question)], "question_id long, question string")
    terms = [x.term for x in retrieval.question_terms(q).collect()]
    index = model.kb_postings(spark, sf_dir).where(F.col("term").isin(terms))
    scores = retrieval.bm25_by_index(index, model.kb_sizes(spark, sf_dir), q)
    top = retrieval.top_k(scores, "question_id", "event_id", DOCUMENTS).select("event_id").collect()
    own = model.kb_evidence(spark, sf_dir).where(F.col("event_id").isin([x.event_id for x in top])).select("claim_id").distinct()
    trusted = model.kb_trusted(spark, sf_dir).join(F.broadcast(own), "claim_id", "left_semi")
    admitted = admission.admit(trusted, admission.Admission(now))
    ids = admitted.select("claim_id")
    edges = model.kb_edges(spark, sf_dir).where("type = 'contradicts'")
    among = edges.join(ids.withColumnRenamed("claim_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("claim_id", "to_id"), "to_id", "left_semi")
    counted = admitted.join(F.broadcast(among.agg(F.count("*").alias("contradictions"))), F.lit(True))
    confidence = analytics.answer_confidence(counted, F.col("contradictions"), now).select("confidence")
    return admitted.withColumnRenamed("confidence", "claim_confidence").join(F.broadcast(confidence), F.lit(True))
