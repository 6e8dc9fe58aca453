"""Applying merges of claims to everything that refers to them. Tables may be kept in buckets by claim, so that a merge of
many claims moves only the list of merges, not the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.sources.shared import Scratch, scratch_path

#: Up to so many merges are sent to the tables by broadcast; more meet them by shuffle, or bucket by bucket.
BROADCAST_MERGES = 300_000
#: The tables that refer to claims.
DEPENDANTS = ("evidence", "edges", "entities", "expectations", "feedback", "embeddings")


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df as a table of the shared folder in so many sorted buckets by key: joins on it leave its rows where they are."""
    spark = df.sparkSession
    name = f"siltstone_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def last_winners(merges: DataFrame, scratch: Scratch) -> DataFrame:
    """old_id, new_id where new_id is merged into nothing else: what is merged into a claim that is merged itself follows it,
    twice as far in each round. Of several merges of a claim the least new_id counts, and none into itself. A ring has no
    winner: an error."""
    now = scratch.written(merges.where("old_id <> new_id").groupBy("old_id").agg(F.min("new_id").alias("new_id")), "merges")
    for _ in range(64):
        ahead = now.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("next_id"))
        chained = now.join(ahead, "new_id", "left_semi")
        if chained.isEmpty():
            return now
        now = scratch.replaced(now.join(ahead, "new_id", "left").select("old_id", F.coalesce("next_id", "new_id").alias("new_id")), "merges")
        if not now.where("old_id = new_id").isEmpty():
            break
    raise ValueError("merges form a ring")


def repointed(rows: DataFrame, merges: DataFrame, column: str, few: bool) -> DataFrame:
    """rows with the winner in place of each merged claim."""
    mapped = merges.select(F.col("old_id").alias(column), "new_id")
    x = rows.join(F.broadcast(mapped) if few else mapped, column, "left")
    return x.withColumn(column, F.coalesce("new_id", column)).drop("new_id").select(rows.columns)


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def applied(tables: dict[str, DataFrame], merges: DataFrame, scratch: Scratch) -> dict[str, DataFrame]:
    """The tables after merges (old_id into new_id), and `journal`, one row (old_id, new_id, status, reason) for each.

    claims (claim_id, ...) lose what was merged. evidence (claim_id, event_id) goes to the winner, each pair once. edges
    (from_id, to_id, type, ...) end at winners; none from a claim to itself is left, and of equal ones that of the least ends
    before stays. entities (claim_id, entity_id, role) are linked once. A claim has one of expectations (claim_id, ...): the
    winner's own, else that of the least merged claim. feedback (claim_id, helpful, streak, at, note): helpful is summed, the
    longest streak and the latest note stay (of equal times the winner's, then the least claim's). embeddings (claim_id, ...)
    of merged claims go. Tables that are not given are not there; merges of unknown claims change nothing but the journal."""
    done = last_winners(merges, scratch)
    few = done.count() <= BROADCAST_MERGES
    gone = done.select(F.col("old_id").alias("claim_id"))
    gone = F.broadcast(gone) if few else gone
    out = {name: df.join(gone, "claim_id", "left_anti").select(df.columns) for name, df in tables.items() if name in ("claims", "embeddings")}
    for name in ("evidence", "entities"):
        if name in tables:
            out[name] = repointed(tables[name], done, "claim_id", few).distinct()
    if "edges" in tables:
        e = tables["edges"].withColumns({"was_from": F.col("from_id"), "was_to": F.col("to_id")})
        e = repointed(repointed(e, done, "from_id", few), done, "to_id", few).where("from_id <> to_id")
        out["edges"] = first_of(e, ["type", "from_id", "to_id"], [F.col("was_from"), F.col("was_to")]).select(tables["edges"].columns)
    for name in ("expectations", "feedback"):
        if name not in tables:
            continue
        df = tables[name]
        x = repointed(df.withColumn("was", F.col("claim_id")), done, "claim_id", few).withColumn("own", F.col("was") == F.col("claim_id"))
        if name == "expectations":
            out[name] = first_of(x, ["claim_id"], [F.desc("own"), F.col("was")]).select(df.columns)
        else:
            latest = F.max_by("note", F.struct(F.col("at"), F.col("own"), -F.col("was")))
            out[name] = x.groupBy("claim_id").agg(F.sum("helpful").alias("helpful"), F.max("streak").alias("streak"), F.max("at").alias("at"), latest.alias("note")).select(df.columns)
    out["journal"] = done.select("old_id", "new_id", F.lit("deprecated").alias("status"), F.lit("merged into a duplicate").alias("reason"))
    return out


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """kind, claim_id of references to claims that are not there."""
    known = tables["claims"].select("claim_id")
    rows = None
    for name in DEPENDANTS:
        if name in tables:
            ends = ["from_id", "to_id"] if name == "edges" else ["claim_id"]
            for end in ends:
                x = tables[name].select(F.lit(name).alias("kind"), F.col(end).alias("claim_id")).distinct().join(known, "claim_id", "left_anti")
                rows = x.select("kind", "claim_id") if rows is None else rows.unionByName(x.select("kind", "claim_id"))
    return rows


def merge_tables(spark: SparkSession, claims: DataFrame, evidence: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The model's frames with feedback and expectations by the claims' numbers."""
    n = F.col("claim_id")
    feedback = claims.where(n % 4 == 0).select("claim_id", (n % 5).alias("helpful"), (n % 3).alias("streak"), (n % 200).alias("at"), F.concat(F.lit("note "), n.cast("string")).alias("note"))
    expectations = claims.where(n % 6 == 0).select("claim_id", (n % 10).alias("predicted"))
    return {"claims": claims.select("claim_id"), "evidence": evidence, "edges": edges.select("from_id", "to_id", "type"), "feedback": feedback, "expectations": expectations}
