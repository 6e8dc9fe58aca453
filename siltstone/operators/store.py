"""Writes as new versions of a table: append, merge, latest, delete; histories; duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text


def appended(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows, and incoming ones of new keys (of repeated keys, one)."""
    return stored.unionByName(incoming.dropDuplicates([key]).join(stored.select(key), key, "left_anti").select(stored.columns))


def merged(stored: DataFrame, incoming: DataFrame, key: str, preserve: list[str]) -> DataFrame:
    """Incoming rows replace stored ones, but empty, zero or null incoming values keep what is stored in `preserve`."""
    s = stored.select(key, *(F.col(c).alias(f"stored_{c}") for c in stored.columns if c != key), F.lit(True).alias("was_stored"))
    i = incoming.select(key, *(F.col(c).alias(f"incoming_{c}") for c in stored.columns if c != key), F.lit(True).alias("is_new"))
    x = s.join(i, key, "full")

    def value(c: str) -> Column:
        new, old = F.col(f"incoming_{c}"), F.col(f"stored_{c}")
        if c in preserve:
            empty = new.isNull() | (new.cast("string").isin("", "0", "0.0"))
            return F.when(F.col("is_new").isNull() | (empty & F.col("was_stored").isNotNull()), old).otherwise(new)
        return F.when(F.col("is_new").isNull(), old).otherwise(new)

    return x.select(*(F.col(key) if c == key else value(c).alias(c) for c in stored.columns))


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(at))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def deleted(tables: dict[str, DataFrame], gone: DataFrame, keys: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Every table without the rows of which a key column is in gone (claim_id)."""
    out = {}
    for name, df in tables.items():
        for k in keys[name]:
            df = df.join(gone.select(F.col("claim_id").alias(k)), k, "left_anti").select(df.columns)
        out[name] = df
    return out


def versions(rows: DataFrame, key: str, at: list[str]) -> DataFrame:
    """Rows numbered from 1 within their key, and when the next version replaces each."""
    w = Window.partitionBy(key).orderBy(*at)
    return rows.withColumn("version", F.row_number().over(w)).withColumn("until", F.lead(at[0]).over(w))


def exact_duplicates(claims: DataFrame) -> DataFrame:
    """old_id, new_id of claims whose key equals that of one with a lesser id."""
    first = claims.groupBy("key").agg(F.min("claim_id").alias("new_id"), F.count("*").alias("n")).where("n > 1")
    return claims.select("key", "claim_id").join(first, "key").where("claim_id <> new_id").select(F.col("claim_id").alias("old_id"), "new_id")


def feedback(rows: DataFrame, confidence: float = 1.0) -> DataFrame:
    """claim_id, streak (unhelpful since the last helpful), helpful, confidence (times 0.9 for each unhelpful), contested
    (a streak of three) of feedback rows (claim_id, at, helpful)."""
    w = Window.partitionBy("claim_id")
    last = F.max(F.when(F.col("helpful"), F.col("at"))).over(w)
    x = rows.withColumn("last_helpful", last)
    since = F.count_if(~F.col("helpful") & (F.col("last_helpful").isNull() | (F.col("at") > F.col("last_helpful"))))
    g = x.groupBy("claim_id").agg(since.alias("streak"), F.count_if("helpful").alias("helpful"), (F.lit(confidence) * F.pow(F.lit(0.9), F.count_if(~F.col("helpful")))).alias("confidence"))
    return g.withColumn("contested", F.col("streak") >= 3)


def plasticity(rows: DataFrame, key: str, order: list[str], value: str, last: int = 5) -> DataFrame:
    """Mean of the last values over the mean of all, 0.5 to 2."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    x = rows.withColumn("rn", F.row_number().over(w)).groupBy(key).agg(F.avg(F.when(F.col("rn") <= last, F.col(value))).alias("recent"), F.avg(value).alias("usual"))
    return x.withColumn("plasticity", F.when(F.col("usual") == 0, 1.0).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.col("recent") / F.col("usual")))))


def changes(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before in their key's order, the first included."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col(value))).drop("before")


def narrative(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, narrative: the changes of a value in order, as one line."""
    steps = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("step"))))
    return changes(rows, key, order, value).groupBy(key).agg(F.array_join(F.transform(steps, lambda s: s["step"]), " > ").alias("narrative"))


def vectors_of(vectors: DataFrame, entity_type: str, model: str, size: int) -> DataFrame:
    """Vectors of one entity type and model; those of another model or size are skipped."""
    return vectors.where((F.col("entity_type") == entity_type) & (F.col("model") == model) & (F.size("embedding") == size))


def audit(kinds: dict[str, DataFrame], author: str, since: Column) -> DataFrame:
    """kind, id, at, n of all rows (id, created_by, at) of an author since a time; n is the number of its kind."""
    parts = []
    for kind, rows in kinds.items():
        own = rows.where((F.col("created_by") == author) & (F.col("at") >= since)).select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), "at")
        parts.append(own.join(F.broadcast(own.agg(F.count("*").alias("n"))), F.lit(True)))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def tier_conflicts(claims: DataFrame, shared: DataFrame) -> DataFrame:
    """claim_id, against: claims (claim_id, text) and the first shared one with the same words but for negations, of which one
    has an odd number and the other an even one. Shared claims are one for each wording, so that none meets many."""
    def cores(df: DataFrame) -> DataFrame:
        return df.select("claim_id", text.polarity_core(F.col("text")).alias("core"), text.negation_parity(F.col("text")).alias("odd")).where("core <> ''")

    first = cores(shared).groupBy("core", "odd").agg(F.min("claim_id").alias("against")).select("core", (1 - F.col("odd")).alias("odd"), "against")
    return cores(claims).join(first, ["core", "odd"]).select("claim_id", "against")


def names_inside(names: DataFrame) -> DataFrame:
    """name, inside: every name (rows of name) that stands anywhere in another one: each name's parts of the lengths that
    names have are looked up, so that no two names are compared that have nothing in common."""
    once = names.where("name <> ''").select("name").distinct()
    lengths = once.select(F.char_length("name").alias("n")).distinct()
    sizes = F.broadcast(lengths.agg(F.array_sort(F.collect_set("n")).alias("sizes")))
    fits = F.filter("sizes", lambda n: n < F.char_length("name"))
    parts = F.flatten(F.transform(fits, lambda n: F.transform(F.sequence(F.lit(1), F.char_length("name") - n + 1), lambda i: F.substring("name", i, n))))
    found = once.join(sizes, F.lit(True)).select("name", F.explode(F.array_distinct(parts)).alias("inside"))
    return found.join(once.select(F.col("name").alias("inside")), "inside").select("name", "inside")


def claim_entities(claims: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """Claims with their entities by links (claim_id, entity_id, role)."""
    return claims.select("claim_id").join(links, "claim_id").join(entities, "entity_id")


def merged_entities(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """Links (claim_id, entity_id, role) with merged entities replaced (old_id, new_id); a link that is there already stays
    one."""
    x = links.join(mapping, links["entity_id"] == mapping["old_id"], "left")
    return x.select("claim_id", F.coalesce("new_id", "entity_id").alias("entity_id"), "role").distinct()


def appended_set(stored: DataFrame, incoming: DataFrame, key: str, column: str) -> DataFrame:
    """stored (key, column: an array) with the values of incoming (key, value) that it lacks at its end, in order; a key's
    incoming values are few."""
    new = incoming.groupBy(key).agg(F.array_sort(F.collect_set("value")).alias("new"))
    return stored.join(new, key, "left").withColumn(column, F.array_union(column, F.coalesce("new", F.array_except(column, column)))).drop("new")


def last_block(rows: DataFrame, key: str, order: list[str], text: str, limit: int) -> DataFrame:
    """key, content: the end, of at most so many characters, of the key's lines joined in order (null last), null if none has a text.
    Rows of which that end holds neither a character nor the line end are dropped before they are gathered, so a key of any
    size gives at most about limit characters."""
    keys = [x for c in order for x in (F.col(c).isNull(), F.col(c))]
    w = Window.partitionBy(key).orderBy(*(x.desc() for x in keys)).rowsBetween(Window.unboundedPreceding, -1)
    row = F.struct(*(x.alias(f"k{i}") for i, x in enumerate(keys)), F.right(text, F.lit(limit)).alias("line"))
    x = rows.select(key, F.when(F.col(text).isNotNull(), row).alias("row"), F.coalesce(F.sum(F.char_length(text) + 1).over(w), F.lit(0)).alias("after"))
    lines = F.array_sort(F.collect_list("row"))
    content = F.when(F.size(lines) > 0, F.right(F.array_join(F.transform(lines, lambda r: r["line"]), "\n"), F.lit(limit)))
    return x.where(F.col("after") <= limit).groupBy(key).agg(content.alias("content"))


def observed(expectations: DataFrame, observations: DataFrame) -> DataFrame:
    """Expectations (claim_id, predicted, tolerance, horizon) with what was observed (claim_id, observed), and whether they
    are resolved; a second observation of a claim replaces the first (at)."""
    last = observations.groupBy("claim_id").agg(F.max_by("observed", "at").alias("observed"))
    return expectations.join(last, "claim_id", "left").withColumn("resolved", F.col("observed").isNotNull())


def decided(claims: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Claims after decisions (winner_id, loser_id): a winner is active again and verified now, a loser deprecated and
    closed now, and superseded by its winner."""
    won = decisions.select(F.col("winner_id").alias("claim_id"), F.lit(True).alias("won")).distinct()
    lost = decisions.groupBy(F.col("loser_id").alias("claim_id")).agg(F.min("winner_id").alias("superseded_by"))
    x = claims.join(won, "claim_id", "left").join(lost, "claim_id", "left")
    status = F.when(F.col("superseded_by").isNotNull(), "deprecated").when(F.col("won"), "active").otherwise(F.col("status"))
    closed = F.when(F.col("superseded_by").isNotNull(), F.coalesce("valid_to", now)).otherwise(F.col("valid_to"))
    verified = F.when(F.col("won") & F.col("superseded_by").isNull(), now).otherwise(F.col("last_verified"))
    return x.withColumns({"status": status, "valid_to": closed, "last_verified": verified}).drop("won")


def invalid_edges(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Edges that break a rule, with the first rule: no type of those known, a missing end, a self loop, or a strength out of
    range."""
    reason = (
        F.when(~F.coalesce(F.col("type").isin(kinds), F.lit(False)), "type").when(F.col("from_id").isNull() | F.col("to_id").isNull(), "end").when(F.col("from_id") == F.col("to_id"), "loop")
        .when(~F.coalesce(F.col("strength").between(0, 10), F.lit(False)), "strength")
    )
    return edges.withColumn("reason", reason).where("reason is not null")


def packed(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, packed: each vector as little-endian 32-bit floats, one after another; null stays null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if x is None else np.array(x, "<f4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], [key, "packed"])

    return vectors.select(key, vector).mapInArrow(run, f"{key} {vectors.schema[key].dataType.simpleString()}, packed binary")


def unpacked(rows: DataFrame, key: str) -> DataFrame:
    """key, vector of packed vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if x is None else np.frombuffer(x, "<f4").tolist() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float32()))], [key, "vector"])

    return rows.select(key, "packed").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, vector array<float>")
