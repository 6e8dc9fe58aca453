"""Sources, sinks and streams on small fixtures."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from siltstone.operators import graph, relate, store
from siltstone.sources import normalise
from siltstone.streaming import signals

SF = "/root/testdata/sf0.001"


def test_text_and_json_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("one\n\n two \n\n\n\nthree")
    chunks = normalise.text_chunks(normalise.read_texts(spark, str(tmp_path / "*.md")), "path", "content").orderBy("chunk_index").collect()
    assert [r.content for r in chunks] == ["one", "two", "three"]
    (tmp_path / "list.json").write_text('[{"a": 1}, "x", [2]]')
    (tmp_path / "one.json").write_text(' {"b": {"c": null}} ')
    items = sorted(r.content for r in normalise.read_json_items(spark, str(tmp_path / "*.json")).collect())
    assert sorted(json.dumps(json.loads(x)) for x in items) == sorted(['{"a": 1}', '"x"', "[2]", '{"b": {"c": null}}'])


def test_markdown_round_trip(spark):
    df = spark.createDataFrame([(7, "fact", "first\n\n---\nlast")], "id long, type string, body string")
    text = df.select(normalise.markdown(F.col("id"), {"type": F.col("type")}, F.col("body")).alias("content"))
    back = text.select(normalise.from_markdown(F.col("content"), ["id", "type"]).alias("m")).select("m.*").first()
    assert (back.id, back.type, back.body) == ("7", "fact", "first\n\n---\nlast")


def test_new_files(spark):
    stored = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, content string").withColumn("sha256", F.sha2("content", 256))
    now = spark.createDataFrame([("a", "x"), ("b", "changed"), ("c", "new")], "path string, content string")
    assert sorted(r.path for r in normalise.new_files(now, stored).collect()) == ["b", "c"]


def test_stream_delivers_each_event_once(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    path = str(tmp_path / "events")
    events.limit(300).coalesce(1).write.parquet(path)
    events.limit(300).coalesce(1).write.mode("append").parquet(path)
    out = signals.event_stream(spark, path).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.table("once").count() == 300


def test_signals(spark):
    rows = [(h, "click", 10) for h in range(20)] + [(20, "click", 100), (21, "click", 0)]
    windows = spark.createDataFrame(rows, "window long, event_type string, n long")
    assert {(r.window, r.signal) for r in signals.signals(windows).collect()} == {(20, "spike"), (21, "stall")}


def test_incremental_relations_are_those_of_all(spark):
    texts = ["alpha beta gamma delta", "alpha beta gamma epsilon", "alpha beta not gamma delta", "zeta eta theta", "eta theta iota", "one two"]
    claims = spark.createDataFrame(list(enumerate(texts)), "claim_id long, text string")
    every = {(frozenset((r.from_id, r.to_id)), r.type) for r in relate.relations(claims, claims).collect()}
    old, new = claims.where("claim_id < 3"), claims.where("claim_id >= 3")
    parts = relate.relations(old, old).unionByName(signals.related(new, old))
    assert {(frozenset((r.from_id, r.to_id)), r.type) for r in parts.collect()} == every
    assert (frozenset((0, 2)), "contradicts") in every and (frozenset((3, 4)), "supports") in every


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (8, 7)], "a long, b long")
    assert {(r.node, r.root) for r in graph.components(links).collect()} == {(2, 1), (3, 1), (8, 7), (9, 7)}


def test_writes(spark):
    stored = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k long, s string, n long")
    new = spark.createDataFrame([(2, "", 0), (3, "c", 0), (3, "c", 0)], "k long, s string, n long")
    assert sorted(store.appended(stored, new, "k").collect()) == [(1, "a", 5), (2, "b", 6), (3, "c", 0)]
    assert sorted(tuple(r) for r in store.merged(stored, new.distinct(), "k", ["s", "n"]).collect()) == [(1, "a", 5), (2, "b", 6), (3, "c", 0)]
    assert sorted(tuple(r) for r in store.merged(stored, new.distinct(), "k", ["s"]).collect()) == [(1, "a", 5), (2, "b", 0), (3, "c", 0)]
