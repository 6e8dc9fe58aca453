"""Merges applied to all dependants."""

from __future__ import annotations

import random

import pytest

from siltstone.operators import merge
from siltstone.sources.shared import Scratch


def tables(spark):
    rng = random.Random(1)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n), rng.choice(["supports", "causes"])) for _ in range(400)]
    return {
        "claims": spark.createDataFrame([(i, f"t{i}") for i in range(n)], "claim_id long, text string"), "evidence": spark.createDataFrame([(rng.randrange(n), rng.randrange(9)) for _ in range(200)], "claim_id long, event_id long"),
        "edges": spark.createDataFrame(sorted({e for e in edges if e[0] != e[1]}), "from_id long, to_id long, type string"), "entities": spark.createDataFrame([(rng.randrange(n), rng.randrange(5), "mention") for _ in range(90)], "claim_id long, entity_id long, role string"),
        "expectations": spark.createDataFrame([(i, float(i)) for i in range(0, n, 3)], "claim_id long, predicted double"), "embeddings": spark.createDataFrame([(i, [1.0]) for i in range(n)], "claim_id long, vector array<double>"),
        "feedback": spark.createDataFrame([(i, i % 4, i % 5, i % 7, f"n{i}") for i in range(0, n, 2)], "claim_id long, helpful long, streak long, at long, note string"),
    }


MERGES = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 10), (11, 10), (12, 10), (12, 13), (20, 20), (30, 31), (900, 901)]
WINNER = {1: 5, 2: 5, 3: 5, 4: 5, 9: 10, 11: 10, 12: 10, 30: 31, 900: 901}


@pytest.mark.parametrize("how", ["broadcast", "shuffle", "buckets"])
def test_applied(spark, monkeypatch, how):
    if how != "broadcast":
        monkeypatch.setattr(merge, "BROADCAST_MERGES", -1)
    given = tables(spark)
    before = {name: [tuple(r) for r in df.collect()] for name, df in given.items()}
    if how == "buckets":
        given = {name: merge.bucketed(df, "from_id" if name == "edges" else "claim_id", 4) for name, df in given.items()}
    with Scratch(spark, "merge-test") as scratch:
        out = merge.applied(given, spark.createDataFrame(MERGES, "old_id long, new_id long"), scratch)
        found = {name: sorted(tuple(r) for r in df.collect()) for name, df in out.items()}
        assert merge.orphans(out).count() == 0

    def w(i):
        return WINNER.get(i, i)

    assert found["claims"] == [r for r in sorted(before["claims"]) if r[0] not in WINNER] and len(found["embeddings"]) == 60 - 8
    assert found["evidence"] == sorted({(w(a), b) for a, b in before["evidence"]})
    assert found["entities"] == sorted({(w(a), b, c) for a, b, c in before["entities"]})
    assert found["edges"] == sorted({(w(a), w(b), c) for a, b, c in before["edges"] if w(a) != w(b)})
    own = {}
    for i, x in sorted(before["expectations"], key=lambda r: (w(r[0]) != r[0], r[0])):
        own.setdefault(w(i), (w(i), x))
    assert found["expectations"] == sorted(own.values())
    groups = {}
    for r in before["feedback"]:
        groups.setdefault(w(r[0]), []).append(r)
    assert found["feedback"] == sorted((i, sum(r[1] for r in g), max(r[2] for r in g), max(r[3] for r in g), max(g, key=lambda r: (r[3], r[0] == i, -r[0]))[4]) for i, g in groups.items())
    assert {(r[0], r[1]) for r in found["journal"]} == set(WINNER.items()) and len(found["journal"]) == len(WINNER)


def test_buckets_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(merge, "BROADCAST_MERGES", -1)
    rows = merge.bucketed(spark.range(5000).selectExpr("id as claim_id", "id % 7 as event_id"), "claim_id", 4)
    merges = spark.range(0, 5000, 2).selectExpr("id as old_id", "id + 1 as new_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = merge.repointed(rows, merges, "claim_id", False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_rings_have_no_winner(spark):
    with Scratch(spark, "merge-test") as scratch, pytest.raises(ValueError, match="ring"):
        merge.last_winners(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "old_id long, new_id long"), scratch)
