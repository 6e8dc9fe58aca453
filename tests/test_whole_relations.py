"""Relations of all claims against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_detect import plain_features, plain_relation

from siltstone import model
from siltstone.functions import detect
from siltstone.plans import QUERIES, catalog_whole
from siltstone.plans.catalog import Store

SF = "/root/testdata/sf0.001"


def test_relations_of_all_claims(spark):
    rows = Store(spark, SF).claims.select("claim_id", "text", "durability", detect.measures(F.col("text")).alias("m")).collect()
    claims = sorted(((r.claim_id, r.durability, plain_features(r.text, [(v.value, v.unit) for v in r.m])) for r in rows), key=lambda x: x[0])
    pairs, typed, new = set(), set(), set()

    def odd(x):
        return x // model.ROOM % 2 == 1

    for i, (b, session_b, g) in enumerate(claims):
        for a, session_a, f in claims[:i]:
            shared = len(f[0] & g[0])
            if not shared:
                continue
            if shared >= 2 and shared / min(len(f[0]), len(g[0])) >= 0.3:
                pairs.add((a, b, shared))
            found = plain_relation(f, g, True)
            if found and not (found[0] == "contradicts" and session_a == session_b == "session"):
                typed.add((a, b, found[0]))
            if odd(a) and odd(b):
                if (a, b, *(found or ())[:1]) in typed:
                    new.add((a, b, found[0]))
            elif odd(a) or odd(b):
                x, y = ((a, f), (b, g)) if odd(a) else ((b, g), (a, f))
                # stored claims come to new ones without scope of session, as no durability is given there
                found = plain_relation(x[1], y[1], False)
                if found:
                    new.add((x[0], y[0], found[0]))
    assert any(a % model.ROOM for a, _, _ in typed)
    assert {tuple(r) for r in QUERIES["o052_overlap_pairs"](spark, SF).collect()} == pairs
    assert {tuple(r) for r in QUERIES["o200_relations"](spark, SF).collect()} == typed
    found = {tuple(r) for r in QUERIES["o245_incremental_relations"](spark, SF).collect()}
    assert {x for x in found if not (odd(x[0]) and odd(x[1]))} == {x for x in new if not (odd(x[0]) and odd(x[1]))}
    inner = {x for x in found if odd(x[0]) and odd(x[1])}
    assert {x for x in typed if odd(x[0]) and odd(x[1])} <= inner


def test_detectors_fire_on_tables(spark):
    """Numbers of parts and aspects of orders against plain rules over all pairs that share a word."""
    for name, detector, frame in (("o202_part_sizes", "numbers", catalog_whole.part_statements), ("o204_order_states", "aspects", catalog_whole.order_statements)):
        rows = frame(spark, SF).select("claim_id", "text", detect.measures(F.col("text")).alias("m")).collect()
        claims = [(r.claim_id, plain_features(r.text, [(v.value, v.unit) for v in r.m])) for r in sorted(rows, key=lambda r: r.claim_id)]
        by_word = {}
        for i, (_, f) in enumerate(claims):
            for w in f[0]:
                by_word.setdefault(w, []).append(i)
        # `complet`, `planned` and `ongoing` tie no two customers together in aspects
        met = {(i, j) for w, at in by_word.items() if w.startswith("customer") or detector == "numbers" for i in at for j in at if i < j}
        expected = {(claims[i][0], claims[j][0]) for i, j in met if (plain_relation(claims[i][1], claims[j][1], True) or ("", ""))[1] == detector}
        found = [tuple(r) for r in QUERIES[name](spark, SF).collect()]
        assert len(found) == len(set(found)) and set(found) == expected and len(found) > 5
