"""Clusters, promotion, analogies, consolidation, recall control and health against plain re-computation."""

from __future__ import annotations

import math
import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from siltstone import model
from siltstone.functions import text
from siltstone.operators import graph, health, lifecycle, promote, recall, retrieval
from siltstone.plans.catalog_last import consolidation_tables
from siltstone.sources.shared import Scratch

SF = "/root/testdata/sf0.001"


def words_of(x):
    """Content words of texts in which no suffix is taken off but a last s."""
    return {w[:-1] if len(w) > 4 and w.endswith("s") and not w.endswith("es") else w[:-2] if len(w) > 5 and w.endswith(("es", "ed")) else w for w in x.split() if w not in text.STOP_WORDS and w not in text.NEGATIONS}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def statements(seed=3, n=70):
    rng = random.Random(seed)
    base = ["retry budget guards payments gateway", "cache layer absorbs read traffic spikes", "deploy windows avoid friday evenings", "index rebuild blocks writes"]
    out = []
    for _ in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(["budget", "gateway", "traffic", "extra", "nightly", "writes", "region"])
        out.append(" ".join(w))
    return sorted(set(out))


def plain_clusters(texts):
    anchors, of = [], {}
    for i, x in enumerate(texts):
        w = words_of(x)
        hit = next((a for a in anchors if jaccard(words_of(texts[a]), w) >= 0.6), None)
        if hit is None:
            anchors.append(i)
        of[i] = i if hit is None else hit
    return of


def plain_independent(nodes, conflicts):
    kept = set()
    for x in nodes:
        if not any((x, y) in conflicts or (y, x) in conflicts for y in kept):
            kept.add(x)
    return kept


@pytest.mark.parametrize("most", [0, 20, 10_000])
def test_first_independent(spark, most):
    """A long chain, a random graph and lone nodes; by rounds, by component, and both."""
    rng = random.Random(8)
    conflicts = {(i, i + 1) for i in range(15)} | {(rng.randrange(20, 60), rng.randrange(20, 60)) for _ in range(70)}
    nodes = rng.sample(range(70), 70)
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(nodes)], "node long, at int").select("node", F.struct("at").alias("order"))
    found = promote.first_independent(rows, spark.createDataFrame(sorted(conflicts), "a long, b long"), most)
    assert {r.node for r in found.collect()} == plain_independent(nodes, {c for c in conflicts if c[0] != c[1]})


def test_clusters_equal_greedy(spark):
    texts = statements()
    rows = spark.createDataFrame(list(enumerate(texts)), "member_id long, text string")
    found = promote.clusters(rows.withColumn("order", F.struct("text"))).collect()
    assert {r.member_id: r.anchor_id for r in found} == plain_clusters(texts)


def test_promotion_outcomes(spark):
    rows = [
        (1, "t1", "retry budget guards payments gateway", 0.7, True, 0.1), (2, "t2", "retry budget guards payments gateway", 0.8, True, 0.2), (3, "t3", "retry budget guards payments gateway today", 0.9, True, 0.0),
        (4, "t1", "cache absorbs read spikes", 0.9, True, 0.0), (5, "t2", "cache absorbs read spikes", 0.9, True, 0.0),
        (6, "t1", "zeta rules acme corp nodes", 0.9, True, 0.0), (7, "t2", "zeta rules acme corp nodes", 0.9, True, 0.0), (8, "t3", "zeta rules acme corp nodes", 0.9, True, 0.0),
        (9, "t1", "index rebuild blocks writes nightly", 0.5, True, 0.0), (10, "t2", "index rebuild blocks writes nightly", 0.5, True, 0.0), (11, "t3", "index rebuild blocks writes nightly", 0.5, True, 0.0),
        (12, "t1", "deploy windows avoid friday evenings", 0.9, False, 0.0),
    ]
    lessons = spark.createDataFrame(rows, "lesson_id long, tenant string, statement string, confidence double, eligible boolean, surprise double")
    denied = promote.denied_terms(spark.createDataFrame([("acme corp",), ("ab",)], "term string"), lessons.select("tenant").distinct())
    known = spark.createDataFrame([(900, "index rebuild never blocks writes nightly")], "claim_id long, text string")
    found = {(r.outcome, r.statement): r for r in promote.promotion(lessons, denied, known).collect()}
    assert {k[0] for k in found} == {"pending", "insufficient_corroboration", "tenant_specific_token", "dissonant"}
    best = found["pending", "retry budget guards payments gateway"]  # `today` is one tenant's word
    assert (best.tenants, best.confidence, best.surprise) == (3, 0.9, 0.2)
    assert promote.released(promote.promotion(lessons, denied, known), 0.95).where("outcome = 'promoted'").count() == 0


def test_promotion_ranks_scopes_and_curated(spark):
    rng = random.Random(3)
    subjects = ["retry budget guards payments", "cache absorbs read spikes", "index rebuild blocks writes", "canary release limits damage", "queue depth predicts lag"]
    rows = []
    for i, text in enumerate(subjects):
        for t in range(3 + i % 3):
            rows.append((len(rows), f"tenant{t}", text, rng.choice([0.5, 0.7, 0.9]), True, rng.choice([None, 0.0, 0.4]), f"s{i if i % 2 else t}", rng.choice(["positive", "negative", None])))
    rows.append((len(rows), "tenant9", "backups need restore drills", 0.8, True, 0.9, None, None))
    lessons = spark.createDataFrame(rows, "lesson_id long, tenant string, statement string, confidence double, eligible boolean, surprise double, scope string, polarity string")
    denied, known = promote.denied_terms(spark.createDataFrame([], "term string"), lessons.select("tenant").distinct()), spark.createDataFrame([], "claim_id long, text string")
    expected = []
    for text in subjects:
        own = [r for r in rows if r[2] == text]
        best = min(own, key=lambda r: (-r[3], r[2], r[1], r[0]))
        scopes = {r[6] for r in own}
        expected.append((-max((r[5] or 0.0) for r in own), -len({r[1] for r in own}), -max(r[3] for r in own), text, scopes.pop() if len(scopes) == 1 else None, best[7] or "positive"))
    found = sorted((r["rank"], r.statement, r.scope, r.polarity) for r in promote.promotion(lessons, denied, known).where("outcome = 'pending'").collect())
    assert found == [(i + 1, x[3], x[4], x[5]) for i, x in enumerate(sorted(expected))]
    curated = promote.promotion(lessons, denied, known, curated=True).where("outcome = 'pending'").collect()
    assert {r.statement for r in curated} == {*subjects, "backups need restore drills"} and [r.statement for r in curated if r["rank"] == 1] == ["backups need restore drills"]


def test_identifying_in_long_words(spark, monkeypatch):
    """A word of 2 MB, and more phrases than one pass takes."""
    word = "abcdefghij" * 200_000
    s = spark.createDataFrame([(1, word), (2, word + "acme corp"), (3, "x" + word + "\tend of line"), (4, None), (5, "")], "statement_id long, statement string")
    denied = spark.createDataFrame([("acme corp",), ("j\tend",), ("fghij abc",), ("abcdefghij",)], "term string")
    for most in (50_000, 1):
        monkeypatch.setattr(promote, "PHRASES", most)
        assert {r.statement_id for r in promote.identifying(s, denied).collect()} == {2, 3}


def test_identifying_terms(spark):
    s = spark.createDataFrame([(1, "the Acme Corp plan"), (2, "xacme corpse"), (3, "acmecorp"), (4, "a thing"), (5, "things")], "statement_id long, statement string")
    denied = spark.createDataFrame([("acme corp",), ("thing",)], "term string")
    assert {r.statement_id for r in promote.identifying(s, denied).collect()} == {1, 2, 4}


def test_schemas_and_fit(spark):
    texts = statements(9, 30)
    claims = spark.createDataFrame([(i, x, (i % 10) / 10) for i, x in enumerate(texts)], "claim_id long, text string, confidence double")
    of = plain_clusters(texts)
    expected = {}
    for a in set(of.values()):
        own = [i for i in of if of[i] == a]
        best = min(own, key=lambda i: (-(i % 10), texts[i], str(i)))
        expected[texts[best]] = (max((i % 10) / 10 for i in own), len(own))
    assert {r.statement: (r.confidence, r.evidence) for r in promote.knowledge_schemas(claims).collect()} == expected
    schemas = spark.createDataFrame([("s1", "retry budget guards payments gateway")], "schema_id string, text string")
    c = spark.createDataFrame([(1, "retry budget guards payments gateway well"), (2, "retry budget never guards payments gateway"), (3, "unrelated words entirely")], "claim_id long, text string")
    fits = {r.claim_id: (r.fit, round(r.boost, 4)) for r in promote.assimilated(c, schemas).collect()}
    assert fits == {1: ("consistent", round(0.15 * 5 / 6, 4)), 2: ("dissonant", 0.0), 3: ("neutral", 0.0)}


def test_subject_class(spark):
    cases = [(["class", "Class "], "class"), (["class", "individual"], "individual"), (["class", ""], "unknown"), ([], "unknown"), (["", "individual"], "individual")]
    for x, expected in cases:
        assert spark.createDataFrame([(x,)], "c array<string>").select(promote.subject_class(F.col("c"))).first()[0] == expected


def plain_fingerprint(edges, roles, seed):
    adj = {}
    for e in edges:
        adj.setdefault(e[0], []).append(e)
        adj.setdefault(e[1], []).append(e)
    seen, front, own = {seed}, [seed], set()
    for _ in range(2):
        after = []
        for n in front:
            for e in adj.get(n, []):
                own.add(e)
                for m in e[:2]:
                    if m not in seen:
                        seen.add(m)
                        after.append(m)
        front = after
    labels = {n: roles.get(n, "unknown") for n in seen}
    hist = Counter(labels.values())
    for _ in range(2):
        ends = [(a, t, b) for a, b, t in own] + [(b, t, a) for a, b, t in own]
        labels = {n: (labels[n], tuple(sorted(f"{t}|{labels[m]}" for a, t, m in ends if a == n))) for n in seen}
        hist.update(labels.values())
    return hist, seen, own


def test_analogies(spark):
    rng = random.Random(4)
    edges = sorted({(a, b, rng.choice(["supports", "causes"])) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(45)) if a != b})
    roles = {i: rng.choice(["fact", "decision"]) for i in range(38)}
    anchor = edges[0][0]
    fp, near, _ = plain_fingerprint(edges, roles, anchor)
    degree = Counter(n for e in edges for n in e[:2])
    done, out = set(), []
    for c in sorted((n for n in degree if n not in near), key=lambda n: (-degree[n], n)):
        if c not in done:
            other, own, _ = plain_fingerprint(edges, roles, c)
            done |= own
            sim = sum(v * other[k] for k, v in fp.items()) / math.sqrt(sum(v * v for v in fp.values()) * sum(v * v for v in other.values()))
            if sim >= 0.5:
                out.append((c, round(sim, 6)))
    frame = spark.createDataFrame(edges, "from_id long, to_id long, type string")
    found = graph.analogies(frame, spark.createDataFrame(list(roles.items()), "claim_id long, role string"), anchor).collect()
    assert [(r.claim_id, round(r.similarity, 6)) for r in found] == sorted(out, key=lambda x: (-x[1], x[0]))[:10]


@pytest.mark.parametrize("in_a_task", [200_000, 5])
def test_representatives(spark, in_a_task):
    """A hub, a chain, loose pairs, a loop and random edges; by one task for each component, and in rounds."""
    rng = random.Random(9)
    edges = {(0, i) for i in range(1, 60)} | {(i, i + 1) for i in range(100, 130)} | {(200 + 2 * i, 201 + 2 * i) for i in range(5)} | {(300, 300)}
    edges |= {(400 + rng.randrange(80), 400 + rng.randrange(80)) for _ in range(90)}
    around, degree = {}, Counter()
    for a, b in edges:
        around.setdefault(a, {a}).add(b)
        around.setdefault(b, {b}).add(a)
        degree.update({a, b})
    open_nodes = {n: d for n, d in degree.items() if n % 7}
    near, expected = set(), set()
    for n in sorted(open_nodes, key=lambda x: (-degree[x], x)):
        if n not in near:
            expected.add(n)
            near |= {o for m in around[n] for o in around[m]}
    frame = spark.createDataFrame([(a, b, "supports") for a, b in sorted(edges)], "from_id long, to_id long, type string")
    nodes = spark.createDataFrame(list(open_nodes.items()), "node long, degree long")
    with Scratch(spark, "test") as scratch:
        taken = graph.representatives(frame, nodes, scratch, in_a_task)
        assert {r.node for r in taken.collect()} == expected
        seen, passed = graph.neighbourhoods(frame, taken.select(F.col("node").alias("claim_id")), scratch)
        assert passed.count() <= 2 * len(edges) and seen.count() <= 2 * len(edges) + len(expected)


def test_rerank(spark):
    edges = spark.createDataFrame([(1, 7, "supports", 1.0), (7, 8, "causes", 10.0), (2, 9, "contradicts", 1.0)], "from_id long, to_id long, type string, strength double")
    ranked = spark.createDataFrame([(i, i) for i in range(1, 11)], "claim_id long, rank int")
    found = {r.claim_id: r for r in graph.reranked(ranked, edges).collect()}
    assert round(found[7].score, 6) == round(0.4 + 0.35 * 0.5, 6) and round(found[8].score, 6) == round(0.3 + 0.35 * 0.5 * 0.5 * 0.8 * 1.5, 6) and round(found[9].score, 6) == round(0.2 + 0.35 * 0.9 * 0.5 * 0.5, 6)
    assert found[1].rank == 1 and found[7].rank == 6


def kb(spark):
    texts = {1: "billing latency rose after deploy", 2: "billing latency fell after rollback", 3: "search index is fresh", 4: "cache ratio is low", 5: "billing team owns retries"}
    docs = spark.createDataFrame([(10, texts[1] + " " + texts[2]), (11, texts[3]), (12, texts[4])], "event_id long, content string")
    rows = [(i, x, 0.4 + i / 10, "active", "durable", "team", "captured", "2024-01-20 00:00:00") for i, x in texts.items()]
    claims = spark.createDataFrame(rows, "claim_id long, text string, trust double, status string, durability string, visibility string, lifecycle string, created_at string").withColumns({
        "created_at": F.to_timestamp("created_at"), "valid_from": F.to_timestamp("created_at"), "valid_to": F.lit(None).cast("timestamp"), "last_verified": F.lit(None).cast("timestamp"), "source_authority": F.lit(0.9), "citation_count": F.lit(10)})
    evidence = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 12)], "claim_id long, event_id long")
    edges = spark.createDataFrame([(1, 2, "contradicts", 1.0), (2, 5, "supports", 1.0), (3, 4, "contradicts", 1.0)], "from_id long, to_id long, type string, strength double")
    claims = claims.withColumn("type", F.when(F.col("claim_id") == 1, "decision").otherwise("fact"))
    own = claims.select(F.col("claim_id").alias("event_id"), F.col("text").alias("content"))
    return recall.Store(retrieval.postings(docs), retrieval.event_sizes(docs), retrieval.postings(own), retrieval.event_sizes(own), claims, evidence, edges)


def test_recall_ranking(spark):
    """Direct claims by intent, then by words and vectors, less inhibition; without any signal by age."""
    s, at = kb(spark), F.to_timestamp(F.lit("2024-02-01"))
    docs = spark.createDataFrame([(10, "billing latency rose after deploy billing latency fell after rollback cache ratio is low")], "event_id long, content string")
    s = replace(s, postings=retrieval.postings(docs), sizes=retrieval.event_sizes(docs), evidence=spark.createDataFrame([(1, 10), (2, 10), (4, 10)], "claim_id long, event_id long"))

    def ranked(store, question, vector=None, **options):
        q = spark.createDataFrame([(1, question, vector)], "question_id long, question string, vector array<double>")
        return [r.claim_id for r in recall.recall(store, q, recall.Options(at, **options)).orderBy("rank").collect()]

    words = {1: "billing latency rose after deploy", 2: "billing latency fell after rollback", 4: "cache ratio is low"}
    assert ranked(s, "billing rollback") == [2, 1, 4]
    assert ranked(s, "what did we decide on rollback") == [1, 2, 4]
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.6, 0.8]), (4, [1.0, 0.0])], "claim_id long, embedding array<double>")
    v = replace(s, claim_vectors=vectors)
    n, size = 5, sum(map(len, (x.split() for x in [*words.values(), "search index is fresh", "billing team owns retries"]))) / 5
    def bm25(claim, terms):
        own = claim.split()
        return sum(math.log((n - df + 0.5) / (df + 0.5) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(own) / size)) for t, df in terms if t in own)
    score = {i: bm25(x, [("billing", 3), ("latency", 2), ("low", 1)]) for i, x in words.items()}
    cos = {1: 0.0, 2: 0.6, 4: 1.0}
    q = spark.createDataFrame([(1, "billing latency low", [1.0, 0.0])], "question_id long, question string, vector array<double>")
    found = {r.claim_id: r.relevance for r in recall.relevance(v, spark.createDataFrame([(1, 1), (1, 2), (1, 4)], "question_id long, claim_id long"), q).collect()}
    assert all(abs(found[i] - (0.5 * score[i] / max(score.values()) + 0.5 * cos[i])) < 1e-9 for i in words)
    assert ranked(v, "billing latency low", [1.0, 0.0]) == sorted(words, key=lambda i: -found[i])
    assert ranked(v, "billing latency", None) == [1, 2, 4]
    held = s.claims.withColumn("components", F.when(F.col("claim_id") == 1, F.create_map(F.lit("inhibition"), F.lit(0.5))).when(F.col("claim_id") == 2, F.create_map(F.lit("salience"), F.lit(0.0))))
    assert ranked(replace(s, claims=held), "billing latency") == [2, 1, 4] and ranked(replace(s, claims=held.withColumn("components", F.when(F.col("claim_id") == 2, F.col("components")))), "billing latency", salient=True) == [1, 2, 4]
    assert ranked(replace(s, claims=s.claims.withColumn("status", F.when(F.col("claim_id") == 1, "deprecated").otherwise("active"))), "billing latency", hops=1) == [2, 4, 5, 3]


def test_recall_control(spark):
    s, at = kb(spark), F.to_timestamp(F.lit("2024-02-01"))
    q = spark.createDataFrame([(1, "billing latency"), (2, "search index"), (3, "nothing known")], "question_id long, question string")
    found = recall.recall(s, q, recall.Options(at)).collect()
    assert sorted((r.question_id, r.claim_id) for r in found) == [(1, 1), (1, 2), (2, 3)]
    deep = recall.recall(s, q, recall.Options(at, hops=1)).collect()
    assert sorted((r.question_id, r.claim_id, r.hop) for r in deep) == [(1, 1, 0), (1, 2, 0), (1, 5, 1), (2, 3, 0), (2, 4, 1)]
    results = recall.recall(s, q, recall.Options(at))
    graded = {r.question_id: r for r in recall.confidences(s, results, q, at).collect()}
    trusts = {r.claim_id: r.trust for r in found}
    expected = 0.4 * (trusts[1] + trusts[2]) / 2 + 0.2 * 2 / 5 - 0.1 + 0.1 * (1 - 12 * 24 / 720)
    assert abs(graded[1].confidence - expected) < 1e-9 and graded[3].claims == 0 and not graded[3].sufficient
    strict = recall.Options(at, min_trust=0.99)
    kept, grades = recall.corrected(s, q, strict)
    assert recall.recall(s, q, strict).count() == 0 and kept.count() == 3 and {r.question_id: r.claims for r in grades.collect()} == {1: 2, 2: 1, 3: 0}
    _, effort = recall.with_effort(s, q, recall.Options(at, limit=1), 1.0)
    rows = {r.question_id: r for r in effort.collect()}
    assert rows[3].passes == 2 and rows[3].hops == 0 and all(abs(r.budget - (1 - g)) < 1e-9 for r, g in ((rows[3], 0.0),))
    against = {(r.question_id, r.claim_id, r.against_id) for r in recall.conflicts(s, results).collect()}
    assert against == {(1, 1, 2), (1, 2, 1), (2, 3, 4)}
    seen, took = recall.iterative(s, q, recall.Options(at))
    assert {r.question_id: r.rounds for r in took.collect()}[3] == 1 and seen.where("question_id = 1").count() >= 2
    kinds = {r.question_id: r.kind for r in recall.classified(recall.confidences(s, results, q, at), results).collect()}
    assert kinds[3] == "novel" and all((k == "fits") == graded[i].sufficient for i, k in kinds.items())
    context = spark.createDataFrame([(1, 2)], "question_id long, claim_id long")
    assert {r.claim_id: r.score for r in recall.with_context(s, results.where("question_id = 1"), context).collect()}[2] >= 4.0


def test_consolidation(spark):
    tables = consolidation_tables(spark, SF)
    now = model.now()
    new, report = lifecycle.consolidate(tables, now, 0.3)
    before, after, r = tables["claims"].count(), new["claims"], report.first()
    assert after.count() == before - r.merged == r.trust_refreshed
    closed = after.where(F.col("valid_to") == now).count()
    assert closed == r.forgotten + r.refuted and r.replayed == 50
    assert after.where("components['inhibition'] < 0.01").count() == 0
    assert after.select("claim_id").join(tables["merges"].withColumnRenamed("old_id", "claim_id"), "claim_id").count() == 0
    assert new["edges"].where("from_id = to_id").count() == 0
    assert sum(x.strength > 9 for x in new["edges"].collect()) == 0


def test_health_grades(spark):
    for value, expected in ((0.0, "ok"), (0.3, "degraded"), (0.6, "unhealthy")):
        assert spark.range(1).select(health.graded(F.lit(value), "low_trust")).first()[0] == expected
    rows = spark.createDataFrame([("a", "unknown"), ("b", "degraded"), ("c", "ok")], "name string, status string")
    assert health.overall(rows).first().status == "degraded" and health.overall(rows.where("name = 'a'")).first().status == "ok" and health.overall(rows.limit(0)).first().status == "ok"
