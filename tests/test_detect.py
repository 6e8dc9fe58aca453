"""Detectors, junk, JSON repair and contested marking against plain rules on small fixtures."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from siltstone.functions import detect as says
from siltstone.functions import noise, text
from siltstone.operators import detect, relate

MARKS = ",.;:!?()[]{}\"'"


def bare(w):
    return w.strip(MARKS)


def stem(w):
    n = len(w.encode())
    return w[:-2] if n > 5 and w.endswith(("ed", "es")) else w[:-1] if n > 4 and w.endswith("s") else w


def words_of(x):
    return {stem(bare(w)) for w in x.lower().split() if bare(w) and bare(w) not in text.NEGATIONS and bare(w) not in text.STOP_WORDS}


def denied(x):
    w = x.lower().split()
    for i, v in enumerate(w):
        if bare(v) in text.NEGATIONS:
            before, after = (w[i - 1] if i else ""), (bare(w[i + 1]) if i + 1 < len(w) else "")
            if not (before[-1:] in (",", ";", "—", "–") or before in ("-", "—", "–") or after in ("merely", "just", "only", "simply", "solely")):
                return True
    return False


def aspect(x):
    w = {bare(v) for v in x.lower().split()} - {""}
    w |= set(map(stem, w))
    return next((k for k, marks in says.ASPECTS.items() if w & set(marks)), None)


def names(x):
    w, out = x.split(), set()
    for i, v in enumerate(w):
        first = i == 0 or w[i - 1][-1] in ".!?"
        b = bare(v)
        copula = i + 1 < len(w) and bare(w[i + 1].lower()) in ("is", "are", "was", "were", "'s")
        if b and b[0].isupper() and b.isalpha() and (not first or copula) and b.lower() not in text.STOP_WORDS:
            out.add(stem(b.lower()))
    return out


MEASURES = {
    "The limit is 5 minutes": [(300.0, "time")], "latency was 250ms and 3 s": [(0.25, "time"), (3.0, "time")], "PR #225 and issue #12 merged": [], "see render.go:133 writes": [], "timeout:30s holds": [(30.0, "time")],
    "lines 76-77 changed": [(76.0, "")], "needs php >=8.1 or ^4.2": [], "at least 30 days and up to 9 h": [], "costs $4,500 or 20 EUR": [(4500.0, "usd"), (20.0, "eur")], "12 widgets, 5%": [(12.0, "raw:widgets"), (5.0, "percent")],
    "p99 rose": [], "2 GB of 1.5 tb": [(2.0 * 1024**3, "bytes"), (1.5 * 1024**4, "bytes")], "-3 was read": [(-3.0, "raw:was")],
}


def test_measures(spark):
    rows = spark.createDataFrame([(x,) for x in MEASURES], "text string").select("text", says.measures(F.col("text")).alias("m")).collect()
    for r in rows:
        assert [(round(m.value, 6), m.unit) for m in r.m] == [(round(v, 6), u) for v, u in MEASURES[r.text]], r.text


def sentences():
    rng = random.Random(5)
    subjects = ["the user", "Alice", "the Migration", "Bob", "the cache layer", "deploy of billing", "the Payments service", "Phase 1", "Phase 2"]
    verbs = ["is", "has", "was not", "will ship", "completed", "is still running", "never got", "is not just", "failed, not"]
    ends = ["12 prior refunds", "0 prior refunds", "the owner", "a slow query. Carol was there", "done on Tuesday", "5 minutes", "300 seconds", "the CEO", "prior refunds", "at least 9 nodes", ""]
    return sorted({f"{rng.choice(subjects)} {rng.choice(verbs)} {rng.choice(ends)}".strip() for _ in range(220)})


def agree(a, b):
    def close(x, y):
        return x == y or (abs(x - y) < 1e-9 if max(x, y) == 0 else abs(x - y) / abs(max(x, y)) < 0.005)

    if not a or not b:
        return True
    if len(a) == len(b) == 1:
        return a[0][1] == b[0][1] and close(a[0][0], b[0][0])
    return all(not (same := [y for y, u in b if u == v]) or any(close(x, y) for y in same) for x, v in a)


ASPECT_MARKS = {m for v in says.ASPECTS.values() for m in v}


def plain_features(x, measures):
    words = words_of(x)
    letters = {w for w in words if any(c.isalpha() for c in w)}
    return words, denied(x), letters, letters - ASPECT_MARKS, aspect(x), names(x), measures, bool(re.match(says.ENUMERATED, x.strip()))


def plain_relation(f, g, lists):
    (a, no_a, la, pa, aspect_a, names_a, ma, list_a), (b, no_b, lb, pb, aspect_b, names_b, mb, list_b) = f, g
    s, lo, hi = len(a & b), min(len(a), len(b)), max(len(a), len(b))
    found = None
    if s >= 2 and s / lo >= 0.3:
        found = "supports" if no_a == no_b else "contradicts" if s / lo >= 0.5 and s / hi >= 0.3 else None
    both = lists and list_a and list_b
    n, m = min(len(la), len(lb)), max(len(la), len(lb))
    if not both and ma and mb and n >= 3 and len(la & lb) / n >= 0.7 and len(la & lb) / m >= 0.4 and not agree(ma, mb):
        return "contradicts", "numbers"
    if found:
        return found, "words"
    if not both and hi <= 3 and s >= 1 and len(a) > s and len(b) > s and names_a - names_b and names_b - names_a:
        return "contradicts", "names"
    if aspect_a and aspect_b and aspect_a != aspect_b and pa & pb and len(pa & pb) / max(len(pa), len(pb)) >= 0.3 and len(pa & pb) / min(len(pa), len(pb)) >= 0.5:
        return "contradicts", "aspects"
    return None


def test_relations_equal_plain_rules(spark):
    texts = sentences()
    rows = [(i, x, "session" if i % 7 == 0 else "durable") for i, x in enumerate(texts)]
    claims = spark.createDataFrame(rows, "claim_id long, text string, durability string")
    m = {r.claim_id: [(v.value, v.unit) for v in r.m] for r in claims.select("claim_id", says.measures(F.col("text")).alias("m")).collect()}
    for r in claims.select("text", says.denied(F.col("text")).alias("d"), says.aspect(F.col("text")).alias("a"), says.names(F.col("text")).alias("n")).collect():
        assert (r.d, r.a, set(r.n)) == (denied(r.text), aspect(r.text), names(r.text)), r.text

    f = [plain_features(x, m[i]) for i, x in enumerate(texts)]

    def plain(pairs, lists):
        out = set()
        for i, j in pairs:
            found = plain_relation(f[i], f[j], lists) if f[i][0] and f[j][0] else None
            if found and not (found[0] == "contradicts" and i % 7 == 0 and j % 7 == 0):
                out.add((i, j, *found))
        return out

    n = len(texts)
    expected = plain([(i, j) for i in range(n) for j in range(i + 1, n)], True)
    assert {d for *_, d in expected} == {"numbers", "words", "names", "aspects"}
    assert {tuple(r) for r in detect.relations(claims).collect()} == expected
    new, old = claims.where("claim_id % 2 = 1"), claims.where("claim_id % 2 = 0")
    expected = plain([(i, j) for i in range(1, n, 2) for j in range(0, n, 2)], False)
    assert {tuple(r) for r in detect.new_relations(new, old).collect()} == expected


def contested_plain(rows):
    def core(x):
        key = re.sub(r"\s+", " ", re.sub("[,.;:!?]", "", x.lower())).strip().split()
        return [stem(w) for w in key if w not in relate.CONTEST_NEGATIONS and w not in relate.CONTEST_STOPS], any(w in relate.CONTEST_NEGATIONS for w in key)

    out = set()
    for a, (i, x, p) in enumerate(rows):
        for j, y, q in rows[a + 1 :]:
            (c, n), (d, m) = core(x), core(y)
            s = sum(w in set(c) for w in d)
            if p == q and c and d and s >= 2 and (s / min(len(c), len(d)) >= 0.5 if n != m else min(len(c), len(d)) >= 4 and s >= min(len(c), len(d)) - 1):
                out |= {i, j}
    return out


def test_contested(spark):
    rows = [(i, x, f"b{i % 3}") for i, x in enumerate(sentences())]
    found = relate.contested(spark.createDataFrame(rows, "claim_id long, text string, batch string"), "batch").collect()
    assert {r.claim_id for r in found} == contested_plain(rows)


JUNK = ["Hello there!", "Done.", "✅ done", "So you need:", "Let me check the config", "I'll add the endpoint", "that stale belief again", "the full suite is green now", "Confirmed absent from every downstream surface we have:", "ok", "", "a the"]
SOUND = ["We decided to use Go for services", "good morning meeting starts at 9", "Actually, the retry budget is 3 attempts", "Users let sessions expire", "the retry mapping table says alpha=beta and gamma:"]
NOISE = ["# Title", "---", "- * >", "Status:", "Date: March 15", "a | b | c", "Ann | ann@x.y", '{"a": 1}', "Database Schema Design", "dear Bob", "```go", "the"]


def test_junk_and_noise(spark):
    for f, yes, no in ((noise.is_junk, JUNK, SOUND), (noise.is_noise, NOISE, [*SOUND[:1], *SOUND[2:]])):
        rows = spark.createDataFrame([(x,) for x in yes + no], "t string").select("t", f(F.col("t")).alias("f")).collect()
        assert [r.t for r in rows if r.f] == yes
    t = spark.createDataFrame([("- **Auth** moved to [Auth0](http://x). We use ~~old~~ tokens daily! # Head\n1. Retries are capped at three",)], "t string")
    assert t.select(noise.candidates(F.col("t"))).first()[0] == ["Auth moved to Auth0", "We use old tokens daily", "Retries are capped at three"]


def test_repaired_json(spark):
    cases = {
        '<think>[1]</think> text ```json\n{"a": "}"}\n``` more': '{"a": "}"}', 'so [1, [2, "]"]] and {': '[1, [2, "]"]]', "none here ": "none here", '{"a": {"b": "\\"}"}} tail }': '{"a": {"b": "\\"}"}}', "[ open": "[ open",
    }
    rows = spark.createDataFrame([(x,) for x in cases], "t string").select("t", noise.repaired_json(F.col("t")).alias("j")).collect()
    assert {r.t: r.j for r in rows} == cases


def test_causes(spark):
    rows = [(1, "deployed billing v2", "2024-01-01 00:00:00"), (2, "billing latency increased", "2024-01-01 05:00:00"), (3, "latency spike on search service", "2024-01-01 05:00:00"), (4, "billing errors dropped", "2024-01-09 00:00:00"), (5, "restarted search service", None)]
    claims = spark.createDataFrame(rows, "claim_id long, text string, at string").withColumn("at", F.to_timestamp("at"))
    assert {tuple(r) for r in relate.causes(claims).collect()} == {(1, 2), (5, 3)}


def test_evict(spark):
    cases = [("ab\ncd\nef", 5, "cd\nef"), ("ab\ncd\nef", 4, "ef"), ("abcdef", 3, "def"), ("ab", 5, "ab"), ("a\nbcdef", 3, "def")]
    for x, n, expected in cases:
        assert spark.range(1).select(text.evict_to_limit(F.lit(x), n)).first()[0] == expected
