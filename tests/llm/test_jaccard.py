"""The Jaccard join, its parts and the pipeline against brute force."""

from __future__ import annotations

import random
import re

import numpy as np

import corpus_pipeline
from siltstone.llm import jaccard_join, shingle_sets, signature_tree

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    k = min(3, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def plain_components(rows, percent=90):
    sets = [(i, plain_set(x)) for i, x in rows]
    up = {i: i for i, _ in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies(seed=1, n=260):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE TWO"), (7, "é É"), (8, "É é"), (9, "a\x1cb c")]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 4, 8, 12, 20, 40, 80, 200]))] for _ in range(25)]
    for i in range(10, n):
        x = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            x[rng.randrange(len(x))] = rng.choice(words)
        rows.append((i, " ".join(x)))
    return rows


def check(spark, rows):
    frame = spark.createDataFrame([(i, x, "n", "r") for i, x in rows], "doc_id long, text string, rep string, root string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similarity_components(frame).collect()}
    assert found == plain_components(rows)


def test_components_equal_brute_force(spark):
    check(spark, near_copies())


def test_large_blocks_are_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", 4)
    check(spark, near_copies(2, 160))


def test_texts_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    check(spark, near_copies(3, 120))


def test_null_ids_repeats_and_empty(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similarity_components(frame).collect()), key=repr)
    assert found == sorted([(None, 2, None), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3)], key=repr)
    kept = sorted((r.doc_id for r in jaccard_join.one_of_each_group(frame).collect()), key=repr)
    assert kept == sorted([None, 1, 3], key=repr)
    assert jaccard_join.similarity_components(frame.limit(0)).count() == 0


def linked_sets(rng, percent, n):
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
    most = n * (100 - percent) // 100
    drop, add = int(rng.integers(0, most + 1)), int(rng.integers(0, most + 1))
    b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
    return a, b, len(b) > 0 and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))


def test_prefixes_miss_no_pair():
    """Whatever the counts are: the smaller set's index prefix meets the larger one's probe prefix."""
    rng = np.random.default_rng(7)
    counts = rng.integers(0, 5, shingle_sets.COUNTERS).astype(np.uint32)
    for percent in (80, 90):
        for n in [1, 2, 4, 5, 9, 10, 11, 19, 20, 40, 100, 150, 500]:
            for _ in range(60):
                a, b, linked = linked_sets(rng, percent, n)
                if linked:
                    a, b = sorted((a, b), key=len)
                    (p, index), (q, _) = (shingle_sets.prefix(s, counts, percent) for s in (a, b))
                    assert set(p[:index].tolist()) & set(q.tolist())


def test_tree_join_equals_all_pairs():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2**62, n).astype(np.uint64)) for n in (10, 30, 100, 400)]
    sets = [np.unique(np.concatenate([rng.permutation(base[i % 4])[int(rng.integers(0, 6)) :], rng.integers(0, 2**62, int(rng.integers(0, 4))).astype(np.uint64)])) for i in range(80)]
    found, plain = signature_tree.Components(80), signature_tree.Components(80)
    tree = signature_tree.build(list(range(80)), sets, signature_tree.width(sets))
    signature_tree.join_trees(tree, tree, sets, 90, found)
    for i in range(80):
        for j in range(i):
            if signature_tree.linked(sets[i], sets[j], 90):
                plain.join(i, j)
    assert [found.find(i) for i in range(80)] == [plain.find(i) for i in range(80)]


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, before, sf), name)
        assert after.columns == columns
        assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        if name == "near_duplicates":
            expected = plain_kept([(r.doc_id, r.text or "") for r in before.collect()], corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
            assert {r.doc_id for r in after.select("doc_id").collect()} == expected
        before = after
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    kept = corpus_pipeline.quality(spark, docs, sf).select("doc_id")
    assert good.join(docs.select("doc_id"), "doc_id").count() - good.join(kept, "doc_id").count() <= 1
    packed = corpus_pipeline.pack(spark, before, sf)
    assert packed.select("doc_id").distinct().count() == before.count()


def plain_kept(rows, words, percent):
    sets = {}
    for i, x in rows:
        w = WORD.findall(x.translate(LOWER))
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in (j for j in sets if j < i and sets[i]):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) > 0:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def test_near_duplicates_of_the_pipeline(spark):
    """Copies with a fifth of the text added or cut go; those with a third added stay. Common passages link nothing."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(60):
        x = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 60, 150, 400]))] + passage * (i % 2)
        more = [f"x{rng.randrange(5000)}" for _ in range(len(x))]
        rows += [(10 * i, x), (10 * i + 1, x + more[: len(x) // 6]), (10 * i + 2, x[: len(x) * 6 // 7]), (10 * i + 3, more[: len(x) // 3] + x)]
    rows = [(i, " ".join(x)) for i, x in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == plain_kept(rows, 5, 80)
    assert not any(i % 10 in (1, 2) for i in kept)
