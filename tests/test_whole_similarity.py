"""Similar vectors of all labels against brute force."""

from __future__ import annotations

import numpy as np

from siltstone.operators import graph, retrieval
from siltstone.plans import QUERIES

SF = "/root/testdata/sf0.001"


def test_components_across_labels(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = sorted((r.vec_id, r.label, r.embedding) for r in vectors.collect())
    m = np.array([x for _, _, x in rows], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    links = {(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(np.triu(m @ m.T >= 0.35, 1)))}
    label = {i: x for i, x, _ in rows}
    assert any(label[a] != label[b] for a, b in links)
    found = [(r.a, r.b) for r in graph.similar_pairs(vectors, 0.35, block=150).select("a", "b").collect()]
    assert len(found) == len(set(found)) and set(found) == links
    root = {i: i for i in label}
    for _ in rows:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {tuple(r) for r in QUERIES["o185_semantic_components"](spark, SF).collect()} == {(i, x) for i, x in root.items() if i != x}


def test_many_queries_in_blocks(spark, monkeypatch):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    queries = vectors.where("vec_id % 10 = 0").selectExpr("vec_id as query_id", "embedding as query")
    few = {(r.query_id, r.vec_id, round(r.score, 9)) for r in retrieval.cosine_scores(vectors, queries).collect()}
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 7)
    monkeypatch.setattr(retrieval, "BLOCK_VECTORS", 30)
    found = [(r.query_id, r.vec_id, round(r.score, 9)) for r in retrieval.cosine_scores(vectors, queries).collect()]
    assert len(found) == len(set(found)) and set(found) == few
