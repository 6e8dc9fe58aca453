"""Collocations, hard negatives and exact search against brute force on small tables with every odd case."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import collocations, hard_negatives, pivot_search, vector_rows

CLASHES = ["unit", "no", "numbers", "count", "word", "id", "f", "rank", "row", "vec", "block", "query_block", "cells", "far", "score", "positives"]


def phrases(rows, words=3, least=10, inside=50, most=2000):
    """rows of (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, words + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in found.items():
        around = [b for (other, v), b in found.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= inside * a for b in around):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:most]))


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def texts(seed=3, rows=120):
    rng = np.random.default_rng(seed)
    vocabulary = ["The", "the", "Ärger", "ärger", "zig-zag", "a\tb", "x", "😀", "\x00", "new york", "New YORK city", "no.one", "end!", "q;", "\x1c", " "]
    return [(None if rng.random() < 0.2 else str(rng.choice(["de", "en", ""])), None if rng.random() < 0.05 else " ".join(rng.choice(vocabulary, int(rng.integers(0, 40))))) for _ in range(rows)]


@pytest.mark.parametrize("words,unit", [(2, 1 << 20), (3, 1 << 20), (3, 50), (4, 200)])
def test_phrases(spark, words, unit):
    rows = texts()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit("x"))
    found = collocations.collocations(docs, words=words, unit_words=unit)
    assert found.columns == COLUMNS
    assert sorted(tuple(r) for r in found.collect()) == phrases(rows, words)
    assert len(phrases(rows, words)) > 15


def test_phrases_in_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert collocations.collocations(empty).collect() == []
    nothing = spark.createDataFrame([(1, None, None), (2, "de", ""), (3, "de", " \t.")], "doc_id long, lang string, text string")
    assert collocations.collocations(nothing).collect() == []
    # one very long text beside repeated rows, and a limit that ties decide by the phrase
    rows = [("de", "so it goes on and on. " * 200_000), *[("en", "b a. a b. c b")] * 12]
    found = sorted(tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), most=2).collect())
    assert found == phrases(rows, most=2)
    assert [r[2] for r in found if r[0] == "en"] == ["c b", "a b"]


def test_counts_past_64_bits(spark):
    """1,000,000 a^2 and l r beyond 2^63: counts that no test table holds."""
    a, left, right = 3_000_000_019, 3_000_000_037, 9_000_000_011
    row = spark.createDataFrame([(a, [left], [right])], "f long, heads array<long>, tails array<long>")
    assert row.select(collocations.lowest_cut().alias("c")).select("c.*").first() == (1_000_000 * a * a // (left * right), 1, left, right)


def vectors(seed=5, n=160):
    """(vec_id, embedding, label) with nulls, infinities, ties, repeated rows and ids, short and empty vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(0, 0.05, 8)], int(i % 4)) for i in range(n)]
    rows += [(50, rows[7][1], 1), (50, rows[50][1], rows[50][2]), rows[100], rows[100], (None, rows[3][1], 2), (None, None, 2)]
    rows += [(200, None, 1), (201, [0.1, None], 1), (202, [0.1, math.nan], 2), (250, [math.inf] * 8, 1), (251, [-math.inf], 1), (300, [], 1), (301, [], 2), (350, [0.5, 0.25], 3)]
    rows += [(400 + i, rows[20][1], i % 3) for i in range(40)] + [(500, [0.3] * 8, None), (550, [-0.4] * 8, 1), (-50, [0.2] * 9, -1), (0, [0.2] * 9, 9)]
    return rows


def usable(rows):
    out = []
    for row, (vec_id, v, label) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((row, vec_id, [math.floor(256 * x) for x in v], label))
    return out


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def in_order(found):
    return sorted(found, key=lambda x: (-x[1], math.inf if x[0] is None else x[0]))


def plain_nearest(rows, best=5):
    out = []
    for row, vec_id, v, _ in usable(rows):
        if vec_id is not None and vec_id % 50 == 0:
            others = in_order([(i, product(v, w)) for other, i, w, _ in usable(rows) if other != row])
            out += [(vec_id, rank + 1, i, s) for rank, (i, s) in enumerate(others[:best])]
    return sorted(out, key=repr)


def plain_negatives(rows):
    def truncated(x):
        return int(math.fmod(x, 10))

    given = [(r, i, v, truncated(label + 1) if i is not None and i % 7 == 0 else label) for r, i, v, label in usable(rows) if label is not None]
    out = []
    for row, vec_id, v, label in given:
        if vec_id is None or vec_id % 50:
            continue
        same = in_order([(i, product(v, w)) for other, i, w, m in given if other != row and m == label])[:5]
        others = in_order([(i, product(v, w)) for _, i, w, m in given if m != label])
        for i, p in same:
            inside = [(j, s) for j, s in others if 50 * p <= 100 * s <= 95 * p][:3]
            out += [(vec_id, i, rank + 1, j, p, s) for rank, (j, s) in enumerate(inside)]
    return sorted(out, key=repr)


def frame(spark, rows, kind="float"):
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    for c in CLASHES:
        table = table.withColumn(c, F.lit("x"))
    return table


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(vector_rows, "CANDIDATES", 40)
    monkeypatch.setattr(vector_rows, "QUERIES", 3)


@pytest.mark.parametrize("small", [False, True])
def test_nearest(spark, request, small):
    if small:
        request.getfixturevalue("small_blocks")
    rows = vectors()
    found = pivot_search.nearest(frame(spark, rows))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_nearest(rows)


@pytest.mark.parametrize("small", [False, True])
def test_negatives(spark, request, small):
    if small:
        request.getfixturevalue("small_blocks")
    rows = vectors()
    found = hard_negatives.mined(hard_negatives.shifted_labels(frame(spark, rows)))
    expected = plain_negatives(rows)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected
    assert len(expected) > 30


def test_few_cells_give_the_same_negatives(spark):
    rows = vectors(6)
    for cells in (1, 2, 256):
        found = hard_negatives.mined(hard_negatives.shifted_labels(frame(spark, rows)), cells=cells)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_negatives(rows)


def test_wide_components(spark):
    """Products that floats can't hold."""
    rows = [(i, [2.0**21 + i, -(2.0**20) - i * i, float(i)], i % 3) for i in range(101)]
    assert sorted((tuple(r) for r in pivot_search.nearest(frame(spark, rows, "double")).collect()), key=repr) == plain_nearest(rows)
    found = hard_negatives.mined(hard_negatives.shifted_labels(frame(spark, rows, "double")))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_negatives(rows)


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(50, [0.5], 1)], [(50, None, 1), (51, [0.5], None)]])
def test_tables_without_pairs(spark, rows):
    table = frame(spark, rows)
    assert pivot_search.nearest(table).collect() == []
    assert hard_negatives.mined(hard_negatives.shifted_labels(table)).collect() == []


def test_bounds_spare_work(spark):
    """Rows in tight groups: few are scored, and no bound is under a true score."""
    rng = np.random.default_rng(1)
    rows = (rng.normal(0, 60, (40, 16))[rng.integers(0, 40, 4000)] + rng.normal(0, 2, (4000, 16))).astype(np.int64)
    pivots = pivot_search.chosen_pivots(rows[:500])
    far, norms = pivot_search.distances(rows, pivots).T.copy(), (rows.astype(float) ** 2).sum(1)
    scored = []
    for q in range(0, 4000, 100):
        above = pivot_search.bounds(far[:, q], norms[q], far, norms)
        assert (above >= rows @ rows[q]).all()
        _, _, n = pivot_search.best_rows(rows[q], above, rows, np.arange(4000), np.arange(4000) != q, 5)
        scored.append(n)
    assert np.mean(scored) < 0.5 * 4000
    ends = np.stack([rows.min(0), rows.max(0)])
    edges = np.stack([np.stack([np.linspace(a, b, 65)[:-1].astype(int), np.concatenate([np.linspace(a, b, 65)[1:-1].astype(int) - 1, [b]])], -1) for a, b in ends.T])
    cells = hard_negatives.cells_of(rows, edges)
    low, high = (hard_negatives.looked_up(t, cells) for t in hard_negatives.products(rows[::100], edges))
    true = rows[::100] @ rows.T
    assert (low <= true).all() and (true <= high).all()
    assert np.mean(high - low) < 0.2 * np.ptp(true)
