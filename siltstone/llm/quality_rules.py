"""Base rules, and an isolation forest on the rule statistics.

Random splits isolate an unusual document after few steps: its anomaly is 2 to the power of minus its mean path length
over the expected one. Each tree's splits are drawn on a small sample of all documents, as the method has it; the path
lengths come from the counts of all documents in its leaves. The threshold above which a document is dropped comes from
all labelled rows: the lowest at which all but a documented share of the good ones stay. Rows that fail the base rules
take no part in either, as they go whatever the forest says.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import documents, labelled_ids, share_of
from siltstone.llm.rule_ensemble import feature_columns
from siltstone.llm.text_stats import COUNTS, FEATURES, features, with_counts
from siltstone.sources.shared import Scratch, written

#: The forest: its trees, and the rows that the splits of one are drawn on.
TREES, SAMPLE = 100, 256
#: Rows of the bounded samples below, at most.
TRAIN_ROWS, LABELLED_ROWS = 10_000, 10_000
#: Bins into which a range of scores is cut, again and again, to find one by its rank.
BINS = 1000
#: The share of good labelled rows that the threshold may drop.
GOOD_LOST = 0.003
#: The statistics that trees split on: those that are alike in ordinary texts, whatever their length and lines.
SPLIT_ON = ["word_length", "symbols", "distinct", "upper", "marks"]
#: Base rules: fewer words than this, or a higher percentage of repeated words, fail (fixed values).
LEAST_WORDS, MOST_REPEATED = 20, 30
SEED = 11


def path_after(n: np.ndarray | float) -> np.ndarray:
    """Expected further path length in a leaf of n rows, which may be a part of a row or more."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.clip(n - 1, 0, 1))


def grow(rows: np.ndarray, rng: np.random.Generator, most: int, depth: int = 0) -> list[tuple]:
    """A tree as a list of nodes (feature, split, left, right, path); children by place from the node's own, -1: leaf."""
    low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
    apart = np.flatnonzero(high > low)
    if depth >= most or len(rows) <= 1 or not len(apart):
        return [(-1, 0.0, 0, 0, depth + float(path_after(len(rows))))]
    f = int(rng.choice(apart))
    split = float(rng.uniform(low[f], high[f]))
    left = grow(rows[rows[:, f] < split], rng, most, depth + 1)
    right = grow(rows[rows[:, f] >= split], rng, most, depth + 1)
    return [(f, split, 1, 1 + len(left), 0.0), *left, *right]


class Forest:
    def __init__(self, samples: list[np.ndarray], seed: int = SEED):
        """A tree for each sample; path lengths by the samples, until weigh() has those by all rows."""
        rng = np.random.default_rng(seed)
        self.size = max(map(len, samples), default=0)
        most = math.ceil(math.log2(max(2, self.size)))
        self.trees = []
        for sample in samples if self.size > 1 else []:
            nodes = np.array(grow(sample, rng, most))
            self.trees.append((nodes[:, 0].astype(int), nodes[:, 1], nodes[:, 2].astype(int), nodes[:, 3].astype(int), nodes[:, 4]))

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Of each tree, the leaves of the rows."""
        rows = np.arange(len(x))
        for feature, split, left, right, _ in self.trees:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                step = np.where(x[rows, feature[at]] < split[at], left[at], right[at])
                at = np.where(inner, at + step, at)
            yield at

    def weigh(self, share: dict[tuple[int, int], float]) -> None:
        """Path lengths by the share of all rows that each (tree, leaf) holds: its level, and the length after it among as
        many of `size` rows."""
        for t, (feature, _, left, right, path) in enumerate(self.trees):
            level = np.zeros(len(feature))
            for i in np.flatnonzero(feature >= 0):
                level[[i + left[i], i + right[i]]] = level[i] + 1
            for i in np.flatnonzero(feature < 0).tolist():
                path[i] = level[i] + float(path_after(self.size * share.get((t, i), 0.0)))

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; 0.5 is usual, and 0 if there is no forest."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for at, (*_, path) in zip(self.leaves(x), self.trees, strict=True):
            total += path[at]
        return 2.0 ** -(total / len(self.trees) / max(float(path_after(self.size)), 1e-9))


def samples(rows: DataFrame, n: int) -> list[np.ndarray]:
    """The rows that each tree is grown on: SAMPLE of all n by a hash of its own."""
    chance = F.pmod(F.xxhash64("tree", "spread"), F.lit(10**9))
    some = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).where(chance < int(min(1.0, 2 * SAMPLE / max(1, n)) * 10**9))
    nearest = F.row_number().over(Window.partitionBy("tree").orderBy(chance, "spread", *SPLIT_ON))
    drawn = some.withColumn("place", nearest).where(F.col("place") <= SAMPLE).toPandas().sort_values(["tree", "place"])
    return [x[SPLIT_ON].to_numpy(float) for _, x in drawn.groupby("tree")]


def weighed(rows: DataFrame, n: int, forest: Forest) -> Forest:
    """The forest with path lengths by all n rows: tasks count the rows of each leaf, Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(len(feature), int) for feature, *_ in forest.trees]
        for batch in batches:
            for total, at in zip(held, forest.leaves(np.column_stack([batch.column(f).to_numpy() for f in SPLIT_ON])), strict=True):
                total += np.bincount(at, minlength=len(total))
        for t, total in enumerate(held):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t)), pa.array(at), pa.array(total[at])], ["tree", "leaf", "n"])

    found = rows.mapInArrow(run, "tree long, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect()
    forest.weigh({(x.tree, x.leaf): x.n / n for x in found})
    return forest


def at_rank(scores: DataFrame, column: str, rank: int) -> float:
    """The score that so many come before in ascending order, by counts of bins within ever narrower ranges."""
    low, high = scores.agg(F.min(column), F.max(column)).first()
    while low < high:
        bin_of = F.least(F.floor((F.col(column) - low) / (high - low) * BINS), F.lit(BINS - 1))
        bins = scores.where(F.col(column).between(low, high)).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for x in sorted(bins.collect()):
            if rank < x.n:
                low, high = x.low, x.high
                break
            rank -= x.n
    return low


def threshold(scores: DataFrame) -> float:
    """The lowest anomaly that all but GOOD_LOST of the good rows stay under; without any good or bad row, none is over."""
    good, bad = scores.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    if not good or not bad:
        return 1.0
    return at_rank(scores.where("good"), "anomaly", min(good - 1, math.ceil((1 - GOOD_LOST) * good)))


def base_failed(x: pd.DataFrame) -> pd.Series:
    return (x["n_words"] < LEAST_WORDS) | (100 * x["n_repeat_words"] > MOST_REPEATED * x["n_words"])


def split_features(x: pd.DataFrame) -> np.ndarray:
    return features(x)[:, [FEATURES.index(f) for f in SPLIT_ON]]


def sample_counts(docs: DataFrame) -> DataFrame:
    """For a look at a part, which fit() doesn't take: COUNTS of at most TRAIN_ROWS documents, chosen by the hash of id and text, so that no id or text that many rows hold
    weighs more than one row."""
    share = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1_000_000)) < int(share_of(docs, TRAIN_ROWS) * 1_000_000)
    rows = with_counts(docs.where(share)).groupBy("doc_id", *COUNTS).agg(F.count("*").alias("n"))
    return rows.select("doc_id", *COUNTS).orderBy(F.xxhash64(F.lit("order"), "doc_id", *COUNTS), "doc_id", *COUNTS).limit(TRAIN_ROWS)


def labelled_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """As sample_counts: quality and COUNTS of one row (the least in its counts) for each of at most LABELLED_ROWS labelled ids."""
    counted = with_counts(docs.join(F.broadcast(labelled_ids(labels, LABELLED_ROWS)), "doc_id"), ["quality"])
    return counted.groupBy("doc_id").agg(F.min(F.struct("quality", *COUNTS)).alias("x")).select("doc_id", "x.*")


def usable(counts: DataFrame) -> DataFrame:
    """The split features of all distinct rows of doc_id and COUNTS that pass the base rules, with a hash to draw them by."""
    rows = counts.where(~base_failed(counts)).select("doc_id", *COUNTS).distinct()
    return rows.select(F.xxhash64("doc_id", *COUNTS).alias("spread"), *(feature_columns()[f].alias(f) for f in SPLIT_ON))


def labelled_scores(counts: DataFrame, labels: DataFrame, forest: Forest) -> DataFrame:
    """anomaly and good (label 1) of one row (the least in its counts) of every labelled id, if that passes the base rules;
    the lesser of several labels counts, null ones teach nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anomaly = forest.anomaly(split_features(batch.select(COUNTS).to_pandas()))
            yield pa.RecordBatch.from_arrays([pa.array(anomaly), batch.column("good")], ["anomaly", "good"])

    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = counts.groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("x")).select("doc_id", "x.*").join(known, "doc_id")
    return rows.where(~base_failed(rows)).select((F.col("quality") == 1).alias("good"), *COUNTS).mapInArrow(run, "anomaly double, good boolean")


def fit_counts(counts: DataFrame, labels: DataFrame) -> tuple[Forest, float]:
    """The forest of all rows of with_counts() that pass the base rules, and the threshold by all labelled ones."""
    with Scratch(counts.sparkSession, "quality") as scratch:
        rows = scratch.written(usable(counts), "usable")
        n = rows.count()
        forest = weighed(rows, n, Forest(samples(rows, n)))
        return forest, threshold(scratch.written(labelled_scores(counts, labels, forest), "scores"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Forest, float]:
    """As fit_counts, of documents; no row of either table is left out, and what comes to the driver does not grow with them."""
    with Scratch(docs.sparkSession, "counts") as scratch:
        return fit_counts(scratch.written(with_counts(docs), "counts"), labels)


def judged(counts: DataFrame, forest: Forest, most: float) -> DataFrame:
    """The columns of apply_rules from rows of with_counts()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.select(COUNTS).to_pandas()
            failed = base_failed(x).to_numpy()
            anomaly = forest.anomaly(split_features(x))
            out = [pa.array(failed), pa.array(anomaly), pa.array(~failed & (anomaly <= most))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:6]), *out], names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "anomaly", "kept"]
    return counts.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, anomaly double, kept boolean")


def apply_rules(docs: DataFrame, forest: Forest, most: float) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, anomaly, kept of every whole
    text (null or empty: no words, and base_failed). Repeated rows stay, each with its own result."""
    return judged(with_counts(docs), forest, most)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; null, empty and repeated texts as in apply_rules. A document with two labels counts by the lesser.
    Texts are read once: their counts are a table for what is learned and for the verdicts."""
    counts = written(with_counts(documents(spark, sf_dir)), "counts")
    return judged(counts, *fit_counts(counts, spark.read.parquet(f"{sf_dir}/labels.parquet")))
