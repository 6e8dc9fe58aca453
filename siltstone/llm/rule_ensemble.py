"""Quality by a sparse ensemble of rules.

Small trees are grown on rule statistics of labelled rows; each path from a root is a conjunction of comparisons. A
logistic regression with lasso penalty weighs the conjunctions and drops most. The rules that are left become Spark
column expressions over the statistics.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import documents, id_crc, labelled_ids
from siltstone.llm.text_stats import COUNTS, FEATURES, features, with_counts

#: Labelled rows to learn from, at most about so many (more in the table: a share by hash), and the ensemble.
LABELLED_ROWS, TREES, DEPTH, TREE_ROWS, CUTS = 10_000, 40, 3, 1500, 12
#: Lasso penalty and steps of its solver; a score at or above ACCEPT predicts label 1.
PENALTY, STEPS, ACCEPT = 0.002, 400, 0.3
SEED = 5

#: A rule: comparisons (feature number, is it below, value), all of which hold.
Rule = tuple[tuple[int, bool, float], ...]


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, path: Rule = ()) -> list[Rule]:
    """The paths from the root to every node of a tree of least Gini impurity."""
    out = [path] if path else []
    if len(path) == DEPTH or len(y) < 20 or y.min() == y.max():
        return out
    best = None
    for f in rng.permutation(x.shape[1])[: max(2, x.shape[1] // 2)].tolist():
        for value in np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, CUTS))).tolist():
            below = x[:, f] < value
            n = int(below.sum())
            if 5 <= n <= len(y) - 5:
                p, q = y[below].mean(), y[~below].mean()
                impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
                if best is None or impurity < best[0]:
                    best = impurity, f, value, below
    if best is None:
        return out
    _, f, value, below = best
    return out + grow(x[below], y[below], rng, (*path, (f, True, value))) + grow(x[~below], y[~below], rng, (*path, (f, False, value)))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, below, value in rule:
        out &= (x[:, f] < value) == below
    return out


def lasso(r: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights and intercept by accelerated proximal steps; the intercept isn't penalised."""
    both = np.column_stack([r, np.ones(len(r))])
    w, z, t = np.zeros(both.shape[1]), np.zeros(both.shape[1]), 1.0
    step = 4 * len(r) / max(np.linalg.norm(both, 2) ** 2, 1e-9)
    for _ in range(STEPS):
        gradient = both.T @ (1 / (1 + np.exp(-(both @ z))) - y) / len(r)
        new = z - step * gradient
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * PENALTY, 0)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / later * (new - w)
        w, t = new, later
    return w[:-1], float(w[-1])


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> tuple[list[tuple[Rule, float]], float]:
    """The rules with their weights, and the intercept. Labels of one kind, or none, give no rule."""
    if not len(y) or y.min() == y.max():
        return [], float(2 * y.mean() - 1) * 4 if len(y) else 0.0
    rng = np.random.default_rng(seed)
    found: dict[tuple[bytes, int], Rule] = {}
    for _ in range(TREES):
        at = rng.choice(len(y), min(TREE_ROWS, len(y)), replace=False)
        for rule in grow(x[at], y[at], rng):
            h = holds(rule, x)
            found.setdefault((h.tobytes(), 0), rule)
    rules = list(found.values())
    r = np.column_stack([holds(rule, x) for rule in rules]).astype(float) if rules else np.zeros((len(y), 0))
    weights, intercept = lasso(r, y)
    return [(rule, float(w)) for rule, w in zip(rules, weights.tolist(), strict=True) if w], intercept


def feature_columns() -> dict[str, Column]:
    """The FEATURES as expressions of the COUNTS; the same numbers as text_stats.features."""
    c = F.col
    words, chars, lines = (F.greatest(c(x), F.lit(1)).cast("double") for x in ("n_words", "word_chars", "n_lines"))
    return {
        "log_words": F.log1p(c("n_words").cast("double")), "word_length": c("word_chars") / words, "symbols": c("n_symbols") / chars, "dup_lines": c("n_dup_lines") / lines,
        "repeats": c("n_repeat_words") / words, "distinct": c("n_distinct") / words, "upper": c("n_upper") / chars, "digits": c("n_digits") / chars, "marks": c("n_marks") / chars,
        "line_words": c("n_words") / lines,
    }


def score_column(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    """The ensemble's probability of label 1 as one expression over columns named as FEATURES."""
    total = F.lit(intercept)
    for rule, weight in rules:
        condition = F.lit(True)
        for f, below, value in rule:
            column = F.col(FEATURES[f])
            condition = condition & (column < value if below else column >= value)
        total = total + F.when(condition, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def held_out(column: str = "doc_id") -> Column:
    return F.pmod(id_crc(column), F.lit(5)) == 0


def labelled_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """quality and COUNTS of one row (the least in its counts) for each of at most LABELLED_ROWS ids that aren't held out."""
    known = labelled_ids(labels.where(~held_out()), LABELLED_ROWS)
    counted = with_counts(docs.join(F.broadcast(known), "doc_id"), ["quality"])
    return counted.groupBy("doc_id").agg(F.min(F.struct("quality", *COUNTS)).alias("x")).select("doc_id", "x.*")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[Rule, float]], float]:
    """Learns from labelled rows that aren't held out, at most LABELLED_ROWS ids, one row of each; the ids are broadcast.
    Null labels teach nothing, of two labels of a document the lesser counts, and without labels every score is a half."""
    rows = labelled_counts(docs, labels).toPandas().sort_values("doc_id")
    return fit_rules(features(rows), rows["quality"].to_numpy().astype(float))


def score(docs: DataFrame, rules: list[tuple[Rule, float]], intercept: float) -> DataFrame:
    """doc_id, score of every whole text (null: empty); repeated rows stay."""
    counts = with_counts(docs).select("doc_id", *(x.alias(name) for name, x in feature_columns().items()))
    return counts.select("doc_id", score_column(rules, intercept).alias("score"))


def kept_by_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, whose score is at least ACCEPT: null and empty texts as texts without words, repeated
    rows alike. Rows go through whole."""
    rules, intercept = fit(docs, labels)
    carried = docs.select("doc_id", "text", F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("kept_row"))
    counted = with_counts(carried, ["kept_row"])
    scored = counted.select("kept_row", *(x.alias(name) for name, x in feature_columns().items()))
    return scored.where(score_column(rules, intercept) >= ACCEPT).select("kept_row.*")


def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; null and empty texts are scored as texts without words, repeated rows alike."""
    docs = documents(spark, sf_dir)
    scored = score(docs, *fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
