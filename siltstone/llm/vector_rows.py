"""Whole-number vectors for the searches, and their dealing into pairs of blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Components are kept as floor(SCALE * x).
SCALE = 256
#: Candidate rows and query rows in a pair of blocks, about.
CANDIDATES, QUERIES = 4096, 1024
#: Rows of the sample that pivots and cells are chosen from.
SAMPLE_ROWS = 4096


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def whole_vectors(rows: DataFrame, *also: str) -> DataFrame:
    """row (a number of its own for each row), vec_id, `also`, vec: floor(SCALE * x) of each component. Rows whose vector is
    null or holds a null or a non-finite component take no part; an empty vector does, with score 0 to all. Write the result
    before it is used twice, as row numbers follow the order of the files."""
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    return rows.where(F.coalesce(usable, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), "vec_id", *also, vec.alias("vec"))


def sampled_vectors(table: DataFrame) -> np.ndarray:
    """At most SAMPLE_ROWS vectors, chosen by the hash of their row number."""
    return matrix(table.select("row", "vec").orderBy(F.xxhash64("row"), "row").limit(SAMPLE_ROWS).toArrow().column("vec"))


def matrix(vectors: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones end in zeros."""
    one = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat, sizes = one.flatten().to_numpy(zero_copy_only=False), one.value_lengths().to_numpy(zero_copy_only=False)
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def scores(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Exact inner products, in float arithmetic where no sum can leave its exact range. Beyond 64 bits there is no score:
    an error stops the query."""
    n = min(rows.shape[1], len(vector))
    rows, vector = rows[:, :n], vector[:n]
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(vector).sum())
    if most < 2**53:
        return (rows.astype(np.float64) @ vector.astype(np.float64)).astype(np.int64)
    return (rows if most < 2**63 else rows.astype(object)).dot(vector.astype(rows.dtype if most < 2**63 else object)).astype(np.int64)


def in_pairs_of_blocks(candidates: DataFrame, queries: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What run gives for a block of candidates and a block of queries, of about CANDIDATES and QUERIES rows: every candidate
    meets every query in one pair of blocks. Rows are dealt by their number, so that equal ids or vectors are no hot key."""
    blocks, parts = (max(1, -(-x.count() // n)) for x, n in ((candidates, CANDIDATES), (queries, QUERIES)))
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (blocks, parts)]
    own = [F.pmod(F.xxhash64("row"), F.lit(n)).cast("int") for n in (blocks, parts)]
    left = candidates.withColumn("block", own[0]).withColumn("query_block", every[1])
    right = queries.withColumn("block", every[0]).withColumn("query_block", own[1])
    # both sides may come from one table, so the queries' columns go by other names
    right = right.select(*(F.col(c).alias(f"asked_{c}") for c in right.columns))

    def renamed(block: pa.Table, asked: pa.Table) -> pa.Table:
        return run(block, asked.rename_columns([c.removeprefix("asked_") for c in asked.column_names]))

    return left.groupBy("block", "query_block").cogroup(right.groupBy("asked_block", "asked_query_block")).applyInArrow(renamed, schema)


def order_of(ids: list[int | None]) -> np.ndarray:
    """Ids as numbers to break ties by: nulls last."""
    return np.array([2**63 - 1 if x is None else x for x in ids], np.int64)


def first_rows(score: np.ndarray, tie: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` by score descending, then tie."""
    return np.lexsort((tie, -score))[:most]
