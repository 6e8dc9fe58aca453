"""Exact top-k search by inner product, with a table of distances to pivots.

Each row's distances to PIVOTS pivots are computed once. For a query, the greatest difference of its own distance and a
row's, over all pivots, is a lower bound of their distance, and with both norms an upper bound of their inner product:
2 <q, x> = |q|^2 + |x|^2 - |q - x|^2. Candidates are scored in the order of their bounds until the k-th best score is above
every bound that is left. Queries and candidates meet in pairs of blocks, and the blocks' best rows are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.vector_rows import embeddings, first_rows, in_pairs_of_blocks, matrix, order_of, sampled_vectors, scores, whole_vectors
from siltstone.sources.shared import Scratch, written

BEST, QUERY_STEP, PIVOTS = 5, 50, 32
#: Candidates that are scored at once: the first so many, then twice as many each time.
FIRST_SCORED = 64


def chosen_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Rows of a sample, each farthest from those before it; the first is the farthest from the mean. Equal rows once."""
    if not sample.size:
        return np.zeros((0, sample.shape[1]))
    rows = sample.astype(np.float64)
    near = ((rows - rows.mean(0)) ** 2).sum(1)
    out: list[int] = []
    while len(out) < min(most, len(rows)) and near.max() > 0:
        out.append(int(near.argmax()))
        far = ((rows - rows[out[-1]]) ** 2).sum(1)
        near = np.minimum(near, far) if len(out) > 1 else far
    return rows[out]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, either padded with zeros to the other's width."""
    width = max(rows.shape[1], pivots.shape[1])
    a, b = (np.pad(x.astype(np.float64), ((0, 0), (0, width - x.shape[1]))) for x in (rows, pivots))
    squares = (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def pivot_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """row, vec_id, vec and far: the distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = distances(matrix(batch.column("vec")), pivots).astype(np.float64)
                ends = pa.array(np.arange(len(far) + 1) * len(pivots), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.select(["row", "vec_id", "vec"]).columns, pa.ListArray.from_arrays(ends, pa.array(far.ravel()))], ["row", "vec_id", "vec", "far"])

    return rows.mapInArrow(run, "row long, vec_id long, vec array<long>, far array<double>")


def bounds(query_far: np.ndarray, query_norm: float, far: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of one query with rows. Distances are rounded, so a bound is let out by more than
    their error."""
    slack = 1e-6 * max(1.0, query_norm**0.5, float(norms.max(initial=0)) ** 0.5)
    apart = np.maximum(np.abs(far - query_far[:, None]).max(0, initial=0) - slack, 0)
    above = (query_norm + norms - apart**2) / 2
    return above + 1e-9 * (query_norm + norms) + 1e-3


def best_rows(vector: np.ndarray, above: np.ndarray, rows: np.ndarray, ties: np.ndarray, usable: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the `most` best usable rows, and how many rows were scored: in the order of their bounds, until
    no bound that is left reaches the last of the best."""
    order = np.argsort(-above, kind="stable")
    order = order[usable[order]]
    places, found, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, FIRST_SCORED
    while at < len(order) and (len(places) < most or above[order[at]] >= found[-1]):
        new = order[at : at + step]
        places, found = np.concatenate([places, new]), np.concatenate([found, scores(rows[new], vector)])
        first = first_rows(found, ties[places], most)
        places, found, at, step = places[first], found[first], at + len(new), 2 * step
    return places, found, min(at, len(order))


def block_best(table: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """The `most` best candidates of each query within each block: query_row, query_id, row, vec_id, score, and scored, how
    many rows of the block its search scored."""
    fields = [("query_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("scored", pa.int64())]

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in fields]
        if block.num_rows and asked.num_rows:
            rows, own = matrix(block.column("vec")), matrix(asked.column("vec"))
            far, own_far = (matrix_of(t.column("far")) for t in (block, asked))
            norms, own_norms = ((x.astype(np.float64) ** 2).sum(1) for x in (rows, own))
            numbers, ids, far = block.column("row").to_numpy(), block.column("vec_id").to_pylist(), np.ascontiguousarray(far.T)
            ties = order_of(ids)
            for i, (row, vec_id) in enumerate(zip(asked.column("row").to_pylist(), asked.column("vec_id").to_pylist(), strict=True)):
                above = bounds(own_far[i], own_norms[i], far, norms)
                places, found, scored = best_rows(own[i], above, rows, ties, numbers != row, most)
                for column, values in zip(columns, ([row] * len(places), [vec_id] * len(places), numbers[places].tolist(), [ids[p] for p in places], found.tolist(), [scored] * len(places)), strict=True):
                    column += values
        return pa.table({c: pa.array(v, t) for (c, t), v in zip(fields, columns, strict=True)})

    return in_pairs_of_blocks(table, queries, run, "query_row long, query_id long, row long, vec_id long, score long, scored long")


def matrix_of(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    one = lists.combine_chunks()
    return one.flatten().to_numpy(zero_copy_only=False).reshape(len(one), -1)


def nearest(rows: DataFrame, best: int = BEST, step: int = QUERY_STEP, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `step`, the `best` other rows (all, if fewer)
    by integer inner product, ties by smaller vec_id. Rows without a usable vector take no part (whole_vectors). Of rows with
    one vec_id each is a row of its own: as a query it has its own result, and the others are candidates. A null vec_id is no
    query and comes last among ties. A shorter vector counts as if it ended in zeros. Other columns don't matter; an empty
    table has no rows."""
    with Scratch(rows.sparkSession, "pivots") as scratch:
        vectors = scratch.written(whole_vectors(rows), "vectors")
        table = scratch.written(pivot_table(vectors, chosen_pivots(sampled_vectors(vectors), pivots)), "pivot-table")
        found = block_best(table, table.where(F.col("vec_id") % step == 0), best)
        by = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
        ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= best)
        return written(ranked.select("query_id", "rank", "vec_id", "score"), "nearest")


def op13_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings; nulls, ties and repeated rows as in nearest."""
    return nearest(embeddings(spark, sf_dir))
