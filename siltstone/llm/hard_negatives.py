"""Hard negatives by a vector-approximation file.

Each dimension is cut into cells and a row keeps the number of its cell in each. For a query, a table holds the least and
the greatest product of its component with any value of a cell; a row's looked-up sums bound its inner product from below
and above, and only rows whose bounds may enter the wanted window are scored. Queries and candidates meet in pairs of blocks:
once for the positives of every anchor, once for the negatives of every anchor and positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.vector_rows import embeddings, first_rows, in_pairs_of_blocks, matrix, order_of, sampled_vectors, scores, whole_vectors
from siltstone.sources.shared import Scratch, written

#: Anchors are every so manyth id; positives of each, negatives of each positive; the window in percent of the positive.
STEP, POSITIVES, NEGATIVES, LEAST_PERCENT, MOST_PERCENT = 50, 5, 3, 50, 95
#: Cells of a dimension.
CELLS = 64
#: Queries whose bounds are summed at once.
TOGETHER = 32
LABEL_STEP, LABELS = 7, 10


def cell_edges(table: DataFrame, cells: int = CELLS) -> np.ndarray:
    """For each dimension the first and the last value of each of its cells, as (dimension, cell, 2): cells of about equal
    shares of a bounded sample; the outer ones reach to the least and the greatest value of all rows."""
    ends = table.select(F.posexplode("vec").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("d").collect()
    sample = sampled_vectors(table)
    out = np.zeros((len(ends), cells, 2), np.int64)
    for x in ends:
        inner = sample[:, x.d] if x.d < sample.shape[1] else np.zeros(0, np.int64)
        # a shorter vector has zeros
        low, high = min(x.low, 0), max(x.high, 0)
        cuts = np.quantile(inner, np.arange(1, cells) / cells, method="lower") if len(inner) else np.zeros(cells - 1)
        cuts = np.clip(cuts.astype(np.int64), low, high)
        out[x.d, :, 0] = np.concatenate([[low], cuts])
        out[x.d, :, 1] = np.concatenate([np.maximum(cuts - 1, out[x.d, :-1, 0]), [high]])
    return out


def cells_of(rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The cell of each component, as (dimension, row): the last that begins at or below it."""
    wide = np.zeros((len(rows), len(edges)), np.int64)
    wide[:, : rows.shape[1]] = rows
    return np.stack([np.searchsorted(edges[d, 1:, 0], wide[:, d], "right") for d in range(len(edges))]).astype(np.uint8) if len(edges) else np.zeros((0, len(rows)), np.uint8)


def approximations(table: DataFrame, edges: np.ndarray) -> DataFrame:
    """row, vec_id, label, vec and cells, the approximation of vec: a byte for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "vec_id", "label", "vec"]
        for batch in batches:
            if batch.num_rows:
                cells = np.ascontiguousarray(cells_of(matrix(batch.column("vec")), edges).T)
                yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array([x.tobytes() for x in cells], pa.binary())], [*names, "cells"])

    return table.mapInArrow(run, "row long, vec_id long, label int, vec array<long>, cells binary")


def products(queries: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tables (dimension, query, cell) of the least and the greatest product of a query's component and a cell's values."""
    wide = np.zeros((len(queries), len(edges)), np.int64)
    wide[:, : queries.shape[1]] = queries
    most = float(np.abs(edges).max(initial=0)) * float(np.abs(wide).sum(1).max(initial=0))
    kind = np.int32 if most < 2**31 else np.int64 if most < 2**63 else np.float64
    ends = [wide.T[:, :, None].astype(kind) * edges[:, None, :, i].astype(kind) for i in (0, 1)]
    low, high = np.minimum(*ends), np.maximum(*ends)
    slack = (np.abs(low) + np.abs(high)) * 1e-12 if kind is np.float64 else 0
    return low - slack, high + slack


def looked_up(table: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Sums over dimensions of the table's entries at the rows' cells: (query, row)."""
    total = np.zeros((table.shape[1], cells.shape[1]), table.dtype)
    for d in range(len(cells)):
        total += np.take(table[d], cells[d], axis=1)
    return total


def kth(values: np.ndarray, k: int) -> float:
    """The k-th greatest value; none reaches below it if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def best_within(vector: np.ndarray, low: np.ndarray, high: np.ndarray, usable: np.ndarray, window: tuple[float, float], block: tuple, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the `most` best usable rows with a score in the window, and how many rows were scored: those
    whose bounds may enter the window and reach the k-th best of the rows that are surely in it."""
    rows, ties = block
    least, greatest = window
    sure = low[usable & (low >= least) & (high <= greatest)]
    may = np.flatnonzero(usable & (high >= max(least, kth(sure, most))) & (low <= greatest))
    exact = scores(rows[may], vector)
    inside = (exact >= least) & (exact <= greatest)
    may_be, exact = may[inside], exact[inside]
    first = first_rows(exact, ties[may_be], most)
    return may_be[first], exact[first], len(may)


def searched(table: DataFrame, queries: DataFrame, edges: np.ndarray, same: bool, most: int, least_percent: int, most_percent: int) -> DataFrame:
    """The best rows of each query within each block: query_row, query_id, and for each of its positives (of which there is
    one without number when the positives themselves are searched) row, vec_id and score of rows of the same or of other
    labels."""
    fields = [("query_row", pa.int64()), ("query_id", pa.int64()), ("positive_row", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("scored", pa.int64())]

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if block.num_rows and asked.num_rows:
            rows, own = matrix(block.column("vec")), matrix(asked.column("vec"))
            cells = np.frombuffer(b"".join(block.column("cells").to_pylist()), np.uint8).reshape(len(rows), -1).T.copy()
            numbers, ids, labels = block.column("row").to_numpy(), block.column("vec_id").to_pylist(), block.column("label").to_numpy()
            ties, anchors = order_of(ids), asked.select(["row", "vec_id", "label", "positives"]).to_pylist()
            for start in range(0, len(own), TOGETHER):
                low, high = (looked_up(t, cells) for t in products(own[start : start + TOGETHER], edges))
                for i, a in enumerate(anchors[start : start + TOGETHER]):
                    usable = (labels == a["label"]) & (numbers != a["row"]) if same else labels != a["label"]
                    for p in a["positives"]:
                        window = (-np.inf, np.inf) if same else (-(-least_percent * p["score"] // 100), most_percent * p["score"] // 100)
                        if window[0] > window[1]:
                            continue
                        places, found, scored = best_within(own[start + i], low[i], high[i], usable, window, (rows, ties), most)
                        out += [(a["row"], a["vec_id"], p["row"], p["vec_id"], p["score"], int(numbers[x]), ids[x], int(s), scored) for x, s in zip(places, found, strict=True)]
        return pa.table({c: pa.array([x[i] for x in out], t) for i, (c, t) in enumerate(fields)})

    return in_pairs_of_blocks(table, queries, run, ", ".join(f"{c} long" for c, _ in fields))


def first_by(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


def shifted_labels(rows: DataFrame) -> DataFrame:
    """Rows with a label; where vec_id is divisible by LABEL_STEP, the label after it."""
    label = F.col("label")
    moved = F.when(F.col("vec_id") % LABEL_STEP == 0, (label + 1) % LABELS).otherwise(label)
    return rows.where(label.isNotNull()).select("vec_id", "embedding", moved.cast("int").alias("label"))


def mined(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, step: int = STEP, least_percent: int = LEAST_PERCENT, most_percent: int = MOST_PERCENT, cells: int = CELLS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row (anchor) whose vec_id is
    divisible by `step` and each of its first `positives` other rows of the same label, the first `negatives` rows of another
    label whose score lies in the window between least_percent and most_percent of the positive's, inclusive. First is by
    inner product descending, then smaller vec_id. An anchor without positives, or a positive with none in its window, has no
    rows. Rows without label or usable vector take no part. Of rows with one vec_id each is a row of its own; a null vec_id is
    no anchor and comes last among ties. A shorter vector counts as if it ended in zeros. Other columns don't matter."""
    with Scratch(rows.sparkSession, "negatives") as scratch:
        vectors = scratch.written(whole_vectors(rows.where("label is not null"), "label"), "vectors")
        edges = cell_edges(vectors, cells)
        table = scratch.written(approximations(vectors, edges), "approximations")
        anchors = table.where(F.col("vec_id") % step == 0).drop("cells")
        nothing = "array<struct<row:long,vec_id:long,score:long>>"
        alone = anchors.withColumn("positives", F.array(F.struct(*(F.lit(None).cast("long").alias(c) for c in ("row", "vec_id", "score")))).cast(nothing))
        best = first_by(searched(table, alone, edges, True, positives, least_percent, most_percent), ["query_row"], positives)
        theirs = best.groupBy("query_row").agg(F.collect_list(F.struct("row", "vec_id", "score")).cast(nothing).alias("positives"))
        asked = scratch.written(anchors.join(theirs.withColumnRenamed("query_row", "row"), "row"), "anchors")
        found = first_by(searched(table, asked, edges, False, negatives, least_percent, most_percent), ["query_row", "positive_row"], negatives)
        return written(found.select(F.col("query_id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, with shifted_labels; nulls, ties and repeated rows as in mined."""
    return mined(shifted_labels(embeddings(spark, sf_dir)))
