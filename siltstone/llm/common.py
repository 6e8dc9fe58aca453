"""What the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of texts that a Python worker handles at a time, or one text.
MOST_CHARS = 4_000_000
#: Rows that a Python worker takes and gives back at a time.
MOST_ROWS = 1000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to MOST_ROWS (0 or less is no bound), never raises them: Spark reads that setting alone, and only
    when a plan runs, and with its default of 10,000 rows two tasks' buffers of text go beyond a small executor's memory."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= MOST_ROWS:
        spark.conf.set(BATCH_ROWS, str(MOST_ROWS))


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id and whole text (null: empty); other columns, whatever their names, stay out of the plan."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def in_bounds(texts: list[str | None], most: int = MOST_CHARS, rows: int = MOST_ROWS) -> Iterator[slice]:
    """Slices of a batch with at most so many characters, or one text, and at most so many rows."""
    start = size = 0
    for i, x in enumerate(texts):
        n = len(x or "")
        if i > start and (size + n > most or i - start >= rows):
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def bounded(batch: pa.RecordBatch, column: str = "text", also: str = "doc_id") -> Iterator[tuple[pa.Array, list[str | None]]]:
    """The batch in bounded parts: another column as Arrow has it, so that no number or null in it changes, and the texts."""
    texts = batch.column(column).to_pylist()
    for part in in_bounds(texts):
        yield batch.column(also).slice(part.start, part.stop - part.start), texts[part]
    released()


def released() -> None:
    """After every batch, gives back what Arrow keeps for later: a worker lives on from stage to stage, and so would
    the peaks of all stages."""
    pa.default_memory_pool().release_unused()


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the decimal id, by which rows are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def share_of(docs: DataFrame, rows: int) -> float:
    """The share of the table's rows that gives about so many; the count reads no text."""
    return min(1.0, rows / max(1, docs.count()))


def sampled(share: float, column: str = "doc_id") -> Column:
    """Keeps that share of ids, by hash: the same rows on every run."""
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(column)), F.lit(1_000_000)) < int(share * 1_000_000)


def labelled_ids(labels: DataFrame, rows: int) -> DataFrame:
    """doc_id and quality (the lesser of several) of at most `rows` labelled ids, chosen by hash; null labels teach nothing."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    some = known.where(sampled(share_of(known, 2 * rows))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return some.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(rows)
