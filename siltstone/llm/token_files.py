"""Flat files of token ids with 64-bit document offsets, memory-mapped when they are read.

A shard is the ids of a range of doc_ids, in ascending order: <shard>.bin holds unsigned ids one after another (2 bytes
each if the vocabulary allows, else 4), <shard>.idx the n + 1 offsets of its n documents in ids, <shard>.doc their
doc_ids (null ones stand first, as 0, and are counted); both are 64-bit little-endian. Bases (ids in all shards before) are prefix sums over the shards' totals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import bounded, doc_texts, documents
from siltstone.llm.library_tokens import encoder
from siltstone.sources.shared import scratch_path

END = 2
SHARDS = "shard long, docs long, nulls long, tokens long, width int"


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end: int = END) -> DataFrame:
    """Writes the shards to a folder that all executors share; a row for each: shard, docs, nulls (of its doc_ids),
    tokens, width (bytes of an id), token_base. A task writes under a name of its own and renames at its end, so one that is lost or repeated leaves
    a whole file. Rows of one doc_id stand in the order of their texts; null ids come first; null text: the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        tail = np.array([end], e.dtype).tobytes()
        task = TaskContext.get()
        shard, store, top = task.partitionId(), *files.FileSystem.from_uri(folder)
        own = f"{top}/{shard:08d}.{task.taskAttemptId()}"
        out, offsets, ids, nulls = None, [np.zeros(1, np.int64)], [], 0
        for batch in batches:
            if out is None:
                store.create_dir(top, recursive=True)
                out = store.open_output_stream(f"{own}.bin")
            for doc_ids, texts in bounded(batch):
                nulls += doc_ids.null_count
                ids.append(doc_ids.fill_null(0).to_numpy(zero_copy_only=False))
                sizes = []
                for raw in e.encode(texts):
                    out.write(raw)
                    out.write(tail)
                    sizes.append((len(raw) + len(tail)) // len(tail))
                offsets.append(offsets[-1][-1] + np.cumsum(np.array(sizes, np.int64)))
        if out is None:
            return
        out.close()
        numbers = {"idx": np.concatenate(offsets), "doc": np.concatenate(ids)}
        for kind, x in numbers.items():
            with store.open_output_stream(f"{own}.{kind}") as f:
                f.write(x.astype("<i8").tobytes())
        for kind in ("bin", "idx", "doc"):
            store.move(f"{own}.{kind}", f"{top}/{shard:08d}.{kind}")
        row = [shard, len(numbers["doc"]), nulls, int(numbers["idx"][-1]), e.dtype.itemsize]
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in row[:4]), pa.array(row[4:], pa.int32())], ["shard", "docs", "nulls", "tokens", "width"])

    spark = docs.sparkSession
    shards = doc_texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SHARDS).collect()
    rows, base = [], 0
    for x in sorted(shards):
        rows.append((*x, base))
        base += x.tokens
    return spark.createDataFrame(rows, f"{SHARDS}, token_base long").repartition(max(1, len(rows)))


def read_token_files(shards: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers) and, if asked for, ids, of every document in the shards."""

    def mapped(store: files.FileSystem, path: str) -> pa.Buffer:
        if isinstance(store, files.LocalFileSystem):
            return pa.memory_map(path).read_buffer()
        with store.open_input_file(path) as f:
            return f.read_buffer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = files.FileSystem.from_uri(folder)
        for batch in batches:
            for x in batch.to_pylist():
                at = f"{top}/{x['shard']:08d}"
                ids = np.frombuffer(mapped(store, f"{at}.bin"), f"<u{x['width']}")
                offsets, docs = (np.frombuffer(mapped(store, f"{at}.{kind}"), "<i8") for kind in ("idx", "doc"))
                for i in range(0, len(docs), 1000):
                    j = min(len(docs), i + 1000)
                    parts = [ids[a:b].astype("<u4").tobytes() for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)]
                    missing = np.arange(i, j) < x["nulls"]
                    arrays = [pa.array(docs[i:j], pa.int64(), mask=missing), pa.array(x["token_base"] + offsets[i:j]), pa.array(np.diff(offsets[i : j + 1])), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(parts if with_ids else [b""] * (j - i), pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    out = shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; null, empty and repeated texts as in write_token_files."""
    import public_tokenizers

    folder = scratch_path(spark, "token-files")
    shards = write_token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_token_files(shards, folder)
