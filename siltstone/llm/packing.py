"""Packing token ids into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut at every full window, and the rest into parts of at most a quarter window. Documents go to
groups of bounded size by a hash of their row, and each group is packed alone: the two partial partitions of largest
imbalance merge, the fullest window of one onto the emptiest of the other, until one partition is left. If a window
exceeds the capacity, the window count rises and the group is packed again.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import bounded, doc_texts, documents
from siltstone.llm.library_tokens import MEMO, encoder
from siltstone.sources.shared import written

END, WINDOW = 2, 4096
#: Documents in a group. Its windows are near full whatever the number of groups; memory in a task is bounded by it.
GROUP = 1000


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Window number (0 to k - 1) of each part, and the largest window's sum.

    A partial partition keeps the sums of its windows that hold something, descending, with the first and last part of
    each window; the parts of a window are a linked list, so that a merge costs one step a window."""
    n = len(sizes)
    following = np.full(n, -1, np.int64)
    heap = []
    for i, size in enumerate(sizes.tolist()):
        one = np.array([i])
        heap.append((-size, i, np.array([size], np.int64), one, one))
    heapq.heapify(heap)
    number = n
    while len(heap) > 1:
        _, _, a, a_first, a_last = heapq.heappop(heap)
        _, _, b, b_first, b_last = heapq.heappop(heap)
        both = max(0, len(a) + len(b) - k)
        alone_a, alone_b = len(a) - both, len(b) - both
        # the emptiest windows of a get the fullest of b turned round: a's are descending, so the last `both` of each meet
        met = a[alone_a:] + b[alone_b:][::-1]
        following[a_last[alone_a:]] = b_first[alone_b:][::-1]
        sums = np.concatenate([a[:alone_a], b[:alone_b], met])
        first = np.concatenate([a_first[:alone_a], b_first[:alone_b], a_first[alone_a:]])
        last = np.concatenate([a_last[:alone_a], b_last[:alone_b], b_last[alone_b:][::-1]])
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        spread = int(sums[0] - (sums[-1] if len(sums) == k else 0))
        heapq.heappush(heap, (-spread, number, sums, first[order], last[order]))
        number += 1
    window = np.zeros(n, np.int64)
    if not heap:
        return window, 0
    _, _, sums, at, _ = heap[0]
    number_of = np.arange(len(at))
    while len(at):
        window[at] = number_of
        at = following[at]
        number_of, at = number_of[at >= 0], at[at >= 0]
    return window, int(sums[0])


def near_equal_windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each part, none over the capacity: as many windows as the total needs, more whenever one is exceeded."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    k = max(1, math.ceil(int(sizes.sum()) / capacity))
    while True:
        window, most = differencing(sizes, k)
        if most <= capacity:
            return window
        over = np.maximum(np.bincount(window, sizes, minlength=k) - capacity, 0).sum()
        k += max(1, math.ceil(over / capacity))


def cuts(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then the rest in equal parts of at most a quarter window."""
    full = n // window * window
    out = [(i, window) for i in range(0, full, window)]
    parts = math.ceil((n - full) / max(1, window // 4))
    ends = [full + (n - full) * i // parts for i in range(parts + 1)] if parts else []
    return out + [(i, j - i) for i, j in zip(ends, ends[1:], strict=False)]


def token_pieces(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, with_ids: bool = False, memo: int = MEMO) -> DataFrame:
    """A row for each document: row_key (unique), doc_id, doc_tokens (with the end id), crcs (of each piece's ids as
    little-endian unsigned 32-bit integers) and, if asked for, ids (all of them so). Null text: the end id alone. memo: bytes
    of pieces that a worker remembers, about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, memo)
        tail = np.array([end], "<u4").tobytes()
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_ids, texts in bounded(batch):
                sizes, crcs, kept = [], [], []
                for raw in e.encode(texts):
                    ids = np.frombuffer(raw, e.dtype).astype("<u4").tobytes() + tail
                    n = len(ids) // 4
                    sizes.append(n)
                    crcs.append([zlib.crc32(ids[4 * s : 4 * (s + m)]) for s, m in cuts(n, window)])
                    kept.append(ids if with_ids else b"")
                keys = pa.array(range(key, key + len(texts)), pa.int64())
                key += len(texts)
                yield pa.RecordBatch.from_arrays([keys, doc_ids, pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(kept, pa.binary())], ["row_key", "doc_id", "doc_tokens", "crcs", "ids"])

    return doc_texts(docs).mapInArrow(run, "row_key long, doc_id long, doc_tokens long, crcs array<long>, ids binary")


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, with_ids: bool = False, memo: int = MEMO) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (in its sequence, gapless
    from 0), and ids (little-endian unsigned 32-bit) if asked for: ordered by offset, a sequence's ids are its content.
    Repeated rows are packed each; an empty table gives no piece; texts may have any length."""
    tokens = written(token_pieces(docs, path, window, end, with_ids, memo), "tokens")
    groups = max(1, math.ceil(tokens.count() / GROUP))

    def run(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("row_key")
        tokens_of, crcs, ids = part.column("doc_tokens").to_pylist(), part.column("crcs").to_pylist(), part.column("ids").to_pylist()
        row, start, length, crc, piece = [], [], [], [], []
        for i, n in enumerate(tokens_of):
            for (s, m), c in zip(cuts(n, window), crcs[i], strict=True):
                row.append(i)
                start.append(s)
                length.append(m)
                crc.append(c)
                piece.append(ids[i][4 * s : 4 * (s + m)])
        size = np.array(length, np.int64)
        small = size < window
        sequence = np.zeros(len(size), np.int64)
        sequence[small] = near_equal_windows(size[small], window)
        taken = int(sequence[small].max()) + 1 if small.any() else 0
        sequence[~small] = taken + np.arange((~small).sum())
        order = np.argsort(sequence, kind="stable")
        ends = np.cumsum(size[order])
        first = np.concatenate([[True], np.diff(sequence[order]) != 0])
        offset = np.zeros(len(size), np.int64)
        offset[order] = ends - size[order] - np.repeat((ends - size[order])[first], np.diff(np.flatnonzero(np.append(first, True))))
        at = pa.array(row, pa.int64())
        return pa.table({
            "doc_id": part.column("doc_id").take(at), "start": pa.array(start, pa.int64()), "length": pa.array(size), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": part.column("doc_tokens").take(at),
            "ids": pa.array(piece, pa.binary()), "sequence_id": pa.array((key[0].as_py() << 32) + sequence), "offset": pa.array(offset),
        })

    out = tokens.withColumn("pack_group", F.pmod(F.xxhash64("row_key"), F.lit(groups))).groupBy("pack_group").applyInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, sequence_id long, offset long")
    return out if with_ids else out.drop("ids")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (the bytes of its pieces in order), length of every sequence of pack(with_ids=True), at most a window
    each; documents' nulls and repeats don't matter here, and an empty table gives none."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    return packed.groupBy("sequence_id").agg(ordered.alias("p")).select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), F.expr("aggregate(p, 0L, (a, x) -> a + x.length)").alias("length"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; null, empty, repeated and very long texts as in pack."""
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
