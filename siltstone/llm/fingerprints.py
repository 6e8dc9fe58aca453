"""Context-triggered piecewise hashes of texts, and their likeness by edit distance.

A rolling hash of the last WIDE bytes ends a chunk where it is BLOCK - 1 modulo the block size; each chunk gives one
character of a signature. The block size is the smallest of BLOCK times a power of two that is
at least half of the bytes over LONGEST and gives at most LONGEST chunks; a fingerprint is `size:signature:signature at twice the size`. Fingerprints are comparable if their sizes are equal or a
factor of two apart, by the signatures of one size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import bounded, doc_texts, documents
from siltstone.sources.shared import written

WIDE, BLOCK, LONGEST = 7, 3, 64
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
ODD, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
#: Bytes whose chunk hashes are computed at a time.
SPAN = 1 << 16


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """ODD to the power of 0 to SPAN, and the inverses."""
    one = np.ones(1, np.uint64)
    return tuple(np.concatenate([one, np.multiply.accumulate(np.full(SPAN, x, np.uint64))]) for x in (ODD, INVERSE))


def chunk_letters(data: np.ndarray, ends: np.ndarray) -> bytes:
    """A letter for each chunk; ends: the place after each chunk's last byte, ascending, the last one len(data). A chunk's
    hash is a polynomial of its bytes, summed over the spans that it crosses."""
    up, down = powers()
    sums = np.zeros(len(ends), np.uint64)
    starts = np.concatenate([[0], ends[:-1]])
    for base in range(0, len(data), SPAN):
        part = data[base : base + SPAN]
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)])])
        first, last = np.searchsorted(ends, base, "right"), np.searchsorted(starts, base + len(part), "left")
        i = np.maximum(starts[first:last] - base, 0)
        j = np.minimum(ends[first:last] - base, len(part))
        within = (run[j] - run[i]) * down[i]
        offset = np.maximum(base - starts[first:last], 0)
        whole = np.array([pow(int(up[SPAN]), x, 2**64) for x in (offset // SPAN).tolist()], np.uint64)
        sums[first:last] += within * up[offset % SPAN] * whole
    mixed = sums ^ (sums >> np.uint64(29))
    mixed = (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(58)
    return LETTERS[mixed.astype(np.int64)].tobytes()


def fingerprint(text: str) -> str:
    """An empty text has empty signatures at the least size."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if not n:
        return f"{BLOCK}::"
    padded = np.concatenate([np.zeros(WIDE - 1, np.uint32), data.astype(np.uint32) + np.uint32(1)])
    rolling = np.zeros(n, np.uint32)
    for back in range(WIDE):
        rolling *= np.uint32(33)
        rolling += padded[back : back + n]
    rolling ^= rolling >> np.uint32(15)
    rolling *= np.uint32(0x85EBCA6B)
    rolling ^= rolling >> np.uint32(13)
    size = BLOCK << max(0, math.ceil(math.log2(n / (LONGEST * BLOCK))) - 1) if n > LONGEST * BLOCK else BLOCK
    at = np.flatnonzero(rolling % np.uint32(size) == size - 1)
    while len(at) >= LONGEST:
        size *= 2
        at = at[rolling[at] % np.uint32(size) == size - 1]
    twice = at[rolling[at] % np.uint32(2 * size) == 2 * size - 1]
    signatures = []
    for places in (at, twice):
        ends = places + 1
        if not len(ends) or ends[-1] != n:
            ends = np.append(ends, n)
        signatures.append(chunk_letters(data, ends).decode())
    return f"{size}:{signatures[0]}:{signatures[1]}"


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of rows at a time."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def likeness(x: str, y: str) -> float:
    """1 for equal fingerprints, else 1 less the edit distance (insertions and deletions) over the signatures' lengths at
    a size that both have; 0 where they have none, or a signature is empty."""
    if x == y:
        return 1.0
    (p, a, b), (q, c, d) = x.split(":"), y.split(":")
    p, q = int(p), int(q)
    pairs = {0: [(a, c), (b, d)], 1: [(b, c)], -1: [(a, d)]}.get((q > p) - (q < p) if p == q or max(p, q) == 2 * min(p, q) else 2, [])
    return max((2 * common_length(s, t) / (len(s) + len(t)) for s, t in pairs if s and t), default=0.0)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the first as many characters, or all, of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


RESULT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def compared(text: str, own: str, following: str, other: str) -> tuple:
    """The RESULT of a text with fingerprint own before a text with fingerprint other."""
    changed = edited(text, following)
    print_of_changed = own if changed == text else fingerprint(changed)
    return len(text), sha256(changed), own, print_of_changed, likeness(own, print_of_changed), likeness(own, other)


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id and RESULT of every document with the next in descending doc_id order (equal ids: descending text; after the
    last one: the first). Texts are dealt out by ranges of doc_id, and each range is compared in one ordered pass that
    holds two texts; the first and last text of each range then meet those of its neighbours."""

    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    edge_types = [pa.int64(), pa.string(), pa.string()]

    def batch_of(ids: list[pa.Array], rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(x, t) for x, t in zip(columns, [*types, *edge_types], strict=True)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *arrays], ["doc_id", *RESULT, "part", "head", "tail"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        nothing = (None,) * len(RESULT)
        none = pa.nulls(1, pa.int64())
        previous = None
        for batch in batches:
            for ids, texts in bounded(batch):
                rows, of = [], []
                for i, text in enumerate(texts):
                    own = fingerprint(text) if previous is None or text != previous[1] else previous[2]
                    if previous is None:
                        rows.append((*nothing, part, text, None))
                        of.append(none)
                    else:
                        rows.append((*compared(previous[1], previous[2], text, own), None, None, None))
                        of.append(previous[0])
                    previous = (ids.slice(i, 1), text, own)
                yield batch_of(of, rows)
        if previous is not None:
            yield batch_of([previous[0]], [(*nothing, part, None, previous[1])])

    result = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    spark = docs.sparkSession
    ordered = doc_texts(docs).repartitionByRange(F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id"), F.desc("text"))
    seen = written(ordered.mapInArrow(run, f"doc_id long, {result}, part long, head string, tail string"), "fingerprints")
    parts = sorted(x.part for x in seen.where("head is not null").select("part").collect())
    after = spark.createDataFrame([(p, q) for p, q in zip(parts, parts[1:] + parts[:1], strict=True)], "part long, next_part long")
    heads = seen.where("head is not null").select(F.col("part").alias("next_part"), "head")
    edges = seen.where("tail is not null").select("part", "doc_id", "tail").join(after, "part").join(heads, "next_part")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column("tail")[i].as_py(), batch.column("head")[i].as_py()
                found = compared(a, fingerprint(a), b, fingerprint(b))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), *(pa.array([x], t) for x, t in zip(found, types, strict=True))], ["doc_id", *RESULT])

    inner = seen.where("part is null").select("doc_id", *RESULT)
    return inner.unionByName(edges.select("doc_id", "tail", "head").mapInArrow(joined, f"doc_id long, {result}"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; null, empty and repeated texts as in neighbours (null: empty; equal ids: descending text)."""
    return neighbours(documents(spark, sf_dir))
