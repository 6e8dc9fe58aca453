"""Shingle sets of texts, a sketch of how frequent shingles are, and the prefixes by which similar sets meet.

Put the elements of all sets in one order. Two sets of sizes m <= n with Jaccard similarity t or more share at least
2tm / (1 + t) and at least tn elements, so their first common element is among the first m - 2tm / (1 + t) + 1 of the
smaller set (its index prefix) and the first n - tn + 1 of the larger one (its probe prefix). The order puts rare elements
first: by their count in the sketch, then by hash. Whatever the counts are, no pair is missed.
"""

from __future__ import annotations

import numpy as np
import xxhash

A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Counters of the sketch, and in a block of it: an element is counted under its low bits.
COUNTERS, BLOCK = 1 << 20, 1 << 15
#: Words whose hashes a worker remembers before it starts anew.
MEMO = 50_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


WORD_HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k words in a row."""
    out = h[: len(h) - k + 1] * A
    for j in range(1, k):
        out = mixed(out) * B + h[j : len(h) - k + 1 + j] * C
    return mixed(out + np.uint64(k))


def shingle_lists(texts: list[str | None], words_each: int = 3) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of the distinct shingles of its words (A-Z lower-cased, cut at ASCII white
    space); with fewer words the whole sequence is one; none without words."""
    words: list[bytes] = []
    ends = [0]
    for x in texts:
        words += (x or "").encode("utf-8", "surrogatepass").lower().split()
        ends.append(len(words))
    h = np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))
    every = runs_of(h, words_each) if len(h) >= words_each else h[:0]
    out = []
    for i, j in zip(ends, ends[1:], strict=False):
        if j - i >= words_each:
            s = np.sort(every[i : j - words_each + 1])
        else:
            s = runs_of(h[i:j], j - i) if j > i else h[:0]
        if len(s) > 1:
            first = np.empty(len(s), bool)
            first[0] = True
            np.not_equal(s[1:], s[:-1], out=first[1:])
            s = s[first]
        out.append(s)
    return out


def shingles(text: str | None, words_each: int = 3) -> np.ndarray:
    return shingle_lists([text], words_each)[0]


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share, as two signed numbers."""
    with np.errstate(over="ignore"):
        pair = mixed(np.array([mixed(s ^ A).sum(dtype=np.uint64), mixed(s ^ B).sum(dtype=np.uint64)], np.uint64) + np.uint64(len(s)))
    return tuple(pair.astype(np.int64).tolist())


def places(s: np.ndarray) -> np.ndarray:
    """The counters of a set's elements."""
    return (s & np.uint64(COUNTERS - 1)).astype(np.int64)


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """Of a set of n elements: its probe prefix, and its index prefix, which is never longer."""
    return n + (-percent * n) // 100 + 1, n + (-2 * percent * n) // (100 + percent) + 1


def prefix(s: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """A set's probe prefix in the common order, and how many of its elements are the index prefix."""
    probe, index = prefix_lengths(len(s), percent)
    return s[np.argsort(counts[places(s)], kind="stable")[:probe]], index
