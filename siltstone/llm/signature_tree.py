"""A signature tree over token sets: each node has the OR of its sets' bitmaps and the range of their sizes.

Two sets of sizes m and n with Jaccard similarity t or more share at least t / (1 + t) * (m + n) tokens. A set with p bits
in its bitmap has m - p tokens beyond one for each bit, so a pair from two nodes shares at most the bits of both bitmaps
plus the lesser of the nodes' greatest m - p, and at most the lesser of their greatest sizes. A dual traversal drops node
pairs that can't reach what they need, and pairs of nodes that are one component already.
"""

from __future__ import annotations

import numpy as np

FANOUT, LEAST_BITS, MOST_BITS = 8, 256, 1 << 16


class Components:
    """Union-find; a component's root is its least number."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


class Node:
    __slots__ = ("beyond", "bits", "children", "high", "item", "low", "one")

    def __init__(self, item: int, bits: int, low: int, high: int, beyond: int, children: tuple[Node, ...] = ()):
        self.item, self.bits, self.low, self.high, self.beyond, self.children = item, bits, low, high, beyond, children
        self.one = not children  # known to be one component


def bitmap(s: np.ndarray, bits: int) -> int:
    flags = np.zeros(bits, np.uint8)
    flags[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return int.from_bytes(np.packbits(flags).tobytes(), "big")


def build(items: list[int], sets: list[np.ndarray], bits: int) -> Node | None:
    """The tree over some of the sets; sets with the same least token, and of like sizes, stand together."""
    level = []
    for i in sorted(items, key=lambda i: (sets[i][0], len(sets[i]), i)):
        b = bitmap(sets[i], bits)
        level.append(Node(i, b, len(sets[i]), len(sets[i]), len(sets[i]) - b.bit_count()))
    while len(level) > 1:
        above = []
        for at in range(0, len(level), FANOUT):
            part = tuple(level[at : at + FANOUT])
            every = 0
            for x in part:
                every |= x.bits
            above.append(Node(part[0].item, every, min(x.low for x in part), max(x.high for x in part), max(x.beyond for x in part), part) if len(part) > 1 else part[0])
        level = above
    return level[0] if level else None


def width(sets: list[np.ndarray]) -> int:
    """Bits of the bitmaps: a power of two, about twice the largest set."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (2 * max(map(len, sets), default=1)).bit_length()))


def one_component(x: Node, found: Components) -> bool:
    if not x.one:
        root = found.find(x.item)
        x.one = all(found.find(c.item) == root and one_component(c, found) for c in x.children)
    return x.one


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def join_trees(a: Node | None, b: Node | None, sets: list[np.ndarray], percent: int, found: Components) -> None:
    """Joins in `found` whatever is linked across the trees (a may be b). Sets that are in one component already are not
    compared again; no other pair is left out but by the bounds."""
    stack = [(a, b)] if a is not None and b is not None else []
    while stack:
        x, y = stack.pop()
        if x is y:
            if x.children and not one_component(x, found):
                kids = x.children
                stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(len(kids) - 1, i, -1)]
                stack += [(k, k) for k in kids]
            continue
        if 100 * x.high < percent * y.low or 100 * y.high < percent * x.low:
            continue
        most = min(x.high, y.high, (x.bits & y.bits).bit_count() + min(x.beyond, y.beyond))
        if (100 + percent) * most < percent * (x.low + y.low):
            continue
        if found.find(x.item) == found.find(y.item) and one_component(x, found) and one_component(y, found):
            continue
        if not x.children and not y.children:
            if linked(sets[x.item], sets[y.item], percent):
                found.join(x.item, y.item)
        elif not y.children or x.children and x.high - x.low >= y.high - y.low:
            stack += [(c, y) for c in x.children]
        else:
            stack += [(x, c) for c in y.children]
