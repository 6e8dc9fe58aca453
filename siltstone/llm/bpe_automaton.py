"""Byte-level BPE as a deterministic automaton built from the merges, encoding by its table and decoding by its labels.

The automaton over tokens starts with one state and an arc for every byte. Each merge (a, b), in order, applies a gadget:
the state behind an arc a loses its arc b (the two are one token now), every state that still has an arc a gets an arc ab,
and ab leads to a copy of the state behind b. All arcs of one label lead to one state, so a state is numbered as the token
that reaches it, and the table has for each state the arcs that it or the states it copies have lost, with the step. An
arc ab stands where an arc a stood when it was made, so it is lost with any loss of a before that step, and so on for a.

Each prefix of a word has exactly one accepted path, so exactly one token ends it. One pass from left to right finds that
token at every byte: a second table, over bytes, gives the longest token that ends there and those within it, and the first
whose arc the state before it still has is the one. The labels are then read back from the end.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import bounded, doc_texts, documents
from siltstone.llm.library_tokens import CUT

#: The pre-split of byte-level vocabularies (a fixed value of the file format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that a worker keeps in each of two memos of pieces, none longer than SHORT, and of arcs and of leaps.
MEMO, SHORT, ARCS = 250_000, 64, 500_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """States are numbered as the tokens whose arcs reach them; label[t] is the text that an arc t spells."""

    def __init__(self, labels: dict[bytes, int], merges: list[tuple[int, int, int]]):
        n = max(labels.values(), default=-1) + 1
        self.label = [b""] * n
        self.first, self.step = [-1] * n, [-1] * n
        rows: list[list[int] | None] = [None] * n
        for text, t in labels.items():
            self.label[t] = text
            if len(text) == 1:
                rows[t] = []
        for step, (a, b, ab) in enumerate(merges):
            # the gadget: ab leads to a copy of the state behind b, and the state behind a loses its arc b
            rows[ab] = rows[b].copy()
            rows[a].append(b << 32 | step)
            self.first[ab], self.step[ab] = a, step
        self.steps = len(merges)
        sizes = [len(r or ()) for r in rows]
        self.ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        lost = np.fromiter((x for r in rows for x in r or ()), np.int64, sum(sizes))
        for i, j in zip(self.ends, self.ends[1:], strict=False):
            lost[i:j].sort()
        self.lost = lost
        self.size = [*map(len, self.label)]
        self.arcs: list[dict[int, bool]] = [{} for _ in range(n)]
        self.held = self.leaps = 0
        tokens = [t for t in range(n) if rows[t] is not None]
        self.whole = {self.label[t]: [t] for t in tokens}
        self.spell(tokens)

    def spell(self, tokens: list[int]) -> None:
        """The byte table: where each byte leads from each beginning of a label (move), to where its longest ending that
        begins a label stands (back), the longest token that ends there (longest), and for each token the longest one that
        is an ending of it (shorter)."""
        self.move: list[dict[int, int]] = [{}]
        made, depth = [(0, 0)], [0]
        own: dict[int, int] = {}
        for t in tokens:
            node = 0
            for byte in self.label[t]:
                to = self.move[node].get(byte)
                if to is None:
                    to = self.move[node][byte] = len(made)
                    self.move.append({})
                    made.append((node, byte))
                    depth.append(depth[node] + 1)
                node = to
            own[node] = t
        self.back, self.longest = [0] * len(made), [-1] * len(made)
        self.shorter = [-1] * len(self.label)
        for node in sorted(range(1, len(made)), key=depth.__getitem__):
            above, byte = made[node]
            if above:
                at = self.back[above]
                while at and byte not in self.move[at]:
                    at = self.back[at]
                self.back[node] = self.move[at].get(byte, 0)
            within = self.longest[self.back[node]]
            self.longest[node] = own.get(node, within)
            if node in own:
                self.shorter[own[node]] = within

    def leap(self, node: int, byte: int) -> int:
        """Where a byte leads that goes on with no label from a node: by the longest ending that it does go on from. The
        table keeps what is found, as far as there is room."""
        at = node
        while at and byte not in self.move[at]:
            at = self.back[at]
        to = self.move[at].get(byte, 0)
        if self.leaps < ARCS:
            self.leaps += 1
            self.move[node][byte] = to
        return to

    def has_arc(self, state: int, t: int) -> bool:
        """Whether the state still has its arc t: neither t nor an arc that t was made from was lost while it stood."""
        row = self.lost[self.ends[state] : self.ends[state + 1]]
        found, until, p = True, self.steps, t
        while p >= 0 and len(row):
            i, j = np.searchsorted(row, (p << 32 | self.step[p] + 1, p << 32 | until + 1))
            if i < j:
                found = False
                break
            until = self.step[p]
            p = self.first[p]
        if self.held >= ARCS:
            for x in self.arcs:
                x.clear()
            self.held = 0
        self.held += 1
        self.arcs[state][t] = found
        return found

    def encode(self, word: bytes) -> list[int]:
        """The labels' numbers along the accepted path that spells the word; the work grows with its length. A word that is
        a label has the path of that one arc, as the first state has lost none."""
        known = self.whole.get(word)
        if known is not None:
            return known
        move, longest, shorter, size, arcs = self.move, self.longest, self.shorter, self.size, self.arcs
        last = [-1]
        node = end = 0
        for byte in word:
            end += 1
            try:
                node = move[node][byte]
            except KeyError:
                node = self.leap(node, byte)
            t = longest[node]
            before = last[end - size[t]] if t >= 0 else -1
            while before >= 0:
                try:
                    kept = arcs[before][t]
                except KeyError:
                    kept = self.has_arc(before, t)
                if kept:
                    break
                t = shorter[t]
                before = last[end - size[t]] if t >= 0 else -1
            if t < 0:
                raise ValueError("a byte has no arc")
            last.append(t)
        path = []
        while end:
            t = last[end]
            path.append(t)
            end -= size[t]
        return path[::-1]


class BpeCodec:
    """A byte-level vocabulary file: special strings, pre-split, automaton."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if file["model"]["type"] != "BPE" or file.get("normalizer") or (file.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path}: not a byte-level BPE vocabulary without normalizer")
        letter = byte_letters()
        spelling = {x: bytes(map(letter.__getitem__, x)) for x in file["model"]["vocab"] if all(c in letter for c in x)}
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        vocab = {x: t for x, t in file["model"]["vocab"].items() if x in spelling and x not in self.special}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        self.automaton = Automaton({spelling[x]: t for x, t in vocab.items()}, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.label = [*self.automaton.label, *[b""] * (max([*self.special.values(), 0]) + 1 - len(self.automaton.label))]
        for text, t in self.special.items():
            self.label[t] = text.encode()
        self.words = regex.compile(WORDS)
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        encode = self.automaton.encode
        for word in self.words.findall(text):
            out += encode(word.encode())
        return out

    def _piece(self, text: str) -> list[int]:
        if self.apart is None or not self.apart.search(text):
            return self._plain(text)
        out = []
        for part in self.apart.split(text):
            out += [self.special[part]] if part in self.special else self._plain(part)
        return out

    def encode(self, text: str) -> list[int]:
        """Pieces between safe spaces are encoded once and remembered, the older half until it is not met for a while; the ids
        are those of the whole text."""
        head, *pieces = CUT.split(text)
        if len(self.pieces) >= MEMO:
            self.older, self.pieces = self.pieces, {}
        known, older, ids = self.pieces, self.older, self._piece(head)
        for x in pieces:
            got = known.get(x)
            if got is None:
                got = older.get(x)
                if got is None:
                    got = self._piece(f" {x}")
                if len(x) <= SHORT:
                    known[x] = got
            ids += got
        return ids

    def decode(self, ids: list[int]) -> str:
        """The arcs' labels in order; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=1)
def codec(path: str) -> BpeCodec:
    """Compiled once in each worker: about as large as its vocabulary."""
    return BpeCodec(path)


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int> of every whole text. A null or empty text has no ids; repeated rows stay, each with its own."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            for ids, texts in bounded(batch):
                yield pa.RecordBatch.from_arrays([ids, pa.array([c.encode(x) for x in texts], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row of (doc_id, ids); null ids give an empty text, unknown ids an error."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            for at in range(batch.num_rows):
                ids = batch.column("ids")[at].as_py() or []
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 1), pa.array([c.decode(ids)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """bpe_encode and bpe_decode in one pass that keeps digests in place of ids and texts: doc_id, n_tokens,
    ids_sha256 (decimal ids joined by commas), decoded_sha256 (decoded text). Null text: empty; repeated rows stay."""

    def run(batches):
        c = codec(path)
        decimal = [str(i) for i in range(len(c.label))]
        for batch in batches:
            for doc_ids, texts in bounded(batch):
                sizes, encoded, decoded = [], [], []
                for x in texts:
                    ids = c.encode(x)
                    sizes.append(len(ids))
                    encoded.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(sizes, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; null, empty, repeated and very long texts as in bpe_round_trip."""
    import public_tokenizers

    return bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
