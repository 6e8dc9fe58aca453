"""Token ids of whole texts by the tokenizers library, with a memo of the pieces between spaces."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space before one of these characters starts a pre-token under both public vocabularies, so a text may be cut there:
#: byte-level patterns give the space to what follows, the word vocabulary drops it. None of them is white space.
SAFE = "[\x21-\x7e\xa1-ᙿ]"
CUT = re.compile(f"[ ](?={SAFE})")
#: A space before another character, or a line end that isn't between two characters that are no white space.
ODD = re.compile(rf" (?!{SAFE})|\n(?!{SAFE})|\s\n|\A[ \n]|[\x1c\x1d]")
#: A mark at the end of a word is a pre-token of its own; another byte stands in its piece, as it lacks the space.
GLUED = {"\x1c": ",", "\x1d": "."}
#: What the bytes of texts in UTF-8 are: white space, letters and marks; RARE ones may be of a character that ODD minds.
BLANK, LETTER, MARK, RARE = 1, 2, 4, 8
KIND = np.zeros(256, np.uint8)
KIND[[*range(32), 127, *range(0xE1, 256)]] = RARE
KIND[[10, 32]] = BLANK
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[[ord(","), ord(".")]] = MARK
#: Words that every public vocabulary keeps whole before its merges, and the letter that stands for a space in byte-level ones.
LETTERS, SPACE = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+"), "\u0120"
#: Bytes of pieces and ids, about, in the younger of a worker's two memos; beyond them it becomes the older one, whose
#: pieces come back when met. What an entry takes besides, and the longest piece that is kept.
MEMO, ENTRY, SHORT = 96 << 20, 150, 200


def lowered(text: str) -> str:
    """Beyond Latin-1, lower case may depend on what stands around; within it, a vocabulary of lower case may as well get it so."""
    try:
        return text.lower() if text.isascii() or text.encode("latin-1") else text
    except UnicodeEncodeError:
        return text


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts that aren't empty, between line ends; their kinds; where each text begins, and the end."""
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    data = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
    return data, KIND[data], np.cumsum([1, *(len(x) + 1 for x in raw)])


def odd_texts(texts: list[str], data: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> set[int]:
    """The texts of joined() in which ODD is found: by pairs of white space, and by ODD itself in those with a rare byte."""
    blank = kind == BLANK
    pairs = np.flatnonzero(blank[1:] & blank[:-1])
    at = np.searchsorted(starts, pairs, "right") - 1
    odd = {*np.where(pairs == starts[at + 1] - 1, at + 1, at).tolist()}
    high = np.flatnonzero(data == 0xC2)
    rare = np.concatenate([np.flatnonzero(kind == RARE), high[data[high + 1] <= 0xA0]])
    return odd.union(i for i in np.unique(np.searchsorted(starts, rare, "right") - 1).tolist() if i not in odd and ODD.search(texts[i]))


class LibraryEncoder:
    """Ids as the library gives them for the whole text: encode() cuts at safe spaces and encodes each new piece once."""

    def __init__(self, path: str, memo: int = MEMO):
        self.memo = memo
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size(with_added_tokens=True) <= 65_536 else np.dtype("<u4")
        added = {x.content: t for t, x in self.library.get_added_tokens_decoder().items() if not (x.lstrip or x.rstrip or x.single_word or x.normalized)}
        self.divider = next(iter(added.items()), None)
        self.opens = os.path.commonprefix(list(added)) if added else ""
        if not self.opens:
            self.divider = None
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        marked = [t for x, t in vocabulary.items() if (x.endswith(suffix) if suffix else x.startswith(SPACE))]
        self.begins, self.edge = not suffix, None
        if marked:
            self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
            self.edge[marked] = True
        self.lowers = self.library.encode("Aé É", add_special_tokens=False).ids == self.library.encode("aé é", add_special_tokens=False).ids
        self.held = 0
        self.spaced: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _divided(self, pieces: list[str]) -> list[bytes]:
        """The library's ids of each piece. Pieces go to it in one text, divided by a special token, which splits a text
        before anything else is done to it; a piece that holds a special token's characters goes alone."""
        if self.divider is None:
            return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        between, number = self.divider
        plain = [x for x in pieces if self.opens not in x]
        ids = np.array(self.library.encode_batch_fast([between.join([*plain, ""])], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(ids == number)
        raw, size = ids.tobytes(), self.dtype.itemsize
        stops = (ends * size).tolist()
        starts = [0, *((ends + 1) * size).tolist()]
        known = dict(zip(plain, (raw[i:j] for i, j in zip(starts, stops, strict=False)), strict=True))
        for x in pieces:
            if x not in known:
                known[x] = np.array(self.library.encode(x, add_special_tokens=False).ids, self.dtype).tobytes()
        return [known[x] for x in pieces]

    def _words(self, words: list[str]) -> list[bytes] | None:
        """Ids of pieces of a space and Latin letters, all in one text: such a piece is one word to the library, and the
        tokens that begin a word, or end it, tell the words apart."""
        ids = np.array(self.library.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(words):
            return None
        places = [*at.tolist(), len(ids)] if self.begins else [0, *(at + 1).tolist()]
        raw, size = ids.tobytes(), self.dtype.itemsize
        return [raw[i * size : j * size] for i, j in zip(places, places[1:], strict=False)]

    def _new(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces as they stand in a text: after a space, or from a line's end on."""
        words = [x for x in pieces if LETTERS.fullmatch(x)] if self.edge is not None else []
        found = self._words([f" {x}" for x in words]) if words else []
        known = dict(zip(words, found, strict=True)) if found else {}
        rest = [x for x in pieces if x not in known]
        return known | dict(zip(rest, self._divided([x if x[0] == "\n" else GLUED.get(x) or f" {x}" for x in rest]), strict=True)) if rest else known

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, from the memo or new."""
        if self.held > self.memo:
            self.older, self.spaced, self.held = self.spaced, {}, 0
        found = [*map(self.spaced.get, pieces)]
        gaps = [i for i, ids in enumerate(found) if ids is None]
        fresh = {x: ids for x in map(pieces.__getitem__, gaps) if (ids := self.older.get(x)) is not None}
        new = [x for x in map(pieces.__getitem__, gaps) if x not in fresh]
        for at in range(0, len(new), 20_000):
            fresh |= self._new(new[at : at + 20_000])
        kept = {x: ids for x, ids in fresh.items() if len(x) <= SHORT}
        self.held += sum(map(len, kept)) + sum(map(len, kept.values())) + ENTRY * len(kept)
        self.spaced |= kept
        for i in gaps:
            found[i] = fresh[pieces[i]]
        return found

    def _whole(self, data: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Texts of joined(), whose every space stands before a safe character and every line end between two others: all
        are cut at spaces, line ends and marks at words' ends at once, each distinct piece is looked up once, and ids are
        gathered by piece numbers."""
        marks = np.flatnonzero(kind == MARK)
        marks = marks[kind[marks + 1] == BLANK]
        before = data[marks - 1]
        marks = marks[(kind[marks - 1] == LETTER) | (data[marks - 2] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)]
        left_out = data == 32
        begins = np.zeros(len(data), bool)
        begins[1:] = left_out[:-1]
        begins[data == 10] = begins[marks] = begins[starts[:-1]] = True
        left_out[starts - 1] = True
        begins[starts - 1] = False
        data = data.copy()
        data[marks] = np.where(data[marks] == ord(","), 0x1C, 0x1D)
        kept = ~left_out
        content = data[kept]
        cut = np.append(np.flatnonzero(begins[kept]), len(content)).astype(np.int32)
        codes = pc.dictionary_encode(pa.StringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut), pa.py_buffer(content)))
        offsets = np.searchsorted(np.flatnonzero(begins), starts)
        pieces, number = codes.dictionary.to_numpy(zero_copy_only=False).tolist(), codes.indices.to_numpy().astype(np.int64)
        heads = [pieces[i] for i in number[offsets[:-1]].tolist()]
        used = np.ones(len(number), bool)
        used[offsets[:-1]] = False
        inner = np.zeros(len(pieces), bool)
        inner[number[used]] = True
        at = np.flatnonzero(inner)
        place = np.zeros(len(pieces), np.int64)
        place[at] = np.arange(len(at))
        number = place[number]
        number[offsets[:-1]] = len(at) + np.arange(len(heads))
        raw = [*self._known([pieces[i] for i in at.tolist()]), *self._divided(heads)]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // self.dtype.itemsize
        pool, starts = np.frombuffer(b"".join(raw), self.dtype), np.cumsum(sizes) - sizes
        each = sizes[number]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = pool[np.repeat(starts[number] - ends[:-1], each) + np.arange(ends[-1])]
        stops = ends[offsets].tolist()
        return [ids[i:j].tobytes() for i, j in zip(stops, stops[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, in self.dtype."""
        if self.lowers:
            texts = [*map(lowered, texts)]
        plain, out = [i for i, x in enumerate(texts) if x], {}
        if plain:
            parts = joined([texts[i] for i in plain])
            if odd := odd_texts([texts[i] for i in plain], *parts):
                plain = [x for i, x in enumerate(plain) if i not in odd]
                parts = joined([texts[i] for i in plain])
            if plain:
                out = dict(zip(plain, self._whole(*parts), strict=True))
        odd = [i for i in range(len(texts)) if i not in out]
        if odd:
            cut = [CUT.split(texts[i]) for i in odd]
            distinct = list({x for pieces in cut for x in pieces[1:]})
            known = dict(zip(distinct, self._known(distinct), strict=True))
            heads = self._divided([pieces[0] for pieces in cut])
            out |= {i: head + b"".join(map(known.__getitem__, pieces[1:])) for i, head, pieces in zip(odd, heads, cut, strict=True)}
        return [out[i] for i in range(len(texts))]


@lru_cache(maxsize=2)
def encoder(path: str, memo: int = MEMO) -> LibraryEncoder:
    """One per worker, vocabulary and size of the memo."""
    return LibraryEncoder(path, memo)
