"""Codec, packing and token files against the library and plain re-computation."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siltstone.llm import bpe_automaton, library_tokens, packing, token_files
from siltstone.sources.shared import scratch_path
from siltstone.llm.library_tokens import encoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, extra string, ids string, row_key string"
TEXTS = [None, "", " ", "a", "the thing", "x" * 3000, "né à l'été <|endoftext|> \n\n  two", "word " * 9000, "漢字🙂 mix", "the thing", "tab\tand\x00nul"]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda x: t.encode(x or "", add_special_tokens=False).ids, t


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, x, "e", "i", "r") for i, x in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4]], SCHEMA)


def odd_texts():
    rng = random.Random(3)
    letters = "ab the  \n\t'sé ü漢🙂<|endoftext|>\x00 K0123 .,!?-_"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1500)]


def test_automaton_equals_library():
    encode, t = library(BYTES)
    c = bpe_automaton.codec(BYTES)
    for x in odd_texts():
        ids = c.encode(x)
        assert ids == encode(x)
        assert c.decode(ids) == t.decode(ids, skip_special_tokens=False) == x


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_memo_encoder_equals_library(path):
    encode, _ = library(path)
    e = encoder(path)
    texts = odd_texts()
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == [encode(x) for x in texts]


def test_codec_rows(docs):
    encode, _ = library(BYTES)
    found = bpe_automaton.bpe_round_trip(docs, BYTES).collect()
    assert len(found) == len(TEXTS) + 1
    for r in found:
        ids = encode(TEXTS[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    back = bpe_automaton.bpe_decode(bpe_automaton.bpe_encode(docs, BYTES), BYTES).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted([(i, x or "") for i, x in enumerate(TEXTS)] + [(4, TEXTS[4])])


def test_packing(docs):
    encode, _ = library(WORDS)
    packed = packing.pack(docs, WORDS, window=256, with_ids=True)
    rows = packed.toPandas()
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own["length"].sum() <= 256
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]
    for doc_id, own in rows.groupby("doc_id"):
        ids = np.array([*encode(TEXTS[doc_id]), 2], "<u4")
        times = 2 if doc_id == 4 else 1
        assert own["length"].sum() == times * len(ids)
        for r in own.itertuples():
            part = ids[r.start : r.start + r.length].tobytes()
            assert bytes(r.ids) == part and r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids)
    whole = packing.sequences(packed).collect()
    assert sum(r.length for r in whole) == rows["length"].sum() and all(len(r.ids) == 4 * r.length for r in whole)


def test_differencing_is_near_equal():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1000, 600)
    k = 40
    window, most = packing.differencing(sizes, k)
    sums = np.bincount(window, sizes, minlength=k)
    assert sums.sum() == sizes.sum() and most == sums.max() and sums.max() - sums.min() <= 20
    full = packing.near_equal_windows(np.array([60] * 10), 100)
    assert np.bincount(full, [60] * 10).max() <= 100 and len(set(full.tolist())) == 10
    assert not len(packing.near_equal_windows(np.zeros(0, int), 10))


def test_token_files(spark, docs):
    encode, _ = library(BYTES)
    folder = scratch_path(spark, "files")
    shards = token_files.write_token_files(docs, BYTES, folder)
    rows = sorted(token_files.read_token_files(shards, folder, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([*range(len(TEXTS)), 4])
    at = 0
    for r in rows:
        ids = np.array([*encode(TEXTS[r.doc_id]), 2], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids) // 4, zlib.crc32(ids), ids)
        at += r.n_tokens


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bpe_automaton.bpe_round_trip(empty, BYTES).count() == 0
    assert packing.pack(empty, WORDS).count() == 0
    folder = scratch_path(spark, "files")
    assert token_files.read_token_files(token_files.write_token_files(empty, BYTES, folder), folder).count() == 0


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "c")], "doc_id long, text string")
    assert {r.doc_id for r in packing.pack(docs, WORDS).collect()} == {None, 3}
    folder = scratch_path(spark, "files")
    assert [r.doc_id for r in token_files.read_token_files(token_files.write_token_files(docs, BYTES, folder), folder).orderBy("start").collect()] == [None, 3]
    assert {r.doc_id for r in bpe_automaton.bpe_round_trip(docs, BYTES).collect()} == {None, 3}


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_line_ends_and_letters(path):
    encode, _ = library(path)
    e = encoder(path)
    parts = ["the", "Thing", "één", "ßa", "İx", "ǅ", "a.", ".b", "1", "'s", "don't", "\n", " ", "\t", "\x85", "<|endoftext|>", "ﬁn", "é", "한글"]
    rng = random.Random(9)
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n", "\n\n", " \n", "\n "]) for _ in range(rng.randint(1, 12))) for _ in range(2500)]
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == [encode(x) for x in texts]


def test_plain_texts_meet_no_pattern(monkeypatch):
    """Ids of texts in Latin letters are the library's, and no pattern goes over their characters one by one."""

    class Never:
        def search(self, text):
            raise AssertionError(text)

    texts = ["Das Öl, naïve.\nÉté à la «mer», so it is.", "one", "a.b, c.d.", "\xd7. \xf7, \xe9. \xe9,", "", "x" * 300 + ", end."]
    for path in (BYTES, WORDS):
        encode, _ = library(path)
        expected = [*map(encode, texts)]
        monkeypatch.setattr(library_tokens, "ODD", Never())
        assert [np.frombuffer(x, encoder(path).dtype).tolist() for x in encoder(path).encode(texts)] == expected
        monkeypatch.undo()


def test_odd_texts_among_plain_ones():
    """Every kind of odd text, between plain ones and side by side, in one call."""
    odd = [
        " a", "a ", "\na", "a\n", "a  b", "a \nb", "a\n b", "a\n\nb", " ", "\n", "a\tb, c", "a\t\nb", "a \tb", "a\x1cb", "\x1c, a", "\x1d", "a \x1f. b", "a\x1f, b", "a\x7f b", "a \x7f", "a\xa0\nb", "a \xa0b", "a\x85 b",
        " \nb", "a \nb", "Σ ΑΣ. b", "ἀ. ἀ, x", "“a.” b", "a “b”", "a – b,\nc", "日本 語. x", "a \nb", "🙂 a. 🙂", "a</s> b, </s>", "İ. I, ſ", ".", ",", ". ,", "a ., b", "é,\né.", "A.\n.B",
    ]
    texts = [y for i, x in enumerate(odd) for y in ([x] if i % 3 else ["plain, one.", x, "Ä plain\ntwo."])]
    for path in (BYTES, WORDS):
        encode, _ = library(path)
        assert [np.frombuffer(x, encoder(path).dtype).tolist() for x in encoder(path).encode(texts)] == [*map(encode, texts)]


def test_token_files_of_plain_and_odd_texts(spark):
    """Ids in the files are the library's, whichever texts stand together in a batch; \x1c and \x1d are bytes that pieces use inside."""
    encode, _ = library(BYTES)
    texts = ["plain, one.", "a\x1c, b", " \x1d", "Ä plain\ntwo.", "a.  b,", "", "née.\nété, x."]
    folder = scratch_path(spark, "plain-odd")
    shards = token_files.write_token_files(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1), BYTES, folder)
    found = token_files.read_token_files(shards, folder, with_ids=True).orderBy("doc_id").collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in found] == [[*encode(x), 2] for x in texts]
