"""The queries against brute force on whole small tables; ids, columns, empty tables and long texts through every operator
and stage."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import uuid
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siltstone.llm import bpe_automaton, chat_format, fingerprints, jaccard_join, language_id, packing, quality_rules, rule_ensemble, secret_scan, text_stats, token_files
from siltstone.llm.queries import ORACLES, QUERIES
from siltstone.sources.shared import scratch_path

SF = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BIG = 2**60 + 1
#: Every name that an operator uses inside.
CLASHES = ["rep", "root", "node", "secret_text", "secret_spans", "secret_base", "a", "k", "h", "r", "kept_row", "counted_text", "n_words", "score", "row_key", "part", "head", "fingerprint", "lang_pred", "masked_text", "component_id", "at_share", "label"]


@pytest.fixture(scope="module")
def rows(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def hash_of(x):
    return int(hashlib.sha256(str(x).encode()).hexdigest(), 16)


def held(doc_id, n, remainder):
    return zlib.crc32(str(doc_id).encode()) % n == remainder


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def result(spark, name):
    return QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = c.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(tuple(r[x] for x in columns) for r in found.collect()) == sorted(cursor.fetchall())


def test_op1(spark, rows):
    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    kinds = [
        ("assign", rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    found = result(spark, "op1_secret_scan")
    assert len(found) == len(rows)
    for r in found:
        spans = sorted((m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, rows[r.doc_id].text or "") if ok(m))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(s for *_, s in spans).encode()).hexdigest()
        assert {s for *_, s in spans} <= set(r.spans.split(","))


#: Ordinary strings of kinds that no sample makes, none of which is a secret.
ORDINARY = [
    "-" * 24, "-" * 80, "_" * 30, "x" * 25, "=-" * 14, "/" * 30, "src/main/java/com/example/XmlHttpQueryParserFactory", "getUserAccountBalanceByCustomerId", "getHTTPResponseCodeFromExceptionHandler", "XMLHttpRequestEventTargetPrototype",
    "2024-01-02-backup-of-postgresql-13-main", "org/apache/spark/sql/execution/datasources/parquet/VectorizedParquetRecordReader", "node_modules/lodash/fp/_mapping", "usr/share/doc/libstdc++6/README", "DEFAULT_MAX_CONNECTIONS_PER_ROUTE", "test_utf8_bom_is_stripped_from_header",
    "CVE-2021-44228-log4shell-remote", "x86_64-unknown-linux-gnu", "aarch64-apple-darwin22-3-0", "kubernetes/ingress-nginx/controller", "AbstractSingletonProxyFactoryBean", "2023-11-30T23-59-59-000Z-access-log", "IMG_20230514_183022_edited", "us-east-1-prod-api-gateway-v2",
    "docs/en/latest/getting-started/install-linux", "HTTP_X_FORWARDED_FOR_HEADER", "libboost_program_options-mt-x64", "com/fasterxml/jackson/databind/ObjectMapper", "NSURLSessionConfigurationDelegate", "ISO_8859-1_1987-encoding", "step-by-step-guide-to-machine-learning-2020",
    "abcdefghijklmnopqrstuvwxyz0123456789", "sha256WithRSAEncryption_identifier", "Donaudampfschifffahrtsgesellschaftskapitaen", "part-00017-of-00128-snappy-parquet", "com/google/protobuf/UnsafeUtil", "ec2-54-211-23-9-compute-1-amazonaws", "0123456789-0123456789-0123456789",
    *(str(uuid.UUID(int=hash_of(i) >> 128)) for i in range(20)), *(f"users/{uuid.UUID(int=hash_of(i) >> 128)}/profile" for i in range(5)),
]
ALPHABETS = [string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_random_spans(spark, sf):
    """The models against a plain log-likelihood ratio over the same counts; random strings are found alone, behind and before
    ordinary words, and ordinary strings are not."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labelled = secret_scan.samples(docs)
    ratios, most = secret_scan.train(labelled)
    n, counts = len(secret_scan.ALPHABET), Counter()
    for r in labelled.collect() if sf == "sf0.001" else ():
        counts.update((r.source, a, b) for a, b in zip(r.text, r.text[1:]) if a in secret_scan.ALPHABET and b in secret_scan.ALPHABET)
    totals = Counter()
    for (s, a, _), k in counts.items():
        totals[s, a] += k

    def chance(s, a, b):
        return (counts[s, a, b] + 0.5) / (totals[s, a] + 0.5 * n)

    for a in "aZ9_" if counts else "":
        for b in "bQ3/":
            usual = sum(share * chance(s, a, b) for s, share in secret_scan.SHARES.items())
            assert ratios[secret_scan.ALPHABET.index(a) * n + secret_scan.ALPHABET.index(b)] == round(1000 * math.log(chance("random", a, b) / usual))
    rng = random.Random(8)
    made = [("".join(rng.choices(letters, k=k)), letters) for letters in ALPHABETS for k in (20, 24, 32, 40, 64) for _ in range(40)]
    texts = [f"see {form} here" for x, _ in made for form in (x, f"config/settings/production/{x}", f"{x}/readme/getting_started/with/several/ordinary/words")]
    frame = spark.createDataFrame(list(enumerate(texts + [f"see {x} here" for x in ORDINARY])), "doc_id long, text string").repartition(4)
    hits = {r.doc_id for r in secret_scan.scan(frame, ratios, most).where("size(secret_spans) > 0").select("kept_row.doc_id").collect()}
    assert [ORDINARY[i - len(texts)] for i in sorted(hits) if i >= len(texts)] == []
    assert len([i for i in hits if i < len(texts)]) >= 0.995 * len(texts)


def hot_tables(spark, n=8000):
    """Documents and labels of which one id holds half, with equal and with different texts."""
    rows = spark.range(n).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("some words of text "), (F.col("id") % 11).cast("string")).alias("text"))
    labels = spark.range(n).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    return rows, labels


def test_training_rows_are_bounded(spark, monkeypatch):
    """One id on half of the rows: what comes to the driver keeps its bound, and that id counts as one row."""
    docs, labels = hot_tables(spark)
    for module in (quality_rules, rule_ensemble):
        monkeypatch.setattr(module, "LABELLED_ROWS", 300)
    monkeypatch.setattr(quality_rules, "TRAIN_ROWS", 500)
    assert quality_rules.sample_counts(docs).count() <= 500
    for module in (quality_rules, rule_ensemble):
        found = module.labelled_counts(docs, labels).toPandas()
        assert 200 < len(found) <= 300 and found["doc_id"].is_unique
    quality_rules.fit(docs, labels)
    rule_ensemble.fit(docs, labels)


def test_every_language_is_learned(spark):
    """More languages than any cap; the nearest by a plain out-of-place distance."""
    rng = random.Random(3)
    own = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 7))) for _ in range(4)] for _ in range(1100)]
    docs = spark.createDataFrame([(i, f"l{i:04}", " ".join(own[i] * 3)) for i in range(1100)], "doc_id long, lang string, text string")
    profiles = language_id.train(language_id.training_rows(docs))
    assert len(profiles) == 1100
    model = language_id.Profiles(profiles)
    for i in range(0, 1100, 97):
        text = " ".join(own[i][:3])
        grams = language_id.ngrams(text)[0][: language_id.DOC_PROFILE].tolist()
        far = {x: sum(abs(p.index(g) - k) if g in p else language_id.PROFILE for k, g in enumerate(grams)) for x, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert model.predict(text) == (best, max(0.0, 1 - far[best] / (language_id.PROFILE * len(grams)))) and best == f"l{i:04}"
    assert model.predict("ÿÿÿ")[1] == 0.0 and language_id.Profiles({}).predict("abc") == ("und", 0.0)


def test_batches_are_never_unbounded(spark):
    from siltstone.llm.common import BATCH_ROWS, MOST_ROWS, small_batches

    before = spark.conf.get(BATCH_ROWS)
    for given, left in (("0", MOST_ROWS), ("-1", MOST_ROWS), ("50", 50), ("20000", MOST_ROWS)):
        spark.conf.set(BATCH_ROWS, given)
        small_batches(spark)
        assert int(spark.conf.get(BATCH_ROWS)) == left
    spark.conf.set(BATCH_ROWS, before)


def test_op2(spark, rows):
    encode = library(BYTES)
    for r in result(spark, "op2_bpe_codec"):
        text = rows[r.doc_id].text or ""
        ids = encode(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op3(spark, rows):
    encode = library(WORDS)
    found, used, taken = result(spark, "op3_packing"), Counter(), {}
    for r in found:
        ids = np.array([*encode(rows[r.doc_id].text), 2], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        taken.setdefault(r.doc_id, []).append((r.start, r.length))
        used[r.sequence_id] += r.length
    assert set(taken) == set(rows) and max(used.values()) <= 4096
    for spans in taken.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(spans), sorted(spans)[1:]))
    for s in used:
        at = sorted((r.offset, r.length) for r in found if r.sequence_id == s)
        assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:]))
    assert sum(used.values()) / (4096 * len(used)) > 0.9


def test_op5(spark, rows):
    def packed(g):
        out = 0
        for c in g:
            out = out << 21 | ord(c)
        return out

    def profile(text, most, counts=None):
        c = Counter() if counts is None else counts
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            p = f" {w} "
            c.update(g for n in (1, 2, 3) for i in range(len(p) - n + 1) if (g := p[i : i + n]).strip())
        return c if counts is not None else sorted(c, key=lambda g: (-c[g], packed(g)))[:most]

    by_lang = {}
    for i, r in rows.items():
        if r.lang is not None and r.text is not None and not held(i, 4, 2):
            profile(r.text, 0, by_lang.setdefault(r.lang, Counter()))
    ranks = {lang: {g: k for k, g in enumerate(sorted(c, key=lambda g: (-c[g], packed(g)))[:400])} for lang, c in by_lang.items()}
    found = result(spark, "op5_language_id")
    assert len(found) == len(rows)
    for r in found:
        own = profile(rows[r.doc_id].text or "", 300)
        assert r.held_out == held(r.doc_id, 4, 2)
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        far = {lang: sum(abs(rank[g] - k) if g in rank else 400 for k, g in enumerate(own)) for lang, rank in ranks.items()}
        best = min(sorted(far), key=far.__getitem__)
        assert r.lang_pred == best and abs(r.score - max(0.0, 1 - far[best] / (400 * len(own)))) < 1e-9
    out = [r for r in found if r.held_out and rows[r.doc_id].lang]
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in out) / len(out) >= 0.95


def test_op6(spark, rows):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    forest, most = quality_rules.fit(docs, labels)

    def anomaly(x):
        total = 0.0
        for feature, split, left, right, path in forest.trees:
            at = 0
            while feature[at] >= 0:
                at += left[at] if x[feature[at]] < split[at] else right[at]
            total += path[at]
        expected = 2 * (math.log(forest.size - 1) + 0.5772156649) - 2 * (forest.size - 1) / forest.size
        return 2 ** -(total / len(forest.trees) / expected)

    for r in result(spark, "op6_quality_rules"):
        text = rows[r.doc_id].text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        again = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(words) < 20 or 100 * len(again) > 30 * len(words))
        n, chars = max(1, len(words)), max(1, sum(map(len, words)))
        x = [sum(map(len, words)) / n, r.n_symbols / chars, len(set(words)) / n, sum(c.isupper() for c in text) / chars, sum(c in "!?" for c in text) / chars]
        assert abs(r.anomaly - anomaly(x)) < 1e-9 and r.kept == (not r.base_failed and r.anomaly <= most)


def test_op7(spark, rows):
    encode, at = library(BYTES), 0
    for r in sorted(result(spark, "op7_token_files"), key=lambda r: r.doc_id):
        ids = np.array([*encode(rows[r.doc_id].text), 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def plain_fingerprint(text):
    data, rolling = text.encode(), []
    for i in range(len(data)):
        h = 0
        for j in range(i - 6, i + 1):
            h = (h * 33 + (data[j] + 1 if j >= 0 else 0)) % 2**32
        h ^= h >> 15
        h = h * 0x85EBCA6B % 2**32
        rolling.append(h ^ h >> 13)

    def signature(size):
        out, part = [], 0
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
        chunks, start = [], 0
        for i, h in enumerate(rolling):
            if h % size == size - 1:
                chunks.append(data[start : i + 1])
                start = i + 1
        if start < len(data):
            chunks.append(data[start:])
        for c in chunks:
            part = sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 2**64) for k, b in enumerate(c)) % 2**64
            out.append(letters[((part ^ part >> 29) * 0xBF58476D1CE4E5B9 % 2**64) >> 58])
        return "".join(out)

    if not data:
        return "3::"
    size = 3
    while len(data) > 64 * 3 and 2 * size * 64 < len(data):
        size *= 2
    while sum(h % size == size - 1 for h in rolling) >= 64:
        size *= 2
    return f"{size}:{signature(size)}:{signature(2 * size)}"


def test_op8(spark, rows):
    order = sorted(rows, reverse=True)
    texts = {i: rows[i].text or "" for i in rows}
    found = {r.doc_id: r for r in result(spark, "op8_fingerprints")}
    assert set(found) == set(rows)
    prints = {i: plain_fingerprint(texts[i]) if len(texts[i]) < 3000 else fingerprints.fingerprint(texts[i]) for i in rows}
    for k, i in enumerate(order):
        x, after = texts[i], order[(k + 1) % len(order)]
        n = len(x) // 3
        changed = x[: len(x) - n] + texts[after][:n]
        r = found[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(x), hashlib.sha256(changed.encode()).hexdigest(), prints[i])
        if len(changed) < 1500:
            assert r.edited_fingerprint == plain_fingerprint(changed)
        assert abs(r.near_next - fingerprints.likeness(prints[i], prints[after])) < 1e-12 and abs(r.near_edited - fingerprints.likeness(prints[i], r.edited_fingerprint)) < 1e-12


def test_op9(spark, rows):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rules, intercept = rule_ensemble.fit(docs, labels)
    for r in result(spark, "op9_rule_ensemble"):
        c = dict(zip(text_stats.COUNTS, text_stats.counts(rows[r.doc_id].text or ""), strict=True))
        n, chars, lines = (max(1, c[x]) for x in ("n_words", "word_chars", "n_lines"))
        x = [math.log1p(c["n_words"]), c["word_chars"] / n, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / n, c["n_distinct"] / n, c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / chars, c["n_words"] / lines]
        total = intercept + sum(w for rule, w in rules if all((x[f] < v) == below for f, below, v in rule))
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-6
        assert r.held_out == held(r.doc_id, 5, 0) and r.predicted == int(r.score >= 0.3)


def models(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return {
        "secrets": secret_scan.train(secret_scan.samples(docs)), "languages": language_id.train(language_id.training_rows(docs)), "forest": quality_rules.fit(docs, labels), "rules": rule_ensemble.fit(docs, labels),
    }


@pytest.fixture(scope="module")
def operators(spark):
    m = models(spark)

    def files(d):
        folder = scratch_path(spark, "files")
        return token_files.read_token_files(token_files.write_token_files(d, BYTES, folder), folder)

    return {
        "op1": lambda d: secret_scan.scan(d, *m["secrets"]).select("kept_row.doc_id"), "op2": lambda d: bpe_automaton.bpe_round_trip(d, BYTES), "op3": lambda d: packing.pack(d, WORDS), "op5": lambda d: language_id.identify(d, m["languages"]),
        "op6": lambda d: quality_rules.apply_rules(d, *m["forest"]), "op7": files, "op8": fingerprints.neighbours, "op9": lambda d: rule_ensemble.score(d, *m["rules"]), "op10": jaccard_join.similarity_components,
    }


def odd_documents(spark):
    texts = [None, "", "the thing and the other thing was here and there", "the thing and the other thing was here and there", "password = abcdefgh9 é🙂"]
    ids = [None, BIG, BIG - 2, 7, 7]
    x = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    return x.withColumns({c: F.lit(BIG) if k % 2 else F.create_map(F.lit("m"), F.col("doc_id")) for k, c in enumerate(CLASHES)})


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_ids_and_columns(spark, operators, name):
    """A null id among great ones, repeated ids and rows, and columns of every inner name; then an empty table."""
    docs = odd_documents(spark).coalesce(1)
    found = Counter(r.doc_id for r in operators[name](docs).collect())
    assert found == Counter([None, BIG, BIG - 2, 7, 7])
    assert operators[name](docs.limit(0)).count() == 0


def test_chat_ids(spark):
    rows = [(None, 0, "user", "a"), (BIG, 0, "user", "b"), (BIG, None, "user", "c"), (BIG, 0, "user", "b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r.n_turns for r in chat_format.digests(chat_format.render(chat_format.fold_log(chat_format.log_of(frame)))).collect()}
    assert found == {None: 1, BIG: 3}


@pytest.mark.parametrize("name", ["quality", "language", "near_duplicates", "secrets"])
def test_stages_keep_rows_whole(spark, name):
    """Stages keep every column's values, whatever the columns' names, and take an empty table."""
    stage = dict(corpus_pipeline.STAGES)[name]
    real = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(None).cast("map<string,bigint>") for c in CLASHES[::2]} | {c: F.lit(None).cast("long") for c in CLASHES[1::2]})
    docs = real.select(odd_documents(spark).columns).unionByName(odd_documents(spark))
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    odd = {r.doc_id for r in out.where(f"{CLASHES[1]} = {BIG}").collect()}
    assert odd <= {None, BIG, BIG - 2, 7}
    assert all(r[CLASHES[0]] == {"m": r.doc_id} for r in out.where(f"{CLASHES[1]} = {BIG}").select("doc_id", CLASHES[0]).collect())
    if name == "near_duplicates":
        assert odd == {None, BIG, 7}
    if name == "secrets":
        assert odd == {None, BIG, BIG - 2, 7} and out.where("text like '%[SECRET] é🙂'").count() == 1
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_packing_stage_takes_any_columns(spark):
    """Clashing columns, null and repeated ids, and an empty table in the last stage."""
    docs = odd_documents(spark)
    found = dict(corpus_pipeline.STAGES)["packing"](spark, docs, SF)
    assert {r.doc_id for r in found.select("doc_id").collect()} == {None, BIG, BIG - 2, 7}
    assert dict(corpus_pipeline.STAGES)["packing"](spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", ["quality", "language", "near_duplicates", "secrets", "packing"])
def test_long_texts_in_stages(spark, name):
    """Texts of 2 MB in every stage; what stays is whole but for masks."""
    sentence = "the thing and the other thing was here and there again "
    texts = [sentence * 36_000, "abcdefg" * 290_000, " ".join(f"token=abcdef{i} and" for i in range(6000))]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    if name == "packing":
        assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {0, 1, 2}
    else:
        assert all(name == "secrets" or r.text == texts[r.doc_id] for r in out.collect()) and out.count() <= 3


def test_long_turns(spark):
    rows = [(1, 0, "user", "word " * 400_000), (1, 1, "assistant", "[INST]" * 100_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (found,) = chat_format.digests(chat_format.render(chat_format.fold_log(chat_format.log_of(frame)))).collect()
    assert found.n_turns == 2 and found.loss_chars == 600_000


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_long_texts(spark, operators, name):
    """A text of 2 MB, one word of 2 MB, and a text with thousands of matches."""
    sentence = "the thing and the other thing was here and there again "
    texts = [sentence * 36_000, "abcdefg" * 290_000, " ".join(f"token=abcdef{i} and" for i in range(6000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in operators[name](docs).select("doc_id").collect()} == {0, 1, 2}
