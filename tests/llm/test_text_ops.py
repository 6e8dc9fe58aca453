"""Secrets, chats, languages, quality and fingerprints on small fixtures against plain re-computation."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from siltstone.llm import chat_format, fingerprints, language_id, quality_rules, rule_ensemble, secret_scan, text_stats

SF = "/root/testdata/sf0.001"
HEX, KEY = "0123456789abcdef" * 2, "AKIA" + "Q7" * 9
TEXTS = [
    None, "", "nothing here", f'é🙂 password = "{HEX}" and {KEY}x', "secret=token : abcdefgh token:abcdefg", "pwd api_key:short api-key=abcdef APIKEY='zzzzzz'", HEX[:23] + " " + HEX[:24], KEY[:19] + " " + KEY[:20],
    "a sKz8Qw3LmX9vTb2RyN5cJd7 b", "get_user_account_by_identifier", f"{HEX}{HEX}", f"token={KEY}",
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def secret_model(real):
    return secret_scan.train(secret_scan.samples(real[0]))


def base_spans(text):
    def either(w):
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)

    names = "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|" + either("api") + "_?" + either("key")
    kinds = [
        ("assign", rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    return sorted((m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m))


def test_secret_spans(spark, secret_model):
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(TEXTS)] + [(3, TEXTS[3], "clash")], "doc_id long, text string, secret_a string")
    rows = secret_scan.scan(docs, *secret_model).select("kept_row.doc_id", secret_scan.joined("secret_base").alias("b"), secret_scan.joined("secret_spans").alias("s")).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        expected = [f"{n}:{a}:{z}" for a, _, z, n in base_spans(TEXTS[r.doc_id] or "")]
        assert r.b == ",".join(expected)
        assert set(expected) <= set(r.s.split(",")) or not expected
    added = {r.doc_id: [x for x in r.s.split(",") if x.startswith("random")] for r in rows}
    assert added[8] == ["random:2:25"] and not added[9] and not added[2]


def test_secrets_are_masked(spark, secret_model):
    docs = spark.createDataFrame([(i, x, len(x or "")) for i, x in enumerate(TEXTS)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in secret_scan.masked(docs, *secret_model).collect()}
    assert out[0].text is None and out[2].text == TEXTS[2]
    assert out[3].text == f"é🙂 [SECRET]\" and {secret_scan.MASK}x" and out[3].n_chars == len(out[3].text)


def test_secrets_of_empty_table(spark, secret_model):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secret_scan.scan(empty, *secret_scan.train(secret_scan.samples(empty))).count() == 0


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\</s>\\\\[INST]", None, "<s>[/INST]</s>", "plain é\n\n", "\\"]
    rows = [(c, t, "assistant" if t % 2 else "user", texts[(c + t) % len(texts)], "x") for c in range(4) for t in range(5)] + [(None, 0, None, "z", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kind string")
    found = {r.conv_id: r for r in chat_format.digests(chat_format.render(chat_format.fold_log(chat_format.log_of(frame)))).collect()}
    assert set(found) == {0, 1, 2, 3, None}
    for c in range(4):
        own = [(r[2], r[3] or "") for r in rows if r[0] == c]
        learned = "".join(x for role, x in own if role == "assistant")
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (found[c].n_turns, found[c].loss_chars, found[c].loss_sha256) == (len(own), len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_chat_log_is_folded(spark):
    log = [
        (1, 0, 1, "message", "user", "hi"), (1, 1, 2, "message", "assistant", ""), (1, 1, 3, "delta", "assistant", "one "), (1, 1, 4, "delta", "assistant", "two"), (1, 2, 5, "message", "user", "old"),
        (1, 1, 6, "regenerate", "assistant", ""), (1, 1, 7, "delta", "assistant", "new"), (1, 2, 8, "message", "user", "next"), (1, 0, 9, "edit", "user", "hello"), (2, 0, 1, "delta", "user", "lone"),
    ]
    frame = spark.createDataFrame(log[::-1], "conv_id long, turn long, seq long, kind string, role string, text string")
    found = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat_format.fold_log(frame).collect())
    assert found == [(1, 0, "user", "hello"), (1, 1, "assistant", "new"), (1, 2, "user", "next"), (2, 0, "user", "lone")]
    assert chat_format.digests(chat_format.render(chat_format.fold_log(frame.limit(0)))).count() == 0


def plain_ngrams(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    grams = Counter(p[i : i + n] for w in words for p in (f" {w} ",) for n in (1, 2, 3) for i in range(len(p) - n + 1) if p[i : i + n].strip() and not (n == 1 and p[i] == " "))
    return grams


def test_ngrams():
    for text in ("", "123 !", "Été à la mer, the sea", "a", "x1y  zz\n\nz"):
        grams, counts = language_id.ngrams(text)

        def unpack(g):
            out = ""
            while g:
                out, g = chr(g & 0x1FFFFF) + out, g >> 21
            return out

        assert {unpack(g): n for g, n in zip(grams.tolist(), counts.tolist(), strict=True)} == dict(plain_ngrams(text))
        assert counts.tolist() == sorted(counts.tolist(), reverse=True)


def test_language_of_held_out(spark, real):
    docs = real[0]
    profiles = language_id.train(language_id.training_rows(docs, language_id.held_out()))
    found = language_id.identify(docs, profiles).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) >= 0.95
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !", "x"), (3, "12 !", "x")], "doc_id long, text string, score string")
    assert {(r.lang_pred, r.score) for r in language_id.identify(odd, profiles).collect()} == {("und", 0.0)}
    assert language_id.identify(odd.limit(0), profiles).count() == 0
    nothing = language_id.train(language_id.training_rows(docs.limit(0)))
    assert nothing == {} and language_id.identify(odd, nothing).count() == 4


def plain_counts(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_text_counts(real):
    texts = ["", " ", "a b c\na b c\n\na b c", "one\xa0two three\x1cfour", "w " * 30, "a b c d e f g h i a b c d e f g h", "#*$ <>|"] + [r.text for r in real[0].limit(60).collect()]
    for x in texts:
        c = dict(zip(text_stats.COUNTS, text_stats.counts(x), strict=True))
        assert (c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"]) == plain_counts(x)


def test_quality_rules(spark, real):
    docs, labels = real
    forest, most = quality_rules.fit(docs, labels)
    rows = quality_rules.apply_rules(docs, forest, most).join(labels.groupBy("doc_id").agg({"quality": "min"}).toDF("doc_id", "quality"), "doc_id").collect()
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed) for r in rows)
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) >= 0.98 and sum(bad) / len(bad) <= 0.5
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x")], "doc_id long, text string, kept string")
    assert {(r.n_words, r.kept) for r in quality_rules.apply_rules(odd, forest, most).collect()} == {(0, False), (2, False)}
    empty, most = quality_rules.fit(docs.limit(0), labels.limit(0))
    assert quality_rules.apply_rules(odd, empty, most).count() == 3 and quality_rules.apply_rules(odd.limit(0), empty, most).count() == 0


def test_quality_rules_learn_from_all_rows(spark, monkeypatch):
    """More rows and labels than any bounded sample: every row counts in the leaves, every label in the threshold."""
    for name in ("TRAIN_ROWS", "LABELLED_ROWS"):
        monkeypatch.setattr(quality_rules, name, 40)
    monkeypatch.setattr(quality_rules, "SAMPLE", 16)
    monkeypatch.setattr(quality_rules, "GOOD_LOST", 0.1)
    words = ["a", "bee", "Sea", "deed!", "eagle", "f#", "GNU", "horses?"]
    texts = [" ".join(words[(i * i + i // 7 * j + j * j * j) % 8] + str((i * j) % (i % 29 + 2)) for j in range(i % 5 * 7 + 12)) for i in range(700)]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (4, None), (None, texts[9])], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, None if i % 11 == 3 else int(i % 3 > 0)) for i in range(600)] + [(5, 0), (900, 1)], "doc_id long, quality int")
    forest, most = quality_rules.fit(docs, labels)
    rows = {(r.doc_id, *(r[c] for c in text_stats.COUNTS)): r for r in text_stats.with_counts(docs).collect()}
    found = pd.DataFrame([r.asDict() for r in rows.values()])
    found = found[~quality_rules.base_failed(found)]
    x = quality_rules.split_features(found)
    assert len(x) > 200 and forest.size == 16 and len(forest.trees) == quality_rules.TREES
    for feature, split, left, right, path in forest.trees:
        at, level, held = 0, {0: 0}, Counter()
        for at in range(len(feature)):
            if feature[at] >= 0:
                level |= {at + left[at]: level[at] + 1, at + right[at]: level[at] + 1}
        for row in x:
            at = 0
            while feature[at] >= 0:
                at += left[at] if row[feature[at]] < split[at] else right[at]
            held[at] += 1
        for at in np.flatnonzero(feature < 0).tolist():
            assert abs(path[at] - level[at] - quality_rules.path_after(16 * held[at] / len(x))) < 1e-9
    quality = {}
    for r in labels.where("quality is not null").collect():
        quality[r.doc_id] = min(r.quality, quality.get(r.doc_id, 1))
    least = {}
    for key in sorted(k for k in rows if k[0] is not None):
        least.setdefault(key[0], rows[key])
    known = pd.DataFrame([least[i].asDict() | {"good": q == 1} for i, q in quality.items() if i in least])
    known = known[~quality_rules.base_failed(known)]
    good = np.sort(forest.anomaly(quality_rules.split_features(known[known["good"]])))
    assert len(good) > 80 and most == good[min(len(good) - 1, math.ceil(0.9 * len(good)))]


def test_score_of_a_rank(spark):
    for values in ([0.5], [0.1, 0.1, 0.1], [(i * i % 97) / 97 for i in range(300)], [0.3, 0.3 + 5e-17, 0.30000000000000004, 1.0]):
        scores = spark.createDataFrame([(x,) for x in values], "x double")
        for rank in {0, len(values) // 2, len(values) - 1}:
            assert quality_rules.at_rank(scores, "x", rank) == sorted(values)[rank]


def test_rule_ensemble(spark, real):
    docs, labels = real
    rules, intercept = rule_ensemble.fit(docs, labels)
    assert 0 < len(rules) < 150
    scored = rule_ensemble.score(docs, rules, intercept).join(labels, "doc_id").where(rule_ensemble.held_out()).collect()
    assert sum((r.score >= rule_ensemble.ACCEPT) == (r.quality == 1) for r in scored) / len(scored) >= 0.85
    x = text_stats.features(text_stats.with_counts(docs).toPandas())
    columns = rule_ensemble.feature_columns()
    y = text_stats.with_counts(docs).select(*(columns[f].alias(f) for f in text_stats.FEATURES)).toPandas().to_numpy()
    assert abs(x - y).max() < 1e-9
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in rule_ensemble.score(odd, rules, intercept).collect())
    assert rule_ensemble.fit(docs, labels.limit(0)) == ([], 0.0)
    clash = docs.withColumn("n_words", docs.doc_id).withColumn("kept_row", docs.doc_id)
    assert rule_ensemble.kept_by_quality(clash, labels).columns == clash.columns


def plain_likeness(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, c in enumerate(a):
        for j, d in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if c == d else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


def test_fingerprints(spark, real):
    for a, b in (("", ""), ("abc", "abd"), ("kitten", "sitting"), ("aaaa", "aa"), ("xyz", "")):
        assert fingerprints.common_length(a, b) == plain_likeness(a, b)
    text = real[0].orderBy("n_chars", ascending=False).first().text
    long = text * (1 + 300_000 // len(text))
    shifted = "zzz" + long
    assert fingerprints.fingerprint(long) == fingerprints.fingerprint(long[:])
    assert fingerprints.likeness(fingerprints.fingerprint(long), fingerprints.fingerprint(shifted)) > 0.9
    rows = [(5, None), (4, "a"), (3, text), (2, text), (1, "é" * 10), (None, "n")]
    docs = spark.createDataFrame([(i, x, "c") for i, x in rows], "doc_id long, text string, fingerprint string")
    found = {r.doc_id: r for r in fingerprints.neighbours(docs).collect()}
    order = [x or "" for _, x in rows]
    assert len(found) == 6
    for k, (i, x) in enumerate(rows):
        changed = fingerprints.edited(x or "", order[(k + 1) % 6])
        assert found[i].n_chars == len(x or "") and found[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert found[i].fingerprint == fingerprints.fingerprint(x or "")
    assert found[3].near_next == 1.0 and found[2].near_next < 0.5
    assert fingerprints.neighbours(docs.limit(0)).count() == 0
    one = fingerprints.neighbours(docs.where("doc_id = 1")).collect()
    assert one[0].near_next == 1.0
