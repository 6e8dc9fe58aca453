"""Language by rank-order profiles of character n-grams and the out-of-place distance.

A profile is the most frequent 1- to 3-grams of a text or of a language's training texts, in order of frequency. The
distance of a document to a language sums, over the document's profile, how far each n-gram's rank is from its rank in
the language's profile, or the profile's length where it is missing there; the nearest language is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import bounded, doc_texts, documents, id_crc, in_bounds, released, small_batches
from siltstone.sources.shared import written

#: N-grams in a language's profile and in a document's.
PROFILE, DOC_PROFILE = 400, 300
#: Training documents of a language, at most about so many: all if there are no more, else a share by hash.
TRAIN_DOCS = 4000
#: Up to so many languages' shares go to the documents by a broadcast; more are joined by shuffle.
BROADCAST_LANGS = 10_000
UNKNOWN = "und"
SPACE = 32
#: A document whose n-grams are all but absent from the nearest profile is in none of the learned languages.
REJECT_BELOW = 0.1


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point: is it a letter."""
    return np.frombuffer(bytes(map(str.isalpha, map(chr, range(0x110000)))), np.bool_)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-grams of the lower-case words (letters, with one space around) as packed code points, and their
    counts, most frequent first, ties by code points; none of a text without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[points]
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.where(is_letter, points, SPACE).astype(np.int64)
    keep = np.ones(len(points), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    points = np.concatenate([[SPACE], points[keep], [SPACE]])
    gap = points == SPACE
    two = (points[:-1] << 21) | points[1:]
    three = (two[:-1] << 21) | points[2:]
    grams = np.concatenate([points[~gap], two[~(gap[:-1] & gap[1:])], three[~gap[1:-1]]])
    grams.sort()
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    counts = np.diff(first, append=len(grams))
    order = np.argsort(-counts, kind="stable")
    return grams[first][order], counts[order]


def training_rows(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """lang, text of at most about TRAIN_DOCS documents of each language, never held-out ones. Rows without lang or text
    teach nothing. Every value of lang is learned."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~(F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))))
    shares = written(rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(TRAIN_DOCS) / F.count("*")).alias("train_share")), "language-shares")
    shares = F.broadcast(shares) if shares.count() <= BROADCAST_LANGS else shares
    part = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    return rows.select("lang", "text", part.alias("at_share")).join(shares, "lang").where("at_share < train_share").select("lang", "text")


def train(rows: DataFrame) -> dict[str, list[int]]:
    """Each language's profile from rows (lang, text): a few hundred packed n-grams, most frequent first, ties by code
    points: about 3 KB come to the driver for each language; counts are summed where the texts are. No rows: no profiles;
    repeated rows count again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[int, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = sums.setdefault(lang, {})
                for gram, n in zip(*(x.tolist() for x in ngrams(text)), strict=True):
                    own[gram] = own.get(gram, 0) + n
        for lang, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array([*own], pa.int64()), pa.array([*own.values()], pa.int64())], ["lang", "gram", "n"])

    small_batches(rows.sparkSession)
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    profiles: dict[str, list[int]] = {}
    for x in sorted(counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= PROFILE).collect(), key=lambda x: (x.lang, x.rank)):
        profiles.setdefault(x.lang, []).append(x.gram)
    return profiles


class Profiles:
    """For each n-gram the languages whose profiles hold it and its ranks there, one after the other."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        grams = np.concatenate([np.array(profiles[x], np.int64) for x in self.langs] or [np.zeros(0, np.int64)])
        order = np.argsort(grams, kind="stable")
        self.grams, starts = np.unique(grams[order], return_index=True)
        self.starts = np.append(starts, len(grams))
        self.lang = np.repeat(np.arange(len(self.langs)), [len(profiles[x]) for x in self.langs])[order]
        self.rank = np.concatenate([np.arange(len(profiles[x])) for x in self.langs] or [np.zeros(0, np.int64)])[order]

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ngrams(text or "")[0][:DOC_PROFILE]
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, grams)
        known = np.flatnonzero(at < len(self.grams))
        known = known[self.grams[at[known]] == grams[known]]
        starts, sizes = self.starts[at[known]], np.diff(self.starts)[at[known]]
        # the places of all languages of all known n-grams
        places = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        nearer = PROFILE - np.abs(self.rank[places] - np.repeat(known, sizes))
        far = PROFILE * len(grams) - np.bincount(self.lang[places], nearer, len(self.langs))
        k = int(far.argmin())
        return self.langs[k], max(0.0, 1.0 - float(far[k]) / (PROFILE * len(grams)))


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """doc_id, lang_pred, score (1: the document's profile is the language's, 0: nothing in common) of every whole text;
    `und` and 0 if it is null or has no letter. Ties go to the first language by name; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles)
        for batch in batches:
            for ids, texts in bounded(batch):
                found = [model.predict(x) for x in texts]
                yield pa.RecordBatch.from_arrays([ids, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(column: str = "doc_id") -> Column:
    return F.pmod(id_crc(column), F.lit(4)) == 2


def kept_by_language(docs: DataFrame) -> DataFrame:
    """The documents, all columns, but for those without a letter and those in none of the learned languages: null and
    empty texts go, repeated rows are judged alike. Rows go through whole, as Arrow has them, so no value changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles)
        for batch in batches:
            texts = batch.column(0).field(at).to_pylist()
            for part in in_bounds(texts):
                found = [model.predict(x) for x in texts[part]]
                kept = pa.array([lang != UNKNOWN and score >= REJECT_BELOW for lang, score in found], pa.bool_())
                yield batch.slice(part.start, part.stop - part.start).filter(kept)
            released()

    at = docs.columns.index("text")
    profiles = train(training_rows(docs, held_out()))
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("kept_row"))
    return rows.mapInArrow(run, rows.schema).select("kept_row.*")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; null, empty and repeated texts as in identify. A null doc_id is held out by no rule: null."""
    docs = documents(spark, sf_dir)
    found = identify(docs, train(training_rows(docs, held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
