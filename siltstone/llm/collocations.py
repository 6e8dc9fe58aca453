"""Phrases that occur more often than their parts would make them, by hierarchical pair naming.

Texts become numbered words in units of about UNIT_WORDS words of one language, each with a dictionary of its own. Equal
entries of all dictionaries meet in buckets, by hash: an entry that is frequent in all gets a global name, which goes back to
the units; others end a phrase. Two adjacent named grams of k-1 words make a pair, whose names are those of its two parts; the
pairs are the next dictionary. A name's parts are its parent pointers: its cuts and the phrases inside it are read off them.

A unit sends a bucket one row that packs its entries, so an entry is moved once for each unit that holds it; no word or pair
has more entries than there are units, and buckets grow in number with the texts, not in size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import documents, in_bounds, released, small_batches
from siltstone.sources.shared import Scratch, written

#: Words of a candidate, its least count, the least share in percent of a longer one that makes it part of it, and how many
#: are reported of each language.
MOST_WORDS, LEAST_COUNT, INSIDE_PERCENT, REPORTED = 3, 10, 50, 2000
#: Words of a unit, about (a single text may be longer), and characters for each bucket.
UNIT_WORDS, BUCKET_CHARS = 1 << 20, 1 << 23
#: Marks the end of a piece; no UTF-8 text holds this byte.
END = b"\xff"
#: Each byte of a text as it counts: A-Z in lower case, piece ends as END, tabs as spaces.
BYTES = bytes(END[0] if x in b".,;:!?\n\x0b\x0c\r" else 32 if x == 9 else x + 32 if 65 <= x <= 90 else x for x in range(256))
#: Partial ranks of a language, so that no task orders all of its candidates.
RANK_PARTS = 32
#: Rows of a table of units: a unit (unit, lang, words, numbers) or its entries in a bucket (unit, lang, bucket, places in
#: its dictionary, counts, and words or the names of two parts).
UNITS = [("unit", pa.int64()), ("lang", pa.string()), ("words", pa.int64()), ("numbers", pa.binary()), ("bucket", pa.int64()), ("places", pa.binary()), ("counts", pa.binary()), ("text", pa.binary()), ("firsts", pa.binary()), ("seconds", pa.binary())]
#: Rows of a table of names: a name (id, f and what it names) or a unit's entries that have names (unit, places, ids).
NAMES = [("id", pa.int64()), ("f", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("first", pa.int64()), ("second", pa.int64()), ("unit", pa.int64()), ("places", pa.binary()), ("ids", pa.binary())]


class Numbers(dict):
    """Numbers words in the order in which they come; END is 0."""

    def __init__(self) -> None:
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def rows(fields: list[tuple[str, pa.DataType]], **columns: object) -> pa.RecordBatch:
    """A batch of these columns, the others null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in fields], [c for c, _ in fields])


def schema(fields: list[tuple[str, pa.DataType]]) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{c} {names[t]}" for c, t in fields)


def packed(numbers: np.ndarray, kind: type = np.int64) -> bytes:
    """Numbers by their first bytes, then their second bytes and so on: most of those are zeros, which compress away."""
    whole = np.ascontiguousarray(numbers, kind)
    return whole.view(np.uint8).reshape(len(whole), -1).T.tobytes()


def unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def in_buckets(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its entries."""
    order = np.argsort(buckets, kind="stable")
    found, starts = np.unique(buckets[order], return_index=True)
    if len(found):
        yield from zip(found.tolist(), np.split(order, starts[1:]), strict=True)


def unit_rows(unit: int, lang: str, own: np.ndarray, words: list[bytes], buckets: int) -> Iterator[pa.RecordBatch]:
    """A unit and its words' entries; END is no word."""
    counts = np.bincount(own, minlength=len(words))
    yield rows(UNITS, unit=[unit], lang=[lang], words=[len(own) - int(counts[0])], numbers=[packed(own, np.int32)])
    hashes = np.fromiter((crc32(w) % buckets for w in words[1:]), np.int64, len(words) - 1)
    for bucket, at in in_buckets(hashes):
        yield rows(UNITS, unit=[unit], lang=[lang], bucket=[bucket], places=[packed(at + 1, np.int32)], counts=[packed(counts[at + 1])], text=[END.join([words[i] for i in (at + 1).tolist()])])


def units(docs: DataFrame, buckets: int, most: int = UNIT_WORDS) -> DataFrame:
    """Units and their entries, by word. Null texts are empty; a null language is `und`; every row counts, repeated ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, numbers, total = TaskContext.get().partitionId() << 32, {}, {}, 0

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal unit, total
            for lang, parts in held.items():
                yield from unit_rows(unit, lang, np.concatenate(parts), list(numbers[lang]), buckets)
                unit += 1
            held.clear()
            numbers.clear()
            total = 0

        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for part in in_bounds(texts):
                for lang, text in zip(langs[part], texts[part], strict=True):
                    words = text.encode().translate(BYTES).replace(END, b" " + END + b" ").split()
                    if words:
                        known = numbers.setdefault(lang, Numbers())
                        held.setdefault(lang, []).append(np.fromiter(map(known.__getitem__, [*words, END]), np.int32, len(words) + 1))
                        total += len(words)
                    if total >= most:
                        yield from flushed()
            released()
        yield from flushed()

    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, schema(UNITS))


def paired(table: DataFrame, names: DataFrame, buckets: int, last: bool) -> DataFrame:
    """The next table of units: in place of each number its entry's name, if it has one, and of two adjacent ones the pair, by
    its number in the unit, or 0; the last table needs its entries only."""

    def run(unit: pa.Table, known: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        if unit.num_rows and known.num_rows:
            key, own = unit.column("whole_unit")[0].as_py(), unpacked(unit.column("numbers")[0].as_py(), np.int32)
            places, ids = (np.concatenate([unpacked(x, t) for x in known.column(c).to_pylist()]) for c, t in (("places", np.int32), ("ids", np.int64)))
            of = np.full(max(int(own.max(initial=0)), int(places.max(initial=0))) + 1, -1, np.int64)
            of[places] = ids
            has = of[own] >= 0
            at = np.flatnonzero(has[:-1] & has[1:])
            pairs, which, counts = np.unique(own[at].astype(np.int64) << 32 | own[at + 1], return_inverse=True, return_counts=True)
            if not last:
                numbers = np.zeros(len(own), np.int32)
                numbers[at] = which + 1
                out.append(rows(UNITS, unit=[key], numbers=[packed(numbers, np.int32)]))
            firsts, seconds = of[pairs >> 32], of[pairs & 0xFFFFFFFF]
            mixed = (firsts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ seconds.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
            for bucket, i in in_buckets((mixed % np.uint64(buckets)).astype(np.int64)):
                out.append(rows(UNITS, unit=[key], bucket=[bucket], places=[packed(i + 1, np.int32)], counts=[packed(counts[i])], firsts=[packed(firsts[i])], seconds=[packed(seconds[i])]))
        return pa.Table.from_batches(out, pa.schema(UNITS))

    # both sides may come from one table, so the columns of one go by other names
    whole = table.where("numbers is not null").select(F.col("unit").alias("whole_unit"), "numbers")
    return whole.groupBy("whole_unit").cogroup(names.where("places is not null").select("unit", "places", "ids").groupBy("unit")).applyInArrow(run, schema(UNITS))


def numbered_words(part: pa.Table) -> tuple[list[np.ndarray], list[tuple[str, bytes]]]:
    """For each row of a bucket the numbers of its entries, equal ones alike, and what the numbers stand for."""
    known: dict[str, dict[bytes, int]] = {}
    stand_for: list[tuple[str, bytes]] = []
    out = []
    for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
        own, words = known.setdefault(lang, {}), text.split(END)
        for w in words:
            if w not in own:
                own[w] = len(stand_for)
                stand_for.append((lang, w))
        out.append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)))
    return out, stand_for


def numbered_pairs(part: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """As numbered_words, for pairs of names."""
    both = [unpacked(x) for c in ("firsts", "seconds") for x in part.column(c).to_pylist()]
    n = part.num_rows
    pairs = np.stack([np.concatenate(both[:n]), np.concatenate(both[n:])], 1)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[order][1:] != pairs[order][:-1]).any(1)
    which = np.empty(len(pairs), np.int64)
    which[order] = np.cumsum(new) - 1
    return np.split(which, np.cumsum([len(x) for x in both[:n]])[:-1]), pairs[order][new]


def named(table: DataFrame, by_word: bool, least: int, buckets: int) -> DataFrame:
    """The names of entries that occur at least `least` times in all units, and which entries of each unit have them."""

    def run(part: pa.Table) -> pa.Table:
        each, stand_for = numbered_words(part) if by_word else numbered_pairs(part)
        counts = [unpacked(x) for x in part.column("counts").to_pylist()]
        total = np.zeros(len(stand_for), np.int64)
        for own, n in zip(each, counts, strict=True):
            total[own] += n  # an entry is in a row once
        often = np.flatnonzero(total >= least)
        ids = np.full(len(total), -1, np.int64)
        ids[often] = np.arange(len(often)) * buckets + part.column("bucket")[0].as_py()
        names = {"lang": [stand_for[i][0] for i in often], "word": [stand_for[i][1].decode() for i in often]} if by_word else {"first": stand_for[often, 0], "second": stand_for[often, 1]}
        out = [rows(NAMES, id=ids[often], f=total[often], **names)]
        for unit, own, places in zip(part.column("unit").to_pylist(), each, part.column("places").to_pylist(), strict=True):
            has = ids[own] >= 0
            if has.any():
                out.append(rows(NAMES, unit=[unit], places=[packed(unpacked(places, np.int32)[has], np.int32)], ids=[packed(ids[own][has])]))
        return pa.Table.from_batches(out, pa.schema(NAMES))

    return table.where("bucket is not null").drop("words", "numbers").groupBy("bucket").applyInArrow(run, schema(NAMES))


def grown(pairs: DataFrame, before: DataFrame) -> DataFrame:
    """The phrases (id, lang, phrase, last, f, heads, tails, first, second) of pairs of names of `before`: heads and tails are
    the counts of the first and the last 1, 2, ... words."""
    left = before.select(F.col("id").alias("first"), "lang", F.col("phrase").alias("begin"), F.array_append("heads", F.col("f")).alias("heads"))
    right = before.select(F.col("id").alias("second"), "last", F.array_append("tails", F.col("f")).alias("tails"))
    both = pairs.join(left, "first").join(right, "second")
    return both.select("id", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "f", "heads", "tails", "first", "second")


def lowest_cut() -> Column:
    """(score, k, l, r) of a phrase's lowest-scoring cut, the first of several: exact for counts below 10^16."""
    a = F.col("f").cast("decimal(19,0)")
    cuts = F.transform(F.sequence(F.lit(1), F.size("heads")), lambda k: F.struct(k.alias("k"), F.get("heads", k - 1).alias("l"), F.get("tails", F.size("tails") - k).alias("r")))
    return F.array_min(F.transform(cuts, lambda c: F.struct(floored(F.lit(1_000_000).cast("decimal(7,0)") * a * a, c["l"], c["r"]).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"))))


def floored(above: Column, x: Column, y: Column) -> Column:
    return F.call_function("div", above.cast("decimal(38,0)"), (x.cast("decimal(19,0)") * y.cast("decimal(19,0)")).cast("decimal(38,0)"))


def first_of_each(found: DataFrame, most: int) -> DataFrame:
    """rank and the first `most` of each language: the first of parts, then of those."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    some = found.withColumn("part_rank", F.row_number().over(part)).where(F.col("part_rank") <= most).drop("part_rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, words: int = MOST_WORDS, least: int = LEAST_COUNT, inside: int = INSIDE_PERCENT, most: int = REPORTED, unit_words: int = UNIT_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first `most` phrases of two to `words` words of each language by score
    descending, count descending, phrase. Texts are lower-cased (A-Z), cut into pieces at `.,;:!?` and line ends, and those
    into words at spaces and tabs. Null, empty and repeated rows as in units; other columns don't matter; an empty table has
    no phrases."""
    with Scratch(docs.sparkSession, "collocations") as scratch:
        chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
        buckets = 1 + chars // BUCKET_CHARS
        table = scratch.written(units(docs, buckets, unit_words), "units")
        totals = scratch.written(table.groupBy("lang").agg(F.sum("words").alias("n")), "totals")
        names = scratch.written(named(table, True, least, buckets), "names")
        none = F.lit([]).cast("array<long>")
        found = names.where("id is not null")
        level = found.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("heads"), none.alias("tails"), "first", "second")
        levels = []
        for k in range(2, words + 1):
            table = scratch.written(paired(table, names, buckets, k == words), "pairs")
            names = scratch.written(named(table, False, least, buckets), "names")
            level = scratch.written(grown(names.where("id is not null").select("id", "first", "second", "f"), level), "phrases")
            levels.append(level)
        longer = [x.select(F.explode(F.array("first", "second")).alias("id"), F.col("f").alias("around")) for x in levels[1:]]
        kept = []
        for phrases, around in zip(levels, [*longer, None], strict=True):
            if around is not None:
                # a longer phrase is no more frequent than the one of a word more inside it
                most_around = around.groupBy("id").agg(F.max("around").alias("around"))
                phrases = phrases.join(most_around, "id", "left").where(F.coalesce(100 * F.col("around") < inside * F.col("f"), F.lit(True)))
            kept.append(phrases.select("lang", "phrase", "f", lowest_cut().alias("cut")))
        scored = reduce(DataFrame.unionByName, kept).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
        ranked = written(first_of_each(scored, most).join(totals, "lang"), "collocations")
        return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; null, empty and repeated texts as in collocations."""
    return collocations(documents(spark, sf_dir))
