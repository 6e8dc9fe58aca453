"""Documents linked by the Jaccard similarity of their word shingles, through signature trees.

Equal sets are one class. Class representatives that have a prefix element in common (shingle_sets) and are near in size
form a group under the least of their ids, so every linked pair is together in some group. A signature tree over each
group's sets finds its links by a dual traversal with exact checks, and only links found are closed into components. A
group too large for one task is dealt out in chunks with its least set: first each chunk is joined with itself, then the
sets outside the group's largest component are joined with the other chunks.

Nothing is dealt out by a key that may hold much of the rows: elements that the sketch counts often go to their group by
a partial aggregate and a broadcast (HEAVY bounds their number), and so do the digests of many copies.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import bounded, doc_texts, documents
from siltstone.llm.shingle_sets import BLOCK, COUNTERS, places, prefix, set_digest, shingle_lists
from siltstone.llm.signature_tree import Components, build, join_trees, width
from siltstone.operators.graph import components
from siltstone.sources.shared import Scratch, written

WORDS, PERCENT = 3, 90
#: Sets in a task of the tree join, and shingles in them, about.
CHUNK, CHUNK_SHINGLES = 800, 800_000
#: Up to so many ids are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Keys that hold more than one in HEAVY of all rows are heavy: fewer than HEAVY keys are.
HEAVY = 20_000
#: Partial sketches that are summed in one task, and where a counter stops.
FAN_IN, MOST_COUNT = 64, (1 << 32) - 1


def digests(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (digest of the set) of every whole text, and rows (part, block, counts) of each
    task's sketch, where doc_id is null and n_shingles -1."""
    names = ["doc_id", "n_shingles", "h1", "h2", "part", "block", "counts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        sketch = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for ids, texts in bounded(batch):
                sets = shingle_lists(texts, words)
                for s in (np.concatenate(sets),) if sets else ():
                    sketch += np.bincount(places(s), minlength=COUNTERS).astype(np.uint32)
                both = [set_digest(s) for s in sets]
                none = pa.nulls(len(sets), pa.int32())
                yield pa.RecordBatch.from_arrays([ids, pa.array([*map(len, sets)], pa.int64()), pa.array([x for x, _ in both], pa.int64()), pa.array([x for _, x in both], pa.int64()), none, none, pa.nulls(len(sets), pa.binary())], names)
        part = TaskContext.get().partitionId()
        blocks = range(COUNTERS // BLOCK) if sketch.any() else ()
        for b in blocks:
            row = [None, -1, None, None, part, b, sketch[b * BLOCK : (b + 1) * BLOCK].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, part int, block int, counts binary")


def sketch_of(table: DataFrame) -> np.ndarray:
    """How often elements with each low bits occur in all sets: the sum of all tasks' sketches, FAN_IN at a time. COUNTERS
    numbers come to the driver, whatever the table's size."""

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.uint32)
        for x in part["counts"]:
            x = np.frombuffer(x, np.uint32)
            total += np.minimum(x, np.uint32(MOST_COUNT) - total)
        return pd.DataFrame({"part": [int(part["part"].iloc[0]) // FAN_IN], "block": [int(part["block"].iloc[0])], "counts": [total.tobytes()]})

    rows = table.where("n_shingles = -1").select("part", "block", "counts")
    parts = rows.agg(F.max("part")).first()[0]
    out = np.zeros(COUNTERS, np.uint32)
    while parts:
        rows, parts = rows.groupBy("block", F.floor(F.col("part") / FAN_IN)).applyInPandas(summed, "part int, block int, counts binary"), parts // FAN_IN
    for x in rows.collect():
        out[x.block * BLOCK : (x.block + 1) * BLOCK] = np.frombuffer(x.counts, np.uint32)
    return out


def heavy_split(rows: DataFrame, keys: str | list[str], stats: DataFrame, most: int) -> DataFrame:
    """rows joined with their keys' stats, of which k is the number of rows: keys of more than `most` rows by broadcast, the
    others by shuffle."""
    heavy = F.broadcast(stats.where(F.col("k") > most))
    rest = rows.join(heavy, keys, "left_anti").join(stats.where(F.col("k") <= most), keys)
    return rows.join(heavy, keys).unionByName(rest)


def classes(table: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_shingles and rep (least doc_id with an equal set; its own if the set is empty) of a table of digests."""
    keys = ["n_shingles", "h1", "h2"]
    sets = table.where("n_shingles >= 0").select("doc_id", *keys)
    copied = scratch.written(sets.where("n_shingles > 0").groupBy(keys).agg(F.min("doc_id").alias("least"), F.count("*").alias("k")).where("k > 1"), "copied-sets")
    size = copied.agg(F.count("*").alias("keys"), F.sum("k").alias("rows")).first()
    few = size["keys"] <= BROADCAST_ROWS
    again = sets.join(F.broadcast(copied), keys) if few else heavy_split(sets, keys, copied, size["rows"] // HEAVY)
    once = sets.join(F.broadcast(copied) if few else copied, keys, "left_anti")
    out = again.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("rep"))
    return scratch.written(out.unionByName(once.select("doc_id", "n_shingles", F.col("doc_id").alias("rep"))), "classes")


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows without those of ids (doc_id, distinct)."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_anti")


def prefixes(docs: DataFrame, copies: DataFrame, sketch: np.ndarray, most: int, words: int, percent: int) -> DataFrame:
    """doc_id, n, index, light, heavy of every document with shingles that isn't a copy: the elements of its probe prefix
    in their order, of which the first `index` are its index prefix; heavy ones, counted more than `most` times, come last."""
    names = ["doc_id", "n", "index", "light", "heavy"]

    def run(batches):
        for batch in batches:
            for ids, texts in bounded(batch):
                n, index, light, heavy = [], [], [], []
                for s in shingle_lists(texts, words):
                    own, q = prefix(s, sketch, percent) if len(s) else (s, 0)
                    at = int(np.searchsorted(sketch[places(own)], most, "right")) if len(own) else 0
                    n.append(len(s))
                    index.append(q)
                    light.append(own[:at].astype(np.int64))
                    heavy.append(own[at:].astype(np.int64))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(index, pa.int64()), pa.array(light, pa.list_(pa.int64())), pa.array(heavy, pa.list_(pa.int64()))], names)

    few = copies.count() <= BROADCAST_ROWS
    texts = doc_texts(docs).where("doc_id is not null")
    schema = "doc_id long, n long, index long, light array<long>, heavy array<long>"
    found = texts.join(F.broadcast(copies), "doc_id", "left_anti").mapInArrow(run, schema) if few else without(texts.mapInArrow(run, schema), copies)
    return found.where("n > 0")


def groups(rows: DataFrame, percent: int, most: int) -> DataFrame:
    """(label, doc_id, n), distinct: the sets of rows (prefixes) that share an element and are near in size, under the least
    id among them. An element that no set has in its index prefix joins nothing; of heavy elements, more than `most` sets may
    have fewer than HEAVY."""
    light = rows.select("doc_id", "n", "index", F.posexplode("light").alias("pos", "element")).select("doc_id", "n", "element", (F.col("pos") < F.col("index")).alias("indexed"))
    by_size = Window.partitionBy("element").orderBy("n", "doc_id")
    near_before = 100 * F.lag("n").over(by_size) >= percent * F.col("n")
    near_after = 100 * F.col("n") >= percent * F.lead("n").over(by_size)
    met = light.withColumns({"before": F.coalesce(near_before, F.lit(False)), "after": F.coalesce(near_after, F.lit(False))}).where("before or after")
    runs = met.withColumn("run", F.sum(F.when(F.col("before"), 0).otherwise(1)).over(by_size))
    run = Window.partitionBy("element", "run")
    labelled = runs.withColumns({"label": F.min("doc_id").over(run), "any": F.max("indexed").over(run), "k": F.count("*").over(run)}).where("any and k > 1").select("label", "doc_id", "n")
    heavy = rows.select("doc_id", "n", F.explode("heavy").alias("element"))
    hubs = heavy.groupBy("element").agg(F.min("doc_id").alias("label"), F.count("*").alias("k")).where("k > 1")
    return labelled.unionByName(heavy_split(heavy, "element", hubs, most).select("label", "doc_id", "n")).distinct()


def linked(ids: list[int], sides: list[str], texts: list[str], known: list[int], words: int, percent: int) -> list[tuple[int, int]]:
    """Links (a, b) that one group's signature trees find, b the least of its component in the group: sides `left` and
    `right` are compared across, `both` with everything; equal known components are one from the start."""
    sets = shingle_lists(texts, words)
    found = Components(len(ids))
    first: dict[int, int] = {}
    for i, k in enumerate(known):
        if first.setdefault(k, i) != i:
            found.join(first[k], i)
    started = [found.find(i) for i in range(len(ids))]
    bits = width(sets)
    usable = [i for i in range(len(ids)) if len(sets[i])]
    if "left" in sides:
        left, right = (build([i for i in usable if sides[i] == side], sets, bits) for side in ("left", "right"))
        join_trees(left, left, sets, percent, found)
        join_trees(left, right, sets, percent, found)
    else:
        whole = build(usable, sets, bits)
        join_trees(whole, whole, sets, percent, found)
    roots = [found.find(i) for i in range(len(ids))]
    return [(ids[i], ids[r]) for i, r in enumerate(roots) if r != i and r != started[i]]


def tree_join(members: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) of members (deal, task, doc_id, text, side, known): rows of one deal go to one task, which joins each of
    its groups (task) by itself. A document with the same text is in a group once."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        tasks, ids, texts, sides, known = (part.column(c).to_pylist() for c in ("task", "doc_id", "text", "side", "known"))
        order = sorted(range(len(ids)), key=lambda i: (tasks[i], ids[i], sides[i]))
        out: list[tuple[int, int]] = []
        for _, group in groupby(order, key=tasks.__getitem__):
            rows = list({(ids[i], texts[i]): i for i in reversed(list(group))}.values())[::-1]
            out += linked([ids[i] for i in rows], [sides[i] for i in rows], [texts[i] for i in rows], [known[i] for i in rows], words, percent)
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return members.groupBy("deal").applyInArrow(run, "a long, b long")


def dealt_members(docs: DataFrame, met: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, bool]:
    """The members (task, doc_id, text, chunks, part, deal) of groups of two or more, part being the chunk of a group that
    has several and deal its task: small groups are dealt out together. The groups (label, chunks), and whether any has more
    than one chunk."""
    size = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES))
    sizes = scratch.written(met.groupBy("label").agg(F.count("*").alias("k"), F.sum("n").alias("n"), size.alias("chunks")).where("k > 1"), "groups")
    total = sizes.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.max("chunks").alias("most")).first()
    few = total["groups"] <= BROADCAST_ROWS
    sizes = sizes.select("label", "chunks")
    members = met.join(F.broadcast(sizes) if few else sizes, "label").select("label", "doc_id", "chunks")
    members = scratch.written(members, "members")
    texts = doc_texts(docs).join(F.broadcast(members) if members.count() <= BROADCAST_ROWS else members, "doc_id")
    dealt = texts.select(F.col("label").alias("task"), "doc_id", "text", "chunks", F.pmod(F.xxhash64("doc_id"), "chunks").alias("part"))
    together = F.pmod(F.xxhash64("task"), F.lit(max(1, (total["n"] or 0) // (CHUNK_SHINGLES // 2)))).cast("string")
    dealt = dealt.withColumn("deal", F.when(F.col("chunks") == 1, together).otherwise(F.concat_ws("/", "task", "part")))
    large = (total["most"] or 1) > 1
    return (scratch.written(dealt, "group-texts") if large else dealt), sizes, large


def similarity_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) of every document, one row for each row of docs.
    Two documents link when their shingle sets' Jaccard similarity is at least percent / 100. A null or empty text, or one
    without words, has no shingles and no links; a doc_id on several rows is one document in links; null ids have none;
    columns but doc_id and text don't matter."""
    with Scratch(docs.sparkSession, "jaccard") as scratch:
        table = scratch.written(digests(docs, words), "digests")
        known = classes(table, scratch)
        copies = scratch.written(known.groupBy("doc_id").agg(F.bool_and(F.col("rep") != F.col("doc_id")).alias("copy")).where("copy").select("doc_id"), "copies")
        sketch = sketch_of(table)
        most = max(1000, int(sketch.sum(dtype=np.int64)) // HEAVY)
        rows = scratch.written(prefixes(docs, copies, sketch, most, words, percent), "prefixes")
        met = scratch.written(groups(rows, percent, most), "met")
        dealt, sizes, large = dealt_members(docs, met, scratch)
        alone = F.col("doc_id").alias("known")
        columns = ["deal", "task", "doc_id", "text", F.lit("both").alias("side"), alone]
        plain = dealt.select(*columns)
        if large:
            every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
            chunked = sizes.where("chunks > 1").withColumnRenamed("label", "doc_id")
            hubs = doc_texts(docs).join(F.broadcast(chunked) if chunked.count() <= BROADCAST_ROWS else chunked, "doc_id")
            hubs = hubs.select(F.col("doc_id").alias("task"), every.alias("part"), "doc_id", "text").withColumn("deal", F.concat_ws("/", "task", "part"))
            plain = plain.unionByName(hubs.select(*columns))
        links = scratch.written(tree_join(plain, words, percent), "group-links")
        if large:
            links = links.unionByName(across_chunks(dealt, components(links, scratch), words, percent))
        # copies join what is linked by their representative
        found = components(links, scratch).select(F.col("node").alias("rep"), "root")
        joined = known.join(found, "rep", "left")
        return written(joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep")).alias("component_id")), "components")


def across_chunks(dealt: DataFrame, roots: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between the chunks of large groups: all sets outside a group's largest component, in parts of about CHUNK,
    meet every chunk. Two sets of that component need no link."""
    now = dealt.where("chunks > 1").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("known", F.coalesce("root", "doc_id"))
    counted = now.groupBy("task", "known").count()
    most = counted.groupBy("task").agg(F.max(F.struct("count", -F.col("known"))).alias("m")).select("task", (-F.col("m.col2")).alias("largest"))
    apart = counted.join(most, "task").where("known <> largest").groupBy("task").agg(F.sum("count").alias("left_rows")).select("task", F.ceil(F.col("left_rows") / CHUNK).alias("left_parts"))
    left = now.join(most, "task").where("known <> largest").join(apart, "task").withColumn("left_part", F.pmod(F.xxhash64(F.lit("left"), "doc_id"), F.col("left_parts")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    lefts = left.select("task", F.col("left_part").alias("task_part"), every.alias("other_part"), "doc_id", "text", F.lit("left").alias("side"), "known")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("left_parts") - 1))
    rights = now.join(apart, "task").select("task", each.alias("task_part"), F.col("part").alias("other_part"), "doc_id", "text", F.lit("right").alias("side"), "known")
    return tree_join(lefts.unionByName(rights).withColumn("deal", F.concat_ws("/", "task", "task_part", "other_part")), words, percent)


def one_of_each_group(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, without those that are linked to one of smaller doc_id, directly or through others. Of
    rows with one doc_id, one for each distinct text (null or not) stays: that whose columns, as JSON, hash least; rows without
    doc_id stay."""
    found = similarity_components(docs, words, percent)
    gone = written(found.where("component_id <> doc_id").select("doc_id").distinct(), "linked")
    left = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "doc_id", "left_anti").select(*(F.col(f"`{x}`") for x in docs.columns))
    repeated = written(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return left
    again = left.join(repeated, "doc_id", "left_semi").select(left.columns)
    whole = F.struct(*(F.col(f"`{x}`") for x in left.columns))
    once = again.groupBy("doc_id", "text").agg(F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias("kept_row")).select("kept_row.*")
    return left.join(repeated, "doc_id", "left_anti").select(left.columns).unionByName(once)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; null, empty and repeated texts as in similarity_components."""
    return similarity_components(documents(spark, sf_dir))
