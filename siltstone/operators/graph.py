"""Expansion, activation and merging over typed edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import scoring
from siltstone.functions.text import token_set
from siltstone.sources.shared import HEAVY, Scratch, heavy_split, written

#: Cosine from which two vectors say the same, and rows in a block of the comparison of all pairs.
LEAST_COSINE, BLOCK = 0.92, 2000


def both_ways(edges: DataFrame) -> DataFrame:
    cols = [c for c in edges.columns if c not in ("from_id", "to_id")]
    return edges.unionByName(edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), *cols))


def hops(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """claim_id, hop: the fewest steps from the seeds, at most so many, along edges in either direction."""
    around = both_ways(edges.select("from_id", "to_id"))
    found = seeds.select("claim_id", F.lit(0).alias("hop"))
    front = found
    for hop in range(1, most + 1):
        met = front.select(F.col("claim_id").alias("from_id")).join(around, "from_id").select(F.col("to_id").alias("claim_id")).distinct()
        front = met.join(found, "claim_id", "left_anti").select("claim_id", F.lit(hop).alias("hop"))
        found = found.unionByName(front)
    return found


def activation(edges: DataFrame, seeds: DataFrame, rounds: int = 2, decay: float = 0.5) -> DataFrame:
    """claim_id, activation spread from seeds (claim_id, score): a node sums what reaches it, and passes on the greatest."""
    weighted = both_ways(edges.select("from_id", "to_id", scoring.edge_weight(F.col("type"), F.col("strength")).alias("weight")))
    front = seeds.select(F.col("claim_id").alias("from_id"), F.col("score").alias("energy"))
    total = None
    for _ in range(rounds):
        sent = front.join(weighted, "from_id").select(F.col("to_id").alias("claim_id"), (F.col("energy") * F.col("weight") * decay).alias("energy"))
        total = sent if total is None else total.unionByName(sent)
        front = sent.groupBy(F.col("claim_id").alias("from_id")).agg(F.max("energy").alias("energy"))
    return total.groupBy("claim_id").agg(F.sum("energy").alias("activation"))


# Fixed values of the re-rank by activation: seeds, steps, decay, the activation that counts at most, and its weight.
SEEDS, STEPS, DECAY, MOST_ACTIVE, ACTIVE_WEIGHT = 5, 2, 0.5, 1.0, 0.35


def reranked(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """claim_id, score, rank of a ranked list (claim_id, rank from 1): each has its place as base score; the first SEEDS
    spread activation along edges to claims not reached before, which sum it if they are in the list and pass on the
    greatest. The list and what its seeds reach are small beside the edges."""
    n = ranked.count()
    base = ranked.select("claim_id", "rank", ((n - F.col("rank") + 1) / n).alias("base"))
    weighted = both_ways(edges.select("from_id", "to_id", scoring.edge_weight(F.col("type"), F.col("strength")).alias("weight")))
    front = base.where(F.col("rank") <= SEEDS).select(F.col("claim_id").alias("from_id"), F.col("base").alias("energy"))
    visited, sent = front.select("from_id"), None
    for _ in range(STEPS):
        step = front.join(weighted, "from_id").join(visited.withColumnRenamed("from_id", "to_id"), "to_id", "left_anti").select("to_id", (F.col("energy") * DECAY * F.col("weight")).alias("energy"))
        sent = step if sent is None else sent.unionByName(step)
        front = written(step.groupBy(F.col("to_id").alias("from_id")).agg(F.max("energy").alias("energy")), "front")
        visited = visited.unionByName(front.select("from_id"))
    active = sent.groupBy(F.col("to_id").alias("claim_id")).agg(F.sum("energy").alias("active"))
    scored = base.join(active, "claim_id", "left").withColumn("score", F.col("base") + ACTIVE_WEIGHT * F.least(F.coalesce("active", F.lit(0.0)), F.lit(MOST_ACTIVE)))
    order = Window.orderBy(F.desc(F.round("score", 9)), "rank")
    return scored.withColumn("old_rank", F.col("rank")).withColumn("rank", F.row_number().over(order)).select("claim_id", "score", "rank")


def components(links: DataFrame, keep: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of links (a, b) but the least of each component, which is the root: large-star and
    small-star steps until nothing changes. A round's links are written to the shared folder and the round before is
    deleted, and the result goes to `keep` if given; only a count and a sum of hashes come to the driver."""
    with Scratch(links.sparkSession, "links") as scratch:
        now = scratch.written(links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct(), "links")
        seen = None
        while True:
            state = now.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
            if state == seen:
                return (keep.written if keep else written)(now, "components")
            seen = state
            both = now.select("node", F.col("root").alias("other")).unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("other")))
            least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("least"))
            large = both.where("other > node").join(least, "node").select(F.col("other").alias("node"), F.col("least").alias("root")).where("node <> root").distinct()
            low = large.groupBy("node").agg(F.min("root").alias("least"))
            small = large.join(low, "node")
            new = small.select("node", F.col("least").alias("root")).unionByName(small.where("root <> least").select(F.col("root").alias("node"), F.col("least").alias("root")))
            now = scratch.replaced(new.distinct(), "links")


def similar_pairs(vectors: DataFrame, least: float = LEAST_COSINE, group: str | None = None, block: int = BLOCK) -> DataFrame:
    """a, b, score of vectors (vec_id, embedding) with cosine at least so much: all pairs, or with a group those within it.
    Rows are dealt to numbered blocks of about `block`, and each pair of blocks is one task's matrix product."""
    if group is not None:
        a = vectors.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), group)
        b = vectors.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"), group)
        return a.join(b, group).where("a < b").select("a", "b", scoring.cosine(F.col("x"), F.col("y")).alias("score")).where(F.col("score") >= least)
    n = -(-max(1, vectors.count()) // block)
    own = vectors.where("embedding is not null and vec_id is not null").select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("own"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    dealt = dealt.select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "vec_id", "embedding")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        p, q = key
        sides = []
        for side in (p, q):
            rows = part[part["own"] == side]
            m = np.array(rows["embedding"].tolist(), np.float64).reshape(len(rows), -1)
            size = np.sqrt((m * m).sum(axis=1, keepdims=True))
            sides.append((rows["vec_id"].to_numpy(np.int64), np.divide(m, size, out=np.zeros_like(m), where=size > 0)))
        (x, u), (y, v) = sides
        if not len(x) or not len(y):
            return pd.DataFrame({"a": x[:0], "b": x[:0], "score": np.zeros(0)})
        scores = u @ v.T
        hit = (scores >= least) & ((x[:, None] < y[None, :]) if p == q else (x[:, None] != y[None, :]))
        i, j = np.nonzero(hit)
        return pd.DataFrame({"a": np.minimum(x[i], y[j]), "b": np.maximum(x[i], y[j]), "score": scores[i, j]})

    return dealt.groupBy("p", "q").applyInPandas(run, "a long, b long, score double")


def winners(claims: DataFrame, roots: DataFrame) -> DataFrame:
    """old_id, new_id: every merged claim's survivor, by greatest trust, then earliest, then least id."""
    members = claims.join(roots.select(F.col("node").alias("claim_id"), "root").unionByName(roots.select(F.col("root").alias("claim_id"), "root").distinct()), "claim_id")
    w = Window.partitionBy("root").orderBy(F.desc("trust"), "created_at", "claim_id")
    best = members.select("claim_id", F.first("claim_id").over(w).alias("new_id"))
    return best.where("claim_id <> new_id").select(F.col("claim_id").alias("old_id"), "new_id")


def jaccard(a: str, b: str) -> Column:
    """Of two sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def recombinations(claims: DataFrame, edges: DataFrame, least: float = 0.34, worth: float = 0.5, candidates: int = 400) -> DataFrame:
    """a, b, similarity of live claims of worth that share words but no edge: among the most salient ones, whose number is
    the feature's bound, so that their pairs are few."""
    sal = scoring.salience(F.col("confidence"), F.col("event_count"), F.col("type"), F.col("source_authority"), F.col("verify_count"))
    best = claims.where(F.col("valid_to").isNull()).select("claim_id", token_set(F.col("text")).alias("words"), sal.alias("salience")).where(F.col("salience") >= worth)
    best = written(best.orderBy(F.desc(F.round("salience", 9)), "claim_id").limit(candidates).drop("salience"), "candidates")
    tokens = best.select("claim_id", "words", F.explode("words").alias("word"))
    a = tokens.select(F.col("claim_id").alias("a"), F.col("words").alias("x"), "word")
    b = tokens.select(F.col("claim_id").alias("b"), F.col("words").alias("y"), "word")
    pairs = a.join(b, "word").where("a < b").dropDuplicates(["a", "b"]).select("a", "b", jaccard("x", "y").alias("similarity")).where(F.col("similarity") >= least)
    known = edges.select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b"))
    return pairs.join(known, ["a", "b"], "left_anti")


# How far a claim's neighbourhood reaches, and from which likeness two are analogous.
NEIGHBOURHOOD_HOPS, LEAST_ANALOGY = 2, 0.5


#: Components of at most so many edges are decided by one task each.
IN_A_TASK = 200_000


def to_neighbours(ends: DataFrame, values: DataFrame, most: int) -> DataFrame:
    """ends (node, other) with the values of node (node, k, ...), of which k is the number of its ends; nodes of more than
    `most` ends by broadcast, as few can have so many."""
    return heavy_split(ends, "node", values, most)


def representatives(edges: DataFrame, nodes: DataFrame, scratch: Scratch, in_a_task: int = IN_A_TASK) -> DataFrame:
    """node of those taken when nodes (node, degree) are taken by falling degree, then id, and each within
    NEIGHBOURHOOD_HOPS = 2 steps of one taken before is left out. No pair of nodes is made: in a round each node hears the
    first undecided node within two steps by passing minima along edges twice, is taken if that is itself, and what is near
    a taken one goes. Small components are decided by one task each, so long chains there cost no rounds."""
    ends = scratch.written(both_ways(edges.select("from_id", "to_id").where("from_id <> to_id")).distinct().toDF("node", "other"), "ends")
    most = max(1, ends.count() // HEAVY)
    sizes = ends.groupBy("node").agg(F.count("*").alias("k"))
    roots = components(ends.where("node < other").toDF("a", "b"), scratch)
    roots = scratch.written(sizes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    large = roots.groupBy("root").agg(F.sum("k").alias("ends")).where(F.col("ends") > 2 * in_a_task).select("root")
    known = roots.join(nodes, "node", "left").select("node", "k", "root", "degree")
    alone = nodes.select("node").join(sizes, "node", "left_anti")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        around: dict[int, list[int]] = {}
        degree: dict[int, int] = {}
        for n, other, d in zip(part["node"].tolist(), part["other"].tolist(), part["degree"].tolist(), strict=True):
            around.setdefault(n, []).append(other)
            if d >= 0:
                degree[n] = int(d)
        taken, near = [], set()
        for n in sorted(degree, key=lambda x: (-degree[x], x)):
            if n not in near:
                taken.append(n)
                near.add(n)
                near.update(around[n])
                for other in around[n]:
                    near.update(around[other])
        return pd.DataFrame({"node": taken}, dtype="int64")

    small = to_neighbours(ends, known.join(large, "root", "left_anti").withColumn("degree", F.coalesce("degree", F.lit(-1).cast("long"))), most)
    taken = scratch.written(alone.unionByName(small.groupBy("root").applyInPandas(run, "node long")), "taken")
    state = scratch.written(known.join(large, "root", "left_semi").select("node", "k", F.when(F.col("degree").isNotNull(), F.struct((-F.col("degree")).alias("d"), F.col("node").alias("id"))).alias("first")), "state")
    while not state.where("first is not null").isEmpty():
        heard = state
        for _ in range(NEIGHBOURHOOD_HOPS):
            heard = scratch.written(heard, "heard")
            met = to_neighbours(ends, heard.where("first is not null").select("node", "k", "first"), most).groupBy(F.col("other").alias("node")).agg(F.min("first").alias("met"))
            heard = heard.join(met, "node", "left").select("node", "k", F.least("first", "met").alias("first"))
        new = scratch.written(heard.where("first.id = node").select("node", "k"), "new")
        gone = new
        for _ in range(NEIGHBOURHOOD_HOPS):
            gone = scratch.written(gone, "gone")
            reached = to_neighbours(ends, gone, most).select(F.col("other").alias("node"))
            gone = gone.select("node").unionByName(reached).distinct().join(state.select("node", "k"), "node")
        taken = taken.unionByName(new.select("node"))
        left = state.join(gone.select("node", F.lit(True).alias("gone")), "node", "left")
        state = scratch.written(left.select("node", "k", F.when(F.col("gone").isNull(), F.col("first")).alias("first")), "state")
    return scratch.written(taken, "taken")


def neighbourhoods(edges: DataFrame, seeds: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(seed, node) within NEIGHBOURHOOD_HOPS of each seed (claim_id), itself included, and (seed, from_id, to_id, type) of
    the edges passed on the way: those at a node nearer than the last hop. Of seeds more than two steps apart no node is next
    to two, so both frames have at most two rows for each edge, besides a row for each seed."""
    own = edges.select("from_id", "to_id", "type").distinct()
    ends = own.select(F.col("from_id").alias("node"), F.col("to_id").alias("other"), "from_id", "to_id", "type").unionByName(own.select(F.col("to_id").alias("node"), F.col("from_id").alias("other"), "from_id", "to_id", "type"))
    ends = scratch.written(ends, "ends")
    sizes = ends.groupBy("node").agg(F.count("*").alias("k"))
    most = max(1, ends.count() // HEAVY)
    nodes = seeds.select(F.col("claim_id").alias("seed"), F.col("claim_id").alias("node")).distinct()
    for _ in range(NEIGHBOURHOOD_HOPS):
        passed = scratch.written(to_neighbours(ends, nodes.join(sizes, "node"), most), "passed")
        nodes = scratch.written(nodes.unionByName(passed.select("seed", F.col("other").alias("node"))).distinct(), "nodes")
    return nodes, passed.select("seed", "from_id", "to_id", "type").distinct()


def fingerprints(nodes: DataFrame, passed: DataFrame, roles: DataFrame, scratch: Scratch) -> DataFrame:
    """seed, label, n: how often each label occurs in a seed's neighbourhood. A node's labels are its role (claim_id, role;
    unknown without one), then twice a hash of the label before and of the types and labels of its neighbours. Those are
    hashed one by one and added up (two sums of 64-bit hashes), so a hub's neighbours are summed in parts before they meet."""
    ends = scratch.written(passed.select("seed", F.col("from_id").alias("node"), F.col("to_id").alias("other"), "type").unionByName(passed.select("seed", F.col("to_id").alias("node"), F.col("from_id").alias("other"), "type")), "ends")
    sizes = ends.groupBy("seed", "node").agg(F.count("*").alias("k"))
    most = max(1, ends.count() // HEAVY)
    labels = nodes.join(roles.withColumnRenamed("claim_id", "node"), "node", "left").select("seed", "node", F.coalesce("role", F.lit("unknown")).alias("label"))
    labels = scratch.written(labels.join(sizes, ["seed", "node"], "left"), "labels")
    every = labels.select("seed", "label")
    for _ in range(2):
        told = heavy_split(ends, ["seed", "node"], labels.where("k is not null"), most)
        sums = [F.sum(F.xxhash64(F.lit(salt), "type", "label").cast("decimal(20,0)")).alias(f"sum{salt}") for salt in (1, 2)]
        tags = told.groupBy("seed", F.col("other").alias("node")).agg(F.count("*").alias("n"), *sums)
        tag = F.concat_ws(":", F.col("n").cast("string"), F.col("sum1").cast("string"), F.col("sum2").cast("string"))
        labels = scratch.written(labels.join(tags, ["seed", "node"], "left").select("seed", "node", F.sha2(F.concat_ws("#", "label", F.coalesce(tag, F.lit(""))), 256).alias("label"), "k"), "labels")
        every = every.unionByName(labels.select("seed", "label"))
    return every.groupBy("seed", "label").agg(F.count("*").alias("n"))


def analogies(edges: DataFrame, roles: DataFrame, anchor: int, limit: int = 10) -> DataFrame:
    """claim_id, similarity of the claims whose neighbourhoods are most like the anchor's in structure. Claims are taken by
    falling degree, then id; one inside the neighbourhood of a claim taken before, or of the anchor, is represented by it.
    Representatives are chosen first and only their neighbourhoods are built, so work grows with the edges. An anchor without
    edges is like nothing."""
    spark = edges.sparkSession
    with Scratch(spark, "analogies") as scratch:
        own_edges = scratch.written(edges.select("from_id", "to_id", "type").distinct(), "edges")
        degree = own_edges.select(F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        near, near_edges = neighbourhoods(own_edges, spark.createDataFrame([(anchor,)], "claim_id long"), scratch)
        own = scratch.written(fingerprints(near, near_edges, roles, scratch), "own")
        taken = representatives(own_edges, degree.join(near.select("node"), "node", "left_anti"), scratch)
        nodes, passed = neighbourhoods(own_edges, taken.select(F.col("node").alias("claim_id")), scratch)
        theirs = scratch.written(fingerprints(nodes, passed, roles, scratch), "theirs")
        counts = theirs.groupBy("label").agg(F.count("*").alias("k"))
        shared = heavy_split(theirs, "label", own.select("label", F.col("n").alias("own_n")).join(counts, "label"), max(1, theirs.count() // HEAVY))
        dot = shared.groupBy("seed").agg(F.sum(F.col("n") * F.col("own_n")).alias("dot"))
        norm = theirs.groupBy("seed").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
        own_norm = own.agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("own_norm"))
        x = dot.join(norm, "seed").join(F.broadcast(own_norm), F.lit(True)).select(F.col("seed").alias("claim_id"), (F.col("dot") / (F.col("norm") * F.col("own_norm"))).alias("similarity"))
        return written(x.where(F.col("similarity") >= LEAST_ANALOGY).orderBy(F.desc(F.round("similarity", 9)), "claim_id").limit(limit), "analogies")
