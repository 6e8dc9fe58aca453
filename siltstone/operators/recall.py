"""Recall of claims for many questions at once, and what controls it: sufficiency, effort, correction, conflicts, rounds."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import scoring
from siltstone.functions.text import intent, token_set
from siltstone.operators import graph, retrieval
from siltstone.operators.admission import Admission, admit
from siltstone.sources.shared import written

# The confidence that suffices, effort, activation by context, rounds, and events that an answer rests on.
FLOOR, ESCALATE, MORE_HOPS, MORE_CLAIMS = 0.35, 0.3, 2, 10
CONTEXT_HOPS, CONTEXT_DECAY, CONTEXT_BOOST, ROUNDS, EVENTS = 2, 0.5, 3.0, 3, 5


@dataclass
class Store:
    """The frames that recall reads: postings or word index of events and of claims (event_id is the claim) and their sizes, claims with
    trust, evidence, edges, and vectors of claims (claim_id, embedding) where there are any."""

    postings: DataFrame
    sizes: DataFrame
    claim_postings: DataFrame
    claim_sizes: DataFrame
    claims: DataFrame
    evidence: DataFrame
    edges: DataFrame
    claim_vectors: DataFrame | None = None


@dataclass
class Options:
    now: Column
    min_trust: float = 0.0
    limit: int = 10
    hops: int = 0
    salient: bool = False


def with_hops(edges: DataFrame, found: DataFrame, hops: int | Column, most: int) -> DataFrame:
    """question_id, claim_id, hop: the fewest steps from each question's claims, at most `hops` (of that question)."""
    around = graph.both_ways(edges.select("from_id", "to_id"))
    every = found.select("question_id", "claim_id", F.lit(0).alias("hop"))
    limit = found.select("question_id", (F.lit(hops) if isinstance(hops, int) else hops).alias("most_hops")).distinct()
    front = every
    for hop in range(1, most + 1):
        go_on = front.join(limit.where(F.col("most_hops") >= hop), "question_id", "left_semi")
        met = go_on.select("question_id", F.col("claim_id").alias("from_id")).join(around, "from_id").select("question_id", F.col("to_id").alias("claim_id")).distinct()
        front = met.join(every, ["question_id", "claim_id"], "left_anti").withColumn("hop", F.lit(hop))
        every = every.unionByName(front)
    return every


def relevance(s: Store, candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, claim_id, relevance of candidates (question_id, claim_id): BM25 over all claims by the best claim of the
    question, and with vectors of claims and of questions (column vector) the cosine by the best of its candidates; half of
    each where a question has both, else the one that it has. Null without either."""
    asked = questions.select("question_id", "question")
    tops = retrieval.bm25_by_index(s.claim_postings, s.claim_sizes, asked, best=1).groupBy("question_id").agg(F.max("score").alias("top"))
    words = retrieval.bm25_of_pairs(s.claim_postings, s.claim_sizes, asked, candidates.withColumnRenamed("claim_id", "event_id")).withColumnRenamed("event_id", "claim_id")
    x = candidates.join(words, ["question_id", "claim_id"], "left").join(tops, "question_id", "left").withColumn("by_words", F.coalesce("score", F.lit(0.0)) / F.col("top")).drop("score")
    if s.claim_vectors is None or "vector" not in questions.columns:
        return x.select("question_id", "claim_id", F.col("by_words").alias("relevance"))
    near = candidates.join(s.claim_vectors, "claim_id").join(questions.select("question_id", "vector"), "question_id")
    near = written(near.select("question_id", "claim_id", scoring.cosine(F.col("embedding"), F.col("vector")).alias("cosine")), "cosines")
    x = x.join(near, ["question_id", "claim_id"], "left").join(near.groupBy("question_id").agg(F.max("cosine").alias("most")).where("most > 0"), "question_id", "left")
    by_vectors = F.coalesce("cosine", F.lit(0.0)) / F.col("most")
    both = 0.5 * F.col("by_words") + 0.5 * by_vectors
    return x.select("question_id", "claim_id", F.coalesce(both, "by_words", by_vectors).alias("relevance"))


def recall(s: Store, questions: DataFrame, o: Options) -> DataFrame:
    """question_id, claim_id, text, trust, hop, created_at, rank of the admitted claims of each question's best EVENTS events,
    and of the admitted ones within o.hops steps of those. The events' own claims come first: those of the kind that the
    question asks for, then by `relevance` (with salience if o.salient, and less what inhibits them), then the older, then id;
    those reached by steps come after, by trust, then id. questions: question_id, question, and where it has them limit, hops
    and vector of its own."""
    scores = retrieval.bm25_by_index(s.postings, s.sizes, questions, best=EVENTS)
    top = retrieval.top_k(scores, "question_id", "event_id", EVENTS)
    gate = Admission(o.now, min_trust=o.min_trust)
    found = top.join(s.evidence, "event_id").select("question_id", "claim_id").distinct()
    found = written(admit(found.join(s.claims, "claim_id"), gate).select("question_id", "claim_id"), "direct")
    own_hops = "hops" in questions.columns
    asked = questions.select("question_id", intent(F.col("question")).alias("wanted"), F.coalesce(F.col("limit") if "limit" in questions.columns else F.lit(None), F.lit(o.limit)).alias("most"))
    most_hops = (questions.agg(F.max("hops")).first()[0] or 0) if own_hops else o.hops
    ranks = relevance(s, found, questions)
    if most_hops:
        hops = found.join(questions.select("question_id", "hops"), "question_id") if own_hops else found
        found = with_hops(s.edges, hops, F.col("hops") if own_hops else o.hops, most_hops)
    else:
        found = found.withColumn("hop", F.lit(0))
    x = admit(found.join(s.claims, "claim_id"), gate).join(ranks, ["question_id", "claim_id"], "left").join(asked, "question_id")
    components = F.col("components") if "components" in s.claims.columns else None
    salience = scoring.explicit_salience(components) if o.salient and components is not None else None
    score = retrieval.claim_score(F.col("relevance"), salience, scoring.inhibition(components) if components is not None else None)
    direct = F.col("hop") == 0
    place = [F.when(direct, (F.col("type") == F.col("wanted")).cast("int")), F.when(direct, F.round(score, 9)), F.when(~direct, F.round("trust", 9))]
    x = x.withColumns({"fits": F.coalesce(place[0], F.lit(0)), "score": place[1], "far_trust": place[2], "oldest": F.when(direct, F.col("created_at"))})
    order = Window.partitionBy("question_id").orderBy("hop", F.desc("fits"), F.desc("score"), F.desc("far_trust"), "oldest", "claim_id")
    ranked = x.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= F.col("most")).select("question_id", "claim_id", "text", "trust", "hop", "created_at", "rank")


def confidences(s: Store, results: DataFrame, questions: DataFrame, now: Column) -> DataFrame:
    """question_id, claims, confidence, sufficient of every question: trust, number and age of its claims, less for
    contradictions among them; sufficient with a claim and FLOOR."""
    hours = F.greatest(scoring.days_between(F.col("created_at"), now) * 24, F.lit(0.0))
    a, b = (results.select("question_id", F.col("claim_id").alias(f"{end}_id")) for end in ("from", "to"))
    against = a.join(s.edges.where("type = 'contradicts'").select("from_id", "to_id"), "from_id").join(b, ["question_id", "to_id"]).groupBy("question_id").agg(F.count("*").alias("contradictions"))
    g = results.groupBy("question_id").agg(F.count("*").alias("claims"), F.avg("trust").alias("trust"), F.avg(1 - F.least(hours / 720, F.lit(1.0))).alias("recent")).join(against, "question_id", "left")
    value = 0.4 * F.col("trust") + 0.2 * F.least(F.col("claims") / 5.0, F.lit(1.0)) - F.least(0.1 * F.coalesce("contradictions", F.lit(0)), F.lit(0.3)) + 0.1 * F.col("recent")
    out = questions.select("question_id").join(g, "question_id", "left")
    confidence = F.when(F.col("claims").isNull(), 0.0).otherwise(scoring.clamp01(value))
    out = out.select("question_id", F.coalesce("claims", F.lit(0)).alias("claims"), confidence.alias("confidence"))
    return out.withColumn("sufficient", (F.col("claims") > 0) & (F.col("confidence") >= FLOOR))


def stronger(claims: Column, confidence: Column, before_claims: Column, before_confidence: Column) -> Column:
    """Whether a second answer replaces the first: never an empty one; more claims, then greater confidence."""
    return (claims > 0) & ((before_claims == 0) | (claims > before_claims) | ((claims == before_claims) & (confidence > before_confidence)))


def better_of(first: DataFrame, first_graded: DataFrame, second: DataFrame, second_graded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results and grades with the second pass where it is the stronger one."""
    b = first_graded.select("question_id", F.col("claims").alias("before"), F.col("confidence").alias("confidence_before"))
    won = second_graded.join(b, "question_id").where(stronger(F.col("claims"), F.col("confidence"), F.col("before"), F.col("confidence_before"))).select("question_id")
    won = written(won, "stronger")

    def merged(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.join(won, "question_id", "left_anti").unionByName(y.join(won, "question_id", "left_semi"))

    return merged(first, second), merged(first_graded, second_graded)


def corrected(s: Store, questions: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """Recall, and for questions that it answers insufficiently once more without the least trust, kept where stronger."""
    first = written(recall(s, questions, o), "recalled")
    graded = written(confidences(s, first, questions, o.now), "graded")
    weak = questions.join(graded.where("not sufficient"), "question_id", "left_semi")
    if o.min_trust <= 0:
        return first, graded
    second = written(recall(s, weak, replace(o, min_trust=0.0)), "recalled")
    return better_of(first, graded, second, confidences(s, second, weak, o.now))


def with_effort(s: Store, questions: DataFrame, o: Options, stakes: float) -> tuple[DataFrame, DataFrame]:
    """Recall, and one wider and deeper pass for insufficient questions whose budget (stakes times doubt) is worth it. The
    grades have budget, passes, and the hops and breadth of the pass that was kept."""
    first = written(recall(s, questions, o), "recalled")
    graded = written(confidences(s, first, questions, o.now), "graded")
    budget = scoring.clamp01(F.lit(stakes)) * (1 - F.col("confidence"))
    g = graded.withColumn("budget", budget).withColumn("more", (F.col("budget") >= ESCALATE) & ~F.col("sufficient"))
    deeper = F.lit(o.hops) + F.ceil(F.col("budget") * MORE_HOPS).cast("int")
    wider = F.lit(o.limit) + F.round(F.col("budget") * MORE_CLAIMS).cast("int")
    again = written(questions.join(g.where("more").select("question_id", deeper.alias("hops"), wider.alias("limit")), "question_id"), "again")
    second = written(recall(s, again, o), "recalled")
    results, kept = better_of(first, graded, second, confidences(s, second, again, o.now))
    used = again.select("question_id", F.col("hops").alias("tried_hops"), F.col("limit").alias("tried_limit"))
    same = graded.select("question_id", F.col("confidence").alias("first_confidence"), F.col("claims").alias("first_claims"))
    x = kept.join(g.select("question_id", "budget", "more"), "question_id").join(used, "question_id", "left").join(same, "question_id")
    adopted = F.col("more") & ((F.col("claims") != F.col("first_claims")) | (F.col("confidence") != F.col("first_confidence")))
    return results, x.select("question_id", "claims", "confidence", "sufficient", "budget", F.when(F.col("more"), 2).otherwise(1).alias("passes"), F.when(adopted, F.col("tried_hops")).otherwise(o.hops).alias("hops"), F.when(adopted, F.col("tried_limit")).otherwise(o.limit).alias("breadth"))


def with_context(s: Store, results: DataFrame, context: DataFrame) -> DataFrame:
    """Results ranked anew: each keeps its place, and claims within CONTEXT_HOPS of the context's claims (question_id,
    claim_id) rise by up to CONTEXT_BOOST places, less with each step."""
    near = with_hops(s.edges, context, CONTEXT_HOPS, CONTEXT_HOPS).select("question_id", "claim_id", F.pow(F.lit(CONTEXT_DECAY), F.col("hop")).alias("active"))
    n = F.count("*").over(Window.partitionBy("question_id"))
    x = results.withColumn("place", n - F.col("rank") + 1).join(near, ["question_id", "claim_id"], "left")
    score = F.col("place") + CONTEXT_BOOST * F.coalesce("active", F.lit(0.0))
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "old_rank")
    return x.withColumn("score", score).withColumnRenamed("rank", "old_rank").withColumn("rank", F.row_number().over(order)).select("question_id", "claim_id", "rank", "score")


def conflicts(s: Store, results: DataFrame) -> DataFrame:
    """question_id, claim_id, against_id, against_trust: for each recalled claim the claims that contradict it and were
    recalled too or are valid and not superseded. Each pair once, of whatever direction its edges have."""
    e = s.edges.where("type = 'contradicts'").select("from_id", "to_id")
    both = e.unionByName(e.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))).distinct()
    x = results.select("question_id", F.col("claim_id").alias("from_id")).join(both, "from_id")
    recalled = results.select("question_id", F.col("claim_id").alias("to_id"), F.col("trust").alias("recalled_trust"))
    valid = s.claims.where(F.col("valid_to").isNull() & (F.col("lifecycle") != "superseded")).select(F.col("claim_id").alias("to_id"), F.col("trust").alias("valid_trust"))
    x = x.join(recalled, ["question_id", "to_id"], "left").join(valid, "to_id", "left").withColumn("against_trust", F.coalesce("recalled_trust", "valid_trust"))
    return x.where("against_trust is not null").select("question_id", F.col("from_id").alias("claim_id"), F.col("to_id").alias("against_id"), "against_trust")


def iterative(s: Store, questions: DataFrame, o: Options, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Recall in rounds: while a question is insufficient and a round brought new claims, the words of its best new claim
    are added to it and it reaches one step further. All claims found, by trust; and the rounds of each question."""
    seen, took = None, None
    now = written(questions.select("question_id", "question", F.lit(o.hops).alias("hops")), "asked")
    for n in range(1, rounds + 1):
        found = written(recall(s, now, o), "recalled")
        graded = confidences(s, found, now, o.now)
        new = found if seen is None else found.join(seen, ["question_id", "claim_id"], "left_anti")
        new = written(new, "new-claims")
        count = now.select("question_id", F.lit(n).alias("rounds"))
        took = count if took is None else took.unionByName(count)
        rows = new.select("question_id", "claim_id", "text", "trust")
        seen = rows if seen is None else seen.unionByName(rows)
        best = new.groupBy("question_id").agg(F.min_by("text", "rank").alias("best"))
        go_on = now.join(graded.where("not sufficient"), "question_id", "left_semi").join(best, "question_id")
        more = F.array_except(F.array_sort(token_set(F.col("best"))), token_set(F.col("question")))
        now = written(go_on.select("question_id", F.concat_ws(" ", "question", F.array_join(more, " ")).alias("question"), (F.col("hops") + 1).alias("hops")), "asked")
        if n == rounds or now.isEmpty():
            break
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("trust", 9)), "claim_id")
    return seen.withColumn("rank", F.row_number().over(order)), took.groupBy("question_id").agg(F.max("rounds").alias("rounds"))


def classified(graded: DataFrame, results: DataFrame) -> DataFrame:
    """question_id, kind, anchor_id, confidence: `fits` with the best claim where what is known suffices, else `novel`."""
    best = results.where("rank = 1").select("question_id", F.col("claim_id").alias("anchor_id"))
    x = graded.join(best, "question_id", "left")
    fits = F.col("sufficient") & F.col("anchor_id").isNotNull()
    return x.select("question_id", F.when(fits, "fits").otherwise("novel").alias("kind"), F.when(fits, F.col("anchor_id")).alias("anchor_id"), "confidence")


def answer_texts(s: Store, results: DataFrame, questions: DataFrame, origins: DataFrame) -> DataFrame:
    """question_id, answer: the best two claims of each question with where they come from, how many contradictions are
    among its claims, and what was used; or that there is none."""
    own = results.join(origins, "claim_id", "left").withColumn("remote", F.coalesce(F.col("origin") != "local", F.lit(False)))
    named = F.concat("text", F.when(F.col("remote"), F.concat(F.lit(" (from "), "origin", F.lit(")"))).otherwise(""))
    a, b = (results.select("question_id", F.col("claim_id").alias(f"{end}_id")) for end in ("from", "to"))
    against = a.join(s.edges.where("type = 'contradicts'").select("from_id", "to_id"), "from_id").join(b, ["question_id", "to_id"]).groupBy("question_id").agg(F.count("*").alias("contradictions"))
    events = results.select("question_id", "claim_id").join(s.evidence, "claim_id").select("question_id", "event_id").distinct().groupBy("question_id").agg(F.count("*").alias("events"))
    g = own.groupBy("question_id").agg(F.max(F.when(F.col("rank") == 1, named)).alias("first"), F.max(F.when(F.col("rank") == 2, named)).alias("second"), F.count("*").alias("claims"), F.count_if("remote").alias("remote"))
    x = questions.select("question_id", "question").join(g, "question_id", "left").join(against, "question_id", "left").join(events, "question_id", "left")
    n = F.coalesce("contradictions", F.lit(0))
    parts = F.concat_ws(
        " ", F.concat(F.lit('For "'), "question", F.lit('", the strongest signal is: '), "first", F.lit(".")), F.concat(F.lit("Other relevant claim: "), "second", F.lit(".")),
        F.when(n > 0, F.concat(F.lit("I also found "), n.cast("string"), F.lit(" contradiction(s), so this topic is contested."))).otherwise("No contradictions were found in the current claim set."),
        F.concat(F.lit("Context used "), F.coalesce("events", F.lit(0)).cast("string"), F.lit(" event(s) and "), F.col("claims").cast("string"), F.lit(" claim(s)"), F.when(F.col("remote") > 0, F.concat(F.lit(" ("), F.col("remote").cast("string"), F.lit(" from a connected registry)"))).otherwise(""), F.lit(".")),
    )
    none = F.concat(F.lit('I could not find claims yet for "'), "question", F.lit('".'))
    return x.select("question_id", F.when(F.col("claims").isNull(), none).otherwise(parts).alias("answer"))
