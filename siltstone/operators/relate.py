"""Typed relations between statements, found by shared words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.detect import denied
from siltstone.functions.text import NEGATIONS, STOP_WORDS, citation_refs, content_tokens, dedup_key, doc_tokens, stem
from siltstone.sources.shared import HEAVY, heavy_split, written

# Shared words, their share of the shorter and of the longer statement.
LEAST_SHARED, SHORTER_SHARE, CONTRADICT_SHARE, LONGER_SHARE = 2, 0.3, 0.5, 0.3


#: A word that more statements hold is dealt out in cells of about so many, each meeting each.
CELL = 2000


def pairs_sharing(left: DataFrame, right: DataFrame, least: int, share: float, cell: int = CELL) -> DataFrame:
    """a, b, shared, size_a, size_b of sets (claim_id, words) that share at least `least` words and that share of the smaller
    set; of one frame with itself each pair once, a < b. Sets are lists of word numbers, rarest first. A pair that must share
    s words has its first one among all but the last s - 1 of either list, so entries too near an end meet nothing; a pair
    comes from its first shared word alone, with both lists beside it, and is counted there. A word's entries are dealt out in
    cells on both sides, so that no task holds more than a cell of each, however frequent the word."""
    same = left is right
    frames = [x.where(F.size("words") >= least).select("claim_id", F.array_distinct("words").alias("words")) for x in ([left] if same else [left, right])]
    held = [x.select("claim_id", F.explode("words").alias("word")) for x in frames]
    every = held[0] if same else held[0].unionByName(held[1])
    words = written(every.groupBy("word").agg(F.count("*").alias("k")).select("word", "k", F.monotonically_increasing_id().alias("w")), "words")
    most = max(1000, (words.agg(F.sum("k")).first()[0] or 0) // HEAVY)

    def ordered(x: DataFrame) -> DataFrame:
        """claim_id, n, ws (its words' numbers, rarest first), and for each of them pos, w, cells."""
        rows = heavy_split(x, "word", words, most).groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("k", "w"))).alias("by_k"))
        rows = rows.select("claim_id", F.size("by_k").alias("n"), F.transform("by_k", lambda w: w["w"]).alias("ws"), F.posexplode("by_k").alias("pos", "at"))
        return rows.select("claim_id", "n", "ws", "pos", "at.w", F.ceil(F.col("at.k") / cell).cast("int").alias("cells"))

    entries = [ordered(x) for x in held]
    n, pos = F.col("n"), F.col("pos")
    need = F.greatest(F.ceil(n * share - 1e-9), F.lit(least))
    mine, each = F.pmod(F.xxhash64("claim_id"), F.col("cells")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1))

    def met(short: DataFrame, long: DataFrame, s: str, t: str) -> DataFrame:
        """Pairs whose set from `short` is the smaller one; of equal sizes the one of lesser id, if the frames are one."""
        heads = short.where(pos <= n - need).select(F.col("claim_id").alias(s), n.alias(f"size_{s}"), need.alias("need"), F.col("ws").alias(f"ws_{s}"), "w", mine.alias("short_cell"), each.alias("long_cell"))
        others = long.where(pos <= n - least).select(F.col("claim_id").alias(t), n.alias(f"size_{t}"), (n - pos).alias("after"), F.col("ws").alias(f"ws_{t}"), "w", mine.alias("long_cell"), each.alias("short_cell"))
        smaller = F.col(f"size_{s}") < F.col(f"size_{t}")
        # of two frames, pairs of equal sizes come from the first way
        first = smaller | ((F.col(f"size_{s}") == F.col(f"size_{t}")) & ((F.col(s) < F.col(t)) if same else F.lit(s == "a")))
        both = heads.join(others, ["w", "short_cell", "long_cell"]).where(first & (F.col("after") >= F.col("need")) & (F.col(s) != F.col(t)))
        common = both.select("a", "b", "size_a", "size_b", "w", "need", F.array_intersect("ws_a", "ws_b").alias("common"))
        return common.where((F.get("common", F.lit(0)) == F.col("w")) & (F.size("common") >= F.col("need"))).select("a", "b", F.size("common").alias("shared"), "size_a", "size_b")

    if not same:
        return met(entries[0], entries[1], "a", "b").unionByName(met(entries[1], entries[0], "b", "a"))
    pairs = met(entries[0], entries[0], "a", "b")
    turned = F.col("a") > F.col("b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", F.when(turned, F.col("size_b")).otherwise(F.col("size_a")).alias("size_a"), F.when(turned, F.col("size_a")).otherwise(F.col("size_b")).alias("size_b"))


def overlap_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, shared, size_a, size_b of statements (claim_id, text) that share at least LEAST_SHARED words and the share of
    the shorter one; of one frame with itself each pair once, a < b."""
    l = left.select("claim_id", content_tokens(F.col("text")).alias("words"))
    r = l if left is right else right.select("claim_id", content_tokens(F.col("text")).alias("words"))
    return pairs_sharing(l, r, LEAST_SHARED, SHORTER_SHARE)


def relation_type(shared: Column, size_a: Column, size_b: Column, opposite: Column) -> Column:
    """supports for equal polarity; contradicts for opposite with enough in common; else null."""
    close = (shared / F.least(size_a, size_b) >= CONTRADICT_SHARE) & (shared / F.greatest(size_a, size_b) >= LONGER_SHARE)
    return F.when(~opposite, "supports").when(close, "contradicts")


def relations(left: DataFrame, right: DataFrame, incremental: bool = False) -> DataFrame:
    """from_id, to_id, type between statements of left and right; each pair once if they are the same frame."""
    pairs = overlap_pairs(left, right)
    if not incremental:
        pairs = pairs.where("a < b")
    polarity = left.unionByName(right).select("claim_id", denied(F.col("text")).alias("neg")).distinct()
    x = pairs.join(polarity.select(F.col("claim_id").alias("a"), F.col("neg").alias("neg_a")), "a").join(polarity.select(F.col("claim_id").alias("b"), F.col("neg").alias("neg_b")), "b")
    x = x.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), relation_type(F.col("shared"), F.col("size_a"), F.col("size_b"), F.col("neg_a") != F.col("neg_b")).alias("type"))
    return x.where("type is not null")


def causal_pairs(causes: DataFrame, effects: DataFrame, hours: int = 48) -> DataFrame:
    """a, b of rows (id, grp, ts) of one group where the effect follows within so many hours: an equi-join on the group
    and on buckets of that width, then the exact range, so no bucket meets more than its neighbour."""
    width = hours * 3600
    a = causes.select(F.col("id").alias("a"), "grp", F.unix_micros("ts").alias("ta")).withColumn("bucket", F.explode(F.array(F.floor(F.col("ta") / 1e6 / width), F.floor(F.col("ta") / 1e6 / width) + 1)))
    b = effects.select(F.col("id").alias("b"), "grp", F.unix_micros("ts").alias("tb")).withColumn("bucket", F.floor(F.col("tb") / 1e6 / width))
    return a.join(b, ["grp", "bucket"]).where((F.col("tb") >= F.col("ta")) & (F.col("tb") - F.col("ta") <= width * 1_000_000) & (F.col("a") != F.col("b"))).select("a", "b")


# How statements of an extraction batch contest one another, and words of cause and effect.
CONTEST_NEGATIONS = "not no never without cannot cant didnt didn't isnt isn't".split()
CONTEST_STOPS = "did does do is are was were be been being the a an".split()
CONTEST_LEAST, CONTEST_SHARE, CONTEST_SIZE = 2, 0.5, 4


def contest_words(text: Column) -> Column:
    """The stemmed words of a statement's key without negations and stop words, repeats included."""
    words = F.filter(F.split(dedup_key(text), r"\s+"), lambda w: (w != "") & ~w.isin(CONTEST_NEGATIONS) & ~w.isin(CONTEST_STOPS))
    return F.transform(words, stem)


def contested(claims: DataFrame, batch: str) -> DataFrame:
    """claim_id of the claims (claim_id, text, batch) that another one of their batch contests: of opposite polarity with
    half of the shorter one's words in common, or of equal polarity with all of them but one. Repeats of a word in the later
    claim (greater id) count as often as they stand there."""
    negative = F.arrays_overlap(F.split(dedup_key(F.col("text")), r"\s+"), F.array(*map(F.lit, CONTEST_NEGATIONS)))
    x = claims.select("claim_id", F.col(batch).alias("batch"), contest_words(F.col("text")).alias("core"), negative.alias("neg")).where(F.size("core") > 0)
    # a word of one batch is no word of another
    keyed = x.select("claim_id", F.transform(F.array_distinct("core"), lambda w: F.concat_ws(" ", F.col("batch"), w)).alias("words"), F.size("core").alias("n"))
    # without repeats, what counts is shared words; a claim with repeats may reach its count with one word
    once, again = keyed.where(F.size("words") == F.col("n")).drop("n"), keyed.where(F.size("words") < F.col("n")).drop("n")
    rest = pairs_sharing(again, keyed.drop("n"), 1, 0.0).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    met = pairs_sharing(once, once, CONTEST_LEAST, CONTEST_SHARE).select("a", "b").unionByName(rest).distinct()
    for end in ("a", "b"):
        met = met.join(x.select(F.col("claim_id").alias(end), F.col("core").alias(f"core_{end}"), F.col("neg").alias(f"neg_{end}")), end)
    shared = F.size(F.filter("core_b", lambda w: F.array_contains("core_a", w)))
    shorter = F.least(F.size("core_a"), F.size("core_b"))
    opposite = (F.col("neg_a") != F.col("neg_b")) & (shared / shorter >= CONTEST_SHARE)
    alike = (F.col("neg_a") == F.col("neg_b")) & (shorter >= CONTEST_SIZE) & (shared >= shorter - 1)
    return met.where((shared >= CONTEST_LEAST) & (opposite | alike)).select(F.explode(F.array("a", "b")).alias("claim_id")).distinct()


def no_longer_contested(claims: DataFrame, first_runs: DataFrame) -> DataFrame:
    """Contested claims that nothing contests any more in the run that they come from; first_runs: claim_id, run_id. Claims
    of no known run are left alone."""
    x = claims.join(first_runs, "claim_id")
    return x.where("status = 'contested'").join(contested(x, "run_id"), "claim_id", "left_anti").select("claim_id")


# How words of actions and of changes of state begin, and words that tie nothing together.
ACTIONS = (
    "deploy releas shipp push merg restart rollback roll scal upgrad downgrad patch configur enabl disabl migrat switch cutover reboot restor trigger kill stop "
    "start launch promot revert hotfix block unblock throttl drain appli execut"
).split()
STATE_CHANGES = (
    "latenc throughput error response memor availab uptim downtim outag incident regress spike spik drop dropp increas decreas degrad improv recover recov crash broke broken saturat"
).split()
CAUSAL_NOISE = "service system systems app production prod stage staging instance replica cluster server node pod container host environment env".split()


def causes(claims: DataFrame, hours: int = 48) -> DataFrame:
    """from_id, to_id of claims (claim_id, text, at) about an action and about a change of state within so many hours after
    it, with a word in common that is no noise. A claim without a time may precede or follow any; two claims that are each
    both an action and a change cause nothing."""
    t = F.col("text")
    raw = F.filter(doc_tokens(t), lambda w: ~w.isin(NEGATIONS) & ~w.isin(STOP_WORDS))

    def begins(parts: list[str]) -> Column:
        return F.exists(raw, lambda w: w.rlike("^(" + "|".join(parts) + ")"))

    words = F.filter(content_tokens(t), lambda w: ~w.isin(CAUSAL_NOISE))
    x = claims.select("claim_id", "at", begins(ACTIONS).alias("acts"), begins(STATE_CHANGES).alias("changes"), words.alias("words")).where((F.col("acts") | F.col("changes")) & (F.size("words") > 0))
    a, b = x.where("acts"), x.where("changes")
    met = pairs_sharing(a.select("claim_id", "words"), b.select("claim_id", "words"), 1, 0.0).select("a", "b")
    for end in ("a", "b"):
        met = met.join(x.select(F.col("claim_id").alias(end), F.col("at").alias(f"at_{end}"), (F.col("acts") & F.col("changes")).alias(f"both_{end}")), end)
    gap = F.unix_micros("at_b") - F.unix_micros("at_a")
    return met.where(F.coalesce(gap.between(0, hours * 3_600_000_000), F.lit(True)) & ~(F.col("both_a") & F.col("both_b"))).select(F.col("a").alias("from_id"), F.col("b").alias("to_id"))


def citations(claims: DataFrame, known: DataFrame) -> DataFrame:
    """from_id, to_id of claims (claim_id, text) that cite known ones (claim_id, ref) other than themselves, each pair once."""
    cited = claims.select(F.col("claim_id").alias("from_id"), F.explode(citation_refs(F.col("text"))).alias("ref"))
    return cited.join(known.select("ref", F.col("claim_id").alias("to_id")), "ref").where("from_id <> to_id").select("from_id", "to_id").distinct()
