"""Detectors of relations between statements, in their order of precedence, over candidate pairs from shared words."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import detect
from siltstone.functions.text import content_tokens
from siltstone.operators.relate import LEAST_SHARED, LONGER_SHARE, SHORTER_SHARE, pairs_sharing, relation_type
from siltstone.sources.shared import written

# Shares of the shorter and of the longer statement's words, and least sizes.
NUMBER_SHORTER, NUMBER_LONGER, NUMBER_LEAST = 0.70, 0.40, 3
NAME_MOST = 3
ASPECT_SHORTER = 0.5


def features(claims: DataFrame) -> DataFrame:
    """claim_id and what the detectors see of claims (claim_id, text, and durability if it is there)."""
    t = F.col("text")
    session = F.coalesce(F.lower(F.trim("durability")) == "session", F.lit(False)) if "durability" in claims.columns else F.lit(False)
    x = claims.select("claim_id", "text", content_tokens(t).alias("words"), session.alias("session")).where(F.size("words") > 0)
    w = F.col("words")
    return x.select(
        "claim_id", "words", "session", detect.denied(t).alias("denied"), detect.word_tokens(w).alias("letters"), detect.anchors(w).alias("anchors"), detect.aspect(t).alias("aspect"),
        F.when(F.size(w) <= NAME_MOST, detect.names(t)).alias("names"), detect.measures(t).alias("measures"), detect.enumerated(t).alias("listed"),
    )


#: By detector: the words that its pairs share, the claims that have what it looks at, and how many and what share of the
#: smaller set they share at least.
MEETS = {
    "words": ("words", "true", LEAST_SHARED, SHORTER_SHARE), "numbers": ("letters", "size(measures) > 0", NUMBER_LEAST, NUMBER_SHORTER),
    "names": ("words", "size(names) > 0", 1, 0.0), "aspects": ("anchors", "aspect is not null", 1, ASPECT_SHORTER),
}


def candidates(left: DataFrame, right: DataFrame, detectors: Iterable[str] = MEETS) -> DataFrame:
    """a, b, each pair once (a < b, if left is right), of features that any of the detectors may relate: each detector's own
    words are met on, among the claims that have what it looks at."""
    def found_by(column: str, where: str, least: int, share: float) -> DataFrame:
        l = left.where(where).select("claim_id", F.col(column).alias("words"))
        r = l if left is right else right.where(where).select("claim_id", F.col(column).alias("words"))
        return pairs_sharing(l, r, least, share).select("a", "b")

    return reduce(DataFrame.unionByName, [found_by(*MEETS[x]) for x in detectors]).distinct()


def _shared(column: str) -> Column:
    return F.size(F.array_intersect(f"{column}_a", f"{column}_b"))


def _of_both(column: str, f) -> Column:
    return f(F.size(f"{column}_a"), F.size(f"{column}_b"))


def numbers_differ() -> Column:
    """Enough words in common to be about one thing, and values that disagree."""
    shared, shorter, longer = _shared("letters"), _of_both("letters", F.least), _of_both("letters", F.greatest)
    about_one = (shorter >= NUMBER_LEAST) & (shared / shorter >= NUMBER_SHORTER) & (shared / longer >= NUMBER_LONGER)
    return (F.size("measures_a") > 0) & (F.size("measures_b") > 0) & about_one & ~detect.measures_agree(F.col("measures_a"), F.col("measures_b"))


def names_differ() -> Column:
    """Very short statements with a word in common and a name of its own each: one role, two holders."""
    shared = _shared("words")
    short = (F.size("words_a") <= NAME_MOST) & (F.size("words_b") <= NAME_MOST) & (shared >= 1) & (F.size("words_a") > shared) & (F.size("words_b") > shared)
    own = (F.size(F.array_except("names_a", "names_b")) > 0) & (F.size(F.array_except("names_b", "names_a")) > 0)
    return short & F.coalesce(own, F.lit(False))


def aspects_differ() -> Column:
    """One subject, and aspects that exclude each other."""
    shared, shorter, longer = _shared("anchors"), _of_both("anchors", F.least), _of_both("anchors", F.greatest)
    about_one = (shared >= 1) & (shared / longer >= LONGER_SHARE) & (shared / shorter >= ASPECT_SHORTER)
    return F.coalesce(F.col("aspect_a") != F.col("aspect_b"), F.lit(False)) & F.coalesce(about_one, F.lit(False))


def typed(pairs: DataFrame, left: DataFrame, right: DataFrame, exempt_lists: bool = True) -> DataFrame:
    """a, b, type, detector of pairs (a, b). Shared words decide first; different numbers overrule them; different names and
    then aspects count where words decided nothing. Two items of a numbered list differ in neither numbers nor names (only
    where all claims are related at once: exempt_lists). Contradictions of two session-local claims are dropped."""
    x = pairs
    for end, df in (("a", left), ("b", right)):
        x = x.join(df.select(*(F.col(c).alias(end if c == "claim_id" else f"{c}_{end}") for c in df.columns)), end)
    shared, n, m = _shared("words"), F.size("words_a"), F.size("words_b")
    by_words = F.when((shared >= LEAST_SHARED) & (shared / F.least(n, m) >= SHORTER_SHARE), relation_type(shared, n, m, F.col("denied_a") != F.col("denied_b")))
    lists = (F.col("listed_a") & F.col("listed_b")) if exempt_lists else F.lit(False)
    x = x.select("a", "b", "session_a", "session_b", by_words.alias("by_words"), (~lists & numbers_differ()).alias("numbers"), (~lists & names_differ()).alias("names"), aspects_differ().alias("aspects"))
    detector = F.when(F.col("numbers"), "numbers").when(F.col("by_words").isNotNull(), "words").when(F.col("names"), "names").when(F.col("aspects"), "aspects")
    kind = F.when(F.col("detector") == "words", F.col("by_words")).otherwise("contradicts")
    x = x.withColumn("detector", detector).where("detector is not null").withColumn("type", kind)
    return x.where(~((F.col("type") == "contradicts") & F.col("session_a") & F.col("session_b"))).select("a", "b", "type", "detector")


def relations(claims: DataFrame) -> DataFrame:
    """from_id, to_id, type, detector of all claims with one another, each pair once, from the lesser id."""
    f = features(claims)
    return typed(candidates(f, f), f, f).select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), "type", "detector")


def relations_by(claims: DataFrame, detector: str) -> DataFrame:
    """Those that one detector decides. Both ends have what it looks at, so only such claims meet, on its words alone."""
    f = written(features(claims).where(MEETS[detector][1]), "features")
    return typed(candidates(f, f, [detector]), f, f).where(F.col("detector") == detector).select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), "type", "detector")


def new_relations(new: DataFrame, stored: DataFrame) -> DataFrame:
    """The same from each new claim to stored ones; numbered lists are not exempt there."""
    f, g = features(new), features(stored)
    return typed(candidates(f, g), f, g, exempt_lists=False).select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), "type", "detector")


def still_contradicting(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """Contradicting edges with a verdict: keep if the detectors still find one, stale if not, orphan without both claims."""
    f = features(claims)
    e = edges.where("type = 'contradicts'").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    now = typed(e, f, f).where("type = 'contradicts'").select("a", "b", F.lit(True).alias("found"))
    ids = claims.select("claim_id")
    both = e.join(ids.withColumnRenamed("claim_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("claim_id", "b"), "b", "left_semi").select("a", "b", F.lit(True).alias("known"))
    x = e.join(both, ["a", "b"], "left").join(now, ["a", "b"], "left")
    verdict = F.when(F.col("known").isNull(), "orphan").when(F.col("found").isNull(), "stale").otherwise("keep")
    return x.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), verdict.alias("verdict"))


def in_scope_contradictions(relations: DataFrame, scopes: DataFrame) -> DataFrame:
    """Relations without the contradictions inside one session and those between workspaces; scopes: claim_id, session,
    workspace, null where unknown, which drops nothing."""
    x = relations
    for end in ("from", "to"):
        x = x.join(scopes.select(F.col("claim_id").alias(f"{end}_id"), F.col("session").alias(f"{end}_session"), F.col("workspace").alias(f"{end}_workspace")), f"{end}_id", "left")
    same_session = F.coalesce(F.col("from_session") == F.col("to_session"), F.lit(False))
    apart = F.coalesce(F.col("from_workspace") != F.col("to_workspace"), F.lit(False))
    return x.where(~((F.col("type") == "contradicts") & (same_session | apart))).select(relations.columns)
