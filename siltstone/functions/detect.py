"""What a statement says that may contradict another: its polarity, numbers, names and aspect, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import NEGATIONS, PUNCTUATION, STOP_WORDS, let, stem

# What makes a negation contrastive, markers of aspects, copulas, units of numbers, words of bounds, list items.
HEDGES_AFTER_NOT = "merely just only simply solely".split()
CLAUSE_ENDS = [",", ";", "—", "–"]
LONE_DASHES = ["-", "—", "–"]
ASPECTS = {
    "never": "never cancel declined".split(),
    "planned": "plan schedul upcom will".split(),
    "ongoing": "still ongoing continu underway runn running pending inflight inprogres working workin active".split(),
    "completed": "complet finish done succeed shipp deliver resolv end clos sign-off signoff rolledback deployed".split(),
}
COPULAS = ["is", "are", "was", "were", "'s"]
UNITS = {
    "ms": ("time", 0.001), "msec": ("time", 0.001), "s": ("time", 1), "sec": ("time", 1), "secs": ("time", 1), "second": ("time", 1), "seconds": ("time", 1), "m": ("time", 60), "min": ("time", 60),
    "mins": ("time", 60), "minute": ("time", 60), "minutes": ("time", 60), "h": ("time", 3600), "hr": ("time", 3600), "hour": ("time", 3600), "hours": ("time", 3600), "%": ("percent", 1),
    "$": ("usd", 1), "usd": ("usd", 1), "€": ("eur", 1), "eur": ("eur", 1), "£": ("gbp", 1), "gbp": ("gbp", 1),
    "b": ("bytes", 1), "kb": ("bytes", 1024), "mb": ("bytes", 1024**2), "gb": ("bytes", 1024**3), "tb": ("bytes", 1024**4),
}
BOUND_WORDS = (
    "at least|at most|no more than|no fewer than|minimum|maximum|min|max|up to|over|under|above|below|more than|fewer than|less than|greater than"
)
ENUMERATED = r"(?i)^(?:- )?(?:phase|outcome|step|milestone|use\s*case|task|objective|deliverable|feature|requirement)\s*\d+"
#: Numbers that differ by less than this share of the greater one are the same.
CLOSE = 0.005
_NUMBER = r"[$€£¥]?-?\d+(?:[.,]\d+)?(?:%|\s*[a-z]{1,7}\b)?"
_UNIT_WORDS = "|".join(sorted((u for u in UNITS if u.isalpha()), key=len, reverse=True))
#: Numbers that name a thing or a place, or bound a quantity, are taken up without a group; all others are group 1.
_MEASURES = (
    r"(?i)(?<![A-Za-z0-9_])(?:"
    rf"(?<=#){_NUMBER}"
    rf"|(?:(?<=[._/A-Za-z0-9]:)|(?<=[0-9]-))(?![$€£¥]?-?\d+(?:[.,]\d+)?(?:%|\s*(?:{_UNIT_WORDS})\b)){_NUMBER}"
    rf"|[$€£¥]?-?(?:(?<=[><=^~][ \t]{{0,9}})|(?<=(?:{BOUND_WORDS})[ \t]{{0,9}})){_NUMBER.removeprefix('[$€£¥]?-?')}"
    rf"|({_NUMBER}))"
)


def raw_words(text: Column) -> Column:
    return F.split(F.lower(text), r"\s+")


def bare(word: Column) -> Column:
    return F.btrim(word, F.lit(PUNCTUATION))


def denied(text: Column) -> Column:
    """Whether a negation denies the statement. One after the end of a clause, or before `merely` and the like, contrasts two
    things and denies nothing."""

    def denies(words: Column) -> Column:
        def at(w: Column, i: Column) -> Column:
            before, after = F.coalesce(F.get(words, i - 1), F.lit("")), F.coalesce(bare(F.get(words, i + 1)), F.lit(""))
            ends = reduce(lambda a, b: a | b, [F.endswith(before, F.lit(x)) for x in CLAUSE_ENDS])
            return bare(w).isin(NEGATIONS) & ~(ends | before.isin(LONE_DASHES) | after.isin(HEDGES_AFTER_NOT))

        return F.array_contains(F.transform(words, at), True)

    return let(raw_words(text), denies)


def word_tokens(tokens: Column) -> Column:
    """Tokens with a letter."""
    return F.filter(tokens, lambda w: w.rlike(r"\p{L}"))


def anchors(tokens: Column) -> Column:
    """What may be the shared subject of two statements: tokens with a letter that mark no aspect."""
    return F.filter(word_tokens(tokens), lambda w: ~w.isin([x for words in ASPECTS.values() for x in words]))


def aspect(text: Column) -> Column:
    """never, planned, ongoing or completed, the first that a word or its stem marks; else null."""
    words = F.filter(F.transform(raw_words(text), bare), lambda w: w != "")
    both = F.concat(words, F.transform(words, stem))
    return F.coalesce(*[F.when(F.arrays_overlap(both, F.array(*map(F.lit, marks))), kind) for kind, marks in ASPECTS.items()])


def named(text: Column) -> Column:
    """The capitalised words, in lower case, that are no stop words; one that opens a sentence only before a copula."""

    def found(words: Column) -> Column:
        def name(w: Column, i: Column) -> Column:
            word = bare(w)
            opens = (i == 0) | F.coalesce(F.get(words, i - 1).rlike(r"[.!?]$"), F.lit(False))
            subject = F.coalesce(F.lower(bare(F.get(words, i + 1))).isin(COPULAS), F.lit(False))
            return F.when(word.rlike(r"^\p{Lu}\p{L}*$") & (~opens | subject) & ~F.lower(word).isin(STOP_WORDS), F.lower(word))

        return F.array_distinct(F.array_compact(F.transform(words, name)))

    return let(F.split(text, r"\s+"), found)


def names(text: Column) -> Column:
    """The stems of `named` words."""
    return F.array_distinct(F.transform(named(text), stem))


def measures(text: Column) -> Column:
    """The numbers that a statement asserts, as (value in the unit family's base, family): not those behind `#`, of lines
    and ports, or with a bound before them. A word after a number that is no unit is a family of its own."""
    kept = F.filter(F.regexp_extract_all(text, F.lit(_MEASURES), 1), lambda x: x != "")
    families = F.create_map(*[F.lit(y) for u, (family, _) in UNITS.items() for y in (u, family)])
    scales = F.create_map(*[F.lit(y) for u, (_, scale) in UNITS.items() for y in (u, float(scale))])

    def one(x: Column) -> Column:
        sign = F.regexp_extract(x, "^([$€£¥])", 1)
        number = F.translate(F.regexp_extract(x, r"(-?\d+(?:[.,]\d+)?)", 1), ",", "").try_cast("double")
        unit = F.when(sign != "", sign).otherwise(F.lower(F.trim(F.regexp_extract(x, r"(?i)\d\s*(%|[a-z]{1,7})$", 1))))
        family = F.coalesce(F.try_element_at(families, unit), F.when(unit == "", "").otherwise(F.concat(F.lit("raw:"), unit)))
        return F.struct((number * F.coalesce(F.try_element_at(scales, unit), F.lit(1.0))).alias("value"), family.alias("unit"))

    return F.filter(F.transform(kept, one), lambda m: m["value"].isNotNull())


def close(a: Column, b: Column) -> Column:
    greater = F.abs(F.greatest(a, b))
    return (a == b) | F.when(greater == 0, F.abs(a - b) < 1e-9).otherwise(F.abs(a - b) / greater < CLOSE)


def measures_agree(a: Column, b: Column) -> Column:
    """Two statements disagree if both give a value of one family and the first's is none of the second's; two with one value
    each also if the families differ. Without values there is nothing to disagree about."""
    x, y = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    single = (x["unit"] == y["unit"]) & close(x["value"], y["value"])

    def missing(v: Column) -> Column:
        same = F.filter(b, lambda w: w["unit"] == v["unit"])
        return (F.size(same) > 0) & ~F.exists(same, lambda w: close(v["value"], w["value"]))

    return F.when((F.size(a) == 0) | (F.size(b) == 0), True).when((F.size(a) == 1) & (F.size(b) == 1), single).otherwise(~F.exists(a, missing))


def enumerated(text: Column) -> Column:
    """An item of a numbered list, such as `Phase 2`."""
    return F.trim(text).rlike(ENUMERATED)
