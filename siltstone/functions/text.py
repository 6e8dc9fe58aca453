"""Text functions as column expressions: tokenizers, normalisers and rule classifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokenizers' punctuation, stop words and negations; words of intent, polarity and volatility.
PUNCTUATION = ",.;:!?()[]{}\"'"
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would shall should may might must can could to of in for on with at by from as into "
    "through during before after above below between and but or nor so yet it its this that these those i we you he she they me us him her them my our your his their"
).split()
NEGATIONS = (
    "not no never without cannot cant can't dont don't doesnt doesn't didnt didn't isnt isn't arent aren't wasnt wasn't werent weren't wont won't wouldnt wouldn't "
    "shouldnt shouldn't impossible unlikely disagree rejected declined failed"
).split()
INTENT_WORDS = {
    "decision": ["decision", "decide", "chose", "choose", "pick", "selected", "approve", "commit"],
    "hypothesis": ["risk", "might", "could", "possibly", "hypothesis", "maybe", "uncertain", "assume"],
    "fact": ["what happened", "did we", "how many", "status", "metric", "measure"],
}
POSITIVE_WORDS = ["shipped", "deployed", "succeeded", "delivered", "passed", "completed", "approved"]
NEGATIVE_WORDS = ["failed", "broken", "missed", "rejected", "cancelled", "regressed", "blocked", "outage"]
DURABLE_WORDS = (
    r"(?i)\b(?:decided|decision|chose|chosen|because|rationale|in\s+order\s+to|so\s+that|must\s+never|must\s+always|policy|convention|by\s+design|deliberate(?:ly)?|"
    r"the\s+reason|trade-?off|we\s+prefer|prefers?\b)"
)
STATE_WORDS = (
    r"(?i)\b(?:(?:is|are|isn'?t|aren'?t|not)\s+(?:currently\s+)?(?:installed|present|available|enabled|disabled|configured|wired|set\s+up|deployed|running|up|down|live|active|"
    r"passing|failing|broken|green|red)|no\s+\w+\s+(?:anywhere|in\s+the\s+repo|installed|configured)|(?:doesn'?t|does\s+not|don'?t)\s+(?:exist|work|run|build|compile|pass)|"
    r"(?:currently|now)\s+(?:on|at|using|running)\s+v?\d|\bv\d+\.\d+\.\d+\b|\bport\s+\d{2,5}\b)"
)
VOLATILE_DAYS = 14


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often a lambda in f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _split_words(text: Column) -> Column:
    return F.split(F.lower(text), r"\s+")


def doc_tokens(text: Column) -> Column:
    """Lower-case words without punctuation at their ends; repeated words stay."""
    return F.filter(F.transform(_split_words(text), lambda w: F.btrim(w, F.lit(PUNCTUATION))), lambda w: w != "")


def stem(word: Column) -> Column:
    """Drops the first that fits of `ed` and `es` (more than five bytes) and `s` (more than four)."""
    size = F.octet_length(word)
    chars = F.char_length(word)
    return (
        F.when((size > 5) & (word.endswith("ed") | word.endswith("es")), F.substring(word, F.lit(1), chars - 2))
        .when((size > 4) & word.endswith("s"), F.substring(word, F.lit(1), chars - 1))
        .otherwise(word)
    )


def content_tokens(text: Column) -> Column:
    """The set of stemmed words that are neither negations nor stop words, in order of first appearance."""
    kept = F.filter(doc_tokens(text), lambda w: ~w.isin(STOP_WORDS) & ~w.isin(NEGATIONS))
    return F.array_distinct(F.transform(kept, stem))


def negated(text: Column) -> Column:
    """Whether a word is a negation."""
    return F.arrays_overlap(doc_tokens(text), F.array(*map(F.lit, NEGATIONS)))


def token_set(text: Column) -> Column:
    """The set of runs of letters and digits with at least three characters, lower-case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda w: F.char_length(w) >= 3))


def dedup_key(text: Column) -> Column:
    """Lower-case, without `,.;:!?`, single spaces: equal for copies of a statement."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), ",.;:!?", ""), r"\s+", " "))


def alnum_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def sentences(text: Column) -> Column:
    return F.split(text, r"[!?\n]+|\.\s+")


def polarity_core(text: Column) -> Column:
    """The sorted words without negations, as one string."""
    return F.array_join(F.array_sort(F.filter(doc_tokens(text), lambda w: ~w.isin(NEGATIONS))), " ")


def negation_parity(text: Column) -> Column:
    return F.size(F.filter(doc_tokens(text), lambda w: w.isin(NEGATIONS))) % 2


def is_structural_noise(text: Column) -> Column:
    """Headings, rules, table rows, labels, and lines with fewer than two content words."""
    return text.rlike(r"^\s*#{1,6}\s") | text.rlike(r"^[\s\-=_*]+$") | text.rlike(r"\|.*\|") | text.rlike(r":\s*$") | (F.size(content_tokens(text)) < 2)


def volatility_days(kind: Column, text: Column) -> Column:
    """Half-life by kind and wording: VOLATILE_DAYS for statements about the state of a system, else 0 (none)."""
    plain = F.translate(text, "’‘ʼ`", "''' ")
    return F.when((F.lower(kind) == "decision") | plain.rlike(DURABLE_WORDS), 0).when(plain.rlike(STATE_WORDS), VOLATILE_DAYS).otherwise(0)


def question_intent(question: str) -> str | None:
    """What a question asks for, by the first list that has a part of it; evaluated once for a literal."""
    q = question.lower()
    return next((kind for kind, words in INTENT_WORDS.items() if any(w in q for w in words)), None)


def intent(text: Column) -> Column:
    q = F.lower(text)
    return F.coalesce(*[F.when(_has_any(q, words), kind) for kind, words in INTENT_WORDS.items()])


def _has_any(text: Column, words: list[str]) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(text, F.lit(w))
    return found


def word_polarity(text: Column) -> Column:
    """-1 for words of failure, else 1 for words of success, else 0."""
    t = F.lower(text)
    return F.when(_has_any(t, NEGATIVE_WORDS), -1).when(_has_any(t, POSITIVE_WORDS), 1).otherwise(0)


def citation_refs(text: Column) -> Column:
    """Ids of claims that a text cites."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(cl_[A-Za-z0-9_-]+)\b"), 1))


def fts_terms(query: Column) -> Column:
    """The words of a full-text query without operators."""
    plain = F.translate(query, "\"()*^:-+{}[]~", "             ")
    return F.filter(F.split(F.lower(plain), r"\s+"), lambda w: (w != "") & ~w.isin("and", "or", "not", "near"))


def evict_to_limit(text: Column, limit: int) -> Column:
    """The text without its oldest lines, as many as bring it to at most limit characters; of a last line that is longer
    still, its end."""
    tail, before = F.right(text, F.lit(limit)), F.substring(text, F.char_length(text) - limit, F.lit(1))
    later = F.when((before == "\n") | (F.instr(tail, "\n") == 0), tail).otherwise(F.substring(tail, F.instr(tail, "\n") + 1, F.lit(limit)))
    return F.when(F.char_length(text) <= limit, text).otherwise(later)


# Endings of names of source files, and the shape of commit ids.
CODE_ENDINGS = (
    "go ts tsx js jsx py rs java rb php c cc cpp h hpp cs kt swift scala md yaml yml json toml sql sh env cfg ini lock mod sum proto gradle dockerfile"
).split()
COMMIT_ID = r"^(?=.*[0-9])[0-9a-f]{7,40}$"


def _plain_word(word: Column) -> Column:
    return F.btrim(word, F.lit(".,;:!?()[]{}\"'`"))


def is_path(word: Column) -> Column:
    slashes = F.char_length(word) - F.char_length(F.translate(word, "/", ""))
    return ~F.contains(word, F.lit("://")) & (word.rlike(r"^.:[\\/]") | word.startswith("./") | word.startswith("../") | (word.startswith("/") & (slashes >= 2)))


def is_repo_local(text: Column) -> Column:
    """Whether a word is a path, the name of a source file, or a commit id."""
    def local(raw: Column) -> Column:
        w = _plain_word(raw)
        named = ~F.contains(w, F.lit("://")) & F.lower(F.regexp_extract(w, r"(?s)^.+\.([^.]+)$", 1)).isin(CODE_ENDINGS)
        return is_path(w) | named | w.rlike(COMMIT_ID)

    return F.exists(F.filter(F.split(text, r"\s+"), lambda w: w != ""), local)


def without_paths(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, r"\s+"), lambda w: (w != "") & ~is_path(_plain_word(w))), " ")


# Patterns of event observations.
OBSERVED = {
    "deployment": r"(?i)\b(?:deployed|rolled\s+out|rolled\s+back|promoted|provisioned|scaled(?:\s+up|\s+down)?)\b",
    "release": r"(?i)\b(?:released|published|shipped|cut|tagged|bumped)\b",
    "change": r"(?i)\b(?:merged|pushed|reverted|reved|cherry-picked|squash-merged|force-pushed)\b",
}
INCIDENT = r"(?i)\b(?:outage|incident|downtime|regression|breakage)\b"
OCCURRED = r"(?i)\b(?:started|occurred|happened|hit|struck|took\s+down|brought\s+down|caused|broke|crashed|went\s+down|at\s+\d)\b"
ARTIFACT = r"(?i)(?:\bv?\d+\.\d+(?:\.\d+)?\b|#\d+\b|\bPR\s*#?\d+\b|\brelease\b|\bbuild\b|\bcommit\b|\b[0-9a-f]{7,40}\b)"
NOT_OBSERVED = (
    r"(?i)(?:\?|\b(?:should|shall|must|will|would|could|might|want\s+me|happy\s+to|shall\s+i|whether|rather|instead|worth|plan(?:ned)?\s+to|going\s+to|about\s+to|because|in\s+order\s+to|"
    r"so\s+that|decided|the\s+reason|policy|always|never|by\s+design|prefer|recommend|i'?d|we'?d|let'?s|next\s+release|until\s+a\s+release)\b)"
)


def event_kind(kind: Column, text: Column) -> Column:
    """What a statement reports as having happened; '' for nothing."""
    plain = F.translate(text, "’‘ʼ`", "''' ")
    seen = F.coalesce(*[F.when(plain.rlike(p), k) for k, p in OBSERVED.items()], F.lit(""))
    return (
        F.when((F.lower(kind) == "decision") | (F.trim(plain) == "") | plain.rlike(NOT_OBSERVED), "").when(plain.rlike(INCIDENT) & plain.rlike(OCCURRED), "incident")
        .when(~plain.rlike(ARTIFACT), "").otherwise(seen)
    )


# Signals of claim types and of confidence.
DECISION_SIGNALS = ["decide", "decision", "we will", "approved", "chosen", "plan is", "we should"]
HYPOTHESIS_SIGNALS = ["might", "maybe", "hypothesis", "assume", "could", "possibly", "likely", "expected"]
HEDGES = ["approximately", "about", "around", "maybe", "might", "likely"]
CONFIRMATIONS = ["confirmed", "observed", "measured", "reported"]
BASE_CONFIDENCE = {"decision": 0.88, "hypothesis": 0.62}
OTHER_CONFIDENCE = 0.8


def claim_type(text: Column) -> Column:
    """decision if it has signals of one, at least as many as of a hypothesis; else hypothesis if it has any; else fact."""
    lower = F.lower(text)

    def score(words: list[str]) -> Column:
        out = F.lit(0)
        for w in words:
            out = out + F.contains(lower, F.lit(w)).cast("int")
        return out

    decision, hypothesis = score(DECISION_SIGNALS), score(HYPOTHESIS_SIGNALS)
    return F.when((decision > 0) & (decision >= hypothesis), "decision").when(hypothesis > 0, "hypothesis").otherwise("fact")


def claim_confidence(text: Column, kind: Column) -> Column:
    """By type, less for hedges, more for digits and words of confirmation, from 0.5 to 0.95."""
    lower = F.lower(text)
    base = F.coalesce(*[F.when(kind == k, v) for k, v in BASE_CONFIDENCE.items()], F.lit(OTHER_CONFIDENCE))
    value = base - F.when(_has_any(lower, HEDGES), 0.08).otherwise(0.0) + F.when(lower.rlike("[0-9]"), 0.05).otherwise(0.0) + F.when(_has_any(lower, CONFIRMATIONS), 0.04).otherwise(0.0)
    return F.greatest(F.lit(0.5), F.least(F.lit(0.95), value))


def entity_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def names_match(a: Column, b: Column) -> Column:
    """Equal after normalising, or one contains the other; empty names match nothing."""
    x, y = entity_key(a), entity_key(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))
