"""What in a text is no statement: Markdown, headings, labels, greetings, narration and the like; and JSON in model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import let, sentences

# Words that carry no content, openings of letters, and patterns of text that states nothing.
SHORT_STOPS = "the a an is are was were be been to of in for on and or but it we by as".split()
SALUTATIONS = ["hi ", "hello ", "hey ", "dear ", "regards", "thanks,", "thank you,", "cheers,", "best,", "sincerely,"]
LABEL = r"^[A-Za-z][A-Za-z0-9 -]{0,40}:\s+\S"
GREETING = r"(?i)^(good\s+(morning|afternoon|evening|night)|hi|hey|hello|cheers|thanks|thank\s+you|bye|goodbye|farewell|greetings)([\s,.!?-]+\w+)?[\s.!?]*$"
ACKNOWLEDGED = r"(?i)^(done|ok|okay|yes|no|sure|noted|confirmed|got\s+it|copy(\s+that)?|roger|agreed)[\s.!?]*$"
STATUS_EMOJI = r"^[\p{So}\p{Sm}\p{Sk}]+\s*(done|ok|okay|yes|noted|confirmed|got\s+it)?[\s.!?]*$"
NARRATION = (
    r"(?i)^(?:(?:ok(?:ay)?|now|next|first|then|finally|so)[,\s]+)*(?:let\s+me|let'?s|i'?ll|i\s+will|i'?m\s+going\s+to)\s+(?:also\s+|just\s+|now\s+|quickly\s+|first\s+)*"
    r"(?:add|build|check|create|do|explore|fix|go|handle|implement|inspect|look|make|open|read|replace|run|see|start|survey|take|test|try|update|use|verify|view|wire|write|examine|"
    r"confirm|continue|dig|drop|find|finish|get|give|keep|land|list|move|note|pick|put|remove|rename|report|review|scan|search|set|show|split|switch|trace|walk|"
    r"rewrite|extend|compose|import|refactor|apply|thread|ground|adjust|swap|delete|generate)\b"
)
ABOUT_CLAIMS = (
    r"(?i)(?:^|\b)(?:that'?s|thats|this\s+is|that\s+is|it'?s)?\s*(?:the\s+|a\s+|another\s+|\w+(?:st|nd|rd|th)\s+)?"
    r"(?:stale|outdated|obsolete|superseded|deprecated|incorrect|wrong)\s+(?:belief|claim|memory|memories)\b"
    r"|\b(?:correct(?:ing|ed)?|deprecat(?:e|ing|ed)|supersed(?:e|ing|ed)|retir(?:e|ing|ed)|forget(?:ting)?|updat(?:e|ing|ed))\s+"
    r"(?:the\s+|that\s+|this\s+|a\s+)?(?:stale\s+|old\s+|previous\s+|existing\s+)?(?:belief|claim|memory|memories)\b"
    r"|\b(?:belief|claim|memory)\s+that\s+(?:said|claimed|stated|asserted)\b"
)
STATUS_CHATTER = (
    r"(?i)\b(?:suites?|tests?|build|builds|ci|pipeline|engine|surfaces?|everything)\b.{0,30}?\b(?:is|are|now|still)\b.{0,20}?"
    r"\b(?:green|red|passing|failing|passes|pass|broken|wired|working|clean|ready)\b"
    r"|\ball\s+\w+(?:\s+\w+){0,2}?\s+(?:are\s+)?(?:wired|green|passing|tested|building|pass|passes)\b"
)


def _fields(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def content_words(text: Column) -> Column:
    """How many words have two bytes or more without marks around them and are no stop words."""
    words = F.transform(_fields(F.lower(text)), lambda w: F.btrim(w, F.lit(",.;:!?()[]{}\"'-")))
    return F.size(F.filter(words, lambda w: (F.octet_length(w) >= 2) & ~w.isin(SHORT_STOPS)))


def is_heading(text: Column) -> Column:
    """Two to four words that each begin with a capital, or are numbers."""
    words = _fields(text)
    return F.size(words).between(2, 4) & F.forall(words, lambda w: w.rlike("^[0-9]+$") | w.rlike("^[A-Z]"))


def is_noise(text: Column) -> Column:
    """Headings, rules, fences, list markers alone, labels, rows of tables and signatures, JSON, salutations, and lines with
    fewer than two words of content."""
    t = F.trim(text)
    words = F.size(_fields(t))
    bars = F.char_length(t) - F.char_length(F.translate(t, "|", ""))
    salutation = F.exists(F.array(*map(F.lit, SALUTATIONS)), lambda p: F.startswith(F.lower(t), p))
    return (
        t.startswith("#") | t.rlike("^[-*> ]*$") | F.translate(t, " ", "").rlike("^-{3,}$") | t.startswith("```") | (t.endswith(":") & (words <= 2)) | ((words <= 5) & t.rlike(LABEL))
        | (bars >= 2) | ((bars == 1) & (F.contains(t, F.lit("@")) | F.contains(t, F.lit("+1-")))) | (t.startswith("{") & t.endswith("}")) | is_heading(t) | ((words <= 4) & salutation) | (content_words(t) < 2)
    )


def is_junk(text: Column) -> Column:
    """Greetings, acknowledgements, emoji, section labels, lead-ins, narration, talk about claims, and status chatter."""
    t = F.trim(text)
    plain = F.trim(F.regexp_replace(t, r"[\p{So}\p{Sm}\p{Sk}]", ""))
    label = F.trim(F.rtrim(plain, F.lit(":")))
    lead = F.trim(F.rtrim(t, F.lit(":")))
    section = plain.endswith(":") & ((label == "") | (content_words(label) <= 4))
    leads_in = (lead != t) & (lead != "") & (content_words(lead) > 4) & ~lead.rlike("[={}]")
    return (
        (plain == "") | plain.rlike(GREETING) | plain.rlike(ACKNOWLEDGED) | t.rlike(STATUS_EMOJI) | section | plain.rlike(NARRATION) | plain.rlike(ABOUT_CLAIMS) | leads_in
        | plain.rlike(STATUS_CHATTER) | (content_words(plain) < 2)
    )


def clean_markdown(text: Column) -> Column:
    """Text without marks of bold, strike-through, check boxes, a leading list marker or number, and link targets."""
    s = F.regexp_replace(text, r"\*\*([^*]+)\*\*", "$1")
    s = F.regexp_replace(s, r"__([^_]+)__", "$1")
    s = F.regexp_replace(s, r"~~([^~]+)~~", "$1")
    for mark in ("- [x] ", "- [ ] ", "[x] ", "[ ] "):
        s = F.replace(s, F.lit(mark), F.lit(""))
    s = F.regexp_replace(F.trim(s), r"^[-*>] \s*", "")
    s = F.regexp_replace(s, r"^[0-9][^.]{0,2}\. \s*", "")
    return F.trim(F.regexp_replace(s, r"\[([^\]\[]*)\]\([^)]*\)", "$1"))


def candidates(text: Column) -> Column:
    """The statements of a text: its sentences after clean-up that are not noise, with four bytes or more."""
    raw = F.transform(sentences(clean_markdown(text)), lambda x: F.regexp_replace(F.rtrim(F.trim(x), F.lit(".")), r"^(?:[-*>]|[0-9]{1,2}[.)]) \s*", ""))
    return F.filter(raw, lambda x: (F.octet_length(x) >= 4) & ~is_noise(x))


def repaired_json(text: Column) -> Column:
    """The JSON in a model's answer: without thoughts, inside the first fence if there is one, and only its first balanced
    array or object; the trimmed text if there is none."""
    s = F.trim(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))
    after = F.regexp_extract(s, r"(?s)```(?:[^\n]*\n)?(.*)$", 1)
    s = F.when(F.contains(s, F.lit("```")), F.trim(F.regexp_replace(after, r"(?s)```.*$", ""))).otherwise(s)
    start = F.regexp_instr(s, F.lit(r"[\[{]"))
    body = F.when(start > 0, F.substring(s, start, F.char_length(s))).otherwise("")

    def value(x: Column) -> Column:
        opens = F.substring(x, 1, 1)
        zero = F.struct(opens.alias("opens"), F.when(opens == "[", "]").otherwise("}").alias("closes"), F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))

        def step(a: Column, p: Column) -> Column:
            depth = a["depth"] + F.when(p == a["opens"], 1).when(p == a["closes"], -1).otherwise(0)
            size = a["size"] + F.char_length(p)
            return F.when(a["done"], a).otherwise(F.struct(a["opens"].alias("opens"), a["closes"].alias("closes"), depth.alias("depth"), size.alias("size"), (depth == 0).alias("done")))

        # a string is one piece, so that brackets in it are not counted
        pieces = F.regexp_extract_all(x, F.lit(r'(?s)("(?:[^"\\]|\\.)*"|.)'), 1)
        return F.aggregate(pieces, zero, step, lambda a: F.when(a["done"], a["size"]))

    return F.coalesce(let(body, lambda x: F.substring(x, F.lit(1), value(x))), s)
