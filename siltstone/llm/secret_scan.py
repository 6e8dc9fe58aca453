"""Secrets in texts: three patterns, and a comparison of two character Markov models. DataFrame functions only.

The models are first-order chains over ALPHABET, one trained on random strings and one on ordinary strings, both from
labelled samples. A long run of ALPHABET characters is judged by its best segment: the greatest sum of the log-likelihood
ratios of consecutive transitions, so that ordinary words around a secret, however many, hide nothing. The run is a secret if
that is over a threshold: the score that all but a small share of the shortest random strings reach, or the one that all but a
small share of the ordinary sample stay under, if that is greater. The ordinary chain mixes
three sources in fixed shares, so that none drowns another in a large table: names made of the documents' words, names made of
WORDS, and what programs and people repeat or spell out. UUIDs, and a few characters repeated five times or more, are ordinary
by their shape, which no chain of single transitions can know; they end a segment.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import documents, sampled, share_of

#: The base patterns, by kind in order (fixed values); assign's second group has at least 6 characters.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, LEAST_VALUE = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}", 6
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Shortest and longest random string of the sample; the shortest is the shortest run that the models judge. An equals
#: sign ends a run, so that a name before it is not judged with the value after it.
LEAST_RUN, MOST_RUN = 20, 64
RUN = "[A-Za-z0-9+/_-]{%d,}=*" % LEAST_RUN
#: Training: documents whose words give ordinary strings, at most about so many, words from each, random strings, smoothing.
TRAIN_DOCS, TRAIN_WORDS, TRAIN_RANDOM, SMOOTHING = 800, 16, 4000, 0.5
ENDS = r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})|(.{1,4}?)\1{4,}"
#: The ordinary chain's sources and their shares.
SHARES = {"documents": 0.45, "words": 0.45, "spelled": 0.1}
#: A sample of words that names in programs and files are made of.
WORDS = """
access action active agent all api app array async back backup base batch binary block buffer build button cache callback channel class
client cluster code com command config connect content context count create data date decode default deploy device doc docker double driver
element enable engine entry event example export factory field file first float frame from gateway get google graph handler has header hello
home host http icon import index input install interface internal item java json key label lambda lib library linux list local lock login
main manager map max member method min module month name network number object option order output package param parse path pattern platform
plugin pool port print process proto proxy python query random read remote report reset resource result root rule run script search server
service set share short size source space sql stack start state std step store stream style sync table target temp test thread time tool
tree unicode unit upload url user util vector version view web window with write xml zone
"""
#: What people repeat that isn't short, and the alphabets that programs spell out, each at several lengths.
SPELLED = ["1234567890", "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef", "0123456789ABCDEF", "qwertyuiop", "-", "_", "=", "/", "+", "x", "X", "0", "a"]
#: Ordinary strings that begin at each word (w: the words from there, n: digits by the word's hash), as SQL:
#: names in snake, kebab and camel case, with acronyms and numbers, paths, packages, dates and versions (fixed forms).
ORDINARY = [
    "w[0]", "concat_ws('_', slice(w, 1, 4))", "concat_ws('-', slice(w, 1, 3))", "concat_ws('/', slice(w, 1, 6))", "concat_ws('', transform(slice(w, 1, 5), v -> initcap(v)))", "upper(concat_ws('_', slice(w, 1, 4)))",
    "concat(w[0], upper(left(w[1], 4)), concat_ws('', transform(slice(w, 3, 3), v -> initcap(v))))", "concat(upper(left(w[0], 4)), concat_ws('', transform(slice(w, 2, 4), v -> initcap(v))))",
    "concat_ws('/', array('src', 'main', w[0], w[1], concat(initcap(w[2]), initcap(w[3]), upper(left(w[4], 3)), initcap(w[5]))))",
    "concat('20', substr(n, 1, 2), '-0', substr(n, 3, 1), '-', substr(n, 4, 2), '-', concat_ws('-', slice(w, 1, 4)))", "concat(concat_ws('-', slice(w, 1, 3)), '-', substr(n, 1, 2), '-', w[3], substr(n, 3, 1))",
    "concat(substr(n, 1, 4), '-', substr(n, 5, 2), '-', substr(n, 7, 2), 'T', substr(n, 2, 2), '-', substr(n, 4, 2), '-', substr(n, 6, 2))", "concat(concat_ws('_', slice(w, 1, 2)), '_', substr(n, 1, 8), '_', substr(n, 2, 4))", "concat('/', w[0], '/', substr(n, 1, 6), '/', w[1], '/', substr(n, 3, 5), '/', w[2])",
]
#: The share of random strings of the shortest length that may score under the threshold, and of the ordinary sample's long
#: strings that may score over it; the greater score holds.
RANDOM_UNDER, ORDINARY_OVER = 0.002, 0.0005
#: Ratios are kept as whole numbers of this many to one.
SCALE = 1000
MASK = "[SECRET]"


def names(words: DataFrame, source: str) -> DataFrame:
    """(text, source) of the forms of ORDINARY that begin at each word of rows of words (all_words)."""
    starts = words.select(F.explode(F.expr("transform(all_words, (x, i) -> slice(all_words, i + 1, 6))")).alias("w")).where("size(w) = 6").withColumn("n", F.translate(F.sha1(F.concat_ws(" ", "w")), "abcdef", "123456"))
    return starts.select(F.explode(F.array(*map(F.expr, ORDINARY))).alias("text"), F.lit(source).alias("source"))


def samples(docs: DataFrame) -> DataFrame:
    """Labelled strings (text, secret, source): names made of the words of a bounded share of documents and of WORDS, what is
    SPELLED out, and random strings of LEAST_RUN to MOST_RUN characters in both forms of base 64, hexadecimal, lower case
    and capitals with digits. What the base patterns match is no ordinary string. Null texts give none."""
    spark, plain = docs.sparkSession, F.coalesce("text", F.lit(""))
    for pattern in (ASSIGN, ACCESS, HEX):
        plain = F.regexp_replace(plain, pattern, " ")
    words = docs.where(sampled(share_of(docs, TRAIN_DOCS))).select(F.slice(F.regexp_extract_all(plain, F.lit("(?<![A-Za-z0-9+/])([A-Z]?[a-z]+)(?![A-Za-z0-9+/])"), 1), 1, TRAIN_WORDS).alias("all_words"))
    known = F.split(F.lit(" ".join(WORDS.split())), " ")
    # in the order of several hashes, so that each word meets others
    shuffled = spark.range(0, 12, 1, 1).select(F.transform(F.array_sort(F.transform(known, lambda w: F.struct(F.xxhash64("id", w).alias("h"), w.alias("w")))), lambda x: x["w"]).alias("all_words"))
    lengths = spark.range(LEAST_RUN, MOST_RUN + 1, 4, 1).select(F.col("id").cast("int").alias("size"), F.explode(F.array(*map(F.lit, SPELLED))).alias("unit"))
    spelled = lengths.select(F.substring(F.repeat("unit", F.lit(MOST_RUN)), F.lit(1), F.col("size")).alias("text"), F.lit("spelled").alias("source"))
    ordinary = names(words, "documents").unionByName(names(shuffled, "words")).unionByName(spelled).withColumn("secret", F.lit(False))
    digest = F.sha2(F.concat(F.lit("secret-"), F.col("id").cast("string")), 512)
    size = F.lit(LEAST_RUN) + F.pmod(F.xxhash64("id"), F.lit(MOST_RUN - LEAST_RUN + 1)).cast("int")
    kinds = F.array("hex", "b64", F.translate(F.upper("b64"), "+/", "XY"), F.translate(F.lower("b64"), "+/", "xy"), F.translate("b64", "+/", "-_"))
    made = spark.range(TRAIN_RANDOM).select(digest.alias("hex"), F.regexp_replace(F.base64(F.unhex(digest)), "[=\r\n]", "").alias("b64"), size.alias("size")).select(F.explode(kinds).alias("text"), "size")
    return ordinary.unionByName(made.select(F.substring("text", F.lit(1), F.col("size")).alias("text"), F.lit("random").alias("source"), F.lit(True).alias("secret")))


def codes(text: Column | str) -> Column:
    """The places of the characters in ALPHABET, from 1; 0 for others."""
    return F.transform(F.split(text, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))


def train(labelled: DataFrame) -> tuple[list[int], int]:
    """The log-likelihood ratio of each transition, scaled, row by row of ALPHABET, and the threshold of the best segment.
    Only counts of character pairs come to the driver, a few thousand whatever the samples' size."""
    n = len(ALPHABET)
    pairs = labelled.select("source", codes("text").alias("c")).select("source", F.explode(F.expr("zip_with(c, slice(c, 2, size(c)), (a, b) -> (a - 1) * 1000 + b - 1)")).alias("p")).where("p is not null and p >= 0")
    counts = {(x.source, x.p): x["count"] for x in pairs.groupBy("source", "p").count().collect()}

    def chances(source: str, a: int) -> list[float]:
        row = [counts.get((source, a * 1000 + b), 0) + SMOOTHING for b in range(n)]
        return [x / sum(row) for x in row]

    ratios = []
    for a in range(n):
        usual = [sum(share * x for share, x in zip(SHARES.values(), each, strict=True)) for each in zip(*(chances(s, a) for s in SHARES), strict=True)]
        ratios += [round(SCALE * math.log(x / y)) for x, y in zip(chances("random", a), usual, strict=True)]
    ordinary = labelled.where(~F.col("secret") & F.col("text").rlike(f"^{RUN}$")).select(best_segment("text", ratios).alias("score"))
    edge = ordinary.agg(F.expr(f"percentile(score, {1 - ORDINARY_OVER})").alias("edge")).first()["edge"]
    shortest = labelled.where("secret").select(best_segment(F.substring("text", F.lit(1), F.lit(LEAST_RUN)), ratios).alias("score"))
    reached = shortest.agg(F.expr(f"percentile(score, {RANDOM_UNDER})").alias("edge")).first()["edge"]
    return ratios, round(max(edge or 0.0, reached or 0.0))


def best_segment(text: Column | str, ratios: list[int]) -> Column:
    """The greatest sum of the scaled ratios of consecutive transitions; UUIDs, repetitions and other characters end
    a segment."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<int>")
    c = codes(F.regexp_replace(text, ENDS, " "))
    steps = F.zip_with(c, F.slice(c, F.lit(2), F.size(c)), lambda a, b: F.when((a > 0) & (b > 0), F.get(table, (a - 1) * len(ALPHABET) + b - 1)))

    def step(s: Column, x: Column) -> Column:
        here = F.greatest(F.coalesce(s["here"] + x, F.lit(0)), F.lit(0)).cast("long")
        return F.struct(here.alias("here"), F.greatest(s["best"], here).alias("best"))

    zero = F.lit(0).cast("long")
    return F.aggregate(steps, F.struct(zero.alias("here"), zero.alias("best")), step, lambda s: s["best"])


SPANS = "array<struct<start:int,kind:int,end:int,val:string>>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def blocks(rows: Column) -> Column:
    """An array cut into about as many blocks as each has elements, at least one."""
    each = F.greatest(F.ceil(F.sqrt(F.size(rows))).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(rows) - 1, F.lit(0)), each), lambda i: F.slice(rows, i + 1, each))


def places(text: Column, pattern: str, kind: int, also: int = 0) -> Column:
    """Spans (start, kind, end, val) of a pattern's matches: what stands between them comes from a split by the same
    pattern, and lengths are summed along, block by block. val: the group `also`."""
    none = F.lit([]).cast(SPANS)
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(also)).alias("val"))
    steps = F.transform(rows, lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("hit"), x["val"].alias("val")))

    def one(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["hit"]).alias("end"), x["val"].alias("val"))
        return F.struct((start + F.coalesce(x["hit"], F.lit(0))).alias("at"), F.when(x["hit"].isNull(), a["out"]).otherwise(F.array_append(a["out"], span)).alias("out"))

    def block(a: Column, b: Column) -> Column:
        after = F.aggregate(b, a["at"], lambda n, x: n + x["gap"] + F.coalesce(x["hit"], F.lit(0)))
        spans = F.aggregate(b, F.struct(a["at"].alias("at"), none.alias("out")), one, lambda c: c["out"])
        return F.struct(after.alias("at"), F.array_append(a["out"], spans).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit([]).cast(f"array<{SPANS}>").alias("out"))
    found = let(steps, lambda s: F.flatten(F.aggregate(blocks(s), start, block, lambda a: a["out"])))
    return F.when(text.rlike(pattern), found).otherwise(none)


def apart(runs: Column, base: Column) -> Column:
    """The runs that no base span overlaps. Both are in order, so that a block of runs is compared with the spans near it."""

    def over(x: Column, first: Column, last: Column) -> Column:
        return (x["start"] < last["end"]) & (first["start"] < x["end"])

    def near(g: Column) -> Column:
        return F.filter(base, lambda x: F.coalesce(over(x, F.get(g, F.lit(0)), F.get(g, F.size(g) - 1)), F.lit(False)))

    return F.flatten(F.transform(blocks(runs), lambda g: let(near(g), lambda b: F.filter(g, lambda r: ~F.exists(b, lambda x: over(x, r, r))))))


def scan(docs: DataFrame, ratios: list[int], most: int) -> DataFrame:
    """kept_row (a document's row, whatever its columns), secret_text (its text, null: empty), secret_base and secret_spans:
    arrays of (start, kind, end, val), code points, end exclusive, ordered by start, then kind. secret_spans adds to the base
    spans the runs that the models call random and that no base span overlaps. Repeated rows stay. The work on a text with n
    matches grows with its length and with n times the root of n."""
    text = F.col("secret_text")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept_row"), F.coalesce("text", F.lit("")).alias("secret_text"))
    found = whole.select("kept_row", "secret_text", places(text, ASSIGN, 0, 2).alias("a"), places(text, ACCESS, 1).alias("k"), places(text, HEX, 2).alias("h"), places(text, RUN, 3).alias("r"))
    base = F.array_sort(F.concat(F.filter("a", lambda x: F.char_length(x.val) >= LEAST_VALUE), "k", "h"))
    found = found.select("kept_row", "secret_text", "r", base.alias("secret_base"))
    judged = F.filter(apart(F.col("r"), F.col("secret_base")), lambda r: best_segment(r.val, ratios) > most)
    return found.select("kept_row", "secret_text", "secret_base", F.array_sort(F.concat("secret_base", judged)).alias("secret_spans"))


def joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.kind), x.start.cast("string"), x.end.cast("string"))), ",")


def without_spans(text: Column, spans: Column) -> Column:
    """The text with MASK in place of each span, or of several that overlap."""

    def block(a: Column, b: Column) -> Column:
        last = F.greatest(a["at"], F.array_max(F.transform(b, lambda x: x["end"])))
        body = F.substring(text, a["at"] + 1, last - a["at"])

        def one(c: Column, x: Column, body: Column) -> Column:
            piece = F.concat(F.substring(body, c["at"] - a["at"] + 1, x["start"] - c["at"]), F.lit(MASK))
            return F.struct(F.greatest(c["at"], x["end"]).alias("at"), F.when(x["start"] >= c["at"], F.array_append(c["out"], piece)).otherwise(c["out"]).alias("out"))

        start = F.struct(a["at"].alias("at"), F.lit([]).cast("array<string>").alias("out"))
        pieces = let(body, lambda y: F.array_join(F.aggregate(b, start, lambda c, x: one(c, x, y), lambda c: c["out"]), ""))
        return F.struct(last.alias("at"), F.array_append(a["out"], pieces).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<string>").alias("out"))
    return F.aggregate(blocks(spans), start, block, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.char_length(text))))


def masked(docs: DataFrame, ratios: list[int], most: int) -> DataFrame:
    """docs, all columns, with every secret span of text replaced by MASK, and n_chars set to the new length; rows without a
    span (null and empty texts too) as they are. A row goes through whole, so its columns may have any names."""
    hit = F.size("secret_spans") > 0
    kept = scan(docs, ratios, most).select("kept_row", F.when(hit, without_spans(F.col("secret_text"), F.col("secret_spans"))).alias("masked_text"))
    row, text = F.col("kept_row"), F.col("masked_text")
    new = {"text": F.coalesce(text, row["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(text.isNotNull(), F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    return kept.select(*(new.get(c, row[c]).alias(c) for c in docs.columns))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; null, empty and repeated texts as in scan."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = scan(docs, *train(samples(docs)))

    def number(kind: int) -> Column:
        return F.size(F.filter("secret_base", lambda x: x.kind == kind)).cast("long")

    return found.select(
        F.col("kept_row")["doc_id"].alias("doc_id"), number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(joined("secret_base"), 256).alias("base_sha256"), joined("secret_spans").alias("spans"),
    )
