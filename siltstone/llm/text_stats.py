"""Rule statistics of whole texts, shared by the quality operators."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from siltstone.llm.common import in_bounds, released, small_batches

#: White space, and the characters that count as symbols (fixed values of the rules).
WHITE, SYMBOLS = "\x20\x09\x0a\x0b\x0c\x0d", "#*$%&|<>"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WINDOW = 8
COUNTS = ["n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks"]
#: What models see: shares and logarithms of the counts.
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "marks", "line_words"]
OTHER, BLANK, SYMBOL, UPPER, DIGIT, MARK, ODD_SPACE = range(7)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of each code point."""
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isupper():
            table[i] = UPPER
        elif c.isdigit():
            table[i] = DIGIT
        elif c.isspace():
            table[i] = ODD_SPACE
    for chars, kind in ((WHITE, BLANK), (SYMBOLS, SYMBOL), ("!?", MARK)):
        table[[ord(c) for c in chars]] = kind
    return table


#: Odd multipliers that mix the words of a window.
MIX = np.array([pow(0x9E3779B97F4A7C15, j + 1, 2**64) | 1 for j in range(WINDOW)], np.uint64)


def repeated_words(words: list[str]) -> int:
    """Words in windows of WINDOW words that are found twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    mixed = ids[:n] * MIX[0]
    for j in range(1, WINDOW):
        mixed = mixed * MIX[1] ^ ids[j : j + n] * MIX[j]
    ordered = np.sort(mixed)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(mixed, again))
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def counts(text: str) -> tuple[int, ...]:
    """The COUNTS of a text."""
    found = np.bincount(kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")], minlength=7).tolist()
    words = WORD.findall(text) if found[ODD_SPACE] else text.split()
    lines = text.split("\n")
    with_word = [x for x in lines if x.strip(WHITE)]
    return (
        len(text), len(words), len(text) - found[BLANK], found[SYMBOL], len(with_word) - len(set(with_word)), repeated_words(words),
        len(with_word), len(set(words)), found[UPPER], found[DIGIT], found[MARK],
    )


def features(x: pd.DataFrame) -> np.ndarray:
    """The FEATURES of rows of COUNTS, one column each; zeros for texts without words."""
    words, chars = np.maximum(x["n_words"], 1), np.maximum(x["word_chars"], 1)
    return np.column_stack([
        np.log1p(x["n_words"]), x["word_chars"] / words, x["n_symbols"] / chars, x["n_dup_lines"] / np.maximum(x["n_lines"], 1), x["n_repeat_words"] / words,
        x["n_distinct"] / words, x["n_upper"] / chars, x["n_digits"] / chars, x["n_marks"] / chars, x["n_words"] / np.maximum(x["n_lines"], 1),
    ]).astype(float)


def with_counts(docs: DataFrame, also: list[str] | None = None) -> DataFrame:
    """doc_id, any other columns named, and the COUNTS of every whole text (null: empty). Repeated rows stay. The column
    `text` may be named too, and other columns of docs, whatever their names, stay out."""
    kept = ["doc_id", *(also or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("counted_text").to_pylist()
            for part in in_bounds(texts):
                found = zip(*(counts(x or "") for x in texts[part]), strict=True)
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*(rows.column(x) for x in range(len(kept))), *(pa.array(x, pa.int64()) for x in found)], [*kept, *COUNTS])
            released()

    small_batches(docs.sparkSession)
    rows = docs.select(*kept, F.col("text").alias("counted_text"))
    schema = StructType([*rows.schema.fields[:-1], *(StructField(x, LongType()) for x in COUNTS)])
    return rows.mapInArrow(run, schema)
