"""Conversations rebuilt from event logs, then rendered with a template that can be read back.

A log has rows (conv_id, turn, seq, kind, role, text). Kinds: `message` opens a message at its turn; `delta` adds to the
text of the turn's latest message; `edit` replaces that text; `regenerate` empties it for the deltas that follow, and
voids all events of later turns that came before it (they answered the old text). The log is dealt out by conversation
and sorted by turn and sequence, so that one pass folds it while it holds one message, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import small_batches

#: The template's control strings, in the order of a turn: <s>role[INST]text[/INST]</s>.
OPEN, BODY, END_BODY, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = "|".join(re.escape(x) for x in ("\\", OPEN, BODY, END_BODY, CLOSE))
ASSISTANT = "assistant"
LOG = ["conv_id", "turn", "seq", "kind", "role", "text"]


def fold_log(log: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the final messages, in order within each partition. Null role or text: empty; events
    of the same sequence number are taken by kind, role and text; repeated messages stay; a delta, edit or regeneration
    without a message opens one. Extra columns are dropped."""

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = zip(*out, strict=True) if out else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["conv_id", "turn", "role", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = turn = role = None
        text: list[str] | None = None
        void = pending = None
        for batch in batches:
            out = []
            for c, t, seq, kind, r, x in zip(*(batch.column(name).to_pylist() for name in LOG), strict=True):
                if (c, t) != (conv, turn):
                    if text is not None:
                        out.append((conv, turn, role, "".join(text)))
                    text = None
                    void = pending if c == conv else None
                    pending = void
                    conv, turn = c, t
                if void is not None and (seq is None or seq <= void):
                    continue
                if kind == "message" and text is not None:
                    out.append((conv, turn, role, "".join(text)))
                if kind == "message" or text is None:
                    role, text = r, []
                if kind in ("edit", "regenerate"):
                    text = []
                if kind == "regenerate":
                    pending = seq if pending is None else max(pending, seq or 0)
                else:
                    text.append(x)
            yield rows_of(out)
        if text is not None:
            yield rows_of([(conv, turn, role, "".join(text))])

    small_batches(log.sparkSession)
    empty = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    ordered = log.select("conv_id", "turn", "seq", "kind", *empty).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, turn long, role string, text string")


def escaped(text: Column | str) -> Column:
    """A backslash before each control string and each backslash."""
    return F.regexp_replace(text, f"({CONTROL})", r"\\$1")


def render(messages: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, loss_start, loss_end: the turn's part of the formatted conversation and the span in it
    (code points, end exclusive) that is learned, empty but for assistant turns. Rows keep their order."""
    head = F.concat(F.lit(OPEN), escaped("role"), F.lit(BODY))
    parts = messages.select("conv_id", "turn", "role", head.alias("head"), escaped("text").alias("body"))
    start = F.char_length("head")
    return parts.select(
        "conv_id", "turn", F.concat("head", "body", F.lit(END_BODY + CLOSE)).alias("formatted"), start.alias("loss_start"),
        F.when(F.col("role") == ASSISTANT, start + F.char_length("body")).otherwise(start).alias("loss_end"),
    )


#: A turn with its role and text escaped.
TURN = re.compile(rf"{re.escape(OPEN)}((?:[^\\\[]|\\.|\[(?!INST\]))*){re.escape(BODY)}(.*){re.escape(END_BODY + CLOSE)}\Z", re.S)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    role, text = TURN.match(formatted).groups()
    return unescaped(role), unescaped(text)


def digests(rendered: DataFrame) -> DataFrame:
    """What is read back from the rendered turns of each conversation: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. Takes render()'s rows as they come, and holds one turn."""

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        columns = zip(*out, strict=True) if out else ((),) * 6
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def row() -> tuple:
            n, turns, loss, chars, formatted = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

        for batch in batches:
            out = []
            for c, x, i, j in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        out.append(row())
                    conv, state = c, [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                role, text = read_turn(x)
                learned = unescaped(x[i:j])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2].update(learned.encode())
                state[3] += len(learned)
                state[4] += len(x)
            yield rows_of(out)
        if state is not None:
            yield rows_of([row()])

    return rendered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def log_of(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as a log: each row is a message of its turn."""
    return conversations.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1; null roles and texts are empty, turns repeated or null stay, in order."""
    words = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", words), (-1, 1, ASSISTANT, words)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    return digests(render(fold_log(log_of(rows))))
