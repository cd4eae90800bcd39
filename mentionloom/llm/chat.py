"""Chat formatting by prefix-target expansion, stored with shared prefixes.

Every assistant turn becomes an example of its own: all turns before it are its
context, and its reply alone is trained on.  The examples of a conversation share
their prefixes, so they are stored once: one row a turn, with the formatted
segment and the place where it begins.  An assistant row is an example; its
context is what the conversation has before ``start``, its loss mask a range
inside its own segment.  The rows grow with the turns, however long a
conversation is; ``full_examples`` spells the examples out.  Both ``full_examples``
and ``read_back`` get their examples from one expansion, which walks a
conversation's rows in order; reading back keeps a running digest of the context,
so every example's whole text is hashed without being written again and again.

A turn is written as <|im_start|>role, newline, text, <|im_end|>, newline.  Inside
texts and roles every "<" with any number of backslashes and a "|" after it gets
one backslash more, so no control string can appear there, and taking one away
gives the text back.  Backslashes and line ends inside a role are written with a
backslash before.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row a turn: conv_id, turn, position, role, segment, start, example, loss_start, loss_end.

    position counts a conversation's turns from 0, by turn, then role and text
    (nulls first); start counts code points of the conversation before the
    segment.  For assistant turns example counts from 0 and loss_start and
    loss_end bound the reply inside the segment; they are null for others.  Null
    roles and texts are empty; null conv_ids form one conversation.  Repeated
    rows are turns of their own.  Other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), escape(text).alias("body"))
    rows = rows.withColumn("head_length", F.length(head)).withColumn("segment", F.concat(head, "body", F.lit(STOP + "\n")))
    reply = F.col("role") == "assistant"
    return rows.select(
        "conv_id",
        "turn",
        (F.row_number().over(order) - 1).cast("long").alias("position"),
        "role",
        "segment",
        F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)).cast("long").alias("start"),
        F.when(reply, F.coalesce(F.sum(reply.cast("int")).over(before), F.lit(0))).cast("long").alias("example"),
        F.when(reply, F.col("head_length")).cast("long").alias("loss_start"),
        F.when(reply, F.col("head_length") + F.length("body")).cast("long").alias("loss_end"),
    )


class _Conversation:
    """Walks the rows of one conversation in order and expands each assistant turn into its example.

    The context of an example is all that came before it: ``context`` is told of
    every segment once and stands for the text so far when an example is made.
    """

    def __init__(self, context):
        self.context, self.chars, self.turns, self.examples = context, 0, 0, 0

    def turn(self, row: dict) -> tuple[int, int, int] | None:
        """Take a row; for an assistant turn its example: number, and bounds of the reply in the example's text."""
        if row["start"] != self.chars or row["position"] != self.turns:
            raise ValueError("segments out of place")
        example = None
        if row["example"] is not None:
            if row["example"] != self.examples:
                raise ValueError("examples out of order")
            example = row["example"], self.chars + row["loss_start"], self.chars + row["loss_end"]
            self.examples += 1
        self.context.update(row["segment"].encode("utf-8", "surrogatepass"))
        self.chars += len(row["segment"])
        self.turns += 1
        return example


class _Text:
    """A context that keeps its text."""

    def __init__(self):
        self.parts: list[bytes] = []

    def update(self, part: bytes) -> None:
        self.parts.append(part)

    def text(self) -> str:
        self.parts = [b"".join(self.parts)]
        return self.parts[0].decode("utf-8", "surrogatepass")


_WALKED = ["conv_id", "position", "segment", "start", "example", "loss_start", "loss_end"]


def _in_order(turns: DataFrame) -> DataFrame:
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "position").select(*_WALKED)


def full_examples(turns: DataFrame) -> DataFrame:
    """Spell the examples of ``format_turns`` out: conv_id, example, text, loss_start, loss_end.

    Streams over sorted partitions and holds one conversation's text at a time.
    What it writes grows with the square of a conversation's length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, walk = None, None
        for batch in batches:
            types = (batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.int64())
            for row in batch.to_pylist():
                if walk is None or row["conv_id"] != conv:
                    conv, walk = row["conv_id"], _Conversation(_Text())
                example = walk.turn(row)
                if example is not None:
                    out = (conv, example[0], walk.context.text(), example[1], example[2])
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, types, strict=True)], ["conv_id", "example", "text", "loss_start", "loss_end"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    return _in_order(turns).mapInArrow(run, f"conv_id {kind}, example long, text string, loss_start long, loss_end long")


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and text of a segment; raises if it isn't one whole turn."""
    if not (segment.startswith(START) and segment.endswith(STOP + "\n")):
        raise ValueError("not a formatted turn")
    role, newline, body = segment[len(START) : -len(STOP) - 1].partition("\n")
    if not newline or "<|" in body or "<|" in role:
        raise ValueError("control string inside a turn")
    return unescape_role(role), unescape(body)


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of each conversation, from its expanded examples and parsed segments.

    Columns: conv_id, n_turns, turns_sha256 over role, newline, text, newline of
    every turn, loss_chars and loss_sha256 of the replies under the loss masks of
    the examples, formatted_chars, n_examples, examples_sha256 (of the SHA-256 of
    each example's whole text, context and reply, in hexadecimal, end to end).
    Turns stream in order through running digests, so a conversation of any
    length needs memory for one batch; as a digest of a sequence is worked out
    from its start to its end, one conversation is read by one task.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "examples_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, walk, conv, out, chars = pa.int64(), None, None, [], 0
        all_turns = loss = examples = hashlib.sha256()

        def close() -> None:
            if walk is not None:
                out.append((conv, walk.turns, all_turns.hexdigest(), chars, loss.hexdigest(), walk.chars, walk.examples, examples.hexdigest()))

        def flush() -> pa.RecordBatch:
            types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)
            out.clear()
            return batch

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if walk is None or row["conv_id"] != conv:
                    close()
                    conv, walk, chars = row["conv_id"], _Conversation(hashlib.sha256()), 0
                    all_turns, loss, examples = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
                before, segment = walk.chars, row["segment"]
                example = walk.turn(row)
                role, text = parse_segment(segment)
                all_turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if example is not None:
                    # The mask is given in the example's text, whose tail this segment is.
                    reply = unescape(segment[example[1] - before : example[2] - before])
                    chars += len(reply)
                    loss.update(reply.encode("utf-8", "surrogatepass"))
                    examples.update(walk.context.copy().hexdigest().encode())
            yield flush()
        close()
        yield flush()

    kind = turns.schema["conv_id"].dataType.simpleString()
    return _in_order(turns).mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, examples_sha256 string")
