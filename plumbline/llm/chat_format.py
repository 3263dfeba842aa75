"""Chat formatting: every assistant turn becomes a training example whose context is all that comes before."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A turn is OPEN + role + HEAD, a new line, its text, CLOSE, a new line. Inside roles and texts these strings are
#: broken up by a backslash (and runs of backslashes before them grow by one), so that only the template has them.
OPEN, HEAD, CLOSE = "<turn> ### ", ":", " </turn>"
ASSISTANT = "assistant"
#: Strings of the template that a text must not contain as they are.
CONTROL = r"(\\*)(<turn>|</turn>|###)"
CONTROL_BACK = r"\\(\\*)(<turn>|</turn>|###)"

EXAMPLES = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("text", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64())])
DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
#: A batch of full examples ends once it has so many code points.
BATCH_CHARS = 4_000_000


FORMATTED = ("conv_id", "place", "is_reply", "piece", "n")


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def escape(text: F.Column) -> F.Column:
    """Puts one more backslash before each control string, whatever number it has."""
    return F.regexp_replace(text, CONTROL, r"\\$1$2")


def escape_role(role: F.Column) -> F.Column:
    """As escape(); the end mark of a role is broken up too."""
    return F.regexp_replace(escape(role), r":(\\*)\n", ":\\\\$1\n")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls as empty strings; further columns go."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return conversations.select("conv_id", "turn", text("role"), text("text"))


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, place (from 1), is_reply, piece (the turn as the template writes it), n (code points of
    its text there).

    Turns are ordered by turn (null first), then role, then text; repeated rows are turns of their own. A null conv_id
    is a conversation of its own. Rows of a conversation stand together, in order; they are rows all the way, so a
    long run of turns between two replies is no large value.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns_of(conversations).select("conv_id", F.row_number().over(order).cast("long").alias("place"), (F.col("role") == ASSISTANT).alias("is_reply"), escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("body"))
    piece = F.concat(F.lit(OPEN), "role", F.lit(HEAD + "\n"), "body", F.lit(CLOSE + "\n"))
    return rows.select("conv_id", "place", "is_reply", piece.alias("piece"), F.char_length("body").cast("long").alias("n")).sortWithinPartitions("conv_id", "place")


def expand_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full examples of formatted turns; only the context of one conversation and a batch are held."""
    now, example, out, size = None, 0, [], 0
    context, open_ = None, False  # open: turns have come since the last example

    for batch in batches:
        for conv, _, reply, piece, n in zip(*(batch.column(c).to_pylist() for c in FORMATTED), strict=True):
            if context is None or conv != now:
                if open_:
                    out.append((now, example + 1, context, None, None))
                now, context, example = conv, "", 0
            context += piece
            open_ = not reply
            if reply:
                example += 1
                end = len(context) - len(CLOSE + "\n")
                out.append((conv, example, context, end - n, end))
                size += len(context)
            if size >= BATCH_CHARS:
                yield batch_of(out, EXAMPLES)
                out, size = [], 0
    if open_:
        out.append((now, example + 1, context, None, None))
    if out:
        yield batch_of(out, EXAMPLES)


def examples(turns: DataFrame) -> DataFrame:
    """One row per example of formatted() turns: conv_id, example, text, loss_from, loss_to.

    Every assistant turn is an example: its text is all turns before it and the turn, and only the code points from
    loss_from up to loss_to (counted from 0, the end not included), those of the reply, carry loss. Turns after the
    last reply (or all, without one) give a last example without loss, so that the output holds every turn. The output
    grows with the square of the number of replies of a conversation, as full contexts do. No rows give no examples.
    """
    return turns.mapInArrow(expand_stream, "conv_id long, example long, text string, loss_from long, loss_to long")


def turns_in(text: str) -> list[tuple[str, str]]:
    """Roles and texts of the turns of an example, parsed from its text alone."""
    plain = lambda x: re.sub(CONTROL_BACK, r"\1\2", x)
    pieces = [p[: -len(CLOSE + "\n")].split(HEAD + "\n", 1) for p in re.split(r"(?<!\\)<turn> ### ", text) if p]
    return [(plain(re.sub(r":\\(\\*)\n", r":\1\n", role)), plain(body)) for role, body in pieces]


def digest_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the conversations of examples()'s rows; the last example of a conversation holds all of its turns."""
    now, last, loss_chars, loss_hash, chars = None, None, 0, hashlib.sha256(), 0

    def close():
        turns = turns_in(last)
        return now, len(turns), hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest(), loss_chars, loss_hash.hexdigest(), chars

    for batch in batches:
        out = []
        for conv, text, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss_from", "loss_to")), strict=True):
            if last is not None and conv != now:
                out.append(close())
                last = None
            if last is None:
                loss_chars, loss_hash, chars = 0, hashlib.sha256(), 0
            now, last = conv, text
            chars += len(text)
            if start is not None:
                loss = re.sub(CONTROL_BACK, r"\1\2", text[start:end])
                loss_chars += len(loss)
                loss_hash.update(loss.encode())
        if out:
            yield batch_of(out, DIGESTS)
    if last is not None:
        yield batch_of([close()], DIGESTS)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the full examples of
    formatted() turns.

    formatted_chars is the sum of the lengths of the full texts. These are made and read in one task for a
    conversation, a batch of BATCH_CHARS at a time, and are neither stored nor shuffled.
    """
    return turns.mapInArrow(lambda batches: digest_stream(expand_stream(batches)), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
