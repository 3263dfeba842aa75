"""Concatenated JSON objects of large files, read by ranges of bytes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range; and so many are read at a time beyond it, for the object that goes on there.
RANGE_BYTES, MORE_BYTES = 32 << 20, 1 << 16
QUOTE, BACKSLASH, OPEN, CLOSE = b'"\\{}'


def read_range(path: str, start: int, size: int) -> bytes:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    with system.open_input_file(name) as file:
        file.seek(start)
        return file.read(size)


def scan(data: bytes, in_string: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """Places of the braces outside strings and +1 or -1 for each, and the state after the bytes: whether they end in a
    string, and with a backslash that the next byte belongs to."""
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), in_string, escaped
    at = np.arange(len(x))
    slash = x == BACKSLASH
    last = np.maximum.accumulate(np.where(slash, -1, at))  # the last place before or at which there is no backslash
    run = np.where(slash, at - last, 0)
    run += np.where(slash & (last < 0), int(escaped), 0)  # a backslash before the first byte is one of the run
    before = np.concatenate([[int(escaped)], run[:-1]])
    quote = (x == QUOTE) & (before % 2 == 0)
    inside = (np.cumsum(quote) + int(in_string)) % 2 == 1
    brace = np.flatnonzero(((x == OPEN) | (x == CLOSE)) & ~inside)
    return brace, np.where(x[brace] == OPEN, 1, -1), bool(inside[-1]), bool(inside[-1] and run[-1] % 2)


def summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a range does to each state that it may begin in: the state after it, and the change of depth."""
    for frame in frames:
        out = []
        for file, start, size in zip(frame["file"], frame["start"], frame["size"], strict=True):
            data = read_range(file, start, size)
            for state, (in_string, escaped) in enumerate(((False, False), (True, False), (True, True))):
                _, change, then, slash = scan(data, in_string, escaped)
                out.append((file, start, size, state, 2 if slash else int(then), int(change.sum())))
        yield pd.DataFrame(out, columns=["file", "start", "size", "state", "then", "change"])


def begun(frame: pd.DataFrame) -> pd.DataFrame:
    """The state and depth in which each range of a file begins: three rows a range, in order."""
    state, depth, out = 0, 0, []
    of = {(s, k): (t, c) for s, k, t, c in zip(frame["start"], frame["state"], frame["then"], frame["change"], strict=True)}
    for start, size in sorted(set(zip(frame["start"], frame["size"], strict=True))):
        out.append((frame["file"].iloc[0], start, size, state, depth))
        then, change = of[start, state]
        state, depth = then, depth + change
    return pd.DataFrame(out, columns=["file", "start", "size", "state", "depth"])


def objects(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The objects that begin in each range; the last one is read to its end beyond it."""
    for frame in frames:
        for file, start, size, state, depth in frame[["file", "start", "size", "state", "depth"]].itertuples(index=False):
            data = read_range(file, start, size)
            brace, change, in_string, escaped = scan(data, state > 0, state == 2)
            levels = depth + np.cumsum(change)
            heads = brace[(change > 0) & (levels == 1)]
            ends = brace[(change < 0) & (levels == 0)] + 1
            ends = ends[ends > heads[0]] if len(heads) else ends[:0]
            tail, level = b"", int(levels[-1]) if len(levels) else depth
            while len(ends) < len(heads):
                more = read_range(file, start + size + len(tail), MORE_BYTES)
                if not more:
                    break
                brace, change, in_string, escaped = scan(more, in_string, escaped)
                closed = np.flatnonzero(level + np.cumsum(change) == 0)
                if len(closed):
                    ends = np.append(ends, len(data) + len(tail) + brace[closed[0]] + 1)
                tail, level = tail + more, level + int(change.sum())
            whole, out = data + tail, []
            for a, b in zip(heads.tolist(), ends.tolist(), strict=False):
                try:
                    out.append((file, start + a, json.dumps(json.loads(whole[a:b].decode("utf-8")), ensure_ascii=False)))
                except ValueError:
                    continue
            yield pd.DataFrame(out, columns=["file", "position", "object"])


def concatenated_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, position, object: JSON objects that follow one another, with or without space between; position is the
    byte where an object begins, object its text.

    Files are cut into ranges of bytes, each a task of its own. Whether a range begins inside a string, and how deep,
    depends on all before: a first pass says for each range what it does to every state it may begin in, three small
    rows, which are put together for each file; a second pass reads the objects that begin in the range. Braces in strings,
    escapes and characters cut by a range's end are no trouble. Between objects there may be anything without quotes and
    braces; what has balanced braces but is no JSON, and an object without an end, is left out. Workers open the files
    by pyarrow, so the path must be of a kind that it knows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    starts = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = starts.select("file", "start", F.least(F.lit(range_bytes), F.col("length") - F.col("start")).cast("long").alias("size")).repartition("file", "start")
    known = ranges.mapInPandas(summaries, "file string, start long, size long, state int, then int, change long")
    placed = known.groupBy("file").applyInPandas(begun, "file string, start long, size long, state int, depth long")
    return placed.repartition("file", "start").mapInPandas(objects, "file string, position long, object string")
