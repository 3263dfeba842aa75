"""Line dedup: later copies of repeated runs of lines go, found by a suffix array over line ids.

The corpus is a sequence of line ids a document. Distributed prefix doubling ranks its suffixes by their first 1, 2,
4, ... lines: the rank of a doubled prefix is the place of its pair of ranks in a global sort. A suffix whose prefix
occurs once is settled and leaves. The suffixes that have a common prefix of L lines are an interval of the suffix array;
the ranks of their first 2^k and last 2^k of these lines, 2^k the greatest power not above L, tell it apart from all
others. An interval whose common prefix has the words of the threshold is a repeated run; its first occurrence in corpus
order stays, the later ones are deleted. Doubling ends at the depth that the threshold of words asks for, as a longer
run is covered by the intervals of its parts of that length.
"""

from __future__ import annotations

import hashlib
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import checkpointed, slices, word_spans

#: A repeated run has so many words at least.
MIN_WORDS = 50

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LINES = "doc_id long, text_hash long, seq int, h1 long, h2 long, need int, most int"


def line_spans(data: np.ndarray, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and words of the lines that have a word."""
    breaks = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([at, breaks, breaks + 1]))
    words = np.diff(np.searchsorted(starts, cuts))
    real = words > 0
    begin = cuts[:-1][real]
    return begin, cuts[1:][real], np.searchsorted(at, begin, side="right") - 1, words[real]


def lines_of(min_words: int):
    def lines(batches):
        for batch in batches:
            for first_row, data, at in slices(batch.column("text")):
                starts = word_spans(data, at)[0]
                begin, end, row, words = line_spans(data, at, starts)
                if not len(begin):
                    continue
                raw = memoryview(data.tobytes())
                ids128 = b"".join([hashlib.blake2b(raw[a:z], digest_size=16).digest() for a, z in zip(begin.tolist(), end.tolist(), strict=True)])
                h1, h2 = np.frombuffer(ids128, np.int64).reshape(-1, 2).T.copy()
                first = np.searchsorted(row, np.arange(len(at)))
                seq = np.arange(len(row)) - first[row]
                sums = np.concatenate([[0], np.cumsum(words)])
                reach = np.searchsorted(sums, sums[:-1] + min_words)  # the first cut with enough words
                need = np.where(reach <= first[row + 1], reach - np.arange(len(row)), 0)
                # a window that ends at a line, with the fewest lines back, has need to most lines from where it starts
                most = np.where(need > 0, np.maximum(np.minimum(np.append(reach[1:] - 1, len(row)), first[row + 1]) - np.arange(len(row)), need), 0)
                ids = batch.slice(first_row, len(at) - 1)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [ids.column("doc_id").take(take), ids.column("text_hash").take(take), pa.array(seq, pa.int32()), pa.array(h1), pa.array(h2), pa.array(need, pa.int32()), pa.array(most, pa.int32())],
                    ["doc_id", "text_hash", "seq", "h1", "h2", "need", "most"],
                )

    return lines


def ranked(occurrences: DataFrame, keys: list[str]) -> DataFrame:
    """keys and rank, for the values of keys that occur twice or more; ranks rise with the keys."""
    repeated = occurrences.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    return checkpointed(repeated.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()))


def shifted(ranks: DataFrame, by: F.Column) -> DataFrame:
    """ranks as they are seen from so many lines before: joins on (doc_id, text_hash, seq)."""
    return ranks.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), (F.col("seq") - by).alias("_seq"), F.col("rank").alias("after"))


def pairs(ranks: DataFrame, others: DataFrame) -> DataFrame:
    return ranks.join(others, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")) & (F.col("target") == F.col("_seq"))).drop("_doc", "_hash", "_seq", "target")


def repeated_windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, seq, need: runs of need lines that occur before in the corpus and cover all lines that go.

    A line of a run of min_words words or more that occurs before is either in the shortest window of so many words
    from the run's start, or in the shortest one that ends at the line itself; both lie in the run. So the windows
    looked up are, for each line, the shortest that starts there and the shortest that ends there.

    Corpus order is (doc_id, text_hash, seq), null ids first; seq counts the lines that have a word.
    """
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    lines = checkpointed(keyed.mapInArrow(lines_of(min_words), LINES))
    known = ranked(lines, ["h1", "h2"])
    # repeated rows count once here, or each doubling would square their number; rewriter() sees to their copies
    ranks = checkpointed(lines.join(known, ["h1", "h2"]).select("doc_id", "text_hash", "seq", "need", "most", "rank").distinct())
    found, length = None, 1
    while True:
        low, high = F.greatest("need", F.lit(length)), F.least("most", F.lit(2 * length - 1))
        here = ranks.where((F.col("need") > 0) & (low <= high)).withColumn("need", F.explode(F.sequence(low, high))).drop("most")
        here = here.withColumn("target", F.col("seq") + F.col("need") - length)
        here = here.withColumn("after", F.col("rank")).drop("target") if length == 1 else pairs(here, shifted(ranks, F.lit(0)))
        found = here if found is None else found.unionByName(here)
        if not ranks.where(F.col("most") >= 2 * length).head(1):
            break
        doubled = checkpointed(pairs(ranks.withColumn("target", F.col("seq") + length), shifted(ranks, F.lit(0))).withColumnRenamed("rank", "before"))
        known = ranked(doubled, ["before", "after"])
        ranks = checkpointed(doubled.join(known, ["before", "after"]).select("doc_id", "text_hash", "seq", "need", "most", "rank"))
        length *= 2
    found = checkpointed(found.select("doc_id", "text_hash", "seq", "need", "rank", "after"))
    key = ["need", "rank", "after"]
    place = F.struct("doc_id", "text_hash", "seq")
    firsts = checkpointed(found.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))  # so that the join can be split where a run is very common
    return found.join(firsts, key).where(place > F.col("first")).select("doc_id", "text_hash", "seq", "need")


def cut_lines(text: str, covered: list[tuple[int, int]] | None) -> tuple[str, int]:
    """text without the lines that a (seq, need) covers, and their number; None covers all."""
    covered = sorted(covered, reverse=True) if covered is not None else [(0, len(text))]
    kept, seq, removed, until = [], 0, 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\f\r"):
            while covered and covered[-1][0] <= seq:
                until = max(until, sum(covered.pop()))
            if seq < until:
                removed += 1
            else:
                kept.append(line)
            seq += 1
        else:
            kept.append(line)
    return "\n".join(kept), removed


def rewriter(min_words: int):
    def rewrite(batches):
        for batch in batches:
            texts, removed = [], []
            for text, spans, copy in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist(), batch.column("_copy").to_pylist(), strict=True):
                n = 0
                if text is not None and copy > 1 and sum(1 for _ in islice(WORD.finditer(text), min_words)) == min_words:
                    text, n = cut_lines(text, None)
                elif spans:
                    text, n = cut_lines(text, [(s["seq"], s["need"]) for s in spans])
                texts.append(text)
                removed.append(n)
            names = batch.schema.names
            columns = dict(zip(names, batch.columns, strict=True)) | {"_text": pa.array(texts, pa.string()), "_removed": pa.array(removed, pa.int64())}
            columns = {k: v for k, v in columns.items() if k not in ("_spans", "_copy")}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rewrite


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text after the deletion, and removed_lines: the number of lines that went.

    A line goes if it is part of a run of lines with min_words words or more that occurs before in the corpus: in a
    row of smaller doc_id, or earlier in the row. All runs are judged on the texts as given. Lines without a word
    are no part of runs and stay. Shorter repeats stay. Of rows with equal doc_id and text, one is first and the
    others are copies of it. Null text: nothing to remove, stays null. Null doc_id: before all others. An empty table
    gives an empty table. Columns other than doc_id and text are passed on; a removed_lines among them is replaced.
    """
    spans = repeated_windows(docs, min_words).groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_key")).agg(F.collect_list(F.struct("seq", "need")).alias("_spans"))
    others = [c for c in docs.columns if c not in ("text", "removed_lines")]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col("text").alias("_text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    joined = keyed.join(spans, F.col("_row.doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_key")), "left")
    numbered = joined.withColumn("_copy", F.row_number().over(Window.partitionBy(F.col("_row.doc_id"), "_hash").orderBy(F.lit(0))))
    packed = numbered.select("_row", "_text", "_spans", "_copy")
    schema = StructType([packed.schema["_row"], packed.schema["_text"], StructField("_removed", LongType())])
    out = packed.mapInArrow(rewriter(min_words), schema)
    columns = [F.col("_text").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != "removed_lines"]
    return out.select(*columns, F.col("_removed").alias("removed_lines"))
