"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, slices, word_spans

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 17
#: So many of each source's largest documents are placed before the others.
LARGEST = 128


def count_words(batches):
    """The batches, where text has become the number of its words."""
    for batch in batches:
        counts = [np.diff(word_spans(data, at)[2]) for _, data, at in slices(batch.column("text"))]
        sizes = pa.array(np.concatenate(counts) if counts else [], pa.int64())
        yield pa.RecordBatch.from_arrays([sizes if name == "text" else batch.column(name) for name in batch.schema.names], batch.schema.names)


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, bytes, size: the bytes and words of each whole text; a null text has none."""
    octets = F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")
    return docs.select("doc_id", "source", octets, "text").mapInArrow(count_words, "doc_id long, source string, bytes int, text long").withColumnRenamed("text", "size")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target: shares of the total by weight, none above most times its source's size.

    weights go round the sources in code-point order, null last. What a capped source can't take is shared among
    the others by weight until none is above its cap: with the caps in order of cap / weight, the level (words a
    unit of weight) is the first that its own source's cap allows, which is the greatest of those allowed. One row a source reaches the global windows. Without rows there
    are no targets; a null source is the last.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sums.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    cap = F.col("source_size") * F.lit(most)
    levels = weighted.select(
        "*",
        (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(cap).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("rest"),
        F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)).alias("rest_weight"),
    )
    level = F.col("rest") / F.col("rest_weight")
    free = F.max(F.when(F.col("weight") * level <= cap, level)).over(Window.partitionBy())
    return levels.select("source", "source_size", F.least(F.col("weight") * free, cap.cast("double")).alias("target"))


def offset(source: F.Column, seed: int) -> F.Column:
    """A fixed number in [0, 1) for each source, in 65536ths so that sums with it are exact."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\0"))))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") / 65536


def large_copies(sizes: F.Column, size: F.Column, target: F.Column, shift: F.Column, most: int) -> F.Column:
    """copies of the documents whose sizes are given (longest first), and left, rest: words to take of the other words.

    size and target are those of the whole source. A document expects left / rest copies, of the words then left to
    take and the words from it on; the sums of these plus shift give one copy for each integer crossed. No document
    takes more than is left, nor so little that the rest can't make up for it.
    """
    none = F.array().cast("array<int>")
    start = F.struct(target.cast("double").alias("left"), size.cast("long").alias("rest"), shift.cast("double").alias("at"), none.alias("copies"))

    def place(state: F.Column, words: F.Column) -> F.Column:
        rest = state["rest"] - words
        at = state["at"] + F.when(state["rest"] > 0, state["left"] / state["rest"]).otherwise(F.lit(0.0))
        high = F.when(words > 0, F.floor(state["left"] / words)).otherwise(F.lit(0))
        low = F.when(words > 0, F.ceil((state["left"] - rest * most) / words)).otherwise(F.lit(0))
        copies = F.least(F.greatest(F.least(F.greatest(F.floor(at) - F.floor(state["at"]), low), high), F.lit(0)), F.lit(most)).cast("int")
        return F.struct((state["left"] - copies * words).alias("left"), rest.alias("rest"), at.alias("at"), F.concat(state["copies"], F.array(copies)).alias("copies"))

    return F.aggregate(sizes, start, place)


def mix_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, largest: int = LARGEST) -> DataFrame:
    """One row per row of docs: doc_id, source, bytes, size, source_size, target, copies.

    A document of a source expects target / source_size copies. Within a source the prefix sums of these plus one
    random offset are taken; each integer that a document's step crosses is one copy. The largest documents of a source
    stand first, longest to shortest, and the step is set anew after each, from what is left to take and what is left
    to take it from: a document of a fifth of its source's words would otherwise put the source as far off. The others
    have the step that is left then, and stand by size, every other one on the way up, the rest on the way down again:
    copies spread over all lengths, and what the offset adds on the way up it takes back on the way down. So the words
    taken miss the target by a part of the longest of these, or of the shortest document of a source with no more than
    largest. Ranks come from ranges of (source, size, id): a count for each range and source, then a place within
    the range, so that a source with most of the rows is no single task's.

    Nulls: a null text has size 0, a null source is a source of its own (the last), a null doc_id sorts first.
    Repeated rows are documents of their own. A source without words has target 0 and takes no copies. An empty
    table gives an empty plan. Extra columns of docs don't matter.
    """
    sizes = checkpointed(word_sizes(docs))
    ordered = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id")]
    ranged = checkpointed(sizes.repartitionByRange(*ordered).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("source", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), "rows", F.sum("rows").over(Window.partitionBy("source")).alias("docs"))
    placed = ranged.withColumn("nth", F.row_number().over(Window.partitionBy("part", "source").orderBy("size", "doc_id")))
    on = lambda of, at: (F.col("part") == F.col(at)) & F.col("source").eqNullSafe(F.col(of))
    begun = starts.select(F.col("source").alias("of"), F.col("part").alias("at"), "before", "rows", "docs")
    # the largest documents of each source, longest first, and what they take
    last = placed.join(begun.where(F.col("before") + F.col("rows") > F.col("docs") - largest), on("of", "at")).where(F.col("before") + F.col("nth") > F.col("docs") - largest)
    top = last.groupBy("source").agg(F.reverse(F.sort_array(F.collect_list(F.struct((F.col("before") + F.col("nth")).alias("rank"), "size")))).alias("top"))
    shift = offset(F.col("source"), seed)
    planned = source_targets(sizes, weights, most).alias("t").join(top.alias("u"), F.col("t.source").eqNullSafe(F.col("u.source"))).select("t.source", "source_size", "target", "top")
    planned = planned.withColumn("large", large_copies(F.transform("top", lambda x: x["size"]), F.col("source_size"), F.col("target"), shift, most))
    known = starts.alias("s").join(planned.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    known = checkpointed(known.select(F.col("s.source").alias("of"), F.col("part").alias("at"), "before", "docs", "source_size", "target", "large.left", "large.rest", F.when(F.col("before") + F.col("rows") > F.col("docs") - largest, F.col("large.copies")).alias("large")))
    rank, others = F.col("before") + F.col("nth"), F.greatest(F.col("docs") - largest, F.lit(0))
    place = F.when(rank % 2 == 1, F.shiftright(rank + 1, 1)).otherwise(others - F.shiftright(rank, 1) + 1)
    step = F.when(F.col("rest") > 0, F.col("left") / F.col("rest")).otherwise(F.lit(0.0))
    rows = placed.join(known, on("of", "at")).select("doc_id", "source", "bytes", "size", "source_size", "target", rank.alias("rank"), "docs", "large", place.alias("place"), step.alias("step"), shift.alias("shift"))
    crossed = F.floor(F.col("place") * F.col("step") + F.col("shift")) - F.floor((F.col("place") - 1) * F.col("step") + F.col("shift"))
    copies = F.when(F.col("rank") > F.col("docs") - largest, F.element_at("large", (F.col("docs") - F.col("rank") + 1).cast("int"))).otherwise(F.least(crossed, F.lit(most)))
    return rows.select("doc_id", "source", "bytes", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix_report(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, size, source_size, target, taken: what the mix takes of each document, repeats counted."""
    return mix_plan(docs, **parameters).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies, with all columns of docs, of any names.

    Rows that agree in doc_id, source and length of text share out the copies planned for them. Nulls, repeated rows
    and empty tables: as in mix_plan().
    """
    plan = mix_plan(docs, **parameters).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("bytes").alias("_bytes")).agg(F.sort_array(F.collect_list("copies")).alias("_copies"))
    size = F.coalesce(F.octet_length("_row.text"), F.lit(0))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    nth = F.row_number().over(Window.partitionBy("_row.doc_id", "_row.source", size).orderBy("_row.text"))
    on = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & F.col("_row.source").eqNullSafe(F.col("_source")) & (size == F.col("_bytes"))
    joined = packed.withColumn("_nth", nth).join(plan, on)
    taken = F.element_at("_copies", F.col("_nth")).cast("int")
    return joined.where(taken > 0).select("_row", F.explode(F.sequence(F.lit(1), taken)).alias("_copy")).select("_row.*")
