"""Helpers that several operators share: byte-level text arithmetic, hashes of spans, blocks of documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.folders import checkpointed

__all__ = ["checkpointed"]

#: Words are runs of characters other than these six, all ASCII, so bytes of UTF-8 decide.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACE_BYTES)] = False
#: A-Z to a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Texts are hashed in slices of about this many bytes, so that work arrays stay in a few dozen MB.
SLICE_BYTES = 1 << 20
#: Spans of more bytes are hashed by BLAKE2b, shorter ones eight bytes at a time.
LONG_SPAN = 1 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit values (the public splitmix64 steps)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a little-endian number, zeros beyond the end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of spans of bytes; hashes of two seeds are independent.

    Eight bytes at a time go through a non-linear step, so there are no strings that are equal for any multiplier, as
    there are for polynomials modulo 2^64.
    """
    length = end - start
    out = mix(length.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF))
    eight, add = lanes(data), np.uint64((0xD1B54A32D192ED03 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    which = np.flatnonzero((length > 0) & (length <= LONG_SPAN))
    at, left, state = start[which], length[which], out[which]
    while len(which):
        value = eight[at]
        short = left < 8
        if short.any():
            value[short] &= (np.uint64(1) << (np.uint64(8) * left[short].astype(np.uint64))) - np.uint64(1)
        state = mix((state ^ value) + add)
        more = left > 8
        if more.all():
            at, left = at + 8, left - 8
            continue
        out[which[~more]] = state[~more]
        which, at, left, state = which[more], at[more] + 8, left[more] - 8, state[more]
    for i in np.flatnonzero(length > LONG_SPAN):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, salt=bytes([seed])).digest(), "little")
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts and the last one ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, size: int = SLICE_BYTES):
    """Runs of whole rows with about size bytes each: (first row, bytes, row starts). A longer row is a run of its own."""
    data, at = buffers(column)
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_spans(data: np.ndarray, at: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of words before it (one entry more than rows)."""
    word = is_word[data]
    head = word.copy()
    head[1:] &= ~word[:-1]
    inner = at[1:-1][at[1:-1] < len(data)]
    head[inner] = word[inner]
    start = np.flatnonzero(head)
    tail = word.copy()
    tail[:-1] &= ~word[1:]
    inner = inner[inner > 0] - 1
    tail[inner] = word[inner]
    return start, np.flatnonzero(tail) + 1, np.searchsorted(start, at)


def windows(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each row, their rows, and the index of the word where each begins."""
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), np.maximum(counts - n + 1, 0))
    begin = np.arange(len(words))
    keep = np.ones(len(words), dtype=bool)
    for k in range(1, n):  # the last n - 1 words of each row begin no window
        ends = first[1:][counts >= k] - k
        keep[ends] = False
    begin = begin[keep]
    total = np.zeros(len(begin), dtype=np.uint64)
    for k in range(n):
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + words[begin + k]) if k == n - 1 else total * np.uint64(0xD6E8FEB86659FD93) + words[begin + k]
    return total, row, begin


def row_hash(rows: np.ndarray) -> np.ndarray:
    """A value for each row number, to keep equal hashes of different rows apart."""
    return mix(rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


#: Bounds of blocks are looked up in two steps: at most HEADS groups of FAN bounds or more, then the bounds of a group.
FAN, HEADS = 1 << 10, 1 << 12
#: Groups of bounds are broadcast up to so many bytes, 32 a bound: with blocks of 12 MB that serves 100 TB of text.
BROADCAST_BYTES = 256 << 20
#: Parts that rows of one group are dealt to where the groups are too large for that, and join by a shuffle.
SALTS = 64


def order_key() -> F.Column:
    """The order of documents: by doc_id, null ids first, then by a hash of the text."""
    known = F.col("doc_id").isNotNull().cast("int").alias("known")
    return F.struct(known, F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))


BOUND = ("known", "id", "hash")


def block_bounds(docs: DataFrame, block_bytes: int) -> DataFrame:
    """known, id, hash, number, first: the keys with which blocks of about block_bytes of text begin, numbered from 1 in
    their order, and the number of the first block that begins with the same key, 0 if that is the first of all; this
    one has no bound. Written to the shared folder.

    Keys and sizes (40 bytes a document) are dealt out by ranges of keys, and each range is cut where its running sum of
    bytes passes a multiple of block_bytes. So neither far ids nor null or equal ids, nor a few long texts, gather in
    one block; a single text may exceed it. Bounds are numbered within their range and by the ranges' counts.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    slim = docs.select(order_key().alias("key"), size.alias("size")).select("key.*", "size")
    ranged = slim.repartitionByRange(*BOUND).withColumn("part", F.spark_partition_id())
    running = F.sum("size").over(Window.partitionBy("part").orderBy(*BOUND).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    cuts = ranged.select(*BOUND, "part", F.floor(running / block_bytes).alias("cut"))
    firsts = checkpointed(cuts.groupBy("part", "cut").agg(F.min(F.struct(*BOUND)).alias("key")).select("part", "cut", "key.*"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a shuffle partition
    ranges = firsts.groupBy("part").agg(F.count("*").alias("begun")).select(F.col("part").alias("of"), F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("part").orderBy(*BOUND)
    numbered = firsts.select(*BOUND, "part", F.row_number().over(order).alias("nth"), F.rank().over(order).alias("rank")).join(ranges, F.col("part") == F.col("of"))
    return checkpointed(numbered.select(*BOUND, (F.col("before") + F.col("nth") - 1).alias("number"), (F.col("before") + F.col("rank") - 1).alias("first")).where("number > 0"))


def below(bounds: F.Column, key: F.Column, fan: int) -> F.Column:
    """How many of the sorted bounds (fan at most) are not above the key: a binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(fan.bit_length()))])

    def step(at: F.Column, by: F.Column) -> F.Column:
        bound = F.get(bounds, at + by - 1)
        return F.when(bound.isNotNull() & (bound <= key), at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def id_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """docs (doc_id, text, ...) with block, a number that never falls as documents ascend by order_key().

    The bounds of block_bounds() are looked up in two steps: the group of bounds, by the first bound of each (HEADS at
    most, the only ones that come to the driver), then the bound in it. Groups are rows with an array of bounds each;
    they are broadcast while BROADCAST_BYTES hold them, beyond that rows and groups meet by a shuffle, in SALTS parts a
    group. Of rows that agree in id and text and are more than a block holds, each goes to one of the blocks that
    begin with them.
    """
    bounds = block_bounds(docs, block_bytes)
    count, repeats = bounds.agg(F.count("*"), F.max(F.col("first") < F.col("number"))).first()
    if not count:
        return docs.withColumn("block", F.lit(0).cast("long"))
    fan = max(FAN, -(-count // HEADS))
    groups = bounds.groupBy(F.floor((F.col("number") - 1) / fan).alias("_group")).agg(F.array_sort(F.collect_list(F.struct(F.struct(*BOUND).alias("key"), "number", "first"))).alias("of"))
    groups = groups.select("_group", F.col("of.key").alias("_bounds"), F.col("of.first").alias("_firsts"))
    first = bounds.where((F.col("number") - 1) % fan == 0).orderBy("number").select(*BOUND).collect()
    kinds = ("int", "long", "long")
    heads = F.array(*[F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(b, kinds, BOUND, strict=True)]) for b in first])
    key = F.col("_key")
    # a group's own first bound is not above the key, but for keys before all bounds
    keyed = docs.withColumn("_key", order_key()).withColumn("_at", F.greatest(below(heads, key, len(first)) - 1, F.lit(0)).cast("long"))
    if count * 32 <= BROADCAST_BYTES:
        keyed = keyed.join(F.broadcast(groups), F.col("_at") == F.col("_group"))
    else:
        dealt = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        keyed = keyed.withColumn("_part", F.pmod(F.xxhash64("_key.id", "_key.hash"), F.lit(SALTS)).cast("int"))
        keyed = keyed.join(dealt, (F.col("_at") == F.col("_group")) & (F.col("_part") == F.col("_salt")))
    keyed = keyed.withColumn("_nth", below(F.col("_bounds"), key, fan))
    block = (F.col("_group") * fan + F.col("_nth")).cast("long")
    if repeats:  # only then may a key fill several blocks
        begins = F.get("_bounds", F.col("_nth") - 1) == key
        low = F.when(begins, F.get("_firsts", F.col("_nth") - 1)).otherwise(block)
        block = low + F.pmod(F.monotonically_increasing_id(), block - low + 1)
    return keyed.withColumn("block", block).select(*docs.columns, "block")
