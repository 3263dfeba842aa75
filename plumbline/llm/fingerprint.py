"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, id_blocks, order_key

WORDS = 5
#: One shingle hash in so many is kept: a text of 300 words has about 37, a likeness of 1/3 a standard error of 0.07.
SCALE = 8
BLOCK_BYTES = 4 << 20
#: The first keys of blocks are broadcast while there are so many of them or fewer, some 64 bytes each.
BROADCAST_BLOCKS = 1 << 22
#: Blocks are numbered by runs of so many, so that one task sees a row for each 16 GB of text at most.
RUN = 1 << 12
SPACE = " \t\n\x0b\f\r"


def words(text: F.Column) -> F.Column:
    trimmed = F.trim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def let(value: F.Column, body) -> F.Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def word_hashes(text: F.Column) -> F.Column:
    return F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))


def sketch_of(hashes: F.Column, n: int = WORDS, scale: int = SCALE) -> F.Column:
    """sketch() from word_hashes()."""
    limit = (1 << 64) // scale
    shingles = F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*[hashes[i + k] for k in range(n)]))
    short = F.when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
    return F.array_sort(F.array_distinct(F.filter(F.when(F.size(hashes) >= n, shingles).otherwise(short), lambda h: (h >= 0) & (h < limit))))


def sketch(text: F.Column, n: int = WORDS, scale: int = SCALE) -> F.Column:
    """The sorted distinct hashes of n-word shingles below 1 / scale of all hash values.

    The bound is the same for every text, so sketches of parts merge by union, and of two texts of any lengths the
    shared share of one's hashes estimates how much of it the other contains. Fewer than n words are one shingle.
    A short text may have no hash below the bound, and so an empty sketch. Null text: as empty, with an empty sketch.
    """
    return let(word_hashes(text), lambda h: sketch_of(h, n, scale))


def fingerprint(text: F.Column, n: int = WORDS, scale: int = SCALE) -> F.Column:
    """sketch, and digest: a hash of all words in order, null without any, that tells texts without a sketch apart."""
    return let(word_hashes(text), lambda h: F.struct(sketch_of(h, n, scale).alias("sketch"), F.when(F.size(h) > 0, F.xxhash64(h)).alias("digest")))


def as_text(of: F.Column) -> F.Column:
    """A fingerprint as hex numbers: the digest, a colon, the sketch; empty for a text without words."""
    return F.coalesce(F.concat(F.hex(of["digest"]), F.lit(":"), F.array_join(F.transform(of["sketch"], F.hex), ",")), F.lit(""))


def likeness(a: F.Column, b: F.Column) -> F.Column:
    """Estimated Jaccard similarity of two fingerprints; where both sketches are empty 1 for equal words, else 0."""
    x, y = a["sketch"], b["sketch"]
    shared = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), a["digest"].eqNullSafe(b["digest"]).cast("double")).otherwise(shared / (F.size(x) + F.size(y) - shared))


def containment(a: F.Column, b: F.Column) -> F.Column:
    """Estimated share of sketch a's shingles that sketch b has; null if a is empty, as it then says nothing."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merged(sketches: F.Column) -> F.Column:
    """The sketch of several texts together, from an array of their sketches."""
    return F.array_sort(F.array_distinct(F.flatten(sketches)))


def fingerprints(docs: DataFrame, n: int = WORDS, scale: int = SCALE) -> DataFrame:
    """doc_id, sketch, digest of each row of docs."""
    return docs.select("doc_id", fingerprint(F.col("text"), n, scale).alias("of")).select("doc_id", "of.*")


def first_keys(blocks: DataFrame) -> DataFrame:
    """block, first_key, previous of each block of rows (block, key): the block before it, before the first the last.

    Runs of RUN blocks are one group each; the last block of each run before comes from a row a run.
    """
    begun = checkpointed(blocks.groupBy("block").agg(F.min("key").alias("first_key")).withColumn("run", F.floor(F.col("block") / RUN)))
    last = begun.agg(F.max("block")).first()[0]
    runs = begun.groupBy("run").agg(F.max("block").alias("top")).select(F.col("run").alias("of"), F.lag("top").over(Window.orderBy("run")).alias("before"))
    inner = F.lag("block").over(Window.partitionBy("run").orderBy("block"))
    return begun.withColumn("inner", inner).join(runs, F.col("run") == F.col("of")).select("block", "first_key", F.coalesce("inner", "before", F.lit(last).cast("long")).alias("previous"))


def with_next(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text, print of each row with next_text, next_print of the row that follows by doc_id.

    After the last comes the first. Null ids come first, equal ids stand by a hash of their text, a null text is empty,
    repeated rows follow one another. Rows go to blocks of ids; the document that begins a block is also sent to the
    block before, so the texts move once.
    """
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block_bytes = max(1 << 14, min(block_bytes, total // (16 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    plain = id_blocks(given, block_bytes).withColumn("key", order_key())
    blocks = checkpointed(first_keys(plain))
    known = plain.join(F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks.hint("merge"), "block")
    rows = known.withColumn("print", fingerprint(F.col("text")))
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("previous").alias("block"), F.lit(True).alias("guest"))
    sent = rows.select("doc_id", "key", "text", "print", F.explode(F.when(F.col("key") == F.col("first_key"), F.array(own, guest)).otherwise(F.array(own))).alias("to"))
    sent = sent.select("doc_id", "key", "text", "print", "to.*")
    order = Window.partitionBy("block").orderBy("guest", "key", "text")
    led = sent.select("doc_id", "text", "print", "guest", F.lead("text").over(order).alias("next_text"), F.lead("print").over(order).alias("next_print"))
    return led.where(~F.col("guest")).drop("guest")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs: its fingerprint, that of its edited text, and the likeness to it and to the next.

    The edited text is the whole text with its last floor(n_chars / 2) code points replaced by as many first code
    points of the next document, or all if it has fewer. An empty table gives no rows.
    """
    n = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 2).cast("int")), F.substring(F.col("next_text"), F.lit(1), F.floor(n / 2).cast("int")))
    rows = with_next(docs).select("doc_id", n.cast("long").alias("n_chars"), "print", "next_print", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "print", "next_print", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_print"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
