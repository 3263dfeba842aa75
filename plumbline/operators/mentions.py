"""Known names in texts, as substrings, by automata over the names."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Bytes of names in one automaton, about; a worker holds some thirty times as much while it reads its texts.
SHARD_BYTES = 8 << 20


def automaton(names: Sequence[tuple[str, list[str]]]):
    """An Aho-Corasick automaton over lower-cased names; a place holds all names that are alike when lower-cased."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for place, (low, _) in enumerate(names):
        out.add_word(low, place)
    out.make_automaton()
    return out


def shards_of(names: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    known = names.where("name <> ''").select("name", F.lower("name").alias("low")).groupBy("low").agg(F.sort_array(F.collect_set("name")).alias("names"))
    total = known.agg(F.sum(F.octet_length("low") + F.octet_length(F.array_join("names", "")))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    return known.withColumn("shard", F.pmod(F.xxhash64("low"), F.lit(shards))), shards


def mentions(texts: DataFrame, names: DataFrame, keys: Sequence[str], shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """keys, names: for each text with any, the distinct names (of column name) that are part of it, in any case.

    A name may stand anywhere, inside words and beside punctuation too. Names are dealt by hash to shards of bounded size;
    each shard's automaton is sent to the workers and goes over every text once, so the cost of a text doesn't grow with
    the names of a shard, and nothing is shuffled. Null texts and null or empty names find nothing.
    """
    known, shards = shards_of(names, shard_bytes)
    given = texts.where("text is not null").select(*keys, F.lower("text").alias("_low"))
    out = None
    for shard in range(shards):
        rows = [(r.low, r.names) for r in known.where(F.col("shard") == shard).select("low", "names").toLocalIterator()]
        if not rows:
            continue
        sent = texts.sparkSession.sparkContext.broadcast(rows)

        def found(batches, sent=sent):
            known_names = sent.value
            search = automaton(known_names)
            for batch in batches:
                hits = [sorted({n for place in {p for _, p in search.iter(low)} for n in known_names[place][1]}) for low in batch.column("_low").to_pylist()]
                some = pa.array([bool(h) for h in hits], pa.bool_())
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(hits, pa.list_(pa.string()))], [*keys, "names"]).filter(some)

        schema = StructType([*[given.schema[k] for k in keys], StructField("names", ArrayType(StringType()))])
        part = given.mapInArrow(found, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return given.select(*keys, F.array().cast("array<string>").alias("names")).limit(0)
    return out if shards == 1 else out.groupBy(*keys).agg(F.flatten(F.collect_list("names")).alias("names"))


def longest_mention(texts: DataFrame, names: DataFrame, keys: Sequence[str], **parameters) -> DataFrame:
    """keys, name, mentions: of each text the longest name that is part of it (then the last by name), and how many are.

    keys are one row each; texts without a name have no row.
    """
    found = mentions(texts, names, keys, **parameters)
    longest = F.array_max(F.transform("names", lambda n: F.struct(F.char_length(n).alias("size"), n.alias("name"))))["name"]
    return found.select(*keys, longest.alias("name"), F.size("names").cast("long").alias("mentions"))
