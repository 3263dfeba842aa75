"""N-gram Jaccard join: sets of word n-grams that overlap enough are linked, by prefix trees of globally ordered sets.

N-grams have one global order, by the number of documents that have them. A document of n n-grams has to share t of
them with any partner, so one of its n - t + 1 rarest is shared: those are its prefix. A document with more than n - t
n-grams of its own has no partner. The others meet in the groups of their prefix n-grams. First each group's members
are held against its most ordinary member; then, where members of one group are still in different components, those
of all but the largest component are held against all. In both steps the sets, commonest n-grams first, are stored in
a prefix tree: sets that begin alike share the partial overlap with the probe, and where what a path has missed leaves
too little for the rest, its whole subtree is passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import components
from . import blobs
from .common import LOWER, checkpointed, id_blocks, mix, slices, span_hashes, windows, word_spans

WORDS = 4
PERCENT = 85
#: N-grams that a task's stored and probing sets have, at most (6 bytes each); one set may have more.
STORED, PROBING = 1 << 19, 1 << 18
#: N-grams are told apart by the first 48 of 64 bits: among 10^13 n-grams about ten are mistaken for one of a given set.
KEPT = np.uint64((1 << 64) - (1 << 16))
#: Text bytes for each byte of a question, about.
TEXT_PER_ASKED = 0.9

SETS = "doc_id long, n long, key binary, seq binary, rare int"


def least_overlap(n: int | np.ndarray, percent: int):
    """What a set of n must share with any partner."""
    return -(-percent * n // 100)


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, dict[int, bytes]]:
    """Of all rows: the distinct shingle hashes, sorted within each row; where each row's begin; of rows with one
    shingle, 128 bits of it."""
    parts, sizes, single = [], [], {}
    for first_row, data, at in slices(column):
        data = LOWER[data]
        start, end, first = word_spans(data, at)
        words = span_hashes(data, start, end)
        found, row, _ = windows(words, first, n)
        count = np.diff(first)
        few = np.flatnonzero((count > 0) & (count < n))
        if len(few):  # the whole sequence as one shingle
            whole = np.array([sequence_hash(words[first[r] : first[r + 1]]) for r in few], np.uint64)
            found, row = np.concatenate([found, whole]), np.concatenate([row, few])
        order = np.lexsort((found, row))
        found, row = found[order], row[order]
        new = np.ones(len(found), dtype=bool)
        new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
        parts.append(found[new])
        sizes.append(np.bincount(row[new], minlength=len(at) - 1))
        for r in np.flatnonzero(sizes[-1] == 1):
            own = slice(first[r], first[r] + min(n, count[r]))
            other = span_hashes(data, start[own], end[own], seed=1)
            single[first_row + int(r)] = sequence_hash(words[own]).tobytes() + sequence_hash(other).tobytes()
    sets = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return sets, np.concatenate([[0], *[s for s in sizes]]).cumsum().astype(np.int64), single


def sequence_hash(words: np.ndarray) -> np.uint64:
    places = np.arange(len(words), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(np.array([len(words)], np.uint64) + np.bitwise_xor.reduce(mix(words + places)))[0]


def packed(values: np.ndarray) -> bytes:
    """The 48 bits of each value that count, in six bytes."""
    return np.ascontiguousarray((values >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel() << np.uint64(16)


def planes(values: np.ndarray) -> bytes:
    """48-bit values as six runs of bytes; sorted values make the first runs compress away."""
    return np.ascontiguousarray((values >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].T[::-1]).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    square = np.frombuffer(data, np.uint8).reshape(6, -1)
    out = np.zeros((square.shape[1], 8), dtype=np.uint8)
    out[:, :6] = square[::-1].T
    return out.view(np.uint64).ravel() << np.uint64(16)


def asker(n: int, buckets: int):
    def questions(key, docs):
        sets, _, _ = shingle_sets(docs.column("text"), n)
        distinct, counts = np.unique(sets & KEPT, return_counts=True)
        asked = blobs.ask(key[0].as_py(), 0, distinct, buckets, np.minimum(counts, 255).astype(np.uint8))
        packed = pa.array([planes(np.frombuffer(x, np.uint64)) for x in asked.column("hashes").to_pylist()], pa.binary())
        return asked.set_column(asked.schema.get_field_index("hashes"), "hashes", packed)

    return questions


def counted(asked):
    """For each hash the number of documents with it in all blocks, 2^16 - 1 at most (the order goes no further)."""
    parts = [from_planes(x) for x in asked.column("hashes").to_pylist()]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    hashes = np.concatenate(parts)
    del parts
    counts = np.concatenate([np.frombuffer(x, np.uint8) for x in asked.column("extra").to_pylist()]).astype(np.uint32)
    order = np.argsort(hashes)
    ordered = hashes[order]
    n = len(hashes)
    del hashes
    new = np.append(True, ordered[1:] != ordered[:-1])
    first = np.flatnonzero(new)
    sums = np.minimum(np.add.reduceat(counts[order], first), 65535).astype(np.uint16)
    total = np.zeros(n, dtype=np.uint16)
    total[order] = np.repeat(sums, np.diff(np.append(first, n)))
    pa.default_memory_pool().release_unused()
    return blobs.answers(asked, total, starts)


def set_maker(n: int, percent: int, buckets: int):
    """Rows of SETS. key: 128 bits of the whole set, where it can have a partner. seq: its n-grams that others have
    too, commonest first; only with the least doc_id of a key in the block, and if a partner need not be equal."""

    def sets_of(key, docs, replies):
        docs = docs.sort_by("doc_id")
        sets, at, single = shingle_sets(docs.column("text"), n)
        distinct, inverse = np.unique(sets & KEPT, return_inverse=True)
        common = blobs.read_values(replies, 0, distinct, buckets, np.uint16)[inverse]
        pa.default_memory_pool().release_unused()
        ids, rows, met = docs.column("doc_id").to_pylist(), {"doc_id": [], "n": [], "key": [], "seq": [], "rare": []}, set()
        for i, doc in enumerate(ids):
            mine, seen = sets[at[i] : at[i + 1]], common[at[i] : at[i + 1]]
            size = len(mine)
            shared = int((seen > 1).sum())
            seq = digest = None
            rare = 0
            if size and shared >= least_overlap(size, percent):
                digest = single[i] if size == 1 else np.array([np.bitwise_xor.reduce(mix(mine)), np.add.reduce(mix(mine + np.uint64(size)))], np.uint64).tobytes()
                if size > 1 and doc is not None and digest not in met:
                    met.add(digest)
                    order = np.lexsort((mine, -seen.astype(np.int64)))[:shared]
                    seq = packed(mine[order])
                    rare = size - least_overlap(size, percent) + 1 - (size - shared)
            for name, value in zip(rows, (doc, size, digest, seq, rare), strict=True):
                rows[name].append(value)
        return pa.table({"doc_id": pa.array(rows["doc_id"], pa.int64()), "n": pa.array(rows["n"], pa.int64()), "key": pa.array(rows["key"], pa.binary()), "seq": pa.array(rows["seq"], pa.binary()), "rare": pa.array(rows["rare"], pa.int32())})

    return sets_of


def prefixes(batches):
    """A row for each prefix n-gram of each set: token, id, n, shared."""
    for batch in batches:
        ids, sizes = batch.column("id").to_numpy(), batch.column("n").to_numpy()
        sets = [unpacked(s) for s in batch.column("seq").to_pylist()]
        parts = [s[len(s) - r :] for s, r in zip(sets, batch.column("rare").to_pylist(), strict=True)]
        counts = np.array([len(p) for p in parts], dtype=np.int64)
        shared = np.array([len(s) for s in sets], dtype=np.int64)
        tokens = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
        spread = lambda x: pa.array(np.repeat(x, counts))
        yield pa.RecordBatch.from_arrays([pa.array(tokens), spread(ids), spread(sizes), spread(shared)], ["token", "id", "n", "shared"])


class PrefixTree:
    """Sets as paths in one global order, sorted, so that neighbours share the longest paths from the root; a subtree
    is a run of members that have a number of steps in common."""

    def __init__(self, members: list[tuple[bytes, int, int]]):
        """members: (n-grams as packed() has them, in the global order; size of the whole set; id)."""
        self.members = sorted(members)
        self.paths = [unpacked(s) for s, _, _ in self.members]
        self.common = [0]
        for a, b in zip(self.paths, self.paths[1:], strict=False):
            m = min(len(a), len(b))
            differs = np.flatnonzero(a[:m] != b[:m])
            self.common.append(int(differs[0]) if len(differs) else m)
        self.common.append(-1)
        self.smaller = [len(self.members)] * (len(self.members) + 1)  # the next place with fewer steps in common
        stack: list[int] = []
        for i, steps in enumerate(self.common):
            while stack and self.common[stack[-1]] > steps:
                self.smaller[stack.pop()] = i
            stack.append(i)

    def probe(self, sequence: bytes, n: int, percent: int):
        """Ids of the members whose sets link with that of the sequence (of n n-grams, those of its own included)."""
        probe = np.sort(unpacked(sequence))
        most_missed = n * (100 - percent) // percent  # of a partner's n-grams
        overlap, valid, i = np.zeros(1, dtype=np.int64), 0, 0  # overlap[d]: of the path's first d steps; known up to valid
        while i < len(self.members):
            (_, size, member), path = self.members[i], self.paths[i]
            valid = min(valid, self.common[i])
            if valid < len(path) and len(probe):
                rest = path[valid:]
                place = np.searchsorted(probe, rest)
                hit = probe[np.minimum(place, len(probe) - 1)] == rest
                overlap = np.concatenate([overlap[: valid + 1], overlap[valid] + np.cumsum(hit)])
                valid = len(path)
            missed = np.arange(valid + 1) - overlap[: valid + 1]
            i += 1
            if missed[-1] > most_missed:  # the subtree of the first step too many is passed over
                depth = int(np.searchsorted(missed, most_missed, side="right"))
                while self.common[i] >= depth:
                    i = self.smaller[i]
                continue
            if overlap[len(path)] >= -(-percent * (n + size) // (100 + percent)):
                yield member


MEMBER = ("probing", "seq", "n", "id", "label")


def group_links(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between the probing and the stored sets of a group that have different labels."""
    tree = PrefixTree([(s, n, i) for probing, s, n, i, _ in rows if not probing])
    label = {i: part for _, _, _, i, part in rows}
    return [(i, other) for probing, seq, n, i, part in rows if probing for other in tree.probe(seq, n, percent) if label[other] != part]


def linker(percent: int, keys: list[str]):
    """Links of the groups of sorted rows; a group at a time is held."""

    def links(batches):
        now, rows = None, []
        for batch in batches:
            out = []
            for key, row in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), zip(*(batch.column(c).to_pylist() for c in MEMBER), strict=True), strict=True):
                if key != now:
                    out += group_links(rows, percent)
                    now, rows = key, []
                rows.append(row)
            yield pairs_of(out)
        yield pairs_of(group_links(rows, percent))

    return links


def pairs_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def near_sets(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n (size of the set), key, seq, rare of each row; see set_maker()."""
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block_bytes, buckets = blobs.sizes(total, TEXT_PER_ASKED)
    blocks = id_blocks(given, block_bytes).select("block", "doc_id", "text").repartition("block")
    asked = blocks.groupBy("block").applyInArrow(asker(n, buckets), blobs.ASKED)
    replies = asked.groupBy("bucket").applyInArrow(lambda t: counted(t), blobs.ANSWER)
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(set_maker(n, percent, buckets), SETS)


def set_links(sets: DataFrame, percent: int, stored: int = STORED, probing: int = PROBING) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between sets (id, n, seq, rare), enough that all that are linked are connected; and components.

    Groups are dealt out in chunks by the number of n-grams of their sets, so that no task holds a large group.
    """
    tokens = checkpointed(sets.select("id", "n", "seq", "rare").mapInArrow(prefixes, "token long, id long, n long, shared long"))
    of = sets.select("id", "n", "seq")
    in_chunks = lambda n, most: (F.floor(n / most) + 1).cast("int")
    chunk = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["id", "n", "label", "seq"]

    def linked(rows: DataFrame, *keys: str) -> DataFrame:
        together = rows.repartition(*keys).sortWithinPartitions(*keys)
        return checkpointed(together.mapInArrow(linker(percent, list(keys)), "a long, b long").distinct())

    ordinary = F.struct((F.col("shared") / F.col("n")).alias("share"), (-F.col("id")).alias("first"), F.col("n"))
    centers = tokens.groupBy("token").agg(F.max(ordinary).alias("top"), F.count("*").alias("members")).where("members > 1")
    met = tokens.join(centers.select("token", (-F.col("top.first")).alias("center"), F.col("top.n").alias("center_n")), "token")
    fits = F.least("n", "center_n") * 100 >= F.greatest("n", "center_n") * percent
    edges = checkpointed(met.where((F.col("id") != F.col("center")) & fits).select("center", "id", "shared").distinct())
    chunks = edges.groupBy("center").agg(in_chunks(F.sum("shared"), stored).alias("chunks"))
    around = edges.join(chunks, "center").withColumn("chunk", chunk("chunks", 1)).join(of, "id")
    middles = chunks.withColumnRenamed("center", "id").join(of, "id").withColumn("chunk", each("chunks"))
    stars = around.select("center", "chunk", F.lit(False).alias("probing"), "id", "n", F.col("id").alias("label"), "seq")
    links = linked(stars.unionByName(middles.select(F.col("id").alias("center"), "chunk", F.lit(True).alias("probing"), "id", "n", F.col("id").alias("label"), "seq")), "center", "chunk")
    labels = components(sets.select("id"), links)

    labelled = tokens.join(labels, "id")
    parts = labelled.groupBy("token", "label").agg(F.count("*").alias("k"), F.sum("shared").alias("grams"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum"))
    groups = parts.groupBy("token").agg(F.count("*").alias("parts"), F.max(F.struct("k", "label", "grams")).alias("top"), F.sum("k").alias("members"), F.sum("grams").alias("grams"), F.sum("sum").alias("sum")).where("parts > 1")
    groups = groups.groupBy("members", "sum").agg(F.min(F.struct("token", "top.label", "top.grams")).alias("of"), F.min("grams").alias("grams"))  # groups of the same members are one
    groups = groups.select("of.token", F.col("of.label").alias("largest"), in_chunks(F.col("grams"), stored).alias("chunks"), in_chunks(F.col("grams") - F.col("of.grams"), probing).alias("probe_chunks"))
    open_ = labelled.drop("n").join(groups, "token").join(of, "id")
    kept = open_.select("token", chunk("chunks", 1).alias("chunk"), each("probe_chunks").alias("probe_chunk"), F.lit(False).alias("probing"), *columns)
    asking = open_.where(F.col("label") != F.col("largest")).select("token", each("chunks").alias("chunk"), chunk("probe_chunks", 2).alias("probe_chunk"), F.lit(True).alias("probing"), *columns)
    rest = linked(kept.unionByName(asking), "token", "chunk", "probe_chunk")
    links = links.unionByName(rest)
    if rest.head(1):
        again = rest.alias("r").join(labels.alias("x"), F.col("r.a") == F.col("x.id")).join(labels.alias("y"), F.col("r.b") == F.col("y.id"))
        merged = components(labels.select(F.col("label").alias("id")).distinct(), again.select(F.col("x.label").alias("a"), F.col("y.label").alias("b")))
        labels = labels.alias("l").join(merged.alias("m"), F.col("l.label") == F.col("m.id")).select("l.id", "m.label")
    return links, labels


def jaccard_join(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, **parameters) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    Rows link where 100 * shared >= percent * all of their sets of distinct n-word shingles (A-Z lower-cased; fewer
    words: the whole sequence). component_id is the least doc_id of the rows that links reach; rows that share a
    doc_id are one document in this, even where their texts differ. Without words, or with a null text, the set is
    empty and the row is linked with nothing (but with other rows of its doc_id). Rows with a null doc_id take part in
    no links and get a null component_id. Repeated rows are alike. An empty table gives no rows; further columns go.
    """
    sets = checkpointed(near_sets(docs, n, percent))
    able = sets.where("doc_id is not null")
    same = (F.col("key") == F.col("_key")) & (F.col("n") == F.col("_n"))
    classes = able.where("key is not null").groupBy(F.col("key").alias("_key"), F.col("n").alias("_n")).agg(F.min("doc_id").alias("least"))
    classes = checkpointed(classes.withColumn("id", F.monotonically_increasing_id()))  # one number for each set
    firsts = sets.where("seq is not null").join(classes.where("_n > 1"), (F.col("doc_id") == F.col("least")) & same).dropDuplicates(["id"]).select("id", "n", "seq", "rare")
    _, labels = set_links(checkpointed(firsts), percent, **parameters)
    of = classes.join(labels, "id", "left").select("_key", "_n", "least", F.coalesce("label", "id").alias("label"))
    several = able.groupBy("doc_id").agg(F.min(F.struct("key", "n")).alias("one"), F.max(F.struct("key", "n")).alias("other")).where("one <> other").select("doc_id")
    if several.head(1):  # rows of one doc_id with unequal sets join their components
        met = able.join(several, "doc_id").join(of, same).select("doc_id", "label").distinct()
        edges = met.join(met.groupBy("doc_id").agg(F.min("label").alias("first")), "doc_id").where("label <> first").select(F.col("first").alias("a"), F.col("label").alias("b"))
        merged = components(of.select(F.col("label").alias("id")).distinct(), edges).select("id", F.col("label").alias("joined"))
        of = of.join(merged, F.col("label") == F.col("id")).select("_key", "_n", "least", F.col("joined").alias("label"))
    reached = of.groupBy("label").agg(F.min("least").alias("component"))
    known = of.join(reached, "label").select("_key", "_n", "component")
    out = sets.join(known, same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    if several.head(1):  # an empty set shares its document's component
        least = out.join(several, "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("_least"))
        out = out.join(least, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("_least", "component_id").alias("component_id"))
    return out


def first_of_each(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose doc_id is the least of their component, with all columns (of any names); of rows that
    share a doc_id all stay. Null texts and ids stay, repeated rows stay together; an empty table gives an empty one."""
    gone = jaccard_join(docs, n, percent).where("component_id <> doc_id").select("doc_id").distinct()
    gone = gone.select(F.col("doc_id").alias("_gone"))
    packed_rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return packed_rows.join(gone, F.col("_row.doc_id") == F.col("_gone"), "left_anti").select("_row.*")
