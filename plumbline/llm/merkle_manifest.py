"""A Merkle manifest of a dataset: a persistent hash tree whose versions copy only the path above a changed leaf."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Children of a node.
FAN = 3
#: A unit of work is the tree of this many levels above one aligned block of FAN ** BLOCK_LEVELS nodes.
BLOCK_LEVELS = 6
#: Rows of a batch that a task gives back.
ROWS = 4096

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<slot: int, siblings: array<string>>>"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def joined_hash(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_above(n: int, most: int) -> int:
    """Levels of a block among n nodes: as many as leave one node, but no more than most."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // FAN), levels + 1
    return levels


class Versions:
    """A hash tree over a block's nodes, and versions of it. A node, once made, never changes.

    nodes[i] is (digest, children); a version is the number of its root. The version with one other leaf has new nodes
    for that leaf and its ancestors, whose other children are the nodes of the first version.
    """

    def __init__(self, leaves: list[str], levels: int):
        self.nodes: list[tuple[str, tuple[int, ...]]] = [(digest, ()) for digest in leaves]
        self.levels = [list(range(len(leaves)))]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([self.parent(tuple(below[i : i + FAN])) for i in range(0, len(below), FAN)])
        self.root = self.levels[-1][0]

    def parent(self, children: tuple[int, ...]) -> int:
        self.nodes.append((joined_hash(self.nodes[c][0] for c in children), children))
        return len(self.nodes) - 1

    def digest(self, node: int) -> str:
        return self.nodes[node][0]

    def changed(self, leaf: int, digest: str) -> int:
        """The root of the version in which a leaf has another digest."""
        self.nodes.append((digest, ()))
        copy = len(self.nodes) - 1
        for ids in self.levels[:-1]:
            low = leaf - leaf % FAN
            copy = self.parent(tuple(copy if k == leaf else ids[k] for k in range(low, min(low + FAN, len(ids)))))
            leaf //= FAN
        return copy

    def path(self, leaf: int) -> list[dict]:
        """For each level the leaf's ancestor's place in its run, and the digests of the others of the run."""
        out = []
        for ids in self.levels[:-1]:
            low = leaf - leaf % FAN
            out.append({"slot": leaf - low, "siblings": [self.digest(ids[k]) for k in range(low, min(low + FAN, len(ids))) if k != leaf]})
            leaf //= FAN
        return out


def folded(digest: str, path: list[dict]) -> str:
    """The digest at the path's upper end: a version that goes on above its block."""
    for step in path:
        siblings = step["siblings"]
        digest = joined_hash([*siblings[: step["slot"]], digest, *siblings[step["slot"] :]])
    return digest


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each block, in order, from batches sorted by grp and block."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["grp"], row["block"]) != key and rows:
                yield rows
                rows = []
            key = row["grp"], row["block"]
            rows.append(row)
    if rows:
        yield rows


def in_batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (grp, ...) with pos, the place within grp by order, and n, the rows of grp; null groups and values first.

    Rows go to ranges of (grp, order) and are counted there, so that a group of most rows is no single task's.
    """
    by = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("seq", F.monotonically_increasing_id())
    ranged = checkpointed(ranged.withColumn("part", F.shiftright("seq", 33)))
    counts = ranged.groupBy("grp", "part").agg(F.min("seq").alias("first"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("grp").alias("of"), F.col("part").alias("at"), (before - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("grp")).alias("n"))
    joined = ranged.join(counts, (F.col("part") == F.col("at")) & F.col("grp").eqNullSafe(F.col("of")))
    return joined.select(*rows.columns, (F.col("seq") + F.col("shift")).alias("pos"), "n")


def dealt(rows: DataFrame) -> DataFrame:
    """rows (grp, block, ...) with each block whole and in order in one partition."""
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", *[c for c in ("kind", "pos") if c in rows.columns])


def block_tree(own: list[dict], levels: int) -> Versions:
    return Versions([r["digest"] for r in own], levels_above(own[0]["n"], levels))


def block_number(levels: int) -> F.Column:
    return F.floor(F.col("pos") / FAN**levels).alias("block")


def tops(nodes: DataFrame, levels: int) -> DataFrame:
    """The nodes (grp, pos, n, digest) above each aligned block of such nodes."""

    def top(batches):
        schema = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
        found = ({"grp": b[0]["grp"], "pos": b[0]["block"], "n": -(-b[0]["n"] // FAN**levels), "digest": (t := block_tree(b, levels)).digest(t.root)} for b in blocks(batches))
        return in_batches(found, schema)

    given = nodes.select("grp", block_number(levels), "pos", "n", "digest")
    return checkpointed(dealt(given).mapInArrow(top, "grp string, pos long, n long, digest string"))


def under(nodes: DataFrame, above: DataFrame, levels: int, *carried: str) -> DataFrame:
    """nodes (grp, pos, n, digest, carried) together with the row above (grp, pos, path, subroot, root) of their block."""
    own = nodes.select("grp", block_number(levels), F.lit(1).alias("kind"), "pos", "n", "digest", *carried)
    upper = above.select("grp", F.col("pos").alias("block"), F.lit(0).alias("kind"), "path", "subroot", "root")
    return dealt(own.unionByName(upper, allowMissingColumns=True))


def paths(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """grp, pos, path, subroot, root of each node: the path to the root, by way of the row above its block."""

    def path(batches):
        step = pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.list_(pa.string()))]))
        schema = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("path", step), ("subroot", pa.string()), ("root", pa.string())])

        def rows():
            for upper, *own in blocks(batches):
                tree = block_tree(own, levels)
                for i, r in enumerate(own):
                    yield {"grp": r["grp"], "pos": r["pos"], "path": tree.path(i) + upper["path"], "subroot": upper["subroot"], "root": upper["root"]}

        return in_batches(rows(), schema)

    return under(nodes, above, levels).mapInArrow(path, f"grp string, pos long, path {PATH}, subroot string, root string")


def climb(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of nodes from the given ones up to one node a group; a round has one node for each block of the last."""
    rounds, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        rounds.append(nodes)
        nodes, most = tops(nodes, levels), -(-most // FAN**levels)
    return rounds, nodes


def manifest(leaves: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """RESULT for leaves (doc_id, grp, leaf, other): the tree's digests, and those of a version for each changed leaf.

    Within grp, leaves ascend by doc_id (null first, ties by digest); while several nodes remain, every FAN consecutive ones
    (the last run: fewer) become one, the hash of their joined digests. The last one is the group's subroot; the
    subroots, by grp (null first), become the root likewise. proof_sha256 is the hash of all siblings on the way.
    folded_root is the root of the version in which this leaf alone has the digest other, and verified says that it
    is the root. Each block of FAN ** levels nodes is one unit of work: the version copies the leaf's ancestors there and
    goes on along the path above its block. No task holds more of a tree than a block.
    """
    given = numbered(leaves.withColumnRenamed("leaf", "digest"), "doc_id", "digest")
    rounds, subroots = climb(given, levels)
    every = checkpointed(numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), "name"))
    high, root = climb(every, levels)
    above = root.select("grp", "pos", F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(high):
        above = paths(nodes, above, levels)
    own = every.select(F.col("pos").alias("at"), "name", F.col("digest").alias("own"))
    above = checkpointed(above.join(own, F.col("pos") == F.col("at")).select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", F.col("own").alias("subroot"), "root"))
    for nodes in reversed(rounds[1:]):
        above = checkpointed(paths(nodes, above, levels))

    def versions(batches):
        schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])

        def rows():
            for upper, *own in blocks(batches):
                tree = block_tree(own, levels)
                for i, r in enumerate(own):
                    path = tree.path(i)
                    proof = joined_hash(s for step in [*path, *upper["path"]] for s in step["siblings"])
                    version = tree.root if r["other"] == r["digest"] else tree.changed(i, r["other"])
                    top = folded(tree.digest(version), upper["path"])
                    yield {"doc_id": r["doc_id"], "leaf": r["digest"], "subroot": upper["subroot"], "root": upper["root"], "proof_sha256": proof, "folded_root": top, "verified": top == upper["root"]}

        return in_batches(rows(), schema)

    return under(given, above, levels, "doc_id", "other").mapInArrow(versions, RESULT)


def leaf(columns: dict[str, F.Column]) -> F.Column:
    """The digest of a row's fields: each "-" if null, else the count of its UTF-8 bytes, a colon and itself."""
    text = {name: c.cast("string") for name, c in columns.items()}
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text.values()]), 256)


def document_manifest(docs: DataFrame, tampered: F.Column | None = None, **parameters) -> DataFrame:
    """One row per row of docs: RESULT of a tree over its FIELDS, grouped by source.

    tampered is the text as someone else has it; where it differs from text, the version's root differs too. Nulls in
    any field are told from empty values; a null source is a group of its own, the first; null doc_ids come first in
    theirs. Rows that share a doc_id stand by their digests, so repeated rows are leaves of their own. An empty table
    gives no rows. Extra columns don't matter.
    """
    columns = {c: F.col(c) for c in FIELDS}
    other = F.col("text") if tampered is None else tampered
    rows = docs.select(*FIELDS, other.alias("_other")).select("doc_id", F.col("source").alias("grp"), leaf(columns).alias("leaf"), leaf(columns | {"text": F.col("_other")}).alias("other"))
    return manifest(checkpointed(rows), **parameters)
