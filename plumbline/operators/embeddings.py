"""Redundancy of groups from their embedding vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import checkpointed
from .graphs import components


def centroids(vectors: DataFrame) -> DataFrame:
    """label, n, centroid: the mean vector of each label, scaled to length 1."""
    parts = vectors.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("label")))
    unit = parts.withColumn("u", F.try_divide("x", norm))
    return unit.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "u"))), lambda s: s["u"]).alias("centroid"))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def centroid_cosines(vectors: DataFrame) -> DataFrame:
    c = centroids(vectors)
    a, b = c.alias("a"), c.alias("b")
    return a.join(b, F.col("a.label") < F.col("b.label")).select(F.col("a.label").alias("a"), F.col("b.label").alias("b"), dot(F.col("a.centroid"), F.col("b.centroid")).alias("cosine"))


def quadrants(cosines: DataFrame, taus: DataFrame, high_cosine: float = 0.85, high_tau: float = 0.5) -> DataFrame:
    """Semantic similarity against rank correlation of the same pairs."""
    both = cosines.join(taus, ["a", "b"])
    near, alike = F.col("cosine") >= high_cosine, F.col("tau") >= high_tau
    return both.withColumn("quadrant", F.when(near & alike, "redundant").when(near, "same topic").when(alike, "same skill").otherwise("distinct"))


def mantel(distances: DataFrame, reps: int = 200) -> DataFrame:
    """Pearson's r of two matrices over pairs (a, b, x, y), and its permutation p: labels of y are shuffled."""
    from .correlation import draw, safe_corr

    full = distances.select("a", "b", "x", "y").unionByName(distances.select(F.col("b").alias("a"), F.col("a").alias("b"), "x", "y"))
    names = full.select(F.col("a").alias("name")).distinct().withColumn("place", F.row_number().over(Window.orderBy("name")).cast("long"))  # a row for each group
    shuffled = names.crossJoin(F.broadcast(distances.sparkSession.range(reps).withColumnRenamed("id", "rep"))).withColumn("to", F.row_number().over(Window.partitionBy("rep").orderBy(draw(F.col("rep"), F.col("place"), 2147483647), "place")).cast("long"))
    moves = shuffled.join(names.select(F.col("name").alias("as_name"), F.col("place").alias("to")), "to").select("rep", "name", "as_name")
    m1, m2 = moves.select("rep", F.col("name").alias("a"), F.col("as_name").alias("pa")), moves.select("rep", F.col("name").alias("b"), F.col("as_name").alias("pb"))
    y = full.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("y").alias("yp"))
    null = distances.join(m1, "a").join(m2, ["rep", "b"]).join(y, ["pa", "pb"]).groupBy("rep").agg(safe_corr(F.col("x"), F.col("yp")).alias("r0"))
    observed = distances.agg(safe_corr(F.col("x"), F.col("y")).alias("r"), F.count("*").alias("pairs"))
    return null.crossJoin(F.broadcast(observed)).groupBy("r", "pairs").agg(((F.count_if(F.col("r0") >= F.col("r") - 1e-9) + 1) / (F.count("r0") + 1)).alias("p"))


#: A block of vectors: bytes at most; a twelfth of all vectors, but so many at least. Vectors that are compared at once.
BLOCK_BYTES, BLOCKS, LEAST, TILE = 1 << 22, 12, 1024, 1024


def in_blocks(known: DataFrame, n: int, width: int) -> DataFrame:
    """block, ids, x: vectors (vec_id, embedding) packed as binary values of bounded size, a partition each."""
    rows = max(1, min(max(n // BLOCKS, LEAST), BLOCK_BYTES // (8 * width)))

    def block(held):
        ids, x = (pa.chunked_array([b.column(c) for b in held]).combine_chunks() for c in ("vec_id", "embedding"))
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (ids.to_numpy(), x.flatten().to_numpy(zero_copy_only=False))], ["ids", "x"])

    def packed(batches):
        held, count = [], 0
        for batch in batches:
            for low in range(0, len(batch), rows):
                part = batch.slice(low, rows)
                if held and count + len(part) > 2 * rows:
                    yield block(held)
                    held, count = [], 0
                held, count = [*held, part], count + len(part)
        if count:
            yield block(held)

    return checkpointed(known.repartition(-(-n // rows) or 1).mapInArrow(packed, "ids binary, x binary").select(F.monotonically_increasing_id().alias("block"), "ids", "x"))


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, the least place in reach of each place, after links from a to b."""
    a, b = label[a], label[b]
    while len(a):
        up = np.arange(len(label))
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up, up[up]):
            up = up[up]
        label, a, b = up[label], up[a], up[b]
        open_ = a != b
        a, b = a[open_], b[open_]
    return label


def linked(x: np.ndarray, y: np.ndarray | None, max_distance: float) -> np.ndarray:
    """The least place in reach of each row of x, then of y, by links from x to y, or inside x if y is None.

    Products of single precision settle all pairs but those very near the distance, which are compared in double. Two
    members of the component that is the largest so far are not compared.
    """
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    every = unit((x if y is None else np.concatenate([x, y])).astype(float))
    rough, label, begin = every.astype(np.float32), np.arange(len(every)), 0 if y is None else len(x)
    least, off = 1 - max_distance * max_distance / 2, 1e-6 + 1.2e-7 * x.shape[1]
    for r in range(0, len(x), TILE):
        top = np.bincount(label).argmax()
        for c in range(r if y is None else begin, len(every), TILE):
            rows, columns = np.arange(r, min(r + TILE, len(x))), np.arange(c, min(c + TILE, len(every)))
            inside, beside = label[rows] == top, label[columns] != top
            for i, j in ((rows[~inside], columns), (rows[inside], columns[beside])):
                if len(i) and len(j):
                    near = rough[i] @ rough[j].T
                    p, q = np.nonzero(near >= least - off)
                    doubtful = near[p, q] < least + off
                    p, q = i[p], j[q]
                    new = label[p] != label[q]
                    p, q, doubtful = p[new], q[new], doubtful[new]
                    if doubtful.any():
                        some = np.flatnonzero(doubtful)
                        good = np.ones(len(p), bool)
                        for low in range(0, len(some), 1 << 16):
                            at = some[low : low + (1 << 16)]
                            good[at] = 2 - 2 * (every[p[at]] * every[q[at]]).sum(1) <= max_distance * max_distance
                        p, q = p[good], q[good]
                    label = joined(label, p, q)
                    top = label[top]
    return label


def clusters(vectors: DataFrame, max_distance: float = 0.9, min_size: int = 3) -> DataFrame:
    """vec_id, cluster: components of pairs of unit vectors within a distance; components under min_size are -1.

    Exact. Vectors lie in blocks of bounded size, a task compares two blocks and gives a link a vector at most, and blocks are
    read from the shared folder, not shuffled for each pair. First each block is held against itself and the first one;
    then the vectors outside the largest component against all, so that a table with one large component, or large families
    of copies, takes about linear time. A table without one is compared in all its pairs of blocks. A null vector is in no
    cluster. Further columns don't matter.
    """
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    dtype = np.float32 if kind == "float" else np.float64
    known = vectors.where("embedding is not null and size(embedding) > 0 and vec_id is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if kind == "float" else "array<double>"))
    n, width = known.agg(F.count("*"), F.max(F.size("embedding"))).first()
    blocks = in_blocks(known, n, width or 1)
    first = blocks.agg(F.min("block")).first()[0]

    def compared(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, b = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["other_ids"], np.int64)
                x, y = (np.frombuffer(row[c], dtype).reshape(len(i), -1) for c, i in (("x", a), ("other_x", b)))
                names, label = (a, linked(x, None, max_distance)) if row["same"] else (np.concatenate([a, b]), linked(x, y, max_distance))
                some = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[label[some]])], ["a", "b"])

    def links(some, which):
        other = blocks.select(F.col("block").alias("other"), F.col("ids").alias("other_ids"), F.col("x").alias("other_x"))
        pairs = some.join(other.hint("shuffle_replicate_nl"), which).select("ids", "x", "other_ids", "other_x", (F.col("block") == F.col("other")).alias("same"))
        return pairs.mapInArrow(compared, "a long, b long")

    ids = known.select(F.col("vec_id").alias("id")).distinct()
    parts = components(ids, links(blocks, (F.col("block") == F.col("other")) | ((F.col("block") == first) & (F.col("other") != first))))
    largest = parts.groupBy("label").count().orderBy(F.col("count").desc(), "label").first()
    rest = parts.where(F.col("label") != (largest["label"] if largest else -1))
    outside = rest.count()
    if outside:
        if 2 * outside <= n:
            found = links(in_blocks(known.join(rest, known["vec_id"] == rest["id"], "left_semi"), outside, width).withColumn("block", F.lit(-1)), F.lit(True))
        else:
            found = links(blocks, (F.col("block") < F.col("other")) & (F.col("block") != first))
        parts = components(ids, found.unionByName(parts.select(F.col("id").alias("a"), F.col("label").alias("b"))))
    sizes = known.select(F.col("vec_id").alias("id")).join(parts, "id").groupBy("label").agg(F.count("*").alias("size"))
    large = parts.join(sizes.where(F.col("size") >= min_size), "label").select(F.col("id").alias("vec_id"), F.col("label").alias("cluster"))
    return vectors.select("vec_id").join(large, "vec_id", "left").select("vec_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def purity(assigned: DataFrame) -> DataFrame:
    """Of each cluster (cluster, grp): size, the commonest group, its share, the three commonest, the number of groups."""
    counts = assigned.groupBy("cluster", "grp").agg(F.count("*").alias("k"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("least"), F.col("grp").alias("grp"))))
    out = counts.groupBy("cluster").agg(F.sum("k").alias("size"), listed.alias("l"), F.count("*").alias("groups"))
    return out.select("cluster", "size", F.col("l")[0]["grp"].alias("dominant"), (-F.col("l")[0]["least"] / F.col("size")).alias("share"), F.array_join(F.transform(F.slice("l", 1, 3), lambda s: s["grp"].cast("string")), ",").alias("top3"), "groups")


def group_overlap(assigned: DataFrame, least: float = 0.1, top: int = 30) -> DataFrame:
    """Pairs of groups by the mean of both shares of items in shared clusters; b shares a cluster with a if it has a tenth of b's items."""
    counts = assigned.groupBy("cluster", "grp").agg(F.count("*").alias("k"))
    counts = counts.withColumn("total", F.sum("k").over(Window.partitionBy("grp")))
    a, b = counts.alias("a"), counts.alias("b")
    directed = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.grp") != F.col("b.grp"))).where(F.col("b.k") >= F.col("b.total") * least).groupBy(F.col("a.grp").alias("a"), F.col("b.grp").alias("b")).agg((F.sum("a.k") / F.first("a.total")).alias("share"))
    pair = directed.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg((F.sum("share") / 2).alias("overlap"))
    return pair.orderBy(F.round("overlap", 9).desc(), "a", "b").limit(top)


def missing_vectors(vectors: DataFrame, items: DataFrame) -> DataFrame:
    """Items of each group without a vector, and all."""
    rows = items.join(vectors.select("vec_id").distinct().withColumn("has", F.lit(True)), items["id"] == F.col("vec_id"), "left")
    return rows.groupBy("grp").agg(F.count("*").alias("expected"), F.count("has").alias("present")).withColumn("complete", F.col("expected") == F.col("present"))
