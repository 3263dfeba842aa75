"""Density clusters of vectors: a neighbour graph by descent, mutual reachability, and a condensed hierarchy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import checkpointed
from .graphs import FINISH, components

#: Vectors that are compared with one another at once; orders of random planes; rounds of descent after them.
CHUNK, TABLES, ROUNDS = 512, 6, 2
PLANES = 30
#: Reverse neighbours that take part in a round of descent, at most: one for each value of a hash.
REVERSE = 16
NEAR = "array<struct<d: double, id: long>>"


def as_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float32).reshape(len(column), -1)


def with_length(vectors: DataFrame) -> DataFrame:
    """vec_id, unit: vectors as they are, of which only the direction counts; null vectors and ids go, and vectors without a
    length."""

    def kept(batches):
        for batch in batches:
            norm = np.linalg.norm(as_matrix(batch.column("unit")).astype(float), axis=1)
            yield batch.filter(pa.array((norm > 0) & np.isfinite(norm)))

    given = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0").select("vec_id", F.col("embedding").cast("array<float>").alias("unit"))
    return given.mapInArrow(kept, "vec_id long, unit array<float>")


def nearest(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the k nearest others of each row, ties by id.

    Products of single precision choose who comes near; a distance itself is summed in double, pair by pair, so that it is
    the same to the last bit wherever and in whatever company the pair is met."""
    k = min(k, len(ids) - 1)
    far, other = np.zeros((len(ids), max(k, 0))), np.zeros((len(ids), max(k, 0)), np.int64)
    if k < 1:
        return far, other
    exact = x.astype(float)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    rough = exact.astype(np.float32)
    off = 2e-6 + 2.4e-7 * x.shape[1]
    for low in range(0, len(ids), 64):
        like = rough[low : low + 64] @ rough.T
        like[np.arange(len(like)), np.arange(low, low + len(like))] = -9
        row, at = np.nonzero(like >= np.partition(like, len(ids) - k, axis=1)[:, len(ids) - k, None] - off)
        some = at != row + low
        row, at = row[some], at[some]
        d = np.sqrt(np.maximum(2 - 2 * (exact[row + low] * exact[at]).sum(1), 0))
        order = np.lexsort((ids[at], d, row))
        first = np.searchsorted(row[order], np.arange(len(like)))
        chosen = order[first[:, None] + np.arange(k)]
        far[low : low + 64], other[low : low + 64] = d[chosen], ids[at[chosen]]
    return far, other


def near_batch(owners: np.ndarray, counts: np.ndarray, d: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    pairs = pa.StructArray.from_arrays([pa.array(d.astype(float)), pa.array(ids.astype(np.int64))], ["d", "id"])
    ends = np.concatenate([[0], np.cumsum(counts)])
    return pa.RecordBatch.from_arrays([pa.array(owners.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["vec_id", "near"])


def best(lists: DataFrame, k: int) -> DataFrame:
    """vec_id, near: the k nearest of all that a vector's lists name, ties by id."""
    every = F.flatten(F.collect_list("near"))
    return lists.groupBy("vec_id").agg(F.slice(F.array_sort(F.array_distinct(every)), 1, k).cast(NEAR).alias("near"))


def in_chunks(units: DataFrame, k: int, tables: int, chunk: int, seed: int) -> DataFrame:
    """Lists of near vectors from runs of chunk vectors in the order of each table's codes.

    A code's bits are sides of random planes, so like vectors stand together, as in a tree of random planes; runs have
    a fixed length however many vectors share a code. Each vector is shuffled once a table.
    """

    def coded(batches):
        for batch in batches:
            x = as_matrix(batch.column("unit"))
            for t in range(tables):
                planes = np.random.default_rng((seed, t)).normal(size=(x.shape[1], PLANES)).astype(np.float32)
                code = ((x @ planes > 0) * (1 << np.arange(PLANES)[::-1])).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(code, pa.int64()), batch.column("vec_id"), batch.column("unit")], ["table", "code", "vec_id", "unit"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        now, x, ids = None, None, None
        for batch in batches:
            every, rows, names = batch.column("table").to_numpy(), as_matrix(batch.column("unit")), batch.column("vec_id").to_numpy()
            for t in np.unique(every):
                mine = every == t
                if t != now:
                    if now is not None:
                        yield from ends(x, ids)
                    now, x, ids = t, rows[mine], names[mine]
                else:
                    x, ids = np.concatenate([x, rows[mine]]), np.concatenate([ids, names[mine]])
                while len(ids) >= 2 * chunk:
                    yield x[:chunk], ids[:chunk]
                    x, ids = x[chunk:], ids[chunk:]
        if now is not None:
            yield from ends(x, ids)

    def ends(x, ids):
        if len(ids) > chunk:
            half = len(ids) // 2
            yield x[:half], ids[:half]
            x, ids = x[half:], ids[half:]
        yield x, ids

    def near(batches):
        for x, ids in runs(batches):
            d, other = nearest(x, ids, k)
            yield near_batch(ids, np.full(len(ids), d.shape[1]), d.ravel(), other.ravel())

    codes = units.mapInArrow(coded, "table int, code long, vec_id long, unit array<float>")
    ordered = codes.repartitionByRange("table", "code", "vec_id").sortWithinPartitions("table", "code", "vec_id")
    return ordered.mapInArrow(near, f"vec_id long, near {NEAR}")


def descended(units: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """graph after one round of descent: neighbours of a vector are compared with one another.

    A vector sends itself, its neighbours and some it is a neighbour of to one group of k + REVERSE + 1 at most, so the
    shuffle is in proportion to vectors times k. Only pairs nearer than a vector's farthest neighbour come back.
    """
    pairs = graph.select(F.col("vec_id").alias("at"), F.explode("near.id").alias("of"))
    back = pairs.groupBy(F.col("of").alias("to"), F.pmod(F.xxhash64("at", "of"), F.lit(REVERSE)).alias("bin")).agg(F.min("at").alias("member"))
    members = pairs.select("at", "of").unionByName(back.select(F.col("to").alias("at"), F.col("member").alias("of"))).unionByName(graph.select(F.col("vec_id").alias("at"), F.col("vec_id").alias("of"))).distinct()
    limit = graph.select(F.col("vec_id").alias("of"), F.when(F.size("near") >= k, F.element_at("near", -1)["d"]).otherwise(F.lit(9.0)).alias("limit"))
    known = members.join(units.withColumnRenamed("vec_id", "of").join(limit, "of"), "of")

    def compared(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) > 1 << 14:
                whole = pa.Table.from_batches(held).combine_chunks()
                last = int(np.searchsorted(whole["at"].to_numpy(), whole["at"][-1].as_py()))
                if last:
                    yield from groups(whole.slice(0, last))
                held = whole.slice(last).to_batches()
        if held:
            yield from groups(pa.Table.from_batches(held))

    def groups(rows: pa.Table):
        at, ids, x, most = rows["at"].to_numpy(), rows["of"].to_numpy(), as_matrix(rows["unit"]), rows["limit"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
        owners, counts, far, other = [], [], [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            d, who = nearest(x[a:b], ids[a:b], k)
            good = d < most[a:b, None]
            some = good.any(1)
            owners.append(ids[a:b][some])
            counts.append(good[some].sum(1))
            far.append(d[good])
            other.append(who[good])
        yield near_batch(*(np.concatenate(v) for v in (owners, counts, far, other)))

    found = known.repartition("at").sortWithinPartitions("at").select("at", "of", "unit", "limit").mapInArrow(compared, f"vec_id long, near {NEAR}")
    return best(graph.unionByName(found), k)


def neighbours(vectors: DataFrame, k: int = 15, tables: int = TABLES, rounds: int = ROUNDS, chunk: int = CHUNK, seed: int = 5) -> DataFrame:
    """vec_id, near: up to k nearest other vectors by distance on the unit sphere, nearest first, ties by id.

    Exact for chunk vectors and fewer; beyond, tests measure recall against brute force (0.9 or more). Vectors that are
    null or have no length are left out. An empty table gives no rows.
    """
    units = checkpointed(with_length(vectors))
    graph = checkpointed(best(in_chunks(units, k, tables, chunk, seed), k))
    if units.count() > chunk:
        for _ in range(rounds):
            graph = checkpointed(descended(units, graph, k))
    return graph


def reachability(graph: DataFrame, min_samples: int = 5) -> DataFrame:
    """a, b, w: edges of the graph with the mutual reachability distance, the greatest of both ends' distances to their
    min_samples-th neighbour and their own."""
    core = graph.select("vec_id", F.element_at("near", F.least(F.lit(min_samples), F.size("near")))["d"].alias("core"))
    edges = graph.select(F.col("vec_id").alias("a"), F.explode("near").alias("n")).select("a", F.col("n.id").alias("b"), F.col("n.d").alias("d"))
    both = edges.join(core.select(F.col("vec_id").alias("a"), F.col("core").alias("ca")), "a").join(core.select(F.col("vec_id").alias("b"), F.col("core").alias("cb")), "b")
    return both.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.greatest("ca", "cb", "d")).cast("double").alias("w"))


class Level:
    """One level of the hierarchy in numpy: the nodes of the last one by the place of the node above."""

    def __init__(self, up: np.ndarray, size: np.ndarray, own: np.ndarray, sub: np.ndarray, node: np.ndarray, span: float, min_size: int):
        n = int(up.max()) + 1 if len(up) else 0
        total = lambda v: np.bincount(up, v, n)
        self.up, self.size, self.goes_on = up, total(size).astype(np.int64), total(node) == 1
        self.own = np.where(self.goes_on, total(np.where(node, own, 0.0)), 0.0) + self.size * span
        self.sub = np.where(self.goes_on, total(np.where(node, sub, 0.0)), total(np.where(node, np.maximum(own, sub), 0.0)))
        self.node = self.size >= min_size


def rest_of_levels(nodes: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, w: np.ndarray, limits: list[float], spans: list[float], min_size: int, apart: int) -> np.ndarray:
    """For each node the label of the chosen cluster that holds it after the levels given, -1 if there is none."""
    labels = nodes["label"]
    now, levels, names = (nodes["size"], nodes["own"], nodes["sub"], nodes["node"]), [], [labels]
    for t, span in zip(limits, spans, strict=True):
        n, some = len(now[0]), w <= t
        least, x, y = np.arange(n), a[some], b[some]
        while len(x):
            new = least.copy()
            np.minimum.at(new, least[x], least[y])
            np.minimum.at(new, least[y], least[x])
            while not np.array_equal(new, new[new]):
                new = new[new]
            least = new
            open_ = least[x] != least[y]
            x, y = x[open_], y[open_]
        kept, up = np.unique(least, return_inverse=True)
        level = Level(up, *now, span, min_size)
        levels.append(level)
        names.append(names[-1][kept])  # places ascend by label, so the least place has the least label
        now = level.size, level.own, level.sub, level.node
        a, b, w = up[a[~some]], up[b[~some]], w[~some]
        open_ = a != b
        a, b, w = a[open_], b[open_], w[open_]
    size, own, sub, node = now
    alone = int(node.sum()) + apart == 1
    chosen = np.where(node & (own >= sub) & (not alone), names[-1], -1)
    for i in range(len(levels) - 1, -1, -1):
        level, below = levels[i], levels[i - 1] if i else None
        held = chosen[level.up]
        if below is None:
            own, sub, node = nodes["own"], nodes["sub"], nodes["node"]
        else:
            own, sub, node = below.own, below.sub, below.node
        begins = node & ~level.goes_on[level.up] & (own >= sub)
        chosen = np.where(held >= 0, held, np.where(begins, names[i], -1))
    return chosen


def finished_levels(nodes: DataFrame, edges: DataFrame, limits: list[float], spans: list[float], min_size: int) -> DataFrame:
    """label, cluster of the nodes, from a graph of bounded size in one task; nodes without edges stay outside."""
    touched = edges.select(F.explode(F.array("a", "b")).alias("label")).distinct()
    inside, outside = nodes.join(touched, "label", "left_semi"), nodes.join(touched, "label", "left_anti")
    apart = outside.where("node").count()
    if apart == 1 and not inside.head(1):
        return nodes.select("label", F.lit(None).cast("long").alias("cluster"))
    last = F.col("own") + F.col("size") * F.lit(float(sum(spans)))
    lone = outside.select("label", F.when(F.col("node") & (last >= F.col("sub")), F.col("label")).alias("cluster"))

    def one(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        rows = whole.filter(pa.compute.is_valid(whole["label"])).combine_chunks()
        order = np.argsort(rows["label"].to_numpy(), kind="stable")
        given = {c: rows[c].to_numpy()[order] for c in ("label", "size", "own", "sub", "node")}
        links = whole.filter(pa.compute.is_valid(whole["w"])).combine_chunks()
        place = lambda c: np.searchsorted(given["label"], links[c].to_numpy())
        chosen = rest_of_levels(given, place("a"), place("b"), links["w"].to_numpy(), limits, spans, min_size, apart)
        yield pa.RecordBatch.from_arrays([pa.array(given["label"], pa.int64()), pa.array(chosen, pa.int64(), mask=chosen < 0)], ["label", "cluster"])

    together = inside.unionByName(edges.select("a", "b", "w"), allowMissingColumns=True).coalesce(1)
    found = together.select("label", "size", "own", "sub", "node", "a", "b", "w").mapInArrow(one, "label long, cluster long")
    return checkpointed(found.unionByName(lone))


def condensed(points: DataFrame, edges: DataFrame, min_size: int, levels: int, finish: int = FINISH) -> DataFrame:
    """vec_id, cluster: the clusters of most stability in the hierarchy of components that grow with the distance.

    The hierarchy is read at so many levels, quantiles of the edges' distances. At each, components of the last one are
    joined by the edges up to its distance, and edges inside a component go, so the graph shrinks (these are the
    components of a minimum spanning tree cut at that distance); from finish edges on one task does the levels left. A
    component of min_size points is a node. A node whose only such child is one of the last level goes on with that
    child's cluster; with two children or more it begins a new one. A cluster's stability is the sum of size times the
    span of 1 / distance over its levels; it is chosen unless those chosen below it have more. A last node that holds
    all is no cluster. All others are -1.
    """
    quantiles = edges.agg(F.percentile_approx("w", [(i + 1) / levels for i in range(levels)], 10_000)).first()[0] or []
    limits = sorted(set(quantiles))
    inverse = [1 / max(t, 1e-6) for t in limits] + [0.0]
    spans = [x - y for x, y in zip(inverse, inverse[1:], strict=False)]
    nodes = points.select(F.col("vec_id").alias("label"), F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("own"), F.lit(0.0).alias("sub"), F.lit(False).alias("node"))
    steps, child = [], F.col("node")
    while limits and edges.count() > finish:
        t, span = limits.pop(0), spans.pop(0)
        moved = components(nodes.select(F.col("label").alias("id")), edges.where(F.col("w") <= t).select("a", "b")).withColumnRenamed("label", "up")
        below = checkpointed(nodes.join(moved, F.col("label") == F.col("id")).drop("id"))
        total = lambda c: F.sum(F.when(child, c).otherwise(0.0))
        above = below.groupBy("up").agg(F.sum("size").alias("size"), F.count_if(child).alias("children"), total(F.col("own")).alias("own"), total(F.col("sub")).alias("sub"), total(F.greatest("own", "sub")).alias("best"))
        mass, one = F.col("size") * F.lit(float(span)), F.col("children") == 1
        above = checkpointed(above.select(F.col("up").alias("label"), "size", (F.when(one, F.col("own")).otherwise(0.0) + mass).alias("own"), F.when(one, F.col("sub")).otherwise(F.col("best")).alias("sub"), (F.col("size") >= min_size).alias("node"), one.alias("goes_on")))
        steps.append((below, above.select(F.col("label").alias("at"), "goes_on")))
        nodes = above.drop("goes_on")
        mapped = edges.where(F.col("w") > t).join(moved.select(F.col("id").alias("a"), F.col("up").alias("ua")), "a").join(moved.select(F.col("id").alias("b"), F.col("up").alias("ub")), "b").where("ua <> ub")
        edges = checkpointed(mapped.groupBy(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).agg(F.min("w").alias("w")))
    chosen = finished_levels(nodes, edges, limits, spans, min_size)
    for below, goes_on in reversed(steps):
        known = below.join(chosen.withColumnRenamed("label", "of"), F.col("up") == F.col("of")).join(goes_on, F.col("up") == F.col("at"))
        begins = F.when(child & ~F.col("goes_on") & (F.col("own") >= F.col("sub")), F.col("label"))
        chosen = checkpointed(known.select("label", F.coalesce("cluster", begins).alias("cluster")))
    return chosen.select(F.col("label").alias("vec_id"), F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


def density_clusters(vectors: DataFrame, k: int = 15, min_samples: int = 5, min_size: int = 10, levels: int = 12, **parameters) -> DataFrame:
    """vec_id, cluster for each row of vectors: the least vec_id of its density cluster, -1 for noise.

    Null vectors and those without a length are noise. Rows that share a vec_id are one vector, any of theirs. An empty
    table gives no rows.
    """
    one = vectors.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    graph = neighbours(one, k, **parameters)
    found = condensed(graph.select("vec_id"), checkpointed(reachability(graph, min_samples)), min_size, levels)
    return vectors.select("vec_id").join(found, "vec_id", "left").select("vec_id", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))
