"""Rank correlation of tasks over models, with resampling whose replicates are rows."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import checkpointed


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate; null for a constant side."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.when(spread > 1e-12, spread))


def average_rank(value: Column, keys: Sequence[str]) -> Column:
    """Ranks from 1 with ties at their mean."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def with_ranks(cells: DataFrame, keys: Sequence[str] = ("task",)) -> DataFrame:
    rounded = cells.withColumn("_v", F.round("acc", 9))
    return rounded.withColumn("rank", average_rank(F.col("_v"), keys)).drop("_v")


def task_pairs(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every pair of tasks a < b with both tasks' columns for each model (x_ and y_)."""
    a, b = cells.alias("a"), cells.alias("b")
    both = a.join(b, (F.col("a.model_id") == F.col("b.model_id")) & (F.col("a.task") < F.col("b.task")))
    return both.select(F.col("a.task").alias("task_a"), F.col("b.task").alias("task_b"), F.col("a.model_id").alias("model_id"), *[F.col(f"a.{c}").alias(f"x_{c}") for c in columns], *[F.col(f"b.{c}").alias(f"y_{c}") for c in columns])


def pearson_pairs(cells: DataFrame) -> DataFrame:
    return task_pairs(cells, ["acc"]).groupBy("task_a", "task_b").agg(F.count("*").alias("n"), safe_corr(F.col("x_acc"), F.col("y_acc")).alias("r"))


def spearman_pairs(cells: DataFrame) -> DataFrame:
    return task_pairs(with_ranks(cells), ["rank"]).groupBy("task_a", "task_b").agg(F.count("*").alias("n"), safe_corr(F.col("x_rank"), F.col("y_rank")).alias("rho"))


def crossed_weight(y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each row of weights the sum of products over pairs i < j with y[i] > y[j]: inversions, by merging.

    At each width the left half of a block is before the right one; in the order of y within blocks, running sums of the
    left's weights say what a right one meets above it. Time n log n a row, and n log^2 n for the orders.
    """
    n, total, width = len(y), np.zeros(len(weights)), 1
    place = np.arange(n)
    while width < n:
        block, left = place // (2 * width), (place // width) % 2 == 0
        order = np.lexsort((left, -y, block))  # larger y first, among equal ones the right half first
        sums = np.cumsum(weights[:, order] * left[order], axis=1)
        starts = np.searchsorted(block[order], block[order])
        before = np.where(starts > 0, sums[:, np.maximum(starts - 1, 0)], 0.0)
        total += ((sums - before) * weights[:, order] * ~left[order]).sum(1)
        width *= 2
    return total


def tied_weight(groups: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each row of weights the sum of squares of its sums over the groups."""
    order = np.argsort(groups, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(groups[order]) != 0]))
    return (np.add.reduceat(weights[:, order], starts, axis=1) ** 2).sum(1)


def taus(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kendall's tau-b for each row of weights (how often each model counts), NaN where a side has no order; and the
    variant that keeps pairs that tie on both sides in the denominators. Values alike to nine digits tie."""
    _, x = np.unique(np.round(x, 9), return_inverse=True)
    _, y = np.unique(np.round(y, 9), return_inverse=True)
    order = np.lexsort((y, x))
    x, y, w = x[order], y[order], weights[:, order].astype(float)
    whole, in_x, in_y = w.sum(1) ** 2, tied_weight(x, w), tied_weight(y, w)
    in_both, one = tied_weight(x * (len(x) + 1) + y, w), (w * w).sum(1)
    unlike = (whole - in_x - in_y + in_both) / 2  # pairs that tie on no side
    score = unlike - 2 * crossed_weight(y, w)
    nx, ny, both = (whole - in_x) / 2, (whole - in_y) / 2, (in_both - one) / 2
    divided = lambda p: np.where(p > 0, score / np.sqrt(np.where(p > 0, p, 1)), np.nan)
    return divided(nx * ny), divided((nx + both) * (ny + both))


def paired_lists(cells: DataFrame, *columns: str) -> DataFrame:
    """task_a, task_b and the lists x, y and columns over the models of both: a row for each pair of tasks."""
    pairs = task_pairs(cells, ["acc", *columns])
    each = F.struct(F.col("x_acc").alias("x"), F.col("y_acc").alias("y"), *[F.col(f"x_{c}").alias(c) for c in columns])
    packed = pairs.groupBy("task_a", "task_b").agg(F.collect_list(each).alias("_m"))
    return packed.select("task_a", "task_b", *[F.col("_m")[c].alias(c) for c in ("x", "y", *columns)])


#: Points of two values that one task puts in order.
POINTS = 1 << 16


def kendall_pairs(cells: DataFrame, points: int = POINTS) -> DataFrame:
    """task_a, task_b, tau, tau_fast of each pair of tasks, by counting inversions: no pairs of models are made.

    Models without a value in either task don't count. A pair whose values are all alike on one side has null. Models alike in
    both values (to nine digits) are one point with a weight. Points are cut into runs of bounded size, once in the order
    of (x, y) and once in that of (y, x); inversions lie in one run of the first, in one of the second, or between cells of
    the grid of both, of which only sums are kept.
    """
    pair, key = ["task_a", "task_b"], ["task_a", "task_b", "x", "y"]
    alike = lambda c: F.round(c, 9) + F.lit(0.0)
    found = task_pairs(cells.where("acc is not null"), ["acc"]).select(*pair, alike(F.col("x_acc")).alias("x"), alike(F.col("y_acc")).alias("y"))
    weighed = checkpointed(found.groupBy(*key).agg(F.count("*").alias("w")))
    parts = max(1, -(-weighed.count() // points))

    def inversions(batches, apart):
        """Of each pair of tasks in one run: pairs in the order of (x, y) that fall in y, those of one other run not counted if apart."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).to_pandas()
        for names, own in rows.groupby(pair, sort=False):
            own = own.sort_values(["x", "y"])
            y, w = np.unique(own["y"].to_numpy(), return_inverse=True)[1], own["w"].to_numpy(float)[None, :]
            total = crossed_weight(y, w)[0]
            if apart:
                total -= sum(crossed_weight(y[at], w[:, at])[0] for at in own.groupby("first").indices.values() if len(at) > 1)
            yield pa.RecordBatch.from_pydict({"task_a": [names[0]], "task_b": [names[1]], "crossed": [float(total)]})

    one, out = lambda rows: inversions(rows, False), "task_a string, task_b string, crossed double"
    if parts == 1:
        crossed = weighed.coalesce(1).mapInArrow(one, out)
    else:
        firsts = checkpointed(weighed.repartitionByRange(parts, "task_a", "task_b", "x", "y").withColumn("first", F.spark_partition_id()))
        both = checkpointed(firsts.repartitionByRange(parts, "task_a", "task_b", "y", "x").withColumn("second", F.spark_partition_id()))
        grid = both.groupBy(*pair, "first", "second").agg(F.sum("w").alias("w"))

        def between(frame: pd.DataFrame) -> pd.DataFrame:
            at = [np.unique(frame[c].to_numpy(), return_inverse=True) for c in ("first", "second")]
            sums = np.zeros([len(v) for v, _ in at])
            sums[at[0][1], at[1][1]] = frame["w"]
            before = np.cumsum(np.cumsum(sums, axis=0)[:, ::-1], axis=1)[:, ::-1]  # of earlier and same rows, same and later columns
            return pd.DataFrame({"task_a": frame["task_a"][:1], "task_b": frame["task_b"][:1], "crossed": [float((sums[1:, :-1] * before[:-1, 1:]).sum())]})

        crossed = firsts.mapInArrow(one, out).unionByName(both.mapInArrow(lambda rows: inversions(rows, True), out)).unionByName(grid.groupBy(*pair).applyInPandas(between, out))
    square = lambda by, c: weighed.groupBy(*pair, *by).agg(F.sum("w").alias("w")).groupBy(*pair).agg(F.sum(F.col("w") * F.col("w")).cast("double").alias(c))
    sums = weighed.groupBy(*pair).agg(F.pow(F.sum("w").cast("double"), 2).alias("whole"), F.sum("w").cast("double").alias("one"), F.sum(F.col("w") * F.col("w")).cast("double").alias("in_both"))
    every = sums.join(square(["x"], "in_x"), pair).join(square(["y"], "in_y"), pair).join(crossed.groupBy(*pair).agg(F.sum("crossed").alias("crossed")), pair)
    score = (F.col("whole") - F.col("in_x") - F.col("in_y") + F.col("in_both")) / 2 - 2 * F.col("crossed")
    nx, ny, tied = (F.col("whole") - F.col("in_x")) / 2, (F.col("whole") - F.col("in_y")) / 2, (F.col("in_both") - F.col("one")) / 2
    divided = lambda p, q: F.when((p > 0) & (q > 0), score / F.sqrt(p * q))
    return every.select(*pair, divided(nx, ny).alias("tau"), divided(nx + tied, ny + tied).alias("tau_fast"))


def draw(rep: Column, slot: Column, n: Column | int, seed: int = 0) -> Column:
    """A model number for a slot of a replicate, the same on every run."""
    return ((rep * 7919 + slot * 104729 + rep * slot * 31 + (seed + 1) * 15485863) % 1000003 * 48271 % 2147483647) % n


#: Replicates whose weights are held at once.
REPS_AT_ONCE = 256


def drawn_weights(reps: np.ndarray, n: int, seed: int) -> np.ndarray:
    """How often each of n models is drawn in each replicate, by the numbers of draw()."""
    rep, slot = reps[:, None].astype(np.int64), np.arange(n, dtype=np.int64)[None, :]
    place = ((rep * 7919 + slot * 104729 + rep * slot * 31 + (seed + 1) * 15485863) % 1000003 * 48271 % 2147483647) % n
    return np.stack([np.bincount(p, minlength=n) for p in place])


def bootstrap_tau(cells: DataFrame, reps: int = 100, seed: int = 0) -> DataFrame:
    """Percentile interval of tau for each pair of tasks, models (of any ids) drawn with replacement, as many as there are;
    replicates with fewer than three different models don't count.

    A pair of tasks is one row with the lists of its models' values, a replicate a row of weights over them: neither pairs
    of models nor rows of replicates are made.
    """
    places = cells.select("model_id").distinct().select("model_id", (F.row_number().over(Window.orderBy("model_id")) - 1).cast("long").alias("place"))  # a row for each model
    n = places.count()
    placed = cells.where("acc is not null").join(places, "model_id")

    def intervals(frames):
        for frame in frames:
            found = [[] for _ in range(len(frame))]
            for low in range(0, reps, REPS_AT_ONCE):
                weights = drawn_weights(np.arange(low, min(low + REPS_AT_ONCE, reps)), n, seed)
                weights = weights[(weights > 0).sum(1) >= 3]
                for out, x, y, place in zip(found, frame["x"], frame["y"], frame["place"], strict=True):
                    if len(weights):
                        tau = taus(np.array(x, float), np.array(y, float), weights[:, np.array(place)])[0]
                        out.append(tau[~np.isnan(tau)])
            found = [np.concatenate(f) if f else np.zeros(0) for f in found]
            at = lambda q: [float(np.quantile(f, q)) if len(f) else None for f in found]
            yield pd.DataFrame({"task_a": frame["task_a"], "task_b": frame["task_b"], "reps": [len(f) for f in found], "lo": at(0.025), "hi": at(0.975)})

    return paired_lists(placed, "place").mapInPandas(intervals, "task_a string, task_b string, reps long, lo double, hi double")


def permutation_p(cells: DataFrame, reps: int = 100) -> DataFrame:
    """Two-sided permutation p of Pearson's r for each pair of tasks: y's models are shuffled in each replicate."""
    models = cells.select("model_id").distinct().withColumn("place", F.row_number().over(Window.orderBy("model_id")))  # a row for each model
    reps_ = cells.sparkSession.range(reps).withColumnRenamed("id", "rep")
    shuffled = models.crossJoin(F.broadcast(reps_)).withColumn("to", F.row_number().over(Window.partitionBy("rep").orderBy(draw(F.col("rep"), F.col("model_id"), 2147483647), "model_id")))
    moves = shuffled.join(models.select(F.col("model_id").alias("as_model"), F.col("place").alias("to")), "to").select("rep", "model_id", "as_model")
    observed = pearson_pairs(cells).select("task_a", "task_b", "r")
    x, y = cells.alias("x"), cells.alias("y")
    moved = x.join(moves, "model_id").join(y, (F.col("as_model") == F.col("y.model_id")) & (F.col("x.task") < F.col("y.task")))
    null = moved.groupBy(F.col("x.task").alias("task_a"), F.col("y.task").alias("task_b"), "rep").agg(safe_corr(F.col("x.acc"), F.col("y.acc")).alias("r0"))
    both = null.join(observed, ["task_a", "task_b"])
    return both.groupBy("task_a", "task_b").agg(((F.count_if(F.abs("r0") >= F.abs("r") - 1e-9) + 1) / (F.count("r0") + 1)).alias("p"))


def partial_pairs(cells: DataFrame, parents: DataFrame) -> DataFrame:
    """Pearson on ranks of tasks of one parent, given the ranks of the mean of the parent's other tasks (leave one
    out, for the first task of the pair)."""
    known = cells.join(parents.select("task", "parent"), "task")
    by = Window.partitionBy("parent", "model_id")
    rest = known.withColumn("others", F.round(F.try_divide(F.sum("acc").over(by) - F.col("acc"), F.count("*").over(by) - 1), 9)).where("others is not null")
    ranked = with_ranks(rest).withColumn("control", average_rank(F.col("others"), ["task"]))
    a, b = ranked.alias("a"), ranked.alias("b")
    both = a.join(b, (F.col("a.model_id") == F.col("b.model_id")) & (F.col("a.parent") == F.col("b.parent")) & (F.col("a.task") < F.col("b.task")))
    x, y, z = F.col("a.rank"), F.col("b.rank"), F.col("a.control")
    out = both.groupBy(F.col("a.task").alias("task_a"), F.col("b.task").alias("task_b")).agg(safe_corr(x, y).alias("xy"), safe_corr(x, z).alias("xz"), safe_corr(y, z).alias("yz"))
    bottom = (1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz"))
    return out.select("task_a", "task_b", F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), F.sqrt(F.when(bottom > 1e-12, bottom))).alias("partial"))


def redundant(taus: DataFrame, intervals: DataFrame, least: float = 0.85, least_lo: float = 0.70) -> DataFrame:
    return taus.join(intervals, ["task_a", "task_b"]).where((F.col("tau") > least) & (F.col("lo") > least_lo))


def within_across(values: DataFrame, parents: DataFrame, value: str) -> DataFrame:
    """Counts, means and quartiles of a pair statistic within parents and across them."""
    of = parents.select("task", "parent")
    a, b = of.select(F.col("task").alias("task_a"), F.col("parent").alias("pa")), of.select(F.col("task").alias("task_b"), F.col("parent").alias("pb"))
    rows = values.join(F.broadcast(a), "task_a").join(F.broadcast(b), "task_b").where(F.col(value).isNotNull())  # a row for each task
    kind = F.when(F.col("pa") == F.col("pb"), "within").otherwise("across")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.25).alias("p25"), F.percentile(value, 0.75).alias("p75"))


#: A digest of 64 hex digits gives so many numbers of six digits.
DRAWS = 10


def poisson_limits(most: int = 11) -> list[float]:
    """P(X < k) of the Poisson distribution of mean 1 for k from 1; beyond most it is 1 in the 24 bits of a draw."""
    total, term, out = 0.0, float(np.exp(-1)), []
    for k in range(1, most + 1):
        total += term
        out.append(total)
        term /= k
    return out


#: Replicates that one pass over the items serves, and items whose weights are held at once.
BLOCK_REPS, ITEMS_AT_ONCE = 1000, 512


def poisson_weights(keys: Sequence[str], low: int, reps: int) -> np.ndarray:
    """The weight of each item (a row) in each of reps replicates from low on, DRAWS of them from one digest."""
    tenths = range(low // DRAWS, -(-(low + reps) // DRAWS))
    digests = b"".join(hashlib.sha256(f"{k}:{t}".encode()).digest()[: 3 * DRAWS] for k in keys for t in tenths)
    parts = np.frombuffer(digests, np.uint8).reshape(len(keys), len(tenths) * DRAWS, 3).astype(np.int64)
    u = (parts[..., 0] << 16 | parts[..., 1] << 8 | parts[..., 2]) / float(1 << 24)
    return np.searchsorted(poisson_limits(), u, side="right")[:, low % DRAWS :][:, :reps]


def item_bootstrap(scored: DataFrame, reps: int = 200, seed: int = 0) -> DataFrame:
    """Ranking stability: items are drawn with Poisson(1) weights in each replicate, models ranked by weighted accuracy
    under two protocols (a, b), and the rankings correlated. Returns replicates, mean rho and its percentile interval.

    scored: task, model_id, idx, a, b (booleans); an item is a task's idx. Its draw in a replicate is a part of a digest, so
    all of its models share it; each digest serves DRAWS replicates. Items are read once for BLOCK_REPS replicates and
    make no rows of replicates: a task adds up an array of weighted sums a model, and hands on one row for each
    (replicate, model), whatever the number of items.
    """
    items = scored.groupBy("task", "idx").agg(F.collect_list(F.struct("model_id", "a", "b")).alias("said"))  # an element for each model
    keyed = items.select(F.concat_ws(":", F.lit(str(seed)), "task", F.col("idx").cast("string")).alias("key"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(BLOCK_REPS))).alias("low"), "said")

    def summed(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for first in range(0, batch.num_rows, ITEMS_AT_ONCE):
                part = batch.slice(first, ITEMS_AT_ONCE)
                lows = part.column("low").to_numpy()
                for low in np.unique(lows).tolist():
                    mine = part.filter(pa.array(lows == low))
                    weights = poisson_weights(mine.column("key").to_pylist(), low, min(BLOCK_REPS, reps - low))
                    said = mine.column("said")
                    item = np.repeat(np.arange(len(mine)), np.diff(said.offsets.to_numpy()))
                    flat = said.flatten()
                    model = flat.field("model_id").to_numpy()
                    for m in np.unique(model).tolist():
                        of = model == m
                        w = weights[item[of]]
                        right = [(w * np.asarray(flat.field(c).fill_null(False).filter(pa.array(of)).to_numpy(zero_copy_only=False), np.int64)[:, None]).sum(0) for c in ("a", "b")]
                        sums[m, low] = sums.get((m, low), 0) + np.stack([w.sum(0), *right])
        for (m, low), (w, x, y) in sums.items():
            rep = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(rep + low, pa.int64()), pa.array(np.full(len(rep), m), pa.int64()), *[pa.array(v[rep], pa.int64()) for v in (w, x, y)]], ["rep", "model_id", "w", "x", "y"])

    parts = keyed.mapInArrow(summed, "rep long, model_id long, w long, x long, y long")
    acc = parts.groupBy("rep", "model_id").agg((F.sum("x") / F.sum("w")).alias("acc_a"), (F.sum("y") / F.sum("w")).alias("acc_b"))
    ranked = acc.select("rep", average_rank(F.round("acc_a", 12), ["rep"]).alias("ra"), average_rank(F.round("acc_b", 12), ["rep"]).alias("rb"))
    rho = ranked.groupBy("rep").agg(safe_corr(F.col("ra"), F.col("rb")).alias("rho"))
    return rho.agg(F.count("rho").alias("reps"), F.avg("rho").alias("mean"), F.percentile("rho", 0.025).alias("lo"), F.percentile("rho", 0.975).alias("hi"))


def filled(cells: DataFrame, value: str = "acc") -> DataFrame:
    """cells without the models that have no value at all."""
    return cells.join(cells.where(F.col(value).isNotNull()).select("model_id").distinct(), "model_id", "left_semi")


#: Keys of the smaller side at most for the exact Gram matrix; it is 8 MB on the driver then.
SMALL_SIDE = 1024
#: For two large sides: vectors beyond the components asked for, rounds at most, and the change of shares that ends them.
SPARE, ROUNDS, STILL = 16, 60, 1e-10
#: Components at most for two large sides.
MOST_COMPONENTS = 64
#: Rows of the other side that a task multiplies at once.
ROWS_AT_ONCE = 2048


def standardised(cells: DataFrame) -> DataFrame:
    """task, model_id, z of the cells with a value, each model's values standardised over tasks. A missing value counts as
    the model's mean, so it is no row."""
    stats = cells.groupBy("model_id").agg(F.avg("acc").alias("_mean"), F.stddev_pop("acc").alias("_sd"))
    scale = F.when(F.col("_sd") < 1e-12, 1.0).otherwise(F.col("_sd"))
    return checkpointed(cells.where(F.col("acc").isNotNull()).join(stats, "model_id").select("task", "model_id", ((F.col("acc") - F.col("_mean")) / scale).alias("z")))


def gram(z: DataFrame, side: str, other: str) -> tuple[list, np.ndarray]:
    """The keys of a side (SMALL_SIDE at most) and the matrix of products of their columns, summed over the other side.

    A task multiplies its rows of the other side in blocks and hands on one matrix; these are summed by rows of it."""
    keys = [r[0] for r in z.select(side).distinct().orderBy(side).collect()]
    size = len(keys)
    places = z.sparkSession.createDataFrame([(k, i) for i, k in enumerate(keys)], f"{side} {z.schema[side].dataType.simpleString()}, _p int")
    rows = z.join(F.broadcast(places), side).groupBy(other).agg(F.collect_list("_p").alias("p"), F.collect_list("z").alias("z"))  # SMALL_SIDE elements at most

    def products(batches):
        total = np.zeros((size, size))
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(first, ROWS_AT_ONCE)
                p, values = part.column("p"), part.column("z")
                dense = np.zeros((part.num_rows, size))
                dense[np.repeat(np.arange(part.num_rows), np.diff(p.offsets.to_numpy())), p.flatten().to_numpy()] = values.flatten().to_numpy()
                total += dense.T @ dense
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["p", "g"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"p": frame["p"].iloc[:1], "g": [np.sum(np.stack(frame["g"].to_list()), axis=0)]})

    parts = rows.select("p", "z").mapInArrow(products, "p int, g array<double>")
    out = np.zeros((size, size))
    for r in parts.groupBy("p").applyInPandas(added, "p int, g array<double>").collect():
        out[r.p] = r.g
    return keys, (out + out.T) / 2


def times(z: DataFrame, vectors: DataFrame, by: str, to: str, size: int) -> DataFrame:
    """The table of z times vectors (by, v), added up to (to, v)."""
    sums = [F.sum(F.col("z") * F.col("v")[i]).alias(f"_{i}") for i in range(size)]
    return z.join(vectors, by).groupBy(to).agg(*sums).select(to, F.array(*[f"_{i}" for i in range(size)]).alias("v"))


def mixed(vectors: DataFrame, key: str, by: np.ndarray) -> DataFrame:
    """Each v times a small matrix."""
    return vectors.select(key, F.array(*[sum(F.col("v")[i] * float(by[i, j]) for i in range(by.shape[0])) for j in range(by.shape[1])]).alias("v"))


def inner(vectors: DataFrame, size: int) -> np.ndarray:
    """The small matrix of inner products of the columns of v."""
    pairs = [(i, j) for i in range(size) for j in range(i + 1)]
    row = vectors.agg(*[F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"_{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((size, size))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"_{i}_{j}"] or 0.0
    return out


def descending(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(matrix)
    return np.maximum(values[::-1], 0), vectors[:, ::-1]


def iterated(z: DataFrame, k: int, total: float) -> tuple[np.ndarray, DataFrame]:
    """The first k eigenvalues of the models' products and their vectors (model_id, v) by subspace iteration: hashed start
    vectors, multiplied by the table and back, made orthonormal by the small matrix of their inner products, until the
    shares stand still. Neither side's matrix is made; a round shuffles the cells twice."""
    size, last = k + SPARE, np.zeros(k)
    start = [F.xxhash64(F.lit(i), "model_id") / F.lit(2.0**63) for i in range(size)]
    vectors = z.select("model_id").distinct().select("model_id", F.array(*start).alias("v"))
    for _ in range(ROUNDS):
        vectors = checkpointed(times(z, times(z, vectors, "model_id", "task", size), "task", "model_id", size))
        values, turn = descending(inner(vectors, size))
        real = values > values[0] * 1e-20
        vectors = mixed(vectors, "model_id", turn[:, real] / np.sqrt(values[real]))
        size = int(real.sum())
        now = np.zeros(k)
        now[: min(k, size)] = np.sqrt(values[real])[:k] / total
        if np.abs(now - last).max() < STILL:
            break
        last = now
    values, turn = descending(inner(times(z, vectors, "model_id", "task", size), size))
    return values[:k], mixed(vectors, "model_id", turn[:, :k])


def components(cells: DataFrame, k: int, small: int = SMALL_SIDE) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """The standardised cells, shares of variance of the first k components at most, and their vectors (model_id, v).

    The Gram matrix of models, else of tasks, where one has small keys at most; else subspace iteration, which takes
    MOST_COMPONENTS components at most."""
    z = standardised(cells)
    size = z.agg(F.countDistinct("model_id").alias("models"), F.countDistinct("task").alias("tasks"), F.sum(F.col("z") * F.col("z")).alias("total")).first()
    total = size.total or 1.0
    spark = z.sparkSession
    if size.models <= small or size.tasks <= small:
        side, other = ("model_id", "task") if size.models <= small else ("task", "model_id")
        keys, products = gram(z, side, other)
        values, vectors = descending(products)
        k = min(k, len(keys))
        table = spark.createDataFrame([(key, vectors[i, :k].tolist()) for i, key in enumerate(keys)], f"{side} {z.schema[side].dataType.simpleString()}, v array<double>")
        if side == "task":
            real = np.sqrt(values[:k])
            table = mixed(times(z, F.broadcast(table), "task", "model_id", k), "model_id", np.diag(np.where(real > 1e-9, 1 / np.maximum(real, 1e-9), 0)))
        return z, values[:k] / total, table
    if k > MOST_COMPONENTS:
        raise ValueError(f"more than {small} models and tasks: at most {MOST_COMPONENTS} components")
    values, table = iterated(z, k, total)
    return z, values / total, table


def signed(table: DataFrame, k: int) -> DataFrame:
    """Vectors with the largest entry of each (the first of equal ones) positive."""
    row = table.agg(*[F.max_by(F.signum(F.col("v")[i]), F.struct(F.abs(F.col("v")[i]), -F.col("model_id"))).alias(f"_{i}") for i in range(k)]).first()
    return mixed(table, "model_id", np.diag([row[f"_{i}"] or 1.0 for i in range(k)]))


def principal_components(cells: DataFrame, k: int = 3) -> DataFrame:
    """component, share, cumulative: shares of variance of the first k components of standardised columns (features are
    models, rows are tasks)."""
    shares = components(cells, k)[1]
    return cells.sparkSession.createDataFrame([(i + 1, float(v), float(c)) for i, (v, c) in enumerate(zip(shares, np.cumsum(shares), strict=True))], "component int, share double, cumulative double")


def component_loadings(cells: DataFrame, k: int = 3) -> DataFrame:
    """model_id, component, loading: unit vectors, the largest loading of each positive."""
    _, shares, table = components(cells, k)
    if not len(shares):
        return cells.sparkSession.createDataFrame([], "model_id long, component int, loading double")
    out = signed(table, len(shares)).select("model_id", F.posexplode("v").alias("c", "loading"))
    return out.select("model_id", (F.col("c") + 1).alias("component"), "loading")


def component_scores(cells: DataFrame, k: int = 3) -> DataFrame:
    """task, component, score: the tasks projected on the components; a task without any value is at 0."""
    z, shares, table = components(cells, k)
    if not len(shares):
        return cells.sparkSession.createDataFrame([], "task string, component int, score double")
    scores = times(z, signed(table, len(shares)), "model_id", "task", len(shares)).select("task", F.posexplode("v").alias("c", "score")).select("task", (F.col("c") + 1).alias("component"), "score")
    every = filled(cells).select("task").distinct().crossJoin(cells.sparkSession.range(1, len(shares) + 1).select(F.col("id").cast("int").alias("component")))  # k rows a task
    return every.join(scores, ["task", "component"], "left").select("task", "component", F.coalesce("score", F.lit(0.0)).alias("score"))


def horn_counts(cells: DataFrame, reps: int = 100, seed: int = 0) -> DataFrame:
    """Parallel analysis: observed shares of variance against the 95th percentile of shares of random normal tables of
    the same shape; each replicate is a group of its own."""
    shape = filled(cells).agg(F.countDistinct("task").alias("rows"), F.countDistinct("model_id").alias("columns"))

    def null(frame: pd.DataFrame) -> pd.DataFrame:
        rep, rows, columns = (int(frame[c].iloc[0]) for c in ("rep", "rows", "columns"))
        x = np.random.default_rng([seed, rep]).normal(size=(rows, columns))
        s = np.linalg.svd((x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1), compute_uv=False) ** 2
        return pd.DataFrame({"component": np.arange(1, len(s) + 1), "share": s / s.sum()})

    reps_ = cells.sparkSession.range(reps).withColumnRenamed("id", "rep").crossJoin(F.broadcast(shape))
    limits = reps_.groupBy("rep").applyInPandas(null, "component int, share double").groupBy("component").agg(F.percentile("share", 0.95).alias("limit"))
    return principal_components(cells, SMALL_SIDE).join(limits, "component").withColumn("kept", F.col("share") > F.col("limit"))


def effective_dimension(cells: DataFrame, target: float = 0.9, reps: int = 100) -> DataFrame:
    """One row: n_for_target, the components whose shares first reach the target, and horn_n, those above the limits of
    horn_counts()."""
    short = F.count_if(F.col("cumulative") < target - 1e-12) + 1
    return horn_counts(cells, reps).agg(F.least(short, F.count("*")).alias("n_for_target"), F.count_if("kept").alias("horn_n"))
