"""Reachability in alias graphs and the credit it gives."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import checkpointed


#: So many edges and fewer are finished by one task (16 bytes each).
FINISH = 1 << 19


def finished(edges: DataFrame) -> DataFrame:
    """id, label of the ends of edges (a, b), in one task: for a graph of bounded size."""

    def joined(tables):
        batches = [t for t in tables if t.num_rows]
        a = np.concatenate([t.column(0).to_numpy() for t in batches]) if batches else np.zeros(0, np.int64)
        b = np.concatenate([t.column(1).to_numpy() for t in batches]) if batches else np.zeros(0, np.int64)
        ids, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = places[: len(a)], places[len(a) :]
        label = np.arange(len(ids))
        while len(x):
            least = label.copy()
            np.minimum.at(least, label[x], label[y])
            np.minimum.at(least, label[y], label[x])
            least = least[label]
            while not np.array_equal(least, least[least]):
                least = least[least]
            label = least
            open_ = label[x] != label[y]
            x, y = x[open_], y[open_]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ids[label], pa.int64())], ["id", "label"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(joined, "id long, label long")


def components(vertices: DataFrame, edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """id, label: the least id in reach of each vertex over undirected edges (a, b).

    Large and small stars in turn: each vertex hands its larger neighbours to the least of itself and its neighbours,
    then its smaller ones. Edges are distinct, and those that the stars have made alike go, so the graph shrinks from
    round to round; a graph of finish edges or fewer is finished by one task. A round that changes nothing is the last.
    """
    far = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    far = checkpointed(far)
    stars = None
    while stars is None:
        if far.count() <= finish:
            stars = finished(far)
            break
        both = far.unionByName(far.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = checkpointed(small.distinct())
        if new.count() == far.count() and not new.exceptAll(far).head(1):
            stars = new.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "id")
        far = new
    found = stars.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
    return checkpointed(vertices.select("id").distinct().join(found, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("_label", "id").alias("label")))


def graph_labels(edges: DataFrame) -> DataFrame:
    """id with its component over alias edges and over all edges, and its degree in both."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), (F.col("kind") == "alias").alias("alias")).groupBy("id").agg(F.count_if("alias").alias("alias_degree"), F.count("*").alias("degree"))
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "kind")
    alias = components(ends, pairs.where("kind = 'alias'")).withColumnRenamed("label", "alias_part")
    every = components(ends, pairs).withColumnRenamed("label", "part")
    return ends.join(alias, "id").join(every, "id")


def credit(predictions: DataFrame, edges: DataFrame) -> DataFrame:
    """predictions (gold, pred) with two credits. One: C in the alias component of a gold node that has an alias edge,
    P in the component over all edges of one that has any, else I. The other: C also for equal names, and 1, 0.5, 0."""
    of = graph_labels(edges)
    gold = of.select(F.col("id").alias("gold"), F.col("alias_part").alias("ga"), F.col("part").alias("gp"), "alias_degree", "degree")
    pred = of.select(F.col("id").alias("pred"), F.col("alias_part").alias("pa"), F.col("part").alias("pp"))
    rows = predictions.join(gold, "gold", "left").join(pred, "pred", "left")
    same_alias = F.coalesce((F.col("ga") == F.col("pa")) & (F.col("alias_degree") > 0), F.lit(False))
    same = F.coalesce((F.col("gp") == F.col("pp")) & (F.col("degree") > 0), F.lit(False))
    first = F.when(same_alias, "C").when(same, "P").otherwise("I")
    second = F.when((F.col("gold") == F.col("pred")) | same_alias, "C").when(same, "P").otherwise("I")
    return rows.withColumn("credit", first).withColumn("self_credit", second).withColumn("points", F.when(second == "C", 1.0).when(second == "P", 0.5).otherwise(0.0)).drop("ga", "gp", "pa", "pp", "alias_degree", "degree")
