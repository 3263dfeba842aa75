"""Scoring of responses as they arrive, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ("task", "model_id", "idx")


def arriving(spark: SparkSession, folder: str, schema: str, files_at_once: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(folder)


def score_arrivals(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataFrame:
    """Scores what has arrived since the last run and returns all scores. Each batch replaces its own folder, so a
    batch that is run again after a failure leaves no rows twice; of repeated keys the last batch's row counts."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        scored = score(batch).dropDuplicates(list(KEY)).withColumn("batch", F.lit(number))
        scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    every = spark.read.parquet(out)
    others = [c for c in every.columns if c not in (*KEY, "batch")]
    return every.groupBy(*KEY).agg(F.max_by(F.struct(*others), "batch").alias("_r")).select(*KEY, "_r.*")


#: The items of a task and model are dealt to so many keys of the state, so that a large task is no single key.
BUCKETS = 4
KNOWN = "idx array<long>, delivery array<long>, correct array<boolean>"
CHANGE = "task string, model_id long, n long, correct long"


class LastVerdicts(StatefulProcessor):
    """Keeps the last verdict on each item of its key, and gives out what a batch changes in the counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", KNOWN)

    def handleInputRows(self, key, rows, timerValues):
        held = self.known.get() if self.known.exists() else ([], [], [])
        items = {i: (d, c) for i, d, c in zip(*held, strict=True)}
        n = correct = 0
        for frame in rows:
            for i, d, c in zip(frame["idx"].tolist(), frame["delivery"].tolist(), frame["correct"].tolist(), strict=True):
                old = items.get(i)
                if old is None or (d, c) > old:  # takes back the old verdict and adds the new one
                    n += old is None
                    correct += bool(c) - (old is not None and bool(old[1]))
                    items[i] = (d, c)
        self.known.update((list(items), [d for d, _ in items.values()], [c for _, c in items.values()]))
        if n or correct:
            yield pd.DataFrame({"task": [key[0]], "model_id": [key[1]], "n": [n], "correct": [correct]})

    def close(self) -> None:
        pass


def running_accuracy(stream: DataFrame, out: str, checkpoint: str, buckets: int = BUCKETS) -> DataFrame:
    """task, model_id, n, correct over all that has arrived: of verdicts on one item that of the last delivery counts.

    stream: task, model_id, idx, delivery (a number that grows), correct; of one delivery's verdicts on an item true counts.
    State is kept for each item by a keyed processor; a batch writes the changes of the counts to a folder of its own,
    which a batch that is run again replaces, so a restart from the checkpoint counts nothing twice. Reading sums one
    row for each cell and batch. Rows with a null in a key column, delivery or verdict don't count.
    """
    spark = stream.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    given = stream.dropna(subset=["task", "model_id", "idx", "delivery", "correct"]).withColumn("bucket", F.pmod(F.xxhash64("idx"), F.lit(buckets)))
    changes = given.groupBy("task", "model_id", "bucket").transformWithStateInPandas(LastVerdicts(), CHANGE, "Update", "None")

    def put(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("task", "model_id").agg(F.sum("n").alias("n"), F.sum("correct").alias("correct")).withColumn("batch", F.lit(number))
        sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    return spark.read.schema(CHANGE + ", batch int").parquet(out).groupBy("task", "model_id").agg(F.sum("n").alias("n"), F.sum("correct").alias("correct"))
