"""Queries that stream derived responses through files of the shared folder."""

from pyspark.sql import functions as F

from ..functions import extract
from ..sources import files
from ..sources.folders import new_folder, read_once
from ..streaming import arrivals
from .registry import add

SCHEMA = "task string, model_id long, idx long, gold string, text string"


def landed(t):
    """Answers as JSON files, in three deliveries of which the last repeats rows of the first."""
    folder = new_folder(t.spark, "arrivals")
    for part in ("idx % 2 = 0", "idx % 2 = 1", "idx % 10 = 0"):
        t.answers.where(part).write.mode("append").json(f"{folder}/in")
    return folder


def scored(rows):
    return rows.withColumn("pred", extract.cascade(F.col("text"))).withColumn("correct", F.coalesce(F.col("pred") == F.col("gold"), F.lit(False))).select("task", "model_id", "idx", "correct")


def incremental(t):
    folder = landed(t)
    return read_once(arrivals.score_arrivals(arrivals.arriving(t.spark, f"{folder}/in", SCHEMA, 4), scored, f"{folder}/out", f"{folder}/log"), folder)


def running(t):
    """Three deliveries; the last one corrects a tenth of the answers."""
    folder = new_folder(t.spark, "arrivals")
    fixed = F.when(F.col("delivery") == 2, F.concat(F.lit("ANSWER: "), F.col("gold"))).otherwise(F.col("text"))
    for number, part in enumerate(("idx % 2 = 0", "idx % 2 = 1", "idx % 10 = 0")):
        t.answers.where(part).withColumn("delivery", F.lit(number)).withColumn("text", fixed).write.mode("append").json(f"{folder}/in")
    stream = arrivals.arriving(t.spark, f"{folder}/in", f"{SCHEMA}, delivery long")
    judged = stream.withColumn("correct", F.coalesce(extract.cascade(F.col("text")) == F.col("gold"), F.lit(False)))
    return read_once(arrivals.running_accuracy(judged.select(*arrivals.KEY, "delivery", "correct"), f"{folder}/out", f"{folder}/log"), folder)


def refreshed(t):
    path = new_folder(t.spark, "cells")
    files.refresh(t.cells.withColumn("acc", F.lit(0.0)), path, ("task",))
    files.refresh(t.cells.where("task < 'src5'"), path, ("task",))
    return read_once(t.spark.read.parquet(path).groupBy("task").agg(F.count("*").alias("n"), F.sum("acc").alias("acc")), path)


LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


def last_line(match: str) -> str:
    return f"list_last(list_filter(list_transform({LINES}, lambda x: {match}), lambda y: y IS NOT NULL))"


CASCADE = "coalesce(" + ", ".join(last_line(m) for m in (
    r"upper(nullif(regexp_extract(x, '\*\*(?:Final )?Answer:\*\*\s*([A-D])\b', 1, 'i'), ''))", r"upper(nullif(regexp_extract(x, '(?:Final )?Answer:\s*([A-D])\b', 1, 'i'), ''))", "nullif(regexp_extract(upper(x), '^([A-D])$', 1), '')",
    "nullif(regexp_extract(upper(x), '^([A-D])(?:[^)]|$)', 1), '')", r"nullif(regexp_extract(upper(x), '\b([A-D])\b', 1), '')")) + f", list_last({LINES}))"
SCORED = f"SELECT task, model_id, idx, coalesce({CASCADE} = gold, FALSE) AS correct FROM answers"

add("t02_incremental_scores", incremental, "SELECT * FROM scored", scored=SCORED)
add("t03_running_accuracy", running, "SELECT task, model_id, count(*) AS n, count_if(correct OR (idx % 10 = 0 AND gold IS NOT NULL)) AS correct FROM scored JOIN (SELECT DISTINCT task, idx, gold FROM answers) USING (task, idx) GROUP BY ALL", scored=SCORED)
add("t04_refreshed_partitions", refreshed, "SELECT task, count(*) AS n, sum(CASE WHEN task < 'src5' THEN acc ELSE 0 END) AS acc FROM cells GROUP BY ALL")
