"""Readers and writers of evaluation files. Schemas are given, never inferred; Spark's readers open all paths."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RESPONSE = "task string, index string, prompt string, ground_truth string, model_response string, metadata string"
VERDICT = (
    "index string, question string, ground_truth string, model_response string, extracted_answer string, judge_response string, judge_justification string, is_correct boolean, skipped boolean, "
    "extracted_vector string, extraction_success boolean, mad double, tp int, fp int, fn int, exact_match boolean, score int, reason string"
)
#: Where model, task and judge stand in a path, in folders with a name or of the form column=name.
RESPONSE_PATH = r"(?:^|[/=])responses_([^/]+)/(?:[^/=]+=)?([^/]+?)_responses\.jsonl"
VERDICT_PATH = r"(?:^|[/=])([^/=]+?)_judge_([^/]+?)(_v1|_v2|__by_[^/]+)?/(?:[^/=]+=)?([^/]+?)_detailed\.jsonl"
MODEL_PATH = r"(?:^|[/=])(?:responses|judge)_([^/]+)/"


def with_path(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_path", F.col("_metadata.file_path"))


def response_tree(spark: SparkSession, root: str, schema: str = RESPONSE, names: str = "*.jsonl") -> DataFrame:
    """Responses below root; model and task come from the path, "-" in a task counts as "_", broken lines go."""
    rows = with_path(spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", names).json(root))
    model, task = F.regexp_extract("_path", RESPONSE_PATH, 1), F.regexp_extract("_path", RESPONSE_PATH, 2)
    return rows.withColumn("model", model).withColumn("task", F.lower(F.replace(task, F.lit("-"), F.lit("_")))).where("model <> '' and not model like '%_smoke'").drop("_path")


def verdict_tree(spark: SparkSession, root: str, schema: str = VERDICT, names: str = "*.jsonl") -> DataFrame:
    """Verdicts below root with model, judge, version ("" for the default, else _v1, _v2 or __by_...) and task."""
    rows = with_path(spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", names).json(root))
    parts = [F.regexp_extract("_path", VERDICT_PATH, g).alias(n) for g, n in enumerate(("model", "judge", "version", "task"), 1)]
    return rows.select("*", *parts).drop("_path")


def discovered(spark: SparkSession, root: str, order: Sequence[str] = (), names: str = "*") -> DataFrame:
    """model, place: the models with a folder responses_... or judge_... below root, without smoke tests and verdicts by
    other judges, and without suffixes of versions; those of order first, in it, then the others by name. Only paths
    are read."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root).select("path")
    model = F.regexp_extract("path", MODEL_PATH, 1)
    found = paths.select(model.alias("model")).where("model <> '' and not endswith(model, '_smoke') and not contains(model, '__by_')")
    found = found.select(F.regexp_replace("model", "_v[12]$", "").alias("model")).distinct()
    known = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(m) for m in order]).cast("array<string>"), F.col("model")), F.lit(0)), F.lit(1 << 40))
    return found.select("model", F.row_number().over(Window.orderBy(known, "model")).cast("long").alias("place"))  # a row for each model


def tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without the broken ones."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def with_broken(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with the broken ones in _corrupt_record."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a broken one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def all_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """JSON lines with every value as text, null as empty."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("primitivesAsString", "true").json(path).na.fill("")


def concatenated(spark: SparkSession, path: str) -> DataFrame:
    """Objects that follow one another without separators: file, position and the object as JSON text. What is no JSON
    is passed over to the next opening brace."""

    def objects(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = json.JSONDecoder()
        for frame in frames:
            for file, text in zip(frame["_path"], frame["value"], strict=True):
                out, at = [], text.find("{")
                while at >= 0:
                    try:
                        value, end = decoder.raw_decode(text, at)
                        out.append((file, len(out), json.dumps(value, ensure_ascii=False)))
                    except json.JSONDecodeError:
                        end = at + 1
                    at = text.find("{", end)
                yield pd.DataFrame(out, columns=["file", "position", "object"])

    return with_path(spark.read.option("wholetext", "true").text(path)).mapInPandas(objects, "file string, position long, object string")


def tsv(spark: SparkSession, path: str, columns: list[str], quoted: bool = False, header: bool = True) -> DataFrame:
    """Tab-separated rows; short rows are filled with empty text."""
    reader = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("sep", "\t").option("header", header).option("quote", '"' if quoted else "")
    return reader.csv(path).na.fill("")


def nested(spark: SparkSession, path: str, field: str, element: str, whole: bool = True) -> DataFrame:
    """The elements of one array of JSON documents, each a whole file or else a line."""
    rows = spark.read.schema(f"`{field}` array<{element}>").option("multiLine", whole).json(path)
    return rows.select(F.explode(field).alias("_e")).select("_e.*")


def option_details(spark: SparkSession, path: str, letters: str = "ABCD") -> DataFrame:
    """Details files (task in the name; gold index, logprobs, prompt) as responses."""
    rows = with_path(spark.read.parquet(path))
    names = F.array(*[F.lit(c) for c in letters])
    best = F.array_position("logprobs", F.array_max("logprobs")).cast("int")
    return rows.select(
        F.regexp_extract("_path", r"details_([^/|]+)", 1).alias("task"), F.element_at(names, F.col("gold") + 1).alias("ground_truth"), F.element_at(names, best).alias("model_response"),
        F.regexp_extract("prompt", r"(?s)Question:\s*(.*?)\n[A-D][).]", 1).alias("question"), F.regexp_extract_all("prompt", F.lit(r"(?m)^[A-D][).]\s*(.*)$"), F.lit(1)).alias("choices"),
    )


def verdict_files(spark: SparkSession, folder: str, schema: str, compact_to: str | None = None, whole: bool = True) -> DataFrame:
    """Many small one-verdict files in one scan; compact_to rewrites them as Parquet."""
    rows = spark.read.schema(schema).option("multiLine", whole).option("recursiveFileLookup", "true").json(folder)
    if compact_to:
        rows.hint("rebalance").write.mode("overwrite").parquet(compact_to)
        rows = rows.sparkSession.read.parquet(compact_to)
    return rows


def write(rows: DataFrame, path: str, form: str = "parquet", by: tuple[str, ...] = ("model", "task")) -> None:
    """Rows in a folder for each value of by."""
    keys = [k for k in by if k in rows.columns]
    rows.repartition(*keys).write.mode("overwrite").partitionBy(*keys).format(form).save(path) if keys else rows.write.mode("overwrite").format(form).save(path)


SUMMARY = "tasks map<string,struct<accuracy:double,correct:bigint,total:bigint>>, total_correct bigint, total_samples bigint, overall_accuracy double"


def write_summary(cells: DataFrame, path: str) -> None:
    """A summary for each model, as one JSON document in the model's folder. cells: model, task, correct, total."""
    cell = F.struct("task", F.struct((F.col("correct") / F.col("total")).alias("accuracy"), "correct", "total").alias("cell"))
    of = cells.groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(cell))).alias("tasks"), F.sum("correct").alias("total_correct"), F.sum("total").alias("total_samples"))  # a cell for each task
    whole = of.withColumn("overall_accuracy", F.col("total_correct") / F.col("total_samples"))
    whole.select("model", F.to_json(F.struct("tasks", "total_correct", "total_samples", "overall_accuracy")).alias("value")).write.mode("overwrite").partitionBy("model").text(path)


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """model, task, accuracy, correct, total, overall_accuracy of the summaries below path."""
    rows = spark.read.schema(f"{SUMMARY}, model string").json(path)
    return rows.select("model", "overall_accuracy", F.explode("tasks").alias("task", "cell")).select("model", "task", "cell.*", "overall_accuracy")


def write_table(cells: DataFrame, path: str, models: Sequence) -> None:
    """A CSV table with a row for each task and a column for each of the models: accuracies of four places, or NA."""
    shown = cells.groupBy("task").pivot("model", list(models)).agg(F.first(F.format_string("%.4f", F.col("acc"))))
    shown.na.fill("NA").orderBy("task").write.mode("overwrite").option("header", True).csv(path)


def refresh(rows: DataFrame, path: str, by: tuple[str, ...]) -> None:
    """Replaces only the partitions that rows has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


#: Fixed value: what a summary holds of each task.
SUMMARY_TEXT = "struct<tasks: map<string, struct<accuracy: double, total: double>>>"


def summary_entries(documents: DataFrame, value: str = "value") -> DataFrame:
    """A row for each task in the summaries, which are JSON texts with a map "tasks" from a task's key to its entry: the
    other columns, key, accuracy, total. A text that is null, broken or without the map gives no rows."""
    others = [c for c in documents.columns if c != value]
    return documents.select(*others, F.explode(F.from_json(value, SUMMARY_TEXT)["tasks"]).alias("key", "_entry")).select(*others, "key", F.col("_entry.accuracy").alias("accuracy"), F.col("_entry.total").alias("total"))


def summary_lookup(wanted: DataFrame, entries: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """wanted (keys, task) with accuracy (null where the summary lacks the task or the number), total (0 where it does) and
    found. A task's key has capitals and underscores only."""
    key = F.upper(F.replace(F.col("task"), F.lit("-"), F.lit("_")))
    found = wanted.withColumn("_key", key).join(entries.withColumnRenamed("key", "_key").withColumn("_found", F.lit(True)), [*keys, "_key"], "left")
    return found.select(*wanted.columns, "accuracy", F.coalesce(F.col("total").cast("long"), F.lit(0)).alias("total"), F.coalesce("_found", F.lit(False)).alias("found"))
