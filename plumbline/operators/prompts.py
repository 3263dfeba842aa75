"""Construction of prompt tables: fields, samples, splits, modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: For each type of task what the judge is told of the answer's form, and how to compare.
JUDGE_RULES = {
    "mcq": ("a single option letter", "the letters must be equal"),
    "tfx": ("T, F or X", "the letters must be equal"),
    "ids": ("a list of technique IDs", "the sets of parent IDs must be equal"),
    "vsp": ("a CVSS v3 vector", "the vectors must be equal without their prefix"),
}


def normalised(rows: DataFrame, prompt: Sequence[str], gold: Sequence[str]) -> DataFrame:
    """prompt and gold from the first of several columns that is filled; a gold of digits is an option's number."""
    first = lambda names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names])
    value = first(gold)
    letter = F.try_element_at(F.array(*[F.lit(c) for c in "ABCD"]), F.expr("try_cast(_gold as int) + 1"))
    out = rows.withColumn("_prompt", first(prompt)).withColumn("_gold", value)
    return out.withColumn("gold", F.when(F.col("_gold").rlike("^[0-3]$"), letter).otherwise(F.col("_gold"))).withColumn("prompt", F.col("_prompt")).drop("_prompt", "_gold")


def nested_gold(gold: Column, metadata: Column, path: str) -> Column:
    return F.coalesce(F.nullif(gold, F.lit("")), F.get_json_object(metadata, path))


def mcq_prompt(question: Column, choices: Column) -> Column:
    """A question with its first four choices, lettered; fewer than two choices are an error."""
    lettered = F.transform(F.slice(choices, 1, 4), lambda c, i: F.concat(F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), i + 1), F.lit(") "), c))
    return F.when(F.size(choices) >= 2, F.concat_ws("\n", question, F.array_join(lettered, "\n"))).otherwise(F.raise_error(F.lit("choices are missing")))


def few_shot(rows: DataFrame, shots: DataFrame, k: int) -> DataFrame:
    """Each prompt after the first k shots of its task (ordered by ord), as (task, prompt)."""
    by = Window.partitionBy("task").orderBy("ord")
    chosen = shots.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= k)
    prefix = chosen.groupBy("task").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "shot"))), lambda s: s["shot"]), "\n\n").alias("prefix"))
    return rows.join(prefix, "task", "left").withColumn("prompt", F.concat_ws("\n\n", "prefix", "prompt")).drop("prefix")


def modes(rows: DataFrame, names: Sequence[str] = ("zero_shot", "few_shot", "cot"), prefix: str = "", suffix: str = "Think step by step.") -> DataFrame:
    """Each row in each mode."""
    out = rows.withColumn("mode", F.explode(F.array(*[F.lit(n) for n in names])))
    return out.withColumn("prompt", F.when(F.col("mode") == "few_shot", F.concat(F.lit(prefix), F.col("prompt"))).when(F.col("mode") == "cot", F.concat_ws("\n", F.col("prompt"), F.lit(suffix))).otherwise(F.col("prompt")))


def mixed_order(idx: str = "idx", seed: int = 42) -> list[Column]:
    """A fixed shuffled order of ids."""
    return [(F.col(idx) * 7919 + seed * 104729) % 1000003 * 48271 % 2147483647, F.col(idx)]


def split(rows: DataFrame, n_shot: int = 2, n_test: int = 100, seed: int = 42) -> DataFrame:
    """part "shot" or "test" for disjoint samples of each task."""
    place = F.row_number().over(Window.partitionBy("task").orderBy(*mixed_order(seed=seed)))
    part = F.when(F.col("_n") <= n_shot, "shot").when(F.col("_n") <= n_shot + n_test, "test")
    return rows.withColumn("_n", place).withColumn("part", part).where("part is not null").drop("_n")


def stratified(rows: DataFrame, n: int = 100, seed: int = 0) -> DataFrame:
    """n rows of each task, or all of a smaller one."""
    place = F.row_number().over(Window.partitionBy("task").orderBy(*mixed_order(seed=seed)))
    return rows.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def head(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("task").orderBy("idx"))).where(F.col("_n") <= n).drop("_n")


def without_chinese(rows: DataFrame, text: str) -> DataFrame:
    return rows.where(~F.coalesce(F.col(text), F.lit("")).rlike("[\\u4e00-\\u9fff]"))


def first_source(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Rows of the first source (model_id by pref) that each task has."""
    known = rows.join(F.broadcast(order), "model_id")  # a row for each model
    return known.join(known.groupBy("task").agg(F.min("pref").alias("pref")), ["task", "pref"], "left_semi")


def todo(items: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items without a result, or whose result failed."""
    return items.join(done.where(~F.col("failed")), list(keys), "left_anti")


def judge_prompts(rows: DataFrame, rules: dict = JUDGE_RULES) -> DataFrame:
    """The text put to a judge for each response, by the type of its task; an unknown type is an error."""
    table = rows.sparkSession.createDataFrame([(k, *v) for k, v in rules.items()], "task_type string, hint string, rule string")
    known = rows.join(F.broadcast(table), "task_type", "left")  # a row for each type
    text = F.format_string("Question: %s\nGold answer: %s\nResponse: %s\nExpected form: %s. Rule: %s.", "question", "gold", "response", "hint", "rule")
    return known.withColumn("judge_prompt", F.when(F.col("hint").isNull(), F.raise_error(F.lit("unknown type of task"))).otherwise(text)).drop("hint", "rule")


#: The letters of options.
LETTERS = "ABCDEFGHIJ"


def choice_block(choices: Column) -> Column:
    """The options as lines, from JSON text: a list is lettered ("A) x"), an object's entries come in the order of their
    keys ("A. x"), any other text stands as it is. Null for nothing, for an empty text, list or object."""
    text = F.trim(choices)
    listed = F.from_json(text, "array<string>")
    # an item past the last letter has its number
    lettered = F.transform(listed, lambda c, i: F.concat(F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in LETTERS]), i + 1), (i + 1).cast("string")), F.lit(") "), F.coalesce(c, F.lit(""))))
    entries = F.array_sort(F.map_entries(F.from_json(text, "map<string,string>")))
    keyed = F.transform(entries, lambda e: F.concat(e["key"], F.lit(". "), F.coalesce(e["value"], F.lit(""))))
    block = F.when(text.startswith("["), F.array_join(F.coalesce(lettered, F.array(text)), "\n")).when(text.startswith("{"), F.array_join(F.coalesce(keyed, F.array(text)), "\n")).otherwise(text)
    return F.nullif(block, F.lit(""))


def question_block(question: Column, choices: Column, task_type: Column, with_choices: Sequence[str] = ("mcq",)) -> Column:
    """A question and, for the types that have options, the block of these after it."""
    block = F.when(task_type.isin(*with_choices), choice_block(choices))
    return F.concat(F.coalesce(question, F.lit("")), F.coalesce(F.concat(F.lit("\n\nAnswer choices:\n"), block), F.lit("")))
