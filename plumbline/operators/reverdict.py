"""A judge's stated comparison rule applied to the answer that the judge itself extracted; cells by their own metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scores
from .graphs import components

KINDS = ("letter", "letters", "cwe", "vector", "techniques", "mitigations", "actor")


def found(pattern: str, x: Column, group: int = 1) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(x, F.lit(""))), F.lit(pattern), F.lit(group))))


def canonical(kind: str, x: Column) -> Column:
    """What an answer of a kind comes to under its rule, as text; null if nothing valid is there.

    letter: one letter in any case. letters: the set of letters, in any order. cwe: the set of numbers, with or without
    prefix. vector: the metrics without the prefix of 3.0 or 3.1. techniques: the set of parents. mitigations: the set of ids.
    actor: the name without outer spaces, in small letters.
    """
    plain = F.upper(F.trim(F.coalesce(x, F.lit(""))))
    if kind == "letter":
        return F.when(plain.rlike("^[A-Z]$"), plain)
    if kind == "vector":
        bare = F.regexp_replace(plain, r"^CVSS:3\.[01]/", "")
        return F.when(bare.rlike("^AV:"), bare)
    if kind == "actor":
        return F.when(~plain.isin("", "NONE"), F.lower(plain))
    if kind == "letters":
        listed = F.when(plain.rlike(r"^[A-Z](?:[ ,]*[A-Z])*$") & (plain != "NONE"), found("([A-Z])", x)).otherwise(F.array().cast("array<string>"))
    elif kind == "cwe":
        listed = F.transform(found(r"(?:CWE-)?(\d+)", x), lambda n: F.regexp_replace(n, "^0+(?=.)", ""))
    else:
        listed = found({"techniques": r"\b(T\d{4})(?:\.\d{3})?\b", "mitigations": r"\b(M\d{4})\b"}[kind], x)
    return F.when(F.size(listed) > 0, F.array_join(F.array_sort(F.array_distinct(listed)), ","))


def by_kind(kind: Column, x: Column) -> Column:
    out = F.when(kind == KINDS[0], canonical(KINDS[0], x))
    for k in KINDS[1:]:
        out = out.when(kind == k, canonical(k, x))
    return out


def re_verdicts(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows (kind, extracted, truth, ...) with rederived: whether the stated rule of the kind finds them equal.

    aliases (a, b) are names of one actor; two actors are equal if their names, or the components of their names over
    these, are. Nothing valid on the judge's side is never equal, and other kinds (judged by meaning) have a null.
    """
    lowered = aliases.select(F.lower(F.trim("a")).alias("a"), F.lower(F.trim("b")).alias("b"))
    names = lowered.select(F.explode(F.array("a", "b")).alias("name")).distinct().withColumn("id", F.xxhash64("name"))
    links = lowered.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    group = names.join(components(names.select("id"), links), "id").select("name", "label")
    actor = F.col("kind") == "actor"
    keyed = rows.withColumns({"_x": by_kind(F.col("kind"), F.col("extracted")), "_y": by_kind(F.col("kind"), F.col("truth"))})
    side = lambda c: group.select(F.col("name").alias(f"{c}n"), F.col("label").alias(f"{c}l"))
    both = keyed.join(side("_x"), actor & (F.col("_x") == F.col("_xn")), "left").join(side("_y"), actor & (F.col("_y") == F.col("_yn")), "left")
    equal = F.coalesce((F.col("_x") == F.col("_y")) | (actor & (F.col("_xl") == F.col("_yl"))), F.lit(False))
    return both.withColumn("rederived", F.when(F.col("kind").isin(*KINDS), equal)).select(*rows.columns, "rederived")


def rates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with stated and rederived: counts of both, and the share that differ."""
    known = rows.where("stated is not null and rederived is not null")
    return known.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("stated").alias("stated_correct"), F.count_if("rederived").alias("rule_correct"), F.avg((F.col("stated") != F.col("rederived")).cast("int")).alias("differ_rate"))


CELL = ("task", "model_id")


def metric_cells(verdicts: DataFrame, deviations: DataFrame, sets: DataFrame, tasks: DataFrame) -> DataFrame:
    """task, model_id, metric, value, normal, total, correct, tp, fp, fn: each cell by the metric of its task's type.

    tasks: task, task_type. Deviation tasks (vsp) have the mean deviation of base scores, invalid ones at 10, and as normal
    1 - mad / 7.7, no less than 0; set tasks (ids) the micro F1 with its counts; the others accuracy over verdicts
    that weren't skipped. A cell whose own metric has no rows falls back to accuracy.
    """
    acc = scores.summary(verdicts).where("task <> 'ALL'").withColumnRenamed("accuracy", "_acc")
    mad = scores.deviations(deviations, CELL).select(*CELL, F.col("mad_penalised").alias("_mad"))
    f1 = scores.micro(sets, CELL).select(*CELL, "tp", "fp", "fn", F.col("micro_f1").alias("_f1"))
    cells = acc.join(mad, list(CELL), "full").join(f1, list(CELL), "full").join(tasks.select("task", "task_type"), "task")
    is_mad, is_f1 = (F.col("task_type") == "vsp") & F.col("_mad").isNotNull(), (F.col("task_type") == "ids") & F.col("_f1").isNotNull()
    value = F.when(is_mad, F.col("_mad")).when(is_f1, F.col("_f1")).otherwise(F.col("_acc"))
    shown = lambda c, when: F.when(when, F.col(c)).alias(c)
    metric = F.when(is_mad, "mad").when(is_f1, "f1").otherwise("accuracy")
    normal = F.when(is_mad, F.greatest(F.lit(0.0), 1 - F.col("_mad") / 7.7)).otherwise(value)
    return cells.select(*CELL, metric.alias("metric"), value.alias("value"), normal.alias("normal"), "total", "correct", *[shown(c, is_f1) for c in ("tp", "fp", "fn")])


def metric_summary(cells: DataFrame) -> DataFrame:
    """metric_cells() and a row for each model with task ALL: totals, and the mean of its cells' normal values."""
    every = cells.groupBy("model_id").agg(F.lit("ALL").alias("task"), F.lit("mean").alias("metric"), F.avg("normal").alias("value"), F.avg("normal").alias("normal"), *[F.sum(c).alias(c) for c in ("total", "correct", "tp", "fp", "fn")])
    return cells.unionByName(every.select(*cells.columns))
