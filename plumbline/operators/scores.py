"""Scoring of responses under competing denominators and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gated(pred: Column, gold: Column, allowed: Sequence[str]) -> tuple[Column, Column]:
    """valid: the prediction is one of the allowed; correct: valid and equal to gold."""
    valid = F.coalesce(pred.isin(*allowed), F.lit(False))
    return valid, valid & (pred == gold)


def accuracies(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of rows with valid and correct: both denominators, the invalid, and how much the valid-only one inflates."""
    n, valid, correct = F.count("*"), F.count_if("valid"), F.count_if("correct")
    strict, kind = correct / n, F.try_divide(correct, valid)
    return scored.groupBy(*keys).agg(
        n.alias("total"), valid.alias("valid"), (n - valid).alias("invalid"), correct.alias("correct"),
        kind.alias("acc_valid"), strict.alias("acc_total"), F.try_divide(kind, strict).alias("inflation"),
    )


def deviations(scored: DataFrame, keys: Sequence[str], worst: float = 10.0, scale: float = 7.7) -> DataFrame:
    """Mean absolute deviation of score_pred from score_gold: over valid rows, and with invalid ones as the worst;
    each as an accuracy, with and without the clamp at 0."""
    gap = F.abs(F.col("score_pred") - F.col("score_gold"))
    skipping, penalised = F.avg(gap), F.coalesce(F.round(F.avg(F.coalesce(F.round(gap, 2), F.lit(worst))), 3), F.lit(worst))
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count(gap).alias("n_valid"), skipping.alias("mad"), penalised.alias("mad_penalised"),
        (1 - skipping / scale).alias("acc_unclamped"), F.greatest(F.lit(0.0), 1 - penalised / scale).alias("acc_clamped"),
    )


def set_scores(pred: Column, gold: Column, empty: str = "zero") -> Column:
    """tp, fp, fn, precision, recall, f1 and exact of two arrays. With an empty gold set: "zero" scores 0 (exact if
    both are empty), "one" scores f1 1 if both are empty, "skip" gives a null f1."""
    tp = F.size(F.array_intersect(pred, gold)).cast("long")
    n, m = F.size(pred), F.size(gold)
    precision, recall = F.when(n > 0, tp / n).otherwise(F.lit(0.0)), F.when(m > 0, tp / m).otherwise(F.lit(0.0))
    f1 = F.when(tp > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    if empty == "one":
        f1 = F.when((n == 0) & (m == 0), F.lit(1.0)).otherwise(f1)
    elif empty == "skip":
        f1 = F.when(m > 0, f1)
    exact = F.array_sort(pred) == F.array_sort(gold)
    return F.struct(tp.alias("tp"), (n - tp).alias("fp"), (m - tp).alias("fn"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), exact.alias("exact"))


def micro(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Micro precision, recall and F1 of rows with s (set_scores), exact matches, and the macro F1."""
    tp, fp, fn = F.sum("s.tp"), F.sum("s.fp"), F.sum("s.fn")
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return scored.groupBy(*keys).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), p.alias("precision"), r.alias("recall"), f1.alias("micro_f1"), F.count_if("s.exact").alias("exact"), F.avg("s.f1").alias("macro_f1"))


def protocol_gap(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean F1 under a strict and a lenient reading, and format errors: nothing strictly, something leniently."""
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("strict_f1").alias("strict"), F.avg("lenient_f1").alias("lenient"), (F.avg("lenient_f1") - F.avg("strict_f1")).alias("gap"), F.count_if((F.col("strict_f1") == 0) & (F.col("lenient_f1") > 0)).alias("format_errors"))


def by_topic(scored: DataFrame) -> DataFrame:
    """Accuracy of each of several topics of a row, and of all rows, each once."""
    acc = [F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy")]
    topics = scored.select(F.explode("topics").alias("topic"), "correct").groupBy("topic").agg(*acc)
    return topics.unionByName(scored.agg(*acc).select(F.lit("Overall").alias("topic"), "n", "accuracy"))


def summary(verdicts: DataFrame) -> DataFrame:
    """Accuracy per (model, task) and per model in one pass; skipped rows leave both counts."""
    kept = verdicts.where(~F.coalesce(F.col("skipped"), F.lit(False)))
    out = kept.groupingSets([["model_id", "task"], ["model_id"]], "model_id", "task").agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct"))
    return out.withColumn("accuracy", F.try_divide("correct", "total")).withColumn("task", F.coalesce("task", F.lit("ALL")))


def best_of_task(cells: DataFrame, lower_is_better: Column, value: str = "value", tolerance: float = 0.0) -> DataFrame:
    """Marks the cells of each task that are its best in the metric's direction, within a tolerance."""
    from pyspark.sql import Window

    by = Window.partitionBy("task")
    gap = F.when(lower_is_better, F.col(value) - F.min(value).over(by)).otherwise(F.max(value).over(by) - F.col(value))
    return cells.withColumn("is_best", gap <= tolerance)


def degenerate(responses: DataFrame, keys: Sequence[str], placeholder: str) -> DataFrame:
    """Shares of empty responses, of the commonest answer and of placeholders."""
    counts = responses.groupBy(*keys, "model_response").agg(F.count("*").alias("k"))
    return counts.groupBy(*keys).agg(
        F.sum("k").alias("n"),
        (F.sum(F.when(F.trim("model_response") == "", F.col("k")).otherwise(0)) / F.sum("k")).alias("empty_rate"),
        (F.max("k") / F.sum("k")).alias("dominant_share"),
        (F.sum(F.when(F.col("model_response").rlike(placeholder), F.col("k")).otherwise(0)) / F.sum("k")).alias("placeholder_rate"),
    )


def ordinal(score: Column) -> Column:
    """A judge's score, held to 1 to 5."""
    return F.greatest(F.lit(1), F.least(F.lit(5), score))
