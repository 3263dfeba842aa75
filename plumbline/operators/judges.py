"""Comparison of judges: verdicts and extractions, leaderboards, strata with human labels, versions of summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .correlation import average_rank, safe_corr

ITEM = ("task", "model_id", "idx")


def kept(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(~F.coalesce(F.col("skipped"), F.lit(False)))


def common_items(verdicts: DataFrame, k: int) -> DataFrame:
    """Items that all k judges judged, with said: each judge's is_correct and trimmed extraction (null: empty).

    verdicts has one row an item and judge (task, model_id, idx, judge, is_correct, extracted, skipped)."""
    said = F.struct("judge", F.coalesce("is_correct", F.lit(False)).alias("is_correct"), F.trim(F.coalesce("extracted", F.lit(""))).alias("extracted"))
    return kept(verdicts).groupBy(*ITEM).agg(F.collect_set(said).alias("said")).where(F.size(F.array_distinct(F.transform("said", lambda s: s["judge"]))) == k)


def comparison(verdicts: DataFrame, k: int) -> DataFrame:
    """task, model_id, common, verdict_disagreements, extraction_disagreements, either: on the items that all k judges
    judged, those whose verdicts or extractions aren't all equal; with totals of tasks (model_id null) and of all ("ALL")."""
    differ = lambda field: F.size(F.array_distinct(F.transform("said", lambda s: s[field]))) > 1
    items = common_items(verdicts, k).select("task", "model_id", differ("is_correct").alias("v"), differ("extracted").alias("e"))
    out = items.rollup("task", "model_id").agg(F.count("*").alias("common"), F.count_if("v").alias("verdict_disagreements"), F.count_if("e").alias("extraction_disagreements"), F.count_if(F.col("v") | F.col("e")).alias("either"))
    return out.withColumn("task", F.coalesce("task", F.lit("ALL")))


def verdict_distribution(verdicts: DataFrame, k: int) -> DataFrame:
    """task, judge, n_correct, n_incorrect, n_none (extractions that are empty or NONE), on the items that all k judges
    judged."""
    rows = common_items(verdicts, k).select("task", F.explode("said").alias("s"))
    none = F.upper("s.extracted").isin("", "NONE")
    return rows.groupBy("task", F.col("s.judge").alias("judge")).agg(F.count_if("s.is_correct").alias("n_correct"), F.count_if(~F.col("s.is_correct")).alias("n_incorrect"), F.count_if(none).alias("n_none"))


def leaderboards(verdicts: DataFrame) -> DataFrame:
    """judge, model_id, acc, rank: models by each judge's accuracy, equal ones at their mean rank."""
    acc = kept(verdicts).groupBy("judge", "model_id").agg(F.avg(F.col("is_correct").cast("int")).alias("acc"))
    return acc.withColumn("_v", F.round("acc", 9)).withColumn("rank", average_rank(F.col("_v"), ["judge"])).drop("_v")


def leaderboard_rho(verdicts: DataFrame) -> DataFrame:
    """first, second, models, rho, largest_shift: Spearman's rho of two judges' leaderboards over the models of both.
    Leaderboards have a row a judge and model."""
    acc = leaderboards(verdicts).select("judge", "model_id", F.round("acc", 9).alias("acc"))
    a, b = acc.alias("a"), acc.alias("b")
    both = a.join(b, (F.col("a.model_id") == F.col("b.model_id")) & (F.col("a.judge") < F.col("b.judge"))).select(F.col("a.judge").alias("first"), F.col("b.judge").alias("second"), F.col("a.acc").alias("x"), F.col("b.acc").alias("y"))
    ranked = both.withColumn("rx", average_rank(F.col("x"), ["first", "second"])).withColumn("ry", average_rank(F.col("y"), ["first", "second"]))
    return ranked.groupBy("first", "second").agg(F.count("*").alias("models"), safe_corr(F.col("rx"), F.col("ry")).alias("rho"), F.max(F.abs(F.col("rx") - F.col("ry"))).alias("largest_shift"))


def family_gains(verdicts: DataFrame, models: DataFrame, judges: DataFrame) -> DataFrame:
    """model_id, family, own, others, gain: a model's accuracy by the judges of its own family against the mean of the
    other judges'. models: model_id, family; judges: judge, family. Without a judge on either side the gain is null."""
    of_judge = judges.select("judge", F.col("family").alias("_judge_family"))
    acc = leaderboards(verdicts).join(models.select("model_id", "family"), "model_id").join(of_judge, "judge")
    own = F.coalesce(F.col("family") == F.col("_judge_family"), F.lit(False))
    out = acc.groupBy("model_id", "family").agg(F.avg(F.when(own, F.col("acc"))).alias("own"), F.avg(F.when(~own, F.col("acc"))).alias("others"))
    return out.withColumn("gain", F.col("own") - F.col("others"))


def stratum(extracted: Column, is_correct: Column, rule: Column) -> Column:
    """"none" where the judge extracted nothing, "conflict" where verdict and stated rule differ, else "control"."""
    none = F.upper(F.trim(F.coalesce(extracted, F.lit("")))).isin("", "NONE")
    return F.when(none, "none").when(is_correct != F.coalesce(rule, F.lit(False)), "conflict").otherwise("control")


def strata(verdicts: DataFrame, predictions: DataFrame, judge: str) -> DataFrame:
    """task, model_id, idx, stratum, is_correct: one judge's verdicts beside the rule that pred equals gold."""
    of = kept(verdicts).where(F.col("judge") == judge).select(*ITEM, "is_correct", "extracted")
    rule = F.col("pred") == F.col("gold")
    return of.join(predictions.select(*ITEM, "pred", "gold"), list(ITEM)).select(*ITEM, stratum(F.col("extracted"), F.col("is_correct"), rule).alias("stratum"), "is_correct")


def strata_agreement(verdicts: DataFrame, predictions: DataFrame, judge: str, other: str) -> DataFrame:
    """stratum, n, agreement, only_first, only_second: how another judge agrees within the first one's strata."""
    second = kept(verdicts).where(F.col("judge") == other).select(*ITEM, F.col("is_correct").alias("second"))
    both = strata(verdicts, predictions, judge).join(second, list(ITEM))
    a, b = F.col("is_correct"), F.col("second")
    return both.groupBy("stratum").agg(F.count("*").alias("n"), F.avg((a == b).cast("int")).alias("agreement"), F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"))


def strata_sample(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows of each stratum in the order of a hash of the item, or all of a smaller one."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "task", F.col("model_id").cast("string"), F.col("idx").cast("string")))
    return rows.withColumn("_o", order).withColumn("_n", F.row_number().over(Window.partitionBy("stratum").orderBy("_o", *ITEM))).where(F.col("_n") <= n).drop("_o", "_n")


def annotated_strata(rows: DataFrame, annotations: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """stratum, n, sampled, labelled, agreement, adjudicated, upheld: the size of each stratum and, on a sample of n, how
    often people agree with the judge, how often they call the answer right, and how many conflicts they decide for the
    judge. annotations: task, model_id, idx, human ("correct", "incorrect", or blank, which counts for nothing)."""
    sample = strata_sample(rows, n, seed).join(annotations.select(*ITEM, F.lower(F.trim("human")).alias("human")), list(ITEM), "left")
    right = F.when(F.col("human") == "correct", True).when(F.col("human") == "incorrect", False)
    said = sample.groupBy("stratum").agg(F.count("*").alias("sampled"), F.count(right).alias("labelled"), F.avg((right == F.col("is_correct")).cast("int")).alias("agreement"), F.avg(right.cast("int")).alias("adjudicated"), F.count_if(right == F.col("is_correct")).alias("upheld"))
    return rows.groupBy("stratum").agg(F.count("*").alias("n")).join(said, "stratum")


def versions(summaries: DataFrame, verdicts: DataFrame) -> DataFrame:
    """task, model_id, judge, acc, n, source: a cell's accuracy from the judge's summary, else the mean of its detailed
    verdicts; n is the number of these in both cases. summaries: task, model_id, judge, accuracy."""
    details = kept(verdicts).groupBy("task", "model_id", "judge").agg(F.avg(F.col("is_correct").cast("int")).alias("_mean"), F.count("*").alias("_n"))
    both = summaries.select("task", "model_id", "judge", "accuracy").join(details, ["task", "model_id", "judge"], "full")
    acc = F.coalesce("accuracy", "_mean")
    source = F.when(F.col("accuracy").isNotNull(), "summary").when(F.col("_mean").isNotNull(), "details")
    return both.select("task", "model_id", "judge", acc.alias("acc"), F.coalesce("_n", F.lit(0)).alias("n"), source.alias("source")).where("acc is not null")


def version_gaps(cells: DataFrame, judge: str, least: float = 0.05, top: int = 20) -> DataFrame:
    """task, model_id, acc, base, gap: cells whose accuracy by one judge is farthest from the mean of the others that
    have the cell. Cells that nobody else has are not compared."""
    mine, others = F.col("judge") == judge, F.col("judge") != judge
    both = cells.groupBy("task", "model_id").agg(F.max(F.when(mine, F.col("acc"))).alias("acc"), F.avg(F.when(others, F.col("acc"))).alias("base"))
    gaps = both.withColumn("gap", F.round(F.abs(F.col("acc") - F.col("base")), 9)).where(F.col("gap") >= least)
    return gaps.orderBy(F.col("gap").desc(), "task", "model_id").limit(top)


def mode_pivot(runs: DataFrame, modes: Sequence[str] = ("zero_shot", "few_shot", "cot"), low: str = "zero_shot", high: str = "cot") -> DataFrame:
    """task, model_id, an accuracy in percent for each mode of prompting, delta (high minus low). Cells that lack a mode
    are left out. runs: task, model_id, mode, correct."""
    pivoted = runs.groupBy("task", "model_id").agg(*[F.avg(F.when(F.col("mode") == m, F.col("correct").cast("int"))).alias(m) for m in modes]).dropna(subset=list(modes))
    return pivoted.select("task", "model_id", *[(F.col(m) * 100).alias(m) for m in modes], ((F.col(high) - F.col(low)) * 100).alias("delta"))


def mode_effects(pivoted: DataFrame, modes: Sequence[str] = ("zero_shot", "few_shot", "cot")) -> DataFrame:
    """model_id, tasks, mean of each mode, mean_delta, gained and lost tasks, and the task that gains most."""
    d = F.round("delta", 9)
    return pivoted.groupBy("model_id").agg(F.count("*").alias("tasks"), *[F.avg(m).alias(m) for m in modes], (F.round(F.avg("delta"), 9) + 0.0).alias("mean_delta"), F.count_if(d > 0).alias("gained"), F.count_if(d < 0).alias("lost"), F.min_by("task", F.struct((-d).alias("d"), "task")).alias("gains_most"))
