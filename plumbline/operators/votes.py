"""Votes of models on gold labels, and of judges on correctness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The shares at which a wrong majority flags a label, and the acceptance levels.
THRESHOLDS = (0.30, 0.40, 0.50, 0.60, 2 / 3, 0.75, 5 / 6, 0.90, 1.00)
ALPHAS = (0.5, 0.6, 0.7, 0.8, 0.9)
QUORUM = 3


def majority_cells(verdicts: DataFrame) -> DataFrame:
    """Strict-majority accuracy of each task and model: an item is right if more than half of its judges say so.

    verdicts: task, model_id, idx, judge, is_correct, skipped. Skipped verdicts are no votes; items without a vote
    don't count. Returns n, correct, accuracy and the judges that took part.
    """
    votes = verdicts.where(~F.coalesce(F.col("skipped"), F.lit(False)) & F.col("is_correct").isNotNull())
    items = votes.groupBy("task", "model_id", "idx").agg(F.count_if("is_correct").alias("yes"), F.count("*").alias("votes"), F.collect_set("judge").alias("judges"))
    right = F.count_if(F.col("yes") * 2 > F.col("votes"))
    judges = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("judges")))), "+")
    return items.groupBy("task", "model_id").agg(F.count("*").alias("n"), right.alias("correct"), (right / F.count("*")).alias("accuracy"), judges.alias("source"))


def vote(predictions: DataFrame, keys: Sequence[str], weight: Column | None = None, order: str = "model_id") -> DataFrame:
    """Weighted plurality of each item: winner, its weight, the total, fraction and voters.

    Predictions that are null don't vote; weights of 0 and less don't count, though their voters do. On a tie the
    prediction of the earliest model wins; weights that differ by less than 1e-9 are a tie.
    """
    rows = predictions.where("pred is not null").withColumn("_w", weight if weight is not None else F.lit(1.0))
    voters = F.count("*").alias("voters")
    options = rows.groupBy(*keys, "pred").agg(F.sum(F.when(F.col("_w") > 0, F.col("_w"))).alias("w"), F.min(F.when(F.col("_w") > 0, F.col(order))).alias("first"), F.count_if(F.col("_w") > 0).alias("supporters"), voters)
    top = F.max_by(F.struct("pred", "w", "supporters"), F.struct(F.round("w", 9).alias("even"), (-F.col("first")).alias("early")))
    out = options.groupBy(*keys).agg(top.alias("top"), F.sum("w").alias("total"), F.sum("voters").alias("voters")).where("total > 0")
    return out.select(*keys, F.col("top.pred").alias("winner"), F.col("top.w").alias("winner_weight"), F.col("total"), (F.col("top.w") / F.col("total")).alias("fraction"), F.col("top.supporters").alias("supporters"), "voters")


def prediction_matrix(predictions: DataFrame) -> DataFrame:
    """A row for each item: gold of the first model, and the predictions by model, as text in the order of models."""
    pairs = F.array_sort(F.collect_list(F.when(F.col("pred").isNotNull(), F.struct("model_id", "pred"))))
    return predictions.groupBy("task", "idx").agg(F.min_by("gold", "model_id").alias("gold"), F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["model_id"].cast("string"), p["pred"])), ";").alias("preds"), F.count("pred").alias("n_models"))


def flagged(votes: DataFrame, gold: DataFrame, threshold: float) -> DataFrame:
    """Items whose winner is not the gold label and has the threshold's share of weight."""
    return votes.join(gold, ["task", "idx"]).where((F.col("winner") != F.col("gold")) & (F.col("fraction") >= threshold))


def sweep(votes: DataFrame, gold: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Flagged items of each task at each threshold, and all items, in one pass."""
    wrong = votes.join(gold, ["task", "idx"])
    hits = [F.count_if((F.col("winner") != F.col("gold")) & (F.col("fraction") >= t)).alias(f"t{k}") for k, t in enumerate(thresholds)]
    return wrong.groupBy("task").agg(F.count("*").alias("n"), *hits)


def ranks(cells: DataFrame) -> DataFrame:
    """cells (task, model_id, acc) with rank in the task, its linear and its harmonic weight, and points: the linear
    weight in whole numbers, so that sums of it are exact."""
    by = Window.partitionBy("task").orderBy(F.col("acc").desc(), "model_id")
    n = F.count("*").over(Window.partitionBy("task"))
    ranked = cells.withColumn("rank", F.row_number().over(by)).withColumn("n_models", n)
    ranked = ranked.withColumn("points", (F.col("n_models") - F.col("rank") + 1).cast("long"))
    return ranked.withColumn("linear", (F.col("n_models") - F.col("rank") + 1) / F.col("n_models")).withColumn("harmonic", 1 / F.col("rank"))


def running_votes(predictions: DataFrame, cells: DataFrame, gold: DataFrame, threshold: float) -> DataFrame:
    """Items with a vote and flagged items of each task when only the best k models vote, for every k, in one pass.

    Votes on an item are taken in the order of their models' ranks. An option's votes and first model change only when
    it gets a vote, and then its votes rise; so the winner of the first votes is the greatest (votes, first model) of all
    states so far, and each vote gives out how the item's standing changes at its rank. Changes are added up by rank, then
    along the ranks. A prediction stays one row: the shuffle doesn't grow with k. Ties are those of vote().
    """
    order = ranks(cells).select("task", "model_id", F.col("rank").cast("long").alias("k"))
    rows = predictions.where("pred is not null").select("task", "idx", "model_id", "pred").join(order, ["task", "model_id"]).repartition("task", "idx").join(gold.select("task", "idx", "gold"), ["task", "idx"])
    option = Window.partitionBy("task", "idx", "pred").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    by_rank = Window.partitionBy("task", "idx").orderBy("k", "pred")
    so_far = by_rank.rowsBetween(Window.unboundedPreceding, 0)
    state = rows.withColumn("_state", F.struct(F.count("*").over(option).alias("votes"), (-F.min("model_id").over(option)).alias("early"), "pred"))
    state = state.withColumn("_top", F.max("_state").over(so_far)).withColumn("_total", F.count("*").over(so_far))
    wrong = ((F.col("_top.pred") != F.col("gold")) & (F.col("_top.votes") / F.col("_total") >= threshold)).cast("int")
    state = state.withColumn("_wrong", F.coalesce(wrong, F.lit(0)))
    change = state.select("task", "k", (F.col("_total") == 1).cast("int").alias("n"), (F.col("_wrong") - F.lag("_wrong", 1, 0).over(by_rank)).alias("flagged"))
    at = change.groupBy("task", "k").agg(F.sum("n").alias("n"), F.sum("flagged").alias("flagged"))
    along = Window.partitionBy("task").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # a row for each model of the task
    sums = [F.coalesce(F.sum(c).over(along), F.lit(0)).alias(c) for c in ("n", "flagged")]
    return order.select("task", "k").join(at, ["task", "k"], "left").select("task", "k", *sums)


def top_k(predictions: DataFrame, cells: DataFrame, gold: DataFrame, threshold: float) -> DataFrame:
    """Flagged items of each task when only the best k models vote, for every k at which an item has a vote."""
    return running_votes(predictions, cells, gold, threshold).where("n > 0")


def acceptance(predictions: DataFrame, cells: DataFrame, gold: DataFrame, threshold: float, alphas: Sequence[float] = ALPHAS, quorum: int = QUORUM) -> DataFrame:
    """Flagged items when models with alpha times the best accuracy vote; null where fewer than quorum are eligible.

    Such models are the best k for some k, so the result is read from running_votes() at that k."""
    levels = F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")
    able = cells.withColumn("best", F.max("acc").over(Window.partitionBy("task"))).select("task", "acc", "best", levels).where(F.col("acc") >= F.col("alpha") * F.col("best"))
    counts = able.groupBy("task", "alpha").agg(F.count("*").alias("eligible"))
    met = running_votes(predictions, cells, gold, threshold).select("task", F.col("k").alias("eligible"), "flagged")
    return counts.join(met, ["task", "eligible"], "left").select("task", "alpha", "eligible", F.when(F.col("eligible") >= quorum, F.coalesce("flagged", F.lit(0))).alias("flagged"))


def flag_rates(predictions: DataFrame, cells: DataFrame, gold: DataFrame, threshold: float = 0.5, thresholds: Sequence[float] = THRESHOLDS, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """kind (threshold, k, alpha), level, task, flagged, n, rate: the share of a task's votable items that is flagged.

    At k and alpha the threshold is fixed. Where the quorum failed, flagged and rate are null. Task ALL adds up the tasks
    that have the level and, at an alpha, the quorum.
    """
    swept = sweep(vote(predictions, ["task", "idx"]), gold, thresholds)
    sizes = swept.select("task", "n")
    by_threshold = swept.select("task", F.posexplode(F.array(*[f"t{i}" for i in range(len(thresholds))])).alias("_i", "flagged")).select(F.lit("threshold").alias("kind"), F.element_at(F.array(*[F.lit(float(x)) for x in thresholds]), F.col("_i") + 1).alias("level"), "task", "flagged")
    by_k = running_votes(predictions, cells, gold, threshold).select(F.lit("k").alias("kind"), F.col("k").cast("double").alias("level"), "task", "flagged")
    by_alpha = acceptance(predictions, cells, gold, threshold, alphas).select(F.lit("alpha").alias("kind"), F.col("alpha").alias("level"), "task", "flagged")
    rows = by_threshold.unionByName(by_k).unionByName(by_alpha).join(sizes, "task")
    every = rows.where("flagged is not null").groupBy("kind", "level").agg(F.lit("ALL").alias("task"), F.sum("flagged").alias("flagged"), F.sum("n").alias("n"))
    return rows.unionByName(every).select("kind", "level", "task", "flagged", "n", (F.col("flagged") / F.col("n")).alias("rate"))


def tier(fraction: Column, thresholds: Sequence[float] = THRESHOLDS) -> Column:
    """The highest threshold that a fraction, rounded to four places, reaches (with a tolerance of 1e-9)."""
    out = F
    for t in sorted(thresholds, reverse=True):
        out = out.when(F.round(fraction, 4) >= t - 1e-9, F.lit(float(t)))
    return out.otherwise(F.lit(None).cast("double"))


def verification_bank(votes: DataFrame, gold: DataFrame, least: float = 0.5) -> DataFrame:
    """Flagged items from a share on, with the tier they reach."""
    return flagged(votes, gold, least).select("task", "idx", "gold", "winner", F.round("fraction", 4).alias("fraction"), tier(F.col("fraction")).alias("tier"))


def tiers_reached(bank: DataFrame, verdicts: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """For each agent and tier: flagged items at that tier or above, verified, pending and wrongly flagged ones."""
    level = bank.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("tier"))  # nine rows
    agents = verdicts.select("agent").distinct()
    rows = bank.crossJoin(F.broadcast(agents)).join(verdicts, ["task", "idx", "agent"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("pending")))
    met = rows.join(F.broadcast(level), F.round("frac", 4) >= F.col("tier") - 1e-9)
    verified = F.count_if(F.col("verdict") != "pending")
    false = F.count_if(F.col("verdict") == "gold_correct")
    return met.groupBy("agent", "tier").agg(F.count("*").alias("flagged"), verified.alias("verified"), F.count_if(F.col("verdict") == "pending").alias("pending"), false.alias("false_flags"), F.try_divide(false, verified).alias("false_rate"))


def label_impact(verdicts: DataFrame, suspects: DataFrame) -> DataFrame:
    """Accuracy of each model with and without items of suspect labels, macro over tasks, with ranks and their change."""
    def means(rows: DataFrame, name: str) -> DataFrame:
        cells = majority_cells(rows)
        mean = cells.groupBy("model_id").agg(F.avg("accuracy").alias(name))
        return mean.withColumn(f"{name}_rank", F.row_number().over(Window.orderBy(F.round(name, 9).desc(), "model_id")))  # a row for each model

    kept = verdicts.join(suspects.select("task", "idx").distinct(), ["task", "idx"], "left_anti")
    both = means(verdicts, "baseline").join(means(kept, "filtered"), "model_id")
    return both.withColumn("rank_change", F.col("baseline_rank") - F.col("filtered_rank"))


def cell_deltas(verdicts: DataFrame, suspects: DataFrame, top: int = 15) -> DataFrame:
    """The cells (task, model_id) whose accuracy changes most when items of suspect labels go: baseline, filtered, delta
    in percentage points, items dropped. Cells of which nothing is left have no delta and are not listed."""
    kept = verdicts.join(suspects.select("task", "idx").distinct(), ["task", "idx"], "left_anti")
    of = lambda rows, acc, n: majority_cells(rows).select("task", "model_id", F.col("accuracy").alias(acc), F.col("n").alias(n))
    both = of(verdicts, "baseline", "n").join(of(kept, "filtered", "n_kept"), ["task", "model_id"])
    out = both.select("task", "model_id", "baseline", "filtered", F.round((F.col("filtered") - F.col("baseline")) * 100, 6).alias("delta_pp"), (F.col("n") - F.col("n_kept")).alias("n_dropped"))
    return out.orderBy(F.abs("delta_pp").desc(), "task", "model_id").limit(top)


def representative(flags: DataFrame, parents: DataFrame, per_parent: int = 2) -> DataFrame:
    """The flag of greatest share (then least idx) of each task, for at most so many tasks of a parent."""
    best = Window.partitionBy("task").orderBy(F.col("frac").desc(), "idx")
    within = Window.partitionBy("parent").orderBy(F.col("frac").desc(), "ord")
    first = flags.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n").join(parents, "task")
    return first.withColumn("place", F.row_number().over(within)).where(F.col("place") <= per_parent)
