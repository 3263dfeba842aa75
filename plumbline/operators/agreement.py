"""Agreement of judges and raters, coverage and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_available(verdicts: DataFrame, order: DataFrame, keys: Sequence[str] = ("task", "model_id")) -> DataFrame:
    """Verdicts of the first judge, by order (judge, jn), that each cell has."""
    known = verdicts.join(F.broadcast(order), "judge")  # a row for each judge
    first = known.groupBy(*keys).agg(F.min("jn").alias("jn"))
    return known.join(first, [*keys, "jn"], "left_semi").drop("jn")


def last_of(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The last row of each key."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), position).alias("_row")).select(*keys, "_row.*")


def kappa(a: Column, b: Column) -> tuple[Column, ...]:
    """Of two boolean columns, as aggregates: n, agreement, Cohen's kappa (null if one class is all), both one-sided
    disagreements."""
    n, both, only_a, only_b = F.count("*"), F.count_if(a & b), F.count_if(a & ~b), F.count_if(~a & b)
    agree = (n - only_a - only_b) / n
    pa, pb = (both + only_a) / n, (both + only_b) / n
    chance = pa * pb + (1 - pa) * (1 - pb)
    return n, agree, F.try_divide(agree - chance, F.when(F.abs(1 - chance) > 1e-12, 1 - chance)), only_a, only_b


def two_judges(verdicts: DataFrame, one: str, other: str, keys: Sequence[str]) -> DataFrame:
    """n, agreement, kappa and one-sided disagreements of two judges on the items that both judged."""
    of = lambda judge, name: verdicts.where((F.col("judge") == judge) & ~F.col("skipped")).select("task", "model_id", "idx", F.col("is_correct").alias(name))
    both = of(one, "a").join(of(other, "b"), ["task", "model_id", "idx"])
    n, agree, k, only_a, only_b = kappa(F.col("a"), F.col("b"))
    return both.groupBy(*keys).agg(n.alias("n"), agree.alias("agreement"), k.alias("kappa"), only_a.alias("only_first"), only_b.alias("only_second"))


def all_judges(verdicts: DataFrame, k: int) -> DataFrame:
    """On items that k judges judged: n, unanimous ones and the pairwise disagreements, per task and over all."""
    kept = verdicts.where(~F.col("skipped"))
    items = kept.groupBy("task", "model_id", "idx").agg(F.countDistinct("judge").alias("k"), F.sort_array(F.collect_list(F.struct("judge", "is_correct"))).alias("said")).where(F.col("k") == k)
    yes = F.size(F.filter("said", lambda s: s["is_correct"]))
    return items.select("task", yes.alias("yes")).rollup("task").agg(F.count("*").alias("n"), F.count_if(F.col("yes").isin(0, k)).alias("unanimous"), F.sum(F.col("yes") * (k - F.col("yes"))).alias("pair_disagreements")).withColumn("task", F.coalesce("task", F.lit("ALL")))


def judge_pairs(verdicts: DataFrame, k: int) -> DataFrame:
    """Disagreements of each pair of judges on the items that all k judged."""
    kept = verdicts.where(~F.col("skipped"))
    whole = kept.groupBy("task", "model_id", "idx").agg(F.countDistinct("judge").alias("_k")).where(F.col("_k") == k).drop("_k")
    rows = kept.join(whole, ["task", "model_id", "idx"], "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col("a.task") == F.col("b.task")) & (F.col("a.model_id") == F.col("b.model_id")) & (F.col("a.idx") == F.col("b.idx")) & (F.col("a.judge") < F.col("b.judge"))
    return a.join(b, same).groupBy(F.col("a.judge").alias("first"), F.col("b.judge").alias("second")).agg(F.count("*").alias("n"), F.count_if(F.col("a.is_correct") != F.col("b.is_correct")).alias("differ"))


def disagreement_samples(verdicts: DataFrame, one: str, other: str, limit: int = 25) -> DataFrame:
    """The first items of each cell on which two judges differ, with both sides."""
    of = lambda judge, name: verdicts.where((F.col("judge") == judge) & ~F.col("skipped")).select("task", "model_id", "idx", F.col("is_correct").alias(name))
    rows = of(one, "first").join(of(other, "second"), ["task", "model_id", "idx"]).where("first <> second")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("task", "model_id").orderBy("idx"))).where(F.col("place") <= limit)


def outlying_cells(verdicts: DataFrame, least: float = 0.05, top: int = 20) -> DataFrame:
    """Cells whose accuracy by one judge is farthest from the mean of the others'."""
    acc = verdicts.where(~F.col("skipped")).groupBy("task", "model_id", "judge").agg(F.avg(F.col("is_correct").cast("int")).alias("acc"))
    by = Window.partitionBy("task", "model_id")
    others = F.try_divide(F.sum("acc").over(by) - F.col("acc"), F.count("*").over(by) - 1)
    gaps = acc.withColumn("gap", F.round(F.abs(F.col("acc") - others), 9)).where(F.col("gap") >= least)
    return gaps.orderBy(F.col("gap").desc(), "task", "model_id", "judge").limit(top)


def confusion(verdicts: DataFrame, one: str, other: str, classes: Sequence[str]) -> DataFrame:
    """Counts of one agent's verdicts (rows) by the other's (columns), with row totals."""
    of = lambda agent, name: verdicts.where(F.col("agent") == agent).select("task", "idx", F.col("verdict").alias(name))
    both = of(one, "first").join(of(other, "second"), ["task", "idx"])
    return both.groupBy("first").agg(*[F.count_if(F.col("second") == c).alias(c) for c in classes], F.count("*").alias("total"))


def categorical_kappa(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Cohen's kappa of two label columns over any classes; null if chance agreement is complete."""
    cells = pairs.groupBy(*keys, a, b).agg(F.count("*").alias("k"))
    by = Window.partitionBy(*keys)
    cells = cells.withColumn("n", F.sum("k").over(by)).withColumn("ra", F.sum("k").over(Window.partitionBy(*keys, a))).withColumn("rb", F.sum("k").over(Window.partitionBy(*keys, b)))
    out = cells.groupBy(*keys).agg(F.first("n").alias("n"), (F.sum(F.when(F.col(a) == F.col(b), F.col("k")).otherwise(0)) / F.first("n")).alias("po"), F.sum(F.when(F.col(a) == F.col(b), F.col("ra") * F.col("rb") / F.col("n") / F.col("n")).otherwise(0.0)).alias("pe"))
    # a class that one side never has adds nothing to chance; classes without a diagonal cell are added from the margins
    margins_a = pairs.groupBy(*keys, F.col(a).alias("_c")).agg(F.count("*").alias("_a"))
    margins_b = pairs.groupBy(*keys, F.col(b).alias("_c")).agg(F.count("*").alias("_b"))
    chance = margins_a.join(margins_b, [*keys, "_c"]).groupBy(*keys).agg(F.sum(F.col("_a") * F.col("_b")).alias("_s"))
    out = out.drop("pe").join(chance, list(keys), "left").withColumn("pe", F.coalesce("_s", F.lit(0)) / (F.col("n") * F.col("n")))
    return out.select(*keys, "n", "po", F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def rater_pairs(labels: DataFrame) -> DataFrame:
    """Cohen's kappa of each pair of raters on the items that both labelled."""
    a, b = labels.alias("a"), labels.alias("b")
    both = a.join(b, (F.col("a.task") == F.col("b.task")) & (F.col("a.idx") == F.col("b.idx")) & (F.col("a.rater") < F.col("b.rater")))
    return categorical_kappa(both.select(F.col("a.rater").alias("first"), F.col("b.rater").alias("second"), F.col("a.class").alias("la"), F.col("b.class").alias("lb")), ["first", "second"], "la", "lb")


def fleiss(labels: DataFrame, classes: Sequence[str] = ("K", "A")) -> DataFrame:
    """Fleiss' kappa for varying numbers of raters. Items with one label go; a class's prior is the mean of the items'
    own shares of it."""
    counts = [F.count_if(F.col("class") == c).alias(f"c{i}") for i, c in enumerate(classes)]
    items = labels.groupBy("task", "idx").agg(F.count("*").alias("n"), *counts).where("n >= 2")
    squares = sum(F.col(f"c{i}") * F.col(f"c{i}") for i in range(len(classes)))
    shares = [F.avg(F.col(f"c{i}") / F.col("n")).alias(f"p{i}") for i in range(len(classes))]
    out = items.agg(F.count("*").alias("items"), F.avg((squares - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("po"), *shares)
    pe = sum(F.col(f"p{i}") * F.col(f"p{i}") for i in range(len(classes)))
    return out.select("items", "po", pe.alias("pe"), F.try_divide(F.col("po") - pe, 1 - pe).alias("kappa"))


def majority_class(labels: DataFrame, order: str = "rater") -> DataFrame:
    """K, A or ambiguous for each item: three votes decide, 2-2 is ambiguous, else the plurality; 1-1 goes to the
    first rater."""
    k, a = F.count_if(F.col("class") == "K"), F.count_if(F.col("class") == "A")
    decided = F.when(k >= 3, "K").when(a >= 3, "A").when((k == 2) & (a == 2), "ambiguous").when(k > a, "K").when(a > k, "A").otherwise(F.min_by("class", order))
    return labels.groupBy("task", "idx").agg(k.alias("k"), a.alias("a"), decided.alias("label"))


def composition(labels: DataFrame, tasks: DataFrame) -> DataFrame:
    """Counts of each majority class per task and per parent, with a row for tasks without labels."""
    rows = tasks.join(majority_class(labels), "task", "left")
    counts = [F.count_if(F.col("label") == c).alias(c.lower()) for c in ("K", "A", "ambiguous")]
    out = rows.rollup("parent", "task").agg(F.count("label").alias("n"), *counts)
    return out.withColumn("task", F.coalesce("task", F.lit("ALL"))).withColumn("parent", F.coalesce("parent", F.lit("ALL"))).withColumn("k_share", F.try_divide("k", "n"))


def agreement_rollups(verdicts: DataFrame, one: str, other: str) -> DataFrame:
    """Agreement of two judges per task, per model and overall, over items, in one pass."""
    of = lambda judge, name: verdicts.where((F.col("judge") == judge) & ~F.col("skipped")).select("task", "model_id", "idx", F.col("is_correct").alias(name))
    both = of(one, "a").join(of(other, "b"), ["task", "model_id", "idx"]).withColumn("model", F.col("model_id").cast("string"))
    out = both.groupingSets([["task"], ["model"], []], "task", "model").agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("int")).alias("agreement"))
    return out.select(F.coalesce("task", F.lit("ALL")).alias("task"), F.coalesce("model", F.lit("ALL")).alias("model"), "n", "agreement")


def rank_shift(one: DataFrame, other: DataFrame, value: str = "acc") -> DataFrame:
    """Ranks of models under two protocols, the shift, and the difference in percentage points."""
    place = Window.orderBy(F.round(value, 9).desc(), "model_id")  # a row for each model
    a = one.select("model_id", F.col(value).alias("first"), F.row_number().over(place).alias("first_rank"))
    b = other.select("model_id", F.col(value).alias("second"), F.row_number().over(place).alias("second_rank"))
    return a.join(b, "model_id").withColumn("shift", F.col("first_rank") - F.col("second_rank")).withColumn("delta_pp", (F.col("second") - F.col("first")) * 100)


def token_budgets(responses: DataFrame, keys: Sequence[str], tokens: str, ceiling: int, exact: bool = True) -> DataFrame:
    """Mean and quantiles of token counts, the share at the ceiling, and a budget: the next power of two of one and a
    half times the 99th percentile, within the ceiling."""
    quantiles = F.percentile if exact else F.percentile_approx
    p = quantiles(tokens, F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)]))
    out = responses.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(tokens).alias("mean"), p.alias("p"), F.avg((F.col(tokens) >= ceiling).cast("int")).alias("truncated"))
    budget = F.least(F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("p")[3] * 1.5, F.lit(1.0))))), F.lit(float(ceiling))).cast("long")
    return out.select(*keys, "n", "mean", *[F.col("p")[i].alias(name) for i, name in enumerate(("p50", "p90", "p95", "p99"))], "truncated", budget.alias("budget"))


def cluster_contrast(cells: DataFrame, inside: Column, flag: float = 0.15) -> DataFrame:
    """Per task: mean and population deviation of accuracies inside and outside a cluster, difference, ratio, flag."""
    a, b = F.when(inside, F.col("acc")), F.when(~inside, F.col("acc"))
    out = cells.groupBy("task").agg(F.avg(a).alias("mean_in"), F.avg(b).alias("mean_out"), F.stddev_pop(a).alias("sd_in"), F.stddev_pop(b).alias("sd_out"))
    gap = F.col("mean_in") - F.col("mean_out")
    return out.withColumn("difference", gap).withColumn("ratio", F.try_divide("mean_in", "mean_out")).withColumn("suspect", F.abs(gap) > flag)


def ceilings(cells: DataFrame, level: float = 0.9) -> DataFrame:
    """Cells at a ceiling per task: count, mean and deviation, and a verdict by count."""
    high = F.when(F.col("acc") >= level, F.col("acc"))
    out = cells.groupBy("task").agg(F.count("*").alias("models"), F.count(high).alias("at_ceiling"), F.avg(high).alias("mean"), F.stddev_pop(high).alias("sd"))
    return out.withColumn("verdict", F.when(F.col("at_ceiling") * 2 >= F.col("models"), "saturated").when(F.col("at_ceiling") > 0, "partial").otherwise("none"))
