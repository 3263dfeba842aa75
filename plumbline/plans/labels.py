"""Queries on votes against gold labels, and on agreement and coverage."""

from pyspark.sql import functions as F

from ..operators import agreement, judges, quantiles, votes
from ..sources.folders import new_folder, read_once
from .registry import add

OPTIONS = "SELECT task, idx, gold, pred, count(*) AS k, min(model_id) AS first FROM predictions WHERE pred IS NOT NULL GROUP BY ALL"
VOTED = "SELECT task, idx, gold, arg_max(pred, 1000 * k - first) AS winner, CAST(max(k) AS DOUBLE) AS winner_weight, CAST(sum(k) AS DOUBLE) AS total, max(k) / sum(k) AS fraction, CAST(max(k) AS BIGINT) AS supporters, CAST(sum(k) AS BIGINT) AS voters FROM options GROUP BY ALL"


def golds(t):
    return t.items.select("task", "idx", "gold")


def plain(t):
    return votes.vote(t.predictions, ["task", "idx"])


add(
    "g01_prediction_matrix",
    lambda t: votes.prediction_matrix(t.predictions),
    "SELECT task, idx, min(gold) AS gold, coalesce(string_agg(concat(CAST(model_id AS VARCHAR), '=', pred), ';' ORDER BY model_id) FILTER (WHERE pred IS NOT NULL), '') AS preds, count(pred) AS n_models FROM predictions GROUP BY ALL",
)
add("g02_vote", plain, "SELECT task, idx, winner, winner_weight, total, fraction, supporters, voters FROM voted", options=OPTIONS, voted=VOTED)
add("g03_flags", lambda t: votes.flagged(plain(t), golds(t), 0.5).select("task", "idx", "gold", "winner", "fraction"), "SELECT task, idx, gold, winner, fraction FROM voted WHERE winner <> gold AND fraction >= 0.5", options=OPTIONS, voted=VOTED)
add(
    "g04_threshold_sweep",
    lambda t: votes.sweep(plain(t), golds(t)),
    "SELECT task, count(*) AS n, " + ", ".join(f"count_if(winner <> gold AND fraction >= {x}) AS t{k}" for k, x in enumerate(["0.3", "0.4", "0.5", "0.6", "2 / 3", "0.75", "5 / 6", "0.9", "1.0"])) + " FROM voted GROUP BY ALL",
    options=OPTIONS, voted=VOTED,
)
RANKED = "SELECT task, model_id, acc, row_number() OVER (PARTITION BY task ORDER BY acc DESC, model_id) AS rank, count(*) OVER (PARTITION BY task) AS n_models FROM cells"
add("g05_rank_weights", lambda t: votes.ranks(t.cells).select("task", "model_id", F.col("rank").cast("long").alias("rank"), "linear", "harmonic"), "SELECT task, model_id, rank, (n_models - rank + 1) / n_models AS linear, 1 / rank AS harmonic FROM ranked", ranked=RANKED)
WEIGHTED = "SELECT p.task, p.idx, p.gold, pred, sum(n_models - rank + 1) AS w, min(p.model_id) AS first FROM predictions p JOIN ranked r ON p.task = r.task AND p.model_id = r.model_id WHERE pred IS NOT NULL GROUP BY ALL"
add(
    "g05_weighted_vote",
    lambda t: votes.vote(t.predictions.join(votes.ranks(t.cells).select("task", "model_id", "points"), ["task", "model_id"]), ["task", "idx"], F.col("points")).select("task", "idx", "winner", F.round("fraction", 9).alias("fraction")),
    "SELECT task, idx, arg_max(pred, w * 1000 - first) AS winner, round(max(w) / sum(w), 9) AS fraction FROM weighted GROUP BY ALL",
    ranked=RANKED, weighted=WEIGHTED,
)
TOPK = "SELECT p.task, k, idx, gold, pred, count(*) AS n, min(p.model_id) AS first FROM predictions p JOIN ranked r ON p.task = r.task AND p.model_id = r.model_id JOIN (SELECT unnest(range(1, 11)) AS k) ON rank <= k AND k <= n_models WHERE pred IS NOT NULL GROUP BY ALL"
add(
    "g06_top_k",
    lambda t: votes.top_k(t.predictions, t.cells, golds(t), 0.5),
    "SELECT task, k, count(*) AS n, count_if(winner <> gold AND f >= 0.5) AS flagged FROM (SELECT task, k, idx, gold, arg_max(pred, 1000 * n - first) AS winner, max(n) / sum(n) AS f FROM topk GROUP BY ALL) GROUP BY ALL",
    ranked=RANKED, topk=TOPK,
)
ABLE = "SELECT task, model_id, alpha FROM (SELECT task, model_id, acc, max(acc) OVER (PARTITION BY task) AS best FROM cells), (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS alpha) WHERE acc >= alpha * best"
add(
    "g07_acceptance",
    lambda t: votes.acceptance(t.predictions, t.cells, golds(t), 0.5),
    """SELECT e.task, e.alpha, eligible, CASE WHEN eligible >= 3 THEN coalesce(flagged, 0) END AS flagged FROM (SELECT task, alpha, count(*) AS eligible FROM able GROUP BY ALL) e LEFT JOIN (
       SELECT task, alpha, count_if(winner <> gold AND f >= 0.5) AS flagged FROM (SELECT task, alpha, idx, gold, arg_max(pred, 1000 * n - first) AS winner, max(n) / sum(n) AS f FROM (
         SELECT p.task, alpha, idx, gold, pred, count(*) AS n, min(p.model_id) AS first FROM predictions p JOIN able a ON p.task = a.task AND p.model_id = a.model_id WHERE pred IS NOT NULL GROUP BY ALL) GROUP BY ALL) GROUP BY ALL) v ON e.task = v.task AND e.alpha = v.alpha""",
    able=ABLE,
)
SWEPT = "SELECT task, x AS level, count_if(winner <> gold AND fraction >= x) AS flagged FROM voted, (SELECT unnest([0.3, 0.4, 0.5, 0.6, 2 / 3, 0.75, 5 / 6, 0.9, 1.0]::DOUBLE[]) AS x) GROUP BY ALL"
BESTK = "SELECT task, k, count_if(winner <> gold AND f >= 0.5) AS flagged FROM (SELECT task, k, idx, gold, arg_max(pred, 1000 * n - first) AS winner, max(n) / sum(n) AS f FROM topk GROUP BY ALL) GROUP BY ALL"
ACCEPTED = "SELECT e.task, e.alpha, CASE WHEN eligible >= 3 THEN coalesce(flagged, 0) END AS flagged FROM (SELECT task, alpha, count(*) AS eligible FROM able GROUP BY ALL) e LEFT JOIN bestk b ON b.task = e.task AND b.k = e.eligible"
LEVELS = "SELECT 'threshold' AS kind, level, task, flagged FROM swept UNION ALL SELECT 'k', CAST(k AS DOUBLE), task, flagged FROM bestk UNION ALL SELECT 'alpha', alpha, task, flagged FROM accepted"
add(
    "k17_flag_rates_by_level",
    lambda t: votes.flag_rates(t.predictions, t.cells, golds(t)).withColumn("level", F.round("level", 6)),
    "SELECT kind, round(level, 6) AS level, task, flagged, n, flagged / n AS rate FROM (SELECT * FROM levels JOIN sizes USING (task) UNION ALL BY NAME SELECT 'ALL' AS task, kind, level, CAST(sum(flagged) AS BIGINT) AS flagged, CAST(sum(n) AS BIGINT) AS n FROM levels JOIN sizes USING (task) WHERE flagged IS NOT NULL GROUP BY kind, level)",
    options=OPTIONS, voted=VOTED, ranked=RANKED, topk=TOPK, able=ABLE, swept=SWEPT, bestk=BESTK, accepted=ACCEPTED, levels=LEVELS, sizes="SELECT task, count(*) AS n FROM voted GROUP BY ALL",
)
add(
    "g08_fixed_set_vote",
    lambda t: votes.vote(t.predictions.where("model_id < 6"), ["task", "idx"]).join(golds(t), ["task", "idx"]).where("winner <> gold").groupBy("task").agg(*[F.count_if(F.col("supporters") >= k).alias(f"of{k}") for k in range(1, 7)]),
    "SELECT task, " + ", ".join(f"count_if(k >= {k}) AS of{k}" for k in range(1, 7)) + " FROM (SELECT task, idx, gold, arg_max(pred, 1000 * k - first) AS winner, max(k) AS k FROM (SELECT task, idx, gold, pred, count(*) AS k, min(model_id) AS first FROM predictions WHERE pred IS NOT NULL AND model_id < 6 GROUP BY ALL) GROUP BY ALL) WHERE winner <> gold GROUP BY ALL",
)
TIER = "CASE " + " ".join(f"WHEN round(fraction, 4) >= {x} - 1e-9 THEN CAST({x} AS DOUBLE)" for x in ["1.0", "0.9", "5 / 6", "0.75", "2 / 3", "0.6", "0.5", "0.4", "0.3"]) + " END"
add("g09_verification_bank", lambda t: votes.verification_bank(plain(t), golds(t)), f"SELECT task, idx, gold, winner, round(fraction, 4) AS fraction, {TIER} AS tier FROM voted WHERE winner <> gold AND fraction >= 0.5", options=OPTIONS, voted=VOTED)
add(
    "g10_false_flags",
    lambda t: votes.tiers_reached(t.flagged, t.verifications),
    """SELECT agent, tier, count(*) AS flagged, count(verdict) AS verified, count(*) - count(verdict) AS pending, count_if(verdict = 'gold_correct') AS false_flags, count_if(verdict = 'gold_correct') / nullif(count(verdict), 0) AS false_rate
       FROM (SELECT f.task, f.idx, f.frac, a.agent, v.verdict FROM flagged f CROSS JOIN (SELECT DISTINCT agent FROM verifications) a LEFT JOIN verifications v ON v.task = f.task AND v.idx = f.idx AND v.agent = a.agent) JOIN tiers ON round(frac, 4) >= tier - 1e-9 GROUP BY ALL""",
    tiers="SELECT unnest([0.3, 0.4, 0.5, 0.6, 2 / 3, 0.75, 5 / 6, 0.9, 1.0]::DOUBLE[]) AS tier",
)
ITEMS = "SELECT task, model_id, idx, 2 * count_if(is_correct) > count(*) AS ok FROM verdicts WHERE NOT skipped GROUP BY ALL"
MEANS = "SELECT *, row_number() OVER (ORDER BY round({0}, 9) DESC, model_id) AS {0}_rank FROM (SELECT model_id, avg(acc) AS {0} FROM (SELECT model_id, task, avg(CAST(ok AS INT)) AS acc FROM items_ i {1} GROUP BY ALL) GROUP BY ALL)"
add(
    "g11_label_impact",
    lambda t: votes.label_impact(t.verdicts, t.flagged).select("model_id", "baseline", F.col("baseline_rank").cast("long").alias("baseline_rank"), "filtered", F.col("filtered_rank").cast("long").alias("filtered_rank"), F.col("rank_change").cast("long").alias("rank_change")),
    "SELECT model_id, baseline, baseline_rank, filtered, filtered_rank, baseline_rank - filtered_rank AS rank_change FROM base JOIN filt USING (model_id)",
    items_=ITEMS, base=MEANS.format("baseline", ""), filt=MEANS.format("filtered", "WHERE NOT EXISTS (SELECT 1 FROM flagged f WHERE f.task = i.task AND f.idx = i.idx)"),
)
add(
    "g11_cell_deltas",
    lambda t: votes.cell_deltas(t.verdicts, t.flagged),
    """SELECT b.task, b.model_id, b.acc AS baseline, f.acc AS filtered, round((f.acc - b.acc) * 100, 6) AS delta_pp, b.n - f.n AS n_dropped FROM cell_base b JOIN cell_filt f USING (task, model_id)
       ORDER BY abs(round((f.acc - b.acc) * 100, 6)) DESC, b.task, b.model_id LIMIT 15""",
    items_=ITEMS, cell_base="SELECT task, model_id, count(*) AS n, avg(CAST(ok AS INT)) AS acc FROM items_ GROUP BY ALL",
    cell_filt="SELECT task, model_id, count(*) AS n, avg(CAST(ok AS INT)) AS acc FROM items_ i WHERE NOT EXISTS (SELECT 1 FROM flagged f WHERE f.task = i.task AND f.idx = i.idx) GROUP BY ALL",
)
add(
    "g12_examples",
    lambda t: votes.representative(t.flagged, t.task_dim.select("task", "parent", "ord")).select("task", "parent", "idx", "frac", F.col("place").cast("long").alias("place")),
    "SELECT * FROM (SELECT task, parent, idx, frac, row_number() OVER (PARTITION BY parent ORDER BY frac DESC, ord) AS place FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY frac DESC, idx) AS n FROM flagged) JOIN task_dim USING (task) WHERE n = 1) WHERE place <= 2",
)

# agreement
PAIRS = "SELECT a.task, a.model_id, a.is_correct AS a, b.is_correct AS b FROM verdicts a JOIN verdicts b ON a.task = b.task AND a.model_id = b.model_id AND a.idx = b.idx AND a.judge = 'def' AND b.judge = 'v1' AND NOT a.skipped AND NOT b.skipped"
add(
    "k01_label_kappa",
    lambda t: t.labels.agg(*[c.alias(n) for c, n in zip(agreement.kappa(F.col("quality") == 1, F.col("toxic") == 0), ("n", "agreement", "kappa", "only_first", "only_second"), strict=True)]),
    "SELECT n, agreement, (agreement - pe) / (1 - pe) AS kappa, only_first, only_second FROM (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM (SELECT count(*) AS n, avg(CAST((quality = 1) = (toxic = 0) AS INT)) AS agreement, avg(quality) AS pa, avg(1 - toxic) AS pb, count_if(quality = 1 AND toxic = 1) AS only_first, count_if(quality = 0 AND toxic = 0) AS only_second FROM labels))",
)
KAPPA = """SELECT {keys}, n, po, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END AS kappa FROM (SELECT {keys}, count(*) AS n, avg(CAST(la = lb AS INT)) AS po,
  (count_if(la = 'K') * count_if(lb = 'K') + count_if(la = 'A') * count_if(lb = 'A')) / (count(*) * count(*)) AS pe FROM rated GROUP BY ALL)"""
RATED = "SELECT a.rater AS first, b.rater AS second, a.task, a.class AS la, b.class AS lb FROM ka_verdicts a JOIN ka_verdicts b ON a.task = b.task AND a.idx = b.idx AND a.rater < b.rater"
add("k02_categorical_kappa", lambda t: agreement.categorical_kappa(t.ka_verdicts.where("rater = 'r0'").select("task", "idx", F.col("class").alias("la")).join(t.ka_verdicts.where("rater = 'r1'").select("task", "idx", F.col("class").alias("lb")), ["task", "idx"]), ["task"], "la", "lb"), KAPPA.format(keys="task").replace("FROM rated", "FROM rated WHERE first = 'r0' AND second = 'r1'"), rated=RATED)
add("k03_rater_pairs", lambda t: agreement.rater_pairs(t.ka_verdicts), KAPPA.format(keys="first, second"), rated=RATED)
COUNTS = "SELECT task, idx, count(*) AS n, count_if(class = 'K') AS k, count_if(class = 'A') AS a, arg_min(class, rater) AS first_class FROM ka_verdicts GROUP BY ALL"
add("k04_fleiss", lambda t: agreement.fleiss(t.ka_verdicts), "SELECT items, po, pe, (po - pe) / (1 - pe) AS kappa FROM (SELECT count(*) AS items, avg((k * k + a * a - n) / (n * (n - 1))) AS po, avg(k / n) * avg(k / n) + avg(a / n) * avg(a / n) AS pe FROM counts_ WHERE n >= 2)", counts_=COUNTS)
MAJORITY = "SELECT task, idx, k, a, CASE WHEN k >= 3 THEN 'K' WHEN a >= 3 THEN 'A' WHEN k = 2 AND a = 2 THEN 'ambiguous' WHEN k > a THEN 'K' WHEN a > k THEN 'A' ELSE first_class END AS label FROM counts_"
add("k05_majority_class", lambda t: agreement.majority_class(t.ka_verdicts), "SELECT * FROM majority", counts_=COUNTS, majority=MAJORITY)
add(
    "k06_composition",
    lambda t: agreement.composition(t.ka_verdicts.where("task <> 'src3'"), t.task_dim.select("task", "parent")),
    "SELECT coalesce(parent, 'ALL') AS parent, coalesce(d.task, 'ALL') AS task, count(label) AS n, count_if(label = 'K') AS k, count_if(label = 'A') AS a, count_if(label = 'ambiguous') AS ambiguous, count_if(label = 'K') / nullif(count(label), 0) AS k_share FROM task_dim d LEFT JOIN (SELECT * FROM majority WHERE task <> 'src3') m ON d.task = m.task GROUP BY ROLLUP (parent, d.task)",
    counts_=COUNTS, majority=MAJORITY,
)
add("k07_agreement_rollups", lambda t: agreement.agreement_rollups(t.verdicts, "def", "v1"), "SELECT coalesce(task, 'ALL') AS task, coalesce(model, 'ALL') AS model, count(*) AS n, avg(CAST(a = b AS INT)) AS agreement FROM (SELECT *, CAST(model_id AS VARCHAR) AS model FROM pairs_) GROUP BY GROUPING SETS ((task), (model), ())", pairs_=PAIRS)
add("k07_lowest_cells", lambda t: agreement.two_judges(t.verdicts, "def", "v1", ["task", "model_id"]).select("task", "model_id", F.round("agreement", 9).alias("agreement")).orderBy("agreement", "task", "model_id").limit(20), "SELECT task, model_id, round(avg(CAST(a = b AS INT)), 9) AS agreement FROM pairs_ GROUP BY ALL ORDER BY agreement, task, model_id LIMIT 20", pairs_=PAIRS)
add("k08_parent_means", lambda t: t.cells.join(F.broadcast(t.task_dim), "task").rollup("parent").agg(F.count("*").alias("cells"), F.avg("acc").alias("accuracy")).withColumn("parent", F.coalesce("parent", F.lit("ALL"))), "SELECT coalesce(parent, 'ALL') AS parent, count(*) AS cells, avg(acc) AS accuracy FROM cells JOIN task_dim USING (task) GROUP BY ROLLUP (parent)")
BYJUDGE = "SELECT *, row_number() OVER (ORDER BY round(acc, 9) DESC, model_id) AS r FROM (SELECT model_id, avg(CAST(is_correct AS INT)) AS acc FROM verdicts WHERE NOT skipped AND judge = '{0}' GROUP BY ALL)"


def by_judge(t, judge):
    return t.verdicts.where(f"not skipped and judge = '{judge}'").groupBy("model_id").agg(F.avg(F.col("is_correct").cast("int")).alias("acc"))


add(
    "k09_rank_shift",
    lambda t: agreement.rank_shift(by_judge(t, "def"), by_judge(t, "v2")).select("model_id", "first", F.col("first_rank").cast("long").alias("first_rank"), "second", F.col("second_rank").cast("long").alias("second_rank"), F.col("shift").cast("long").alias("shift"), "delta_pp"),
    "SELECT model_id, a.acc AS first, a.r AS first_rank, b.acc AS second, b.r AS second_rank, a.r - b.r AS shift, (b.acc - a.acc) * 100 AS delta_pp FROM one a JOIN two b USING (model_id)",
    one=BYJUDGE.format("def"), two=BYJUDGE.format("v2"),
)
add(
    "k10_cluster_contrast",
    lambda t: agreement.cluster_contrast(t.cells, F.col("model_id") < 3),
    "SELECT *, mean_in - mean_out AS difference, mean_in / nullif(mean_out, 0) AS ratio, abs(mean_in - mean_out) > 0.15 AS suspect FROM (SELECT task, avg(acc) FILTER (WHERE model_id < 3) AS mean_in, avg(acc) FILTER (WHERE model_id >= 3) AS mean_out, stddev_pop(acc) FILTER (WHERE model_id < 3) AS sd_in, stddev_pop(acc) FILTER (WHERE model_id >= 3) AS sd_out FROM cells GROUP BY ALL)",
)
add(
    "k11_ceilings",
    lambda t: agreement.ceilings(t.cells, 0.75),
    "SELECT *, CASE WHEN at_ceiling * 2 >= models THEN 'saturated' WHEN at_ceiling > 0 THEN 'partial' ELSE 'none' END AS verdict FROM (SELECT task, count(*) AS models, count_if(acc >= 0.75) AS at_ceiling, avg(acc) FILTER (WHERE acc >= 0.75) AS mean, stddev_pop(acc) FILTER (WHERE acc >= 0.75) AS sd FROM cells GROUP BY ALL)",
)
add(
    "k12_token_budgets",
    lambda t: agreement.token_budgets(t.documents.withColumn("tokens", F.floor(F.col("n_chars") / 4)), ["source"], "tokens", 4096),
    "SELECT source, n, mean, p[1] AS p50, p[2] AS p90, p[3] AS p95, p[4] AS p99, truncated, CAST(least(pow(2, ceil(log2(greatest(p[4] * 1.5, 1)))), 4096) AS BIGINT) AS budget FROM (SELECT source, count(*) AS n, avg(n_chars // 4) AS mean, quantile_cont(n_chars // 4, [0.5, 0.9, 0.95, 0.99]) AS p, avg(CAST(n_chars // 4 >= 4096 AS INT)) AS truncated FROM documents GROUP BY ALL)",
)


def delivered_budgets(t):
    """Token counts of the documents, which come in three deliveries; each one's sketches are kept, and merged at the end."""
    folder = new_folder(t.spark, "sketches")
    rows = t.documents.select("source", F.floor(F.col("n_chars") / 4).alias("tokens"), (F.col("doc_id") % 3).alias("delivery"))
    for d in range(3):
        quantiles.keep(quantiles.sketches(rows.where(F.col("delivery") == d), ["source"], "tokens", 4096), folder, str(d))
    return read_once(quantiles.budgets(quantiles.kept(t.spark, folder), ["source"], 4096), folder)


add(
    "k12_merged_sketches",
    delivered_budgets,
    "SELECT source, n, mean, p[1] AS p50, p[2] AS p90, p[3] AS p95, p[4] AS p99, truncated, CAST(least(pow(2, ceil(log2(greatest(p[4] * 1.5, 1)))), 4096) AS BIGINT) AS budget FROM (SELECT source, count(*) AS n, avg(n_chars // 4) AS mean, quantile_disc(n_chars // 4, [0.5, 0.9, 0.95, 0.99]) AS p, avg(CAST(n_chars // 4 >= 4096 AS INT)) AS truncated FROM documents GROUP BY ALL)",
)
add("k13_top_categories", lambda t: t.events.groupBy("event_type").count().withColumnRenamed("count", "n").orderBy(F.col("n").desc(), "event_type").limit(10), "SELECT event_type, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, event_type LIMIT 10")
add(
    "k14_mode_pivot",
    lambda t: t.verdicts.where("not skipped").groupBy("model_id").pivot("judge", ["def", "v1", "v2"]).agg(F.avg(F.col("is_correct").cast("int"))).withColumn("gain", F.col("v2") - F.col("def")),
    "SELECT model_id, def, v1, v2, v2 - def AS gain FROM (SELECT model_id, " + ", ".join(f"avg(CAST(is_correct AS INT)) FILTER (WHERE judge = '{j}') AS {j}" for j in ("def", "v1", "v2")) + " FROM verdicts WHERE NOT skipped GROUP BY ALL)",
)
MODES = "SELECT task, model_id, zero_shot * 100 AS zero_shot, few_shot * 100 AS few_shot, cot * 100 AS cot, (cot - zero_shot) * 100 AS delta FROM (SELECT task, model_id, " + ", ".join(f"avg(CAST(correct AS INT)) FILTER (WHERE mode = '{m}') AS {m}" for m in ("zero_shot", "few_shot", "cot")) + " FROM mode_runs GROUP BY ALL) WHERE zero_shot IS NOT NULL AND few_shot IS NOT NULL AND cot IS NOT NULL"
add("k14_prompt_modes", lambda t: judges.mode_pivot(t.mode_runs), "SELECT * FROM modes_", modes_=MODES)
add(
    "k14_mode_effects",
    lambda t: judges.mode_effects(judges.mode_pivot(t.mode_runs)),
    "SELECT model_id, count(*) AS tasks, avg(zero_shot) AS zero_shot, avg(few_shot) AS few_shot, avg(cot) AS cot, round(avg(delta), 9) + 0.0 AS mean_delta, count_if(round(delta, 9) > 0) AS gained, count_if(round(delta, 9) < 0) AS lost, arg_min(task, {'d': -round(delta, 9), 't': task}) AS gains_most FROM modes_ GROUP BY ALL",
    modes_=MODES,
)
add("k15_run_consistency", lambda t: t.verdicts.where("not skipped").groupBy("task", "model_id", "judge").agg(F.round(F.avg(F.col("is_correct").cast("int")), 2).alias("acc")).groupBy("task", "model_id").agg((F.countDistinct("acc") == 1).alias("consistent")), "SELECT task, model_id, count(DISTINCT acc) = 1 AS consistent FROM (SELECT task, model_id, judge, round(avg(CAST(is_correct AS INT)), 2) AS acc FROM verdicts WHERE NOT skipped GROUP BY ALL) GROUP BY ALL")
add("k16_comparable_means", lambda t: t.cells.join(t.task_dim.where("task_type not in ('vsp', 'ids')"), "task", "left_semi").groupBy("model_id").agg(F.count("*").alias("tasks"), F.avg("acc").alias("accuracy")), "SELECT model_id, count(*) AS tasks, avg(acc) AS accuracy FROM cells WHERE task IN (SELECT task FROM task_dim WHERE task_type NOT IN ('vsp', 'ids')) GROUP BY ALL")
add(
    "k17_flag_rates",
    lambda t: votes.sweep(plain(t), golds(t)).rollup("task").agg(F.sum("n").alias("n"), *[(F.sum(f"t{k}") / F.sum("n")).alias(f"rate{k}") for k in range(9)]).withColumn("task", F.coalesce("task", F.lit("ALL"))),
    "SELECT coalesce(task, 'ALL') AS task, count(*) AS n, " + ", ".join(f"count_if(winner <> gold AND fraction >= {x}) / count(*) AS rate{k}" for k, x in enumerate(["0.3", "0.4", "0.5", "0.6", "2 / 3", "0.75", "5 / 6", "0.9", "1.0"])) + " FROM voted GROUP BY ROLLUP (task)",
    options=OPTIONS, voted=VOTED,
)
