"""Queries on scores and on judges: accuracy, deviations, set metrics, summaries, joins of judges."""

from pyspark.sql import functions as F

from ..functions import cvss, extract
from ..operators import agreement, judges, reverdict, scores, votes
from .registry import add

KEPT = "SELECT task, model_id, idx, judge, is_correct FROM verdicts WHERE NOT skipped"
ITEMS = "SELECT task, model_id, idx, sum(CASE WHEN is_correct THEN 1 ELSE 0 END) AS yes, count(*) AS votes, count(DISTINCT judge) AS k FROM verdicts WHERE NOT skipped GROUP BY ALL"

add(
    "j01_majority_accuracy",
    lambda t: votes.majority_cells(t.verdicts),
    "SELECT i.task, i.model_id, count(*) AS n, count_if(2 * yes > votes) AS correct, count_if(2 * yes > votes) / count(*) AS accuracy, any_value(source) AS source FROM items_ i "
    "JOIN (SELECT task, model_id, string_agg(DISTINCT judge, '+' ORDER BY judge) AS source FROM kept GROUP BY ALL) s ON i.task = s.task AND i.model_id = s.model_id GROUP BY ALL",
    kept=KEPT, items_=ITEMS,
)
add(
    "j02_binary_correctness",
    lambda t: t.sql("SELECT task, model_id, idx, judge, CASE WHEN idx % 3 = 0 THEN is_correct END AS is_correct, CASE WHEN idx % 3 = 1 THEN is_correct END AS exact_match, CASE WHEN idx % 3 = 2 THEN CASE WHEN is_correct THEN 0.0 ELSE 1.5 END END AS mad FROM verdicts").select("task", "model_id", "idx", "judge", F.coalesce("is_correct", "exact_match", F.col("mad") == 0).alias("correct")),
    "SELECT task, model_id, idx, judge, is_correct AS correct FROM verdicts",
)
add(
    "j03_two_judges",
    lambda t: agreement.two_judges(t.verdicts, "def", "v1", ["task", "model_id"]),
    """SELECT task, model_id, n, agreement, CASE WHEN abs(1 - pe) > 1e-12 THEN (agreement - pe) / (1 - pe) END AS kappa, only_first, only_second FROM (
       SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM (
         SELECT a.task, a.model_id, count(*) AS n, count_if(a.is_correct = b.is_correct) / count(*) AS agreement, count_if(a.is_correct) / count(*) AS pa, count_if(b.is_correct) / count(*) AS pb,
           count_if(a.is_correct AND NOT b.is_correct) AS only_first, count_if(b.is_correct AND NOT a.is_correct) AS only_second
         FROM kept a JOIN kept b ON a.task = b.task AND a.model_id = b.model_id AND a.idx = b.idx AND a.judge = 'def' AND b.judge = 'v1' GROUP BY ALL))""",
    kept=KEPT,
)
add(
    "j04_all_judges",
    lambda t: agreement.all_judges(t.verdicts, 3),
    "SELECT coalesce(task, 'ALL') AS task, count(*) AS n, count_if(yes IN (0, 3)) AS unanimous, CAST(sum(yes * (3 - yes)) AS BIGINT) AS pair_disagreements FROM items_ WHERE k = 3 GROUP BY ROLLUP (task)",
    items_=ITEMS,
)
add(
    "j04_judge_pairs",
    lambda t: agreement.judge_pairs(t.verdicts, 3),
    "SELECT a.judge AS first, b.judge AS second, count(*) AS n, count_if(a.is_correct <> b.is_correct) AS differ FROM kept a JOIN kept b ON a.task = b.task AND a.model_id = b.model_id AND a.idx = b.idx AND a.judge < b.judge "
    "JOIN items_ i ON a.task = i.task AND a.model_id = i.model_id AND a.idx = i.idx AND i.k = 3 GROUP BY ALL",
    kept=KEPT, items_=ITEMS,
)
add(
    "j05_outlying_cells",
    lambda t: agreement.outlying_cells(t.verdicts),
    """SELECT task, model_id, judge, acc, gap FROM (SELECT *, round(abs(acc - (sum(acc) OVER w - acc) / (count(*) OVER w - 1)), 9) AS gap FROM acc_ WINDOW w AS (PARTITION BY task, model_id)) WHERE gap >= 0.05 ORDER BY gap DESC, task, model_id, judge LIMIT 20""",
    acc_="SELECT task, model_id, judge, avg(CAST(is_correct AS INT)) AS acc FROM verdicts WHERE NOT skipped GROUP BY ALL",
)
add(
    "j06_disagreement_samples",
    lambda t: agreement.disagreement_samples(t.verdicts, "def", "v1").withColumn("place", F.col("place").cast("long")),
    """SELECT * FROM (SELECT a.task, a.model_id, a.idx, a.is_correct AS first, b.is_correct AS second, row_number() OVER (PARTITION BY a.task, a.model_id ORDER BY a.idx) AS place
       FROM kept a JOIN kept b ON a.task = b.task AND a.model_id = b.model_id AND a.idx = b.idx AND a.judge = 'def' AND b.judge = 'v1' WHERE a.is_correct <> b.is_correct) WHERE place <= 25""",
    kept=KEPT,
)
add(
    "j07_skipped_exclusion",
    lambda t: t.verdicts.groupBy("judge").agg(F.count("*").alias("n"), F.count_if("skipped").alias("n_skipped"), F.avg(F.when(~F.col("skipped"), F.col("is_correct").cast("int"))).alias("accuracy"), F.avg((F.col("is_correct") & ~F.col("skipped")).cast("int")).alias("accuracy_all")),
    "SELECT judge, count(*) AS n, count_if(skipped) AS n_skipped, avg(CASE WHEN NOT skipped THEN CAST(is_correct AS INT) END) AS accuracy, avg(CAST(is_correct AND NOT skipped AS INT)) AS accuracy_all FROM verdicts GROUP BY ALL",
)
add(
    "j08_without_suspects",
    lambda t: votes.majority_cells(t.verdicts.join(t.flagged.select("task", "idx"), ["task", "idx"], "left_anti")).drop("source"),
    "SELECT task, model_id, count(*) AS n, count_if(2 * yes > votes) AS correct, count_if(2 * yes > votes) / count(*) AS accuracy FROM items_ i WHERE NOT EXISTS (SELECT 1 FROM flagged f WHERE f.task = i.task AND f.idx = i.idx) GROUP BY ALL",
    items_=ITEMS,
)
add(
    "j09_enriched_flags",
    lambda t: t.flagged.join(t.responses.where("model_response <> ''").groupBy("task", "idx").agg(F.min_by("model_response", "model_id").alias("sample")), ["task", "idx"], "left").select("task", "idx", "winner", "sample"),
    "SELECT f.task, f.idx, f.winner, r.sample FROM flagged f LEFT JOIN (SELECT task, idx, min_by(model_response, model_id) AS sample FROM responses WHERE model_response <> '' GROUP BY ALL) r ON f.task = r.task AND f.idx = r.idx",
)
add(
    "j10_pending_verdicts",
    lambda t: t.flagged.join(t.verifications.where("agent = 'a0'"), ["task", "idx"], "left").select("task", "idx", F.coalesce("verdict", F.lit("pending")).alias("verdict")),
    "SELECT f.task, f.idx, coalesce(v.verdict, 'pending') AS verdict FROM flagged f LEFT JOIN verifications v ON f.task = v.task AND f.idx = v.idx AND v.agent = 'a0'",
)
add(
    "j11_agent_confusion",
    lambda t: agreement.confusion(t.verifications, "a0", "a1", ["gold_correct", "gold_wrong", "uncertain"]),
    "SELECT a.verdict AS first, count_if(b.verdict = 'gold_correct') AS gold_correct, count_if(b.verdict = 'gold_wrong') AS gold_wrong, count_if(b.verdict = 'uncertain') AS uncertain, count(*) AS total FROM verifications a JOIN verifications b ON a.task = b.task AND a.idx = b.idx AND a.agent = 'a0' AND b.agent = 'a1' GROUP BY ALL",
)
TIERS = "SELECT unnest([0.3, 0.4, 0.5, 0.6, 2 / 3, 0.75, 5 / 6, 0.9, 1.0]::DOUBLE[]) AS tier"
add(
    "j12_tiers_reached",
    lambda t: t.flagged.join(F.broadcast(t.spark.range(1).select(F.explode(F.array(*[F.lit(float(x)) for x in votes.THRESHOLDS])).alias("tier"))), F.round("frac", 4) >= F.col("tier") - 1e-9).groupBy("task", "tier").agg(F.count("*").alias("n")),
    "SELECT task, tier, count(*) AS n FROM flagged JOIN tiers ON round(frac, 4) >= tier - 1e-9 GROUP BY ALL",
    tiers=TIERS,
)
add(
    "j13_parents",
    lambda t: t.cells.join(F.broadcast(t.task_dim.where("ord % 5 <> 0")), "task", "left").groupBy(F.coalesce("parent", F.lit("OTHER")).alias("parent")).agg(F.count("*").alias("cells"), F.avg("acc").alias("accuracy")),
    "SELECT coalesce(parent, 'OTHER') AS parent, count(*) AS cells, avg(acc) AS accuracy FROM cells LEFT JOIN (SELECT * FROM task_dim WHERE ord % 5 <> 0) d USING (task) GROUP BY 1",
)
RUN = "SELECT task, model_id, {0} AS acc FROM responses GROUP BY ALL"
PAIRED = "SELECT a.task, sum(CASE WHEN a.judge = 'def' THEN acc END) AS x, sum(CASE WHEN a.judge = 'v2' THEN acc END) AS y FROM (SELECT task, judge, avg(CAST(is_correct AS INT)) AS acc FROM verdicts WHERE NOT skipped GROUP BY ALL) a GROUP BY ALL"
add(
    "j14_paired_runs",
    lambda t: t.verdicts.where("not skipped").groupBy("task").agg(F.avg(F.when(F.col("judge") == "def", F.col("is_correct").cast("int"))).alias("x"), F.avg(F.when(F.col("judge") == "v2", F.col("is_correct").cast("int"))).alias("y")).withColumn("delta", F.round(F.abs(F.col("x") - F.col("y")), 9)).withColumn("severity", F.when(F.col("delta") < 0.025, "minor").when(F.col("delta") < 0.1, "moderate").otherwise("severe")),
    "SELECT task, x, y, round(abs(x - y), 9) AS delta, CASE WHEN round(abs(x - y), 9) < 0.025 THEN 'minor' WHEN round(abs(x - y), 9) < 0.1 THEN 'moderate' ELSE 'severe' END AS severity FROM paired",
    paired=PAIRED,
)
add(
    "j15_model_pairs",
    lambda t: t.cells.alias("a").join(t.cells.alias("b"), (F.col("a.task") == F.col("b.task")) & (F.col("a.model_id") < F.col("b.model_id"))).select(F.col("a.task").alias("task"), F.col("a.model_id").alias("m1"), F.col("b.model_id").alias("m2"), (F.col("a.acc") - F.col("b.acc")).alias("difference"), F.when(F.col("a.acc") > F.col("b.acc"), F.col("a.model_id")).when(F.col("a.acc") < F.col("b.acc"), F.col("b.model_id")).alias("winner")),
    "SELECT a.task, a.model_id AS m1, b.model_id AS m2, a.acc - b.acc AS difference, CASE WHEN a.acc > b.acc THEN a.model_id WHEN a.acc < b.acc THEN b.model_id END AS winner FROM cells a JOIN cells b ON a.task = b.task AND a.model_id < b.model_id",
)
add(
    "j16_run_deltas",
    lambda t: t.verdicts.where("not skipped").groupBy("task", "model_id").agg(F.avg(F.when(F.col("judge") == "def", F.col("is_correct").cast("int"))).alias("x"), F.avg(F.when(F.col("judge") == "v1", F.col("is_correct").cast("int"))).alias("y")).groupBy("task").agg(F.avg(F.col("y") - F.col("x")).alias("mean_delta"), F.max_by("model_id", F.struct(F.round(F.col("y") - F.col("x"), 9).alias("d"), "model_id")).alias("gains_most"), F.min_by("model_id", F.struct(F.round(F.col("y") - F.col("x"), 9).alias("d"), "model_id")).alias("loses_most")),
    """SELECT task, avg(y - x) AS mean_delta, arg_max(model_id, round(y - x, 9) * 1000000 + model_id / 1000) AS gains_most, arg_min(model_id, round(y - x, 9) * 1000000 + model_id / 1000) AS loses_most FROM (
       SELECT task, model_id, avg(CASE WHEN judge = 'def' THEN CAST(is_correct AS INT) END) AS x, avg(CASE WHEN judge = 'v1' THEN CAST(is_correct AS INT) END) AS y FROM verdicts WHERE NOT skipped GROUP BY ALL) GROUP BY ALL""",
)
add(
    "j17_judge_independence",
    lambda t: t.verdicts.where("not skipped").groupBy("model_id").pivot("judge", ["def", "v1", "v2"]).agg(F.avg(F.col("is_correct").cast("int"))).select("model_id", (F.col("v1") - F.col("def")).alias("gain_v1"), (F.col("v2") - F.col("def")).alias("gain_v2")),
    "SELECT model_id, avg(CASE WHEN judge = 'v1' THEN CAST(is_correct AS INT) END) - avg(CASE WHEN judge = 'def' THEN CAST(is_correct AS INT) END) AS gain_v1, avg(CASE WHEN judge = 'v2' THEN CAST(is_correct AS INT) END) - avg(CASE WHEN judge = 'def' THEN CAST(is_correct AS INT) END) AS gain_v2 FROM verdicts WHERE NOT skipped GROUP BY ALL",
)
add(
    "j18_adversarial_strata",
    lambda t: t.predictions.join(t.verdicts.where("judge = 'def' and not skipped").drop("judge", "skipped"), ["task", "model_id", "idx"]).select(F.when(F.col("pred").isNull(), "no answer").when((F.col("pred") == F.col("gold")) != F.col("is_correct"), "conflict").otherwise("agreed").alias("stratum"), "is_correct").groupBy("stratum").agg(F.count("*").alias("n"), F.avg(F.col("is_correct").cast("int")).alias("judged_right")),
    "SELECT CASE WHEN pred IS NULL THEN 'no answer' WHEN (pred = gold) <> is_correct THEN 'conflict' ELSE 'agreed' END AS stratum, count(*) AS n, avg(CAST(is_correct AS INT)) AS judged_right FROM predictions JOIN verdicts USING (task, model_id, idx) WHERE judge = 'def' AND NOT skipped GROUP BY ALL",
)

# judges by what they extract, their leaderboards, strata with human labels, versions
COMMON = "SELECT task, model_id, idx, count(DISTINCT is_correct) > 1 AS v, count(DISTINCT trim(extracted)) > 1 AS e FROM judged_answers WHERE NOT skipped GROUP BY ALL HAVING count(DISTINCT judge) = 3"
add(
    "j04_extraction_comparison",
    lambda t: judges.comparison(t.judged_answers, 3),
    "SELECT coalesce(task, 'ALL') AS task, model_id, count(*) AS common, count_if(v) AS verdict_disagreements, count_if(e) AS extraction_disagreements, count_if(v OR e) AS either FROM common_ GROUP BY ROLLUP (task, model_id)",
    common_=COMMON,
)
add(
    "j04_verdict_distribution",
    lambda t: judges.verdict_distribution(t.judged_answers, 3),
    "SELECT task, judge, count_if(is_correct) AS n_correct, count_if(NOT is_correct) AS n_incorrect, count_if(upper(trim(extracted)) = 'NONE') AS n_none FROM judged_answers JOIN common_ USING (task, model_id, idx) GROUP BY ALL",
    common_=COMMON,
)
BOARD = "SELECT judge, model_id, round(avg(CAST(is_correct AS INT)), 9) AS acc FROM verdicts WHERE NOT skipped GROUP BY ALL"
BOTH = "SELECT a.judge AS first, b.judge AS second, a.acc AS x, b.acc AS y FROM board a JOIN board b ON a.model_id = b.model_id AND a.judge < b.judge"
PLACED = "SELECT first, second, " + ", ".join(f"rank() OVER (PARTITION BY first, second ORDER BY {c}) + (count(*) OVER (PARTITION BY first, second, {c}) - 1) / 2 AS r{c}" for c in "xy") + " FROM both_"
add(
    "j17_leaderboard_rho",
    lambda t: judges.leaderboard_rho(t.verdicts).withColumn("rho", F.round("rho", 8)),
    "SELECT first, second, count(*) AS models, round(CASE WHEN stddev_pop(rx) * stddev_pop(ry) > 1e-12 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END, 8) AS rho, max(abs(rx - ry)) AS largest_shift FROM placed GROUP BY ALL",
    board=BOARD, both_=BOTH, placed=PLACED,
)
add(
    "j17_family_gains",
    lambda t: judges.family_gains(t.verdicts, t.models.select("model_id", (F.col("model_id") % 4).alias("family")), t.judges.select("judge", F.col("jn").cast("long").alias("family"))),
    """SELECT model_id, model_id % 4 AS family, avg(acc) FILTER (WHERE jn = model_id % 4) AS own, avg(acc) FILTER (WHERE jn <> model_id % 4) AS others, avg(acc) FILTER (WHERE jn = model_id % 4) - avg(acc) FILTER (WHERE jn <> model_id % 4) AS gain
       FROM (SELECT judge, model_id, avg(CAST(is_correct AS INT)) AS acc FROM verdicts WHERE NOT skipped GROUP BY ALL) JOIN judges USING (judge) GROUP BY ALL""",
)
STRATA = """SELECT task, model_id, idx, is_correct, CASE WHEN upper(trim(extracted)) IN ('', 'NONE') THEN 'none' WHEN is_correct <> coalesce(pred = gold, FALSE) THEN 'conflict' ELSE 'control' END AS stratum
  FROM judged_answers JOIN predictions USING (task, model_id, idx) WHERE judge = 'def' AND NOT skipped AND task IN (SELECT task FROM task_dim WHERE task_type = 'mcq')"""


def of_options(t, rows):
    return rows.join(F.broadcast(t.task_dim.where("task_type = 'mcq'").select("task")), "task", "left_semi")  # a row for each task


add(
    "j17_strata_agreement",
    lambda t: judges.strata_agreement(of_options(t, t.judged_answers), t.predictions, "def", "v1"),
    "SELECT stratum, count(*) AS n, avg(CAST(s.is_correct = v.is_correct AS INT)) AS agreement, count_if(s.is_correct AND NOT v.is_correct) AS only_first, count_if(v.is_correct AND NOT s.is_correct) AS only_second FROM strata s JOIN verdicts v USING (task, model_id, idx) WHERE v.judge = 'v1' AND NOT v.skipped GROUP BY ALL",
    strata=STRATA,
)
add(
    "j18_annotated_strata",
    lambda t: judges.annotated_strata(judges.strata(of_options(t, t.judged_answers), t.predictions, "def"), t.annotations, 60),
    """SELECT stratum, n, sampled, labelled, agreement, adjudicated, upheld FROM (SELECT stratum, count(*) AS n FROM strata GROUP BY ALL) JOIN (
         SELECT stratum, count(*) AS sampled, count(right_) AS labelled, avg(CAST(right_ = is_correct AS INT)) AS agreement, avg(CAST(right_ AS INT)) AS adjudicated, count_if(right_ = is_correct) AS upheld FROM (
           SELECT s.*, CASE lower(trim(human)) WHEN 'correct' THEN TRUE WHEN 'incorrect' THEN FALSE END AS right_ FROM (
             SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws(':', '0', task, CAST(model_id AS VARCHAR), CAST(idx AS VARCHAR)))) AS place FROM strata) s
           LEFT JOIN annotations a USING (task, model_id, idx) WHERE place <= 60) GROUP BY ALL) USING (stratum)""",
    strata=STRATA,
)
DETAILS = "SELECT task, model_id, judge, avg(CAST(is_correct AS INT)) AS mean_, count(*) AS k FROM verdicts WHERE NOT skipped AND NOT (judge = 'v2' AND model_id % 4 = 3) GROUP BY ALL"
VERSIONS = "SELECT task, model_id, judge, coalesce(accuracy, mean_) AS acc, coalesce(k, 0) AS n, CASE WHEN accuracy IS NOT NULL THEN 'summary' ELSE 'details' END AS source FROM judge_summaries FULL JOIN details USING (task, model_id, judge)"


def versions(t):
    return judges.versions(t.judge_summaries, t.verdicts.where("not (judge = 'v2' and model_id % 4 = 3)"))


add("j05_versions", versions, "SELECT * FROM versions", details=DETAILS, versions=VERSIONS)
add(
    "j05_version_gaps",
    lambda t: judges.version_gaps(versions(t), "v2"),
    "SELECT task, model_id, acc, base, round(abs(acc - base), 9) AS gap FROM (SELECT task, model_id, max(acc) FILTER (WHERE judge = 'v2') AS acc, avg(acc) FILTER (WHERE judge <> 'v2') AS base FROM versions GROUP BY ALL) WHERE round(abs(acc - base), 9) >= 0.05 ORDER BY gap DESC, task, model_id LIMIT 20",
    details=DETAILS, versions=VERSIONS,
)

# scoring
VALID = "pred IN ('A', 'B', 'C', 'D') AND pred IS NOT NULL"


def gated(t):
    valid, correct = scores.gated(F.col("pred"), F.col("gold"), "ABCD")
    return t.predictions.withColumn("valid", valid).withColumn("correct", correct)


add("m01_validity_gate", lambda t: gated(t).select("task", "model_id", "idx", "valid", "correct"), f"SELECT task, model_id, idx, {VALID} AS valid, coalesce(pred = gold, FALSE) AS correct FROM predictions")
ACCURACIES = "SELECT task, model_id, count(*) AS total, count(pred) AS valid, count(*) - count(pred) AS invalid, count_if(pred = gold) AS correct, count_if(pred = gold) / nullif(count(pred), 0) AS acc_valid, count_if(pred = gold) / count(*) AS acc_total FROM predictions GROUP BY ALL"
add("m02_accuracies", lambda t: scores.accuracies(gated(t), ["task", "model_id"]).drop("inflation"), ACCURACIES)
add("m03_inflation", lambda t: scores.accuracies(gated(t), ["model_id"]).select("model_id", "inflation"), "SELECT model_id, (count_if(pred = gold) / nullif(count(pred), 0)) / nullif(count_if(pred = gold) / count(*), 0) AS inflation FROM predictions GROUP BY ALL")

CVSS_SQL = """
  SELECT task, model_id, idx, {side} AS v, CASE WHEN impact IS NULL OR exploit IS NULL THEN NULL WHEN impact <= 0 THEN 0.0 WHEN CAST(round(raw * 100000) AS BIGINT) % 10000 = 0 THEN CAST(round(raw * 100000) AS BIGINT) / 100000 ELSE (floor(CAST(round(raw * 100000) AS BIGINT) / 10000) + 1) / 10 END AS score FROM (
  SELECT *, least(CASE WHEN s = 'C' THEN 1.08 * (impact + exploit) ELSE impact + exploit END, 10.0::DOUBLE) AS raw FROM (
  SELECT *, CASE WHEN s = 'C' THEN 7.52 * (iss - 0.029) - 3.25 * power(iss - 0.02, 15) ELSE 6.42 * iss END AS impact, 8.22 * av * ac * pr * ui AS exploit FROM (
  SELECT *, 1 - (1 - c) * (1 - i) * (1 - a) AS iss FROM (
  SELECT task, model_id, idx, {side}, regexp_extract({side}, '(?:^|/)S:([UC])(?:/|$)', 1) AS s,
    map {{'N': 0.85::DOUBLE, 'A': 0.62, 'L': 0.55, 'P': 0.2}}[regexp_extract({side}, '(?:^|/)AV:([A-Z])(?:/|$)', 1)] AS av,
    map {{'L': 0.77::DOUBLE, 'H': 0.44}}[regexp_extract({side}, '(?:^|/)AC:([A-Z])(?:/|$)', 1)] AS ac,
    CASE WHEN regexp_extract({side}, '(?:^|/)S:([UC])(?:/|$)', 1) = 'C' THEN map {{'N': 0.85::DOUBLE, 'L': 0.68, 'H': 0.5}}[regexp_extract({side}, '(?:^|/)PR:([A-Z])(?:/|$)', 1)]
         ELSE map {{'N': 0.85::DOUBLE, 'L': 0.62, 'H': 0.27}}[regexp_extract({side}, '(?:^|/)PR:([A-Z])(?:/|$)', 1)] END AS pr,
    map {{'N': 0.85::DOUBLE, 'R': 0.62}}[regexp_extract({side}, '(?:^|/)UI:([A-Z])(?:/|$)', 1)] AS ui,
    map {{'H': 0.56::DOUBLE, 'L': 0.22, 'N': 0.0}}[regexp_extract({side}, '(?:^|/)C:([A-Z])(?:/|$)', 1)] AS c,
    map {{'H': 0.56::DOUBLE, 'L': 0.22, 'N': 0.0}}[regexp_extract({side}, '(?:^|/)I:([A-Z])(?:/|$)', 1)] AS i,
    map {{'H': 0.56::DOUBLE, 'L': 0.22, 'N': 0.0}}[regexp_extract({side}, '(?:^|/)A:([A-Z])(?:/|$)', 1)] AS a
  FROM cvss_pairs))))"""
GOLD_CVSS, PRED_CVSS = CVSS_SQL.format(side="gold"), CVSS_SQL.format(side="pred")
SCORED = "SELECT g.task, g.model_id, g.idx, g.score AS g, p.score AS p FROM gold_cvss g JOIN pred_cvss p USING (task, model_id, idx)"


def cvss_scored(t):
    return t.cvss_pairs.select("task", "model_id", "idx", cvss.base_score(F.col("gold")).alias("score_gold"), cvss.base_score(F.col("pred")).alias("score_pred"))


add("e20_cvss_scores", lambda t: cvss_scored(t), "SELECT task, model_id, idx, g AS score_gold, p AS score_pred FROM scored", gold_cvss=GOLD_CVSS, pred_cvss=PRED_CVSS, scored=SCORED)
for key, columns, sql in (
    ("m04_mad", ["n", "n_valid", "mad"], "count(*) AS n, count(abs(p - g)) AS n_valid, avg(abs(p - g)) AS mad"),
    ("m05_mad_penalised", ["mad_penalised"], "round(avg(coalesce(round(abs(p - g), 2), 10.0)), 3) AS mad_penalised"),
    ("m06_mad_accuracy", ["acc_unclamped", "acc_clamped"], "1 - avg(abs(p - g)) / 7.7 AS acc_unclamped, greatest(0.0, 1 - round(avg(coalesce(round(abs(p - g), 2), 10.0)), 3) / 7.7) AS acc_clamped"),
):
    add(key, lambda t, c=columns: scores.deviations(cvss_scored(t), ["model_id"]).select("model_id", *c), f"SELECT model_id, {sql} FROM scored GROUP BY ALL", gold_cvss=GOLD_CVSS, pred_cvss=PRED_CVSS, scored=SCORED)

SETS = r"""SELECT *, len(list_intersect(p, g)) AS tp, len(p) AS np, len(g) AS ng FROM (
  SELECT task, model_id, idx, list_distinct(list_transform(regexp_extract_all(upper(model_response), '\b(T\d{4}(?:\.\d{3})?)\b', 1), lambda x: string_split(x, '.')[1])) AS p,
    list_distinct(list_transform(regexp_extract_all(upper(ground_truth), '\b(T\d{4}(?:\.\d{3})?)\b', 1), lambda x: string_split(x, '.')[1])) AS g FROM id_sets)"""
F1 = "CASE WHEN tp > 0 THEN 2 * (tp / np) * (tp / ng) / (tp / np + tp / ng) ELSE 0 END"


def set_scored(t, empty="zero"):
    ids = lambda c: extract.parents(extract.technique_ids(F.col(c)))
    return t.id_sets.select("task", "model_id", "idx", scores.set_scores(ids("model_response"), ids("ground_truth"), empty).alias("s"))


add("m07_exact_sets", lambda t: set_scored(t).groupBy("task", "model_id").agg(F.avg(F.col("s.exact").cast("int")).alias("exact_rate")), "SELECT task, model_id, avg(CAST(tp = np AND tp = ng AS INT)) AS exact_rate FROM sets GROUP BY ALL", sets=SETS)
add("m08_set_scores", lambda t: set_scored(t).select("task", "model_id", "idx", "s.tp", "s.fp", "s.fn", "s.f1"), f"SELECT task, model_id, idx, tp, np - tp AS fp, ng - tp AS fn, {F1} AS f1 FROM sets", sets=SETS)
MICRO = "SELECT {keys}, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(np - tp) AS BIGINT) AS fp, CAST(sum(ng - tp) AS BIGINT) AS fn, sum(tp) / sum(np) AS precision, sum(tp) / sum(ng) AS recall, 2 * (sum(tp) / sum(np)) * (sum(tp) / sum(ng)) / (sum(tp) / sum(np) + sum(tp) / sum(ng)) AS micro_f1, count_if(tp = np AND tp = ng) AS exact, avg(" + F1 + ") AS macro_f1 FROM sets GROUP BY ALL"
add("m09_micro", lambda t: scores.micro(set_scored(t), ["model_id"]).drop("macro_f1"), f"SELECT * EXCLUDE (macro_f1) FROM ({MICRO.format(keys='model_id')})", sets=SETS)
add("m10_macro_f1", lambda t: scores.micro(set_scored(t), ["task"]).select("task", "macro_f1"), f"SELECT task, macro_f1 FROM ({MICRO.format(keys='task')})", sets=SETS)
STRICT = r"""SELECT s.*, len(list_intersect(q, g)) AS stp, len(q) AS nq, CASE WHEN regexp_matches(model_response, '(?m)^\s*\d+\.') THEN 'numbered_list' WHEN len(list_filter(regexp_split_to_array(model_response, '\s+'), lambda w: w <> '')) > 10 THEN 'prose' WHEN contains(model_response, ',') THEN 'comma_separated' ELSE 'simple' END AS format
  FROM (SELECT s.*, i.model_response, list_distinct(list_transform(regexp_extract_all(list_last(string_split(i.model_response, chr(10))), '(T\d{4}(?:\.?\d{1,3})?)', 1), lambda x: string_split(x, '.')[1])) AS q FROM sets s JOIN id_sets i USING (task, model_id, idx)) s"""


def protocols(t):
    gold = extract.parents(extract.technique_ids(F.col("ground_truth")))
    strict, lenient = extract.parents(extract.strict_ids(F.col("model_response"))), extract.parents(extract.technique_ids(F.col("model_response")))
    return t.id_sets.select("task", "model_id", "idx", extract.response_format(F.col("model_response")).alias("format"), scores.set_scores(strict, gold)["f1"].alias("strict_f1"), scores.set_scores(lenient, gold)["f1"].alias("lenient_f1"))


SF1 = F1.replace("tp", "stp").replace("np", "nq")
add("m11_protocol_gap", lambda t: scores.protocol_gap(protocols(t), ["format"]), f"SELECT format, count(*) AS n, avg({SF1}) AS strict, avg({F1}) AS lenient, avg({F1}) - avg({SF1}) AS gap, count_if(({SF1}) = 0 AND ({F1}) > 0) AS format_errors FROM strict_ GROUP BY ALL", sets=SETS, strict_=STRICT)
add(
    "m14_topics",
    lambda t: scores.by_topic(gated(t).select(F.array(F.col("task"), F.concat(F.lit("mod"), (F.col("idx") % 3).cast("string"))).alias("topics"), "correct")),
    "SELECT topic, count(*) AS n, avg(CAST(coalesce(pred = gold, FALSE) AS INT)) AS accuracy FROM (SELECT unnest([task, concat('mod', CAST(idx % 3 AS VARCHAR))]) AS topic, pred, gold FROM predictions UNION ALL SELECT 'Overall', pred, gold FROM predictions) GROUP BY ALL",
)
add(
    "m15_match_triple",
    lambda t: t.responses.groupBy("task").agg(F.avg((F.col("model_response") == F.col("ground_truth")).cast("int")).alias("exact"), F.avg(F.col("model_response").startswith(F.col("ground_truth")).cast("int")).alias("prefix"), F.avg(F.coalesce(F.regexp_extract("model_response", r"\b([ABCD])\b", 1) == F.col("ground_truth"), F.lit(False)).cast("int")).alias("pattern")),
    r"SELECT task, avg(CAST(model_response = ground_truth AS INT)) AS exact, avg(CAST(starts_with(model_response, ground_truth) AS INT)) AS prefix, avg(CAST(regexp_extract(model_response, '\b([ABCD])\b', 1) = ground_truth AS INT)) AS pattern FROM responses GROUP BY ALL",
)
add("m16_ordinal", lambda t: t.verdicts.groupBy("judge").agg(F.avg(scores.ordinal(F.col("idx") % 8 - 1)).alias("score")), "SELECT judge, avg(greatest(1, least(5, idx % 8 - 1))) AS score FROM verdicts GROUP BY ALL")


def metric_cells(t):
    return reverdict.metric_cells(t.verdicts.where("judge = 'def'"), cvss_scored(t), set_scored(t), t.task_dim)


DEVIATIONS = "SELECT task, model_id, round(avg(coalesce(round(abs(p - g), 2), 10.0)), 3) AS mad FROM scored GROUP BY ALL"
COUNTS = "SELECT task, model_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(np - tp) AS BIGINT) AS fp, CAST(sum(ng - tp) AS BIGINT) AS fn, coalesce(2 * (sum(tp) / nullif(sum(np), 0)) * (sum(tp) / nullif(sum(ng), 0)) / nullif(sum(tp) / nullif(sum(np), 0) + sum(tp) / nullif(sum(ng), 0), 0), 0) AS f1 FROM sets GROUP BY ALL"
METRICS = """SELECT task, model_id, CASE task_type WHEN 'vsp' THEN 'mad' WHEN 'ids' THEN 'f1' ELSE 'accuracy' END AS metric, CASE task_type WHEN 'vsp' THEN mad WHEN 'ids' THEN f1 ELSE correct / total END AS value,
  CASE task_type WHEN 'vsp' THEN greatest(0.0, 1 - mad / 7.7) WHEN 'ids' THEN f1 ELSE correct / total END AS normal, total, correct, CASE WHEN task_type = 'ids' THEN tp END AS tp, CASE WHEN task_type = 'ids' THEN fp END AS fp, CASE WHEN task_type = 'ids' THEN fn END AS fn
  FROM (SELECT task, model_id, count(*) AS total, count_if(is_correct) AS correct FROM verdicts WHERE judge = 'def' AND NOT skipped GROUP BY ALL) JOIN devs USING (task, model_id) JOIN counts USING (task, model_id) JOIN task_dim USING (task)"""
WITH_METRICS = {"gold_cvss": GOLD_CVSS, "pred_cvss": PRED_CVSS, "scored": SCORED, "sets": SETS, "devs": DEVIATIONS, "counts": COUNTS, "metrics": METRICS}
add("m17_primary_scores", lambda t: metric_cells(t).select("task", "model_id", "value", F.col("metric").alias("unit")), "SELECT task, model_id, value, metric AS unit FROM metrics", **WITH_METRICS)
add(
    "m18_metric_summary", lambda t: reverdict.metric_summary(metric_cells(t)),
    """SELECT * FROM metrics UNION ALL SELECT 'ALL' AS task, model_id, 'mean' AS metric, avg(normal) AS value, avg(normal) AS normal, CAST(sum(total) AS BIGINT) AS total, CAST(sum(correct) AS BIGINT) AS correct,
       CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM metrics GROUP BY model_id""", **WITH_METRICS,
)
add("m18_summary", lambda t: scores.summary(t.verdicts.where("judge = 'def'")), "SELECT model_id, coalesce(task, 'ALL') AS task, count(*) AS total, count_if(is_correct) AS correct, count_if(is_correct) / count(*) AS accuracy FROM verdicts WHERE judge = 'def' AND NOT skipped GROUP BY GROUPING SETS ((model_id, task), (model_id))")
add(
    "m19_native_cells",
    lambda t: t.cells.where("model_id % 3 <> 0").withColumnRenamed("acc", "summary_acc").drop("n").join(scores.summary(t.verdicts.where("judge = 'def'")).where("task <> 'ALL'"), ["task", "model_id"], "right").select("task", "model_id", F.coalesce("summary_acc", "accuracy").alias("value")),
    "SELECT s.task, s.model_id, coalesce(c.acc, s.acc) AS value FROM (SELECT task, model_id, avg(CAST(is_correct AS INT)) AS acc FROM verdicts WHERE judge = 'def' AND NOT skipped GROUP BY ALL) s LEFT JOIN cells c ON c.task = s.task AND c.model_id = s.model_id AND c.model_id % 3 <> 0",
)
add(
    "m20_best_of_task",
    lambda t: scores.best_of_task(t.cells.join(F.broadcast(t.task_dim), "task").select("task", "model_id", "task_type", F.round("acc", 9).alias("value")), F.col("task_type") == "vsp", tolerance=0.05).drop("task_type"),
    "SELECT task, model_id, round(acc, 9) AS value, CASE WHEN task_type = 'vsp' THEN round(acc, 9) - min(round(acc, 9)) OVER w ELSE max(round(acc, 9)) OVER w - round(acc, 9) END <= 0.05 AS is_best FROM cells JOIN task_dim USING (task) WINDOW w AS (PARTITION BY task)",
)
add("m21_single_letter_rate", lambda t: t.responses.groupBy("model_id").agg(F.avg((F.size(F.array_distinct(F.regexp_extract_all("model_response", F.lit(r"\b([A-D])\b"), F.lit(1)))) == 1).cast("int")).alias("single")), r"SELECT model_id, avg(CAST(len(list_distinct(regexp_extract_all(model_response, '\b([A-D])\b', 1))) = 1 AS INT)) AS single FROM responses GROUP BY ALL")
add(
    "m22_degenerate",
    lambda t: scores.degenerate(t.responses, ["task", "model_id"], r"^ANSWER: [A-D]$"),
    "SELECT task, model_id, CAST(sum(k) AS BIGINT) AS n, sum(CASE WHEN trim(model_response) = '' THEN k ELSE 0 END) / sum(k) AS empty_rate, max(k) / sum(k) AS dominant_share, sum(CASE WHEN regexp_matches(model_response, '^ANSWER: [A-D]$') THEN k ELSE 0 END) / sum(k) AS placeholder_rate FROM (SELECT task, model_id, model_response, count(*) AS k FROM responses GROUP BY ALL) GROUP BY ALL",
)
add(
    "m23_re_verdict",
    lambda t: t.predictions.join(t.verdicts.where("not skipped"), ["task", "model_id", "idx"]).groupBy("judge").agg(F.count("*").alias("n"), F.avg((F.coalesce(F.col("pred") == F.col("gold"), F.lit(False)) != F.col("is_correct")).cast("int")).alias("differ_rate")),
    "SELECT judge, count(*) AS n, avg(CAST(coalesce(pred = gold, FALSE) <> is_correct AS INT)) AS differ_rate FROM predictions JOIN verdicts USING (task, model_id, idx) WHERE NOT skipped GROUP BY ALL",
)


#: Answers as a judge extracts them, of seven kinds, in four ways: alike but for notation, alike, unlike, nothing.
JUDGED = """SELECT task, model_id, idx, kind, judge, stated, truth, CASE WHEN way = 3 THEN 'NONE' WHEN way = 1 THEN truth WHEN way = 0 THEN like_it ELSE unlike END AS extracted FROM (
  SELECT v.task, v.model_id, v.idx, v.judge, v.is_correct AS stated, (v.idx * 7 + v.model_id * 3) % 4 AS way,
    CASE v.idx % 8 WHEN 0 THEN 'letter' WHEN 1 THEN 'letters' WHEN 2 THEN 'cwe' WHEN 3 THEN 'vector' WHEN 4 THEN 'techniques' WHEN 5 THEN 'mitigations' WHEN 6 THEN 'actor' ELSE 'meaning' END AS kind,
    CASE v.idx % 8 WHEN 0 THEN 'B' WHEN 1 THEN 'ACD' WHEN 2 THEN concat('CWE-', CAST(20 + v.idx % 70 AS STRING)) WHEN 3 THEN 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:N' WHEN 4 THEN concat('T1059.001, T', CAST(1000 + v.idx % 40 AS STRING)) WHEN 5 THEN 'M1018,M1026'
      WHEN 6 THEN concat('Actor ', CAST(v.idx % 9 + 1 AS STRING)) ELSE 'any' END AS truth,
    CASE v.idx % 8 WHEN 0 THEN ' b' WHEN 1 THEN 'd, a, C' WHEN 2 THEN CAST(20 + v.idx % 70 AS STRING) WHEN 3 THEN 'cvss:3.0/av:n/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:N' WHEN 4 THEN concat('T', CAST(1000 + v.idx % 40 AS STRING), '.002,T1059') WHEN 5 THEN 'm1026 and m1018'
      WHEN 6 THEN concat('ACTOR ', CAST(v.idx % 9 + 2 AS STRING)) ELSE 'all' END AS like_it,
    CASE v.idx % 8 WHEN 0 THEN 'C' WHEN 1 THEN 'AC' WHEN 2 THEN concat('CWE-', CAST(20 + v.idx % 70 AS STRING), ', CWE-1') WHEN 3 THEN 'AV:L/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:N' WHEN 4 THEN 'T1059' WHEN 5 THEN 'M1018' WHEN 6 THEN concat('Actor ', CAST(v.idx % 9 + 70 AS STRING)) ELSE 'none' END AS unlike
  FROM verdicts v WHERE NOT v.skipped)"""
ALIASES = "SELECT concat('actor ', CAST(src AS STRING)) AS a, concat('Actor ', CAST(dst AS STRING)) AS b FROM edges WHERE kind = 'alias'"
add(
    "m23_stated_rules",
    lambda t: reverdict.rates(reverdict.re_verdicts(t.sql(JUDGED), t.sql(ALIASES)), ["kind", "judge"]),
    r"""SELECT kind, judge, count(*) AS n, count_if(stated) AS stated_correct, count_if(same) AS rule_correct, avg(CAST(stated <> same AS INT)) AS differ_rate FROM (
      SELECT kind, judge, stated, CASE kind WHEN 'letter' THEN upper(trim(extracted)) = truth WHEN 'letters' THEN extracted <> 'NONE' AND list_sort(list_distinct(regexp_extract_all(upper(extracted), '[A-Z]'))) = list_sort(regexp_extract_all(truth, '[A-Z]'))
        WHEN 'cwe' THEN list_sort(list_distinct(list_transform(regexp_extract_all(extracted, '\d+'), lambda x: x::INT))) = list_transform(regexp_extract_all(truth, '\d+'), lambda x: x::INT) WHEN 'vector' THEN regexp_replace(upper(extracted), '^CVSS:3.[01]/', '') = substr(truth, 10)
        WHEN 'techniques' THEN list_sort(list_distinct(list_transform(regexp_extract_all(extracted, 'T\d{4}(\.\d+)?'), lambda x: x[1:5]))) = list_sort(list_distinct(list_transform(regexp_extract_all(truth, 'T\d{4}(\.\d+)?'), lambda x: x[1:5])))
        WHEN 'mitigations' THEN list_sort(list_distinct(regexp_extract_all(upper(extracted), 'M\d{4}'))) = list_sort(regexp_extract_all(truth, 'M\d{4}'))
        ELSE lower(extracted) = lower(truth) OR EXISTS (SELECT 1 FROM reach WHERE x = lower(extracted) AND y = lower(truth)) END AS same FROM judged WHERE kind <> 'meaning') GROUP BY ALL""",
    judged=JUDGED.replace("STRING", "VARCHAR"), pairs_="SELECT concat('actor ', CAST(p.s AS VARCHAR)) AS x, concat('actor ', CAST(q.s AS VARCHAR)) AS y FROM (SELECT unnest(range(1, 100)) AS s) p, (SELECT unnest(range(1, 100)) AS s) q WHERE (p.s - 1) // 7 = (q.s - 1) // 7",
    ends_="SELECT 'actor ' || CAST(src AS VARCHAR) AS name FROM edges WHERE kind = 'alias' UNION SELECT 'actor ' || CAST(dst AS VARCHAR) FROM edges WHERE kind = 'alias'",
    reach="SELECT x, y FROM pairs_ WHERE x IN (SELECT name FROM ends_) AND y IN (SELECT name FROM ends_)",
)
