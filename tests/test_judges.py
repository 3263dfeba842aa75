"""Judges compared on small tables worked out by hand."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import judges, prompts
from plumbline.sources import files

SAID = "task string, model_id long, idx long, judge string, is_correct boolean, extracted string, skipped boolean"


@pytest.fixture(scope="module")
def said(spark):
    rows = [
        ("t", 1, 1, "a", True, "A ", False), ("t", 1, 1, "b", True, "A", False),
        ("t", 1, 2, "a", True, "B", False), ("t", 1, 2, "b", False, "B", False),
        ("t", 1, 3, "a", True, None, False), ("t", 1, 3, "b", True, "NONE", False),
        ("t", 1, 4, "a", True, "C", False), ("t", 1, 4, "b", True, "C", True),  # skipped by b
        ("t", 2, 1, "a", False, "A", False), ("t", 2, 1, "b", None, "A", None),  # no verdict is no correct one
    ]
    return spark.createDataFrame(rows, SAID)


def test_disagreements_of_verdicts_and_extractions(said):
    got = {(r.task, r.model_id): (r.common, r.verdict_disagreements, r.extraction_disagreements, r.either) for r in judges.comparison(said, 2).collect()}
    assert got == {("t", 1): (3, 1, 1, 2), ("t", 2): (1, 0, 0, 0), ("t", None): (4, 1, 1, 2), ("ALL", None): (4, 1, 1, 2)}
    dist = {r.judge: (r.n_correct, r.n_incorrect, r.n_none) for r in judges.verdict_distribution(said, 2).collect()}
    assert dist == {"a": (3, 1, 1), "b": (2, 2, 1)}
    assert judges.comparison(said.where("false"), 2).where("task <> 'ALL'").count() == 0 and judges.verdict_distribution(said, 3).count() == 0


def test_a_repeated_verdict_counts_once(said):
    twice = {(r.task, r.model_id): r.common for r in judges.comparison(said.union(said), 2).collect()}
    assert twice["ALL", None] == 4


def test_leaderboards_of_opposite_order(spark):
    rows = [("t", m, i, j, (i < m) if j == "a" else (i >= m), None, False) for m in range(1, 4) for i in range(4) for j in "ab"]
    v = spark.createDataFrame(rows, SAID)
    r = judges.leaderboard_rho(v).first()
    assert (r.first, r.second, r.models, round(r.rho, 9), r.largest_shift) == ("a", "b", 3, -1.0, 2.0)
    same = judges.leaderboard_rho(v.withColumn("is_correct", F.lit(True))).first()
    assert same.rho is None and same.largest_shift == 0  # equal models have no order


def test_own_family_gain(spark):
    rows = [("t", m, i, j, i < {("a", 1): 4, ("b", 1): 2}.get((j, m), 3), None, False) for m in (1, 2) for i in range(4) for j in "ab"]
    models, of = spark.createDataFrame([(1, "x"), (2, None)], "model_id long, family string"), spark.createDataFrame([("a", "x"), ("b", "y")], "judge string, family string")
    got = {r.model_id: (r.own, r.others, r.gain) for r in judges.family_gains(spark.createDataFrame(rows, SAID), models, of).collect()}
    assert got == {1: (1.0, 0.5, 0.5), 2: (None, 0.75, None)}


def test_strata_and_blank_labels(spark, said):
    pred = spark.createDataFrame([("t", 1, i, p, "A") for i, p in ((1, "A"), (2, None), (3, "A"), (4, "A"))], "task string, model_id long, idx long, pred string, gold string")
    rows = judges.strata(said, pred, "a")
    assert {r.idx: r.stratum for r in rows.collect()} == {1: "control", 2: "conflict", 3: "none", 4: "control"}
    people = spark.createDataFrame([("t", 1, 1, "Correct "), ("t", 1, 2, "incorrect"), ("t", 1, 3, " "), ("t", 1, 4, "incorrect")], "task string, model_id long, idx long, human string")
    got = {r.stratum: (r.n, r.sampled, r.labelled, r.agreement, r.adjudicated, r.upheld) for r in judges.annotated_strata(rows, people, 5).collect()}
    assert got == {"control": (2, 2, 2, 0.5, 0.5, 1), "conflict": (1, 1, 1, 0.0, 0.0, 0), "none": (1, 1, 0, None, None, 0)}
    one = {r.stratum: (r.n, r.sampled) for r in judges.annotated_strata(rows, people, 1).collect()}
    assert one["control"] == (2, 1)
    both = {r.stratum: (r.n, r.agreement) for r in judges.strata_agreement(said, pred, "a", "b").collect()}
    assert both == {"control": (1, 1.0), "conflict": (1, 0.0), "none": (1, 1.0)}


def test_summary_before_details(spark, said):
    given = spark.createDataFrame([("t", 1, "a", 0.25), ("t", 1, "c", 0.5), ("t", 2, "a", None)], "task string, model_id long, judge string, accuracy double")
    cells = judges.versions(given, said)
    got = {(r.model_id, r.judge): (round(r.acc, 6), r.n, r.source) for r in cells.collect()}
    assert got == {(1, "a"): (0.25, 4, "summary"), (1, "b"): (0.666667, 3, "details"), (1, "c"): (0.5, 0, "summary"), (2, "a"): (0.0, 1, "details")}
    assert [(r.model_id, round(r.gap, 6)) for r in judges.version_gaps(cells, "b", 0.05).collect()] == [(1, 0.291667)]


def test_modes_need_all_three(spark):
    rows = [("t", 1, m, c) for m, c in (("zero_shot", True), ("zero_shot", False), ("few_shot", True), ("cot", True))] + [("u", 1, "zero_shot", True), ("u", 1, "cot", False)]
    pivoted = judges.mode_pivot(spark.createDataFrame(rows, "task string, model_id long, mode string, correct boolean"))
    assert [tuple(r) for r in pivoted.collect()] == [("t", 1, 50.0, 100.0, 100.0, 50.0)]
    effect = judges.mode_effects(pivoted).first()
    assert (effect.tasks, effect.mean_delta, effect.gained, effect.lost, effect.gains_most) == (1, 50.0, 1, 0, "t")


def test_choices(spark):
    texts = ['["x", null]', '{"B": "2", "A": "1"}', "A) as it is", "[]", "{}", "  ", None, "[broken", str(list(range(11)))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string").select("i", prompts.choice_block(F.col("c")).alias("b")).orderBy("i").collect()
    assert [r.b for r in rows][:8] == ["A) x\nB) ", "A. 1\nB. 2", "A) as it is", None, None, None, None, "[broken"]
    assert rows[8].b.split("\n")[9:] == ["J) 9", "11) 10"]


def test_summary_texts(spark):
    docs = spark.createDataFrame([("m", '{"tasks": {"A_B": {"accuracy": 0.5, "total": 4}, "C": {"total": null}}}'), ("n", "{broken"), ("o", None), ("p", '{"x": 1}')], "model string, value string")
    wanted = spark.createDataFrame([("m", "a-b"), ("m", "c"), ("m", "d"), ("n", "a-b"), ("o", "c")], "model string, task string")
    got = {(r.model, r.task): (r.accuracy, r.total, r.found) for r in files.summary_lookup(wanted, files.summary_entries(docs)).collect()}
    assert got == {("m", "a-b"): (0.5, 4, True), ("m", "c"): (None, 0, True), ("m", "d"): (None, 0, False), ("n", "a-b"): (None, 0, False), ("o", "c"): (None, 0, False)}
