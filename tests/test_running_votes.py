"""Votes of the best k models against a plain revote for every k."""

from collections import Counter

import numpy as np

from plumbline.operators import votes

CELLS = "task string, model_id long, acc double"
ROWS = "task string, model_id long, idx long, pred string"
GOLD = "task string, idx long, gold string"


def revoted(rows, cells, gold, threshold):
    out = {}
    for task in {t for t, _, _ in cells}:
        order = [m for _, m, _ in sorted((c for c in cells if c[0] == task), key=lambda c: (-c[2], c[1]))]
        for k in range(1, len(order) + 1):
            n = flagged = 0
            for idx, label in ((i, g) for t, i, g in gold if t == task):
                said = [(m, p) for t, m, i, p in rows if t == task and i == idx and p is not None and m in order[:k]]
                if said:
                    count = Counter(p for _, p in said)
                    first = {p: min(m for m, q in said if q == p) for p in count}
                    winner = max(count, key=lambda p: (count[p], -first[p]))
                    n += 1
                    flagged += winner != label and count[winner] / len(said) >= threshold
            out[task, k] = (n, flagged)
    return out


def made(seed):
    rng = np.random.default_rng(seed)
    cells = [(t, m, float(rng.integers(0, 4)) / 4) for t in "ab" for m in range(7)]
    gold = [(t, i, "ABC"[int(rng.integers(3))]) for t in "ab" for i in range(40)]
    rows = [(t, m, i, [None, "A", "B", "C"][int(rng.integers(4))]) for t, i, _ in gold for m in range(8)]  # model 7 has no cell
    return rows + rows[:9], cells, gold  # some predictions come twice


def test_same_as_a_revote_for_every_k(spark):
    rows, cells, gold = made(3)
    frames = spark.createDataFrame(rows, ROWS), spark.createDataFrame(cells, CELLS), spark.createDataFrame(gold, GOLD)
    for threshold in (0.5, 0.75):
        got = {(r.task, r.k): (r.n, r.flagged) for r in votes.running_votes(*frames, threshold).collect()}
        assert got == revoted(rows, cells, gold, threshold)


def test_accepted_models_are_the_best_k(spark):
    rows, cells, gold = made(4)
    frames = spark.createDataFrame(rows, ROWS), spark.createDataFrame(cells, CELLS), spark.createDataFrame(gold, GOLD)
    want = revoted(rows, cells, gold, 0.5)
    for r in votes.acceptance(*frames, 0.5).collect():
        best = max(a for t, _, a in cells if t == r.task)
        assert r.eligible == sum(a >= r.alpha * best for t, _, a in cells if t == r.task)
        assert r.flagged == (want[r.task, r.eligible][1] if r.eligible >= 3 else None)


def test_models_and_items_without_votes(spark):
    frames = spark.createDataFrame([("a", 1, 5, None), ("a", 0, 5, "B")], ROWS), spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.2), ("c", 3, 0.1)], CELLS), spark.createDataFrame([("a", 5, "A"), ("a", 6, "A")], GOLD)
    got = {(r.task, r.k): (r.n, r.flagged) for r in votes.running_votes(*frames, 0.5).collect()}
    assert got == {("a", 1): (0, 0), ("a", 2): (1, 1), ("c", 1): (0, 0)}
    assert {(r.task, r.k) for r in votes.top_k(*frames, 0.5).collect()} == {("a", 2)}
    rates = {(r.kind, r.level, r.task): (r.flagged, r.n) for r in votes.flag_rates(*frames).collect()}
    assert rates["k", 2.0, "a"] == (1, 1) and rates["alpha", 0.5, "a"] == (None, 1) and ("alpha", 0.5, "ALL") not in rates and rates["threshold", 1.0, "ALL"] == (1, 1)


def test_predictions_stay_single_rows(spark):
    rows, cells, gold = made(5)
    frames = spark.createDataFrame(rows, ROWS), spark.createDataFrame(cells, CELLS), spark.createDataFrame(gold, GOLD)
    plan = votes.top_k(*frames, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan
