"""Principal components by all three ways against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import correlation

CELLS = "task string, model_id long, acc double"


def table(rng, tasks, models, rank=3):
    x = rng.normal(size=(tasks, rank)) * np.array([3.0, 2.0, 1.2])[:rank] @ rng.normal(size=(rank, models)) + 0.3 * rng.normal(size=(tasks, models))
    return x


def expected(x, k):
    z = (x - x.mean(0)) / x.std(0)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    signs = np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])
    return (s**2 / (s**2).sum())[:k], (v * signs[:, None])[:k]


@pytest.mark.parametrize(("small", "tasks", "models"), [(40, 50, 30), (40, 30, 50), (20, 50, 40)], ids=["models", "tasks", "iterated"])
def test_same_as_numpy(spark, small, tasks, models):
    x = table(np.random.default_rng(7), tasks, models)
    cells = spark.createDataFrame([(f"t{i:03}", j, float(x[i, j])) for i in range(tasks) for j in range(models)], CELLS)
    _, shares, vectors = correlation.components(cells, 3, small)
    want_shares, want_loadings = expected(x, 3)
    assert np.allclose(shares, want_shares, atol=1e-7)
    loadings = {r.model_id: r.v for r in correlation.signed(vectors, 3).collect()}
    assert len(loadings) == models and all(np.allclose(loadings[j], want_loadings[:, j], atol=1e-4) for j in range(models))


def test_twenty_thousand_models(spark):
    n, tasks = 20_000, 24
    rows = spark.range(n).select(F.col("id").alias("model_id"), F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("t"))
    noise = lambda *of: F.xxhash64(*of) / F.lit(2.0**63)
    cells = rows.select(F.concat(F.lit("t"), F.col("t").cast("string")).alias("task"), "model_id", (noise(F.lit("m"), "model_id") * noise(F.lit("t"), "t") + 0.1 * noise("model_id", "t")).alias("acc"))
    found = cells.toPandas()
    wide = np.zeros((tasks, n))
    wide[found["task"].str[1:].astype(int), found["model_id"]] = found["acc"]
    want, loadings = expected(wide, 2)
    _, shares, vectors = correlation.components(cells, 2)
    assert np.allclose(shares, want, atol=1e-9)
    got = correlation.signed(vectors, 2).toPandas().sort_values("model_id")
    assert len(got) == n and np.allclose(np.stack(got["v"].to_list())[:, 0], loadings[0], atol=1e-6)


def test_constant_missing_and_empty(spark):
    rows = [("a", 1, 0.5), ("b", 1, 0.5), ("c", 1, 0.5), ("a", 2, 0.1), ("b", 2, 0.4), ("c", 2, None), ("a", 3, 0.9), ("b", 3, 0.2), ("c", 3, 0.4), ("d", 2, None), ("a", 9, None)]
    cells = spark.createDataFrame(rows, CELLS)
    loadings = {(r.model_id, r.component): r.loading for r in correlation.component_loadings(cells, 2).collect()}
    assert {m for m, _ in loadings} == {1, 2, 3} and abs(loadings[1, 1]) < 1e-9  # a constant model has no part, one without values no row
    scores = {(r.task, r.component): r.score for r in correlation.component_scores(cells, 2).collect()}
    assert {t for t, _ in scores} == {"a", "b", "c", "d"} and scores["d", 1] == 0
    assert correlation.principal_components(cells.where("false"), 2).count() == 0 and correlation.component_scores(cells.where("false"), 2).count() == 0


def test_too_many_components_for_two_large_sides(spark):
    cells = spark.createDataFrame([(f"t{i}", j, float(i * j % 7)) for i in range(4) for j in range(4)], CELLS)
    with pytest.raises(ValueError, match="at most"):
        correlation.components(cells, 65, small=3)
