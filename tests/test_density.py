"""Neighbour graphs and density clusters against brute force and planted clusters; components that shrink."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import density, graphs


def as_table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


@pytest.fixture(scope="module")
def planted():
    """Four clusters of unequal density and noise, in 24 dimensions."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(4, 24))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    label = rng.integers(-1, 4, 1600)
    spread = np.array([0.02, 0.035, 0.05, 0.07])
    near = centers[np.maximum(label, 0)] + rng.normal(size=(1600, 24)) * spread[np.maximum(label, 0)][:, None]
    return np.where(label[:, None] >= 0, near, rng.normal(size=(1600, 24))), label


def nearest_brute(x, k):
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    d = 2 - 2 * u @ u.T
    np.fill_diagonal(d, 9)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def test_neighbours_are_found(spark, planted):
    x, _ = planted
    want = nearest_brute(x, 15)
    got = {r.vec_id: r.near for r in density.neighbours(as_table(spark, x)).collect()}
    assert len(got) == len(x) and all(len(n) == 15 and [p.d for p in n] == sorted(p.d for p in n) and i not in {p.id for p in n} for i, n in got.items())
    assert np.mean([len({p.id for p in got[i]} & set(want[i].tolist())) / 15 for i in range(len(x))]) > 0.9
    rough = {r.vec_id: r.near for r in density.neighbours(as_table(spark, x), tables=2, rounds=0, chunk=64).collect()}
    better = {r.vec_id: r.near for r in density.neighbours(as_table(spark, x), tables=2, rounds=1, chunk=64).collect()}
    recall = lambda g: np.mean([len({p.id for p in g[i]} & set(want[i].tolist())) / 15 for i in range(len(x))])
    assert recall(better) > recall(rough) + 0.1


def test_few_neighbours_are_exact(spark, planted):
    x = planted[0][:300]
    want = nearest_brute(x, 15)
    got = {r.vec_id: {p.id for p in r.near} for r in density.neighbours(as_table(spark, x)).collect()}
    assert [got[i] for i in range(300)] == [set(w.tolist()) for w in want]


def test_planted_clusters_and_noise(spark, planted):
    x, label = planted
    got = {r.vec_id: r.cluster for r in density.density_clusters(as_table(spark, x), min_size=20).collect()}
    seen = {c: collections.Counter(got[i] for i in np.flatnonzero(label == c).tolist()) for c in range(-1, 4)}
    assert seen[-1][-1] >= 0.95 * sum(seen[-1].values())
    main = [seen[c].most_common(1)[0] for c in range(4)]
    assert len({m[0] for m in main} - {-1}) == 4 and all(m[1] >= 0.85 * sum(seen[c].values()) for c, m in enumerate(main))


def test_one_task_and_many_agree(spark):
    """The last levels by one task, or every level by joins: the same clusters."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, s, (25, 2)) for c, s in ((0, 0.1), (3, 0.3), (6, 0.05), (6.5, 0.05))])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    pairs = [(i, int(j), float(d[i, j])) for i in range(len(x)) for j in np.argsort(d[i])[1:6] if i < j or i not in np.argsort(d[int(j)])[1:6]]
    points, edges = spark.range(len(x)).withColumnRenamed("id", "vec_id"), spark.createDataFrame(pairs, "a long, b long, w double")
    edges = edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w"))
    one = {r.vec_id: r.cluster for r in density.condensed(points, edges, 8, 4).collect()}
    many = {r.vec_id: r.cluster for r in density.condensed(points, edges, 8, 4, finish=0).collect()}
    assert one == many and len(set(one.values()) - {-1}) >= 3


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [0.0, 0.0]), (4, []), (5, [0.5, 0.5])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label string")
    assert sorted((r.vec_id is None, r.vec_id, r.cluster) for r in density.density_clusters(table).collect() if r.vec_id) == [(False, i, -1) for i in (1, 1, 2, 3, 4, 5)]
    assert density.density_clusters(table.limit(0)).count() == 0
    same = as_table(spark, np.ones((40, 3)))
    assert density.density_clusters(same, min_size=5).count() == 40


@pytest.mark.parametrize("finish", [8, 1 << 19])
def test_components_shrink_and_finish(spark, finish):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(200, i) for i in range(201, 260)]
    loose = [(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2))]
    parent = list(range(300))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in chain + hub + loose:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.label for r in graphs.components(spark.range(300), spark.createDataFrame(chain + hub + loose, "a long, b long"), finish).collect()}
    assert got == {i: root(i) for i in range(300)}


def test_a_pair_has_one_distance(spark, planted):
    """Whoever else is compared, so that no neighbour is listed twice and none is ranked by rounding; equal distances by id."""
    x = planted[0].astype(np.float32)
    x = np.concatenate([x[:300], x[:40], x[:40] * np.float32(3)])
    ids = np.arange(len(x)) * 7 % len(x)
    d, who = density.nearest(x, ids, 15)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = {(ids[i], ids[j]): 2 - 2 * (unit[i] * unit[j]).sum() for i in range(len(x)) for j in range(len(x)) if i != j}
    for i in range(len(x)):
        mine = sorted((max(v, 0) ** 0.5, b) for (a, b), v in true.items() if a == ids[i])[:15] if i % 29 == 0 else None
        assert mine is None or mine == list(zip(d[i].tolist(), who[i].tolist(), strict=True))
    rng, seen = np.random.default_rng(1), {}
    for size in (len(x), 301, 77, 33):
        some = rng.permutation(len(x))[:size]
        d, who = density.nearest(x[some], ids[some], 15)
        for i, a in enumerate(ids[some]):
            for b, v in zip(who[i], d[i], strict=True):
                assert seen.setdefault((min(a, b), max(a, b)), v) == v
    got = density.neighbours(as_table(spark, planted[0]), chunk=128, tables=4, rounds=1).collect()
    assert all(len({p.id for p in r.near}) == len(r.near) for r in got)
