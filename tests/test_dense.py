"""Neighbours and clusters of clouds that are dense in places, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenequarry.operators import neighbors


def _cloud(seed):
    """Even points, a knot of very close ones, a line, and a place that many share."""
    rng = np.random.default_rng(seed)
    knot = 0.3 + rng.normal(size=(150, 3)) * 1e-4
    line = np.stack([np.linspace(-1, 1, 80), np.zeros(80), np.zeros(80)], axis=1)
    return np.concatenate([rng.uniform(-1, 1, (250, 3)), knot, line, np.tile([[0.5, -0.5, 0.25]], (60, 1)), rng.uniform(5, 9, (20, 3))])


def _frame(spark, at):
    return spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate(at)], "scene_id string, id long, x double, y double, z double")


def _squares(at):
    return sum((at[:, None, c] - at[None, :, c]) ** 2 for c in range(3))


@pytest.mark.parametrize("k, radius", [(5, 0.3), (1, 0.05), (40, 0.5)])
def test_nearest_against_all_pairs(spark, k, radius):
    at = _cloud(1)
    d = _squares(at)
    want = set()
    for i in range(len(at)):
        order = sorted((d[i, j], j) for j in range(len(at)) if j != i and d[i, j] <= radius**2)
        want |= {(i, j) for _, j in order[:k]}
    got = {(r.a, r.b) for r in neighbors.nearest_pairs(_frame(spark, at).repartition(3), k, radius).collect()}
    assert got == want


def test_dense_cells_are_not_paired_with_themselves(spark):
    """20,000 points in a corner of one cell: candidates are a bounded multiple of the neighbours wanted, where all pairs would be 400 million."""
    rng = np.random.default_rng(3)
    points = _frame(spark, np.abs(rng.normal(size=(20_000, 3))) * 0.02)
    levels = neighbors._search_levels(points, 5, 0.3)
    # Candidates on the level of each point, in its own cell; there are 27 such cells around.
    own = neighbors._levelled(levels, 0.3, F.col("level"))
    cells = neighbors._candidates(points, 0.3, levels).groupBy("level", *neighbors.CELL).count()
    met = own.join(cells, ["level", *neighbors.CELL]).agg(F.sum("count")).first()[0]
    print("candidates of a point in its own cell", met / 20_000)
    assert met * 27 < 20_000 * 5 * 200
    near = neighbors.nearest_pairs(points, 5, 0.3)
    assert near.count() == 100_000


def _clusters(at, radius, least):
    near = _squares(at) <= radius**2
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(at)), -1)
    while True:
        best = np.array([min((label[j] for j in np.flatnonzero(near[i] & core)), default=-1) if core[i] else -1 for i in range(len(at))])
        if (best == label).all():
            break
        label = best
    number = {c: n for n, c in enumerate(sorted(set(label[core])))}
    return [number[label[i]] if core[i] else min((number[label[j]] for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(at))]


@pytest.mark.parametrize("radius, least, few", [(0.15, 8, 4_096), (0.15, 8, 0), (0.05, 3, 4), (2.0, 30, 4_096), (0.4, 1, 16)])
def test_clusters_against_all_pairs(spark, monkeypatch, radius, least, few):
    """Also where every pair of cells has to be split down to single points."""
    monkeypatch.setattr(neighbors, "FEW_PAIRS", max(few, 1))
    at = _cloud(2)
    got = {r.id: r.cluster for r in neighbors.density_clusters(_frame(spark, at).repartition(3), radius, least).collect()}
    assert [got[i] for i in range(len(at))] == _clusters(at, radius, least)


def test_no_points(spark):
    none = _frame(spark, np.zeros((1, 3))).limit(0)
    assert neighbors.nearest_graph(none).isEmpty() and neighbors.density_clusters(none).isEmpty()
