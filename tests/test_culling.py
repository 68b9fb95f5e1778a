"""Culling by cells loses no point and spares most pairs."""

import numpy as np
from pyspark.sql import functions as F

from scenequarry.operators import camera


def _rotation(rng):
    q, r = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    return q if np.linalg.det(q) > 0 else -q


def _cameras(spark, rng, n):
    rows = []
    for scene in ("s", "t"):
        for i in range(n):
            turn, at = _rotation(rng), rng.normal(size=3) * 4
            e = np.concatenate([turn, (-turn @ at)[:, None]], axis=1)
            rows.append((scene, i, f"f{i}", *map(float, e.ravel()), 50.0 + 3 * i, 60.0, 31.5, 20.0, 64, 40))
    names = ", ".join(f"e{r}{c} double" for r in range(3) for c in range(4))
    return spark.createDataFrame(rows, f"scene_id string, frame_ord long, frame_name string, {names}, fx double, fy double, cx double, cy double, width int, height int")


def _points(spark, rng, n):
    rows = [(s, i, *map(float, p)) for s, size in (("s", 6.0), ("t", 300.0)) for i, p in enumerate(rng.uniform(-size, size, (n, 3)))]
    return spark.createDataFrame(rows + [("alone", 1, 0.0, 0.0, 1.0), ("s", n, 1e6, 0.0, 0.0)], "scene_id string, point_idx long, x double, y double, z double")


def _every(points, cameras):
    """Each point on each camera of its scene."""
    rows = []
    for c in cameras.collect():
        e = np.array([[c[f"e{r}{k}"] for k in range(4)] for r in range(3)])
        for p in points.where(F.col("scene_id") == c.scene_id).collect():
            x, y, z = e[:, :3] @ (p.x, p.y, p.z) + e[:, 3]
            if z > camera.NEAR:
                u, v = np.rint(c.fx * x / z + c.cx), np.rint(c.fy * y / z + c.cy)
                if 0 <= u < c.width and 0 <= v < c.height:
                    rows.append((c.scene_id, c.frame_ord, p.point_idx, int(u), int(v)))
    return sorted(rows)


def test_culled_projection_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    points, cameras = _points(spark, rng, 800).repartition(3), _cameras(spark, rng, 9)
    got = sorted(tuple(r)[:5] for r in camera.project(points, cameras).collect())
    assert got == _every(points, cameras) and len(got) > 300
    assert camera.project(points.limit(0), cameras).isEmpty() and camera.project(points, cameras.limit(0)).isEmpty()


def test_pairs_spared(spark):
    """Of 20,000 points and 30 cameras that look about, a fifth of the pairs is left at most."""
    rng = np.random.default_rng(12)
    points = spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate(rng.uniform(-6, 6, (20_000, 3)))], "scene_id string, point_idx long, x double, y double, z double")
    cameras = _cameras(spark, rng, 30).where("scene_id = 's'")
    grid, seen = camera.visible_cells(points, cameras)
    before = points.count() * cameras.count()
    after = camera.point_cells(points, grid).join(seen, ["scene_id", *camera.CELL]).agg(F.sum(F.size("frames"))).first()[0]
    hits = camera.project(points, cameras, (grid, seen)).count()
    print(f"pairs before {before}, after {after}, on a frame {hits}")
    assert hits <= after <= 0.2 * before
