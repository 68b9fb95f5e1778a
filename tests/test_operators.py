"""Operators that SQL can't express, against small restatements and invariants."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenequarry.functions import geometry, labels
from scenequarry.operators import camera, cloud, graph, lift, merge, neighbors, room


def _points(spark, rows, scene="s"):
    return spark.createDataFrame([(scene, i, float(x), float(y), float(z), 0.5) for i, (x, y, z) in enumerate(rows)], "scene_id string, point_idx long, x double, y double, z double, conf double")


def test_thinning_is_idempotent(spark):
    rng = np.random.default_rng(1)
    points = _points(spark, rng.random((400, 3)))
    sizes = spark.createDataFrame([("s", 0.2)], "scene_id string, voxel double")
    once = cloud.thin_voxels(points, sizes)
    assert once.exceptAll(cloud.thin_voxels(once, sizes)).isEmpty() and 0 < once.count() < 400


def test_components_of_chains_and_loops(spark):
    nodes = spark.createDataFrame([("s", i) for i in range(60)], "scene_id string, node long")
    pairs = [(i, i + 1) for i in range(40)] + [(50, 51), (51, 50), (52, 52)]
    found = {r.node: r.component for r in graph.connected_components(nodes, spark.createDataFrame([("s", a, b) for a, b in pairs], "scene_id string, a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[51] == 50 and found[52] == 52 and found[59] == 59


def test_density_clusters(spark):
    rng = np.random.default_rng(2)
    rows = np.concatenate([rng.normal(0, 0.03, (60, 3)), rng.normal(3, 0.03, (60, 3)), [[9, 9, 9]]])
    df = _points(spark, rows).withColumnRenamed("point_idx", "id")
    found = {r.id: r.cluster for r in neighbors.density_clusters(df, 0.15, 10).collect()}
    near = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(axis=2)) <= 0.15
    assert {found[i] for i in range(60) if near[i].sum() >= 10} == {0} and {found[i] for i in range(60, 120) if near[i].sum() >= 10} == {1} and found[120] == -1


def test_nearest_graph(spark):
    rows = np.random.default_rng(3).random((150, 3))
    found = {(r.a, r.b) for r in neighbors.nearest_graph(_points(spark, rows).withColumnRenamed("point_idx", "id")).collect()}
    d2 = ((rows[:, None] - rows[None]) ** 2).sum(axis=2)
    expected = set()
    for i in range(len(rows)):
        near = sorted((d2[i, j], j) for j in range(len(rows)) if j != i and d2[i, j] <= 0.09)[:5]
        expected |= {(min(i, j), max(i, j)) for _, j in near}
    assert found == expected


def test_geometric_median(spark):
    rng = np.random.default_rng(4)
    rows = np.concatenate([rng.normal(0, 0.1, (100, 3)), np.full((5, 3), 50.0)])
    df = _points(spark, rows).withColumn("w", F.lit(1.0))
    got = lift.geometric_median(df, ["scene_id"]).first()
    x = rows.mean(axis=0)
    for _ in range(12):
        q = 1 / np.maximum(np.linalg.norm(rows - x, axis=1), 1e-7)
        x = (q[:, None] * rows).sum(axis=0) / q.sum()
    assert np.allclose([got.x, got.y, got.z], x, atol=1e-6) and abs(got.x) < 0.5


def test_occlusion(spark):
    front = [(x / 50, y / 50, 1.0) for x in range(-5, 6) for y in range(-5, 6)]
    wall = [(x / 10, y / 10, 2.0) for x in range(-10, 11) for y in range(-10, 11)]
    points = _points(spark, front + wall)
    cam = spark.createDataFrame([("s", 0, "f", 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 100.0, 100.0, 50.0, 50.0, 100, 100)], "scene_id string, frame_ord long, frame_name string, e00 double, e01 double, e02 double, e03 double, e10 double, e11 double, e12 double, e13 double, e20 double, e21 double, e22 double, e23 double, fx double, fy double, cx double, cy double, width int, height int")
    seen = camera.project(points, cam)
    eps = spark.createDataFrame([("s", 0.1)], "scene_id string, epsilon double")
    ids = {r.point_idx for r in lift.visible(seen, camera.spread_foreground(camera.zbuffer(seen), cam), eps).collect()}
    behind = {len(front) + i for i, (x, y, _) in enumerate(wall) if abs(x) <= 0.1 and abs(y) <= 0.1}
    assert set(range(len(front))) <= ids and not behind & ids


def test_quaternion_turns_axes_back(spark):
    rng = np.random.default_rng(5)
    q = rng.normal(size=(50, 4))
    q /= np.linalg.norm(q, axis=1)[:, None]
    w, x, y, z = q.T
    m = np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], axis=1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in m], [f"m{i}" for i in range(9)])
    got = np.array(df.select(*geometry.matrix_to_quaternion([[F.col(f"m{3 * i + j}") for j in range(3)] for i in range(3)])).collect())
    assert np.allclose(np.abs((got * q).sum(axis=1)), 1, atol=1e-6)


def test_footprint_has_no_holes(spark):
    ring = [(x / 20, 0.0, z / 20) for x in range(40) for z in range(40) if not (12 < x < 28 and 12 < z < 28)]
    points = _points(spark, ring * 6)
    grid = room.grids(points)
    cells = {(r.cx, r.cz) for r in room.room_mask(points, grid).collect()}
    assert (20, 20) in cells and len(cells) >= 38 * 38


def test_greedy_suppression(spark):
    rows = [("s", 0, 0, 0, 0, 10, 10, 0.9), ("s", 1, 0, 1, 0, 10, 10, 0.8), ("s", 2, 0, 2, 0, 10, 10, 0.7), ("s", 3, 1, 0, 0, 10, 10, 0.1)]
    df = spark.createDataFrame(rows, "scene_id string, mask_ord long, frame_ord long, left int, top int, wide int, high int, confidence double")
    # 1 overlaps 0 and goes; 2 overlaps only 1, which isn't kept.
    assert sorted(r.mask_ord for r in lift.suppress_masks(df, 0.8).collect()) == [0, 2, 3]


def test_near_duplicates_of_objects(spark):
    rows = [("s", 0, 0.0, "red chair"), ("s", 1, 0.59, "Chair"), ("s", 2, 1.2, "chair"), ("s", 3, 0.1, "lamp")]
    df = spark.createDataFrame(rows, "scene_id string, id long, x double, label string").withColumn("y", F.lit(0.0)).withColumn("z", F.lit(0.0))
    assert {(r.a, r.b) for r in neighbors.similar_neighbours(df).collect()} == {(0, 1)}


def test_labels(spark):
    df = spark.createDataFrame([("```json\n{\"a\": {\"label\": \"cup\", \"confidence\": 0.5, \"alternatives\": [\"mug\"]}}\n```",), ("no",)], "t string")
    assert [r.n for r in df.select(F.size(labels.parse_labels(F.col("t"))).alias("n")).collect()] in ([1, -1], [1, None])
    assert df.select(F.size(labels.parse_proposals(F.col("t"))).alias("n")).where("n > 0").isEmpty()


def test_join_labels(spark):
    clusters = spark.createDataFrame([("s", c) for c in "abcd"], "scene_id string, id string")
    given = spark.createDataFrame([("s", "a", " NONE ", 1.0, None), ("s", "b", "cup", 0.5, ["duplicate_of:a"]), ("s", "c", "cup", 0.5, ["x", "duplicate_of:a"])], "scene_id string, id string, label string, confidence double, alternatives array<string>")
    assert {(r.id, r.label) for r in merge.join_labels(clusters, given).collect()} == {("c", "cup"), ("d", "unknown")}


def test_flip_twice_is_nothing(spark):
    lo, hi = geometry.flip_box(*geometry.flip_box([F.lit(float(i)) for i in (0, 1, 2)], [F.lit(float(i)) for i in (3, 4, 5)]))
    assert list(spark.range(1).select(*lo, *hi).first()) == [0, 1, 2, 3, 4, 5]


def test_ply_round_trip(spark, tmp_path):
    from scenequarry.sources.ply import read_ply

    rows = [(float(i), i * 2.0, -float(i), i % 256, 7, 9, i / 1000) for i in range(1000)]
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 1000\n" + "".join(f"property float {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue")) + "property float confidence\nend_header\n"
    for name, n in (("one", 1000), ("none", 0)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "points.ply").write_bytes(head.replace("1000", str(n)).encode() + b"".join(struct.pack("<3f3Bf", *r) for r in rows[:n]))
    df = read_ply(spark, f"{tmp_path}/*/points.ply")
    got = {r.point_idx: r for r in df.collect()}
    assert len(got) == 1000 and got[999].y == 1998.0 and got[999].red == 231.0 and got[5].opacity is None and got[5].scene_id == "one"


def test_documents(spark, tmp_path):
    from scenequarry.sources import documents as d

    one = tmp_path / "one"
    one.mkdir()
    (one / "manifest.json").write_text('{"scene_id": "one", "created_at": "2026-01-02T03:04:05Z", "status": "ready", "stages": {"capture": {"status": "complete", "duration_s": 1.5, "method": "x"}, "poses": {"status": "pending"}, "splat": {"status": "pending"}, "segmentation": {"status": "odd"}}, "errors": []}')
    (one / "annotations.json").write_text('{"annotations": [{"id": "a", "label": "cup", "centroid": [1, 2, 3], "bbox": [[0, 0, 0], [2, 2, 2]], "confidence": 0.5, "color": "#fff"}]}')
    (one / "cameras.json").write_text('[{"extrinsic": []}, {"frame": "f.jpg", "extrinsic": [[1,0,0,4],[0,1,0,5],[0,0,1,6]], "intrinsic": [[9,0,1],[0,8,2],[0,0,1]]}]')
    (one / "capture.yaml").write_text("scene_id: one\nsource_video: v.mp4\nduration_s: 3.5\nfps: 15.0\nframe_count: 9\nresolution:\n- 640\n- 480\ncamera_model: pinhole\nfov_deg: null\ncaptured_at: 2026-01-02T03:04:05Z\n")
    assert d.read_manifests(spark, f"{tmp_path}/*/manifest.json").first().stage_extra["capture"]["method"] == "x"
    assert d.manifest_stages(d.read_manifests(spark, f"{tmp_path}/*/manifest.json")).count() == 4
    a = d.read_annotations(spark, f"{tmp_path}/*/annotations.json").first()
    assert (a.id, a.x, a.hi_z, a.frame_ids) == ("a", 1.0, 2.0, [])
    c = d.read_cameras(spark, f"{tmp_path}/*/cameras.json").collect()
    assert [(r.frame_ord, r.e13, r.fy) for r in c] == [(1, 5.0, 8.0)]
    y = d.read_captures(spark, f"{tmp_path}/*/capture.yaml").first()
    assert (y.resolution, y.fps, y.fov_deg, y.camera_model) == ([640, 480], 15.0, None, "pinhole")
    assert [r.scene_id for r in d.list_scenes(spark, str(tmp_path)).collect()] == ["one"]
    assert {r.artifact: (r.ok, r.reason) for r in d.validate_corpus(spark, str(tmp_path)).collect()} == {"manifest": (False, "stage status"), "annotations": (True, ""), "capture": (True, "")}


def test_write_scene_replaces_one(spark, tmp_path):
    from scenequarry.sources.versions import read_scene, write_scene

    where = str(tmp_path / "t")
    write_scene(spark.createDataFrame([("a", 1), ("b", 1)], "scene_id string, v int"), where)
    write_scene(spark.createDataFrame([("b", 2)], "scene_id string, v int"), where)
    assert {(r.scene_id, r.v) for r in read_scene(spark, where).collect()} == {("a", 1), ("b", 2)}


def test_deep_span_forest(spark):
    """No level is lost, however deep; a guard raises."""
    spans = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "span_id long, parent_span_id long")
    got = {r.span_id: r.depth for r in graph.span_forest(spans).collect()}
    assert got == {i: i for i in range(40)}
    with pytest.raises(RuntimeError):
        graph.span_forest(spans, max_depth=20)


def test_geometric_medians_of_large_groups(spark):
    """The pass over a group and the steps over all give the same."""
    rng = np.random.default_rng(4)
    rows = [(k, *map(float, p), float(w)) for k in range(3) for p, w in zip(rng.normal(k, 1, (200, 3)), rng.random(200))]
    points = spark.createDataFrame(rows, "k int, x double, y double, z double, w double")
    one, many = ({r.k: (r.x, r.y, r.z) for r in lift.geometric_median(points, ["k"], most=n).collect()} for n in (10**6, 10))
    assert all(np.allclose(one[k], many[k], atol=1e-6) for k in range(3))


def test_boxes_and_rays_against_brute_force(spark):
    rng = np.random.default_rng(5)
    points = [("s", i, *map(float, rng.uniform(-3, 3, 3))) for i in range(800)]
    boxes = [("s", i, *map(float, lo), *map(float, lo + size)) for i, (lo, size) in enumerate(zip(rng.uniform(-3, 2, (40, 3)), rng.uniform(0, [0.3, 1, 5], (40, 3))))]
    p = spark.createDataFrame(points, "scene_id string, point_idx long, x double, y double, z double")
    b = spark.createDataFrame(boxes, "scene_id string, box_id long, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double")
    want = {(j, i) for _, i, *at in points for _, j, *ends in boxes if all(ends[k] <= at[k] <= ends[k + 3] for k in range(3))}
    assert {(r.box_id, r.point_idx) for r in neighbors.points_in_boxes(p, b).collect()} == want and want
    rays = []
    for i in range(60):
        o, d = rng.uniform(-4, 4, 3), rng.normal(0, 1, 3)
        d = np.array([0.0, 0.0, 1.0]) if i % 7 == 0 else d / np.linalg.norm(d)
        rays.append(("s", i, *map(float, o), *map(float, d)))
    r = spark.createDataFrame(rays, "scene_id string, ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    best = {}
    for _, i, *ray in rays:
        o, d = np.array(ray[:3]), np.array(ray[3:])
        hits = [(t, j) for _, j, *at in points for rel in [np.array(at) - o] for t in [rel @ d] if t > 0 and rel @ rel - t * t <= 0.3**2]
        if hits:
            best[i] = min(hits)[1]
    assert {x.ray_id: x.point_idx for x in neighbors.pick_points(p, r, 0.3).collect()} == best and best


def test_merged_clusters(spark):
    """Near clusters with similar phrases become one, with the geometry of their points; others stay as they are."""
    rng = np.random.default_rng(6)
    centres = [(0.0, 0.0, 0.0), (0.3, 0.0, 0.0), (0.5, 0.0, 0.0), (9.0, 0.0, 0.0)]
    phrases, areas = ["red office chair", "office chair", "green lamp", "red office chair"], [10, 30, 20, 5]
    rows = [("s", i, f"c{i}", *c, *(x - 1 for x in c), *(x + 1 for x in c), areas[i], phrases[i], ["sam" if i % 2 else "vlm"], [f"f{i}"]) for i, c in enumerate(centres)]
    schema = "scene_id string, ordinal long, id string, x double, y double, z double, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double, anchor_area long, phrase string, sources array<string>, frame_ids array<string>"
    points = [("s", 100 * i + j, *map(float, np.array(c) + rng.normal(0, 0.1, 3))) for i, c in enumerate(centres) for j in range(50)]
    cloud_ = spark.createDataFrame(points, "scene_id string, point_idx long, x double, y double, z double")
    members = spark.createDataFrame([("s", i // 100, i) for _, i, *_ in points], "scene_id string, ordinal long, point_idx long")
    got = {r.ordinal: r for r in merge.merge_clusters(spark.createDataFrame(rows, schema), members, cloud_).collect()}
    assert set(got) == {0, 2, 3}
    one = got[0]
    assert (one.id, one.n_merged, one.anchor_area, one.phrase, one.sources, one.frame_ids) == ("c1", 2, 30, "office chair", ["sam", "vlm"], ["f0", "f1"])
    at = np.array([p[2:] for p in points if p[1] < 200])
    mid = at.mean(axis=0)
    for _ in range(12):
        w = 1 / np.maximum(np.linalg.norm(at - mid, axis=1), 1e-7)
        mid = (w[:, None] * at).sum(axis=0) / w.sum()
    assert np.allclose((one.x, one.y, one.z), mid, atol=1e-6) and np.allclose((one.lo_x, one.hi_x), np.percentile(at[:, 0], [5, 95]))
    assert (got[3].x, got[3].lo_x, got[3].hi_x, got[3].n_merged) == (9.0, 8.0, 10.0, 1) and got[2].phrase == "green lamp"
