"""What a review of larger and other tables found."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenequarry.llm import components
from scenequarry.operators import camera, graph, lift, neighbors, questions, scenes
from scenequarry.operators.stored import stored
from scenequarry.plans import registry, source_queries, views
from scenequarry.sources import documents
from scenequarry.plans.views import view

DATA = "/root/testdata/sf0.001"


def test_ordinals_of_more_than_53_bits_pass_through_ply(spark, tmp_path):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").limit(300).withColumn("l_orderkey", F.col("l_orderkey") + 900_001)
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = registry.queries()["s1_ply_points"](spark, str(tmp_path))
    assert sorted(r.ident for r in got.collect()) == sorted(r.point_idx for r in view(spark, str(tmp_path), "points").collect())


def test_stream_of_a_table_in_parts(spark, tmp_path):
    calls = spark.read.parquet(f"{DATA}/conversations.parquet")
    calls.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = registry.queries()["t4_running_scene_cost"](spark, str(tmp_path))
    assert sum(r.call_count for r in got.collect()) == calls.count()


def test_packed_tables_are_not_broadcast_unasked(spark):
    """20,000 equal rows are a few hundred bytes as a file; an operator may multiply them."""
    table = stored(spark.range(20_000).select((F.col("id") % 3).alias("scene_id"), F.lit(1.5).alias("x")))
    other = stored(spark.range(30_000).select((F.col("id") % 3).alias("scene_id"), "id"))
    plan = table.join(other, "scene_id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_tasks_of_a_view_do_not_grow_with_it(spark, monkeypatch):
    monkeypatch.setattr(views, "TASK_ROWS", 500)
    sizes = view(spark, DATA, "points").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) <= 520


def test_equal_points_and_masks_are_counted_once_and_given_whole(spark):
    points = spark.createDataFrame([("s", i, float(i % 2), 0.0, 1.0) for i in range(80)], "scene_id string, point_idx long, x double, y double, z double")
    masks = spark.createDataFrame([("s", m, 0, left, 0, 2, 2) for m, left in ((3, 0), (5, 0), (8, 0), (9, 1))], "scene_id string, mask_ord long, frame_ord long, left int, top int, wide int, high int")
    at, shapes = lift.places(points), lift.mask_shapes(masks)
    assert sorted(tuple(r) for r in at.select("point_idx", "n").collect()) == [(0, 40), (1, 40)]
    seen = at.select("scene_id", F.lit(0).cast("long").alias("frame_ord"), "point_idx", F.col("x").cast("int").alias("u"), F.lit(0).alias("v"), "n")
    members = stored(lift.rectangle_membership(seen, lift.distinct_shapes(masks, shapes)))
    assert sorted((r.mask_ord, r.point_idx) for r in members.collect()) == [(3, 0), (3, 1), (9, 1)]
    alone = members.groupBy("scene_id", "mask_ord").agg(F.sum("n").alias("shared"))
    got = {(r.a, r.b): r.shared for r in lift.pairs_of_masks(lift.shared_points(members), alone, shapes).collect()}
    assert got == {(3, 5): 80, (3, 8): 80, (5, 8): 80, (3, 9): 40, (5, 9): 40, (8, 9): 40}


def test_a_point_is_copied_to_few_cells(spark):
    """All 27 cells around each point were written before; five or so of three radii are."""
    points = spark.range(4_000).select(F.lit("s").alias("scene_id"), "id", *[(F.rand(i) * 20).alias(c) for i, c in enumerate("xyz")])
    around = neighbors._celled_around(points, neighbors.GRAIN * 0.5, 0.5).count()
    assert 4_000 < around < 6 * 4_000


def test_documents_are_written_by_tasks(spark, tmp_path):
    texts = spark.createDataFrame([("a", "one"), ("b", "two"), ("no.scene", None)], "scene_id string, value string").repartition(3)
    documents.write_documents(texts, f"file://{tmp_path}/corpus", "manifest.json")
    documents.write_documents(texts, f"file://{tmp_path}/corpus", "manifest.json")
    assert {p.parent.name: p.read_text() for p in (tmp_path / "corpus").glob("*/manifest.json")} == {"a": "one\n", "b": "two\n", "no.scene": "\n"}
    assert sorted(r.scene_id for r in documents.list_scenes(spark, f"file://{tmp_path}/corpus").collect()) == ["a", "b"]


def test_a_round_of_components_takes_two_shuffles_where_labels_are_few(spark, monkeypatch):
    """Seven were taken before; both ways give the same components."""
    plans = []

    def store(df, name):
        if name == "cc-labels":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(components, "store", store)
    edges = spark.range(4_000).select("id", F.pmod(F.xxhash64("id"), F.lit(4_000)).alias("to")).where("id % 3 != 0").union(spark.range(5_000, 5_200).selectExpr("id", "id + 1"))
    edges = edges.select(F.col("id").alias("a"), F.col("to").alias("b"))
    found = sorted(tuple(r) for r in components.components(edges).collect())
    assert len(plans) > 2 and all(p.count("Exchange hashpartitioning") <= 2 for p in plans[1:])
    assert found == sorted(tuple(r) for r in components.components(edges, most=0).collect())
    root = {}
    for a, b in edges.collect():
        for x in (a, b):
            root.setdefault(x, x)
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)

    def least(x):
        while root[x] != x:
            x = root[x]
        return x

    assert all(component == least(i) for i, component in found)


def test_objects_of_ids_are_counted_before_they_are_joined(spark, monkeypatch):
    """The first object of each id was an aggregate over a packed file, which a join could broadcast by the file's size."""
    names = []
    monkeypatch.setattr(questions, "stored", lambda df, name="table": names.append(name) or stored(df, name))
    objects = spark.createDataFrame([("s", 2, "obj_1", "chair"), ("s", 1, "OBJ_1", "table")], "scene_id string, ordinal long, id string, label string")
    asked = spark.createDataFrame([(1, "s", " Obj_1 "), (2, "s", "lamp"), (3, "s", "hair")], "request_id long, scene_id string, needle string")
    assert {r.request_id: r.hit and r.hit.ordinal for r in questions.resolve_objects(asked, objects).collect()} == {1: 1, 2: None, 3: 2}
    assert "ids" in names


def test_steps_of_a_walk_are_flat(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(graph, "stored", lambda df, name="table": kept.append((name, df.schema)) or stored(df, name))
    forest = spark.createDataFrame([(1, None, 1), (2, 1, 1), (10, 1, 1), (3, 2, 1), (7, 7, 7)], "span_id long, parent_span_id long, root_id long")
    assert {r.span_id: r.place for r in graph.preorder(forest).collect()} == {1: 1, 2: 2, 3: 3, 10: 4, 7: 1}
    assert all("struct" not in f.dataType.simpleString() for name, schema in kept if name == "walk" for f in schema)


def test_trimmed_points_are_computed_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(lift, "stored", lambda df, name="table": names.append(name) or stored(df, name))
    points = spark.range(60).select(F.lit("s").alias("scene_id"), F.lit(1).alias("track"), F.col("id").alias("point_idx"), *[F.when(F.col("id") == 59, 90.0).otherwise(F.col("id") % 7 / 10).alias(c) for c in "xyz"])
    assert 59 not in {r.point_idx for r in lift.trim_outliers(points).collect()}
    assert names[0] == "trim-points"


def test_files_of_scenes_are_written_by_tasks_and_read_from_their_folders_alone(spark, tmp_path, monkeypatch):
    """They were renamed one by one by the driver, which also expanded the glob."""
    monkeypatch.setattr(source_queries, "_folder", lambda df, name: f"file://{tmp_path}/docs")
    glob = source_queries._files(spark.createDataFrame([("a", "one"), ("b", "two")], "scene_id string, value string"), "notes")
    assert {f.relative_to(tmp_path / "docs").parts[0] for f in (tmp_path / "docs").rglob("*.txt")} == {"a", "b"}
    (tmp_path / "docs" / "a" / "below").mkdir()
    (tmp_path / "docs" / "a" / "below" / "notes.txt").write_text("no")
    assert sorted((r.scene_id, r.value) for r in documents._texts(spark, glob).collect()) == [("a", "one\n"), ("b", "two\n")]


def _shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for i in range(blocks.size()) if (name := blocks.apply(i).name()).startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    """They stayed until the driver collected its garbage: the sum of all steps."""
    before = _shuffle_files(spark)
    assert stored(spark.range(5_000).repartition(5).groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    # Counting the table has a shuffle of one row a task; the write's own are gone.
    left = {name for name in _shuffle_files(spark) - before if name.endswith(".data")}
    assert len({name.split("_")[1] for name in left}) <= 2
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def _scenes(spark):
    """Scenes of even, equal, close and lone points on a lattice of ties, one with an id twice, one without a place."""
    rng = np.random.default_rng(5)
    rows = []
    for scene, n in (("a", 400), ("b", 300), ("c", 1)):
        at = np.round(rng.uniform(-1, 1, (n, 3)), 1)
        at[: n // 10] = at[0]
        rows += [(scene, int(i) * 7, *map(float, p)) for i, p in zip(rng.permutation(n), at, strict=True)]
    rows += [("twice", i % 20, *map(float, rng.uniform(0, 0.5, 3))) for i in range(22)]
    return spark.createDataFrame(rows, "scene_id string, id long, x double, y double, z double").repartition(3)


@pytest.mark.parametrize("pairs", [1 << 22, 3_000])
def test_few_points_of_a_scene_are_one_task_and_more_go_by_cells(spark, monkeypatch, pairs):
    """Both ways give the same; the first deals the points once, where fourteen shuffles were taken."""
    monkeypatch.setattr(scenes.near_in_scene, "__defaults__", (pairs,))
    points = _scenes(spark)
    for run in (lambda keep: neighbors.nearest_graph(points, 5, 0.3, keep), lambda keep: neighbors.density_clusters(points, 0.25, 6, keep)):
        tasks, cells = run(65_536), run(0)
        assert sorted(tuple(r) for r in tasks.collect()) == sorted(tuple(r) for r in cells.collect())
        assert tasks.schema.simpleString() == cells.schema.simpleString()
    one = points.where("scene_id != 'twice'")
    if pairs > 3_000:
        for found in (neighbors.nearest_graph(one), neighbors.density_clusters(one)):
            assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_wireframe_deals_its_points_once(spark):
    """Points were dealt by voxels, by ids and by cells; both ways give the same."""
    points = _scenes(spark).withColumnRenamed("id", "point_idx")
    boxes = spark.createDataFrame([("a", "m", *[-0.5] * 3, *[0.4] * 3), ("a", "n", *[0.0] * 3, *[2.0] * 3), ("none", "m", *[0.0] * 3, *[1.0] * 3)], "scene_id string, box_id string, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double")
    tasks, cells = (neighbors.wireframe(points, boxes, 0.25, 30, 3, 0.4, keep) for keep in (65_536, 0))
    assert sorted(tuple(r) for r in tasks.collect()) == sorted(tuple(r) for r in cells.collect())
    one = neighbors.wireframe(points.where("scene_id != 'twice'"), boxes)
    assert not one.isEmpty() and "Exchange" not in one._jdf.queryExecution().executedPlan().toString()


def test_projected_points_are_not_shuffled_where_images_are_small(spark, monkeypatch):
    rng = np.random.default_rng(8)
    points = spark.createDataFrame([(s, i, *map(float, p)) for s in "ab" for i, p in enumerate(rng.uniform(-1, 1, (500, 3)) + [0, 0, 3])], "scene_id string, point_idx long, x double, y double, z double")
    one = {f"e{r}{c}": float(r == c) for r in range(3) for c in range(4)}
    cams = spark.createDataFrame([{"scene_id": s, "frame_ord": f, "frame_name": "f", **one, "e03": f * 0.3, "fx": 20.0, "fy": 20.0, "cx": 9.0, "cy": 6.0, "width": 18, "height": 12} for s in "ab" for f in range(2)])
    tolerance = spark.createDataFrame([("a", 0.1), ("b", 0.02)], "scene_id string, epsilon double")
    at = stored(lift.places(points, ids=F.col("point_idx") % 7))
    projected = camera.project(at, cams)
    seen = lift.in_foreground(projected, cams, tolerance)
    assert "Exchange hashpartitioning" not in seen._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(camera, "BROADCAST_BYTES", 0)
    shuffled = lift.in_foreground(projected, cams, tolerance).select(*seen.columns)
    assert 0 < seen.count() < projected.count() and sorted(tuple(r) for r in seen.collect()) == sorted(tuple(r) for r in shuffled.collect())
    assert at.agg(F.sum("ids")).first()[0] == sum(i % 7 for i in range(500)) * 2


def test_points_that_are_only_counted_are_read_as_they_are(spark):
    """A view of one file was dealt to all tasks anew in every pass over it."""
    plan = view(spark, DATA, "points", spread=False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "Exchange" in view(spark, DATA, "points")._jdf.queryExecution().executedPlan().toString()


def test_pixels_of_masks_are_not_shuffled(spark, monkeypatch):
    """A file of masks was one task, and its pixels were dealt twice."""
    monkeypatch.setattr(lift, "TASK_MASKS", 3)
    masks = spark.createDataFrame([("s", m % 2, m) for m in range(40)], "scene_id string, frame_ord long, mask_ord long").coalesce(1)
    dealt = lift.by_mask(masks)
    assert dealt.rdd.getNumPartitions() == 14
    # Some pixels are there twice, and a hole parts a row.
    pixels = dealt.withColumn("u", F.explode(F.array(*[F.lit(u) for u in (4, 5, 5, 7, 1, 4)]))).withColumn("v", F.explode(F.array(F.lit(0), F.lit(3))))
    runs = lift.mask_runs(pixels)
    assert runs._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(tuple(r)[2:] for r in runs.where("mask_ord = 7").collect()) == [(7, v, a, b) for v in (0, 3) for a, b in ((1, 1), (4, 5), (7, 7))]


def test_pairs_of_masks_are_made_by_tasks_of_a_bounded_number(spark, monkeypatch):
    """Spark dealt them by what they are made of: 148 million pairs were three tasks."""
    monkeypatch.setattr(lift, "TASK_PAIRS", 100)
    masks = spark.createDataFrame([("s", 0, m, 2 if m % 2 else 0) for m in range(50)], "scene_id string, frame_ord long, mask_ord long, left int")
    pixels = masks.withColumn("u", F.explode(F.sequence(F.col("left"), F.col("left") + 2))).withColumn("v", F.lit(0)).drop("left")
    made = lift.pixel_overlaps(pixels)
    want = {(a, b): 1 if (a + b) % 2 else 3 for a in range(50) for b in range(a + 1, 50)}
    assert {(r.a, r.b): r.shared for r in made.collect()} == want and made.count() == len(want)
    assert made.where("area_a != 3 OR area_b != 3").isEmpty()
    assert made.rdd.getNumPartitions() >= len(want) // 100
