"""A lift that was done is not done again."""

from pyspark.sql import functions as F

from scenequarry.operators.incremental import lift_changed
from scenequarry.plans.views import view

DATA = "/root/testdata/sf0.001"


def test_only_changed_scenes_are_lifted(spark, tmp_path):
    points, cameras, masks = (view(spark, DATA, n) for n in ("points", "cameras", "masks"))
    # The least table has few masks: each stands in both scenes.
    masks = masks.withColumn("scene_id", F.explode(F.array(F.lit("A"), F.lit("N")))).withColumns({"left": F.lit(20), "top": F.lit(10 + 2), "frame_ord": F.lit(3).cast("long")})
    points = points.where("scene_id != 'R'")
    where = str(tmp_path / "lifts")
    key = ["scene_id", "id", "n_points"]
    first, done = lift_changed(points, cameras, masks, where, least_track=5, background=0.9)
    found = sorted(map(tuple, first.select(key).collect()))
    assert sorted(r.scene_id for r in done.collect()) == ["A", "N"] and {r[0] for r in found} == {"A", "N"}
    again, done = lift_changed(points, cameras, masks.repartition(3), where, least_track=5, background=0.9)
    assert done.isEmpty() and sorted(map(tuple, again.select(key).collect())) == found
    # One mask of one scene less tall: that scene's work only.
    moved = masks.withColumn("high", F.when((F.col("scene_id") == "N") & (F.col("mask_ord") == masks.agg(F.min("mask_ord")).first()[0]), F.col("high") - 3).otherwise(F.col("high")))
    changed, done = lift_changed(points, cameras, moved, where, least_track=5, background=0.9)
    assert [r.scene_id for r in done.collect()] == ["N"]
    assert [r for r in sorted(map(tuple, changed.select(key).collect())) if r[0] == "A"] == [r for r in found if r[0] == "A"]
    # Without its masks a scene has no objects, and none from before.
    none, done = lift_changed(points, cameras, masks.where("scene_id = 'A'"), where, least_track=5, background=0.9)
    assert sorted(r.scene_id for r in done.collect()) == ["N"] and {r.scene_id for r in none.collect()} == {"A"}
