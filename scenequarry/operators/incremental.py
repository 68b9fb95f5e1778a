"""Lifts that are kept: scenes whose cloud, cameras, masks and thresholds are as they were are not lifted again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequarry.operators.camera import small
from scenequarry.operators.lift import lift_masks
from scenequarry.operators.merge import content_sum, lift_fingerprints, new_work
from scenequarry.operators.stored import stored
from scenequarry.sources.versions import has_scenes, read_scene, write_scene


def scene_keys(points: DataFrame, cameras: DataFrame, masks: DataFrame, options: dict) -> DataFrame:
    """``(scene_id, work_key)``: what a scene's lift depends on, in a hash. Order of rows doesn't count; doubles count to a millionth."""
    cloud = points.groupBy("scene_id").agg(content_sum(points).alias("__p"))
    seen = cameras.groupBy("scene_id").agg(content_sum(cameras).alias("__c"))
    both = cloud.join(seen, "scene_id", "left").select("scene_id", F.concat_ws("|", "__p", F.coalesce("__c", F.lit(""))).alias("fingerprint"))
    return lift_fingerprints(both, masks, "|".join(f"{k}={options[k]}" for k in sorted(options)))


def lift_changed(points: DataFrame, cameras: DataFrame, masks: DataFrame, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """Objects of all scenes of ``points``, and the scenes that were lifted for them now.

    Keys and objects are kept under ``path``, each replaced by scene. Only scenes without a kept key, or with another one, are lifted, with ``options`` of
    ``lift_masks``; the others' objects are those kept. Objects carry the key that they were made for: a run that ends between the two writes leaves a
    scene's old key, and is made good by the next. Scenes that are not in ``points`` stay kept, and are not returned.
    """
    spark = points.sparkSession
    keys = stored(scene_keys(points, cameras, masks, options), "lift-keys")
    known = f"{path}/keys"
    changed = stored(new_work(keys, read_scene(spark, known), ["scene_id", "work_key"]) if has_scenes(spark, known) else keys, "lift-changed")
    if not changed.isEmpty():
        scenes = small(changed.select("scene_id"))
        mine = [df.join(scenes, "scene_id", "left_semi") for df in (points, cameras, masks)]
        objects = lift_masks(*mine, **options).join(small(changed), "scene_id")
        write_scene(objects, f"{path}/objects")
        write_scene(changed, known)
    if not has_scenes(spark, f"{path}/objects"):
        return lift_masks(points.limit(0), cameras, masks, **options), changed
    kept = read_scene(spark, f"{path}/objects").join(small(keys), ["scene_id", "work_key"]).drop("work_key")
    return kept, changed.select("scene_id")
