"""Queries that go through files of our own formats, and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenequarry.plans.registry import REGISTRY

add = REGISTRY.add


@add("o6_set_operations", "WITH a AS (SELECT DISTINCT CAST(scene_id AS BIGINT) % 2 AS side, label FROM annotations), s0 AS (SELECT label FROM a WHERE side = 0), s1 AS (SELECT label FROM a WHERE side = 1) SELECT 'both' AS kind, count(*) AS n FROM (SELECT * FROM s0 INTERSECT SELECT * FROM s1) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM s0 UNION SELECT * FROM s1) UNION ALL SELECT 'only_first', count(*) FROM (SELECT * FROM s0 EXCEPT SELECT * FROM s1)")
def _(get):
    # Labels of scenes with even and with odd numbers: together all scenes.
    labels = get("annotations").select((F.col("scene_id").cast("long") % 2).alias("side"), "label").distinct()
    one, two = (labels.where(F.col("side") == s).select("label") for s in (0, 1))
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(one.intersect(two), "both").union(count(one.union(two).distinct(), "either")).union(count(one.subtract(two), "only_first"))


@add("o4_union_frames", "SELECT scene_id, frame_ord, count(*) AS n FROM pixels WHERE depth IS NOT NULL GROUP BY ALL")
def _(get):
    pixels = get("pixels").where("depth IS NOT NULL")
    return pixels.where("frame_ord < 5").unionByName(pixels.where("frame_ord >= 5")).groupBy("scene_id", "frame_ord").agg(F.count(F.lit(1)).alias("n"))


@add("o7_top_annotations", "SELECT scene_id, id FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY confidence DESC, ordinal) AS k FROM annotations) WHERE k <= 4")
def _(get):
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("confidence"), "ordinal"))
    return get("annotations").withColumn("k", rank).where("k <= 4").select("scene_id", "id")
