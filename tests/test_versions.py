"""Scenes are replaced at once."""

import threading
from pathlib import Path

from pyspark.sql import functions as F

from scenequarry.sources import versions
from scenequarry.sources.documents import read_surfels, write_surfels
from scenequarry.streaming.live import merge_snapshot


def test_readers_see_old_or_new(spark, tmp_path):
    """While a scene is replaced again and again, every read finds one whole version of it, and the other scene untouched."""
    where = str(tmp_path / "t")
    scene = lambda v, n: spark.range(n).select(F.lit("007").alias("scene_id"), F.lit(v).alias("v"), F.lit(n).alias("n"))
    versions.write_scene(scene(0, 50).union(spark.createDataFrame([("b", 9, 1)], "scene_id string, v int, n int")), where)
    done, seen, failed = threading.Event(), [], []

    def write():
        try:
            for v in range(1, 5):
                versions.write_scene(scene(v, 50 + v), where)
        except Exception as e:  # noqa: BLE001
            failed.append(e)
        done.set()

    writer = threading.Thread(target=write)
    writer.start()
    while not done.is_set() or not seen or seen[-1] != 4:
        rows = versions.read_scene(spark, where).groupBy("scene_id", "v").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n")).collect()
        assert not failed and {r.scene_id for r in rows} == {"007", "b"} and len(rows) == 2
        mine = next(r for r in rows if r.scene_id == "007")
        assert mine.c == mine.n
        seen.append(mine.v)
    writer.join()
    assert seen == sorted(seen)
    assert len(list(Path(where, "versions").iterdir())) == 5 and versions.drop_replaced(spark, where) == 3
    assert versions.read_scene(spark, where).count() == 55


def test_failed_and_empty_writes_change_nothing(spark, tmp_path):
    where = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "scene_id string, v int")
    versions.write_scene(rows, where)
    versions.write_scene(rows.limit(0), where)
    # A writer that died before its commit.
    rows.withColumn("scene_key", F.lit("ka")).write.partitionBy("scene_key").parquet(f"{where}/versions/version=vdead")
    assert sorted(map(tuple, versions.read_scene(spark, where).collect())) == [("a", 1), ("b", 2)]
    # Commits claimed at the same time get numbers of their own, and the later number wins.
    first, second = versions._claim(spark, where), versions._claim(spark, where)
    assert second == first + 1
    versions.write_scene(spark.createDataFrame([("b", 3, "new")], "scene_id string, v int, more string"), where)
    assert sorted((r.scene_id, r.v, r.more) for r in versions.read_scene(spark, where).collect()) == [("a", 1, None), ("b", 3, "new")]


def test_surfels_and_snapshots(spark, tmp_path):
    surfels = spark.createDataFrame([("s", 1, 0.5), ("s", 2, 0.25), ("t", 1, 0.1)], "scene_id string, frame_ord int, x double")
    write_surfels(surfels, str(tmp_path / "s"))
    write_surfels(surfels.where("scene_id = 's' AND frame_ord = 2"), str(tmp_path / "s"))
    assert sorted(map(tuple, read_surfels(spark, str(tmp_path / "s")).select("scene_id", "frame_ord").collect())) == [("s", 2), ("t", 1)]
    spans = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 2.0), ("t", 3, 3.0)], "scene_id string, span_id int, d double")
    again = spark.createDataFrame([("s", 2, 5.0), ("s", 4, 4.0)], spans.schema)
    for batch in (spans, again, again):
        merge_snapshot(batch, str(tmp_path / "p"))
    assert sorted((r.scene_id, r.span_id, r.d) for r in versions.read_scene(spark, str(tmp_path / "p")).collect()) == [("s", 1, 1.0), ("s", 2, 5.0), ("s", 4, 4.0), ("t", 3, 3.0)]
