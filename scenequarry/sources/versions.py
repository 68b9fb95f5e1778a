"""Tables by scene whose scenes are replaced at once: a reader sees a scene's old rows or its new ones, never neither and never both.

A write puts its rows into a folder of their own, which nobody reads yet. Then a commit, a small table of the scenes it replaces, is moved into place by
one rename. Commits are numbered in the order in which they are claimed; of a scene's commits the last one says which folder holds it. Rows
of replaced versions stay until ``drop_replaced``, so that readers that began before a commit end with what they began with.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenequarry.operators.camera import small
from scenequarry.operators.stored import path_exists

COMMIT = "scene_key string, version string, commit int"


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return where(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _claim(spark: SparkSession, path: str) -> int:
    """The next commit number, which nobody else gets: a file that can be created only once."""
    fs, where = _file_system(spark, path)
    number = len(fs.listStatus(where(f"{path}/claims"))) if fs.exists(where(f"{path}/claims")) else 0
    while True:
        try:
            fs.create(where(f"{path}/claims/{number:010d}"), False).close()
            return number
        except Py4JJavaError:
            if not fs.exists(where(f"{path}/claims/{number:010d}")):
                raise
            number += 1


def write_scene(df: DataFrame, path: str) -> None:
    """Replace the scenes in ``df``, and no others, in one step that readers see as a whole. Without rows nothing changes."""
    spark, version = df.sparkSession, f"v{uuid.uuid4().hex}"
    fs, where = _file_system(spark, path)
    folder = f"{path}/versions/version={version}"
    # A letter in front: a scene named by digits stays text.
    keyed = df.withColumn("scene_key", F.concat(F.lit("k"), F.col("scene_id").cast("string")))
    keyed.write.partitionBy("scene_key").parquet(folder)
    scenes = spark.read.schema(keyed.schema).parquet(folder).select("scene_key").distinct().withColumn("version", F.lit(version))
    if scenes.isEmpty():
        fs.delete(where(folder), True)
        return
    staged = f"{path}/staged/{version}"
    scenes.write.parquet(staged)
    fs.mkdirs(where(f"{path}/commits"))
    target = f"{path}/commits/commit={_claim(spark, path)}"
    if not fs.rename(where(staged), where(target)):
        raise RuntimeError(f"{target} could not be put in place")


def live_versions(spark: SparkSession, path: str) -> DataFrame:
    """``(scene_key, version)``: where each scene's rows are."""
    commits = spark.read.schema(COMMIT).parquet(f"{path}/commits")
    return commits.groupBy("scene_key").agg(F.max_by("version", "commit").alias("version"))


def read_scene(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all scenes as their last commits have them. Folders without a live scene are pruned where the versions are few enough to broadcast."""
    live = live_versions(spark, path)
    rows = spark.read.option("mergeSchema", "true").option("basePath", f"{path}/versions").parquet(f"{path}/versions")
    return rows.join(small(live), ["version", "scene_key"]).drop("version", "scene_key")


def has_scenes(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/commits")


def drop_replaced(spark: SparkSession, path: str) -> int:
    """Delete the folders of versions that no scene is in any more, and return how many; for when no reader that began before the last commits is left.

    Folders that aren't committed yet may belong to a writer and stay.
    """
    fs, where = _file_system(spark, path)
    commits = spark.read.schema(COMMIT).parquet(f"{path}/commits").select("version").distinct()
    dead = [r["version"] for r in commits.join(live_versions(spark, path), "version", "left_anti").toLocalIterator()]
    for version in dead:
        fs.delete(where(f"{path}/versions/version={version}"), True)
    return len(dead)
