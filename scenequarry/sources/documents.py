"""Scene documents: manifests, annotations, cameras, captures, and checks over a corpus of them.

A scene is a folder; its id is the name of the folder that a file lies in, ``scene_id=…`` or the id alone. Schemas are declared, never inferred.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from scenequarry.functions.labels import strip_extension, valid_scene_id
from scenequarry.sources.ply import _located
from scenequarry.sources.versions import read_scene, write_scene

STAGE = "struct<status:string,duration_s:double>"
MANIFEST = f"scene_id string, created_at timestamp, status string, stages struct<capture:{STAGE},poses:{STAGE},splat:{STAGE},segmentation:{STAGE}>, artifacts map<string,string>, stats struct<frame_count:int,object_count:int,splat_size_mb:double>, errors array<string>, _corrupt_record string"
ANNOTATION = "struct<id:string,label:string,centroid:array<double>,bbox:array<array<double>>,color:string,confidence:double,alternatives:array<string>,cluster_gaussian_indices:array<bigint>,provenance:array<string>,frame_ids:array<string>>"
CAMERA = "array<struct<frame:string,extrinsic:array<array<double>>,intrinsic:array<array<double>>>>"
#: Fixed values of the documents.
STATUSES, STAGE_STATUSES = ("queued", "processing", "ready", "failed"), ("pending", "running", "complete", "failed")
CAMERA_MODELS = ("pinhole", "meta_rayban_gen2", "fisheye", "generic")
STAGES = ("capture", "poses", "splat", "segmentation")


def _scene_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(?:scene_id=)?([^/]+)/[^/]+$", 1)


def _texts(spark: SparkSession, glob: str) -> DataFrame:
    """Whole files: scene_id, path, value. Of a glob ``root/*/name`` the scenes' folders are listed by tasks; the driver expands other globs, a folder at a time."""
    root, _, name = glob.rpartition("/*/")
    reader = spark.read
    if root and not re.search(r"[*?\[{\\]", root):
        reader, glob = reader.option("recursiveFileLookup", True).option("pathGlobFilter", name), root
    found = reader.text(glob, wholetext=True)
    if glob == root:
        # Files right in a scene's folder, none below.
        found = found.where(F.col("_metadata.file_path").rlike(rf"/{re.escape(root.rstrip('/').split('/')[-1])}/[^/]+/[^/]+$"))
    return found.select(_scene_of(F.col("_metadata.file_path")).alias("scene_id"), F.col("_metadata.file_path").alias("path"), "value")


def write_documents(texts: DataFrame, root: str, name: str) -> None:
    """A file ``root/scene_id/name`` for each of ``texts(scene_id, value)``; tasks write their own, none passes through the driver. A task that is run again writes the same."""

    def write(rows: Iterator[Row]) -> None:
        system, base = _located(root)
        for r in rows:
            system.create_dir(f"{base}/{r.scene_id}", recursive=True)
            with system.open_output_stream(f"{base}/{r.scene_id}/{name}") as f:
                f.write(((r.value or "") + "\n").encode())

    texts.select("scene_id", "value").foreachPartition(write)


def read_manifests(spark: SparkSession, glob: str) -> DataFrame:
    """Manifests with typed stages; ``stage_extra`` has all keys of each stage as text, the unknown ones too."""
    raw = _texts(spark, glob)
    parsed = raw.withColumn("m", F.from_json("value", MANIFEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    extra = F.from_json(F.get_json_object("value", "$.stages"), "map<string,map<string,string>>")
    return parsed.select(F.coalesce("m.scene_id", "scene_id").alias("scene_id"), *[f"m.{c}" for c in ("created_at", "status", "stages", "artifacts", "stats", "errors", "_corrupt_record")], extra.alias("stage_extra"), "path")


def manifest_stages(manifests: DataFrame) -> DataFrame:
    """A row for each scene and stage."""
    each = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"stages.{s}.status").alias("status"), F.col(f"stages.{s}.duration_s").alias("duration_s"), F.col("stage_extra")[s].alias("extra")) for s in STAGES])
    return manifests.select("scene_id", F.inline(each))


def _annotations() -> Column:
    """Annotations of a file's text, a bare array or wrapped. An object read as an array would be one empty entry, so the text decides."""
    bare, wrapped = F.from_json("value", f"array<{ANNOTATION}>"), F.from_json("value", f"struct<annotations:array<{ANNOTATION}>>")["annotations"]
    return F.when(F.ltrim("value").startswith("["), bare).otherwise(wrapped)


def read_annotations(spark: SparkSession, glob: str) -> DataFrame:
    """Annotations of each scene in order; a bare array or an object with ``annotations``."""
    rows = _texts(spark, glob).select("scene_id", F.posexplode(_annotations()).alias("ordinal", "a"))
    box = [F.get(F.get("a.bbox", F.lit(i)), F.lit(j)).alias(f"{n}_{c}") for i, n in enumerate(("lo", "hi")) for j, c in enumerate("xyz")]
    return rows.select("scene_id", "ordinal", "a.id", "a.label", *[F.get("a.centroid", F.lit(j)).alias(c) for j, c in enumerate("xyz")], *box, "a.color", "a.confidence", *[F.coalesce(f"a.{c}", F.array().cast(t)).alias(c) for c, t in (("alternatives", "array<string>"), ("cluster_gaussian_indices", "array<bigint>"), ("provenance", "array<string>"), ("frame_ids", "array<string>"))])


def read_cameras(spark: SparkSession, glob: str) -> DataFrame:
    """Cameras in order, without entries that name no frame; a 3x4 extrinsic or the upper rows of a 4x4 one."""
    rows = _texts(spark, glob).select("scene_id", F.posexplode(F.from_json("value", CAMERA)).alias("frame_ord", "c")).where(F.col("c.frame").isNotNull())
    at = lambda m, r, c: F.get(F.get(f"c.{m}", F.lit(r)), F.lit(c))
    return rows.select("scene_id", F.col("frame_ord").cast("long"), F.col("c.frame").alias("frame_name"), *[at("extrinsic", r, c).alias(f"e{r}{c}") for r in range(3) for c in range(4)], at("intrinsic", 0, 0).alias("fx"), at("intrinsic", 1, 1).alias("fy"), at("intrinsic", 0, 2).alias("cx"), at("intrinsic", 1, 2).alias("cy"))


def read_captures(spark: SparkSession, glob: str) -> DataFrame:
    """Flat capture files, a ``key: value`` a line; the resolution as a list in brackets or a dash a line."""
    # A quoted value ends at its quote; in a plain one, a comment begins at a # after a blank.
    shape = r"""(?:"([^"\n]*)"|'([^'\n]*)'|((?:[^\n#]|(?<=\S)#)*))"""
    value = lambda key: F.nullif(F.trim(F.concat(*[F.regexp_extract("value", rf"(?m)^{key}:[ \t]*{shape}", i) for i in (1, 2, 3)])), F.lit(""))
    number = lambda key, kind: value(key).try_cast(kind).alias(key)
    block = F.regexp_extract("value", r"(?m)^resolution:[ \t]*(\[[^\]]*\]|(?:\n[ \t]*-[ \t]*\d+)+)", 1)
    sides = F.transform(F.regexp_extract_all(block, F.lit(r"\d+"), 0), lambda x: x.cast("int"))
    return _texts(spark, glob).select(F.coalesce(value("scene_id"), "scene_id").alias("scene_id"), value("source_video").alias("source_video"), number("duration_s", "double"), number("fps", "double"), number("frame_count", "int"), sides.alias("resolution"), value("camera_model").alias("camera_model"), number("fov_deg", "double"), number("captured_at", "timestamp"), "path")


def read_probes(spark: SparkSession, glob: str) -> DataFrame:
    got = F.from_json("value", "struct<src_fps:double,src_resolution:array<int>>")
    return _texts(spark, glob).select("scene_id", got["src_fps"].alias("src_fps"), got["src_resolution"].alias("src_resolution"))


def list_scenes(spark: SparkSession, root: str) -> DataFrame:
    """Distinct valid scene ids under a folder, from paths alone: file contents aren't read."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    base = root.rstrip("/").split("/")[-1]
    found = paths.select(F.regexp_extract("path", rf"/{base}/([^/]+)/", 1).alias("scene_id"))
    return found.where(valid_scene_id(F.col("scene_id"))).distinct()


def validate_corpus(spark: SparkSession, root: str) -> DataFrame:
    """``(scene_id, artifact, ok, reason)`` for every manifest, annotation and capture file under a folder."""
    m = read_manifests(spark, f"{root}/*/manifest.json")
    bad_stage = F.array(*[F.coalesce(~F.col(f"stages.{s}.status").isin(*STAGE_STATUSES), F.lit(True)) for s in STAGES])
    why = F.when(F.col("_corrupt_record").isNotNull() | F.col("status").isNull(), "not a manifest").when(~F.col("status").isin(*STATUSES), "status").when(~valid_scene_id(F.col("scene_id")), "scene_id").when(F.array_contains(bad_stage, True), "stage status")
    manifests = m.select("scene_id", F.lit("manifest").alias("artifact"), why.alias("reason"))
    raw = _texts(spark, f"{root}/*/annotations.json").withColumn("a", _annotations())
    odd = F.exists("a", lambda x: x["id"].isNull() | x["label"].isNull() | (F.size(x["centroid"]) != 3) | (F.size(x["bbox"]) != 2) | ~F.coalesce(x["confidence"].between(0, 1), F.lit(False)))
    annotations = raw.select("scene_id", F.lit("annotations").alias("artifact"), F.when(F.col("a").isNull(), "not annotations").when(odd, "annotation fields").alias("reason"))
    c = read_captures(spark, f"{root}/*/capture.yaml")
    wrong = F.when(F.col("source_video").isNull(), "source_video").when(~F.coalesce(F.col("camera_model").isin(*CAMERA_MODELS), F.lit(False)), "camera_model").when(F.size("resolution") != 2, "resolution").when(~F.coalesce((F.col("fps") > 0) & (F.col("frame_count") >= 0) & (F.col("duration_s") >= 0), F.lit(False)), "ranges")
    captures = c.select("scene_id", F.lit("capture").alias("artifact"), wrong.alias("reason"))
    return manifests.unionByName(annotations).unionByName(captures).select("scene_id", "artifact", F.col("reason").isNull().alias("ok"), F.coalesce("reason", F.lit("")).alias("reason"))


def evidence_manifest(annotations: DataFrame, mask_files: DataFrame, frame_files: DataFrame, per_object: int = 6) -> DataFrame:
    """Frames to mirror: those that annotations name (up to ``per_object`` of each) or that have a mask, if the frame exists; stems are compared."""
    named = annotations.select("scene_id", F.explode(F.slice("frame_ids", 1, per_object)).alias("frame_name"))
    stem = strip_extension(F.col("frame_name"))
    wanted = named.unionByName(mask_files.select("scene_id", "frame_name")).select("scene_id", stem.alias("stem")).distinct()
    return frame_files.select("scene_id", "frame_name").distinct().withColumn("stem", stem).join(wanted, ["scene_id", "stem"], "left_semi").drop("stem")


def write_surfels(surfels: DataFrame, path: str) -> None:
    write_scene(surfels.repartition("scene_id", "frame_ord"), path)


def read_surfels(spark: SparkSession, path: str) -> DataFrame:
    return read_scene(spark, path)


def write_trace_snapshot(spans: DataFrame, path: str) -> None:
    """Snapshot of each scene's spans with the time of writing; replaces that scene's last one."""
    write_scene(spans.withColumn("snapshot_at", F.current_timestamp()), path)
