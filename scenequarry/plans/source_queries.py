"""Queries of the sources: documents and clouds written from the tables, broken ones among them, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequarry.operators.stored import shared_folder
from scenequarry.plans.registry import REGISTRY
from scenequarry.sources import documents
from scenequarry.sources.ply import read_ply, write_ply

add = REGISTRY.add


def _folder(df: DataFrame, name: str) -> str:
    spark = df.sparkSession
    return f"{shared_folder(spark)}/scenequarry-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _files(texts: DataFrame, name: str) -> str:
    """A file for each of ``texts(scene_id, value)``, in its scene's folder, written by tasks; returns the glob of all."""
    root = _folder(texts, name)
    documents.write_documents(texts, root, f"{name}.txt")
    return f"{root}/*/{name}.txt"


@add("s1_ply_points", "SELECT scene_id, point_idx AS ident, x, y, z, conf AS confidence FROM points", "x y z confidence")
def _(get):
    # PLY has no whole numbers of 64 bits, and doubles hold 53: an ordinal is two columns.
    halves = [F.shiftright("point_idx", 32).cast("double").alias("ident_high"), F.col("point_idx").bitwiseAND(0xFFFFFFFF).cast("double").alias("ident_low")]
    points = get("points").select("scene_id", "x", "y", "z", F.col("conf").alias("confidence"), *halves)
    root = _folder(points, "ply")
    write_ply(points, root, 10_000)
    found = read_ply(points.sparkSession, f"{root}/*/*.ply", "scene_id string, point_idx long, x double, y double, z double, confidence double, ident_high double, ident_low double")
    ident = F.shiftleft(F.col("ident_high").cast("long"), 32).bitwiseOR(F.col("ident_low").cast("long"))
    return found.select("scene_id", ident.alias("ident"), "x", "y", "z", "confidence")


def _stages(get) -> DataFrame:
    last = get("stage_events").groupBy("scene_id").pivot("stage", list(documents.STAGES)).agg(F.max_by(F.struct("status", "duration_s"), "seq"))
    return last.select("scene_id", *documents.STAGES)


def _manifest_texts(get) -> DataFrame:
    """A manifest a scene: every seventh is cut off, every fifth has a stage status that there isn't."""
    made = _stages(get)
    number = F.col("scene_id").cast("long")
    stages = F.struct(*[F.struct(F.when((number % 5 == 0) & F.lit(s == "poses"), "lost").otherwise(F.coalesce(F.col(f"{s}.status"), F.lit("pending"))).alias("status"), F.col(f"{s}.duration_s").alias("duration_s"), F.lit("b-" + s).alias("backend")).alias(s) for s in documents.STAGES])
    text = F.to_json(F.struct("scene_id", F.lit("2025-01-02T03:04:05Z").alias("created_at"), F.lit("ready").alias("status"), stages.alias("stages"), F.create_map(F.lit("ply"), F.concat(F.lit("scenes/"), "scene_id")).alias("artifacts"), F.array().cast("array<string>").alias("errors")))
    return made.select("scene_id", F.when(number % 7 == 0, F.substring(text, 1, 40)).otherwise(text).alias("value"))


_STAGE_SQL = """st AS (SELECT scene_id, stage, arg_max(status, seq) AS status, arg_max(duration_s, seq) FILTER (duration_s IS NOT NULL) AS duration_s FROM stage_events GROUP BY scene_id, stage),
sc AS (SELECT DISTINCT scene_id, CAST(scene_id AS BIGINT) AS n FROM stage_events), al AS (SELECT scene_id, n, stage FROM sc, (VALUES ('capture'), ('poses'), ('splat'), ('segmentation')) v(stage))"""


@add("s2_manifest_stages", f"WITH {_STAGE_SQL} SELECT al.scene_id, al.stage, CASE WHEN n % 7 <> 0 THEN CASE WHEN n % 5 = 0 AND al.stage = 'poses' THEN 'lost' ELSE coalesce(st.status, 'pending') END END AS status, CASE WHEN n % 7 <> 0 THEN st.duration_s END AS duration_s, CASE WHEN n % 7 <> 0 THEN 'b-' || al.stage END AS backend FROM al LEFT JOIN st ON al.scene_id = st.scene_id AND al.stage = st.stage", "duration_s")
def _(get):
    texts = _manifest_texts(get)
    stages = documents.manifest_stages(documents.read_manifests(texts.sparkSession, _files(texts, "manifests")))
    return stages.select("scene_id", "stage", "status", "duration_s", F.col("extra")["backend"].alias("backend"))


def _annotation_texts(get) -> DataFrame:
    """Annotations of a scene as a bare array, or wrapped where its number is odd."""
    a = get("annotations")
    box = F.array(*[F.array(*[F.col(f"{e}_{c}") for c in "xyz"]) for e in ("lo", "hi")])
    one = F.struct("ordinal", F.struct("id", "label", F.array("x", "y", "z").alias("centroid"), box.alias("bbox"), F.lit("#ffffff").alias("color"), "confidence", F.array("brand").alias("alternatives"), F.array("type").alias("provenance")).alias("a"))
    listed = a.groupBy("scene_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["a"]).alias("l"))
    return listed.select("scene_id", F.when(F.col("scene_id").cast("long") % 2 == 0, F.to_json("l")).otherwise(F.to_json(F.struct(F.col("l").alias("annotations")))).alias("value"))


@add("s3_annotations", "SELECT scene_id, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY ordinal) - 1 AS INT) AS ordinal, id, label, x, y, z, lo_x, lo_y, lo_z, hi_x, hi_y, hi_z, confidence, brand AS alternatives, type AS provenance, 0 AS n_frames FROM annotations", "x y z lo_x lo_y lo_z hi_x hi_y hi_z confidence")
def _(get):
    texts = _annotation_texts(get)
    found = documents.read_annotations(texts.sparkSession, _files(texts, "annotations"))
    return found.select("scene_id", "ordinal", "id", "label", *"xyz", *[f"{e}_{c}" for e in ("lo", "hi") for c in "xyz"], "confidence", F.array_join("alternatives", ",").alias("alternatives"), F.array_join("provenance", ",").alias("provenance"), F.size("frame_ids").alias("n_frames"))


@add("s4_cameras", "SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY frame_ord) - 1 AS place, frame_name, " + ", ".join(f"e{r}{c}" for r in range(3) for c in range(4)) + ", fx, fy, cx, cy FROM cameras WHERE frame_ord % 6 <> 5", " ".join(f"e{r}{c}" for r in range(3) for c in range(4)) + " fx fy cx cy")
def _(get):
    # Every sixth entry names no frame; every second matrix has a fourth row.
    cams = get("cameras")
    row = lambda r: F.array(*[F.col(f"e{r}{c}") for c in range(4)])
    zero, one = F.lit(0.0), F.lit(1.0)
    turn = F.when(F.col("frame_ord") % 2 == 0, F.array(*[row(r) for r in range(3)])).otherwise(F.array(*[row(r) for r in range(3)], F.array(zero, zero, zero, one)))
    lens = F.array(F.array(F.col("fx"), zero, F.col("cx")), F.array(zero, F.col("fy"), F.col("cy")), F.array(zero, zero, one))
    entry = F.struct("frame_ord", F.struct(F.when(F.col("frame_ord") % 6 != 5, F.col("frame_name")).alias("frame"), turn.alias("extrinsic"), lens.alias("intrinsic")).alias("c"))
    texts = cams.groupBy("scene_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["c"])).alias("value"))
    found = documents.read_cameras(cams.sparkSession, _files(texts, "cameras"))
    from scenequarry.operators.order import group_ranks

    ranked = group_ranks(found, ["scene_id"], [("frame_ord", False)], "place")
    return ranked.select("scene_id", "place", "frame_name", *[f"e{r}{c}" for r in range(3) for c in range(4)], "fx", "fy", "cx", "cy")


def _capture_texts(get) -> DataFrame:
    """Captures of the parts: sizes in brackets or a dash a line, quotes, comments, a missing video and a model that there isn't."""
    a = get("annotations").where("ordinal % 10 = 3").select(F.col("id").alias("scene_id"), "size", "brand", "ordinal")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    size = F.when(F.col("size") % 2 == 0, line("resolution: [", F.col("size") * 10, ", ", F.col("size") * 5, "]")).otherwise(line("resolution:\n  - ", F.col("size") * 10, "\n  - ", F.col("size") * 5))
    video = F.when(F.col("size") % 9 == 0, F.lit("# no video")).otherwise(line("source_video: \"", F.col("brand"), ".mp4\"  # raw"))
    model = F.when(F.col("size") % 11 == 0, F.lit("camera_model: lidar")).otherwise(F.lit("camera_model: 'pinhole'"))
    return a.withColumn("value", F.concat_ws("\n", line("scene_id: ", F.col("scene_id")), video, line("duration_s: ", F.col("size"), ".5"), F.lit("fps: 30"), line("frame_count: ", F.col("size") * 3), size, model, F.lit("fov_deg: none")))


@add("s5_captures", "SELECT id AS scene_id, CASE WHEN size % 9 <> 0 THEN brand || '.mp4' END AS source_video, size + 0.5 AS duration_s, 30.0 AS fps, CAST(size * 3 AS INT) AS frame_count, CAST(size * 10 AS VARCHAR) || 'x' || CAST(size * 5 AS VARCHAR) AS resolution, CASE WHEN size % 11 = 0 THEN 'lidar' ELSE 'pinhole' END AS camera_model, true AS no_fov FROM annotations WHERE ordinal % 10 = 3", "duration_s fps")
def _(get):
    texts = _capture_texts(get)
    found = documents.read_captures(texts.sparkSession, _files(texts, "captures"))
    return found.select("scene_id", "source_video", "duration_s", "fps", "frame_count", F.array_join(F.transform("resolution", lambda r: r.cast("string")), "x").alias("resolution"), "camera_model", F.col("fov_deg").isNull().alias("no_fov"))


_SURFEL = "SELECT scene_id, point_idx, x, y, z, conf FROM points WHERE scene_id <> 'N'"


@add("s6_surfel_table", f"{_SURFEL} UNION ALL SELECT scene_id, point_idx, x + 1 AS x, y, z, conf FROM points WHERE scene_id = 'N'", "x y z conf")
def _(get):
    # All scenes, then one of them again.
    points = get("points").select("scene_id", "point_idx", *"xyz", "conf", (F.col("point_idx") % 4).alias("frame_ord"))
    root = _folder(points, "surfels")
    documents.write_surfels(points, root)
    documents.write_surfels(points.where("scene_id = 'N'").withColumn("x", F.col("x") + 1), root)
    return documents.read_surfels(points.sparkSession, root).select("scene_id", "point_idx", *"xyz", "conf")


def _corpus(get) -> str:
    """A folder a scene with its documents, named as readers of a whole corpus expect them; one folder has a name that is no scene's."""
    texts = _manifest_texts(get)
    root = _folder(texts, "corpus")
    for name, made in (("manifest.json", texts), ("annotations.json", _annotation_texts(get)), ("capture.yaml", _capture_texts(get))):
        documents.write_documents(made.withColumn("scene_id", F.when(F.col("scene_id") == "3", "no.scene").otherwise(F.col("scene_id"))), root, name)
    return root


_SCENES = "SELECT scene_id FROM stage_events UNION SELECT scene_id FROM annotations UNION SELECT id FROM annotations WHERE ordinal % 10 = 3"


@add("s12_list_scenes", f"SELECT scene_id FROM ({_SCENES}) WHERE scene_id <> '3'")
def _(get):
    return documents.list_scenes(get("points").sparkSession, _corpus(get))


@add("s13_validate_corpus", f"""WITH sc AS (SELECT DISTINCT scene_id, CAST(scene_id AS BIGINT) AS n FROM stage_events),
m AS (SELECT scene_id, CASE WHEN n % 7 = 0 THEN 'not a manifest' WHEN n % 5 = 0 THEN 'stage status' ELSE '' END AS reason FROM sc),
c AS (SELECT id AS scene_id, CASE WHEN size % 9 = 0 THEN 'source_video' WHEN size % 11 = 0 THEN 'camera_model' ELSE '' END AS reason FROM annotations WHERE ordinal % 10 = 3)
SELECT scene_id, 'manifest' AS artifact, reason = '' AS ok, reason FROM m UNION ALL SELECT DISTINCT CASE WHEN scene_id = '3' THEN 'no.scene' ELSE scene_id END, 'annotations', true, '' FROM annotations UNION ALL SELECT scene_id, 'capture', reason = '', reason FROM c""")
def _(get):
    return documents.validate_corpus(get("points").sparkSession, _corpus(get))
