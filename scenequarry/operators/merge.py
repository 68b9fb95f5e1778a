"""Merging objects that are the same, and joining labels to clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenequarry.functions.geometry import sigmoid
from scenequarry.functions.labels import is_duplicate, strip_duplicates
from scenequarry.operators.cloud import XYZ
from scenequarry.operators.graph import connected_components
from scenequarry.operators.lift import EVIDENCE_FRAMES, geometric_median, percentile_box
from scenequarry.operators.neighbors import similar_neighbours
from scenequarry.operators.stored import stored


def _components(objects: DataFrame, radius: float, least: float, label: str) -> DataFrame:
    """Objects (with an ``ordinal``) and the least ordinal that each is joined to."""
    by_ordinal = objects.select("scene_id", F.col("ordinal").alias("id"), *XYZ, label)
    edges = similar_neighbours(by_ordinal, radius, least, label)
    found = connected_components(objects.select("scene_id", F.col("ordinal").alias("node")), edges)
    return objects.join(found.withColumnRenamed("node", "ordinal"), ["scene_id", "ordinal"])


def merge_clusters(clusters: DataFrame, members: DataFrame, points: DataFrame, radius: float = 0.6, least: float = 0.40) -> DataFrame:
    """Before labels: clusters near each other with similar phrases become one, its geometry computed anew.

    ``clusters(scene_id, ordinal, id, x, y, z, lo_x … hi_z, anchor_area, phrase, sources, frame_ids)`` and
    ``members(scene_id, ordinal, point_idx)``. Lone clusters keep their own geometry.
    """
    grouped = stored(_components(clusters, radius, least, "phrase"))
    sizes = grouped.groupBy("scene_id", "component").agg(F.count(F.lit(1)).alias("n_merged"))
    joint = sizes.where("n_merged > 1")
    cloud = members.join(grouped.select("scene_id", "ordinal", "component"), ["scene_id", "ordinal"]).join(joint, ["scene_id", "component"], "left_semi").select("scene_id", "component", "point_idx").distinct()
    cloud = stored(cloud.join(points, ["scene_id", "point_idx"]).withColumn("w", sigmoid(F.col("opacity")) if "opacity" in points.columns else F.lit(1.0)))
    shape = geometric_median(cloud, ["scene_id", "component"]).join(percentile_box(cloud, ["scene_id", "component"]), ["scene_id", "component"])
    first = -F.col("ordinal")
    boxes = [f"{e}_{c}" for e in ("lo", "hi") for c in XYZ]
    kept = grouped.groupBy("scene_id", "component").agg(
        F.max_by("id", F.struct("anchor_area", first)).alias("id"), F.max("anchor_area").alias("anchor_area"), F.max_by("phrase", F.struct("anchor_area", F.length("phrase"), first)).alias("phrase"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("frame_ids")))), 1, EVIDENCE_FRAMES).alias("frame_ids"),
        F.count(F.lit(1)).alias("n_merged"), *[F.max_by(c, first).alias(f"__{c}") for c in [*XYZ, *boxes]],
    )
    return kept.join(shape, ["scene_id", "component"], "left").select("scene_id", F.col("component").alias("ordinal"), "id", "n_merged", "anchor_area", "phrase", "sources", "frame_ids", *[F.coalesce(c, f"__{c}").alias(c) for c in [*XYZ, *boxes]])


def merge_annotations(annotations: DataFrame, radius: float = 0.6, least: float = 0.30) -> DataFrame:
    """After labels: annotations near each other with similar labels become the most confident one, in the box around all.

    ``annotations(scene_id, ordinal, id, label, x, y, z, lo_x … hi_z, confidence, alternatives, frame_ids, provenance)``.
    The centroid is the middle of the box; a lone annotation keeps its own.
    """
    grouped = _components(annotations, radius, least, "label")
    best = F.struct("confidence", -F.col("ordinal"))
    lone = F.col("n_merged") == 1
    lows, highs = [F.min(f"lo_{c}").alias(f"lo_{c}") for c in XYZ], [F.max(f"hi_{c}").alias(f"hi_{c}") for c in XYZ]
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    merged = grouped.groupBy("scene_id", "component").agg(
        F.count(F.lit(1)).alias("n_merged"), *[F.max_by(c, best).alias(c) for c in ("id", "label", "confidence")], F.max_by("alternatives", best).alias("__alts"), *lows, *highs, *[F.first(c).alias(f"__{c}") for c in XYZ],
        union("provenance").alias("provenance"), F.slice(union("frame_ids"), 1, EVIDENCE_FRAMES).alias("frame_ids"),
    )
    middle = {c: F.when(lone, F.col(f"__{c}")).otherwise((F.col(f"lo_{c}") + F.col(f"hi_{c}")) * 0.5) for c in XYZ}
    alternatives = F.when(lone, F.col("__alts")).otherwise(strip_duplicates(F.col("__alts")))
    return merged.withColumns(middle).withColumn("alternatives", alternatives).drop("__alts", *[f"__{c}" for c in XYZ]).withColumnRenamed("component", "ordinal")


def join_labels(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """Clusters with their labels of ``labels(scene_id, id, label, confidence, alternatives)``.

    Without a label: unknown, confidence 0. Those labelled none, or whose first alternative marks a duplicate, go.
    """
    joined = clusters.join(labels, ["scene_id", "id"], "left")
    dropped = (F.lower(F.trim(F.col("label"))) == "none") | is_duplicate(F.col("alternatives"))
    return joined.where(~F.coalesce(dropped, F.lit(False))).withColumn("label", F.coalesce("label", F.lit("unknown"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def label_funnel(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """Clusters by scene that were rejected, marked as duplicates, and kept."""
    joined = clusters.select("scene_id", "id").join(labels, ["scene_id", "id"], "left")
    rejected = F.coalesce(F.lower(F.trim(F.col("label"))) == "none", F.lit(False))
    duplicate = ~rejected & is_duplicate(F.col("alternatives"))
    return joined.groupBy("scene_id").agg(F.count_if(rejected).alias("rejected"), F.count_if(duplicate).alias("duplicate"), F.count_if(~rejected & ~duplicate).alias("kept"))


def label_batches(clusters: DataFrame, size: int = 5) -> DataFrame:
    """Work for the labeller: clusters in order, ``size`` a batch."""
    place = F.row_number().over(Window.partitionBy("scene_id").orderBy("ordinal")) - 1
    batched = clusters.withColumn("batch", F.floor(place / size))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"])
    return batched.groupBy("scene_id", "batch").agg(F.array_join(ids, ",").alias("ids"))


def noise_share(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("scene_id").agg(F.avg((F.col("cluster") == -1).cast("double")).alias("noise"))


def top_clusters(clustered: DataFrame, most: int = 12) -> DataFrame:
    """Rows of the first ``most`` clusters of each scene, noise left out."""
    found = clustered.where("cluster >= 0")
    return found.withColumn("__r", F.dense_rank().over(Window.partitionBy("scene_id").orderBy("cluster"))).where(F.col("__r") <= most).drop("__r")


def first_phrases(proposals: DataFrame) -> DataFrame:
    """The first proposal of each phrase (case and blanks at the ends don't count) in each frame."""
    key = F.lower(F.trim(F.col("phrase")))
    return proposals.groupBy("scene_id", "frame_name", key.alias("key")).agg(F.min_by(F.struct(*proposals.columns), "ordinal").alias("p")).select("p.*")


def proposal_counts(proposals: DataFrame) -> DataFrame:
    """Proposals by frame, and by scene (frame null)."""
    return proposals.groupingSets([["scene_id", "frame_name"], ["scene_id"]], "scene_id", "frame_name").agg(F.count(F.lit(1)).alias("n"))


def new_work(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose key (with a fingerprint of their inputs) isn't done yet."""
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def content_sum(rows: DataFrame) -> Column:
    """Aggregate that names a set of rows whatever their order: the sum of 60 bits of each row's md5; doubles count to a millionth."""
    parts = [F.round(F.col(f.name) * 1e6).cast("long") if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in rows.schema.fields]
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.sum(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")


def lift_fingerprints(clouds: DataFrame, masks: DataFrame, thresholds: str) -> DataFrame:
    """Key of each scene's lift: its cloud's fingerprint, the thresholds, its mask count and a hash of the masks' content."""
    seen = masks.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_masks"), content_sum(masks).alias("__h"))
    return clouds.join(seen, "scene_id", "left").select("scene_id", F.sha2(F.concat_ws("|", "fingerprint", F.lit(thresholds), F.coalesce("n_masks", F.lit(0)).cast("string"), F.coalesce(F.col("__h").cast("string"), F.lit(""))), 256).alias("work_key"))
