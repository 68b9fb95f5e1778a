"""Questions about objects, many at once: a request table meets annotations.

Annotations hold ``scene_id, ordinal, id, label, x, y, z, lo_x … hi_z, confidence, frame_ids``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenequarry.functions.geometry import norm
from scenequarry.operators.stored import stored


#: Letters of the pieces by which needles and labels meet.
GRAM = 3
_ASKED = ["scene_id", "__n"]


def _grams(text: Column, least: int = 1) -> Column:
    """Distinct pieces of ``least`` to ``GRAM`` letters."""

    def pieces(k: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substring(text, i, F.lit(k)))
        return F.when(F.length(text) >= k, every).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[pieces(k) for k in range(least, GRAM + 1)]))


def _rarest(strings: DataFrame, column: str, counts: DataFrame) -> DataFrame:
    """``strings`` with the piece, of ``GRAM`` letters or all of a shorter string, that fewest labels of the scene have."""
    pieces = F.when(F.length(column) < GRAM, F.array(column)).otherwise(_grams(F.col(column), GRAM))
    each = strings.select("scene_id", column, F.explode(pieces).alias("__g")).join(counts, ["scene_id", "__g"], "left")
    return each.groupBy("scene_id", column).agg(F.min_by("__g", F.struct(F.coalesce("__c", F.lit(0)), "__g")).alias("__g"))


def inside_pairs(asked: DataFrame, labels: DataFrame) -> DataFrame:
    """``(scene_id, __n, __t)`` where a needle of ``asked(scene_id, __n)`` is inside a label of ``labels(scene_id, __t)``, or holds it; distinct rows each.

    What is inside another string has all of its pieces, so the rarest of them finds it: needles and labels meet on scene and piece. An empty label is
    inside every needle.
    """
    of_labels = stored(labels.where("__t != ''").select("scene_id", "__t", F.explode(_grams(F.col("__t"))).alias("__g")), "label-pieces")
    counts = of_labels.groupBy("scene_id", "__g").agg(F.count(F.lit(1)).alias("__c"))
    inside = _rarest(asked, "__n", counts).join(of_labels, ["scene_id", "__g"]).where(F.contains("__t", "__n"))
    of_needles = asked.select("scene_id", "__n", F.explode(_grams(F.col("__n"))).alias("__g"))
    around = of_needles.join(_rarest(labels.where("__t != ''"), "__t", counts), ["scene_id", "__g"]).where(F.contains("__n", "__t"))
    empty = asked.join(labels.where("__t = ''"), "scene_id")
    columns = [*_ASKED, "__t"]
    return inside.select(columns).union(around.select(columns)).union(empty.select(columns)).distinct()


def resolve_objects(requests: DataFrame, annotations: DataFrame, needle: str = "needle") -> DataFrame:
    """Each of ``requests(request_id, scene_id, needle)`` with the best annotation as ``hit`` (null: none).

    By id, then label, then either inside the other; the first in order of each. Each distinct question of a scene is answered once: by an equi-join on the
    id, what is left by one on the label, and only the rest by pieces of the labels. Nothing is paired by scene alone.
    """
    row = F.struct(*[F.col(c) for c in annotations.columns])
    named = annotations.select("scene_id", row.alias("hit"), F.lower("id").alias("__i"), F.lower("label").alias("__t"))
    first = lambda key: named.where(F.col(key).isNotNull()).groupBy("scene_id", F.col(key).alias("__n")).agg(F.min_by("hit", F.col("hit.ordinal")).alias("hit"))
    asked = requests.select("request_id", "scene_id", F.lower(F.trim(F.col(needle))).alias("__n"))
    open_ = stored(asked.where("__n != ''").select(*_ASKED).distinct(), "questions")
    ids = stored(first("__i"), "ids")
    by_id = open_.join(ids, _ASKED)
    open_ = open_.join(ids.select(*_ASKED), _ASKED, "left_anti")
    labels = stored(first("__t"), "labels")
    by_label = open_.join(labels, _ASKED)
    open_ = stored(open_.join(labels.select(*_ASKED), _ASKED, "left_anti"), "questions")
    labels = labels.withColumnRenamed("__n", "__t")
    pairs = inside_pairs(open_, labels.select("scene_id", "__t")).join(labels, ["scene_id", "__t"])
    by_part = pairs.groupBy(*_ASKED).agg(F.min_by("hit", F.col("hit.ordinal")).alias("hit"))
    answers = by_id.unionByName(by_label).unionByName(by_part)
    return requests.withColumn("__n", F.lower(F.trim(F.col(needle)))).join(answers, _ASKED, "left").select(*[F.col(f"`{c}`") for c in requests.columns], "hit")


def known_labels(annotations: DataFrame) -> DataFrame:
    """Labels of each scene in order, joined by commas. A scene's annotations are few."""
    listed = F.sort_array(F.collect_list(F.struct("ordinal", "label")))
    return annotations.groupBy("scene_id").agg(F.array_join(F.transform(listed, lambda x: x["label"]), ", ").alias("labels"))


def locate_objects(requests: DataFrame, annotations: DataFrame) -> DataFrame:
    """Id, label, centroid and box of the object asked for; otherwise outcome ``not_found`` and the labels there are."""
    hit = resolve_objects(requests, annotations).join(known_labels(annotations), "scene_id", "left")
    found = F.col("hit").isNotNull()
    return hit.select(
        "request_id", "scene_id", F.when(found, "ok").otherwise("not_found").alias("outcome"), F.col("hit.id").alias("id"), F.col("hit.label").alias("label"),
        *[F.col(f"hit.{c}").alias(c) for c in ("x", "y", "z", "lo_x", "lo_y", "lo_z", "hi_x", "hi_y", "hi_z")], F.when(~found, F.coalesce("labels", F.lit(""))).alias("known_labels"),
    )


def camera_targets(requests: DataFrame, annotations: DataFrame) -> DataFrame:
    """Where the camera is to look: the object's centroid."""
    return resolve_objects(requests, annotations).where(F.col("hit").isNotNull()).select("request_id", "scene_id", F.col("hit.id").alias("id"), *[F.col(f"hit.{c}").alias(f"look_{c}") for c in "xyz"])


def describe_scenes(scenes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Inventory of each scene, a line ``- label (id)`` an object, or a message that there are none."""
    listed = F.sort_array(F.collect_list(F.struct("ordinal", "label", "id")))
    lines = annotations.groupBy("scene_id").agg(F.array_join(F.transform(listed, lambda x: F.concat(F.lit("- "), x["label"], F.lit(" ("), x["id"], F.lit(")"))), "\n").alias("__t"))
    return scenes.select("scene_id").distinct().join(lines, "scene_id", "left").select("scene_id", F.coalesce("__t", F.lit("No annotated objects.")).alias("inventory"))


def frames_of_objects(requests: DataFrame, annotations: DataFrame, frames: DataFrame, most: int = 4) -> DataFrame:
    """The first ``most`` frames of the object's evidence that exist in ``frames(scene_id, frame_name)``, in order."""
    hit = resolve_objects(requests, annotations)
    steps = hit.where(F.col("hit").isNotNull()).select("request_id", "scene_id", F.posexplode("hit.frame_ids").alias("__i", "frame_name"))
    there = steps.join(frames.select("scene_id", "frame_name").distinct(), ["scene_id", "frame_name"], "left_semi")
    listed = there.groupBy("request_id").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("__i", "frame_name"))), lambda x: x["frame_name"]), 1, most).alias("__f"))
    out = hit.join(listed, "request_id", "left")
    frames_or_none = F.coalesce("__f", F.array().cast("array<string>"))
    return out.select("request_id", "scene_id", F.col("hit.id").alias("id"), F.when(F.col("hit").isNull(), "not_found").when(F.size(frames_or_none) == 0, "no_frames").otherwise("ok").alias("outcome"), F.array_join(frames_or_none, ",").alias("frames"))


def pair_distances(pairs: DataFrame, annotations: DataFrame) -> DataFrame:
    """Distance between the centroids of two named objects of ``pairs(request_id, scene_id, needle_a, needle_b)``; null if either isn't found."""
    a = resolve_objects(pairs, annotations, "needle_a").select("request_id", "scene_id", F.col("hit").alias("a"))
    b = resolve_objects(pairs, annotations, "needle_b").select("request_id", F.col("hit").alias("b"))
    d = norm(*[F.col(f"a.{c}") - F.col(f"b.{c}") for c in "xyz"])
    return a.join(b, "request_id").select("request_id", "scene_id", F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), d.alias("distance"))


def measure(pairs: DataFrame) -> DataFrame:
    """Length of each of ``pairs(scene_id, ordinal, ax … bz)``."""
    return pairs.withColumn("distance", norm(*[F.col(f"a{c}") - F.col(f"b{c}") for c in "xyz"]))


def calibrate(measured: DataFrame, real: DataFrame) -> DataFrame:
    """Scale of each scene: its real length over the last raw distance (1 where that is 0); and all its distances scaled."""
    last = measured.groupBy("scene_id").agg(F.max_by("distance", "ordinal").alias("__last"))
    scale = real.join(last, "scene_id").select("scene_id", F.when(F.col("__last") > 0, F.col("real_length") / F.col("__last")).otherwise(F.lit(1.0)).alias("scale"))
    return measured.join(scale, "scene_id", "left").na.fill(1.0, ["scale"]).withColumn("scaled", F.col("distance") * F.col("scale"))


def dimensions(boxes: DataFrame, scale: float = 1.0) -> DataFrame:
    """Width, height and depth of each box, scaled."""
    return boxes.select("scene_id", "id", *[((F.col(f"hi_{c}") - F.col(f"lo_{c}")) * scale).alias(n) for c, n in zip("xyz", ("width", "height", "depth"), strict=True)])


def scene_catalogue(manifests: DataFrame) -> DataFrame:
    """Scenes newest first (without a time last), with the sum of stage durations to one place, null if 0."""
    total = F.aggregate("durations", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    row = manifests.withColumn("total_s", F.when(total != 0, F.round(total, 1)))
    return row.drop("durations").orderBy(F.desc_nulls_last("created_at"), "scene_id")
