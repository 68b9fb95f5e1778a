"""Point clouds: extents, voxel thinning, filters and statistics, all keyed by scene."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenequarry.functions.geometry import clip, dc_to_rgb, norm, sigmoid, turbo
from scenequarry.operators.camera import small
from scenequarry.operators.order import group_quantiles, group_ranks
from scenequarry.operators.stored import stored

XYZ = ("x", "y", "z")
MIN_POINTS = 1000


def filter_opacity(points: DataFrame, least: float = 0.05) -> DataFrame:
    """Points whose opacity, a logit, is at least ``least``; all if there is no such column."""
    return points.where(sigmoid(F.col("opacity")) >= least) if "opacity" in points.columns else points


def scene_bounds(points: DataFrame) -> DataFrame:
    """Axis-aligned bounds, count and diagonal by scene."""
    ends = [f(c).alias(f"{c}_{n}") for c in XYZ for n, f in (("min", F.min), ("max", F.max))]
    return points.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), *ends).withColumn("diagonal", norm(*[F.col(f"{c}_max") - F.col(f"{c}_min") for c in XYZ]))


def depth_tolerance(bounds: DataFrame, least: float = 0.10, part: float = 0.02) -> DataFrame:
    return bounds.withColumn("epsilon", F.greatest(F.lit(least), F.col("diagonal") * part))


def robust_extent(points: DataFrame, low: float = 0.025, high: float = 0.975, approximate: bool = False) -> DataFrame:
    """Diagonal between percentiles by scene: exact, whatever a scene's size; ``approximate`` takes one pass instead of a few."""
    if approximate:
        at = points.groupBy("scene_id").agg(*[F.percentile_approx(c, [low, high], 10_000).alias(c) for c in XYZ])
        return at.select("scene_id", norm(*[F.get(c, F.lit(1)) - F.get(c, F.lit(0)) for c in XYZ]).alias("extent"))
    at = group_quantiles(points, ["scene_id"], {c: (low, high) for c in XYZ})
    return at.select("scene_id", norm(*[F.col(f"{c}_q1") - F.col(f"{c}_q0") for c in XYZ]).alias("extent"))


def voxel_sizes(points: DataFrame, fraction: float = 0.005, approximate: bool = False) -> DataFrame:
    """Voxel edge by scene: a fraction of the robust extent, at least 1e-4."""
    return robust_extent(points, approximate=approximate).withColumn("voxel", F.greatest(F.col("extent") * fraction, F.lit(1e-4)))


def voxel_keys(size: Column, axes: Sequence[str] = XYZ) -> list[Column]:
    return [F.floor(F.col(c) / size).alias(f"k{c}") for c in axes]


def thin_voxels(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """The point of most confidence in each voxel, the lowest point_idx of equals; one map-side combined aggregate, no sort.

    ``sizes(scene_id, voxel)`` has a row a scene.
    """
    row = F.struct(*[F.col(c) for c in points.columns])
    best = F.max_by(row, F.struct("conf", -F.col("point_idx")))
    # Broadcast: a shuffle by scene would make each scene one task.
    return points.join(small(stored(sizes.select("scene_id", "voxel"), "voxels")), "scene_id").groupBy("scene_id", *voxel_keys(F.col("voxel"))).agg(best.alias("p")).select("p.*")


def first_per_voxel(points: DataFrame, size: float = 0.05, half_range: float = 51.2) -> DataFrame:
    """The first point of each voxel of a fixed grid that spans ``half_range`` each way."""
    inside = points.where(" AND ".join(f"{c} >= {-half_range} AND {c} < {half_range}" for c in XYZ))
    return inside.groupBy("scene_id", *voxel_keys(F.lit(size))).agg(F.min("point_idx").alias("point_idx"))


def strided_sample(points: DataFrame, most: int = 8000) -> DataFrame:
    """Every n-th point by ordinal so that about ``most`` stay in a scene. Ordinals are made dense first; a scene spreads over many tasks."""
    stride = F.greatest(F.lit(1), F.ceil(F.col("__n") / most))
    return group_ranks(points, ["scene_id"], [("point_idx", False)], "__i", "__n").where(F.col("__i") % stride == 0).drop("__i", "__n")


def reject_small(points: DataFrame, least: int = MIN_POINTS) -> DataFrame:
    """Scenes with fewer than ``least`` points, and their counts."""
    return points.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)


def field_statistics(cloud: DataFrame, fields: Sequence[str]) -> DataFrame:
    """min, max, mean and sample deviation of each field, a row for each scene and field, in one pass."""
    parts = [F.struct(F.lit(c).alias("field"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("deviation")) for c in fields]
    return cloud.groupBy("scene_id").agg(F.array(*parts).alias("f")).select("scene_id", F.inline("f"))


def synthetic_flags(statistics: DataFrame) -> DataFrame:
    """Scenes whose opacity or scale hardly vary (below 0.01), or whose colour doesn't (below 0.05)."""
    flat = lambda names, least: F.max(F.when(F.col("field").isin(list(names)) & (F.col("deviation") < least), 1).otherwise(0)) == 1
    return statistics.groupBy("scene_id").agg(
        flat(["opacity"], 0.01).alias("flat_opacity"), flat(["scale_0", "scale_1", "scale_2"], 0.01).alias("flat_scale"), flat(["f_dc_0", "f_dc_1", "f_dc_2"], 0.05).alias("flat_colour")
    )


def splat_export_columns(surfels: DataFrame) -> DataFrame:
    """The 17 columns of a splat row, in order; normals are zero and the quaternion has unit length."""
    q = [F.col(f"rot_{i}") for i in range(4)]
    size = norm(*q) + 1e-9
    return surfels.select(
        "scene_id", *XYZ, *[F.lit(0.0).alias(n) for n in ("nx", "ny", "nz")], *[f"f_dc_{i}" for i in range(3)], "opacity", *[f"scale_{i}" for i in range(3)], *[(c / size).alias(f"rot_{i}") for i, c in enumerate(q)]
    )


def points_export_columns(surfels: DataFrame) -> DataFrame:
    """Points with byte colours: decoded, times 255, clipped and truncated."""
    byte = lambda i: clip(dc_to_rgb(F.col(f"f_dc_{i}")) * 255, 0.0, 255.0).cast("int")
    return surfels.select("scene_id", *XYZ, byte(0).alias("red"), byte(1).alias("green"), byte(2).alias("blue"), F.col("conf").alias("confidence"))


def colorize(points: DataFrame, mode: str = "depth", eye: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Colour-map value and colour of each point: distance from ``eye`` over the scene's diagonal, or its confidence."""
    if mode == "depth":
        bounds = scene_bounds(points).select("scene_id", F.greatest(F.col("diagonal"), F.lit(1e-3)).alias("__d"))
        valued = points.join(small(stored(bounds, "bounds")), "scene_id").withColumn("t", norm(*[F.col(c) - e for c, e in zip(XYZ, eye, strict=True)]) / F.col("__d")).drop("__d")
    else:
        valued = points.withColumn("t", F.col("conf"))
    return valued.withColumns({k: v for k, v in turbo(F.col("t")).items()})
