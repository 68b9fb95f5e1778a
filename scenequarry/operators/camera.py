"""Projection, visibility, depth maps and surfels.

Cameras hold ``scene_id, frame_ord, frame_name``, a row-major 3x4 extrinsic (world to camera) as
``e00 … e23``, intrinsics ``fx, fy, cx, cy`` and the frame's ``width, height``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenequarry.functions.geometry import conf_to_logit, half_even, matrix_to_quaternion, norm, rgb_to_dc, surfel_basis, surfel_scales
from scenequarry.operators.stored import stored, tidied

NEAR = 1e-6
#: Rows and bytes (as JSON, which is longer than Spark's rows) of a table that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20
FRAME = ["scene_id", "frame_ord"]
PIXEL = ["scene_id", "frame_ord", "u", "v"]
#: Cells along a scene's longest side by which points meet cameras.
CELLS, CELL = 16, ["__cx", "__cy", "__cz"]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``BROADCAST_BYTES`` bytes; otherwise Spark chooses the join.

    Costs a job over ``df``: what is dear to compute is stored first.
    """
    with tidied(df.sparkSession):
        size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return F.broadcast(df) if size[0] <= rows and size[1] <= BROADCAST_BYTES else df


def point_cells(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Points with their cell of ``grid(scene_id, edge)``."""
    return points.join(small(grid), "scene_id").withColumns({k: F.floor(F.col(c) / F.col("edge")) for k, c in zip(CELL, ("x", "y", "z"), strict=True)}).drop("edge")


def visible_cells(points: DataFrame, cameras: DataFrame, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """A grid of about ``cells`` cells along each scene's longest side, and the frames of each cell of it: ``(scene_id, cell, frames)``.

    Cells, by the box that their points really fill, meet the cameras of their scene instead of the points themselves. A camera doesn't see a cell
    whose eight corners lie beyond one plane of its frustum: nothing inside can be on the frame. The planes stand a pixel outside of the frame, so that
    rounding loses no point.
    """
    ends = points.groupBy("scene_id").agg(F.greatest(*[F.max(c) - F.min(c) for c in ("x", "y", "z")]).alias("__e"))
    # A power of two: cells of a scene are the same whatever else is read with it.
    edge = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("__e") / cells, F.lit(1e-6)))))
    grid = stored(ends.select("scene_id", edge.alias("edge")), "grid")
    sides = [f(c).alias(f"__{n}{c}") for c in ("x", "y", "z") for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = point_cells(points, grid).groupBy("scene_id", *CELL).agg(*sides)
    axis = [[F.col(f"e{r}{c}") for c in range(4)] for r in range(3)]

    def highest(weights: list[Column]) -> Column:
        """Greatest value over a cell of a sum of camera coordinates, each with a weight."""
        turned = [sum((w * axis[r][c] for r, w in enumerate(weights)), F.lit(0.0)) for c in range(4)]
        return sum((F.greatest(t * F.col(f"__lo{c}"), t * F.col(f"__hi{c}")) for t, c in zip(turned, ("x", "y", "z"), strict=False)), turned[3])

    zero = F.lit(0.0)
    planes = [highest([F.col("fx"), zero, F.col("cx") + 1.5]), highest([-F.col("fx"), zero, F.col("width") - F.col("cx") + 0.5]), highest([zero, F.col("fy"), F.col("cy") + 1.5]), highest([zero, -F.col("fy"), F.col("height") - F.col("cy") + 0.5])]
    inside = highest([zero, zero, F.lit(1.0)]) > NEAR
    for plane in planes:
        inside = inside & (plane >= 0)
    seen = boxes.join(small(cameras), "scene_id").where(inside).groupBy("scene_id", *CELL).agg(F.collect_list("frame_ord").alias("frames"))
    return grid, stored(seen, "visible-cells")


def project(points: DataFrame, cameras: DataFrame, culled: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Pixels that points fall on: scene_id, frame_ord, point_idx, u, v, depth; only those inside a frame and in front of it.

    Points meet the cameras that see their cell (``culled``, as ``visible_cells`` gives it), not all of their scene; rows outside the frame are dropped in the same stage,
    before any shuffle. Of places (``lift.places``), ``n`` is kept.
    """
    grid, seen = culled or visible_cells(points, cameras)
    kept = [c for c in ("n",) if c in points.columns]
    near = point_cells(points.select("scene_id", "point_idx", "x", "y", "z", *kept), grid).join(small(seen), ["scene_id", *CELL]).drop(*CELL)
    joined = near.withColumn("frame_ord", F.explode("frames")).join(small(cameras), FRAME)
    cam = [F.col(f"e{r}0") * F.col("x") + F.col(f"e{r}1") * F.col("y") + F.col(f"e{r}2") * F.col("z") + F.col(f"e{r}3") for r in range(3)]
    placed = joined.select("scene_id", "frame_ord", "point_idx", *kept, "fx", "fy", "cx", "cy", "width", "height", cam[0].alias("__x"), cam[1].alias("__y"), cam[2].alias("depth")).where(F.col("depth") > NEAR)
    u = half_even(F.col("fx") * F.col("__x") / F.col("depth") + F.col("cx"))
    v = half_even(F.col("fy") * F.col("__y") / F.col("depth") + F.col("cy"))
    inside = placed.withColumn("u", u).withColumn("v", v).where("u >= 0 AND u < width AND v >= 0 AND v < height")
    return inside.select("scene_id", "frame_ord", "point_idx", F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), "depth", *kept)


def zbuffer(projected: DataFrame) -> DataFrame:
    """Least depth of each pixel. An empty pixel has no row."""
    return projected.groupBy(*PIXEL).agg(F.min("depth").alias("zmin"))


def few_pixels(cameras: DataFrame) -> bool:
    """Whether images of all frames of ``cameras`` may be broadcast."""
    pixels = cameras.agg(F.coalesce(F.sum(F.col("width").cast("long") * F.col("height")), F.lit(0))).first()[0]
    return 8 * pixels <= BROADCAST_BYTES


def spread_foreground(buffer: DataFrame, cameras: DataFrame, radius: int = 3, hit_only: bool = False, images: bool = False) -> DataFrame:
    """Least depth in the (2 radius + 1)-square around each pixel of the frame; ``hit_only`` gives the buffer's own pixels only; ``images`` gives a row a frame, ``height`` and ``image``, where a pixel is at ``u * height + v``.

    One shuffle by frame: a frame is a dense image, bounded by its camera's pixels, and the square's minimum is taken
    along one axis after the other.
    """
    sized = buffer.join(small(cameras.select("scene_id", "frame_ord", "width", "height")), FRAME)

    def spread(frame: pd.DataFrame) -> pd.DataFrame:
        u, v = frame.u.to_numpy(), frame.v.to_numpy()
        image = np.full((int(frame.width.iloc[0]), int(frame.height.iloc[0])), np.inf)
        image[u, v] = frame.zmin
        for axis in (0, 1):
            source, image = image, image.copy()
            for d in range(1, min(radius, source.shape[axis] - 1) + 1):
                low, high = (slice(None, -d), slice(d, None)) if axis == 0 else ((slice(None), slice(None, -d)), (slice(None), slice(d, None)))
                np.minimum(image[low], source[high], out=image[low])
                np.minimum(image[high], source[low], out=image[high])
        if images:
            return pd.DataFrame([[*frame[FRAME].iloc[0], image.shape[1], image.ravel()]], columns=[*FRAME, "height", "image"])
        if not hit_only:
            u, v = np.nonzero(np.isfinite(image))
        out = pd.DataFrame({"u": u.astype(np.int32), "v": v.astype(np.int32), "zmin": image[u, v]})
        out.insert(0, "scene_id", frame.scene_id.iloc[0])
        out.insert(1, "frame_ord", frame.frame_ord.iloc[0])
        return out

    kinds = ", ".join(f"{c} {buffer.schema[c].dataType.simpleString()}" for c in FRAME)
    return sized.groupBy(*FRAME).applyInPandas(spread, f"{kinds}, height int, image array<double>" if images else f"{kinds}, u int, v int, zmin double")


def rigid_inverse(cameras: DataFrame) -> DataFrame:
    """Camera to world as ``i00 … i23``: the rotation's transpose, and minus that times the translation."""
    e = lambda r, c: F.col(f"e{r}{c}")
    turned = {f"i{r}{c}": e(c, r) for r in range(3) for c in range(3)}
    return cameras.withColumns(turned | {f"i{r}3": -(e(0, r) * e(0, 3) + e(1, r) * e(1, 3) + e(2, r) * e(2, 3)) for r in range(3)})


def general_inverse(cameras: DataFrame) -> DataFrame:
    """The same for matrices that may scale or shear; a singular one gives nulls."""
    names = [f"i{r}{c}" for r in range(3) for c in range(4)]

    def invert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            m = np.tile(np.eye(4), (len(f), 1, 1))
            m[:, :3] = f[[f"e{r}{c}" for r in range(3) for c in range(4)]].to_numpy(float).reshape(-1, 3, 4)
            good = np.abs(np.linalg.det(m)) > 1e-12
            out = np.full((len(f), 12), np.nan)
            out[good] = np.linalg.inv(m[good])[:, :3].reshape(-1, 12)
            yield pd.concat([f.reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    return cameras.mapInPandas(invert, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in cameras.schema.fields] + [f"{n} double" for n in names]))


def unproject(pixels: DataFrame, cameras: DataFrame) -> DataFrame:
    """World position of ``pixels(scene_id, frame_ord, u, v, depth, …)``; null where the depth is null, NaN or not positive."""
    joined = pixels.join(small(rigid_inverse(cameras).drop("frame_name", "width", "height")), FRAME)
    good = (F.col("depth") > 0) & ~F.isnan("depth")
    cam = [(F.col("u") - F.col("cx")) * F.col("depth") / F.col("fx"), (F.col("v") - F.col("cy")) * F.col("depth") / F.col("fy"), F.col("depth")]
    world = {n: F.when(good, sum((F.col(f"i{r}{c}") * cam[c] for c in range(3)), F.col(f"i{r}3"))) for r, n in enumerate(("x", "y", "z"))}
    return joined.withColumns(world).select(*pixels.columns, *world, ((F.col("fx") + F.col("fy")) / 2).alias("focal"))


def central_difference(columns: list[str], axis: str, frame: list[str] = FRAME) -> dict[str, Column]:
    """Half the difference between the next and the last pixel along u or v; null at borders and gaps."""
    other = "v" if axis == "u" else "u"
    w = Window.partitionBy(*frame, other).orderBy(axis)
    whole = (F.lead(axis).over(w) == F.col(axis) + 1) & (F.lag(axis).over(w) == F.col(axis) - 1)
    return {f"{c}_d{axis}": F.when(whole, (F.lead(c).over(w) - F.lag(c).over(w)) / 2) for c in columns}


def far_caps(pixels: DataFrame, percentile: float = 0.95, times: float = 1.5) -> DataFrame:
    """Depth beyond which a frame's pixels don't count; infinite for a frame without valid depth."""
    valid = F.when((F.col("depth") > 0) & ~F.isnan("depth"), F.col("depth"))
    return pixels.groupBy(*FRAME).agg(F.coalesce(F.percentile(valid, percentile) * times, F.lit(float("inf"))).alias("far_cap"))


def smooth_depth(pixels: DataFrame, sigma_range: float = 0.05, sigma_space: float = 50.0) -> DataFrame:
    """Edge-preserving mean of depth over the 13 pixels within two of each; bad depths count as 0; at the border the pixels there are."""
    offsets = F.array(*[F.struct(F.lit(a).alias("du"), F.lit(b).alias("dv")) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4])
    clean = pixels.withColumn("depth", F.when(F.isnan("depth") | F.col("depth").isNull(), 0.0).otherwise(F.col("depth")))
    spread = clean.select(*PIXEL, F.col("depth").alias("__d"), F.explode(offsets).alias("o")).select("scene_id", "frame_ord", (F.col("u") + F.col("o.du")).alias("u"), (F.col("v") + F.col("o.dv")).alias("v"), "__d", (F.col("o.du") ** 2 + F.col("o.dv") ** 2).alias("__r"))
    weight = F.exp(-F.col("__r") / (2 * sigma_space**2) - (F.col("__d") - F.col("depth")) ** 2 / (2 * sigma_range**2))
    mean = spread.join(clean.select(*PIXEL, "depth"), PIXEL).groupBy(*PIXEL).agg((F.sum(weight * F.col("__d")) / F.sum(weight)).alias("depth"))
    return clean.drop("depth").join(mean, PIXEL)


def depth_gradient(pixels: DataFrame) -> DataFrame:
    """Relative depth gradient of each pixel; null at borders or next to bad depths."""
    good = F.when((F.col("depth") > 0) & ~F.isnan("depth"), F.col("depth"))
    d = pixels.withColumn("__g", good).withColumns(central_difference(["__g"], "u")).withColumns(central_difference(["__g"], "v"))
    return d.withColumn("gradient", norm(F.col("__g_du"), F.col("__g_dv")) / (F.col("__g") + 1e-9)).drop("__g", "__g_du", "__g_dv")


def surfels(pixels: DataFrame, cameras: DataFrame, conf_min: float = 0.2, grad_max: float = 0.04, smooth: bool = False) -> DataFrame:
    """Oriented surface elements of ``pixels(scene_id, frame_ord, u, v, depth, conf, r, g, b)``.

    Keeps pixels with valid neighbours, confidence and depth within bounds and a small relative gradient.
    Windows of a frame share two sorts, one for each axis.
    """
    if smooth:
        pixels = smooth_depth(pixels)
    world = unproject(pixels, cameras)
    world = world.withColumn("__d", F.when(F.col("x").isNotNull(), F.col("depth")))
    values = ["__d", "x", "y", "z"]
    world = world.withColumns(central_difference(values, "u")).withColumns(central_difference(values, "v"))
    world = world.withColumn("gradient", norm(F.col("__d_du"), F.col("__d_dv")) / (F.col("__d") + 1e-9))
    kept = world.join(small(far_caps(pixels)), FRAME).where((F.col("depth") <= F.col("far_cap")) & (F.col("conf") >= conf_min) & (F.col("gradient") <= grad_max)).dropna(subset=[f"{c}_d{a}" for c in "xyz" for a in "uv"])
    e1, e2, n = surfel_basis([F.col(f"{c}_du") for c in "xyz"], [F.col(f"{c}_dv") for c in "xyz"])
    based = kept.select(*PIXEL, "x", "y", "z", "depth", "focal", "conf", "r", "g", "b", *[c.alias(f"{k}{i}") for k, v in (("a", e1), ("b", e2), ("n", n)) for i, c in enumerate(v)])
    quat = matrix_to_quaternion([[F.col(f"a{i}"), F.col(f"b{i}"), F.col(f"n{i}")] for i in range(3)])
    along, across = surfel_scales(F.col("depth"), F.col("focal"))
    return based.select(
        *PIXEL, "x", "y", "z", *[rgb_to_dc(F.col(c)).alias(f"f_dc_{i}") for i, c in enumerate("rgb")], conf_to_logit(F.col("conf")).alias("opacity"),
        along.alias("scale_0"), along.alias("scale_1"), across.alias("scale_2"), *[c.alias(f"rot_{i}") for i, c in enumerate(quat)], "conf",
    )


def sharpness(grey: DataFrame) -> DataFrame:
    """Population variance of the 4-neighbour Laplacian over the inner pixels of ``grey(scene_id, frame_ord, u, v, value)``."""
    across, down = Window.partitionBy(*FRAME, "v").orderBy("u"), Window.partitionBy(*FRAME, "u").orderBy("v")
    lap = F.lag("value").over(across) + F.lead("value").over(across) + F.lag("value").over(down) + F.lead("value").over(down) - 4 * F.col("value")
    return grey.withColumn("__l", lap).groupBy(*FRAME).agg(F.var_pop("__l").alias("sharpness"))
