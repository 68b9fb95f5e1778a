"""Room footprint: floor and ceiling, occupied cells, closing, holes and outline, all keyed by scene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenequarry.operators.camera import small
from scenequarry.operators.cloud import scene_bounds
from scenequarry.operators.graph import connected_components
from scenequarry.operators.stored import stored

CELL, Y_BINS = 0.05, 200
AT = ["scene_id", "cx", "cz"]
_SIDES = ((0, -1), (0, 1), (-1, 0), (1, 0))


def grids(points: DataFrame, cell: float = CELL) -> DataFrame:
    """Bounds of each scene and the size of its cell grid."""
    return scene_bounds(points).withColumn("grid_w", F.greatest(F.lit(1), F.ceil((F.col("x_max") - F.col("x_min")) / cell) + 1)).withColumn("grid_d", F.greatest(F.lit(1), F.ceil((F.col("z_max") - F.col("z_min")) / cell) + 1))


def floor_and_ceiling(points: DataFrame, bounds: DataFrame, bins: int = Y_BINS) -> DataFrame:
    """Heights at which the histogram of y has passed 5 and 95 per cent of the points."""
    span = F.greatest(F.col("y_max") - F.col("y_min"), F.lit(1e-3))
    binned = points.select("scene_id", "y").join(small(bounds.select("scene_id", "n", "y_min", "y_max")), "scene_id").withColumn("bin", F.floor((F.col("y") - F.col("y_min")) / span * bins)).where(F.col("bin").between(0, bins - 1))
    counts = binned.groupBy("scene_id", "bin").agg(F.count(F.lit(1)).alias("c"))
    run = counts.withColumn("cum", F.sum("c").over(Window.partitionBy("scene_id").orderBy("bin")))
    found = run.join(bounds.select("scene_id", "n", "y_min", "y_max"), "scene_id").groupBy("scene_id").agg(
        F.coalesce(F.min(F.when(F.col("cum") >= F.col("n") * 0.05, F.col("bin"))), F.lit(0)).alias("lo"), F.coalesce(F.min(F.when(F.col("cum") >= F.col("n") * 0.95, F.col("bin"))), F.lit(bins - 1)).alias("hi"), F.first("y_min").alias("y_min"), F.first("y_max").alias("y_max")
    )
    return found.select("scene_id", (F.col("y_min") + F.col("lo") / bins * span).alias("floor_y"), (F.col("y_min") + (F.col("hi") + 1) / bins * span).alias("ceiling_y"))


def occupancy(points: DataFrame, bounds: DataFrame, cell: float = CELL) -> DataFrame:
    """Points of each cell of the ground grid."""
    placed = points.select("scene_id", "x", "z").join(small(bounds.select("scene_id", "x_min", "z_min")), "scene_id")
    return placed.groupBy("scene_id", F.floor((F.col("x") - F.col("x_min")) / cell).alias("cx"), F.floor((F.col("z") - F.col("z_min")) / cell).alias("cz")).agg(F.count(F.lit(1)).alias("c"))


def _inside(cells: DataFrame, grid: DataFrame) -> DataFrame:
    return cells.join(small(grid.select("scene_id", "grid_w", "grid_d")), "scene_id").where("cx >= 0 AND cx < grid_w AND cz >= 0 AND cz < grid_d").drop("grid_w", "grid_d")


def _spread(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets])
    return cells.withColumn("__o", F.explode(steps)).withColumn("cx", F.col("cx") + F.col("__o.a")).withColumn("cz", F.col("cz") + F.col("__o.b")).drop("__o")


def blurred(occupied: DataFrame, grid: DataFrame) -> DataFrame:
    """Mean over the 3x3 cells around each cell that lie in the grid; cells without any count don't appear."""
    summed = _spread(occupied, [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]).join(small(grid.select("scene_id", "grid_w", "grid_d")), "scene_id").where("cx >= 0 AND cx < grid_w AND cz >= 0 AND cz < grid_d")
    edge = lambda c, n: 3 - (F.col(c) == 0).cast("int") - (F.col(c) == F.col(n) - 1).cast("int")
    return summed.groupBy(*AT).agg((F.sum("c") / F.first(edge("cx", "grid_w") * edge("cz", "grid_d"))).alias("blur"))


def occupied_mask(blur: DataFrame, grid: DataFrame) -> DataFrame:
    """Cells whose blurred count is above max(3, a fifth of the mean over all cells, rounded down)."""
    limit = F.greatest(F.lit(3), F.floor(F.col("n") / (F.col("grid_w") * F.col("grid_d")) * 0.2))
    return blur.join(small(grid.select("scene_id", limit.alias("__t"))), "scene_id").where(F.col("blur") > F.col("__t")).select(*AT)


def dilate(mask: DataFrame, grid: DataFrame) -> DataFrame:
    return _inside(_spread(mask, [(0, 0), *_SIDES]), grid).distinct()


def erode(mask: DataFrame, grid: DataFrame) -> DataFrame:
    """Cells all of whose four neighbours in the grid are in the mask: each cell is counted by itself and its neighbours."""
    votes = _inside(_spread(mask, [(0, 0), *_SIDES]), grid).groupBy(*AT).agg(F.count(F.lit(1)).alias("__v"))
    sides = lambda c, n: 2 - (F.col(c) == 0).cast("int") - (F.col(c) == F.col(n) - 1).cast("int")
    full = votes.join(small(grid.select("scene_id", "grid_w", "grid_d")), "scene_id").where(F.col("__v") == 1 + sides("cx", "grid_w") + sides("cz", "grid_d"))
    return full.select(*AT).join(mask, AT, "left_semi")


def close_gaps(mask: DataFrame, grid: DataFrame, steps: int = 2) -> DataFrame:
    for step in (dilate, erode):
        for _ in range(steps):
            mask = step(mask, grid)
        mask = stored(mask)
    return mask


def fill_holes(mask: DataFrame, grid: DataFrame) -> DataFrame:
    """The mask with every empty cell that has no way to the border (4-connected components of the empty cells)."""
    every = grid.select("scene_id", "grid_w", "grid_d", F.explode(F.sequence(F.lit(0), F.col("grid_w") - 1)).alias("cx")).withColumn("cz", F.explode(F.sequence(F.lit(0), F.col("grid_d") - 1)))
    # Runs of empty cells along x are the nodes: far fewer than cells, and rows reach across at once.
    row = Window.partitionBy("scene_id", "cz").orderBy("cx")
    run = every.join(mask, AT, "left_anti").withColumn("node", F.col("cx") - F.row_number().over(row))
    empty = stored(run.withColumn("node", F.col("cz") * F.col("grid_w") + F.min("cx").over(Window.partitionBy("scene_id", "cz", "node"))))
    south = empty.select("scene_id", F.col("node").alias("a"), "cx", (F.col("cz") + 1).alias("cz"))
    edges = south.join(empty.select(*AT, F.col("node").alias("b")), AT).select("scene_id", "a", "b").distinct()
    found = connected_components(empty.select("scene_id", "node"), edges)
    labelled = empty.join(found, ["scene_id", "node"])
    outside = labelled.where("cx = 0 OR cz = 0 OR cx = grid_w - 1 OR cz = grid_d - 1").select("scene_id", "component").distinct()
    return mask.unionByName(labelled.join(outside, ["scene_id", "component"], "left_anti").select(*AT))


def tight_bounds(mask: DataFrame, grid: DataFrame, cell: float = CELL) -> DataFrame:
    """Bounds of the mask; the scene's own where the mask is empty."""
    ends = mask.groupBy("scene_id").agg(F.min("cx").alias("a"), F.max("cx").alias("b"), F.min("cz").alias("c"), F.max("cz").alias("d"))
    return grid.join(ends, "scene_id", "left").select(
        "scene_id", F.coalesce(F.col("x_min") + F.col("a") * cell, "x_min").alias("min_x"), F.coalesce(F.col("x_min") + (F.col("b") + 1) * cell, "x_max").alias("max_x"),
        F.coalesce(F.col("z_min") + F.col("c") * cell, "z_min").alias("min_z"), F.coalesce(F.col("z_min") + (F.col("d") + 1) * cell, "z_max").alias("max_z"),
    )


def outline(mask: DataFrame, grid: DataFrame, heights: DataFrame, cell: float = CELL) -> DataFrame:
    """Boundary segments of the mask: a side of a cell whose neighbour there isn't in it, with floor and ceiling height."""
    sides = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _SIDES])
    each = mask.withColumn("s", F.explode(sides)).withColumn("nx", F.col("cx") + F.col("s.a")).withColumn("nz", F.col("cz") + F.col("s.b"))
    open_ = each.join(mask.select("scene_id", F.col("cx").alias("nx"), F.col("cz").alias("nz")), ["scene_id", "nx", "nz"], "left_anti")
    x0, z0 = F.col("x_min") + F.col("cx") * cell, F.col("z_min") + F.col("cz") * cell
    placed = open_.join(small(grid.select("scene_id", "x_min", "z_min")), "scene_id").join(small(heights), "scene_id")
    return placed.select(
        "scene_id", "cx", "cz", F.col("s.a").alias("side_x"), F.col("s.b").alias("side_z"), F.when(F.col("s.a") == 1, x0 + cell).otherwise(x0).alias("ax"), F.when(F.col("s.b") == 1, z0 + cell).otherwise(z0).alias("az"),
        F.when(F.col("s.a") == -1, x0).otherwise(x0 + cell).alias("bx"), F.when(F.col("s.b") == -1, z0).otherwise(z0 + cell).alias("bz"), "floor_y", "ceiling_y",
    )


def room_mask(points: DataFrame, grid: DataFrame) -> DataFrame:
    return fill_holes(close_gaps(occupied_mask(blurred(occupancy(points, grid), grid), grid), grid), grid)


def room_footprint(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bounds with floor and ceiling of each scene's room, and the outline of its footprint."""
    grid = stored(grids(points))
    heights = stored(floor_and_ceiling(points, grid))
    mask = stored(room_mask(points, grid))
    return tight_bounds(mask, grid).join(heights, "scene_id"), outline(mask, grid, heights)
