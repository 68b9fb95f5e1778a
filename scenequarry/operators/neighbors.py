"""Neighbour searches on a uniform grid: cells are equi-join keys, so pairs far apart never meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenequarry.functions.labels import label_similar
from scenequarry.operators.camera import BROADCAST_ROWS, small
from scenequarry.operators.cloud import XYZ, first_per_voxel
from scenequarry.operators.graph import connected_components
from scenequarry.operators.scenes import KEEP, by_scene, clusters_in_scene, nearest_in_scene, wireframe_in_scene
from scenequarry.operators.stored import remove_stored, stored

CELL = [f"__c{c}" for c in XYZ]
#: Points for each neighbour wanted above which a cell is split, and how often at most; pairs of two cells' points that are compared at once.
FULL, LEVELS, FEW_PAIRS = 2, 30, 4_096
#: Edge of the cells of a search in radii, and of the blocks in which tight cells meet in cells: larger ones copy fewer rows to cells around and compare more.
GRAIN, BLOCK = 3, 6
#: How far the voxels of a wireframe span each way.
HALF_RANGE = 51.2


def _celled(points: DataFrame, size: float | Column) -> DataFrame:
    """Points with their cell."""
    return points.withColumns({k: F.floor(F.col(c) / size) for k, c in zip(CELL, XYZ, strict=True)})


def _cells_between(rows: DataFrame, ends: dict[str, tuple[Column, Column]], size: float | Column) -> DataFrame:
    """Rows once for each cell that meets their box of ``ends``, which is taken a little larger, so that rounding loses no cell."""
    for c, k in zip(XYZ, CELL, strict=True):
        low, high = ends[c]
        # No larger than a cell: where doubles stand further apart than that, what is near is equal.
        slack = F.least(F.greatest(F.abs(low), F.abs(high)) * 1e-15 + (high - low) * 1e-9, F.lit(size))
        rows = rows.withColumn(k, F.explode(F.sequence(F.floor((low - slack) / size), F.floor((high + slack) / size))))
    return rows


def _celled_around(points: DataFrame, size: float | Column, reach: float | Column) -> DataFrame:
    """Points with each cell that is within ``reach`` of them along every axis."""
    return _cells_between(points, {c: (F.col(c) - reach, F.col(c) + reach) for c in XYZ}, size)


def near_pairs(left: DataFrame, right: DataFrame, radius: float, strict: bool = False) -> DataFrame:
    """``(scene_id, a, b, d2)`` of ids with squared distance up to ``radius`` squared (``strict``: below it); ids are ``id``."""
    size = GRAIN * radius
    one = _celled_around(left.select("scene_id", F.col("id").alias("a"), *XYZ), size, radius)
    two = _celled(right.select("scene_id", F.col("id").alias("b"), *XYZ), size).withColumnsRenamed({c: f"__r{c}" for c in XYZ})
    d2 = sum(((F.col(c) - F.col(f"__r{c}")) ** 2 for c in XYZ), F.lit(0.0))
    pairs = one.join(two, ["scene_id", *CELL]).select("scene_id", "a", "b", d2.alias("d2"))
    return pairs.where(F.col("d2") < radius**2 if strict else F.col("d2") <= radius**2)


def similar_neighbours(objects: DataFrame, radius: float = 0.6, least: float = 0.4, label: str = "label") -> DataFrame:
    """Pairs a < b of ``objects(scene_id, id, x, y, z, label)`` closer than ``radius`` with similar labels."""
    named = objects.select("scene_id", "id", F.col(label).alias("__l"))
    pairs = near_pairs(objects, objects, radius, strict=True).where("a < b")
    joined = pairs.join(named.withColumnsRenamed({"id": "a", "__l": "__la"}), ["scene_id", "a"]).join(named.withColumnsRenamed({"id": "b", "__l": "__lb"}), ["scene_id", "b"])
    return joined.where(label_similar(F.col("__la"), F.col("__lb"), least)).select("scene_id", "a", "b")


def points_in_boxes(points: DataFrame, boxes: DataFrame, base: float = 0.5) -> DataFrame:
    """``(scene_id, box_id, point_idx)`` of points inside ``boxes(scene_id, box_id, lo_x … hi_z)``, faces included.

    A box lies on the grid whose cells (``base`` times a power of two) are no smaller than it, in at most eight of them; a point takes one cell of each
    such grid. So points and boxes meet on cells, not on scenes.
    """
    edge = F.greatest(*[F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in XYZ])
    sized = boxes.where(" AND ".join(f"lo_{c} <= hi_{c}" for c in XYZ)).withColumn("__l", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(edge, F.lit(base)) / base))).cast("int"))
    levels = sorted(r[0] for r in sized.select("__l").distinct().collect())
    # Points of scenes without boxes aren't dealt to cells, where the scenes that have some are few enough to be sent to all tasks.
    scenes = stored(sized.select("scene_id").distinct(), "boxed-scenes")
    if scenes.count() <= BROADCAST_ROWS:
        points = points.join(small(scenes), "scene_id", "left_semi")
    cell = F.lit(base) * F.pow(F.lit(2.0), F.col("__l"))
    for c, k in zip(XYZ, CELL, strict=True):
        sized = sized.withColumn(k, F.explode(F.sequence(F.floor(F.col(f"lo_{c}") / cell), F.floor(F.col(f"hi_{c}") / cell))))
    placed = points.withColumn("__l", F.explode(F.array(*[F.lit(x) for x in levels or [0]]))).withColumns({k: F.floor(F.col(c) / cell) for k, c in zip(CELL, XYZ, strict=True)})
    inside = " AND ".join(f"{c} >= lo_{c} AND {c} <= hi_{c}" for c in XYZ)
    return placed.join(small(sized), ["scene_id", "__l", *CELL]).where(inside).select("scene_id", "box_id", "point_idx")


def _levelled(points: DataFrame, radius: float, level: Column) -> DataFrame:
    """Points with their cell of a level of the grid: edges are ``radius`` halved so often."""
    edge = F.lit(float(radius)) * F.pow(F.lit(2.0), -F.col("level"))
    return points.withColumn("level", level).withColumns({n: F.floor(F.col(c) / edge) for n, c in zip(CELL, XYZ, strict=True)})


def _candidates(points: DataFrame, radius: float, probes: DataFrame) -> DataFrame:
    """Points as candidates ``b``, once on each level that probes are on."""
    used = sorted(r[0] for r in probes.select("level").distinct().collect()) or [0]
    return _levelled(points, radius, F.explode(F.array(*[F.lit(x) for x in used]))).select("scene_id", "level", *CELL, F.col("id").alias("b"), *[F.col(c).alias(f"__r{c}") for c in XYZ])


def _search_levels(points: DataFrame, k: int, radius: float) -> DataFrame:
    """Stored ``points(scene_id, id, x, y, z)`` with the ``level`` of the grid to search them on and how far, ``reach``.

    Cells of edge ``radius`` are split in eight where they are full, round by round, down to the smallest around each point that holds more than ``k`` points. The ``k``-th
    nearest within that cell bounds how far the nearest can be, and the search goes to the level whose cells just exceed that.
    """
    open_, done, level, rounds = points, None, 0, []
    while True:
        cells = _levelled(open_, radius, F.lit(level))
        counts = cells.groupBy("scene_id", *CELL).agg(F.count(F.lit(1)).alias("__n"))
        # A point whose cell is too thin keeps what the level before has told.
        kept = F.col("fine") if level else F.lit(None).cast("int")
        keyed = stored(cells.join(counts, ["scene_id", *CELL]).drop(*CELL, "level").withColumn("fine", F.when(F.col("__n") > k, F.lit(level)).otherwise(kept)), "split-cells")
        rounds.append(keyed)
        settled = keyed.where(F.col("__n") <= FULL * k)
        done = settled if done is None else done.unionByName(settled)
        open_ = keyed.where(F.col("__n") > FULL * k).drop("__n")
        level += 1
        if level > LEVELS or open_.isEmpty():
            break
    found = done.drop("__n") if level <= LEVELS else done.drop("__n").unionByName(open_)
    probes = _levelled(found.where("fine IS NOT NULL"), radius, F.col("fine"))
    within = probes.withColumnRenamed("id", "a").join(_candidates(points, radius, probes), ["scene_id", "level", *CELL]).where("a != b").withColumn("d2", _d2())
    rank = F.row_number().over(Window.partitionBy("scene_id", "a").orderBy("d2"))
    # A little more than the distance itself, which is rounded.
    bound = within.withColumn("__k", rank).where(F.col("__k") == k).select("scene_id", F.col("a").alias("id"), F.least(F.lit(float(radius)), F.sqrt("d2") * (1 + 1e-9)).alias("reach"))
    reach = F.coalesce("reach", F.lit(float(radius)))
    level_of = F.when(reach > 0, F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.floor(F.log2(F.lit(float(radius)) / reach) - 1e-9)))).otherwise(F.lit(LEVELS))
    levels = stored(found.drop("fine").join(bound, ["scene_id", "id"], "left").select("scene_id", "id", *XYZ, reach.alias("reach"), level_of.cast("int").alias("level")), "levels")
    for last in rounds:
        remove_stored(levels.sparkSession, last)
    return levels


def _d2() -> Column:
    return sum(((F.col(c) - F.col(f"__r{c}")) ** 2 for c in XYZ), F.lit(0.0))


def nearest_pairs(points: DataFrame, k: int = 5, radius: float = 0.30) -> DataFrame:
    """``(scene_id, a, b, d2)``: the ``k`` nearest of each of ``points(scene_id, id, x, y, z)`` within ``radius``; of equals the lower id.

    Of points at one place only the ``k + 1`` lowest ids can be among the nearest of any, and more than ``k`` of them are each other's nearest. All others are
    searched for on cells as small as they stand close (``_search_levels``), so that a dense cell is never paired with itself as a whole.
    """
    place = Window.partitionBy("scene_id", *XYZ).orderBy("id")
    first = stored(points.select("scene_id", "id", *XYZ).withColumn("__r", F.row_number().over(place)).where(F.col("__r") <= k + 1), "places")
    crowds = first.where(F.col("__r") == k + 1).select("scene_id", *XYZ)
    together = points.select("scene_id", F.col("id").alias("a"), *XYZ).join(first.join(crowds, ["scene_id", *XYZ], "left_semi").select("scene_id", F.col("id").alias("b"), *XYZ), ["scene_id", *XYZ]).where("a != b")
    together = together.select("scene_id", "a", "b", F.lit(0.0).alias("d2"))
    searched = first.join(crowds, ["scene_id", *XYZ], "left_anti")
    # Levels are those of all candidates; only points that stand alone or with few are searched for.
    levels = _search_levels(first.drop("__r"), k, radius)
    # Cells of twice the edge, of which a point is copied to those that its reach touches only.
    probes = levels.join(searched.select("scene_id", "id"), ["scene_id", "id"], "left_semi").withColumn("level", F.col("level") - 1)
    edge = F.lit(float(radius)) * F.pow(F.lit(2.0), -F.col("level"))
    one = _celled_around(probes, edge, F.col("reach")).select("scene_id", "level", *CELL, F.col("id").alias("a"), *XYZ, "reach")
    met = one.join(_candidates(first, radius, probes), ["scene_id", "level", *CELL]).where("a != b").withColumn("d2", _d2()).where((F.col("d2") <= radius**2) & (F.col("d2") <= F.col("reach") * F.col("reach")))
    # A task keeps its k nearest of each point before they are shuffled.
    rank = F.row_number().over(Window.partitionBy("scene_id", "a").orderBy("d2", "b"))
    return met.select("scene_id", "a", "b", "d2").unionByName(together).withColumn("__k", rank).where(F.col("__k") <= k).drop("__k")


def nearest_graph(points: DataFrame, k: int = 5, radius: float = 0.30, keep: int = KEEP) -> DataFrame:
    """Undirected edges a < b from each of ``points(scene_id, id, x, y, z)`` to its ``k`` nearest within ``radius``; of equals the lower id.

    Scenes of up to ``keep`` points that are not too dense are each one task's work, others are searched by ``nearest_pairs``.
    """
    kind = points.schema["id"].dataType.simpleString()

    def searched(rest: DataFrame) -> DataFrame:
        near = stored(nearest_pairs(stored(rest, "searched"), k, radius).select("scene_id", "a", "b"), "near")
        return near.select("scene_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    return by_scene(points, lambda frame: nearest_in_scene(frame, k, radius), f"a {kind}, b {kind}", searched, keep)


def pick_points(points: DataFrame, rays: DataFrame, radius: float = 0.05) -> DataFrame:
    """First point along each ray of ``rays(scene_id, ray_id, ox, oy, oz, dx, dy, dz)`` (unit directions) within ``radius`` of it.

    A ray takes the grid's cells around it, as far as its scene's points reach; points meet rays on cells.
    """
    size = max(8 * radius, 1e-9)
    bounds = stored(points.groupBy("scene_id").agg(*[f(c).alias(f"__{n}{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))]), "bounds")
    # Pieces as long as a cell from where the ray enters the bounds to where it leaves them; each takes the cells that its box, widened by the radius, meets.
    enter, leave = [], []
    for c in XYZ:
        d = F.col(f"d{c}")
        ends = [(F.col(f"__lo{c}") - radius - F.col(f"o{c}")) / d, (F.col(f"__hi{c}") + radius - F.col(f"o{c}")) / d]
        along = F.abs(d) > 1e-12
        enter.append(F.when(along, F.least(*ends)).otherwise(F.lit(float("-inf"))))
        leave.append(F.when(along, F.greatest(*ends)).otherwise(F.lit(float("inf"))))
    reach = rays.join(small(bounds), "scene_id").withColumns({"__t0": F.greatest(F.lit(0.0), *enter), "__t1": F.least(*leave)}).where("__t1 >= __t0")
    pieces = F.greatest(F.lit(1), F.ceil((F.col("__t1") - F.col("__t0")) / size).cast("int"))
    steps = reach.withColumn("__i", F.explode(F.sequence(F.lit(0), pieces - 1)))
    at = lambda c, i: F.col(f"o{c}") + (F.col("__t0") + (F.col("__i") + i) * size) * F.col(f"d{c}")
    ends = {c: (F.least(at(c, 0), at(c, 1)) - radius, F.greatest(at(c, 0), at(c, 1)) + radius) for c in XYZ}
    # Pieces next to each other share cells; a point that is met twice is still the first or not.
    cells = _cells_between(steps, ends, size).select("scene_id", "ray_id", *[f"{k}{c}" for k in "od" for c in XYZ], *CELL)
    rel = [F.col(c) - F.col(f"o{c}") for c in XYZ]
    t = sum((r * F.col(f"d{c}") for r, c in zip(rel, XYZ, strict=True)), F.lit(0.0))
    off = sum((r * r for r in rel), F.lit(0.0)) - F.col("__t") ** 2
    hit = _celled(points, size).join(cells, ["scene_id", *CELL]).withColumn("__t", t).where(F.col("__t") > 0).where(off <= radius**2)
    best = F.min_by(F.struct("point_idx", *XYZ, F.col("__t").alias("t")), F.struct("__t", "point_idx"))
    return hit.groupBy("scene_id", "ray_id").agg(best.alias("p")).select("scene_id", "ray_id", "p.*")


def sample_per_group(rows: DataFrame, keys: list[str], ident: str, most: int = 500, seed: int = 7) -> DataFrame:
    """At most ``most`` rows of each group, the same ones on every run: the least hashes of seed and id.

    Ranking keeps a group's first ``most`` rows of each task, so that no task sees a whole group.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string")).cast("binary"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order, ident))
    return rows.withColumn("__i", rank).where(F.col("__i") <= most).drop("__i")


def density_clusters(points: DataFrame, radius: float = 0.15, least: int = 30, keep: int = KEEP) -> DataFrame:
    """Density clusters of ``points(scene_id, id, x, y, z)``: ``(scene_id, id, cluster)``, -1 for noise.

    A core point has ``least`` points within ``radius``, itself included. Clusters are components of core points, numbered by
    their least core id; a border point joins the least component it touches. Scenes of up to ``keep`` points that are not too dense are each one task's
    work, others go by cells (``clusters_by_cells``). Rows that share an id are one point in several places.
    """
    kind = points.schema["id"].dataType.simpleString()
    return by_scene(points, lambda frame: clusters_in_scene(frame, radius, least), f"id {kind}, cluster int", lambda rest: clusters_by_cells(rest, radius, least), keep)


def clusters_by_cells(points: DataFrame, radius: float, least: int) -> DataFrame:
    """The clusters of ``density_clusters``, for scenes of any size and density.

    Points are kept by cells so tight that all of a cell are near each other: those of
    a cell with ``least`` are core without a pair, cells are linked as wholes, and only points of thin cells, fewer than ``least`` a cell, are paired with others. Rows that
    share an id are one point in several places.
    """
    points = stored(points.select("scene_id", "id", *XYZ), "clustered")
    own = _tight_cells(points, radius)
    full = stored(own.groupBy("scene_id", *CELL).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select("scene_id", *CELL), "full-cells")
    crowded = own.join(full, ["scene_id", *CELL], "left_semi").select("scene_id", "id")
    thin = own.join(full, ["scene_id", *CELL], "left_anti").drop(*CELL)
    counted = near_pairs(thin, points, radius).groupBy("scene_id", F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("scene_id", "id")
    core = stored(crowded.unionByName(counted).distinct(), "core-points")
    core_points = stored(points.join(core, ["scene_id", "id"], "left_semi"), "core-points")
    cells = stored(_tight_cells(core_points, radius).groupBy("scene_id", *CELL).agg(F.min("id").alias("node")), "core-cells")
    placed = stored(_tight_cells(core_points, radius).join(cells, ["scene_id", *CELL]).select("scene_id", "id", "node"), "core-nodes")
    # An id that stands in several places holds their cells together.
    again = placed.groupBy("scene_id", "id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("scene_id", "id", "a")
    several = placed.join(again, ["scene_id", "id"]).where("a < node").select("scene_id", "a", F.col("node").alias("b"))
    joined = connected_components(cells.select("scene_id", "node"), linked_cells(core_points, radius).unionByName(several))
    label = placed.join(joined, ["scene_id", "node"])
    number = joined.select("scene_id", "component").distinct().withColumn("cluster", (F.dense_rank().over(Window.partitionBy("scene_id").orderBy("component")) - 1).cast("int"))
    own = stored(label.groupBy("scene_id", "id").agg(F.min("component").alias("component")), "core-labels")
    others = points.join(core, ["scene_id", "id"], "left_anti")
    touched = near_pairs(others, core_points, radius).join(own.withColumnRenamed("id", "b"), ["scene_id", "b"]).groupBy("scene_id", F.col("a").alias("id")).agg(F.min("component").alias("component"))
    best = own.unionByName(touched).join(number, ["scene_id", "component"])
    return points.select("scene_id", "id").join(best.select("scene_id", "id", "cluster"), ["scene_id", "id"], "left").na.fill(-1, ["cluster"])


def _tight_cells(points: DataFrame, radius: float, parts: int = 1) -> DataFrame:
    """Points with their cell of an edge that keeps any two points of a cell within ``radius``, divided in ``parts`` along each side."""
    edge = radius / 3**0.5 * (1 - 1e-9) / parts
    return points.withColumns({n: F.floor(F.col(c) / edge) for n, c in zip(CELL, XYZ, strict=True)})


def linked_cells(points: DataFrame, radius: float) -> DataFrame:
    """``(scene_id, a, b)``: pairs of tight cells, by the least id of their points, of which two points are within ``radius``.

    Boxes around the points decide most pairs: as a whole within the radius, or as a whole beyond it. Pairs that neither holds for are compared point by
    point if they are few, else both cells are split and their parts are judged alike, until one pair of parts is within or none is left.
    """
    limit, slack = radius**2, 1e-12
    ends = [f(c).alias(f"{n}{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))]
    root = _tight_cells(points, radius)
    cells = stored(root.groupBy("scene_id", *CELL).agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"), *ends), "cells")
    owned = stored(root.join(cells.select("scene_id", *CELL, "node"), ["scene_id", *CELL]).select("scene_id", "id", *XYZ, "node"), "cell-points")
    boxes = ["n", *[f"{e}{c}" for c in XYZ for e in ("lo", "hi")]]
    least = sum((F.greatest(F.lit(0.0), F.col(f"a_lo{c}") - F.col(f"b_hi{c}"), F.col(f"b_lo{c}") - F.col(f"a_hi{c}")) ** 2 for c in XYZ), F.lit(0.0))
    most = sum((F.greatest(F.col(f"a_hi{c}") - F.col(f"b_lo{c}"), F.col(f"b_hi{c}") - F.col(f"a_lo{c}")) ** 2 for c in XYZ), F.lit(0.0))
    side = lambda df, s, keys: df.select("scene_id", *keys, F.col("node").alias(s), *[F.col(x).alias(f"{s}_{x}") for x in boxes])
    # Two cells at most apart along each axis, each pair once; a cell is copied to the blocks that those around it are in, not to each of them.
    block = [f"__b{c}" for c in XYZ]
    moved = side(cells, "a", CELL)
    for k, n in zip(block, CELL, strict=True):
        moved = moved.withColumn(k, F.explode(F.sequence(F.floor((F.col(n) - 2) / BLOCK), F.floor((F.col(n) + 2) / BLOCK)))).withColumnRenamed(n, f"__a{n}")
    others = side(cells, "b", CELL).withColumns({k: F.floor(F.col(n) / BLOCK) for k, n in zip(block, CELL, strict=True)})
    apart = [F.col(n) - F.col(f"__a{n}") for n in CELL]
    after = (apart[0] > 0) | ((apart[0] == 0) & ((apart[1] > 0) | ((apart[1] == 0) & (apart[2] > 0))))
    near = after & (F.abs(apart[0]) <= 2) & (F.abs(apart[1]) <= 2) & (F.abs(apart[2]) <= 2)
    met = moved.join(others, ["scene_id", *block]).where(near).drop(*CELL, *[f"__a{n}" for n in CELL], *block)
    found, parts = None, 1
    while True:
        judged = stored(met.withColumns({"__near": most <= limit * (1 - slack), "__far": least > limit * (1 + slack)}).where("NOT __far"), "cell-pairs")
        linked = judged.where("__near").select("scene_id", "a", "b").distinct()
        rest = judged.where("NOT __near").join(linked, ["scene_id", "a", "b"], "left_anti")
        few = rest.where(F.col("a_n") * F.col("b_n") <= FEW_PAIRS)
        keys = [f"__{s}{n}" for s in "ab" for n in CELL] if parts > 1 else []
        part = _tight_cells(owned, radius, parts) if parts > 1 else owned
        at = lambda s, part=part: part.select("scene_id", F.col("node").alias(s), *[F.col(c).alias(f"{s}{c}") for c in XYZ], *([F.col(n).alias(f"__{s}{n}") for n in CELL] if parts > 1 else []))
        d2 = sum(((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in XYZ), F.lit(0.0))
        for s in "ab":
            few = few.join(at(s), ["scene_id", s, *[k for k in keys if k.startswith(f"__{s}")]])
        new = stored(linked.unionByName(few.where(d2 <= limit).select("scene_id", "a", "b").distinct()).distinct(), "linked-cells")
        found = new if found is None else found.unionByName(new)
        open_ = stored(rest.where(F.col("a_n") * F.col("b_n") > FEW_PAIRS).join(new, ["scene_id", "a", "b"], "left_anti").select("scene_id", "a", "b", *keys).distinct(), "open-cells")
        if open_.isEmpty():
            return found.select("scene_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        # Parts of the open cells: half the edge, each with the part that it is in so far.
        nodes = open_.select("scene_id", F.explode(F.array("a", "b")).alias("node")).distinct()
        finer = _tight_cells(owned.join(nodes, ["scene_id", "node"], "left_semi"), radius, 2 * parts)
        coarse = {f"__p{n}": F.floor(F.col(n) / 2) for n in CELL} if parts > 1 else {}
        pieces = stored(finer.withColumns(coarse).groupBy("scene_id", "node", *CELL, *coarse).agg(F.count(F.lit(1)).alias("n"), *ends), "cell-parts")
        met = open_
        for s in "ab":
            mine = pieces.select("scene_id", F.col("node").alias(s), *[F.col(f"__p{n}").alias(f"__{s}{n}") for n in (CELL if coarse else [])], *[F.col(n).alias(f"__n{s}{n}") for n in CELL], *[F.col(x).alias(f"{s}_{x}") for x in boxes])
            met = met.join(mine, ["scene_id", s, *[k for k in keys if k.startswith(f"__{s}")]])
        met = met.drop(*keys).withColumnsRenamed({f"__n{s}{n}": f"__{s}{n}" for s in "ab" for n in CELL})
        parts *= 2


def wireframe(points: DataFrame, boxes: DataFrame, voxel: float = 0.05, per_object: int = 500, k: int = 5, radius: float = 0.30, keep: int = KEEP) -> DataFrame:
    """Edges of the neighbour graph over one point a voxel and up to ``per_object`` points of each box; scenes of up to ``keep`` points are each one task's work."""
    sampled = sample_per_group(points_in_boxes(points, boxes), ["scene_id", "box_id"], "point_idx", per_object)
    inside = stored(sampled.select("scene_id", F.col("point_idx").alias("id")).distinct(), "box-samples")
    kind = points.schema["point_idx"].dataType.simpleString()

    def searched(rest: DataFrame) -> DataFrame:
        base = first_per_voxel(rest.withColumnRenamed("id", "point_idx"), voxel, HALF_RANGE).select("scene_id", F.col("point_idx").alias("id"))
        return nearest_graph(stored(rest.join(base.union(inside).distinct(), ["scene_id", "id"], "left_semi")), k, radius, keep)

    return by_scene(points.withColumnRenamed("point_idx", "id"), lambda frame, marked: wireframe_in_scene(frame, marked, voxel, HALF_RANGE, k, radius), f"a {kind}, b {kind}", searched, keep, inside)
