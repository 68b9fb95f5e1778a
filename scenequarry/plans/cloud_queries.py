"""Queries over clouds: extents, thinning, neighbours, rooms."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenequarry.functions import geometry as g
from scenequarry.operators import cloud, graph, neighbors, room
from scenequarry.operators.stored import stored
from scenequarry.plans.registry import REGISTRY

add = REGISTRY.add
FRACTION = 0.02

_SIZES = """e AS (SELECT scene_id, sqrt(power(quantile_cont(x, 0.975) - quantile_cont(x, 0.025), 2) + power(quantile_cont(y, 0.975) - quantile_cont(y, 0.025), 2) + power(quantile_cont(z, 0.975) - quantile_cont(z, 0.025), 2)) AS extent FROM points GROUP BY scene_id),
vs AS (SELECT scene_id, extent, greatest(extent * 0.02, 1e-4) AS voxel FROM e)"""
_THIN = f"""{_SIZES},
rk AS (SELECT p.*, row_number() OVER (PARTITION BY p.scene_id, floor(x / voxel), floor(y / voxel), floor(z / voxel) ORDER BY conf DESC, point_idx) AS k FROM points p JOIN vs USING (scene_id)),
thin AS (SELECT * EXCLUDE (k) FROM rk WHERE k = 1)"""


def _thinned(get):
    points = get("points")
    return cloud.thin_voxels(points, cloud.voxel_sizes(points, FRACTION))


@add("a1_scene_bounds", "SELECT scene_id, count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max, sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2) + power(max(z) - min(z), 2)) AS diagonal FROM points GROUP BY scene_id", "x_min x_max y_min y_max z_min z_max diagonal")
def _(get):
    return cloud.scene_bounds(get("points"))


@add("a2_voxel_sizes", f"WITH {_SIZES} SELECT * FROM vs", "extent voxel")
def _(get):
    return cloud.voxel_sizes(get("points"), FRACTION)


@add("a4_depth_tolerance", "SELECT scene_id, greatest(0.1, 0.02 * sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2) + power(max(z) - min(z), 2))) AS epsilon FROM points GROUP BY scene_id", "epsilon")
def _(get):
    return cloud.depth_tolerance(cloud.scene_bounds(get("points"))).select("scene_id", "epsilon")


@add("a7_small_scenes", "SELECT scene_id, count(*) AS n FROM points_k GROUP BY scene_id HAVING count(*) < 1000")
def _(get):
    return cloud.reject_small(get("points_k"))


@add("w1_voxel_thinning_counts", f"WITH {_THIN} SELECT scene_id, count(*) AS n, CAST(sum(point_idx % 1000003) AS BIGINT) AS id_sum FROM thin GROUP BY scene_id")
def _(get):
    return _thinned(get).groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("point_idx") % 1000003).alias("id_sum"))


@add("w1_voxel_thinning", f"WITH {_THIN} SELECT * FROM thin", "x y z conf opacity")
def _(get):
    return _thinned(get)


@add("w17_first_per_voxel", "SELECT scene_id, CAST(floor(x / 0.05) AS BIGINT) AS kx, CAST(floor(y / 0.05) AS BIGINT) AS ky, CAST(floor(z / 0.05) AS BIGINT) AS kz, min(point_idx) AS point_idx FROM points WHERE x >= -51.2 AND x < 51.2 AND y >= -51.2 AND y < 51.2 AND z >= -51.2 AND z < 51.2 GROUP BY ALL")
def _(get):
    return cloud.first_per_voxel(get("points"))


@add("w18_strided_sample", "WITH r AS (SELECT scene_id, point_idx, row_number() OVER (PARTITION BY scene_id ORDER BY point_idx) - 1 AS i, count(*) OVER (PARTITION BY scene_id) AS n FROM points) SELECT scene_id, point_idx FROM r WHERE i % greatest(1, CAST(ceil(n / 8000) AS BIGINT)) = 0")
def _(get):
    return cloud.strided_sample(get("points")).select("scene_id", "point_idx")


@add("p1_opacity_filter", "SELECT scene_id, count(*) AS n FROM points WHERE 1 / (1 + exp(-opacity)) >= 0.3 GROUP BY scene_id")
def _(get):
    return cloud.filter_opacity(get("points"), 0.3).groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))


@add("a31_field_statistics", " UNION ALL ".join(f"SELECT scene_id, '{c}' AS field, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, avg({c}) AS mean, stddev_samp({c}) AS deviation FROM points GROUP BY scene_id" for c in ("x", "y", "z", "conf", "opacity")), "low high mean deviation", 5)
def _(get):
    return cloud.field_statistics(get("points"), ["x", "y", "z", "conf", "opacity"])


@add("a31_synthetic_flags", "SELECT scene_id, stddev_samp(opacity) < 0.01 AS flat_opacity, false AS flat_scale, stddev_samp(conf) < 0.05 AS flat_colour FROM points GROUP BY scene_id")
def _(get):
    return cloud.synthetic_flags(cloud.field_statistics(get("points").withColumn("f_dc_0", F.col("conf")), ["opacity", "f_dc_0"]))


@add("p9_p10_colour_and_logit", f"SELECT scene_id, point_idx, (conf - 0.5) / {g.SH_C0} AS dc, least(greatest((conf - 0.5) / {g.SH_C0} * {g.SH_C0} + 0.5, 0), 1) AS rgb, ln(least(greatest(conf, 0.1), 0.99) / (1 - least(greatest(conf, 0.1), 0.99))) AS logit FROM points", "dc rgb logit")
def _(get):
    dc = g.rgb_to_dc(F.col("conf"))
    return get("points").select("scene_id", "point_idx", dc.alias("dc"), g.dc_to_rgb(dc).alias("rgb"), g.conf_to_logit(F.col("conf")).alias("logit"))


@add("p11_flip_frame", "SELECT scene_id, id, x, -y AS y, -z AS z, lo_x, -hi_y AS lo_y, -hi_z AS lo_z, hi_x, -lo_y AS hi_y, -lo_z AS hi_z FROM annotations", "x y z lo_x lo_y lo_z hi_x hi_y hi_z")
def _(get):
    x, y, z = g.flip_point(*[F.col(c) for c in "xyz"])
    lo, hi = g.flip_box([F.col(f"lo_{c}") for c in "xyz"], [F.col(f"hi_{c}") for c in "xyz"])
    return get("annotations").select("scene_id", "id", x.alias("x"), y.alias("y"), z.alias("z"), *[c.alias(f"lo_{a}") for a, c in zip("xyz", lo, strict=True)], *[c.alias(f"hi_{a}") for a, c in zip("xyz", hi, strict=True)])


_T = "least(greatest(t, 0), 1)"
_POLY = {k: f"least(greatest((({p[3]} * {_T} + {p[2]}) * {_T} + ({p[1]})) * {_T} + ({p[0]}), 0), 1)" for k, p in g.TURBO.items()}


@add("p23_depth_colours", f"WITH b AS (SELECT scene_id, greatest(sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2) + power(max(z) - min(z), 2)), 1e-3) AS d FROM points GROUP BY scene_id), v AS (SELECT p.scene_id, point_idx, sqrt(x * x + y * y + z * z) / d AS t FROM points p JOIN b USING (scene_id)) SELECT scene_id, point_idx, t, {_POLY['r']} AS r, {_POLY['g']} AS g, {_POLY['b']} AS b FROM v", "t r g b")
def _(get):
    return cloud.colorize(get("points").select("scene_id", "point_idx", "x", "y", "z")).select("scene_id", "point_idx", "t", "r", "g", "b")


_BOXES = "bx AS (SELECT 's' || scene_id AS scene_id, id AS box_id, lo_x, lo_y, lo_z, hi_x, hi_y, hi_z FROM annotations), ib AS (SELECT scene_id, box_id, id AS point_idx FROM points_k p JOIN bx USING (scene_id) WHERE x BETWEEN lo_x AND hi_x AND y BETWEEN lo_y AND hi_y AND z BETWEEN lo_z AND hi_z)"
_SAMPLE = "sm AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, box_id ORDER BY md5('7:' || point_idx), point_idx) AS k FROM ib) WHERE k <= 500)"


@add("j7_points_in_boxes", f"WITH {_BOXES} SELECT scene_id, box_id, count(*) AS n, CAST(sum(point_idx % 1000003) AS BIGINT) AS id_sum FROM ib GROUP BY scene_id, box_id")
def _(get):
    inside = neighbors.points_in_boxes(_points_k(get), _boxes(get))
    return inside.groupBy("scene_id", "box_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("point_idx") % 1000003).alias("id_sum"))


def _points_k(get, spread=True):
    return get("points_k", spread=spread).withColumnRenamed("id", "point_idx")


def _boxes(get):
    """Boxes of all annotations."""
    return get("annotations").select(F.concat(F.lit("s"), "scene_id").alias("scene_id"), F.col("id").alias("box_id"), *[f"{e}_{c}" for e in ("lo", "hi") for c in "xyz"])


@add("w16_object_samples", f"WITH {_BOXES}, {_SAMPLE.replace('500', '20')} SELECT scene_id, box_id, count(*) AS n, CAST(sum(point_idx % 1000003) AS BIGINT) AS id_sum FROM sm GROUP BY scene_id, box_id")
def _(get):
    inside = neighbors.points_in_boxes(_points_k(get), _boxes(get))
    return neighbors.sample_per_group(inside, ["scene_id", "box_id"], "point_idx", 20).groupBy("scene_id", "box_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("point_idx") % 1000003).alias("id_sum"))


@add("o5_wireframe_seeds", f"WITH v AS (SELECT scene_id, min(id) AS point_idx FROM points_k GROUP BY scene_id, floor(x / 0.05), floor(y / 0.05), floor(z / 0.05)), {_BOXES} SELECT scene_id, count(*) AS n FROM (SELECT scene_id FROM v UNION ALL SELECT scene_id FROM ib) GROUP BY scene_id")
def _(get):
    points = _points_k(get)
    seeds = cloud.first_per_voxel(points).select("scene_id").unionAll(neighbors.points_in_boxes(points, _boxes(get)).select("scene_id"))
    return seeds.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))


_KNN = "WITH d AS (SELECT p.scene_id, p.id AS a, q.id AS b, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) AS d2 FROM points_k p JOIN points_k q ON p.scene_id = q.scene_id AND p.id <> q.id AND abs(p.x - q.x) <= 0.3 AND abs(p.z - q.z) <= 0.3), r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, a ORDER BY d2, b) AS k FROM d WHERE d2 <= 0.3 * 0.3) SELECT DISTINCT scene_id, least(a, b) AS a, greatest(a, b) AS b FROM r WHERE k <= 5"


@add("j8_nearest_graph", _KNN)
def _(get):
    return neighbors.nearest_graph(get("points_k", spread=False))


@add("g10_wireframe", f"WITH {_BOXES}, {_SAMPLE}, ch AS (SELECT scene_id, min(id) AS id FROM points_k WHERE x >= -51.2 AND x < 51.2 AND y >= -51.2 AND y < 51.2 AND z >= -51.2 AND z < 51.2 GROUP BY scene_id, floor(x / 0.05), floor(y / 0.05), floor(z / 0.05) UNION SELECT scene_id, point_idx FROM sm), pc AS (SELECT p.* FROM points_k p SEMI JOIN ch ON p.scene_id = ch.scene_id AND p.id = ch.id), {_KNN.removeprefix('WITH ').replace('points_k', 'pc')}")
def _(get):
    return neighbors.wireframe(_points_k(get, spread=False), _boxes(get))


@add("j9_pick_points", "WITH ry AS (SELECT 's' || scene_id AS scene_id, ordinal AS ray_id, x AS ox, y AS oy, -1.0 AS oz, 0.0 AS dx, 0.0 AS dy, 1.0 AS dz FROM annotations), h AS (SELECT scene_id, ray_id, id AS point_idx, p.x, p.y, p.z, (p.z - oz) AS t FROM points_k p JOIN ry USING (scene_id) WHERE (p.z - oz) > 0 AND (p.x - ox) * (p.x - ox) + (p.y - oy) * (p.y - oy) + (p.z - oz) * (p.z - oz) - (p.z - oz) * (p.z - oz) <= 0.05 * 0.05), r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, ray_id ORDER BY t, point_idx) AS k FROM h) SELECT * EXCLUDE (k) FROM r WHERE k = 1", "x y z t")
def _(get):
    rays = get("annotations").select(F.concat(F.lit("s"), "scene_id").alias("scene_id"), F.col("ordinal").alias("ray_id"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.lit(-1.0).alias("oz"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(1.0).alias("dz"))
    return neighbors.pick_points(_points_k(get), rays)


_DENSITY = """WITH RECURSIVE d AS (SELECT p.scene_id, p.id AS a, q.id AS b FROM points_k p JOIN points_k q ON p.scene_id = q.scene_id AND abs(p.x - q.x) <= 0.25 AND abs(p.z - q.z) <= 0.25 WHERE (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) <= 0.25 * 0.25),
co AS (SELECT scene_id, a FROM d GROUP BY scene_id, a HAVING count(*) >= 4), dc AS (SELECT d.* FROM d SEMI JOIN co ON d.scene_id = co.scene_id AND d.a = co.a), ed AS (SELECT dc.* FROM dc SEMI JOIN co ON dc.scene_id = co.scene_id AND dc.b = co.a WHERE dc.a <> dc.b),
cc(scene_id, node, c) USING KEY (scene_id, node) AS (SELECT scene_id, a, a FROM co UNION SELECT ed.scene_id, ed.b, min(cc.c) FROM cc JOIN ed ON cc.scene_id = ed.scene_id AND cc.node = ed.a JOIN recurring.cc o ON o.scene_id = ed.scene_id AND o.node = ed.b AND o.c > cc.c GROUP BY ed.scene_id, ed.b),
lb AS (SELECT scene_id, node AS id, c FROM cc UNION ALL SELECT dc.scene_id, dc.b, min(cc.c) FROM dc JOIN cc ON dc.scene_id = cc.scene_id AND dc.a = cc.node ANTI JOIN co ON dc.scene_id = co.scene_id AND dc.b = co.a GROUP BY dc.scene_id, dc.b),
nr AS (SELECT scene_id, c, row_number() OVER (PARTITION BY scene_id ORDER BY c) - 1 AS cluster FROM (SELECT DISTINCT scene_id, c FROM cc)),
gc AS (SELECT p.scene_id, p.id, CAST(coalesce(nr.cluster, -1) AS INT) AS cluster FROM points_k p LEFT JOIN lb ON p.scene_id = lb.scene_id AND p.id = lb.id LEFT JOIN nr ON nr.scene_id = lb.scene_id AND nr.c = lb.c)"""


@add("g2_density_clusters", _DENSITY + " SELECT * FROM gc")
def _(get):
    return neighbors.density_clusters(get("points_k", spread=False), 0.25, 4)


@add("a33_noise_share", _DENSITY + " SELECT scene_id, avg(CASE WHEN cluster = -1 THEN 1.0 ELSE 0.0 END) AS noise FROM gc GROUP BY scene_id", "noise")
def _(get):
    from scenequarry.operators.merge import noise_share

    return noise_share(neighbors.density_clusters(get("points_k", spread=False), 0.25, 4))


@add("w21_top_clusters", _DENSITY + " SELECT scene_id, cluster, count(*) AS n FROM gc WHERE cluster BETWEEN 0 AND 11 GROUP BY scene_id, cluster")
def _(get):
    from scenequarry.operators.merge import top_clusters

    found = top_clusters(neighbors.density_clusters(get("points_k", spread=False), 0.25, 4), 12)
    return found.groupBy("scene_id", "cluster").agg(F.count(F.lit(1)).alias("n"))


@add("g1_connected_components", "WITH RECURSIVE e AS (SELECT scene_id, mask_ord AS a, mask_ord + 9 + mask_ord % 4 * 3 AS b FROM masks), u AS (SELECT e.scene_id, e.a, e.b FROM e JOIN masks m ON e.scene_id = m.scene_id AND e.b = m.mask_ord WHERE e.a % 5 <> 0), both_ways AS (SELECT * FROM u UNION SELECT scene_id, b, a FROM u), w AS (SELECT scene_id, mask_ord AS node, mask_ord AS c FROM masks UNION SELECT w.scene_id, x.b, w.c FROM w JOIN both_ways x ON w.scene_id = x.scene_id AND w.node = x.a) SELECT scene_id, node, min(c) AS component FROM w GROUP BY scene_id, node")
def _(get):
    masks = get("masks").select("scene_id", F.col("mask_ord").alias("node"))
    edges = masks.select("scene_id", F.col("node").alias("a"), (F.col("node") + 9 + F.col("node") % 4 * 3).alias("b")).where("a % 5 != 0").join(masks.select("scene_id", F.col("node").alias("b")), ["scene_id", "b"], "left_semi")
    return graph.connected_components(masks, edges)


_ROOM = """WITH b AS (SELECT scene_id, count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max FROM points GROUP BY scene_id),
gr AS (SELECT *, greatest(1, CAST(ceil((x_max - x_min) / 0.05) AS BIGINT) + 1) AS gw, greatest(1, CAST(ceil((z_max - z_min) / 0.05) AS BIGINT) + 1) AS gd FROM b),
oc AS (SELECT p.scene_id, CAST(floor((x - x_min) / 0.05) AS BIGINT) AS cx, CAST(floor((z - z_min) / 0.05) AS BIGINT) AS cz, count(*) AS c FROM points p JOIN gr USING (scene_id) GROUP BY ALL)"""
_BLUR = _ROOM + """, nb AS (SELECT oc.scene_id, cx + dx AS cx, cz + dz AS cz, c FROM oc, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) k(dz)),
bl AS (SELECT nb.scene_id, cx, cz, sum(c) / ((3 - CAST(cx = 0 AS INT) - CAST(cx = gw - 1 AS INT)) * (3 - CAST(cz = 0 AS INT) - CAST(cz = gd - 1 AS INT))) AS blur FROM nb JOIN gr USING (scene_id) WHERE cx >= 0 AND cx < gw AND cz >= 0 AND cz < gd GROUP BY nb.scene_id, cx, cz, gw, gd)"""
_MASK = _BLUR + ", mk AS (SELECT scene_id, cx, cz FROM bl JOIN gr USING (scene_id) WHERE blur > greatest(3, floor(n / (gw * gd) * 0.2)))"


def _dilated(source: str, name: str) -> str:
    return f", {name} AS (SELECT DISTINCT s.scene_id, cx + dx AS cx, cz + dz AS cz FROM {source} s JOIN gr USING (scene_id), (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) o(dx, dz) WHERE cx + dx >= 0 AND cx + dx < gw AND cz + dz >= 0 AND cz + dz < gd)"


def _eroded(source: str, name: str) -> str:
    lost = f"SELECT s.scene_id, s.cx, s.cz FROM {source} s JOIN gr USING (scene_id), (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dx, dz) WHERE cx + dx >= 0 AND cx + dx < gw AND cz + dz >= 0 AND cz + dz < gd AND NOT EXISTS (SELECT 1 FROM {source} t WHERE t.scene_id = s.scene_id AND t.cx = s.cx + dx AND t.cz = s.cz + dz)"
    return f", {name} AS (SELECT scene_id, cx, cz FROM {source} EXCEPT ({lost}))"


_CLOSED = _MASK + _dilated("mk", "d1") + _dilated("d1", "d2") + _eroded("d2", "e1") + _eroded("e1", "cl")


@add("a21_floor_and_ceiling", "WITH b AS (SELECT scene_id, count(*) AS n, min(y) AS lo, max(y) AS hi FROM points GROUP BY scene_id), h AS (SELECT p.scene_id, CAST(floor((y - lo) / greatest(hi - lo, 1e-3) * 200) AS BIGINT) AS bin, count(*) AS c FROM points p JOIN b USING (scene_id) GROUP BY ALL), r AS (SELECT scene_id, bin, sum(c) OVER (PARTITION BY scene_id ORDER BY bin) AS cum FROM h WHERE bin BETWEEN 0 AND 199) SELECT scene_id, min(lo) + coalesce(min(bin) FILTER (cum >= n * 0.05), 0) / 200 * greatest(min(hi) - min(lo), 1e-3) AS floor_y, min(lo) + (coalesce(min(bin) FILTER (cum >= n * 0.95), 199) + 1) / 200 * greatest(min(hi) - min(lo), 1e-3) AS ceiling_y FROM r JOIN b USING (scene_id) GROUP BY scene_id", "floor_y ceiling_y")
def _(get):
    points = get("points")
    return room.floor_and_ceiling(points, room.grids(points))


@add("a22_occupancy", _ROOM + " SELECT scene_id, cx, cz, c FROM oc")
def _(get):
    points = get("points")
    return room.occupancy(points, room.grids(points))


@add("a23_blurred_occupancy", _BLUR + " SELECT scene_id, cx, cz, blur FROM bl", "blur")
def _(get):
    points = get("points")
    return room.blurred(room.occupancy(points, room.grids(points)), room.grids(points))


@add("a24_occupied_mask", _MASK + " SELECT scene_id, cx, cz FROM mk")
def _(get):
    points = get("points")
    grid = stored(room.grids(points))
    return room.occupied_mask(room.blurred(room.occupancy(points, grid), grid), grid)


@add("g3_closed_mask", _CLOSED + " SELECT scene_id, cx, cz FROM cl")
def _(get):
    points = get("points")
    grid = stored(room.grids(points))
    return room.close_gaps(room.occupied_mask(room.blurred(room.occupancy(points, grid), grid), grid), grid)


_FILLED = "WITH RECURSIVE " + _CLOSED.removeprefix("WITH ") + """, ev AS (SELECT scene_id, gw, gd, cx, unnest(range(0, gd)) AS cz FROM (SELECT scene_id, gw, gd, unnest(range(0, gw)) AS cx FROM gr)),
em AS (SELECT ev.* FROM ev ANTI JOIN cl ON ev.scene_id = cl.scene_id AND ev.cx = cl.cx AND ev.cz = cl.cz),
fl AS (SELECT scene_id, cx, cz FROM em WHERE cx = 0 OR cz = 0 OR cx = gw - 1 OR cz = gd - 1 UNION SELECT em.scene_id, em.cx, em.cz FROM (SELECT scene_id, cx + dx AS cx, cz + dz AS cz FROM fl, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dx, dz)) s JOIN em ON s.scene_id = em.scene_id AND s.cx = em.cx AND s.cz = em.cz),
rm AS (SELECT scene_id, cx, cz FROM cl UNION ALL SELECT em.scene_id, em.cx, em.cz FROM em ANTI JOIN fl ON em.scene_id = fl.scene_id AND em.cx = fl.cx AND em.cz = fl.cz),
yh AS (SELECT p.scene_id, CAST(floor((y - y_min) / greatest(y_max - y_min, 1e-3) * 200) AS BIGINT) AS bin, count(*) AS c FROM points p JOIN b USING (scene_id) GROUP BY ALL), yr AS (SELECT scene_id, bin, sum(c) OVER (PARTITION BY scene_id ORDER BY bin) AS cum FROM yh WHERE bin BETWEEN 0 AND 199),
ht AS (SELECT scene_id, min(y_min) + coalesce(min(bin) FILTER (cum >= n * 0.05), 0) / 200 * greatest(min(y_max) - min(y_min), 1e-3) AS floor_y, min(y_min) + (coalesce(min(bin) FILTER (cum >= n * 0.95), 199) + 1) / 200 * greatest(min(y_max) - min(y_min), 1e-3) AS ceiling_y FROM yr JOIN b USING (scene_id) GROUP BY scene_id)"""


@add("g4_filled_mask", _FILLED + " SELECT * FROM rm")
def _(get):
    points = get("points")
    return room.room_mask(points, stored(room.grids(points)))


@add("a25_g9_room_bounds", _FILLED + ", en AS (SELECT scene_id, min(cx) AS a, max(cx) AS bb, min(cz) AS c, max(cz) AS d FROM rm GROUP BY scene_id) SELECT b.scene_id, coalesce(x_min + a * 0.05, x_min) AS min_x, coalesce(x_min + (bb + 1) * 0.05, x_max) AS max_x, coalesce(z_min + c * 0.05, z_min) AS min_z, coalesce(z_min + (d + 1) * 0.05, z_max) AS max_z, floor_y, ceiling_y FROM b LEFT JOIN en USING (scene_id) JOIN ht USING (scene_id)", "min_x max_x min_z max_z floor_y ceiling_y")
def _(get):
    return room.room_footprint(get("points"))[0]


@add("g5_room_outline", _FILLED + ", sd AS (SELECT rm.*, dx, dz FROM rm, (VALUES (0, -1), (0, 1), (-1, 0), (1, 0)) o(dx, dz)), op AS (SELECT sd.* FROM sd ANTI JOIN rm ON sd.scene_id = rm.scene_id AND sd.cx + dx = rm.cx AND sd.cz + dz = rm.cz), pl AS (SELECT op.*, x_min + cx * 0.05 AS x0, z_min + cz * 0.05 AS z0 FROM op JOIN b USING (scene_id)) SELECT scene_id, cx, cz, CAST(dx AS INT) AS side_x, CAST(dz AS INT) AS side_z, CASE WHEN dx = 1 THEN x0 + 0.05 ELSE x0 END AS ax, CASE WHEN dz = 1 THEN z0 + 0.05 ELSE z0 END AS az, CASE WHEN dx = -1 THEN x0 ELSE x0 + 0.05 END AS bx, CASE WHEN dz = -1 THEN z0 ELSE z0 + 0.05 END AS bz, floor_y, ceiling_y FROM pl JOIN ht USING (scene_id)", "ax az bx bz floor_y ceiling_y")
def _(get):
    return room.room_footprint(get("points"))[1]
