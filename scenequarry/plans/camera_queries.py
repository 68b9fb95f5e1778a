"""Queries over cameras, frames, depth maps and surfels."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenequarry.functions import geometry as g
from scenequarry.operators import camera, cloud, frames
from scenequarry.operators.stored import stored
from scenequarry.plans.registry import REGISTRY

add = REGISTRY.add

_PROJ = """pr AS (SELECT p.scene_id, frame_ord, point_idx, CAST(round_even(fx * (e00 * x + e01 * y + e02 * z + e03) / (e20 * x + e21 * y + e22 * z + e23) + cx, 0) AS INT) AS u,
 CAST(round_even(fy * (e10 * x + e11 * y + e12 * z + e13) / (e20 * x + e21 * y + e22 * z + e23) + cy, 0) AS INT) AS v, e20 * x + e21 * y + e22 * z + e23 AS depth, width, height FROM points p JOIN cameras USING (scene_id) WHERE e20 * x + e21 * y + e22 * z + e23 > 1e-6),
pj AS (SELECT scene_id, frame_ord, point_idx, u, v, depth FROM pr WHERE u >= 0 AND u < width AND v >= 0 AND v < height),
zb AS (SELECT scene_id, frame_ord, u, v, min(depth) AS zmin FROM pj GROUP BY ALL)"""


@add("p2_project_points", f"WITH {_PROJ} SELECT scene_id, frame_ord, count(*) AS n, CAST(sum(u) AS BIGINT) AS su, CAST(sum(v) AS BIGINT) AS sv, CAST(sum(point_idx % 1000003) AS BIGINT) AS id_sum FROM pj GROUP BY scene_id, frame_ord")
def _(get):
    seen = camera.project(get("points"), get("cameras"))
    return seen.groupBy("scene_id", "frame_ord").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("su"), F.sum("v").alias("sv"), F.sum(F.col("point_idx") % 1000003).alias("id_sum"))


@add("a5_zbuffer", f"WITH {_PROJ} SELECT * FROM zb", "zmin")
def _(get):
    return camera.zbuffer(camera.project(get("points"), get("cameras")))


@add("a6_spread_foreground", f"WITH {_PROJ}, a AS (SELECT scene_id, frame_ord, u + d AS u, v, min(zmin) AS zmin FROM zb, (SELECT unnest(range(-3, 4)) AS d) WHERE u + d >= 0 AND u + d < 100 GROUP BY ALL) SELECT scene_id, frame_ord, CAST(u AS INT) AS u, CAST(v + d AS INT) AS v, min(zmin) AS zmin FROM a, (SELECT unnest(range(-3, 4)) AS d) WHERE v + d >= 0 AND v + d < 100 GROUP BY scene_id, frame_ord, u, v + d", "zmin")
def _(get):
    return camera.spread_foreground(stored(camera.zbuffer(camera.project(get("points"), get("cameras")))), get("cameras"))


_WORLD = """w AS (SELECT scene_id, frame_ord, u, v, depth, conf, px.r, px.g, px.b, (fx + fy) / 2 AS focal,
 CASE WHEN depth > 0 THEN (e00 * ((u - cx) * depth / fx - e03) + e10 * ((v - cy) * depth / fy - e13) + e20 * (depth - e23)) END AS x,
 CASE WHEN depth > 0 THEN (e01 * ((u - cx) * depth / fx - e03) + e11 * ((v - cy) * depth / fy - e13) + e21 * (depth - e23)) END AS y,
 CASE WHEN depth > 0 THEN (e02 * ((u - cx) * depth / fx - e03) + e12 * ((v - cy) * depth / fy - e13) + e22 * (depth - e23)) END AS z FROM pixels px JOIN pixel_cameras USING (scene_id, frame_ord))"""


@add("p4_unproject", f"WITH {_WORLD} SELECT scene_id, frame_ord, u, v, x, y, z FROM w", "x y z")
def _(get):
    return camera.unproject(get("pixels"), get("pixel_cameras")).select("scene_id", "frame_ord", "u", "v", "x", "y", "z")


@add("p4_general_inverse", "SELECT scene_id, frame_ord, e00 AS i00, e10 AS i01, e20 AS i02, -(e00 * e03 + e10 * e13 + e20 * e23) AS i03 FROM pixel_cameras", "i00 i01 i02 i03")
def _(get):
    return camera.general_inverse(get("pixel_cameras")).select("scene_id", "frame_ord", "i00", "i01", "i02", "i03")


@add("a3_far_caps", "SELECT scene_id, frame_ord, coalesce(quantile_cont(depth, 0.95) FILTER (depth > 0) * 1.5, CAST('inf' AS DOUBLE)) AS far_cap FROM pixels GROUP BY scene_id, frame_ord", "far_cap")
def _(get):
    return camera.far_caps(get("pixels"))


_DIFF = """dd AS (SELECT *, CASE WHEN lead(u) OVER h = u + 1 AND lag(u) OVER h = u - 1 THEN (lead({0}) OVER h - lag({0}) OVER h) / 2 END AS {0}_du, CASE WHEN lead(v) OVER k = v + 1 AND lag(v) OVER k = v - 1 THEN (lead({0}) OVER k - lag({0}) OVER k) / 2 END AS {0}_dv FROM {1} WINDOW h AS (PARTITION BY scene_id, frame_ord, v ORDER BY u), k AS (PARTITION BY scene_id, frame_ord, u ORDER BY v))"""


@add("w2_depth_gradient", f"WITH {_DIFF.format('depth', 'pixels')} SELECT scene_id, frame_ord, u, v, sqrt(depth_du * depth_du + depth_dv * depth_dv) / (depth + 1e-9) AS gradient FROM dd", "gradient")
def _(get):
    return camera.depth_gradient(get("pixels")).select("scene_id", "frame_ord", "u", "v", "gradient")


@add("w3_world_derivatives", f"WITH {_WORLD}, {_DIFF.format('x', 'w')} SELECT scene_id, frame_ord, u, v, x_du, x_dv FROM dd", "x_du x_dv")
def _(get):
    world = camera.unproject(get("pixels"), get("pixel_cameras"))
    return world.withColumns(camera.central_difference(["x"], "u")).withColumns(camera.central_difference(["x"], "v")).select("scene_id", "frame_ord", "u", "v", "x_du", "x_dv")


def _lagged(c: str) -> str:
    return f"CASE WHEN lead(u) OVER h = u + 1 AND lag(u) OVER h = u - 1 THEN (lead({c}) OVER h - lag({c}) OVER h) / 2 END AS {c}u, CASE WHEN lead(v) OVER k = v + 1 AND lag(v) OVER k = v - 1 THEN (lead({c}) OVER k - lag({c}) OVER k) / 2 END AS {c}v"


_SURFELS = f"""WITH {_WORLD}, fc AS (SELECT scene_id, frame_ord, quantile_cont(depth, 0.95) FILTER (depth > 0) * 1.5 AS cap FROM pixels GROUP BY scene_id, frame_ord),
dv AS (SELECT *, {_lagged('depth')}, {_lagged('x')}, {_lagged('y')}, {_lagged('z')} FROM w WINDOW h AS (PARTITION BY scene_id, frame_ord, v ORDER BY u), k AS (PARTITION BY scene_id, frame_ord, u ORDER BY v)),
kp AS (SELECT * FROM dv JOIN fc USING (scene_id, frame_ord) WHERE depth <= cap AND conf >= 0.2 AND sqrt(depthu * depthu + depthv * depthv) / (depth + 1e-9) <= 0.04 AND xu IS NOT NULL AND xv IS NOT NULL AND yu IS NOT NULL AND yv IS NOT NULL AND zu IS NOT NULL AND zv IS NOT NULL)
SELECT scene_id, frame_ord, u, v, x, y, z, (r - 0.5) / {g.SH_C0} AS f_dc_0, ln(least(greatest(conf, 0.1), 0.99) / (1 - least(greatest(conf, 0.1), 0.99))) AS opacity, ln(greatest(depth * 4 / focal, 1e-6)) AS scale_0, ln(greatest(greatest(depth * 4 / focal, 1e-6) * 0.3, 1e-6)) AS scale_2 FROM kp"""


@add("p5_p10_surfels", _SURFELS, "x y z f_dc_0 opacity scale_0 scale_2")
def _(get):
    s = camera.surfels(get("pixels"), get("pixel_cameras"))
    return s.select("scene_id", "frame_ord", "u", "v", "x", "y", "z", "f_dc_0", "opacity", "scale_0", "scale_2")


_UNIT = "sqrt({0}0 * {0}0 + {0}1 * {0}1 + {0}2 * {0}2) + 1e-9"
_ALONG = "(yy0 * a0 + yy1 * a1 + yy2 * a2)"
_SPLAT = _SURFELS[: _SURFELS.rindex("SELECT scene_id, frame_ord")] .rstrip() + f""",
e0 AS (SELECT *, xu AS xx0, yu AS xx1, zu AS xx2, xv AS yy0, yv AS yy1, zv AS yy2 FROM kp), e1 AS (SELECT *, xx0 / ({_UNIT.format('xx')}) AS a0, xx1 / ({_UNIT.format('xx')}) AS a1, xx2 / ({_UNIT.format('xx')}) AS a2 FROM e0),
e2 AS (SELECT *, yy0 - {_ALONG} * a0 AS t0, yy1 - {_ALONG} * a1 AS t1, yy2 - {_ALONG} * a2 AS t2 FROM e1), e3 AS (SELECT *, t0 / ({_UNIT.format('t')}) AS b0, t1 / ({_UNIT.format('t')}) AS b1, t2 / ({_UNIT.format('t')}) AS b2 FROM e2),
e4 AS (SELECT *, a1 * b2 - a2 * b1 AS c0, a2 * b0 - a0 * b2 AS c1, a0 * b1 - a1 * b0 AS c2 FROM e3), e5 AS (SELECT *, c0 / ({_UNIT.format('c')}) AS n0, c1 / ({_UNIT.format('c')}) AS n1, c2 / ({_UNIT.format('c')}) AS n2 FROM e4),
q0 AS (SELECT *, CASE WHEN a0 + b1 + n2 > 0 THEN 0 WHEN a0 >= b1 AND a0 >= n2 THEN 1 WHEN b1 >= n2 THEN 2 ELSE 3 END AS k FROM e5), q1 AS (SELECT *, 2 * sqrt(greatest(CASE k WHEN 0 THEN a0 + b1 + n2 + 1 WHEN 1 THEN 1 + a0 - b1 - n2 WHEN 2 THEN 1 + b1 - a0 - n2 ELSE 1 + n2 - a0 - b1 END, 1e-12)) AS s FROM q0),
q2 AS (SELECT *, (b2 - n1) / s AS wx, (n0 - a2) / s AS wy, (a1 - b0) / s AS wz, (b0 + a1) / s AS xy, (n0 + a2) / s AS xz, (n1 + b2) / s AS yz FROM q1),
q3 AS (SELECT *, CASE k WHEN 0 THEN s / 4 WHEN 1 THEN wx WHEN 2 THEN wy ELSE wz END AS q0, CASE k WHEN 0 THEN wx WHEN 1 THEN s / 4 WHEN 2 THEN xy ELSE xz END AS q1, CASE k WHEN 0 THEN wy WHEN 1 THEN xy WHEN 2 THEN s / 4 ELSE yz END AS q2, CASE k WHEN 0 THEN wz WHEN 1 THEN xz WHEN 2 THEN yz ELSE s / 4 END AS q3 FROM q2),
q4 AS (SELECT *, sqrt(q0 * q0 + q1 * q1 + q2 * q2 + q3 * q3) + 1e-9 AS qn FROM q3)
SELECT scene_id, x, y, z, 0.0 AS nx, 0.0 AS ny, 0.0 AS nz, (r - 0.5) / {g.SH_C0} AS f_dc_0, (g - 0.5) / {g.SH_C0} AS f_dc_1, (b - 0.5) / {g.SH_C0} AS f_dc_2, ln(least(greatest(conf, 0.1), 0.99) / (1 - least(greatest(conf, 0.1), 0.99))) AS opacity,
ln(greatest(depth * 4 / focal, 1e-6)) AS scale_0, ln(greatest(depth * 4 / focal, 1e-6)) AS scale_1, ln(greatest(greatest(depth * 4 / focal, 1e-6) * 0.3, 1e-6)) AS scale_2, q0 / qn AS rot_0, q1 / qn AS rot_1, q2 / qn AS rot_2, q3 / qn AS rot_3 FROM q4"""


@add("s9_splat_export", _SPLAT, "x y z nx ny nz f_dc_0 f_dc_1 f_dc_2 opacity scale_0 scale_1 scale_2 rot_0 rot_1 rot_2 rot_3", 5)
def _(get):
    return cloud.splat_export_columns(camera.surfels(get("pixels"), get("pixel_cameras")))


_DYES = (("red", "x", 5), ("green", "y", 3), ("blue", "z", 6))


@add("s10_points_export", "SELECT scene_id, x, y, z, " + ", ".join(f"CAST(trunc(least(greatest(least(greatest(({c} / {n} - 0.5) / {g.SH_C0} * {g.SH_C0} + 0.5, 0), 1) * 255, 0), 255)) AS INT) AS {name}" for name, c, n in _DYES) + ", conf AS confidence FROM points", "x y z confidence")
def _(get):
    dyed = get("points").withColumns({f"f_dc_{i}": g.rgb_to_dc(F.col(c) / n) for i, (_, c, n) in enumerate(_DYES)})
    return cloud.points_export_columns(dyed)


@add("g12_smooth_depth", "WITH c AS (SELECT scene_id, frame_ord, u, v, coalesce(depth, 0) AS d FROM pixels), o AS (SELECT a.du, b.dv, a.du * a.du + b.dv * b.dv AS r FROM (SELECT unnest(range(-2, 3)) AS du) a, (SELECT unnest(range(-2, 3)) AS dv) b WHERE a.du * a.du + b.dv * b.dv <= 4), j AS (SELECT c.scene_id, c.frame_ord, c.u, c.v, q.d AS qd, exp(-r / 5000.0 - (q.d - c.d) * (q.d - c.d) / (2 * 0.05 * 0.05)) AS w FROM c, o, c q WHERE q.scene_id = c.scene_id AND q.frame_ord = c.frame_ord AND q.u = c.u - du AND q.v = c.v - dv) SELECT scene_id, frame_ord, u, v, sum(w * qd) / sum(w) AS depth FROM j GROUP BY ALL", "depth")
def _(get):
    return camera.smooth_depth(get("pixels")).select("scene_id", "frame_ord", "u", "v", "depth")


@add("w9_sharpness", "WITH l AS (SELECT scene_id, frame_ord, lag(r) OVER h + lead(r) OVER h + lag(r) OVER k + lead(r) OVER k - 4 * r AS l FROM pixels WINDOW h AS (PARTITION BY scene_id, frame_ord, v ORDER BY u), k AS (PARTITION BY scene_id, frame_ord, u ORDER BY v)) SELECT scene_id, frame_ord, var_pop(l) AS sharpness FROM l GROUP BY scene_id, frame_ord", "sharpness")
def _(get):
    return camera.sharpness(get("pixels").withColumn("value", F.col("r")))


_PATH = "st AS (SELECT scene_id, frame_ord, coalesce(sqrt(power(e03 - lag(e03) OVER w, 2) + power(e13 - lag(e13) OVER w, 2) + power(e23 - lag(e23) OVER w, 2)), 0) AS s FROM cameras WINDOW w AS (PARTITION BY scene_id ORDER BY frame_ord)), pt AS (SELECT scene_id, frame_ord, sum(s) OVER (PARTITION BY scene_id ORDER BY frame_ord) AS length FROM st)"


@add("w4_path_lengths", f"WITH {_PATH} SELECT * FROM pt", "length")
def _(get):
    return frames.path_lengths(get("cameras"))


@add("w5_keyframes", f"WITH {_PATH}, t AS (SELECT scene_id, i AS nth, i * max(length) / 4 AS t FROM pt, (SELECT unnest(range(0, 5)) AS i) GROUP BY scene_id, i), r AS (SELECT t.scene_id, nth, frame_ord, row_number() OVER (PARTITION BY t.scene_id, nth ORDER BY abs(length - t), frame_ord) AS k FROM t JOIN pt USING (scene_id)) SELECT scene_id, CAST(nth AS INT) AS nth, frame_ord FROM r WHERE k = 1")
def _(get):
    return frames.keyframes(get("cameras"), 5)


@add("w6_w8_select_frames", "WITH a AS (SELECT *, count(*) OVER (PARTITION BY scene_id) AS n, row_number() OVER (PARTITION BY scene_id ORDER BY frame_ord) - 1 AS i FROM frames), b AS (SELECT scene_id, frame_ord, sharpness, ts FROM a WHERE i % CASE WHEN n > 96 THEN greatest(1, n // 96) ELSE 1 END = 0), c AS (SELECT *, count(*) OVER (PARTITION BY scene_id) AS n, row_number() OVER (PARTITION BY scene_id ORDER BY sharpness DESC, frame_ord DESC) AS i FROM b), d AS (SELECT scene_id, frame_ord, sharpness, ts FROM c WHERE i <= CASE WHEN n > 8 THEN greatest(8, round_even(n * 0.8, 0)) ELSE n END), e AS (SELECT *, count(*) OVER (PARTITION BY scene_id) AS n, row_number() OVER (PARTITION BY scene_id ORDER BY frame_ord) - 1 AS i FROM d) SELECT scene_id, frame_ord FROM e WHERE n <= 48 OR i IN (SELECT CAST(round_even(j * (e.n - 1) / 47, 0) AS BIGINT) FROM (SELECT unnest(range(0, 48)) AS j))")
def _(get):
    return frames.select_frames(get("frames")).select("scene_id", "frame_ord")


@add("w10_sample_timeline", "WITH s AS (SELECT scene_id, min(epoch_us(ts)) AS s FROM frames GROUP BY scene_id), b AS (SELECT f.scene_id, frame_ord, CAST(floor((epoch_us(ts) - s) * (1.0 / 604800) / 1e6) AS BIGINT) AS bucket, ts FROM frames f JOIN s USING (scene_id)), r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, bucket ORDER BY ts, frame_ord) AS k FROM b), q AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY bucket) AS i FROM r WHERE k = 1) SELECT scene_id, frame_ord, bucket FROM q WHERE i <= 100")
def _(get):
    return frames.sample_timeline(get("frames").select("scene_id", "ts", "frame_ord"), "scene_id", "ts", 1.0 / 604800, 100).select("scene_id", "frame_ord", "bucket")


@add("j15_resolve_frames", "WITH q AS (SELECT scene_id, mask_ord, CASE mask_ord % 3 WHEN 0 THEN 'missing.jpg' ELSE frame_name END AS frame_name, CASE mask_ord % 4 WHEN 3 THEN 999 ELSE frame_ord END AS frame_ord FROM masks) SELECT q.scene_id, mask_ord, coalesce(a.frame_ord, b.frame_ord) AS camera_ord FROM q LEFT JOIN cameras a ON q.scene_id = a.scene_id AND q.frame_name = a.frame_name LEFT JOIN cameras b ON q.scene_id = b.scene_id AND q.frame_ord = b.frame_ord")
def _(get):
    masks = get("masks")
    wanted = masks.select("scene_id", "mask_ord", F.when(F.col("mask_ord") % 3 == 0, "missing.jpg").otherwise(F.col("frame_name")).alias("frame_name"), F.when(F.col("mask_ord") % 4 == 3, 999).otherwise(F.col("frame_ord")).alias("frame_ord"))
    return frames.resolve_frames(wanted, get("cameras")).select("scene_id", "mask_ord", "camera_ord")
