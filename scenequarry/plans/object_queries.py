"""Queries over objects: labels, questions, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenequarry.functions import geometry as g
from scenequarry.functions import labels as lb
from scenequarry.operators import merge, neighbors, questions
from scenequarry.plans.registry import REGISTRY

add = REGISTRY.add

#: Label similarity in SQL, for names a and b.
STOP = ", ".join(f"'{w}'" for w in lb.STOPWORDS)


def _tokens(c: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9_]+')), lambda w: length(w) >= 3 AND w NOT IN ({STOP}))"


def _similar(a: str, b: str, least: float) -> str:
    ta, tb = _tokens(a), _tokens(b)
    return f"(contains(lower({a}), lower({b})) OR contains(lower({b}), lower({a})) OR (len({ta}) > 0 AND len({tb}) > 0 AND len(list_intersect({ta}, {tb})) >= {least} * len(list_distinct(list_concat({ta}, {tb})))))"


def _pairs(least: float) -> str:
    return f"SELECT p.scene_id, p.ordinal AS a, q.ordinal AS b FROM annotations p JOIN annotations q ON p.scene_id = q.scene_id AND p.ordinal < q.ordinal WHERE power(p.x - q.x, 2) + power(p.y - q.y, 2) + power(p.z - q.z, 2) < 0.6 * 0.6 AND {_similar('p.label', 'q.label', least)}"


@add("f1_label_tokens", f"SELECT scene_id, id, array_to_string(list_sort({_tokens('label')}), ' ') AS tokens FROM annotations")
def _(get):
    return get("annotations").select("scene_id", "id", F.array_join(F.sort_array(lb.label_tokens(F.col("label"))), " ").alias("tokens"))


@add("j6_f2_similar_neighbours", _pairs(0.4))
def _(get):
    return neighbors.similar_neighbours(get("annotations").drop("id").withColumnRenamed("ordinal", "id"), 0.6, 0.4)


_TIER = "CASE WHEN trim({n}) = '' THEN NULL WHEN lower(trim({n})) = lower(id) THEN 1 WHEN lower(trim({n})) = lower(label) THEN 2 WHEN contains(lower(label), lower(trim({n}))) OR contains(lower(trim({n})), lower(label)) THEN 3 END"


def _hits(needle: str, name: str) -> str:
    return f"{name}0 AS (SELECT q.request_id, a.*, {_TIER.format(n='q.' + needle)} AS tier FROM requests q JOIN annotations a ON q.scene_id = a.scene_id), {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY tier, ordinal) AS k FROM {name}0 WHERE tier IS NOT NULL) WHERE k = 1)"


_LOCATE = f"WITH {_hits('needle', 'h')}, kl AS (SELECT scene_id, string_agg(label, ', ' ORDER BY ordinal) AS labels FROM annotations GROUP BY scene_id) SELECT q.request_id, q.scene_id, CASE WHEN h.id IS NULL THEN 'not_found' ELSE 'ok' END AS outcome, h.id, h.label, h.x, h.y, h.z, h.lo_x, h.lo_y, h.lo_z, h.hi_x, h.hi_y, h.hi_z, CASE WHEN h.id IS NULL THEN coalesce(labels, '') END AS known_labels FROM requests q LEFT JOIN h ON q.request_id = h.request_id LEFT JOIN kl ON q.scene_id = kl.scene_id"


@add("q1_q5_locate_objects", _LOCATE, "x y z lo_x lo_y lo_z hi_x hi_y hi_z")
def _(get):
    return questions.locate_objects(get("requests"), get("annotations"))


@add("q2_camera_targets", f"WITH {_hits('needle', 'h')} SELECT q.request_id, q.scene_id, h.id, h.x AS look_x, h.y AS look_y, h.z AS look_z FROM requests q JOIN h ON q.request_id = h.request_id", "look_x look_y look_z")
def _(get):
    return questions.camera_targets(get("requests"), get("annotations"))


@add("q3_describe_scenes", "WITH s AS (SELECT DISTINCT scene_id FROM requests), t AS (SELECT scene_id, string_agg('- ' || label || ' (' || id || ')', chr(10) ORDER BY ordinal) AS t FROM annotations GROUP BY scene_id) SELECT s.scene_id, coalesce(t, 'No annotated objects.') AS inventory FROM s LEFT JOIN t ON s.scene_id = t.scene_id")
def _(get):
    return questions.describe_scenes(get("requests"), get("annotations"))


def _framed(get):
    a = get("annotations")
    return a.withColumn("frame_ids", F.transform(F.sequence(F.lit(0), F.col("size") % 8), lambda i: F.concat(F.lit("f"), ((F.col("ordinal") * 3 + i * 5) % 40).cast("string"))))


@add("q4_frames_of_objects", f"WITH {_hits('needle', 'h')}, st AS (SELECT request_id, h.scene_id, i, 'f' || CAST((ordinal * 3 + i * 5) % 40 AS STRING) AS frame_name FROM (SELECT *, unnest(range(0, size % 8 + 1)) AS i FROM h) h), ex AS (SELECT request_id, i, frame_name, row_number() OVER (PARTITION BY request_id ORDER BY i, frame_name) AS k FROM st WHERE frame_name IN (SELECT 'f' || CAST(n_nationkey AS STRING) FROM nation)), l AS (SELECT request_id, string_agg(frame_name, ',' ORDER BY k) AS frames FROM ex WHERE k <= 4 GROUP BY request_id) SELECT q.request_id, q.scene_id, h.id, CASE WHEN h.id IS NULL THEN 'not_found' WHEN l.frames IS NULL THEN 'no_frames' ELSE 'ok' END AS outcome, coalesce(l.frames, '') AS frames FROM requests q LEFT JOIN h ON q.request_id = h.request_id LEFT JOIN l ON q.request_id = l.request_id")
def _(get):
    scenes = get("annotations").select("scene_id").distinct()
    there = scenes.crossJoin(get("cameras").select(F.concat(F.lit("f"), F.col("frame_ord").cast("string")).alias("frame_name")).distinct())
    return questions.frames_of_objects(get("requests"), _framed(get), there)


@add("q8_pair_distances", f"WITH {_hits('needle', 'ha')}, {_hits('needle_b', 'hb')} SELECT q.request_id, q.scene_id, ha.id AS id_a, hb.id AS id_b, sqrt(power(ha.x - hb.x, 2) + power(ha.y - hb.y, 2) + power(ha.z - hb.z, 2)) AS distance FROM requests q LEFT JOIN ha ON q.request_id = ha.request_id LEFT JOIN hb ON q.request_id = hb.request_id", "distance")
def _(get):
    asked = get("requests").select("request_id", "scene_id", F.col("needle").alias("needle_a"), "needle_b")
    return questions.pair_distances(asked, get("annotations"))


def _measured(get):
    return questions.measure(get("annotations").select("scene_id", "ordinal", *[F.col(f"lo_{c}").alias(f"a{c}") for c in "xyz"], *[F.col(f"hi_{c}").alias(f"b{c}") for c in "xyz"]))


_D = "sqrt(power(hi_x - lo_x, 2) + power(hi_y - lo_y, 2) + power(hi_z - lo_z, 2))"


@add("p27_w20_calibrate", f"WITH m AS (SELECT scene_id, ordinal, {_D} AS distance FROM annotations), l AS (SELECT scene_id, arg_max(distance, ordinal) AS last FROM m GROUP BY scene_id), rl AS (SELECT scene_id, CASE WHEN last > 0 THEN (1 + length(scene_id)) / last ELSE 1.0 END AS scale FROM l WHERE scene_id <> '3') SELECT m.scene_id, ordinal, distance, coalesce(scale, 1.0) AS scale, distance * coalesce(scale, 1.0) AS scaled FROM m LEFT JOIN rl ON m.scene_id = rl.scene_id", "distance scale scaled")
def _(get):
    measured = _measured(get)
    real = measured.where("scene_id != '3'").select("scene_id", (1 + F.length("scene_id")).cast("double").alias("real_length")).distinct()
    return questions.calibrate(measured, real).select("scene_id", "ordinal", "distance", "scale", "scaled")


@add("p28_dimensions", "SELECT scene_id, id, (hi_x - lo_x) * 1.5 AS width, (hi_y - lo_y) * 1.5 AS height, (hi_z - lo_z) * 1.5 AS depth FROM annotations", "width height depth")
def _(get):
    return questions.dimensions(get("annotations"), 1.5)


def _full(get):
    return _framed(get).withColumn("alternatives", F.when(F.col("ordinal") % 3 == 0, F.array(F.lit("duplicate_of:x"), F.col("brand"))).otherwise(F.array(F.col("brand")))).withColumn("provenance", F.array("type"))


_CC = f"""WITH RECURSIVE e AS ({_pairs(0.3)}), bw AS (SELECT * FROM e UNION SELECT scene_id, b, a FROM e), w AS (SELECT scene_id, ordinal AS node, ordinal AS c FROM annotations UNION SELECT w.scene_id, x.b, w.c FROM w JOIN bw x ON w.scene_id = x.scene_id AND w.node = x.a),
cc AS (SELECT scene_id, node AS ordinal, min(c) AS component FROM w GROUP BY scene_id, node)"""


@add("a19_merge_annotations", f"""{_CC}, j AS (SELECT a.*, component, count(*) OVER (PARTITION BY a.scene_id, component) AS n, row_number() OVER (PARTITION BY a.scene_id, component ORDER BY confidence DESC, a.ordinal) AS k FROM annotations a JOIN cc ON a.scene_id = cc.scene_id AND a.ordinal = cc.ordinal)
SELECT scene_id, component AS ordinal, count(*) AS n_merged, max(id) FILTER (k = 1) AS id, max(label) FILTER (k = 1) AS label, max(confidence) AS confidence, min(lo_x) AS lo_x, min(lo_y) AS lo_y, min(lo_z) AS lo_z, max(hi_x) AS hi_x, max(hi_y) AS hi_y, max(hi_z) AS hi_z,
 CASE WHEN count(*) = 1 THEN min(x) ELSE (min(lo_x) + max(hi_x)) * 0.5 END AS x, CASE WHEN count(*) = 1 THEN min(y) ELSE (min(lo_y) + max(hi_y)) * 0.5 END AS y, CASE WHEN count(*) = 1 THEN min(z) ELSE (min(lo_z) + max(hi_z)) * 0.5 END AS z,
 array_to_string(list_sort(list_distinct(list(type))), ',') AS provenance, array_to_string(list_slice(list_sort(list_distinct(flatten(list(list_transform(range(0, size % 8 + 1), lambda i: 'f' || CAST((ordinal * 3 + i * 5) % 40 AS VARCHAR)))))), 1, 6), ',') AS frame_ids, max(CASE WHEN n = 1 AND ordinal % 3 = 0 THEN 'duplicate_of:x,' || brand ELSE brand END) FILTER (k = 1) AS alternatives FROM j GROUP BY scene_id, component""", "confidence lo_x lo_y lo_z hi_x hi_y hi_z x y z")
def _(get):
    merged = merge.merge_annotations(_full(get))
    return merged.withColumn("frame_ids", F.array_join("frame_ids", ",")).withColumn("provenance", F.array_join("provenance", ",")).withColumn("alternatives", F.array_join("alternatives", ","))


def _labels(get):
    a = get("annotations").where("ordinal % 4 != 1")
    label = F.when(F.col("ordinal") % 7 == 0, " None ").otherwise(F.col("label"))
    return a.select("scene_id", "id", label.alias("label"), "confidence", F.when(F.col("ordinal") % 5 == 0, F.array(F.lit("duplicate_of:obj_1"), F.lit("chair"))).otherwise(F.array(F.lit("chair"))).alias("alternatives"))


_LAB = "lab AS (SELECT scene_id, id, CASE ordinal % 7 WHEN 0 THEN ' None ' ELSE label END AS label, confidence, ordinal % 5 = 0 AS dup FROM annotations WHERE ordinal % 4 <> 1)"


@add("j11_join_labels", f"WITH {_LAB} SELECT a.scene_id, a.id, coalesce(lab.label, 'unknown') AS label, coalesce(lab.confidence, 0.0) AS confidence FROM annotations a LEFT JOIN lab ON a.scene_id = lab.scene_id AND a.id = lab.id WHERE NOT coalesce(lower(trim(lab.label)) = 'none' OR dup, false)", "confidence")
def _(get):
    return merge.join_labels(get("annotations").select("scene_id", "id"), _labels(get)).select("scene_id", "id", "label", "confidence")


@add("a17_label_funnel", f"WITH {_LAB} SELECT a.scene_id, count(*) FILTER (coalesce(lower(trim(lab.label)) = 'none', false)) AS rejected, count(*) FILTER (coalesce(lower(trim(lab.label)) <> 'none' AND dup, false)) AS duplicate, count(*) FILTER (NOT coalesce(lower(trim(lab.label)) = 'none' OR dup, false)) AS kept FROM annotations a LEFT JOIN lab ON a.scene_id = lab.scene_id AND a.id = lab.id GROUP BY a.scene_id")
def _(get):
    return merge.label_funnel(get("annotations"), _labels(get))


@add("t8_unlabelled_clusters", "SELECT scene_id, id, confidence FROM annotations WHERE ordinal % 4 = 1", "confidence")
def _(get):
    return merge.new_work(get("annotations").select("scene_id", "id", "confidence"), _labels(get), ["scene_id", "id"])


@add("w19_label_batches", "WITH p AS (SELECT scene_id, id, ordinal, CAST(floor((row_number() OVER (PARTITION BY scene_id ORDER BY ordinal) - 1) / 5) AS BIGINT) AS batch FROM annotations) SELECT scene_id, batch, string_agg(id, ',' ORDER BY ordinal) AS ids FROM p GROUP BY scene_id, batch")
def _(get):
    return merge.label_batches(get("annotations"))


@add("f4_parse_labels", "SELECT scene_id, id, label, confidence FROM annotations WHERE ordinal % 11 <> 0", "confidence")
def _(get):
    answer = F.to_json(F.create_map("id", F.struct("label", "confidence", F.array(F.lit("x")).alias("alternatives"))))
    text = F.when(F.col("ordinal") % 11 == 0, "no json").otherwise(F.concat(F.lit("```json\n"), answer, F.lit("\n```")))
    return get("annotations").select("scene_id", F.explode(lb.parse_labels(text)).alias("id", "v")).select("scene_id", "id", "v.label", "v.confidence")


_BOX = "x / 5 AS bx, y / 3 AS \"by\", size / 40.0 AS bw, size / 80.0 AS bh"


@add("f5_parse_proposals", f"WITH b AS (SELECT scene_id, ordinal, label, confidence, {_BOX} FROM annotations) SELECT scene_id, ordinal, label AS phrase, bx AS x, \"by\" AS y, least(bw, 1 - bx) AS w, least(bh, 1 - \"by\") AS h FROM b WHERE bw > 0 AND bw <= 1 AND bx + bw <= 1.001 AND \"by\" + bh <= 1.001 AND ordinal % 13 <> 0", "x y w h")
def _(get):
    box = F.array(F.col("x") / 5, F.col("y") / 3, F.col("size") / 40.0, F.col("size") / 80.0)
    answer = F.to_json(F.array(F.struct(F.col("label").alias("phrase"), box.alias("bbox"), "confidence")))
    text = F.when(F.col("ordinal") % 13 == 0, "{broken").otherwise(F.concat(F.lit("```\n"), answer, F.lit("```")))
    return get("annotations").select("scene_id", "ordinal", F.explode(lb.parse_proposals(text)).alias("p")).select("scene_id", "ordinal", "p.phrase", *[F.get("p.bbox", F.lit(i)).alias(n) for i, n in enumerate("xywh")])


@add("w14_first_phrases", "SELECT scene_id, frame_name, ordinal, phrase FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, frame_name, lower(trim(phrase)) ORDER BY ordinal) AS k FROM (SELECT scene_id, 'f' || CAST(ordinal % 4 AS STRING) AS frame_name, ordinal, CASE ordinal % 2 WHEN 0 THEN upper(label) ELSE ' ' || label END AS phrase FROM annotations)) WHERE k = 1")
def _(get):
    return merge.first_phrases(_proposals(get)).select("scene_id", "frame_name", "ordinal", "phrase")


def _proposals(get):
    return get("annotations").select("scene_id", F.concat(F.lit("f"), (F.col("ordinal") % 4).cast("string")).alias("frame_name"), "ordinal", F.when(F.col("ordinal") % 2 == 0, F.upper("label")).otherwise(F.concat(F.lit(" "), "label")).alias("phrase"))


@add("a35_proposal_counts", "SELECT scene_id, frame_name, count(*) AS n FROM (SELECT scene_id, 'f' || CAST(ordinal % 4 AS STRING) AS frame_name FROM annotations) GROUP BY GROUPING SETS ((scene_id, frame_name), (scene_id))")
def _(get):
    return merge.proposal_counts(_proposals(get))


@add("f13_strip_duplicates", "SELECT scene_id, id, ordinal % 3 = 0 AS duplicate, brand AS alternatives FROM annotations")
def _(get):
    return _full(get).select("scene_id", "id", lb.is_duplicate(F.col("alternatives")).alias("duplicate"), F.array_join(lb.strip_duplicates(F.col("alternatives")), ",").alias("alternatives"))


_BXS = "SELECT mask_ord, \"left\", \"top\", wide, high FROM masks"


@add("p13_crop_boxes", 'SELECT mask_ord, greatest(0, "left" - CAST(trunc(wide * 0.08) AS INT)) AS x0, greatest(0, "top" - CAST(trunc(high * 0.08) AS INT)) AS y0, least(70, "left" + wide + CAST(trunc(wide * 0.08) AS INT)) AS x1, least(60, "top" + high + CAST(trunc(high * 0.08) AS INT)) AS y1 FROM masks')
def _(get):
    box = g.crop_box(F.col("left"), F.col("top"), F.col("wide"), F.col("high"), F.lit(70), F.lit(60))
    return get("masks").select("mask_ord", *[c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)])


@add("p14_p16_boxes", 'SELECT mask_ord, CAST(round_even("left" / 100.0 * 337, 0) AS INT) AS rx, CAST(round_even("top" / 100.0 * 211, 0) AS INT) AS ry, CAST(greatest(least(round_even(wide / 100.0 * 337, 0), 337 - round_even("left" / 100.0 * 337, 0)), 1) AS INT) AS rw, "left" + wide / 2.0 AS cx, "top" + high / 2.0 AS cy, CAST(round_even("left" / 4.0, 0) AS INT) AS kx, CAST(round_even(wide / 4.0, 0) AS INT) AS kw, CAST(greatest(least(round_even(high / 100.0 * 211, 0), 211 - round_even("top" / 100.0 * 211, 0)), 1) AS INT) AS rh, CAST(round_even("top" / 4.0, 0) AS INT) AS ky, CAST(round_even(high / 4.0, 0) AS INT) AS kh FROM masks', "cx cy")
def _(get):
    f = {c: F.col(c) for c in ("left", "top", "wide", "high")}
    rect = g.proposal_rectangle(f["left"] / 100, f["top"] / 100, f["wide"] / 100, f["high"] / 100, F.lit(337), F.lit(211))
    center = g.box_center(*f.values())
    corner = g.corners_to_box(f["left"] / 4, f["top"] / 4, (f["left"] + f["wide"]) / 4, (f["top"] + f["high"]) / 4)
    return get("masks").select("mask_ord", rect[0].alias("rx"), rect[1].alias("ry"), rect[2].alias("rw"), center[0].alias("cx"), center[1].alias("cy"), corner[0].alias("kx"), corner[2].alias("kw"), rect[3].alias("rh"), corner[1].alias("ky"), corner[3].alias("kh"))


@add("p17_scaled_sizes", "WITH s AS (SELECT p_partkey, p_size * 97 + 100 AS w, p_partkey % 50 * 61 + 90 AS h FROM part) SELECT p_partkey AS id, CAST(CASE WHEN greatest(w, h) <= 1920 THEN w WHEN w >= h THEN 1920 ELSE round_even(w * 1920 / h / 2, 0) * 2 END AS INT) AS width, CAST(CASE WHEN greatest(w, h) <= 1920 THEN h WHEN w >= h THEN round_even(h * 1920 / w / 2, 0) * 2 ELSE 1920 END AS INT) AS height FROM s")
def _(get):
    sizes = get("annotations").select(F.substring("id", 5, 20).cast("long").alias("id"), (F.col("size") * 97 + 100).alias("w"), (F.substring("id", 5, 20).cast("long") % 50 * 61 + 90).alias("h"))
    w, h = g.scaled_size(F.col("w"), F.col("h"))
    return sizes.select("id", w.alias("width"), h.alias("height"))


@add("p18_parse_rates", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 30000.0 / (1000 + p_size) WHEN 1 THEN 0.0 WHEN 2 THEN CAST(p_size AS DOUBLE) ELSE NULL END AS rate FROM part", "rate")
def _(get):
    n = F.substring("id", 5, 20).cast("long")
    text = F.when(n % 4 == 0, F.concat(F.lit("30000/"), (1000 + F.col("size")).cast("string"))).when(n % 4 == 1, "25/0").when(n % 4 == 2, F.col("size").cast("string")).otherwise("abc")
    return get("annotations").select(n.alias("id"), g.parse_rate(text).alias("rate"))


@add("p19_f12_names", "SELECT c_custkey AS id, regexp_matches(c_name, '^[A-Za-z0-9_-]{1,64}$') AS valid_name, regexp_matches(replace(c_name, '#', '-'), '^[A-Za-z0-9_-]{1,64}$') AS valid_id, regexp_replace(c_name || '.png', '\\.[^./]+$', '') AS stem FROM customer")
def _(get):
    names = get("requests").select(F.col("request_id").alias("id"), F.concat(F.lit("Customer#"), F.lpad(F.col("request_id").cast("string"), 9, "0")).alias("name"))
    return names.select("id", lb.valid_scene_id(F.col("name")).alias("valid_name"), lb.valid_scene_id(F.replace("name", F.lit("#"), F.lit("-"))).alias("valid_id"), lb.strip_extension(F.concat("name", F.lit(".png"))).alias("stem"))
