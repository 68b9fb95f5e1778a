"""Objects asked for by name, against a comparison of every request with every annotation."""

import random

from pyspark.sql import functions as F

from scenequarry.functions.labels import match_tier
from scenequarry.operators.questions import resolve_objects


def test_resolution_by_tiers_against_all_pairs(spark):
    rng = random.Random(12)
    words = ["Red", "chair", "table", "lamp", "a", "ab", "Étagère", "sofa bed", "tab", "air", ""]
    label = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 3))) if rng.random() < 0.9 else rng.choice([None, "", "x", "lampshade"])
    annotations = spark.createDataFrame([(f"s{i % 4}", i, f"Obj_{i % 37}", label(), float(i)) for i in range(160)], "scene_id string, ordinal int, id string, label string, x double")
    needles = ["obj_3", " OBJ_12 ", "red chair", "chair", "hai", "a", "e", "ab", "the red chair there", "lampshades", "étag", "zzz", "", "  ", None, "x", "obj", "sofa bed red", "tabl"]
    asked = spark.createDataFrame([(k, f"s{k % 5}", rng.choice(needles)) for k in range(400)], "request_id int, scene_id string, needle string")
    got = {r.request_id: r.hit and r.hit.ordinal for r in resolve_objects(asked, annotations).collect()}
    assert len(got) == 400
    paired = asked.join(annotations, "scene_id").withColumn("tier", match_tier(F.col("needle"), F.col("id"), F.col("label"))).where("tier IS NOT NULL")
    want = {r.request_id: r.o for r in paired.groupBy("request_id").agg(F.min_by("ordinal", F.struct("tier", "ordinal")).alias("o")).collect()}
    assert got == {k: want.get(k) for k in range(400)}
    assert resolve_objects(asked, annotations.limit(0)).where("hit IS NOT NULL").isEmpty() and resolve_objects(asked.limit(0), annotations).isEmpty()


def test_no_join_by_scene_alone(spark):
    """Every join of a plan has a second key, but that with empty labels, of which a scene has one."""
    annotations = spark.createDataFrame([("s", 1, "a", "b")], "scene_id string, ordinal int, id string, label string")
    asked = spark.createDataFrame([(1, "s", "c")], "request_id int, scene_id string, needle string")
    plan = resolve_objects(asked, annotations)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and sum("AND" not in line for line in joins) <= 1
