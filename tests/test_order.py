"""Order statistics of large groups against sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenequarry.operators import cloud, frames
from scenequarry.operators.order import group_quantiles, group_ranks


def _values(kind, n, rng):
    return {
        "even": lambda: rng.random(n), "same": lambda: np.full(n, 2.5), "ties": lambda: rng.integers(0, 5, n).astype(float), "outlier": lambda: np.append(rng.random(n - 1), 1e300),
        "magnitudes": lambda: rng.choice([-1.0, 1.0], n) * 10.0 ** rng.uniform(-280, 280, n), "ends": lambda: rng.choice([-1.7e308, -1.0, 1.0, 1.7e308], n),
    }[kind]()


@pytest.mark.parametrize("kind", ["even", "same", "ties", "outlier", "magnitudes", "ends"])
def test_quantiles_of_one_group(spark, kind):
    values = _values(kind, 5_000, np.random.default_rng(3))
    rows = spark.createDataFrame([("g", float(v)) for v in values], "k string, v double").repartition(4)
    wanted = (0.0, 0.025, 0.5, 0.95, 1.0)
    found = group_quantiles(rows, ["k"], {"v": wanted}, keep=50, bins=16).first()
    assert found["n"] == len(values) and found["v_min"] == values.min() and found["v_max"] == values.max()
    ordered = np.sort(values)
    for i, q in enumerate(wanted):
        at = (len(values) - 1) * q
        low, high = int(np.floor(at)), int(np.ceil(at))
        expected = ordered[low] if low == high else (high - at) * ordered[low] + (at - low) * ordered[high]
        assert found[f"v_q{i}"] == pytest.approx(expected, rel=1e-14), q


def test_quantiles_of_uneven_groups(spark):
    rng = np.random.default_rng(4)
    rows = [("big", float(v), float(w)) for v, w in rng.normal(size=(4_000, 2))] + [("one", 7.0, -1.0), ("holes", None, 1.0), ("holes", 3.0, None), ("none", None, 2.0)] + [("few", float(i), float(-i)) for i in range(7)]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    many = {r["k"]: r.asDict() for r in group_quantiles(df, ["k"], {"v": (0.5, 0.9), "w": (0.1,)}, keep=10, bins=8).collect()}
    once = {r["k"]: r.asDict() for r in group_quantiles(df, ["k"], {"v": (0.5, 0.9), "w": (0.1,)}).collect()}
    assert many.keys() == once.keys()
    for k, row in once.items():
        assert many[k] == pytest.approx(row), k
    assert once["none"]["v_q0"] is None and once["holes"]["v_q0"] == 3.0
    assert group_quantiles(df.limit(0), ["k"], {"v": (0.5,)}).count() == 0


def test_ranks_spread_a_group(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, "b").when(F.col("id") == 7, None).otherwise("a").alias("k"), (F.col("id") * 7919 % 20_011).alias("v"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = group_ranks(df, ["k"], [("v", True)], "r", "n")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = out.collect()
    assert len(rows) == 20_000
    for k in ("a", "b", None):
        mine = sorted((r for r in rows if r["k"] == k), key=lambda r: r["r"])
        assert [r["r"] for r in mine] == list(range(len(mine))) and {r["n"] for r in mine} == {len(mine)}
        assert [r["v"] for r in mine] == sorted((r["v"] for r in mine), reverse=True)
    # The key that nine rows of ten have lies in several ranges.
    ranges = [spark.read.parquet(f) for f in out.inputFiles() if "range-heads" not in f]
    assert max(r.where("k = 'a'").count() for r in ranges) < 10_000
    assert group_ranks(df.limit(0), ["k"], [("v", False)], "r").count() == 0


def test_extent_and_frames_of_one_large_scene(spark):
    points = spark.range(70_000).select(F.lit("s").alias("scene_id"), F.col("id").alias("point_idx"), *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(100_003)).cast("double").alias(c) for i, c in enumerate("xyz")])
    exact = points.groupBy("scene_id").agg(*[F.percentile(c, [0.025, 0.975]).alias(c) for c in "xyz"]).first()
    want = sum((exact[c][1] - exact[c][0]) ** 2 for c in "xyz") ** 0.5
    assert cloud.robust_extent(points).first()["extent"] == pytest.approx(want, rel=1e-12)
    kept = [r["point_idx"] for r in cloud.strided_sample(points, 8_000).orderBy("point_idx").collect()]
    assert kept == list(range(0, 70_000, 9))
    chosen = frames.select_frames(points.select("scene_id", F.col("point_idx").alias("frame_ord"), F.col("x").alias("sharpness")))
    assert chosen.count() == 48
