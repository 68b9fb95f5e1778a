"""Choosing frames: by camera path, stride, sharpness and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenequarry.functions.geometry import half_even, norm
from scenequarry.operators.order import group_ranks


def path_lengths(cameras: DataFrame, use_center: bool = False) -> DataFrame:
    """Cumulative length of the camera path; ``use_center`` takes camera centres, else translation columns."""
    if use_center:
        at = [-(F.col(f"e0{r}") * F.col("e03") + F.col(f"e1{r}") * F.col("e13") + F.col(f"e2{r}") * F.col("e23")) for r in range(3)]
    else:
        at = [F.col(f"e{r}3") for r in range(3)]
    w = Window.partitionBy("scene_id").orderBy("frame_ord")
    placed = cameras.withColumns({f"__p{r}": c for r, c in enumerate(at)})
    step = F.coalesce(norm(*[F.col(f"__p{r}") - F.lag(f"__p{r}").over(w) for r in range(3)]), F.lit(0.0))
    return placed.withColumn("__step", step).withColumn("length", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("scene_id", "frame_ord", "length")


def keyframes(cameras: DataFrame, n: int = 12, use_center: bool = False) -> DataFrame:
    """``n`` frames at even distances along the path, the first of the nearest; all if there are no more than ``n``.

    Targets that share a nearest frame repeat it (``nth`` tells them apart): a still camera gives the first frame n times.
    """
    paths = path_lengths(cameras, use_center)
    whole = paths.groupBy("scene_id").agg(F.max("length").alias("__l"), F.count(F.lit(1)).alias("__n"))
    few = paths.join(whole.where(F.col("__n") <= n), "scene_id").select("scene_id", (F.row_number().over(Window.partitionBy("scene_id").orderBy("frame_ord")) - 1).cast("int").alias("nth"), "frame_ord")
    targets = whole.where(F.col("__n") > n).select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("nth"), "__l").withColumn("__t", F.col("nth") * F.col("__l") / max(1, n - 1))
    near = targets.join(paths, "scene_id").groupBy("scene_id", "nth").agg(F.min_by("frame_ord", F.struct(F.abs(F.col("length") - F.col("__t")), "frame_ord")).alias("frame_ord"))
    return few.unionByName(near)


def select_frames(frames: DataFrame, most: int = 48, least: int = 8, drop_share: float = 0.2) -> DataFrame:
    """Of ``frames(scene_id, frame_ord, sharpness)``: a stride, then without the blurriest, then evenly spaced to ``most``. No scene is one task's work."""
    ranked = lambda rows, *order: group_ranks(rows, ["scene_id"], order, "__i", "__n")
    # Stride: every n // (2 most)-th of more than 2 most frames.
    stride = F.when(F.col("__n") > 2 * most, F.greatest(F.lit(1), F.floor(F.col("__n") / (2 * most)))).otherwise(1)
    strided = ranked(frames, ("frame_ord", False)).where(F.col("__i") % stride == 0).select(frames.columns)
    # Sharpest: of equally sharp frames the later ones stay.
    keep = F.when(F.col("__n") > least, F.greatest(F.lit(float(least)), half_even(F.col("__n") * (1 - drop_share)))).otherwise(F.col("__n"))
    sharp = ranked(strided, ("sharpness", True), ("frame_ord", True)).where(F.col("__i") < keep).select(frames.columns)
    # Spacing: positions round(i (n - 1) / (most - 1)).
    place = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: half_even(i * (F.col("__n") - 1) / max(1, most - 1)).cast("int"))
    return ranked(sharp, ("frame_ord", False)).where((F.col("__n") <= most) | F.array_contains(place, F.col("__i").cast("int"))).select(frames.columns)


def sample_timeline(rows: DataFrame, key: str, time: str, per_second: float, most: int | None = None) -> DataFrame:
    """The first row of each 1 / ``per_second`` stretch since a key's first row, at most ``most`` of each key."""
    start = rows.groupBy(key).agg(F.min(F.unix_micros(time)).alias("__s"))
    bucket = F.floor((F.unix_micros(time) - F.col("__s")) * per_second / 1e6).alias("bucket")
    row = F.struct(*rows.columns)
    first = rows.join(start, key).groupBy(key, bucket).agg(F.min_by(row, F.struct(F.col(time), *[F.col(c) for c in rows.columns if c not in (key, time)])).alias("r"))
    if most is not None:
        first = first.withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy("bucket"))).where(F.col("__i") <= most)
    return first.select("r.*", "bucket")


def resolve_frames(wanted: DataFrame, cameras: DataFrame) -> DataFrame:
    """Camera of each ``wanted(scene_id, frame_name, frame_ord)``: by name, else by ordinal, else null."""
    by_name = cameras.select("scene_id", "frame_name", F.col("frame_ord").alias("__by_name")).dropDuplicates(["scene_id", "frame_name"])
    by_ord = cameras.select("scene_id", "frame_ord", F.col("frame_ord").alias("__by_ord")).dropDuplicates(["scene_id", "frame_ord"])
    return wanted.join(by_name, ["scene_id", "frame_name"], "left").join(by_ord, ["scene_id", "frame_ord"], "left").withColumn("camera_ord", F.coalesce("__by_name", "__by_ord")).drop("__by_name", "__by_ord")
