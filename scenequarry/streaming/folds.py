"""Folds of stage events, uploads and spans, in batch; :mod:`scenequarry.streaming.live` has their streaming twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STAGES = ("capture", "poses", "splat", "segmentation")


def fold_manifests(events: DataFrame) -> DataFrame:
    """Current manifest of each scene from ``events(scene_id, seq, stage, status, message)``.

    A running stage sets the scene to processing, a failed one to failed and adds ``stage: message``; a complete
    segmentation sets it to ready, and so does a complete splat if poses is complete by then. Events count in order of ``seq``.
    """
    order = Window.partitionBy("scene_id").orderBy("seq")
    poses = F.last(F.when(F.col("stage") == "poses", F.col("status")), ignorenulls=True).over(order)
    top = (
        F.when(F.col("status") == "running", "processing").when(F.col("status") == "failed", "failed")
        .when((F.col("status") == "complete") & ((F.col("stage") == "segmentation") | ((F.col("stage") == "splat") & (poses == "complete"))), "ready")
    )
    marked = events.withColumn("__top", top)
    last = [F.coalesce(F.max_by("status", F.when(F.col("stage") == s, F.col("seq"))), F.lit("pending")).alias(s) for s in STAGES]
    errors = F.sort_array(F.collect_list(F.when(F.col("status") == "failed", F.struct("seq", F.concat_ws(": ", "stage", "message").alias("e")))))
    current = F.coalesce(F.max_by("__top", F.when(F.col("__top").isNotNull(), F.col("seq"))), F.lit("queued")).alias("status")
    return marked.groupBy("scene_id").agg(current, *last, F.array_join(F.transform(errors, lambda x: x["e"]), "|").alias("errors"))


def dedupe_uploads(uploads: DataFrame, content: str = "text") -> DataFrame:
    """Uploads with the scene that owns their content: that of the first upload of it. ``deduped`` marks the later ones."""
    hashed = uploads.withColumn("sha", F.sha2(F.col(content).cast("binary"), 256))
    owner = hashed.groupBy("sha").agg(F.min_by("scene_id", "upload_id").alias("owner"), F.min("upload_id").alias("__first"))
    return hashed.join(owner, "sha").withColumn("deduped", F.col("upload_id") != F.col("__first")).drop("__first")


def stage_throughput(spans: DataFrame, width: str = "1 minute") -> DataFrame:
    """Spans and their milliseconds by name and time window; works on streams with a watermark too."""
    grouped = spans.groupBy("span_name", F.window("start_timestamp", width)).agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("ms"))
    return grouped.select("span_name", F.col("window.start").alias("window_start"), "n", "ms")
