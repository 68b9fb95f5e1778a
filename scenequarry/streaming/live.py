"""Structured Streaming twins: stage events to manifests, uploads, spans, cost and clouds as they arrive."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from scenequarry.operators.stored import path_exists, remove_stored, shared_folder, stored
from scenequarry.sources.documents import write_trace_snapshot
from scenequarry.sources.versions import has_scenes, read_scene
from scenequarry.streaming.folds import STAGES, stage_throughput

MANIFEST = "scene_id string, status string, capture string, poses string, splat string, segmentation string, errors string"


class ManifestFold(StatefulProcessor):
    """The manifest of a scene, updated by its events in order of ``seq`` within each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("manifest", "status string, capture string, poses string, splat string, segmentation string, errors string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values("seq")
        old = self.current.get() if self.current.exists() else ("queued", *["pending"] * len(STAGES), "")
        state = dict(zip(("status", *STAGES, "errors"), old, strict=True))
        for stage, status, message in zip(events.stage, events.status, events.message, strict=True):
            if stage in STAGES:
                state[stage] = status
            if status == "running":
                state["status"] = "processing"
            elif status == "failed":
                state["status"] = "failed"
                line = f"{stage}: {message}" if isinstance(message, str) else stage
                state["errors"] = f"{state['errors']}|{line}" if state["errors"] else line
            elif status == "complete" and (stage == "segmentation" or (stage == "splat" and state["poses"] == "complete")):
                state["status"] = "ready"
        self.current.update(tuple(state.values()))
        yield pd.DataFrame([{"scene_id": key[0], **state}])

    def close(self) -> None:
        pass


def stream_manifests(events: DataFrame) -> DataFrame:
    """Manifests as events arrive, in update mode. Needs the RocksDB state store; events of a scene must arrive in order across batches."""
    return events.groupBy("scene_id").transformWithStateInPandas(ManifestFold(), MANIFEST, "Update", "None")


class FirstOwner(StatefulProcessor):
    """Owner of a content hash: the scene of its first upload."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owner = handle.getValueState("owner", "scene_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        uploads = pd.concat(list(rows)).sort_values("upload_id", ignore_index=True)
        known = self.owner.exists()
        owner = self.owner.get()[0] if known else uploads.scene_id.iloc[0]
        if not known:
            self.owner.update((owner,))
        yield pd.DataFrame({"upload_id": uploads.upload_id, "scene_id": uploads.scene_id, "owner": owner, "deduped": [known or i > 0 for i in range(len(uploads))]})

    def close(self) -> None:
        pass


def stream_uploads(uploads: DataFrame, content: str = "text") -> DataFrame:
    """Uploads with the owner of their content, as they arrive. State grows with distinct contents, and holds an id for each."""
    hashed = uploads.select("upload_id", "scene_id", F.sha2(F.col(content).cast("binary"), 256).alias("sha"))
    return hashed.groupBy("sha").transformWithStateInPandas(FirstOwner(), "upload_id long, scene_id string, owner string, deduped boolean", "Append", "None")


def ingest_spans(spans: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Spans once each; a repeat within the watermark's lateness is dropped, later ones are too late."""
    return spans.withWatermark("start_timestamp", lateness).dropDuplicatesWithinWatermark(["span_id"])


def stream_throughput(spans: DataFrame, width: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    return stage_throughput(spans.withWatermark("start_timestamp", lateness), width)


def stream_scene_cost(priced: DataFrame) -> DataFrame:
    """Running cost of each scene, in update mode, from calls with ``cost``."""
    return priced.groupBy("scene_id").agg(F.count(F.lit(1)).alias("call_count"), F.sum("cost").alias("total_usd"), F.sum("tokens_in").alias("total_tokens_in"), F.sum("tokens_out").alias("total_tokens_out"))


def stream_points(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Count and bounds of each scene's cloud as its Parquet parts arrive, in update mode."""
    points = spark.readStream.schema(schema).parquet(folder)
    return points.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{n}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))])


def merge_snapshot(batch: DataFrame, path: str) -> None:
    """Add spans to the snapshots of their scenes: what a snapshot has stays, a span that comes again replaces its last version. Repeating a batch changes nothing."""
    spark = batch.sparkSession
    fresh = batch.withColumn("__new", F.lit(1))
    if has_scenes(spark, path):
        touched = batch.select("scene_id").distinct()
        kept = read_scene(spark, path).drop("snapshot_at").join(touched, "scene_id", "left_semi").withColumn("__new", F.lit(0))
        fresh = kept.unionByName(fresh, allowMissingColumns=True)
    columns = [c for c in fresh.columns if c != "__new"]
    last = fresh.groupBy("scene_id", "span_id").agg(F.max_by(F.struct(*[F.col(c) for c in columns]), "__new").alias("s")).select("s.*")
    # The rows come from the table that they replace: they are stored first.
    done = stored(last, "snapshot")
    write_trace_snapshot(done, path)
    remove_stored(spark, done)


def snapshot_stream(spans: DataFrame, path: str, checkpoint: str, every: str | None = "30 seconds", on_batch: Callable[[DataFrame], None] | None = None):
    """Keep each scene's spans as a snapshot, written at most once in ``every`` (None: what is there, then an end); each batch is merged into the snapshots of its scenes."""

    def write(batch: DataFrame, _: int) -> None:
        merge_snapshot(batch, path)
        if on_batch:
            on_batch(batch)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return spans.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def run_available(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what is there and return what it put out, with its batch number as ``batch``."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/scenequarry-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"

    def write(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/number={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(schema).parquet(f"{root}/out/*") if path_exists(spark, f"{root}/out") else spark.createDataFrame([], schema)
