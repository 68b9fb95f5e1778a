"""Queries that run the streams over what the tables hold."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scenequarry.operators.stored import shared_folder
from scenequarry.plans.registry import REGISTRY
from scenequarry.sources.versions import read_scene
from scenequarry.streaming import live

add = REGISTRY.add


@add("t3_ingested_spans", "SELECT span_id, span_name, duration_ms FROM spans", "duration_ms")
def _(get):
    spans = get("spans", stream=True).select("span_id", "span_name", "start_timestamp", "duration_ms")
    # Every tenth span comes twice.
    twice = spans.unionByName(get("spans", stream=True).select(*spans.columns).where("span_id % 10 = 0"))
    return live.run_available(live.ingest_spans(twice, "3650 days"), "append", "ingest").select("span_id", "span_name", "duration_ms")


@add("t4_running_scene_cost", "SELECT scene_id, count(*) AS call_count, sum(tokens_in / 1e6) AS total_usd, CAST(sum(tokens_in) AS BIGINT) AS total_tokens_in, CAST(sum(tokens_out) AS BIGINT) AS total_tokens_out FROM model_calls GROUP BY scene_id", "total_usd")
def _(get):
    calls = get("model_calls", stream=True).withColumn("cost", F.col("tokens_in") / 1e6)
    updates = live.run_available(live.stream_scene_cost(calls), "update", "cost")
    last = F.max_by(F.struct("call_count", "total_usd", "total_tokens_in", "total_tokens_out"), "batch")
    return updates.groupBy("scene_id").agg(last.alias("s")).select("scene_id", "s.*")


@add("t5_span_snapshots", "SELECT scene_attr AS scene_id, span_id, span_name, duration_ms FROM spans WHERE scene_attr IS NOT NULL", "duration_ms")
def _(get):
    spans = get("spans", stream=True).where("scene_attr IS NOT NULL").select(F.col("scene_attr").alias("scene_id"), "span_id", "span_name", "duration_ms")
    spark = spans.sparkSession
    root = f"{shared_folder(spark)}/scenequarry-{spark.sparkContext.applicationId}/snapshots-{uuid.uuid4().hex}"
    live.snapshot_stream(spans, f"{root}/out", f"{root}/checkpoint", every=None).awaitTermination()
    return read_scene(spark, f"{root}/out").select("scene_id", "span_id", "span_name", "duration_ms")
