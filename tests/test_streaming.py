"""Streams give what their batch twins give."""

from pyspark.sql import functions as F

from scenequarry.plans.views import view
from scenequarry.sources.versions import read_scene
from scenequarry.streaming import folds, live

DATA = "/root/testdata/sf0.001"


def _run(df, mode, tmp_path):
    rows = []
    query = df.writeStream.outputMode(mode).foreachBatch(lambda b, _: rows.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return rows


def _stream(spark, df, tmp_path, order):
    where = str(tmp_path / "in")
    cut = df.approxQuantile(order, [0.5], 0.01)[0]
    df.where(F.col(order) <= cut).coalesce(1).write.parquet(where)
    df.where(F.col(order) > cut).coalesce(1).write.mode("append").parquet(where)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(where)


def test_manifest_fold(spark, tmp_path):
    events = view(spark, DATA, "stage_events")
    events.coalesce(1).write.parquet(str(tmp_path / "all"))
    one_batch = spark.readStream.schema(events.schema).parquet(str(tmp_path / "all"))
    got = {r.scene_id: tuple(r) for r in _run(live.stream_manifests(one_batch), "update", tmp_path)}
    assert got == {r.scene_id: tuple(r) for r in folds.fold_manifests(events).collect()}


def test_upload_owners(spark, tmp_path):
    uploads = view(spark, DATA, "uploads")
    uploads.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(uploads.schema).parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in _run(live.stream_uploads(stream), "append", tmp_path)}
    assert got == {tuple(r) for r in folds.dedupe_uploads(uploads).select("upload_id", "scene_id", "owner", "deduped").collect()}


def test_running_cost_and_bounds(spark, tmp_path):
    calls = view(spark, DATA, "model_calls").withColumn("cost", F.col("tokens_in") / 1e6)
    got = {r.scene_id: r.call_count for r in _run(live.stream_scene_cost(_stream(spark, calls, tmp_path, "call_id")), "update", tmp_path)}
    assert got == {r.scene_id: r["count"] for r in calls.groupBy("scene_id").count().collect()}


def test_spans_once(spark, tmp_path):
    spans = view(spark, DATA, "spans").select("span_id", "span_name", "start_timestamp", "duration_ms")
    stream = _stream(spark, spans.unionByName(spans.where("span_id % 10 = 0")), tmp_path, "span_id")
    rows = _run(live.ingest_spans(stream, "60 days"), "append", tmp_path)
    assert sorted(r.span_id for r in rows) == sorted(r.span_id for r in spans.collect())


def test_snapshots_keep_earlier_spans(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    batch = lambda rows: spark.createDataFrame(rows, "scene_id string, span_id long, span_name string")
    live.merge_snapshot(batch([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")]), path)
    for _ in range(2):  # a batch that comes again changes nothing
        live.merge_snapshot(batch([("a", 4, "w"), ("a", 2, "y2")]), path)
    got = {(r.scene_id, r.span_id, r.span_name) for r in read_scene(spark, path).collect()}
    assert got == {("a", 1, "x"), ("a", 2, "y2"), ("a", 4, "w"), ("b", 3, "z")}


def test_manifests_over_batches(spark, tmp_path):
    events = view(spark, DATA, "stage_events")
    rows = _run(live.stream_manifests(_stream(spark, events, tmp_path, "seq")), "update", tmp_path)
    got = {r.scene_id: tuple(r) for r in rows}
    assert got == {r.scene_id: tuple(r) for r in folds.fold_manifests(events).collect()}
