"""Queries over trace spans, stage events and model calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenequarry.functions import labels as lb
from scenequarry.operators import graph, questions, trace
from scenequarry.operators.stored import stored
from scenequarry.plans.registry import REGISTRY
from scenequarry.streaming import folds

add = REGISTRY.add


def _spans(get):
    """Spans with their attributes as JSON, and an end."""
    values = {"scene_id": F.col("scene_attr"), "cost_usd": F.col("usd_attr"), "tokens_in": F.col("in_attr")}
    attributes = F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]))
    end = F.timestamp_micros(F.unix_micros("start_timestamp") + (F.col("duration_ms") * 1000).cast("long"))
    return get("spans").withColumn("attributes", attributes).withColumn("end_timestamp", end)


_TOUCH = "tt AS (SELECT DISTINCT scene_attr AS scene_id, trace_id FROM spans WHERE scene_attr IS NOT NULL)"
_USE = "us AS (SELECT *, coalesce(usd_attr, 0) AS usd, coalesce(TRY_CAST(in_attr AS DOUBLE), 0) AS tokens_in, 0.0 AS tokens_out FROM spans)"


@add("j10_scene_spans", f"WITH {_TOUCH} SELECT scene_id, count(*) AS n, CAST(sum(span_id) AS BIGINT) AS id_sum FROM tt JOIN spans USING (trace_id) GROUP BY scene_id")
def _(get):
    return trace.scene_spans(_spans(get)).groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), F.sum("span_id").alias("id_sum"))


@add("j10_o2_spans_of_scene", "SELECT trace_id, span_id, span_name FROM spans WHERE trace_id IN (SELECT trace_id FROM spans WHERE scene_attr = 's7')")
def _(get):
    return trace.spans_of_scene(_spans(get), "s7").select("trace_id", "span_id", "span_name")


@add("o3_latest_spans", "SELECT span_id, trace_id FROM spans ORDER BY start_timestamp DESC, span_id LIMIT 5000")
def _(get):
    return get("spans").orderBy(F.desc("start_timestamp"), "span_id").limit(5000).select("span_id", "trace_id")


_FOREST = "WITH RECURSIVE f AS (SELECT span_id, span_name, span_id AS root_id, 0 AS depth, CAST(span_id AS STRING) AS path FROM spans s WHERE parent_span_id IS NULL OR parent_span_id NOT IN (SELECT span_id FROM spans) UNION ALL SELECT s.span_id, s.span_name, f.root_id, f.depth + 1, f.path || '/' || CAST(s.span_id AS STRING) FROM spans s JOIN f ON s.parent_span_id = f.span_id AND s.span_id <> f.span_id)"


@add("g6_span_forest", f"{_FOREST} SELECT span_id, root_id, depth, path FROM f")
def _(get):
    return graph.span_forest(get("spans").select("span_id", "parent_span_id"), paths=True).select("span_id", "root_id", "depth", "path")


@add("g7_stage_subtrees", f"{_FOREST}, m AS (SELECT f.span_id, g.span_id AS root, row_number() OVER (PARTITION BY f.span_id ORDER BY g.depth) AS k FROM f JOIN f g ON f.root_id = g.root_id AND (f.path = g.path OR starts_with(f.path, g.path || '/')) WHERE starts_with(g.span_name, 'segmentation.')) SELECT span_id, CAST(root AS STRING) AS matched_root FROM m WHERE k = 1")
def _(get):
    spans = get("spans").select("span_id", "parent_span_id", "span_name")
    forest = graph.span_forest(spans.drop("span_name"))
    return graph.stage_subtrees(forest, spans, "segmentation.").select("span_id", "matched_root")


@add("g8_preorder", f"{_FOREST}, k AS (SELECT span_id, list_aggregate(list_transform(string_split(path, '/'), lambda s: lpad(s, 20, '0')), 'string_agg', '/') AS key FROM f) SELECT span_id, row_number() OVER (ORDER BY key) AS place FROM k")
def _(get):
    from pyspark.sql.window import Window

    forest = stored(graph.preorder(graph.span_forest(get("spans").select("span_id", "parent_span_id"))).select("span_id", "root_id", F.col("place").alias("__i")))
    # Places within a root, then the roots' sizes before it: no window over all rows.
    sizes = forest.groupBy("root_id").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("root_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return forest.join(sizes, "root_id").select("span_id", (F.col("__i") + F.col("__before")).alias("place"))


_COST = f"{_TOUCH}, {_USE}, us2 AS (SELECT tt.scene_id, span_name, usd, tokens_in, tokens_out FROM tt JOIN us USING (trace_id) WHERE usd <> 0 OR tokens_in <> 0)"


def _usage(get):
    """Spans that cost something, for every scene that their trace touches."""
    spans = _spans(get)
    return trace.scene_spans(spans, trace.span_usage(spans).drop("attributes"))


@add("a26_cost_by_span", f"WITH {_COST} SELECT scene_id, span_name, grouping(span_name) = 1 AS is_total, count(*) AS call_count, round(sum(usd), 6) AS usd, sum(tokens_in) AS tokens_in, sum(tokens_out) AS tokens_out FROM us2 GROUP BY GROUPING SETS ((scene_id, span_name), (scene_id))", "usd tokens_in tokens_out", 6)
def _(get):
    return trace.cost_by_span(_usage(get))


@add("a27_chat_cost", f"WITH {_COST}, ch AS (SELECT 's' || CAST(conv_id % 20 AS STRING) AS scene_id, 'agent.chat' AS span_name, count(*) AS call_count, sum(length(text) / 1e6) AS usd, CAST(sum(length(text)) AS DOUBLE) AS tokens_in, 0.0 AS tokens_out FROM conversations GROUP BY 1), al AS (SELECT scene_id, span_name, count(*) AS call_count, round(sum(usd), 6) AS usd, sum(tokens_in) AS tokens_in, sum(tokens_out) AS tokens_out FROM us2 GROUP BY ALL UNION ALL SELECT * FROM ch) SELECT scene_id, span_name, CAST(sum(call_count) AS BIGINT) AS call_count, round(sum(usd), 6) AS usd, sum(tokens_in) AS tokens_in, sum(tokens_out) AS tokens_out, grouping(span_name) = 1 AS is_total FROM al GROUP BY GROUPING SETS ((scene_id, span_name), (scene_id))", "usd tokens_in tokens_out", 6)
def _(get):
    by_span = trace.cost_by_span(_usage(get))
    number = F.regexp_extract("scene_id", r"\d+", 0).cast("int") % 20
    chat = get("model_calls").groupBy(F.concat(F.lit("s"), number.cast("string")).alias("scene_id")).agg(F.count(F.lit(1)).alias("call_count"), F.sum(F.col("tokens_in") / 1e6).alias("usd"), F.sum("tokens_in").cast("double").alias("tokens_in"), F.lit(0.0).alias("tokens_out"))
    return trace.fold_chat_usage(by_span, chat)


def _prices(get):
    """A price for each size of model, in order; the first is the default."""
    n = get("cameras").where("frame_ord < 3").select("frame_ord").distinct()
    return n.select(F.col("frame_ord").alias("ordinal"), F.element_at(F.array(*[F.lit(x) for x in ("small-2", "medium", "large-3")]), (F.col("frame_ord") + 1).cast("int")).alias("prefix"), F.pow(F.lit(3.0), "frame_ord").alias("input_per_m"), (F.pow(F.lit(3.0), "frame_ord") * 5).alias("output_per_m"))


_PRICED = "pc AS (SELECT call_id, scene_id, model, tokens_in, tokens_out, CASE WHEN model LIKE 'medium%' THEN 3.0 WHEN model LIKE 'large-3%' THEN 9.0 ELSE 1.0 END AS input_per_m, CASE WHEN model LIKE 'medium%' THEN 15.0 WHEN model LIKE 'large-3%' THEN 45.0 ELSE 5.0 END AS output_per_m, usd FROM model_calls), pd AS (SELECT *, coalesce(usd, tokens_in / 1e6 * input_per_m + tokens_out / 1e6 * output_per_m) AS cost FROM pc)"


@add("j12_a29_price_calls", f"WITH {_PRICED} SELECT call_id, scene_id, model, input_per_m, output_per_m, cost FROM pd", "input_per_m output_per_m cost")
def _(get):
    return trace.price_calls(get("model_calls"), _prices(get)).select("call_id", "scene_id", "model", "input_per_m", "output_per_m", "cost")


@add("a28_calls_by_scene", f"WITH {_PRICED} SELECT scene_id, count(*) AS call_count, sum(cost) AS total_usd, CAST(sum(tokens_in) AS BIGINT) AS total_tokens_in, CAST(sum(tokens_out) AS BIGINT) AS total_tokens_out FROM pd GROUP BY scene_id", "total_usd")
def _(get):
    return trace.calls_by_scene(trace.price_calls(get("model_calls"), _prices(get)))


@add("j13_live_else_snapshot", f"WITH {_TOUCH}, l AS (SELECT tt.scene_id, span_id FROM tt JOIN spans USING (trace_id) WHERE length(tt.scene_id) = 2), sn AS (SELECT tt.scene_id, span_id FROM tt JOIN spans USING (trace_id) WHERE span_id % 7 = 0) SELECT scene_id, span_id, 'live' AS source FROM l UNION ALL SELECT scene_id, span_id, 'snapshot' FROM sn WHERE scene_id NOT IN (SELECT scene_id FROM l)")
def _(get):
    every = trace.scene_spans(_spans(get)).select("scene_id", "span_id")
    return trace.live_else_snapshot(every.where(F.length("scene_id") == 2), every.where("span_id % 7 = 0"))


@add("a32_f10_waterfall", "WITH t AS (SELECT *, epoch_us(start_timestamp) AS s, epoch_us(start_timestamp) + CAST(duration_ms * 1000 AS BIGINT) AS e FROM spans), b AS (SELECT *, min(s) OVER (PARTITION BY trace_id) AS lo, greatest(max(e) OVER (PARTITION BY trace_id) - min(s) OVER (PARTITION BY trace_id), 1) AS len FROM t) SELECT span_id, (s - lo) / len * 100 AS left_pct, greatest(0.3, (e - s) / len * 100) AS width_pct, CASE WHEN contains(span_name, 'vlm_label') THEN 'model' WHEN starts_with(span_name, 'inference.') THEN 'inference' WHEN starts_with(span_name, 'modal.') THEN 'runtime' WHEN starts_with(span_name, 'segmentation.lift') THEN 'lift' WHEN starts_with(span_name, 'capture.') THEN 'capture' ELSE 'other' END AS family FROM b", "left_pct width_pct")
def _(get):
    return trace.waterfall(_spans(get)).select("span_id", "left_pct", "width_pct", "family")


@add("f8_f9_durations", "SELECT span_id, CASE WHEN span_id % 2 = 0 THEN value ELSE duration_ms / 1000 END AS seconds, CAST(duration_ms * 1000 AS BIGINT) AS micros FROM spans", "seconds")
def _(get):
    spans = _spans(get).withColumn("duration", F.when(F.col("span_id") % 2 == 0, F.col("value")))
    return spans.select("span_id", lb.span_duration(F.col("duration"), F.col("duration_ms")).alias("seconds"), (F.unix_micros("end_timestamp") - F.unix_micros("start_timestamp")).alias("micros"))


@add("f6_span_evidence", "SELECT span_id, 'annotation' AS kind, 'o' || CAST(user_id AS STRING) AS id, span_name AS label, value / 100 AS confidence, false AS duplicate, false AS rejected, CAST(floor(value / 100 * 100 + 0.5) AS INT) AS percent FROM spans WHERE span_id % 5 = 0", "confidence")
def _(get):
    item = F.to_json(F.array(F.struct(F.concat(F.lit("o"), F.col("user_id").cast("string")).alias("id"), F.col("span_name").alias("label"), (F.col("value") / 100).alias("confidence"))))
    attributes = F.when(F.col("span_id") % 5 == 0, F.concat(F.lit('{"annotations": '), item, F.lit("}"))).otherwise("{}")
    found = trace.span_evidence(get("spans").withColumn("attributes", attributes))
    return found.withColumn("percent", F.floor(F.col("confidence") * 100 + 0.5).cast("int"))


@add("p29_cap_payload", "SELECT upload_id, length(text) AS full_length, length(text) > 2000 AS truncated, substr(text, 1, 2000) AS payload FROM uploads")
def _(get):
    return get("uploads").select("upload_id", lb.cap_payload(F.col("text"), 2000).alias("c")).select("upload_id", "c.full_length", "c.truncated", "c.payload")


@add("s7_columns_to_rows", "SELECT trace_id, span_id, span_name, value FROM spans", "value")
def _(get):
    names = ("span_id", "span_name", "value")
    lists = get("spans").groupBy("trace_id").agg(*[F.transform(F.sort_array(F.collect_list(F.struct("span_id", F.col(c).cast("string").alias("v")))), lambda x: x["v"]).alias(c) for c in names])
    body = F.to_json(F.struct(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("values")) for c in names]).alias("columns")))
    return trace.columns_to_rows(lists.select("trace_id", body.alias("body")), "span_id long, span_name string, value double")


_FOLD = """WITH ev AS (SELECT *, row_number() OVER (PARTITION BY scene_id, stage ORDER BY seq DESC) AS k FROM stage_events), st AS (SELECT scene_id, max(status) FILTER (stage = 'capture' AND k = 1) AS capture, max(status) FILTER (stage = 'poses' AND k = 1) AS poses, max(status) FILTER (stage = 'splat' AND k = 1) AS splat, max(status) FILTER (stage = 'segmentation' AND k = 1) AS segmentation, string_agg(stage || ': ' || message, '|' ORDER BY seq) FILTER (status = 'failed') AS errors FROM ev GROUP BY scene_id),
po AS (SELECT *, max(CASE WHEN stage = 'poses' THEN seq END) OVER (PARTITION BY scene_id ORDER BY seq) AS p FROM stage_events), tp AS (SELECT po.scene_id, po.seq, CASE WHEN po.status = 'running' THEN 'processing' WHEN po.status = 'failed' THEN 'failed' WHEN po.stage = 'segmentation' THEN 'ready' WHEN po.stage = 'splat' AND q.status = 'complete' THEN 'ready' END AS t FROM po LEFT JOIN stage_events q ON po.p = q.seq AND po.scene_id = q.scene_id)
SELECT scene_id, coalesce(arg_max(t, seq) FILTER (t IS NOT NULL), 'queued') AS status, any_value(coalesce(capture, 'pending')) AS capture, any_value(coalesce(poses, 'pending')) AS poses, any_value(coalesce(splat, 'pending')) AS splat, any_value(coalesce(segmentation, 'pending')) AS segmentation, any_value(coalesce(errors, '')) AS errors FROM tp JOIN st USING (scene_id) GROUP BY scene_id"""


@add("t1_fold_manifests", _FOLD)
def _(get):
    return folds.fold_manifests(get("stage_events"))


@add("t6_terminal_scenes", _FOLD.replace("SELECT scene_id, coalesce(arg_max", ", fo AS (SELECT scene_id, coalesce(arg_max") + ") SELECT scene_id FROM fo WHERE status IN ('ready', 'failed') AND segmentation IN ('complete', 'failed')")
def _(get):
    return trace.terminal_scenes(folds.fold_manifests(get("stage_events"))).select("scene_id")


@add("t9_stage_windows", "SELECT span_name, CAST(floor(epoch_us(start_timestamp) / 3600000000) AS BIGINT) AS hour, count(*) AS n, sum(duration_ms) AS ms FROM spans GROUP BY ALL", "ms")
def _(get):
    rows = folds.stage_throughput(get("spans"), "1 hour")
    return rows.select("span_name", F.floor(F.unix_micros("window_start") / 3600000000).alias("hour"), "n", "ms")


@add("t2_dedupe_uploads", "SELECT upload_id, scene_id, first_value(scene_id) OVER (PARTITION BY sha256(text) ORDER BY upload_id) AS owner, upload_id <> min(upload_id) OVER (PARTITION BY sha256(text)) AS deduped FROM uploads")
def _(get):
    return folds.dedupe_uploads(get("uploads")).select("upload_id", "scene_id", "owner", "deduped")


@add("f14_content_hashes", "SELECT upload_id, sha256(text) AS sha, length(text) AS n FROM uploads")
def _(get):
    return get("uploads").select("upload_id", lb.content_hash(F.col("text")).alias("sha"), F.length("text").cast("long").alias("n"))


@add("f14_quick_fingerprints", "SELECT upload_id, n || ':' || md5(unhex(substr(h, 1, 8192) || substr(h, greatest(2 * n - 8191, 1), 8192))) AS fingerprint FROM (SELECT upload_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM uploads)")
def _(get):
    return get("uploads").select("upload_id", lb.quick_fingerprint(F.col("text")).alias("fingerprint"))


@add("q6_a30_o1_scene_catalogue", "SELECT scene_id, epoch_us(min(t)) AS created_us, CASE WHEN round(sum(duration_s), 1) <> 0 THEN round(sum(duration_s), 1) END AS total_s FROM (SELECT scene_id, stage, arg_max(duration_s, seq) AS duration_s, min(ts) AS t FROM stage_events GROUP BY scene_id, stage) GROUP BY scene_id", "total_s", 1)
def _(get):
    last = get("stage_events").groupBy("scene_id", "stage").agg(F.max_by("duration_s", "seq").alias("d"), F.min("ts").alias("t"))
    manifests = last.groupBy("scene_id").agg(F.min("t").alias("created_at"), F.transform(F.sort_array(F.collect_list(F.struct("stage", "d"))), lambda x: x["d"]).alias("durations"))
    return questions.scene_catalogue(manifests).withColumn("created_us", F.unix_micros("created_at")).drop("created_at")


@add("q7_trace_summary", f"WITH {_COST}, n AS (SELECT tt.scene_id, count(*) AS span_count, count(DISTINCT trace_id) AS traces FROM tt JOIN spans USING (trace_id) GROUP BY tt.scene_id), c AS (SELECT scene_id, count(*) AS call_count, round(sum(usd), 6) AS usd FROM us2 GROUP BY scene_id) SELECT n.scene_id, span_count, traces, coalesce(call_count, 0) AS call_count, coalesce(usd, 0.0) AS usd FROM n LEFT JOIN c ON n.scene_id = c.scene_id", "usd", 6)
def _(get):
    spans = trace.scene_spans(_spans(get))
    counts = spans.groupBy("scene_id").agg(F.count(F.lit(1)).alias("span_count"), F.count_distinct("trace_id").alias("traces"))
    cost = trace.cost_by_span(trace.span_usage(spans)).where("is_total").select("scene_id", "call_count", "usd")
    return counts.join(cost, "scene_id", "left").na.fill(0, ["call_count"]).na.fill(0.0, ["usd"])
